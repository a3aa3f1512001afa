"""slidelake: a Spark-native engine for tiled-imagery and embedding lakes."""

__version__ = "0.1.0"
