"""From a folder of slides to its manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake.operators.manifest import read_properties
from slidelake.operators.skew import group_join, side_join
from slidelake.session import materialize
from slidelake.sources.files import CHUNK, fingerprint_files


def manifest_build(inventory: DataFrame, properties: DataFrame, mode: str = "sha1_quick", chunk: int = CHUNK) -> DataFrame:
    """One row for each file of ``inventory``: its fingerprint, its typed properties, and ``error`` if one of them failed.

    ``properties`` has slide_id and properties (a map), for slides that could be opened; ids must be unique.  No file is
    lost: one without a fingerprint or without properties keeps its row, the other values and the reason.
    """
    prints = fingerprint_files(inventory, mode, chunk)
    given = properties.select("slide_id", "properties", F.lit(True).alias("__opened"))
    joined = side_join(prints, given, "slide_id", "left")
    typed = read_properties(joined)
    missing = F.when(F.col("__opened").isNull(), F.lit("no properties"))
    error = F.nullif(F.concat_ws("; ", "fingerprint_error", missing), F.lit(""))
    return typed.withColumn("error", error).drop("__opened", "properties", "fingerprint_error")


def failures(manifest: DataFrame) -> DataFrame:
    return manifest.where(F.col("error").isNotNull()).select("path", "error")


def hash_index(manifest: DataFrame) -> DataFrame:
    return manifest.select("path", "size_bytes", "fingerprint")


def _alike(rows: DataFrame, *keys: str) -> DataFrame:
    """``__n``: how many rows share the row's keys; one size or digest may be that of most files."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return group_join(rows, counts, keys, ["path"])


def confirmed_duplicates(inventory: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """For each file, how many files have its bytes, itself included, reading only what is needed to tell.

    A size of its own settles a file unread.  Of the others first and last chunk are read; where these collide too, and do
    not cover the file, all of it.  Adds to the rows of ``inventory`` (path, size_bytes, ...; columns of these names are replaced):
    settled_by (size, quick or full), fingerprint (NULL where unread), n_equal, bytes_read and error.  A file that cannot
    be read, or has no size, has no n_equal but the reason.
    """
    added = ("settled_by", "fingerprint", "n_equal", "bytes_read", "error", "fingerprint_error")
    rows = inventory.drop(*added)
    none = F.lit(None).cast("string")

    def settled(df: DataFrame, by: str, read, n_equal, fingerprint=F.col("fingerprint"), error=none) -> DataFrame:
        return df.select(
            *rows.columns, F.lit(by).alias("settled_by"), fingerprint.alias("fingerprint"), n_equal.cast("bigint").alias("n_equal"),
            read.cast("bigint").alias("bytes_read"), error.alias("error"),
        )

    size, n = F.col("size_bytes"), F.col("__n")
    ends = F.least(size, F.lit(chunk)) + F.when(size > chunk, chunk).otherwise(0)
    unread = F.lit(0)
    out = settled(rows.where(size.isNull()), "size", unread, F.lit(None), none, F.lit("no size"))
    sized = materialize(_alike(rows.where(size.isNotNull()), "size_bytes"), "sizes")
    out = out.unionByName(settled(sized.where((n == 1) | (size == 0)), "size", unread, n, none))

    quick = materialize(fingerprint_files(sized.where((n > 1) & (size > 0)).drop("__n"), "sha1_quick", chunk), "quick")
    failed = settled(quick.where(F.col("fingerprint").isNull()), "quick", unread, F.lit(None), error=F.col("fingerprint_error"))
    quick = materialize(_alike(quick.where(F.col("fingerprint").isNotNull()), "size_bytes", "fingerprint"), "quick-alike")
    told = (n == 1) | (size <= 2 * chunk)
    out = out.unionByName(failed).unionByName(settled(quick.where(told), "quick", ends, n))

    full = materialize(fingerprint_files(quick.where(~told).drop("__n", "fingerprint", "fingerprint_error"), "sha1_full"), "full")
    failed = settled(full.where(F.col("fingerprint").isNull()), "full", ends, F.lit(None), error=F.col("fingerprint_error"))
    alike = _alike(full.where(F.col("fingerprint").isNotNull()), "size_bytes", "fingerprint")
    return out.unionByName(failed).unionByName(settled(alike, "full", ends + size, n))
