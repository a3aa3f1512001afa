"""Table readers and writers with explicit schemas, and append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slidelake.functions.vectors import l2_norm

LOG_SCHEMA = T.StructType(
    [T.StructField("ts", T.StringType()), T.StructField("epoch", T.StringType()), T.StructField("step", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in ("lr", "loss", "loss_byol", "loss_mfr", "tps", "vram_gb")]
)

STAGE_SCHEMA = T.StructType(
    [
        T.StructField("stage", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("inputs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("outputs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("stats", T.MapType(T.StringType(), T.StringType())),
    ]
)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.option("header", "true").schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Header and quoting on; arrays are joined by ``;`` as CSV has no lists."""
    flat = [
        F.concat_ws(";", F.col(f.name).cast("array<string>")).alias(f.name)
        if isinstance(f.dataType, T.ArrayType)
        else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*flat).write.mode(mode).option("header", "true").option("escape", '"').csv(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines read with a fixed text schema; ``normalize_log`` types them."""
    return spark.read.schema(LOG_SCHEMA).json(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def stage_entry(
    stats_of: DataFrame, stage: str, inputs: dict[str, str], outputs: dict[str, str], stats: dict[str, Column]
) -> DataFrame:
    """One provenance row; its figures are aggregates of ``stats_of``."""

    def text_map(d: dict) -> Column:
        flat: list[Column] = []
        for k, v in d.items():
            flat += [F.lit(k), v.cast("string") if isinstance(v, Column) else F.lit(v).cast("string")]
        return F.create_map(*flat)

    return stats_of.agg(text_map(stats).alias("stats")).select(
        F.lit(stage).alias("stage"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        text_map(inputs).alias("inputs"),
        text_map(outputs).alias("outputs"),
        "stats",
    )


def append_stage(entry: DataFrame, path: str) -> None:
    entry.write.mode("append").json(path)


def read_stages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STAGE_SCHEMA).json(path)


def write_embeddings(df: DataFrame, path: str, dataset: str = "dataset", mode: str = "error") -> None:
    """One folder per data set.

    Rows are rebalanced by data set, so a small one is one file and a large one is split into files of even size.
    """
    df.hint("rebalance", dataset).write.mode(mode).partitionBy(dataset).parquet(path)


def embedding_index(df: DataFrame, emb: str = "emb") -> DataFrame:
    """Index rows of an embedding table: everything but the vector, plus its norm."""
    return df.withColumn("norm", l2_norm(emb)).drop(emb)
