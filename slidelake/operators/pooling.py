"""Vector pooling per group, with map-side partial aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidelake.operators.selection import kth_rows
from slidelake.operators.skew import null_safe_join


def _vec(feat: str) -> Column:
    return array_to_vector(F.col(feat).cast("array<double>"))


def validate_vectors(df: DataFrame, dim: int, feat: str = "feat") -> DataFrame:
    """Add ``ok`` and ``reason``; bad rows are kept."""
    n = F.size(feat)
    reason = F.when(F.col(feat).isNull(), F.lit("missing_feature_file")).when(
        n != dim, F.concat(F.lit("bad_shape("), n.cast("string"), F.lit(")"))
    )
    return df.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


def dedupe_vectors(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key where the same vectors were loaded from several folders: the last by ``order``.

    ``order`` tells the rows of a key apart, as the name of the folder does.
    """
    # Only keys and the order are grouped; a row then sees whether it is the last, so no vector is aggregated.
    own = F.struct(*[F.col(k) for k in keys])
    last = df.select(own.alias("__key"), order).groupBy("__key").agg(F.max(order).alias("__last"))
    kept = df.withColumn("__key", own).join(last, "__key").where(F.col(order).eqNullSafe(F.col("__last")))
    return kept.drop("__key", "__last")


def outcome_counts(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def mean_pool(df: DataFrame, keys: Sequence[str], feat: str = "feat", method: str = "summarizer") -> DataFrame:
    """Element-wise mean per group.

    ``summarizer`` merges one running vector per group and task.  ``explode``
    makes a row per element and is kept as an independent second form.
    """
    return _pool(df, keys, feat, method, Summarizer.mean, F.avg)


def max_pool(df: DataFrame, keys: Sequence[str], feat: str = "feat", method: str = "summarizer") -> DataFrame:
    """Element-wise maximum per group."""
    return _pool(df, keys, feat, method, Summarizer.max, F.max)


def _pool(df, keys, feat, method, vector_agg, scalar_agg) -> DataFrame:
    if method == "summarizer":
        pooled = df.groupBy(*keys).agg(vector_agg(_vec(feat)).alias("__v"), F.count(F.lit(1)).alias("n_rows"))
        return pooled.select(*keys, "n_rows", vector_to_array("__v").alias("emb"))
    if method != "explode":
        raise ValueError(f"unknown pooling method: {method}")
    parts = (
        df.select(*keys, F.posexplode(F.col(feat).cast("array<double>")).alias("__i", "__x"))
        .groupBy(*keys, "__i")
        .agg(scalar_agg("__x").alias("__x"), F.count(F.lit(1)).alias("n_rows"))
    )
    return parts.groupBy(*keys).agg(
        F.max("n_rows").alias("n_rows"),
        F.transform(F.array_sort(F.collect_list(F.struct("__i", "__x"))), lambda s: s["__x"]).alias("emb"),
    )


def topk_softmax_pool(
    df: DataFrame,
    keys: Sequence[str],
    score: str,
    id_col: str,
    feat: str = "feat",
    ratio: float = 0.15,
    min_k: int = 24,
) -> DataFrame:
    """Softmax-weighted mean of each bag's best-scored rows.

    k = min(max(floor(ratio * n), min_k), n), or the number of rows with a
    score if that is less.  As k grows with the bag, its k-th score is found by
    counts (``kth_rows``).  It then tells every row whether it counts, and the
    vectors are summed map-side: they are never shuffled.
    """
    ids = df.select(*keys, F.col(id_col).alias("__id_k"), F.col(score).alias("__s_k"))
    k = F.greatest(F.least(F.greatest(F.floor(F.lit(ratio) * F.col("n_rows")), F.lit(min_k)), F.col("n_known")), F.lit(1))
    last = kth_rows(ids, k, keys, "__s_k", "__id_k", descending=True)
    last = last.select(*keys, "__s_k", "__id_k", F.col("largest").alias("__top"))
    joined = null_safe_join(df, last, keys, [id_col])
    s = F.col(score)
    chosen = (s > F.col("__s_k")) | ((s == F.col("__s_k")) & (F.col(id_col) <= F.col("__id_k")))
    weighted = joined.where(chosen).withColumn("__w", F.exp(s - F.col("__top")))
    summary = Summarizer.metrics("mean").summary(_vec(feat), F.col("__w"))
    return (
        weighted.groupBy(*keys)
        .agg(summary["mean"].alias("__v"), F.count(F.lit(1)).alias("k"))
        .select(*keys, "k", vector_to_array("__v").alias("emb"))
    )


def unpack(df: DataFrame, keys: Sequence[str], emb: str = "emb", digits: int = 6) -> DataFrame:
    """One row per vector element, rounded."""
    return df.select(*keys, F.posexplode(emb).alias("dim", "value")).withColumn(
        "value", F.round("value", digits)
    )


def wide_features(df: DataFrame, keys: Sequence[str], dim: int, emb: str = "emb", prefix: str = "f") -> DataFrame:
    """Vector to columns f0, f1, ..."""
    return df.select(*keys, *[F.get(F.col(emb), F.lit(i)).alias(f"{prefix}{i}") for i in range(dim)])


def narrow_features(df: DataFrame, keys: Sequence[str], prefix: str, emb: str = "emb") -> DataFrame:
    """Columns such as prob_0, prob_1, ... to one array, by numeric suffix."""
    names = [c for c in df.columns if c.startswith(prefix) and c[len(prefix):].isdigit()]
    names.sort(key=lambda c: int(c[len(prefix):]))
    return df.select(*keys, F.array(*names).alias(emb))
