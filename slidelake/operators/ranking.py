"""Ranks, top-k and running sums that keep working when one group is huge.

A plain window puts a whole group into one task.  The operators here never do:

* ``top_k_per_group`` cuts to k rows per (group, salt) before the final cut, so
  the last step sees at most salts * k rows of a group.
* ``hash_rank`` ranks by a uniform 32-bit hash.  Equal slices of the hash range
  hold equal shares of a group, so rank = rank in slice + rows in lower slices.
* ``slab_rank`` does the same with slices the caller knows.
* ``exact_rank`` and ``running_sums`` order by arbitrary columns.  The rows are
  range-partitioned on (group, order), the partition number is pinned by
  writing the rows out, and per-partition totals give the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slidelake.functions.detrand import U32
from slidelake.operators.skew import partitions
from slidelake.session import materialize


def _with_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pack the group keys into one struct: NULL keys then compare as equal."""
    return df.withColumn("__key", F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0)))


def _offsets(
    parts: DataFrame, slab: str, sums: Sequence[str], maxima: Sequence[str] = (), keep: Sequence[str] = ()
) -> DataFrame:
    """Per (group, slab): the sum over lower slabs and over the whole group."""
    group = W.partitionBy("__key")
    before = group.orderBy(slab).rowsBetween(W.unboundedPreceding, -1)
    return parts.select(
        "__key",
        slab,
        *keep,
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__before_{c}") for c in sums],
        *[F.sum(c).over(group).alias(f"__all_{c}") for c in sums],
        *[F.max(c).over(group).alias(c) for c in maxima],
    )


def top_k_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: Column | int,
    max_k: int,
    salt: Column,
    salts: int | None = None,
    rank: str = "rank_no",
) -> DataFrame:
    """First k rows of each group by ``order``, with their rank from 1.

    ``max_k`` bounds k when k is a column; Spark turns the literal bound into a
    group limit ahead of the shuffle.  ``salt`` is any column that spreads the
    rows of one group, over as many salts as there are shuffle partitions.
    """
    keys, salts = list(keys), salts or partitions(df)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
    local = W.partitionBy(*keys, "__salt").orderBy(*order)
    first = (
        salted.withColumn("__r", F.row_number().over(local))
        .where(F.col("__r") <= max_k)
        .drop("__r", "__salt")
    )
    final = W.partitionBy(*keys).orderBy(*order)
    out = first.withColumn(rank, F.row_number().over(final)).where(F.col(rank) <= max_k)
    if isinstance(k, Column):
        out = out.where(F.col(rank) <= k)
    elif k != max_k:
        out = out.where(F.col(rank) <= k)
    return out


def _rank_in_slabs(slabs: DataFrame, order: Sequence[Column | str], rank: str) -> DataFrame:
    sizes = slabs.groupBy("__key", "__slab").agg(F.count(F.lit(1)).alias("rows"))
    local = W.partitionBy("__key", "__slab").orderBy(*order)
    ranked = slabs.withColumn("__local", F.row_number().over(local))
    joined = ranked.join(_offsets(sizes, "__slab", ["rows"]), ["__key", "__slab"])
    return (
        joined.withColumn(rank, F.col("__local") + F.col("__before_rows"))
        .withColumnRenamed("__all_rows", "group_rows")
        .drop("__key", "__slab", "__local", "__before_rows")
    )


def hash_rank(
    df: DataFrame,
    keys: Sequence[str],
    hash_col: str,
    tiebreak: Sequence[str],
    rank: str = "rank_no",
    slices: int | None = None,
) -> DataFrame:
    """Rank from 1 within each group by (hash_col, tiebreak); also adds group_rows.

    ``hash_col`` must be a uniform 32-bit integer, so that equal slices of its
    range split even a single huge group evenly.
    """
    n = slices or partitions(df)
    cut = _with_key(df, list(keys)).withColumn(
        "__slab", F.floor(F.col(hash_col) * F.lit(n / U32)).cast("int")
    )
    return _rank_in_slabs(cut, [hash_col, *tiebreak], rank)


def slab_rank(
    df: DataFrame, keys: Sequence[str], slab: Column, order: Sequence[Column | str], rank: str = "rank_no"
) -> DataFrame:
    """Rank from 1 within each group where the caller knows an even split.

    ``slab`` must not decrease along ``order`` and must hold few rows per group
    and value, such as a dense id divided by a constant.
    """
    return _rank_in_slabs(_with_key(df, list(keys)).withColumn("__slab", slab), order, rank)


def _slabbed(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], label: str, slab: Column | None = None
) -> DataFrame:
    if slab is not None:
        return _with_key(df, list(keys)).withColumn("__slab", slab)
    ranged = df.repartitionByRange(partitions(df), *[F.col(k) for k in keys], *order)
    return _with_key(materialize(ranged.withColumn("__slab", F.spark_partition_id()), label), list(keys))


def exact_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    rank: str = "rank_no",
    maxima: dict[str, str] | None = None,
) -> DataFrame:
    """Rank from 1 within each group; ``order`` must be unique per group.

    Also adds ``group_rows``, the size of the group, and for each entry of
    ``maxima`` (column -> new name) the maximum over the group.
    """
    maxima = maxima or {}
    by = [*[F.col(k) for k in keys], *order]
    ranged = df.repartitionByRange(partitions(df), *by).sortWithinPartitions(*by)
    # The id of a sorted row is its partition number and its place in it, so the
    # rank within a slab needs no further sort or shuffle.
    placed = _with_key(materialize(ranged.withColumn("__at", F.monotonically_increasing_id()), "rank"), list(keys))
    placed = placed.withColumns({"__slab": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND(2**33 - 1)})
    sizes = placed.groupBy("__key", "__slab").agg(
        F.count(F.lit(1)).alias("rows"), F.min("__at").alias("first"), *[F.max(c).alias(n) for c, n in maxima.items()]
    )
    offsets = _offsets(sizes, "__slab", ["rows"], list(maxima.values()), ["first"])
    joined = placed.join(offsets, ["__key", "__slab"])
    return (
        joined.withColumn(rank, F.col("__at") - F.col("first") + 1 + F.col("__before_rows"))
        .withColumnRenamed("__all_rows", "group_rows")
        .drop("__key", "__slab", "__at", "first", "__before_rows")
    )


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    values: dict[str, str],
    slab: Column | None = None,
) -> DataFrame:
    """Inclusive running sums and group totals of ``values`` (column -> prefix).

    For a value column ``pos`` mapped to ``p`` this adds ``p_run`` and ``p_all``.
    ``order`` must be unique per group, so aggregate ties away first.  Where the
    caller has a ``slab`` as in ``slab_rank``, nothing is written out.
    """
    names = list(values.values())
    slabs = _slabbed(df, keys, order, "running", slab)
    parts = slabs.groupBy("__key", "__slab").agg(*[F.sum(c).alias(p) for c, p in values.items()])
    local = (
        W.partitionBy("__key", "__slab")
        .orderBy(*order)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    summed = slabs.withColumns({f"__local_{p}": F.sum(c).over(local) for c, p in values.items()})
    joined = summed.join(_offsets(parts, "__slab", names), ["__key", "__slab"])
    return joined.withColumns(
        {f"{p}_run": F.col(f"__local_{p}") + F.col(f"__before_{p}") for p in names}
        | {f"{p}_all": F.col(f"__all_{p}") for p in names}
    ).drop("__key", "__slab", *[f"__{w}_{p}" for p in names for w in ("local", "before", "all")])
