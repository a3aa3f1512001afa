"""Fold assignment and per-fold standardisation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake.functions.detrand import u32
from slidelake.operators.ranking import exact_rank, hash_rank
from slidelake.operators.skew import checked_join, group_join


def kfold_stratified(df: DataFrame, stratum: str, id_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Deal the rows of each stratum to k folds in hash order.

    Fold sizes differ by at most one per stratum.  A stratum may hold most of the
    rows: ranks come from hash slices, not from one window per stratum.
    """
    hashed = df.withColumn("__h", u32(seed, F.col(id_col)))
    ranked = hash_rank(hashed, [stratum], "__h", [id_col], rank="__r")
    return ranked.withColumn("fold", ((F.col("__r") - 1) % k).cast("int")).drop("__h", "__r", "group_rows")


def kfold_stratified_group(
    df: DataFrame, stratum: str, group: str, row_id: Sequence[str], k: int = 5, seed: int = 42
) -> DataFrame:
    """Folds that keep groups whole and class shares near even.

    Groups are ordered by their commonest class (the smallest on a tie), by falling size and by hash, and dealt to the
    folds to and fro, so groups of one class and of like size go to different folds.  The order is a distributed rank:
    no group, and no number of groups, is special.  Rows with a NULL group are one group.
    """
    own = F.struct(F.col(group))
    counts = df.groupBy(own.alias("__g"), F.col(stratum).cast("string").alias("__c")).agg(F.count(F.lit(1)).alias("n"))
    per_group = counts.groupBy("__g").agg(F.sum("n").alias("n_rows"), F.min(F.struct((-F.col("n")).alias("less"), "__c"))["__c"].alias("main"))
    hashed = per_group.withColumn("__h", u32(seed, F.coalesce(F.col("__g")[group].cast("string"), F.lit(""))))
    order = [F.col("main").asc_nulls_first(), F.col("n_rows").desc(), F.col("__h").asc(), F.col("__g").asc()]
    ranked = exact_rank(hashed, [], order, rank="__r")
    turn = (F.col("__r") - 1) % (2 * k)
    fold_of = ranked.select("__g", F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int").alias("fold"))
    return group_join(df.withColumn("__g", own), fold_of, ["__g"], row_id).drop("__g")


def leave_one_group_out(df: DataFrame, center: str, unknown: int = -1) -> DataFrame:
    """Own fold = own center; rows of unknown center are in every training set."""
    return df.withColumn("fold", F.when(F.col(center) != unknown, F.col(center)))


def center_folds(
    df: DataFrame, center: str, stratum: str, id_col: str, k: int = 5, seed: int = 17, unknown: int = -1
) -> DataFrame:
    """Leave-one-center-out folds, or k stratified folds if fewer than two centers are known."""
    known = df.where(F.col(center) != unknown).select(center).distinct().limit(2).count()
    if known >= 2:
        return leave_one_group_out(df, center, unknown)
    return kfold_stratified(df, stratum, id_col, k, seed)


def label_encode(df: DataFrame, label: str, row_id: Sequence[str]) -> DataFrame:
    """Classes numbered from 0 in sorted order, joined back to the rows."""
    classes = df.select(label).where(F.col(label).isNotNull()).distinct()
    codes = exact_rank(classes, [], [F.col(label).asc()], rank="__r").select(
        label, (F.col("__r") - 1).cast("int").alias("code")
    )
    return group_join(df, codes, [label], row_id)


def fold_moments(df: DataFrame, fold: str, keys: Sequence[str], feat: str, pivot: Sequence[float]) -> DataFrame:
    """(keys, fold, n, mean, m2): each fold's own rows, their mean distance from ``pivot`` and sums of squared deviations.

    Spark's summarizer merges such moments in the map side, one state of a vector's size for each fold and task.  Rows
    without a vector take no part; all others must have the length of ``pivot``.
    """
    origin = F.array(*[F.lit(float(v)) for v in pivot]).cast("array<double>")
    away = F.zip_with(F.col(feat).cast("array<double>"), origin, lambda a, b: a - b)
    state = Summarizer.metrics("count", "mean", "variance").summary(array_to_vector(away))
    own = df.where(F.col(feat).isNotNull()).groupBy(*keys, F.col(fold).alias("fold")).agg(state.alias("__s"))
    spread = F.col("__s.count") - 1
    return own.select(
        *keys,
        "fold",
        F.col("__s.count").alias("n"),
        vector_to_array("__s.mean").alias("mean"),
        F.transform(vector_to_array("__s.variance"), lambda v: v * spread).alias("m2"),
    )


Moments = tuple[int, np.ndarray, np.ndarray]


def merged(a: Moments | None, b: Moments | None) -> Moments | None:
    """The moments of two sets of rows together, from their difference, so that no large squares are subtracted."""
    if a is None or b is None:
        return b if a is None else a
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + gap * gap * (a[0] * b[0] / n)


def _training_moments(pivot: Sequence[float]):
    origin = np.array(pivot, float)

    def run(group: pa.Table) -> pa.Table:
        """One row per fold with the moments of all others: those before it and those after it, merged."""
        group = group.sort_by("fold")
        folds = group.column("fold").to_pylist()
        states = [(r["n"], np.array(r["mean"]), np.array(r["m2"])) for r in group.select(["n", "mean", "m2"]).to_pylist()]
        after = [None]
        for s in reversed(states):
            after.append(merged(s, after[-1]))
        before, rows = None, []
        for i, (f, s) in enumerate(zip(folds, states)):
            others = merged(before, after[len(states) - 1 - i])
            before = merged(before, s)
            if f is not None and others is not None:
                n, mean, m2 = others
                std = np.sqrt(m2 / n)
                rows.append((i, origin + mean, np.where(std < 1e-12, 1.0, std)))
        out, kind = group.take(pa.array([i for i, _, _ in rows], pa.int64())).drop_columns(["n", "mean", "m2"]), pa.list_(pa.float64())
        return out.append_column("mean", pa.array([m for _, m, _ in rows], kind)).append_column("std", pa.array([s for _, _, s in rows], kind))

    return run


def fold_scaling(df: DataFrame, fold: str, keys: Sequence[str], feat: str) -> DataFrame:
    """(keys, fold, mean, std): mean and population deviation of each fold's training rows, as arrays.

    The training rows of a fold are all rows but its own, and rows with a NULL fold are in every training set.  The data
    are read once; the folds' moments, folds times dimensions numbers, are then merged for each fold.  They are taken as
    distances from some row's vector, so that no digits are lost where means are large.
    """
    some = df.where(F.col(feat).isNotNull()).select(F.col(feat).cast("array<double>")).first()
    pivot = some[0] if some else []
    own = fold_moments(df, fold, keys, feat, pivot).withColumn("__all", F.lit(0))
    of = [*keys, "fold", "__all"]
    kinds = dict(own.dtypes)
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in of) + ", mean array<double>, std array<double>"
    groups = own.select(*of, "n", "mean", "m2").groupBy(*keys, "__all")
    return groups.applyInArrow(_training_moments(pivot), ddl).drop("__all")


def fold_stats(df: DataFrame, fold: str, keys: Sequence[str], feat: str) -> DataFrame:
    """``fold_scaling`` as one row per (training fold, dimension)."""
    pairs = F.posexplode(F.arrays_zip("mean", "std")).alias("dim", "__p")
    return fold_scaling(df, fold, keys, feat).select(*keys, "fold", pairs).select(*keys, "fold", "dim", "__p.mean", "__p.std")


def standardize(
    df: DataFrame, stats: DataFrame, fold: str, row_id: Sequence[str], feat: str = "feat"
) -> DataFrame:
    """Scale the rows of each (evaluation fold) with that fold's training statistics.

    ``stats`` has one row per (fold, dimension): a vector's length times the
    number of folds.
    """
    packed = stats.groupBy("fold").agg(
        F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("__st")
    )
    joined = checked_join(df, packed.withColumnRenamed("fold", fold), [fold], row_id)
    scaled = F.zip_with(F.col(feat).cast("array<double>"), F.col("__st"), lambda v, s: (v - s["mean"]) / s["std"])
    return joined.withColumn(feat, scaled).drop("__st")
