"""Availability, work lists, label joins, fold assignment by cross product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidelake.functions.parsing import parse_center, patient_from_slide, stem
from slidelake.operators.skew import checked_join, group_join


def two_scale_ids(df: DataFrame, id_col: str, scale: str = "scale", scales: Sequence[float] = (0.5, 2.0)) -> DataFrame:
    """Ids present at every scale, found in one pass over the table."""
    seen = [F.bool_or(F.col(scale) == s).alias(f"__s{i}") for i, s in enumerate(scales)]
    both = F.lit(True)
    for i in range(len(scales)):
        both = both & F.col(f"__s{i}")
    return df.groupBy(id_col).agg(*seen).where(both).select(id_col)


def two_scale_counts(df: DataFrame, id_col: str, scale: str = "scale") -> DataFrame:
    """Number of ids at both scales, at 0.5 and at 2.0."""
    seen = df.groupBy(id_col).agg(
        F.bool_or(F.col(scale) == 0.5).alias("a"), F.bool_or(F.col(scale) == 2.0).alias("b")
    )
    return seen.agg(
        F.count_if(F.col("a") & F.col("b")).alias("n_both"), F.count_if("a").alias("n_05"), F.count_if("b").alias("n_20")
    )


def keep_existing(df: DataFrame, existing: Sequence[DataFrame], on: str, row_id: Sequence[str]) -> DataFrame:
    """Rows whose id occurs in every one of the id tables."""
    for ids in existing:
        df = group_join(df, ids.select(on).distinct(), [on], row_id, "left_semi")
    return df


def pending_work(summary: DataFrame, done: DataFrame, id_col: str, scale: str = "scale") -> DataFrame:
    """Per slide, the unfinished scales, the one with most tiles first.

    A slide has a handful of scales, which bounds the list.
    """
    todo = summary.join(done.select(id_col, scale), [id_col, scale], "left_anti")
    entry = F.struct((-F.col("n_tiles")).alias("neg"), F.col(scale).alias("scale"), F.col("n_tiles").alias("n_tiles"))
    return todo.groupBy(id_col).agg(
        F.transform(
            F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["scale"].alias("scale"), e["n_tiles"].alias("n_tiles"))
        ).alias("entries")
    )


def valid_results(results: DataFrame, id_col: str, width: str, dim: int, scales: Sequence[float], scale: str = "scale") -> DataFrame:
    """Ids that have a result of ``dim`` values at every one of ``scales``; a missing or narrow one does not count."""
    good = results.where((F.col(width) == dim) & F.col(scale).isin(list(scales))).select(id_col, scale).distinct()
    return good.groupBy(id_col).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == len(scales)).select(id_col)


def pending_ids(ids: DataFrame, results: DataFrame, id_col: str, width: str, dim: int, scales: Sequence[float], scale: str = "scale") -> DataFrame:
    """Rows of ``ids`` that are not done: both results there and of the right width."""
    return ids.join(valid_results(results, id_col, width, dim, scales, scale), id_col, "left_anti")


def first_by_order(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """First non-NULL value per key, by an explicit order column."""
    return (
        df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
        .groupBy(key)
        .agg(F.min_by(value, order).alias(value))
    )


def label_patients(patients: DataFrame, manifest: DataFrame, values: Sequence[str], order: str, key: str = "patient") -> DataFrame:
    """Attach the first known value of each column; patients lacking one are dropped."""
    named = manifest.where(F.col(key).isNotNull())
    firsts = named.groupBy(key).agg(
        *[F.min_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values]
    )
    return patients.join(firsts.dropna(subset=list(values)), key)


def label_vectors(
    vectors: DataFrame, labels: DataFrame, label: str, order: str, row_id: Sequence[str], key: str = "patient"
) -> DataFrame:
    """Vectors with a non-negative label; a later label row replaces an earlier one."""
    last = labels.where(F.col(label).isNotNull()).groupBy(key).agg(F.max_by(label, order).alias(label))
    return checked_join(vectors, last.where(F.col(label) >= 0), [key], row_id)


def fill_center(
    labels: DataFrame, paths: DataFrame, row_id: Sequence[str], path: str = "path", share: float = 0.1
) -> DataFrame:
    """Fill missing centers from slide paths when more than ``share`` are missing.

    The center of a patient is the most frequent one among its paths, the
    smallest on ties.  What stays unknown becomes -1.
    """
    missing = labels.agg(F.coalesce(F.avg(F.col("center").isNull().cast("double")), F.lit(0.0)).alias("m")).scalar()
    found = paths.select(
        patient_from_slide(stem(path)).alias("patient"), parse_center(path).alias("__c")
    ).where(F.col("patient").isNotNull() & F.col("__c").isNotNull())
    votes = found.groupBy("patient", "__c").agg(F.count(F.lit(1)).alias("__n"))
    mode = votes.groupBy("patient").agg(F.min_by("__c", F.struct(-F.col("__n"), F.col("__c"))).alias("__c"))
    return (
        group_join(labels, mode, ["patient"], row_id, "left")
        .withColumn("center", F.coalesce("center", F.when(missing > share, F.col("__c")), F.lit(-1)))
        .drop("__c")
    )


def fold_roles(df: DataFrame, folds: Column, own: Column) -> DataFrame:
    """Every row once per fold, as ``test`` in its own fold and ``train`` elsewhere."""
    return df.withColumn("eval_fold", F.explode(folds)).withColumn(
        "role", F.when(F.col("eval_fold") == own, F.lit("test")).otherwise(F.lit("train"))
    )


def fold_ids(df: DataFrame, column: str, unknown: int | None = -1, limit: int = 10_000) -> Column:
    """Sorted array of the distinct fold values, usable as ``folds`` of ``fold_roles``.

    There is one fit per fold, so their number is small by nature; more than
    ``limit`` distinct values is an input error and raises.
    """
    vals = df.select(column).where(F.col(column).isNotNull()).distinct()
    if unknown is not None:
        vals = vals.where(F.col(column) != unknown)
    ids = F.array_sort(F.collect_list(column))
    checked = F.when(F.count(F.lit(1)) <= limit, ids).otherwise(F.raise_error(F.lit("too many folds")))
    return vals.limit(limit + 1).agg(checked.alias("ids")).scalar()
