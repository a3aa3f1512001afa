"""Paired comparison of fold-wise scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def two_sided_t(t: Column, dof: Column) -> Column:
    """Two-sided tail probability of Student's t for whole degrees of freedom.

    The distribution has a closed form as a finite cosine series, so this stays
    a built-in expression.
    """
    theta = F.atan(F.abs(t) / F.sqrt(dof.cast("double")))
    c2 = F.cos(theta) * F.cos(theta)
    odd = dof % 2 == 1
    # Number of series terms after the first, and the factor between terms.
    steps = F.when(odd, (dof - 3) / 2).otherwise((dof - 2) / 2).cast("int")
    shift = F.when(odd, F.lit(1.0)).otherwise(F.lit(0.0))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * c2 * (2 * i - 1 + shift) / (2 * i + shift)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    terms = F.when(steps >= 1, F.sequence(F.lit(1), F.greatest(steps, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    series = F.aggregate(terms, start, step, lambda acc: acc["sum"])
    inside_odd = (2 / math.pi) * (theta + F.when(dof > 1, F.sin(theta) * F.cos(theta) * series).otherwise(F.lit(0.0)))
    inside_even = F.sin(theta) * series
    return F.greatest(F.lit(1.0) - F.when(odd, inside_odd).otherwise(inside_even), F.lit(0.0))


def paired_ttest(
    a: DataFrame, b: DataFrame, on: str, score: str, n_comparisons: int = 1
) -> DataFrame:
    """Paired t, two-sided p, Bonferroni-corrected p, mean difference.

    Every fold must occur on both sides; otherwise the job raises.
    """
    left = a.select(on, F.col(score).cast("double").alias("__a"), F.lit(1).alias("__in_a"))
    right = b.select(on, F.col(score).cast("double").alias("__b"), F.lit(1).alias("__in_b"))
    d = F.col("__a") - F.col("__b")
    unmatched = F.count_if(F.col("__in_a").isNull() | F.col("__in_b").isNull())
    sums = left.join(right, on, "full").agg(
        F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("__s"), F.count(F.lit(1)).alias("n"), unmatched.alias("__u")
    )
    checked = sums.withColumn(
        "n", F.when(F.col("__u") == 0, F.col("n")).otherwise(F.raise_error(F.lit("fold counts must match")))
    )
    t = F.col("mean_diff") / F.nullif(F.col("__s") / F.sqrt(F.col("n").cast("double")), F.lit(0.0))
    out = checked.withColumn("t_stat", t)
    p = two_sided_t(F.col("t_stat"), F.col("n") - 1)
    out = out.withColumn("p_value", F.when(F.col("t_stat").isNotNull(), p))
    corrected = F.when(F.col("p_value").isNotNull(), F.least(F.col("p_value") * n_comparisons, F.lit(1.0)))
    return out.select("n", "t_stat", "p_value", corrected.alias("p_corrected"), "mean_diff")
