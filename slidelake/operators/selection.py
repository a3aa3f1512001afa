"""The k-th row of each group by histograms of leading digits, without a sort of all rows."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slidelake.operators.ranking import exact_rank
from slidelake.operators.skew import group_join, is_small
from slidelake.session import materialize

#: Rows of one group that a window may sort in one task.
FEW = 65_536
BUCKETS = 1024


def _magnitude(x: Column) -> Column:
    """A scale on which all doubles, infinite ones and NaN (the largest) too, keep their order and lie within 8,000."""
    size = F.signum(x) * (F.log2(F.abs(x)) + F.lit(1075.0))
    return (
        F.when(F.isnan(x), F.lit(4000.0))
        .when(x == F.lit(float("inf")), F.lit(3000.0))
        .when(x == F.lit(float("-inf")), F.lit(-3000.0))
        .when(x == 0, F.lit(0.0))
        .otherwise(size)
    )


def _digit(buckets: int, descending: bool) -> Column:
    """Which of ``buckets`` slices of lo to hi the value lies in: equal slices, of magnitudes where they differ by more than two."""
    v, lo, hi = F.col("__v"), F.col("lo"), F.col("hi")
    low, span = _magnitude(lo), _magnitude(hi) - _magnitude(lo)
    share = F.when(span > 2, (_magnitude(v) - low) / F.greatest(span, F.lit(2.0))).otherwise((v - lo) / (hi - lo))
    digit = F.least(F.floor(share * buckets).cast("int"), F.lit(buckets - 1))
    return F.lit(buckets - 1) - digit if descending else digit


def _within(rows: DataFrame, state: DataFrame, *more: str) -> DataFrame:
    """Rows between lo and hi of a wanted place of their group; the places are sent to them if they are few."""
    side = state.select("__own", "k", "lo", "hi", "rest", *more)
    joined = rows.join(side.hint("broadcast"), "__own") if is_small(side) else group_join(rows, side, ["__own"], ["__v", "__t"])
    return joined.where((F.col("__v") >= F.col("lo")) & (F.col("__v") <= F.col("hi")))


def kth_rows(
    rows: DataFrame,
    wants: DataFrame | Column,
    keys: Sequence[str],
    value: str,
    tie: str,
    descending: bool = False,
    few: int = FEW,
    buckets: int = BUCKETS,
) -> DataFrame:
    """For each row of ``wants`` (keys, ``k`` from 1, further columns) the ``value`` and ``tie`` of its group's k-th row.

    In place of a table ``wants`` may be one k for each group, in terms of ``n_rows`` and ``n_known``, its rows and those with
    a value.  The result tells the group's ``smallest`` and ``largest`` value too.

    Rows are ordered by ``value``, a number, from the largest if ``descending``, then by rising ``tie``; NaN is the largest
    number.  A NULL value has no place, a NULL key is a key, and a place beyond the group's rows has no row in the result.

    A group of up to ``few`` rows is sorted in one task.  Of a larger one the rows are counted by the leading digit of their
    value, map-side, and then again within the slice that holds the k-th row, until it has few rows or a single value; ties of
    a single value alone are ranked by a range sort.  A pass moves at most ``buckets`` counts per place and task, and there are
    at most about eight: two for the magnitude, six for 52 bits.
    """
    own = F.struct(*[F.col(c) for c in keys]) if keys else F.struct(F.lit(0).alias("__all"))
    narrow = rows.select(own.alias("__own"), F.col(value).cast("double").alias("__v"), F.col(tie).alias("__t"))
    ends = narrow.groupBy("__own").agg(
        F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.count("__v").alias("n_in"), F.count(F.lit(1)).alias("n_rows")
    )
    narrow = narrow.where("__v IS NOT NULL")
    if isinstance(wants, Column):
        more = ["smallest", "largest"]
        places = ends.withColumn("n_known", F.col("n_in")).withColumn("k", wants)
        places = places.withColumns({"smallest": F.col("lo"), "largest": F.col("hi")})
    else:
        more = [c for c in wants.columns if c not in (*keys, "k")]
        places = wants.select(own.alias("__own"), "k", *more).join(ends, "__own")
    k = F.col("k").cast("bigint")
    places = places.select("__own", k.alias("k"), "lo", "hi", "n_in", k.alias("rest"), F.struct(F.lit(0).alias("_"), *more).alias("__more"))
    state, found, n_tied = materialize(places.where((F.col("k") >= 1) & (F.col("k") <= F.col("n_in"))), "places"), [], 0
    wide = (F.col("n_in") > few) & (F.col("lo") < F.col("hi"))
    while True:
        n = state.agg(F.count_if(wide).alias("wide"), F.count_if(~wide & (F.col("n_in") > few)).alias("tied")).first()
        found.append(state.where(~wide))
        n_tied += n["tied"]
        if not n["wide"]:
            break
        kept = ["__own", "k", "rest", "__more"]
        counts = (
            _within(narrow, state.where(wide), "__more").groupBy(*kept, _digit(buckets, descending).alias("digit"))
            .agg(F.count(F.lit(1)).alias("n_in"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        )
        lower = W.partitionBy(*kept).orderBy("digit").rowsBetween(W.unboundedPreceding, -1)
        placed = counts.withColumn("before", F.coalesce(F.sum("n_in").over(lower), F.lit(0)))
        holds = placed.where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("n_in")))
        left = (F.col("rest") - F.col("before")).alias("rest")
        state = materialize(holds.select("__own", "k", "lo", "hi", "n_in", left, "__more"), "places")
    places = functools.reduce(DataFrame.unionByName, found)
    order = [F.col("__v").desc() if descending else F.col("__v").asc(), F.col("__t").asc()]
    local = W.partitionBy("__own", "k", "__more").orderBy(*order)
    out = _within(narrow, places.where(F.col("n_in") <= few), "__more").withColumn("r", F.row_number().over(local))
    if n_tied:
        tied = _within(narrow, places.where(F.col("n_in") > few), "__more")
        ranked = exact_rank(tied, ["__own", "k", "__more"], [F.col("__t").asc()], rank="r")
        out = out.unionByName(ranked.select(*out.columns))
    named = out.where(F.col("r") == F.col("rest"))
    return named.select(
        *[F.col("__own")[c].alias(c) for c in keys], "k", F.col("__v").alias(value), F.col("__t").alias(tie), *[F.col("__more")[c].alias(c) for c in more]
    )


__all__ = ["kth_rows"]
