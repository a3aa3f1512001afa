"""Token budgets: at most k tiles per (bag, scale), chosen uniformly or by vector norm.

All selections rank narrow rows (keys, id, order, norm); callers join the wide
feature rows to the survivors afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slidelake.functions.detrand import u32
from slidelake.functions.vectors import l2_norm
from slidelake.operators.ranking import top_k_per_group

# Fixed default budgets per scale (micrometre per pixel).
BUDGETS = {0.5: 1200, 2.0: 400}


def budget_of(scale: str, budgets: dict[float, int]) -> Column:
    """Budget of a row's scale; a row of an unlisted scale raises, so that no tile is lost unnoticed."""
    text = F.concat(F.lit("no budget for scale "), F.coalesce(F.col(scale).cast("string"), F.lit("NULL")))
    out = F.raise_error(text).cast("int")
    for s, k in budgets.items():
        out = F.when(F.col(scale) == s, F.lit(k)).otherwise(out)
    return out


def group_sizes(df: DataFrame, keys: Sequence[str], name: str = "n_candidates") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def _emit(chosen: DataFrame, sizes: DataFrame, keys: Sequence[str], k: Column, order: str, pos: Column) -> DataFrame:
    """Output position: file order when the group fits its budget, else ``pos``.  A NULL key is a group too."""
    in_order = W.partitionBy(*keys).orderBy(order)
    own = F.struct(*[F.col(c) for c in keys]).alias("__key")
    return chosen.select("*", own).join(sizes.select(own, "n_candidates"), "__key").drop("__key").withColumn(
        "tile_idx",
        F.when(F.col("n_candidates") <= k, F.row_number().over(in_order) - 1).otherwise(pos).cast("bigint"),
    )


def sample_uniform(
    tiles: DataFrame,
    keys: Sequence[str],
    budgets: dict[float, int],
    id_col: str,
    order: str,
    seed: int,
    scale: str = "scale",
) -> DataFrame:
    """A uniform sample without replacement of the group's budget, or all of it."""
    k = budget_of(scale, budgets)
    drawn = tiles.withColumn("__h", u32(seed, F.col(id_col)))
    top = top_k_per_group(
        drawn, keys, [F.col("__h"), F.col(id_col)], k, max(budgets.values()), F.col(id_col), rank="__rank"
    )
    out = _emit(top, group_sizes(tiles, keys), keys, k, order, F.col("__rank") - 1)
    return out.drop("__h", "__rank", "n_candidates")


def norms(features: DataFrame, feat: str = "feat") -> DataFrame:
    """Replace the vector by its norm."""
    return features.withColumn("norm", l2_norm(feat)).drop(feat)


def topk_l2norm(
    tiles: DataFrame,
    keys: Sequence[str],
    budgets: dict[float, int],
    id_col: str,
    order: str,
    scale: str = "scale",
    norm: str = "norm",
) -> DataFrame:
    """The group's budget of tiles with the largest norms, emitted by rising norm.

    A group within its budget is emitted whole and in file order.  Equal norms
    rank by id.
    """
    k = budget_of(scale, budgets)
    by_norm = [F.col(norm).desc(), F.col(id_col).desc()]
    top = top_k_per_group(tiles, keys, by_norm, k, max(budgets.values()), F.col(id_col), rank="__rank")
    out = _emit(top, group_sizes(tiles, keys), keys, k, order, k - F.col("__rank"))
    return out.drop("__rank", "n_candidates")


def topk_or_uniform(
    candidates: DataFrame,
    features: DataFrame,
    keys: Sequence[str],
    budgets: dict[float, int],
    id_col: str,
    order: str,
    seed: int,
    scale: str = "scale",
) -> DataFrame:
    """Norm selection where every candidate has a feature row, else a uniform sample.

    The two tables are stacked and counted per group once, which settles the mode; the rows of the table that the mode
    uses are then ranked in one pass, by norm or by hash, and cut to the budget.
    """
    cols = [*keys, id_col, order]
    stacked = candidates.select(*cols, F.lit(None).cast("double").alias("__norm"), F.lit("uniform").alias("mode")).unionByName(
        features.select(*cols, F.col("norm").cast("double").alias("__norm"), F.lit("l2_norm").alias("mode"))
    )
    own = F.struct(*[F.col(c) for c in keys]).alias("__key")
    sizes = stacked.groupBy(own).agg(
        F.count_if(F.col("mode") == "uniform").alias("__c"), F.count_if(F.col("mode") == "l2_norm").alias("__f")
    )
    settled = sizes.where("__c > 0").select(
        "__key", F.when(F.col("__c") == F.col("__f"), "l2_norm").otherwise("uniform").alias("mode"), F.col("__c").alias("n_candidates")
    )
    rows = stacked.select("*", own).join(settled, ["__key", "mode"])
    k = budget_of(scale, budgets)
    by_norm = F.col("mode") == "l2_norm"
    # Ascending in both modes: by falling norm and id, or by hash and id.
    place = [F.when(by_norm, -F.col("__norm")).otherwise(u32(seed, F.col(id_col)).cast("double")), F.when(by_norm, -F.col(id_col)).otherwise(F.col(id_col))]
    top = top_k_per_group(rows, keys, place, k, max(budgets.values()), F.col(id_col), rank="__rank")
    in_order = W.partitionBy(*keys).orderBy(order)
    pos = F.when(by_norm, k - F.col("__rank")).otherwise(F.col("__rank") - 1)
    at = F.when(F.col("n_candidates") <= k, F.row_number().over(in_order) - 1).otherwise(pos).cast("bigint")
    return top.withColumn("tile_idx", at).select(*keys, id_col, "tile_idx", "mode")


def head_budget(
    tiles: DataFrame, keys: Sequence[str], budgets: dict[float, int], order: str, scale: str = "scale"
) -> DataFrame:
    """The first k tiles of each group in file order."""
    k = budget_of(scale, budgets)
    return top_k_per_group(
        tiles, keys, [F.col(order)], k, max(budgets.values()), F.col(order), rank="__rank"
    ).drop("__rank")


def scan_budget(
    tiles: DataFrame,
    keys: Sequence[str],
    budgets: dict[float, int],
    keep: Column,
    order: Sequence[str] = ("y", "x"),
    scale: str = "scale",
    batch: int = 1,
) -> DataFrame:
    """Passing tiles in raster order until the budget is reached.

    The budget is tested only after whole batches, so it is rounded up to a
    multiple of ``batch``; the default of 1 makes it exact.
    """
    caps = {s: math.ceil(k / batch) * batch for s, k in budgets.items()}
    k = budget_of(scale, caps)
    cols = [F.col(c) for c in order]
    return top_k_per_group(
        tiles.where(keep), keys, cols, k, max(caps.values()), F.struct(*cols), rank="scan_no"
    )
