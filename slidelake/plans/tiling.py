"""From slides to budgeted tiles.

With one mask per slide the plan is lazy; with a table of mask cells, small jobs check the size of its sides first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake.operators.budget import BUDGETS, sample_uniform
from slidelake.operators.qc import qc_gate
from slidelake.operators.skew import spread
from slidelake.operators.tiling import (
    MIN_COVERAGE,
    OVERLAP,
    TILE,
    choose_level,
    grid_coverage,
    mask_scale,
    tile_coverage_dense,
)


def level_geometry(slides: DataFrame, scales: tuple[float, ...] = (0.5, 2.0)) -> DataFrame:
    """Level, its size and the mask scale of every slide at every scale.

    ``slides`` has slide, width, height, mask_w, mask_h, base_mpp, downsamples.
    """
    at = slides.withColumn("scale", F.explode(F.array(*[F.lit(float(s)) for s in scales])))
    at = at.withColumn("__l", choose_level(F.col("base_mpp"), F.col("downsamples"), F.col("scale")))
    ds = F.element_at("downsamples", F.col("__l.level") + 1)
    at = at.select(
        "*",
        F.col("__l.level").alias("level"),
        F.col("__l.approx_mpp").alias("approx_mpp"),
        F.floor(F.col("width") / ds).cast("bigint").alias("level_w"),
        F.floor(F.col("height") / ds).cast("bigint").alias("level_h"),
        mask_scale(F.col("mask_w"), F.col("width"), ds).alias("sx"),
        mask_scale(F.col("mask_h"), F.col("height"), ds).alias("sy"),
    ).drop("__l", "downsamples")
    # A slide is one small row but thousands of tiles.
    return spread(at, "slide", "scale")


def covered_tiles(slides: DataFrame, masks: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Tiles with enough mask under them.

    ``masks`` is (slide, mask, mask_w, mask_h), one binary mask per slide, as ``tissue_mask`` gives it.  A mask meets
    its slide's scales in one row and is measured once for each, so no mask cell becomes a row.  A table of cells
    (slide, mx, my, tissue) also does, for masks with little in them.  Slides without a mask have no tiles.
    """
    if "mask" not in masks.columns:
        return grid_coverage(level_geometry(slides), masks).where(F.col("coverage") >= min_coverage)
    own = masks.where(F.col("mask").isNotNull()).select("slide", "mask", "mask_w", "mask_h")
    known = slides.drop("mask_w", "mask_h")
    geometry = level_geometry(known.join(own.drop("mask"), "slide"))
    keys = ["slide", "scale"]
    # The small geometry rows go to the masks, a slide with all its scales.
    sized = geometry.select(*keys, "sx", "sy", "level_w", "level_h").join(own, "slide")
    found = tile_coverage_dense(sized, keys, min_coverage=min_coverage)
    return found.join(geometry.select(*keys, "cancer_code", "level", "approx_mpp"), keys)


def tile_table(
    slides: DataFrame,
    qc: DataFrame,
    masks: DataFrame,
    policy: str = "medium",
    budgets: dict[float, int] | None = None,
    seed: int = 1337,
) -> DataFrame:
    """QC gate, level choice, grid, coverage and token budget; one row per kept tile.

    The gate comes first, so refused slides never grow a grid; the budget ranks
    narrow rows.  ``masks`` as in ``covered_tiles``.
    """
    kept = qc_gate(slides, qc, policy, on="slide")
    tiles = covered_tiles(kept, masks).withColumn("tile_id", F.concat_ws("|", "slide", "scale", "y", "x"))
    chosen = sample_uniform(tiles, ["slide", "scale"], budgets or BUDGETS, "tile_id", "grid_idx", seed)
    return chosen.select(
        "slide", "cancer_code", "scale", "level", "x", "y", F.lit(TILE).alias("tile_size"), F.lit(OVERLAP).alias("overlap"),
        "approx_mpp", "coverage", "tile_idx", F.lit(seed).alias("seed"),
    )
