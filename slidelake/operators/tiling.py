"""Pyramid levels, tile grids, mask coverage."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slidelake.operators.skew import side_join

TILE = 256
OVERLAP = 32
STRIDE = TILE - OVERLAP
MIN_COVERAGE = 0.30
BASE_MPP = 0.25


def choose_level(base_mpp: Column, downsamples: Column, target: Column | float) -> Column:
    """Struct (level, approx_mpp) of the level closest to the target resolution.

    The lowest level wins ties.  Level 0 is taken at its plain base resolution
    as well, which is what an unusable pyramid falls back to.
    """
    base = F.coalesce(base_mpp, F.lit(BASE_MPP))
    target = target if isinstance(target, Column) else F.lit(float(target))
    at_base = F.array(
        F.struct(F.abs(base - target).alias("gap"), F.lit(0).alias("level"), base.alias("approx_mpp"))
    )
    levels = F.transform(
        downsamples,
        lambda d, i: F.struct(
            F.abs(base * d - target).alias("gap"), i.alias("level"), (base * d).alias("approx_mpp")
        ),
    )
    # Candidates in trial order; comparing (gap, position) keeps the first on ties.
    tried = F.transform(
        F.concat(at_base, levels),
        lambda s, i: F.struct(s["gap"], i.alias("pos"), s["level"], s["approx_mpp"]),
    )
    best = F.array_min(tried)
    return F.struct(best["level"].alias("level"), best["approx_mpp"].alias("approx_mpp"))


def level_for_downsample(downsamples: Column, wanted: Column | float) -> Column:
    """Struct (level, downsample) of the deepest level that is not coarser than wanted, else level 0."""
    want = wanted if isinstance(wanted, Column) else F.lit(float(wanted))
    levels = F.transform(downsamples, lambda d, i: F.struct(d.cast("double").alias("downsample"), i.alias("level")))
    fine = F.array_max(F.transform(F.filter(levels, lambda e: e["downsample"] <= want), lambda e: F.struct(e["level"], e["downsample"])))
    first = F.get(levels, F.lit(0))
    return F.struct(
        F.coalesce(fine["level"], first["level"]).alias("level"), F.coalesce(fine["downsample"], first["downsample"]).alias("downsample")
    )


def base_origin(x: Column, y: Column, downsample: Column, rounded: bool = True) -> dict[str, Column]:
    """Origin of a level's tile in pixels of level 0: rounded half to even, or cut off."""
    to = F.bround if rounded else F.floor
    return {"base_x": to(x * downsample).cast("bigint"), "base_y": to(y * downsample).cast("bigint")}


def _starts(extent: Column, tile: int, stride: int, strict: bool) -> Column:
    room = extent.cast("bigint") - tile
    steps = F.sequence(F.lit(0).cast("bigint"), F.greatest(room, F.lit(0).cast("bigint")), F.lit(stride).cast("bigint"))
    return F.when(room >= 0, steps) if strict else steps


def tile_grid(
    df: DataFrame, width: str = "level_w", height: str = "level_h", tile: int = TILE, stride: int = STRIDE, strict: bool = False
) -> DataFrame:
    """One row per tile origin (x, y); grid_idx counts with y outside, x inside.

    A level smaller than a tile has one tile at its origin, or none if ``strict``.
    """
    xs = _starts(F.col(width), tile, stride, strict)
    ys = _starts(F.col(height), tile, stride, strict)
    rows = df.select("*", F.posexplode(ys).alias("__row", "y"))
    cells = rows.select("*", F.posexplode(xs).alias("__colno", "x"))
    per_row = F.size(xs)
    return cells.withColumn(
        "grid_idx", (F.col("__row").cast("bigint") * per_row + F.col("__colno")).cast("bigint")
    ).drop("__row", "__colno")


def mask_side(side: Column, width: Column, height: Column, max_side: int = 2048) -> Column:
    """Side of a mask whose longer side is at most ``max_side``."""
    longer = F.greatest(width, height)
    shrink = F.when(longer > max_side, longer / float(max_side)).otherwise(F.lit(1.0))
    return F.floor(side / shrink).cast("bigint")


def mask_scale(mask_side: Column, base_side: Column, downsample: Column) -> Column:
    """Mask pixels per level pixel."""
    return mask_side / base_side * downsample


def roi(mask_w: Column, mask_h: Column, sx: Column, sy: Column, tile: int = TILE) -> dict[str, Column]:
    """Mask rectangle under a tile, cut to the mask without its last row and column."""

    def at(v: Column, s: Column) -> Column:
        return F.floor(v * s).cast("bigint")

    x, y = F.col("x"), F.col("y")
    return {
        "x0": F.greatest(at(x, sx), F.lit(0)),
        "y0": F.greatest(at(y, sy), F.lit(0)),
        "x1": F.least(at(x + tile, sx), mask_w - 1),
        "y1": F.least(at(y + tile, sy), mask_h - 1),
    }


def integral_image(cells: DataFrame, slide: str, value: str) -> DataFrame:
    """Sum of ``value`` over all cells up to and including (mx, my).

    A mask row or column is one window group, so a group is as long as a mask
    side and never as large as a slide.
    """
    along_x = W.partitionBy(slide, "my").orderBy("mx").rowsBetween(W.unboundedPreceding, 0)
    along_y = W.partitionBy(slide, "mx").orderBy("my").rowsBetween(W.unboundedPreceding, 0)
    rows = cells.withColumn("__row_sum", F.sum(value).over(along_x))
    return rows.select(slide, "mx", "my", F.sum("__row_sum").over(along_y).cast("bigint").alias("cum"))


def tile_coverage(tiles: DataFrame, cells: DataFrame, slide: str = "slide", value: str = "tissue") -> DataFrame:
    """Mean of the mask under each tile; tiles carry x0, y0, x1, y1.

    The four corners of the integral image are fetched with one equi-join: each
    tile sends four signed corner keys and the answers are summed per tile.  Both
    sides are sorted by the corner: where cells are exploded from small rows, the
    planner takes them for few and would send the whole image through the driver.
    """
    key = [c for c in tiles.columns]
    sums = integral_image(cells, slide, value)

    def corner(px: Column, py: Column, sign: int) -> Column:
        return F.struct(px.alias("mx"), py.alias("my"), F.lit(sign).alias("sign"))

    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    corners = F.array(
        corner(x1 - 1, y1 - 1, 1), corner(x0 - 1, y1 - 1, -1), corner(x1 - 1, y0 - 1, -1), corner(x0 - 1, y0 - 1, 1)
    )
    asked = tiles.withColumn("__c", F.explode(corners))
    asked = asked.select(*key, F.col("__c.mx").alias("mx"), F.col("__c.my").alias("my"), "__c.sign")
    found = asked.join(sums.hint("merge"), [slide, "mx", "my"], "left")
    total = F.sum(F.coalesce(F.col("cum"), F.lit(0)) * F.col("sign"))
    per_tile = found.groupBy(*key).agg(total.alias("__tissue"))
    area = (x1 - x0) * (y1 - y0)
    empty = (x1 <= x0) | (y1 <= y0)
    return per_tile.withColumn(
        "coverage", F.when(empty, F.lit(0.0)).otherwise(F.col("__tissue") / area)
    ).drop("__tissue")


def grid_coverage(
    geometry: DataFrame,
    cells: DataFrame,
    keys: tuple[str, ...] = ("slide", "scale"),
    slide: str = "slide",
    value: str = "tissue",
    tile: int = TILE,
    stride: int = STRIDE,
) -> DataFrame:
    """Coverage of all grid tiles of ``geometry`` (keys, level_w, level_h, mask_w, mask_h, sx, sy).

    A mask cell lies under the few tiles around it, whose grid numbers follow
    from its position.  So each tissue cell is sent straight to those tiles and
    counted map-side: cells are neither sorted nor shuffled one by one.
    """
    keys = list(keys)
    geo = geometry.select(*keys, "level_w", "level_h", "mask_w", "mask_h", "sx", "sy")
    inside = cells.where(F.col(value) != 0).select(slide, "mx", "my", F.col(value).alias("__v"))
    inside = side_join(inside, geo, slide)
    inside = inside.where((F.col("mx") < F.col("mask_w") - 1) & (F.col("my") < F.col("mask_h") - 1))

    def along(df: DataFrame, name: str, pos: str, extent: str, s: str) -> DataFrame:
        after = F.col(pos) + 1
        last = F.floor(F.greatest(F.col(extent) - tile, F.lit(0)) / stride)
        lo = F.greatest(F.floor((after / F.col(s) - tile) / stride) - 1, F.lit(0)).cast("int")
        hi = F.least(F.floor(after / (F.col(s) * stride)) + 1, last).cast("int")
        near = df.withColumn(name, F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
        i = F.col(name)
        return near.where(
            (F.floor(i * stride * F.col(s)) <= F.col(pos)) & (F.floor((i * stride + tile) * F.col(s)) > F.col(pos))
        )

    rows = along(along(inside, "__i", "mx", "level_w", "sx"), "__j", "my", "level_h", "sy")
    sums = rows.groupBy(*keys, (F.col("__i") * stride).cast("bigint").alias("x"), (F.col("__j") * stride).cast("bigint").alias("y")).agg(
        F.sum("__v").alias("__tissue")
    )
    box = roi(F.col("mask_w"), F.col("mask_h"), F.col("sx"), F.col("sy"), tile)
    tiles = tile_grid(geometry, tile=tile, stride=stride).withColumns(box)
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    empty = (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0"))
    return (
        tiles.join(sums, [*keys, "x", "y"], "left")
        .withColumn("coverage", F.when(empty, F.lit(0.0)).otherwise(F.coalesce("__tissue", F.lit(0)) / area))
        .drop("__tissue", "x0", "y0", "x1", "y1")
    )


def tile_coverage_dense(
    slides: DataFrame, keys: Sequence[str] = ("slide",), tile: int = TILE, stride: int = STRIDE, min_coverage: float | None = None
) -> DataFrame:
    """Coverage from one binary mask per row (keys, mask, mask_w, mask_h, sx, sy, level_w, level_h).

    A mask is a few MB at most, so a slide is a fair unit of work: its tiles are
    cut and measured where the mask is, and only (keys, x, y, grid_idx, coverage)
    leave, of the tiles with at least ``min_coverage`` where it is given.
    """
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                mask = np.frombuffer(row.mask, dtype=np.uint8).reshape(row.mask_h, row.mask_w)
                cum = np.zeros((row.mask_h + 1, row.mask_w + 1), dtype=np.int64)
                cum[1:, 1:] = mask.astype(np.int64).cumsum(0).cumsum(1)
                xs = np.arange(0, max(row.level_w - tile, 0) + 1, stride)
                ys = np.arange(0, max(row.level_h - tile, 0) + 1, stride)
                x0 = np.floor(xs * row.sx).astype(np.int64)
                y0 = np.floor(ys * row.sy).astype(np.int64)
                x1 = np.minimum(np.floor((xs + tile) * row.sx).astype(np.int64), row.mask_w - 1)
                y1 = np.minimum(np.floor((ys + tile) * row.sy).astype(np.int64), row.mask_h - 1)
                ok = (x1 > x0)[None, :] & (y1 > y0)[:, None]
                x0, x1 = np.minimum(x0, row.mask_w), np.maximum(x1, 0)
                y0, y1 = np.minimum(y0, row.mask_h), np.maximum(y1, 0)
                inside = cum[np.ix_(y1, x1)] - cum[np.ix_(y0, x1)] - cum[np.ix_(y1, x0)] + cum[np.ix_(y0, x0)]
                area = (y1 - y0)[:, None] * (x1 - x0)[None, :]
                cov = np.where(ok, inside / np.where(ok, area, 1), 0.0).ravel()
                at = np.arange(cov.size) if min_coverage is None else np.flatnonzero(cov >= min_coverage)
                own = {k: [getattr(row, k)] * len(at) for k in keys}
                yield pd.DataFrame(
                    own | {"x": xs[at % len(xs)], "y": ys[at // len(xs)], "grid_idx": at, "coverage": cov[at]}
                )

    kinds = ", ".join(f"{k} {slides.schema[k].dataType.simpleString()}" for k in keys)
    return slides.select(*keys, "mask", "mask_w", "mask_h", "sx", "sy", "level_w", "level_h").mapInPandas(
        run, f"{kinds}, x bigint, y bigint, grid_idx bigint, coverage double"
    )


def tiling_summary(tiles: DataFrame, keys: tuple[str, ...] = ("slide_id", "cancer_code", "scale")) -> DataFrame:
    return tiles.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_tiles"))


def work_size(summary: DataFrame, slide: str = "slide_id", scale: str = "scale", smallest: int | None = 12) -> DataFrame:
    """Tiles per slide and the scale with most of them; ``smallest`` keeps the n lightest."""
    out = summary.groupBy(slide).agg(
        F.sum("n_tiles").alias("n_tiles"), F.max_by(scale, F.struct("n_tiles", scale)).alias("largest_scale")
    )
    return out if smallest is None else out.orderBy("n_tiles", slide).limit(smallest)
