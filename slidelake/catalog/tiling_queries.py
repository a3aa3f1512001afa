"""Pyramid, grid, coverage and budget queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from slidelake.catalog import fixtures as fx
from slidelake.catalog.fixtures import Query, sql_u, sql_u32, with_views
from slidelake.functions import parsing
from slidelake.functions.detrand import uniform
from slidelake.operators import budget, joins, tiling
from slidelake.plans import tiling as tiling_plan

BUDGETS = {0.5: 20, 2.0: 8}
SEED = 1337
KEYS = ["bag", "scale"]
CAP = "CASE WHEN scale = 0.5 THEN 20 ELSE 8 END"


def _ids(s, d):
    return fx.tile_features(s, d).drop("feat")


def _norms(s, d):
    # Rounded on both sides, so that ranks agree across engines.
    return budget.norms(fx.tile_features(s, d)).withColumn("norm", F.round("norm", 9))


def _level(s, d):
    base = parsing.first_number("mpp_a", "mpp_b")
    # Some first properties hold text; the second then counts.
    bad = F.when(F.col("doc_id") % 7 == 3, F.lit("n/a")).otherwise(F.col("mpp_a"))
    second = F.when(F.col("doc_id") % 14 == 3, F.lit("0.5")).otherwise(F.col("mpp_b"))
    sl = fx.slides(s, d).withColumns({"mpp_a": bad, "mpp_b": second}).select(
        "slide_id", base.alias("base"), "downsamples", F.explode(F.array(F.lit(0.5), F.lit(2.0))).alias("scale")
    )
    out = sl.withColumn("l", tiling.choose_level(F.col("base"), F.col("downsamples"), F.col("scale")))
    return out.select("slide_id", "scale", "l.level", "l.approx_mpp")


_LEVEL_SQL = """SELECT slide_id, scale, level::INTEGER AS level, approx_mpp FROM (
  SELECT slide_id, scale, level, base * ds AS approx_mpp,
    row_number() OVER (PARTITION BY slide_id, scale ORDER BY abs(base * ds - scale), pos) AS r
  FROM (SELECT slide_id, coalesce(TRY_CAST(a AS DOUBLE), TRY_CAST(b AS DOUBLE), 0.25::DOUBLE) AS base FROM (
    SELECT slide_id, CASE WHEN doc_id % 7 = 3 THEN 'n/a' ELSE mpp_a END AS a, CASE WHEN doc_id % 14 = 3 THEN '0.5' ELSE mpp_b END AS b FROM slides)),
    (VALUES (0, 0, 1::DOUBLE), (1, 0, 1::DOUBLE), (2, 1, 2::DOUBLE), (3, 2, 4::DOUBLE), (4, 3, 8::DOUBLE)) v(pos, level, ds),
    (VALUES (0.5::DOUBLE), (2.0::DOUBLE)) t(scale))
WHERE r = 1"""

_GRID_SQL = """SELECT slide_id, x, y, row_number() OVER (PARTITION BY slide_id ORDER BY y, x) - 1 AS grid_idx FROM (
  SELECT slide_id, unnest(range(0, greatest(width - 256, 0) + 1, 224)) AS x, y FROM (
    SELECT slide_id, width, unnest(range(0, greatest(height - 256, 0) + 1, 224)) AS y FROM slides))"""


def _fine_level(s, d):
    wanted = F.explode(F.array(*[F.lit(x) for x in (0.5, 1.0, 3.9, 4.0, 99.0)]))
    sl = fx.slides(s, d).select("slide_id", "downsamples", wanted.alias("wanted"))
    out = sl.withColumn("l", tiling.level_for_downsample(F.col("downsamples"), F.col("wanted")))
    return out.select("slide_id", "wanted", "l.level", "l.downsample")


def _strict_grid(s, d):
    g = tiling.tile_grid(fx.slides(s, d).select("slide_id", "width", "height"), "width", "height", strict=True)
    at = tiling.base_origin(F.col("x"), F.col("y"), F.lit(1.5))
    cut = tiling.base_origin(F.col("x"), F.col("y"), F.lit(1.3), rounded=False)["base_x"]
    return g.select("slide_id", "x", "y", "grid_idx", *[c.alias(n) for n, c in at.items()], cut.alias("cut_x"))


def _pending_valid(s, d):
    """Bags of which both results are there and of the right width; every third bag's coarse one is too narrow."""
    narrow = (F.col("bag") % 3 == 0) & (F.col("scale") == 2.0)
    results = fx.inventory_done(s, d).withColumn("width", F.when(narrow, 767).otherwise(768))
    return joins.pending_ids(fx.tile_groups(s, d).select("bag").distinct(), results, "bag", "width", 768, (0.5, 2.0))


def mask_slides(s, d):
    return fx.table(s, d, "supplier").select(
        F.col("s_suppkey").alias("slide"),
        F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string")).alias("cancer_code"),
        *[F.lit(1024).alias(c) for c in ("width", "height")],
        *[F.lit(32).alias(c) for c in ("mask_w", "mask_h")],
        F.lit(0.25).alias("base_mpp"),
        F.array(*[F.lit(x) for x in (1.0, 2.0, 4.0, 8.0)]).alias("downsamples"),
    )


def _base_tiles(s, d):
    sl = mask_slides(s, d).select("slide", F.col("width").alias("level_w"), F.col("height").alias("level_h"))
    box = tiling.roi(F.lit(32), F.lit(32), F.lit(1 / 32), F.lit(1 / 32))
    return tiling.tile_grid(sl).select("slide", "x", "y", *[c.alias(n) for n, c in box.items()])


def _coverage(s, d):
    return tiling.tile_coverage(_base_tiles(s, d), fx.masks(s, d)).select("slide", "x", "y", F.round("coverage", 9).alias("coverage"))


def _grid_coverage(s, d):
    geo = mask_slides(s, d).select(
        "slide", F.lit(0.25).alias("scale"), F.col("width").alias("level_w"), F.col("height").alias("level_h"), "mask_w", "mask_h",
        *[F.lit(1 / 32).alias(c) for c in ("sx", "sy")],
    )
    return tiling.grid_coverage(geo, fx.masks(s, d)).select("slide", "x", "y", F.round("coverage", 9).alias("coverage"))


def _masks(s, d):
    """One binary mask per slide."""
    cells = fx.masks(s, d).groupBy("slide").agg(
        F.array_sort(F.collect_list(F.struct("my", "mx", "tissue"))).alias("c")
    )
    byte = F.concat_ws("", F.transform("c", lambda e: F.lpad(e["tissue"].cast("string"), 2, "0")))
    return cells.select("slide", F.unhex(byte).alias("mask"), F.lit(32).alias("mask_w"), F.lit(32).alias("mask_h"))


def _dense(s, d):
    rows = _masks(s, d).select(
        "*", F.lit(1 / 32).alias("sx"), F.lit(1 / 32).alias("sy"), F.lit(1024).alias("level_w"), F.lit(1024).alias("level_h")
    )
    return tiling.tile_coverage_dense(rows).select("slide", "x", "y", F.round("coverage", 9).alias("coverage"))


_COVERAGE_CTE = """SELECT slide, x, y, coalesce(avg(tissue), 0)::DOUBLE AS coverage
FROM (SELECT s_suppkey AS slide, x, y FROM supplier, range(0, 769, 224) a(x), range(0, 769, 224) b(y)) t
LEFT JOIN masks m USING (slide)
WHERE mx >= x // 32 AND mx < least((x + 256) // 32, 31) AND my >= y // 32 AND my < least((y + 256) // 32, 31)
GROUP BY slide, x, y"""


def slide_qc(s, d):
    i = F.col("s_suppkey")
    return fx.table(s, d, "supplier").select(
        i.alias("slide"), uniform("t", i).alias("tissue_pct"), uniform("q", i).alias("white_pct")
    )


def tile_table(s, d):
    return tiling_plan.tile_table(mask_slides(s, d), slide_qc(s, d), _masks(s, d), "medium", {0.5: 3, 2.0: 1}, SEED)


def tiling_flagship(s, d):
    """QC gate, level, grid, coverage, budget and summary in one plan."""
    return tiling.tiling_summary(tile_table(s, d), ("slide", "cancer_code", "scale"))


PLAN_CTES = {
    "gated": f"""SELECT s_suppkey AS slide, 'nation_' || s_nationkey AS cancer_code FROM supplier
WHERE {sql_u("'t|' || s_suppkey")} >= 0.05::DOUBLE AND {sql_u("'q|' || s_suppkey")} <= 0.95::DOUBLE""",
    # Level 1 is 512 wide, mask pixels 1/16; level 3 is 128 wide, mask pixels 1/4.
    "grid": """SELECT slide, cancer_code, 0.5::DOUBLE AS scale, 1 AS level, 0.5::DOUBLE AS approx_mpp, x, y, 2 * (y // 224) + x // 224 AS grid_idx,
  x // 16 AS x0, y // 16 AS y0, least((x + 256) // 16, 31) AS x1, least((y + 256) // 16, 31) AS y1
FROM gated, range(0, 257, 224) a(x), range(0, 257, 224) b(y)
UNION ALL SELECT slide, cancer_code, 2.0::DOUBLE, 3, 2.0::DOUBLE, 0, 0, 0, 0, 0, 31, 31 FROM gated""",
    "covered": """SELECT g.slide, cancer_code, scale, level, approx_mpp, x, y, grid_idx, avg(tissue)::DOUBLE AS coverage FROM grid g
JOIN masks m ON m.slide = g.slide AND mx >= x0 AND mx < x1 AND my >= y0 AND my < y1
GROUP BY ALL HAVING avg(tissue) >= 0.30::DOUBLE""",
    "ranked": f"""SELECT *, row_number() OVER (PARTITION BY slide, scale ORDER BY {sql_u32("'1337|' || tile_id")}, tile_id) AS r,
  count(*) OVER (PARTITION BY slide, scale) AS n, CASE WHEN scale = 0.5 THEN 3 ELSE 1 END AS k
FROM (SELECT *, concat_ws('|', slide, CASE WHEN scale = 0.5 THEN '0.5' ELSE '2.0' END, y, x) AS tile_id FROM covered)""",
    "tile_table": """SELECT slide, cancer_code, scale, level::INTEGER AS level, x::BIGINT AS x, y::BIGINT AS y, 256 AS tile_size, 32 AS overlap, approx_mpp, coverage,
  CASE WHEN n <= k THEN row_number() OVER (PARTITION BY slide, scale ORDER BY grid_idx) - 1 ELSE r - 1 END AS tile_idx, 1337 AS seed
FROM ranked WHERE r <= k""",
}


def _budget_sql(order: str, cols: str = "vec_id") -> str:
    """Budget by ``order`` over the tiles CTE; emit position p of a full group."""
    return f"""SELECT bag, scale, {cols}, CASE WHEN n <= k THEN tile_idx ELSE p END::BIGINT AS tile_idx FROM (
  SELECT *, {order} FROM (
    SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY bag, scale) AS n, {CAP} AS k FROM src WINDOW w AS (ORDERING)))
WHERE r <= k"""


_UNIFORM = _budget_sql("r - 1 AS p").replace(
    "ORDERING", f"PARTITION BY bag, scale ORDER BY {sql_u32(f"'{SEED}|' || vec_id")}, vec_id"
)
_TOPK = _budget_sql("k - r AS p").replace("ORDERING", "PARTITION BY bag, scale ORDER BY norm DESC, vec_id DESC")
_NORM = "round(sqrt(list_sum(list_transform(feat, lambda v: v * v))), 9)"


def _partial_features(s, d):
    """Bag 7 lacks one vector and bag 8 lacks all of them."""
    missing = (F.col("bag") == 8) | ((F.col("bag") == 7) & (F.col("scale") == 0.5) & (F.col("tile_idx") == 0))
    return _norms(s, d).where(~missing)


def _topk_or_uniform(s, d):
    return budget.topk_or_uniform(_ids(s, d), _partial_features(s, d), KEYS, BUDGETS, "vec_id", "tile_idx", SEED).select(
        "bag", "scale", "vec_id", "tile_idx", "mode"
    )


_TOPK_OR_UNIFORM_SQL = f"""SELECT bag, scale, vec_id, CASE WHEN n <= k THEN tile_idx WHEN mode = 'l2_norm' THEN k - r ELSE r - 1 END::BIGINT AS tile_idx, mode
FROM (SELECT *, row_number() OVER (PARTITION BY bag, scale ORDER BY CASE WHEN mode = 'l2_norm' THEN -norm ELSE h END,
    CASE WHEN mode = 'l2_norm' THEN -vec_id ELSE vec_id END) AS r, count(*) OVER (PARTITION BY bag, scale) AS n, {CAP} AS k
  FROM (SELECT *, {_NORM} AS norm, {sql_u32(f"'{SEED}|' || vec_id")}::DOUBLE AS h,
      CASE WHEN bag = 8 OR (bag = 7 AND scale = 0.5) THEN 'uniform' ELSE 'l2_norm' END AS mode FROM tiles))
WHERE r <= k"""


def _pending(s, d):
    summary = fx.tile_groups(s, d)
    todo = joins.pending_work(summary, fx.inventory_done(s, d), "bag")
    text = F.transform("entries", lambda e: F.concat_ws(":", e["scale"].cast("string"), e["n_tiles"].cast("string")))
    return todo.select("bag", F.concat_ws(";", text).alias("entries"))


QUERIES: dict[str, tuple[Query, str | None]] = {
    "level_for_downsample": (
        _fine_level,
        with_views(
            """SELECT slide_id, wanted, level::INTEGER AS level, ds AS downsample FROM (
  SELECT slide_id, wanted, level, ds, row_number() OVER (PARTITION BY slide_id, wanted ORDER BY ds <= wanted DESC, CASE WHEN ds <= wanted THEN -level ELSE level END) AS r
  FROM slides, (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (3.9::DOUBLE), (4.0::DOUBLE), (99.0::DOUBLE)) w(wanted),
    (VALUES (0, 1.0::DOUBLE), (1, 2.0::DOUBLE), (2, 4.0::DOUBLE), (3, 8.0::DOUBLE)) v(level, ds)) WHERE r = 1""", "slides"
        ),
    ),
    "tile_grid_strict": (
        _strict_grid,
        with_views(
            """SELECT slide_id, x, y, row_number() OVER (PARTITION BY slide_id ORDER BY y, x) - 1 AS grid_idx, round_even(x * 1.5::DOUBLE, 0)::BIGINT AS base_x,
  round_even(y * 1.5::DOUBLE, 0)::BIGINT AS base_y, floor(x * 1.3::DOUBLE)::BIGINT AS cut_x FROM (
  SELECT slide_id, unnest(range(0, width - 256 + 1, 224)) AS x, y FROM (
    SELECT slide_id, width, unnest(range(0, height - 256 + 1, 224)) AS y FROM slides WHERE height >= 256) WHERE width >= 256)""", "slides"
        ),
    ),
    "choose_level": (_level, with_views(_LEVEL_SQL, "slides")),
    "tile_grid": (
        lambda s, d: tiling.tile_grid(fx.slides(s, d).select("slide_id", "width", "height"), "width", "height").select("slide_id", "x", "y", "grid_idx"),
        with_views(_GRID_SQL, "slides"),
    ),
    "mask_scale": (
        lambda s, d: fx.slides(s, d).select(
            "slide_id",
            F.explode("downsamples").alias("downsample"),
            *[tiling.mask_side(F.col(a), F.col("width"), F.col("height")).alias(f"mask_{a[0]}") for a in ("width", "height")],
            "width", "height",
        ).select(
            "slide_id", "downsample", "mask_w", "mask_h",
            F.round(tiling.mask_scale(F.col("mask_w"), F.col("width"), F.col("downsample")), 9).alias("sx"),
            F.round(tiling.mask_scale(F.col("mask_h"), F.col("height"), F.col("downsample")), 9).alias("sy"),
        ),
        with_views(
            """SELECT slide_id, ds AS downsample, mask_w, mask_h, round(mask_w / width * ds, 9) AS sx, round(mask_h / height * ds, 9) AS sy
FROM (SELECT slide_id, width, height, floor(width / shrink)::BIGINT AS mask_w, floor(height / shrink)::BIGINT AS mask_h
  FROM (SELECT *, CASE WHEN greatest(width, height) > 2048 THEN greatest(width, height) / 2048::DOUBLE ELSE 1::DOUBLE END AS shrink FROM slides)),
  (SELECT unnest([1, 2, 4, 8])::DOUBLE AS ds)""", "slides"
        ),
    ),
    "tile_coverage": (_coverage, with_views("SELECT slide, x, y, round(coverage, 9) AS coverage FROM coverage", "masks", extra={"coverage": _COVERAGE_CTE})),
    "tile_coverage_dense": (_dense, with_views("SELECT slide, x, y, round(coverage, 9) AS coverage FROM coverage", "masks", extra={"coverage": _COVERAGE_CTE})),
    "grid_coverage": (_grid_coverage, with_views("SELECT slide, x, y, round(coverage, 9) AS coverage FROM coverage", "masks", extra={"coverage": _COVERAGE_CTE})),
    "coverage_filter": (
        lambda s, d: tiling.tile_coverage(_base_tiles(s, d), fx.masks(s, d)).where(F.col("coverage") >= tiling.MIN_COVERAGE).select("slide", "x", "y"),
        with_views("SELECT slide, x, y FROM coverage WHERE coverage >= 0.30::DOUBLE", "masks", extra={"coverage": _COVERAGE_CTE}),
    ),
    "tile_table": (
        lambda s, d: tile_table(s, d).withColumn("coverage", F.round("coverage", 9)),
        with_views("SELECT * REPLACE (round(coverage, 9) AS coverage) FROM tile_table", "masks", extra=PLAN_CTES),
    ),
    "tiling_summary": (
        tiling_flagship,
        with_views("SELECT slide, cancer_code, scale, count(*) AS n_tiles FROM tile_table GROUP BY ALL", "masks", extra=PLAN_CTES),
    ),
    "work_size": (
        lambda s, d: tiling.work_size(fx.tile_groups(s, d), "bag"),
        with_views(
            "SELECT bag, sum(n_tiles)::BIGINT AS n_tiles, arg_max(scale, n_tiles * 10 + scale) AS largest_scale FROM tile_groups GROUP BY bag ORDER BY 2, 1 LIMIT 12",
            "tile_groups",
        ),
    ),
    "sample_uniform": (
        lambda s, d: budget.sample_uniform(_ids(s, d), KEYS, BUDGETS, "vec_id", "tile_idx", SEED).select("bag", "scale", "vec_id", "tile_idx"),
        with_views(_UNIFORM, "tiles", extra={"src": "SELECT bag, scale, vec_id, tile_idx FROM tiles"}),
    ),
    "topk_l2norm": (
        lambda s, d: budget.topk_l2norm(_norms(s, d), KEYS, BUDGETS, "vec_id", "tile_idx").select("bag", "scale", "vec_id", "norm", "tile_idx"),
        with_views(_TOPK.replace("SELECT bag, scale, vec_id,", "SELECT bag, scale, vec_id, norm,"), "tiles", extra={"src": f"SELECT bag, scale, vec_id, tile_idx, {_NORM} AS norm FROM tiles"}),
    ),
    "topk_or_uniform": (_topk_or_uniform, with_views(_TOPK_OR_UNIFORM_SQL, "tiles")),
    "head_budget": (
        lambda s, d: budget.head_budget(_ids(s, d), KEYS, BUDGETS, "tile_idx").select("bag", "scale", "vec_id", "tile_idx"),
        with_views(f"SELECT bag, scale, vec_id, tile_idx FROM tiles WHERE tile_idx < {CAP}", "tiles"),
    ),
    "scan_budget": (
        lambda s, d: budget.scan_budget(_ids(s, d), KEYS, BUDGETS, F.col("vec_id") % 3 > 0, batch=3).select("bag", "scale", "vec_id", F.col("scan_no").cast("bigint").alias("scan_no")),
        with_views(
            """SELECT bag, scale, vec_id, scan_no FROM (
  SELECT *, row_number() OVER (PARTITION BY bag, scale ORDER BY y, x) AS scan_no FROM tiles WHERE vec_id % 3 > 0)
WHERE scan_no <= CASE WHEN scale = 0.5 THEN 21 ELSE 9 END""", "tiles"
        ),
    ),
    "two_scale_ids": (
        lambda s, d: joins.two_scale_ids(fx.tile_groups(s, d), "bag"),
        with_views("SELECT bag FROM tiles WHERE scale = 0.5 INTERSECT SELECT bag FROM tiles WHERE scale = 2.0", "tiles"),
    ),
    "two_scale_counts": (
        lambda s, d: joins.two_scale_counts(fx.tile_groups(s, d), "bag"),
        with_views(
            """SELECT (SELECT count(*) FROM (SELECT bag FROM tiles WHERE scale = 0.5 INTERSECT SELECT bag FROM tiles WHERE scale = 2.0)) AS n_both,
  (SELECT count(DISTINCT bag) FROM tiles WHERE scale = 0.5) AS n_05, (SELECT count(DISTINCT bag) FROM tiles WHERE scale = 2.0) AS n_20""", "tiles"
        ),
    ),
    "existence_semi_join": (
        lambda s, d: joins.keep_existing(
            fx.table(s, d, "embeddings").select("vec_id", F.col("label").cast("int").alias("bag")),
            [fx.tile_groups(s, d).where(F.col("scale") == x) for x in (0.5, 2.0)], "bag", ["vec_id"],
        ),
        with_views(
            """SELECT vec_id, label::INTEGER AS bag FROM embeddings e WHERE EXISTS (SELECT 1 FROM tiles t WHERE t.bag = e.label AND scale = 0.5)
  AND EXISTS (SELECT 1 FROM tiles t WHERE t.bag = e.label AND scale = 2.0)""", "tiles"
        ),
    ),
    "pending_work_valid": (
        _pending_valid,
        with_views(
            """SELECT DISTINCT bag FROM tile_groups g WHERE (
  SELECT count(*) FROM done d WHERE d.bag = g.bag AND NOT (d.bag % 3 = 0 AND d.scale = 2.0)) < 2""", "tile_groups", "done"
        ),
    ),
    "pending_work": (
        _pending,
        with_views(
            """SELECT bag, string_agg(CASE WHEN scale = 0.5 THEN '0.5' ELSE '2.0' END || ':' || n_tiles, ';' ORDER BY n_tiles DESC, scale) AS entries
FROM tile_groups g WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.bag = g.bag AND d.scale = g.scale) GROUP BY bag""", "tile_groups", "done"
        ),
    ),
}
