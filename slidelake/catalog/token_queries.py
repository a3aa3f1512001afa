"""Token, vector and pooling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from slidelake.catalog import fixtures as fx
from slidelake.catalog.fixtures import Query, sql_u32, with_views
from slidelake.functions import vectors as v
from slidelake.operators import metrics, pooling, tokens
from slidelake.plans import embedding
from slidelake.session import scratch_path

BUDGETS = {0.5: 20, 2.0: 8}
CAP = "CASE WHEN scale = 0.5 THEN 20 ELSE 8 END"
DIM = 64


def rz(expr: str, digits: int = 6) -> str:
    """Rounded, with negative zero turned into zero."""
    return f"(round({expr}, {digits}) + 0::DOUBLE)"


def word(key: str, w: int) -> str:
    return f"(('0x' || substr(md5({key}), {1 + 8 * w}, 8))::BIGINT / 4294967296::DOUBLE)"


def _patients(s, d):
    return fx.table(s, d, "embeddings").select(
        "vec_id", F.concat(F.lit("patient_"), F.lpad((F.col("vec_id") % 100).cast("string"), 3, "0")).alias("patient"), F.col("embedding").alias("feat")
    )


_PATIENTS = "SELECT vec_id, 'patient_' || lpad((vec_id % 100)::VARCHAR, 3, '0') AS patient, embedding AS feat FROM embeddings"


def _pool_sql(key: str, agg: str, source: str, *views: str) -> str:
    return with_views(
        f"""SELECT {key}, dim, {rz(f"{agg}(v)")} AS value FROM (
  SELECT {key}, unnest(feat)::DOUBLE AS v, (generate_subscripts(feat, 1) - 1)::INTEGER AS dim FROM src) GROUP BY ALL""",
        *views, extra={"src": source},
    )


def _cut(s, d):
    """Vectors of which some are one value short."""
    e = F.col("embedding")
    return fx.table(s, d, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 41 == 0, F.slice(e, 1, DIM - 1)).otherwise(e).alias("feat")
    )


def _softmax_pool(s, d):
    t = fx.tile_features(s, d).withColumn("score", F.element_at("feat", 1))
    return pooling.unpack(pooling.topk_softmax_pool(t, ["bag"], "score", "vec_id"), ["bag", "k"])


_SOFTMAX_POOL = f"""SELECT bag, k, dim, {rz("sum(w * v) / sum(w)")} AS value FROM (
  SELECT bag, k, exp(score - top) AS w, unnest(feat) AS v, (generate_subscripts(feat, 1) - 1)::INTEGER AS dim FROM (
    SELECT *, greatest(least(greatest(floor(0.15::DOUBLE * n), 24), n), 1)::BIGINT AS k FROM (
      SELECT *, feat[1] AS score, max(feat[1]) OVER (PARTITION BY bag) AS top, count(*) OVER (PARTITION BY bag) AS n,
        row_number() OVER (PARTITION BY bag ORDER BY feat[1] DESC, vec_id) AS r FROM tiles)) WHERE r <= k)
GROUP BY ALL"""


def _masked(s, d):
    out = tokens.mask_positions(fx.tile_features(s, d).select("bag", "scale", "vec_id", "feat"), ["bag"], "vec_id", 7)
    return out.select("bag", "scale", "vec_id", "masked", F.round(v.l2_norm("feat"), 6).alias("norm"))


_MASKED = f"""SELECT bag, scale, vec_id, r <= m AS masked, CASE WHEN r <= m THEN 0 ELSE {rz("norm")} END::DOUBLE AS norm FROM (
  SELECT bag, scale, vec_id, sqrt(list_sum(list_transform(feat, lambda x: x * x))) AS norm,
    row_number() OVER (PARTITION BY bag ORDER BY {sql_u32("'7|' || vec_id")}, vec_id) AS r,
    greatest(1, round_even(0.25::DOUBLE * count(*) OVER (PARTITION BY bag), 0)) AS m FROM tiles)"""


def _views(s, d):
    e = fx.table(s, d, "embeddings").withColumn("view", F.explode(F.array(F.lit(1), F.lit(2))))
    out = e.select("vec_id", "view", tokens.augment_view("embedding", [11, F.col("view"), F.col("vec_id")]).alias("emb"))
    return pooling.unpack(out, ["vec_id", "view"])


def _aug_key(prefix: str) -> str:
    return f"{prefix} || '|' || vec_id || '|' || dim"


_EXPLODED = "SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, (generate_subscripts(embedding, 1) - 1)::INTEGER AS dim FROM embeddings"


def _noise(key: str, sigma: str) -> str:
    return f"{sigma}::DOUBLE * sqrt(-2::DOUBLE * ln({word(key, 1)} + 1 / 4294967296::DOUBLE)) * cos(2 * pi() * {word(key, 2)})"


_VIEW_KEY = _aug_key("'11|' || view")
_VIEWS = f"""SELECT vec_id, view, dim, {rz(f"CASE WHEN {word(_VIEW_KEY, 0)} > 0.1::DOUBLE THEN v ELSE 0 END + {_noise(_VIEW_KEY, '0.02')}")} AS value
FROM src, (SELECT unnest([1, 2])::INTEGER AS view)"""


def _aug_bags(s, d):
    e = fx.table(s, d, "embeddings")
    out = e.select("vec_id", tokens.augment_bag("embedding", [13, F.col("label")], [13, F.col("vec_id")]).alias("emb"))
    return pooling.unpack(out, ["vec_id"])


_BAG_KEY = _aug_key("'13'")
_AUG_BAGS = f"""SELECT vec_id, dim, {rz(f'''CASE WHEN {word("'13|' || label || '|drop'", 0)} < 0.3::DOUBLE AND {word(_BAG_KEY, 0)} <= 0.05::DOUBLE THEN 0
  ELSE v + CASE WHEN {word("'13|' || label || '|noise'", 0)} < 0.4::DOUBLE THEN {_noise(_BAG_KEY, '0.01')} ELSE 0 END END''')} AS value FROM src"""


def _padded(s, d, run=tokens.pad_bags, more=("scale",)):
    more = list(more)
    t = fx.tile_features(s, d)
    labels = fx.table(s, d, "embeddings").select(F.col("label").cast("int").alias("bag")).distinct()
    # One bag more per batch that has no tokens at all.
    bags = labels.unionByName(labels.where(F.col("bag") < 3).select((F.col("bag") + 100).alias("bag"))).withColumn(
        "batch", F.col("bag") % 4
    )
    out = run(tokens.token_mm_xy(t), bags, "bag", "batch", "tile_idx", DIM, BUDGETS, carry=["mm_x", "mm_y"] + more)
    keys = ["bag", "batch", *[c for c in out.columns if c == "scale" and not more], "t", "t_max"]
    z = out.select(*keys, F.posexplode(F.arrays_zip("tokens", "pad_mask", "mm_x", "mm_y", *more)).alias("pos", "z"))
    return z.select(
        *keys, "pos", F.col("z.pad_mask").alias("pad"), F.round(v.l2_norm("z.tokens"), 6).alias("norm"),
        *[F.round(F.col("z")[c], 9).alias(c) for c in ("mm_x", "mm_y")], *[F.col("z")[c].alias(c) for c in more],
    )


def _batch(s, d):
    """Every place of every padded row: what it holds of both views, and whether it is padding or masked."""
    t = fx.tile_features(s, d)
    labels = fx.table(s, d, "embeddings").select(F.col("label").cast("int").alias("bag")).distinct()
    bags = labels.unionByName(labels.where(F.col("bag") < 3).select((F.col("bag") + 100).alias("bag"))).withColumn(
        "batch", F.col("bag") % 4
    )
    out = tokens.training_batch(t, bags, "bag", "batch", "tile_idx", DIM, BUDGETS, 17, row_id="vec_id")
    whole = ("view1", "view2", "pad_mask", "mm_x", "mm_y", "scale")
    z = out.select("bag", "batch", "t", "t_max", "mask_index", F.posexplode(F.arrays_zip(*whole)).alias("pos", "z"))
    first = [F.round(F.element_at(F.col("z")[c], 1) + F.lit(0.0), 6).alias(f"{c}_first") for c in ("view1", "view2")]
    return z.select(
        "bag", "batch", "t", "t_max", "pos", F.col("z.pad_mask").alias("pad"), F.array_contains("mask_index", F.col("pos")).alias("masked"),
        *[F.round(v.l2_norm(F.col("z")[c]), 6).alias(f"{c}_norm") for c in ("view1", "view2")], *first,
        *[F.round(F.col("z")[c], 9).alias(c) for c in ("mm_x", "mm_y")], F.col("z.scale").alias("scale"),
    )


_PADDED = f"""SELECT bag, batch, t, t_max, pos, pos >= t AS pad, coalesce({rz("norm")}, 0)::DOUBLE AS norm, coalesce(mm_x, 0)::DOUBLE AS mm_x,
  coalesce(mm_y, 0)::DOUBLE AS mm_y, coalesce(scale, 0)::DOUBLE AS scale FROM (
  SELECT bag, batch, t, t_max, unnest(range(t_max))::INTEGER AS pos FROM (
    SELECT bag, bag % 4 AS batch, greatest(n, 1)::INTEGER AS t, max(greatest(n, 1)) OVER (PARTITION BY bag % 4)::INTEGER AS t_max
    FROM (SELECT b.bag, count(k.bag) AS n FROM bags b LEFT JOIN kept k ON b.bag = k.bag GROUP BY b.bag)))
LEFT JOIN kept USING (bag, pos)"""
_PAD_CTES = {
    "bags": "SELECT DISTINCT label::INTEGER AS bag FROM embeddings UNION SELECT DISTINCT (label + 100)::INTEGER FROM embeddings WHERE label < 3",
    "kept": f"""SELECT bag, (row_number() OVER (PARTITION BY bag ORDER BY scale, tile_idx) - 1)::INTEGER AS pos,
  sqrt(list_sum(list_transform(feat, lambda x: x * x))) AS norm, scale, round((x + 128::DOUBLE) * (scale / 1000), 9) AS mm_x,
  round((y + 128::DOUBLE) * (scale / 1000), 9) AS mm_y FROM tiles WHERE tile_idx < {CAP}""",
}
_BATCH_KEY = "'17|' || view || '|' || bag || '|' || pos || '|' || dim"
_BATCH_CTES = {
    "bags": _PAD_CTES["bags"],
    "kept": _PAD_CTES["kept"].replace("AS norm,", "AS norm, feat,"),
    "slots": """SELECT bag, batch, t, t_max, unnest(range(t_max))::INTEGER AS pos FROM (
  SELECT bag, bag % 4 AS batch, greatest(n, 1)::INTEGER AS t, max(greatest(n, 1)) OVER (PARTITION BY bag % 4)::INTEGER AS t_max
  FROM (SELECT b.bag, count(k.bag) AS n FROM bags b LEFT JOIN kept k ON b.bag = k.bag GROUP BY b.bag))""",
    "masked_slots": f"""SELECT bag, pos FROM (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY {sql_u32("'17|' || bag || '|' || pos")}, pos) AS r
  FROM slots WHERE pos < t) WHERE r <= greatest(1, round_even(0.25::DOUBLE * t, 0))""",
    "mixed": f"""SELECT bag, pos, view, dim, CASE WHEN {word(_BATCH_KEY, 0)} > 0.1::DOUBLE THEN v ELSE 0 END + {_noise(_BATCH_KEY, '0.02')} AS value
  FROM (SELECT bag, pos, unnest(feat)::DOUBLE AS v, (generate_subscripts(feat, 1) - 1)::INTEGER AS dim FROM kept ANTI JOIN masked_slots USING (bag, pos)),
    (SELECT unnest([1, 2])::INTEGER AS view)""",
    "view_norms": f"""SELECT bag, pos, {", ".join(f"{rz(f'sqrt(sum(value * value) FILTER (view = {w}))')} AS view{w}_norm, {rz(f'sum(value) FILTER (view = {w} AND dim = 0)')} AS view{w}_first" for w in (1, 2))}
  FROM mixed GROUP BY bag, pos""",
}
_BATCH = f"""SELECT bag, batch, t, t_max, pos, pos >= t AS pad, m.pos IS NOT NULL AS masked,
  {", ".join(f"coalesce({c}, 0)::DOUBLE AS {c}" for c in ("view1_norm", "view2_norm", "view1_first", "view2_first", "mm_x", "mm_y", "scale"))}
FROM slots LEFT JOIN kept USING (bag, pos) LEFT JOIN view_norms USING (bag, pos) LEFT JOIN masked_slots m USING (bag, pos)"""
_PADDED_BY_SCALE = f"""SELECT bag, batch, scale, t, t_max, pos, pos >= t AS pad, coalesce({rz("norm")}, 0)::DOUBLE AS norm, coalesce(mm_x, 0)::DOUBLE AS mm_x,
  coalesce(mm_y, 0)::DOUBLE AS mm_y FROM (
  SELECT bag, batch, scale, t, t_max, unnest(range(t_max))::INTEGER AS pos FROM (
    SELECT bag, bag % 4 AS batch, scale, greatest(n, 1)::INTEGER AS t, max(greatest(n, 1)) OVER (PARTITION BY bag % 4, scale)::INTEGER AS t_max
    FROM (SELECT b.bag, c.scale, count(k.bag) AS n FROM bags b CROSS JOIN (VALUES (0.5::DOUBLE), (2.0::DOUBLE)) c(scale)
      LEFT JOIN tiles_kept k ON b.bag = k.bag AND c.scale = k.scale GROUP BY ALL)))
LEFT JOIN tiles_kept USING (bag, scale, pos)"""
_SCALE_CTES = {
    "bags": _PAD_CTES["bags"],
    "tiles_kept": _PAD_CTES["kept"].replace("PARTITION BY bag ORDER BY scale, tile_idx", "PARTITION BY bag, scale ORDER BY tile_idx"),
}


def _pairs(s, d, steps: int):
    """Vectors paired with the next ones by id."""
    e = fx.table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("v0"))
    out = e
    for k in range(1, steps + 1):
        out = out.join(e.select((F.col("vec_id") - k).alias("vec_id"), F.col("v0").alias(f"v{k}")), "vec_id")
    return out


def _cos(a: str, b: str) -> str:
    def dot(x, y):
        return f"list_sum(list_transform(range(1, {DIM + 1}), lambda i: {x}[i]::DOUBLE * {y}[i]::DOUBLE))"

    return f"({dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})))"


def _renormalise(s, d):
    raw = F.transform("logits", lambda z: F.greatest(z, F.lit(0.0)))
    out = fx.predictions(s, d).select("seed", "vec_id", v.scale_to_sum(raw).alias("emb"))
    return pooling.unpack(out, ["seed", "vec_id"], digits=9)


def _focal(s, d):
    p = fx.predictions(s, d)
    w = metrics.class_weights(fx.table(s, d, "embeddings").select((F.col("label") % 6).alias("y")), "y", 6)
    weighted = p.join(F.broadcast(w.select(F.col("label").alias("y"), "weight")), "y")
    out = metrics.focal_ce(weighted, "logits", "y", "weight", keys=["seed"])
    return out.withColumn("focal_ce", F.round("focal_ce", 9))


_FOCAL = f"""SELECT seed, round(avg(0.25::DOUBLE * (1 - pt) * (1 - pt) * ce * weight), 9) AS focal_ce FROM (
  SELECT seed, y, greatest(list_sum(list_transform(range(6), lambda i: probs[i + 1] * tgt[i + 1])), 1e-8::DOUBLE) AS pt,
    -list_sum(list_transform(range(6), lambda i: ln(probs[i + 1]) * tgt[i + 1])) AS ce
  FROM (SELECT seed, y, probs, list_transform(range(6), lambda i: 0.05::DOUBLE / 6 + CASE WHEN i = y THEN 0.95::DOUBLE ELSE 0 END) AS tgt FROM predictions))
JOIN weights USING (y) GROUP BY seed"""
_WEIGHTS = """SELECT y, inv / avg(inv) OVER () AS weight, n, total / (6 * n)::DOUBLE AS balanced FROM (
  SELECT y, n, sum(n) OVER () AS total, 1 / greatest(n / sum(n) OVER (), 1e-6::DOUBLE) AS inv FROM (
    SELECT (label % 6)::INTEGER AS y, count(*) AS n FROM embeddings GROUP BY 1))"""


def _wide(s, d):
    e = fx.table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("emb"))
    wide = pooling.wide_features(e, ["vec_id"], DIM)
    back = pooling.narrow_features(wide, ["vec_id"], "f", "again")
    return wide.join(back, "vec_id").select(
        "vec_id", *[F.round(f"f{i}", 6).alias(f"f{i}") for i in range(DIM)], F.round(F.element_at("again", 11), 6).alias("again_10")
    )


def _slide_emb(s, d):
    t = fx.tile_features(s, d)
    out = embedding.slide_embeddings(t, DIM, budgets=BUDGETS)
    return out.select("bag", "t05", "t20", F.round("norm", 6).alias("norm"))


_SLIDE_EMB = f"""SELECT bag, t05, t20, {rz("sqrt(sum(m * m))")} AS norm FROM (
  SELECT bag, dim, avg(v) AS m FROM (SELECT bag, unnest(feat) AS v, generate_subscripts(feat, 1) AS dim FROM kept) GROUP BY ALL)
JOIN (SELECT bag, count(*) FILTER (scale = 0.5) AS t05, count(*) FILTER (scale = 2.0) AS t20 FROM kept GROUP BY bag) USING (bag)
GROUP BY bag, t05, t20"""
_KEPT = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bag, scale ORDER BY {sql_u32("'1337|' || vec_id")}, vec_id) AS r FROM tiles)
WHERE r <= {CAP} AND bag IN (SELECT bag FROM tiles WHERE scale = 0.5 INTERSECT SELECT bag FROM tiles WHERE scale = 2.0)"""


def _outcomes(s, d):
    t = fx.tile_features(s, d)
    out = embedding.embedding_outcomes(t, DIM, budgets=BUDGETS)
    return out.select("bag", "ok", "reason", "t05", "t20", F.round("norm", 6).alias("norm"))


def _export(s, d):
    """Bags of two data sets and others, some with a short vector; what was written is read back."""
    path = scratch_path(s, "export")
    t = fx.tile_features(s, d)
    short = (F.col("bag") == 4) & (F.col("tile_idx") == 0)
    t = t.withColumn("feat", F.when(short, F.slice("feat", 1, DIM - 1)).otherwise(F.col("feat")))
    bags = t.select("bag").distinct()
    sets = [("even", bags.where("bag % 2 = 0")), ("third", bags.where("bag % 3 = 0"))]
    index = embedding.slide_export(t, DIM, sets, path, budgets=BUDGETS)
    written = s.read.parquet(path).select("bag", F.col("dataset").alias("folder"), v.l2_norm("emb").alias("norm"))
    return index.drop("norm").join(written, "bag", "left").select("bag", "dataset", "folder", "ok", "reason", "t05", "t20", F.round("norm", 6).alias("norm"))


def _dedupe(s, d):
    """Vectors found in two folders, the second holding a changed copy of some."""
    e = fx.table(s, d, "embeddings").select("vec_id", F.lit("final").alias("variant"), F.lit("a").alias("folder"), F.col("embedding").alias("emb"))
    again = e.where(F.col("vec_id") % 2 == 0).withColumns({"folder": F.lit("b"), "emb": F.reverse("emb")})
    out = pooling.dedupe_vectors(e.unionByName(again), ["vec_id", "variant"], "folder")
    return out.select("vec_id", "variant", "folder", F.posexplode("emb").alias("dim", "value"))


QUERIES: dict[str, tuple[Query, str | None]] = {
    "attach_meta": (
        lambda s, d: (lambda t: t.select("bag", "scale", "tile_idx", F.round(v.l2_norm("feat"), 6).alias("norm")).join(
            t.select("bag", "scale", "tile_idx", "x", "y"), ["bag", "scale", "tile_idx"]))(fx.tile_features(s, d)),
        with_views(f"""SELECT bag, scale, tile_idx, x, y, {rz("sqrt(list_sum(list_transform(feat, lambda x: x * x)))")} AS norm FROM tiles""", "tiles"),
    ),
    "scale_union": (
        lambda s, d: (lambda t: t.where("scale = 0.5").unionByName(t.where("scale = 2.0")))(fx.tile_features(s, d).drop("feat")),
        with_views("SELECT vec_id, bag, scale, tile_idx, x, y FROM tiles", "tiles"),
    ),
    "validate_vectors": (
        lambda s, d: pooling.validate_vectors(_cut(s, d), DIM).select("vec_id", "ok", "reason"),
        "SELECT vec_id, vec_id % 41 <> 0 AS ok, CASE WHEN vec_id % 41 = 0 THEN 'bad_shape(63)' END AS reason FROM embeddings",
    ),
    "dedupe_embeddings": (
        _dedupe,
        f"""SELECT vec_id, 'final' AS variant, CASE WHEN vec_id % 2 = 0 THEN 'b' ELSE 'a' END AS folder, dim::INTEGER AS dim,
  CASE WHEN vec_id % 2 = 0 THEN embedding[{DIM} - dim] ELSE embedding[dim + 1] END AS value FROM embeddings, range({DIM}) t(dim)""",
    ),
    "outcome_counts": (
        lambda s, d: pooling.outcome_counts(pooling.validate_vectors(_cut(s, d), DIM).withColumn("status", F.when(F.col("ok"), "ok").otherwise("bad"))),
        "SELECT CASE WHEN vec_id % 41 = 0 THEN 'bad' ELSE 'ok' END AS status, count(*) AS n FROM embeddings GROUP BY 1",
    ),
    "patient_mean_pool": (
        lambda s, d: pooling.unpack(pooling.mean_pool(_patients(s, d), ["patient"]), ["patient"]),
        _pool_sql("patient", "avg", _PATIENTS),
    ),
    "patient_max_pool": (
        lambda s, d: pooling.unpack(pooling.max_pool(_patients(s, d), ["patient"]), ["patient"]),
        _pool_sql("patient", "max", _PATIENTS),
    ),
    "bag_mean_pool": (
        lambda s, d: pooling.unpack(pooling.mean_pool(fx.tile_features(s, d), ["bag"]), ["bag"]),
        _pool_sql("bag", "avg", "SELECT bag, feat FROM tiles", "tiles"),
    ),
    "bag_max_pool": (
        lambda s, d: pooling.unpack(pooling.max_pool(fx.tile_features(s, d), ["bag"]), ["bag"]),
        _pool_sql("bag", "max", "SELECT bag, feat FROM tiles", "tiles"),
    ),
    "slide_embeddings": (_slide_emb, with_views(_SLIDE_EMB, "tiles", extra={"kept": _KEPT})),
    "embedding_outcomes": (
        _outcomes,
        with_views(
            f"""SELECT bag, norm IS NOT NULL AS ok, CASE WHEN norm IS NULL THEN 'missing_feature_file' END AS reason, t05, t20, norm
FROM (SELECT DISTINCT bag FROM tiles) LEFT JOIN ({_SLIDE_EMB}) USING (bag)""", "tiles", extra={"kept": _KEPT}
        ),
    ),
    "slide_export": (
        _export,
        with_views(
            f"""SELECT bag, dataset, CASE WHEN ok THEN dataset END AS folder, ok, reason, CASE WHEN ok THEN t05 END AS t05, CASE WHEN ok THEN t20 END AS t20,
  CASE WHEN ok THEN norm END AS norm FROM (
  SELECT *, CASE WHEN bag % 2 = 0 THEN 'even' WHEN bag % 3 = 0 THEN 'third' ELSE 'OTHER' END AS dataset, norm IS NOT NULL AND bag <> 4 AS ok,
    CASE WHEN bag = 4 THEN 'bad_shape({DIM - 1})' WHEN norm IS NULL THEN 'missing_feature_file' END AS reason
  FROM (SELECT DISTINCT bag FROM tiles) LEFT JOIN ({_SLIDE_EMB}) USING (bag))""", "tiles", extra={"kept": _KEPT}
        ),
    ),
    "topk_softmax_pool": (_softmax_pool, with_views(_SOFTMAX_POOL, "tiles")),
    "mask_positions": (_masked, with_views(_MASKED, "tiles")),
    "augment_view": (_views, with_views(_VIEWS, extra={"src": _EXPLODED})),
    "augment_bag": (_aug_bags, with_views(_AUG_BAGS, extra={"src": _EXPLODED})),
    "pad_bags": (_padded, with_views(_PADDED, "tiles", extra=_PAD_CTES)),
    "pad_bags_by_scale": (
        lambda s, d: _padded(s, d, tokens.pad_bags_by_scale, ()),
        with_views(_PADDED_BY_SCALE, "tiles", extra=_SCALE_CTES),
    ),
    "training_batch": (_batch, with_views(_BATCH, "tiles", extra=_BATCH_CTES)),
    "token_mm_xy": (
        lambda s, d: tokens.token_mm_xy(fx.tile_features(s, d)).select("vec_id", F.round("mm_x", 9).alias("mm_x"), F.round("mm_y", 9).alias("mm_y")),
        with_views("SELECT vec_id, round((x + 128::DOUBLE) * (scale / 1000), 9) AS mm_x, round((y + 128::DOUBLE) * (scale / 1000), 9) AS mm_y FROM tiles", "tiles"),
    ),
    "l2_norm": (
        lambda s, d: fx.table(s, d, "embeddings").select("vec_id", F.round(v.l2_norm("embedding"), 9).alias("norm")),
        "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 9) AS norm FROM embeddings",
    ),
    "cosine_loss": (
        lambda s, d: tokens.cosine_loss(_pairs(s, d, 1), "v0", "v1").select(F.round("loss", 9).alias("loss")),
        f"""SELECT round(avg(1 - {_cos('v0', 'v1')}), 9) AS loss FROM (
  SELECT a.embedding AS v0, b.embedding AS v1 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)""",
    ),
    "two_view_loss": (
        lambda s, d: tokens.two_view_loss(_pairs(s, d, 3).withColumn("m", F.col("vec_id") % 4 == 0), "v0", "v1", "v2", "v3", "m").select(
            *[F.round(c, 9).alias(c) for c in ("loss_view", "loss_token", "loss")]
        ),
        f"""SELECT round(lv, 9) AS loss_view, round(lt, 9) AS loss_token, round(lv + 0.5::DOUBLE * lt, 9) AS loss FROM (
  SELECT avg(a + b) / 2 AS lv, avg(a + b) FILTER (m) / 2 AS lt FROM (
    SELECT a.vec_id % 4 = 0 AS m, 1 - {_cos('a.embedding', 'b.embedding')} AS a, 1 - {_cos('c.embedding', 'd.embedding')} AS b
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2 JOIN embeddings d ON d.vec_id = a.vec_id + 3))""",
    ),
    "softmax_rows": (
        lambda s, d: pooling.unpack(fx.predictions(s, d).select("seed", "vec_id", v.softmax("logits").alias("emb")), ["seed", "vec_id"], digits=9),
        with_views("SELECT seed, vec_id, dim::INTEGER AS dim, round(probs[dim + 1], 9) AS value FROM predictions, range(6) t(dim)", "predictions"),
    ),
    "probability_renormalise": (
        _renormalise,
        with_views(
            """SELECT seed, vec_id, dim::INTEGER AS dim, round(greatest(logits[dim + 1], 0) / CASE WHEN total = 0 THEN 1 ELSE total END, 9) AS value
FROM (SELECT *, list_sum(list_transform(logits, lambda z: greatest(z, 0::DOUBLE))) AS total FROM predictions), range(6) t(dim)""", "predictions"
        ),
    ),
    "argmax": (
        lambda s, d: fx.predictions(s, d).select("seed", "vec_id", v.argmax("logits").alias("pred")),
        with_views(
            """SELECT seed, vec_id, (SELECT arg_max(dim, logits[dim + 1])::INTEGER FROM range(6) t(dim)) AS pred FROM predictions""", "predictions"
        ),
    ),
    "expected_class_tail_mass": (
        lambda s, d: fx.predictions(s, d).select(
            "seed", "vec_id", F.round(v.expected_index("probs"), 9).alias("expected"), F.round(v.tail_mass("probs", 3), 9).alias("tail_3")
        ),
        with_views(
            """SELECT seed, vec_id, round(probs[2] + 2 * probs[3] + 3 * probs[4] + 4 * probs[5] + 5 * probs[6], 9) AS expected,
  round(probs[4] + probs[5] + probs[6], 9) AS tail_3 FROM predictions""", "predictions"
        ),
    ),
    "focal_ce": (_focal, with_views(_FOCAL, "predictions", extra={"weights": _WEIGHTS})),
    "ordinal_penalty": (
        lambda s, d: metrics.ordinal_penalty(fx.predictions(s, d), "probs", "y", ["seed"]).select(
            "seed", F.round("mean_distance", 9).alias("mean_distance"), F.round("expected_sq_error", 9).alias("expected_sq_error")
        ),
        with_views(
            """SELECT seed, round(avg(abs(pred - y)), 9) AS mean_distance, round(avg((e - y) * (e - y)), 9) AS expected_sq_error
FROM (SELECT *, probs[2] + 2 * probs[3] + 3 * probs[4] + 4 * probs[5] + 5 * probs[6] AS e FROM predictions) GROUP BY seed""", "predictions"
        ),
    ),
    "wide_features": (
        _wide,
        f"SELECT vec_id, {', '.join(f'{rz(f'embedding[{i + 1}]::DOUBLE')} AS f{i}' for i in range(DIM))}, {rz('embedding[11]::DOUBLE')} AS again_10 FROM embeddings",
    ),
}
