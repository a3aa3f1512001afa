"""Fold, metric, bootstrap, test, probe and gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from slidelake.catalog import fixtures as fx
from slidelake.catalog.fixtures import Query, sql_u, sql_u32, with_views
from slidelake.catalog.source_queries import artefacts
from slidelake.catalog.token_queries import _WEIGHTS
from slidelake.functions import parsing
from slidelake.operators import bootstrap, diagnostics, folds, joins, metrics, probes, stats
from slidelake.plans import evaluation
from slidelake.session import materialize

BOOT = 1000


def r9(df, *cols: str):
    return df.withColumns({c: F.round(c, 9) for c in cols})


def _cells(s, d, *keys: str):
    return metrics.cells(fx.predictions(s, d), list(keys))


def _vectors(s, d):
    return fx.table(s, d, "embeddings").select(
        "vec_id",
        (F.col("label") % 6).cast("int").alias("y"),
        (F.col("vec_id") % 5).cast("int").alias("fold"),
        (F.col("vec_id") % 23).cast("int").alias("site"),
        F.col("embedding").cast("array<double>").alias("feat"),
    )


def _centers(s, d):
    return fx.patient_labels(s, d).select("row_no", F.coalesce(parsing.parse_center("center"), F.lit(-1)).alias("center"))


def _loco(s, d):
    c = _centers(s, d)
    placed = folds.leave_one_group_out(c, "center")
    own = F.coalesce(F.col("fold"), F.lit(-1))
    return joins.fold_roles(placed, joins.fold_ids(c, "center"), own).select("row_no", "eval_fold", "role")


def _binary(s, d):
    """Tumour slides against the parity of the prediction."""
    p = fx.predictions(s, d)
    return p.select("seed", parsing.tumor_label("slide").alias("y"), (F.col("pred") % 2).cast("int").alias("pred"))


def _scored(s, d):
    """Class 0 against the rest."""
    return fx.predictions(s, d).select(
        "seed", "vec_id", "provider", F.round(F.element_at("probs", 1), 9).alias("score"), (F.col("y") == 0).cast("int").alias("hit")
    )


_SCORED = "SELECT seed, vec_id, provider, round(probs[1], 9) AS score, (y = 0)::INTEGER AS hit FROM predictions"


def _auc_sql(source: str, keys: str) -> str:
    """Pairwise AUROC and threshold-wise average precision of (keys, score, hit) rows."""
    k = [x.strip() for x in keys.split(",")]
    eq = " AND ".join(f"a.{x} = b.{x}" for x in k)
    return f"""SELECT {keys}, n, n_pos, pos_rate, auroc, auprc FROM (
  SELECT {keys}, count(*) AS n, sum(hit)::BIGINT AS n_pos, avg(hit) AS pos_rate FROM ({source}) GROUP BY {keys})
LEFT JOIN (SELECT {", ".join(f"a.{x}" for x in k)}, avg(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END::DOUBLE) AS auroc
  FROM ({source}) a JOIN ({source}) b ON {eq} WHERE a.hit = 1 AND b.hit = 0 GROUP BY ALL) USING ({keys})
LEFT JOIN (SELECT {keys}, avg(prec) AS auprc FROM (
    SELECT {", ".join(f"a.{x}" for x in k)}, a.vec_id, avg(b.hit) AS prec FROM ({source}) a JOIN ({source}) b ON {eq} AND b.score >= a.score
    WHERE a.hit = 1 GROUP BY ALL) GROUP BY {keys}) USING ({keys})"""


_OVR = "SELECT seed, provider, fold, vec_id, k, round(probs[k + 1], 9) AS score, (y = k)::INTEGER AS hit FROM predictions, range(6) t(k)"
_THRESH = """SELECT seed, provider, vec_id, t::INTEGER AS threshold, (y >= t)::INTEGER AS hit,
  round(list_sum(list_transform(range(t, 6), lambda i: probs[i + 1])) / list_sum(probs), 9) AS score FROM predictions, range(1, 6) r(t)"""


def _ovr_sql(keys: str) -> str:
    k = [x.strip() for x in keys.split(",")]
    eq = " AND ".join(f"a.{x} = b.{x}" for x in [*k, "k"])
    cols = ", ".join(f"a.{x}" for x in k)
    return f"""SELECT {keys}, CASE WHEN count(*) = 6 THEN avg(auc) END AS macro_auc FROM (
  SELECT {cols}, a.k, avg(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END::DOUBLE) AS auc
  FROM ({_OVR}) a JOIN ({_OVR}) b ON {eq} WHERE a.hit = 1 AND b.hit = 0 GROUP BY ALL) GROUP BY {keys}"""


_OOF_SCOPES = "(SELECT 'all' AS scope, NULL::VARCHAR AS chosen UNION ALL SELECT 'provider', '0' UNION ALL SELECT 'provider', '1')"
_OOF_HITS = f"""SELECT scope || coalesce(chosen, '') AS of, seed || '|' || vec_id AS vec_id, threshold, hit, score
FROM ({_THRESH}), {_OOF_SCOPES} WHERE chosen IS NULL OR chosen = provider::VARCHAR"""
_OOF_OVR = f"""SELECT of, avg(auc) AS macro_auc FROM (
  SELECT of, k, avg(auc) AS auc FROM (
    SELECT a.of, a.k, CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END::DOUBLE AS auc
    FROM ovr a JOIN ovr b ON a.of = b.of AND a.k = b.k WHERE a.hit = 1 AND b.hit = 0) GROUP BY of, k) GROUP BY of HAVING count(*) = 6"""
_OOF_CTES = {
    "ovr": f"SELECT scope || coalesce(chosen, '') AS of, k, hit, score FROM ({_OVR}), {_OOF_SCOPES} WHERE chosen IS NULL OR chosen = provider::VARCHAR",
    "hits": _OOF_HITS,
}
_OOF_TABLE = f"""SELECT CASE WHEN of = 'all' THEN 'all' ELSE 'provider' END AS scope, nullif(replace(replace(of, 'all', ''), 'provider', ''), '') AS provider,
  threshold, n, n_pos, round(auroc, 9) AS auroc, round(auprc, 9) AS auprc, round(pos_rate, 9) AS pos_rate, round(macro_auc, 9) AS macro_auroc_ovr
FROM ({_auc_sql("SELECT * FROM hits", "of, threshold")}) LEFT JOIN ({_OOF_OVR}) USING (of)"""


def _class_sql(source: str, keys: str) -> str:
    """Per class: true positives, support, predicted, precision, recall, F1."""
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}label, tp, support, predicted, coalesce(tp / nullif(predicted, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r,
  coalesce(2 * tp / nullif(support + predicted, 0), 0) AS f1 FROM (
  SELECT {k}label, sum((y = label AND pred = label)::INTEGER) AS tp, sum((y = label)::INTEGER) AS support, sum((pred = label)::INTEGER) AS predicted
  FROM ({source}), (SELECT DISTINCT unnest([y, pred]) AS label FROM ({source})) GROUP BY ALL) WHERE support + predicted > 0"""


def _kappa_sql(source: str, keys: str) -> str:
    """Kappa by the observed and expected tables, one entry per class pair."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    using = f"USING ({keys})" if keys else "ON true"
    return f"""SELECT {k}1 - obs / nullif(expd, 0) AS kappa FROM (
  SELECT {k}sum((i - j) * (i - j))::DOUBLE AS obs, count(*) AS n FROM coded GROUP BY ALL) o
JOIN (SELECT {", ".join([f"a.{x.strip()}" for x in keys.split(",")]) + ", " if keys else ""}sum((a.i - b.j) * (a.i - b.j) * a.c * b.c / a.n::DOUBLE) AS expd
  FROM (SELECT {k}i, c, sum(c) OVER ({part}) AS n FROM (SELECT {k}i, count(*) AS c FROM coded GROUP BY ALL)) a
  JOIN (SELECT {k}j, count(*) AS c FROM coded GROUP BY ALL) b {using} GROUP BY ALL) e {using}"""


def _coded(source: str, keys: str) -> str:
    k = [x.strip() for x in keys.split(",")] if keys else []
    eq = "".join(f" AND {{0}}.{x} = p.{x}" for x in k)
    part = f"PARTITION BY {keys} " if keys else ""
    sel = f"{keys}, " if keys else ""
    return f"""SELECT p.*, l.code AS i, m.code AS j FROM ({source}) p
JOIN (SELECT {sel}label, dense_rank() OVER ({part}ORDER BY label) AS code FROM (SELECT DISTINCT {sel}unnest([y, pred]) AS label FROM ({source}))) l
  ON l.label = p.y{eq.format("l")}
JOIN (SELECT {sel}label, dense_rank() OVER ({part}ORDER BY label) AS code FROM (SELECT DISTINCT {sel}unnest([y, pred]) AS label FROM ({source}))) m
  ON m.label = p.pred{eq.format("m")}"""


_LAST = "SELECT vec_id, y, pred, vec_id % 23 AS site FROM predictions WHERE seed = 1337"
_ENSEMBLE = """SELECT vec_id, y, (list_position(m, list_max(m)) - 1)::INTEGER AS pred FROM (
  SELECT vec_id, y, list(p ORDER BY k) AS m FROM (SELECT vec_id, y, k, avg(probs[k + 1]) AS p FROM predictions, range(6) t(k) GROUP BY ALL) GROUP BY ALL)"""


def _last(s, d):
    order = F.element_at(F.create_map(*[F.lit(x) for p in zip(fx.SEEDS, (0, 1, 2)) for x in p]), F.col("seed"))
    p = fx.predictions(s, d).withColumn("seed_no", order)
    return metrics.oof_last_seed(p, "vec_id", "seed_no")


def _ensemble(s, d):
    return metrics.oof_ensemble(fx.predictions(s, d), "vec_id")


def _ensemble_metrics(s, d):
    c = metrics.cells(_ensemble(s, d))
    k = metrics.qw_kappa(c)
    hit = F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")
    both = k.select(F.lit("kappa").alias("metric"), F.col("kappa").alias("value")).unionByName(
        c.agg(hit.alias("value")).select(F.lit("accuracy").alias("metric"), "value")
    )
    return r9(both, "value")


def _fold_results(s, d):
    # Slides per fold are ids, as in leave-out folds of the whole table.
    return evaluation.fold_results(fx.predictions(s, d), digits=9)


_FOLD_CTES = {
    "acc": "SELECT seed, fold, avg((y = pred)::INTEGER) AS accuracy FROM predictions GROUP BY ALL",
    "bal": "SELECT seed, fold, avg(rec) AS balanced_accuracy FROM (SELECT seed, fold, y, avg((y = pred)::INTEGER) AS rec FROM predictions GROUP BY ALL) GROUP BY ALL",
    "mf1": f"SELECT seed, fold, avg(f1) AS macro_f1 FROM ({_class_sql('SELECT seed, fold, y, pred FROM predictions', 'seed, fold')}) GROUP BY ALL",
    "auc": _ovr_sql("seed, fold"),
    "results": "SELECT * FROM acc JOIN bal USING (seed, fold) JOIN mf1 USING (seed, fold) JOIN auc USING (seed, fold)",
}
_METRICS = ("accuracy", "balanced_accuracy", "macro_f1", "macro_auc")


def _ttest(s, d):
    # Both columns come from one table: a fold's accuracy under the two seeds.
    per = fx.predictions(s, d).groupBy("seed", "fold").agg(F.avg((F.col("y") == F.col("pred")).cast("double")).alias("accuracy"))
    a, b = per.where(F.col("seed") == 42), per.where(F.col("seed") == 777)
    return r9(stats.paired_ttest(a, b, "fold", "accuracy", 3), "t_stat", "p_value", "p_corrected", "mean_diff").withColumn(
        "p_value", F.round("p_value", 7)
    ).withColumn("p_corrected", F.round("p_corrected", 7))


# p by Simpson's rule over the density of t with 4 degrees of freedom.
_TTEST = """SELECT n, round(t, 9) AS t_stat, round(p, 7) AS p_value, round(least(3 * p, 1), 7) AS p_corrected, round(md, 9) AS mean_diff FROM (
  SELECT n, t, md, 1 - 2 * sum(CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * 0.375::DOUBLE
      * power(1 + power(abs(t) * i / 20000, 2) / 4, -2.5::DOUBLE)) * abs(t) / 20000 / 3 AS p
  FROM (SELECT count(*) AS n, avg(d) AS md, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM (
    SELECT a.acc - b.acc AS d FROM (SELECT fold, avg((y = pred)::INTEGER) AS acc FROM predictions WHERE seed = 42 GROUP BY fold) a
    JOIN (SELECT fold, avg((y = pred)::INTEGER) AS acc FROM predictions WHERE seed = 777 GROUP BY fold) b USING (fold))), range(20001) g(i)
  GROUP BY n, t, md)"""


def _interval_sql(values: str, metric: str) -> str:
    return f"""SELECT round(quantile_cont({metric}, 0.025), 9) AS ci_lo, round(quantile_cont({metric}, 0.975), 9) AS ci_hi, count({metric}) AS n_replicates
FROM ({values})"""


def _draw_sql(n: str, seed: int) -> str:
    return f"""SELECT rep, floor(('0x' || substr(md5('{seed}|' || rep || '|' || pos), 1, 13))::BIGINT / 4503599627370496::DOUBLE * {n})::BIGINT AS drawn
FROM range({BOOT}) a(rep), range({n}) b(pos)"""


_BOOT_ACC = with_views(
    _interval_sql("SELECT rep, avg((y = pred)::INTEGER) AS m FROM draws JOIN numbered ON pos = drawn GROUP BY rep", "m"),
    "predictions",
    extra={
        "rows": _LAST,
        "numbered": "SELECT y, pred, row_number() OVER (ORDER BY y, pred, vec_id) - 1 AS pos FROM rows",
        "draws": _draw_sql("(SELECT count(*) FROM rows)", 42),
    },
)
_BOOT_AUC = with_views(
    _interval_sql(
        """SELECT rep, sum(p * (run - q + q / 2)) / nullif(sum(p) * sum(q), 0) AS m FROM (
  SELECT *, sum(q) OVER (PARTITION BY rep ORDER BY score) AS run FROM (
    SELECT rep, score, sum(hit)::DOUBLE AS p, sum(1 - hit)::DOUBLE AS q FROM draws JOIN numbered ON pos = drawn GROUP BY ALL)) GROUP BY rep""", "m"
    ),
    "predictions",
    extra={
        "rows": f"SELECT * FROM ({_SCORED}) WHERE seed = 42",
        "numbered": f"""SELECT score, hit, row_number() OVER (ORDER BY {sql_u32("'42|' || vec_id")}, vec_id) - 1 AS pos FROM rows""",
        "draws": _draw_sql("(SELECT count(*) FROM rows)", 42),
    },
)
_BOOT_KAPPA = with_views(
    _interval_sql(_kappa_sql("", "rep"), "kappa"),
    "predictions",
    extra={
        "rows": _LAST,
        "sites": f"""SELECT site, row_number() OVER (ORDER BY {sql_u32("'123|' || site")}, site) - 1 AS pos FROM (SELECT DISTINCT site FROM rows)""",
        "draws": _draw_sql("(SELECT count(*) FROM sites)", 123),
        "picked": "SELECT rep, y, pred FROM draws JOIN sites ON pos = drawn JOIN rows USING (site)",
        "coded": _coded("SELECT * FROM picked", "rep"),
    },
)


def _probe(model: str) -> Query:
    def run(s, d):
        v = materialize(_vectors(s, d), "probe")
        return probes.cross_validate(v, model, 1.0).select("vec_id", "fold", "y", "pred")

    return run


_GROUP_FOLDS = f"""SELECT e.vec_id, (e.label % 6)::INTEGER AS y, (e.vec_id % 23)::INTEGER AS site, r.fold FROM embeddings e JOIN (
  SELECT site, (CASE WHEN (r - 1) % 10 < 5 THEN (r - 1) % 10 ELSE 9 - (r - 1) % 10 END)::INTEGER AS fold FROM (
    SELECT site, row_number() OVER (ORDER BY main, n DESC, {sql_u32("'42|' || site")}, site) AS r FROM (
      SELECT site, sum(n) AS n, list(c ORDER BY n DESC, c)[1] AS main FROM (
        SELECT (vec_id % 23)::INTEGER AS site, (label % 6)::VARCHAR AS c, count(*) AS n FROM embeddings GROUP BY 1, 2) GROUP BY site))) r
ON r.site = e.vec_id % 23"""


def _group_fold_checks(s, d):
    """Rows per fold and class, and how many sites were found in more than one fold."""
    f = folds.kfold_stratified_group(_vectors(s, d).select("vec_id", "y", "site"), "y", "site", ["vec_id"])
    sizes = f.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n"))
    split = f.groupBy("site").agg(F.count_distinct("fold").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n_split"))
    return sizes.withColumn("n_split", split.scalar())


def _evaluation(s, d):
    """Slides to patient vectors, site-grouped folds, probe, and all parts of the report, whose rows ``part`` tells apart."""
    i = F.col("vec_id")
    e = fx.table(s, d, "embeddings")
    slides = e.select(F.floor(i / 2).alias("patient"), F.col("embedding").alias("emb"))
    manifest = e.select(
        F.floor(i / 2).alias("patient"), F.concat(F.lit("class_"), (F.floor(i / 2) % 4).cast("string")).alias("cancer_code"),
        F.concat(F.lit("site_"), (F.floor(i / 2) % 23).cast("string")).alias("site"), i.alias("ord"),
    )
    patients = evaluation.patient_table(slides, manifest, "cancer_code", "site", "ord")
    return _in_parts(evaluation.report(evaluation.out_of_fold(patients, "site")))


def _in_parts(parts: dict):
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("part"), "*")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _binary_evaluation(s, d):
    i = F.col("vec_id")
    name = F.concat(F.when(i % 3 == 0, F.lit("Tumor_")).otherwise(F.lit("normal_")), i.cast("string"))
    slides = fx.table(s, d, "embeddings").select(name.alias("slide"), F.col("embedding").alias("feat"))
    return _in_parts(evaluation.binary_evaluation(slides, 64, n_boot=BOOT))


def _staging(s, d):
    i = F.col("vec_id")
    patients = fx.table(s, d, "embeddings").select(
        i.alias("patient"), (F.col("label") % 4).cast("int").alias("y"), F.when(i % 11 == 0, -1).otherwise(i % 3).cast("int").alias("center"),
        F.col("embedding").cast("array<double>").alias("feat"),
    )
    return _in_parts(evaluation.staging_evaluation(patients))


def _oof_table(s, d):
    p = fx.predictions(s, d).withColumn("true_isup", F.col("y")).withColumn("data_provider", F.col("provider").cast("string"))
    wide = p.select("true_isup", "data_provider", *[F.get("probs", F.lit(k)).alias(f"prob_{k}") for k in range(6)])
    return r9(evaluation.oof_table_evaluation(wide, digits=9), "auroc", "auprc", "pos_rate", "macro_auroc_ovr")


def _center_folds(s, d):
    f = folds.center_folds(_centers(s, d).withColumn("y", F.col("row_no") % 4), "center", "y", "row_no")
    return f.select("row_no", "center", "fold")


def _grid(s, d):
    v = materialize(_vectors(s, d), "grid")
    return probes.grid_search(v)


def _gates(s, d):
    counts = joins.two_scale_counts(fx.tile_groups(s, d), "bag")
    trend = diagnostics.loss_trend(fx.train_log(s, d))
    return diagnostics.gates(counts, trend, artefacts(s, d))


_TREND = """SELECT n_rows, last_step, round(a, 9) AS start_median, round(b, 9) AS end_median, round((a - b) / nullif(a, 0), 9) AS rel_improvement FROM (
  SELECT (SELECT count(*) FROM train_log) AS n_rows, (SELECT max(step) FROM train_log) AS last_step,
    median(loss) FILTER (up <= m) AS a, median(loss) FILTER (down <= m) AS b
  FROM (SELECT loss, row_number() OVER (ORDER BY step) AS up, row_number() OVER (ORDER BY step DESC) AS down,
      (SELECT greatest(3, count(*) // 10) FROM train_log) AS m FROM train_log WHERE loss IS NOT NULL))"""


QUERIES: dict[str, tuple[Query, str | None]] = {
    "label_encode": (
        lambda s, d: folds.label_encode(fx.table(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["c_custkey"]),
        "SELECT c_custkey, c_mktsegment, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INTEGER AS code FROM customer",
    ),
    "kfold_stratified": (
        lambda s, d: folds.kfold_stratified(_vectors(s, d).select("vec_id", "y"), "y", "vec_id"),
        f"""SELECT vec_id, (label % 6)::INTEGER AS y,
  ((row_number() OVER (PARTITION BY label % 6 ORDER BY {sql_u32("'42|' || vec_id")}, vec_id) - 1) % 5)::INTEGER AS fold FROM embeddings""",
    ),
    "kfold_stratified_group": (
        lambda s, d: folds.kfold_stratified_group(_vectors(s, d).select("vec_id", "y", "site"), "y", "site", ["vec_id"]),
        _GROUP_FOLDS,
    ),
    "kfold_stratified_group_checks": (
        _group_fold_checks,
        f"""WITH f AS ({_GROUP_FOLDS}) SELECT fold, y, count(*) AS n,
  (SELECT count(*) FROM (SELECT site FROM f GROUP BY site HAVING count(DISTINCT fold) > 1)) AS n_split FROM f GROUP BY fold, y""",
    ),
    "center_folds": (
        _center_folds,
        with_views(
            "SELECT row_no, center, nullif(center, -1) AS fold FROM c", "patient_labels",
            extra={"c": "SELECT row_no, coalesce(TRY_CAST(replace(center, 'center_', '') AS INTEGER), -1)::INTEGER AS center FROM patient_labels"},
        ),
    ),
    "patient_evaluation": (_evaluation, None),
    "binary_evaluation": (_binary_evaluation, None),
    "staging_evaluation": (_staging, None),
    "oof_table_evaluation": (_oof_table, with_views(_OOF_TABLE, "predictions", extra=_OOF_CTES)),
    "leave_one_group_out": (
        _loco,
        with_views(
            """SELECT row_no, eval_fold, CASE WHEN center = eval_fold THEN 'test' ELSE 'train' END AS role
FROM c, (SELECT DISTINCT center AS eval_fold FROM c WHERE center <> -1)""",
            "patient_labels",
            extra={
                "c": "SELECT row_no, coalesce(TRY_CAST(replace(center, 'center_', '') AS INTEGER), -1)::INTEGER AS center FROM patient_labels"
            },
        ),
    ),
    "fold_cross_product": (
        lambda s, d: joins.fold_roles(
            fx.predictions(s, d).select("seed", "vec_id", "fold"), F.sequence(F.lit(0), F.lit(4)), F.col("fold")
        ).select("seed", "vec_id", "eval_fold", "role"),
        with_views(
            "SELECT seed, vec_id, f::INTEGER AS eval_fold, CASE WHEN fold = f THEN 'test' ELSE 'train' END AS role FROM predictions, range(5) t(f)", "predictions"
        ),
    ),
    "standardize_fold": (
        lambda s, d: folds.fold_stats(_vectors(s, d), "fold", [], "feat").select(
            "fold", "dim", (F.round("mean", 8)).alias("mean"), F.round("std", 8).alias("std")
        ),
        """SELECT f::INTEGER AS fold, dim, round(avg(v), 8) + 0::DOUBLE AS mean, round(stddev_pop(v), 8) AS std FROM (
  SELECT vec_id % 5 AS own, unnest(embedding)::DOUBLE AS v, (generate_subscripts(embedding, 1) - 1)::INTEGER AS dim FROM embeddings), range(5) t(f)
WHERE own <> f GROUP BY ALL""",
    ),
    "standardize_rows": (
        lambda s, d: folds.standardize(_vectors(s, d), folds.fold_stats(_vectors(s, d), "fold", [], "feat"), "fold", ["vec_id"]).select(
            "vec_id", "fold", F.posexplode("feat").alias("dim", "value")
        ).withColumn("value", F.round("value", 6)),
        """SELECT vec_id, own::INTEGER AS fold, dim, round((v - m) / sd, 6) + 0::DOUBLE AS value FROM vals JOIN (
  SELECT f, dim, avg(v) AS m, stddev_pop(v) AS sd FROM vals, range(5) t(f) WHERE own <> f GROUP BY ALL) ON f = own AND vals.dim = dim""".replace(
            "ON f = own AND vals.dim = dim", "st ON st.f = own AND st.dim = vals.dim"
        ).replace("SELECT vec_id, own::INTEGER AS fold, dim,", "WITH vals AS (SELECT vec_id, vec_id % 5 AS own, unnest(embedding)::DOUBLE AS v, (generate_subscripts(embedding, 1) - 1)::INTEGER AS dim FROM embeddings)\nSELECT vec_id, own::INTEGER AS fold, vals.dim,"),
    ),
    "accuracy": (
        lambda s, d: r9(metrics.accuracy(fx.predictions(s, d), ["seed"]), "accuracy"),
        with_views("SELECT seed, round(avg((y = pred)::INTEGER), 9) AS accuracy FROM predictions GROUP BY seed", "predictions"),
    ),
    "balanced_accuracy": (
        lambda s, d: r9(metrics.balanced_accuracy(_cells(s, d, "seed"), ["seed"]), "balanced_accuracy"),
        with_views(
            "SELECT seed, round(avg(r), 9) AS balanced_accuracy FROM (SELECT seed, y, avg((y = pred)::INTEGER) AS r FROM predictions GROUP BY ALL) GROUP BY seed", "predictions"
        ),
    ),
    "macro_f1": (
        lambda s, d: r9(metrics.macro_f1(_cells(s, d, "seed"), ["seed"]), "macro_f1"),
        with_views(f"SELECT seed, round(avg(f1), 9) AS macro_f1 FROM ({_class_sql('SELECT seed, y, pred FROM predictions', 'seed')}) GROUP BY seed", "predictions"),
    ),
    "binary_f1": (
        lambda s, d: r9(metrics.binary_f1(metrics.cells(_binary(s, d), ["seed"]), ["seed"]), "binary_f1"),
        with_views(
            """SELECT seed, round(2 * count(*) FILTER (y AND p) / (count(*) FILTER (y) + count(*) FILTER (p))::DOUBLE, 9) AS binary_f1
FROM (SELECT seed, slide LIKE 'Tumor%' AS y, pred % 2 = 1 AS p FROM predictions) GROUP BY seed""", "predictions"
        ),
    ),
    "confusion_matrix": (
        lambda s, d: metrics.confusion_matrix(metrics.cells(_last(s, d))),
        with_views(
            f"""SELECT a.l AS y, b.l AS pred, count(r.y) AS n FROM ls a CROSS JOIN ls b LEFT JOIN rows r ON r.y = a.l AND r.pred = b.l GROUP BY ALL""",
            "predictions", extra={"rows": _LAST, "ls": "SELECT DISTINCT unnest([y, pred]) AS l FROM rows"},
        ),
    ),
    "classification_report": (
        lambda s, d: r9(metrics.classification_report(metrics.cells(_last(s, d))), "precision", "recall", "f1_score", "support"),
        with_views(
            """SELECT label::VARCHAR AS label, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1_score, support::DOUBLE AS support FROM c
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 9), round(sum(tp) / sum(support), 9), round(sum(tp) / sum(support), 9), round(sum(tp) / sum(support), 9) FROM c
UNION ALL SELECT 'macro avg', round(avg(p), 9), round(avg(r), 9), round(avg(f1), 9), sum(support)::DOUBLE FROM c
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 9), round(sum(r * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9), sum(support)::DOUBLE FROM c""",
            "predictions", extra={"rows": _LAST, "c": _class_sql("SELECT y, pred FROM rows", "")},
        ),
    ),
    "auroc_binary": (
        lambda s, d: r9(metrics.ranking_metrics(_scored(s, d), "score", "hit", ["seed"]).select("seed", "n", "n_pos", "auroc"), "auroc"),
        with_views(f"SELECT seed, n, n_pos, round(auroc, 9) AS auroc FROM ({_auc_sql(_SCORED, 'seed')})", "predictions"),
    ),
    "average_precision": (
        lambda s, d: r9(metrics.ranking_metrics(_scored(s, d), "score", "hit", ["seed"]).select("seed", "auprc"), "auprc"),
        with_views(f"SELECT seed, round(auprc, 9) AS auprc FROM ({_auc_sql(_SCORED, 'seed')})", "predictions"),
    ),
    "auroc_ovr_macro": (
        lambda s, d: r9(metrics.auroc_ovr_macro(fx.predictions(s, d), "probs", "y", ["seed"], 9), "macro_auroc_ovr"),
        with_views(f"SELECT seed, round(macro_auc, 9) AS macro_auroc_ovr FROM ({_ovr_sql('seed')})", "predictions"),
    ),
    "qw_kappa": (
        lambda s, d: r9(metrics.qw_kappa(_cells(s, d, "seed"), ["seed"]), "kappa"),
        with_views(
            f"SELECT seed, round(kappa, 9) AS kappa FROM ({_kappa_sql('', 'seed')})", "predictions",
            extra={"coded": _coded("SELECT seed, y, pred FROM predictions", "seed")},
        ),
    ),
    "threshold_metrics": (
        lambda s, d: r9(metrics.threshold_metrics(fx.predictions(s, d), "probs", "y", keys=["seed"], digits=9), "auroc", "auprc", "pos_rate"),
        with_views(
            f"SELECT seed, threshold, n, n_pos, round(auroc, 9) AS auroc, round(auprc, 9) AS auprc, round(pos_rate, 9) AS pos_rate FROM ({_auc_sql(_THRESH, 'seed, threshold')})",
            "predictions",
        ),
    ),
    "metrics_by_provider": (
        lambda s, d: (lambda p: r9(
            metrics.threshold_metrics(p, "probs", "y", keys=["seed", "provider"], digits=9)
            .join(metrics.auroc_ovr_macro(p, "probs", "y", ["seed", "provider"], 9), ["seed", "provider"]),
            "auroc", "auprc", "pos_rate", "macro_auroc_ovr"))(fx.predictions(s, d)),
        with_views(
            f"""SELECT seed, provider, threshold, n, n_pos, round(auroc, 9) AS auroc, round(auprc, 9) AS auprc, round(pos_rate, 9) AS pos_rate,
  round(macro_auc, 9) AS macro_auroc_ovr FROM ({_auc_sql(_THRESH, 'seed, provider, threshold')}) JOIN ({_ovr_sql('seed, provider')}) USING (seed, provider)""",
            "predictions",
        ),
    ),
    "class_weights": (
        lambda s, d: r9(metrics.class_weights(fx.table(s, d, "embeddings").select((F.col("label") % 6).alias("y")), "y", 6), "weight", "balanced"),
        with_views("SELECT y AS label, n, round(weight, 9) AS weight, round(balanced, 9) AS balanced FROM weights", extra={"weights": _WEIGHTS}),
    ),
    "fold_results": (
        lambda s, d: r9(_fold_results(s, d), *_METRICS),
        with_views(f"SELECT seed, fold, {', '.join(f'round({m}, 9) AS {m}' for m in _METRICS)} FROM results", "predictions", extra=_FOLD_CTES),
    ),
    "fold_summary": (
        lambda s, d: (lambda f: r9(f, *[c for c in f.columns if c != "n_evaluations"]))(metrics.fold_summary(_fold_results(s, d), _METRICS)),
        with_views(
            f"SELECT count(*) AS n_evaluations, {', '.join(f'round(avg({m}), 9) AS {m}_mean, round(stddev_samp({m}), 9) AS {m}_std' for m in _METRICS)} FROM results",
            "predictions", extra=_FOLD_CTES,
        ),
    ),
    "oof_last_seed": (
        _last,
        with_views(
            "SELECT vec_id, y, pred, 3::BIGINT AS n_predictions FROM predictions WHERE seed = 1337", "predictions"
        ),
    ),
    "oof_ensemble": (lambda s, d: _ensemble(s, d).select("vec_id", "y", "pred"), with_views(_ENSEMBLE, "predictions")),
    "oof_ensemble_metrics": (
        _ensemble_metrics,
        with_views(
            f"""SELECT 'accuracy' AS metric, round(avg((y = pred)::INTEGER), 9) AS value FROM ens
UNION ALL SELECT 'kappa', round(kappa, 9) FROM ({_kappa_sql('', '')})""",
            "predictions", extra={"ens": _ENSEMBLE, "coded": _coded("SELECT y, pred FROM ens", "")},
        ),
    ),
    "bootstrap_accuracy": (
        lambda s, d: r9(bootstrap.bootstrap_accuracy(_last(s, d), BOOT, 42, method="draws"), "ci_lo", "ci_hi"),
        _BOOT_ACC,
    ),
    "bootstrap_accuracy_multinomial": (
        lambda s, d: bootstrap.bootstrap_accuracy(_last(s, d), BOOT, 42),
        None,
    ),
    "bootstrap_auroc": (
        lambda s, d: r9(bootstrap.bootstrap_auroc(_scored(s, d).where(F.col("seed") == 42), "vec_id", "score", "hit", BOOT, 42, method="draws"), "ci_lo", "ci_hi"),
        _BOOT_AUC,
    ),
    "bootstrap_auroc_blocks": (
        lambda s, d: bootstrap.bootstrap_auroc(_scored(s, d).where(F.col("seed") == 42), "vec_id", "score", "hit", BOOT, 42),
        None,
    ),
    "bootstrap_cluster_kappa": (
        lambda s, d: r9(bootstrap.bootstrap_cluster_kappa(_last(s, d).withColumn("site", F.col("vec_id") % 23), "site", BOOT, 123, method="draws"), "ci_lo", "ci_hi"),
        _BOOT_KAPPA,
    ),
    "bootstrap_cluster_kappa_counts": (
        lambda s, d: bootstrap.bootstrap_cluster_kappa(_last(s, d).withColumn("site", F.col("vec_id") % 23), "site", BOOT, 123),
        None,
    ),
    "paired_ttest": (_ttest, with_views(_TTEST, "predictions")),
    "loss_trend": (
        lambda s, d: r9(diagnostics.loss_trend(fx.train_log(s, d)), "start_median", "end_median", "rel_improvement"),
        with_views(_TREND, "train_log"),
    ),
    "gates": (
        _gates,
        with_views(
            """SELECT 'G1_2scale_coverage' AS name, CASE WHEN n >= 18000 THEN 'PASS' WHEN n >= 15000 THEN 'WARN' ELSE 'FAIL' END AS status,
  CASE WHEN n >= 18000 THEN 'covered' WHEN n >= 15000 THEN 'somewhat short' ELSE 'far too few' END || ' at both scales: ' || n AS detail
FROM (SELECT count(*) AS n FROM (SELECT bag FROM tiles WHERE scale = 0.5 INTERSECT SELECT bag FROM tiles WHERE scale = 2.0))
UNION ALL SELECT 'G2_loss_improvement', CASE WHEN r >= 0.6 THEN 'PASS' WHEN r >= 0.3 THEN 'WARN' ELSE 'FAIL' END,
  CASE WHEN r >= 0.6 THEN 'loss fell enough, by ' WHEN r >= 0.3 THEN 'loss fell somewhat, by ' ELSE 'loss hardly fell, by ' END || format('{:.2f}', r)
FROM (SELECT rel_improvement AS r FROM trend)
UNION ALL SELECT 'G4_checkpoints', CASE WHEN k = 0 THEN 'FAIL' WHEN bad > 0 THEN 'WARN' ELSE 'PASS' END,
  CASE WHEN k = 0 THEN 'none found' WHEN bad > 0 THEN 'unreadable: ' || bad ELSE 'found and readable: ' || k END
FROM (SELECT count(*) AS k, count(*) FILTER (doc_id % 97 = 0 OR text IS NULL OR text = '') AS bad FROM documents)""",
            "tile_groups", "train_log", extra={"trend": _TREND},
        ),
    ),
    "throughput_log": (
        lambda s, d: r9(diagnostics.throughput(fx.train_log(s, d), ["slide"]), "seconds", "tiles_per_s"),
        with_views(
            """SELECT slide, sum(tiles)::BIGINT AS tiles, round(sum(seconds), 9) AS seconds, round(sum(tiles) / greatest(sum(seconds), 1e-6), 9) AS tiles_per_s,
  sum(tiles) / greatest(sum(seconds), 1e-6) >= 50 AS passed FROM train_log GROUP BY slide""", "train_log"
        ),
    ),
    "probe_logreg": (_probe("logreg_l2"), None),
    "probe_logreg_l1": (_probe("logreg_l1"), None),
    "probe_ridge": (_probe("ridge"), None),
    "probe_ordinal": (_probe("ordinal"), None),
    "grid_search": (_grid, None),
}
