"""Views derived from the driver tables, once in Spark and once as SQL text.

``spark_view(name)(spark, sf_dir)`` and ``sql_view(name)`` define the same rows.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidelake.functions.detrand import uniform
from slidelake.operators.metrics import with_probabilities
from slidelake.operators.ranking import slab_rank
from slidelake.operators.skew import spread

SEEDS = (42, 777, 1337)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def sql_u32(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT)"


def sql_u(key: str) -> str:
    return f"({sql_u32(key)} / 4294967296::DOUBLE)"


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    site = F.upper(F.substring(F.md5(F.concat(F.lit("s"), (i % 200 % 23).cast("string"))), 1, 2))
    patient_row = i % 17 == 0
    slide_id = F.when(
        patient_row,
        F.concat(
            F.lit("patient_"), F.lpad((i % 10).cast("string"), 3, "0"),
            F.lit("_node_"), (i % 5).cast("string"), F.lit("_"), i.cast("string"),
        ),
    ).otherwise(
        F.concat(
            F.lit("TCGA-"), site, F.lit("-"), F.lpad((i % 200).cast("string"), 4, "0"),
            F.lit("-"), F.lpad(i.cast("string"), 6, "0"),
        )
    )
    folder = (
        F.when(patient_row, F.concat(F.lit("center_"), (F.floor(i / 10) % 3).cast("string"), F.lit("/")))
        .when(i % 29 == 0, F.lit(""))
        .otherwise(F.concat(F.col("source"), F.lit("/")))
    )
    return d.select(
        i,
        slide_id.alias("slide_id"),
        F.when(i % 13 == 0, None)
        .otherwise(F.concat(F.lit("/wsi/"), folder, slide_id, F.lit(".svs")))
        .alias("path"),
        F.concat(F.col("lang"), F.lit("_"), (i % 50).cast("string")).alias("stem"),
        "source",
        "lang",
        F.col("text").alias("content"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
        (200 + F.floor(4000 * uniform("w", i))).cast("bigint").alias("width"),
        (200 + F.floor(4000 * uniform("h", i))).cast("bigint").alias("height"),
        F.when(i % 11 == 0, None)
        .when(i % 11 == 1, F.lit(""))
        .when(i % 2 == 0, F.lit("0.25"))
        .otherwise(F.lit("0.5"))
        .alias("mpp_a"),
        F.when(i % 11 == 1, F.lit("0.25")).alias("mpp_b"),
        F.when(i % 3 == 0, F.lit("20")).when(i % 3 == 1, F.lit("40")).otherwise(F.lit("n/a")).alias("power"),
        F.array(*[F.lit(float(x)) for x in (1, 2, 4, 8)]).alias("downsamples"),
    )


_SQL_SLIDES = f"""
SELECT doc_id, slide_id, stem, source, lang, content, size_bytes, width, height, mpp_a, mpp_b, power,
  CASE WHEN doc_id % 13 = 0 THEN NULL
       WHEN doc_id % 17 = 0 THEN '/wsi/center_' || ((doc_id // 10) % 3) || '/' || slide_id || '.svs'
       WHEN doc_id % 29 = 0 THEN '/wsi/' || slide_id || '.svs'
       ELSE '/wsi/' || source || '/' || slide_id || '.svs' END AS path
FROM (
  SELECT doc_id, source, lang, text AS content, strlen(text)::BIGINT AS size_bytes,
    lang || '_' || (doc_id % 50) AS stem,
    CASE WHEN doc_id % 17 = 0
      THEN 'patient_' || lpad((doc_id % 10)::VARCHAR, 3, '0') || '_node_' || (doc_id % 5) || '_' || doc_id
      ELSE 'TCGA-' || upper(substr(md5('s' || ((doc_id % 200) % 23)), 1, 2)) || '-'
        || lpad((doc_id % 200)::VARCHAR, 4, '0') || '-' || lpad(doc_id::VARCHAR, 6, '0') END AS slide_id,
    (200 + floor(4000 * {sql_u("'w|' || doc_id")}))::BIGINT AS width,
    (200 + floor(4000 * {sql_u("'h|' || doc_id")}))::BIGINT AS height,
    CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 11 = 1 THEN ''
         WHEN doc_id % 2 = 0 THEN '0.25' ELSE '0.5' END AS mpp_a,
    CASE WHEN doc_id % 11 = 1 THEN '0.25' END AS mpp_b,
    CASE doc_id % 3 WHEN 0 THEN '20' WHEN 1 THEN '40' ELSE 'n/a' END AS power
  FROM documents)
"""


def qc_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = slides(spark, sf_dir).select("doc_id", "slide_id")
    i = F.col("doc_id")
    return table(spark, sf_dir, "labels").select("doc_id").join(ids, "doc_id").select(
        "slide_id",
        uniform("t", i).alias("tissue_pct"),
        uniform("q", i).alias("white_pct"),
        (0.05 * uniform("p", i)).alias("pen_pct"),
        (40.0 * uniform("b", i)).alias("blur_var"),
    )


_SQL_QC = f"""
SELECT s.slide_id, {sql_u("'t|' || l.doc_id")} AS tissue_pct, {sql_u("'q|' || l.doc_id")} AS white_pct,
  0.05::DOUBLE * {sql_u("'p|' || l.doc_id")} AS pen_pct, 40::DOUBLE * {sql_u("'b|' || l.doc_id")} AS blur_var
FROM labels l JOIN slides s USING (doc_id)
"""


def tile_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bags of 8 tiles per row, at most a few dozen tiles per (bag, scale)."""
    i = F.col("vec_id")
    e = (
        table(spark, sf_dir, "embeddings")
        .select(
            "vec_id",
            F.col("label").cast("int").alias("bag"),
            F.when(i % 4 == 0, F.lit(2.0)).otherwise(F.lit(0.5)).alias("scale"),
            F.transform(
                F.col("embedding").cast("array<double>"),
                lambda x: x * (F.lit(1.0) + (i % 97).cast("double") / F.lit(97.0)),
            ).alias("feat"),
        )
        .where((F.col("bag") != 9) | (F.col("scale") != 2.0))
    )
    # Ids are dense, so a thousand of them make an even slab.
    ranked = slab_rank(e, ["bag", "scale"], F.floor(i / 1000), ["vec_id"], "r")
    return ranked.withColumn("tile_idx", (F.col("r") - 1).cast("bigint")).select(
        "vec_id",
        "bag",
        "scale",
        "tile_idx",
        (224 * (F.col("tile_idx") % 8)).alias("x"),
        (224 * F.floor(F.col("tile_idx") / 8)).alias("y"),
        "feat",
    )


_SQL_TILES = """
SELECT *, 224 * (tile_idx % 8) AS x, 224 * (tile_idx // 8) AS y FROM (
  SELECT vec_id, label::INTEGER AS bag, scale, feat,
    row_number() OVER (PARTITION BY label, scale ORDER BY vec_id) - 1 AS tile_idx
  FROM (SELECT vec_id, label, CASE WHEN vec_id % 4 = 0 THEN 2.0 ELSE 0.5 END::DOUBLE AS scale,
          list_transform(embedding, lambda x: x::DOUBLE * (1::DOUBLE + (vec_id % 97)::DOUBLE / 97::DOUBLE)) AS feat
        FROM embeddings)
  WHERE label <> 9 OR scale <> 2.0)
"""


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, mx, my = F.col("slide"), F.col("mx"), F.col("my")
    base = 0.1 + 0.6 * ((F.floor(mx / 8) + F.floor(my / 8) + s) % 2).cast("double")
    return (
        spread(table(spark, sf_dir, "supplier"), "s_suppkey")
        .select(F.col("s_suppkey").alias("slide"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("my"))
        .select("slide", "my", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("mx"))
        .select("slide", "mx", "my", (uniform(s, mx, my) < base).cast("int").alias("tissue"))
    )


_SQL_MASKS = f"""
SELECT s_suppkey AS slide, mx::INTEGER AS mx, my::INTEGER AS my,
  ({sql_u("s_suppkey || '|' || mx || '|' || my")}
    < 0.1::DOUBLE + 0.6::DOUBLE * ((mx // 8 + my // 8 + s_suppkey) % 2)::DOUBLE)::INTEGER AS tissue
FROM supplier, range(32) a(mx), range(32) b(my)
"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, x, y = F.col("image"), F.col("x"), F.col("y")

    def channel(name: str):
        return F.when(s % 10 == 0, F.lit(250)).otherwise(F.floor(256 * uniform(name, s, x, y)).cast("int"))

    return (
        spread(table(spark, sf_dir, "supplier"), "s_suppkey")
        .select(F.col("s_suppkey").alias("image"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("y"))
        .select("image", "y", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("x"))
        .select("image", "x", "y", *[channel(c).alias(c) for c in "rgb"])
    )


def _sql_channel(name: str) -> str:
    u = sql_u(f"'{name}|' || s_suppkey || '|' || x || '|' || y")
    return f"CASE WHEN s_suppkey % 10 = 0 THEN 250 ELSE floor(256 * {u})::INTEGER END AS {name}"


_SQL_PIXELS = f"""
SELECT s_suppkey AS image, x::INTEGER AS x, y::INTEGER AS y,
  {_sql_channel("r")}, {_sql_channel("g")}, {_sql_channel("b")}
FROM supplier, range(16) p(x), range(16) q(y)
"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, seed = F.col("vec_id"), F.col("seed")
    y = (F.col("label") % 6).cast("int")
    logits = F.transform(
        F.sequence(F.lit(0), F.lit(5)),
        lambda k: F.lit(6.0) * F.element_at(F.col("embedding"), k + 1).cast("double")
        + F.when(k == y, F.lit(1.5)).otherwise(F.lit(0.0))
        + F.lit(2.0) * (uniform("n", seed, i, k) - F.lit(0.5)),
    )
    base = (
        table(spark, sf_dir, "embeddings")
        .withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS])))
        .select(
            "seed",
            "vec_id",
            y.alias("y"),
            logits.alias("logits"),
            (i % 2).cast("int").alias("provider"),
            (i % 5).cast("int").alias("fold"),
            (i % 23).cast("int").alias("site"),
            F.concat(F.when(i % 3 == 0, F.lit("Tumor_")).otherwise(F.lit("normal_")), i.cast("string")).alias(
                "slide"
            ),
        )
    )
    return with_probabilities(base, "logits", "probs", "pred")


_SQL_PREDICTIONS = f"""
SELECT seed, vec_id, y, logits, probs, (list_position(probs, list_max(probs)) - 1)::INTEGER AS pred,
  (vec_id % 2)::INTEGER AS provider, (vec_id % 5)::INTEGER AS fold, (vec_id % 23)::INTEGER AS site,
  CASE WHEN vec_id % 3 = 0 THEN 'Tumor_' ELSE 'normal_' END || vec_id AS slide
FROM (
  SELECT *, list_transform(logits, lambda z: exp(z - list_max(logits))
      / list_sum(list_transform(logits, lambda w: exp(w - list_max(logits))))) AS probs
  FROM (
    SELECT seed, vec_id, (label % 6)::INTEGER AS y,
      list_transform(range(6), lambda k: 6::DOUBLE * embedding[k + 1]::DOUBLE
        + CASE WHEN k = label % 6 THEN 1.5 ELSE 0 END::DOUBLE
        + 2::DOUBLE * ({sql_u("'n|' || seed || '|' || vec_id || '|' || k")} - 0.5::DOUBLE)) AS logits
    FROM embeddings, (SELECT unnest([42, 777, 1337])::INTEGER AS seed)))
"""


def train_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        i.alias("step"),
        F.when(i % 53 == 0, None)
        .otherwise(F.lit(5.0) / (F.lit(1.0) + i / F.lit(2000.0)) + F.col("value") / F.lit(500.0))
        .alias("loss"),
        F.col("user_id").alias("slide"),
        (i % 500).alias("tiles"),
        (F.col("value") / F.lit(100.0)).alias("seconds"),
    )


_SQL_LOG = """
SELECT event_id AS step, CASE WHEN event_id % 53 = 0 THEN NULL
    ELSE 5::DOUBLE / (1::DOUBLE + event_id / 2000::DOUBLE) + value / 500::DOUBLE END AS loss,
  user_id AS slide, event_id % 500 AS tiles, value / 100::DOUBLE AS seconds
FROM events
"""


def patient_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    k = (F.col("c_nationkey") % 5).cast("string")
    stages = ["pN0", "pn 1", "2", "pN3", "pN0(i+)", "unknown"]
    return table(spark, sf_dir, "customer").select(
        c.alias("row_no"),
        F.concat(F.lit("patient_"), F.lpad((c % 100).cast("string"), 3, "0")).alias("patient"),
        F.element_at(F.array(*[F.lit(s) for s in stages]), (c % 6 + 1).cast("int")).alias("pn"),
        F.when(c % 3 == 0, F.concat(F.lit("center_"), k)).when(c % 3 == 1, k).alias("center"),
    )


_SQL_LABELS = """
SELECT c_custkey AS row_no, 'patient_' || lpad((c_custkey % 100)::VARCHAR, 3, '0') AS patient,
  ['pN0', 'pn 1', '2', 'pN3', 'pN0(i+)', 'unknown'][c_custkey % 6 + 1] AS pn,
  CASE c_custkey % 3 WHEN 0 THEN 'center_' || (c_nationkey % 5) WHEN 1 THEN (c_nationkey % 5)::VARCHAR END AS center
FROM customer
"""


def inventory_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = tile_groups(spark, sf_dir)
    return pairs.where(uniform("d", F.col("bag"), F.col("scale")) < 0.4).select("bag", "scale")


def tile_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "embeddings")
        .select(
            F.col("label").cast("int").alias("bag"),
            F.when(F.col("vec_id") % 4 == 0, F.lit(2.0)).otherwise(F.lit(0.5)).alias("scale"),
        )
        .where((F.col("bag") != 9) | (F.col("scale") != 2.0))
        .groupBy("bag", "scale")
        .agg(F.count(F.lit(1)).alias("n_tiles"))
    )


_SQL_GROUPS = "SELECT bag, scale, count(*) AS n_tiles FROM tiles GROUP BY bag, scale"
_SQL_DONE = f"""
SELECT bag, scale FROM tile_groups
WHERE {sql_u("'d|' || bag || '|' || CASE WHEN scale = 2.0 THEN '2.0' ELSE '0.5' END")} < 0.4::DOUBLE
"""

# view -> (SQL text, views it reads)
_SQL: dict[str, tuple[str, tuple[str, ...]]] = {
    "slides": (_SQL_SLIDES, ()),
    "qc": (_SQL_QC, ("slides",)),
    "tiles": (_SQL_TILES, ()),
    "tile_groups": (_SQL_GROUPS, ("tiles",)),
    "done": (_SQL_DONE, ("tile_groups",)),
    "masks": (_SQL_MASKS, ()),
    "pixels": (_SQL_PIXELS, ()),
    "predictions": (_SQL_PREDICTIONS, ()),
    "train_log": (_SQL_LOG, ()),
    "patient_labels": (_SQL_LABELS, ()),
}


def with_views(query: str, *views: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """Prefix ``query`` with the CTEs it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in _SQL[name][1]:
            visit(dep)
        order.append(name)

    for v in views:
        visit(v)
    ctes = [f"{n} AS ({_SQL[n][0].strip()})" for n in order]
    ctes += [f"{n} AS ({q.strip()})" for n, q in (extra or {}).items()]
    word = "WITH RECURSIVE" if recursive else "WITH"
    return (f"{word} " + ",\n".join(ctes) + "\n" if ctes else "") + query.strip()


Query = Callable[[SparkSession, str], DataFrame]
