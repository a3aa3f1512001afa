"""Manifest, parsing and QC queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from slidelake.catalog import fixtures as fx
from slidelake.catalog.fixtures import Query, with_views
from slidelake.functions import hashing, parsing
from slidelake.operators import joins, manifest, qc
from slidelake.session import materialize

CHUNK = 1024
ROOT = "/wsi"
BARCODE = "nullif(regexp_extract({c}, '(TCGA-[A-Z0-9]{{2}}-[A-Z0-9]{{4}})', 1), '')"
SITE = "nullif(regexp_extract({c}, 'TCGA-([A-Z0-9]{{2}})-', 1), '')"
CLASS = "CASE WHEN len(string_split(substr(path, 6), '/')) >= 2 THEN split_part(substr(path, 6), '/', 1) ELSE 'UNKNOWN' END"
PATIENT = "coalesce(nullif(regexp_extract(lower({c}), '(patient[_\\-]?\\d+)', 1), ''), split_part(lower({c}), '_node', 1))"
REASONS = """concat_ws(';', CASE WHEN tissue_pct < 0.10::DOUBLE THEN 'low_tissue<0.10' END,
  CASE WHEN white_pct > 0.75::DOUBLE THEN 'white>0.75' END,
  CASE WHEN blur_var < 15::DOUBLE THEN 'blur<15.0' END,
  CASE WHEN pen_pct > 0.02::DOUBLE THEN 'pen>0.02' END)"""
STAGE = """coalesce(TRY_CAST(nullif(regexp_extract(lower(pn), 'pn\\s*([0-3])', 1), '') AS INTEGER),
  CASE WHEN regexp_full_match(pn, '[0-3]') THEN pn::INTEGER END)"""
CENTER = """coalesce(TRY_CAST(nullif(regexp_extract({c}, '(?i)center[_\\-]?(\\d+)', 1), '') AS INTEGER),
  CASE WHEN regexp_full_match({c}, '[0-9]+') AND TRY_CAST({c} AS INTEGER) BETWEEN 0 AND 9 THEN TRY_CAST({c} AS INTEGER) END)"""


def _keyed(s, d):
    """Slides with fingerprint, class, patient and site."""
    return fx.slides(s, d).select(
        "doc_id",
        "slide_id",
        "path",
        "size_bytes",
        parsing.file_name("path").alias("filename"),
        parsing.class_from_path("path", ROOT).alias("cancer_code"),
        parsing.patient_barcode("slide_id").alias("patient"),
        parsing.site_barcode("slide_id").alias("site"),
        hashing.fingerprint("content", "size_bytes", chunk=CHUNK).alias("fingerprint"),
    )


def _typed(s, d):
    mpp = parsing.to_number(parsing.first_non_empty("mpp_a", "mpp_b"))
    return fx.slides(s, d).select("slide_id", "size_bytes", "width", "height", mpp.alias("mpp_x"), mpp.alias("mpp_y"))


def _slide_sql(body: str, **extra: str) -> str:
    return with_views(body, "slides", extra=extra)


_FP = f"""'QSHA1:' || sha1(unhex(substr(hex(encode(content)), 1, {2 * CHUNK})
  || CASE WHEN size_bytes > {CHUNK} THEN right(hex(encode(content)), {2 * CHUNK}) ELSE '' END
  || hex(encode(size_bytes::VARCHAR))))"""


def _qc_gate(policy: str) -> Query:
    def run(s, d):
        flagged = qc.qc_flags(fx.qc_metrics(s, d))
        return qc.qc_gate(fx.slides(s, d).select("slide_id", "source"), flagged, policy)

    return run


def _gate_sql(cond: str) -> str:
    return with_views(
        f"SELECT s.slide_id, s.source FROM slides s LEFT JOIN flagged q USING (slide_id) WHERE {cond}",
        "slides", "qc", extra={"flagged": f"SELECT *, {REASONS} AS reasons FROM qc"},
    )


def _histogram_sql(values: str, *views: str) -> str:
    return with_views(
        """SELECT b::INTEGER AS bin, round(lo + b * ((hi - lo) / 40::DOUBLE), 9) AS left_edge,
  (SELECT count(*) FROM vals WHERE least(floor((v - lo) / (hi - lo) * 40::DOUBLE), 39) = b) AS n
FROM range(40) t(b), (SELECT min(v) AS lo, max(v) AS hi FROM vals)""",
        *views, extra={"vals": values},
    )


def _histogram(df):
    return manifest.histogram(df, "v").select("bin", F.round("left_edge", 9).alias("left_edge"), "n")


def _dims(s, d):
    sides = fx.slides(s, d).select(F.explode(F.array("width", "height")).alias("side"))
    return _histogram(sides.select(F.round(F.log10(F.greatest("side", F.lit(1))), 9).alias("v")))


def _labels(s, d):
    return fx.patient_labels(s, d).select(
        "row_no",
        parsing.patient_from_label("patient").alias("patient"),
        parsing.parse_stage("pn").alias("pn_int"),
        parsing.parse_center("center").alias("center"),
    ).where(F.col("pn_int").isNotNull())


_LABELS_SQL = f"SELECT row_no, patient, {STAGE} AS pn_int, {CENTER.format(c='center')} AS center FROM patient_labels WHERE {STAGE} IS NOT NULL"


def _resolve(s, d):
    sl = fx.slides(s, d)
    asked = sl.select(
        "doc_id",
        F.when(F.col("doc_id") % 2 == 0, F.col("stem")).otherwise(F.concat("stem", F.lit("."), F.col("doc_id").cast("string"))).alias("slide_id"),
        "path",
    )
    return manifest.resolve_path(asked, manifest.path_index(sl), ["doc_id"]).select("doc_id", "resolved_path")


def _dataset(s, d):
    sl = fx.slides(s, d)
    sets = [
        ("CAMELYON16", sl.where(F.col("doc_id") % 7 == 0).select("slide_id")),
        ("CAMELYON17", sl.where(F.col("doc_id") % 5 == 0).select("slide_id")),
        ("TCGA", sl.where(F.col("slide_id").startswith("TCGA-")).select("slide_id")),
    ]
    return manifest.dataset_of(sl.select("slide_id"), sets)


def _label_vectors(s, d):
    vec = fx.table(s, d, "embeddings").select(
        "vec_id", F.concat(F.lit("patient_"), F.lpad((F.col("vec_id") % 100).cast("string"), 3, "0")).alias("patient"), "embedding"
    )
    out = joins.label_vectors(vec, _labels(s, d), "pn_int", "row_no", ["vec_id"])
    return out.select("vec_id", "patient", "pn_int", F.posexplode("embedding").alias("dim", "value"))


def _property_fallback(s, d):
    sl = fx.slides(s, d)
    props = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("openslide.mpp-x", "openslide.mpp-y", "aperio.MPP", "aperio.AppMag", "openslide.objective-power")]),
        F.array("mpp_a", "mpp_a", "mpp_b", F.lit(""), "power"),
    )
    out = manifest.read_properties(sl.withColumn("properties", props))
    return out.select("slide_id", "mpp_x", "mpp_y", "vendor", "objective_power", "objective_power_raw")


QUERIES: dict[str, tuple[Query, str | None]] = {
    "parquet_scan_sink": (
        lambda s, d: materialize(fx.slides(s, d).select("slide_id", "path", "size_bytes", "width", "height"), "manifest"),
        _slide_sql("SELECT slide_id, path, size_bytes, width, height FROM slides"),
    ),
    "path_index": (
        lambda s, d: manifest.path_index(fx.slides(s, d)),
        _slide_sql("SELECT stem, max(path) AS path FROM slides WHERE path IS NOT NULL GROUP BY stem"),
    ),
    "fingerprint_quick": (
        lambda s, d: fx.slides(s, d).select("slide_id", hashing.fingerprint("content", "size_bytes", chunk=CHUNK).alias("fingerprint")),
        _slide_sql(f"SELECT slide_id, {_FP} AS fingerprint FROM slides"),
    ),
    "fingerprint_full": (
        lambda s, d: fx.slides(s, d).select(
            "slide_id", hashing.fingerprint("content", "size_bytes", "sha1_full").alias("fingerprint"), F.sha1(F.col("content").cast("binary")).alias("sha1_full")
        ),
        _slide_sql("SELECT slide_id, 'SHA1:' || sha1(content) AS fingerprint, sha1(content) AS sha1_full FROM slides"),
    ),
    "fingerprint_size": (
        lambda s, d: fx.slides(s, d).select("slide_id", hashing.fingerprint("content", "size_bytes", "size_only").alias("fingerprint")),
        _slide_sql("SELECT slide_id, 'SIZE:' || size_bytes AS fingerprint FROM slides"),
    ),
    "short_digest": (
        lambda s, d: fx.slides(s, d).select("slide_id", hashing.short_digest("content").alias("sha256_12")),
        _slide_sql("SELECT slide_id, substr(sha256(content), 1, 12) AS sha256_12 FROM slides"),
    ),
    "class_from_path": (
        lambda s, d: fx.slides(s, d).select("slide_id", parsing.class_from_path("path", ROOT).alias("cancer_code")),
        _slide_sql(f"SELECT slide_id, CASE WHEN path IS NOT NULL THEN {CLASS} END AS cancer_code FROM slides"),
    ),
    "property_fallback": (
        _property_fallback,
        _slide_sql(
            """SELECT slide_id, mpp AS mpp_x, mpp AS mpp_y, 'unknown' AS vendor,
  CASE WHEN power <> 'n/a' THEN power::DOUBLE END AS objective_power, power AS objective_power_raw
FROM (SELECT slide_id, power, CASE WHEN mpp_a IS NULL OR mpp_a = '' THEN CASE WHEN mpp_b <> '' THEN mpp_b::DOUBLE END
  ELSE mpp_a::DOUBLE END AS mpp FROM slides)"""
        ),
    ),
    "coerce_numeric": (
        lambda s, d: fx.slides(s, d).select("slide_id", parsing.to_number("mpp_a").alias("mpp"), parsing.power_number("power").alias("power")),
        _slide_sql("SELECT slide_id, TRY_CAST(mpp_a AS DOUBLE) AS mpp, TRY_CAST(power AS DOUBLE) AS power FROM slides"),
    ),
    "unit_conversion": (
        lambda s, d: fx.slides(s, d).select(
            "slide_id",
            F.round(F.col("size_bytes") / manifest.GB, 2).alias("gb"),
            F.round(F.col("size_bytes") / manifest.GB, 12).alias("gb_exact"),
            F.round(parsing.to_number("mpp_a") / 1000.0, 9).alias("mm_per_px"),
        ),
        _slide_sql(
            """SELECT slide_id, round(size_bytes / 1073741824::DOUBLE, 2) AS gb,
  round(size_bytes / 1073741824::DOUBLE, 12) AS gb_exact, round(TRY_CAST(mpp_a AS DOUBLE) / 1000::DOUBLE, 9) AS mm_per_px FROM slides"""
        ),
    ),
    "log_clip": (
        lambda s, d: fx.slides(s, d).select("slide_id", F.round(F.log10(F.greatest("width", F.lit(1))), 9).alias("log_width")),
        _slide_sql("SELECT slide_id, round(log10(greatest(width, 1)), 9) AS log_width FROM slides"),
    ),
    "qc_flags": (
        lambda s, d: qc.qc_flags(fx.qc_metrics(s, d)).select("slide_id", "reasons", "excluded"),
        with_views(f"SELECT slide_id, {REASONS} AS reasons, ({REASONS} <> '')::INTEGER AS excluded FROM qc", "qc"),
    ),
    "qc_summary": (
        lambda s, d: qc.qc_summary(qc.qc_flags(fx.qc_metrics(s, d))).withColumn("pct_excluded", F.round("pct_excluded", 9)),
        with_views(
            f"""SELECT count(*) AS n_total, count(*) FILTER ({REASONS} <> '') AS n_excluded,
  round(100::DOUBLE * count(*) FILTER ({REASONS} <> '') / greatest(count(*), 1), 9) AS pct_excluded FROM qc""", "qc"
        ),
    ),
    "qc_gate_strict": (_qc_gate("strict"), _gate_sql("q.reasons IS NULL OR q.reasons = ''")),
    "qc_gate_medium": (
        _qc_gate("medium"), _gate_sql("coalesce(q.tissue_pct, 1) >= 0.05::DOUBLE AND coalesce(q.white_pct, 0) <= 0.95::DOUBLE")
    ),
    "qc_gate_none": (_qc_gate("none"), _slide_sql("SELECT slide_id, source FROM slides")),
    "barcode_extract": (
        lambda s, d: fx.slides(s, d).select("slide_id", parsing.patient_barcode("slide_id").alias("patient"), parsing.site_barcode("slide_id").alias("site")),
        _slide_sql(f"SELECT slide_id, {BARCODE.format(c='slide_id')} AS patient, {SITE.format(c='slide_id')} AS site FROM slides"),
    ),
    "patient_from_slide_name": (
        lambda s, d: fx.slides(s, d).select("slide_id", parsing.patient_from_slide("slide_id").alias("patient")),
        _slide_sql(f"SELECT slide_id, {PATIENT.format(c='slide_id')} AS patient FROM slides"),
    ),
    "parse_stage": (
        lambda s, d: fx.patient_labels(s, d).select("row_no", parsing.parse_stage("pn").alias("pn_int")),
        with_views(f"SELECT row_no, {STAGE} AS pn_int FROM patient_labels", "patient_labels"),
    ),
    "parse_center": (
        lambda s, d: fx.patient_labels(s, d).select("row_no", F.coalesce(parsing.parse_center("center"), F.lit(-1)).alias("center")),
        with_views(f"SELECT row_no, coalesce({CENTER.format(c='center')}, -1) AS center FROM patient_labels", "patient_labels"),
    ),
    "name_derived_label": (
        lambda s, d: fx.predictions(s, d).select("seed", "slide", parsing.tumor_label("slide").alias("label")),
        with_views("SELECT seed, slide, (slide ILIKE '%tumor%')::INTEGER AS label FROM predictions", "predictions"),
    ),
    "default_label": (
        lambda s, d: fx.slides(s, d).join(fx.table(s, d, "labels"), "doc_id", "left").select("slide_id", parsing.label_or_zero("quality").alias("label")),
        _slide_sql("SELECT slide_id, coalesce(quality, 0)::INTEGER AS label FROM slides LEFT JOIN labels USING (doc_id)"),
    ),
    "composite_stratum_key": (
        lambda s, d: fx.predictions(s, d).select("seed", "vec_id", parsing.stratum("y", "provider").alias("stratum")),
        with_views("SELECT seed, vec_id, y || '_' || provider AS stratum FROM predictions", "predictions"),
    ),
    "manifest_summary": (
        lambda s, d: manifest.manifest_summary(fx.slides(s, d), failed=F.col("path").isNull()),
        _slide_sql(
            """SELECT count(*) AS n_rows, sum(size_bytes)::BIGINT AS total_bytes, round(sum(size_bytes) / 1073741824::DOUBLE, 8) AS total_gb,
  count(*) FILTER (path IS NULL) AS n_failures FROM slides"""
        ),
    ),
    "value_counts": (
        lambda s, d: manifest.value_counts(_keyed(s, d).select("cancer_code"), "cancer_code", 20),
        _slide_sql(
            f"""SELECT cancer_code, count(*) AS n FROM (SELECT CASE WHEN path IS NOT NULL THEN {CLASS} END AS cancer_code FROM slides)
GROUP BY 1 ORDER BY n DESC, cancer_code NULLS FIRST LIMIT 20"""
        ),
    ),
    "mpp_completeness": (
        lambda s, d: manifest.completeness(_typed(s, d), ["mpp_x", "mpp_y"]).withColumn("pct_complete", F.round("pct_complete", 9)),
        _slide_sql(
            """SELECT count(*) FILTER (mpp IS NULL) AS n_missing, round(100::DOUBLE * count(mpp) / count(*), 9) AS pct_complete
FROM (SELECT coalesce(nullif(mpp_a, ''), nullif(mpp_b, '')) AS mpp FROM slides)"""
        ),
    ),
    "duplicate_groups": (
        lambda s, d: manifest.duplicate_groups(_keyed(s, d)),
        _slide_sql(f"SELECT {_FP} AS dup_key, count(*) AS n FROM slides GROUP BY 1 HAVING count(*) > 1"),
    ),
    "duplicate_summary": (
        lambda s, d: manifest.duplicate_summary(manifest.duplicate_groups(_keyed(s, d))),
        _slide_sql(
            f"""SELECT count(*) AS n_groups, (coalesce(sum(n), 0) - count(*))::BIGINT AS n_extra
FROM (SELECT {_FP} AS k, count(*) AS n FROM slides GROUP BY 1 HAVING count(*) > 1)"""
        ),
    ),
    "histogram_size": (
        lambda s, d: _histogram(fx.slides(s, d).select((F.col("size_bytes") / manifest.GB).alias("v"))),
        _histogram_sql("SELECT size_bytes / 1073741824::DOUBLE AS v FROM slides", "slides"),
    ),
    "histogram_dims": (
        _dims,
        _histogram_sql(
            "SELECT round(log10(greatest(side, 1)), 9) AS v FROM (SELECT width AS side FROM slides UNION ALL SELECT height FROM slides)", "slides"
        ),
    ),
    "histogram_tokens": (
        lambda s, d: _histogram(fx.tile_groups(s, d).select(F.col("n_tiles").cast("double").alias("v"))),
        _histogram_sql("SELECT n_tiles::DOUBLE AS v FROM tile_groups", "tile_groups"),
    ),
    "largest_files": (
        lambda s, d: manifest.largest(fx.slides(s, d), "size_bytes", "slide_id").select("slide_id", "size_bytes", F.round("size_gb", 12).alias("size_gb")),
        _slide_sql(
            """SELECT slide_id, size_bytes, round(size_bytes / 1073741824::DOUBLE, 12) AS size_gb FROM slides
ORDER BY size_bytes DESC, slide_id LIMIT 10"""
        ),
    ),
    "resolve_path": (
        _resolve,
        _slide_sql(
            """SELECT s.doc_id, coalesce(s.path, i.path) AS resolved_path FROM slides s
LEFT JOIN (SELECT stem, max(path) AS path FROM slides GROUP BY stem) i USING (stem)"""
        ),
    ),
    "dataset_of": (
        _dataset,
        _slide_sql(
            """SELECT slide_id, CASE WHEN slide_id IN (SELECT slide_id FROM slides WHERE doc_id % 7 = 0) THEN 'CAMELYON16'
  WHEN slide_id IN (SELECT slide_id FROM slides WHERE doc_id % 5 = 0) THEN 'CAMELYON17'
  WHEN slide_id LIKE 'TCGA-%' THEN 'TCGA' ELSE 'OTHER' END AS dataset FROM slides"""
        ),
    ),
    "first_by_order": (
        lambda s, d: joins.first_by_order(_keyed(s, d), "patient", "cancer_code", "doc_id"),
        _slide_sql(
            f"""SELECT DISTINCT ON (patient) patient, cancer_code FROM (SELECT doc_id, {BARCODE.format(c='slide_id')} AS patient, {CLASS} AS cancer_code
  FROM slides WHERE path IS NOT NULL) WHERE patient IS NOT NULL ORDER BY patient, doc_id"""
        ),
    ),
    "label_patients": (
        lambda s, d: joins.label_patients(
            _keyed(s, d).where(F.col("patient").isNotNull()).select("patient").distinct(), _keyed(s, d), ["cancer_code", "site"], "doc_id"
        ),
        _slide_sql(
            f"""SELECT patient, arg_min(cancer_code, doc_id) FILTER (cancer_code IS NOT NULL) AS cancer_code, arg_min(site, doc_id) AS site
FROM (SELECT doc_id, {BARCODE.format(c='slide_id')} AS patient, {SITE.format(c='slide_id')} AS site,
  CASE WHEN path IS NOT NULL THEN {CLASS} END AS cancer_code FROM slides)
WHERE patient IS NOT NULL GROUP BY patient HAVING count(cancer_code) > 0 AND count(site) > 0"""
        ),
    ),
    "label_vectors": (
        _label_vectors,
        with_views(
            """SELECT e.vec_id, e.patient, l.pn_int, (k - 1)::INTEGER AS dim, embedding[k] AS value FROM (
  SELECT vec_id, 'patient_' || lpad((vec_id % 100)::VARCHAR, 3, '0') AS patient, embedding, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings) e
JOIN (SELECT patient, arg_max(pn_int, row_no) AS pn_int FROM labelled GROUP BY patient) l USING (patient)""",
            "patient_labels", extra={"labelled": _LABELS_SQL},
        ),
    ),
    "fill_center": (
        lambda s, d: joins.fill_center(_labels(s, d), fx.slides(s, d).select("path"), ["row_no"]).select("row_no", "patient", "pn_int", "center"),
        with_views(
            """SELECT row_no, l.patient, pn_int, coalesce(l.center, CASE WHEN share > 0.1::DOUBLE THEN m.center END, -1)::INTEGER AS center
FROM labelled l LEFT JOIN (
  SELECT patient, center FROM votes QUALIFY row_number() OVER (PARTITION BY patient ORDER BY n DESC, center) = 1) m USING (patient),
  (SELECT avg((center IS NULL)::INTEGER) AS share FROM labelled)""",
            "slides", "patient_labels",
            extra={
                "labelled": _LABELS_SQL,
                "named": "SELECT path, regexp_replace(parse_filename(path), '\\.[^.]*$', '') AS stem FROM slides WHERE path IS NOT NULL",
                "votes": f"""SELECT patient, center, count(*) AS n FROM (
  SELECT {PATIENT.format(c='n.stem')} AS patient, {CENTER.format(c='path')} AS center FROM named n) WHERE center IS NOT NULL GROUP BY ALL""",
            },
        ),
    ),
}
