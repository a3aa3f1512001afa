"""File, image, log and inference queries over data derived from the driver tables.

Files are written by Spark from the tables into a fresh folder of the shared
scratch space and then read through the sources.
"""

from __future__ import annotations

import io
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slidelake.catalog import fixtures as fx
from slidelake.catalog import tiling_queries
from slidelake.catalog.fixtures import Query, with_views
from slidelake.catalog.manifest_queries import _FP as FILE_FINGERPRINT
from slidelake.catalog.token_queries import rz
from slidelake.functions import raster
from slidelake.functions import vectors as v
from slidelake.operators import diagnostics, inference, manifest
from slidelake.plans.embedding import patient_embeddings
from slidelake.plans import manifest as manifest_plan
from slidelake.plans import tiling as tiling_plan
from slidelake.session import scratch_path
from slidelake.sources import files, tables

DIM = 64

_HSV = """SELECT *, CASE WHEN mx = 0 THEN 0 ELSE (255 * (mx - mn)) // mx END::INTEGER AS s, mx::INTEGER AS v,
  floor(255 * CASE WHEN turn < 0 THEN turn + 1 ELSE turn END)::INTEGER AS h, ((299 * r + 587 * g + 114 * b + 500) // 1000)::DOUBLE AS gray FROM (
  SELECT *, CASE WHEN mx = mn THEN 0 WHEN r = mx THEN (g - b) / (mx - mn)::DOUBLE WHEN g = mx THEN 2 + (b - r) / (mx - mn)::DOUBLE
      ELSE 4 + (r - g) / (mx - mn)::DOUBLE END::DOUBLE / 6 AS turn
  FROM (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM pixels))"""
_MASKED = """SELECT *, s >= 20 AND v < 230 AS tissue, v >= 230 AND s <= 30 AS white, h BETWEEN 170 AND 255 AND s >= 60 AS pen FROM hsv"""
# The Laplacian by self-joins on the mirrored neighbour positions.
_LAP = """SELECT p.*, l.gray + r.gray + u.gray + w.gray - 4 * p.gray AS lap FROM masked p
JOIN masked l ON l.image = p.image AND l.y = p.y AND l.x = CASE WHEN p.x = 0 THEN 1 ELSE p.x - 1 END
JOIN masked r ON r.image = p.image AND r.y = p.y AND r.x = CASE WHEN p.x = 15 THEN 14 ELSE p.x + 1 END
JOIN masked u ON u.image = p.image AND u.x = p.x AND u.y = CASE WHEN p.y = 0 THEN 1 ELSE p.y - 1 END
JOIN masked w ON w.image = p.image AND w.x = p.x AND w.y = CASE WHEN p.y = 15 THEN 14 ELSE p.y + 1 END"""
_PIX = {"hsv": _HSV, "masked": _MASKED}
_QC_SQL = """SELECT image, round(avg(tissue::INTEGER), 6) AS tissue_pct, round(avg(white::INTEGER), 6) AS white_pct, round(avg(pen::INTEGER), 6) AS pen_pct,
  round(coalesce(var_pop(lap) FILTER (tissue), 0), 6) AS blur_var, round(coalesce(avg(v) FILTER (tissue), avg(v)), 6) AS brightness_mean,
  round(coalesce(avg(s) FILTER (tissue), avg(s)), 6) AS saturation_mean FROM lap GROUP BY image"""


def _r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _hsv(s, d):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return fx.pixels(s, d).withColumns({**raster.hsv_columns(r, g, b), "gray": raster.luma(r, g, b)})


def _npy_bytes(s, d) -> DataFrame:
    """Contents of ``.npy`` files, one per 32 consecutive vectors."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        buf = io.BytesIO()
        np.save(buf, np.stack([np.asarray(x, dtype=np.float32) for x in pdf["embedding"]]), allow_pickle=False)
        return pd.DataFrame({"path": [f"block-{int(pdf['block'].iloc[0])}.npy"], "content": [buf.getvalue()]})

    e = fx.table(s, d, "embeddings").withColumn("block", F.floor(F.col("vec_id") / 32))
    return e.select("block", "vec_id", "embedding").groupBy("block").applyInPandas(pack, "path string, content binary")


def _npy(s, d):
    return _by_id(files.npy_ingest(_npy_bytes(s, d), DIM))


def _npy_ranges(s, d):
    """The same files, written and read in ranges of a few rows."""
    root = scratch_path(s, "npy")
    _write_files(_npy_bytes(s, d).withColumnRenamed("path", "name"), root)
    return _by_id(files.npy_ranges(files.list_files(s, root, ["npy"]), DIM, range_bytes=5 * 4 * DIM))


def _by_id(rows: DataFrame) -> DataFrame:
    block = F.regexp_extract("path", r"block-(\d+)", 1).cast("bigint")
    return rows.where(F.col("error").isNull()).select(
        (block * 32 + F.col("tile_idx")).alias("vec_id"), F.round(v.l2_norm("feat"), 6).alias("norm"), F.round(v.total("feat"), 6).alias("total")
    )


_NPY = f"""SELECT vec_id, {rz("sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))")} AS norm,
  {rz("list_sum(list_transform(embedding, lambda x: x::DOUBLE))")} AS total FROM embeddings"""


def _csv(s, d):
    path = scratch_path(s, "csv")
    src = fx.slides(s, d).select("slide_id", "path", "size_bytes", "mpp_a")
    tables.write_csv(src, path)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in src.schema.fields])
    return tables.read_csv(s, path, schema)


def _json(s, d):
    path = scratch_path(s, "log")
    log = fx.train_log(s, d).select("step", "loss")
    tables.append_json(log.where(F.col("loss").isNull()), path)
    tables.append_json(log.where(F.col("loss").isNotNull()), path)
    typed = diagnostics.normalize_log(tables.read_log(s, path))
    return typed.select(F.col("step").cast("bigint").alias("step"), F.round("loss", 9).alias("loss"), "tps")


def _partitioned(s, d):
    path = scratch_path(s, "embeddings")
    i = F.col("vec_id")
    src = fx.table(s, d, "embeddings").select(
        "vec_id", F.concat(F.lit("set_"), (i % 3).cast("string")).alias("dataset"), F.col("embedding").alias("emb")
    )
    tables.write_embeddings(src, path)
    index = tables.embedding_index(s.read.parquet(path))
    return index.select("vec_id", "dataset", F.round("norm", 6).alias("norm"))


def _stage_log(s, d):
    path = scratch_path(s, "stages")
    sl = fx.slides(s, d)
    stats = {"n_records": F.count(F.lit(1)), "n_failures": F.count_if(F.col("path").isNull()), "total_bytes": F.sum("size_bytes")}
    for stage in ("manifest", "qc"):
        tables.append_stage(tables.stage_entry(sl, stage, {"root": "/wsi"}, {"table": "slides"}, stats), path)
    log = tables.read_stages(s, path)
    return log.select("stage", *[F.col("stats")[k].cast("bigint").alias(k) for k in stats])


def _write_files(rows: DataFrame, root: str) -> None:
    """Write each (name, content) row as a file below ``root``; runs in the tasks.

    With a column ``seconds``, files of a local file system get that time.  Contents reach Python by a plain function, which
    gets a hundred rows at once: a batch of Arrow holds up to 10,000 of them, and two are alive as one follows the other.
    """

    def write(name: str, content: bytes, second: int | None) -> int:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        at = f"{base}/{name}"
        system.create_dir(at.rpartition("/")[0], recursive=True)
        with system.open_output_stream(at, compression=None) as f:
            f.write(content)
        if second is not None and system.type_name == "local":
            os.utime(at, (second, second))
        return 1

    second = F.col("seconds") if "seconds" in rows.columns else F.lit(None).cast("bigint")
    run = F.udf(write, "int", useArrow=False).asNondeterministic()
    rows.select(run("name", F.col("content").cast("binary"), second).alias("n")).agg(F.sum("n")).collect()


#: Every document as a file in the folder of its source; some are empty, some have the suffix in capitals.
_FILE_NAME = """concat(coalesce(source, 'none'), '/', CAST(doc_id AS STRING), CASE WHEN doc_id % 10 = 3 THEN '.SVS' ELSE '.svs' END)"""
_FILES = """SELECT doc_id, coalesce(source, 'none') AS cancer_code, doc_id::VARCHAR AS slide_id,
  doc_id || CASE WHEN doc_id % 10 = 3 THEN '.SVS' ELSE '.svs' END AS filename, CASE WHEN doc_id % 97 = 0 THEN '' ELSE coalesce(text, '') END AS content,
  strlen(CASE WHEN doc_id % 97 = 0 THEN '' ELSE coalesce(text, '') END)::BIGINT AS size_bytes FROM documents"""


def _document_files(s, d) -> str:
    root = scratch_path(s, "files")
    content = F.when(F.col("doc_id") % 97 == 0, F.lit("")).otherwise(F.coalesce("text", F.lit("")))
    seconds = F.lit(1_600_000_000) + F.col("doc_id") * 60
    rows = fx.table(s, d, "documents").select(F.expr(_FILE_NAME).alias("name"), content.alias("content"), seconds.alias("seconds"))
    _write_files(rows, root)
    return root


def _inventory(s, d):
    listed = files.file_inventory(s, _document_files(s, d))
    seconds = F.unix_timestamp("modified_time").alias("modified_s")
    return listed.select("filename", "slide_id", "cancer_code", "size_bytes", seconds)


def _fingerprints(s, d):
    listed = files.file_inventory(s, _document_files(s, d)).select("path", "filename", "size_bytes")
    return files.fingerprint_files(listed, chunk=1024).select("filename", "size_bytes", "fingerprint", "fingerprint_error")


def _confirmed(s, d):
    found = manifest_plan.confirmed_duplicates(files.file_inventory(s, _document_files(s, d)), chunk=256)
    return found.select("filename", "size_bytes", "settled_by", "n_equal", "bytes_read", "error")


def _manifest(s, d):
    slides = fx.slides(s, d).where(F.col("doc_id") % 13 != 0)
    pairs = [F.lit("openslide.mpp-x"), F.col("mpp_a"), F.lit("aperio.MPP"), F.col("mpp_b"), F.lit("aperio.AppMag"), F.col("power")]
    props = slides.select(F.col("doc_id").cast("string").alias("slide_id"), F.create_map(*pairs).alias("properties"))
    built = manifest_plan.manifest_build(files.file_inventory(s, _document_files(s, d)), props, chunk=1024)
    wanted = ["filename", "cancer_code", "size_bytes", "fingerprint", "mpp_x", "mpp_y", "vendor", "objective_power", "objective_power_raw", "error"]
    return built.select(*wanted, (F.col("modified_time") > F.lit("2020-01-01").cast("timestamp")).alias("has_time"))


def artefacts(s, d):
    """The files written from the documents, as the artefact table sees them."""
    return files.artefact_table(s, _document_files(s, d), ("svs",), recent=2**31 - 1)


def _artefacts(s, d):
    return artefacts(s, d).select(F.regexp_extract("path", "[^/]*$", 0).alias("filename"), "size_mb", "sha256_12", "load_ok", "n_files")


def _labels(s, d):
    """Label tables under several names and headers; of the staging tables the one with the shortest name is wanted."""
    root = scratch_path(s, "labels")
    k = (F.col("row_no") % 7 + 1).cast("int")
    line = F.concat_ws(",", "patient", "pn", "center")
    by = fx.patient_labels(s, d).groupBy(k.alias("k")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    header = F.when(F.col("k") % 2 == 0, F.lit(' Case,"pn", center')).otherwise(F.lit("patient,center"))
    content = F.concat(header, F.lit("\n"), F.array_join("lines", "\n"))
    _write_files(by.select(F.concat(F.lit("labels_"), F.expr("repeat('x', k)"), F.lit(".csv")).alias("name"), content.alias("content")), root)
    found = files.discover_label_files(s, root)
    return found.select(F.regexp_extract("path", "[^/]*$", 0).alias("filename"), "columns")


def _label_table(s, d):
    src = fx.patient_labels(s, d)
    raw = src.select("row_no", F.col("patient").alias("Case"), F.col("pn").alias("Stage"), F.col("center").alias("CenterID"))
    return manifest.normalize_labels(raw).select("row_no", "patient", "pn", "center")


def _aliases(s, d):
    t = fx.tile_features(s, d).select(F.col("x").alias("PX_X"), F.col("y").alias("y_level"), F.lit(1).alias("lvl"), "vec_id")
    wanted = {"vec_id": ["vec_id"], "x": ["x", "px_x", "x_level"], "y": ["y", "px_y", "y_level"], "level": ["level", "lvl"], "tile_size": ["tile_size", "tile_px", "size"]}
    return manifest.resolve_columns(t, wanted, {"tile_size": 256})


def _write_png(images: DataFrame, root: str) -> None:
    """Write each image row as a PNG file; runs in the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for k, w, h, data in zip(batch["image"], batch["width"], batch["height"], batch["data"]):
                rgb = np.frombuffer(data, dtype=np.uint8).reshape(h, w, 3)[..., ::-1]
                lines = b"".join(b"\x00" + row.tobytes() for row in rgb)
                out = b"\x89PNG\r\n\x1a\n"
                for tag, body in (
                    (b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)), (b"IDAT", zlib.compress(lines)), (b"IEND", b""),
                ):
                    out += struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
                system, base = fs.FileSystem.from_uri(root)
                system.create_dir(base, recursive=True)
                with system.open_output_stream(f"{base}/{k}.png") as f:
                    f.write(out)
            yield batch[["image"]]

    images.select("image", "width", "height", "data").mapInPandas(run, "image bigint").count()


def _image_scan(s, d):
    root = scratch_path(s, "png")
    _write_png(raster.pack_pixels(fx.pixels(s, d)), root)
    img = files.image_scan(s, root)
    image = F.regexp_extract("path", r"(\d+)\.png$", 1).cast("bigint")
    qc = raster.raster_qc(img.withColumn("image", image), "image")
    return _r6(qc.drop("error"), *raster.METRICS)


def _tissue_mask(s, d):
    m = raster.tissue_mask(raster.pack_pixels(fx.pixels(s, d)), "image")
    return m.select("image", "mask_w", "mask_h", F.lower(F.hex("mask")).alias("mask"), "error")


def _tiles_from_images(s, d):
    """Thumbnail images to masks to tiles."""
    images = raster.pack_pixels(fx.pixels(s, d)).withColumnRenamed("image", "slide")
    masks = raster.tissue_mask(images, "slide")
    return tiling_plan.tile_table(tiling_queries.mask_slides(s, d), tiling_queries.slide_qc(s, d), masks, "medium", {0.5: 3, 2.0: 1}, tiling_queries.SEED)


# As the plan's views, over masks of 16 x 16 pixels: level 1 has 1/32 mask pixels, level 3 has 1/8.
_IMAGE_CTES = tiling_queries.PLAN_CTES | {
    "grid": """SELECT slide, cancer_code, 0.5::DOUBLE AS scale, 1 AS level, 0.5::DOUBLE AS approx_mpp, x, y, 2 * (y // 224) + x // 224 AS grid_idx,
  x // 32 AS x0, y // 32 AS y0, least((x + 256) // 32, 15) AS x1, least((y + 256) // 32, 15) AS y1
FROM gated, range(0, 257, 224) a(x), range(0, 257, 224) b(y)
UNION ALL SELECT slide, cancer_code, 2.0::DOUBLE, 3, 2.0::DOUBLE, 0, 0, 0, 0, 0, 15, 15 FROM gated""",
    "covered": """SELECT g.slide, cancer_code, scale, level, approx_mpp, g.x, g.y, grid_idx, avg(tissue::INTEGER)::DOUBLE AS coverage FROM grid g
JOIN masked m ON m.image = g.slide AND m.x >= x0 AND m.x < x1 AND m.y >= y0 AND m.y < y1
GROUP BY ALL HAVING avg(tissue::INTEGER) >= 0.30::DOUBLE""",
}


def _make_projection():
    w = np.cos(np.arange(DIM * 8).reshape(DIM, 8))
    return lambda x: x.astype(np.float64) @ w


def _infer(s, d):
    e = fx.table(s, d, "embeddings").select("vec_id", "embedding")
    out = inference.batch_infer(e, _make_projection, "embedding", (DIM,), batch_size=256, element=T.DoubleType())
    return out.select("vec_id", F.posexplode("feat").alias("dim", "value")).withColumn("value", F.round("value", 6))


def _patient_vectors(s, d):
    e = fx.table(s, d, "embeddings").select((F.col("vec_id") % 23).alias("patient"), F.col("embedding").alias("emb"))
    return patient_embeddings(e, pool="max").select("patient", "n_rows", F.round(v.l2_norm("emb"), 6).alias("norm"))


QUERIES: dict[str, tuple[Query, str | None]] = {
    "rgb_to_hsv_l": (
        lambda s, d: _hsv(s, d).select("image", "x", "y", "h", "s", "v", "gray"),
        with_views("SELECT image, x, y, h, s, v, gray FROM hsv", "pixels", extra=_PIX),
    ),
    "hsv_masks": (
        lambda s, d: _hsv(s, d).select("image", "x", "y", *[c.alias(n) for n, c in raster.mask_columns(F.col("h"), F.col("s"), F.col("v")).items()]),
        with_views("SELECT image, x, y, tissue, white, pen FROM masked", "pixels", extra=_PIX),
    ),
    "raster_qc": (
        lambda s, d: _r6(raster.raster_qc(raster.pack_pixels(fx.pixels(s, d)), "image").drop("error"), *raster.METRICS),
        with_views(_QC_SQL, "pixels", extra=_PIX | {"lap": _LAP}),
    ),
    "pixel_metrics": (
        lambda s, d: _r6(raster.pixel_metrics(fx.pixels(s, d)), *raster.METRICS),
        with_views(_QC_SQL, "pixels", extra=_PIX | {"lap": _LAP}),
    ),
    "laplacian_var": (
        lambda s, d: _r6(raster.pixel_metrics(fx.pixels(s, d)).select("image", "blur_var"), "blur_var"),
        with_views("SELECT image, round(coalesce(var_pop(lap) FILTER (tissue), 0), 6) AS blur_var FROM lap GROUP BY image", "pixels", extra=_PIX | {"lap": _LAP}),
    ),
    "tile_brightness_filter": (
        lambda s, d: _r6(raster.tile_brightness(fx.pixels(s, d)), "mean", "std"),
        with_views(
            """SELECT image, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std, avg(c) < 235 AND stddev_pop(c) > 15 AS keep
FROM (SELECT image, unnest([r, g, b]) AS c FROM pixels) GROUP BY image""", "pixels"
        ),
    ),
    "pixel_normalisation": (
        lambda s, d: fx.pixels(s, d).select(
            "image", "x", "y",
            *[F.round(c, 6).alias(n) for n, c in zip(("r_n", "g_n", "b_n"), raster.normalized_channels(F.col("r"), F.col("g"), F.col("b")))],
        ),
        with_views(
            f"""SELECT image, x, y, {rz("(r / 255::DOUBLE - 0.485::DOUBLE) / 0.229::DOUBLE")} AS r_n,
  {rz("(g / 255::DOUBLE - 0.456::DOUBLE) / 0.224::DOUBLE")} AS g_n, {rz("(b / 255::DOUBLE - 0.406::DOUBLE) / 0.225::DOUBLE")} AS b_n FROM pixels""", "pixels"
        ),
    ),
    "npy_ingest": (_npy, _NPY),
    "npy_ranges": (_npy_ranges, _NPY),
    "csv_scan_sink": (_csv, with_views("SELECT slide_id, path, size_bytes, nullif(mpp_a, '') AS mpp_a FROM slides", "slides")),
    "json_scan_sink": (_json, with_views("SELECT step, round(loss, 9) AS loss, NULL::DOUBLE AS tps FROM train_log", "train_log")),
    "partitioned_embedding_sink": (
        _partitioned,
        f"""SELECT vec_id, 'set_' || (vec_id % 3) AS dataset, {rz("sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))")} AS norm FROM embeddings""",
    ),
    "stage_log": (
        _stage_log,
        with_views(
            """SELECT stage, count(*) AS n_records, count(*) FILTER (path IS NULL) AS n_failures, sum(size_bytes)::BIGINT AS total_bytes
FROM slides, (SELECT unnest(['manifest', 'qc']) AS stage) GROUP BY stage""", "slides"
        ),
    ),
    "file_inventory": (_inventory, f"SELECT filename, slide_id, cancer_code, size_bytes, (1600000000 + doc_id * 60)::BIGINT AS modified_s FROM ({_FILES})"),
    "fingerprint_files": (
        _fingerprints,
        f"""SELECT filename, size_bytes, {FILE_FINGERPRINT} AS fingerprint, NULL::VARCHAR AS fingerprint_error FROM ({_FILES})""",
    ),
    "confirmed_duplicates": (
        _confirmed,
        f"""SELECT filename, size_bytes, settled_by, n_equal, CASE settled_by WHEN 'size' THEN 0 ELSE least(size_bytes, 256) + CASE WHEN size_bytes > 256 THEN 256 ELSE 0 END
    + CASE settled_by WHEN 'full' THEN size_bytes ELSE 0 END END::BIGINT AS bytes_read, NULL::VARCHAR AS error FROM (
  SELECT filename, size_bytes, n_equal, CASE WHEN n_size = 1 OR size_bytes = 0 THEN 'size' WHEN n_ends = 1 OR size_bytes <= 512 THEN 'quick' ELSE 'full' END AS settled_by FROM (
    SELECT *, count(*) OVER (PARTITION BY size_bytes) AS n_size, count(*) OVER (PARTITION BY content) AS n_equal,
      count(*) OVER (PARTITION BY size_bytes, left(hex(encode(content)), 512), right(hex(encode(content)), 512)) AS n_ends FROM ({_FILES})))""",
    ),
    "manifest_build": (
        _manifest,
        with_views(
            f"""SELECT filename, cancer_code, f.size_bytes, {FILE_FINGERPRINT.replace("content", "f.content").replace("size_bytes", "f.size_bytes")} AS fingerprint,
  TRY_CAST(coalesce(nullif(mpp_a, ''), nullif(mpp_b, '')) AS DOUBLE) AS mpp_x, TRY_CAST(nullif(mpp_b, '') AS DOUBLE) AS mpp_y, 'unknown' AS vendor,
  TRY_CAST(power AS DOUBLE) AS objective_power, power AS objective_power_raw, CASE WHEN s.doc_id IS NULL THEN 'no properties' END AS error, true AS has_time
FROM ({_FILES}) f LEFT JOIN (SELECT * FROM slides WHERE doc_id % 13 <> 0) s ON s.doc_id = f.doc_id""",
            "slides",
        ),
    ),
    "artefact_table": (
        _artefacts,
        f"""SELECT filename, round(size_bytes / 1048576::DOUBLE, 2) AS size_mb, substr(sha256(content), 1, 12) AS sha256_12, size_bytes > 0 AS load_ok,
  count(*) OVER () AS n_files FROM ({_FILES})""",
    ),
    "discover_label_files": (
        _labels,
        with_views(
            """SELECT 'labels_' || repeat('x', min(k)) || '.csv' AS filename, 'case,pn,center' AS columns
FROM (SELECT DISTINCT (row_no % 7 + 1)::INTEGER AS k FROM patient_labels) WHERE k % 2 = 0 HAVING count(*) > 0""", "patient_labels"
        ),
    ),
    "label_normalisation": (_label_table, with_views("SELECT row_no, patient, pn, center FROM patient_labels", "patient_labels")),
    "resolve_columns": (
        _aliases,
        with_views("SELECT vec_id, x, y, 1 AS level, 256 AS tile_size FROM tiles", "tiles"),
    ),
    "tissue_mask": (
        _tissue_mask,
        with_views(
            """SELECT image, 16 AS mask_w, 16 AS mask_h, string_agg(CASE WHEN tissue THEN '01' ELSE '00' END, '' ORDER BY y, x) AS mask,
  NULL::VARCHAR AS error FROM masked GROUP BY image""", "pixels", extra=_PIX
        ),
    ),
    "tile_table_from_images": (
        lambda s, d: _tiles_from_images(s, d).withColumn("coverage", F.round("coverage", 9)),
        with_views("SELECT * REPLACE (round(coverage, 9) AS coverage) FROM tile_table", "pixels", extra=_PIX | _IMAGE_CTES),
    ),
    "image_scan": (_image_scan, with_views(_QC_SQL, "pixels", extra=_PIX | {"lap": _LAP})),
    "batch_infer": (
        _infer,
        f"""SELECT vec_id, k::INTEGER AS dim, {rz("sum(e * cos(i * 8 + k))")} AS value FROM (
  SELECT vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), range(8) t(k) GROUP BY ALL""",
    ),
    "patient_embeddings": (
        _patient_vectors,
        f"""SELECT patient, n AS n_rows, {rz("sqrt(sum(m * m))")} AS norm FROM (
  SELECT vec_id % 23 AS patient, dim, max(x) AS m, count(*) AS n FROM (
    SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY ALL)
GROUP BY patient, n""",
    ),
}
