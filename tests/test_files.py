"""Sources and sinks on small files written by the tests."""

import hashlib
import io
import json
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidelake.catalog.source_queries import _write_png
from slidelake.functions.raster import raster_qc
from slidelake.operators import diagnostics
from slidelake.sources import files, tables


def put(path, data=b""):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_inventory_and_ranged_fingerprint(spark, tmp_path):
    root = str(tmp_path / "wsi")
    data = {"a/x.svs": b"1" * 10, "a/b/y.TIFF": b"2" * 40, "z.ndpi": b"", "a/notes.txt": b"n", "a/q.Svs": b"m"}
    for k, body in data.items():
        put(f"{root}/{k}", body)
    inv = files.file_inventory(spark, root)
    assert [(r["filename"], r["slide_id"], r["cancer_code"], r["size_bytes"]) for r in inv.orderBy("path").collect()] == [
        ("y.TIFF", "y", "a", 40), ("x.svs", "x", "a", 10), ("z.ndpi", "z", "UNKNOWN", 0),
    ]
    assert files.file_inventory(spark, f"file:{root}").select("cancer_code").distinct().count() == 2
    ghost = inv.limit(1).withColumn("path", F.lit(f"{root}/gone.svs"))
    got = {r["path"]: r for r in files.fingerprint_files(inv.unionByName(ghost), chunk=16).collect()}
    body = data["a/b/y.TIFF"]
    assert got[f"{root}/a/b/y.TIFF"]["fingerprint"] == "QSHA1:" + hashlib.sha1(body[:16] + body[-16:] + b"40").hexdigest()
    assert got[f"{root}/gone.svs"]["fingerprint"] is None and "FileNotFound" in got[f"{root}/gone.svs"]["fingerprint_error"]
    full = {r["filename"]: r["fingerprint"] for r in files.fingerprint_files(inv, "sha1_full").collect()}
    assert full["x.svs"] == "SHA1:" + hashlib.sha1(data["a/x.svs"]).hexdigest()


def test_npy_shapes(spark, tmp_path):
    for name, a in {"empty": np.zeros((0, 8)), "five": np.arange(40.0).reshape(5, 8), "flat": np.zeros(8), "wide": np.zeros((2, 9))}.items():
        buf = io.BytesIO()
        np.save(buf, a.astype(np.float16))
        put(f"{tmp_path}/n/{name}.npy", buf.getvalue())
    put(f"{tmp_path}/n/broken.npy", b"not a tensor")
    rows = files.read_npy(spark, f"{tmp_path}/n", 8).collect()
    ok = [r for r in rows if r["error"] is None]
    assert [(r["tile_idx"], list(r["feat"])) for r in sorted(ok, key=lambda r: r["tile_idx"])] == [
        (i, [8.0 * i + j for j in range(8)]) for i in range(5)
    ]
    assert sorted(os.path.basename(r["path"]) for r in rows if r["error"]) == ["broken.npy", "flat.npy", "wide.npy"]


def test_png_scan(spark, tmp_path):
    rgb = np.zeros((4, 5, 3), dtype=np.uint8)
    rgb[:] = (10, 200, 30)
    df = spark.createDataFrame([(7, 5, 4, bytearray(rgb[..., ::-1].tobytes()))], "image bigint, width int, height int, data binary")
    _write_png(df, f"{tmp_path}/png")
    img = files.image_scan(spark, f"{tmp_path}/png")
    r = img.collect()[0]
    assert (r["width"], r["height"], r["channels"]) == (5, 4, 3) and bytes(r["data"]) == rgb[..., ::-1].tobytes()
    q = raster_qc(img.withColumn("k", F.lit(1)), "k").collect()[0]
    assert q["brightness_mean"] == 200.0 and q["tissue_pct"] == 1.0


def test_label_discovery(spark, tmp_path):
    put(f"{tmp_path}/l/long_name.csv", b"Patient,pN,center\np,1,2\n")
    put(f"{tmp_path}/l/sub/s.csv", b"\xef\xbb\xbfCase,\"PN\"\r\np,1\r\n")
    put(f"{tmp_path}/l/a.csv", b"patient,center\n")
    put(f"{tmp_path}/l/e.csv", b"")
    got = files.discover_label_files(spark, f"{tmp_path}/l").collect()
    assert len(got) == 1 and got[0]["path"].endswith("/sub/s.csv") and got[0]["columns"] == "case,pn"
    put(f"{tmp_path}/m/a.csv", b"x,y\n")
    assert files.discover_label_files(spark, f"{tmp_path}/m").collect() == []


def test_json_log_with_absent_columns(spark, tmp_path):
    lines = [{"ts": "t1", "step": 1, "loss": 2.5}, {"ts": "t2", "step": "2", "loss": "bad"}]
    put(f"{tmp_path}/log/a.jsonl", "\n".join(map(json.dumps, lines)).encode())
    rows = diagnostics.normalize_log(tables.read_log(spark, f"{tmp_path}/log")).orderBy("ts").collect()
    assert [(r["step"], r["loss"], r["tps"]) for r in rows] == [(1.0, 2.5, None), (2.0, None, None)]
    bare = spark.createDataFrame([("3",)], "step string")
    r = diagnostics.normalize_log(bare).collect()[0]
    assert r["step"] == 3.0 and r["ts"] is not None and r["vram_gb"] is None


def test_csv_keeps_arrays_and_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"]), ("b", [])], "id string, reasons array<string>")
    tables.write_csv(df, f"{tmp_path}/c")
    schema = spark.createDataFrame([], "id string, reasons string").schema
    assert sorted((r["id"], r["reasons"]) for r in tables.read_csv(spark, f"{tmp_path}/c", schema).collect()) == [("a", "x;y"), ("b", None)]
    put(f"{tmp_path}/bom/x.csv", b"\xef\xbb\xbfid,reasons\nq,r\n")
    assert [tuple(r) for r in tables.read_csv(spark, f"{tmp_path}/bom", schema).collect()] == [("q", "r")]


def test_artefacts(spark, tmp_path):
    for i in range(8):
        put(f"{tmp_path}/m/w{i}.pt", b"w" * i)
        os.utime(f"{tmp_path}/m/w{i}.pt", (1000 + i, 1000 + i))
    rows = {os.path.basename(r["path"]): r for r in files.artefact_table(spark, f"{tmp_path}/m").collect()}
    assert sorted(rows) == [f"w{i}.pt" for i in range(2, 8)]
    put(f"{tmp_path}/e/none.pth")
    assert [(r["load_ok"], r["size_mb"]) for r in files.artefact_table(spark, f"{tmp_path}/e").collect()] == [(False, 0.0)]
    assert rows["w3.pt"]["sha256_12"] == hashlib.sha256(b"www").hexdigest()[:12] and rows["w3.pt"]["load_ok"]


def test_duplicates_are_confirmed_in_stages(spark, tmp_path):
    """Equal size, head and tail are no proof; unread files cost no bytes."""
    from slidelake.plans.manifest import confirmed_duplicates

    long = b"h" * 16 + b"middle-1" * 8 + b"t" * 16
    bodies = {
        "own": b"size of its own", "same1": long, "same2": long, "other": long.replace(b"1", b"2"), "head": b"H" + long[1:],
        "e1": b"", "e2": b"", "s1": b"k" * 20, "s2": b"k" * 20, "s3": b"k" * 19 + b"l",
    }
    for name, body in bodies.items():
        put(f"{tmp_path}/{name}.svs", body)
    inv = files.file_inventory(spark, str(tmp_path)).withColumn("error", F.lit("old"))
    lost = inv.where("filename = 'own.svs'").withColumns({"path": F.lit("/gone.svs"), "filename": F.lit("gone.svs"), "size_bytes": F.lit(96).cast("bigint")})
    unknown = lost.withColumns({"size_bytes": F.lit(None).cast("bigint"), "filename": F.lit("nosize.svs")})
    got = {r.filename[:-4]: r for r in confirmed_duplicates(inv.unionByName(lost).unionByName(unknown), chunk=16).collect()}
    assert len(got) == 12
    assert {k: (r.settled_by, r.n_equal, r.bytes_read) for k, r in got.items()} == {
        "own": ("size", 1, 0), "e1": ("size", 2, 0), "e2": ("size", 2, 0), "head": ("quick", 1, 32),
        "s1": ("quick", 2, 32), "s2": ("quick", 2, 32), "s3": ("quick", 1, 32), "nosize": ("size", None, 0), "gone": ("quick", None, 0),
        "same1": ("full", 2, 128), "same2": ("full", 2, 128), "other": ("full", 1, 128),
    }
    assert got["same1"].fingerprint == got["same2"].fingerprint != got["other"].fingerprint
    assert "FileNotFound" in got["gone"].error and got["nosize"].error == "no size" and got["own"].error is None
    assert confirmed_duplicates(inv.limit(0)).count() == 0


WRITE_AND_LIST = """
import sys
import psutil
from pyspark.sql import functions as F
from slidelake.catalog.source_queries import _write_files
from slidelake.session import local_session
from slidelake.sources.files import list_files

spark = local_session("2", 2, "1g")
rows = spark.range(0, 8000, 1, 1).select(
    F.concat("id", F.lit(".svs")).alias("name"), F.repeat(F.lit("x"), 16384 + F.col("id").cast("int") % 7).alias("content")
)
_write_files(rows, sys.argv[1])
sizes = list_files(spark, sys.argv[1], ["svs"]).agg(F.count("path"), F.sum("length")).first()
found = [p for p in psutil.Process().children(recursive=True) if "pyspark.daemon" in p.cmdline()]
daemons = [p for p in found if "pyspark.daemon" not in p.parent().cmdline()]
peaks = [int(x.split()[1]) // 1024 for p in found for x in open(f"/proc/{p.pid}/status") if x.startswith("VmHWM")]
print(*sizes, len(daemons), max(peaks))
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/status"), reason="reads peaks of memory from /proc")
def test_writing_and_listing_take_little_python(tmp_path):
    """128 MB of contents pass one worker, which never holds more than a few of them; listing starts no second set of workers."""
    pytest.importorskip("psutil")
    done = subprocess.run(
        [sys.executable, "-c", WRITE_AND_LIST, str(tmp_path / "out")], capture_output=True, text=True, timeout=300, check=True,
        cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
    )
    n, size, daemons, peak_mb = map(int, done.stdout.split()[-4:])
    assert (n, size) == (8000, sum(16384 + i % 7 for i in range(8000)))
    assert daemons == 1 and peak_mb < 200, (daemons, peak_mb)
