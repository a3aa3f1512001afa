"""Distributed listing and tensor files read in ranges."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidelake.sources import files


def touch(path, data=b"", at=None):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    if at is not None:
        os.utime(path, (at, at))


def test_everything_below_the_root_once(spark, tmp_path):
    root = str(tmp_path / "in")
    names = ["a/x.svs", "a/b/c/d/deep.SVS", "_hidden/.dot.svs", "_under.svs", "sp ace/ü%20.svs"]
    for k, name in enumerate(names):
        touch(f"{root}/{name}", b"1" * k, 1_500_000_000 + k)
    touch(f"{root}/a/other.txt", b"n")
    os.symlink(root, f"{root}/a/back")  # a way back up is not followed
    got = {r["path"]: r for r in files.list_files(spark, root, ["svs"]).collect()}
    assert set(got) == {f"{root}/{n}" for n in names}
    for k, name in enumerate(names):
        r = got[f"{root}/{name}"]
        assert (r["length"], int(r["modificationTime"].timestamp())) == (k, 1_500_000_000 + k)
    assert files.list_files(spark, f"file:{root}/", ["svs"]).select("path").distinct().count() == len(names)


def test_flat_folder_is_shared_by_tasks(spark, tmp_path):
    root = str(tmp_path / "flat")
    for i in range(3000):
        touch(f"{root}/{i}.svs")
    listed = files.list_files(spark, root, ["svs"], batch_rows=100)
    per_task = [r["count"] for r in listed.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 3000 and len(per_task) == 8 and max(per_task) < 900


def test_empty_folder_missing_folder_and_vanished_file(spark, tmp_path):
    root = str(tmp_path / "e")
    os.makedirs(root)
    assert files.list_files(spark, root, ["svs"]).count() == 0
    with pytest.raises(Exception, match="No such file"):
        files.list_files(spark, f"{root}/none", ["svs"]).count()
    touch(f"{root}/x.svs", b"1")
    listed = files.list_files(spark, root, ["svs"])
    os.remove(f"{root}/x.svs")
    gone = listed.select("path", F.col("length").alias("size_bytes"))
    assert gone.first()["size_bytes"] is None
    r = files.fingerprint_files(gone).first()
    assert r["fingerprint"] is None and r["fingerprint_error"]


def save(path, a, order="C"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    np.save(path, np.asarray(a, order=order), allow_pickle=True)


def test_ranges_give_all_rows(spark, tmp_path):
    root = str(tmp_path / "n")
    a = np.arange(103 * 6, dtype=np.float64).reshape(103, 6)
    for name, (kind, order) in {"c8": ("f8", "C"), "f4": ("f4", "F"), "i2": (">i2", "C"), "h": ("f2", "F"), "b": ("?", "C")}.items():
        save(f"{root}/{name}.npy", a.astype(kind), order)
    ranges = files.npy_ranges(files.list_files(spark, root, ["npy"]), 6, range_bytes=400, batch_bytes=150)
    assert ranges.where("path LIKE '%c8.npy'").select(F.spark_partition_id()).distinct().count() > 1
    got = ranges.groupBy(F.regexp_extract("path", r"(\w+)\.npy", 1).alias("k")).agg(
        F.array_sort(F.collect_list(F.struct("tile_idx", "feat"))).alias("rows")
    )
    for r in got.collect():
        kind = {"c8": "f8", "f4": "f4", "i2": ">i2", "h": "f2", "b": "?"}[r["k"]]
        assert [x["tile_idx"] for x in r["rows"]] == list(range(103))
        assert np.array_equal(np.array([x["feat"] for x in r["rows"]]), a.astype(kind).astype(np.float32))
    assert got.count() == 5


def test_bad_files_give_one_row(spark, tmp_path):
    root = str(tmp_path / "bad")
    whole = np.ones((50, 4), np.float32)
    save(f"{root}/good.npy", whole)
    with open(f"{root}/good.npy", "rb") as f:
        content = f.read()
    touch(f"{root}/short.npy", content[:-1])
    touch(f"{root}/head.npy", content[:20])
    touch(f"{root}/empty.npy")
    save(f"{root}/objects.npy", np.array([[None, 1]], dtype=object))
    save(f"{root}/complex.npy", np.ones((2, 4), np.complex64))
    save(f"{root}/cube.npy", np.ones((2, 2, 2)))
    save(f"{root}/none.npy", np.ones((0, 4)))
    save(f"{root}/narrow.npy", np.ones((3, 0)))
    listed = files.list_files(spark, root, ["npy"]).select("path")
    gone = spark.createDataFrame([(f"{root}/gone.npy",)], "path string")
    rows = files.npy_ranges(listed.unionByName(gone), 4, range_bytes=64).collect()
    bad = {os.path.basename(r["path"]): r["error"] for r in rows if r["error"]}
    assert set(bad) == {f"{n}.npy" for n in ("short", "head", "empty", "objects", "complex", "cube", "narrow", "gone")}
    assert "truncated" in bad["short.npy"] and "bad_shape" in bad["cube.npy"] and "bad_type" in bad["objects.npy"]
    assert len(rows) == 50 + len(bad)
    wide = files.npy_ranges(listed.where("path LIKE '%narrow%'"), range_bytes=64).collect()
    assert [list(r["feat"]) for r in wide] == [[], [], []]


def test_file_over_two_gigabytes_is_read_by_seeking(tmp_path):
    from pyarrow import fs

    path, rows = f"{tmp_path}/big.npy", (5 << 30) // 4096
    a = np.lib.format.open_memmap(path, "w+", np.float32, (rows, 1024))  # sparse: takes no room on the disk
    a[-1] = np.arange(1024)
    a.flush()
    with fs.LocalFileSystem().open_input_file(path) as f:
        head = files._npy_head(f)
        assert head[:2] == (rows, 1024)
        assert np.array_equal(files._npy_rows(f, head, rows - 1, 1), np.arange(1024, dtype=np.float32)[None])
    os.remove(path)
