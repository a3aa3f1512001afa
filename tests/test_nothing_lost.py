"""Rows that the fixtures never hold: none of them may vanish or change a result unnoticed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidelake.functions import raster
from slidelake.operators import folds, metrics, pooling, tiling, tokens
from slidelake.plans import embedding
from slidelake.session import scratch_path
from slidelake.sources import files


def test_tiny_probabilities_are_ranked(spark):
    rows = [(0, [1.0, 1e-12]), (0, [1.0, 2e-12]), (1, [1.0, 3e-10]), (1, [1.0, 4e-10])]
    df = spark.createDataFrame(rows, "y int, probs array<double>")
    got = metrics.threshold_metrics(df, "probs", "y", [1]).first()
    assert got["auroc"] == 1.0 and got["auprc"] == 1.0


def test_unreadable_image_keeps_its_row(spark, tmp_path):
    (tmp_path / "bad.png").write_bytes(b"no image at all")
    (r,) = files.image_scan(spark, str(tmp_path)).collect()
    assert r["path"].endswith("bad.png") and r["width"] is None and r["error"] == "unreadable image"
    images = files.image_scan(spark, str(tmp_path))
    assert raster.raster_qc(images, "path").first()["error"] and raster.tissue_mask(images, "path").first()["error"]


def test_bag_with_a_bad_vector_is_refused_whole(spark):
    rows = [(b, s, i, i, [1.0, 2.0] if not (b == "x" and i == 1) else [1.0]) for b in ("x", "y") for i, s in enumerate((0.5, 0.5, 2.0))]
    rows += [("z", 0.5, 9, 0, None), ("z", 2.0, 10, 0, [1.0, 1.0])]
    df = spark.createDataFrame([(b, s, f"{b}{i}", t, v) for b, s, i, t, v in rows], "bag string, scale double, vec_id string, tile_idx int, feat array<double>")
    got = {r["bag"]: (r["ok"], r["reason"]) for r in embedding.embedding_outcomes(df, 2).collect()}
    assert got == {"x": (False, "bad_shape(1)"), "y": (True, None), "z": (False, "missing_feature_file")}


def test_padding_by_scale_refuses_other_scales(spark):
    df = spark.createDataFrame([("a", 1.0, 0, [1.0])], "bag string, scale double, tile_idx int, feat array<double>")
    bags = spark.createDataFrame([("a", 0)], "bag string, batch int")
    with pytest.raises(Exception, match="no budget for scale 1.0"):
        tokens.pad_bags_by_scale(df, bags, "bag", "batch", "tile_idx", 1, {0.5: 2}).collect()


def test_levels_and_strict_grid(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0],)], "d array<double>")
    pick = lambda w: tuple(df.select(tiling.level_for_downsample(F.col("d"), w).alias("l")).first()["l"])
    assert [pick(w) for w in (0.5, 1.0, 3.9, 4.0, 100.0)] == [(0, 1.0), (0, 1.0), (1, 2.0), (2, 4.0), (2, 4.0)]
    small = spark.createDataFrame([(1, 100, 300), (2, 300, 256)], "id int, level_w int, level_h int")
    assert [r["id"] for r in tiling.tile_grid(small, strict=True).collect()] == [2]
    assert tiling.tile_grid(small).count() == 2


def test_scratch_is_in_the_session_folder(spark):
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]


def test_null_bags_are_pooled_and_masked(spark):
    rows = [(None, i, float(i), [float(i), 1.0]) for i in range(3)] + [("a", 9, 1.0, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "bag string, id int, score double, feat array<double>")
    got = {r["bag"]: (r["k"], r["emb"]) for r in pooling.topk_softmax_pool(df, ["bag"], "score", "id").collect()}
    w = np.exp([0.0, 1.0, 2.0])
    assert got["a"] == (1, [1.0, 2.0]) and got[None][0] == 3
    assert got[None][1] == pytest.approx([float(w @ [0, 1, 2] / w.sum()), 1.0])
    masked = tokens.mask_positions(df, ["bag"], "id", 7).collect()
    assert len(masked) == 4 and sorted(str(r["bag"]) for r in masked if r["masked"]) == ["None", "a"]


def test_padding_keeps_to_the_budget_with_ties_and_null_bags(spark):
    rows = [("a", 0.5, 7, i, [float(i)]) for i in range(3)] + [("b", 0.5, 7, 5, [5.0])] * 3 + [(None, 0.5, i, i, [1.0]) for i in range(2)]
    df = spark.createDataFrame(rows, "bag string, scale double, tile_idx int, id int, feat array<double>")
    bags = spark.createDataFrame([("a", 0), ("b", 0), (None, 0)], "bag string, batch int")
    for options in ({}, {"row_id": "id"}):
        got = {r["bag"]: (r["t"], r["tokens"]) for r in tokens.pad_bags(df, bags, "bag", "batch", "tile_idx", 1, {0.5: 2}, **options).collect()}
        assert {b: t for b, (t, _) in got.items()} == {"a": 2, "b": 2, None: 2}
    assert got["a"][1] == [[0.0], [1.0]]


def test_rows_without_a_bag_have_a_reason(spark):
    df = spark.createDataFrame([(None, 0.5, "x", 0, [1.0]), ("a", 0.5, "y", 0, [1.0]), ("a", 2.0, "z", 0, [1.0])], "bag string, scale double, vec_id string, tile_idx int, feat array<double>")
    got = {r["bag"]: (r["ok"], r["reason"]) for r in embedding.embedding_outcomes(df, 1).collect()}
    assert got == {"a": (True, None), None: (False, "no_bag")}


def test_fold_scaling_of_large_means(spark):
    """Deviations do not drown in the squares of a large mean, nor in folds that lie far apart."""
    r = np.random.default_rng(3)
    x = np.concatenate([1e9 + r.integers(0, 5, (40, 3)), r.normal(0, 1e-3, (40, 3)), np.full((5, 3), 7.0)])
    fold = [i % 4 for i in range(40)] + [4] * 40 + [None] * 5
    df = spark.createDataFrame([(f, v.tolist()) for f, v in zip(fold, x)] + [(0, None)], "fold int, feat array<double>")
    for far in (df, df.where("fold < 4"), df.where("fold >= 4 or fold is null")):
        rows = [(f, np.array(v)) for f, v in far.collect() if v is not None]
        for s in folds.fold_scaling(far, "fold", [], "feat").collect():
            train = np.array([v for f, v in rows if f != s["fold"]])
            assert s["mean"] == pytest.approx(train.mean(axis=0), rel=1e-12) and s["std"] == pytest.approx(np.where(train.std(axis=0) < 1e-12, 1, train.std(axis=0)), rel=1e-9)
    small = folds.fold_stats(spark.createDataFrame([(f, [1e9 + v]) for f in (0, 1) for v in range(5)], "fold int, feat array<double>"), "fold", [], "feat")
    assert [s["std"] for s in small.collect()] == pytest.approx([np.sqrt(2)] * 2, rel=1e-9)


def test_kappa_of_too_many_cells_is_an_error(spark):
    c = spark.range(20).select(F.col("id").alias("y"), F.col("id").alias("pred"), F.lit(1).cast("long").alias("n"))
    assert metrics.qw_kappa(c).first()["kappa"] == 1.0
    with pytest.raises(Exception, match="too many classes"):
        metrics.qw_kappa(c, max_cells=19).collect()
