"""The evaluation plans against plain computation on their own predictions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidelake.plans import evaluation
from slidelake.plans.manifest import failures, hash_index, manifest_build
from slidelake.sources.files import file_inventory


def kappa(y, p):
    labels = sorted(set(y) | set(p))
    i, j = np.array([labels.index(v) for v in y]), np.array([labels.index(v) for v in p])
    expected = np.mean((i[:, None] - j[None, :]) ** 2)
    return 1 - np.mean((i - j) ** 2) / expected


def test_binary_evaluation(spark):
    r = np.random.default_rng(4)
    rows = [(f"{'Tumor' if i % 3 == 0 else 'normal'}_{i}", (r.normal(size=4) + (i % 3 == 0)).tolist()) for i in range(90)]
    rows += [("tumor_bad", [1.0]), ("normal_none", None)]
    df = spark.createDataFrame(rows, "slide string, feat array<double>")
    parts = evaluation.binary_evaluation(df, 4, n_boot=50)
    oof, s = parts["predictions"].collect(), parts["summary"].first()
    assert len(oof) == 90 and {x.fold for x in oof} == set(range(5))
    pos, neg = [x.score for x in oof if x.y], [x.score for x in oof if not x.y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert s.auroc == pytest.approx(auc) and 0.6 < auc < 1 and s.ci_lo < auc < s.ci_hi
    hit = np.array([(x.y, x.pred) for x in oof])
    tp = (hit.sum(axis=1) == 2).sum()
    assert s.accuracy == pytest.approx((hit[:, 0] == hit[:, 1]).mean())
    assert s["binary_f1"] == pytest.approx(2 * tp / (hit[:, 0].sum() + hit[:, 1].sum()))
    assert all((x.score > 0.5) == (x.pred == 1) for x in oof)
    assert (s.n_slides, s.n_tumor, s.n_refused) == (90, 30, 2)


def test_staging_evaluation(spark):
    r = np.random.default_rng(5)
    rows = [(i, i % 3, i % 4 - 1, (r.normal(size=3) + i % 3).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "patient int, y int, center int, feat array<double>")
    parts = evaluation.staging_evaluation(df, ("ridge", "logreg_l2"), (0.1, 1.0), n_boot=50)
    grid, oof, best = parts["grid"].collect(), parts["predictions"].collect(), parts["best"].first()
    assert len(grid) == 4 and all(g.folds == 3 and g.detail.startswith("CEN0:n=30|k=") for g in grid)
    # Patients of unknown center only train.
    assert sorted(x.patient for x in oof) == [i for i in range(120) if i % 4]
    assert max(g.kappa_mean for g in grid) == best.kappa_mean
    per = [kappa([x.y for x in oof if x.fold == f], [x.pred for x in oof if x.fold == f]) for f in range(3)]
    assert best.kappa_mean == pytest.approx(np.mean(per))
    assert best.kappa_overall == pytest.approx(kappa([x.y for x in oof], [x.pred for x in oof])) and best.ci_lo < best.kappa_overall < best.ci_hi


def test_oof_table_of_logits_and_without_providers(spark):
    r = np.random.default_rng(6)
    z = r.normal(size=(60, 3))
    rows = [(i % 3, *map(float, v)) for i, v in enumerate(z)]
    logits = spark.createDataFrame(rows, "true_isup int, logit_0 double, logit_1 double, logit_2 double")
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    probs = spark.createDataFrame([(i % 3, *map(float, 5 * v)) for i, v in enumerate(p)], "true_isup int, prob_0 double, prob_1 double, prob_2 double")
    one, two = [sorted(map(tuple, evaluation.oof_table_evaluation(t, thresholds=(1, 2), digits=9).collect())) for t in (logits, probs)]
    assert len(one) == 2 and [x[:2] for x in one] == [("all", None)] * 2
    for a, b in zip(one, two):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:])
    with pytest.raises(ValueError, match="neither"):
        evaluation.oof_table_evaluation(logits.select("true_isup"))


def test_manifest_keeps_every_file(spark, tmp_path):
    for name, data in (("a/1.svs", b"abc"), ("a/2.svs", b""), ("3.SVS", b"xyz" * 10)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    inventory = file_inventory(spark, str(tmp_path))
    gone = inventory.limit(1).withColumns({"path": F.lit(str(tmp_path / "gone.svs")), "slide_id": F.lit("gone")})
    properties = spark.createDataFrame([("1", {"openslide.mpp-x": "0.5"}), ("gone", {})], "slide_id string, properties map<string,string>")
    got = {r.slide_id: r for r in manifest_build(inventory.unionByName(gone), properties).collect()}
    assert set(got) == {"1", "2", "3", "gone"}
    assert got["1"].error is None and got["1"].mpp_x == 0.5 and got["1"].cancer_code == "a"
    assert got["2"].error == "no properties" and got["2"].fingerprint.startswith("QSHA1:")
    assert got["gone"].fingerprint is None and "FileNotFound" in got["gone"].error
    built = manifest_build(inventory, properties)
    assert failures(built).count() == 2 and hash_index(built).count() == 3
