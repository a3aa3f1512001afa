"""Hand-made edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidelake.functions import hashing, parsing, raster
from slidelake.functions import vectors as v
from slidelake.operators import bootstrap, budget, diagnostics, folds, joins, manifest, metrics, pooling, qc, stats, tiling, tokens


def one(df):
    return df.collect()[0]


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 24, 31, 32, 33, 100])
def test_quick_fingerprint_sizes(spark, n):
    import hashlib

    data, chunk = bytes(i % 251 for i in range(n)), 16
    want = hashlib.sha1(data[:chunk] + (data[max(n - chunk, 0):] if n > chunk else b"") + str(n).encode()).hexdigest()
    df = spark.createDataFrame([(bytearray(data), n)], "content binary, size bigint")
    assert one(df.select(hashing.fingerprint("content", "size", chunk=chunk).alias("f")))["f"] == "QSHA1:" + want


def test_unknown_fingerprint_mode():
    with pytest.raises(ValueError):
        hashing.fingerprint("c", "s", "md5")


def test_parsing(spark):
    rows = [("/r/a/b/x.tar.svs",), ("/r/x.svs",), (None,)]
    df = spark.createDataFrame(rows, "p string").select(
        parsing.class_from_path("p", "/r/").alias("c"), parsing.stem("p").alias("s")
    )
    assert [tuple(r) for r in df.collect()] == [("a", "x.tar"), ("UNKNOWN", "x"), (None, None)]
    st = spark.createDataFrame([("pN1mi",), ("PN 3",), ("2",), ("5",), ("12",), (None,), ("x",)], "s string")
    assert [r[0] for r in st.select(parsing.parse_stage("s")).collect()] == [1, 3, 2, None, None, None, None]
    ce = spark.createDataFrame([("Center_4",), ("center-12/x",), ("7",), ("12",), ("99999999999",), ("",), (None,)], "s string")
    assert [r[0] for r in ce.select(parsing.parse_center("s")).collect()] == [4, 12, 7, None, None, None, None]
    po = spark.createDataFrame([("20",), ("20.5",), ("2.0.5",), ("n/a",), ("",), (None,)], "s string")
    assert [r[0] for r in po.select(parsing.power_number("s")).collect()] == [20.0, 20.5, None, None, None, None]
    pa = spark.createDataFrame([("Patient-12_node_3",), ("abc_node_1",), ("zzz",)], "s string")
    assert [r[0] for r in pa.select(parsing.patient_from_slide("s")).collect()] == ["patient-12", "abc", "zzz"]


def test_duplicates_fall_back_to_size_and_name(spark):
    rows = [(None, 5, "a"), (None, 5, "a"), (None, 5, "b"), (None, None, "b")]
    df = spark.createDataFrame(rows, "fingerprint string, size_bytes bigint, filename string")
    assert [tuple(r) for r in manifest.duplicate_groups(df).collect()] == [("5|a", 2)]
    some = df.unionByName(spark.createDataFrame([("f", 1, "x")], df.schema))
    assert manifest.duplicate_groups(some).collect() == []
    assert tuple(one(manifest.duplicate_summary(manifest.duplicate_groups(some)))) == (0, 0)


def test_histogram_of_equal_values(spark):
    df = spark.createDataFrame([(2.0,)] * 3 + [(None,)], "x double")
    h = manifest.histogram(df, "x", 4).orderBy("bin").collect()
    counts, edges = np.histogram([2.0] * 3, bins=4)
    assert [r["n"] for r in h] == counts.tolist()
    assert np.allclose([r["left_edge"] for r in h] + [h[-1]["right_edge"]], edges)


def test_qc_rules_are_strict(spark):
    df = spark.createDataFrame([(0.10, 0.75, 15.0, 0.02), (0.0999, 0.7501, 14.9, 0.0201)], "tissue_pct double, white_pct double, blur_var double, pen_pct double")
    rows = qc.qc_flags(df).collect()
    assert (rows[0]["reasons"], rows[0]["excluded"]) == ("", 0)
    assert rows[1]["reasons"] == "low_tissue<0.10;white>0.75;blur<15.0;pen>0.02"
    with pytest.raises(ValueError):
        qc.qc_gate(df, df, "loose")


def test_resolve_columns(spark):
    df = spark.createDataFrame([(1, 2)], "PX_X int, y int")
    out = manifest.resolve_columns(df, {"x": ["x", "px_x"], "y": ["y"], "t": ["tile_px"]}, {"t": 256})
    assert tuple(one(out)) == (1, 2, 256)
    with pytest.raises(KeyError):
        manifest.resolve_columns(df, {"z": ["z"]})


def test_choose_level_ties_and_fallback(spark):
    df = spark.createDataFrame([(0.25, [1.0, 3.0]), (None, [1.0, 2.0]), (1.0, [2.0, 2.0])], "b double, d array<double>")
    got = [tuple(r[0]) for r in df.select(tiling.choose_level(F.col("b"), F.col("d"), 0.5)).collect()]
    # 0.25 and 0.75 are equally far; the base resolution beats both levels in the last row.
    assert got == [(0, 0.25), (1, 0.5), (0, 1.0)]


def test_grid_and_coverage_edges(spark):
    df = spark.createDataFrame([("s", 100, 600), ("t", 480, 256)], "s string, level_w int, level_h int")
    g = [(r["s"], r["x"], r["y"], r["grid_idx"]) for r in tiling.tile_grid(df).orderBy("s", "grid_idx").collect()]
    assert g == [("s", 0, 0, 0), ("s", 0, 224, 1), ("t", 0, 0, 0), ("t", 224, 0, 1)]


@pytest.mark.parametrize("h, w, lw, lh", [(23, 31, 900, 700), (4, 5, 2000, 1500), (60, 80, 300, 1000), (9, 7, 700, 480)])
def test_coverage_forms_agree_with_brute_force(spark, h, w, lw, lh):
    rng = np.random.default_rng(h)
    mask = (rng.random((h, w)) < 0.4).astype(np.uint8)
    sx, sy = w / lw, h / lh
    cells = spark.createDataFrame([(1, x, y, int(mask[y, x])) for y in range(h) for x in range(w)], "slide int, mx int, my int, tissue int")
    box = tiling.roi(F.lit(w), F.lit(h), F.lit(sx), F.lit(sy))
    tiles = tiling.tile_grid(spark.createDataFrame([(1, lw, lh)], "slide int, level_w int, level_h int")).select(
        "slide", "x", "y", *[c.alias(n) for n, c in box.items()]
    )
    rel = {(r["x"], r["y"]): r["coverage"] for r in tiling.tile_coverage(tiles, cells).collect()}
    dense_in = spark.createDataFrame([(1, bytearray(mask.tobytes()), w, h, sx, sy, lw, lh)], "slide int, mask binary, mask_w int, mask_h int, sx double, sy double, level_w int, level_h int")
    dense = {(r["x"], r["y"]): r["coverage"] for r in tiling.tile_coverage_dense(dense_in).collect()}
    geo = spark.createDataFrame([(1, 0.5, lw, lh, w, h, sx, sy)], "slide int, scale double, level_w int, level_h int, mask_w int, mask_h int, sx double, sy double")
    grid = {(r["x"], r["y"]): r["coverage"] for r in tiling.grid_coverage(geo, cells).collect()}
    want = {}
    for y in range(0, lh - 256 + 1, 224):
        for x in range(0, lw - 256 + 1, 224):
            part = mask[int(y * sy):min(int((y + 256) * sy), h - 1), int(x * sx):min(int((x + 256) * sx), w - 1)]
            want[(x, y)] = part.mean() if part.size else 0.0
    assert rel.keys() == want.keys() == dense.keys() == grid.keys()
    for k in want:
        assert math.isclose(rel[k], want[k], abs_tol=1e-12) and math.isclose(dense[k], want[k], abs_tol=1e-12)
        assert math.isclose(grid[k], want[k], abs_tol=1e-12)


def test_budget_within_and_beyond(spark):
    rows = [("a", 0.5, i, i, float(i % 4)) for i in range(10)] + [("b", 2.0, 100 + i, i, 1.0) for i in range(2)]
    df = spark.createDataFrame(rows, "bag string, scale double, id int, ord int, norm double")
    b = {0.5: 4, 2.0: 3}
    top = budget.topk_l2norm(df, ["bag", "scale"], b, "id", "ord").orderBy("bag", "tile_idx").collect()
    # norm 3: ids 3, 7; norm 2: ids 2, 6; rising norm, ties by id.
    assert [(r["bag"], r["id"]) for r in top] == [("a", 2), ("a", 6), ("a", 3), ("a", 7), ("b", 100), ("b", 101)]
    for parts in (1, 3):
        u = budget.sample_uniform(df.repartition(parts), ["bag", "scale"], b, "id", "ord", 9)
        got = sorted((r["bag"], r["id"], r["tile_idx"]) for r in u.collect())
        assert sum(g[0] == "a" for g in got) == 4 and [g for g in got if g[0] == "b"] == [("b", 100, 0), ("b", 101, 1)]
        if parts == 1:
            first = got
    assert got == first
    # A NULL key is a group like any other; an unlisted scale is an error, not a loss.
    nulls = spark.createDataFrame([(None, 0.5, i, i, 1.0) for i in range(6)], df.schema)
    assert budget.sample_uniform(nulls, ["bag", "scale"], b, "id", "ord", 9).count() == 4
    assert budget.topk_or_uniform(nulls, nulls, ["bag", "scale"], b, "id", "ord", 9).count() == 4
    other = spark.createDataFrame([("c", 1.0, 200, 0, 1.0)], df.schema)
    for run in (lambda: budget.topk_l2norm(other, ["bag", "scale"], b, "id", "ord"), lambda: budget.head_budget(other, ["bag", "scale"], b, "ord")):
        with pytest.raises(Exception, match="no budget for scale 1.0"):
            run().collect()


def test_scan_budget_rounds_up_to_batches(spark):
    df = spark.createDataFrame([("a", 0.5, i, 0) for i in range(50)], "bag string, scale double, x int, y int")
    n = lambda batch: budget.scan_budget(df, ["bag", "scale"], {0.5: 10}, F.lit(True), batch=batch).count()
    assert (n(1), n(4), n(128)) == (10, 12, 50)


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], [0.0, 0.0, 0.0])], "a array<double>, z array<double>")
    r = one(df.select(v.argmax("a"), v.scale_to_sum("z"), v.cosine("a", "z"), v.softmax("a"), v.tail_mass("a", 1), v.expected_index("a")))
    assert r[0] == 1 and r[1] == [0.0, 0.0, 0.0] and r[2] == 0.0 and r[4] == 6.0 and r[5] == 9.0
    assert math.isclose(sum(r[3]), 1.0)


def test_pool_forms_agree(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", F.col("embedding").alias("feat"))
    for f in (pooling.mean_pool, pooling.max_pool):
        a = {r["label"]: (r["n_rows"], r["emb"]) for r in f(e, ["label"]).collect()}
        b = {r["label"]: (r["n_rows"], r["emb"]) for r in f(e, ["label"], method="explode").collect()}
        assert a.keys() == b.keys()
        for k in a:
            assert a[k][0] == b[k][0] and np.allclose(a[k][1], b[k][1], atol=1e-12)


def test_mask_positions_at_least_one(spark):
    df = spark.createDataFrame([("a", 1, [1.0]), *[("b", i, [1.0]) for i in range(2, 12)]], "bag string, id int, feat array<double>")
    out = tokens.mask_positions(df, ["bag"], "id", 1)
    got = {r["bag"]: r["n"] for r in out.where("masked").groupBy("bag").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 1, "b": 2}  # 2.5 rounds to even
    assert {r["feat"][0] for r in out.where("masked").collect()} == {0.0}


def test_pad_bags_with_empty_bag(spark):
    t = spark.createDataFrame([("a", 0.5, 0, [1.0, 2.0]), ("a", 0.5, 1, [3.0, 4.0]), ("a", 2.0, 0, [5.0, 6.0])], "bag string, scale double, i int, feat array<double>")
    bags = spark.createDataFrame([("a", 1), ("e", 1)], "bag string, batch int")
    got = {r["bag"]: r for r in tokens.pad_bags(t, bags, "bag", "batch", "i", 2, {0.5: 1, 2.0: 5}).collect()}
    assert got["a"]["tokens"] == [[1.0, 2.0], [5.0, 6.0]] and got["a"]["pad_mask"] == [False, False]
    assert got["e"]["tokens"] == [[0.0, 0.0], [0.0, 0.0]] and got["e"]["pad_mask"] == [False, True]


def test_auroc_single_class_and_ties(spark):
    rows = [("one", 0.5, 1), ("one", 0.7, 1), ("tie", 0.5, 1), ("tie", 0.5, 0), (None, 0.1, 0), (None, 0.9, 1)]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    got = {r["g"]: (r["auroc"], r["auprc"], r["n"]) for r in metrics.ranking_metrics(df, "s", "y", ["g"]).collect()}
    assert got == {"one": (None, 1.0, 2), "tie": (0.5, 0.5, 2), None: (1.0, 1.0, 2)}


def test_ovr_undefined_when_class_absent(spark):
    df = spark.createDataFrame([(0, [0.6, 0.4, 0.0]), (1, [0.3, 0.7, 0.0])], "y int, p array<double>")
    assert one(metrics.auroc_ovr_macro(df, "p", "y"))[0] is None


def test_kappa(spark):
    def kappa(pairs):
        return one(metrics.qw_kappa(metrics.cells(spark.createDataFrame(pairs, "y int, pred int"))))["kappa"]

    assert kappa([(0, 0), (5, 5)]) == 1.0
    assert kappa([(1, 1), (1, 1)]) is None
    y, p = [0, 1, 2, 2, 4, 4, 0], [0, 2, 2, 1, 4, 0, 1]
    labels = sorted(set(y) | set(p))
    i, j = [labels.index(a) for a in y], [labels.index(a) for a in p]
    o = np.zeros((len(labels),) * 2)
    np.add.at(o, (i, j), 1)
    w = (np.arange(len(labels))[:, None] - np.arange(len(labels))[None]) ** 2
    want = 1 - (w * o).sum() / (w * np.outer(o.sum(1), o.sum(0)) / o.sum()).sum()
    assert math.isclose(kappa(list(zip(y, p))), want, rel_tol=1e-12)


def test_f1_of_never_predicted_class(spark):
    c = metrics.cells(spark.createDataFrame([(0, 0), (1, 0), (2, 2)], "y int, pred int"))
    got = {r["label"]: (r["precision"], r["recall"], r["f1"]) for r in metrics.class_counts(c).collect()}
    assert got[1] == (0.0, 0.0, 0.0) and got[2] == (1.0, 1.0, 1.0)
    assert one(metrics.binary_f1(metrics.cells(spark.createDataFrame([(0, 0)], "y int, pred int"))))[0] == 0.0


def test_class_weights_of_absent_class(spark):
    df = spark.createDataFrame([(0,), (0,), (1,)], "y int")
    got = {r["label"]: r for r in metrics.class_weights(df, "y", 3).collect()}
    inv = 1 / np.clip(np.array([2, 1, 0]) / 3, 1e-6, None)
    assert np.allclose([got[k]["weight"] for k in range(3)], inv / inv.mean())
    assert got[0]["balanced"] == 0.75 and got[2]["balanced"] is None


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 15, 16])
def test_t_tail(spark, n):
    from math import gamma, pi, sqrt

    rng = np.random.default_rng(n)
    a, b = rng.normal(size=n), rng.normal(size=n) + 0.4
    da = spark.createDataFrame([(i, float(x)) for i, x in enumerate(a)], "f int, s double")
    db = spark.createDataFrame([(i, float(x)) for i, x in enumerate(b)], "f int, s double")
    r = one(stats.paired_ttest(da, db, "f", "s", 4))
    d, dof = a - b, n - 1
    t = d.mean() / (d.std(ddof=1) / sqrt(n))
    x = np.linspace(0, abs(t), 200_001)
    pdf = gamma((dof + 1) / 2) / (sqrt(dof * pi) * gamma(dof / 2)) * (1 + x * x / dof) ** (-(dof + 1) / 2)
    p = 1 - 2 * np.trapezoid(pdf, x)
    assert math.isclose(r["t_stat"], t, rel_tol=1e-9) and abs(r["p_value"] - p) < 1e-8
    assert math.isclose(r["p_corrected"], min(1.0, 4 * r["p_value"]))


def test_t_test_rejects_unequal_folds(spark):
    a = spark.createDataFrame([(0, 1.0), (1, 2.0)], "f int, s double")
    with pytest.raises(Exception, match="fold counts"):
        stats.paired_ttest(a, a.where("f = 0"), "f", "s").collect()


def test_loss_trend_edges(spark):
    def trend(losses):
        df = spark.createDataFrame(list(enumerate(losses)), "step int, loss double")
        return one(diagnostics.loss_trend(df))["rel_improvement"]

    assert trend([4.0, 2.0, 1.0]) is None
    assert trend([None] * 5) is None
    assert trend([0.0] * 3 + [1.0] * 3) is None
    xs = [8.0, None, 7.0, 6.0, 5.0, 4.0, None, 3.0, 2.0, 1.0, 1.0, 0.5]
    assert math.isclose(trend(xs), (7.0 - 1.0) / 7.0)


def test_gate_levels(spark):
    counts = spark.createDataFrame([(16000,)], "n_both bigint")
    trend = spark.createDataFrame([(None,)], "rel_improvement double")
    files = spark.createDataFrame([(True,), (False,)], "load_ok boolean")
    got = [(r["name"][:2], r["status"]) for r in diagnostics.gates(counts, trend, files).collect()]
    assert got == [("G1", "WARN"), ("G2", "WARN"), ("G4", "WARN")]
    none = diagnostics.gates(counts, trend, files.where("false")).collect()[2]
    assert (none["status"], none["detail"]) == ("FAIL", "none found")


def test_fill_center_needs_enough_gaps(spark):
    labels = spark.createDataFrame([(i, "patient_1", 3) for i in range(19)] + [(19, "patient_2", None)], "row_no int, patient string, center int")
    paths = spark.createDataFrame([("/x/center_7/patient_2_node_1.tif",)], "path string")
    few = {r["row_no"]: r["center"] for r in joins.fill_center(labels, paths, ["row_no"]).collect()}
    assert few[19] == -1
    many = {r["row_no"]: r["center"] for r in joins.fill_center(labels.where("row_no > 15"), paths, ["row_no"]).collect()}
    assert many[19] == 7 and many[18] == 3


def test_label_vectors_last_row_wins(spark):
    vec = spark.createDataFrame([(1, "p"), (2, "q")], "id int, patient string")
    lab = spark.createDataFrame([(0, "p", 1), (1, "p", 2), (0, "q", -1)], "ord int, patient string, y int")
    assert [(r["id"], r["y"]) for r in joins.label_vectors(vec, lab, "y", "ord", ["id"]).collect()] == [(1, 2)]


def test_fold_invariants(spark):
    # A third of the rows share one group; another third share one class.
    rows = [(i, "big" if i % 3 == 0 else f"g{i % 37}", 0 if i % 3 else i % 5) for i in range(1500)]
    df = spark.createDataFrame(rows, "id int, site string, y int")
    k = folds.kfold_stratified(df, "y", "id")
    sizes = {}
    for r in k.groupBy("y", "fold").count().collect():
        sizes.setdefault(r["y"], []).append(r["count"])
    assert k.count() == len(rows) and all(len(s) == 5 and max(s) - min(s) <= 1 for s in sizes.values())
    # Rows without a site are one group.
    rows += [(2000 + i, None, i % 3) for i in range(7)]
    df = spark.createDataFrame(rows, "id int, site string, y int")
    g = folds.kfold_stratified_group(df, "y", "site", ["id"])
    assert g.count() == len(rows)
    assert g.groupBy("site").agg(F.countDistinct("fold").alias("n"), F.count_if(F.col("fold").isNull()).alias("m")).where("n != 1 or m > 0").count() == 0
    assert folds.kfold_stratified_group(df, "y", "site", ["id"]).select("fold").distinct().count() == 5


def test_unknown_center_always_trains(spark):
    df = spark.createDataFrame([(0, 1), (1, 2), (2, -1)], "id int, center int")
    roles = joins.fold_roles(df, joins.fold_ids(df, "center"), F.col("center"))
    assert sorted((r["id"], r["eval_fold"], r["role"]) for r in roles.collect()) == [
        (0, 1, "test"), (0, 2, "train"), (1, 1, "train"), (1, 2, "test"), (2, 1, "train"), (2, 2, "train"),
    ]
    with pytest.raises(Exception, match="too many folds"):
        joins.fold_roles(df, joins.fold_ids(df, "center", limit=1), F.col("center")).collect()


def test_standardize_constant_column(spark):
    df = spark.createDataFrame([(i, i % 2, [1.0, float(i)]) for i in range(6)] + [(9, None, [1.0, 50.0])], "id int, fold int, feat array<double>")
    got = {(r["fold"], r["dim"]): (r["mean"], r["std"]) for r in folds.fold_stats(df, "fold", [], "feat").collect()}
    assert got[(0, 0)] == (1.0, 1.0)
    x = np.array([1, 3, 5, 50.0])
    assert np.allclose(got[(0, 1)], (x.mean(), x.std()))


def test_bootstrap_methods_agree(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(y), int(y if rng.random() < 0.7 else rng.integers(3)), float(np.round(y + rng.normal(), 1))) for i, y in enumerate(rng.integers(0, 3, 400))]
    df = spark.createDataFrame(rows, "id int, y int, pred int, s double")
    acc = float(np.mean([r[1] == r[2] for r in rows]))
    for m in ("draws", "multinomial"):
        ci = one(bootstrap.bootstrap_accuracy(df, 400, 1, method=m))
        assert ci["n_replicates"] == 400 and ci["ci_lo"] < acc < ci["ci_hi"]
        sd = math.sqrt(acc * (1 - acc) / len(rows))
        assert abs((ci["ci_hi"] - ci["ci_lo"]) - 3.92 * sd) < 0.8 * sd
    hit = df.withColumn("hit", (F.col("y") > 0).cast("int"))
    auc = one(metrics.ranking_metrics(hit, "s", "hit"))["auroc"]
    cis = [one(bootstrap.bootstrap_auroc(hit, "id", "s", "hit", 400, 1, method=m)) for m in ("draws", "blocks")]
    for ci in cis:
        assert ci["ci_lo"] < auc < ci["ci_hi"] and ci["n_replicates"] == 400
    assert abs(cis[0]["ci_lo"] - cis[1]["ci_lo"]) < 0.015 and abs(cis[0]["ci_hi"] - cis[1]["ci_hi"]) < 0.015


def test_all_white_image_and_flat_image():
    white = np.full((8, 8, 3), 250, dtype=np.uint8)
    m = raster.image_metrics(white)
    assert (m["tissue_pct"], m["white_pct"], m["blur_var"], m["brightness_mean"], m["saturation_mean"]) == (0.0, 1.0, 0.0, 250.0, 0.0)
    stripes = np.zeros((6, 6, 3), dtype=np.uint8)
    stripes[::2] = (200, 40, 40)
    lap = raster.laplacian(np.arange(12.0).reshape(3, 4))
    assert lap[1, 1] == 0.0 and lap[0, 0] == 2 * 1 + 2 * 4
    assert raster.image_metrics(stripes)["tissue_pct"] == 0.5


def test_bad_image_keeps_its_row(spark):
    df = spark.createDataFrame([(1, 2, 2, bytearray(12)), (2, 2, 2, bytearray(5))], "k int, width int, height int, data binary")
    got = {r["k"]: r for r in raster.raster_qc(df, "k").collect()}
    assert got[1]["error"] is None and got[2]["error"] is not None and got[2]["tissue_pct"] is None
