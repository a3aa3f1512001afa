"""Ridge fits from fold products against a solution for each fold and C of its own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidelake.operators import gram
from slidelake.operators.probes import _fold_table, _scale, cross_validate, fit_predict

OFFSET = 1e6
CS = (0.1, 0.3, 1.0, 3.0, 10.0)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(8)
    x = r.normal(size=(300, 6)) * [1, 2, 3, 1, 1, 5] + OFFSET
    y = np.digitize((x - OFFSET) @ [1.0, -0.6, 0.3, 0, 0, 0.1] + r.normal(size=300), [-2.0, 0.2, 2.0])
    fold = [int(i % 5) if i % 7 else None for i in range(300)]
    return x, y, fold


@pytest.fixture(scope="module")
def table(spark, rows):
    x, y, fold = rows
    data = [(i, f"k{y[i]}", fold[i], x[i].tolist()) for i in range(len(y))]
    data += [(1000, "k1", 2, None), (1001, None, 3, x[0].tolist())]
    return spark.createDataFrame(data, "id int, y string, fold int, feat array<double>").repartition(5).cache()


def expected(x, y, c, balanced=True):
    """Scaled ridge on +-1 targets by least squares of stacked rows."""
    mean, std = x.mean(0), x.std(0)
    z, labels = (x - mean) / std, sorted(set(y))
    w = np.array([len(y) / (len(labels) * (y == k).sum()) if balanced else 1.0 for k in y])
    out = []
    for k in labels:
        t = np.where(y == k, 1.0, -1.0)
        zc, tc = z - (w @ z) / w.sum(), t - (w @ t) / w.sum()
        a = np.vstack([zc * np.sqrt(w)[:, None], np.eye(x.shape[1]) / np.sqrt(c)])
        fit = np.linalg.lstsq(a, np.append(tc * np.sqrt(w), np.zeros(x.shape[1])), rcond=None)[0] / std
        out.append((fit, (w @ t) / w.sum() - fit @ ((w @ x) / w.sum())))
    return labels, np.array([f for f, _ in out]), np.array([b for _, b in out])


@pytest.mark.parametrize("balanced", [True, False])
def test_all_folds_and_cs_equal_fits_of_their_own(table, rows, balanced, monkeypatch):
    monkeypatch.setattr(gram, "ROW_CELLS", 15)  # several blocks a matrix
    x, y, fold = rows
    used = table.where("y is not null")
    g = gram.ridge_grams(used, _fold_table(used, "fold", "feat"), balanced=balanced)
    models = gram.ridge_models(g, CS)
    assert len(models) == 25
    for (f, c), (labels, w, b) in models.items():
        train = np.array([k != f for k in fold])
        want_labels, want, level = expected(x[train], y[train], c, balanced)
        assert labels == [f"k{v}" for v in want_labels]
        assert np.abs(w - want).max() < 1e-6
        assert np.abs((b - w @ g.pivot) - level).max() / OFFSET < 1e-6
        scores = (x - g.pivot) @ w.T + b
        assert np.abs(scores - ((x - OFFSET) @ want.T + (level + want @ np.full(x.shape[1], OFFSET)))).max() < 1e-6


def test_flushed_sums_are_the_same(table, rows):
    x, y, fold = rows
    used = table.where("y is not null")
    read = lambda d: {(r.fold, r.y, r.block): np.array(r.sums) for r in d.collect()}
    pivot = [OFFSET] * 6
    whole, flushed = read(gram.fold_grams(used, "fold", "y", "feat", pivot)), read(gram.fold_grams(used, "fold", "y", "feat", pivot, 1))
    assert whole.keys() == flushed.keys() and len(whole) == 24
    assert all(np.allclose(whole[k], flushed[k], rtol=1e-12) for k in whole)
    own = np.array([k is None for k in fold]) & (y == 1)
    assert whole[None, "k1", 0][-1] == own.sum()


def test_cross_validation_is_the_fit_of_each_fold(table, rows):
    used = table.where("y is not null and feat is not null")
    scaling = _fold_table(used, "fold", "feat")
    got = {r.id: r.pred for r in cross_validate(used, "ridge", 0.3).collect()}
    assert len(got) == sum(f is not None for f in rows[2])
    for f in (0, 3):
        scaled = _scale(used, scaling[f], "feat")
        each = fit_predict(scaled.where(F.col("fold").isNull() | (F.col("fold") != f)), scaled.where(F.col("fold") == f), "ridge", 0.3)
        assert all(got[r.id] == r.pred for r in each.collect())


def test_odd_rows(spark, table):
    odd = table.withColumn("pred", F.lit("x")).withColumn("c", F.lit(7))
    out = {r.id: r for r in cross_validate(odd, "ridge", 1.0).collect()}
    assert out[1000].pred is None and out[1001].pred is not None and out[1000].c == 7
    one = spark.createDataFrame([(1, 5, 0, [1.0]), (2, 5, 0, [2.0])], "id int, y int, fold int, feat array<double>")
    with pytest.raises(ValueError, match="no fold"):
        cross_validate(one, "ridge", 1.0)
    with pytest.raises(Exception, match="another length"):
        wrong = table.limit(3).unionByName(spark.createDataFrame([(9, "k1", 1, [1.0])], table.schema))
        gram.fold_grams(wrong, "fold", "y", "feat", [0.0] * 6).collect()
