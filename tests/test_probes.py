"""Probes against numpy solutions of the same objectives."""

import numpy as np
import pytest

from slidelake.operators.folds import fold_stats
from slidelake.operators.probes import best_config, cross_validate, fit_predict, grid_search


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(240, 3))
    y = np.digitize(x @ [1.0, -0.6, 0.3] + 0.6 * rng.normal(size=240), [-0.8, 0.2, 1.0])
    rows = [(i, int(y[i]), int(i % 4), [float(v) for v in x[i]]) for i in range(len(y))]
    return x, y, spark.createDataFrame(rows, "id int, y int, fold int, feat array<double>").cache()


def preds(df):
    return np.array([r["pred"] for r in df.orderBy("id").collect()])


def minimize(f, w, steps=4000):
    """Gradient descent with backtracking; the test objectives are smooth and convex."""
    val, g = f(w)
    rate = 1.0
    for _ in range(steps):
        while True:
            nxt = w - rate * g
            nv, ng = f(nxt)
            if nv <= val - 0.5 * rate * (g * g).sum() or rate < 1e-14:
                break
            rate /= 2
        w, val, g, rate = nxt, nv, ng, rate * 2
        if np.abs(g).max() < 1e-8:
            break
    return w


def test_multinomial_l2(data):
    x, y, df = data
    k, c, n = 4, 0.3, len(y)
    onehot = np.eye(k)[y]
    sw = (n / (k * onehot.sum(0)))[y]

    def f(w):
        z = x @ w[:3] + w[3]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = sw[:, None] * (p - onehot) / n
        val = -(sw * np.log(p[np.arange(n), y])).sum() / n + (w[:3] ** 2).sum() / (2 * c * n)
        return val, np.vstack([x.T @ d + w[:3] / (c * n), d.sum(0, keepdims=True)])

    w = minimize(f, np.zeros((4, k)))
    z = x @ w[:3] + w[3]
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    out = fit_predict(df, df, "logreg_l2", c).orderBy("id").collect()
    assert np.abs(np.array([list(r["probs"]) for r in out]) - p).max() < 1e-3
    assert (np.array([r["pred"] for r in out]) == p.argmax(1)).mean() > 0.99


def test_ridge(data):
    x, y, df = data
    c, k = 0.3, 4
    sw = (len(y) / (k * np.bincount(y)))[y]
    a = np.hstack([x, np.ones((len(y), 1))])
    pen = np.diag([1 / c] * 3 + [0])
    w = np.linalg.solve(a.T @ (sw[:, None] * a) + pen, a.T @ (sw[:, None] * (2 * np.eye(k)[y] - 1)))
    assert (preds(fit_predict(df, df, "ridge", c)) == (a @ w).argmax(1)).mean() > 0.99


def test_ordinal(data):
    x, y, df = data
    c, steps = 0.3, 3
    above = (y[:, None] > np.arange(steps)).astype(float)

    def f(w):
        z = (x @ w[:3])[:, None] + w[3:]
        val = np.logaddexp(0, z).sum() - (above * z).sum() + (w[:3] ** 2).sum() / (2 * c)
        d = 1 / (1 + np.exp(-z)) - above
        return val, np.concatenate([x.T @ d.sum(1) + w[:3] / c, d.sum(0)])

    w = minimize(f, np.zeros(6))
    want = ((x @ w[:3])[:, None] + w[3:] > 0).sum(1)
    assert (preds(fit_predict(df, df, "ordinal", c)) == want).mean() > 0.98


def test_l1_shrinks_to_the_majority(data):
    _, _, df = data
    assert len(set(preds(fit_predict(df, df, "logreg_l1", 1e-4)))) == 1


def test_cross_validation_tests_each_row_once(data):
    x, y, df = data
    out = cross_validate(df, "ridge", 1.0)
    assert sorted(r["id"] for r in out.collect()) == list(range(len(y)))
    acc = np.mean([r["pred"] == r["y"] for r in out.collect()])
    assert acc > 0.5
    assert fold_stats(df, "fold", [], "feat").count() == 12


def test_grid(data):
    _, _, df = data
    g = grid_search(df, ("ridge",), (0.1, 1.0), prefix="CEN")
    rows = g.collect()
    assert len(rows) == 2 and rows[0]["kappa_mean"] >= rows[1]["kappa_mean"]
    assert rows[0]["folds"] == 4 and rows[0]["detail"].startswith("CEN0:n=60|k=")
    assert best_config(g).collect()[0]["c"] == rows[0]["c"]


def test_unknown_model(data):
    with pytest.raises(ValueError):
        fit_predict(data[2], data[2], "svm", 1.0)


def test_binomial_l2_for_two_classes(data, spark):
    """Two classes are one binomial model; the multinomial form halves the penalty and is asked for by name."""
    x, y, df = data
    two = (y > 1).astype(int)
    rows = [(i, int(two[i]), [float(v) for v in x[i]]) for i in range(len(y))]
    table = spark.createDataFrame(rows, "id int, y int, feat array<double>").cache()
    c, n = 0.1, len(y)
    sw = (n / (2 * np.bincount(two)))[two]

    def f(w):
        p = 1 / (1 + np.exp(-(x @ w[:3] + w[3])))
        val = -(sw * np.log(np.where(two == 1, p, 1 - p))).sum() / n + (w[:3] ** 2).sum() / (2 * c * n)
        d = sw * (p - two) / n
        return val, np.append(x.T @ d + w[:3] / (c * n), d.sum())

    w = minimize(f, np.zeros(4))
    p = 1 / (1 + np.exp(-(x @ w[:3] + w[3])))
    out = fit_predict(table, table, "logreg_l2", c).orderBy("id").collect()
    assert np.abs(np.array([r["probs"][1] for r in out]) - p).max() < 1e-3
    other = fit_predict(table, table, "logreg_l2", c, family="multinomial").orderBy("id").collect()
    assert np.abs(np.array([r["probs"][1] for r in other]) - p).max() > 1e-3


def test_registered_searches_are_whole(spark, sf_dir, monkeypatch):
    """All settings of the grid; all seeds and parts of the evaluation. The fits are replaced by the labels."""
    from pyspark.sql import functions as F

    import __spark_entry__ as entry
    from slidelake.operators import probes
    from slidelake.plans import evaluation

    asked = []

    def fit(df, model, c, *args, max_iter=200, **kwargs):
        asked.append((model, c, args[3] if len(args) > 3 else max_iter))
        return df.drop("feat").withColumn("pred", F.col("y"))

    monkeypatch.setattr(probes, "cross_validate", fit)
    monkeypatch.setattr(evaluation, "cross_validate", fit)
    assert entry.queries()["grid_search"](spark, sf_dir).count() == 20
    assert sorted(asked) == sorted((m, c, 200) for m in probes.MODELS for c in (0.1, 0.3, 1.0, 3.0, 10.0))
    asked.clear()
    rows = entry.queries()["patient_evaluation"](spark, sf_dir).collect()
    assert asked == [("logreg_l2", 1.0, 200)] * 3
    assert {r["seed"] for r in rows if r["part"] == "folds"} == {42, 123, 456}
    assert {r["part"] for r in rows} == {"folds", "summary", "interval", "classes", "confusion"}


def test_predictions_of_a_grid_are_computed_once(spark):
    """The table of a grid uses the cells several times; the predictions behind them are not in its plan any more."""
    from pyspark.sql import functions as F

    from slidelake.operators.probes import grid_table

    rows = [("ridge", 1.0, i % 2, i % 3, i) for i in range(30)]
    runs = spark.createDataFrame(rows, "model string, c double, fold int, y int, id int").withColumn("pred", F.udf(lambda i: i % 5 % 3, "int")("id"))
    table = grid_table(runs)
    assert "EvalPython" not in table._jdf.queryExecution().executedPlan().toString()
    assert table.first()["folds"] == 2
