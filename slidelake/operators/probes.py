"""Linear probes on vectors, fitted by MLlib per evaluation fold."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidelake.functions.vectors import argmax, dot
from slidelake.operators.folds import fold_scaling
from slidelake.operators.gram import Grams, ridge_grams, ridge_predictions
from slidelake.operators.metrics import cells, qw_kappa
from slidelake.session import materialize

MODELS = ("ordinal", "logreg_l2", "logreg_l1", "ridge")
# A threshold weight is divided by this, which leaves it practically unpenalised.
THRESHOLD_SCALE = 1000.0


MAX_CLASSES = 10_000


def _class_table(train: DataFrame, y: str) -> list[tuple[int, int]]:
    """(class, rows) of the training set; as many rows as there are classes."""
    counts = train.groupBy(F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    return sorted((r["y"], r["n"]) for r in counts)


def _balanced(y: str, table: list[tuple[int, int]]) -> Column:
    n, k = sum(c for _, c in table), len(table)
    out = F.lit(1.0)
    for label, count in table:
        out = F.when(F.col(y) == label, F.lit(n / (k * count))).otherwise(out)
    return out


def _vec(feat: str) -> Column:
    return array_to_vector(F.col(feat))


def _fit_logreg(train, test, y, feat, c, l1, balanced, max_iter, family="auto"):
    """``auto`` fits two classes as a binomial model; ``multinomial`` penalises both classes' weights there."""
    table = _class_table(train, y)
    n = sum(k for _, k in table)
    labels = F.array(*[F.lit(label) for label, _ in table])
    code = (F.array_position(labels, F.col(y)) - 1).cast("double")
    weight = _balanced(y, table) if balanced else F.lit(1.0)
    model = LogisticRegression(
        family=family, featuresCol="__x", labelCol="__y", weightCol="__w", regParam=1.0 / (c * n),
        elasticNetParam=1.0 if l1 else 0.0, standardization=False, maxIter=max_iter, tol=1e-8,
        probabilityCol="__p", predictionCol="__c", rawPredictionCol="__raw",
    ).fit(train.select(_vec(feat).alias("__x"), code.alias("__y"), weight.alias("__w")))
    scored = model.transform(test.withColumn("__x", _vec(feat)))
    return scored.withColumn("probs", vector_to_array("__p")).withColumn(
        "pred", F.element_at(labels, F.col("__c").cast("int") + 1)
    ).drop("__x", "__p", "__c", "__raw")


def _fit_ridge(train, test, y, feat, c, balanced):
    table = _class_table(train, y)
    alpha, n = 1.0 / max(c, 1e-6), sum(k for _, k in table)
    weight = _balanced(y, table) if balanced else F.lit(1.0)
    base = train.select(_vec(feat).alias("__x"), F.col(y).alias("__y"), weight.alias("__w"))
    # With two classes one regression decides; its mirror image is implied.
    targets = table if len(table) > 2 else table[1:]

    def score(label: int) -> Column:
        m = LinearRegression(
            featuresCol="__x", labelCol="__t", weightCol="__w", regParam=alpha / n, elasticNetParam=0.0,
            standardization=False, solver="normal",
        ).fit(base.withColumn("__t", F.when(F.col("__y") == label, 1.0).otherwise(-1.0)))
        coef = F.array(*[F.lit(float(v)) for v in m.coefficients])
        return dot(feat, coef) + F.lit(float(m.intercept))

    scores = [score(label) for label, _ in targets]
    if len(table) == 2:
        scores = [-scores[0], scores[0]]
    labels = F.array(*[F.lit(label) for label, _ in table])
    return test.withColumn("__s", F.array(*scores)).withColumn(
        "pred", F.element_at(labels, argmax("__s") + 1)
    ).drop("__s")


def _fit_ordinal(train, test, y, feat, c, max_iter):
    table = _class_table(train, y)
    alpha, n = 1.0 / max(c, 1e-6), sum(k for _, k in table)
    steps = len(table) - 1
    labels = F.array(*[F.lit(label) for label, _ in table])
    rank = (F.array_position(labels, F.col(y)) - 1).cast("int")
    cuts = F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))
    rows = train.select(F.col(feat).alias("__f"), rank.alias("__r"), cuts.alias("__k"))
    onehot = F.transform(
        F.sequence(F.lit(0), F.lit(steps - 1)),
        lambda i: F.when(i == F.col("__k"), F.lit(THRESHOLD_SCALE)).otherwise(F.lit(0.0)),
    )
    design = rows.select(
        array_to_vector(F.concat("__f", onehot)).alias("__x"), (F.col("__r") > F.col("__k")).cast("double").alias("__y")
    )
    model = LogisticRegression(
        family="binomial", featuresCol="__x", labelCol="__y", fitIntercept=False, standardization=False,
        regParam=alpha / (n * steps), elasticNetParam=0.0, maxIter=max_iter, tol=1e-9,
    ).fit(design)
    w = [float(v) for v in model.coefficients]
    split = len(w) - steps
    line = dot(feat, F.array(*[F.lit(v) for v in w[:split]]))
    passed = [F.when(line + F.lit(v * THRESHOLD_SCALE) > 0, 1).otherwise(0) for v in w[split:]]
    step = passed[0]
    for p in passed[1:]:
        step = step + p
    return test.withColumn("pred", F.element_at(labels, step + 1))


def fit_predict(
    train: DataFrame, test: DataFrame, model: str, c: float, y: str = "y", feat: str = "feat", max_iter: int = 200, balanced: bool = True,
    family: str = "auto",
) -> DataFrame:
    """Fit one probe on scaled training rows and add ``pred`` to the test rows."""
    if model in ("logreg_l2", "logreg_l1"):
        return _fit_logreg(train, test, y, feat, c, model == "logreg_l1", balanced, max_iter, family)
    if model == "ridge":
        return _fit_ridge(train, test, y, feat, c, balanced)
    if model == "ordinal":
        return _fit_ordinal(train, test, y, feat, c, max_iter)
    raise ValueError(f"unknown model: {model}")


def _scale(df: DataFrame, stats: list[tuple[float, float]], feat: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(s).alias("s")) for m, s in stats])
    return df.withColumn(feat, F.zip_with(F.col(feat).cast("array<double>"), pairs, lambda v, p: (v - p["m"]) / p["s"]))


def _fold_table(df: DataFrame, fold: str, feat: str) -> dict[int, list[tuple[float, float]]]:
    """Scaling constants per fold: folds times dimensions numbers."""
    return {r["fold"]: list(zip(r["mean"], r["std"])) for r in fold_scaling(df, fold, [], feat).collect()}


def cross_validate(
    df: DataFrame, model: str, c: float, fold: str = "fold", y: str = "y", feat: str = "feat",
    max_iter: int = 200, balanced: bool = True, parallelism: int = 8, scaling: dict | None = None, grams: Grams | None = None,
    scaled: dict[int, DataFrame] | None = None,
) -> DataFrame:
    """Out-of-fold predictions of every row that has a fold.

    Rows with a NULL fold only train.  ``df`` should be cheap to scan repeatedly
    (a table, or a materialised step).  Ridge probes of all folds are solved from
    one pass over the rows, or from its ``grams`` where a caller has them; ``scaled``
    has ``df`` in the scale of each fold, where a caller fits many settings.
    """
    scaling = scaling or _fold_table(df, fold, feat)
    if not scaling:
        raise ValueError("no fold leaves rows to train on")
    if model == "ridge":
        return ridge_predictions(df, grams or ridge_grams(df, scaling, fold, y, feat, balanced), c, fold, y, feat)

    def one(f: int) -> DataFrame:
        rows = scaled[f] if scaled else _scale(df, scaling[f], feat)
        train = rows.where(F.col(fold).isNull() | (F.col(fold) != f))
        test = rows.where(F.col(fold) == f)
        return fit_predict(train, test, model, c, y, feat, max_iter, balanced)

    with ThreadPool(min(parallelism, len(scaling))) as pool:
        parts = pool.map(one, sorted(scaling))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop(feat)


def grid_predictions(
    df: DataFrame, models: Sequence[str] = MODELS, cs: Sequence[float] = (0.1, 0.3, 1.0, 3.0, 10.0), fold: str = "fold",
    y: str = "y", feat: str = "feat", max_iter: int = 200, parallelism: int = 8, keep: Sequence[str] = (),
) -> DataFrame:
    """Out-of-fold predictions of every setting: model, c, fold, y, pred and the columns in ``keep``.

    ``parallelism`` settings are fitted at a time, each with its folds one after the other, so that the tasks of many
    fits share the executors and none waits for the slowest fold of another.
    """
    scaling = _fold_table(df, fold, feat)
    grams = ridge_grams(df, scaling, fold, y, feat) if "ridge" in models and scaling else None

    scaled = {f: _scale(df, s, feat) for f, s in scaling.items()}

    def one(setting: tuple[str, float]) -> DataFrame:
        m, c = setting
        oof = cross_validate(df, m, c, fold, y, feat, max_iter, True, 1, scaling, grams=grams, scaled=scaled)
        return oof.select(F.lit(m).alias("model"), F.lit(float(c)).alias("c"), fold, F.col(y).alias("y"), "pred", *keep)

    settings = [(m, c) for m in models for c in cs]
    with ThreadPool(max(1, min(parallelism, len(settings)))) as pool:
        parts = pool.map(one, settings, chunksize=1)
    runs = None
    for part in parts:
        runs = part if runs is None else runs.unionByName(part)
    return runs


def grid_table(runs: DataFrame, fold: str = "fold", prefix: str = "FOLD") -> DataFrame:
    """Mean fold kappa per (model, C) of ``grid_predictions``, with the folds spelled out, best first."""
    keys = ["model", "c", fold]
    # Settings times folds times class pairs; written, as the predictions of all settings are computed for each use of them.
    counted = materialize(cells(runs, keys), "grid-cells")
    per_fold = qw_kappa(counted, keys).join(counted.groupBy(*keys).agg(F.sum("n").alias("n")), keys)
    text = F.format_string("%s%s:n=%d|k=%.3f", F.lit(prefix), F.col(fold).cast("string"), "n", "kappa")
    lines = F.array_sort(F.collect_list(F.struct(F.col(fold).alias("f"), text.alias("t"))))
    return (
        per_fold.groupBy("model", "c")
        .agg(
            F.avg("kappa").alias("kappa_mean"),
            F.count(F.lit(1)).alias("folds"),
            F.concat_ws("; ", F.transform(lines, lambda e: e["t"])).alias("detail"),
        )
        .orderBy(F.col("kappa_mean").desc_nulls_last(), "model", "c")
    )


def grid_search(
    df: DataFrame, models: Sequence[str] = MODELS, cs: Sequence[float] = (0.1, 0.3, 1.0, 3.0, 10.0), fold: str = "fold",
    y: str = "y", feat: str = "feat", prefix: str = "FOLD", max_iter: int = 200, parallelism: int = 8,
) -> DataFrame:
    """Mean fold kappa per (model, C), with the folds spelled out, best first."""
    return grid_table(grid_predictions(df, models, cs, fold, y, feat, max_iter, parallelism), fold, prefix)


def best_config(grid: DataFrame) -> DataFrame:
    return grid.orderBy(F.col("kappa_mean").desc_nulls_last(), "model", "c").limit(1)
