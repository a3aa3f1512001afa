"""Classification metrics as grouped aggregations.

Count-based metrics reduce the rows to (group, truth, prediction) cells first.
Rank metrics reduce them to (group, score) counts and take running sums over
range-partitioned slabs.  ``keys`` gives one result per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slidelake.functions.vectors import argmax, expected_index, let, scale_to_sum, softmax, tail_mass, total
from slidelake.operators.ranking import running_sums


def with_probabilities(df: DataFrame, logits: str, probs: str = "probs", pred: str = "pred") -> DataFrame:
    """Softmax probabilities and the first most likely class."""
    return df.withColumn(probs, softmax(logits)).withColumn(pred, argmax(probs))


def _agg(df: DataFrame, keys: Sequence[str], *exprs: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*exprs) if keys else df.agg(*exprs)


def cells(df: DataFrame, keys: Sequence[str] = (), y: str = "y", pred: str = "pred") -> DataFrame:
    """Row counts per (group, truth, prediction)."""
    return df.groupBy(*keys, F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, keys: Sequence[str] = (), y: str = "y", pred: str = "pred") -> DataFrame:
    return _agg(df, keys, F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"))


def balanced_accuracy(c: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean recall over the classes that occur in the truth; takes cells."""
    recall = F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")
    per_class = c.groupBy(*keys, "y").agg(recall.alias("recall"))
    return _agg(per_class, keys, F.avg("recall").alias("balanced_accuracy"))


def class_counts(c: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per class of truth or prediction: tp, support, predicted, P, R, F1."""
    hit = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)
    roles = F.array(
        F.struct(F.col("y").alias("label"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")),
    )
    r = c.select(*keys, F.explode(roles).alias("r"))
    sums = r.groupBy(*keys, F.col("r.label").alias("label")).agg(
        F.sum("r.tp").alias("tp"), F.sum("r.support").alias("support"), F.sum("r.predicted").alias("predicted")
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b == 0, F.lit(0.0)).otherwise(a / b)

    return sums.withColumns(
        {
            "precision": ratio(F.col("tp"), F.col("predicted")),
            "recall": ratio(F.col("tp"), F.col("support")),
            "f1": ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")),
        }
    )


def macro_f1(c: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean F1 over all classes of truth and prediction; takes cells."""
    return _agg(class_counts(c, keys), keys, F.avg("f1").alias("macro_f1"))


def binary_f1(c: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """F1 of class 1; takes cells of 0/1 labels."""
    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    tp = total((F.col("y") == 1) & (F.col("pred") == 1))
    both = total(F.col("y") == 1) + total(F.col("pred") == 1)
    return _agg(c, keys, F.when(both == 0, F.lit(0.0)).otherwise(2 * tp / both).alias("binary_f1"))


def confusion_matrix(c: DataFrame, max_classes: int = 10_000) -> DataFrame:
    """All (y, pred) pairs of the occurring classes, zeros included; takes cells.

    The cells are at most classes squared.  More than ``max_classes`` classes
    raise, as the matrix itself would not be usable.
    """
    labels = c.select(F.explode(F.array("y", "pred")).alias("label")).distinct().limit(max_classes + 1)
    ids = F.when(F.count(F.lit(1)) <= max_classes, F.array_sort(F.collect_list("label"))).otherwise(
        F.raise_error(F.lit("too many classes"))
    )
    spine = labels.agg(ids.alias("ls")).select(F.explode("ls").alias("y"), "ls")
    spine = spine.select("y", F.explode("ls").alias("pred"))
    return spine.join(c, ["y", "pred"], "left").select("y", "pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def classification_report(c: DataFrame) -> DataFrame:
    """Rows per class, then accuracy, macro average and weighted average; takes cells."""
    per_class = class_counts(c)
    rows = per_class.select(
        F.col("label").cast("string").alias("label"), "precision", "recall", F.col("f1").alias("f1_score"),
        F.col("support").cast("double").alias("support"),
    )
    n = F.sum("support")
    acc = F.sum("tp") / n
    total = per_class.agg(
        acc.alias("acc"),
        *[F.avg(m).alias(f"m_{m}") for m in ("precision", "recall", "f1")],
        *[(F.sum(F.col(m) * F.col("support")) / n).alias(f"w_{m}") for m in ("precision", "recall", "f1")],
        n.cast("double").alias("n"),
    )

    def line(name: str, p: str, r: str, f: str, s: str):
        return F.struct(
            F.lit(name).alias("label"), F.col(p).alias("precision"), F.col(r).alias("recall"),
            F.col(f).alias("f1_score"), F.col(s).alias("support"),
        )

    summary = total.select(
        F.explode(
            F.array(
                line("accuracy", "acc", "acc", "acc", "acc"),
                line("macro avg", "m_precision", "m_recall", "m_f1", "n"),
                line("weighted avg", "w_precision", "w_recall", "w_f1", "n"),
            )
        ).alias("s")
    ).select("s.*")
    return rows.unionByName(summary)


def qw_kappa(c: DataFrame, keys: Sequence[str] = (), name: str = "kappa", max_cells: int = 1_000_000) -> DataFrame:
    """Quadratic weighted kappa; takes cells.

    Classes count by their rank among the classes of the group.  As the weights
    are squared rank differences, the expected disagreement follows from first
    and second moments and no table of class pairs is formed.  NULL if undefined.
    A group's cells are one row, so more than ``max_cells`` of them are an error,
    raised before more than these are gathered.
    """
    nth = F.row_number().over(W.partitionBy(*(keys or [F.lit(0)])).orderBy("y", "pred"))
    too_many = F.raise_error(F.lit(f"more than {max_cells} cells in a group: too many classes for kappa")).cast("bigint")
    counted = c.withColumn("__nth", nth).withColumn("n", F.when(F.col("__nth") <= max_cells, F.col("n")).otherwise(too_many))
    packed = _agg(counted, keys, F.collect_list(F.struct("y", "pred", "n")).alias("__c"))
    labels = F.array_sort(
        F.array_union(F.transform("__c", lambda e: e["y"]), F.transform("__c", lambda e: e["pred"]))
    )
    coded = let(
        labels,
        lambda ls: F.transform(
            F.col("__c"),
            lambda e: F.struct(
                F.array_position(ls, e["y"]).cast("double").alias("i"),
                F.array_position(ls, e["pred"]).cast("double").alias("j"),
                e["n"].cast("double").alias("n"),
            ),
        ),
    )

    def kappa(r: Column) -> Column:
        def moment(f) -> Column:
            return F.aggregate(r, F.lit(0.0), lambda a, e: a + e["n"] * f(e["i"], e["j"]))

        observed = moment(lambda i, j: (i - j) * (i - j))
        n = moment(lambda i, j: F.lit(1.0))
        expected = moment(lambda i, j: i * i + j * j) - 2.0 * moment(lambda i, j: i) * moment(lambda i, j: j) / n
        return 1.0 - observed / F.when(F.abs(expected) > 1e-9, expected)

    return packed.select(*keys, let(coded, kappa).alias(name))


def ranking_metrics(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Tie-aware AUROC and average precision of a 0/1 label, with counts.

    Rows are reduced to distinct scores before anything is ordered.  A group
    with one class only gets NULL.
    """
    pos = F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos")
    neg = F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg")
    counts = df.groupBy(*keys, F.col(score).alias("__score")).agg(pos, neg)
    return _ranking_from_counts(counts, keys)


def _ranking_from_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    run = running_sums(counts, keys, [F.col("__score").asc()], {"pos": "p", "neg": "q"})
    p, q, pos, neg = F.col("p_all"), F.col("q_all"), F.col("pos"), F.col("neg")
    below = F.col("q_run") - neg + neg / 2.0
    tp = p - F.col("p_run") + pos
    called = tp + q - F.col("q_run") + neg
    parts = _agg(
        run,
        keys,
        F.sum(pos * below).alias("__u"),
        F.sum(pos * tp / called).alias("__a"),
        F.max("p_all").alias("n_pos"),
        F.max("q_all").alias("n_neg"),
    )
    p, q = F.col("n_pos"), F.col("n_neg")
    defined = (p > 0) & (q > 0)
    return parts.select(
        *keys,
        F.when(defined, F.col("__u") / (p.cast("double") * q)).alias("auroc"),
        F.when(p > 0, F.col("__a") / p).alias("auprc"),
        (p + q).alias("n"),
        "n_pos",
        (p / (p + q)).alias("pos_rate"),
    )


def auroc_ovr_macro(df: DataFrame, probs: str, y: str, keys: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Mean one-vs-rest AUROC over the probability columns; NULL if a class is absent.

    Scores are ranked as they are; ``digits`` rounds them first, for comparisons across engines.
    """
    rows = df.select(*keys, F.col(y).alias("__y"), F.posexplode(probs).alias("__k", "__p"))
    score = F.col("__p") if digits is None else F.round("__p", digits)
    rows = rows.withColumns({"__p": score, "__hit": (F.col("__y") == F.col("__k")).cast("int")})
    per = ranking_metrics(rows, "__p", "__hit", [*keys, "__k"])
    mean = F.when(F.count("auroc") == F.count(F.lit(1)), F.avg("auroc"))
    return _agg(per, keys, mean.alias("macro_auroc_ovr"))


def threshold_metrics(
    df: DataFrame, probs: str, y: str, thresholds: Sequence[int] = (1, 2, 3, 4, 5), keys: Sequence[str] = (), digits: int | None = None
) -> DataFrame:
    """AUROC, AUPRC and prevalence of y >= t scored by the probability mass from t up; ``digits`` as above."""
    p = scale_to_sum(probs)
    rows = df.select(*keys, F.col(y).alias("__y"), p.alias("__p"))
    rows = rows.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    mass = tail_mass("__p", F.col("threshold"))
    rows = rows.select(
        *keys,
        "threshold",
        (mass if digits is None else F.round(mass, digits)).alias("__s"),
        (F.col("__y") >= F.col("threshold")).cast("int").alias("__hit"),
    )
    return ranking_metrics(rows, "__s", "__hit", [*keys, "threshold"])


def class_weights(df: DataFrame, label: str, n_classes: int) -> DataFrame:
    """Inverse-frequency weights scaled to mean 1, and n / (K * n_k), for all K classes."""
    spine = df.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("label"))
    counts = df.groupBy(F.col(label).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    known = spine.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    every = W.partitionBy(F.lit(0))
    total = F.sum("n").over(every)
    inv = 1.0 / F.greatest(F.col("n") / F.greatest(total, F.lit(1)), F.lit(1e-6))
    out = known.withColumn("__inv", inv).withColumn("__n", total)
    present = F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(every)
    return out.select(
        "label",
        "n",
        (F.col("__inv") / F.avg("__inv").over(every)).alias("weight"),
        F.when(F.col("n") > 0, F.col("__n") / (present * F.col("n"))).alias("balanced"),
    )


def fold_summary(folds: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean and sample standard deviation of each metric over the folds."""
    exprs = [F.count(F.lit(1)).alias("n_evaluations")]
    for m in metrics:
        exprs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return folds.agg(*exprs)


def focal_ce(
    df: DataFrame,
    logits: str,
    y: str,
    weight: str | None = None,
    alpha: float = 0.25,
    gamma: float = 2.0,
    smooth: float = 0.05,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Mean smoothed focal cross-entropy of a logits table."""
    z = F.col(logits)

    def log_probs(v: Column) -> Column:
        return let(
            F.array_max(v),
            lambda top: let(
                F.log(total(F.transform(v, lambda x: F.exp(x - top)))) + top,
                lambda norm: F.transform(v, lambda x: x - norm),
            ),
        )

    def target(i: Column) -> Column:
        return F.lit(smooth) / F.size(z) + F.when(i == F.col(y), F.lit(1.0 - smooth)).otherwise(F.lit(0.0))

    def row_loss(lp: Column) -> Column:
        pt = F.greatest(total(F.transform(lp, lambda v, i: F.exp(v) * target(i))), F.lit(1e-8))
        ce = -total(F.transform(lp, lambda v, i: target(i) * v))
        return F.lit(alpha) * F.pow(1.0 - pt, F.lit(gamma)) * ce

    loss = let(log_probs(z), row_loss)
    if weight is not None:
        loss = loss * F.col(weight)
    return _agg(df, keys, F.avg(loss).alias("focal_ce"))


def ordinal_penalty(df: DataFrame, probs: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean distance of the argmax class, and mean squared error of the expected class."""
    gap = expected_index(probs) - F.col(y)
    return _agg(
        df,
        keys,
        F.avg(F.abs(argmax(probs) - F.col(y)).cast("double")).alias("mean_distance"),
        F.avg(gap * gap).alias("expected_sq_error"),
    )


def oof_last_seed(df: DataFrame, id_col: str, seed_order: str, pred: str = "pred", y: str = "y") -> DataFrame:
    """Per row the prediction of the last seed, and how many predictions it had."""
    return df.groupBy(id_col).agg(
        F.max_by(y, seed_order).alias("y"),
        F.max_by(pred, seed_order).alias("pred"),
        F.count(F.lit(1)).alias("n_predictions"),
    )


def oof_ensemble(df: DataFrame, id_col: str, probs: str = "probs", y: str = "y") -> DataFrame:
    """Class probabilities averaged over the seeds, with their argmax."""
    from slidelake.operators.pooling import mean_pool

    pooled = mean_pool(df, [id_col, y], probs).withColumnRenamed("emb", probs)
    return pooled.withColumn("pred", argmax(probs)).select(id_col, y, "pred", probs)
