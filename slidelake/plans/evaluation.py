"""From labelled vectors to fold metrics, intervals and reports."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake.functions.parsing import tumor_label
from slidelake.functions.vectors import scale_to_sum, softmax
from slidelake.operators.bootstrap import bootstrap_accuracy, bootstrap_auroc, bootstrap_cluster_kappa
from slidelake.operators.folds import center_folds, kfold_stratified, kfold_stratified_group, label_encode
from slidelake.operators.joins import label_patients
from slidelake.operators.metrics import (
    accuracy,
    auroc_ovr_macro,
    balanced_accuracy,
    binary_f1,
    cells,
    classification_report,
    confusion_matrix,
    fold_summary,
    macro_f1,
    oof_last_seed,
    qw_kappa,
    ranking_metrics,
    threshold_metrics,
)
from slidelake.operators.pooling import mean_pool, narrow_features, validate_vectors
from slidelake.operators.probes import MODELS, best_config, cross_validate, grid_predictions, grid_table
from slidelake.session import materialize

METRICS = ("accuracy", "balanced_accuracy", "macro_f1", "macro_auc")


def fold_results(oof: DataFrame, keys: tuple[str, ...] = ("seed", "fold"), probs: str | None = "probs", digits: int | None = None) -> DataFrame:
    """Accuracy, balanced accuracy, macro F1 and macro AUROC per (seed, fold); ``digits`` rounds the scores first."""
    k = list(keys)
    c = cells(oof, k)
    hit = F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")
    acc = c.groupBy(*k).agg(hit.alias("accuracy"))
    out = acc.join(balanced_accuracy(c, k), k).join(macro_f1(c, k), k)
    if probs is not None:
        out = out.join(auroc_ovr_macro(oof, probs, "y", k, digits).withColumnRenamed("macro_auroc_ovr", "macro_auc"), k)
    return out


def patient_table(slides: DataFrame, manifest: DataFrame, label: str, site: str, order: str) -> DataFrame:
    """Mean vector, class number and site per patient.

    ``slides`` has patient and emb; ``manifest`` has patient, label, site and order.
    Patients lacking a label or a site are left out.
    """
    pooled = mean_pool(slides, ["patient"], "emb").withColumnRenamed("emb", "feat").drop("n_rows")
    labelled = label_patients(pooled, manifest, [label, site], order)
    return label_encode(labelled, label, ["patient"]).withColumnRenamed("code", "y")


def out_of_fold(
    patients: DataFrame, site: str, seeds: tuple[int, ...] = (42, 123, 456), k: int = 5, model: str = "logreg_l2", c: float = 1.0,
    max_iter: int = 200,
) -> DataFrame:
    """Out-of-fold predictions under site-grouped folds, once per seed."""
    table = materialize(patients.select("patient", F.col(site).alias("site"), "y", "feat"), "patients")
    out = None
    for n, seed in enumerate(seeds):
        folded = materialize(kfold_stratified_group(table, "y", "site", ["patient"], k, seed), "folds")
        part = cross_validate(folded, model, c, balanced=False, max_iter=max_iter).withColumns(
            {"seed": F.lit(seed), "seed_no": F.lit(n)}
        )
        out = part if out is None else out.unionByName(part)
    return materialize(out, "oof")


def report(oof: DataFrame, n_boot: int = 1000, seed: int = 42, boot: str = "multinomial") -> dict[str, DataFrame]:
    """Fold table, its summary, the interval, the class report and the confusion matrix."""
    folds = fold_results(oof, probs="probs" if "probs" in oof.columns else None)
    last = oof_last_seed(oof, "patient", "seed_no")
    c = cells(last)
    return {
        "folds": folds,
        "summary": fold_summary(folds, [m for m in METRICS if m in folds.columns]),
        "interval": bootstrap_accuracy(last, n_boot, seed, method=boot),
        "classes": classification_report(c),
        "confusion": confusion_matrix(c),
    }


def side_by_side(*parts: DataFrame) -> DataFrame:
    """One row with the columns of parts that have a row each, without a join; what a part without a row lacks is NULL."""
    stacked = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def binary_evaluation(
    slides: DataFrame, dim: int, slide: str = "slide", feat: str = "feat", k: int = 5, seed: int = 42, c: float = 1.0,
    n_boot: int = 1000, max_iter: int = 5000,
) -> dict[str, DataFrame]:
    """Slides that are tumours by their name against all others: stratified folds, a scaled logistic probe, one report.

    ``predictions`` has each slide's out-of-fold probability; ``summary`` is one row.  Slides whose vector is missing or of
    another length take no part; the summary counts them.
    """
    checked = validate_vectors(slides.select(F.col(slide).alias("slide"), F.col(feat).alias("feat")), dim)
    table = checked.where("ok").select("slide", "feat", tumor_label("slide").alias("y"))
    folded = materialize(kfold_stratified(table, "y", "slide", k, seed), "folds")
    oof = cross_validate(folded, "logreg_l2", c, balanced=False, max_iter=max_iter)
    oof = materialize(oof.select("slide", "fold", "y", "pred", F.element_at("probs", 2).alias("score")), "oof")
    ranks = ranking_metrics(oof, "score", "y").select("auroc", "auprc")
    counts = oof.agg(F.count(F.lit(1)).alias("n_slides"), F.sum("y").alias("n_tumor"))
    refused = checked.agg(F.count_if(~F.col("ok")).alias("n_refused"))
    interval = bootstrap_auroc(oof, "slide", "score", "y", n_boot, seed).select("ci_lo", "ci_hi")
    summary = side_by_side(ranks, interval, accuracy(oof), binary_f1(cells(oof)), counts, refused)
    return {"predictions": oof, "summary": summary}


def staging_evaluation(
    patients: DataFrame, models: tuple[str, ...] = MODELS, cs: tuple[float, ...] = (0.1, 0.3, 1.0, 3.0, 10.0), k: int = 5,
    seed: int = 17, n_boot: int = 1000, boot_seed: int = 123, max_iter: int = 200,
) -> dict[str, DataFrame]:
    """The whole grid under center-out folds (stratified ones where fewer than two centers are known).

    ``patients`` has patient, y, center (-1: unknown) and feat.  ``grid`` has every setting; ``predictions`` are those of the
    best one, and ``best`` is its setting with the kappa over all its predictions and the interval over drawn patients.
    """
    table = patients.select("patient", "y", "center", "feat")
    folded = materialize(center_folds(table, "center", "y", "patient", k, seed), "folds")
    runs = materialize(grid_predictions(folded, models, cs, max_iter=max_iter, keep=("patient",)), "grid")
    grid = materialize(grid_table(runs, prefix="CEN"), "settings")
    best = best_config(grid)
    predictions = runs.join(F.broadcast(best.select("model", "c")), ["model", "c"]).select("patient", "fold", "y", "pred")
    predictions = materialize(predictions, "best")
    overall = qw_kappa(cells(predictions)).withColumnRenamed("kappa", "kappa_overall")
    interval = bootstrap_cluster_kappa(predictions, "patient", n_boot, boot_seed).select("ci_lo", "ci_hi")
    found = side_by_side(best, overall, interval).where(F.col("model").isNotNull())
    return {"grid": grid, "predictions": predictions, "best": found}


def oof_table_evaluation(
    table: DataFrame, y: str = "true_isup", provider: str = "data_provider", thresholds: tuple[int, ...] = (1, 2, 3, 4, 5),
    digits: int | None = None,
) -> DataFrame:
    """Metrics of a table of out-of-fold predictions: for each threshold, over all rows and per provider.

    The classes' probabilities are columns prob_0, prob_1, ..., which are scaled to sum to one, or else logit_0, ..., which
    go through a softmax.  Rows over all have ``scope`` all and no provider; without the provider column there are no others.
    """
    names = set(table.columns)
    kind = next((k for k in ("prob_", "logit_") if any(c.startswith(k) and c[len(k) :].isdigit() for c in names)), None)
    if kind is None:
        raise ValueError("neither prob_* nor logit_* columns")
    scopes = [(F.lit("all"), F.lit(None).cast("string"))]
    if provider in names:
        scopes.append((F.lit("provider"), F.col(provider).cast("string")))
    scope = F.explode(F.array(*[F.struct(s.alias("scope"), p.alias("provider")) for s, p in scopes])).alias("s")
    keys = ["scope", "provider"]
    rows = table.withColumn("__y", F.col(y).cast("int")).select("*", scope)
    rows = narrow_features(rows.select("__y", "s.*", *[c for c in table.columns if c.startswith(kind)]), ["__y", *keys], kind, "probs")
    rows = rows.withColumn("probs", scale_to_sum("probs") if kind == "prob_" else softmax("probs"))
    per = threshold_metrics(rows, "probs", "__y", thresholds, keys, digits)
    macro = auroc_ovr_macro(rows, "probs", "__y", keys, digits).withColumnRenamed("provider", "p").withColumnRenamed("scope", "q")
    return per.join(macro, (F.col("scope") == F.col("q")) & F.col("provider").eqNullSafe(F.col("p"))).drop("p", "q")
