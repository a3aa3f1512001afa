"""From tile features to slide and patient vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake.functions.detrand import u32
from slidelake.functions.vectors import l2_norm
from slidelake.operators.budget import BUDGETS, sample_uniform
from slidelake.operators.joins import two_scale_ids
from slidelake.operators.manifest import dataset_of
from slidelake.operators.pooling import max_pool, mean_pool, validate_vectors
from slidelake.operators.skew import checked_join, group_join
from slidelake.session import materialize
from slidelake.sources.tables import write_embeddings


def slide_embeddings(
    features: DataFrame, dim: int, bag: str = "bag", id_col: str = "vec_id", budgets: dict | None = None, seed: int = 1337, pool: str = "mean"
) -> DataFrame:
    """Budgeted tokens of the bags with both scales, pooled to one vector per bag.

    A bag with any vector that is missing or of another length is left out whole: the rest would not stand for it.

    Ids are cut to the budget before any vector is touched.  The last kept place
    per (bag, scale) then tells every row whether it counts, so the vectors are
    pooled where they lie.
    """
    refused = bad_bags(features, dim, bag)
    good = checked_join(features.where(F.col(bag).isNotNull()), refused, [bag], [id_col], "left_anti")
    both = two_scale_ids(good, bag)
    ids = good.select(bag, "scale", id_col, F.col("tile_idx").alias("__order"))
    ids = group_join(ids, both, [bag], [id_col], "left_semi")
    kept = sample_uniform(ids, [bag, "scale"], budgets or BUDGETS, id_col, "__order", seed)
    kept = materialize(kept.select(bag, "scale", id_col), "kept")
    place = F.struct(u32(seed, F.col(id_col)).alias("h"), F.col(id_col).alias("id"))
    last = kept.groupBy(bag, "scale").agg(F.max(place).alias("__last"))
    tokens = checked_join(good, last, [bag, "scale"], [id_col]).where(place <= F.col("__last")).drop("__last")
    counts = kept.groupBy(bag).agg(
        F.count_if(F.col("scale") == 0.5).alias("t05"), F.count_if(F.col("scale") == 2.0).alias("t20")
    )
    pooled = (mean_pool if pool == "mean" else max_pool)(tokens, [bag]).drop("n_rows")
    return pooled.join(counts, bag).withColumn("norm", l2_norm("emb"))


def bad_bags(features: DataFrame, dim: int, bag: str) -> DataFrame:
    """(bag, why) of the bags with a bad vector; of several reasons the smallest."""
    bad = validate_vectors(features, dim).where(~F.col("ok"))
    return bad.where(F.col(bag).isNotNull()).groupBy(bag).agg(F.min("reason").alias("why"))


def patient_embeddings(slides: DataFrame, patient: str = "patient", pool: str = "mean", emb: str = "emb") -> DataFrame:
    return (mean_pool if pool == "mean" else max_pool)(slides, [patient], emb)


def slide_export(
    features: DataFrame, dim: int, id_sets: Sequence[tuple[str, DataFrame]], path: str, bag: str = "bag", other: str = "OTHER", **options
) -> DataFrame:
    """Pool every bag, write the vectors into one folder per data set, and return the index of all bags.

    The index has a row for each bag: its data set, whether it has a vector, the reason if not, its token counts and norm.
    """
    found = materialize(dataset_of(embedding_outcomes(features, dim, bag, **options), id_sets, bag, other), "outcomes")
    write_embeddings(found.where("ok").select(bag, "emb", "dataset"), path)
    return found.drop("emb")


def embedding_outcomes(features: DataFrame, dim: int, bag: str = "bag", **options) -> DataFrame:
    """Every bag with its vector, or with the reason why it has none: a bad vector, or a scale without rows.

    Rows whose bag is NULL belong to no slide, so nothing is pooled from them; they are one row with the reason no_bag.
    """
    made = slide_embeddings(features, dim, bag, **options).withColumn("ok", F.lit(True))
    out = features.select(bag).distinct().join(made, bag, "left").join(bad_bags(features, dim, bag), bag, "left")
    out = out.withColumn("why", F.when(F.col(bag).isNull(), F.lit("no_bag")).otherwise(F.col("why")))
    return out.withColumns(
        {
            "ok": F.coalesce("ok", F.lit(False)),
            "reason": F.when(F.col("ok").isNull(), F.coalesce("why", F.lit("missing_feature_file"))),
        }
    ).drop("why")
