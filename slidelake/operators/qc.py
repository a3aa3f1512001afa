"""Quality rules over slide metrics, and the gate that lets slides into tiling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    """Fixed default limits of the quality rules."""

    min_tissue: float = 0.10
    max_white: float = 0.75
    min_blur: float = 15.0
    max_pen: float = 0.02


def reason_list(t: Thresholds = Thresholds()) -> Column:
    """Array of the rules a slide breaks, in rule order."""
    rules = [
        (F.col("tissue_pct") < t.min_tissue, f"low_tissue<{t.min_tissue:.2f}"),
        (F.col("white_pct") > t.max_white, f"white>{t.max_white:.2f}"),
        (F.col("blur_var") < t.min_blur, f"blur<{t.min_blur:.1f}"),
        (F.col("pen_pct") > t.max_pen, f"pen>{t.max_pen:.2f}"),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in rules]))


def qc_flags(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Add ``reasons`` (joined by ``;``) and ``excluded``."""
    reasons = reason_list(t)
    return df.withColumns(
        {"reasons": F.concat_ws(";", reasons), "excluded": (F.size(reasons) > 0).cast("int")}
    )


def qc_summary(flagged: DataFrame) -> DataFrame:
    n, bad = F.count(F.lit(1)), F.coalesce(F.sum("excluded"), F.lit(0))
    return flagged.agg(
        n.alias("n_total"),
        bad.cast("bigint").alias("n_excluded"),
        (100.0 * bad / F.greatest(n, F.lit(1))).alias("pct_excluded"),
    )


def qc_gate(
    slides: DataFrame,
    qc: DataFrame,
    policy: str = "medium",
    min_tissue: float = 0.05,
    max_white: float = 0.95,
    on: str = "slide_id",
) -> DataFrame:
    """Keep the slides a policy lets through; slides without metrics pass."""
    if policy == "none":
        return slides
    if policy == "strict":
        side, keep = ["reasons"], F.coalesce(F.col("reasons"), F.lit("")) == ""
    elif policy == "medium":
        side = ["tissue_pct", "white_pct"]
        keep = (F.coalesce(F.col("tissue_pct"), F.lit(1.0)) >= min_tissue) & (
            F.coalesce(F.col("white_pct"), F.lit(0.0)) <= max_white
        )
    else:
        raise ValueError(f"unknown QC policy: {policy}")
    return slides.join(qc.select(on, *side), on, "left").where(keep).drop(*side)
