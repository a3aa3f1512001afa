"""Manifest jobs: summaries, duplicates, completeness, histograms, path lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidelake.functions.parsing import first_non_empty, power_number, to_number
from slidelake.operators.skew import group_join

GB = 1024.0**3


def read_properties(df: DataFrame, props: str = "properties") -> DataFrame:
    """Typed slide properties from a map of vendor properties."""
    p = F.col(props)
    power = first_non_empty(p["aperio.AppMag"], p["openslide.objective-power"])
    return df.withColumns(
        {
            "mpp_x": to_number(first_non_empty(p["openslide.mpp-x"], p["aperio.MPP"])),
            "mpp_y": to_number(first_non_empty(p["openslide.mpp-y"], p["aperio.MPP"])),
            "vendor": F.coalesce(first_non_empty(p["openslide.vendor"]), F.lit("unknown")),
            "objective_power": power_number(power),
            "objective_power_raw": power,
        }
    )


def manifest_summary(df: DataFrame, size: str = "size_bytes", failed: Column | None = None) -> DataFrame:
    """Row count, total bytes, total GB and failures in one pass."""
    bad = failed if failed is not None else F.col("error").isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(size).alias("total_bytes"),
        F.round(F.sum(size) / GB, 8).alias("total_gb"),
        F.count_if(bad).alias("n_failures"),
    )


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Rows per value, NULL included, most frequent first; ``top`` makes it a report."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if top is None:
        return counts
    return counts.orderBy(F.col("n").desc(), F.col(column).asc_nulls_first()).limit(top)


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows lacking any of the columns, and the percentage that has them all."""
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return df.agg(
        F.count_if(missing).alias("n_missing"),
        (100.0 * F.avg((~missing).cast("double"))).alias("pct_complete"),
    )


def duplicate_groups(
    df: DataFrame, fingerprint: str = "fingerprint", fallback: Sequence[str] = ("size_bytes", "filename")
) -> DataFrame:
    """Groups of more than one row with equal fingerprint.

    Rows without a fingerprint are left out, unless no row at all has one: then
    the fallback columns are the key.
    """
    known = df.agg(F.count(fingerprint).alias("n")).scalar()
    has_any = known > 0
    parts = [F.col(c).cast("string") for c in fallback]
    usable = F.lit(True)
    for p in parts:
        usable = usable & p.isNotNull()
    spare = F.when(usable, F.concat_ws("|", *parts))
    keyed = df.select(F.when(has_any, F.col(fingerprint)).otherwise(spare).alias("dup_key"))
    return (
        keyed.where(F.col("dup_key").isNotNull())
        .groupBy("dup_key")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
    )


def duplicate_summary(groups: DataFrame) -> DataFrame:
    """Number of groups and of extra copies beyond the first."""
    return groups.agg(
        F.count(F.lit(1)).alias("n_groups"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).alias("n_extra"),
    )


def histogram(df: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """Equal-width bins from min to max, the last one closed; empty bins are kept.

    When all values are equal the range is widened by 0.5 to both sides.
    """
    v = F.col(value).cast("double")
    vals = df.select(v.alias("v")).where(F.col("v").isNotNull())
    span = vals.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("span"))
    s = span.scalar()
    flat = s["lo"] == s["hi"]
    lo = F.when(flat, s["lo"] - 0.5).otherwise(s["lo"])
    hi = F.when(flat, s["hi"] + 0.5).otherwise(s["hi"])
    slot = F.least(F.floor((F.col("v") - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    counts = vals.groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (hi - lo) / bins
    return spine.join(counts, "bin", "left").select(
        "bin",
        (lo + F.col("bin") * width).alias("left_edge"),
        (lo + (F.col("bin") + 1) * width).alias("right_edge"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def largest(df: DataFrame, size: str, tiebreak: str, n: int = 10) -> DataFrame:
    """The n largest rows, with their size in GB."""
    return (
        df.withColumn("size_gb", F.col(size) / GB)
        .orderBy(F.col(size).desc(), F.col(tiebreak).asc())
        .limit(n)
    )


def path_index(df: DataFrame, stem: str = "stem", path: str = "path") -> DataFrame:
    """One path per stem: the lexically last."""
    return df.where(F.col(path).isNotNull()).groupBy(stem).agg(F.max(path).alias(path))


def resolve_path(
    slides: DataFrame, index: DataFrame, row_id: Sequence[str], slide_id: str = "slide_id", path: str = "path"
) -> DataFrame:
    """Path from the manifest, else by id, else by the id up to its first dot."""
    by_id = index.select(F.col("stem").alias("__s1"), F.col("path").alias("__p1"))
    by_base = index.select(F.col("stem").alias("__s2"), F.col("path").alias("__p2"))
    keyed = slides.withColumns({"__s1": F.col(slide_id), "__s2": F.substring_index(F.col(slide_id), ".", 1)})
    found = group_join(group_join(keyed, by_id, ["__s1"], row_id, "left"), by_base, ["__s2"], row_id, "left")
    return found.withColumn(
        "resolved_path", F.coalesce(F.nullif(F.col(path), F.lit("")), "__p1", "__p2")
    ).drop("__s1", "__p1", "__s2", "__p2")


def dataset_of(
    slides: DataFrame, id_sets: Sequence[tuple[str, DataFrame]], slide_id: str = "slide_id", other: str = "OTHER"
) -> DataFrame:
    """Name of the first id set that holds the slide; the sets come in precedence order.

    The sets are merged into one (id, best rank) table first, so the slides are
    joined once however many sets there are.
    """
    merged = None
    for rank, (_, ids) in enumerate(id_sets):
        part = ids.select(F.col(ids.columns[0]).alias("__id"), F.lit(rank).alias("__rank"))
        merged = part if merged is None else merged.unionByName(part)
    best = merged.groupBy("__id").agg(F.min("__rank").alias("__rank"))
    names = F.array(*[F.lit(name) for name, _ in id_sets])
    return (
        slides.join(best, F.col(slide_id) == F.col("__id"), "left")
        .withColumn("dataset", F.coalesce(F.get(names, F.col("__rank")), F.lit(other)))
        .drop("__id", "__rank")
    )


def resolve_columns(df: DataFrame, wanted: dict[str, Sequence[str]], defaults: dict | None = None) -> DataFrame:
    """Select columns under fixed names, each from the first alias that exists.

    An alias matches exactly, or else ignoring case.  A missing one takes its
    default if it has one, and raises KeyError otherwise.
    """
    defaults = defaults or {}
    by_lower = {c.lower(): c for c in df.columns}
    out = []
    for name, aliases in wanted.items():
        hit = next((a if a in df.columns else by_lower[a.lower()] for a in aliases if a.lower() in by_lower), None)
        if hit is not None:
            out.append(F.col(f"`{hit}`").alias(name))
        elif name in defaults:
            out.append(F.lit(defaults[name]).alias(name))
        else:
            raise KeyError(f"none of the columns {tuple(aliases)} exists")
    return df.select(*out)


def normalize_labels(df: DataFrame) -> DataFrame:
    """Lower-case headers; case, stage and centerid become patient, pn and center."""
    out = df.toDF(*[c.lower() for c in df.columns])
    for old, new in (("case", "patient"), ("stage", "pn"), ("centerid", "center")):
        if old in out.columns and new not in out.columns:
            out = out.withColumnRenamed(old, new)
    return out
