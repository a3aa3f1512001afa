"""Parsing of paths, barcodes, label texts and loosely typed properties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of the naming schemes.
PATIENT_BARCODE = r"(TCGA-[A-Z0-9]{2}-[A-Z0-9]{4})"
SITE_BARCODE = r"TCGA-([A-Z0-9]{2})-"
PATIENT_NAME = r"(patient[_\-]?\d+)"
STAGE = r"pn\s*([0-3])"
CENTER = r"(?i)center[_\-]?(\d+)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract(text, pattern: str) -> Column:
    """First group of the first match, NULL when there is none."""
    found = F.regexp_extract(_col(text), pattern, 1)
    return F.when(found != "", found)


def file_name(path) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def stem(path) -> Column:
    """File name without its last suffix; a leading dot is part of the name."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def class_from_path(path, root: str) -> Column:
    """First folder below the root; ``UNKNOWN`` for a file right in the root."""
    base = root.rstrip("/") + "/"
    parts = F.split(F.substr(_col(path), F.lit(len(base) + 1)), "/")
    return F.when(_col(path).isNull(), None).when(F.size(parts) >= 2, parts[0]).otherwise(F.lit("UNKNOWN"))


def first_non_empty(*cols) -> Column:
    """First value that is neither NULL nor the empty string."""
    return F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in cols])


def first_number(*cols) -> Column:
    """First value that is a number; text before it is passed over."""
    return F.coalesce(*[to_number(c) for c in cols])


def to_number(c) -> Column:
    """Number or NULL; never raises."""
    return _col(c).try_cast("double")


def power_number(c) -> Column:
    """Number only when the text is digits with at most one dot in them."""
    digits = F.regexp_replace(_col(c), r"^([^.]*)\.", "$1")
    return F.when(digits.rlike(r"^[0-9]+$"), _col(c).try_cast("double"))


def patient_barcode(c) -> Column:
    return extract(c, PATIENT_BARCODE)


def site_barcode(c) -> Column:
    return extract(c, SITE_BARCODE)


def patient_from_slide(slide_id) -> Column:
    """Patient part of a slide name: the pattern, else the text before ``_node``."""
    low = F.lower(_col(slide_id))
    return F.coalesce(extract(low, PATIENT_NAME), F.substring_index(low, "_node", 1))


def patient_from_label(c) -> Column:
    return F.coalesce(extract(c, PATIENT_NAME), _col(c))


def parse_stage(c) -> Column:
    """Stage 0..3 from texts such as ``pN1``, ``pn 2`` or ``3``; else NULL."""
    low = F.lower(_col(c).cast("string"))
    return F.coalesce(extract(low, STAGE), F.when(low.rlike(r"^[0-3]$"), low)).cast("int")


def parse_center(c) -> Column:
    """Center number from ``center_3`` or from a bare number 0..9; else NULL."""
    text = _col(c).cast("string")
    bare = F.when(text.rlike(r"^[0-9]+$"), text.try_cast("int"))
    return F.coalesce(extract(text, CENTER).try_cast("int"), F.when(bare.between(0, 9), bare))


def tumor_label(slide_id) -> Column:
    return F.lower(_col(slide_id)).contains("tumor").cast("int")


def label_or_zero(c) -> Column:
    return F.coalesce(_col(c), F.lit(0)).cast("int")


def stratum(*cols) -> Column:
    """Composite stratum such as grade_provider."""
    return F.concat_ws("_", *[_col(c).cast("string") for c in cols])
