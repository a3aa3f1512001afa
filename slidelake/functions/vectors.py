"""Functions over ARRAY<FLOAT|DOUBLE> columns, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    An expression used inside a lambda is evaluated for every element; binding
    it as a lambda variable keeps a row-level value at one evaluation per row.
    """
    return F.get(F.transform(F.array(_col(value)), body), F.lit(0))


def as_double(v) -> Column:
    return _col(v).cast("array<double>")


def total(v) -> Column:
    return F.aggregate(as_double(v), F.lit(0.0), lambda a, x: a + x)


def dot(a, b) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda a, x: a + x * x))


def cosine(a, b, eps: float = 1e-12) -> Column:
    """Cosine similarity; norms are floored at eps so a zero vector gives 0."""
    na = F.greatest(l2_norm(a), F.lit(eps))
    nb = F.greatest(l2_norm(b), F.lit(eps))
    return dot(a, b) / (na * nb)


def softmax(z) -> Column:
    """Softmax with the row maximum subtracted first."""
    return let(
        as_double(z),
        lambda v: let(F.array_max(v), lambda top: scale_to_sum(F.transform(v, lambda x: F.exp(x - top)))),
    )


def scale_to_sum(p) -> Column:
    """Divide by the row sum; a zero sum leaves the row as it is."""
    return let(
        as_double(p),
        lambda v: let(
            total(v),
            lambda s: F.transform(v, lambda x: x / F.when(s == 0, F.lit(1.0)).otherwise(s)),
        ),
    )


def argmax(p) -> Column:
    """Zero-based position of the maximum, the lowest on ties."""
    return let(p, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def expected_index(p) -> Column:
    """Sum of i * p[i]."""
    weighted = F.transform(as_double(p), lambda x, i: x * i)
    return total(weighted)


def tail_mass(p, t) -> Column:
    """Sum of p[i] for i >= t."""
    t = t if isinstance(t, Column) else F.lit(t)
    kept = F.transform(as_double(p), lambda x, i: F.when(i >= t, x).otherwise(F.lit(0.0)))
    return total(kept)


def zeros_like(v) -> Column:
    return F.transform(as_double(v), lambda x: F.lit(0.0))
