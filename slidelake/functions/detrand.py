"""Reproducible randomness as columns.

Every draw is a pure function of a text key, so retried tasks, re-partitioned
inputs and other SQL engines all see the same numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 4294967296.0


def key(*parts) -> Column:
    """Parts joined by ``|``; plain values become literals."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def digest(*parts) -> Column:
    return F.md5(key(*parts))


def digest_u32(hex_digest: Column, word: int = 0) -> Column:
    """One of the four 32-bit integers in an md5 digest."""
    return F.conv(F.substring(hex_digest, 1 + 8 * word, 8), 16, 10).cast("bigint")


def digest_uniform(hex_digest: Column, word: int = 0) -> Column:
    return digest_u32(hex_digest, word) / F.lit(U32)


def u32(*parts) -> Column:
    """32-bit integer from the md5 of the key."""
    return digest_u32(digest(*parts))


def uniform(*parts) -> Column:
    """Uniform double in [0, 1)."""
    return u32(*parts) / F.lit(U32)


def draw_index(n: Column, *parts) -> Column:
    """Uniform integer in [0, n), from 52 bits: every one of up to 2**52 rows can be drawn."""
    bits = F.conv(F.substring(digest(*parts), 1, 13), 16, 10).cast("bigint")
    return F.floor(bits / F.lit(2.0**52) * n).cast("bigint")


def gaussian(u1: Column, u2: Column) -> Column:
    """Box-Muller transform of two uniforms; u1 is shifted off zero."""
    radius = F.sqrt(F.lit(-2.0) * F.log(u1 + F.lit(1.0 / U32)))
    return radius * F.cos(F.lit(2.0 * math.pi) * u2)
