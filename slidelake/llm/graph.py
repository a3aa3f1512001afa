"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake.session import materialize


def components(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches.

    Each round hangs every node's larger neighbours on its smallest neighbour, then every node and its smaller
    neighbours on the smallest of them; the number of rounds is logarithmic in practice.  Minima are combined before
    they are shuffled, and each round is written out (into ``folder``), so a lost executor costs one round at most.
    """
    a, b = F.col("a"), F.col("b")
    flat = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    stars, state = materialize(flat, "edges", folder), None
    while True:
        both = stars.select("u", "v").unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = materialize(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "stars", folder)
        now = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    roots = stars.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
