"""Joins and re-partitioning that do not trip over hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidelake.session import materialize

SALTS = 16


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df: DataFrame, *cols: str | Column) -> DataFrame:
    """Spread small rows that stand for much work over all partitions.

    The number is explicit, so adaptive execution does not merge the partitions
    by their (small) size.
    """
    return df.repartition(partitions(df), *cols)


#: Plain bytes of a side that is sent to all executors.
SMALL_BYTES = 64 << 20


def is_small(df: DataFrame, most: int = SMALL_BYTES) -> bool:
    """Whether the rows of ``df`` take at most ``most`` bytes; counts them."""
    size = F.lit(8 * len(df.columns))
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            # As text, nested values take about their bytes or more.
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0))
    return (df.agg(F.sum(size.cast("bigint"))).first()[0] or 0) <= most


def side_join(rows: DataFrame, side: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join rows to a side table whose bytes are summed first.

    A small one is broadcast; beyond that both sides are hashed by the key.  The
    check keeps the planner from broadcasting the large side where its estimate
    is off, as after an explode.
    """
    return rows.join(side.hint("broadcast" if is_small(side) else "shuffle_hash"), on, how)


def group_join(
    rows: DataFrame,
    groups: DataFrame,
    on: Sequence[str],
    row_id: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join rows to a table with one row per group, whatever the group sizes.

    The rows of a group are spread over salts by their id and the group's row is
    repeated per salt, so a group with a third of all rows is shared by many
    tasks.  Small group tables are broadcast by adaptive execution as usual.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*row_id), F.lit(salts)).cast("int"))
    repeated = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "__salt"], how).drop("__salt")


def checked_join(
    rows: DataFrame,
    groups: DataFrame,
    on: Sequence[str],
    row_id: Sequence[str],
    how: str = "inner",
) -> DataFrame:
    """``group_join`` for wide rows: the group table is written, measured in bytes, and broadcast if small.

    Then the rows, such as feature vectors, are not shuffled at all.
    """
    table = materialize(groups, "side")
    if is_small(table):
        return rows.join(table.hint("broadcast"), list(on), how)
    return group_join(rows, table, on, row_id, how)


def null_safe_join(rows: DataFrame, groups: DataFrame, on: Sequence[str], row_id: Sequence[str], how: str = "inner") -> DataFrame:
    """``checked_join`` in which a NULL key is a key like any other."""
    own = F.struct(*[F.col(c) for c in on])
    keyed = groups.withColumn("__own", own).drop(*on)
    return checked_join(rows.withColumn("__own", own), keyed, ["__own"], row_id, how).drop("__own")
