"""Merkle manifest of a data set: a content-addressed DAG of digests, and proofs read from it by descent.

Every row becomes a leaf, the SHA-256 of its tagged fields.  Per source the leaves, in order of id, are hashed in runs of
``FANOUT``, level by level, until one node is left; the sources' nodes, in order of source, make the root in the same way.

The store holds one record for each ``STRIDE`` levels: a node's digest and all digests below it, level by level.  It is
addressed by content, so equal subtrees are one record.  A request for a leaf is its source's rank and its own rank in the
source: it descends from the root, record by record, where the digits of the rank to base ``FANOUT`` say which child to
take, and collects the children not taken.  Requests that share the way to a record descend it once, so a descent moves a
row for each record and not for each leaf and level.  Reversed, the path segments are the proof, from the leaf to the root.

Leaves are ranked over range partitions and gathered by at most ``FANOUT ** STRIDE`` at a time, so no source, however
large, meets in one task.

Defined results: null fields are hashed as ``-``; a null source comes first and is a source of its own; rows without an id
come first in their source; rows with the same id are ordered by digest, so repeated rows are leaves of their own, and it
does not matter which of them is which; an empty table has no root and no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidelake.operators.ranking import exact_rank
from slidelake.operators.skew import checked_join
from slidelake.session import materialize

FANOUT = 3
#: Levels that one record of the store spans, and so the most leaves below it.
STRIDE = 4
SPAN = FANOUT**STRIDE
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The siblings to the left and to the right of a node on the way, their digests put together.
STEP = "struct<before:string,after:string>"


def tagged(field: str | Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value."""
    value = (F.col(field) if isinstance(field, str) else field).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    """SHA-256 of the row's fields; ``changed`` replaces some of them."""
    return F.sha2(F.concat(*[tagged(changed.get(f, f)) for f in FIELDS]), 256)


def _runs(level: Column) -> Column:
    """The level above: each run of ``FANOUT`` digests becomes one."""
    starts = F.sequence(F.lit(0), F.size(level) - 1, F.lit(FANOUT))
    return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(level, i + 1, FANOUT), ""), 256))


def _height(n: Column) -> Column:
    """Levels above ``n`` nodes within one record."""
    return reduce(lambda rest, h: F.when(n <= FANOUT**h, h).otherwise(rest), range(STRIDE - 1, -1, -1), F.lit(STRIDE))


def build(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roots, store) of the trees over ``leaves`` (tree, rank from 0, size of the tree, digest).

    ``roots`` (tree, digest, size); ``store`` (digest, below): the digests below a node, its nearest children last.
    """
    finished, records, base = [], [], leaves
    while True:
        finished.append(base.where("size = 1").select("tree", "digest"))
        base = base.where("size > 1")
        if base.isEmpty():
            break
        spans = base.groupBy("tree", F.expr(f"rank div {SPAN}").alias("rank")).agg(
            F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("members")
        )
        levels = spans.withColumn("l0", F.transform("members", lambda m: m["digest"]))
        for h in range(STRIDE):
            levels = levels.withColumn(f"l{h + 1}", _runs(F.col(f"l{h}")))
        height = _height(F.col("size"))
        every = F.array(*[F.col(f"l{h}") for h in range(STRIDE + 1)])
        levels = levels.select(
            "tree",
            "rank",
            F.expr(f"(size + {SPAN - 1}) div {SPAN}").alias("size"),
            F.element_at(F.element_at(every, height + 1), 1).alias("digest"),
            F.slice(every, F.lit(1), height).alias("below"),
        )
        levels = materialize(levels, "merkle")
        records.append(levels.select("digest", "below"))
        base = levels.drop("below")
    sizes = leaves.groupBy("tree").agg(F.first("size").alias("size"))
    roots = reduce(DataFrame.unionByName, finished).join(sizes, "tree")
    none = leaves.select("digest", F.array(F.array("digest")).alias("below")).limit(0)
    store = reduce(DataFrame.unionByName, records, none)
    return roots, store.groupBy("digest").agg(F.first("below").alias("below"))


def _descended(below: Column, at: Column) -> tuple[Column, Column]:
    """(digest reached, steps from the record down to it) for the node number ``at`` of the lowest level."""
    size = F.size(below)

    def step(h: Column) -> Column:
        # Element h + 1 of ``below`` is the level h above the lowest one.
        level = F.element_at(below, h + 1)
        place = F.floor(at / F.pow(F.lit(FANOUT), h)).cast("int")
        digit = place % FANOUT
        before = F.slice(level, place - digit + 1, digit)
        after = F.slice(level, place + 2, F.lit(FANOUT - 1) - digit)
        return F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))

    steps = F.transform(F.sequence(size - 1, F.lit(0), F.lit(-1)), step)
    return F.element_at(F.element_at(below, 1), at + 1), steps


def descend(starts: DataFrame, store: DataFrame, requests: DataFrame) -> DataFrame:
    """Answer ``requests`` (tree, rank, ...) from ``starts`` (tree, digest, size, down, ...): adds ``digest`` and ``down``.

    ``down`` is the list of steps taken so far; a tree's size says how many records lie between its root and a leaf.
    Other columns of ``starts`` come along.
    """
    most = starts.agg(F.max("size")).first()[0] or 0
    records = 0
    while SPAN**records < most:
        records += 1
    tall = reduce(lambda rest, r: F.when(F.col("size") <= SPAN**r, r).otherwise(rest), range(records - 1, -1, -1), F.lit(records))
    starts = starts.withColumn("tall", tall).withColumn("rank", F.lit(0).cast("long")).drop("size")
    # The ways that requests share: their ranks at the upper end of each record.
    ways = [requests]
    for _ in range(records):
        ways.append(ways[-1].select("tree", F.expr(f"rank div {SPAN}").alias("rank")).distinct())
    frontier = starts.where(F.col("tall") == records).drop("tall")
    if not records:
        return requests.join(frontier, ["tree", "rank"])
    for level in range(records - 1, -1, -1):
        found = frontier.join(store, "digest").withColumnRenamed("rank", "record").drop("digest")
        asked = ways[level].withColumn("record", F.expr(f"rank div {SPAN}")).join(found, ["tree", "record"])
        digest, steps = _descended(F.col("below"), (F.col("rank") % SPAN).cast("int"))
        reached = asked.withColumns({"digest": digest, "down": F.concat("down", steps)}).drop("record", "below")
        fresh = starts.where(F.col("tall") == level).drop("tall")
        # A tree of one leaf begins and ends here; only its own request is looked up.
        fresh = fresh if level else requests.where("rank = 0").join(fresh, ["tree", "rank"])
        frontier = reached.unionByName(fresh)
    return frontier


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` gives with the siblings of ``proof``, which goes from the leaf to the root."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def proven(documents: DataFrame, **tampered: Column) -> DataFrame:
    """One row per row of ``documents``: doc_id, leaf, subroot, root, and ``proof``, the steps from the leaf to the root.

    ``tampered`` replaces fields of the rows: ``tampered_leaf`` is what such a row's leaf would be.
    """
    other = leaf_digest(**tampered)
    leaf = leaf_digest()
    rows = documents.select("doc_id", "source", leaf.alias("leaf"), F.nullif(other, leaf).alias("other"))
    rows = materialize(rows, "leaves")
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    ranked = exact_rank(rows.withColumn("key", F.struct("source")), ["key"], order, "rank")
    ranked = materialize(ranked.select("*", (F.col("rank") - 1).alias("at")).drop("rank", "source"), "ranked")

    sources = exact_rank(ranked.groupBy("key").agg(F.first("group_rows").alias("n")), [], [F.col("key.source").asc_nulls_first()], "tree")
    sources = materialize(sources.select("key", (F.col("tree") - 1).alias("tree"), F.col("group_rows").alias("sources")), "sources")
    named = checked_join(ranked, sources.select("key", "tree"), ["key"], ["at"]).select(
        "tree", F.col("at").cast("long").alias("rank"), F.col("group_rows").alias("size"), F.col("leaf").alias("digest"), "doc_id", "other"
    )
    named = materialize(named, "named")
    subroots, store = build(named.select("tree", "rank", "size", "digest"))
    subroots = materialize(subroots, "subroots")
    upper = subroots.join(sources.select("tree", "sources"), "tree").select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").cast("long").alias("rank"), F.col("sources").alias("size"), "digest"
    )
    upper = materialize(upper, "upper")
    root, top = build(upper)

    down = F.array().cast(f"array<{STEP}>").alias("down")
    root = materialize(root.select("tree", "digest", "size", F.col("digest").alias("root"), down), "root")
    reached = descend(root, top, upper.select("tree", "rank")).select(F.col("rank").alias("tree"), "root", "digest", "down")
    starts = reached.join(subroots.select("tree", "size"), "tree").withColumn("subroot", F.col("digest"))
    answers = descend(materialize(starts, "starts"), store, named.select("tree", "rank", "doc_id", "other"))
    return answers.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        F.coalesce("other", "digest").alias("tampered_leaf"),
        "subroot",
        "root",
        F.reverse("down").alias("proof"),
    )


def verified_documents(documents: DataFrame, **tampered: Column) -> DataFrame:
    """``proven`` with the proof's digest, the root folded from the tampered leaf, and whether that is the root."""
    whole = F.array_join(F.transform("proof", lambda s: F.concat(s["before"], s["after"])), "")
    return (
        proven(documents, **tampered)
        .select(
            "doc_id",
            "leaf",
            "subroot",
            "root",
            F.sha2(whole, 256).alias("proof_sha256"),
            folded(F.col("tampered_leaf"), F.col("proof")).alias("folded_root"),
        )
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )
