"""Prefix trie of conversations, built from the sorted conversations without building a trie first.

Every conversation is one row: the 16-byte digests of its turns put together, and the words of each turn.  Equal
conversations are one sequence.  The sequences are sorted, over range partitions, and the edge between two neighbours is
the depth of their longest common prefix.  Within a partition a union-find takes the edges in descending depth: each merge
of two components makes a branching node at the edge's depth, or joins a node that is there, so the components' tops grow
into a compact forest.  The chain of depths between a node and its parent is the nodes with one child each.

Nodes on the way to a sequence at a partition's border, down to the depth it has in common with the next partition, lie in
several partitions.  They are contracted: each partition gives its part of their sums, and the parts meet by the digest of
the node's prefix.  What remains is the trie of the borders, a few nodes for each partition; the same union-find, over the
prefixes shared at the borders, adds up what needs whole nodes.  All other nodes are finished where they are.

Bounds: a conversation's digests are one row (16 bytes a turn, no text); a partition is ``ROWS`` sequences, about; the trie
of the borders has at most (partitions) x (depth shared at a border) nodes.  The ids of equal conversations are gathered
in chunks of ``CHUNK`` and hashed as a stream, as SHA-256 needs them in order.

Defined results: turns are ordered by turn, null first, then by their content, so ties and repeated rows have one order; a
null role or text is empty; rows without conv_id belong to no conversation; the root has no text; an empty table gives an
empty trie.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake.operators.ranking import exact_rank
from slidelake.operators.skew import partitions, side_join
from slidelake.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a turn's digest.
WIDTH = 16
#: Sequences in a partition, about.
ROWS = 50_000
#: Ids that are put together before they are hashed.
CHUNK = 4096
NO_IDS = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at from 1, digest, words): the turns of each conversation in order, without their texts."""
    role, text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")]
    content = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", content.alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words")
    )
    turns = materialize(turns, "turns")
    return exact_rank(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("digest")], "at").select("conv_id", "at", "digest", "words")


def rebuilt(turns: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """(conv_id, sequence, words): each conversation with its first turns from the first one of its family.

    Conversation c takes h = crc32(c) mod ``heads`` turns of c - c mod ``family``, then its own from its h-th turn on.
    """
    ids = turns.select("conv_id").distinct()
    ids = ids.withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % heads, "base": F.expr(f"conv_id - conv_id % {family}")})
    own = turns.where(F.col("at") > F.crc32(F.col("conv_id").cast("string")) % heads)
    first = turns.where(F.col("at") < heads).select(F.col("conv_id").alias("base"), "at", "digest", "words")
    given = ids.join(first, "base").where("at <= h").select("conv_id", "at", "digest", "words")
    none = ids.select("conv_id", *[F.lit(None).cast(t).alias(c) for c, t in turns.dtypes if c != "conv_id"])
    every = own.unionByName(given).unionByName(none)
    turn = F.when(F.col("at").isNotNull(), F.struct("at", F.hex("digest").alias("digest"), "words"))
    listed = every.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return listed.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("t", lambda t: t["digest"]), "")).alias("sequence"),
        F.transform("t", lambda t: t["words"]).alias("words"),
    )


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by (key, chunk) to one row for each key, with the hash of all its ids; holds one chunk at a time."""
    key = state = None
    done: list[tuple] = []

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pylist([dict(zip(ENDS.names, r)) for r in done], ENDS)
        done.clear()
        return batch

    for batch in batches:
        for k, n, least, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "least", "ids"))):
            if k != key:
                if key is not None:
                    done.append((key, count, first, state.hexdigest()))
                key, state, count, first = k, hashlib.sha256(ids.encode()), n, least
            else:
                state.update(f",{ids}".encode())
                count += n
        if len(done) >= 1000:
            yield out()
    if key is not None:
        done.append((key, count, first, state.hexdigest()))
    if done:
        yield out()


ENDS = pa.schema([("key", pa.string()), ("n", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.string())])


def sequences(convs: DataFrame) -> DataFrame:
    """(sequence, words, n, conv_id, ends): the distinct sequences, how many conversations have them, and their ids' hash."""
    keyed = materialize(convs.withColumn("key", F.md5("sequence")), "conversations")
    ranked = exact_rank(keyed.select("key", "conv_id"), ["key"], [F.col("conv_id")], "rank")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    chunks = ranked.groupBy("key", F.expr(f"(rank - 1) div {CHUNK}").alias("chunk")).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), ids.alias("ids")
    )
    ends = (
        chunks.repartition("key")
        .sortWithinPartitions("key", "chunk")
        .select("key", "n", "least", "ids")
        .mapInArrow(_joined_ids, "key string, n long, conv_id long, ends string")
    )
    each = keyed.groupBy("key").agg(F.first("sequence").alias("sequence"), F.first("words").alias("words"))
    return each.join(ends, "key").drop("key")


def shared_depth(a: bytes, b: bytes) -> int:
    """How many whole digests two sequences have in common at the front."""
    lo, hi = 0, min(len(a), len(b)) // WIDTH
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[: mid * WIDTH] == b[: mid * WIDTH]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def prefix_keys(sequence: bytes, depth: int) -> list[bytes]:
    """Digests of the prefixes of 0 to ``depth`` turns."""
    state, out = hashlib.md5(), [hashlib.md5().digest()]
    for at in range(0, depth * WIDTH, WIDTH):
        state.update(sequence[at : at + WIDTH])
        out.append(state.copy().digest())
    return out


class Forest:
    """The compact trie over sorted distinct sequences, by union-find over the edges of neighbours, deepest first.

    Node i below len(lengths) is the end of sequence i.  ``depth``, ``parent`` (-1: none) and ``sample``, a sequence below
    the node, are lists by node; ``order`` has children before parents.
    """

    def __init__(self, lengths: list[int], edges: list[int]) -> None:
        n = len(lengths)
        self.depth, self.parent, self.sample = list(lengths), [-1] * n, list(range(n))
        leader, top = list(range(n)), list(range(n))

        def find(i: int) -> int:
            while leader[i] != i:
                leader[i] = leader[leader[i]]
                i = leader[i]
            return i

        # edges[i] lies between sequences i and i + 1.  Of equal depths the left edge comes first, so what lies to the
        # right of an edge is deeper than the edge, and a node at the edge's depth can only be to its left.
        for i in sorted(range(n - 1), key=lambda i: -edges[i]):
            a, b = find(i), find(i + 1)
            x, y = top[a], top[b]
            if self.depth[x] > edges[i]:
                self.depth.append(edges[i])
                self.sample.append(self.sample[x])
                self.parent.append(-1)
                self.parent[x] = x = len(self.depth) - 1
            self.parent[y] = x
            leader[b], top[a] = a, x
        self.order = sorted(range(len(self.depth)), key=lambda v: -self.depth[v])


NODE = pa.schema(
    [
        ("key", pa.binary()),
        ("parent_key", pa.binary()),
        ("border", pa.binary()),
        ("conv_id", pa.int64()),
        ("depth", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
        ("words", pa.int64()),
        ("ends", pa.string()),
    ]
)
NODE_DDL = (
    "key binary, parent_key binary, border binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, words long, ends string"
)


def partition_nodes(group: pa.Table) -> pa.Table:
    """All nodes that one partition has alone, and its parts of the nodes that it has in common with its neighbours.

    A node of several partitions has its ``key``; in ``saved_tokens`` it has only what finished nodes below it save.
    ``parent_key`` is the key of a parent that has one.  One more row has the prefix that is shared at the left ``border``.
    """
    side = group.column("side").to_pylist()
    seqs = group.column("sequence").to_pylist()
    before, after = [next((s for s, k in zip(seqs, side) if k == want), None) for want in (-1, 1)]
    rows = sorted((s, i) for i, (s, k) in enumerate(zip(seqs, side)) if k == 0)
    seqs, taken = [s for s, _ in rows], group.take([i for _, i in rows])
    n, ids, ends = (taken.column(c).to_pylist() for c in ("n", "conv_id", "ends"))
    words = taken.column("words").combine_chunks()
    counts, starts = words.values.to_numpy(zero_copy_only=False), words.offsets.to_numpy()
    lengths = [len(s) // WIDTH for s in seqs]
    # Depths down to which the first and the last sequence's nodes are not this partition's alone; -1: none.
    left = shared_depth(before, seqs[0]) if before is not None else -1
    right = shared_depth(seqs[-1], after) if after is not None else -1
    left_keys, right_keys = prefix_keys(seqs[0], left), prefix_keys(seqs[-1], right)

    forest = Forest(lengths, [shared_depth(a, b) for a, b in zip(seqs, seqs[1:])])
    size = len(forest.depth)
    total, leaves, saved, kids, least = [0] * size, [0] * size, [0] * size, [0] * size, [None] * size
    total[: len(n)], least[: len(n)] = n, ids
    has_child = set(forest.parent)
    for i in range(len(seqs)):
        # A sequence is a leaf if the next one, here or in the next partition, doesn't begin with it.
        leaves[i] = int(i not in has_child and not (i == len(seqs) - 1 and right == lengths[i]))
    out: list[list] = [[] for _ in NODE.names]
    top_row = {}
    for v in forest.order:
        p, s = forest.parent[v], forest.sample[v]
        with_left = min(left, shared_depth(seqs[s], seqs[0])) if left >= 0 else -1
        with_right = min(right, shared_depth(seqs[s], seqs[-1])) if right >= 0 else -1

        def key(d: int) -> bytes | None:
            return left_keys[d] if d <= with_left else right_keys[d] if d <= with_right else None  # noqa: B023

        below, children = saved[v], kids[v]
        for d in range(forest.depth[v], forest.depth[p] if p >= 0 else -1, -1):
            w, own = int(counts[starts[s] + d - 1]) if d else 0, key(d)
            if own is None:
                below += (total[v] - 1) * w
            top_row[v] = len(out[0])
            above = key(d - 1) if d else None
            end = ends[v] if v < len(seqs) and d == lengths[v] else None
            # A parent in the same chain has the same members.
            row = (own, above, None, least[v], d, least[v] if d else None, total[v], children, leaves[v], below, w, end)
            for column, value in zip(out, row):
                column.append(value)
            # An earlier partition has counted what it shares with this one.
            children = int(d > with_left)
        if p >= 0:
            total[p] += total[v]
            leaves[p] += leaves[v]
            saved[p] += below
            kids[p] += children
            least[p] = least[v] if least[p] is None else min(least[p], least[v])
    for v, row in top_row.items():
        if (p := forest.parent[v]) >= 0:
            out[NODE.names.index("parent_conv_id")][row] = least[p]
    if left >= 0:
        for name, column in zip(NODE.names, out):
            column.append(seqs[0][: left * WIDTH] if name == "border" else None)
    return pa.table(out, NODE)


def border_nodes(group: pa.Table) -> pa.Table:
    """The nodes of several partitions, whole: adds up what they save themselves, and names their parents."""
    rows = group.to_pylist()
    by_key = {r["key"]: r for r in rows if r["key"] is not None}
    paths = sorted({r["border"] for r in rows if r["border"] is not None})
    forest = Forest([len(p) // WIDTH for p in paths], [shared_depth(a, b) for a, b in zip(paths, paths[1:])])
    own = [0] * len(forest.depth)
    for v in forest.order:
        p, keys = forest.parent[v], prefix_keys(paths[forest.sample[v]], forest.depth[v])
        for d in range(forest.depth[v], forest.depth[p] if p >= 0 else -1, -1):
            row = by_key[keys[d]]
            own[v] += (row["n_convs"] - 1) * row["words"]
            row["saved_tokens"] += own[v]
            row["parent_conv_id"] = by_key[keys[d - 1]]["conv_id"] if d else None
        if p >= 0:
            own[p] += own[v]
    return pa.Table.from_pylist(list(by_key.values()), NODE)


def trie_nodes(convs: DataFrame) -> DataFrame:
    """One row per node of the trie over ``convs`` (conv_id, sequence, words); see the contract of the columns above."""
    distinct = materialize(sequences(convs), "sequences")
    count = distinct.count()
    parts = max(1, min(partitions(distinct), count // 64), count // ROWS)
    sorted_rows = distinct.repartitionByRange(parts, "sequence").withColumn("part", F.spark_partition_id())
    sorted_rows = materialize(sorted_rows.withColumn("side", F.lit(0)), "sorted")
    # A row for each partition.
    borders = sorted_rows.groupBy("part").agg(F.min("sequence").alias("low"), F.max("sequence").alias("high"))
    borders = borders.select(
        "part", F.expr("lag(high) OVER (ORDER BY part)").alias("before"), F.expr("lead(low) OVER (ORDER BY part)").alias("after")
    )
    sides = F.array(F.struct(F.lit(-1).alias("side"), F.col("before").alias("sequence")), F.struct(F.lit(1).alias("side"), F.col("after").alias("sequence")))
    borders = borders.select("part", F.inline(sides)).where("sequence IS NOT NULL")
    nodes = sorted_rows.unionByName(borders, allowMissingColumns=True).groupBy("part").applyInArrow(partition_nodes, NODE_DDL)
    nodes = materialize(nodes, "nodes")

    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    shared = nodes.where("key IS NOT NULL OR border IS NOT NULL").groupBy("key", "border").agg(
        F.first("parent_key").alias("parent_key"),
        F.min("conv_id").alias("conv_id"),
        F.first("depth").alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"),
        *[F.sum(c).alias(c) for c in sums],
        F.max("words").alias("words"),
        F.max("ends").alias("ends"),
    )
    shared = shared.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(border_nodes, NODE_DDL)
    shared = materialize(shared, "borders")
    parents = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("named"))
    own = nodes.where("key IS NULL AND border IS NULL")
    hung = side_join(own.where("parent_key IS NOT NULL"), parents, "parent_key")
    return (
        shared.unionByName(own.where("parent_key IS NULL"))
        .unionByName(hung.withColumn("parent_conv_id", F.col("named")).drop("named"))
        .select("conv_id", "depth", "parent_conv_id", *sums, F.coalesce("ends", F.lit(NO_IDS)).alias("ends_sha256"))
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves (nodes without children in the subtree), saved_tokens (in the subtree: words of each node's last text, once for
    each member but one), ends_sha256 (hash of the ids of conversations that end here)."""
    return trie_nodes(rebuilt(numbered_turns(conversations)))
