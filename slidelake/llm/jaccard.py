"""N-gram Jaccard join: which documents share nearly all of their word shingles.

The set of a document is the set of hashes of its distinct ``width``-word shingles.  Two documents link when
``100 * intersection >= percent * union``.  The join is exact (hashes of 64 bits stand for shingles, of 128 bits for sets):

1. Documents with equal sets are one node.
2. Sets are ordered by hash.  Linked sets of a and b elements have at least ``percent`` % of the larger in common, so
   among the first ``a - ceil(percent * a) + k`` elements of the one and of the other at least k are common.  With k a
   tenth of the set, only documents go on that share so many of these prefix elements with others.  A text that merely
   quotes a common passage does not get this far.
3. Among what is left, two linked sets differ in at most ``d`` elements, which their sizes bound.  So elements are dealt by
   hash to some more than ``d`` groups, and a signature stands for all that a set has in one group: at most ``d`` groups
   differ, so the sets have a signature in common among the first ``d + 1`` of each, in any one order of signatures.
   First are those with an element that few sets have, then those of many elements; elements are counted for that (the
   ``MOST_COMMON`` commonest are known).  Equal signatures join documents to components.  As a signature takes several
   equal elements, a quoted passage or common lines do not hold a component together, and components stay as large as
   the families of near copies in them.  Each component is cut, in order of size, into bands of about ``band_elements``
   elements, and two bands are joined only if their sizes allow a link.
4. In a tile, hashed bitmap signatures bound the overlap from above: each bit in which two signatures differ is an
   element that only one set has.  Pairs that pass are intersected as sorted arrays.  Pairs that are already connected
   within the tile are not looked at again, so a tile returns a spanning forest of its links.

A hash that very many documents have is counted within each chunk of a task first, so at most one row for each chunk
leaves for it.  No group is collected: chunks, buckets and tiles have a bounded number of elements.  The steps' files go as
soon as they have been read.

Defined results: a null, empty or blank text has no shingle and links with nothing, itself being its component; fewer
than ``width`` words are one shingle; repeated rows and equal texts are one component; a null doc_id is kept, and a
component whose ids are all null has a null id; an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slidelake.llm.graph import components
from slidelake.operators.ranking import running_sums
from slidelake.operators.skew import is_small
from slidelake.session import discard, materialize, scratch_path

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
MEMO_WORDS = 500_000
#: Prefix elements that a task gathers before it sends them on.
CHUNK = 1_000_000
#: Elements in a bucket, about.
BUCKET = 65_536
#: Elements that so many sets have count as common, and so many of them are ordered by how common they are.
COMMON = 8
MOST_COMMON = 1 << 20
#: Groups for signatures: so many percent more than linked sets may differ in.
SPARE = 60
#: Bytes of ids up to which they are sent to all executors; beyond, they are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
ODD = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


class WordHashes(dict):
    """64-bit hashes of words, each computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes, width: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct hashes (int64) of the shingles of ``text``."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    k = min(width, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(ODD) + h[i : len(h) - k + 1 + i]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out.view(np.int64))


def digest(elements: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(elements.tobytes())


def low_digest(node: bytes) -> int:
    return int.from_bytes(node[8:], "big", signed=True)


def common_part(n: int) -> int:
    """How many prefix elements a set of ``n`` must share at least with a linked one of its size or more."""
    return max(1, n // 10)


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - -(-percent * n // 100) + common_part(n))


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            found = [shingles(t.as_py() or b"", width, memo) for t in batch.column("text").cast(pa.binary())]
            nodes = [digest(s) for s in found]
            others = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(n) for n in others],
                    pa.array(nodes, pa.binary()),
                    pa.array([low_digest(d) for d in nodes], pa.int64()),
                    pa.array([len(s) for s in found], pa.int64()),
                ],
                [*others, "node", "low", "n"],
            )

    return run


def _full_sets(width: int):
    """(node, low, n, elements) of each text with shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = batch.column("text").slice(at, 256).cast(pa.binary())
                found = [s for t in texts if len(s := shingles(t.as_py() or b"", width, memo))]
                nodes = [digest(s) for s in found]
                lows = [low_digest(d) for d in nodes]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.binary()), pa.array(lows, pa.int64()), pa.array([len(s) for s in found], pa.int64()), _lists(found)],
                    ["node", "low", "n", "elements"],
                )

    return run


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


BLOCKS = pa.schema([("bucket", pa.int32()), ("h", pa.list_(pa.int64())), ("held", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))])


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by ``h``; for each element in that order the number of its run; the size of each run."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    run = np.cumsum(first) - 1
    return order, run, np.bincount(run) if len(s) else np.zeros(0, np.int64)


def _split(h: np.ndarray, held: np.ndarray, low: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Deal elements to buckets by their hash."""
    at = ((h.view(np.uint64) >> np.uint64(11)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(at, kind="stable")
    at, h, held, low = at[order], h[order], held[order], low[order]
    names, starts = np.unique(at, return_index=True)
    offsets = pa.array(np.append(starts, len(at)).astype(np.int32))
    cols = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (h, held, low)]
    yield pa.RecordBatch.from_arrays([pa.array(names), *cols], schema=BLOCKS)


def _prefix_blocks(width: int, percent: int, buckets: int):
    """Prefix elements by bucket: ``held`` 1 with the holder's low digest, 2 for one that several here hold.

    The holders of the latter are told at once: a row of bucket -1 has the low digests and how many of their elements
    were found shared.
    """

    def flush(parts: list[np.ndarray], lows: list[int]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate(parts)
        low = np.repeat(np.array(lows, np.int64), [len(p) for p in parts])
        order, run, size = _runs(h)
        many = size[run] > 1
        credit, n = np.unique(low[order][many], return_counts=True)
        if len(credit):
            cols = [_lists([x]) for x in (np.zeros(0, np.int64), n.astype(np.int64), credit)]
            yield pa.RecordBatch.from_arrays([pa.array([-1 - int(abs(int(credit[0]))) % buckets], pa.int32()), *cols], schema=BLOCKS)
        first = np.ones(len(run), bool)
        first[1:] = run[1:] != run[:-1]
        kept = order[first]
        yield from _split(h[kept], np.where(size > 1, 2, 1).astype(np.int64), np.where(size > 1, 0, low[kept]), buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        parts, lows, size = [], [], 0
        for batch in batches:
            for t in batch.column("text").cast(pa.binary()):
                s = shingles(t.as_py() or b"", width, memo)
                if len(s):
                    parts.append(s[: prefix_length(len(s), percent)])
                    lows.append(low_digest(digest(s)))
                    size += len(parts[-1])
                if size >= CHUNK:
                    yield from flush(parts, lows)
                    parts, lows, size = [], [], 0
        if parts:
            yield from flush(parts, lows)

    return run


def _credits(group: pa.Table) -> pa.Table:
    """How many prefix elements of each holder in this bucket others hold too."""
    if group.column("bucket")[0].as_py() < 0:
        low, n = group.column("low").combine_chunks().flatten().to_numpy(), group.column("held").combine_chunks().flatten().to_numpy()
    else:
        h, held, low = (group.column(c).combine_chunks().flatten().to_numpy() for c in ("h", "held", "low"))
        order, run, size = _runs(h)
        shared = (size[run] > 1) & (held[order] == 1)
        low, n = np.unique(low[order][shared], return_counts=True)
    return pa.table({"low": pa.array(low, pa.int64()), "n_shared": pa.array(n.astype(np.int64))})


def _count_blocks(buckets: int):
    """How many sets of a chunk have each element, by bucket."""

    def flush(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        yield from _split(h, n.astype(np.int64), np.zeros(len(h), np.int64), buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for elements in batch.column("elements"):
                parts.append(elements.values.to_numpy())
                size += len(parts[-1])
                if size >= CHUNK:
                    yield from flush(parts)
                    parts, size = [], 0
        if parts:
            yield from flush(parts)

    return run


def _common(group: pa.Table) -> pa.Table:
    h, n = (group.column(c).combine_chunks().flatten().to_numpy() for c in ("h", "held"))
    order, run, size = _runs(h)
    total = np.bincount(run, weights=n[order]).astype(np.int64)
    first = np.cumsum(size) - size
    kept = total >= COMMON
    return pa.table({"h": pa.array(h[order][first[kept]]), "n": pa.array(total[kept])})


def common_elements(sets: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest elements, sorted, and the class of each: the bits of its count."""
    blocks = sets.select("elements").mapInArrow(_count_blocks(buckets), "bucket int, h array<long>, held array<long>, low array<long>")
    counts = blocks.groupBy("bucket").applyInArrow(_common, "h long, n long")
    got = counts.orderBy(F.desc("n"), "h").limit(MOST_COMMON).toArrow()
    h, n = got.column("h").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], np.frexp(n[order].astype(float))[1].astype(np.int8)


def size_classes(most: int) -> np.ndarray:
    """Where classes of sizes begin, each a quarter above the one before, up to one above ``most``."""
    starts = [1]
    while starts[-1] <= most:
        starts.append(max(starts[-1] + 1, starts[-1] * 5 // 4))
    return np.array(starts, np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Hashes (uint64) of 64-bit numbers."""
    x = x.view(np.uint64) ^ (x.view(np.uint64) >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(sets: list[np.ndarray], common: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, place of its set in ``sets``): sets that link have one in common.

    Of sizes ``a <= b``, linked sets have ``percent * b <= 100 * a`` and differ in at most ``a * (100 - percent) / percent``
    elements.  Both give signatures for the class of the smaller size, so each set does so for all classes in which the
    smaller one may be.
    """
    n = np.array([len(s) for s in sets], np.int64)
    elements = np.concatenate(sets)
    h, kinds = common
    kind = np.zeros(len(elements), np.int64)
    if len(h):
        at = np.searchsorted(h, elements)
        at[at == len(h)] = 0
        kind = np.where(h[at] == elements, kinds[at], 0).astype(np.int64)
    mixed, start = _mixed(elements), np.cumsum(n) - n
    classes = size_classes(int(n.max()))
    own = np.searchsorted(classes, n, "right") - 1
    least = np.searchsorted(classes, np.maximum(1, -(-percent * n // 100)), "right") - 1
    found, holders = [], []
    for back in range(int((own - least).max()) + 1):
        use = np.flatnonzero(own - back >= least)
        cls = own[use] - back
        differ = (classes[cls + 1] - 1) * (100 - percent) // percent
        groups = differ + 1 + -(-SPARE * differ // 100)
        holder = np.repeat(np.arange(len(use)), n[use])
        place = np.arange(len(holder)) + np.repeat(start[use] - (np.cumsum(n[use]) - n[use]), n[use])
        e = mixed[place]
        group = ((e >> np.uint64(20)) % groups[holder].astype(np.uint64)).astype(np.int64)
        order, run, size = _runs((np.cumsum(groups) - groups)[holder] + group)
        first = np.cumsum(size) - size
        held, group = holder[order][first], group[order][first]
        # What a group holds, whatever its order, and the place of the group.
        whole = np.add.reduceat(e[order], first) + np.uint64(ODD) * ((cls[held] << 32) + group).astype(np.uint64)
        rarest = np.minimum.reduceat(kind[place][order], first)
        ranked = np.lexsort((group, -size, rarest, held))
        by = held[ranked]
        kept = np.arange(len(by)) - np.searchsorted(by, by) <= differ[by]
        found.append(_mixed(whole[ranked][kept]).view(np.int64))
        holders.append(use[by[kept]])
        # Groups without elements come last, and all are one signature.
        short = np.bincount(held, minlength=len(use)) <= differ
        found.append(-1 - cls[short])
        holders.append(use[short])
    return np.concatenate(found), np.concatenate(holders)


def _stars(lows: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each signature's holders to the first holder in its run."""
    starts = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(run) else np.zeros(0, np.int64)
    first = lows[starts[run]]
    pairs = np.unique(np.stack([lows, first], axis=1)[lows != first], axis=0)
    return pairs[:, 0], pairs[:, 1]


STARS = pa.schema([("bucket", pa.int32()), ("h", pa.list_(pa.int64())), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))])


def _edge_blocks(percent: int, buckets: int, common):
    """Signatures by bucket, each with the low digest of one of its holders here; a row of a bucket below 0 has the stars
    among the holders of a chunk."""

    def flush(parts: list[np.ndarray], lows: list[int]) -> Iterator[pa.RecordBatch]:
        h, holder = signatures(parts, common.value, percent)
        low = np.array(lows, np.int64)[holder]
        order, run, size = _runs(h)
        a, b = _stars(low[order], run)
        if len(a):
            cols = [_lists([x]) for x in (np.zeros(0, np.int64), a, b)]
            yield pa.RecordBatch.from_arrays([pa.array([-1 - int(a[0]) % buckets], pa.int32()), *cols], schema=STARS)
        kept = order[np.cumsum(size) - size]
        for batch in _split(h[kept], low[kept], np.zeros(len(kept), np.int64), buckets):
            none = pa.ListArray.from_arrays(pa.array(np.zeros(batch.num_rows + 1, np.int32)), pa.array([], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("h"), batch.column("held"), none], schema=STARS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, lows, size = [], [], 0
        for batch in batches:
            for low, elements in zip(batch.column("low"), batch.column("elements"), strict=True):
                parts.append(elements.values.to_numpy())
                lows.append(low.as_py())
                size += len(parts[-1])
                if size >= CHUNK:
                    yield from flush(parts, lows)
                    parts, lows, size = [], [], 0
        if parts:
            yield from flush(parts, lows)

    return run


def _edges(group: pa.Table) -> pa.Table:
    a = group.column("a").combine_chunks().flatten()
    if group.column("bucket")[0].as_py() < 0:
        return pa.table({"a": a, "b": group.column("b").combine_chunks().flatten()})
    order, run, _ = _runs(group.column("h").combine_chunks().flatten().to_numpy())
    x, y = _stars(a.to_numpy()[order], run)
    return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})


EDGES = "a binary, b binary"


class Tile:
    """Sets in order of size, with signatures; finds a spanning forest of the links among or between them."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.sets, self.percent = sets, percent
        self.n = np.array([len(s) for s in sets], np.int64)
        bits = 1024
        while bits < min(2 * int(self.n.max()), 1 << 16):
            bits *= 2
        marks = np.zeros((len(sets), bits // 8), np.uint8)
        row = np.zeros(bits, np.uint8)
        for i, s in enumerate(sets):
            own = (s.view(np.uint64) % np.uint64(bits)).astype(np.int64)
            row[own] = 1
            marks[i] = np.packbits(row)
            row[own] = 0
        self.marks = marks.view(np.uint64)
        self.tree = np.arange(len(sets))

    def linked(self, i: int, j: int) -> bool:
        small, large = (self.sets[i], self.sets[j]) if len(self.sets[i]) <= len(self.sets[j]) else (self.sets[j], self.sets[i])
        at = np.searchsorted(large, small)
        at[at == len(large)] = 0
        both = int(np.count_nonzero(large[at] == small))
        return 100 * both >= self.percent * (len(small) + len(large) - both)

    def links(self, i: int, others: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links of set i with ``others``, but for those with sets that are connected with it by then."""
        others = others[self.tree[others] != self.tree[i]]
        a, b = self.n[i], self.n[others]
        # 100 * both >= percent * (a + b - both), solved for both.
        need = -(-self.percent * (a + b) // (100 + self.percent))
        fits = np.minimum(a, b) >= need
        others, b, need = others[fits], b[fits], need[fits]
        differ = np.bitwise_count(self.marks[others] ^ self.marks[i]).sum(axis=1, dtype=np.int64)
        for j in others[(a + b - differ) // 2 >= need].tolist():
            if self.tree[j] != self.tree[i] and self.linked(i, j):
                self.tree[self.tree == self.tree[j]] = self.tree[i]
                yield i, j


def _tile_links(percent: int):
    def run(group: pa.Table) -> pa.Table:
        """Tiles of one key: of one pair of bands, or of several small components."""
        group = group.sort_by([("component", "ascending"), ("side", "ascending"), ("n", "ascending"), ("node", "ascending")])
        nodes, sides = group.column("node").to_pylist(), group.column("side").to_numpy()
        sets = [e.values.to_numpy() for e in group.column("elements")]
        comps = group.column("component").to_pylist()
        a, b, at = [], [], 0
        while at < len(comps):
            end = at
            while end < len(comps) and comps[end] == comps[at]:
                end += 1
            tile = Tile(sets[at:end], percent)
            second = int(np.count_nonzero(sides[at:end] == 0))
            for i in range(end - at):
                if second == end - at:
                    others = np.arange(i + 1, end - at)
                else:
                    others = np.arange(second, end - at) if i < second else np.arange(0)
                for x, y in tile.links(i, others):
                    a.append(nodes[at + x])
                    b.append(nodes[at + y])
            at = end
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _banded(nodes: DataFrame, band_elements: int) -> DataFrame:
    """Cut each component, in order of size, into bands of about ``band_elements`` elements: adds ``band`` and ``whole``.

    A set counts some elements more than it has, so that a band of tiny sets stays short.
    """
    weighed = nodes.select("component", "node", "n", (F.col("n") + 512).alias("weight"))
    summed = running_sums(weighed, ["component"], [F.col("n"), F.col("node")], {"weight": "w"})
    return summed.select("component", "node", "n", F.expr(f"(w_run - 1) div {band_elements}").alias("band"), F.col("w_all").alias("whole"))


def linked_documents(
    documents: DataFrame,
    width: int = 5,
    percent: int = 80,
    keep: tuple[str, ...] = (),
    band_elements: int = 1 << 20,
    root: str | None = None,
) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of each row of ``documents``.

    The columns in ``keep`` come too.  A column named ``root`` tells components apart also where all ids are null: the digest
    of one of their sets, null for a row without shingles.
    """
    docs = documents.select("doc_id", *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], "text")
    schema = T.StructType([f for f in docs.schema if f.name != "text"]).add("node", "binary").add("low", "long").add("n", "long")
    members = materialize(docs.mapInArrow(_sets(width), schema), "members")

    spark = documents.sparkSession
    steps = scratch_path(spark, "jaccard")
    total = members.agg(F.sum("n")).first()[0] or 0
    buckets = 1 + int(0.3 * total) // BUCKET
    blocks = docs.select("text").mapInArrow(_prefix_blocks(width, percent, buckets), "bucket int, h array<long>, held array<long>, low array<long>")
    credits = blocks.groupBy("bucket").applyInArrow(_credits, "low long, n_shared long").groupBy("low").agg(F.sum("n_shared").alias("n_shared"))
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / 10))
    # One document stands for each node that may have links.
    chosen = (
        members.where("n > 0").groupBy("node", "low", "n").agg(F.min("doc_id").alias("doc_id"))
        .join(credits, "low")
        .where(F.col("n_shared") >= least)
        .select("doc_id", "node")
    )
    chosen = materialize(chosen, "chosen", steps)
    ids = chosen.select(F.col("doc_id").alias("wanted")).distinct()
    ids = F.broadcast(ids) if is_small(ids, BROADCAST_BYTES) else ids
    wanted = F.col("doc_id").eqNullSafe(F.col("wanted"))
    own = docs.join(ids, wanted, "left_semi").select("text")
    sets = own.mapInArrow(_full_sets(width), "node binary, low long, n long, elements array<long>")
    if members.select("doc_id").join(ids, wanted, "left_semi").count() != chosen.count():
        # Repeated or null ids bring other texts and repeats.
        sets = sets.join(chosen.select("node"), "node", "left_semi").dropDuplicates(["node"])
    sets = materialize(sets, "sets", steps)

    size = sets.agg(F.sum("n")).first()[0] or 0
    common = spark.sparkContext.broadcast(common_elements(sets, 1 + size // BUCKET))
    buckets = 1 + int(0.6 * size) // BUCKET
    blocks = sets.select("low", "elements").mapInArrow(_edge_blocks(percent, buckets, common), "bucket int, h array<long>, a array<long>, b array<long>")
    near = components(blocks.groupBy("bucket").applyInArrow(_edges, "a long, b long"), steps)

    # Nodes of one low digest, if ever there are some, are in one component.
    located = sets.select("node", "low", "n").join(near.select(F.col("node").alias("low"), F.col("root").alias("component")), "low")
    banded = materialize(_banded(located, band_elements), "bands", steps)
    one_band = F.col("whole") <= band_elements
    bands = banded.where(~one_band).groupBy("component", "band").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    # Components of one band share tiles; of the larger, each pair of bands that sizes allow is a tile.
    elements = banded.where(one_band).agg(F.sum("n")).first()[0] or 0
    shared = F.pmod(F.xxhash64("component"), F.lit(1 + elements // band_elements))
    small = banded.where(one_band).select("component", "node", F.concat(F.lit("s"), shared).alias("tile"), F.lit(0).alias("side"))
    x, y = bands.alias("x"), bands.alias("y")
    pairs = x.join(y, (F.col("x.component") == F.col("y.component")) & (F.col("x.band") <= F.col("y.band")) & (F.col("x.most") * 100 >= F.col("y.least") * percent))
    pairs = pairs.select(F.col("x.component").alias("component"), F.col("x.band").alias("i"), F.col("y.band").alias("j"))
    pairs = pairs.withColumn("tile", F.concat_ws("-", F.hex("component"), "i", "j"))
    sides = pairs.select("component", F.col("i").alias("band"), "tile", F.lit(0).alias("side")).unionByName(
        pairs.where("i < j").select("component", F.col("j").alias("band"), "tile", F.lit(1).alias("side"))
    )
    large = banded.where(~one_band).join(sides, ["component", "band"]).select("component", "node", "tile", "side")
    work = sets.join(small.unionByName(large), "node")
    links = work.select("tile", "component", "side", "node", "n", "elements").groupBy("tile").applyInArrow(_tile_links(percent), EDGES)

    roots = components(links, steps)
    firsts = members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    rooted = firsts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = materialize(rooted.join(lowest, "root").select(F.col("node").alias("of"), "component_id", "root"), "classes")
    discard(spark, steps)
    joined = members.join(ids, (F.col("node") == F.col("of")) & (F.col("n") > 0), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    kept = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]
    kept += [F.col("root").alias(root)] if root else []
    return joined.select("doc_id", *kept, F.col("n").alias("n_shingles"), component.alias("component_id"))
