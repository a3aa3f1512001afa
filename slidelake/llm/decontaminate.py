"""Benchmark decontamination with a generalised suffix automaton over words.

Text is lower-cased in A-Z and cut into words (digits, letters and every character from U+0080).  The automaton holds
all words sequences of the normalised test items; a document is streamed through it word by word, which gives the
longest item passage ending at each word.  A window is ``window`` consecutive words of an item, or the whole item where
it is shorter.  A document word inside any occurrence of a window is hit, and a document whose hit words reach the share
``coverage`` is contaminated.  ``cleaned=True`` also returns the text without its hit spans.

A numpy pass first finds the runs of words whose neighbouring pairs all occur in items; only there can a window occur,
and only those runs are streamed.

The items are the small side.  Usually they are one automaton of ``group_chars`` characters at most, which is broadcast, and
the documents are judged in one pass without a shuffle.  More items are cut into groups by hash, an id with very much text
into several; each group is an automaton of its own and a job of its own over the documents, which are written once for
that.  A pass leaves a row for each document in which it finds something, and these are merged by document.  So neither the
driver nor a task ever holds more than one group, however many items there are.

Defined results: a null or empty text has no words and is not contaminated; items without an id or without words are
ignored; repeated items count once; repeated documents are judged alike; empty tables give empty or unhit results.
Columns of ``documents`` other than those in ``keep`` and the text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slidelake.session import materialize

#: Every byte to itself, in lower case, or to a space where it parts words.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
PAIR_BITS = 20
SPANS = "array<struct<first:bigint,last:bigint>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class SuffixAutomaton:
    """All word sequences of several items; ``report`` names the nearest state on the way to the root with windows."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.windows: dict[int, dict[int, list[str]]] = {}
        self.report: list[int] = []

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state for the longest sequence that ``p`` reaches by ``word``, parted from ``q``."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        state = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return state

    def add(self, words: list[int]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def mark(self, item: str, words: list[int], window: int) -> None:
        """File ``item`` under the states of its windows; after all items were added."""
        size, state = min(window, len(words)), 0
        for i, w in enumerate(words):
            state = self.next[state][w]
            while self.length[self.link[state]] >= size:
                state = self.link[state]
            if i + 1 >= size:
                items = self.windows.setdefault(state, {}).setdefault(size, [])
                if not items or items[-1] != item:
                    items.append(item)

    def close(self) -> None:
        self.report = [0] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.report[s] = s if s in self.windows else self.report[self.link[s]]

    def matches(self, words: list[int]) -> Iterator[tuple[int, int, list[str]]]:
        """(first, last, items) for every window that ends at a word of the stream."""
        state = run = 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                run += 1
            r = self.report[state]
            while r:
                for size, items in self.windows[r].items():
                    if size <= run:
                        yield i - size + 1, i, items
                r = self.report[self.link[r]]


class ItemIndex:
    """The automaton of one group of items with what the prefilter needs."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.automaton = SuffixAutomaton()
        ids = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]) for item, text in items]
        for _, words in ids:
            self.automaton.add(words)
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        for item, words in ids:
            if words:
                self.automaton.mark(item, words, window)
                self.pairs[self._pair(np.array(words, np.int64))] = True
        self.automaton.close()
        self.least = min([min(window, len(w)) for _, w in ids if w], default=0)

    @staticmethod
    def _pair(ids: np.ndarray) -> np.ndarray:
        mixed = (ids[:-1] * 0x9E3779B1 + ids[1:]) * 0x85EBCA6B
        return (mixed >> 7) & ((1 << PAIR_BITS) - 1)

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        if not self.least or len(words) < self.least:
            return
        ids = np.array(list(map(self.vocabulary.get, words, repeat(-1))), np.int64)
        known = ids >= 0
        # joined[i]: words i and i + 1 may follow each other in an item.
        joined = known[:-1] & known[1:]
        joined &= self.pairs[self._pair(ids)]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], joined, [False])).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        if self.least == 1:
            alone = known.copy()
            alone[:-1] &= ~joined
            alone[1:] &= ~joined
            starts = np.concatenate([starts, np.flatnonzero(alone)])
            ends = np.concatenate([ends, np.flatnonzero(alone)])
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a + 1 >= self.least:
                for first, last, items in self.automaton.matches(ids[a : b + 1].tolist()):
                    yield a + first, a + last, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of ``spans`` and what stands between them."""
    at = [m.span() for m in WORD.finditer(text)]
    out, done = [], 0
    for first, last in spans:
        out.append(text[done : at[first][0]])
        done = at[last][1]
    return b"".join([*out, text[done:]])


def _matcher(index, text: str):
    """One pass: add what one group of items finds to ``spans`` and ``items``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            cols = list(batch.columns)
            counts, spans, items = [], [], []
            for t, s, k in zip(cols[at[text]].cast(pa.binary()), cols[at["spans"]].to_pylist(), cols[at["items"]].to_pylist(), strict=True):
                words = words_of(t.as_py())
                counts.append(len(words))
                found, names = [], set(k)
                for first, last, who in own.matches(words):
                    found.append((first, last))
                    names.update(who)
                if found:
                    s = [{"first": a, "last": b} for a, b in merged([*((x["first"], x["last"]) for x in s), *found])]
                spans.append(s)
                items.append(sorted(names))
            kind = batch.schema.field("spans").type
            cols[at["n_words"]] = pa.array(counts, pa.int64())
            cols[at["spans"]] = pa.array(spans, kind)
            cols[at["items"]] = pa.array(items, batch.schema.field("items").type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return run


def _merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put together what several passes found in a document."""
    for batch in batches:
        i, j = batch.schema.get_field_index("spans"), batch.schema.get_field_index("items")
        spans = [merged([(x["first"], x["last"]) for x in s]) for s in batch.column(i).to_pylist()]
        spans = pa.array([[{"first": a, "last": b} for a, b in s] for s in spans], batch.schema.field(i).type)
        items = pa.array([sorted(set(k)) for k in batch.column(j).to_pylist()], batch.schema.field(j).type)
        yield batch.set_column(i, batch.schema.field(i), spans).set_column(j, batch.schema.field(j), items)


def _in_passes(base: DataFrame, text: str, groups: int, index_of) -> DataFrame:
    """``base`` with what each of several groups of items finds: one job for each group, one after another."""
    numbered = materialize(base.withColumn("__row", F.monotonically_increasing_id()), "documents")
    narrow = numbered.select("__row", F.col(text).alias("__text"), "n_words", "spans", "items")
    finds = None
    for g in range(groups):
        index = index_of(g)
        part = narrow.mapInArrow(_matcher(index, "__text"), narrow.schema).drop("__text")
        # The first pass counts the words of every document.
        part = materialize(part if g == 0 else part.where(F.size("spans") > 0), "pass")
        index.destroy()
        finds = part if finds is None else finds.unionByName(part)
    whole = finds.groupBy("__row").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items")
    )
    whole = whole.mapInArrow(_merger, whole.schema)
    return numbered.drop("n_words", "spans", "items").join(whole, "__row").select(base.columns)


def _cleaner(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text)
            texts, spans = batch.column(i).to_pylist(), batch.column("spans").to_pylist()
            cut = [without_spans(t.encode(), [(x["first"], x["last"]) for x in s]).decode() if s else t for t, s in zip(texts, spans, strict=True)]
            yield batch.set_column(i, batch.schema.field(i), pa.array(cut, batch.schema.field(i).type))

    return run


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    window: int = 13,
    coverage: float = 0.05,
    group_chars: int = 2_000_000,
    cleaned: bool = False,
) -> DataFrame:
    """``keep`` columns with n_words, n_hit, spans (word numbers), items (ids, sorted as strings) and contaminated.

    With ``cleaned`` the text comes too, without its hit spans.
    """
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("t")).where("item is not null and t is not null")
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    groups = max(1, -(-chars // group_chars))
    base = documents.select(*keep, *([] if text in keep else [text])).withColumns(
        {"n_words": F.lit(0).cast("long"), "spans": F.array().cast(SPANS), "items": F.array().cast("array<string>")}
    )
    group = F.pmod(F.xxhash64("item", "t"), F.lit(groups))

    def index_of(g: int):
        rows = items.where(group == g).distinct().collect()
        return spark.sparkContext.broadcast(ItemIndex(sorted((r.item, r.t.encode()) for r in rows), window))

    if groups == 1:
        found = base.mapInArrow(_matcher(index_of(0), text), base.schema)
    else:
        found = _in_passes(base, text, groups, index_of)
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    found = found.withColumn("n_hit", hits)
    # In whole numbers: n_hit / n_words reaches the share exactly.
    share = F.lit(round(coverage * 1_000_000))
    found = found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 1_000_000 >= share * F.col("n_words")))
    out = [*keep, "n_words", "n_hit", "spans", "items", "contaminated"]
    if cleaned:
        found = found.mapInArrow(_cleaner(text), T.StructType(found.schema.fields))
        out += [text] if text not in keep else []
    return found.select(*out)
