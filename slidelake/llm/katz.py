"""Language-model scores by Katz backoff.

Training counts every n-gram up to ``order``.  A count r gives up ``discount[r]`` of itself, by Good-Turing; what the
n-grams of a context give up is left for words not seen there, shared as the next shorter context would share it.  The
backoff weight of a context makes its probabilities sum to one exactly; at the end of the recursion, what the words give up
is the probability of all unknown words together.

Good-Turing estimates hold for small counts.  Counts above ``LARGE`` give up as much as a count of ``LARGE`` does (Katz
leaves them whole): else a context with large counts alone would leave nothing, and other words would be impossible.  Where
the counts of counts allow no estimate for ``LARGE``, fewer are taken, and a constant half where there is none.

The work is done on blocks of some million tokens, which are written once as word numbers:

1. Each block sends its distinct n-grams (64-bit digests) to shards, which sum the counts and answer with the total, with
   whether a scored text needs the n-gram, and whether this block is the one to speak for it.
2. The counts of counts of all shards give the discounts: a few numbers for each order.
3. With the answers, each block scores its tokens.  Seen n-grams need no more; for others the score lacks the weight of
   the context, which the block asks of the context's shard.  Blocks also send what the n-grams they speak for add to a
   needed context: the mass given up, and the mass that the shorter context gives to its words.
4. A shard has the weights of its contexts and answers with sums for each text.

All tables are partitioned by digest, and every block sends one row for an n-gram however often it has it, so a frequent
word, pair or context is spread over many tasks.  The only global numbers are the counts of counts.

Defined results: a null or empty text is the end token alone; repeated rows are scored and counted each; a null doc_id is
training data; without training texts every token has the probability one of an unknown word; an empty table gives an
empty result.  Columns other than doc_id, text and those named are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidelake.operators.skew import partitions
from slidelake.session import materialize

#: Counts up to which Good-Turing estimates are used.
LARGE = 5
#: Tokens in a block and n-grams in a shard, about.
BLOCK = 1_500_000
SHARD = 1_000_000
#: Bytes of text that are cut into words at once, and the length from which a word is hashed by itself.
WINDOW = 1 << 20
LONG_WORD = 1 << 16

SPACE = re.compile(rb"[\x20\x09-\x0D]")
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no pattern."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


#: A random number for each byte, the same for a letter in either case.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))[np.frombuffer(FOLD, np.uint8)]
BEGIN, END = mix(np.array([11, 13], np.uint64))


class Words:
    """Digests of the words of texts: a polynomial over the bytes of a word, by prefix sums over a whole window."""

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            steps = np.full(n, 1, np.uint64)
            steps[1:] = np.uint64(BASE)
            self.power = np.multiply.accumulate(steps)
            steps[1:] = np.uint64(pow(BASE, -1, 1 << 64))
            self.inverse = np.multiply.accumulate(steps)

    def of_window(self, window: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(digest, start) of the words between white space."""
        raw = np.frombuffer(window, np.uint8)
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = ~IS_SPACE[raw]
        turns = np.diff(inside)
        starts, stops = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        self._powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE[raw] * self.power[: len(raw)], out=sums[1:])
        digests = mix((sums[stops] - sums[starts]) * self.inverse[starts] + (stops - starts).astype(np.uint64))
        for i in np.flatnonzero(stops - starts >= LONG_WORD):
            digests[i] = self.of_long_word(window[starts[i] : stops[i]])
        return digests, starts

    @staticmethod
    def of_long_word(word: bytes) -> np.uint64:
        return np.uint64(int.from_bytes(hashlib.blake2b(word.translate(FOLD), digest_size=8).digest(), "little"))

    def of_text(self, text: bytes) -> Iterator[np.ndarray]:
        """The digests of a text of any length, a window at a time."""
        at = 0
        while at < len(text):
            stop = min(at + WINDOW, len(text))
            end = m.start() if (m := SPACE.search(text, stop)) else len(text)
            if end - stop < LONG_WORD:
                yield self.of_window(text[at:end])[0]
            else:
                head = text[at:stop]
                cut = at + max(head.rfind(bytes([c])) for c in (32, 9, 10, 11, 12, 13)) + 1
                yield self.of_window(text[at:cut])[0]
                yield np.array([self.of_long_word(text[cut:end])], np.uint64)
            at = end

    def of_texts(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the text, digests of its next words), in order; short texts are taken together."""
        first, size = 0, 0
        for i, text in enumerate([*texts, None]):
            if text is not None and size + len(text) <= WINDOW:
                size += len(text) + 1
                continue
            if first < i:
                some = texts[first:i]
                digests, starts = self.of_window(b"\n".join(some))
                bounds = np.cumsum([0, *[len(t) + 1 for t in some]])
                for k, part in enumerate(np.split(digests, np.searchsorted(starts, bounds[1:-1]))):
                    yield first + k, part
            first, size = i, 0
            if text is not None:
                if len(text) > WINDOW:
                    for part in self.of_text(text):
                        yield i, part
                    first = i + 1
                else:
                    size = len(text) + 1


def squeezed(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, those of like weight together."""
    if not len(values):
        return b""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return np.int64(len(values)).tobytes() + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def expanded(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    n, width = int(np.frombuffer(data[:8], np.int64)[0]), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


BLOCKS_DDL = (
    "block long, first_doc long, doc_ids array<{id}>, held array<boolean>, opens array<boolean>, lengths binary, tokens binary, "
    "words binary, train_tokens long, train_texts long"
)


def _blocks(order: int, most: int):
    """Cut texts into tokens and gather them to blocks.

    Each text is one piece of its block; one that is longer than a block goes on as the first piece of the next.  A piece
    begins with the order - 1 tokens before it.
    """
    lead = order - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = Words(), np.zeros(0, np.uint64)
        # Each piece: id, held out, whether it opens its text, its digests.
        pieces: list[tuple] = []
        doc, number, size, base, id_type = -1, 0, 0, 0, None

        def block() -> pa.RecordBatch:
            nonlocal pieces, number, size
            flat = np.concatenate([d for p in pieces for d in p[3]])
            distinct, numbers, counts = np.unique(flat, return_inverse=True, return_counts=True)
            by_count = np.argsort(-counts, kind="stable")
            place = np.empty(len(distinct), np.uint32)
            place[by_count] = np.arange(len(distinct), dtype=np.uint32)
            lengths = np.array([sum(map(len, p[3])) for p in pieces], np.int64)
            learned = np.array([not p[1] for p in pieces])
            columns = [
                pa.array([base + number]),
                pa.array([base + doc - len(pieces) + 1]),
                pa.array([[p[0] for p in pieces]], pa.list_(id_type)),
                pa.array([[p[1] for p in pieces]], pa.list_(pa.bool_())),
                pa.array([[p[2] for p in pieces]], pa.list_(pa.bool_())),
                pa.array([lengths.tobytes()], pa.binary()),
                pa.array([squeezed(place[numbers])], pa.binary()),
                pa.array([squeezed(distinct[by_count])], pa.binary()),
                pa.array([int((lengths - lead)[learned].sum())]),
                pa.array([sum(1 for p in pieces if p[2] and not p[1])]),
            ]
            pieces, number, size = [], number + 1, 0
            return pa.RecordBatch.from_arrays(columns, re.findall(r"(\w+) (?:long|array<[^>]*>|binary)", BLOCKS_DDL))

        def add(doc_id, held: bool, opens: bool, digests: np.ndarray) -> None:
            nonlocal last, size
            if opens:
                last = np.full(lead, BEGIN)
            if opens or not pieces:
                pieces.append((doc_id, held, opens, [last]))
            pieces[-1][3].append(digests)
            last = np.concatenate([last, digests])[len(digests) :]
            size += len(digests)

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            base = batch.column("part")[0].as_py() << 33 if batch.num_rows else base
            ids, held = batch.column("doc_id").to_pylist(), batch.column("held").to_pylist()
            parts = words.of_texts([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
            ahead = next(parts, None)
            for i in range(batch.num_rows):
                doc += 1
                add(ids[i], held[i], True, np.zeros(0, np.uint64))
                while ahead is not None and ahead[0] == i:
                    for at in range(0, len(ahead[1]), most):
                        add(ids[i], held[i], False, ahead[1][at : at + most])
                        if size >= most:
                            yield block()
                    ahead = next(parts, None)
                add(ids[i], held[i], False, np.array([END]))
                if size >= most:
                    yield block()
        if pieces:
            yield block()

    return run


class Grams:
    """The tokens of a block and their n-grams, up to ``order``."""

    def __init__(self, row: dict, order: int) -> None:
        lead = order - 1
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        held, opens = np.array(row["held"]), np.array(row["opens"])
        self.words, self.tokens = expanded(row["words"], np.uint64), expanded(row["tokens"], np.uint32)
        n = len(self.tokens)
        self.piece = np.repeat(np.arange(len(self.lengths)), self.lengths)
        within = np.arange(n) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        #: The tokens that this piece has to score, as against those that are only there as context.
        self.own = within >= lead
        self.held = held[self.piece]
        #: Whether the token before is the beginning of the text.
        self.begun = opens[self.piece] & (within == lead)
        first = mix(self.words)[self.tokens]
        #: By order, the digest of the n-gram that ends at each token; 0 where a piece has less before it.
        self.keys = [np.zeros(n, np.uint64), first]
        for k in range(2, order + 1):
            longer = np.zeros(n, np.uint64)
            longer[1:] = mix(self.keys[-1][:-1] * np.uint64(BASE) + first[1:])
            longer[within < k - 1] = 0
            self.keys.append(longer)
        #: Tokens whose n-gram is whole and isn't the beginning itself.
        real = (self.own | ~opens[self.piece])
        self.whole = [None] + [real & (within >= k - 1) for k in range(1, order + 1)]

    def distinct(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted distinct digests, a place of each, for each whole place the number of its digest)."""
        at = np.flatnonzero(self.whole[k])
        keys = self.keys[k][at]
        by = np.argsort(keys)
        keys = keys[by]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        numbers = np.empty(len(keys), np.int64)
        numbers[by] = np.cumsum(new) - 1
        return keys[new], at[by[new]], numbers


def shard_bounds(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins in sorted digests: equal ranges."""
    edges = (np.arange(shards, dtype=np.float64) * (2.0**64 / shards)).astype(np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


ASKS = pa.schema([("n", pa.int32()), ("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("wanted", pa.binary())])
ASKS_DDL = "n int, shard int, block long, keys binary, counts binary, wanted binary"


def _ask(order: int, shards: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                grams = Grams(row, order)
                for k in range(1, order + 1):
                    keys, _, numbers = grams.distinct(k)
                    at = np.flatnonzero(grams.whole[k])
                    counts = np.bincount(numbers[grams.own[at] & ~grams.held[at]], minlength=len(keys))
                    wanted = np.zeros(len(keys), np.uint8)
                    wanted[numbers[grams.held[at]]] = 1
                    cut = shard_bounds(keys, shards[k])
                    parts = [slice(a, b) for a, b in zip(cut, cut[1:])]
                    used = [(s, p) for s, p in enumerate(parts) if p.stop > p.start]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([k] * len(used), pa.int32()),
                            pa.array([s for s, _ in used], pa.int32()),
                            pa.array([row["block"]] * len(used), pa.int64()),
                            pa.array([keys[p].tobytes() for _, p in used], pa.binary()),
                            pa.array([squeezed(counts[p]) for _, p in used], pa.binary()),
                            pa.array([pa.compress(np.packbits(wanted[p]).tobytes(), "zstd", asbytes=True) for _, p in used], pa.binary()),
                        ],
                        ASKS.names,
                    )

    return run


#: A total is the count times four, plus WANTED and SPEAKS.
WANTED, SPEAKS = 2, 1
TOTALS_DDL = "n int, block long, shard int, totals binary, seen long, " + ", ".join(f"r{r} long" for r in range(1, LARGE + 2))


def _totals(group: pa.Table) -> pa.Table:
    """Sum a shard's counts and answer each block; the first row also has the shard's counts of counts."""
    group = group.sort_by("block")
    rows = group.to_pylist()
    keys = [np.frombuffer(r["keys"], np.uint64) for r in rows]
    counts = [expanded(r["counts"], np.int64) for r in rows]
    wanted = [np.unpackbits(np.frombuffer(pa.decompress(r["wanted"], (len(k) + 7) // 8, "zstd", asbytes=True), np.uint8), count=len(k)) for r, k in zip(rows, keys)]
    distinct, numbers = np.unique(np.concatenate(keys), return_inverse=True)
    flat = np.concatenate(counts)
    total = np.bincount(numbers, flat, len(distinct)).astype(np.int64)
    needed = np.zeros(len(distinct), np.int64)
    needed[numbers[np.concatenate(wanted) > 0]] = WANTED
    # The first block that has it in training data speaks for an n-gram.
    has = np.flatnonzero(flat > 0)
    speaker = np.full(len(distinct), -1, np.int64)
    speaker[numbers[has[::-1]]] = has[::-1]
    answers = total[numbers] * 4 + needed[numbers]
    answers[speaker[speaker >= 0]] += SPEAKS
    answers = np.split(answers, np.cumsum([len(k) for k in keys])[:-1])
    few = np.bincount(np.minimum(total, LARGE + 2), minlength=LARGE + 3)
    stats = [int((total > 0).sum()), *[int(few[r]) for r in range(1, LARGE + 2)]]
    out = {
        "n": pa.array([r["n"] for r in rows], pa.int32()),
        "block": pa.array([r["block"] for r in rows], pa.int64()),
        "shard": pa.array([r["shard"] for r in rows], pa.int32()),
        "totals": pa.array([squeezed(a) for a in answers], pa.binary()),
    }
    for name, value in zip(["seen", *[f"r{r}" for r in range(1, LARGE + 2)]], stats):
        out[name] = pa.array([value] + [0] * (len(rows) - 1), pa.int64())
    return pa.table(out)


def discounts(counts_of_counts: list[int]) -> list[float]:
    """What a count r = 1, 2, ... gives up, the last for all larger ones, from the numbers of n-grams with count 1, 2, ...

    Katz's estimates: with r* = (r + 1) n[r + 1] / n[r], a count keeps the share (r* / r - A) / (1 - A), where
    A = (k + 1) n[k + 1] / n[1] and k is the largest number for which all shares lie between zero and one.
    """
    n = [0, *counts_of_counts]
    for k in range(len(counts_of_counts) - 1, 0, -1):
        if min(n[1 : k + 1]) == 0 or (a := (k + 1) * n[k + 1] / n[1]) >= 1:
            continue
        keeps = [((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) for r in range(1, k + 1)]
        if all(0 < d < 1 for d in keeps):
            return [r * (1 - d) for r, d in enumerate(keeps, 1)]
    return [0.5]


class Model:
    """The global numbers: tokens, words and texts of training, and the discounts of each order."""

    def __init__(self, tokens: int, seen: int, texts: int, counts_of_counts: list[list[int]]) -> None:
        self.tokens, self.seen, self.texts = tokens, seen, texts
        self.give = [None] + [np.array([0.0, *discounts(c)]) for c in counts_of_counts]
        ones = counts_of_counts[0]
        give = self.give[1]
        known = len(give) - 1
        lost = sum(give[r] * ones[r - 1] for r in range(1, known)) + give[known] * (seen - sum(ones[: known - 1]))
        self.unknown = float(lost / tokens) if tokens else 1.0

    def given(self, k: int, counts: np.ndarray) -> np.ndarray:
        return self.give[k][np.minimum(counts, len(self.give[k]) - 1)]


SCORES = pa.schema(
    [
        ("n", pa.int32()),
        ("shard", pa.int32()),
        ("first_doc", pa.int64()),
        *[(c, pa.binary()) for c in ("context", "left", "shorter", "asked", "docs")],
        ("doc", pa.list_(pa.int64())),
        ("n_tokens", pa.list_(pa.int64())),
        ("n_known", pa.list_(pa.int64())),
        ("base_score", pa.list_(pa.float64())),
        ("score", pa.list_(pa.float64())),
    ]
)
SCORES_DDL = (
    "n int, shard int, first_doc long, context binary, left binary, shorter binary, asked binary, docs binary, doc array<long>, "
    "n_tokens array<long>, n_known array<long>, base_score array<double>, score array<double>"
)


def _score(order: int, shards: list[int], model: Model):
    """Score a block with its answers; ask for the weights of contexts, and send what this block knows of them."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        row = next(r for r in rows if r["tokens"] is not None)
        grams = Grams(row, order)
        n = len(grams.tokens)
        counts, flags, firsts = [None], [None], [None]
        for k in range(1, order + 1):
            keys, first, numbers = grams.distinct(k)
            answers = sorted((r["shard"], r["totals"]) for r in rows if r["n"] == k)
            totals = np.concatenate([np.zeros(0, np.int64), *[expanded(t, np.int64) for _, t in answers]])
            at = np.flatnonzero(grams.whole[k])
            each, flag = np.zeros(n, np.int64), np.zeros(n, np.int8)
            each[at], flag[at] = (totals >> 2)[numbers], (totals & WANTED)[numbers]
            counts.append(each)
            flags.append(flag)
            firsts.append(first[(totals & SPEAKS) > 0])
        before = lambda a: np.concatenate([a[:1] * 0, a[:-1]])
        # Per order, the probability of the token if its n-gram is seen, and how often its context is.
        with np.errstate(divide="ignore", invalid="ignore"):
            prob, room = [None, (counts[1] - model.given(1, counts[1])) / max(model.tokens, 1)], [None, None]
            for k in range(2, order + 1):
                held_by = np.where(grams.begun, model.texts, before(counts[k - 1]))
                room.append(held_by)
                prob.append((counts[k] - model.given(k, counts[k])) / held_by)
            own = np.flatnonzero(grams.own)
            seen = counts[1][own] > 0
            logs = np.where(seen, np.log10(prob[1][own], where=seen, out=np.zeros(len(own))), np.log10(model.unknown))
            wants = []
            done = np.zeros(len(own), bool)
            for k in range(order, 1, -1):
                hit = ~done & (counts[k][own] > 0)
                logs[hit] = np.log10(prob[k][own[hit]])
                done |= hit
                wants.append((k, own[~done & (room[k][own] > 0)]))
            base = np.log10((counts[1][own] + 0.5) / (model.tokens + 0.5 * (model.seen + 1)))
        out: list[dict] = []
        # Each piece is the next text; the first may go on with the last text of the block before.
        piece, docs = grams.piece[own], len(grams.lengths)
        per = lambda w: np.bincount(piece, w, docs)
        out.append(
            {
                "n": 0,
                "shard": row["block"] % shards[0],
                "first_doc": row["first_doc"],
                "doc": (row["first_doc"] + np.arange(docs)).tolist(),
                "n_tokens": per(None).astype(np.int64).tolist(),
                "n_known": per(seen.astype(float)).astype(np.int64).tolist(),
                "base_score": per(base).tolist(),
                "score": per(logs).tolist(),
            }
        )
        for k, asking in wants:
            at = firsts[k]
            at = at[(before(flags[k - 1])[at] > 0) | grams.begun[at]]
            context = before(grams.keys[k - 1])
            left, shorter = model.given(k, counts[k][at]) / room[k][at], prob[k - 1][at]
            keys, numbers = np.unique(context[at], return_inverse=True)
            left, shorter = [np.bincount(numbers, w, len(keys)) for w in (left, shorter)]
            asked, doc = context[asking], grams.piece[asking].astype(np.uint32)
            by = np.argsort(asked, kind="stable")
            asked, doc = asked[by], doc[by]
            cut, cut_asked = shard_bounds(keys, shards[k]), shard_bounds(asked, shards[k])
            for s in range(shards[k]):
                p, q = slice(cut[s], cut[s + 1]), slice(cut_asked[s], cut_asked[s + 1])
                if p.stop > p.start or q.stop > q.start:
                    out.append(
                        {
                            "n": k,
                            "shard": s,
                            "first_doc": row["first_doc"],
                            "context": keys[p].tobytes(),
                            "left": left[p].tobytes(),
                            "shorter": shorter[p].tobytes(),
                            "asked": asked[q].tobytes(),
                            "docs": squeezed(doc[q]),
                        }
                    )
        return pa.Table.from_pylist(out, SCORES)

    return run


WEIGHED_DDL = "doc array<long>, n_tokens array<long>, n_known array<long>, base_score array<double>, score array<double>"
WEIGHED = pa.schema([SCORES.field(c) for c in ("doc", "n_tokens", "n_known", "base_score", "score")])


def _weigh(key: tuple, group: pa.Table) -> pa.Table:
    """The logarithms of a shard's backoff weights, summed for each text that asks; finished scores pass through."""
    if key[0].as_py() == 0:
        return group.select(WEIGHED.names)
    rows = group.to_pylist()
    cat = lambda c, kind: np.concatenate([np.frombuffer(r[c], kind) for r in rows])
    keys, numbers = np.unique(cat("context", np.uint64), return_inverse=True)
    left, shorter = [np.bincount(numbers, cat(c, np.float64), len(keys)) for c in ("left", "shorter")]
    weight = np.log10(left) - np.log10(np.maximum(1 - shorter, 1e-300))
    out = []
    for r in rows:
        asked, docs = np.frombuffer(r["asked"], np.uint64), expanded(r["docs"], np.uint32)
        if len(asked):
            some, at = np.unique(docs, return_inverse=True)
            sums = np.bincount(at, weight[np.searchsorted(keys, asked)], len(some))
            none = [0] * len(some)
            out.append({"doc": (r["first_doc"] + some.astype(np.int64)).tolist(), "n_tokens": none, "n_known": none, "base_score": [0.0] * len(some), "score": sums.tolist()})
    return pa.Table.from_pylist(out, WEIGHED)


def katz_scores(documents: DataFrame, held_out: Column, order: int = 2, block_tokens: int = BLOCK) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows for which ``held_out`` is true are scored only, all others are also learned from.  ``score`` is the log10
    probability of the text under the model; ``base_score`` that of single words with half a count added to each.
    """
    held = F.coalesce(held_out, F.lit(False)).alias("held")
    rows = documents.select("doc_id", held, "text", F.spark_partition_id().alias("part"))
    ddl = BLOCKS_DDL.format(id=documents.schema["doc_id"].dataType.simpleString())
    blocks = materialize(rows.mapInArrow(_blocks(order, block_tokens), ddl), "blocks")
    number, tokens, texts = blocks.agg(F.count(F.lit(1)), F.sum("train_tokens"), F.sum("train_texts")).first()

    least = partitions(blocks)
    shards = [least] + [max(least, number * block_tokens // SHARD)] * order
    asks = blocks.mapInArrow(_ask(order, shards), ASKS_DDL)
    totals = materialize(asks.groupBy("n", "shard").applyInArrow(_totals, TOTALS_DDL), "totals")
    names = ["seen", *[f"r{r}" for r in range(1, LARGE + 2)]]
    # One row for each order.
    found = {x.n: x for x in totals.groupBy("n").agg(*[F.sum(c).alias(c) for c in names]).collect()}
    counts_of_counts = [[found[k][c] if k in found else 0 for c in names[1:]] for k in range(1, order + 1)]
    model = Model(tokens or 0, found[1].seen if found else 0, texts or 0, counts_of_counts)

    asked = blocks.select("block", "first_doc", "held", "opens", "lengths", "tokens", "words")
    answered = asked.unionByName(totals.select("n", "block", "shard", "totals"), allowMissingColumns=True)
    scored = answered.groupBy("block").applyInArrow(_score(order, shards, model), SCORES_DDL)
    sums = ("n_tokens", "n_known", "base_score", "score")
    weighed = scored.groupBy("n", "shard").applyInArrow(_weigh, WEIGHED_DDL)
    weighed = weighed.select(F.inline(F.arrays_zip("doc", *sums))).groupBy("doc").agg(*[F.sum(c).alias(c) for c in sums])
    pieces = blocks.select("first_doc", F.posexplode(F.arrays_zip("doc_ids", "held", "opens")).alias("at", "piece")).where("piece.opens")
    named = pieces.select((F.col("first_doc") + F.col("at")).alias("doc"), F.col("piece.doc_ids").alias("doc_id"), F.col("piece.held").alias("held_out"))
    return named.join(weighed, "doc").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
