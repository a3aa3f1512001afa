"""Katz backoff against a model of dictionaries, which also shows that probabilities sum to one."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidelake.llm import katz
from slidelake.llm.katz import Words, discounts, katz_scores

FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def tokens_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(FOLD)) if w] + [None]


class PlainKatz:
    def __init__(self, texts, order):
        self.order = order
        self.counts = [Counter() for _ in range(order + 1)]
        for text in texts:
            t = ["<s>"] * (order - 1) + tokens_of(text)
            for i in range(order - 1, len(t)):
                for k in range(1, order + 1):
                    self.counts[k][tuple(t[i - k + 1 : i + 1])] += 1
        self.n = sum(self.counts[1].values())
        self.give = [None]
        self.after = [None] + [defaultdict(dict) for _ in range(order)]
        for k in range(1, order + 1):
            of = Counter(self.counts[k].values())
            self.give.append(discounts([of[r] for r in range(1, katz.LARGE + 2)]))
            for g, c in self.counts[k].items():
                self.after[k][g[:-1]][g[-1]] = c
        self.unknown = sum(self.given(1, c) for c in self.counts[1].values()) / self.n if self.n else 1.0

    def given(self, k, c):
        return self.give[k][min(c, len(self.give[k])) - 1]

    def prob(self, context, word):
        k = len(context) + 1
        seen = self.after[k].get(context)
        if k == 1:
            return (seen[word] - self.given(1, seen[word])) / self.n if seen and word in seen else self.unknown
        if not seen:
            return self.prob(context[1:], word)
        total = sum(seen.values())
        if word in seen:
            return (seen[word] - self.given(k, seen[word])) / total
        left = sum(self.given(k, c) for c in seen.values()) / total
        return left / (1 - sum(self.prob(context[1:], w) for w in seen)) * self.prob(context[1:], word)

    def score(self, text):
        t = ["<s>"] * (self.order - 1) + tokens_of(text)
        return sum(math.log10(self.prob(tuple(t[i - self.order + 1 : i]), t[i])) for i in range(self.order - 1, len(t)))


def rows_of(n):
    r = random.Random(n)
    vocabulary = ["the", "The", "of", "a", "é", "Été"] + [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = [(i, " ".join(r.choices(vocabulary, weights, k=r.randint(1, 40))) + r.choice(["", "\n", "\tx"])) for i in range(n)]
    rows += [(n + i, "the same text in many rows of a\x0btable") for i in range(n // 3)]
    return rows + [(None, "the of"), (None, None), (5, rows[5][1]), (7, ""), (8, " \n "), (9, "the of " * 700 + "W3 w" * 50)]


@pytest.mark.parametrize(("order", "block"), [(1, 3_000_000), (2, 3_000_000), (3, 500), (2, 37)])
def test_scores_equal_the_plain_model(spark, order, block):
    rows = rows_of(150)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    model = PlainKatz([t for i, t in rows if not held(i)], order)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in ("block", "part", "held", "doc", "score")})
    got = katz_scores(df, F.crc32(F.col("doc_id").cast("string")) % 5 == 1, order, block).collect()
    v, ones = len(model.counts[1]), {g[0]: c for g, c in model.counts[1].items()}
    want = []
    for i, t in rows:
        toks = tokens_of(t)
        base = sum(math.log10((ones.get(w, 0) + 0.5) / (model.n + 0.5 * (v + 1))) for w in toks)
        want.append((str(i), held(i), len(toks), sum(w in ones for w in toks), model.n, base, model.score(t)))
    have = [(str(r.doc_id), *r[1:]) for r in got]
    assert len(have) == len(want)
    for a, b in zip(sorted(have, key=lambda x: (x[0], x[2], round(x[5], 6))), sorted(want, key=lambda x: (x[0], x[2], round(x[5], 6)))):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_plain_model_sums_to_one(order):
    model = PlainKatz([t for _, t in rows_of(60)], order)
    words = [g[0] for g in model.counts[1]] + ["never seen"]
    for context in list(model.after[order])[:200] + [("never",) * (order - 1)]:
        assert sum(model.prob(context, w) for w in words) == pytest.approx(1, abs=1e-9)


def test_edges(spark):
    schema = "doc_id long, text string"
    assert katz_scores(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    # Nothing to learn from: every token is an unknown word.
    (r,) = katz_scores(spark.createDataFrame([(1, "a b")], schema), F.lit(True)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    # Equal texts only: no counts of counts to estimate from, yet no word is impossible.
    rows = [(i, "x y") for i in range(50)] + [(100, "x z")]
    got = {r.doc_id: r for r in katz_scores(spark.createDataFrame(rows, schema), F.col("doc_id") == 100).collect()}
    assert -math.inf < got[100].score < got[1].score < 0


def test_discounts():
    assert discounts([0, 0, 0, 0, 0, 0]) == [0.5] and discounts([5, 0, 0, 0, 0, 0]) == [0.5]
    give = discounts([1000, 300, 140, 80, 50, 35])
    assert len(give) == 5 and all(0 < g < r for r, g in enumerate(give, 1))
    # What is given up by Good-Turing's own rule: the number of n-grams seen once.
    assert sum(g * n for g, n in zip(give, [1000, 300, 140, 80, 50])) == pytest.approx(1000)


def test_words_of_any_length_and_window():
    words = Words()
    one = lambda w: int(np.concatenate([d for _, d in words.of_texts([w])])[0])
    long, longer = b"Ab" * 40_000, b"q" * 3_000_000
    text = b" ".join([b"first"] * 200_000 + [long] + [b"x"] * 400_000 + [longer, b"last"])
    got = np.concatenate([d for _, d in words.of_texts([b"", b"zero", text, b" \n", b"end"])])
    want = [one(b"zero")] + [one(b"FIRST")] * 200_000 + [one(long.lower())] + [one(b"X")] * 400_000 + [one(longer), one(b"last"), one(b"end")]
    assert got.tolist() == want
    assert len({one(w) for w in (b"ab", b"ba", b"a", b"b", b"aa", b"a\x00", b"\x00", b"\x00\x00")}) == 8
