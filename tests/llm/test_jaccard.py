"""The exact join against all pairs of plain Python sets."""

import os
import random

import numpy as np
import pytest

from slidelake.llm import jaccard
from slidelake.llm.jaccard import linked_documents


def brute(rows):
    sets = []
    for _, text in rows:
        w = (text or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})).encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    tree = list(range(len(rows)))

    def top(i):
        while tree[i] != i:
            i = tree[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                tree[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(d, low.get(top(i), d))
    return sorted(((d, len(s), low.get(top(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def made_rows():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 6)))
    base = [word() for _ in range(300)]
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(120):  # near copies at all distances round the threshold
        w = list(base)
        for _ in range(i // 8):
            w[r.randrange(len(w))] = word()
        rows.append(" ".join(w))
    for _ in range(60):  # unrelated texts with a common passage
        rows.append(" ".join([word() for _ in range(r.randint(20, 90))] + passage))
    for n in range(1, 12):  # short texts and their extensions
        rows += [" ".join(base[:n]), " ".join(base[:n]).upper(), "  ".join(base[: n + 1])]
    rows += ["", "   ", "\n", None, None, "a", "A", "a a a a a a a a", "é è é è é", "É è é è é", " ".join(base * 40), " ".join(base * 40 + ["end"])]
    out = [(i, t) for i, t in enumerate(rows)]
    return out + [(3, rows[3]), (3, rows[70]), (None, rows[5]), (None, None), (None, "only here and only once")]


@pytest.mark.parametrize("band", [1 << 20, 4000])
def test_matches_all_pairs(spark, band):
    rows = made_rows()
    df = spark.createDataFrame([(d, t, d, t, 1) for d, t in rows], "doc_id long, text string, node long, component string, n int")
    got = sorted((tuple(r) for r in linked_documents(df, band_elements=band).collect()), key=str)
    assert got == brute(rows)


def test_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted((tuple(r) for r in linked_documents(df).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_empty(spark):
    assert linked_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_quoted_passages_hold_no_component_together(spark, monkeypatch):
    """Families of near copies quote each other; tiles copy a component as often as it has bands, so it must stay a family."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    passages = [[word() for _ in range(12)] for _ in range(120)]
    rows = []
    for f in range(60):
        base = [word() for _ in range(200)]
        for i in (f, (f + 1) % 60, 60 + f, 60 + (f + 7) % 60):  # each in two families
            base += passages[i]
        rows += [" ".join(base), " ".join([*base[:100], word(), *base[101:]]), " ".join(base[:-1])]
    sizes, banded = [], jaccard._banded

    def seen(nodes, band_elements):
        sizes.extend(n for (n,) in nodes.groupBy("component").count().select("count").collect())
        return banded(nodes, band_elements)

    monkeypatch.setattr(jaccard, "_banded", seen)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = sorted(tuple(r) for r in linked_documents(df).collect())
    assert [c for _, _, c in got] == [d // 3 * 3 for d in range(180)]
    assert sum(sizes) == 180 and max(sizes) <= 9


@pytest.mark.parametrize("percent", [50, 80, 95, 100])
def test_linked_sets_have_a_signature_in_common(percent):
    r = np.random.default_rng(percent)
    draw = lambda n: r.integers(-(1 << 63), 1 << 63, n)
    common = np.sort(draw(40))
    pairs = []
    for n in [*range(1, 60), 127, 400, 2000]:
        both, rest = np.concatenate([draw(n), common[: n // 3]]), draw(n)
        for a_only in range(0, n // 2 + 1, max(1, n // 12)):
            for b_only in {0, a_only, n // 4}:
                a, b = np.unique(np.append(both, rest[:a_only])), np.unique(np.append(both, rest[n - b_only :]))
                i, u = len(np.intersect1d(a, b)), len(np.union1d(a, b))
                if 100 * i >= percent * u:
                    pairs.append((a, b))
    kinds = (common, np.arange(40, dtype=np.int8) % 5 + 4)
    one = lambda x: set(jaccard.signatures([x], kinds, percent)[0].tolist())
    assert pairs and all(one(a) & one(b) for a, b in pairs)
    # Sets give the same signatures in company.
    sets = [x for pair in pairs[:20] for x in pair]
    h, holder = jaccard.signatures(sets, kinds, percent)
    assert all(set(h[holder == i].tolist()) == one(x) for i, x in enumerate(sets))


def test_steps_are_removed(spark):
    df = spark.createDataFrame([(i, " ".join(["a b c d e f g h"] * 3) + f" {i % 4} z") for i in range(40)], "doc_id long, text string")
    out = linked_documents(df)
    folder = spark.conf.get("slidelake.scratch").removeprefix("file://")
    before = set(os.listdir(folder))
    linked_documents(df)
    assert {n.split("-")[0] for n in set(os.listdir(folder)) - before} == {"members", "running", "classes"}
    assert out.count() == 40
