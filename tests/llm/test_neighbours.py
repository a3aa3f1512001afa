"""Recall, scores and edge cases of the search against brute force."""

import os

import numpy as np
import pyarrow as pa
import pytest

from slidelake.llm.neighbours import _rerank, balanced_parts, neighbour_graph, nearest, unit
from pyspark.sql import functions as F

KIND = "vec_id long, embedding array<float>, id string, v int"


def brute(rows, k, every):
    good = []
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.append((i, np.array(v, np.float32).astype(float)))
    out = {}
    for i, v in good:
        if i % every == 0:
            scored = sorted((-float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), j) for j, w in good if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        got = out.setdefault(r.query_id, [])
        got.append((r.vec_id, r.score))
        assert r["rank"] == len(got)
    return out


def test_recall_with_learned_parts(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(6000, 24)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], KIND)
    got = answers(nearest(df, F.col("vec_id") % 50 == 0, sample_rows=2048, part_rows=500, chunk=300))
    want = brute(rows, 5, 50)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want)
    assert hits / (5 * len(want)) >= 0.9
    exact = {(i, j): s for i, found in got.items() for j, s in found}
    for (i, j), s in exact.items():
        a, b = x[i].astype(float), x[j].astype(float)
        assert abs(s - a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)) < 1e-12


@pytest.mark.parametrize("chunk", [4096, 3])
def test_edges_and_copies(spark, chunk):
    one = [1.0, 2.0, 3.0]
    rows = [(i, one) for i in range(0, 40)] + [(100, [2.0, 4.0, 6.0]), (150, [1.0, 0.0, 0.0]), (200, [0.0, 1.0, 0.0])]
    rows += [(250, None), (300, []), (350, [0.0, 0.0, 0.0]), (400, [1.0, None, 1.0]), (450, [float("nan"), 1.0, 1.0])]
    rows += [(500, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (550, [1.0, 2.0]), (600, [-1.0, -2.0, -3.0]), (601, [-0.0, 0.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], KIND)
    got = answers(nearest(df, F.col("vec_id") % 50 == 0, chunk=chunk))
    want = brute([r for r in rows if r[0] != 550], 5, 50)
    assert set(got) == set(want)
    assert [j for j, _ in got[0]] == [1, 2, 3, 4, 5]
    for i in want:
        assert np.allclose([s for _, s in got[i]], [s for _, s in want[i]], atol=1e-12)
    few = answers(nearest(df.where("vec_id in (100, 150, 200)"), F.col("vec_id") % 50 == 0))
    assert {i: len(v) for i, v in few.items()} == {100: 2, 150: 2, 200: 2}
    assert nearest(df.where("vec_id = 100"), F.col("vec_id") % 50 == 0).collect() == []
    assert nearest(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_parts_are_balanced():
    x = unit(np.random.default_rng(1).normal(size=(1000, 16)))
    sizes = np.bincount(balanced_parts(x, neighbour_graph(x, 10), 7), minlength=7)
    assert sizes.sum() == 1000 and sizes.max() <= 1.1 * 1000 / 7 + 1


def test_ties_of_different_vectors(spark):
    """All vectors but one have the same cosine with the query; the smallest ids win."""
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [0.0, 2.0**-i, 0.0]) for i in range(1, 100)] + [(1000 + i, [0.0, 0.0, 2.0**-i]) for i in range(100)]
    for turn in (rows, rows[::-1]):
        chunk = pa.table({"id": [i for i, _ in turn], "v": [v for _, v in turn]})
        assert sorted(_rerank(6)(chunk.slice(turn.index(rows[0]), 1), chunk)["id"].to_pylist()) == [0, 1, 2, 3, 4, 5]
        df = spark.createDataFrame([(i, v, "x", 1) for i, v in turn], KIND)
        got = answers(nearest(df, F.col("vec_id") % 50 == 0, sample_rows=64))
        assert [j for j, _ in got[0]] == [1, 2, 3, 4, 5] and [j for j, _ in got[50]] == [1, 2, 3, 4, 5]
        assert [j for j, _ in got[1050]] == [1000, 1001, 1002, 1003, 1004]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_of_the_registered_query(spark, sf_dir, sf, monkeypatch):
    """The small tables go through the router as well."""
    from slidelake.llm import neighbours
    from slidelake.llm.queries import op5_nearest

    made, fit = [], neighbours.fit_router
    monkeypatch.setattr(neighbours, "fit_router", lambda x, parts, *a: made.append((parts, fit(x, parts, *a))) or made[-1][1])
    folder = f"{os.path.dirname(sf_dir)}/{sf}"
    got = answers(op5_nearest(spark, folder))
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = brute(rows, 5, 50)
    assert [parts for parts, _ in made] == [min(8, len({tuple(v) for _, v in rows}) // 64)]
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want)
    print(sf, "parts, visited:", made[0][0], made[0][1].probes, "recall:", hits, "of", 5 * len(want))
    assert hits / (5 * len(want)) >= 0.9
