"""The k-th row of each group, against sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from slidelake.operators import selection
from slidelake.operators.pooling import topk_softmax_pool
from slidelake.operators.selection import kth_rows

SCHEMA = "g string, v double, id bigint"


def expected(data, wants, descending):
    out = {}
    for g, k in wants:
        sign = -1 if descending else 1
        rank = lambda v: (sign, 0.0) if math.isnan(v) else (0, sign * v)
        rows = sorted((rank(v), i, v) for h, v, i in data if h == g and v is not None)
        if 1 <= k <= len(rows):
            out[g, k] = (rows[k - 1][2], rows[k - 1][1])
    return out


def values(rng, kind, n):
    if kind == "spread":
        return [rng.choice([-1, 1]) * 2.0 ** rng.randint(-1074, 1023) for _ in range(n)]
    if kind == "odd":
        return [rng.choice([0.0, -0.0, math.inf, -math.inf, math.nan, 1.7e308, -1.7e308, 5e-324]) for _ in range(n)]
    if kind == "near":
        return [1e9 + rng.randint(0, 50) * 1e-7 for _ in range(n)]
    if kind == "equal":
        return [3.0] * n
    return [rng.gauss(0, 1) for _ in range(n)]


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("few,buckets", [(3, 4), (50, 1024), (10**6, 1024)])
def test_equal_to_sorting(spark, descending, few, buckets):
    rng = random.Random(5)
    data, wants = [], []
    for kind in ("spread", "odd", "near", "equal", "gauss", None):
        n = 200
        data += [(kind, v, i) for i, v in enumerate(values(rng, kind, n))] + [(kind, None, -1)]
        wants += [(kind, k) for k in {0, 1, 2, n // 3, n // 2, n - 1, n, n + 1}]
    rows = spark.createDataFrame(data, SCHEMA).repartition(5)
    asked = spark.createDataFrame(wants, "g string, k int").withColumn("note", F.concat(F.lit("n"), "k"))
    got = kth_rows(rows, asked, ["g"], "v", "id", descending, few, buckets).collect()
    assert all(r["note"] == f"n{r['k']}" for r in got)
    result = {(r["g"], r["k"]): (r["v"], r["id"]) for r in got}
    right = expected(data, wants, descending)
    assert set(result) == set(right)
    for at, (v, i) in right.items():
        assert result[at][1] == i and (result[at][0] == v or math.isnan(v) and math.isnan(result[at][0])), at


def test_no_keys_and_no_rows(spark):
    rows = spark.createDataFrame([("a", float(i % 7), i) for i in range(100)], SCHEMA)
    asked = spark.createDataFrame([(50,)], "k int")
    assert tuple(kth_rows(rows, asked, [], "v", "id", few=5).first()) == (50, 3.0, 38)
    assert kth_rows(rows.where("false"), asked, [], "v", "id").count() == 0
    assert kth_rows(rows, asked.where("false"), [], "v", "id").count() == 0


def test_pooling_is_the_same_by_counts_and_by_sorting(spark, monkeypatch):
    rng = random.Random(1)
    data = [(rng.choice([1, 1, 1, 2, None]), i, rng.choice([None, rng.random(), 0.5]), [rng.random(), 1.0]) for i in range(900)]
    df = spark.createDataFrame(data, "bag int, id bigint, s double, feat array<double>")

    def pooled():
        return {r["bag"]: (r["k"], [round(x, 9) for x in r["emb"]]) for r in topk_softmax_pool(df, ["bag"], "s", "id").collect()}

    by_window = pooled()
    monkeypatch.setattr(selection.kth_rows, "__defaults__", (False, 2, 4))
    assert pooled() == by_window and set(by_window) == {1, 2, None}
    for bag, (k, emb) in by_window.items():
        rows = [r for r in data if r[0] == bag]
        best = sorted((r for r in rows if r[2] is not None), key=lambda r: (-r[2], r[1]))[: max(int(0.15 * len(rows)), 24)]
        w = [math.exp(r[2] - best[0][2]) for r in best]
        assert k == len(best) and abs(emb[0] - sum(a * r[3][0] for a, r in zip(w, best)) / sum(w)) < 1e-8


def test_a_bag_with_fewer_scores_than_k_keeps_them(spark):
    df = spark.createDataFrame([(1, 1, 0.5, [2.0]), (1, 2, None, [9.0])], "bag int, id bigint, s double, feat array<double>")
    r = topk_softmax_pool(df, ["bag"], "s", "id").first()
    assert (r["k"], r["emb"]) == (1, [2.0])
