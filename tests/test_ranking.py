"""Distributed ranks and sums against plain Python, with hot and NULL groups."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from slidelake.functions.detrand import u32
from slidelake.operators.ranking import exact_rank, hash_rank, running_sums, top_k_per_group
from slidelake.operators.skew import group_join

ROWS = 900


@pytest.fixture(scope="module")
def rows():
    """A third of the rows in group 'hot', many equal values, a NULL group."""
    rnd = random.Random(5)
    out = []
    for i in range(ROWS):
        g = "hot" if i % 3 == 0 else rnd.choice(["a", "b", "c", None])
        v = 1.0 if i % 2 else float(rnd.randint(0, 40))
        out.append((i, g, v))
    return out


@pytest.fixture()
def df(spark, rows):
    return spark.createDataFrame(rows, "id bigint, g string, v double").repartition(5)


def by_group(rows):
    out = defaultdict(list)
    for i, g, v in rows:
        out[g].append((v, i))
    return out


@pytest.mark.parametrize("parts", ["1", "4", "64"])
def test_exact_rank(spark, df, rows, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["id"]: (r["rank_no"], r["group_rows"]) for r in exact_rank(df, ["g"], [F.col("v").asc(), F.col("id").asc()]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = {}
    for members in by_group(rows).values():
        for n, (_, i) in enumerate(sorted(members), 1):
            want[i] = (n, len(members))
    assert got == want


def test_exact_rank_maxima_and_no_keys(df, rows):
    got = exact_rank(df, [], [F.col("v").desc(), F.col("id").asc()], maxima={"v": "top"}).collect()
    want = {i: n for n, (_, i) in enumerate(sorted((-v, i) for i, _, v in rows), 1)}
    assert {r["id"]: r["rank_no"] for r in got} == want
    assert {r["top"] for r in got} == {max(v for _, _, v in rows)}


@pytest.mark.parametrize("slices", [1, 7, 64])
def test_hash_rank(df, rows, slices):
    h = df.withColumn("h", u32("s", F.col("id")))
    got = hash_rank(h, ["g"], "h", ["id"], slices=slices).collect()
    groups = defaultdict(list)
    for r in got:
        groups[r["g"]].append((r["h"], r["id"], r["rank_no"], r["group_rows"]))
    assert sum(map(len, groups.values())) == len(rows)
    for members in groups.values():
        members.sort()
        assert [m[2] for m in members] == list(range(1, len(members) + 1))
        assert {m[3] for m in members} == {len(members)}


def test_top_k_with_column_limit(df, rows):
    k = F.when(F.col("g") == "hot", 7).otherwise(3)
    top = top_k_per_group(df, ["g"], [F.col("v").desc(), F.col("id")], k, 7, F.col("id"))
    got = defaultdict(list)
    for r in top.collect():
        got[r["g"]].append((r["rank_no"], r["id"]))
    for g, members in by_group(rows).items():
        n = 7 if g == "hot" else 3
        want = [i for _, i in sorted((-v, i) for v, i in members)[:n]]
        assert [i for _, i in sorted(got[g])] == want


def test_top_k_uses_group_limit(df):
    top = top_k_per_group(df, ["g"], [F.col("id")], 3, 3, F.col("id"))
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_running_sums(spark, df, rows):
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    got = {(r["g"], r["v"]): (r["c_run"], r["c_all"]) for r in running_sums(counts, ["g"], [F.col("v").asc()], {"n": "c"}).collect()}
    for g, members in by_group(rows).items():
        vals = [v for v, _ in members]
        for v in set(vals):
            assert got[(g, v)] == (sum(x <= v for x in vals), len(vals))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_group_join_equals_plain_join(spark, df, how):
    groups = spark.createDataFrame([("hot", 1), ("a", 2), ("z", 3)], "g string, w int")
    cols = lambda d: sorted(map(str, d.collect()))
    assert cols(group_join(df, groups, ["g"], ["id"], how)) == cols(df.join(groups, ["g"], how))
