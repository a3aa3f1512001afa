"""Draws split down a tree of buckets have the law of n-of-n draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidelake.operators import bootstrap


def shares(spark, sizes, buckets, n_boot, seed=5):
    df = spark.createDataFrame(list(sizes.items()), "bucket int, n bigint").repartition(3)
    return {r.bucket: np.array(r.draws) for r in bootstrap.split_draws(df, buckets, n_boot, seed).collect()}


def test_shares_add_up_and_repeat(spark):
    sizes = {0: 50, 1: 7, 2: 1, 4: 300, 6: 1, 9: 41}
    got = shares(spark, sizes, 11, 2000)
    assert got.keys() == sizes.keys()
    assert (sum(got.values()) == 400).all()
    again = shares(spark, sizes, 11, 2000)
    assert all((got[b] == again[b]).all() for b in got)
    assert any((got[b] != other).any() for b, other in shares(spark, sizes, 11, 2000, 6).items())
    assert (shares(spark, {0: 9}, 1, 4)[0] == 9).all()


def test_shares_are_multinomial(spark):
    """Means, variances and covariances of the multinomial, and a chi-square of one bucket against its binomial."""
    from math import comb

    sizes = {0: 6, 1: 3, 2: 1, 3: 7, 4: 3}
    n, reps = 20, 40000
    got = shares(spark, sizes, 5, reps)
    k = np.array([got[b] for b in sorted(got)])
    p = np.array([sizes[b] for b in sorted(sizes)]) / n
    assert np.abs(k.mean(1) - n * p).max() < 5 * np.sqrt(n * 0.25 / reps)
    want = n * (np.diag(p) - np.outer(p, p))
    assert np.abs(np.cov(k) - want).max() < 0.15
    for b in (0, 2, 4):
        seen = np.bincount(k[b], minlength=n + 1)
        law = np.array([comb(n, i) * p[b] ** i * (1 - p[b]) ** (n - i) for i in range(n + 1)]) * reps
        big = law >= 5
        chi = ((seen - law)[big] ** 2 / law[big]).sum()
        assert chi < big.sum() + 5 * np.sqrt(2 * big.sum())


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    data = []
    for g in range(60):
        for _ in range(40 if g == 7 else int(r.integers(1, 6))):
            y = int(r.integers(0, 4))
            data.append((g if g else None, y, y if r.random() < 0.6 else int(r.integers(0, 4))))
    return spark.createDataFrame(data, "site int, y int, pred int").repartition(4).cache()


def test_cluster_cells_draw_whole_groups(rows):
    """Each replicate holds as many groups as there are; sums of rows vary as those of drawn groups do."""
    per = {r.site: r.n for r in rows.groupBy("site").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = bootstrap.cluster_cells(rows, "site", 4000, 1, per_bucket=4)
    size = np.array([r.n for r in got.groupBy("replicate").agg(F.sum("n").alias("n")).collect()])
    n = np.array(list(per.values()))
    assert len(size) == 4000 and len(per) == 60
    assert abs(size.mean() - n.sum()) < 5 * n.std() * np.sqrt(60 / 4000)
    assert abs(size.std() / (n.std() * np.sqrt(60)) - 1) < 0.08
    own = rows.withColumns({"y": F.col("site"), "pred": F.col("site")})
    each = bootstrap.cluster_cells(own, "site", 50, 1, per_bucket=4).collect()
    assert all(r.n % per[r.y] == 0 for r in each)
    times = {}
    for r in each:
        times[r.replicate] = times.get(r.replicate, 0) + r.n // per[r.y]
    assert set(times.values()) == {60}


def test_counts_and_draws_agree(rows):
    known = rows.where("site is not null")
    a, b = (bootstrap.bootstrap_cluster_kappa(known, "site", 1500, 9, method=m).first() for m in ("counts", "draws"))
    assert a.n_replicates == b.n_replicates == 1500
    assert abs(a.ci_lo - b.ci_lo) < 0.03 and abs(a.ci_hi - b.ci_hi) < 0.03
    assert bootstrap.bootstrap_cluster_kappa(known, "site", 1500, 9).first() == a
    with pytest.raises(ValueError):
        bootstrap.bootstrap_cluster_kappa(known, "site", method="none")


def test_empty_table(rows):
    assert bootstrap.cluster_cells(rows.limit(0), "site", 5, 1).count() == 0
