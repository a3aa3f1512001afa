"""The padded training batch: shapes, masks, draws that repeat, NULL and empty bags."""

import numpy as np
from pyspark.sql import functions as F

from slidelake.operators.tokens import training_batch

DIM = 6
BUDGETS = {0.5: 5, 2.0: 2}
SCHEMA = "bag int, scale double, tile_idx bigint, x double, y double, feat array<double>"


def rows(bag, n, scale=0.5):
    return [(bag, scale, i, 256.0 * i, 0.0, [float(10 * i + j + 1) for j in range(DIM)]) for i in range(n)]


def batch_of(spark, parts=3, **options):
    data = rows(1, 9) + rows(1, 3, 2.0) + rows(None, 4) + rows(2, 1, 2.0)
    tokens = spark.createDataFrame(data, SCHEMA).repartition(parts)
    bags = spark.createDataFrame([(1, 0), (None, 0), (2, 1), (3, 1)], "bag int, batch int")
    return {r["bag"]: r for r in training_batch(tokens, bags, "bag", "batch", "tile_idx", DIM, BUDGETS, 5, **options).collect()}


def test_one_padded_row_per_bag(spark):
    got = batch_of(spark)
    assert {k: (r["t"], r["t_max"]) for k, r in got.items()} == {1: (7, 7), None: (4, 7), 2: (1, 1), 3: (1, 1)}
    for r in got.values():
        t, top, hidden = r["t"], r["t_max"], r["mask_index"]
        assert all(len(r[c]) == top for c in ("view1", "view2", "mm_x", "mm_y", "scale", "pad_mask"))
        assert r["pad_mask"] == [i >= t for i in range(top)]
        assert len(hidden) == max(1, round(0.25 * t)) and hidden == sorted(set(hidden)) and set(hidden) <= set(range(t))
        for c in ("view1", "view2"):
            zero = [not np.any(v) for v in r[c]]
            assert zero == [i >= t or i in hidden for i in range(top)]
    assert got[1]["scale"] == [0.5] * 5 + [2.0] * 2
    assert got[1]["mm_x"][:2] == [128 * 0.0005, 384 * 0.0005]


def test_views_are_the_tokens_but_for_noise_and_dropout(spark):
    still = batch_of(spark, drop_p=-1.0, sigma=0.0)[1]
    for i in set(range(7)) - set(still["mask_index"]):
        place = i if i < 5 else i - 5
        assert still["view1"][i] == still["view2"][i] == [10.0 * place + j + 1 for j in range(DIM)]
    got = batch_of(spark)[1]
    seen = [i for i in range(7) if i not in got["mask_index"]]
    assert got["view1"][seen[0]] != got["view2"][seen[0]]
    for c in ("view1", "view2"):
        diff = np.array([got[c][i] for i in seen]) - np.array([still["view1"][i] for i in seen])
        kept = np.abs(diff) < 0.2
        assert kept.mean() > 0.6  # the others are dropped to zero


def test_batches_repeat_over_partitionings_and_differ_by_seed(spark):
    assert batch_of(spark, 1) == batch_of(spark, 7)
    assert batch_of(spark)[1]["view1"] != batch_of(spark, sigma=0.5)[1]["view1"]


def test_no_tokens_at_all(spark):
    tokens = spark.createDataFrame([], SCHEMA)
    bags = spark.createDataFrame([(1, 0)], "bag int, batch int")
    r = training_batch(tokens, bags, "bag", "batch", "tile_idx", DIM, BUDGETS, 5).first()
    assert (r["t"], r["mask_index"], r["view1"], r["pad_mask"]) == (1, [0], [[0.0] * DIM], [False])
    none = bags.where(F.lit(False))
    assert training_batch(tokens, none, "bag", "batch", "tile_idx", DIM, BUDGETS, 5).count() == 0
