"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors gives a neighbour graph, which is cut into balanced parts so that few neighbours are
parted.  A small network then learns, from a vector alone, in which parts its neighbours lie.  Every vector is indexed
in its most probable part.  A query is routed to as many of its most probable parts as it took on held-out vectors of
the sample to find the share ``recall`` of their neighbours, and the vectors there are reranked by their exact cosine in
double precision.

Parts that turn out large are dealt to chunks of about ``chunk`` vectors, and the queries of a part likewise, so a task
holds two chunks at most.  Equal vectors are searched once: only the k + 1 smallest ids of a vector can be in an answer.

Bounds: ``sample_rows`` vectors reach the driver for the fit; a part has about ``part_rows`` vectors, or fewer where that
makes less than ``LEAST_PARTS`` parts, but there are no more parts than a 64th of the sample: one below 128 vectors.

Defined results: vectors that are null, zero, hold null or non-finite components, have no id, or are not of the
commonest length (the smaller on a tie) take no part; ties in the score go to the smaller id; rows with the query's id
are its own; a query gets all candidates if there are fewer than k; an empty table gives an empty result.  Columns that
are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slidelake.session import materialize

NEIGHBOURS = 10
HIDDEN = 64
LEAST_PARTS = 8
#: More than the fast and the exact cosine of two vectors differ by.
ROUNDING = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Row i: the k rows nearest to row i, nearest first."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable")
        out[at : at + 1024] = np.take_along_axis(near, order, 1)
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 6) -> np.ndarray:
    """A part for each row: halves along main axes first, then moves to where the neighbours are, while there is room."""
    label = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, low, n = todo.pop()
        if n == 1:
            label[rows] = low
            continue
        own = x[rows] - x[rows].mean(axis=0)
        axis = np.linalg.eigh(own.T @ own)[1][:, -1]
        order = rows[np.argsort(own @ axis, kind="stable")]
        left = n // 2
        cut = len(rows) * left // n
        todo += [(order[:cut], low, left), (order[cut:], low + left, n - left)]
    room = int(slack * len(x) / parts) + 1
    size = np.bincount(label, minlength=parts)
    both = [[] for _ in range(len(x))]
    for i, near in enumerate(graph.tolist()):
        both[i] += near
        for j in near:
            both[j].append(i)
    for _ in range(rounds):
        moved = 0
        for i, near in enumerate(both):
            votes = np.bincount(label[near], minlength=parts)
            votes[(size >= room) & (np.arange(parts) != label[i])] = -1
            best = int(votes.argmax())
            if votes[best] > votes[label[i]]:
                size[label[i]] -= 1
                size[best] += 1
                label[i] = best
                moved += 1
        if not moved:
            break
    return label


@dataclass
class Router:
    """A network with one hidden layer: the probability of each part, and how many parts a query visits."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts of each row, most probable first."""
        return np.argsort(-(np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2), axis=1, kind="stable")


def fit_router(x: np.ndarray, parts: int, recall: float, k: int, steps: int = 600, seed: int = 7) -> Router:
    """Learn parts and their classifier from unit vectors."""
    d = x.shape[1]
    if parts <= 1 or len(x) <= NEIGHBOURS + 1:
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    graph = neighbour_graph(x, NEIGHBOURS)
    label = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts))
    for column in [np.arange(len(x)), *graph.T]:
        target[np.arange(len(x)), label[column]] += 1 / (NEIGHBOURS + 1)
    r = np.random.default_rng(seed)
    held = r.permutation(len(x)) < len(x) // 4
    learn = np.flatnonzero(~held)
    weights = [r.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, (HIDDEN, parts)), np.zeros(parts)]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        rows = r.choice(learn, min(512, len(learn)), replace=False)
        hidden = np.maximum(x[rows] @ weights[0] + weights[1], 0)
        z = hidden @ weights[2] + weights[3]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
        back = (g @ weights[2].T) * (hidden > 0)
        rate = 0.01 * (1 - step / (steps + 1))
        for i, grad in enumerate((x[rows].T @ back, back.sum(axis=0), hidden.T @ g, g.sum(axis=0))):
            mean[i] = 0.9 * mean[i] + 0.1 * grad
            square[i] = 0.99 * square[i] + 0.01 * grad**2
            weights[i] -= rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8)
    router = Router(*weights, probes=parts)
    # The visits that found enough of the neighbours of vectors the network has not seen.
    order = router.order(x)
    place = np.argsort(order, axis=1)
    asked = np.flatnonzero(held)
    visit = np.take_along_axis(place[asked], order[graph[asked, :k], 0], axis=1)
    found = np.cumsum(np.bincount(visit.ravel(), minlength=parts)) / visit.size
    router.probes = int(np.argmax(found >= recall)) + 1
    return router


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                part = shared.value.order(unit(_matrix(b.column("v"))))[:, 0]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(part.astype(np.int32))], ["id", "v", "part"])

    return run


def _route(shared, sizes: list[int], least: int):
    """Each query for each part it visits; more parts than usual where those hold fewer than ``least`` vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.array(sizes)
        for b in batches:
            if b.num_rows:
                order = shared.value.order(unit(_matrix(b.column("v"))))
                before = np.cumsum(rows[order], axis=1) - rows[order]
                goes = (np.arange(order.shape[1]) < shared.value.probes) | (before < least)
                at, place = np.nonzero(goes & (rows[order] > 0))
                picked = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column("id").take(picked), b.column("v").take(picked), pa.array(order[at, place].astype(np.int32))], ["id", "v", "part"])

    return run


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    return dot(a, b) / np.sqrt(dot(a, a) * dot(b, b))


def _rerank(k: int):
    """The k nearest vectors of a chunk for each query that visits it."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        ask, own, score = [], [], []
        if len(queries) and len(rows):
            q, v = _matrix(queries.column("v")), _matrix(rows.column("v"))
            ids, names = rows.column("id").to_numpy(), queries.column("id").to_numpy()
            base = unit(v)
            # All that the fast product's rounding may have among the k best, ties included, then the exact measure.
            least = min(len(v), k)
            for at in range(0, len(q), 512):
                s = unit(q[at : at + 512]) @ base.T
                bar = -np.partition(-s, least - 1, axis=1)[:, least - 1] - ROUNDING
                for i, row in enumerate(s):
                    js = np.flatnonzero(row >= bar[i])
                    exact = cosines(np.broadcast_to(q[at + i], (len(js), q.shape[1])), v[js])
                    best = np.lexsort((ids[js], -exact))[:k]
                    ask += [names[at + i]] * len(best)
                    own.append(ids[js][best])
                    score.append(exact[best])
        return pa.table(
            {
                "query": pa.array(ask, pa.int64()),
                "id": pa.array(np.concatenate(own) if own else [], pa.int64()),
                "score": pa.array(np.concatenate(score) if score else [], pa.float64()),
            }
        )

    return run


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """(vec_id, v): the rows that take part, as doubles."""
    v = F.col("v")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col(column).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(good)
    # Both zeros are one number.
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (lengths.d if lengths else 0))


def nearest(
    vectors: DataFrame,
    is_query,
    k: int = 5,
    column: str = "embedding",
    recall: float = 0.97,
    sample_rows: int = 8192,
    part_rows: int = 4096,
    chunk: int = 4096,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds, the k nearest of all other rows found."""
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, column), "vectors")
    # Of equal vectors the k + 1 smallest ids; the smallest stands for all.
    order = W.partitionBy("v").orderBy("vec_id")
    ranked = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    ids = materialize(ranked.withColumn("id", F.first("vec_id").over(order)), "ids")
    base = ids.where("nth = 1").select("id", "v")
    n = base.count()
    parts = max(1, min(max(n // part_rows, LEAST_PARTS), min(n, sample_rows) // 64))
    sample = base.orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect() if parts > 1 else []
    d = len(sample[0].v) if sample else 1
    x = unit(np.array([r.v for r in sample])) if sample else np.zeros((0, d))
    router = spark.sparkContext.broadcast(fit_router(x, parts, recall, k) if sample else None)
    kind = "id long, v array<double>, part int"
    one = F.lit(0).alias("part")
    placed = materialize(base.mapInArrow(_assign(router), kind) if sample else base.select("id", "v", one), "index")
    sizes = [0] * parts
    for r in placed.groupBy("part").count().collect():
        sizes[r.part] = r["count"]

    asked = rows.where(is_query)
    distinct = materialize(asked.groupBy("v").agg(F.min("vec_id").alias("id")).select("id", "v"), "queries")
    routed = distinct.mapInArrow(_route(router, sizes, k + 2), kind) if sample else distinct.select("id", "v", one)
    routed = materialize(routed, "routed")
    visits = [0] * parts
    for r in routed.groupBy("part").count().collect():
        visits[r.part] = r["count"]
    chunks = lambda counts: F.array(*[F.lit(max(1, -(-c // chunk))) for c in counts])[F.col("part")]
    every = lambda counts: F.explode(F.sequence(F.lit(0), chunks(counts) - 1))
    own = lambda counts: F.pmod(F.xxhash64("id"), chunks(counts)).cast("int")
    left = routed.withColumn("q", own(visits)).withColumn("c", every(sizes))
    right = placed.withColumn("c", own(sizes)).withColumn("q", every(visits))
    key = ["part", "q", "c"]
    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_rerank(k + 1), "query long, id long, score double")
    best = W.partitionBy("query").orderBy(F.desc("score"), "id")
    near = near.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).drop("nth")

    answers = (
        asked.join(distinct.withColumnRenamed("id", "query"), "v")
        .select(F.col("vec_id").alias("query_id"), "query")
        .join(near, "query")
        .join(ids.select("id", "vec_id"), "id")
        .where("vec_id != query_id")
        .select("query_id", "vec_id", "score")
        .distinct()
    )
    final = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
