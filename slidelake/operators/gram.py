"""Ridge classifiers from sums of products: the rows are read once for all folds and all penalties.

The products of a training set are those of the other folds added up, and a penalty only changes the system that is
solved; so after one pass the work depends on folds, classes and dimensions, and no longer on rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slidelake.session import materialize

#: Bytes of sums that a task holds before it passes them on.
STATE_BYTES = 256 << 20
#: Numbers of one row of a table of products.
ROW_CELLS = 1 << 17
#: Bytes of all fitted weights together, which are sent to the tasks that score rows.
MODEL_BYTES = 256 << 20
MAX_GROUPS = 100_000


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten()
    if any(n != dim for n in column.value_lengths().to_pylist()):
        raise ValueError(f"vectors of another length than {dim}")
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dim)


def fold_grams(df: DataFrame, fold: str, y: str, feat: str, pivot: Sequence[float], state_bytes: int = STATE_BYTES) -> DataFrame:
    """(fold, y, block, sums): per fold and class the products of (vector - pivot, 1) with itself, some rows a block.

    The last row of the matrix holds the sums of the vectors and, at its end, the number of rows.  Sums are made in the
    tasks, which hold at most ``state_bytes`` or one matrix of them.  Rows without a vector or class take no part; a
    vector of another length than ``pivot`` is an error, and one that is not finite makes its sums so.
    """
    origin, dim = np.array(pivot, float), len(pivot)
    step = max(1, ROW_CELLS // (dim + 1))
    kinds = dict(df.dtypes)
    ddl = f"fold {kinds[fold]}, y {kinds[y]}, block int, sums array<double>"

    def rows(held: dict, kind: pa.Schema) -> Iterator[pa.RecordBatch]:
        for (f, label), g in held.items():
            for b, start in enumerate(range(0, dim + 1, step)):
                cells = pa.array([g[start : start + step].ravel()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f], kind.field("fold").type), pa.array([label], kind.field("y").type), pa.array([b], pa.int32()), cells],
                    names=["fold", "y", "block", "sums"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kind = {}, None
        for batch in batches:
            kind = batch.schema
            x = np.hstack([_matrix(batch.column("x"), dim) - origin, np.ones((batch.num_rows, 1))])
            at: dict = {}
            for i, key in enumerate(zip(batch.column("fold").to_pylist(), batch.column("y").to_pylist())):
                at.setdefault(key, []).append(i)
            for key, which in at.items():
                own = x[which]
                if key not in held:
                    if (len(held) + 1) * 8 * (dim + 1) ** 2 > state_bytes:
                        yield from rows(held, kind)
                        held = {}
                    held[key] = np.zeros((dim + 1, dim + 1))
                held[key] += own.T @ own
        yield from rows(held, kind)

    used = df.where(F.col(feat).isNotNull() & F.col(y).isNotNull())
    parts = used.select(F.col(fold).alias("fold"), F.col(y).alias("y"), F.col(feat).cast("array<double>").alias("x")).mapInArrow(run, ddl)
    return _added(parts, "fold", "y", "block")


def _added(df: DataFrame, *keys: str) -> DataFrame:
    """Sums of arrays of one length, element by element, merged map-side."""
    total = Summarizer.metrics("sum").summary(array_to_vector("sums"))
    return df.groupBy(*keys).agg(total.alias("__s")).select(*keys, vector_to_array("__s.sum").alias("sums"))


@dataclass
class Grams:
    """What ``ridge_grams`` found: tables of products per training set, and the small numbers that go with them."""

    products: DataFrame  # target, block, sums: with balanced rows
    sums: DataFrame  # target, y, sums: the last row of each class
    labels: list
    weights: dict  # (target, label) -> weight of a row
    scaling: dict
    pivot: np.ndarray


def ridge_grams(df: DataFrame, scaling: dict, fold: str = "fold", y: str = "y", feat: str = "feat", balanced: bool = True) -> Grams:
    """Products of each fold's training rows (all rows but its own; rows with a NULL fold always train).

    ``scaling`` has (mean, deviation) per dimension for each fold.  Products are taken around the average of these means,
    so that no digits are lost where means are large.  In a balanced fit each class of a training set weighs the same.
    """
    pivot = np.mean([[m for m, _ in s] for s in scaling.values()], axis=0)
    own = materialize(fold_grams(df, fold, y, feat, pivot), "grams")
    last = len(pivot) // max(1, ROW_CELLS // (len(pivot) + 1))
    corner = own.where(F.col("block") == last).select("fold", "y", F.element_at("sums", -1).cast("bigint").alias("n"))
    counts = corner.limit(MAX_GROUPS + 1).collect()
    if len(counts) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} pairs of fold and class")
    weights, use = {}, []
    for target in scaling:
        train = [r for r in counts if r["fold"] != target]
        n: dict = {}
        for r in train:
            n[r["y"]] = n.get(r["y"], 0) + r["n"]
        for label, k in n.items():
            weights[target, label] = sum(n.values()) / (len(n) * k) if balanced else 1.0
        use += [(target, r["fold"], r["y"], weights[target, r["y"]]) for r in train]
    kinds = dict(own.dtypes)
    plan = df.sparkSession.createDataFrame(use, f"target {kinds['fold']}, __f {kinds['fold']}, __y {kinds['y']}, w double")
    # At most MAX_GROUPS rows for each fold.
    joined = own.join(plan, F.col("fold").eqNullSafe(F.col("__f")) & (F.col("y") == F.col("__y")))
    weighted = joined.select("target", "block", F.transform("sums", lambda v: v * F.col("w")).alias("sums"))
    products = materialize(_added(weighted, "target", "block"), "products")
    ends = joined.where(F.col("block") == last).select("target", "y", F.slice("sums", -(len(pivot) + 1), len(pivot) + 1).alias("sums"))
    return Grams(products, materialize(_added(ends, "target", "y"), "class-sums"), sorted({r["y"] for r in counts}), weights, scaling, pivot)


def ridge_models(grams: Grams, cs: Sequence[float]) -> dict:
    """{(fold, C): (labels, weights by class and dimension, intercepts)} for rows from which ``pivot`` was taken.

    The folds are solved in tasks of their own, each with one matrix of products for all its Cs.
    """
    dim = len(grams.pivot)
    most = 8 * (dim + 1) * len(grams.weights) * len(cs)
    if most > MODEL_BYTES:
        raise ValueError(f"{most} bytes of fitted weights: ask for fewer Cs at once")
    weights, scaling, pivot = grams.weights, grams.scaling, grams.pivot
    label_kind = T.StructType(grams.sums.schema.fields[:2])

    def solve(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        target = key[0].as_py()
        g = np.concatenate([np.array(v) for v in left.sort_by("block").column("sums").to_pylist()]).reshape(dim + 1, dim + 1)
        right = right.sort_by("y")
        labels = right.column("y").to_pylist()
        mean, std = np.array(scaling[target]).T
        n, centre = g[dim, dim], g[dim, :dim] / g[dim, dim]
        products = (g[:dim, :dim] - n * np.outer(centre, centre)) / np.outer(std, std)
        own = np.array([np.array(s) * weights[target, label] for label, s in zip(labels, right.column("sums").to_pylist())])
        signed = 2 * own - g[dim]  # rows of the class count as 1, all others as -1
        level = signed[:, dim] / n
        aims = (signed[:, :dim] - np.outer(signed[:, dim], centre)) / std
        out = []
        for c in cs:
            fit = np.linalg.solve(products + np.eye(dim) / max(c, 1e-6), aims.T).T / std
            out += [(target, float(c), label, w, b) for label, w, b in zip(labels, fit, level - fit @ centre)]
        columns = list(zip(*out))
        kinds = [left.schema.field("target").type, pa.float64(), right.schema.field("y").type, pa.list_(pa.float64()), pa.float64()]
        return pa.Table.from_arrays([pa.array(list(v), k) for v, k in zip(columns, kinds)], names=["target", "c", "y", "w", "b"])

    ddl = T.StructType([label_kind[0], T.StructField("c", T.DoubleType()), label_kind[1], T.StructField("w", T.ArrayType(T.DoubleType())), T.StructField("b", T.DoubleType())])
    fits = grams.products.groupBy("target").cogroup(grams.sums.groupBy("target")).applyInArrow(solve, ddl).collect()
    out: dict = {}
    for r in sorted(fits, key=lambda r: r["y"]):
        labels, w, b = out.setdefault((r["target"], r["c"]), ([], [], []))
        labels.append(r["y"])
        w.append(r["w"])
        b.append(r["b"])
    return {k: (labels, np.array(w), np.array(b)) for k, (labels, w, b) in out.items()}


def ridge_predictions(df: DataFrame, grams: Grams, c: float, fold: str = "fold", y: str = "y", feat: str = "feat") -> DataFrame:
    """The rows that have a fold, without their vectors, and ``pred`` by the fit on all other folds.

    Of classes with equal scores the smallest is taken.  Rows without a vector, or whose fold leaves no row to train on, get NULL.
    """
    models, pivot = ridge_models(grams, [c]), grams.pivot
    kept = [f for f in df.schema.fields if f.name not in (feat, "pred")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, folds = batch.column("__x"), batch.column(fold).to_pylist()
            pred: list = [None] * batch.num_rows
            at: dict = {}
            for i, ok in enumerate(x.is_valid().to_pylist()):
                if ok and (folds[i], float(c)) in models:
                    at.setdefault(folds[i], []).append(i)
            for f, which in at.items():
                labels, w, b = models[f, float(c)]
                scores = (_matrix(x.take(pa.array(which)), len(pivot)) - pivot) @ w.T + b
                for i, k in zip(which, scores.argmax(1)):
                    pred[i] = labels[k]
            out = batch.drop_columns(["__x"])
            yield out.append_column("pred", pa.array(pred, batch.column(y).type))

    rows = df.where(F.col(fold).isNotNull()).select(*[f.name for f in kept], F.col(feat).cast("array<double>").alias("__x"))
    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("pred", df.schema[y].dataType)]))
