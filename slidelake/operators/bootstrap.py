"""Bootstrap intervals.

By default a resample is drawn as counts: of the cells of a confusion matrix, or
of blocks of scores or groups and then of what is in a block.  That is the same law as
drawing rows, without a row per draw.  ``method="draws"`` draws rows, as pure
functions of (seed, replicate, position): replicates times rows of work, for
small tables and for other engines to repeat.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slidelake.functions.detrand import draw_index, u32
from slidelake.operators.metrics import cells, qw_kappa
from slidelake.operators.ranking import exact_rank, hash_rank, running_sums
from slidelake.operators.skew import group_join, side_join, spread
from slidelake.session import materialize


DRAWS_PER_ROW = 10_000
SCORES_PER_SLAB = 50_000
GROUPS_PER_BUCKET = 20_000


def _replicates(b: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(b - 1)))


def _draws(spark: SparkSession, n: Column, n_boot: int, seed: int) -> DataFrame:
    """(replicate, __at): n draws from [0, n) per replicate.

    The draws depend on nothing but n, so they are generated in pieces of
    ``DRAWS_PER_ROW`` from a spread-out range instead of from the rows.
    """
    sized = spark.range(n_boot).select(F.col("id").cast("int").alias("replicate"), n.cast("bigint").alias("__n"))
    last = F.ceil(F.col("__n") / F.lit(DRAWS_PER_ROW)).cast("bigint") - 1
    pieces = sized.select("replicate", "__n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    even = spread(pieces, "replicate", "piece")
    start = F.col("piece") * DRAWS_PER_ROW
    stop = F.least(start + DRAWS_PER_ROW, F.col("__n")) - 1
    # Drawn inside the generator, so that each draw is hashed once and not again
    # wherever its value is used.
    drawn = F.transform(
        F.sequence(start, stop), lambda pos: draw_index(F.col("__n"), F.lit(seed), F.col("replicate"), pos)
    )
    return even.select("replicate", F.explode(drawn).alias("__at"))


def _drawn(draws: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of each draw, by ``__at``.

    There are replicates times more draws than rows, but the planner takes them for the few numbers they are made from.
    So the rows are written and are the side that is sent or hashed, never the draws.
    """
    return side_join(draws, materialize(rows, "drawn-from"), "__at")


def interval(values: DataFrame, metric: str, level: float = 0.95) -> DataFrame:
    """Linear percentiles of the defined replicates."""
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    return values.agg(
        F.percentile(metric, F.lit(lo)).alias("ci_lo"),
        F.percentile(metric, F.lit(hi)).alias("ci_hi"),
        F.count(metric).alias("n_replicates"),
    )


def _cell_bounds(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Cells in (y, pred) order with the half-open range of row positions they hold."""
    c = cells(df, y=y, pred=pred)
    run = W.partitionBy(F.lit(0)).orderBy("y", "pred").rowsBetween(W.unboundedPreceding, 0)
    return c.select("y", "pred", "n", F.sum("n").over(run).alias("upto"))


def resampled_cells(df: DataFrame, n_boot: int, seed: int, y: str = "y", pred: str = "pred") -> DataFrame:
    """(replicate, y, pred, n) of n-of-n resamples, with n-of-n md5 draws.

    A count metric only needs to know which cell a drawn row lies in.  With rows
    numbered cell by cell that is a look-up of the draw in the array of cell
    bounds (classes squared entries), so drawn positions never meet the rows.
    """
    bounds = _cell_bounds(df, y, pred)
    table = bounds.agg(F.array_sort(F.collect_list(F.struct("upto", "y", "pred"))).alias("cells")).scalar()
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    below = F.size(F.filter("__upto", lambda u: u <= F.col("__at")))
    return (
        _draws(df.sparkSession, n, n_boot, seed)
        .withColumns({"__cells": table, "__upto": table["upto"]})
        .select("replicate", F.get("__cells", below).alias("c"))
        .groupBy("replicate", F.col("c.y").alias("y"), F.col("c.pred").alias("pred"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def multinomial_cells(df: DataFrame, n_boot: int, seed: int, y: str = "y", pred: str = "pred") -> DataFrame:
    """(replicate, y, pred, n) drawn straight from the multinomial law of the cells.

    An n-of-n resample of rows has multinomial cell counts, so this is the same
    bootstrap at a cost that does not depend on n once the cells are counted.
    """
    packed = cells(df, y=y, pred=pred).agg(F.array_sort(F.collect_list(F.struct("y", "pred", "n"))).alias("c"))
    reps = packed.select(_replicates(n_boot).alias("replicate"), "c")
    reps = spread(reps.select("replicate", F.transform("c", lambda e: e["n"]).alias("n"), "c"), "replicate")

    @F.pandas_udf("array<bigint>")
    def draw(replicate: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for r, counts in zip(replicate, n):
            k = np.asarray(counts, dtype=np.int64)
            out.append(np.random.default_rng([seed, int(r)]).multinomial(k.sum(), k / k.sum()))
        return pd.Series(out)

    drawn = reps.withColumn("k", draw("replicate", "n"))
    rows = drawn.select("replicate", F.explode(F.arrays_zip("c", "k")).alias("z"))
    return rows.select("replicate", F.col("z.c.y").alias("y"), F.col("z.c.pred").alias("pred"), F.col("z.k").alias("n")).where(
        F.col("n") > 0
    )


def replicate_accuracy(resampled: DataFrame) -> DataFrame:
    hit = F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0))
    return resampled.groupBy("replicate").agg((hit / F.sum("n")).alias("accuracy"))


def bootstrap_accuracy(
    df: DataFrame, n_boot: int = 1000, seed: int = 42, y: str = "y", pred: str = "pred", method: str = "multinomial"
) -> DataFrame:
    """95 % interval of the accuracy; ``method`` is ``multinomial`` or ``draws``."""
    sampler = {"draws": resampled_cells, "multinomial": multinomial_cells}[method]
    return interval(replicate_accuracy(sampler(df, n_boot, seed, y, pred)), "accuracy")


def _indexed(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Rows numbered from 0 in hash order of their id."""
    hashed = df.withColumn("__h", u32(seed, F.col(id_col)))
    return hash_rank(hashed, [], "__h", [id_col], rank="__pos").drop("__h").withColumn(
        "__pos", F.col("__pos") - 1
    )


def replicate_auroc(df: DataFrame, id_col: str, score: str, label: str, n_boot: int, seed: int) -> DataFrame:
    """AUROC of each n-of-n resample; NULL where only one class was drawn.

    Scores are ordered once, over their distinct values.  A replicate is then
    summed in (replicate, slab) parts that all replicates share, so no task ever
    holds a whole replicate.
    """
    scores = exact_rank(df.select(F.col(score).alias("__score")).distinct(), [], [F.col("__score").asc()], rank="__nth")
    scores = scores.select("__score", F.floor(F.col("__nth") / SCORES_PER_SLAB).cast("int").alias("__part"))
    placed = df.select(id_col, F.col(score).alias("__score"), F.col(label).alias("__y"))
    rows = _indexed(group_join(placed, scores, ["__score"], [id_col]), id_col, seed)
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    drawn = _drawn(_draws(df.sparkSession, n, n_boot, seed), rows.select(F.col("__pos").alias("__at"), "__score", "__part", "__y"))
    counts = drawn.groupBy("replicate", "__part", "__score").agg(
        F.sum(F.when(F.col("__y") == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("__y") == 1, 0).otherwise(1)).alias("neg"),
    )
    run = running_sums(
        counts, ["replicate"], [F.col("__score").asc()], {"pos": "p", "neg": "q"}, slab=F.col("__part")
    )
    u = F.sum(F.col("pos") * (F.col("q_run") - F.col("neg") / 2.0))
    p, q = F.max("p_all"), F.max("q_all")
    value = F.when((p > 0) & (q > 0), u / (p.cast("double") * q))
    return run.groupBy("replicate").agg(value.alias("auroc"))


def split_draws(sizes: DataFrame, buckets: int, n_boot: int, seed: int) -> DataFrame:
    """(bucket, draws): how many of n draws out of n rows fall into each bucket, for every replicate.

    ``sizes`` has a row (bucket, n) for each bucket with rows; buckets count from 0 and are fewer than ``buckets``.  They
    are the leaves of a binary tree.  The draws of a node part into its halves by a binomial whose generator is seeded by
    the node, which splits an n-of-n multinomial exactly; so a bucket finds its own share by going down from the root, and
    no row, task or driver ever holds the shares of all.
    """
    levels = max(0, buckets - 1).bit_length()
    total = sizes.agg(F.sum("n").alias("n")).scalar()
    if levels == 0:
        ways = sizes.select("bucket", total.alias("__n"), F.lit(None).cast("array<struct<level:int,node:bigint,all:bigint,left:bigint,goes_left:boolean>>").alias("__way"))
    else:
        level = F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("level")
        node = F.expr("shiftright(cast(bucket as bigint), level)")
        goes_left = F.expr("shiftright(cast(bucket as bigint), level - 1) & 1") == 0
        steps = sizes.select("bucket", "n", level).withColumns({"node": node, "goes_left": goes_left})
        nodes = steps.groupBy("level", "node").agg(
            F.sum("n").alias("all"), F.sum(F.when(F.col("goes_left"), F.col("n")).otherwise(0)).alias("left")
        )
        step = F.struct("level", "node", "all", "left", "goes_left")
        # One step for each level: at most 63.
        way = F.sort_array(F.collect_list(step), asc=False).alias("__way")
        ways = steps.join(nodes, ["level", "node"]).groupBy("bucket").agg(way).withColumn("__n", total)

    def walk(batches):
        for batch in batches:
            shares = []
            for n, way in zip(batch.column("__n").to_pylist(), batch.column("__way").to_pylist()):
                k = np.full(n_boot, n, np.int64)
                for s in way or []:
                    left = np.random.default_rng([seed, s["level"], s["node"]]).binomial(k, s["left"] / s["all"])
                    k = left if s["goes_left"] else k - left
                shares.append(k)
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array(shares, pa.list_(pa.int64()))], names=["bucket", "draws"])

    kind = dict(sizes.dtypes)["bucket"]
    return spread(ways.select("bucket", "__n", "__way"), "bucket").mapInArrow(walk, f"bucket {kind}, draws array<bigint>")


def replicate_auroc_blocks(
    df: DataFrame, score: str, label: str, n_boot: int, seed: int, blocks: int | None = None
) -> DataFrame:
    """AUROC of each resample without a row per draw.

    Distinct scores are range-partitioned into blocks of about
    ``SCORES_PER_SLAB``, however many there are.  The rows a replicate
    draws from each block are multinomial in the block sizes (``split_draws``), and
    uniform within a block; so a block resamples itself and returns per replicate its positives,
    negatives and ordered pairs.  Only replicates * blocks rows are shuffled.
    """
    counts = df.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"),
    )
    counts = materialize(counts, "scores")
    nb = blocks or max(1, -(-counts.count() // SCORES_PER_SLAB))
    ranged = materialize(
        counts.repartitionByRange(nb, "s").withColumn("block", F.spark_partition_id()), "auroc-blocks"
    )
    sizes = ranged.groupBy("block").agg(F.sum(F.col("pos") + F.col("neg")).alias("n"))
    shares = split_draws(sizes.withColumnRenamed("block", "bucket"), nb, n_boot, seed).withColumnRenamed("bucket", "block")

    def resample(rows: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("s")
        block = int(rows["block"].iloc[0])
        pos, neg = rows["pos"].to_numpy(np.int64), rows["neg"].to_numpy(np.int64)
        weights = np.concatenate([pos, neg]) / (pos.sum() + neg.sum())
        m = len(pos)
        out = []
        for r, mine in enumerate(drawn["draws"].iloc[0]):
            k = np.random.default_rng([seed, int(r), block]).multinomial(int(mine), weights)
            p, q = k[:m], k[m:]
            pairs = float((p * (np.cumsum(q) - q / 2.0)).sum())
            out.append((int(r), block, int(p.sum()), int(q.sum()), pairs))
        return pd.DataFrame(out, columns=["replicate", "block", "p", "q", "pairs"])

    schema = "replicate int, block int, p bigint, q bigint, pairs double"
    parts = ranged.groupBy("block").cogroup(shares.groupBy("block")).applyInPandas(resample, schema)
    run = W.partitionBy("replicate").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    below = F.coalesce(F.sum("q").over(run), F.lit(0))
    lined = parts.withColumn("u", F.col("pairs") + F.col("p") * below)
    p, q = F.sum("p"), F.sum("q")
    value = F.when((p > 0) & (q > 0), F.sum("u") / (p.cast("double") * q))
    return lined.groupBy("replicate").agg(value.alias("auroc"))


def bootstrap_auroc(
    df: DataFrame, id_col: str, score: str, label: str, n_boot: int = 1000, seed: int = 42, method: str = "blocks"
) -> DataFrame:
    """95 % interval of the AUROC; ``method`` is ``blocks`` or ``draws``."""
    if method == "draws":
        return interval(replicate_auroc(df, id_col, score, label, n_boot, seed), "auroc")
    if method == "blocks":
        return interval(replicate_auroc_blocks(df, score, label, n_boot, seed), "auroc")
    raise ValueError(f"unknown bootstrap method: {method}")


def cluster_cells(
    df: DataFrame, group: str, n_boot: int, seed: int, y: str = "y", pred: str = "pred", per_bucket: int = GROUPS_PER_BUCKET
) -> DataFrame:
    """(replicate, y, pred, n) of resampled groups, each with all of its rows, without a row per draw.

    Groups, reduced to their cells, are hashed to buckets of about ``per_bucket``.  Each bucket learns how many of a
    replicate's draws are its own (``split_draws``) and draws them among its groups, so that only replicates times cells
    leave it.  Rows with a NULL group are one group.
    """
    key = F.to_json(F.struct(F.col(group).alias("g")))
    counts = materialize(df.groupBy(key.alias("__g"), F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n")), "group-cells")
    buckets = max(1, -(-counts.select("__g").distinct().count() // per_bucket))
    placed = counts.withColumn("bucket", F.pmod(F.xxhash64("__g"), F.lit(buckets)).cast("int"))
    sizes = placed.select("bucket", "__g").distinct().groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    shares = split_draws(sizes, buckets, n_boot, seed)

    def resample(rows: pa.Table, drawn: pa.Table) -> pa.Table:
        names, of = np.unique(np.array(rows.column("__g").to_pylist(), dtype=object), return_inverse=True)
        cell: dict = {}
        pairs = list(zip(rows.column("y").to_pylist(), rows.column("pred").to_pylist()))
        # In an order of their own, as rows come in any.
        for p in sorted(set(pairs), key=repr):
            cell[p] = len(cell)
        at, n = np.array([cell[p] for p in pairs]), rows.column("n").to_numpy()
        bucket = rows.column("bucket")[0].as_py()
        out = []
        for r, k in enumerate(drawn.column("draws")[0].as_py()):
            times = np.bincount(np.random.default_rng([seed, 1 << 20, bucket, r]).integers(0, len(names), k), minlength=len(names))
            total = np.zeros(len(cell), np.int64)
            np.add.at(total, at, times[of] * n)
            out += [(r, *p, int(t)) for p, t in zip(cell, total) if t]
        kinds = [pa.int32(), rows.schema.field("y").type, rows.schema.field("pred").type, pa.int64()]
        columns = list(zip(*out)) if out else [()] * 4
        return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["replicate", "y", "pred", "n"])

    kinds = dict(counts.dtypes)
    schema = f"replicate int, y {kinds['y']}, pred {kinds['pred']}, n bigint"
    parts = placed.groupBy("bucket").cogroup(shares.groupBy("bucket")).applyInArrow(resample, schema)
    return parts.groupBy("replicate", "y", "pred").agg(F.sum("n").alias("n"))


def bootstrap_cluster_kappa(
    df: DataFrame, group: str, n_boot: int = 1000, seed: int = 123, y: str = "y", pred: str = "pred", method: str = "counts"
) -> DataFrame:
    """95 % interval of kappa over resampled groups, each with all of its rows; ``method`` is ``counts`` or ``draws``.

    Rows are reduced to cells per group first, so a group with a third of all
    rows weighs no more than any other.
    """
    if method == "counts":
        return interval(qw_kappa(cluster_cells(df, group, n_boot, seed, y, pred), ["replicate"]), "kappa")
    if method != "draws":
        raise ValueError(f"unknown bootstrap method: {method}")
    per_group = cells(df, [group], y, pred)
    groups = per_group.select(group).distinct()
    numbered = _indexed(groups, group, seed).select(F.col("__pos").alias("__at"), group)
    n = groups.agg(F.count(F.lit(1)).alias("n")).scalar()
    held = numbered.join(per_group, group)
    picked = _drawn(_draws(df.sparkSession, n, n_boot, seed), held)
    c = picked.groupBy("replicate", "y", "pred").agg(F.sum("n").alias("n"))
    return interval(qw_kappa(c, ["replicate"]), "kappa")
