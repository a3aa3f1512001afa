"""Plans keep free of nested loops and prune their scans; results do not depend on partitioning."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.compare import _norm

QUERIES = entry.queries()
SLOW = {"grid_search", "patient_evaluation", "probe_logreg", "probe_logreg_l1", "probe_ridge", "probe_ordinal"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_no_nested_loops(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize(
    "name", ["tile_table", "topk_or_uniform", "mask_positions", "auroc_binary", "kfold_stratified", "kfold_stratified_group", "topk_softmax_pool", "loss_trend"]
)
def test_same_rows_at_any_partitioning(name, spark, sf_dir):
    old, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "4", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(tuple(map(_norm, r)) for r in QUERIES[name](spark, sf_dir).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen[0] == seen[1] == seen[2]


def test_scans_are_pruned(spark, sf_dir):
    text = plan(QUERIES["throughput_log"](spark, sf_dir))
    assert re.search(r"ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>", text)
    text = plan(QUERIES["manifest_summary"](spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in text


def test_inventory_does_not_read_contents(spark, tmp_path):
    from slidelake.sources.files import file_inventory

    (tmp_path / "a.svs").write_bytes(b"x")
    assert "content" not in plan(file_inventory(spark, str(tmp_path)))


def test_filter_reaches_the_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("user_id") == 3).groupBy("user_id").count()
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,3)]" in plan(df)


@pytest.mark.parametrize("name", ["bootstrap_auroc", "bootstrap_cluster_kappa"])
def test_draws_are_not_sent_through_the_driver(name, spark, sf_dir):
    """There are replicates times more draws than rows, however small the planner thinks they are."""
    joins = re.findall(r"(\w+) \[__at#\w+\], \[__at#\w+\], Inner, (\w+)", plan(QUERIES[name](spark, sf_dir)))
    # The rows drawn from, on the right, are the side that is built.
    assert joins and all(build == "BuildRight" for _, build in joins), joins


@pytest.mark.parametrize("name", ["tile_coverage", "coverage_filter"])
def test_the_integral_image_is_not_sent_through_the_driver(name, spark, sf_dir):
    """Its cells are exploded from one small row per slide, and the planner takes them for as few."""
    joins = re.findall(r"(\w+) \[slide#\w+, mx#\w+, my#\w+\]", plan(QUERIES[name](spark, sf_dir)))
    assert "SortMergeJoin" in joins and "BroadcastHashJoin" not in joins
