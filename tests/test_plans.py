"""Physical plans: pushdown, no cross joins, limits before shuffles, spread hot keys."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from sparkroster import operators as op
from sparkroster.catalog import REGISTRY
from sparkroster.operators.skew import hot_keys, lookup
from sparkroster.schemas import INVENTORY, RUN_LOGS
from sparkroster.session import work_dir
from sparkroster.sources import verify_written, write_parquet

SF_DIR = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_no_cross_join_and_no_python(spark, no_broadcast, name):
    plan = physical(e.queries()[name](spark, SF_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "CollectLimit"):
        assert bad not in plan, bad


def test_flat_label_reaches_the_scan(spark):
    path = work_dir(spark, "inv")
    spark.createDataFrame([], INVENTORY).write.parquet(path)
    chosen = op.label_select(spark.read.parquet(path), "project-id=p1").select("namespace")
    plan = physical(chosen)
    assert "EqualTo(project_id,p1)" in plan
    assert re.search(r"ReadSchema: struct<namespace:string,project_id:string>", plan)


def test_scope_prunes_partitions(spark):
    rows = spark.range(10).select(
        F.when(F.col("id") < 4, "default").otherwise("other").alias("namespace"), "id"
    )
    path = write_parquet(rows, work_dir(spark, "scoped"), partition_by=["namespace"])
    scoped = op.scope_filter(spark.read.parquet(path))
    assert re.search(r"PartitionFilters: \[.*\(namespace#\d+ = default\)", physical(scoped))
    assert scoped.count() == 4
    assert verify_written(spark, path, rows.schema).first().schema_ok


def test_tail_is_limited_before_the_shuffle(spark):
    logs = spark.createDataFrame([], RUN_LOGS)
    outcomes = spark.createDataFrame([], "run_id string, outcome string")
    plan = physical(op.tail_lines(logs, outcomes, sort=False))
    assert re.search(r"WindowGroupLimit .*Partial", plan)


def test_summary_is_one_shuffle_of_three_columns(spark):
    path = work_dir(spark, "inv")
    spark.createDataFrame([], INVENTORY).write.parquet(path)
    plan = physical(op.project_summary(spark.read.parquet(path), sort=False))
    assert plan.count("Exchange") == 1
    assert "ReadSchema: struct<project_id:string,project_name:string,environment:string>" in plan


def test_environments_of_a_hot_project_are_spread(spark, no_broadcast):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        project = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))
        rows = spark.range(150_000).select(
            F.concat(F.lit("ns-"), "id").alias("namespace"),
            F.concat(F.lit("proj-"), project).alias("project_id"),
            F.concat(F.lit("team-"), project).alias("project_name"),
            F.concat(F.lit("env-"), "id").alias("environment"),
            F.lit("Active").alias("phase"),
            F.timestamp_seconds("id").alias("created_at"),
        )
        requests = spark.range(500).select(
            F.col("id").alias("request_id"), F.concat(F.lit("Team-"), "id").alias("project_name")
        )
        out = op.project_environments(requests, rows).withColumn("p", F.spark_partition_id())
        sizes = [r["count"] for r in out.groupBy("p").count().collect()]
        assert sum(sizes) == 50_000 + 333
        # Four partitions: without spreading, one of them would hold all 50,000.
        assert max(sizes) < 25_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_environments_that_do_not_resolve_are_spread(spark, no_broadcast):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        asked = spark.range(8_000).select(
            F.col("id").alias("request_id"), F.lit("nobody").alias("project_name"), F.lit("dev").alias("environment")
        )
        none = spark.range(0).selectExpr(
            "'n' AS namespace", "'i' AS project_id", "'p' AS project_name", "'e' AS environment"
        )
        out = op.resolve_environments(asked, none).withColumn("p", F.spark_partition_id())
        sizes = [r["count"] for r in out.groupBy("p").count().collect()]
        assert sum(sizes) == 8_000 and max(sizes) < 4_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_hot_keys_are_few_and_exact(spark):
    rows = spark.range(10_000).select(
        F.when(F.col("id") < 3_400, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id"
    )
    assert [tuple(r) for r in hot_keys(rows, ["k"], 16).collect()] == [("hot", 6)]
    # A finer share finds more keys; their parts stay below twice the shares.
    two = rows.withColumn("k", F.when(F.col("id") >= 9_000, "warm").otherwise(F.col("k")))
    assert {tuple(r) for r in hot_keys(two, ["k"], 64).collect()} == {("hot", 22), ("warm", 7)}
    assert hot_keys(two, ["k"], 2).count() == 0


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_equals_a_plain_join(spark, no_broadcast, how):
    rows = spark.range(4_000).select(
        F.when(F.col("id") < 1_300, "hot")
        .when(F.col("id") < 2_000, None)
        .when(F.col("id") < 2_500, "warm")
        .otherwise((F.col("id") / 3).cast("int").cast("string"))
        .alias("k"),
        "id",
    )
    right = spark.range(1_000).select(F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("v"))
    right = right.union(spark.createDataFrame([("hot", -1)], "k string, v long"))
    got = lookup(rows, right, "k", how, shares=16)
    want = rows.join(right, "k", how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_lookup_spreads_the_hot_key_and_the_null_key(spark, no_broadcast):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(8_000).select(
            F.when(F.col("id") < 3_000, "hot")
            .when(F.col("id") < 6_000, None)
            .otherwise(F.col("id").cast("string"))
            .alias("k"),
            "id",
        )
        right = spark.createDataFrame([("hot", 1)], "k string, v long").groupBy("k").agg(
            F.max("v").alias("v")
        )
        joined = lookup(rows, right, "k").withColumn("p", F.spark_partition_id())
        most = joined.groupBy("k", "p").count().agg(F.max("count")).first()[0]
        # Four partitions: without spreading, one of them would hold all 3,000.
        assert most < 1_500
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_counts_need_no_list(spark, no_broadcast):
    for name in ("project_counts", "apply_counts"):
        assert "collect_" not in physical(e.queries()[name](spark, SF_DIR))


def test_describing_an_entry_reads_it_once(spark):
    assert physical(e.queries()["describe_entry"](spark, SF_DIR)).count("Scan parquet") == 1
