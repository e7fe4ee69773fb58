"""Bloom filters of requests, and reports kept up to date."""

import random

import pytest
from pyspark.sql import functions as F

from sparkroster import operators as op
from sparkroster.operators.narrow import bloom_blocks
from sparkroster.schemas import INVENTORY


def inventory(spark, seed, n=400):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        project = rnd.choice([None, "", *[f"p{k}" for k in range(60)]])
        name = rnd.choice([None, "", f"team-{rnd.randrange(40)}"])
        rows.append((f"ns{i}", project, name, rnd.choice([None, "", "dev", "qa", "prod"]), None, None, {}, {}, None, None))
    return spark.createDataFrame(rows, INVENTORY)


def shown(df):
    return sorted(str(r) for r in df.collect())


@pytest.mark.parametrize("most_blocks", [1 << 15, 1])
def test_every_asked_value_stays_and_few_others(spark, most_blocks):
    asked = spark.range(3000).select(F.concat(F.lit("v"), F.col("id") * 7).alias("v")).union(spark.sql("SELECT CAST(NULL AS STRING)"))
    rows = spark.range(60_000).select("id", F.when(F.col("id") % 10 > 0, F.concat(F.lit("v"), "id")).alias("name"))
    left = op.possibly_in(rows, "name", asked, most_blocks=most_blocks)
    wanted = rows.join(asked, F.col("name") == F.col("v"), "left_semi")
    assert left.columns == rows.columns
    assert wanted.join(left, "id", "left_anti").count() == 0
    assert left.where("name IS NULL").count() == 0
    others = left.join(wanted, "id", "left_anti").count()
    # The bound on blocks costs precision, never a row.
    assert others < (120 if most_blocks > 1 else 60_000)
    blocks, n = bloom_blocks(asked, 3000, most_blocks)
    assert blocks.count() <= n <= most_blocks


def test_narrowed_lookups_give_the_same(spark):
    inv = inventory(spark, 3)
    asked = spark.createDataFrame(
        [(i, f"TEAM-{i % 23}" if i % 9 else None, ["dev", "QA", "none"][i % 3]) for i in range(50)],
        "request_id long, project_name string, environment string",
    )
    narrow = op.narrowed(inv, asked)
    names = {f"team-{i % 23}" for i in range(50) if i % 9}
    assert {r.project_name for r in narrow.collect()} >= {r.project_name for r in inv.collect()} & names
    for act in (op.resolve_names, op.name_owner, op.resolve_environments):
        assert shown(act(asked, inv, narrow=True)) == shown(act(asked, inv))
    assert shown(op.resolve_names(asked.limit(0), inv, narrow=True)) == []
    assert shown(op.resolve_names(asked, inv.limit(0), narrow=True)) == shown(op.resolve_names(asked, inv.limit(0)))


def test_the_filter_stands_below_the_shuffle(spark):
    """In the plan the inventory meets the filter before its first exchange."""
    inv = inventory(spark, 4)
    asked = spark.createDataFrame([(1, "team-1")], "request_id long, project_name string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = op.resolve_names(asked, inv, narrow=True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.split("\n")
    scan = next(i for i, line in enumerate(lines) if "namespace#" in line and "Scan" in line)
    depth = len(lines[scan]) - len(lines[scan].lstrip(" :+-|"))
    for line in reversed(lines[:scan]):
        at = len(line) - len(line.lstrip(" :+-|"))
        if at < depth:
            depth = at
            what = line.lstrip(" :+-|*()0123456789")
            assert not what.startswith("Exchange"), plan
            if what.startswith("BroadcastHashJoin"):
                return
    raise AssertionError(plan)


@pytest.mark.parametrize("seed", [1, 2])
def test_reports_from_merged_states_equal_a_full_recompute(spark, seed):
    now = inventory(spark, seed)
    state = op.report_state(now)
    summary = op.project_summary(now)
    rnd = random.Random(seed)
    for step in range(3):
        names = [f"ns{i}" for i in rnd.sample(range(400), 60)]
        touched = F.col("namespace").isin(names)
        gone = now.where(touched)
        kind = F.pmod(F.xxhash64("namespace", F.lit(step)), F.lit(3))
        come = gone.where(kind > 0).withColumns(
            {
                "project_name": F.when(kind == 1, F.lit(f"renamed-{step}")).otherwise(F.col("project_name")),
                "environment": F.when(kind == 2, F.lit("moved")).otherwise(F.col("environment")),
            }
        )
        change = op.state_change(gone, come)
        now = spark.createDataFrame(now.where(~touched).unionByName(come).collect(), INVENTORY)
        state = spark.createDataFrame(op.merged_state(state, change).collect(), state.schema)
        assert shown(state) == shown(op.report_state(now).select(*state.columns))
        summary = op.refreshed(summary, state, change, op.project_summary)
        summary = spark.createDataFrame(summary.collect(), summary.schema)
        assert shown(summary) == shown(op.project_summary(now))
        as_inv = op.as_inventory(state)
        assert shown(op.project_counts(as_inv)) == shown(op.project_counts(now))
        assert shown(op.project_environment_rows(as_inv)) == shown(op.project_environment_rows(now))
        assert shown(op.inconsistent_names(as_inv)) == shown(op.inconsistent_names(now))


def test_states_add_up_in_any_grouping(spark):
    parts = [op.report_state(inventory(spark, s, 80)) for s in (5, 6, 7)]
    whole = op.added_up(*parts)
    assert shown(op.added_up(op.added_up(parts[2], parts[0]), parts[1])) == shown(whole)
    less = parts[1].withColumn("n", -F.col("n"))
    assert shown(op.added_up(whole, less)) == shown(op.added_up(parts[0], parts[2]))


def test_a_stored_state_is_not_shuffled(spark):
    from sparkroster.operators.upkeep import STATE_KEY
    from sparkroster.sources import store

    state = op.report_state(inventory(spark, 9))
    stored = store(state, "kept_state", 3, STATE_KEY)
    change = op.report_state(inventory(spark, 10, 50))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        merged = op.merged_state(stored, change, 3)
        plan = merged._jdf.queryExecution().executedPlan().toString()
        lines = plan.split("\n")
        at = next(i for i, line in enumerate(lines) if "FileScan" in line)
        join = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
        assert not any("Exchange" in line for line in lines[join:at])
        assert shown(merged) == shown(op.added_up(state, change))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
