"""Reports that are kept up to date from changes instead of being computed anew.

The state is how many rows of the inventory give a project each of its names and each of its
environments. States add up, so a change of the inventory is a small state of its own, with
negative counts for what went; reports are computed from the state, for all projects or for
those that a change touches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE_KEY = ("project_id", "side", "value")
NAME, ENVIRONMENT, ROW = "name", "environment", "row"


def report_state(inventory: DataFrame) -> DataFrame:
    """(project_id, side, value, n): rows per project, and per project and name or environment.

    Rows without a project id are in no report and so not in the state; null and empty names
    and environments count as rows of the project alone.
    """
    sides = F.array(
        F.struct(F.lit(ROW).alias("side"), F.lit("").alias("value")),
        F.struct(F.lit(NAME).alias("side"), F.col("project_name").alias("value")),
        F.struct(F.lit(ENVIRONMENT).alias("side"), F.col("environment").alias("value")),
    )
    rows = inventory.where(F.col("project_id") != "").select("project_id", F.inline(sides))
    filled = rows.where((F.col("side") == ROW) | (F.col("value") != ""))
    return filled.groupBy(*STATE_KEY).agg(F.count("*").alias("n"))


def added_up(*states: DataFrame) -> DataFrame:
    """States put together; what counts zero is gone."""
    whole = states[0]
    for state in states[1:]:
        whole = whole.unionByName(state)
    return whole.groupBy(*STATE_KEY).agg(F.sum("n").alias("n")).where(F.col("n") != 0)


def state_change(gone: DataFrame, come: DataFrame) -> DataFrame:
    """The state of a change: inventory rows as they were (``gone``), and as they are now."""
    less = report_state(gone).withColumn("n", -F.col("n"))
    return added_up(less, report_state(come))


def merged_state(state: DataFrame, change: DataFrame, buckets: int | None = None) -> DataFrame:
    """The state after a change. A state that is stored in ``buckets`` of its key is read where
    it lies; only the change moves."""
    moved = change.withColumnRenamed("n", "_n")
    if buckets:
        moved = moved.repartition(buckets, *STATE_KEY)
    n = F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))
    return state.join(moved, list(STATE_KEY), "full_outer").select(*STATE_KEY, n.alias("n")).where(F.col("n") != 0)


def as_inventory(state: DataFrame) -> DataFrame:
    """Rows with (project_id, project_name, environment) from which the reports on projects, their
    environments and inconsistent names come out as from the inventory itself."""
    side, value = F.col("side"), F.col("value")
    return state.select(
        "project_id",
        F.when(side == NAME, value).alias("project_name"),
        F.when(side == ENVIRONMENT, value).alias("environment"),
    )


def refreshed(
    report: DataFrame,
    state: DataFrame,
    change: DataFrame,
    make: Callable[[DataFrame], DataFrame],
    key: Sequence[str] = ("project_id",),
) -> DataFrame:
    """A report per project after a change, from the one before it and the state after it.

    ``make`` computes the report from an inventory; it runs on the projects that the change
    touches, and the rows of all others are kept.
    """
    touched = change.select(*key).distinct()
    anew = make(as_inventory(state.join(touched, list(key), "left_semi")))
    return report.join(touched, list(key), "left_anti").unionByName(anew)
