"""Grouped reports.

List-valued cells (environment names, failed names) are as long as the report shows. Next
to each such report is one with a row per list item and plain counts, for groups whose list
would not fit a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkroster.constants import INCONSISTENT_SUFFIX, NO_DISPLAY_NAME, NOT_AVAILABLE
from sparkroster.functions import iso_time
from sparkroster.operators.resolve import OK, resolve_names
from sparkroster.operators.skew import lookup


def _filled(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def project_counts(inventory: DataFrame) -> DataFrame:
    """One row per project id: lowest name, whether it has several, number of environments.

    No list is collected: rows are reduced per project and environment, then per project.
    """
    per_environment = (
        inventory.where(F.col("project_id") != "")
        .groupBy("project_id", _filled("environment").alias("_environment"))
        .agg(F.min(_filled("project_name")).alias("_low"), F.max(_filled("project_name")).alias("_high"))
    )
    grouped = per_environment.groupBy("project_id").agg(
        F.min("_low").alias("_low"),
        F.max("_high").alias("_high"),
        F.count("_environment").alias("environment_count"),
    )
    return grouped.select(
        "project_id",
        F.coalesce("_low", F.lit(NO_DISPLAY_NAME)).alias("project_display_name"),
        F.coalesce(F.col("_low") != F.col("_high"), F.lit(False)).alias("several_names"),
        "environment_count",
    )


def project_summary(inventory: DataFrame, sort: bool = False) -> DataFrame:
    """One row per project id: display name, number of environments, their names.

    :func:`project_counts` gives the counts and the verdict on names without any list.

    One shuffle: the sets are combined in the map tasks before it, so copies never leave
    their task and a project with a large share of the rows arrives as one set per task.
    Removing copies in a shuffle of their own took twice as long on an inventory without
    any.
    """
    names = F.sort_array(F.collect_set(_filled("project_name")))
    envs = F.sort_array(F.collect_set(_filled("environment")))
    grouped = (
        inventory.where(F.col("project_id") != "")
        .groupBy("project_id")
        .agg(names.alias("_names"), envs.alias("environment_names"))
    )
    display = F.when(F.size("_names") == 0, F.lit(NO_DISPLAY_NAME)).otherwise(
        F.concat(
            F.array_join("_names", ", "),
            F.when(F.size("_names") > 1, F.lit(INCONSISTENT_SUFFIX)).otherwise(F.lit("")),
        )
    )
    out = grouped.select(
        "project_id",
        display.alias("project_display_name"),
        F.size("environment_names").cast("bigint").alias("environment_count"),
        "environment_names",
    )
    return out.orderBy("project_display_name", "project_id") if sort else out


def environments_text(c: Column | str = "environment_names") -> Column:
    """Printed form of an environment list: joined, or a dash when there is none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.size(c) == 0, F.lit("-")).otherwise(F.array_join(c, ", "))


def project_environment_rows(inventory: DataFrame) -> DataFrame:
    """(project_id, environment) rows behind :func:`project_summary`, without any list."""
    return (
        inventory.where((F.col("project_id") != "") & (F.col("environment") != ""))
        .select("project_id", "environment")
        .distinct()
    )


def project_environments(
    requests: DataFrame,
    inventory: DataFrame,
    name: str = "project_name",
    sort: bool = False,
) -> DataFrame:
    """One row per environment of every requested project; unresolved requests give none."""
    asked = (
        resolve_names(requests, inventory, name)
        .where(F.col("status") == OK)
        .withColumn("_asked", F.lower(F.col(name)))
        .drop("status", name)
    )
    keep = [c for c in requests.columns if c != name]
    rows = inventory.where(F.col("environment") != "").select(
        "project_id",
        "project_name",
        "environment",
        "namespace",
        "phase",
        "created_at",
    )
    out = lookup(rows, asked, "project_id", "inner").select(
        *keep,
        "environment",
        "namespace",
        "project_id",
        F.coalesce("project_name", "_asked").alias("project_display_name"),
        F.coalesce("phase", F.lit(NOT_AVAILABLE)).alias("status"),
        iso_time("created_at").alias("created"),
    )
    return out.orderBy(*keep, "environment", "namespace") if sort else out


def apply_counts(results: DataFrame, by: str | list[str], applied: str = "applied") -> DataFrame:
    """(total, applied, verdict) per request; plain counts, combined before the shuffle."""
    by = [by] if isinstance(by, str) else list(by)
    done = F.coalesce(F.col(applied), F.lit(False))
    counted = results.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(done).alias("applied")
    )
    return counted.withColumn("verdict", verdict(F.col("total"), F.col("applied")))


def apply_tally(
    results: DataFrame,
    by: str | list[str],
    name: str = "namespace",
    applied: str = "applied",
) -> DataFrame:
    """(total, applied, failed_names, verdict) per request.

    The list holds the names that failed, which is what the report shows; see
    :func:`failed_rows` for one row per failed name.
    """
    by = [by] if isinstance(by, str) else list(by)
    done = F.coalesce(F.col(applied), F.lit(False))
    return (
        results.groupBy(*by)
        .agg(
            F.count("*").alias("total"),
            F.count_if(done).alias("applied"),
            F.sort_array(F.collect_list(F.when(~done, F.col(name)))).alias("failed_names"),
        )
        .withColumn("verdict", verdict(F.col("total"), F.col("applied")))
    )


def failed_rows(
    results: DataFrame,
    by: str | list[str],
    name: str = "namespace",
    applied: str = "applied",
) -> DataFrame:
    """One row per (request, name) that was not applied."""
    by = [by] if isinstance(by, str) else list(by)
    return results.where(~F.coalesce(F.col(applied), F.lit(False))).select(*by, name)


def verdict(total: Column, applied: Column) -> Column:
    """``all`` (also for nothing to do), ``partial`` or ``none``."""
    return (
        F.when(applied == total, "all").when(applied > 0, "partial").otherwise("none")
    )
