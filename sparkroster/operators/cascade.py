"""Renames and drops that touch every row of a project.

All requests are judged against the table as it came in. Of several requests for the same
new name the lowest ``request_id`` wins, then of several winners for the same project; the
others are conflicts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkroster.constants import LABEL_COLUMNS
from sparkroster.functions import merge_patch
from sparkroster.operators.change import CONFLICT, Changed
from sparkroster.operators.report import verdict
from sparkroster.operators.resolve import OK, name_index, resolution_status
from sparkroster.operators.skew import key_counts, lookup


def rename_projects(
    inventory: DataFrame,
    requests: DataFrame,
    columns: dict[str, str] = LABEL_COLUMNS,
) -> Changed:
    """Give projects a new display name on every one of their rows.

    Requests have (request_id, old_name, new_name), the id unique. Results have
    (request_id, project_id, status, total, applied, verdict). The repository name stays.
    """
    names = name_index(inventory)
    old = names.select(
        F.col("_name").alias("_old"),
        F.when(F.col("_id_min") == F.col("_id_max"), F.col("_id_min")).alias("project_id"),
        resolution_status(F.col("_id_min"), F.col("_id_max")).alias("_resolved"),
    )
    new = names.select(F.col("_name").alias("_new"), "_owner_min", "_owner_max")
    asked = requests.select(
        "request_id",
        F.lower("old_name").alias("_old"),
        F.lower("new_name").alias("_new"),
    )
    other = (F.col("_owner_min") != F.col("project_id")) | (
        F.col("_owner_max") != F.col("project_id")
    )
    found = lookup(asked, old, "_old")
    judged = lookup(found, new, "_new", counted=asked).select(
        "request_id",
        "_new",
        "project_id",
        F.when(F.col("_old") == F.col("_new"), "noop")
        .when(F.col("_resolved").isNull(), "not_found")
        .when(F.col("_resolved") != OK, F.col("_resolved"))
        .when(other, CONFLICT)
        .otherwise("renamed")
        .alias("status"),
    )
    going = judged.where(F.col("status") == "renamed")
    by_name = (
        going.groupBy("_new")
        .agg(F.min_by(F.struct("request_id", "project_id"), "request_id").alias("_w"))
        .select("_new", "_w.*")
    )
    rows = key_counts(inventory, ["project_id"])
    winners = (
        by_name.groupBy("project_id")
        .agg(F.min_by(F.struct("request_id", "_new"), "request_id").alias("_w"))
        .select("project_id", "_w.*")
        .join(rows, "project_id")
    )

    label = F.create_map(F.lit(columns["project_name"]), F.col("_new"))
    table = (
        lookup(inventory, winners.select("project_id", "_new"), "project_id")
        .withColumns(
            {
                "project_name": F.coalesce("_new", "project_name"),
                "labels": F.when(
                    F.col("_new").isNotNull(), merge_patch("labels", label)
                ).otherwise(F.col("labels")),
            }
        )
        .select(*inventory.columns)
    )
    won = winners.select("request_id", F.col("n").alias("_rows"))
    settled = judged.join(won, "request_id", "left")
    status = F.when(
        (F.col("status") == "renamed") & F.col("_rows").isNull(), CONFLICT
    ).otherwise(F.col("status"))
    total = F.coalesce("_rows", F.lit(0))
    results = settled.select(
        "request_id",
        "project_id",
        status.alias("status"),
        total.alias("total"),
        total.alias("applied"),
        F.when(status.isin("renamed", "noop"), verdict(total, total))
        .otherwise("none")
        .alias("verdict"),
    )
    return Changed(table, results)


def drop_projects(
    inventory: DataFrame, requests: DataFrame, name: str = "project_name"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(table without the projects, removed rows, results) of strictly resolved requests.

    Requests have (request_id, project_name); results have (request_id, project_id, status,
    removed).
    """
    rows = key_counts(inventory, ["project_id"])
    low, high = F.col("_id_min"), F.col("_id_max")
    status = resolution_status(low, high)
    names = (
        name_index(inventory)
        .select(
            "_name",
            F.when(status == OK, low).alias("project_id"),
            F.when(status == OK, "dropped").otherwise(status).alias("status"),
        )
        .join(rows, "project_id", "left")
    )
    asked = requests.withColumn("_name", F.lower(F.col(name)))
    ids = (
        names.where(F.col("project_id").isNotNull())
        .join(asked.select("_name").distinct(), "_name", "left_semi")
        .select("project_id")
        .distinct()
    )
    kept = lookup(inventory, ids, "project_id", "left_anti").select(*inventory.columns)
    removed = lookup(inventory, ids, "project_id", "left_semi").select(*inventory.columns)
    results = lookup(asked, names, "_name").select(
        "request_id",
        "project_id",
        F.coalesce("status", F.lit("not_found")).alias("status"),
        F.coalesce("n", F.lit(0)).alias("removed"),
    )
    return kept, removed, results
