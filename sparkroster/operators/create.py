"""New projects and environments: the checks, the generated names and the insert in one plan.

Of several requests for the same new row the lowest ``request_id`` gets it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkroster.constants import DEFAULT_ENVIRONMENT, REPO_PREFIX, REPO_URL_ANNOTATION
from sparkroster.functions import new_id, physical_name, repo_name
from sparkroster.operators.change import Changed
from sparkroster.operators.resolve import (
    EXISTS,
    OK,
    judge_parents,
    name_index,
    name_owner,
    project_repos,
    resolution_status,
)
from sparkroster.operators.skew import lookup
from sparkroster.schemas import labels_from_columns


def _insert(inventory: DataFrame, rows: DataFrame, repo_url: str) -> DataFrame:
    """The inventory with rows (namespace, flat label columns, url)."""
    url = F.create_map(F.lit(repo_url), F.col("_url"))
    full = rows.withColumns({"labels": labels_from_columns(), "annotations": url})
    return inventory.unionByName(
        full.select(*[c for c in inventory.columns if c in full.columns]), allowMissingColumns=True
    )


def create_projects(
    inventory: DataFrame,
    requests: DataFrame,
    batch: str,
    repo_base: str,
    repo_prefix: str = REPO_PREFIX,
    environment: str = DEFAULT_ENVIRONMENT,
    repo_url: str = REPO_URL_ANNOTATION,
) -> Changed:
    """Projects of new names, each with its default environment.

    Requests have (request_id, project_name). A name that any project carries is taken.
    Ids are derived from ``batch``, a text that is new for every call, so that a repeated
    task gives the same id. Results have (request_id, project_id, namespace, status): created,
    taken, or id_conflict where the short id is another project's; of new projects with one id
    the lowest request has it. Ask again in another batch.
    """
    asked = name_owner(
        requests.select("request_id", F.lower("project_name").alias("project_name")), inventory
    )
    seed = F.concat_ws("/", F.lit(batch), F.col("request_id").cast("string"), "project_name")
    named = (
        asked.where(~F.col("taken"))
        .groupBy("project_name")
        .agg(F.min("request_id").alias("request_id"))
        .withColumn("project_id", new_id(seed))
    )
    made = (
        named.groupBy("project_id")
        .agg(F.min_by(F.struct("request_id", "project_name"), "request_id").alias("_first"))
        .select("project_id", "_first.*")
        .join(inventory.select("project_id"), "project_id", "left_anti")
        .withColumn("namespace", physical_name("project_id", F.lit(environment)))
    )
    repo = repo_name("project_name", repo_prefix)
    rows = made.select(
        "namespace",
        "project_id",
        "project_name",
        F.lit(environment).alias("environment"),
        repo.alias("repo_name"),
        F.lit(None).cast("string").alias("depends_on"),
        F.concat(F.lit(repo_base), repo).alias("_url"),
    )
    results = (
        asked.select("request_id")
        .join(made.select("request_id", "project_id", "namespace"), "request_id", "left")
        .join(named.select("request_id", F.lit(True).alias("_named")), "request_id", "left")
        .select(
            "request_id",
            "project_id",
            "namespace",
            F.when(F.col("project_id").isNotNull(), "created")
            .when(F.col("_named"), "id_conflict")
            .otherwise("taken")
            .alias("status"),
        )
    )
    return Changed(_insert(inventory, rows, repo_url), results)


def create_environments(
    inventory: DataFrame, requests: DataFrame, repo_url: str = REPO_URL_ANNOTATION
) -> Changed:
    """New environments of named projects, with or without a parent environment.

    Requests have (request_id, project_name, environment, depends_on). Results have
    (request_id, project_id, namespace, status): created, exists, project_not_found,
    no_repo, parent_missing or parent_mismatch.
    """
    asked = requests.select(
        "request_id",
        *[F.lower(c).alias(c) for c in ("project_name", "environment", "depends_on")],
    )
    only_id = resolution_status(F.col("_id_min"), F.col("_id_max")) == OK
    projects = (
        name_index(inventory)
        .select(
            F.col("_name").alias("project_name"), F.when(only_id, F.col("_id_min")).alias("project_id")
        )
        .join(project_repos(inventory, repo_url), "project_id", "left")
    )
    named = lookup(asked, projects, "project_name")
    judged = judge_parents(named, inventory, "environment", "depends_on").withColumn(
        "status",
        F.when(F.col("project_id").isNull(), "project_not_found").otherwise(F.col("status")),
    )
    made = (
        judged.where(F.col("status") == OK)
        .groupBy("namespace")
        .agg(
            F.min_by(
                F.struct(
                    "request_id", "project_id", "project_name", "environment", "depends_on", "_repo"
                ),
                "request_id",
            ).alias("_first")
        )
        .select("namespace", "_first.*")
    )
    rows = made.select(
        "namespace",
        "project_id",
        "project_name",
        "environment",
        F.col("_repo.name").alias("repo_name"),
        F.nullif(F.col("depends_on"), F.lit("")).alias("depends_on"),
        F.col("_repo.url").alias("_url"),
    )
    won = made.select("request_id", F.lit(True).alias("_won"))
    status = (
        F.when(F.col("_won"), "created")
        .when(F.col("status") == OK, EXISTS)
        .otherwise(F.col("status"))
    )
    results = judged.join(won, "request_id", "left").select(
        "request_id", "project_id", "namespace", status.alias("status")
    )
    return Changed(_insert(inventory, rows, repo_url), results)
