"""Name resolution and integrity checks: many requests against one inventory.

Every lookup joins the requests to something with one row per key, so no join here can
multiply rows, as long as the inventory has one row per namespace. Where that is an aggregate, :func:`~sparkroster.operators.skew.lookup`
spreads a name or project that very many requests share; where both sides are plain
tables, the adaptive skew join splits it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkroster.constants import REPO_URL_ANNOTATION
from sparkroster.functions import physical_name
from sparkroster.operators.narrow import narrowed, possibly_in
from sparkroster.operators.skew import key_counts, lookup

OK = "ok"
NOT_FOUND = "not_found"
AMBIGUOUS = "ambiguous"
EXISTS = "exists"


def only_named(inventory: DataFrame, requests: DataFrame, *names: str) -> DataFrame:
    """Rows of the inventory that carry a requested project name.

    For few requests against a large inventory: a request table that the engine broadcasts
    filters the inventory in its scan, before anything is grouped or shuffled. Name and
    owner lookups give the same results on the rows that are left.
    """
    asked = None
    for name in names or ("project_name",):
        one = requests.select(F.lower(F.col(name)).alias("project_name"))
        asked = one if asked is None else asked.union(one)
    return inventory.join(asked.distinct(), "project_name", "left_semi").select(*inventory.columns)


def name_index(inventory: DataFrame) -> DataFrame:
    """One row per project name with its lowest and highest id.

    Two ids differ exactly when the lowest and the highest differ, so no distinct count is
    needed and a name held by very many rows is reduced before the shuffle.
    """
    filled = F.nullif(F.col("project_id"), F.lit(""))
    return (
        inventory.where(F.col("project_name").isNotNull())
        .groupBy(F.col("project_name").alias("_name"))
        .agg(
            F.min("project_id").alias("_id_min"),
            F.max("project_id").alias("_id_max"),
            F.min(filled).alias("_owner_min"),
            F.max(filled).alias("_owner_max"),
        )
    )


def resolution_status(low: Column, high: Column) -> Column:
    """Strict rule: no id, several ids, or exactly one."""
    return (
        F.when(low.isNull(), NOT_FOUND).when(low != high, AMBIGUOUS).otherwise(OK)
    )


def _with_index(requests: DataFrame, inventory: DataFrame, name: str) -> DataFrame:
    keyed = requests.withColumn("_name", F.lower(F.col(name)))
    return lookup(keyed, name_index(inventory), "_name")


def resolve_names(
    requests: DataFrame,
    inventory: DataFrame,
    name: str = "project_name",
    narrow: bool = False,
) -> DataFrame:
    """Requests with (project_id, status); the id is given only when it is the only one.

    With ``narrow`` the requested names are counted and a Bloom filter of them is applied in
    the scan of the inventory, so that the rows shuffled follow the requests; for requests
    that name a small part of a huge inventory, yet too many for a broadcast.
    """
    if narrow:
        inventory = narrowed(inventory, requests, name)
    found = _with_index(requests, inventory, name)
    status = resolution_status(F.col("_id_min"), F.col("_id_max"))
    return found.select(
        *[F.col(c) for c in requests.columns],
        F.when(status == OK, F.col("_id_min")).alias("project_id"),
        status.alias("status"),
    )


def name_owner(
    requests: DataFrame,
    inventory: DataFrame,
    name: str = "project_name",
    narrow: bool = False,
) -> DataFrame:
    """Requests with (owner_id, taken, multi_owner): any non-empty id takes the name. For
    ``narrow`` see :func:`resolve_names`."""
    if narrow:
        inventory = narrowed(inventory, requests, name)
    found = _with_index(requests, inventory, name)
    return found.select(
        *[F.col(c) for c in requests.columns],
        F.col("_owner_min").alias("owner_id"),
        F.col("_owner_min").isNotNull().alias("taken"),
        F.coalesce(F.col("_owner_min") != F.col("_owner_max"), F.lit(False)).alias("multi_owner"),
    )


def _spread_nulls(c: Column, rows: DataFrame) -> Column:
    """A join key whose nulls become values that match nothing and do not meet in one task."""
    nested = ("map", "struct", "array", "variant")
    plain = [f.name for f in rows.schema.fields if f.dataType.typeName() not in nested]
    apart = F.concat(F.lit(" "), (F.xxhash64(*plain) if plain else F.lit(0)).cast("string"))
    return F.coalesce(c, apart)


def resolve_environments(
    requests: DataFrame,
    inventory: DataFrame,
    name: str = "project_name",
    environment: str = "environment",
    narrow: bool = False,
) -> DataFrame:
    """Requests with (project_id, namespace, status) of the named environment.

    With ``narrow`` the inventory is filtered in its scan twice, by requested names and by
    the namespaces that these give; see :func:`resolve_names`.
    """
    named = resolve_names(requests, inventory, name, narrow).withColumn(
        "_ns", physical_name("project_id", F.lower(F.col(environment)))
    )
    known = inventory.select(F.col("namespace").alias("_ns"), F.lit(True).alias("_there"))
    if narrow:
        known = possibly_in(known, "_ns", named.select("_ns"), requests.count())
    status = (
        F.when(F.col("status") != OK, "project_not_found")
        .when(F.col("_there").isNull(), "environment_not_found")
        .otherwise(OK)
    )
    key = _spread_nulls(F.col("_ns"), requests)
    return named.join(known.withColumnRenamed("_ns", "_at"), key == F.col("_at"), "left").select(
        *[F.col(c) for c in requests.columns],
        "project_id",
        F.when(F.col("_there"), F.col("_ns")).alias("namespace"),
        status.alias("status"),
    )


def _labels_at(inventory: DataFrame, tag: str) -> DataFrame:
    return inventory.select(
        F.col("namespace").alias(f"_{tag}_ns"),
        F.col("project_id").alias(f"_{tag}_id"),
        F.col("environment").alias(f"_{tag}_env"),
        F.lit(True).alias(f"_{tag}_found"),
    )


def check_parents(
    requests: DataFrame,
    inventory: DataFrame,
    environment: str = "environment",
    parent: str = "depends_on",
    repo_url: str = REPO_URL_ANNOTATION,
) -> DataFrame:
    """Requests (project_id, new environment, parent) with the status of the creation.

    Adds (namespace, status).
    """
    known = lookup(requests, project_repos(inventory, repo_url), "project_id")
    return judge_parents(known, inventory, environment, parent).select(
        *requests.columns, "namespace", "status"
    )


def project_repos(inventory: DataFrame, repo_url: str = REPO_URL_ANNOTATION) -> DataFrame:
    """(project_id, _repo): the repository (name, url) of the first namespace by name."""
    repo = F.struct(
        F.nullif(F.col("repo_name"), F.lit("")).alias("name"),
        F.nullif(F.col("annotations")[repo_url], F.lit("")).alias("url"),
    )
    return (
        inventory.where(F.col("project_id").isNotNull())
        .groupBy("project_id")
        .agg(F.min_by(repo, "namespace").alias("_repo"))
    )


def judge_parents(
    requests: DataFrame, inventory: DataFrame, environment: str, parent: str
) -> DataFrame:
    """Requests that have their project's ``_repo``, with (namespace, status)."""
    env, par = F.lower(F.col(environment)), F.lower(F.col(parent))
    named = requests.withColumns(
        {
            "_new_ns": physical_name("project_id", env),
            "_par_ns": F.when(
                F.coalesce(par, F.lit("")) != "", physical_name("project_id", par)
            ),
        }
    )
    taken = inventory.select(F.col("namespace").alias("_new_ns"), F.lit(True).alias("_taken"))
    joined = named.join(taken, "_new_ns", "left").join(
        _labels_at(inventory, "par").withColumnRenamed("_par_ns", "_par_at"),
        _spread_nulls(F.col("_par_ns"), requests) == F.col("_par_at"),
        "left",
    )
    same = F.col("_par_id").eqNullSafe(F.col("project_id")) & F.col("_par_env").eqNullSafe(par)
    status = (
        F.when(F.col("_taken"), EXISTS)
        .when(F.col("_repo.name").isNull() | F.col("_repo.url").isNull(), "no_repo")
        .when(F.col("_par_ns").isNull(), OK)
        .when(F.col("_par_found").isNull(), "parent_missing")
        .when(~same, "parent_mismatch")
        .otherwise(OK)
    )
    return joined.select(
        *[F.col(c) for c in requests.columns],
        F.col("_new_ns").alias("namespace"),
        status.alias("status"),
    )


def check_delete_targets(
    requests: DataFrame, inventory: DataFrame, environment: str = "environment"
) -> DataFrame:
    """Requests (project_id, environment) with the status of the deletion."""
    env = F.lower(F.col(environment))
    r = requests.withColumn("_del_ns", physical_name("project_id", env))
    joined = r.join(_labels_at(inventory, "del"), "_del_ns", "left")
    same = F.col("_del_id").eqNullSafe(F.col("project_id")) & F.col("_del_env").eqNullSafe(env)
    status = (
        F.when(F.col("_del_found").isNull(), NOT_FOUND).when(~same, "unsafe").otherwise(OK)
    )
    return joined.select(
        *[F.col(c) for c in requests.columns],
        F.col("_del_ns").alias("namespace"),
        status.alias("status"),
    )


def inconsistent_pairs(inventory: DataFrame) -> DataFrame:
    """(side, key, value) rows that break the one-name-one-id rule, in both directions.

    One row per offending pair and no list, so a key with any number of values is fine.
    Pairs are distinct, so a key with more than one of them is an offender.
    """
    pairs = (
        inventory.where(F.col("project_name").isNotNull() & F.col("project_id").isNotNull())
        .where((F.col("project_name") != "") & (F.col("project_id") != ""))
        .select("project_name", "project_id")
        .distinct()
    )

    def side(label: str, key: str, value: str) -> DataFrame:
        bad = key_counts(pairs, [key]).where(F.col("n") > 1).select(key)
        return lookup(pairs, bad, key, "left_semi").select(
            F.lit(label).alias("side"), F.col(key).alias("key"), F.col(value).alias("value")
        )

    return side("name", "project_name", "project_id").unionByName(
        side("id", "project_id", "project_name")
    )


def inconsistent_names(inventory: DataFrame) -> DataFrame:
    """(side, key, values, n): the pairs of :func:`inconsistent_pairs`, one row per key.

    The list is a cell of the report, as long as the report shows; read the pairs where a
    key may have more values than a cell should hold.
    """
    return (
        inconsistent_pairs(inventory)
        .groupBy("side", "key")
        .agg(F.sort_array(F.collect_list("value")).alias("values"), F.count("*").alias("n"))
    )
