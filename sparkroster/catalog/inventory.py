"""Inventory queries: selection, resolution, integrity, reports, cascades.

The inventory is derived from all orders: one namespace per customer and priority. Names
are shared by every second pair of customers, some ids carry two names, one priority has
no environment label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkroster import operators as op
from sparkroster.catalog.base import REGISTRY, dash_sql, iso_sql, query, string_map, table
from sparkroster.functions import physical_name
from sparkroster.schemas import labels_from_columns

_SEGMENTS = ("HOUSEHOLD", "MACHINERY", "FURNITURE", "BUILDING", "AUTOMOBILE")


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory with flat label columns and label maps."""
    state = (
        F.when(F.col("o_orderstatus") == "P", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    )
    grouped = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey", "o_orderpriority")
        .agg(
            F.min("o_totalprice").alias("low"),
            F.max(state).alias("state"),
            F.min("o_orderdate").cast("timestamp").alias("created_at"),
        )
    )
    key = F.col("o_custkey").cast("string")
    priority = F.lower("o_orderpriority")
    team = F.floor(F.col("o_custkey") * 2 / 3).cast("string")
    flat = grouped.select(
        physical_name(F.concat(F.lit("proj-"), key), priority).alias("namespace"),
        F.concat(F.lit("proj-"), key).alias("project_id"),
        F.when(F.col("low") < 20000, F.concat(F.lit("legacy-"), key))
        .otherwise(F.concat(F.lit("team-"), team))
        .alias("project_name"),
        F.nullif(priority, F.lit("4-not specified")).alias("environment"),
        F.when(F.col("low") < 300000, F.concat(F.lit("project-"), key)).alias("repo_name"),
        F.when(priority == "2-high", "1-urgent").alias("depends_on"),
        F.when(F.col("state") > 0, F.concat(F.lit("git/"), key)).alias("url"),
        F.when(F.col("state") == 2, "Active").when(F.col("state") == 1, "Terminating").alias(
            "phase"
        ),
        "created_at",
    )
    return flat.select(
        "namespace",
        "project_id",
        "project_name",
        "environment",
        "repo_name",
        "depends_on",
        labels_from_columns().alias("labels"),
        string_map(repo__url=F.col("url")).alias("annotations"),
        "phase",
        "created_at",
    )


INV = f"""inv AS (
  SELECT substr('proj-' || o_custkey || '-' || {dash_sql("lower(o_orderpriority)")}, 1, 63)
           AS namespace,
         'proj-' || o_custkey AS project_id,
         CASE WHEN min(o_totalprice) < 20000 THEN 'legacy-' || o_custkey
              ELSE 'team-' || ((o_custkey * 2) // 3) END AS project_name,
         nullif(lower(o_orderpriority), '4-not specified') AS environment,
         CASE WHEN min(o_totalprice) < 300000 THEN 'project-' || o_custkey END AS repo_name,
         CASE WHEN lower(o_orderpriority) = '2-high' THEN '1-urgent' END AS depends_on,
         CASE WHEN max(o_orderstatus) IN ('P', 'O') THEN 'git/' || o_custkey END AS repo_url,
         CASE max(o_orderstatus) WHEN 'P' THEN 'Active' WHEN 'O' THEN 'Terminating' END AS phase,
         min(o_orderdate) AS created_at
  FROM orders GROUP BY o_custkey, o_orderpriority)"""

NAMES = """names AS (
  SELECT project_name, min(project_id) AS id_min, count(DISTINCT project_id) AS n_ids
  FROM inv WHERE project_name IS NOT NULL GROUP BY project_name)"""


def _by_segment(*values: str | None):
    case = F.lit(None).cast("string")
    for segment, value in zip(_SEGMENTS, values):
        case = F.when(F.col("c_mktsegment") == segment, F.lit(value)).otherwise(case)
    return case


def _by_segment_sql(*values: str | None) -> str:
    whens = " ".join(
        f"WHEN '{s}' THEN " + ("NULL" if v is None else f"'{v}'")
        for s, v in zip(_SEGMENTS, values)
    )
    return f"CASE c_mktsegment {whens} END"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per customer, in upper case; a third of the names does not exist."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("request_id"),
        F.concat(F.lit("TEAM-"), F.col("c_custkey").cast("string")).alias("project_name"),
        _by_segment("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "Sandbox").alias(
            "environment"
        ),
    )


REQ = f"""req AS (
  SELECT c_custkey AS request_id, 'TEAM-' || c_custkey AS project_name,
         {_by_segment_sql("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "Sandbox")}
           AS environment
  FROM customer)"""

RESOLVED = """resolved AS (
  SELECT r.request_id, r.project_name, r.environment,
         CASE WHEN n.n_ids = 1 THEN n.id_min END AS project_id,
         CASE WHEN coalesce(n.n_ids, 0) = 0 THEN 'not_found' WHEN n.n_ids > 1 THEN 'ambiguous'
              ELSE 'ok' END AS status
  FROM req r LEFT JOIN names n ON n.project_name = lower(r.project_name))"""


@query(
    f"""WITH {INV} SELECT namespace, project_id, project_name FROM inv
    WHERE environment = '1-urgent'"""
)
def label_equals(spark, sf_dir):
    rows = op.label_select(inventory(spark, sf_dir), "environment=1-urgent")
    return rows.select("namespace", "project_id", "project_name")


@query(f"WITH {INV} SELECT namespace, depends_on FROM inv WHERE depends_on IS NOT NULL")
def label_exists(spark, sf_dir):
    rows = op.label_select(inventory(spark, sf_dir), "depends-on")
    return rows.select("namespace", "depends_on")


@query(
    f"""WITH {INV} SELECT namespace, repo_url FROM inv
    WHERE repo_url IS NOT NULL AND repo_name IS NOT NULL"""
)
def label_in_map(spark, sf_dir):
    labelled = op.label_select(inventory(spark, sf_dir), "repo-name", columns={})
    url = F.col("annotations")["repo-url"]
    return labelled.where(url.isNotNull()).select("namespace", url.alias("repo_url"))


@query(f"WITH {INV}, {NAMES}, {REQ}, {RESOLVED} SELECT request_id, project_id, status FROM resolved")
def resolve_names(spark, sf_dir):
    out = op.resolve_names(_requests(spark, sf_dir), inventory(spark, sf_dir))
    return out.select("request_id", "project_id", "status")


@query(
    f"""WITH {INV}, {NAMES}, {REQ}
    SELECT r.request_id, n.id_min AS owner_id, n.id_min IS NOT NULL AS taken,
           coalesce(n.n_ids, 0) > 1 AS multi_owner
    FROM req r LEFT JOIN names n ON n.project_name = lower(r.project_name)"""
)
def name_owner(spark, sf_dir):
    out = op.name_owner(_requests(spark, sf_dir), inventory(spark, sf_dir))
    return out.select("request_id", "owner_id", "taken", "multi_owner")


@query(
    f"""WITH {INV}, {REQ}
    SELECT namespace, project_id, project_name FROM inv
    WHERE project_name IN (SELECT lower(project_name) FROM req)"""
)
def only_named(spark, sf_dir):
    rows = op.only_named(inventory(spark, sf_dir), _requests(spark, sf_dir))
    return rows.select("namespace", "project_id", "project_name")


_ENV_NS = f"substr(r.project_id || '-' || {dash_sql('lower(r.environment)')}, 1, 63)"


@query(
    f"""WITH {INV}, {NAMES}, {REQ}, {RESOLVED}
    SELECT r.request_id, r.project_id, i.namespace,
           CASE WHEN r.status <> 'ok' THEN 'project_not_found'
                WHEN i.namespace IS NULL THEN 'environment_not_found' ELSE 'ok' END AS status
    FROM resolved r LEFT JOIN inv i ON i.namespace = {_ENV_NS}"""
)
def resolve_environments(spark, sf_dir):
    out = op.resolve_environments(_requests(spark, sf_dir), inventory(spark, sf_dir))
    return out.select("request_id", "project_id", "namespace", "status")


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("request_id"),
        F.concat(F.lit("proj-"), F.col("c_custkey").cast("string")).alias("project_id"),
        _by_segment("Staging", "1-URGENT", "qa", "qa", "qa").alias("environment"),
        _by_segment("2-HIGH", None, "4-NOT SPECIFIED", "nowhere", "").alias("depends_on"),
    )


@query(
    f"""WITH {INV}, repo AS (
      SELECT project_id, arg_min({{'n': repo_name, 'u': repo_url}}, namespace) AS r
      FROM inv GROUP BY project_id),
    req AS (
      SELECT c_custkey AS request_id, 'proj-' || c_custkey AS project_id,
             lower({_by_segment_sql("Staging", "1-URGENT", "qa", "qa", "qa")}) AS env,
             nullif(lower({_by_segment_sql("2-HIGH", None, "4-NOT SPECIFIED", "nowhere", "")}), '')
               AS par
      FROM customer),
    named AS (
      SELECT *, substr(project_id || '-' || {dash_sql("env")}, 1, 63) AS new_ns,
             substr(project_id || '-' || {dash_sql("par")}, 1, 63) AS par_ns FROM req)
    SELECT n.request_id, n.new_ns AS namespace,
           CASE WHEN t.namespace IS NOT NULL THEN 'exists'
                WHEN repo.r.n IS NULL OR repo.r.u IS NULL THEN 'no_repo'
                WHEN n.par IS NULL THEN 'ok'
                WHEN p.namespace IS NULL THEN 'parent_missing'
                WHEN p.project_id IS DISTINCT FROM n.project_id
                  OR p.environment IS DISTINCT FROM n.par THEN 'parent_mismatch'
                ELSE 'ok' END AS status
    FROM named n LEFT JOIN inv t ON t.namespace = n.new_ns
    LEFT JOIN repo ON repo.project_id = n.project_id
    LEFT JOIN inv p ON p.namespace = n.par_ns"""
)
def check_parents(spark, sf_dir):
    out = op.check_parents(_targets(spark, sf_dir), inventory(spark, sf_dir))
    return out.select("request_id", "namespace", "status")


@query(
    f"""WITH {INV}, req AS (
      SELECT c_custkey AS request_id, 'proj-' || c_custkey AS project_id,
             lower({_by_segment_sql("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "Sandbox")})
               AS environment
      FROM customer),
    named AS (SELECT r.*, {_ENV_NS} AS ns FROM req r)
    SELECT n.request_id, n.ns AS namespace,
           CASE WHEN i.namespace IS NULL THEN 'not_found'
                WHEN i.project_id IS DISTINCT FROM n.project_id
                  OR i.environment IS DISTINCT FROM n.environment THEN 'unsafe'
                ELSE 'ok' END AS status
    FROM named n LEFT JOIN inv i ON i.namespace = n.ns"""
)
def check_delete_targets(spark, sf_dir):
    requests = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("request_id"),
        F.concat(F.lit("proj-"), F.col("c_custkey").cast("string")).alias("project_id"),
        _by_segment("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "Sandbox").alias(
            "environment"
        ),
    )
    out = op.check_delete_targets(requests, inventory(spark, sf_dir))
    return out.select("request_id", "namespace", "status")


_PAIRS = """pairs AS (SELECT DISTINCT project_name, project_id FROM inv),
    sides AS (
      SELECT 'name' AS side, project_name AS key, project_id AS value FROM pairs
      UNION ALL SELECT 'id', project_id, project_name FROM pairs),
    bad AS (SELECT side, key, count(*) AS n FROM sides GROUP BY side, key HAVING count(*) > 1)"""


@query(f"WITH {INV}, {_PAIRS} SELECT side, key, value FROM sides JOIN bad USING (side, key)")
def inconsistent_pairs(spark, sf_dir):
    return op.inconsistent_pairs(inventory(spark, sf_dir))


@query(
    f"""WITH {INV}, {_PAIRS}
    SELECT side, key, string_agg(value, ', ' ORDER BY value) AS "values", min(n) AS n
    FROM sides JOIN bad USING (side, key) GROUP BY side, key"""
)
def inconsistent_names(spark, sf_dir):
    out = op.inconsistent_names(inventory(spark, sf_dir))
    return out.withColumn("values", F.array_join("values", ", "))


PROJECT_SUMMARY_SQL = f"""WITH {INV}, g AS (
      SELECT project_id,
             list_sort(list_distinct(list(project_name))) AS ns,
             list_sort(list_distinct(list(environment))) AS es
      FROM inv WHERE project_id <> '' GROUP BY project_id)
    SELECT project_id,
           CASE WHEN len(ns) = 0 THEN '[No Display Name Label]'
                WHEN len(ns) > 1 THEN array_to_string(ns, ', ')
                  || ' (Warning: Inconsistent display names for this ID)'
                ELSE ns[1] END AS project_display_name,
           len(es)::BIGINT AS environment_count,
           CASE WHEN len(es) = 0 THEN '-' ELSE array_to_string(es, ', ') END AS environment_names
    FROM g ORDER BY project_display_name, project_id"""


@query(PROJECT_SUMMARY_SQL)
def project_summary(spark, sf_dir):
    out = op.project_summary(inventory(spark, sf_dir))
    return out.withColumn("environment_names", op.environments_text())


@query(
    f"""WITH {INV} SELECT project_id,
           coalesce(min(nullif(project_name, '')), '[No Display Name Label]') AS project_display_name,
           count(DISTINCT nullif(project_name, '')) > 1 AS several_names,
           count(DISTINCT nullif(environment, '')) AS environment_count
    FROM inv WHERE project_id <> '' GROUP BY project_id"""
)
def project_counts(spark, sf_dir):
    return op.project_counts(inventory(spark, sf_dir))


@query(f"WITH {INV} SELECT DISTINCT project_id, environment FROM inv WHERE environment <> ''")
def project_environment_rows(spark, sf_dir):
    return op.project_environment_rows(inventory(spark, sf_dir))


@query(
    f"""WITH {INV}, {NAMES}, {REQ}, {RESOLVED}
    SELECT r.request_id, i.environment, i.namespace, r.project_id,
           coalesce(i.project_name, lower(r.project_name)) AS project_display_name,
           coalesce(i.phase, 'N/A') AS status,
           coalesce({iso_sql("i.created_at")}, 'N/A') AS created
    FROM resolved r JOIN inv i ON i.project_id = r.project_id
    WHERE r.status = 'ok' AND i.environment <> ''"""
)
def project_environments(spark, sf_dir):
    requests = _requests(spark, sf_dir).select("request_id", "project_name")
    return op.project_environments(requests, inventory(spark, sf_dir))


def _new_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two customers ask for each new name; the names of one segment exist already."""
    key = F.col("c_custkey")
    name = F.when(
        F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("Team-"), key.cast("string"))
    ).otherwise(F.concat(F.lit("Fresh App "), F.floor(key / 2).cast("string")))
    return table(spark, sf_dir, "customer").select(
        key.alias("request_id"), name.alias("project_name")
    )


_FOUNDED = f"""{INV}, req AS (
      SELECT c_custkey AS request_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'team-' || c_custkey
               ELSE 'fresh app ' || (c_custkey // 2) END AS project_name
      FROM customer),
    made AS (
      SELECT project_name, min(request_id) AS request_id,
             'proj-' || substr(sha256('b1/' || min(request_id) || '/' || project_name), 1, 12)
               AS project_id
      FROM req WHERE project_name NOT IN (SELECT project_name FROM inv WHERE project_id <> '')
      GROUP BY project_name)"""


@query(
    f"""WITH {_FOUNDED}
    SELECT namespace, project_id, project_name, environment, repo_name, repo_url,
           project_name AS label FROM inv
    UNION ALL
    SELECT project_id || '-dev', project_id, project_name, 'dev',
           'project-' || {dash_sql("project_name")}, 'git/project-' || {dash_sql("project_name")},
           project_name
    FROM made"""
)
def create_projects(spark, sf_dir):
    done = op.create_projects(inventory(spark, sf_dir), _new_projects(spark, sf_dir), "b1", "git/")
    return done.table.select(
        "namespace",
        "project_id",
        "project_name",
        "environment",
        "repo_name",
        F.col("annotations")["repo-url"].alias("repo_url"),
        F.col("labels")["project-name"].alias("label"),
    )


@query(
    f"""WITH {_FOUNDED}
    SELECT r.request_id, m.project_id, m.project_id || '-dev' AS namespace,
           CASE WHEN m.project_id IS NULL THEN 'taken' ELSE 'created' END AS status
    FROM req r LEFT JOIN made m ON m.request_id = r.request_id"""
)
def create_projects_results(spark, sf_dir):
    asked = _new_projects(spark, sf_dir)
    return op.create_projects(inventory(spark, sf_dir), asked, "b1", "git/").results


def _new_environments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two customers ask for each new environment, by segment with different parents."""
    name = F.concat(F.lit("TEAM-"), F.floor(F.col("c_custkey") / 2).cast("string"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("request_id"),
        name.alias("project_name"),
        _by_segment("Staging", "1-URGENT", "qa", "qa", "qa").alias("environment"),
        _by_segment("2-HIGH", None, "4-NOT SPECIFIED", "nowhere", "").alias("depends_on"),
    )


_GROWN = f"""{INV}, {NAMES}, repo AS (
      SELECT project_id, arg_min({{'n': repo_name, 'u': repo_url}}, namespace) AS r
      FROM inv GROUP BY project_id),
    req AS (
      SELECT c_custkey AS request_id, 'team-' || (c_custkey // 2) AS project_name,
             lower({_by_segment_sql("Staging", "1-URGENT", "qa", "qa", "qa")}) AS env,
             nullif(lower({_by_segment_sql("2-HIGH", None, "4-NOT SPECIFIED", "nowhere", "")}), '')
               AS par
      FROM customer),
    named AS (
      SELECT r.*, CASE WHEN n.n_ids = 1 THEN n.id_min END AS project_id FROM req r
      LEFT JOIN names n ON n.project_name = r.project_name),
    spaced AS (
      SELECT *, substr(project_id || '-' || {dash_sql("env")}, 1, 63) AS namespace,
             substr(project_id || '-' || {dash_sql("par")}, 1, 63) AS par_ns FROM named),
    judged AS (
      SELECT s.*, repo.r,
             CASE WHEN s.project_id IS NULL THEN 'project_not_found'
                  WHEN t.namespace IS NOT NULL THEN 'exists'
                  WHEN repo.r.n IS NULL OR repo.r.u IS NULL THEN 'no_repo'
                  WHEN s.par IS NULL THEN 'ok'
                  WHEN p.namespace IS NULL THEN 'parent_missing'
                  WHEN p.project_id IS DISTINCT FROM s.project_id
                    OR p.environment IS DISTINCT FROM s.par THEN 'parent_mismatch'
                  ELSE 'ok' END AS status
      FROM spaced s LEFT JOIN inv t ON t.namespace = s.namespace
      LEFT JOIN repo ON repo.project_id = s.project_id
      LEFT JOIN inv p ON p.namespace = s.par_ns),
    won AS (SELECT min(request_id) AS request_id FROM judged WHERE status = 'ok'
            GROUP BY namespace)"""


@query(
    f"""WITH {_GROWN}
    SELECT namespace, project_id, project_name, environment, repo_name, depends_on, repo_url
    FROM inv UNION ALL
    SELECT namespace, project_id, project_name, env, r.n, par, r.u FROM judged
    WHERE request_id IN (SELECT request_id FROM won)"""
)
def create_environments(spark, sf_dir):
    done = op.create_environments(inventory(spark, sf_dir), _new_environments(spark, sf_dir))
    return done.table.select(
        "namespace",
        "project_id",
        "project_name",
        "environment",
        "repo_name",
        "depends_on",
        F.col("annotations")["repo-url"].alias("repo_url"),
    )


@query(
    f"""WITH {_GROWN}
    SELECT request_id, project_id, namespace,
           CASE WHEN request_id IN (SELECT request_id FROM won) THEN 'created'
                WHEN status = 'ok' THEN 'exists' ELSE status END AS status
    FROM judged"""
)
def create_environments_results(spark, sf_dir):
    asked = _new_environments(spark, sf_dir)
    return op.create_environments(inventory(spark, sf_dir), asked).results


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("request_id"),
        F.concat(F.lit("ns-"), F.col("o_orderkey").cast("string")).alias("namespace"),
        F.when(F.col("o_orderstatus") == "F", False)
        .when(F.col("o_orderstatus") == "O", True)
        .when(F.col("o_orderpriority") != "5-LOW", True)
        .alias("applied"),
    )


_TALLY = """t AS (
      SELECT o_custkey AS request_id, 'ns-' || o_orderkey AS namespace,
             o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_orderpriority <> '5-LOW')
               AS applied
      FROM orders)"""
_VERDICT = """CASE WHEN count(*) FILTER (applied) = count(*) THEN 'all'
                WHEN count(*) FILTER (applied) > 0 THEN 'partial' ELSE 'none' END AS verdict"""


@query(
    f"""WITH {_TALLY} SELECT request_id, count(*) AS total,
           count(*) FILTER (applied) AS applied,
           coalesce(string_agg(namespace, ', ' ORDER BY namespace) FILTER (NOT applied), '')
             AS failed_names, {_VERDICT}
    FROM t GROUP BY request_id"""
)
def apply_tally(spark, sf_dir):
    out = op.apply_tally(_results(spark, sf_dir), "request_id")
    return out.withColumn("failed_names", F.array_join("failed_names", ", "))


@query(
    f"""WITH {_TALLY} SELECT request_id, count(*) AS total,
           count(*) FILTER (applied) AS applied, {_VERDICT}
    FROM t GROUP BY request_id"""
)
def apply_counts(spark, sf_dir):
    return op.apply_counts(_results(spark, sf_dir), "request_id")


@query(f"WITH {_TALLY} SELECT request_id, namespace FROM t WHERE NOT applied")
def failed_rows(spark, sf_dir):
    return op.failed_rows(_results(spark, sf_dir), "request_id")


def _renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    old = F.concat(F.lit("TEAM-"), key.cast("string"))
    new = (
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.lower(old))
        .when(
            F.col("c_mktsegment") == "BUILDING",
            F.concat(F.lit("Team-"), F.floor(key / 2).cast("string")),
        )
        .otherwise(F.concat(F.lit("Platform-"), F.floor(key / 3).cast("string")))
    )
    return table(spark, sf_dir, "customer").select(
        key.alias("request_id"), old.alias("old_name"), new.alias("new_name")
    )


RENAMES = f"""{INV}, {NAMES}, owners AS (
      SELECT project_name, min(project_id) AS lo, max(project_id) AS hi FROM inv
      WHERE project_id <> '' GROUP BY project_name),
    req AS (
      SELECT c_custkey AS request_id, 'team-' || c_custkey AS old,
             CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'team-' || c_custkey
                  WHEN 'BUILDING' THEN 'team-' || (c_custkey // 2)
                  ELSE 'platform-' || (c_custkey // 3) END AS new
      FROM customer),
    judged AS (
      SELECT r.request_id, r.new, CASE WHEN n.n_ids = 1 THEN n.id_min END AS project_id,
             CASE WHEN r.old = r.new THEN 'noop'
                  WHEN coalesce(n.n_ids, 0) = 0 THEN 'not_found'
                  WHEN n.n_ids > 1 THEN 'ambiguous'
                  WHEN o.lo <> n.id_min OR o.hi <> n.id_min THEN 'conflict'
                  ELSE 'renamed' END AS status
      FROM req r LEFT JOIN names n ON n.project_name = r.old
      LEFT JOIN owners o ON o.project_name = r.new),
    by_name AS (
      SELECT min(request_id) AS request_id, arg_min(project_id, request_id) AS project_id
      FROM judged WHERE status = 'renamed' GROUP BY new),
    won AS (SELECT min(request_id) AS request_id FROM by_name GROUP BY project_id),
    settled AS (
      SELECT request_id, new, project_id,
             CASE WHEN status = 'renamed' AND request_id NOT IN (SELECT request_id FROM won)
                  THEN 'conflict' ELSE status END AS status
      FROM judged)"""


@query(
    f"""WITH {RENAMES}
    SELECT i.namespace, i.project_id, coalesce(s.new, i.project_name) AS project_name,
           i.repo_name, coalesce(s.new, i.project_name) AS label
    FROM inv i LEFT JOIN settled s ON s.project_id = i.project_id AND s.status = 'renamed'"""
)
def rename_projects(spark, sf_dir):
    out = op.rename_projects(inventory(spark, sf_dir), _renames(spark, sf_dir)).table
    return out.select(
        "namespace",
        "project_id",
        "project_name",
        "repo_name",
        F.col("labels")["project-name"].alias("label"),
    )


@query(
    f"""WITH {RENAMES}
    SELECT s.request_id, s.project_id, s.status,
           CASE WHEN s.status = 'renamed' THEN c.n ELSE 0 END AS total,
           CASE WHEN s.status = 'renamed' THEN c.n ELSE 0 END AS applied,
           CASE WHEN s.status IN ('renamed', 'noop') THEN 'all' ELSE 'none' END AS verdict
    FROM settled s
    LEFT JOIN (SELECT project_id, count(*) AS n FROM inv GROUP BY project_id) c
      ON c.project_id = s.project_id"""
)
def rename_projects_results(spark, sf_dir):
    return op.rename_projects(inventory(spark, sf_dir), _renames(spark, sf_dir)).results


_DROPPED = f"""{INV}, {NAMES}, {REQ}, {RESOLVED},
    gone AS (SELECT DISTINCT project_id FROM resolved WHERE status = 'ok')"""


@query(
    f"""WITH {_DROPPED} SELECT namespace, project_id, project_name FROM inv
    WHERE project_id NOT IN (SELECT project_id FROM gone)"""
)
def drop_projects(spark, sf_dir):
    kept, _, _ = op.drop_projects(inventory(spark, sf_dir), _requests(spark, sf_dir))
    return kept.select("namespace", "project_id", "project_name")


@query(
    f"""WITH {_DROPPED} SELECT namespace, project_id, project_name FROM inv
    WHERE project_id IN (SELECT project_id FROM gone)"""
)
def drop_projects_removed(spark, sf_dir):
    _, removed, _ = op.drop_projects(inventory(spark, sf_dir), _requests(spark, sf_dir))
    return removed.select("namespace", "project_id", "project_name")


@query(
    f"""WITH {_DROPPED}
    SELECT r.request_id, r.project_id,
           CASE WHEN r.status = 'ok' THEN 'dropped' ELSE r.status END AS status,
           coalesce(c.n, 0) AS removed
    FROM resolved r
    LEFT JOIN (SELECT project_id, count(*) AS n FROM inv GROUP BY project_id) c
      ON c.project_id = r.project_id"""
)
def drop_projects_results(spark, sf_dir):
    _, _, results = op.drop_projects(inventory(spark, sf_dir), _requests(spark, sf_dir))
    return results


@query(REGISTRY["resolve_names"].sql)
def resolve_names_narrowed(spark, sf_dir):
    """With the inventory filtered by the requested names in its scan."""
    out = op.resolve_names(_requests(spark, sf_dir), inventory(spark, sf_dir), narrow=True)
    return out.select("request_id", "project_id", "status")


@query(REGISTRY["name_owner"].sql)
def name_owner_narrowed(spark, sf_dir):
    out = op.name_owner(_requests(spark, sf_dir), inventory(spark, sf_dir), narrow=True)
    return out.select("request_id", "owner_id", "taken", "multi_owner")


@query(REGISTRY["resolve_environments"].sql)
def resolve_environments_narrowed(spark, sf_dir):
    out = op.resolve_environments(_requests(spark, sf_dir), inventory(spark, sf_dir), narrow=True)
    return out.select("request_id", "project_id", "namespace", "status")


def _state_after_a_change(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """The inventory as it was before names changed, environments came and whole projects went; the
    state of the change; and the state after it."""
    now = inventory(spark, sf_dir)
    key = F.xxhash64("namespace")
    renamed, fresh = F.pmod(key, F.lit(5)) == 0, F.pmod(key, F.lit(7)) == 0
    ghosts = now.where(F.pmod(key, F.lit(11)) == 0).withColumns(
        {"project_id": F.concat("project_id", F.lit("-gone")), "namespace": F.concat("namespace", F.lit("-gone"))}
    )
    old = now.withColumn("project_name", F.when(renamed, "old").otherwise(F.col("project_name")))
    before = old.where(~fresh).unionByName(ghosts)
    gone = before.where(F.col("project_id").endswith("-gone") | renamed)
    change = op.state_change(gone, now.where(renamed | fresh))
    return before, change, op.merged_state(op.report_state(before), change)


@query(PROJECT_SUMMARY_SQL)
def project_summary_refreshed(spark, sf_dir):
    """The summary of before, with only the projects that a change touches computed anew."""
    before, change, state = _state_after_a_change(spark, sf_dir)
    out = op.refreshed(op.project_summary(before), state, change, op.project_summary)
    return out.withColumn("environment_names", op.environments_text())


@query(REGISTRY["inconsistent_pairs"].sql)
def inconsistent_pairs_refreshed(spark, sf_dir):
    """From the state of before and that of the change."""
    *_, state = _state_after_a_change(spark, sf_dir)
    return op.inconsistent_pairs(op.as_inventory(state))
