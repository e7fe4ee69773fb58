"""Keyed change queries: entries derived from customers, orders and events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkroster import operators as op
from sparkroster.catalog.base import REGISTRY, query, string_map, table, work_dir
from sparkroster.catalog.inventory import INV, _by_segment, _by_segment_sql, inventory
from sparkroster.functions import physical_name
from sparkroster.schemas import ENTRY_KEY, empty_map
from sparkroster.sources import change_partitions, change_stored, create_partitioned, store
from sparkroster.streaming import apply_change_stream, stream_results


def _user(c: str):
    return F.concat(F.lit("user-"), F.col(c).cast("string"))


def _keyed(df: DataFrame, name, data, *more) -> DataFrame:
    return df.select(
        F.lit("account").alias("kind"),
        F.lit("default").alias("namespace"),
        name.alias("name"),
        *more,
        data.alias("data"),
    )


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the customers that are not in debt."""
    data = string_map(segment=F.col("c_mktsegment"), nation=F.col("c_nationkey"))
    customers = table(spark, sf_dir, "customer").where(F.col("c_acctbal") >= 0)
    return _keyed(customers, _user("c_custkey"), data, empty_map().alias("labels"))


def _order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes from all orders, many per customer: values, removals, empty patches. One in fifty
    has no ``seq``, and one in fifty no name."""
    full = string_map(
        segment=F.when(F.col("o_orderstatus") == "F", F.lit(None)).otherwise(
            F.lower("o_orderpriority")
        ),
        order=F.col("o_orderkey"),
    )
    data = F.when(F.col("o_orderstatus") == "O", empty_map()).otherwise(full)
    rest = F.col("o_orderkey") % 50
    return _keyed(
        table(spark, sf_dir, "orders"),
        F.when(rest != 1, _user("o_custkey")),
        data,
        F.when(rest != 0, F.col("o_orderkey")).alias("seq"),
    )


ACC = """acc AS (
      SELECT 'user-' || c_custkey AS name, c_mktsegment AS segment, c_nationkey::VARCHAR AS nation,
             NULL::VARCHAR AS "order"
      FROM customer WHERE c_acctbal >= 0),
    chg AS (
      SELECT 'user-' || o_custkey AS name, o_orderkey AS seq, o_orderstatus = 'O' AS nothing,
             CASE WHEN o_orderstatus = 'P' THEN lower(o_orderpriority) END AS segment,
             CASE WHEN o_orderstatus <> 'O' THEN o_orderkey::VARCHAR END AS "order",
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS is_first
      FROM orders WHERE o_orderkey % 50 > 1),
    one AS (SELECT * FROM chg WHERE is_first)"""

_INVALID = """UNION ALL
    SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'user-' || o_custkey END AS name,
           CASE WHEN o_orderkey % 50 = 1 THEN o_orderkey END AS seq, 'invalid' AS status
    FROM orders WHERE o_orderkey % 50 <= 1"""


def _shown(df: DataFrame) -> DataFrame:
    data = F.col("data")
    return df.select(
        "name",
        data["segment"].alias("segment"),
        data["nation"].alias("nation"),
        data["order"].alias("order"),
        F.size("data").alias("n"),
    )


@query(
    f"""WITH {ACC}
    SELECT name, segment, nation, "order", 2 AS n FROM acc
    UNION ALL
    SELECT name, segment, NULL, "order", (segment IS NOT NULL)::INTEGER + ("order" IS NOT NULL)::INTEGER
    FROM one WHERE name NOT IN (SELECT name FROM acc)"""
)
def create_if_absent(spark, sf_dir):
    return _shown(op.create_if_absent(_accounts(spark, sf_dir), _order_changes(spark, sf_dir)).table)


@query(
    f"""WITH {ACC} SELECT name, seq, CASE WHEN is_first AND name NOT IN (SELECT name FROM acc)
      THEN 'created' ELSE 'conflict' END AS status FROM chg {_INVALID}"""
)
def create_if_absent_results(spark, sf_dir):
    done = op.create_if_absent(_accounts(spark, sf_dir), _order_changes(spark, sf_dir))
    return done.results.select("name", "seq", "status")


@query(
    f"""WITH {ACC}
    SELECT a.name, CASE WHEN o.name IS NULL THEN a.segment ELSE o.segment END AS segment,
           CASE WHEN o.name IS NULL THEN a.nation END AS nation, o."order",
           CASE WHEN o.name IS NULL THEN 2
                ELSE (o.segment IS NOT NULL)::INTEGER + (o."order" IS NOT NULL)::INTEGER END AS n
    FROM acc a LEFT JOIN one o ON o.name = a.name"""
)
def replace_existing(spark, sf_dir):
    return _shown(op.replace_existing(_accounts(spark, sf_dir), _order_changes(spark, sf_dir)).table)


@query(
    f"""WITH {ACC} SELECT c.name, c.seq, CASE WHEN a.name IS NULL THEN 'missing'
      WHEN NOT is_first THEN 'skipped' ELSE 'replaced' END AS status
    FROM chg c LEFT JOIN acc a ON a.name = c.name {_INVALID}"""
)
def replace_existing_results(spark, sf_dir):
    done = op.replace_existing(_accounts(spark, sf_dir), _order_changes(spark, sf_dir))
    return done.results.select("name", "seq", "status")


@query(
    f"""WITH {ACC}, m AS (
      SELECT a.name,
             CASE WHEN o.name IS NULL OR o.nothing THEN a.segment ELSE o.segment END AS segment,
             a.nation, o."order"
      FROM acc a LEFT JOIN one o ON o.name = a.name)
    SELECT *, 1 + (segment IS NOT NULL)::INTEGER + ("order" IS NOT NULL)::INTEGER AS n FROM m"""
)
def merge_patch(spark, sf_dir):
    done = op.merge_patch_existing(_accounts(spark, sf_dir), _order_changes(spark, sf_dir))
    return _shown(done.table)


@query(
    f"""WITH {ACC} SELECT c.name, c.seq, CASE WHEN nothing THEN 'noop' WHEN a.name IS NULL
      THEN 'missing' WHEN NOT is_first THEN 'skipped' ELSE 'patched' END AS status
    FROM chg c LEFT JOIN acc a ON a.name = c.name {_INVALID}"""
)
def merge_patch_results(spark, sf_dir):
    done = op.merge_patch_existing(_accounts(spark, sf_dir), _order_changes(spark, sf_dir))
    return done.results.select("name", "seq", "status")


@query(
    """SELECT 'user-' || c_custkey AS name FROM customer WHERE c_acctbal >= 0
      AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')"""
)
def delete_if_present(spark, sf_dir):
    return op.delete_if_present(_accounts(spark, sf_dir), _low_keys(spark, sf_dir)).table.select(
        "name"
    )


@query(
    """SELECT 'user-' || o.o_custkey AS name,
           CASE WHEN c.c_custkey IS NULL THEN 'absent' ELSE 'deleted' END AS status
    FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '5-LOW') o
    LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal >= 0"""
)
def delete_if_present_results(spark, sf_dir):
    done = op.delete_if_present(_accounts(spark, sf_dir), _low_keys(spark, sf_dir))
    return done.results.select("name", "status")


def _low_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "5-LOW")
    return _keyed(low, _user("o_custkey"), F.lit(None)).drop("data")


def _label_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    env = _by_segment("1-urgent", "2-high", "3-medium", "2-high", "sandbox")
    labels = F.create_map(
        F.lit("project-id"),
        F.concat(F.lit("proj-"), key.cast("string")),
        F.lit("environment"),
        F.concat(F.lit("moved-"), env),
        F.lit("depends-on"),
        F.lit(None).cast("string"),
        F.lit("nation"),
        F.col("c_nationkey").cast("string"),
    )
    url = F.create_map(F.lit("repo-url"), F.concat(F.lit("git/new/"), key.cast("string")))
    segment = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        physical_name(F.concat(F.lit("proj-"), key.cast("string")), env).alias("namespace"),
        key.alias("seq"),
        F.when(segment != "FURNITURE", labels).alias("labels"),
        F.when(~segment.isin("FURNITURE", "BUILDING"), url).alias("annotations"),
    )


_LBL = f"""{INV}, lbl AS (
      SELECT 'proj-' || c_custkey || '-' ||
               {_by_segment_sql("1-urgent", "2-high", "3-medium", "2-high", "sandbox")}
               AS namespace, c_custkey AS seq,
             c_mktsegment <> 'FURNITURE' AS has_labels,
             c_mktsegment NOT IN ('FURNITURE', 'BUILDING') AS has_url,
             'proj-' || c_custkey AS project_id,
             'moved-' || {_by_segment_sql("1-urgent", "2-high", "3-medium", "2-high", "sandbox")}
               AS environment,
             c_nationkey::VARCHAR AS nation, 'git/new/' || c_custkey AS repo_url
      FROM customer)"""


@query(
    f"""WITH {_LBL}
    SELECT coalesce(i.namespace, c.namespace) AS namespace,
           CASE WHEN c.has_labels THEN c.project_id ELSE i.project_id END AS project_id,
           CASE WHEN c.has_labels AND i.project_id LIKE '%7' THEN NULL ELSE i.project_name END
             AS project_name,
           CASE WHEN c.has_labels THEN c.environment ELSE i.environment END AS environment,
           CASE WHEN c.has_labels THEN NULL ELSE i.depends_on END AS depends_on,
           CASE WHEN c.has_labels THEN c.nation END AS nation,
           CASE WHEN c.has_url THEN c.repo_url ELSE i.repo_url END AS repo_url,
           CASE WHEN c.has_labels OR i.namespace IS NULL THEN true
                ELSE i.project_id NOT LIKE '%7' END AS has_labels
    FROM inv i FULL JOIN lbl c ON c.namespace = i.namespace"""
)
def upsert_labels(spark, sf_dir):
    done = op.upsert_labels(_part_unlabelled(spark, sf_dir), _label_changes(spark, sf_dir))
    return done.table.select(
        "namespace",
        "project_id",
        "project_name",
        "environment",
        "depends_on",
        F.col("labels")["nation"].alias("nation"),
        F.col("annotations")["repo-url"].alias("repo_url"),
        F.col("labels").isNotNull().alias("has_labels"),
    )


def _part_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory, with the label map of every tenth project lost but its flat columns kept."""
    lost = F.coalesce(F.col("project_id").endswith("7"), F.lit(False))
    return inventory(spark, sf_dir).withColumn("labels", F.when(~lost, F.col("labels")))


@query(
    f"""WITH {_LBL}
    SELECT c.namespace, c.seq, CASE WHEN i.namespace IS NULL THEN 'created'
      WHEN NOT has_labels AND NOT has_url THEN 'noop' ELSE 'patched' END AS status
    FROM lbl c LEFT JOIN inv i ON i.namespace = c.namespace"""
)
def upsert_labels_results(spark, sf_dir):
    return op.upsert_labels(inventory(spark, sf_dir), _label_changes(spark, sf_dir)).results


@query(
    """WITH base AS (SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority
      FROM orders WHERE o_orderdate < '1999-01-01'),
    new AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X'
        ELSE nullif(o_orderstatus, 'P') END AS status, o_orderpriority AS priority
      FROM orders WHERE o_orderdate >= '1997-01-01')
    SELECT coalesce(b.o_orderkey, n.o_orderkey) AS o_orderkey,
           CASE WHEN n.o_orderkey IS NULL THEN b.status ELSE n.status END AS status,
           coalesce(n.priority, b.priority) AS priority,
           CASE WHEN n.o_orderkey IS NULL THEN 'kept' WHEN b.o_orderkey IS NULL THEN 'created'
                WHEN b.status IS NOT DISTINCT FROM n.status THEN 'unchanged' ELSE 'updated' END
             AS action
    FROM base b FULL JOIN new n ON n.o_orderkey = b.o_orderkey"""
)
def write_if_changed(spark, sf_dir):
    base, new = _order_versions(spark, sf_dir)
    return _order_actions(op.write_if_changed(base, new, ["o_orderkey"]))


def _order_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    data = string_map(status=status, priority=priority)
    base = orders.where(F.col("o_orderdate") < "1999-01-01").select(
        "o_orderkey", data.alias("data")
    )
    changed = string_map(
        priority=priority,
        status=F.when(priority == "1-URGENT", "X").otherwise(F.nullif(status, F.lit("P"))),
    )
    new = orders.where(F.col("o_orderdate") >= "1997-01-01").select(
        "o_orderkey", changed.alias("data")
    )
    return base, new


def _order_actions(written: DataFrame) -> DataFrame:
    return written.select(
        "o_orderkey",
        F.col("data")["status"].alias("status"),
        F.col("data")["priority"].alias("priority"),
        "action",
    )


# An event log as ordered changes: the kind of the event gives the operation.
_OPS = {
    "signup": "create",
    "purchase": "replace",
    "view": "patch",
    "click": "upsert",
    "error": "delete",
}


def _event_log(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    kind, event = F.col("event_type"), F.col("event_id").cast("string")
    op_name = F.lit(None).cast("string")
    for event_type, name in _OPS.items():
        op_name = F.when(kind == event_type, name).otherwise(op_name)
    last = F.when(F.col("value") < 5, F.lit(None)).otherwise(event)
    data = F.when(
        F.col("value") >= 1, F.create_map(kind, event, F.lit("last"), last.cast("string"))
    ).otherwise(empty_map())
    return _keyed(
        table(spark, sf_dir, "events") if events is None else events,
        _user("user_id"),
        data,
        F.col("event_id").alias("seq"),
        op_name.alias("op"),
    )


LOG = """base AS (
      SELECT 'user-' || c_custkey AS name, c_mktsegment AS segment FROM customer
      WHERE c_acctbal >= 0),
    log AS (
      SELECT 'user-' || user_id AS name, event_id AS seq, event_type AS f, value < 1 AS nothing,
             CASE WHEN value >= 5 THEN event_id::VARCHAR END AS last_value,
             CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'replace'
               WHEN 'view' THEN 'patch' WHEN 'click' THEN 'upsert' ELSE 'delete' END AS op
      FROM events),
    seen AS (
      SELECT *, coalesce(last_value(CASE WHEN op IN ('create', 'upsert') THEN true
                                         WHEN op = 'delete' THEN false END IGNORE NULLS)
                 OVER (PARTITION BY name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
               name IN (SELECT name FROM base)) AS there
      FROM log),
    judged AS (
      SELECT *, CASE WHEN op = 'create' AND there THEN 'rejected'
                     WHEN op = 'patch' AND nothing THEN 'noop'
                     WHEN op IN ('replace', 'patch') AND NOT there THEN 'rejected'
                     WHEN op = 'upsert' AND there AND nothing THEN 'noop'
                     WHEN op = 'delete' AND NOT there THEN 'noop' ELSE 'applied' END AS outcome
      FROM seen),
    state AS (
      SELECT name, count(*) FILTER (outcome = 'applied') AS applied,
             count(*) FILTER (outcome = 'rejected') AS rejected,
             count(*) FILTER (outcome = 'noop') AS noop,
             coalesce(arg_max(op IN ('create', 'upsert'), seq)
                        FILTER (op IN ('create', 'upsert', 'delete')),
                      name IN (SELECT name FROM base)) AS present,
             coalesce(max(seq) FILTER (op = 'delete' OR
               (op IN ('create', 'replace') AND outcome = 'applied')), -1) AS reset
      FROM judged GROUP BY name),
    kept AS (
      SELECT j.* FROM judged j JOIN state s ON s.name = j.name AND j.seq >= s.reset
      WHERE j.outcome = 'applied' AND j.op <> 'delete' AND NOT j.nothing),
    fields AS (
      SELECT name, max(seq) FILTER (f = 'signup') AS signup,
             max(seq) FILTER (f = 'purchase') AS purchase, max(seq) FILTER (f = 'view') AS view_,
             max(seq) FILTER (f = 'click') AS click,
             arg_max({'v': last_value}, seq).v AS last_value
      FROM kept GROUP BY name)"""


@query(
    f"""WITH {LOG}
    SELECT coalesce(s.name, b.name) AS name,
           CASE WHEN coalesce(s.reset, -1) = -1 THEN b.segment END AS segment,
           f.signup::VARCHAR AS signup, f.purchase::VARCHAR AS purchase,
           f.view_::VARCHAR AS viewed, f.click::VARCHAR AS click, f.last_value AS last
    FROM base b FULL JOIN state s ON s.name = b.name
    LEFT JOIN fields f ON f.name = coalesce(s.name, b.name)
    WHERE coalesce(s.present, true)"""
)
def apply_changes(spark, sf_dir):
    done = op.apply_changes(_accounts(spark, sf_dir), _event_log(spark, sf_dir))
    data = F.col("data")
    return done.table.select(
        "name",
        data["segment"].alias("segment"),
        data["signup"].alias("signup"),
        data["purchase"].alias("purchase"),
        data["view"].alias("viewed"),
        data["click"].alias("click"),
        data["last"].alias("last"),
    )


@query(
    f"WITH {LOG} SELECT name, applied, rejected, noop, 0::BIGINT AS invalid, present FROM state"
)
def apply_changes_results(spark, sf_dir):
    done = op.apply_changes(_accounts(spark, sf_dir), _event_log(spark, sf_dir))
    return done.results.select("name", "applied", "rejected", "noop", "invalid", "present")


_TIMED = LOG.replace(
    "FROM events)", "FROM events WHERE event_id % 40 > 1)", 1
).replace("event_id AS seq", "epoch_us(ts) AS seq", 1)


@query(
    f"""WITH {_TIMED}, lost AS (
      SELECT CASE WHEN event_id % 40 = 0 THEN 'user-' || user_id END AS name, count(*) AS invalid
      FROM events WHERE event_id % 40 <= 1 GROUP BY 1)
    SELECT coalesce(s.name, l.name) AS name, coalesce(applied, 0) AS applied,
           coalesce(rejected, 0) AS rejected, coalesce(noop, 0) AS noop,
           coalesce(invalid, 0) AS invalid,
           coalesce(s.present, coalesce(l.name, '') IN (SELECT name FROM base)) AS present
    FROM state s FULL JOIN lost l ON l.name IS NOT DISTINCT FROM s.name"""
)
def apply_changes_by_time(spark, sf_dir):
    """The same log in order of microseconds; some events have no time and some no user."""
    events = table(spark, sf_dir, "events")
    rest = F.col("event_id") % 40
    log = _event_log(spark, sf_dir, events.withColumn("user_id", F.when(rest != 1, F.col("user_id"))))
    times = events.select(
        F.col("event_id").alias("seq"),
        F.when(rest != 0, F.unix_micros(F.col("ts").cast("timestamp"))).alias("_at"),
    )
    timed = log.join(times, "seq").withColumn("seq", F.col("_at")).drop("_at")
    done = op.apply_changes(_accounts(spark, sf_dir), timed)
    return done.results.select("name", "applied", "rejected", "noop", "invalid", "present")


def _reuse(of) -> str:
    return REGISTRY[of.__name__].sql


def _stored(spark: SparkSession, df: DataFrame, key=ENTRY_KEY) -> tuple[str, str]:
    """Name and folder of a new stored table."""
    name, folder = f"stored_{uuid.uuid4().hex[:12]}", work_dir(spark, "stored")
    store(df, name, BUCKETS, key, folder)
    return name, folder


def _changed_in_place(spark, sf_dir, change, changes=None) -> str:
    changes = _order_changes(spark, sf_dir) if changes is None else changes
    name, folder = _stored(spark, _accounts(spark, sf_dir))
    change_stored(spark, name, change, changes, folder=folder)
    return name


BUCKETS = 16


@query(_reuse(create_if_absent))
def create_if_absent_stored(spark, sf_dir):
    """Into a table stored in buckets of its key: the table as shown after the change."""
    return _shown(spark.table(_changed_in_place(spark, sf_dir, op.create_if_absent)))


@query(_reuse(replace_existing))
def replace_existing_stored(spark, sf_dir):
    return _shown(spark.table(_changed_in_place(spark, sf_dir, op.replace_existing)))


@query(_reuse(merge_patch))
def merge_patch_stored(spark, sf_dir):
    return _shown(spark.table(_changed_in_place(spark, sf_dir, op.merge_patch_existing)))


@query(_reuse(delete_if_present))
def delete_if_present_stored(spark, sf_dir):
    keys = _low_keys(spark, sf_dir)
    return spark.table(_changed_in_place(spark, sf_dir, op.delete_if_present, keys)).select("name")


@query(_reuse(write_if_changed))
def write_if_changed_stored(spark, sf_dir):
    """Against a stored base, read bucket by bucket."""
    base, new = _order_versions(spark, sf_dir)
    name, _ = _stored(spark, base, ("o_orderkey",))
    stored = spark.table(name)
    return _order_actions(op.write_if_changed(stored, new, ["o_orderkey"], buckets=BUCKETS))


def _by_nation(df: DataFrame) -> DataFrame:
    """Accounts in a namespace for each nation, which the table is partitioned by."""
    return df.withColumn("namespace", F.concat(F.lit("nation-"), F.coalesce(df["data"]["nation"], F.lit("none"))))


@query(
    """WITH acc AS (
      SELECT 'user-' || c_custkey AS name, c_nationkey AS nation, c_mktsegment AS segment, c_custkey
      FROM customer WHERE c_acctbal >= 0)
    SELECT 'nation-' || nation AS namespace, name,
           CASE WHEN nation % 5 = 0 THEN lower(segment) ELSE segment END AS segment
    FROM acc WHERE nation % 5 <> 1"""
)
def patch_and_empty_partitions(spark, sf_dir):
    """A log over the nations: a fifth is patched, a fifth deleted to the last row, the rest left as it lies."""
    path = work_dir(spark, "partitions") + "/table"
    base = _by_nation(_accounts(spark, sf_dir))
    create_partitioned(base, path)
    nation = F.col("data")["nation"].cast("int") % 5
    segment = F.create_map(F.lit("segment"), F.lower(F.col("data")["segment"]))
    log = base.where(nation <= 1).select(
        "kind",
        "namespace",
        "name",
        F.lit(1).cast("long").alias("seq"),
        F.when(nation == 0, "patch").otherwise("delete").alias("op"),
        F.when(nation == 0, segment).otherwise(empty_map()).alias("data"),
    )
    table_now = spark.read.schema(base.schema).parquet(path)
    change_partitions(table_now, path, "nations", op.apply_changes, log)
    left = spark.read.schema(base.schema).parquet(path)
    return left.select("namespace", "name", F.col("data")["segment"].alias("segment"))


def _log_as_files(spark: SparkSession, sf_dir: str, path: str, n: int = 3) -> DataFrame:
    """The event log as files in order of ``seq``, read as a stream of one file at a time."""
    log = _event_log(spark, sf_dir)
    last = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0
    for i in range(n):
        low, high = last * i // n, last * (i + 1) // n
        at = F.col("seq")
        part = log.where((at <= high) & ((at > low) if i else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _applied_as_stream(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    path = work_dir(spark, "change-stream")
    base = _accounts(spark, sf_dir)
    create_partitioned(base, f"{path}/table")
    log = _log_as_files(spark, sf_dir, f"{path}/log")
    apply_change_stream(
        log, f"{path}/table", base.schema, f"{path}/checkpoint", available_now=True
    ).awaitTermination()
    return f"{path}/table", spark.read.schema(base.schema).parquet(f"{path}/table")


@query(_reuse(apply_changes))
def apply_change_stream_table(spark, sf_dir):
    """The log of :func:`apply_changes` in three micro-batches: the same table."""
    _, done = _applied_as_stream(spark, sf_dir)
    data = F.col("data")
    names = {"segment": "segment", "signup": "signup", "purchase": "purchase", "view": "viewed", "click": "click", "last": "last"}
    return done.select("name", *[data[k].alias(c) for k, c in names.items()])


@query(f"WITH {LOG} SELECT name, applied, rejected, noop, 0::BIGINT AS invalid FROM state")
def apply_change_stream_results(spark, sf_dir):
    path, _ = _applied_as_stream(spark, sf_dir)
    return stream_results(spark, path).select("name", "applied", "rejected", "noop", "invalid")
