"""Run data queries: events as status samples, conversations as logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkroster import operators as op
from sparkroster.catalog.base import REGISTRY, iso_sql, query, table, work_dir
from sparkroster.functions import iso_time
from sparkroster.streaming import (
    closed_outcomes_stream,
    run_outcomes_stream,
    tail_lines_stream,
    tails_of,
    unstarted_outcomes_stream,
    write_outcomes,
)

TIMEOUT = 12 * 3600


@query(
    f"""SELECT event_id,
           CASE WHEN event_type = 'view' THEN 1 END AS active,
           CASE WHEN event_type = 'purchase' THEN 1 END AS succeeded,
           CASE WHEN event_type = 'error' THEN 2 END AS failed,
           CASE WHEN event_type <> 'signup' THEN {iso_sql("ts")} END AS start_time,
           CASE WHEN event_type IN ('purchase', 'error')
                THEN {iso_sql("date_trunc('hour', ts)")} END AS completion_time,
           CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END AS n_conditions,
           CASE WHEN event_type IN ('purchase', 'error') THEN event_type END AS condition,
           CASE WHEN event_type = 'error' THEN {iso_sql("ts")} END AS condition_time,
           CASE WHEN event_type IN ('purchase', 'error') THEN props END AS condition_message
    FROM events"""
)
def flatten_status(spark, sf_dir):
    kind, ts = F.col("event_type"), F.col("ts").cast("timestamp")
    ended = kind.isin("purchase", "error")
    condition = F.struct(
        kind.alias("type"),
        F.lit("True").alias("status"),
        F.when(kind == "error", ts).alias("last_transition_time"),
        F.col("props").alias("message"),
    )
    status = F.struct(
        F.when(kind == "view", 1).alias("active"),
        F.when(kind == "purchase", 1).alias("succeeded"),
        F.when(kind == "error", 2).alias("failed"),
        ts.alias("start_time"),
        F.when(ended, F.date_trunc("hour", ts)).alias("completion_time"),
        F.when(ended, F.array(condition)).alias("conditions"),
    )
    raw = table(spark, sf_dir, "events").select(
        "event_id", F.when(kind != "signup", status).alias("status")
    )
    first = F.get("conditions", F.lit(0))
    return op.flatten_status(raw).select(
        "event_id",
        "active",
        "succeeded",
        "failed",
        "start_time",
        "completion_time",
        F.size("conditions").alias("n_conditions"),
        first["type"].alias("condition"),
        first["last_transition_time"].alias("condition_time"),
        first["message"].alias("condition_message"),
    )


def _samples(events: DataFrame, run_id, start_time) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        run_id.cast("string").alias("run_id"),
        start_time.cast("timestamp").alias("start_time"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "view", 1).alias("active"),
        F.when(kind == "purchase", 1).alias("succeeded"),
        F.when(kind == "error", 1).alias("failed"),
    )


@query(
    f"""WITH r AS (
      SELECT user_id, min(ts) + INTERVAL {TIMEOUT} SECOND AS deadline,
             min(ts) FILTER (event_type = 'purchase') AS ok_at,
             min(ts) FILTER (event_type = 'error') AS bad_at
      FROM events GROUP BY user_id),
    d AS (
      SELECT *, CASE WHEN least(ok_at, bad_at) <= deadline THEN least(ok_at, bad_at) END AS at
      FROM r)
    SELECT d.user_id::VARCHAR AS run_id,
           CASE WHEN d.at IS NULL THEN 'timeout' WHEN d.ok_at = d.at THEN 'succeeded'
                ELSE 'failed' END AS outcome,
           count(*) FILTER (e.ts <= coalesce(d.at, d.deadline)) AS attempt,
           coalesce({iso_sql("min(d.at)")}, 'N/A') AS decided_at
    FROM d JOIN events e ON e.user_id = d.user_id GROUP BY d.user_id, d.at, d.ok_at"""
)
def run_outcomes(spark, sf_dir):
    samples = _samples(table(spark, sf_dir, "events"), F.col("user_id"), F.lit(None))
    out = op.run_outcomes(samples, TIMEOUT)
    return out.withColumn("decided_at", iso_time("decided_at"))


@query(
    f"""WITH r AS (
      SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS run_id,
             date_trunc('day', ts) + INTERVAL {TIMEOUT} SECOND AS deadline,
             min(ts) FILTER (event_type = 'purchase') AS ok_at,
             min(ts) FILTER (event_type = 'error') AS bad_at, list(ts) AS times
      FROM events GROUP BY 1, 2),
    d AS (
      SELECT *, CASE WHEN least(ok_at, bad_at) <= deadline THEN least(ok_at, bad_at) END AS decided
      FROM r)
    SELECT run_id, CASE WHEN decided IS NULL THEN 'timeout' WHEN ok_at = decided THEN 'succeeded'
             ELSE 'failed' END AS outcome,
           CASE WHEN decided IS NULL THEN len([t for t in times if t <= deadline])
                ELSE len([t for t in times if t < decided]) + 1 END AS attempt,
           coalesce({iso_sql("decided")}, 'N/A') AS decided_at
    FROM d"""
)
def run_outcomes_started(spark, sf_dir):
    """One run per user and day, which starts with the day."""
    run_id = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    samples = _samples(table(spark, sf_dir, "events"), run_id, F.date_trunc("day", F.col("ts")))
    out = op.run_outcomes(samples, TIMEOUT)
    return out.withColumn("decided_at", iso_time("decided_at"))


DELAY = 3600


@query(
    f"""WITH r AS (
      SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS run_id,
             date_trunc('day', ts) AS start_time,
             min(ts) FILTER (event_type = 'purchase'
               AND ts <= date_trunc('day', ts) + INTERVAL {TIMEOUT} SECOND) AS ok_at,
             min(ts) FILTER (event_type = 'error'
               AND ts <= date_trunc('day', ts) + INTERVAL {TIMEOUT} SECOND) AS bad_at
      FROM events GROUP BY 1, 2)
    SELECT run_id, CASE WHEN least(ok_at, bad_at) IS NULL THEN 'timeout'
             WHEN ok_at = least(ok_at, bad_at) THEN 'succeeded' ELSE 'failed' END AS outcome,
           coalesce({iso_sql("least(ok_at, bad_at)")}, 'N/A') AS decided_at
    FROM r WHERE start_time <=
      (SELECT max(date_trunc('day', ts)) FROM events) - INTERVAL {TIMEOUT + DELAY} SECOND"""
)
def run_outcomes_stream_closed(spark, sf_dir):
    """One run per user and day, read as a stream; runs still open at the end are not in it."""
    schema = table(spark, sf_dir, "events").schema
    events = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )
    day = F.date_trunc("day", F.col("ts"))
    run_id = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    outcomes = run_outcomes_stream(
        _samples(events, run_id, day), timeout_s=TIMEOUT, delay_s=DELAY
    )
    path = work_dir(spark, "outcomes")
    write_outcomes(outcomes, f"{path}/table", f"{path}/checkpoint", True).awaitTermination()
    closed = spark.read.schema(outcomes.schema).parquet(f"{path}/table")
    return closed.select(
        "run_id", "outcome", iso_time("decided_at").alias("decided_at")
    )


@query(
    f"""WITH e AS (
      SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts)
                  + INTERVAL {TIMEOUT} SECOND, true) AS opens FROM events),
    s AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY user_id ORDER BY ts
            RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stretch FROM e),
    r AS (
      SELECT user_id, min(ts) AS start, max(ts) AS until,
             min(ts) FILTER (event_type = 'purchase') AS ok_at,
             min(ts) FILTER (event_type = 'error') AS bad_at
      FROM s GROUP BY user_id, stretch),
    d AS (SELECT *, CASE WHEN least(ok_at, bad_at) <= start + INTERVAL {TIMEOUT} SECOND
                    THEN least(ok_at, bad_at) END AS decided FROM r)
    SELECT user_id::VARCHAR AS run_id, {iso_sql("start")} AS start_time,
           CASE WHEN decided IS NULL THEN 'timeout' WHEN ok_at = decided THEN 'succeeded' ELSE 'failed' END
             AS outcome, coalesce({iso_sql("decided")}, 'N/A') AS decided_at
    FROM d WHERE until + INTERVAL {TIMEOUT + 1} SECOND
      <= (SELECT max(ts) FROM events) - INTERVAL {DELAY} SECOND"""
)
def run_outcomes_stream_unstarted(spark, sf_dir):
    """One run per user, without a start in any sample: the closed stretches of each."""
    schema = table(spark, sf_dir, "events").schema
    events = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )
    outcomes = unstarted_outcomes_stream(
        _samples(events, F.col("user_id"), F.lit(None)), TIMEOUT, DELAY
    )
    path = work_dir(spark, "unstarted")
    write_outcomes(outcomes, f"{path}/table", f"{path}/checkpoint", True).awaitTermination()
    closed = spark.read.schema(outcomes.schema).parquet(f"{path}/table")
    return closed.select(
        "run_id",
        iso_time("start_time").alias("start_time"),
        "outcome",
        iso_time("decided_at").alias("decided_at"),
    )


@query(
    f"""WITH r AS (
      SELECT user_id, min(ts) AS start, min(ts) FILTER (event_type = 'purchase') AS ok_at,
             min(ts) FILTER (event_type = 'error') AS bad_at
      FROM events GROUP BY user_id),
    d AS (SELECT *, CASE WHEN least(ok_at, bad_at) <= start + INTERVAL {TIMEOUT} SECOND
                    THEN least(ok_at, bad_at) END AS decided FROM r)
    SELECT user_id::VARCHAR AS run_id, {iso_sql("start")} AS start_time,
           CASE WHEN decided IS NULL THEN 'timeout' WHEN ok_at = decided THEN 'succeeded' ELSE 'failed' END
             AS outcome, coalesce({iso_sql("decided")}, 'N/A') AS decided_at
    FROM d WHERE start + INTERVAL {TIMEOUT} SECOND
      < (SELECT max(ts) FROM events) - INTERVAL {DELAY} SECOND"""
)
def run_outcomes_stream_by_run(spark, sf_dir):
    """One run per user, without a start in any sample: a row per run, however often it falls silent."""
    schema = table(spark, sf_dir, "events").schema
    events = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )
    outcomes = closed_outcomes_stream(
        _samples(events, F.col("user_id"), F.lit(None)), TIMEOUT, DELAY
    )
    path = work_dir(spark, "by-run")
    write_outcomes(outcomes, f"{path}/table", f"{path}/checkpoint", True).awaitTermination()
    closed = spark.read.schema(outcomes.schema).parquet(f"{path}/table")
    return closed.select(
        "run_id",
        iso_time("start_time").alias("start_time"),
        "outcome",
        iso_time("decided_at").alias("decided_at"),
    )


_SHIP_TIMEOUT, _SHIP_DELAY = 90 * 86400, 43200


@query(
    f"""WITH clock AS (
      SELECT least((SELECT max(o_orderdate) FROM orders),
                   (SELECT max(l_shipdate) FROM lineitem WHERE l_returnflag <> 'N'))
             - INTERVAL {_SHIP_DELAY} SECOND - INTERVAL {_SHIP_TIMEOUT} SECOND AS until),
    r AS (
      SELECT o_orderkey, min(l_shipdate) FILTER (l_returnflag = 'A') AS ok_at,
             min(l_shipdate) FILTER (l_returnflag = 'R') AS bad_at
      FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate
        AND l_shipdate <= o_orderdate + INTERVAL {_SHIP_TIMEOUT} SECOND
      WHERE o_orderdate < (SELECT until FROM clock) GROUP BY o_orderkey)
    SELECT o_orderkey::VARCHAR AS run_id,
           CASE WHEN least(ok_at, bad_at) IS NULL THEN 'timeout'
             WHEN ok_at = least(ok_at, bad_at) THEN 'succeeded' ELSE 'failed' END AS outcome,
           coalesce({iso_sql("least(ok_at, bad_at)")}, 'N/A') AS decided_at
    FROM r"""
)
def run_outcomes_stream_joined(spark, sf_dir):
    """Orders start runs, their lines decide them; two streams joined by run and time."""

    def stream(name: str) -> DataFrame:
        read = spark.readStream.schema(table(spark, sf_dir, name).schema)
        return read.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)

    starts = stream("orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.col("o_orderdate").cast("timestamp").alias("start_time"),
    )
    flag = F.col("l_returnflag")
    samples = stream("lineitem").select(
        F.col("l_orderkey").cast("string").alias("run_id"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.when(flag == "A", 1).alias("succeeded"),
        F.when(flag == "R", 1).alias("failed"),
    )
    outcomes = run_outcomes_stream(samples, starts, _SHIP_TIMEOUT, _SHIP_DELAY)
    path = work_dir(spark, "shipped")
    write_outcomes(outcomes, f"{path}/table", f"{path}/checkpoint", True).awaitTermination()
    closed = spark.read.schema(outcomes.schema).parquet(f"{path}/table")
    return closed.select("run_id", "outcome", iso_time("decided_at").alias("decided_at"))


@query(
    """WITH c AS (SELECT *, max(turn // 2) OVER (PARTITION BY conv_id, role) AS pod_at,
             CASE WHEN length(text) < 400 THEN 0 ELSE 1 END AS ci FROM conversations),
    latest AS (SELECT DISTINCT conv_id, first_value(role) OVER (PARTITION BY conv_id
        ORDER BY pod_at DESC, role DESC) AS role FROM c),
    bad AS (SELECT conv_id FROM conversations GROUP BY conv_id HAVING max(turn) > 5),
    r AS (SELECT c.conv_id, c.turn, c.role, c.text,
             row_number() OVER (PARTITION BY c.conv_id, c.role ORDER BY c.turn DESC) AS rn
      FROM c JOIN latest l ON l.conv_id = c.conv_id AND l.role = c.role WHERE c.ci = 0)
    SELECT conv_id::VARCHAR AS run_id, role AS pod, turn AS line_no, text AS line FROM r
    WHERE rn <= CASE WHEN conv_id IN (SELECT conv_id FROM bad) THEN 1 ELSE 2 END"""
)
def tail_lines(spark, sf_dir):
    logs, outcomes = _logs(spark, sf_dir)
    out = op.tail_lines(logs, outcomes, n_ok=2, n_failed=1)
    return out.select("run_id", "pod", "line_no", "line")


def _logs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Conversations as logs, a role being a pod, and outcomes by their length."""
    conv = table(spark, sf_dir, "conversations")
    logs = conv.select(
        F.col("conv_id").cast("string").alias("run_id"),
        F.col("role").alias("pod"),
        F.lit("main").alias("container"),
        F.when(F.length("text") < 400, 0).otherwise(1).alias("container_index"),
        F.timestamp_seconds(F.floor(F.col("turn") / 2)).alias("ts"),
        F.col("turn").alias("line_no"),
        F.col("text").alias("line"),
    )
    outcomes = conv.groupBy(F.col("conv_id").cast("string").alias("run_id")).agg(
        F.when(F.max("turn") > 5, "failed").otherwise("succeeded").alias("outcome")
    )
    return logs, outcomes


@query(REGISTRY["tail_lines"].sql)
def tail_lines_streamed(spark, sf_dir):
    """The same tails from a stream of the lines; a last line of another run moves the clock on."""
    logs, outcomes = _logs(spark, sf_dir)
    path = work_dir(spark, "tails")
    # The clock of a stream starts at zero, and lines as old as that would be late.
    logs = logs.withColumn("ts", F.timestamp_add("DAY", F.lit(1), F.col("ts")))
    logs.write.parquet(f"{path}/logs")
    later = F.timestamp_seconds(F.lit(10**7))
    clock = logs.agg(F.count("*").alias("n")).select(
        F.lit("clock").alias("run_id"), F.lit("p").alias("pod"), F.lit("main").alias("container"), F.lit(0).alias("container_index"),
        later.alias("ts"), F.lit(0).cast("long").alias("line_no"), F.lit("").alias("line"),
    )
    clock.write.mode("append").parquet(f"{path}/logs")
    stream = spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/logs")
    tails = tail_lines_stream(stream, quiet_s=3600, delay_s=3600, n=2)
    write_outcomes(tails, f"{path}/table", f"{path}/checkpoint", True).awaitTermination()
    closed = spark.read.schema(tails.schema).parquet(f"{path}/table")
    return tails_of(closed, outcomes, 2, 1).select("run_id", "pod", "line_no", "line")


@query(
    """WITH p AS (SELECT p_partkey, CASE WHEN p_size <= 10 THEN 1 WHEN p_size <= 20 THEN 126
        WHEN p_size <= 30 THEN 127 WHEN p_size <= 40 THEN 137 ELSE p_size END AS exit_code
      FROM part)
    SELECT p_partkey, exit_code,
           CASE WHEN exit_code IN (1, 126, 127, 137) THEN 'fail_job' ELSE 'other' END
             AS exit_action,
           CASE exit_code WHEN 1 THEN 'generic error' WHEN 126 THEN 'command not executable'
             WHEN 127 THEN 'command not found' WHEN 137 THEN 'killed' END AS exit_reason
    FROM p"""
)
def classify_exit(spark, sf_dir):
    size = F.col("p_size")
    code = (
        F.when(size <= 10, 1)
        .when(size <= 20, 126)
        .when(size <= 30, 127)
        .when(size <= 40, 137)
        .otherwise(size)
    )
    return op.classify_exit(table(spark, sf_dir, "part").select("p_partkey", code.alias("exit_code")))


@query(
    """WITH b AS (
      SELECT doc_id, CASE source
          WHEN 'src0' THEN '' WHEN 'src1' THEN text WHEN 'src2' THEN NULL
          WHEN 'src3' THEN json_object('message', text)::VARCHAR
          WHEN 'src4' THEN json_object('code', n_chars)::VARCHAR
          ELSE json_object('message', source, 'details', json_object('causes', json_array(
                 json_object('field', lang, 'reason', source),
                 json_object('message', text))))::VARCHAR END AS body,
        source, lang, text
      FROM documents)
    SELECT doc_id, CASE source WHEN 'src3' THEN text WHEN 'src4' THEN 'N/A'
             WHEN 'src0' THEN NULL WHEN 'src1' THEN NULL WHEN 'src2' THEN NULL
             ELSE source END AS message,
           CASE i WHEN 1 THEN lang WHEN 2 THEN 'N/A' END AS field,
           CASE i WHEN 1 THEN source WHEN 2 THEN 'N/A' END AS reason,
           CASE i WHEN 1 THEN 'N/A' WHEN 2 THEN text END AS cause_message,
           CASE WHEN source IN ('src0', 'src2') THEN 'no additional content'
                WHEN source = 'src1' THEN substr(text, 1, 500) || '...' END AS note
    FROM b, (SELECT unnest([0, 1, 2]) AS i) n
    WHERE (i > 0) = (source NOT IN ('src0', 'src1', 'src2', 'src3', 'src4'))"""
)
def error_details(spark, sf_dir):
    text, source = F.col("text"), F.col("source")
    empty = F.lit(None).cast("string")
    cause = F.struct(F.col("lang").alias("field"), source.alias("reason"), empty.alias("message"))
    other = F.struct(empty.alias("field"), empty.alias("reason"), text.alias("message"))
    full = F.struct(
        source.alias("message"), F.struct(F.array(cause, other).alias("causes")).alias("details")
    )
    body = (
        F.when(source == "src0", "")
        .when(source == "src1", text)
        .when(source == "src2", empty)
        .when(source == "src3", F.to_json(F.struct(text.alias("message"))))
        .when(source == "src4", F.to_json(F.struct(F.col("n_chars").alias("code"))))
        .otherwise(F.to_json(full))
    )
    df = table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))
    return op.error_details(df).drop("body")


@query(
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'user ' || user_id ELSE 'N/A' END
             AS message,
           CASE WHEN event_type = 'error' THEN props END AS cause, NULL::VARCHAR AS note
    FROM events WHERE json_valid(props)"""
)
def error_details_of_events(spark, sf_dir):
    cause = F.struct(F.col("event_type").alias("field"), F.col("props").alias("message"))
    full = F.struct(
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("message"),
        F.struct(F.array(cause).alias("causes")).alias("details"),
    )
    body = F.when(F.col("event_type") == "error", F.to_json(full)).otherwise(F.col("props"))
    df = table(spark, sf_dir, "events").select("event_id", body.alias("props"))
    return op.error_details(df, "props").select(
        "event_id", "message", F.col("cause_message").alias("cause"), "note"
    )
