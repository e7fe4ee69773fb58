"""Column function queries over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkroster import functions as fn
from sparkroster.catalog.base import dash_sql, iso_sql, query, string_map, table


@query(
    f"""SELECT doc_id, nullif(substr({dash_sql("lower(text)")}, 1, 63), '') AS name,
           {dash_sql("lower(text)")} = '' AS bad
    FROM documents"""
)
def sanitize_name(spark, sf_dir):
    named = table(spark, sf_dir, "documents").select(
        "doc_id", "text", fn.sanitize_name("text").alias("name")
    )
    return named.select("doc_id", "name", fn.is_bad_name("text", "name").alias("bad"))


@query(
    f"""SELECT page_id, substr('page-' || page_id || '-' || CASE WHEN {dash_sql("url")} = ''
           THEN 'env' ELSE {dash_sql("url")} END, 1, 63) AS namespace
    FROM pages"""
)
def physical_name(spark, sf_dir):
    project = F.concat(F.lit("page-"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select(
        "page_id", fn.physical_name(project, "url").alias("namespace")
    )


@query(
    f"""SELECT page_id, 'project-' || {dash_sql("lower(url)")} AS repo,
           {dash_sql("lower(url)")} AS branch FROM pages"""
)
def repo_and_branch_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", fn.repo_name("url").alias("repo"), fn.branch_name("url").alias("branch")
    )


@query(
    """SELECT p_partkey, substr('run-exec-' || translate(lower(p_name || '_' || p_type), '_', '-')
           || '-' || substr(sha256(p_partkey::VARCHAR), 1, 8), 1, 63) AS run
    FROM part"""
)
def run_name(spark, sf_dir):
    suffix = fn.new_id("p_partkey", prefix="", n=8)
    name = F.concat_ws("_", "p_name", "p_type")
    return table(spark, sf_dir, "part").select(
        "p_partkey", fn.run_name(name, suffix).alias("run")
    )


@query(
    """SELECT o_orderkey, 'proj-' || substr(sha256(o_orderkey::VARCHAR), 1, 12) AS id
    FROM orders"""
)
def new_id(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.new_id("o_orderkey").alias("id"))


@query(
    """SELECT doc_id, CASE WHEN length(text) > 70 THEN substr(text, 1, 70) || '...'
           ELSE text END AS value,
           CASE WHEN length(text) > 50 THEN substr(text, 1, 47) || '...' ELSE text END
             AS description
    FROM documents"""
)
def preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        fn.preview("text", 70, 70).alias("value"),
        fn.preview("text", 50, 47).alias("description"),
    )


@query(
    """SELECT doc_id, CASE WHEN instr(text, 'the') > 0
           THEN substr(text, 1, instr(text, 'the') - 1) || substr(text, instr(text, 'the') + 3)
           ELSE text END AS text
    FROM documents"""
)
def strip_first(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", fn.strip_first("text", "the").alias("text")
    )


@query(
    """SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base,
           CASE WHEN instr(url, '/') = 0 THEN ''
                ELSE rtrim(regexp_extract(url, '^(.*)/[^/]*$', 1), '/') END AS dir
    FROM pages"""
)
def path_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", fn.path_base("url").alias("base"), fn.path_dir("url").alias("dir")
    )


@query(
    """SELECT c_custkey, CASE WHEN c_nationkey < 10 THEN 1 ELSE 2 END AS n_literal, c_name AS name,
           CASE WHEN c_nationkey < 10 THEN 1 ELSE 0 END AS n_files,
           CASE WHEN c_nationkey < 10 THEN '/certs/' || c_custkey || '.pem' END AS cert
    FROM customer"""
)
def split_file_fields(spark, sf_dir):
    path = F.concat(F.lit("/certs/"), F.col("c_custkey").cast("string"), F.lit(".pem"))
    fields = F.when(
        F.col("c_nationkey") < 10,
        string_map(name=F.col("c_name"), file_cert=path, file_=F.col("c_name")),
    ).otherwise(string_map(name=F.col("c_name"), cert=path, file_=F.col("c_name")))
    literal, files = fn.split_file_fields(fields)
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.size(literal).alias("n_literal"),
        literal["name"].alias("name"),
        F.size(files).alias("n_files"),
        files["cert"].alias("cert"),
    )


@query(
    """SELECT doc_id, md5(base64(encode(text))) AS encoded,
           length(base64(encode(text)))::INTEGER AS n, md5(text) AS decoded
    FROM documents"""
)
def encode_and_decode(spark, sf_dir):
    encoded = (
        table(spark, sf_dir, "documents")
        .select("doc_id", fn.encode_values(string_map(text=F.col("text"))).alias("data"))
    )
    return encoded.select(
        "doc_id",
        F.md5(F.col("data")["text"]).alias("encoded"),
        F.length(F.col("data")["text"]).alias("n"),
        F.md5(fn.decode_values("data")["text"].cast("binary")).alias("decoded"),
    )


@query(
    """SELECT o_orderkey, o_orderpriority AS priority,
           CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE lower(o_orderstatus) END AS status,
           CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'yes' END AS extra,
           CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 3 END AS n
    FROM orders"""
)
def merge_params(spark, sf_dir):
    config = string_map(priority=F.col("o_orderpriority"), status=F.lit("F"))
    inline = F.when(
        F.col("o_orderstatus") != "P",
        string_map(status=F.lower("o_orderstatus"), extra=F.lit("yes")),
    )
    merged = fn.merge_params(config, inline)
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", merged.alias("p"))
        .select(
            "o_orderkey",
            F.col("p")["priority"].alias("priority"),
            F.col("p")["status"].alias("status"),
            F.col("p")["extra"].alias("extra"),
            F.size("p").alias("n"),
        )
    )


@query(
    """SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment,
           c_nationkey::VARCHAR AS nation, CASE WHEN c_acctbal >= 0 THEN 2 ELSE 1 END AS n
    FROM customer"""
)
def params_by_prefix(spark, sf_dir):
    more = string_map(
        run_segment=F.col("c_mktsegment"), run_nation=F.col("c_nationkey"), other=F.col("c_name")
    )
    less = string_map(segment=F.col("c_mktsegment"), run_nation=F.col("c_nationkey"))
    config = F.when(F.col("c_acctbal") >= 0, more).otherwise(less)
    return (
        table(spark, sf_dir, "customer")
        .select("c_custkey", fn.params_by_prefix(config, "run_").alias("p"))
        .select(
            "c_custkey",
            F.col("p")["segment"].alias("segment"),
            F.col("p")["nation"].alias("nation"),
            F.size("p").alias("n"),
        )
    )


@query(
    """SELECT c_custkey, '--segment ' || c_mktsegment || ' --Segment ' || c_nationkey AS args,
           'PARAM_SEGMENT=' || c_mktsegment || ' PARAM_SEGMENT=' || c_nationkey AS env,
           'PARAM_SEGMENT' AS shared
    FROM customer"""
)
def params_as_args_and_env(spark, sf_dir):
    params = string_map(segment=F.col("c_mktsegment"), Segment=F.col("c_nationkey"))
    env = F.transform(
        fn.params_as_env("p"), lambda e: F.concat(e["name"], F.lit("="), e["value"])
    )
    return (
        table(spark, sf_dir, "customer")
        .select("c_custkey", params.alias("p"))
        .select(
            "c_custkey",
            F.array_join(fn.params_as_args("p"), " ").alias("args"),
            F.array_join(env, " ").alias("env"),
            F.array_join(fn.env_collisions("p"), ",").alias("shared"),
        )
    )


@query(
    """SELECT o_orderkey, o_custkey::VARCHAR AS customer,
           CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS status,
           CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 2 END AS n
    FROM orders"""
)
def stringify_map(spark, sf_dir):
    data = fn.stringify_map(
        {"customer": F.col("o_custkey"), "status": F.nullif(F.col("o_orderstatus"), F.lit("P"))}
    )
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", data.alias("d"))
        .select(
            "o_orderkey",
            F.col("d")["customer"].alias("customer"),
            F.col("d")["status"].alias("status"),
            F.size("d").alias("n"),
        )
    )


@query(
    f"""SELECT event_id, {iso_sql("ts")} AS at,
           coalesce(CASE WHEN event_type = 'error' THEN NULL
                    ELSE {iso_sql("date_trunc('day', ts)")} END, 'N/A') AS day
    FROM events"""
)
def iso_time(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    day = F.when(F.col("event_type") != "error", F.date_trunc("day", ts))
    return table(spark, sf_dir, "events").select(
        "event_id", fn.iso_time(ts).alias("at"), fn.iso_time(day).alias("day")
    )
