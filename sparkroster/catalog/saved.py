"""Saved query and output queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkroster import plans, sources
from sparkroster.catalog.base import query, string_map, table, work_dir
from sparkroster.functions import encode
from sparkroster.schemas import SAVED_QUERIES


@query(
    """WITH d AS (SELECT p_partkey, CASE WHEN p_size > 20 OR p_size < 5 THEN p_name END AS code,
             CASE WHEN p_size < 12 THEN '/code/' || p_partkey END AS code_path,
             CASE WHEN p_type <> 'ECONOMY' THEN p_type END AS type,
             CASE WHEN p_size > 30 THEN 'X' ELSE '' END AS engine, p_retailprice < 1000 AS has_file,
             p_brand AS text
      FROM part)
    SELECT p_partkey::VARCHAR AS name, CASE engine WHEN '' THEN 'K8S_JOB' ELSE engine END AS engine,
           coalesce(code, CASE WHEN has_file AND code_path IS NOT NULL THEN text END) AS code,
           CASE WHEN code IS NOT NULL AND code_path IS NOT NULL THEN 'two_sources'
                WHEN code IS NULL AND code_path IS NULL THEN 'no_code'
                WHEN code_path IS NOT NULL AND NOT has_file THEN 'no_file'
                WHEN type IS NULL THEN 'no_type' ELSE 'ok' END AS status
    FROM d"""
)
def check_definitions(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    path = F.concat(F.lit("/code/"), key)
    defs = part.select(
        F.lit("default").alias("namespace"),
        key.alias("name"),
        F.nullif(F.col("p_type"), F.lit("ECONOMY")).alias("type"),
        F.when(F.col("p_size") > 30, "X").otherwise("").alias("engine"),
        F.when((F.col("p_size") > 20) | (F.col("p_size") < 5), F.col("p_name")).alias("code"),
        F.when(F.col("p_size") < 12, path).alias("code_path"),
    )
    files = part.where(F.col("p_retailprice") < 1000).select(
        path.alias("path"), F.col("p_brand").alias("text")
    )
    return plans.check_definitions(defs, files).select("name", "engine", "code", "status")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey END AS customer,
           CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END AS price,
           concat_ws('; ', CASE WHEN o_orderstatus = 'F' THEN 'not bigint: customer' END,
             CASE WHEN o_orderpriority = '5-LOW' THEN 'missing: price' END,
             CASE WHEN o_orderstatus = 'P' THEN 'unknown: extra' END) AS errors
    FROM orders"""
)
def bind_params(spark, sf_dir):
    status, low = F.col("o_orderstatus"), F.col("o_orderpriority") == "5-LOW"
    customer = F.col("o_custkey").cast("string")
    wrong = F.when(status == "F", F.concat(F.lit("no. "), customer)).otherwise(customer)
    base = string_map(customer=wrong)
    price = string_map(price=F.col("o_totalprice"))
    extra = string_map(extra=status)
    none = F.create_map().cast("map<string,string>")
    params = F.map_concat(
        base, F.when(low, none).otherwise(price), F.when(status == "P", extra).otherwise(none)
    )
    calls = table(spark, sf_dir, "orders").select("o_orderkey", params.alias("params"))
    bound = plans.bind_params(calls, "customer:bigint, price:double")
    return bound.select(
        "o_orderkey",
        "values.customer",
        "values.price",
        F.array_join("errors", "; ").alias("errors"),
    )


@query(
    """SELECT c.c_custkey::VARCHAR AS name, c.c_name AS literal,
           base64(encode(p.p_name)) AS cert, base64(encode(q.p_brand)) AS key,
           CASE WHEN p.p_partkey IS NULL AND q.p_partkey IS NULL THEN 'cert, key'
                WHEN p.p_partkey IS NULL THEN 'cert' WHEN q.p_partkey IS NULL THEN 'key' ELSE '' END
             AS missing,
           CASE WHEN p.p_partkey IS NULL OR q.p_partkey IS NULL THEN 'missing_file' ELSE 'ok' END
             AS status
    FROM customer c
    LEFT JOIN part p ON p.p_partkey = c.c_custkey AND p.p_size < 40
    LEFT JOIN part q ON q.p_partkey = c.c_custkey + 1 AND q.p_size >= 10"""
)
def resolve_file_fields(spark, sf_dir):
    """Parts as files: small ones hold a certificate, larger ones a key."""
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")

    def files(folder: str, content: str) -> DataFrame:
        return part.select(
            F.concat(F.lit(f"/{folder}/"), key).alias("path"),
            encode(content).alias("value"),
            "p_size",
        )

    stored = files("cert", "p_name").where(F.col("p_size") < 40).unionByName(
        files("key", "p_brand").where(F.col("p_size") >= 10)
    )
    custkey = F.col("c_custkey")
    entries = table(spark, sf_dir, "customer").select(
        F.lit("secret").alias("kind"),
        F.lit("default").alias("namespace"),
        custkey.cast("string").alias("name"),
        string_map(
            name=F.col("c_name"),
            file_cert=F.concat(F.lit("/cert/"), custkey.cast("string")),
            file_key=F.concat(F.lit("/key/"), (custkey + 1).cast("string")),
        ).alias("data"),
    )
    return sources.resolve_file_fields(entries, stored).select(
        "name",
        F.col("literal")["name"].alias("literal"),
        F.col("encoded")["cert"].alias("cert"),
        F.col("encoded")["key"].alias("key"),
        F.array_join("missing", ", ").alias("missing"),
        "status",
    )


@query(
    """SELECT p_partkey::VARCHAR AS name, p_type AS type, p_name AS code, p_brand AS description
    FROM part"""
)
def stored_definitions(spark, sf_dir):
    """Definitions written in their stored form and read back."""
    none = F.lit(None).cast("string")
    defs = table(spark, sf_dir, "part").select(
        F.lit("default").alias("namespace"),
        F.col("p_partkey").cast("string").alias("name"),
        F.col("p_type").alias("type"),
        none.alias("engine"),
        F.col("p_name").alias("code"),
        none.alias("code_path"),
        none.alias("params_spec"),
        F.col("p_brand").alias("description"),
    )
    back = plans.definitions_from_entries(plans.definitions_as_entries(defs))
    return back.select("name", "type", "code", "description")


_REVENUE = """SELECT l_returnflag, l_linestatus, count(*) AS n_lines, sum(l_quantity) AS quantity
  FROM IDENTIFIER(:lines) WHERE l_quantity >= :least AND l_shipdate < :before
  GROUP BY l_returnflag, l_linestatus"""


def _definitions(spark: SparkSession) -> DataFrame:
    spec = "lines:string, least:double, before:timestamp_ntz"
    return spark.createDataFrame(
        [
            ("default", "revenue", "SQL_SPARK", "", _REVENUE, None, spec, "lines by flag"),
            ("default", "spend", "PYSPARK", "", "spend", None, "status:string", "by customer"),
            ("other", "revenue", "PYTHON", "", "print()", None, None, "not for Spark"),
        ],
        SAVED_QUERIES,
    )


_LINES = "roster_lineitem"


def _revenue_call(spark: SparkSession, sf_dir: str) -> dict:
    table(spark, sf_dir, "lineitem").createOrReplaceTempView(_LINES)
    config = {"run_before": "1998-01-01", "run_least": "1", "run_lines": _LINES, "other": "x"}
    return {"config": config, "prefix": "run_", "inline": {"least": 10}}


_REVENUE_SQL = """SELECT l_returnflag, l_linestatus, count(*) AS n_lines,
      sum(l_quantity) AS quantity
    FROM lineitem WHERE l_quantity >= 10 AND l_shipdate < TIMESTAMP '1998-01-01'
    GROUP BY l_returnflag, l_linestatus"""


@query(_REVENUE_SQL)
def run_saved_sql(spark, sf_dir):
    call = _revenue_call(spark, sf_dir)
    return plans.run_saved_query(spark, _definitions(spark), "Revenue", **call)


@query(
    """SELECT o_custkey, count(*) AS n_orders, max(o_totalprice) AS most FROM orders
    WHERE o_orderstatus = 'P' GROUP BY o_custkey"""
)
def run_saved_function(spark, sf_dir):
    def spend(session: SparkSession, params: dict) -> DataFrame:
        orders = table(session, sf_dir, "orders")
        return (
            orders.where(F.col("o_orderstatus") == F.lit(params["status"]))
            .groupBy("o_custkey")
            .agg(F.count("*").alias("n_orders"), F.max("o_totalprice").alias("most"))
        )

    return plans.run_saved_query(
        spark, _definitions(spark), "spend", {"status": "P"}, functions={"spend": spend}
    )


@query(
    f"""SELECT count(*) AS n_rows, true AS schema_ok, count(*) >= 1 AS found
    FROM ({_REVENUE_SQL}) q"""
)
def run_and_write(spark, sf_dir):
    call = _revenue_call(spark, sf_dir)
    done = plans.run_and_write(
        spark, _definitions(spark), "revenue", work_dir(spark, "saved"), **call
    )
    return done.drop("path")


@query(
    """SELECT count(DISTINCT l_returnflag = 'R') AS n_rows, true AS schema_ok, true AS found
    FROM lineitem WHERE l_quantity >= 10"""
)
def run_and_write_again(spark, sf_dir):
    """Two writes to one place; the report is on the second, which groups more coarsely."""
    call, base = _revenue_call(spark, sf_dir), work_dir(spark, "saved")
    plans.run_and_write(spark, _definitions(spark), "revenue", base, **call)

    def returned(session: SparkSession, params: dict) -> DataFrame:
        lines = table(session, sf_dir, "lineitem").where(F.col("l_quantity") >= 10)
        is_returned = F.col("l_returnflag") == "R"
        return lines.groupBy(is_returned.alias("returned")).agg(F.count("*").alias("n_lines"))

    done = plans.run_and_write(
        spark, _definitions(spark), "spend", base, functions={"spend": returned}, inline={"status": "P"}
    )
    return done.drop("path")


@query(
    """SELECT c_custkey, 'ArgUser' || (c_custkey + 1) AS user_name_arg,
           (301 + c_custkey)::INTEGER AS user_id_arg, c_custkey::DOUBLE * 1.23::DOUBLE AS value_arg
    FROM customer"""
)
def sample_rows(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", *sources.sample_columns(F.col("c_custkey"))
    )


@query("SELECT count(*) AS n_rows, true AS schema_ok, count(*) >= 1 AS found FROM customer")
def write_and_verify(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(*sources.sample_columns(F.col("c_custkey")))
    path = sources.write_parquet(rows, work_dir(spark, "sample"))
    return sources.verify_written(spark, path, sources.SAMPLE_SCHEMA).drop("path")


def _text_files(spark: SparkSession, sf_dir: str) -> str:
    """All part lines as text files of at most 5,000 lines."""
    path = work_dir(spark, "text")
    lines = table(spark, sf_dir, "part").select(
        F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name", "p_brand").alias("value")
    )
    lines.write.option("maxRecordsPerFile", 5000).text(path)
    return f"{path}/*.txt"


_LINES_SQL = "SELECT p_partkey || ',' || p_name || ',' || p_brand AS line FROM part"


@query(_LINES_SQL)
def text_files_as_rows(spark, sf_dir):
    files = sources.text_files_as_rows(spark, _text_files(spark, sf_dir))
    return files.select(F.explode(F.split(F.rtrim(F.col("text"), F.lit("\n")), "\n")).alias("line"))


@query(_LINES_SQL)
def files_as_rows(spark, sf_dir):
    files = sources.files_as_rows(spark, _text_files(spark, sf_dir))
    text = F.unbase64("value").cast("string")
    return files.select(F.explode(F.split(F.rtrim(text, F.lit("\n")), "\n")).alias("line"))


@query(
    """SELECT lower(p_brand) AS name, p_partkey || ',' || p_name || ',' || p_brand AS line FROM part"""
)
def files_as_entries(spark, sf_dir):
    """The parts of each brand in a folder of its own; each folder is an entry."""
    path = work_dir(spark, "brands")
    lines = table(spark, sf_dir, "part").select(
        F.lower("p_brand").alias("brand"),
        F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name", "p_brand").alias("value"),
    )
    lines.write.partitionBy("brand").text(path)
    found = sources.files_as_entries(spark, f"{path}/*/*.txt", "brand", "default")
    files = found.select("name", F.explode("data").alias("file", "value"))
    text = F.rtrim(F.unbase64("value").cast("string"), F.lit("\n"))
    return files.select(
        F.url_decode(F.replace("name", F.lit("brand="), F.lit(""))).alias("name"),
        F.explode(F.split(text, "\n")).alias("line"),
    )
