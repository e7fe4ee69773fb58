"""Entry queries: parts as stored scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkroster import operators as op
from sparkroster.catalog.base import query, table
from sparkroster.functions import stringify_map


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per part; some have no type, no engine, no role or no data."""
    long_text = F.concat_ws(" ", *["p_name", "p_brand", "p_type"] * 3)
    data = stringify_map(
        {
            "code": long_text,
            "description": F.when(F.col("p_size") > 10, long_text).otherwise(F.col("p_name")),
            "scriptType": F.when(F.col("p_size") > 5, F.col("p_brand")),
            "engine": F.when(F.col("p_size") > 8, F.lit("K8S_JOB")),
            "_hidden": F.col("p_size"),
        }
    )
    return table(spark, sf_dir, "part").select(
        F.lit("script").alias("kind"),
        F.lower("p_type").alias("namespace"),
        F.concat(F.lit("script-"), F.col("p_partkey").cast("string")).alias("name"),
        F.when(F.col("p_size") < 45, F.create_map(F.lit("role"), F.lit("script"))).alias("labels"),
        F.when(F.col("p_size") != 3, data).alias("data"),
    )


_SCRIPTS = """s AS (
      SELECT 'script-' || p_partkey AS name, p_partkey, lower(p_type) AS namespace, p_size,
             concat_ws(' ', p_name, p_brand, p_type, p_name, p_brand, p_type,
                       p_name, p_brand, p_type) AS code,
             CASE WHEN p_size > 10 THEN concat_ws(' ', p_name, p_brand, p_type, p_name, p_brand,
                    p_type, p_name, p_brand, p_type) ELSE p_name END AS description,
             CASE WHEN p_size > 5 THEN p_brand END AS type,
             CASE WHEN p_size > 8 THEN 'K8S_JOB' END AS engine
      FROM part)"""


@query(
    """SELECT 'script-' || p_partkey AS name, p_size > 5 AS typed FROM part
    WHERE lower(p_type) = 'economy' AND p_size <> 3"""
)
def scope_filter(spark, sf_dir):
    scoped = op.scope_filter(_scripts(spark, sf_dir), "economy")
    return scoped.where(F.col("data").isNotNull()).select(
        "name", F.map_contains_key("data", "scriptType").alias("typed")
    )


@query(
    f"""WITH {_SCRIPTS}, l AS (
      SELECT namespace, name, 'code' AS attribute, code AS value FROM s WHERE p_size <> 3
      UNION ALL SELECT namespace, name, 'description', CASE WHEN length(description) > 70
        THEN substr(description, 1, 70) || '...' ELSE description END FROM s WHERE p_size <> 3
      UNION ALL SELECT namespace, name, 'scriptType', type FROM s WHERE p_size <> 3
      UNION ALL SELECT namespace, name, 'engine', engine FROM s WHERE p_size <> 3)
    SELECT * FROM l WHERE value IS NOT NULL"""
)
def describe_entry(spark, sf_dir):
    return op.describe_entry(_scripts(spark, sf_dir), namespace=None)


@query(
    f"""WITH {_SCRIPTS}
    SELECT p_partkey::VARCHAR AS name, coalesce(type, 'N/A') AS type,
           coalesce(engine, 'N/A') AS engine,
           CASE WHEN length(description) > 50 THEN substr(description, 1, 47) || '...'
                ELSE description END AS description,
           name AS entry_name
    FROM s WHERE p_size < 45 AND p_size <> 3"""
)
def list_entries(spark, sf_dir):
    return op.list_entries(_scripts(spark, sf_dir), namespace=None)
