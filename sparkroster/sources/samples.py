"""Typed sample rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkroster.constants import SAMPLE_FACTOR, SAMPLE_FIRST_ID, SAMPLE_NAME_PREFIX

SAMPLE_SCHEMA = T.StructType(
    [
        T.StructField("user_name_arg", T.StringType()),
        T.StructField("user_id_arg", T.IntegerType()),
        T.StructField("value_arg", T.DoubleType()),
    ]
)


def sample_columns(i: Column, first_id: int = SAMPLE_FIRST_ID) -> list[Column]:
    """The three typed columns of sample row ``i``, counted from zero."""
    return [
        F.concat(F.lit(SAMPLE_NAME_PREFIX), (i + 1).cast("string")).alias("user_name_arg"),
        (i + first_id).cast("int").alias("user_id_arg"),
        (i.cast("double") * F.lit(SAMPLE_FACTOR)).alias("value_arg"),
    ]


def sample_rows(spark: SparkSession, n: int, first_id: int = SAMPLE_FIRST_ID) -> DataFrame:
    """``n`` generated rows, made in the tasks."""
    return spark.range(n).select(*sample_columns(F.col("id"), first_id))
