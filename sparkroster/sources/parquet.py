"""Parquet output and its check."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_SUB_DIR = "output"
_NOTHING_THERE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def write_parquet(
    df: DataFrame,
    base: str,
    sub_dir: str = DEFAULT_SUB_DIR,
    partition_by: Sequence[str] = (),
) -> str:
    """Append to ``base/sub_dir`` under new file names; earlier output stays.

    A table read one namespace at a time is best partitioned by it: the read then lists and
    opens only that namespace. The path is returned.
    """
    path = f"{base.rstrip('/')}/{sub_dir}"
    df.write.mode("append").partitionBy(*partition_by).parquet(path)
    return path


def write_apart(df: DataFrame, base: str, sub_dir: str = DEFAULT_SUB_DIR) -> str:
    """Write to a folder of its own, ``base/sub_dir/write_id=...``, and return its path.

    What stands there is this write and nothing else, so it can be checked; reading
    ``base/sub_dir`` gives all writes, with ``write_id`` as a column.
    """
    path = f"{base.rstrip('/')}/{sub_dir}/write_id={uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def _shape(schema: T.StructType) -> list[tuple[str, str]]:
    """Names and types; partition columns come last when read back, so order is left out."""
    return sorted((f.name, f.dataType.simpleString()) for f in schema.fields)


def verify_written(
    spark: SparkSession, path: str, schema: T.StructType, min_rows: int = 1
) -> DataFrame:
    """One row (path, n_rows, schema_ok, found). Missing output is a result, not an error."""
    try:
        written = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in _NOTHING_THERE:
            raise
        counted = spark.range(1, numPartitions=1).select(F.lit(0).cast("bigint").alias("n_rows"))
        same = False
    else:
        counted = written.agg(F.count("*").alias("n_rows"))
        same = _shape(written.schema) == _shape(schema)
    return counted.select(
        F.lit(path).alias("path"),
        "n_rows",
        F.lit(same).alias("schema_ok"),
        (F.col("n_rows") >= min_rows).alias("found"),
    )
