"""Tables partitioned by a column, of which a change rewrites only the partitions it touches.

A change runs as a named job in two steps. First the new rows of the touched partitions and
the results are written beside the table, in a folder that readers of the table do not see;
then those partitions are replaced. A job that is repeated, for example after a lost driver,
goes on with what the first attempt wrote, so the changes are judged once whatever happens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkroster.operators.change import Changed

BY = "namespace"
#: Folder of the jobs below a table; names with an underscore are no data to readers.
JOBS = "_jobs"
#: Up to so many touched values prune the listing of partitions; more are joined.
NAMED = 1000
_NOT_THERE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")
_DONE = ("created", "replaced", "patched", "deleted")


def create_partitioned(df: DataFrame, path: str, by: str = BY) -> str:
    """Write ``df`` as a table partitioned by ``by``."""
    df.write.mode("errorifexists").partitionBy(by).parquet(path)
    return path


def _written(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.parquet(path).isEmpty()
    except AnalysisException as e:
        if e.getCondition() in _NOT_THERE:
            return False
        raise


def _only(base: DataFrame, wanted: DataFrame, by: str) -> DataFrame:
    """The rows of ``base`` whose ``by`` is in ``wanted``; few values are given to the scan, so
    that other partitions are not even listed."""
    few = [r[0] for r in wanted.limit(NAMED + 1).collect()]
    if len(few) <= NAMED:
        return base.where(F.col(by).isin(few))
    return base.join(wanted, by, "left_semi")


def _applied(results: DataFrame) -> Column:
    """Whether a change did something, by either form of results."""
    if "applied" in results.columns:
        return F.col("applied") > 0
    return F.col("status").isin(*_DONE)


def change_partitions(
    base: DataFrame,
    path: str,
    job: str,
    change: Callable[[DataFrame, DataFrame], Changed],
    changes: DataFrame,
    by: str = BY,
) -> DataFrame:
    """Apply ``change(base, changes)`` to the table at ``path`` and return the results.

    ``base`` is the table as read; ``change`` is one of the keyed changes or the ordered log,
    bound to its other arguments. The key must hold ``by``, a string. Only partitions that the changes
    name are read, only those in which a change applied are written, and a partition without
    rows left is removed; the files of all others stay. ``job`` names the change: repeating
    it gives the same table and the same results, also if the first attempt broke off.
    """
    spark, staged = base.sparkSession, f"{path.rstrip('/')}/{JOBS}/{job}"
    if not _written(spark, f"{staged}/done"):
        changes.write.mode("overwrite").parquet(f"{staged}/changes")
        asked = spark.read.schema(changes.schema).parquet(f"{staged}/changes")
        part = _only(base, asked.where(F.col(by).isNotNull()).select(by).distinct(), by)
        done = change(part, asked)
        done.results.write.mode("overwrite").parquet(f"{staged}/results")
        results = spark.read.schema(done.results.schema).parquet(f"{staged}/results")
        touched = results.where(_applied(results)).select(by).distinct()
        rows = done.table.join(touched, by, "left_semi").select(*base.columns)
        rows.write.mode("overwrite").partitionBy(by).parquet(f"{staged}/table")
        left = spark.read.schema(base.schema).parquet(f"{staged}/table").select(by).distinct()
        folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder")
        emptied = _only(base.select(by, folder), touched.join(left, by, "left_anti"), by)
        emptied.select("folder").distinct().write.mode("overwrite").parquet(f"{staged}/emptied")
        spark.range(1).write.mode("overwrite").parquet(f"{staged}/done")
    rows = spark.read.schema(base.schema).parquet(f"{staged}/table")
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(by)
        .parquet(path)
    )
    _remove(spark.read.schema("folder string").parquet(f"{staged}/emptied"))
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(f"{staged}/results")


def _remove(folders: DataFrame) -> None:
    """Delete the folders of emptied partitions, a name at a time as the catalog would."""
    jvm, conf = folders.sparkSession._jvm, folders.sparkSession._jsc.hadoopConfiguration()
    for row in folders.toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(row["folder"]))
        path.getFileSystem(conf).delete(path, True)
