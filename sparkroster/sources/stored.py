"""Tables stored in buckets of their key, changed without a shuffle of what is stored.

A stored table is a view on its last version, a bucketed and sorted Parquet table. The keyed
changes of :mod:`sparkroster.operators.change` join it bucket by bucket, so only the changes
move. A change writes the next version and then moves the view, which is one step of the
catalog: readers see the table before or after it, and versions stay until they are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from sparkroster.operators.change import Changed, upsert_labels
from sparkroster.schemas import ENTRY_KEY

_VERSION = "__v"


def _quoted(name: str) -> str:
    return ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))


def _save(
    df: DataFrame, name: str, version: int, key: Sequence[str], buckets: int, folder: str | None
) -> None:
    writer = df.write.mode("errorifexists").bucketBy(buckets, *key).sortBy(*key)
    full = f"{name}{_VERSION}{version}"
    if folder:
        writer = writer.option("path", f"{folder.rstrip('/')}/{full}")
    writer.saveAsTable(full)


def _show(spark: SparkSession, name: str, version: int) -> None:
    spark.sql(
        f"CREATE OR REPLACE VIEW {_quoted(name)} AS SELECT * FROM {_quoted(f'{name}{_VERSION}{version}')}"
    )


def versions(spark: SparkSession, name: str) -> list[int]:
    """The versions of a stored table that the catalog holds, oldest first."""
    *database, short = name.split(".")
    prefix = f"{short}{_VERSION}".lower()
    found = [t.name.lower() for t in spark.catalog.listTables(*database)]
    tails = [t.removeprefix(prefix) for t in found if t.startswith(prefix)]
    return sorted(int(t) for t in tails if t.isdigit())


def store(
    df: DataFrame,
    name: str,
    buckets: int,
    key: Sequence[str] = ENTRY_KEY,
    folder: str | None = None,
) -> DataFrame:
    """Store ``df``, one row per key, as the first version of the table ``name``.

    Take as many buckets as tasks should read the table: a bucket is read by one task. The
    versions lie in ``folder``, or in the warehouse where none is given.
    """
    spark = df.sparkSession
    _save(df.repartition(buckets, *key), name, 1, key, buckets, folder)
    _show(spark, name, 1)
    return spark.table(name)


def bucket_count(spark: SparkSession, name: str, key: Sequence[str] = ENTRY_KEY) -> int:
    """In how many buckets of ``key`` the last version is stored; an error if it is not."""
    last = versions(spark, name)
    if not last:
        raise ValueError(f"{name} is not a stored table")
    about = spark.sql(f"DESCRIBE EXTENDED {_quoted(f'{name}{_VERSION}{last[-1]}')}").collect()
    said = {r["col_name"]: r["data_type"] for r in about}
    columns = [c.strip(" `") for c in said.get("Bucket Columns", "[]").strip("[]").split(",")]
    if columns != list(key):
        raise ValueError(f"{name} is stored by {columns}, not by {list(key)}")
    return int(said["Num Buckets"])


def change_stored(
    spark: SparkSession,
    name: str,
    change: Callable[..., Changed],
    changes: DataFrame,
    key: Sequence[str] = ENTRY_KEY,
    folder: str | None = None,
) -> DataFrame:
    """Apply a keyed change, for example ``create_if_absent``, to a stored table.

    The next version is written and shown; the result is that of the change, judged against
    the version before, which stays. Two changes at once are told apart by the catalog: the
    one that comes second to write the same version fails and leaves the table as it is.
    """
    buckets = bucket_count(spark, name, key)
    last = versions(spark, name)[-1]
    base = spark.table(f"{name}{_VERSION}{last}")
    keyed = {} if change is upsert_labels else {"key": key}
    done = change(base, changes, **keyed, buckets=buckets)
    _save(done.table, name, last + 1, key, buckets, folder)
    _show(spark, name, last + 1)
    return done.results


def keep_versions(spark: SparkSession, name: str, n: int = 2) -> list[int]:
    """Drop all but the last ``n`` versions; those dropped are returned. Results of a change
    that were not written yet need the version before it."""
    old = versions(spark, name)[: -max(n, 1)]
    for v in old:
        spark.sql(f"DROP TABLE {_quoted(f'{name}{_VERSION}{v}')}")
    return old
