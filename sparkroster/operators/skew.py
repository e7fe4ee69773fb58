"""Lookup join that spreads the rows of hot keys.

The adaptive skew join splits a large partition only when both sides of the join are plain
shuffles. It steps back when one side is an aggregate that is already partitioned by the
key, and when a grouping by the key follows. Those joins go through :func:`lookup`: rows
of hot keys, and rows with a null key, are sent to many tasks, and the few lookup rows of
the hot keys are repeated for each of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_SHARES = 64


def default_shares(df: DataFrame) -> int:
    """As many shares of the rows as there are shuffle partitions, and some at least."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(partitions, LEAST_SHARES)


def key_counts(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows per key without nulls, counted in the map tasks first."""
    for k in key:
        rows = rows.where(F.col(k).isNotNull())
    return rows.groupBy(*key).agg(F.count("*").alias("n"))


def hot_keys(rows: DataFrame, key: Sequence[str], shares: int) -> DataFrame:
    """Keys with more than one ``shares``-th of the rows that have a key, and ``_parts`` to spread
    each over. The rows are counted once: their total is the sum of the counts.

    There are fewer than ``shares`` such keys whatever the data, so the result may be
    broadcast. A key gets a part per share it holds, so all parts together are fewer than
    twice ``shares``.
    """
    counts = key_counts(rows, key)
    total = counts.agg(F.sum("n")).scalar()
    parts = F.ceil(F.col("n") * F.lit(shares) / total).cast("int")
    return counts.select(*key, parts.alias("_parts")).where(F.col("_parts") > 1)


def _row_hash(rows: DataFrame, key: Sequence[str]) -> Column:
    """A hash of the row without its key: the same in every attempt of a task."""
    parts = [
        F.map_entries(f.name) if f.dataType.typeName() == "map" else F.col(f.name)
        for f in rows.schema.fields
        if f.name not in key
    ]
    return F.xxhash64(*parts) if parts else F.lit(0)


def lookup(
    rows: DataFrame,
    right: DataFrame,
    key: str | Sequence[str],
    how: str = "left",
    counted: DataFrame | None = None,
    shares: int | None = None,
) -> DataFrame:
    """Join ``rows`` to ``right``, which has few rows per key (left, inner, semi or anti).

    Keys are counted in ``rows``, or in ``counted`` where a table from before earlier joins
    has the same keys and is cheaper to read.
    """
    key = [key] if isinstance(key, str) else list(key)
    shares = shares or default_shares(rows)
    marks = F.broadcast(hot_keys(rows if counted is None else counted, key, shares))
    no_key = F.lit(False)
    for k in key:
        no_key = no_key | F.col(k).isNull()
    parts = F.when(no_key, shares).otherwise(F.col("_parts"))
    spread = F.pmod(_row_hash(rows, key), parts).cast("int")
    left = (
        rows.join(marks, key, "left")
        .withColumn("_part", F.coalesce(spread, F.lit(0)))
        .drop("_parts")
    )
    last = F.coalesce("_parts", F.lit(1)) - 1
    copies = (
        right.join(marks, key, "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), last)))
        .drop("_parts")
    )
    return left.join(copies, [*key, "_part"], how).drop("_part")
