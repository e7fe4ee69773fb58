"""Registry of queries over the given tables, each with its ANSI SQL where there is one."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkroster import session

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Run], Run]:
    """Register a function under its own name."""

    def register(run: Run) -> Run:
        if run.__name__ in REGISTRY:
            raise ValueError(f"query {run.__name__} is registered twice")
        REGISTRY[run.__name__] = Query(run, sql)
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def string_map(**values) -> object:
    """A map literal of columns as text, nulls kept."""
    parts = []
    for key, value in values.items():
        parts += [F.lit(key.replace("__", "-")), value.cast("string")]
    return F.create_map(*parts)


def dash_sql(text: str) -> str:
    """SQL of a name made of letters, digits and dashes, from lower-case text."""
    return f"trim(regexp_replace({text}, '[^a-z0-9-]+', '-', 'g'), '-')"


def iso_sql(ts: str) -> str:
    """SQL of ISO-8601 text in UTC, microseconds only when there are any."""
    return (
        f"CASE WHEN {ts} = date_trunc('second', {ts}) "
        f"THEN strftime({ts}, '%Y-%m-%dT%H:%M:%S') "
        f"ELSE strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00'"
    )


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; below one of this machine where none is set, as in tests."""
    if spark.conf.get(session.CHECKPOINT_DIR, None):
        return session.work_dir(spark, name)
    return tempfile.mkdtemp(prefix=f"{name}-") + "/new"
