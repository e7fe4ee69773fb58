"""Ordered change logs that arrive as a stream."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sparkroster.operators.changelog import apply_changes
from sparkroster.schemas import ENTRY_KEY
from sparkroster.sources.partitions import BY, JOBS, change_partitions

COUNTS = ("applied", "rejected", "noop", "invalid")


def apply_change_stream(
    changes: DataFrame,
    path: str,
    schema: StructType,
    checkpoint: str,
    name: str = "log",
    key: Sequence[str] = ENTRY_KEY,
    by: str = BY,
    available_now: bool = False,
) -> StreamingQuery:
    """Apply a stream of ordered changes to the table at ``path``, partitioned by ``by``.

    Every micro-batch is folded into the table by :func:`~sparkroster.operators.apply_changes`
    and rewrites the partitions it touches; what exists is carried to the next batch by the
    table itself. The changes of a key must arrive in the order of their ``seq``; then any
    cut of a log into micro-batches gives the table that the whole log gives. A batch that
    is repeated after a restart is recognised by its number and judged once. ``schema`` is
    that of the table, and one stream of a ``name`` writes it.
    """

    def step(batch: DataFrame, number: int) -> None:
        base = batch.sparkSession.read.schema(schema).parquet(path)
        change_partitions(base, path, f"{name}-{number}", partial(apply_changes, key=key), batch, by)

    writer = changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def stream_results(
    spark: SparkSession, path: str, name: str = "log", key: Sequence[str] = ENTRY_KEY
) -> DataFrame:
    """Per key (applied, rejected, noop, invalid), summed over the micro-batches of a stream."""
    results = spark.read.parquet(f"{path.rstrip('/')}/{JOBS}/{name}-*/results")
    return results.groupBy(*key).agg(*[F.sum(c).alias(c) for c in COUNTS])
