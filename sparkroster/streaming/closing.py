"""Run outcomes over a stream, one row per run whatever its silences."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkroster.constants import RUN_TIMEOUT_SECONDS

if TYPE_CHECKING:
    import pandas as pd

NEVER = 1 << 62
_TIMES = ("first", "started", "ok", "bad")
_STATE = ", ".join(f"{t} long" for t in _TIMES) + ", closed boolean"
_CLOSED = "run_id {}, start_us long, outcome string, decided_us long"


def _closing(timeout_us: int):
    """The step of one run: its four lowest times as the state, a timer at its deadline."""

    def step(
        key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        import pandas as pd

        *times, closed = state.get if state.exists else (*[NEVER] * len(_TIMES), False)
        if closed:
            return
        if not state.hasTimedOut:
            for rows in pieces:
                lowest = rows[list(_TIMES)].min()
                times = [min(t, int(x)) for t, x in zip(times, lowest, strict=True)]
        first, started, ok, bad = times
        start = first if started == NEVER else started
        deadline_ms = -(-(start + timeout_us) // 1000)
        watermark_ms = state.getCurrentWatermarkMs()
        if not state.hasTimedOut and deadline_ms >= watermark_ms:
            state.update((*times, False))
            state.setTimeoutTimestamp(max(deadline_ms, watermark_ms + 1))
            return
        decided = min(ok, bad)
        in_time = decided <= start + timeout_us
        outcome = "timeout" if not in_time else "succeeded" if ok == decided else "failed"
        state.update((*times, True))
        row = {"run_id": [key[0]], "start_us": [start], "outcome": [outcome]}
        decided_at = pd.array([decided if in_time else None], dtype="Int64")
        yield pd.DataFrame(row | {"decided_us": decided_at})

    return step


def closed_outcomes_stream(
    samples: DataFrame, timeout_s: int = RUN_TIMEOUT_SECONDS, delay_s: int = 60
) -> DataFrame:
    """(run_id, start_time, outcome, decided_at), one row per closed run, as the batch rule has it.

    A run starts at the start that its samples carry, or with its first sample where none
    carries one. It is closed once its timeout and the allowed delay have passed in event
    time; samples that come after that, however late, change nothing and give no second row.
    Runs that are open when the stream ends are not in the result, nor are samples without a
    time. A start that no sample carries before the run is closed is not seen.

    This needs state that outlives any window: a run's four lowest times, and after closing
    that it is closed. The state is one short row per run that was ever seen, so a stream of
    runs without end is best restarted from time to time with the runs that are done left
    out. Samples of a run reach its step in pieces and are reduced as they come, so a run
    with very many samples costs no memory. The step runs in Python, the one place outside
    ``llm`` that does: no built-in aggregation keeps state beyond its window.
    """
    ok = F.coalesce("succeeded", F.lit(0)) > 0
    bad = F.coalesce("failed", F.lit(0)) > 0
    at, never = F.unix_micros("ts"), F.lit(NEVER).cast("long")
    rows = (
        samples.where(F.col("ts").isNotNull())
        .withColumns({"ts": F.col("ts").cast("timestamp"), "start_time": F.col("start_time").cast("timestamp")})
        .withWatermark("ts", f"{delay_s} seconds")
        .select(
            "run_id",
            "ts",
            at.alias("first"),
            F.coalesce(F.unix_micros("start_time"), never).alias("started"),
            F.when(ok, at).otherwise(never).alias("ok"),
            F.when(bad & ~ok, at).otherwise(never).alias("bad"),
        )
    )
    kind = samples.schema["run_id"].dataType.simpleString()
    closed = rows.groupBy("run_id").applyInPandasWithState(
        _closing(timeout_s * 1_000_000),
        _CLOSED.format(kind),
        _STATE,
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return closed.select(
        "run_id",
        F.timestamp_micros("start_us").alias("start_time"),
        "outcome",
        F.timestamp_micros("decided_us").alias("decided_at"),
    )
