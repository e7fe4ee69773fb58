"""Log tails of runs over a stream of lines."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkroster.constants import TAIL_LINES, TAIL_LINES_FAILED

if TYPE_CHECKING:
    import pandas as pd

_TAIL = "pod string, ts_us long, line_no long, line string, newest long"
#: A pod as (lines of its first container as (time, number, line), time of its last line).
_Pods = dict[str, tuple[list[tuple[int, int, str]], int]]


def _with_lines(pods: _Pods, rows: pd.DataFrame, n: int) -> _Pods:
    """The pods with more lines; of each the last ``n`` of the first container are kept."""
    for pod, part in rows.groupby("pod", sort=False):
        lines, last = pods.get(pod, ([], 0))
        first = part[part["first"]].sort_values(["us", "line_no"]).tail(n)
        lines = sorted([*lines, *zip(first["us"], first["line_no"], first["line"], strict=True)])
        pods[pod] = (lines[-n:], max(last, int(part["us"].max())))
    return pods


def _tailing(quiet_us: int, n: int):
    """The step of one run: the last lines of its pods as the state, a timer after its last line."""

    def step(
        key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        import pandas as pd

        pods = pickle.loads(state.get[0]) if state.exists else {}
        if pods is None:
            return
        if not state.hasTimedOut:
            for rows in pieces:
                pods = _with_lines(pods, rows, n)
            latest = max(last for _, last in pods.values())
            closes_ms = -(-(latest + quiet_us) // 1000)
            state.update((pickle.dumps(pods),))
            state.setTimeoutTimestamp(max(closes_ms, state.getCurrentWatermarkMs() + 1))
            return
        state.update((pickle.dumps(None),))
        pod = max(pods, key=lambda p: (pods[p][1], p))
        lines = pods[pod][0]
        yield pd.DataFrame(
            {
                "run_id": [key[0]] * len(lines),
                "pod": [pod] * len(lines),
                "ts_us": [us for us, _, _ in lines],
                "line_no": [no for _, no, _ in lines],
                "line": [line for _, _, line in lines],
                "newest": list(range(len(lines), 0, -1)),
            }
        )

    return step


def tail_lines_stream(
    logs: DataFrame, quiet_s: int, delay_s: int = 60, n: int = max(TAIL_LINES, TAIL_LINES_FAILED)
) -> DataFrame:
    """(run_id, pod, ts, line_no, line, newest): the last ``n`` lines of every closed run's latest pod.

    ``logs`` are lines as for :func:`~sparkroster.operators.tail_lines`. A run is closed when
    it has been quiet for ``quiet_s`` and the allowed delay in event time; lines that come
    later are not seen. ``newest`` numbers the lines from the last one back, so
    :func:`tails_of` cuts them to what an outcome shows.

    The state is a bounded buffer: ``n`` lines of the first container of each pod of a run
    that is open, one short mark for a run that is closed. Lines reach it in pieces and all
    but the last ``n`` of a pod are dropped as they come. Lines without a pod or a time are
    left out.
    """
    rows = (
        logs.where(F.col("ts").isNotNull() & F.col("pod").isNotNull())
        .withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", f"{delay_s} seconds")
        .select(
            "run_id",
            "ts",
            "pod",
            F.unix_micros("ts").alias("us"),
            F.coalesce(F.col("container_index") == 0, F.lit(False)).alias("first"),
            F.coalesce(F.col("line_no").cast("long"), F.lit(0)).alias("line_no"),
            F.coalesce("line", F.lit("")).alias("line"),
        )
    )
    kind = logs.schema["run_id"].dataType.simpleString()
    tails = rows.groupBy("run_id").applyInPandasWithState(
        _tailing(quiet_s * 1_000_000, n),
        f"run_id {kind}, {_TAIL}",
        "pods binary",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    ts = F.timestamp_micros("ts_us").alias("ts")
    return tails.select("run_id", "pod", ts, "line_no", "line", "newest")


def tails_of(
    tails: DataFrame,
    outcomes: DataFrame,
    n_ok: int = TAIL_LINES,
    n_failed: int = TAIL_LINES_FAILED,
) -> DataFrame:
    """The tails of closed runs cut to the lines that their outcome shows."""
    limit = F.when(F.col("outcome") == "failed", n_failed).otherwise(n_ok)
    known = outcomes.select("run_id", "outcome")
    return tails.join(known, "run_id", "left").where(F.col("newest") <= limit).select(*tails.columns)
