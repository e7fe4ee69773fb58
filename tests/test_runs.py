import datetime as dt
import random

import pytest

from sparkroster import operators as op
from sparkroster.schemas import RUN_LOGS, RUN_SAMPLES
from sparkroster.session import work_dir
from sparkroster.streaming import (
    closed_outcomes_stream,
    run_outcomes_stream,
    tail_lines_stream,
    tails_of,
    write_outcomes,
)

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def samples(spark, rows):
    """(run, start or None, second, active, succeeded, failed)"""
    return spark.createDataFrame(
        [
            (run, None if start is None else at(start), at(s), a, ok, bad, None)
            for run, start, s, a, ok, bad in rows
        ],
        RUN_SAMPLES,
    )


def test_status(spark):
    raw = spark.sql(
        """SELECT 1 AS id, named_struct('active', 1, 'succeeded', CAST(NULL AS INT), 'failed', 2,
             'start_time', TIMESTAMP '2024-01-01 00:00:00Z',
             'completion_time', CAST(NULL AS TIMESTAMP),
             'conditions', array(named_struct('type', 'Failed', 'status', 'True',
               'last_transition_time', TIMESTAMP '2024-01-01 00:01:00Z', 'message', 'm'))) AS status
        UNION ALL SELECT 2, NULL"""
    )
    got = {r.id: r for r in op.flatten_status(raw).collect()}
    assert (got[1].active, got[1].succeeded, got[1].failed) == (1, None, 2)
    assert got[1].start_time == "2024-01-01T00:00:00+00:00" and got[1].completion_time is None
    assert [tuple(c) for c in got[1].conditions] == [
        ("Failed", "True", "2024-01-01T00:01:00+00:00", "m")
    ]
    assert got[2].active is None and got[2].conditions == []


def test_outcomes(spark):
    df = samples(
        spark,
        [
            ("ok", 0, 10, 1, None, None),
            ("ok", None, 20, None, None, None),
            ("ok", 0, 30, 0, 1, 1),
            ("ok", 0, 40, 0, 0, 1),
            ("bad", 0, 10, 0, 0, 1),
            ("bad", 0, 20, 0, 1, 0),
            ("edge", 0, 600, 0, 1, 0),
            ("late", 0, 601, 0, 1, 0),
            ("late", 0, 600, 1, 0, 0),
            ("nostart", None, 100, 1, 0, 0),
            ("nostart", None, 700, 0, 0, 1),
        ],
    )
    want = {
        "ok": ("succeeded", 3, at(30)),
        "bad": ("failed", 1, at(10)),
        "edge": ("succeeded", 1, at(600)),
        "late": ("timeout", 1, None),
        "nostart": ("failed", 2, at(700)),
    }
    for shares in (1, 2, 64):
        got = {r.run_id: tuple(r)[1:] for r in op.run_outcomes(df, shares=shares).collect()}
        assert got == want


def model(rows, timeout):
    runs = {}
    for row in rows:
        runs.setdefault(row[0], []).append(row)
    out = {}
    for run, seen in runs.items():
        seen.sort(key=lambda r: r[2])
        start = min((r[1] for r in seen if r[1] is not None), default=seen[0][2])
        inside = [r for r in seen if r[2] <= start + timeout]
        for i, (_, _, s, _, ok, bad) in enumerate(inside, 1):
            if ok or bad:
                out[run] = ("succeeded" if ok else "failed", i, at(s))
                break
        else:
            out[run] = ("timeout", len(inside), None)
    return out


def random_rows(seed, n=900):
    rnd = random.Random(seed)
    seconds = rnd.sample(range(100_000), n)
    rows = []
    for s in seconds:
        # One run holds a third of the samples.
        run = "r0" if rnd.random() < 0.33 else f"r{rnd.randrange(60)}"
        p = rnd.random()
        rows.append((run, None, s, 1, int(p < 0.1), int(0.1 < p < 0.2)))
    return rows


@pytest.mark.parametrize("shares", [2, 16])
def test_outcomes_equal_the_step_by_step_rule(spark, shares):
    rows = random_rows(shares)
    got = op.run_outcomes(samples(spark, rows), 20_000, shares)
    assert {r.run_id: tuple(r)[1:] for r in got.collect()} == model(rows, 20_000)


def arrivals(seed):
    """Runs with their samples in an order that is late by less than the allowed delay."""
    rnd = random.Random(seed)
    rows = []
    for i in range(200):
        run, start = f"r{i}", rnd.randrange(1_000, 50_000)
        for _ in range(rnd.randrange(1, 8)):
            p = rnd.random()
            second = start + rnd.randrange(0, 1_000)
            rows.append((run, start, second, 1, int(p < 0.15), int(0.15 < p < 0.3)))
    rows.sort(key=lambda r: r[2] + rnd.randrange(0, 250))
    return rows + [("last", 60_000, 60_000, 1, 0, 0)]


def write_parts(df_of, rows, path, size):
    for i in range(0, len(rows), size):
        df_of(rows[i : i + size]).coalesce(1).write.mode("append").parquet(path)


def closed_runs(spark, out, path):
    write_outcomes(out, f"{path}/out", f"{path}/check", available_now=True).awaitTermination()
    table = spark.read.schema(out.schema).parquet(f"{path}/out").collect()
    got = {r.run_id: (r.outcome, r.decided_at) for r in table}
    assert len(got) == len(table)
    return got


def batch_runs(spark, rows):
    out = op.run_outcomes(samples(spark, rows), 600).collect()
    return {r.run_id: (r.outcome, r.decided_at) for r in out if r.run_id != "last"}


def test_stream_equals_batch_for_closed_runs(spark):
    """Files out of order: the result does not depend on the order of arrival."""
    rows, path = arrivals(3), work_dir(spark, "stream")
    write_parts(lambda part: samples(spark, part), rows, f"{path}/in", 90)
    stream = (
        spark.readStream.schema(RUN_SAMPLES).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    )
    got = closed_runs(spark, run_outcomes_stream(stream, timeout_s=600, delay_s=2_000), path)
    assert got == batch_runs(spark, rows)
    assert {o for o, _ in got.values()} == {"succeeded", "failed", "timeout"}


def test_stream_with_starts_equals_batch(spark):
    """Samples without a start, joined to the starts; some runs are never sampled."""
    rows, path = arrivals(4), work_dir(spark, "starts")
    ddl = "run_id string, start_time timestamp"
    begun = sorted({(r[0], at(r[1])) for r in rows} | {("silent", at(5_000))}, key=lambda r: r[1])
    write_parts(lambda part: spark.createDataFrame(part, ddl), begun, f"{path}/starts", 60)
    bare = [(run, None, *rest) for run, _, *rest in rows]
    # A last sample, so that the clock of the samples passes the last deadline too.
    bare.append(("last", None, 60_000, 0, 0, 1))
    write_parts(lambda part: samples(spark, part), bare, f"{path}/in", 200)
    read = spark.readStream.option("maxFilesPerTrigger", 1)
    starts = read.schema(ddl).parquet(f"{path}/starts")
    stream = spark.readStream.option("maxFilesPerTrigger", 1).schema(RUN_SAMPLES).parquet(f"{path}/in")
    got = closed_runs(spark, run_outcomes_stream(stream, starts, 600, 2_000), path)
    assert got.pop("silent") == ("timeout", None)
    assert got == batch_runs(spark, rows)


def silent_runs(seed):
    """Unstarted runs that fall silent for far longer than their timeout and come back, some several times."""
    rnd = random.Random(seed)
    rows = []
    for i in range(80):
        second = rnd.randrange(1_000, 30_000)
        for _ in range(rnd.randrange(1, 4)):
            for _ in range(rnd.randrange(1, 6)):
                p = rnd.random()
                rows.append((f"r{i}", None, second, 1, int(p < 0.15), int(0.15 < p < 0.3)))
                second += rnd.randrange(0, 700)
            second += rnd.randrange(3_000, 9_000)
    # A started run too: the start of a sample that is not the first one counts.
    rows += [("begun", s, t, 0, int(t == 21_700), 0) for s, t in ((21_150, 21_200), (21_100, 21_300), (21_150, 21_700))]
    rows.sort(key=lambda r: r[2] + rnd.randrange(0, 250))
    return rows + [("last", None, 90_000, 1, 0, 0)]


@pytest.mark.parametrize("size", [40, 1_000])
def test_stream_by_run_equals_batch_through_long_silences(spark, size):
    rows, path = silent_runs(size), work_dir(spark, "silences")
    write_parts(lambda part: samples(spark, part), rows, f"{path}/in", size)
    stream = (
        spark.readStream.schema(RUN_SAMPLES).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    )
    got = closed_runs(spark, closed_outcomes_stream(stream, timeout_s=600, delay_s=2_000), path)
    assert got == batch_runs(spark, rows)
    assert {o for o, _ in got.values()} == {"succeeded", "failed", "timeout"}
    assert got["begun"] == ("succeeded", at(21_700))


def test_closed_runs_stay_closed_after_a_restart(spark):
    """The stream is stopped and started again from its checkpoint between two files."""
    path = work_dir(spark, "restart")
    first = [("a", None, 1_000, 1, 0, 0), ("b", None, 4_900, 1, 0, 0), ("clock", None, 9_000, 1, 0, 0)]
    later = [("a", None, 9_500, 0, 1, 0), ("b", None, 9_600, 0, 0, 1), ("c", None, 9_700, 0, 1, 0), ("clock", None, 30_000, 0, 0, 0)]

    def run():
        stream = spark.readStream.schema(RUN_SAMPLES).parquet(f"{path}/in")
        out = closed_outcomes_stream(stream, timeout_s=600, delay_s=10)
        write_outcomes(out, f"{path}/out", f"{path}/check", available_now=True).awaitTermination()
        return sorted((r.run_id, r.outcome) for r in spark.read.schema(out.schema).parquet(f"{path}/out").collect())

    write_parts(lambda part: samples(spark, part), first, f"{path}/in", 9)
    assert run() == [("a", "timeout"), ("b", "timeout")]
    write_parts(lambda part: samples(spark, part), later, f"{path}/in", 9)
    assert run() == [("a", "timeout"), ("b", "timeout"), ("c", "succeeded"), ("clock", "timeout")]


def test_tail(spark):
    rows = []
    for run, pod, container, n in (
        ("ok", "p1", 0, 30),
        ("ok", "p2", 0, 150),
        ("ok", "p2", 1, 10),
        ("bad", "p1", 0, 80),
        ("open", "p1", 0, 120),
        ("silent", "p1", 0, 5),
        ("silent", "p2", 1, 5),
    ):
        base = 1000 if pod == "p2" else 0
        for i in range(n):
            rows.append((run, pod, f"c{container}", container, at(base + i // 7), i, f"{pod} {i}"))
    logs = spark.createDataFrame(rows, RUN_LOGS)
    outcomes = spark.createDataFrame(
        [("ok", "succeeded"), ("bad", "failed"), ("open", "timeout"), ("silent", "failed")],
        "run_id string, outcome string",
    )
    got = {}
    for r in op.tail_lines(logs, outcomes, sort=True).collect():
        got.setdefault(r.run_id, []).append(r.line)
    assert got == {
        "ok": [f"p2 {i}" for i in range(50, 150)],
        "bad": [f"p1 {i}" for i in range(30, 80)],
        "open": [f"p1 {i}" for i in range(20, 120)],
    }


def test_streamed_tails_equal_the_batch(spark):
    """Lines of several pods and containers, late by less than the delay, in many files."""
    rnd, rows = random.Random(6), []
    for i in range(30):
        second = rnd.randrange(1_000, 20_000)
        for n in range(rnd.randrange(1, 60)):
            pod, container = f"p{rnd.randrange(3)}", rnd.choice([0, 0, 0, 1])
            rows.append((f"r{i}", pod, f"c{container}", container, at(second), n, f"{pod} {n}"))
            second += rnd.randrange(0, 40)
    # A run that holds most lines, one whose latest pod has no line in its first container, one without a pod.
    rows += [("hot", "p1", "c0", 0, at(2_000 + i), i, f"hot {i}") for i in range(900)]
    rows += [("odd", "p1", "c0", 0, at(2_000), 1, "x"), ("odd", "p2", "c1", 1, at(2_001), 2, "y"), ("none", None, "c0", 0, at(2_000), 1, "z")]
    rows.sort(key=lambda r: (r[4] - T0).total_seconds() + rnd.randrange(0, 250))
    outcomes = spark.createDataFrame([(f"r{i}", rnd.choice(["failed", "succeeded"])) for i in range(30)] + [("hot", "timeout")], "run_id string, outcome string")
    path = work_dir(spark, "tails")
    clock = [("clock", "p", "c0", 0, at(90_000), 0, "")]
    write_parts(lambda part: spark.createDataFrame(part, RUN_LOGS), rows + clock, f"{path}/in", 250)
    stream = spark.readStream.schema(RUN_LOGS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    tails = tail_lines_stream(stream, quiet_s=3_000, delay_s=300, n=30)
    write_outcomes(tails, f"{path}/out", f"{path}/check", available_now=True).awaitTermination()
    closed = spark.read.schema(tails.schema).parquet(f"{path}/out")
    columns = ["run_id", "pod", "ts", "line_no", "line"]
    got = tails_of(closed, outcomes, 30, 12).select(columns)
    logs = spark.createDataFrame([r for r in rows if r[1] is not None], RUN_LOGS)
    want = op.tail_lines(logs, outcomes, 30, 12).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_exit_codes(spark):
    df = spark.createDataFrame([(c,) for c in (1, 126, 127, 137, 0, 2, None)], "exit_code int")
    got = {r.exit_code: (r.exit_action, r.exit_reason) for r in op.classify_exit(df).collect()}
    assert {c for c, (a, _) in got.items() if a == "fail_job"} == {1, 126, 127, 137}
    assert all(got[c] == ("other", None) for c in (0, 2, None))
    assert len({got[c][1] for c in (1, 126, 127, 137)}) == 4


def test_error_bodies(spark):
    two = (
        '{"message": "m", "details": {"causes": ['
        '{"field": "f", "reason": "r", "message": "c"}, {"field": "g"}]}}'
    )
    df = spark.createDataFrame(
        [(1, two), (2, "not json " + "x" * 600), (3, "{}"), (4, None), (5, ""), (6, '{"details": {}}')],
        "id int, body string",
    )
    got = sorted(tuple(r) for r in op.error_details(df).drop("body").collect() if r.id == 1)
    assert got == [(1, "m", "f", "r", "c", None), (1, "m", "g", "N/A", "N/A", None)]
    rest = {r.id: tuple(r)[1:] for r in op.error_details(df).drop("body").collect() if r.id > 1}
    blank = (None, None, None)
    assert rest[2] == (None, *blank, ("not json " + "x" * 600)[:500] + "...")
    assert rest[3] == ("N/A", *blank, None) and rest[6] == ("N/A", *blank, None)
    assert rest[4] == rest[5] == (None, *blank, "no additional content")
