"""Partition-wise changes and change logs as streams."""

import random
import threading

import pytest

from sparkroster import operators as op
from sparkroster.schemas import CHANGES, ENTRIES, ENTRY_KEY
from sparkroster.session import work_dir
from sparkroster.sources import change_partitions, create_partitioned
from sparkroster.sources import partitions as parts
from sparkroster.streaming import apply_change_stream, stream_results


def base_table(spark, n=60):
    rows = [("k", f"ns/{i % 4}" if i % 4 else "1", f"a{i}", {}, {"x": str(i)}) for i in range(n)]
    return spark.createDataFrame(rows, ENTRIES)


def read(spark, path):
    return spark.read.schema(ENTRIES).parquet(path)


def shown(df):
    rows = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(str(sorted((k, sorted(v.items(), key=str) if isinstance(v, dict) else v) for k, v in r.items())) for r in rows)


def files(spark, path, namespace):
    rows = read(spark, path).where(f"namespace = '{namespace}'").select("_metadata.file_path")
    return sorted(r[0] for r in rows.distinct().collect())


def log_rows(seed, n=300):
    """An ordered log over namespaces that exist, that are new, that are named in vain, and that end empty."""
    rnd = random.Random(seed)
    rows = []
    for seq in range(n):
        ns = rnd.choice(["ns/1", "ns/2", "new", None] if seq % 29 == 0 else ["ns/1", "ns/2", "new"])
        kind = rnd.choice(["create", "replace", "patch", "upsert", "delete"])
        data = rnd.choice([{"y": str(seq)}, {"x": None, "z": str(seq)}, {}, None])
        rows.append(("k", ns, rnd.choice("aA") + str(rnd.randrange(70)), None if seq % 41 == 0 else seq, kind, data))
    return rows


def test_only_touched_partitions_are_written(spark):
    base, path = base_table(spark), work_dir(spark, "touched") + "/t"
    create_partitioned(base, path)
    before = {ns: files(spark, path, ns) for ns in ("1", "ns/1", "ns/2", "ns/3")}
    rows = [("k", "ns/1", "a1", 1, "patch", {"x": "new"}), ("k", "fresh", "b", 2, "create", {"q": "1"})]
    # Named, but nothing applies there.
    rows += [("k", "ns/3", "absent", 3, "replace", {"x": "1"}), ("k", "ns/3", "absent", 4, "delete", None)]
    # Emptied to the last row.
    rows += [("k", "ns/2", f"a{i}", 10 + i, "delete", None) for i in range(60) if i % 4 == 2]
    changes = spark.createDataFrame(rows, CHANGES)
    want = op.apply_changes(base, changes)
    want_table, want_results = shown(want.table), shown(want.results)
    results = change_partitions(read(spark, path), path, "job", op.apply_changes, changes)
    assert shown(read(spark, path)) == want_table and shown(results) == want_results
    assert files(spark, path, "1") == before["1"] and files(spark, path, "ns/3") == before["ns/3"]
    assert files(spark, path, "ns/1") != before["ns/1"] and files(spark, path, "ns/2") == []
    # The same job again: the same table and results, though the changes would be judged otherwise now.
    results = change_partitions(read(spark, path), path, "job", op.apply_changes, changes)
    assert shown(read(spark, path)) == want_table and shown(results) == want_results


@pytest.mark.parametrize("broken", ["changes", "results", "table", "emptied", "swap"])
def test_a_job_that_breaks_off_is_repeated(spark, monkeypatch, broken):
    base, path = base_table(spark), work_dir(spark, "broken") + "/t"
    create_partitioned(base, path)
    changes = spark.createDataFrame(log_rows(5) + [("k", "ns/2", f"a{i}", 1000 + i, "delete", None) for i in range(70)], CHANGES)
    want = op.apply_changes(base, changes)
    want_table, want_results = shown(want.table), shown(want.results)
    if broken == "swap":
        monkeypatch.setattr(parts, "_remove", lambda folders: 1 / 0)
        error = ZeroDivisionError
    else:
        real = type(base.write).parquet

        def parquet(writer, to, *more, **named):
            if to.endswith(f"/job/{broken}"):
                raise RuntimeError(broken)
            return real(writer, to, *more, **named)

        monkeypatch.setattr(type(base.write), "parquet", parquet)
        error = RuntimeError
    with pytest.raises(error):
        change_partitions(read(spark, path), path, "job", op.apply_changes, changes)
    monkeypatch.undo()
    results = change_partitions(read(spark, path), path, "job", op.apply_changes, changes)
    assert shown(read(spark, path)) == want_table and shown(results) == want_results


@pytest.mark.parametrize("change", [op.create_if_absent, op.merge_patch_existing, op.replace_existing])
def test_keyed_changes_by_partition(spark, monkeypatch, change):
    """Also with more namespaces than are named to the scan."""
    monkeypatch.setattr(parts, "NAMED", 1)
    base, path = base_table(spark), work_dir(spark, "keyed") + "/t"
    create_partitioned(base, path)
    changes = spark.createDataFrame(log_rows(8), CHANGES)
    want = change(base, changes)
    want_table, want_results = shown(want.table), shown(want.results)
    results = change_partitions(read(spark, path), path, "one", change, changes)
    assert shown(read(spark, path)) == want_table and shown(results) == want_results


def totals(df):
    rows = df.select(*ENTRY_KEY, "applied", "rejected", "noop", "invalid").collect()
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("cuts", [(300,), (50, 51, 200, 300)])
def test_any_cut_of_a_log_gives_the_table_of_the_whole(spark, cuts):
    base, path = base_table(spark), work_dir(spark, "cuts")
    create_partitioned(base, f"{path}/t")
    rows = log_rows(11)
    want = op.apply_changes(base, spark.createDataFrame(rows, CHANGES))
    want_table, want_counts = shown(want.table), totals(want.results)
    low, log = 0, f"{path}/log"
    for high in cuts:
        spark.createDataFrame(rows[low:high], CHANGES).coalesce(1).write.mode("append").parquet(log)
        low = high
        # A restart after every file, from the checkpoint.
        stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(log)
        apply_change_stream(stream, f"{path}/t", ENTRIES, f"{path}/check", available_now=True).awaitTermination()
    assert shown(read(spark, f"{path}/t")) == want_table
    assert totals(stream_results(spark, f"{path}/t")) == want_counts


def test_a_batch_that_broke_off_is_judged_once(spark, monkeypatch):
    base, path = base_table(spark), work_dir(spark, "again")
    create_partitioned(base, f"{path}/t")
    rows = [("k", "ns/1", "a1", 1, "delete", None), ("k", "ns/1", "a1", 2, "create", {"y": "1"}), ("k", "new", "n", 3, "create", {})]
    want = op.apply_changes(base, spark.createDataFrame(rows, CHANGES))
    want_table, want_counts = shown(want.table), totals(want.results)
    spark.createDataFrame(rows, CHANGES).coalesce(1).write.parquet(f"{path}/log")

    def run():
        stream = spark.readStream.schema(CHANGES).parquet(f"{path}/log")
        apply_change_stream(stream, f"{path}/t", ENTRIES, f"{path}/check", available_now=True).awaitTermination()

    real, lock = parts._remove, threading.Lock()

    def once(folders):
        with lock:
            monkeypatch.setattr(parts, "_remove", real)
        raise RuntimeError("lost")

    monkeypatch.setattr(parts, "_remove", once)
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert shown(read(spark, f"{path}/t")) == want_table
    assert totals(stream_results(spark, f"{path}/t")) == want_counts
