"""Stored tables: changed bucket by bucket, or partition by partition."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkroster import operators as op
from sparkroster.schemas import CHANGES, ENTRIES, ENTRY_KEY
from sparkroster.sources import bucket_count, change_stored, keep_versions, store, versions


def entries(spark, n=60):
    return spark.createDataFrame([("k", f"ns{i % 4}", f"a{i}", {}, {"x": str(i)}) for i in range(n)], ENTRIES)


def changes(spark, seed=1, n=120):
    rnd = random.Random(seed)
    rows = []
    for seq in range(n):
        name = None if seq == 7 else rnd.choice("aA") + str(rnd.randrange(90))
        data = rnd.choice([{"y": str(seq)}, {"x": None}, {}, None])
        rows.append(("k", f"ns{rnd.randrange(5)}", name, None if seq == 9 else seq, "patch", data))
    # A hot key.
    rows += [("k", "ns1", "a1", 1000 + i, "patch", {"y": str(i)}) for i in range(n)]
    return spark.createDataFrame(rows, CHANGES)


def rows_of(df):
    return sorted((str(sorted(r.asDict(recursive=True).items(), key=str)) for r in df.collect()))


def labels(spark, n=40):
    ddl = "namespace string, seq long, labels map<string,string>, annotations map<string,string>"
    return spark.createDataFrame([(f"ns{i}", i, {"project-id": f"p{i}"} if i % 3 else None, {"a": str(i)} if i % 2 else None) for i in range(0, n, 2)], ddl)


CHANGE = {
    "create": op.create_if_absent,
    "replace": op.replace_existing,
    "patch": op.merge_patch_existing,
    "delete": op.delete_if_present,
    "labels": op.upsert_labels,
    "write": op.write_if_changed,
}


def stored_case(spark, kind, buckets, name):
    """The table, the changes and the key of one kind of change."""
    if kind == "labels":
        ddl = "namespace string, project_id string, labels map<string,string>, annotations map<string,string>"
        rows = [(f"ns{i}", f"old{i}", {"project-id": f"old{i}"}, {}) for i in range(20)]
        return store(spark.createDataFrame(rows, ddl), name, buckets, ("namespace",)), labels(spark), ("namespace",)
    base = store(entries(spark), name, buckets)
    if kind == "write":
        incoming = entries(spark, 80).withColumn("data", F.when(F.col("name") == "a5", F.create_map(F.lit("x"), F.lit("new"))).otherwise(F.col("data")))
        return base, incoming, ENTRY_KEY
    return base, changes(spark), ENTRY_KEY


def exchanged_scans(df, name):
    """The scans of the stored table that stand below an exchange of their own rows: on the way up from the scan an
    exchange comes before any join."""
    bad, path = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        node = re.match(r"[\s:+|*()\d-]*", line).group(0)
        depth, what = len(re.sub(r"\*?\(\d+\) ", "", node).rstrip()), line[len(node) :]
        path = [p for p in path if p[0] < depth] + [(depth, what)]
        if "FileScan" in what and f"{name}__v" in what:
            above = [w for _, w in reversed(path[:-1])]
            first = next((w for w in above if "Exchange" in w.split()[0] or "Join" in w.split()[0]), "")
            if "Exchange" in first.split(" ")[0]:
                bad.append(what)
    return bad


@pytest.mark.parametrize("buckets", [3, 8])
@pytest.mark.parametrize("kind", sorted(CHANGE))
def test_stored_bases_are_not_shuffled(spark, kind, buckets):
    name = f"plan_{kind}_{buckets}"
    base, new, key = stored_case(spark, kind, buckets, name)
    more = {} if kind == "labels" else {"key": key}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        done = CHANGE[kind](base, new, **more, buckets=buckets)
        frames = [done] if kind == "write" else [done.table, done.results]
        for df in frames:
            text = df._jdf.queryExecution().executedPlan().toString()
            assert f"{name}__v1" in text and "Bucketed: true" in text
            assert exchanged_scans(df, name) == []
        plain = CHANGE[kind](base, new, **more)
        plain = [plain] if kind == "write" else [plain.table, plain.results]
        assert [rows_of(f) for f in frames] == [rows_of(f) for f in plain]
        # Without the hint the same check finds the shuffle.
        if buckets == 3 and kind == "patch":
            assert any(exchanged_scans(f, name) for f in plain)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("kind", ["create", "replace", "patch", "delete", "labels"])
def test_stored_tables_change_in_place(spark, kind):
    name = f"in_place_{kind}"
    base, new, key = stored_case(spark, kind, 3, name)
    more = {} if kind == "labels" else {"key": key}
    want = CHANGE[kind](spark.createDataFrame(base.collect(), base.schema), new, **more)
    results = change_stored(spark, name, CHANGE[kind], new, key)
    assert rows_of(spark.table(name)) == rows_of(want.table)
    assert rows_of(results) == rows_of(want.results)
    assert bucket_count(spark, name, key) == 3 and versions(spark, name) == [1, 2]
    # The version before is still there for those who read it, until it is dropped.
    assert rows_of(spark.table(f"{name}__v1")) == rows_of(base)
    assert keep_versions(spark, name, 1) == [1] and versions(spark, name) == [2]
    assert rows_of(spark.table(name)) == rows_of(want.table)


def test_stored_tables_by_another_key(spark):
    store(entries(spark), "other_key", 2, ("name",))
    with pytest.raises(ValueError, match="stored by"):
        bucket_count(spark, "other_key")
    with pytest.raises(ValueError, match="not a stored table"):
        change_stored(spark, "nowhere", op.replace_existing, changes(spark))
