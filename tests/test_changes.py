import random

import pytest
from pyspark.sql import functions as F

from sparkroster import operators as op
from tests.helpers import as_dict, changes, entries, inventory, ns, statuses


def test_create(spark):
    base = entries(spark, {"a": {"x": "1"}})
    done = op.create_if_absent(
        base,
        changes(
            spark,
            ("a", 1, "create", {"x": "2"}),
            ("b", 5, "create", {"y": "5", "z": None}),
            ("b", 4, "create", {"y": "4", "z": None}),
        ),
    )
    assert as_dict(done.table) == {"a": {"x": "1"}, "b": {"y": "4"}}
    assert statuses(done.results) == {
        ("a", 1): "conflict",
        ("b", 4): "created",
        ("b", 5): "conflict",
    }


def test_requested_names_count_in_lower_case(spark):
    base = entries(spark, {"a": {"x": "1"}})
    log = changes(spark, ("A", 1, "patch", {"y": "2"}), ("New", 2, "create", {"z": "3"}))
    assert as_dict(op.create_if_absent(base, log).table) == {"a": {"x": "1"}, "new": {"z": "3"}}
    assert as_dict(op.merge_patch_existing(base, log).table) == {"a": {"x": "1", "y": "2"}}
    assert as_dict(op.replace_existing(base, log).table) == {"a": {"y": "2"}}
    assert as_dict(op.delete_if_present(base, log).table) == {}
    done = op.apply_changes(base, log)
    assert as_dict(done.table) == {"a": {"x": "1", "y": "2"}, "new": {"z": "3"}}
    assert {r.name for r in done.results.collect()} == {"a", "new"}


def test_maps_of_values_that_are_never_null(spark):
    """Map literals have another type than maps that were read from a file."""
    base = spark.range(1).select(
        F.lit("secret").alias("kind"),
        F.lit("default").alias("namespace"),
        F.lit("a").alias("name"),
        F.lit(None).cast("map<string,string>").alias("labels"),
        F.create_map(F.lit("x"), F.lit("1")).alias("data"),
    )
    log = changes(spark, ("a", 1, "patch", {"y": "2"}), ("b", 2, "create", {"z": None}))
    for act in (op.create_if_absent, op.replace_existing, op.merge_patch_existing, op.apply_changes):
        act(base, log).table.collect()
        act(base, log).results.collect()
    strict = log.withColumn("data", F.create_map(F.lit("q"), F.lit("1")))
    assert as_dict(op.create_if_absent(base, strict).table) == {"a": {"x": "1"}, "b": {"q": "1"}}
    assert as_dict(op.apply_changes(base, strict).table) == {
        "a": {"x": "1", "q": "1"},
        "b": {"q": "1"},
    }


def test_replace(spark):
    base = entries(spark, {"a": {"x": "1"}, "c": {"k": "v"}})
    done = op.replace_existing(
        base,
        changes(
            spark,
            ("a", 1, "replace", {"y": "2"}),
            ("a", 2, "replace", {"y": "3"}),
            ("b", 3, "replace", {"y": "4"}),
        ),
    )
    assert as_dict(done.table) == {"a": {"y": "2"}, "c": {"k": "v"}}
    assert statuses(done.results) == {
        ("a", 1): "replaced",
        ("a", 2): "skipped",
        ("b", 3): "missing",
    }


def test_patch(spark):
    base = entries(spark, {"a": {"a": "1", "b": "2"}, "n": None, "u": {"u": "0"}})
    done = op.merge_patch_existing(
        base,
        changes(
            spark,
            ("a", 1, "patch", {"b": "9", "c": None}),
            ("n", 2, "patch", {"q": "1"}),
            ("u", 3, "patch", {}),
            ("zz", 4, "patch", {"x": "1"}),
            ("zz", 5, "patch", None),
        ),
    )
    assert as_dict(done.table) == {"a": {"a": "1", "b": "9"}, "n": {"q": "1"}, "u": {"u": "0"}}
    assert statuses(done.results) == {
        ("a", 1): "patched",
        ("n", 2): "patched",
        ("u", 3): "noop",
        ("zz", 4): "missing",
        ("zz", 5): "noop",
    }


def test_delete(spark):
    base = entries(spark, {"a": {}, "b": {}})
    keys = changes(spark, ("a", 1, "delete", None), ("a", 2, "delete", None), ("x", 3, "delete", None))
    done = op.delete_if_present(base, keys)
    assert set(as_dict(done.table)) == {"b"}
    assert statuses(done.results, "name") == {"a": "deleted", "x": "absent"}


def test_upsert_labels(spark):
    inv = inventory(spark, ns("p", "n", "dev", annotations={"repo-url": "u"}), ns("p", "n", "qa"))
    asked = spark.createDataFrame(
        [
            ("p-dev", 1, {"environment": "prod", "project-name": None}, None),
            ("p-qa", 2, None, None),
            ("p-new", 3, {"project-id": "p"}, {"repo-url": "v"}),
            ("p-empty", 4, None, None),
        ],
        "namespace string, seq long, labels map<string,string>, annotations map<string,string>",
    )
    done = op.upsert_labels(inv, asked)
    got = {r.namespace: r for r in done.table.collect()}
    assert got["p-dev"].environment == "prod" and got["p-dev"].project_name is None
    assert got["p-dev"].annotations == {"repo-url": "u"}
    assert got["p-qa"].environment == "qa"
    assert got["p-new"].project_id == "p" and got["p-new"].annotations == {"repo-url": "v"}
    assert got["p-empty"].labels == {}
    assert statuses(done.results, "namespace") == {
        "p-dev": "patched",
        "p-qa": "noop",
        "p-new": "created",
        "p-empty": "created",
    }


def test_labels_of_existing_namespaces_only(spark):
    inv = inventory(spark, ns("p", "n", "dev"))
    asked = spark.createDataFrame(
        [("p-dev", 1, {"project-name": "m"}, None), ("p-new", 2, {"project-name": "m"}, None)],
        "namespace string, seq long, labels map<string,string>, annotations map<string,string>",
    )
    done = op.upsert_labels(inv, asked, insert=False)
    assert {r.namespace: r.project_name for r in done.table.collect()} == {"p-dev": "m"}
    assert statuses(done.results, "namespace") == {"p-dev": "patched", "p-new": "missing"}


def test_write_if_changed_twice_is_unchanged(spark):
    base = spark.createDataFrame(
        [(1, "a", {"x": "1", "y": "2"}), (2, None, None), (3, "c", {})],
        "k long, v string, m map<string,string>",
    )
    new = spark.createDataFrame(
        [(1, "a", {"y": "2", "x": "1"}), (2, None, {"q": "1"}), (4, "d", None)], base.schema
    )
    first = op.write_if_changed(base, new, ["k"])
    assert {r.k: r.action for r in first.collect()} == {
        1: "unchanged",
        2: "updated",
        3: "kept",
        4: "created",
    }
    again = op.write_if_changed(first.drop("action"), new, ["k"])
    assert {r.action for r in again.collect()} == {"unchanged", "kept"}


def test_ordered_changes_of_one_new_key(spark):
    log = changes(
        spark,
        ("k", 1, "create", {"a": "1"}),
        ("k", 2, "create", {"a": "2"}),
        ("k", 3, "patch", {"b": "9"}),
        ("k", 4, "delete", None),
        ("k", 5, "create", {"z": "1"}),
        ("gone", 6, "replace", {"x": "1"}),
        ("gone", 7, "patch", {"x": "1"}),
        ("gone", 8, "delete", None),
    )
    base = entries(spark, {"still": {"s": "1"}})
    for shares in (1, 2, 100):
        done = op.apply_changes(base, log, shares=shares)
        assert as_dict(done.table) == {"still": {"s": "1"}, "k": {"z": "1"}}
        assert {tuple(r)[2:] for r in done.results.collect()} == {
            ("k", 4, 1, 0, 0, True),
            ("gone", 0, 2, 1, 0, False),
        }


def fold(base, log):
    """The log one change at a time."""
    state = {k: dict(v) for k, v in base.items()}
    counts = {}
    for name, _, kind, data in sorted(log, key=lambda c: c[1]):
        there, n = name in state, counts.setdefault(name, [0, 0, 0])
        data = data or {}
        full = {k: v for k, v in data.items() if v is not None}
        if kind == "create" and not there:
            state[name] = full
            n[0] += 1
        elif kind == "replace" and there:
            state[name] = full
            n[0] += 1
        elif kind == "delete":
            n[0 if state.pop(name, None) is not None else 2] += 1
        elif kind == "patch" and not data:
            n[2] += 1
        elif kind == "upsert" and there and not data:
            n[2] += 1
        elif kind == "upsert" or (kind == "patch" and there):
            merged = {**state.get(name, {}), **data}
            state[name] = {k: v for k, v in merged.items() if v is not None}
            n[0] += 1
        else:
            n[1] += 1
    return state, {k: (*v, k in state) for k, v in counts.items()}


@pytest.mark.parametrize("shares", [1, 7, 1000])
def test_change_log_equals_one_change_at_a_time(spark, shares):
    rnd = random.Random(shares)
    base = {f"k{i}": {"a": "0", "b": str(i)} for i in range(0, 120, 2)}
    log = []
    for seq in range(1500):
        # One key holds a third of the log.
        name = "k0" if rnd.random() < 0.33 else f"k{rnd.randrange(120)}"
        kind = rnd.choice(["create", "replace", "patch", "upsert", "delete"])
        data = {
            f: rnd.choice([None, str(seq)]) for f in rnd.sample("abcd", rnd.randrange(4))
        }
        log.append((name, seq, kind, data or rnd.choice([None, {}])))
    done = op.apply_changes(entries(spark, base), changes(spark, *log), shares=shares)
    state, counts = fold(base, log)
    assert as_dict(done.table) == state
    got = {
        r.name: (r.applied, r.rejected, r.noop, r.present) for r in done.results.collect()
    }
    assert got == counts


def test_change_log_equals_the_single_operators_in_turn(spark):
    base = entries(spark, {"a": {"x": "1"}, "b": {"y": "1"}})
    steps = [
        ("a", 1, "create", {"x": "2"}),
        ("c", 2, "create", {"z": "3"}),
        ("a", 3, "patch", {"x": None, "w": "4"}),
        ("b", 4, "replace", {"q": "5"}),
        ("c", 5, "delete", None),
    ]
    run = {
        "create": op.create_if_absent,
        "replace": op.replace_existing,
        "patch": op.merge_patch_existing,
        "delete": op.delete_if_present,
    }
    table = base
    for step in steps:
        table = run[step[2]](table, changes(spark, step)).table
    assert as_dict(op.apply_changes(base, changes(spark, *steps)).table) == as_dict(table)


def test_labels_survive_unless_deleted(spark):
    base = entries(spark, {"a": {"x": "1"}, "b": {"x": "1"}}).withColumn(
        "labels", F.create_map(F.lit("role"), F.lit("script"))
    )
    log = changes(
        spark,
        ("a", 1, "patch", {"x": "2"}),
        ("b", 2, "delete", None),
        ("b", 3, "create", {"x": "3"}),
    )
    got = {r.name: (r.labels, r.data) for r in op.apply_changes(base, log).table.collect()}
    assert got == {"a": ({"role": "script"}, {"x": "2"}), "b": (None, {"x": "3"})}


def test_changes_without_seq_or_key_are_invalid(spark):
    base = entries(spark, {"a": {"x": "1"}})
    log = changes(
        spark,
        ("a", None, "patch", {"x": "2"}),
        (None, 1, "patch", {"x": "3"}),
        ("b", None, "create", {"x": "4"}),
        ("c", 2, "create", {"x": "5"}),
    )
    for change in (op.create_if_absent, op.replace_existing, op.merge_patch_existing):
        done = change(base, log)
        assert statuses(done.results) | {("c", 2): "?"} == {
            ("a", None): "invalid", (None, 1): "invalid", ("b", None): "invalid", ("c", 2): "?"
        }
        assert done.results.count() == 4 and as_dict(done.table)["a"] == {"x": "1"}
    done = op.apply_changes(base, log)
    assert as_dict(done.table) == {"a": {"x": "1"}, "c": {"x": "5"}}
    assert {r.name: (r.applied, r.invalid, r.present) for r in done.results.collect()} == {
        "a": (0, 1, True), None: (0, 1, False), "b": (0, 1, False), "c": (1, 0, True)
    }
    gone = op.delete_if_present(base, log.drop("data", "op", "seq"))
    assert statuses(gone.results, "name") == {
        "a": "deleted", None: "invalid", "b": "absent", "c": "absent"
    }


def test_upsert_leaves_untouched_rows(spark):
    bare = inventory(spark, ns("p1", "n1", "dev"), ns("p2", "n2", "dev")).withColumns(
        {"labels": F.lit(None).cast("map<string,string>"), "annotations": F.lit(None).cast("map<string,string>")}
    )
    asked = spark.createDataFrame(
        [("p2-dev", 1, None, {"u": "1"}), (None, 2, {"x": "1"}, None), ("new", None, None, None)],
        "namespace string, seq long, labels map<string,string>, annotations map<string,string>",
    )
    done = op.upsert_labels(bare, asked)
    rows = {r.namespace: r for r in done.table.collect()}
    before = {r.namespace: r for r in bare.collect()}
    assert rows["p1-dev"] == before["p1-dev"]
    assert rows["p2-dev"].labels is None and rows["p2-dev"].project_id == "p2"
    assert rows["p2-dev"].annotations == {"u": "1"}
    assert statuses(done.results, "namespace") == {"p2-dev": "patched", None: "invalid", "new": "invalid"}


def test_pieces_of_a_sparse_hot_log_are_even(spark):
    from sparkroster.operators.changelog import _in_pieces

    log = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        (F.col("id") * 1_000_003 + F.pmod(F.hash("id"), F.lit(1000))).alias("seq"),
    )
    sizes = [r["count"] for r in _in_pieces(log, ["k"], 50).groupBy("k", "_piece").count().collect()]
    assert max(sizes) <= 3 * 30_000 / 50
