import datetime as dt

from sparkroster import operators as op
from sparkroster.schemas import flatten_labels
from tests.helpers import entries, inventory, ns


def requests(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_selectors(spark):
    inv = inventory(
        spark,
        ns("p", "n", "dev", depends_on=""),
        ns("p", "n", "qa", depends_on="dev"),
        ns("q", "m", "dev"),
    )

    def chosen(selector, **kw):
        return sorted(r.namespace for r in op.label_select(inv, selector, **kw).collect())

    for kw in ({}, {"columns": {}}):
        assert chosen("environment=dev", **kw) == ["p-dev", "q-dev"]
        assert chosen("depends-on", **kw) == ["p-dev", "p-qa"]
        assert chosen(None, **kw) == ["p-dev", "p-qa", "q-dev"]
    assert op.scope_filter(inv, "p-qa").count() == 1
    assert op.scope_filter(inv).count() == 0


def test_flatten_labels_follows_the_map(spark):
    inv = inventory(spark, ns("p", "n", "dev"))
    again = flatten_labels(inv.drop("project_id").withColumnRenamed("phase", "phase"))
    assert again.first().project_id == "p"


def test_describe_and_list(spark):
    long = "d" * 71
    df = entries(
        spark,
        {
            "script-one": {
                "code": "c" * 200,
                "scriptType": "PYSPARK",
                "_hidden": "x",
                "description": long,
            },
            "script-two": {"code": "c"},
            "script-none": None,
            "other": {"code": "c"},
        },
    )
    rows = op.describe_entry(df, "default", "One", prefix="script-", sort=True).collect()
    assert [(r.attribute, r.value) for r in rows] == [
        ("code", "c" * 200),
        ("description", "d" * 70 + "..."),
        ("scriptType", "PYSPARK"),
    ]
    role = df.sparkSession.sql("SELECT map('role', 'script') AS labels")
    tagged = df.drop("labels").crossJoin(role).where("name <> 'other'")
    got = {r.name: tuple(r)[1:] for r in op.list_entries(tagged).collect()}
    assert got == {
        "one": ("PYSPARK", "N/A", "d" * 47 + "...", "script-one"),
        "two": ("N/A", "N/A", "", "script-two"),
    }


def test_resolution_with_empty_and_missing_ids(spark):
    inv = inventory(
        spark,
        {"namespace": "a", "project_name": "blank", "project_id": ""},
        {"namespace": "b", "project_name": "blank", "project_id": "p1"},
        {"namespace": "c", "project_name": "unlabelled"},
        ns("p2", "twice", "dev"),
        ns("p3", "twice", "dev"),
    )
    asked = requests(
        spark,
        [(1, "BLANK"), (2, "unlabelled"), (3, "twice"), (4, None)],
        "request_id long, project_name string",
    )
    strict = {r.request_id: (r.project_id, r.status) for r in op.resolve_names(asked, inv).collect()}
    assert strict == {
        1: (None, "ambiguous"),
        2: (None, "not_found"),
        3: (None, "ambiguous"),
        4: (None, "not_found"),
    }
    lenient = {r.request_id: tuple(r)[2:] for r in op.name_owner(asked, inv).collect()}
    assert lenient == {
        1: ("p1", True, False),
        2: (None, False, False),
        3: ("p2", True, True),
        4: (None, False, False),
    }


def test_few_requests_narrow_the_inventory_first(spark):
    inv = inventory(
        spark,
        ns("p1", "one", "dev"),
        ns("p2", "two", "dev"),
        ns("p3", "two", "dev"),
        ns("p4", "x", "dev"),
    )
    asked = requests(
        spark,
        [(1, "ONE", "Two"), (2, "Two", "none")],
        "request_id long, project_name string, new_name string",
    )
    narrow = op.only_named(inv, asked)
    assert sorted(r.namespace for r in narrow.collect()) == ["p1-dev", "p2-dev", "p3-dev"]
    assert narrow.columns == inv.columns
    for act in (op.resolve_names, op.name_owner):
        assert sorted(map(str, act(asked, narrow).collect())) == sorted(
            map(str, act(asked, inv).collect())
        )
    both = op.only_named(inv, asked.limit(1), "project_name", "new_name")
    assert both.count() == 3


def test_parents(spark):
    url = {"repo-url": "u"}
    inv = inventory(
        spark,
        ns("p", "n", "dev", repo_name="r", annotations=url),
        ns("p", "n", "qa"),
        {"namespace": "p-odd", "project_id": "other", "environment": "odd"},
        ns("bare", "b", "dev"),
    )
    asked = requests(
        spark,
        [
            (1, "p", "DEV", "nowhere"),
            (2, "p", "new", None),
            (3, "p", "new", ""),
            (4, "p", "new", "QA"),
            (5, "p", "new", "nowhere"),
            (6, "p", "new", "odd"),
            (7, "bare", "new", "dev"),
            (8, "unknown", "new", None),
        ],
        "request_id long, project_id string, environment string, depends_on string",
    )
    assert {r.request_id: r.status for r in op.check_parents(asked, inv).collect()} == {
        1: "exists",
        2: "ok",
        3: "ok",
        4: "ok",
        5: "parent_missing",
        6: "parent_mismatch",
        7: "no_repo",
        8: "no_repo",
    }


def test_delete_target_of_another_project_is_unsafe(spark):
    inv = inventory(spark, {"namespace": "p-dev", "project_id": "q", "environment": "dev"})
    asked = requests(
        spark, [(1, "p", "dev")], "request_id long, project_id string, environment string"
    )
    assert op.check_delete_targets(asked, inv).first().status == "unsafe"


def test_summary_edges(spark):
    inv = inventory(
        spark,
        {"namespace": "a", "project_id": "p1"},
        {"namespace": "b", "project_id": "", "project_name": "lost"},
        {"namespace": "c", "project_name": "lost"},
        ns("p2", "zeta", "dev"),
        ns("p2", "alpha", ""),
    )
    got = [tuple(r) for r in op.project_summary(inv, sort=True).collect()]
    assert got == [
        ("p1", "[No Display Name Label]", 0, []),
        (
            "p2",
            "alpha, zeta (Warning: Inconsistent display names for this ID)",
            1,
            ["dev"],
        ),
    ]
    texts = op.project_summary(inv, sort=True).select(op.environments_text()).collect()
    assert [r[0] for r in texts] == ["-", "dev"]
    assert [tuple(r) for r in op.project_environment_rows(inv).collect()] == [("p2", "dev")]


def test_environments_of_a_project(spark):
    at = dt.datetime(2024, 5, 1, 10, 0, 0)
    inv = inventory(
        spark,
        ns("p", "n", "dev", phase="Active", created_at=at),
        {"namespace": "p-x", "project_id": "p", "environment": "x"},
        {"namespace": "p-y", "project_id": "p", "project_name": "n"},
    )
    asked = requests(spark, [(1, "N"), (2, "none")], "request_id long, project_name string")
    got = [tuple(r) for r in op.project_environments(asked, inv, sort=True).collect()]
    assert got == [
        (1, "dev", "p-dev", "p", "n", "Active", "2024-05-01T10:00:00+00:00"),
        (1, "x", "p-x", "p", "n", "N/A", "N/A"),
    ]


def test_inconsistent_names(spark):
    inv = inventory(
        spark,
        ns("p1", "shared", "dev"),
        ns("p2", "shared", "dev"),
        ns("p2", "second", "qa"),
        ns("p3", "fine", "dev"),
        ns("p3", "fine", "qa"),
    )
    got = {(r.side, r.key): (r["values"], r.n) for r in op.inconsistent_names(inv).collect()}
    assert got == {
        ("name", "shared"): (["p1", "p2"], 2),
        ("id", "p2"): (["second", "shared"], 2),
    }
    assert op.inconsistent_pairs(inv).count() == 4


def test_tally(spark):
    df = spark.createDataFrame(
        [
            (1, "a", True),
            (1, "b", True),
            (2, "c", True),
            (2, "e", False),
            (2, "d", None),
            (3, "f", False),
        ],
        "request_id long, namespace string, applied boolean",
    )
    got = {r.request_id: tuple(r)[1:] for r in op.apply_tally(df, "request_id").collect()}
    assert got == {
        1: (2, 2, [], "all"),
        2: (3, 1, ["d", "e"], "partial"),
        3: (1, 0, ["f"], "none"),
    }
    counts = {r.request_id: tuple(r)[1:] for r in op.apply_counts(df, "request_id").collect()}
    assert counts == {1: (2, 2, "all"), 2: (3, 1, "partial"), 3: (1, 0, "none")}
    assert sorted(tuple(r) for r in op.failed_rows(df, "request_id").collect()) == [
        (2, "d"),
        (2, "e"),
        (3, "f"),
    ]
