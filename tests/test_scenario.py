"""One session of commands, replayed on small tables."""

from sparkroster import operators as op
from tests.helpers import inventory, ns

A, B, C = "proj-a", "proj-b", "proj-c"


def names(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "request_id long, project_name string")


def test_no_projects(spark):
    assert op.project_summary(inventory(spark)).collect() == []


def test_first_project_and_environments(spark):
    inv = inventory(
        spark,
        ns(A, "miprimeraapp", "dev"),
        ns(A, "miprimeraapp", "staging"),
        ns(A, "miprimeraapp", "production"),
        ns(B, "otroproyecto", "dev"),
    )
    got = [tuple(r) for r in op.project_summary(inv, sort=True).collect()]
    assert got == [
        (A, "miprimeraapp", 3, ["dev", "production", "staging"]),
        (B, "otroproyecto", 1, ["dev"]),
    ]
    rows = op.project_environments(names(spark, "MiPrimeraApp"), inv, sort=True).collect()
    assert [r.environment for r in rows] == ["dev", "production", "staging"]
    assert {(r.status, r.created) for r in rows} == {("N/A", "N/A")}


def test_rename_then_lookup_by_both_names(spark):
    inv = inventory(
        spark,
        ns(A, "miprimeraapp", "dev", repo_name="project-miprimeraapp"),
        ns(A, "miprimeraapp", "production", repo_name="project-miprimeraapp"),
        ns(B, "otroproyecto", "dev"),
    )
    asked = spark.createDataFrame(
        [(1, "MiPrimeraApp", "AppRenombrada")], "request_id long, old_name string, new_name string"
    )
    done = op.rename_projects(inv, asked)
    assert [tuple(r) for r in done.results.collect()] == [(1, A, "renamed", 2, 2, "all")]
    after = done.table
    assert [r.project_display_name for r in op.project_summary(after, sort=True).collect()] == [
        "apprenombrada",
        "otroproyecto",
    ]
    rows = after.where("project_id = 'proj-a'").collect()
    assert {r.repo_name for r in rows} == {"project-miprimeraapp"}
    assert {r.labels["project-name"] for r in rows} == {"apprenombrada"}
    found = op.resolve_names(names(spark, "AppRenombrada", "MiPrimeraApp"), after)
    assert {r.request_id: (r.project_id, r.status) for r in found.collect()} == {
        0: (A, "ok"),
        1: (None, "not_found"),
    }


def test_rename_to_a_taken_name(spark):
    inv = inventory(spark, ns(B, "otroproyecto", "dev"), ns(C, "conflictonombre", "dev"))
    asked = spark.createDataFrame(
        [(1, "OtroProyecto", "ConflictoNombre")],
        "request_id long, old_name string, new_name string",
    )
    done = op.rename_projects(inv, asked)
    assert [tuple(r) for r in done.results.collect()] == [(1, B, "conflict", 0, 0, "none")]
    assert sorted(r.project_name for r in done.table.collect()) == [
        "conflictonombre",
        "otroproyecto",
    ]


def test_rename_clashes_between_requests(spark):
    inv = inventory(
        spark, ns(A, "a", "dev"), ns(B, "b", "dev"), ns(C, "c", "dev"), ns(C, "c", "test")
    )
    asked = spark.createDataFrame(
        [
            (5, "a", "x"),
            (3, "b", "x"),
            (4, "c", "y"),
            (6, "c", "z"),
            (7, "a", "A"),
            (8, "nope", "q"),
            (9, "a", "w"),
        ],
        "request_id long, old_name string, new_name string",
    )
    done = op.rename_projects(inv, asked)
    assert {r.request_id: (r.status, r.total) for r in done.results.collect()} == {
        3: ("renamed", 1),
        4: ("renamed", 2),
        5: ("conflict", 0),
        6: ("conflict", 0),
        7: ("noop", 0),
        8: ("not_found", 0),
        9: ("renamed", 1),
    }
    assert {r.project_id: r.project_name for r in done.table.collect()} == {
        A: "w",
        B: "x",
        C: "y",
    }


def test_drop_environment_then_project(spark):
    inv = inventory(
        spark,
        ns(A, "apprenombrada", "dev"),
        ns(A, "apprenombrada", "production"),
        ns(B, "otroproyecto", "dev"),
        ns(B, "otroproyecto", "test"),
    )
    asked = spark.createDataFrame(
        [(1, A, "production"), (2, B, "entornoinexistente"), (3, "proj-x", "dev")],
        "request_id long, project_id string, environment string",
    )
    checked = op.check_delete_targets(asked, inv)
    assert {r.request_id: r.status for r in checked.collect()} == {
        1: "ok",
        2: "not_found",
        3: "not_found",
    }
    ok = checked.where("status = 'ok'").select("namespace")
    left = op.delete_if_present(inv, ok, ["namespace"])
    assert [r.status for r in left.results.collect()] == ["deleted"]
    assert sorted(r.namespace for r in left.table.collect()) == [
        "proj-a-dev",
        "proj-b-dev",
        "proj-b-test",
    ]
    kept, removed, results = op.drop_projects(
        left.table, names(spark, "OtroProyecto", "ProyectoQueNoExiste")
    )
    assert {r.request_id: (r.status, r.removed) for r in results.collect()} == {
        0: ("dropped", 2),
        1: ("not_found", 0),
    }
    assert [r.project_id for r in op.project_summary(kept).collect()] == [A]
    assert removed.count() == 2


def test_use_of_missing_project_or_environment(spark):
    inv = inventory(spark, ns(A, "testfinal", "dev"))
    asked = spark.createDataFrame(
        [(1, "ProyectoQueNoExiste", "dev"), (2, "TestFinal", "staging"), (3, "TestFinal", "DEV")],
        "request_id long, project_name string, environment string",
    )
    got = op.resolve_environments(asked, inv)
    assert {r.request_id: (r.project_id, r.namespace, r.status) for r in got.collect()} == {
        1: (None, None, "project_not_found"),
        2: (A, None, "environment_not_found"),
        3: (A, "proj-a-dev", "ok"),
    }


def test_second_project_of_the_same_name_is_taken(spark):
    inv = inventory(spark, ns(A, "testfinal", "dev"))
    got = op.name_owner(names(spark, "TestFinal", "other"), inv)
    assert {r.request_id: (r.owner_id, r.taken, r.multi_owner) for r in got.collect()} == {
        0: (A, True, False),
        1: (None, False, False),
    }
