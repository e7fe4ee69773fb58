"""A whole session: projects, environments, secrets from files, a script and its run."""

from pyspark.sql import functions as F

from sparkroster import operators as op
from sparkroster import plans, sources
from sparkroster.schemas import ENTRIES, INVENTORY, SAVED_QUERIES, to_inventory
from sparkroster.session import work_dir
from tests.helpers import entries, inventory, ns


def asked(spark, *rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "request_id long, project_name string, environment string, depends_on string",
    )


def test_projects_and_environments(spark):
    empty = spark.createDataFrame([], INVENTORY)
    wanted = asked(
        spark,
        ("MiPrimeraApp", None, None),
        ("OtroProyecto", None, None),
        ("miprimeraapp", None, None),
    ).select("request_id", "project_name")
    first = op.create_projects(empty, wanted, "batch-1", "git/")
    assert {r.request_id: r.status for r in first.results.collect()} == {
        0: "created",
        1: "created",
        2: "taken",
    }
    inv = first.table
    rows = {r.project_name: r for r in inv.collect()}
    app = rows["miprimeraapp"]
    assert app.namespace == f"{app.project_id}-dev" and app.environment == "dev"
    assert app.repo_name == "project-miprimeraapp"
    assert app.annotations == {"repo-url": "git/project-miprimeraapp"}
    assert app.labels == {
        "project-id": app.project_id,
        "project-name": "miprimeraapp",
        "environment": "dev",
        "repo-name": "project-miprimeraapp",
    }
    again = op.create_projects(inv, wanted, "batch-2", "git/")
    assert {r.status for r in again.results.collect()} == {"taken"}
    assert again.table.count() == 2

    grown = op.create_environments(
        inv,
        asked(
            spark,
            ("MiPrimeraApp", "Staging", None),
            ("MiPrimeraApp", "staging", ""),
            ("MiPrimeraApp", "QA", "Dev"),
            ("MiPrimeraApp", "x", "nowhere"),
            ("Nobody", "x", None),
            ("OtroProyecto", "dev", None),
        ),
    )
    assert {r.request_id: r.status for r in grown.results.collect()} == {
        0: "created",
        1: "exists",
        2: "created",
        3: "parent_missing",
        4: "project_not_found",
        5: "exists",
    }
    got = {r.environment: r for r in grown.table.where("project_name = 'miprimeraapp'").collect()}
    assert set(got) == {"dev", "staging", "qa"}
    assert got["qa"].depends_on == "dev" and got["qa"].labels["depends-on"] == "dev"
    assert got["staging"].depends_on is None and "depends-on" not in got["staging"].labels
    assert got["qa"].repo_name == "project-miprimeraapp"
    report = op.project_summary(grown.table, sort=True).collect()
    summary = [(r.project_display_name, r.environment_names) for r in report]
    assert summary == [("miprimeraapp", ["dev", "qa", "staging"]), ("otroproyecto", ["dev"])]


def test_ids_repeat_for_one_batch_and_differ_between_batches(spark):
    empty = spark.createDataFrame([], INVENTORY)
    wanted = asked(spark, ("a", None, None))

    def made(batch):
        return op.create_projects(empty, wanted, batch, "git/").results.first().project_id

    assert made("b1") == made("b1") != made("b2")
    held = inventory(spark, ns(made("b1"), "another", "dev"))
    done = op.create_projects(held, wanted, "b1", "git/")
    assert [r.status for r in done.results.collect()] == ["id_conflict"]
    assert done.table.count() == 1


def test_environment_of_a_project_without_a_repository(spark):
    inv = inventory(spark, ns("p", "bare", "dev"))
    done = op.create_environments(inv, asked(spark, ("bare", "qa", None)))
    assert [r.status for r in done.results.collect()] == ["no_repo"]
    assert done.table.count() == 1


def test_raw_rows_become_an_inventory(spark):
    inv = inventory(spark, ns("p", "n", "dev", repo_name="r", depends_on="qa", phase="Active"))
    raw = inv.select("namespace", "labels", "annotations", "phase", "created_at")
    assert to_inventory(raw).collect() == inv.collect()


def test_secret_from_files_then_replace_and_delete(spark, tmp_path):
    path = tmp_path / "key.json"
    path.write_bytes(b'{"k": 1}')
    wanted = entries(
        spark, {"my-app": {"api_key": "s3cr3t", "file_config-json": str(path), "file_ca": str(path)}}
    )
    read = sources.resolve_file_fields(wanted, sources.files_as_rows(spark, str(path)))
    row = read.first()
    assert row.status == "ok" and set(row.encoded) == {"config-json", "ca"}
    both = F.map_concat("literal", "encoded")
    log = read.select("kind", "namespace", "name", F.lit(1).alias("seq"), both.alias("data"))
    base = spark.createDataFrame([], ENTRIES)
    table = op.create_if_absent(base, log).table
    assert set(table.first().data) == {"api_key", "config-json", "ca"}
    assert op.delete_if_present(table, log).table.count() == 0


def test_script_from_a_file_is_stored_listed_described_and_run(spark, tmp_path):
    path = tmp_path / "hello.sql"
    path.write_text("SELECT :mensaje AS mensaje, id FROM range(:n)")
    defs = spark.createDataFrame(
        [
            (
                "default",
                "Script-De-Archivo",
                "SQL_SPARK",
                None,
                None,
                str(path),
                "mensaje:string, n:int",
                "Este script fue cargado desde un archivo local.",
            ),
            ("default", "broken", "SQL_SPARK", None, None, None, None, None),
        ],
        SAVED_QUERIES,
    )
    checked = plans.check_definitions(defs, sources.text_files_as_rows(spark, str(path)))
    assert {r.name: r.status for r in checked.collect()} == {
        "Script-De-Archivo": "ok",
        "broken": "no_code",
    }
    good = plans.definitions_as_entries(checked.where("status = 'ok'"))
    base = spark.createDataFrame([], ENTRIES)
    stored = op.create_if_absent(base, good.withColumn("seq", F.lit(1))).table
    assert [tuple(r) for r in op.list_entries(stored).collect()] == [
        (
            "script-de-archivo",
            "SQL_SPARK",
            "K8S_JOB",
            "Este script fue cargado desde un archivo local.",
            "script-script-de-archivo",
        )
    ]
    shown = op.describe_entry(stored, "default", "Script-De-Archivo", prefix="script-", sort=True).collect()
    assert [r.attribute for r in shown] == [
        "code",
        "description",
        "engine",
        "paramsSpec",
        "scriptType",
    ]
    patch = stored.select(
        "kind",
        "namespace",
        "name",
        F.lit(2).alias("seq"),
        F.create_map(F.lit("description"), F.lit(None).cast("string")).alias("data"),
    )
    stored = op.merge_patch_existing(stored, patch).table
    assert "description" not in stored.first().data
    saved = plans.definitions_from_entries(stored)
    done = plans.run_and_write(
        spark,
        saved,
        "script-de-archivo",
        work_dir(spark, "run"),
        inline={"mensaje": "Hola Mundo Archivo"},
        config={"run_n": "3"},
        prefix="run_",
    ).first()
    assert (done.n_rows, done.schema_ok, done.found) == (3, True, True)
    assert {r.mensaje for r in spark.read.parquet(done.path).collect()} == {"Hola Mundo Archivo"}
