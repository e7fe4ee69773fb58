import base64

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sparkroster import plans, sources
from sparkroster.schemas import ENTRIES, SAVED_QUERIES
from sparkroster.session import work_dir
from tests.helpers import as_dict, entries


def definitions(spark, *rows):
    return spark.createDataFrame([("default", *r) for r in rows], SAVED_QUERIES)


def test_definition_checks(spark, tmp_path):
    (tmp_path / "a.sql").write_text("SELECT 1\nAS é")
    defs = definitions(
        spark,
        ("both", "T", None, "c", "p", None, None),
        ("none", "T", "", "", None, None, None),
        ("lost", "T", None, None, str(tmp_path / "x.sql"), None, None),
        ("file", "T", "E", None, str(tmp_path / "a.sql"), None, None),
        ("untyped", "", None, "c", None, None, None),
        ("fine", "T", None, "c", None, None, None),
    )
    files = sources.text_files_as_rows(spark, str(tmp_path / "*.sql"))
    got = {r.name: (r.status, r.engine, r.code) for r in plans.check_definitions(defs, files).collect()}
    assert {n: s for n, (s, _, _) in got.items()} == {
        "both": "two_sources",
        "none": "no_code",
        "lost": "no_file",
        "file": "ok",
        "untyped": "no_type",
        "fine": "ok",
    }
    assert got["file"][1:] == ("E", "SELECT 1\nAS é")
    assert got["fine"][1] == "K8S_JOB"


def test_binding(spark):
    call = {"mensaje": "Hola Mundo Archivo", "n": "5"}
    spec = "mensaje:string, n:int"
    assert plans.resolve_params(spark, call, spec=spec) == {"mensaje": "Hola Mundo Archivo", "n": 5}
    with pytest.raises(ValueError, match="missing: n; unknown: x"):
        plans.resolve_params(spark, {"mensaje": "a", "x": 1}, spec=spec)
    with pytest.raises(ValueError, match="not int: n"):
        plans.resolve_params(spark, {"mensaje": "a", "n": "five"}, spec=spec)
    assert plans.resolve_params(spark, {"a": 1}, {"run_a": "0", "run_b": "2", "c": "3"}, "run_") == {
        "a": "1",
        "b": "2",
    }


def test_running(spark):
    defs = definitions(
        spark,
        ("hello", "SQL_SPARK", None, "SELECT :mensaje AS m, :n + 1 AS n", None, "mensaje:string, n:int", ""),
        ("fn", "PYSPARK", None, "rows", None, "n:int", ""),
        ("py", "PYTHON", None, "print()", None, None, ""),
        ("empty", "SQL_SPARK", None, "", None, None, ""),
        ("twice", "SQL_SPARK", None, "SELECT 1", None, None, ""),
        ("twice", "SQL_SPARK", None, "SELECT 2", None, None, ""),
    )
    got = plans.run_saved_query(spark, defs, "Hello", {"mensaje": "x'; DROP", "n": "4"}).collect()
    assert [tuple(r) for r in got] == [("x'; DROP", 5)]
    rows = plans.run_saved_query(
        spark, defs, "fn", {"n": 3}, functions={"rows": lambda s, p: s.range(p["n"])}
    )
    assert rows.count() == 3
    with pytest.raises(LookupError, match="not found"):
        plans.run_saved_query(spark, defs, "nope")
    with pytest.raises(LookupError, match="more than once"):
        plans.run_saved_query(spark, defs, "twice")
    with pytest.raises(LookupError, match="no registered function"):
        plans.run_saved_query(spark, defs, "fn", {"n": 3})
    with pytest.raises(ValueError, match="not supported"):
        plans.run_saved_query(spark, defs, "py")
    with pytest.raises(ValueError, match="has no code"):
        plans.run_saved_query(spark, defs, "empty")


def test_config_from_an_entry(spark):
    stored = entries(spark, {"settings": {"run_n": "2", "other": "x"}})
    config = plans.config_values(stored, "Settings")
    assert plans.resolve_params(spark, None, config, "run_", "n:int") == {"n": 2}


def test_run_and_write_reports_its_own_write(spark):
    base = work_dir(spark, "saved")
    defs = definitions(spark, ("rows", "PYSPARK", None, "rows", None, "n:int", ""))
    call = {"inline": {"n": 4}, "functions": {"rows": lambda s, p: sources.sample_rows(s, p["n"])}}
    one = plans.run_and_write(spark, defs, "rows", base, **call).first()
    assert (one.n_rows, one.schema_ok, one.found) == (4, True, True)
    assert one.path.startswith(f"{base}/output/write_id=")
    two = plans.run_and_write(spark, defs, "rows", base, min_rows=9, **call).first()
    assert (two.n_rows, two.found) == (4, False)
    none = plans.run_and_write(spark, defs, "rows", base, **(call | {"inline": {"n": 0}})).first()
    assert (none.n_rows, none.schema_ok, none.found) == (0, True, False)
    assert spark.read.parquet(f"{base}/output").count() == 8


def test_sample_rows(spark):
    rows = sources.sample_rows(spark, 4).orderBy("user_id_arg")
    assert [tuple(r) for r in rows.collect()] == [
        (f"ArgUser{i + 1}", 301 + i, i * 1.23) for i in range(4)
    ]
    assert rows.schema.simpleString() == sources.SAMPLE_SCHEMA.simpleString()


def test_missing_output_is_a_result(spark):
    got = sources.verify_written(spark, work_dir(spark, "nothing"), sources.SAMPLE_SCHEMA).first()
    assert (got.n_rows, got.schema_ok, got.found) == (0, False, False)
    path = sources.write_parquet(spark.range(2), work_dir(spark, "other"), "sub")
    got = sources.verify_written(spark, path, sources.SAMPLE_SCHEMA).first()
    assert (got.n_rows, got.schema_ok, got.found) == (2, False, True)


def test_files_as_entries(spark, tmp_path):
    big = bytes(range(256)) * 2
    (tmp_path / "key.json").write_bytes(big[:300])
    (tmp_path / "ca.crt").write_bytes(b"x")
    row = sources.files_as_entries(spark, str(tmp_path), "secret", "default", "keys").first()
    assert row.data == {
        "key.json": base64.b64encode(big[:300]).decode(),
        "ca.crt": base64.b64encode(b"x").decode(),
    }
    assert sources.files_as_entries(spark, str(tmp_path), "s", "d", "k").columns == ENTRIES.names
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        sources.files_as_rows(spark, str(tmp_path / "nothing"))


def test_file_fields_of_entries(spark, tmp_path):
    path = tmp_path / "sa.json"
    path.write_bytes(b"{}")
    df = entries(
        spark,
        {
            "good": {"api_key": "s3", "file_config-json": str(path), "file_ca": str(path)},
            "lost": {"file_a": str(path), "file_b": "/nowhere/x", "file_": "y"},
            "plain": {"k": "v"},
            "none": None,
        },
    )
    files = sources.files_as_rows(spark, str(tmp_path))
    got = {r.name: tuple(r)[3:] for r in sources.resolve_file_fields(df, files).collect()}
    assert got == {
        "good": ({"api_key": "s3"}, {"config-json": "e30=", "ca": "e30="}, [], "ok"),
        "lost": ({}, {"a": "e30="}, ["b"], "missing_file"),
        "plain": ({"k": "v"}, {}, [], "ok"),
        "none": ({}, {}, [], "ok"),
    }


def test_work_dir_is_below_the_shared_folder(spark):
    assert work_dir(spark, "a").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert work_dir(spark, "a") != work_dir(spark, "a")


def test_no_files_are_collected_by_accident(spark, tmp_path):
    (tmp_path / "one.txt").write_text("a\nb")
    rows = sources.text_files_as_rows(spark, str(tmp_path))
    assert [tuple(r) for r in rows.collect()] == [(str(tmp_path / "one.txt"), "a\nb")]
    assert rows.where(F.col("text").contains("b")).count() == 1


@pytest.mark.parametrize("name", ["a b.txt", "a%20b.txt", "a+b.txt", "é%.txt", "#1?.txt"])
def test_readers_agree_on_paths(spark, tmp_path, name):
    (tmp_path / name).write_text("x")
    want = [str(tmp_path / name)]
    assert [r.path for r in sources.text_files_as_rows(spark, str(tmp_path)).collect()] == want
    assert [r.path for r in sources.files_as_rows(spark, str(tmp_path)).collect()] == want


def test_each_folder_is_an_entry(spark, tmp_path):
    for folder, name in (("one", "a"), ("one", "b"), ("two", "a")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(folder + name)
    got = as_dict(sources.files_as_entries(spark, f"{tmp_path}/*/*", "secret", "default"))
    text = {n: {k: base64.b64decode(v).decode() for k, v in d.items()} for n, d in got.items()}
    assert text == {"one": {"a": "onea", "b": "oneb"}, "two": {"a": "twoa"}}
