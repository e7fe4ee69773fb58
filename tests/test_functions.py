import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkroster import functions as fn


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    "given,expected",
    [
        ("My_App.V2", "my-app-v2"),
        ("--a__b--", "a-b"),
        ("___", None),
        ("x" * 70, "x" * 63),
        ("Éa ñ", "a"),
        ("a" * 62 + "_b", "a" * 62 + "-"),
    ],
)
def test_sanitize(spark, given, expected):
    name = fn.sanitize_name(F.lit(given))
    name, bad = one(spark, name, fn.is_bad_name(F.lit(given), name))
    assert name == expected
    assert bad == (expected is None)


def test_sanitize_strict_raises(spark):
    with pytest.raises(Exception, match="no usable characters"):
        one(spark, fn.sanitize_name(F.lit("___"), strict=True))
    assert one(spark, fn.sanitize_name(F.lit("Ab"), strict=True))[0] == "ab"


def test_sanitize_is_idempotent_unless_the_cut_leaves_a_dash(spark):
    df = spark.createDataFrame([("A b",), ("x" * 80,), ("é-é--q",), ("1_2.3",)], "s string")
    once = df.select(fn.sanitize_name("s").alias("s"))
    assert once.select(fn.sanitize_name("s")).collect() == once.collect()


def test_physical_name(spark):
    assert one(
        spark,
        fn.physical_name(F.lit("proj-1"), F.lit("qa team")),
        fn.physical_name(F.lit("proj-1"), F.lit("QA")),
        fn.physical_name(F.lit("proj-1"), F.lit(None).cast("string")),
        fn.physical_name(F.lit("proj-1"), F.lit("x" * 80)),
    ) == ("proj-1-qa-team", "proj-1-env", "proj-1-env", "proj-1-" + "x" * 56)


def test_repo_branch_run_and_entry_names(spark):
    assert one(
        spark,
        fn.repo_name(F.lit("My App")),
        fn.branch_name(F.lit("QA_1")),
        fn.run_name(F.lit("My_Job"), F.lit("0a1b2c3d")),
        fn.run_name(F.lit("j" * 80), F.lit("0a1b2c3d")),
        fn.entry_name(F.lit("My Script"), "script-"),
    ) == (
        "project-my-app",
        "qa-1",
        "run-exec-my-job-0a1b2c3d",
        "run-exec-" + "j" * 54,
        "script-my-script",
    )


def test_ids(spark):
    a, b, c, run = one(
        spark, fn.new_id(), fn.new_id(F.lit(7)), fn.new_id(F.lit(7)), fn.run_name(F.lit("x"))
    )
    assert a.startswith("proj-") and len(a) == 17
    assert b == c and len(b) == 17
    assert len(run) == len("run-exec-x-") + 8


def test_preview_strip_and_paths(spark):
    assert one(
        spark,
        fn.preview(F.lit("x" * 70), 70, 70),
        fn.preview(F.lit("x" * 71), 70, 70),
        fn.preview(F.lit("x" * 51), 50, 47),
        fn.strip_first(F.lit("script-script-a"), "script-"),
        fn.strip_first(F.lit("a-script-b"), "script-"),
        fn.strip_first(F.lit("plain"), "script-"),
    ) == ("x" * 70, "x" * 70 + "...", "x" * 47 + "...", "script-a", "a-b", "plain")
    for path, directory, base in (
        ("/mnt/keys/a.json", "/mnt/keys", "a.json"),
        ("a.json", "", "a.json"),
        ("/a.json", "/", "a.json"),
        ("/a/b/", "/a/b", ""),
    ):
        assert tuple(one(spark, fn.path_dir(F.lit(path)), fn.path_base(F.lit(path)))) == (
            directory,
            base,
        )


def test_iso_time_agrees_with_python(spark):
    times = [
        dt.datetime(2024, 1, 2, 3, 4, 5, tzinfo=dt.timezone.utc),
        dt.datetime(2024, 1, 2, 3, 4, 5, 120, tzinfo=dt.timezone.utc),
    ]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp")
    assert [r[0] for r in df.select(fn.iso_time("t")).collect()] == [t.isoformat() for t in times]
    assert one(spark, fn.iso_time(F.lit(None).cast("timestamp")))[0] == "N/A"
    assert one(spark, fn.iso_time(F.lit(None).cast("timestamp"), None))[0] is None


def m(**values):
    return F.create_map(*[F.lit(x).cast("string") for kv in values.items() for x in kv])


def test_file_fields(spark):
    literal, files = fn.split_file_fields(
        F.create_map(
            *[F.lit(x) for x in ("api_key", "s3", "file_ca-crt", "./a.json", "file_", "./b")]
        )
    )
    assert one(spark, literal, files) == ({"api_key": "s3"}, {"ca-crt": "./a.json"})


def test_encode_has_no_line_breaks_and_round_trips(spark):
    text = "ñ" * 150
    encoded = fn.encode_values(m(k=text))
    row = one(spark, encoded.alias("e"), fn.decode_values(encoded).alias("d"))
    assert len(row.e["k"]) == 400 and "\n" not in row.e["k"] and "\r" not in row.e["k"]
    assert row.d == {"k": text}
    nothing = F.lit(None).cast("map<string,string>")
    assert one(spark, fn.decode_values(nothing))[0] == {}
    bad = F.create_map(F.lit("k"), F.base64(F.unhex(F.lit("FF"))))
    assert one(spark, fn.decode_values(bad, strict=False))[0] == {"k": None}
    with pytest.raises(Exception, match="INVALID_UTF8"):
        one(spark, fn.decode_values(bad))


def test_params(spark):
    nothing = F.lit(None).cast("map<string,string>")
    assert one(
        spark,
        fn.merge_params(m(a="1", b="2"), m(b="9", c="3")),
        fn.merge_params(nothing, m(a="1")),
        fn.merge_params(m(a="1"), nothing),
        fn.merge_params(m(a="1"), m(a=None)),
        fn.params_by_prefix(m(run_X="1", run_Y="2", z="3"), "run_"),
        fn.params_by_prefix(m(z="3")),
        fn.params_as_args(m(b="1", a="x y")),
        fn.params_as_args(nothing),
    ) == (
        {"a": "1", "b": "9", "c": "3"},
        {"a": "1"},
        {"a": "1"},
        {"a": None},
        {"X": "1", "Y": "2"},
        {"z": "3"},
        ["--b", "1", "--a", "x y"],
        [],
    )
    given = m(a="1", A="2", b="3")
    env, shared = one(spark, fn.params_as_env(given), fn.env_collisions(given))
    assert [tuple(e) for e in env] == [("PARAM_A", "1"), ("PARAM_A", "2"), ("PARAM_B", "3")]
    assert shared == ["PARAM_A"]


def test_merge_patch_and_stringify(spark):
    assert one(
        spark,
        fn.merge_patch(m(a="1", b="2"), m(b="9", c=None)),
        fn.merge_patch(m(a="1", b="2"), m(a=None)),
        fn.stringify_map({"n": F.lit(5), "x": F.lit(None), "s": F.lit("t")}),
    ) == ({"a": "1", "b": "9"}, {"b": "2"}, {"n": "5", "s": "t"})
