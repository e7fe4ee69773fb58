"""Saved, parameterised queries: check, bind, run, write.

A saved query is Spark SQL with named parameters, or the name of a registered PySpark
function. Parameters are bound as typed values and never formatted into the text.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkroster.constants import (
    DEFAULT_NAMESPACE,
    ENGINE_DEFAULT,
    KEY_CODE,
    KEY_DESCRIPTION,
    KEY_ENGINE,
    KEY_PARAMS_SPEC,
    KEY_TYPE,
    ROLE_LABEL,
    ROLE_SCRIPT,
    SCRIPT_PREFIX,
    TYPE_PYSPARK,
    TYPE_SQL,
)
from sparkroster.functions import (
    entry_name,
    merge_params,
    or_empty,
    params_by_prefix,
    stringify_map,
    strip_first,
)
from sparkroster.operators.select import label_select
from sparkroster.schemas import SAVED_QUERIES, empty_map
from sparkroster.sources.parquet import DEFAULT_SUB_DIR, verify_written, write_apart

# Definition columns and the data keys they are stored under.
_STORED = {
    "type": KEY_TYPE,
    "engine": KEY_ENGINE,
    "code": KEY_CODE,
    "params_spec": KEY_PARAMS_SPEC,
    "description": KEY_DESCRIPTION,
}

PySparkQuery = Callable[[SparkSession, dict], DataFrame]


def check_definitions(defs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Definitions with their code read in, the engine filled in, and a status.

    ``files`` has (path, text). Statuses: two_sources, no_code, no_file, no_type, ok.
    """
    inline = F.nullif(F.col("code"), F.lit(""))
    path = F.nullif(F.col("code_path"), F.lit(""))
    if files is None:
        read = defs.withColumn("_text", F.lit(None).cast("string"))
    else:
        texts = files.select(F.col("path").alias("code_path"), F.col("text").alias("_text"))
        read = defs.join(texts, "code_path", "left")
    status = (
        F.when(inline.isNotNull() & path.isNotNull(), "two_sources")
        .when(inline.isNull() & path.isNull(), "no_code")
        .when(path.isNotNull() & F.col("_text").isNull(), "no_file")
        .when(F.nullif(F.col("type"), F.lit("")).isNull(), "no_type")
        .otherwise("ok")
    )
    engine = F.coalesce(F.nullif(F.col("engine"), F.lit("")), F.lit(ENGINE_DEFAULT))
    filled = {"engine": engine, "code": F.coalesce(inline, "_text")}
    return read.select(
        *[filled[c].alias(c) if c in filled else F.col(c) for c in defs.columns],
        status.alias("status"),
    )


def definitions_as_entries(
    defs: DataFrame, prefix: str = SCRIPT_PREFIX, role_label: str = ROLE_LABEL
) -> DataFrame:
    """Definitions in their stored form: one entry each, with a role label and a data map."""
    data = stringify_map({key: F.col(c) for c, key in _STORED.items()})
    return defs.select(
        F.lit("script").alias("kind"),
        "namespace",
        entry_name("name", prefix).alias("name"),
        F.create_map(F.lit(role_label), F.lit(ROLE_SCRIPT)).alias("labels"),
        data.alias("data"),
    )


def definitions_from_entries(
    entries: DataFrame, prefix: str = SCRIPT_PREFIX, role_label: str = ROLE_LABEL
) -> DataFrame:
    """Definitions of the stored scripts among the entries."""
    scripts = label_select(entries, f"{role_label}={ROLE_SCRIPT}", columns={})
    columns = {c: F.col("data")[key] for c, key in _STORED.items()}
    columns["name"] = strip_first("name", prefix)
    columns["namespace"] = F.col("namespace")
    columns["code_path"] = F.lit(None).cast("string")
    return scripts.select(*[columns[c].alias(c) for c in SAVED_QUERIES.names])


def _fields(spec: str) -> list[T.StructField]:
    return T.StructType.fromDDL(spec).fields


def bind_params(calls: DataFrame, spec: str, params: str = "params") -> DataFrame:
    """Calls with their parameter map bound: (values, errors) in its place.

    ``spec`` reads ``name:type, …`` and gives the typed struct ``values``. ``errors`` is an
    array of the missing, uncastable and unknown parameters.
    """
    fields = _fields(spec)
    names = F.array(*[F.lit(f.name) for f in fields])
    given = calls.withColumn(params, or_empty(params))
    typed = given.withColumn(
        "values",
        F.struct(*[F.col(params)[f.name].try_cast(f.dataType).alias(f.name) for f in fields]),
    )
    wrong = [
        F.when(~F.map_contains_key(params, f.name), f"missing: {f.name}").when(
            F.col(params)[f.name].isNotNull() & F.col("values")[f.name].isNull(),
            f"not {f.dataType.simpleString()}: {f.name}",
        )
        for f in fields
    ]
    unknown = F.transform(
        F.sort_array(F.array_except(F.map_keys(params), names)),
        lambda k: F.concat(F.lit("unknown: "), k),
    )
    errors = F.concat(F.array_compact(F.array(*wrong)), unknown)
    return typed.withColumn("errors", errors).drop(params)


def _literal_map(values: Mapping[str, object] | None) -> Column:
    if not values:
        return empty_map()
    parts = []
    for k, v in values.items():
        parts += [F.lit(k), F.lit(None if v is None else str(v)).cast("string")]
    return F.create_map(*parts)


def resolve_params(
    spark: SparkSession,
    inline: Mapping[str, object] | None,
    config: Mapping[str, str] | None = None,
    prefix: str = "",
    spec: str | None = None,
) -> dict:
    """The parameters of one call: config entries by prefix, inline values over them, bound.

    One row of literals, evaluated with the same expressions as a whole table of calls.
    """
    merged = merge_params(
        params_by_prefix(_literal_map(config), prefix), _literal_map(inline)
    )
    one = spark.sql("SELECT 1")
    if not spec:
        return dict(one.select(merged.alias("p")).first().p)
    row = bind_params(one.select(merged.alias("params")), spec).first()
    if row["errors"]:
        raise ValueError("; ".join(row["errors"]))
    return row["values"].asDict()


def _one(df: DataFrame, what: str):
    """The single row of a point lookup."""
    rows = df.limit(2).collect()
    if not rows:
        raise LookupError(f"{what} not found")
    if len(rows) > 1:
        raise LookupError(f"{what} is defined more than once")
    return rows[0]


def config_values(
    entries: DataFrame, name: str, namespace: str = DEFAULT_NAMESPACE
) -> dict[str, str]:
    """Data of one stored entry, to be used as the config of a call."""
    key = (F.col("namespace") == F.lit(namespace)) & (F.col("name") == F.lit(name.lower()))
    return dict(_one(entries.where(key).select("data"), f"config '{name}'").data or {})


def run_saved_query(
    spark: SparkSession,
    defs: DataFrame,
    name: str,
    inline: Mapping[str, object] | None = None,
    config: Mapping[str, str] | None = None,
    prefix: str = "",
    namespace: str = DEFAULT_NAMESPACE,
    functions: Mapping[str, PySparkQuery] | None = None,
) -> DataFrame:
    """The result of a saved query. Only its one definition row comes to the driver."""
    key = (F.col("namespace") == F.lit(namespace)) & (F.col("name") == F.lit(name.lower()))
    saved = _one(defs.where(key).select("type", "code", "params_spec"), f"saved query '{name}'")
    if not saved.code:
        raise ValueError(f"saved query '{name}' has no code")
    params = resolve_params(spark, inline, config, prefix, saved.params_spec)
    if saved.type == TYPE_SQL:
        return spark.sql(saved.code, args=params)
    if saved.type == TYPE_PYSPARK:
        function = (functions or {}).get(saved.code.strip())
        if function is None:
            raise LookupError(f"no registered function for saved query '{name}'")
        return function(spark, params)
    raise ValueError(f"type '{saved.type}' of saved query '{name}' is not supported")


def run_and_write(
    spark: SparkSession,
    defs: DataFrame,
    name: str,
    base: str,
    sub_dir: str = DEFAULT_SUB_DIR,
    min_rows: int = 1,
    **call,
) -> DataFrame:
    """Run a saved query, write its result as Parquet, and report on what this call wrote."""
    result = run_saved_query(spark, defs, name, **call)
    path = write_apart(result, base, sub_dir)
    return verify_written(spark, path, result.schema, min_rows)
