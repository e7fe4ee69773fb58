"""Input schemas and the flattening of well-known labels into columns.

A filter on ``labels['project-id']`` reaches a Parquet scan only as
``IsNotNull(labels)``; a filter on a flat column reaches it as ``EqualTo`` and
prunes row groups. Inventories are therefore stored with both: flat columns for
the well-known labels, the map for ad-hoc selectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkroster.constants import LABEL_COLUMNS

_MAP = T.MapType(T.StringType(), T.StringType())

CONDITION = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("last_transition_time", T.TimestampType()),
        T.StructField("message", T.StringType()),
    ]
)

INVENTORY = T.StructType(
    [
        T.StructField("namespace", T.StringType()),
        T.StructField("project_id", T.StringType()),
        T.StructField("project_name", T.StringType()),
        T.StructField("environment", T.StringType()),
        T.StructField("repo_name", T.StringType()),
        T.StructField("depends_on", T.StringType()),
        T.StructField("labels", _MAP),
        T.StructField("annotations", _MAP),
        T.StructField("phase", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

ENTRIES = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("labels", _MAP),
        T.StructField("data", _MAP),
    ]
)

CHANGES = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("data", _MAP),
    ]
)

RUN_SAMPLES = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("start_time", T.TimestampType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("active", T.IntegerType()),
        T.StructField("succeeded", T.IntegerType()),
        T.StructField("failed", T.IntegerType()),
        T.StructField("conditions", T.ArrayType(CONDITION)),
    ]
)

RUN_LOGS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("pod", T.StringType()),
        T.StructField("container", T.StringType()),
        T.StructField("container_index", T.IntegerType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("line", T.StringType()),
    ]
)

SAVED_QUERIES = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "namespace",
            "name",
            "type",
            "engine",
            "code",
            "code_path",
            "params_spec",
            "description",
        )
    ]
)

ENTRY_KEY = ("kind", "namespace", "name")


def empty_map() -> Column:
    """A typed empty map<string,string>."""
    return F.create_map().cast("map<string,string>")


def flatten_labels(df: DataFrame, columns: dict[str, str] = LABEL_COLUMNS) -> DataFrame:
    """Set the flat label columns of an inventory from its label map."""
    return df.withColumns({flat: F.col("labels")[key] for flat, key in columns.items()})


def labels_from_columns(columns: dict[str, str] = LABEL_COLUMNS) -> Column:
    """The label map that belongs to the flat columns; null columns give no label."""
    keys = F.array(*[F.lit(key) for key in columns.values()])
    values = F.array(*[F.col(flat).cast("string") for flat in columns])
    return F.map_filter(F.map_from_arrays(keys, values), lambda _, v: v.isNotNull())


def to_inventory(raw: DataFrame, columns: dict[str, str] = LABEL_COLUMNS) -> DataFrame:
    """An inventory from raw rows (namespace, labels, annotations, phase, created_at)."""
    return flatten_labels(raw, columns).select(*INVENTORY.names)
