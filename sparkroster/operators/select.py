"""Selection and projection over inventories and keyed entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkroster.constants import (
    DEFAULT_NAMESPACE,
    DESCRIPTION_PREVIEW,
    KEY_CODE,
    KEY_DESCRIPTION,
    KEY_ENGINE,
    KEY_TYPE,
    LABEL_COLUMNS,
    NOT_AVAILABLE,
    ROLE_LABEL,
    ROLE_SCRIPT,
    SCRIPT_PREFIX,
    VALUE_PREVIEW,
)
from sparkroster.functions import entry_name, or_empty, preview, strip_first


def scope_filter(df: DataFrame, namespace: str = DEFAULT_NAMESPACE) -> DataFrame:
    """Rows of one namespace. A stored table partitioned by namespace is pruned to it."""
    return df.where(F.col("namespace") == F.lit(namespace))


def label_select(
    df: DataFrame,
    selector: str | None = None,
    labels: str = "labels",
    columns: dict[str, str] = LABEL_COLUMNS,
) -> DataFrame:
    """Rows whose labels match ``key=value``, or carry ``key``; all rows without a selector.

    A well-known label that the table also holds as a flat column is tested there, so that
    the test reaches the scan.
    """
    if not selector:
        return df
    key, wants_value, value = selector.partition("=")
    flat = next((c for c, k in columns.items() if k == key and c in df.columns), None)
    if flat is not None:
        test = F.col(flat) == F.lit(value) if wants_value else F.col(flat).isNotNull()
    elif wants_value:
        test = F.col(labels)[key] == F.lit(value)
    else:
        test = F.map_contains_key(F.col(labels), key)
    return df.where(test)


def describe_entry(
    entries: DataFrame,
    namespace: str | None = DEFAULT_NAMESPACE,
    name: str | None = None,
    prefix: str = "",
    sort: bool = False,
) -> DataFrame:
    """(namespace, name, attribute, value) rows of one entry, or of all entries.

    Hidden keys (leading underscore) are left out, code comes whole, other values as a
    preview. ``namespace=None`` and ``name=None`` select all.
    """
    if namespace is not None:
        entries = scope_filter(entries, namespace)
    if name is not None:
        entries = entries.where(F.col("name") == entry_name(F.lit(name), prefix))
    rows = entries.select("namespace", "name", F.explode("data").alias("attribute", "value"))
    out = rows.where(~F.col("attribute").startswith("_")).withColumn(
        "value",
        F.when(F.col("attribute") == KEY_CODE, F.col("value")).otherwise(
            preview("value", *VALUE_PREVIEW)
        ),
    )
    return out.orderBy("namespace", "name", "attribute") if sort else out


def list_entries(
    entries: DataFrame,
    namespace: str | None = DEFAULT_NAMESPACE,
    prefix: str = SCRIPT_PREFIX,
    role_label: str = ROLE_LABEL,
) -> DataFrame:
    """One row per stored script: short name, type, engine, description, stored name."""
    if namespace is not None:
        entries = scope_filter(entries, namespace)
    scripts = label_select(entries, f"{role_label}={ROLE_SCRIPT}", columns={})
    scripts = scripts.where(F.size(or_empty("data")) > 0)

    def field(key: str, default: str):
        return F.coalesce(F.col("data")[key], F.lit(default))

    return scripts.select(
        strip_first("name", prefix).alias("name"),
        field(KEY_TYPE, NOT_AVAILABLE).alias("type"),
        field(KEY_ENGINE, NOT_AVAILABLE).alias("engine"),
        preview(field(KEY_DESCRIPTION, ""), *DESCRIPTION_PREVIEW).alias("description"),
        F.col("name").alias("entry_name"),
    )
