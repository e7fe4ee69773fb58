"""Keyed table changes, one plan for any number of changes.

Each function takes at most one change per key (the lowest ``seq`` when there are several;
an ordered log with many changes per key goes through :mod:`.changelog`) and returns the
new table together with one result row per change. A requested ``name`` counts in lower
case. Plain Parquet has no atomic merge: write the new table to a new path.

``buckets`` says that the base is a table stored in that many buckets of its key (see
:mod:`sparkroster.sources.stored`): the changes are then dealt out in the same way and the
base is read where it lies, whatever its size.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkroster.functions import comparable, drop_nulls, merge_patch, or_empty
from sparkroster.operators.skew import lookup
from sparkroster.schemas import ENTRY_KEY, LABEL_COLUMNS

CONFLICT = "conflict"
SKIPPED = "skipped"
INVALID = "invalid"


class Changed(NamedTuple):
    """The table after the changes, and what became of each change."""

    table: DataFrame
    results: DataFrame


def by_lower_name(changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Changes with the requested name in lower case, where the key has a name."""
    return changes.withColumn("name", F.lower("name")) if "name" in key else changes


def beside(changes: DataFrame, key: Sequence[str], buckets: int | None) -> DataFrame:
    """Changes in the partitions of a base that is stored in ``buckets`` of its key. They are
    one row per key by then, so that a key with very many changes does not meet in a task."""
    return changes.repartition(buckets, *key) if buckets else changes


def whole_key(key: Sequence[str]) -> Column:
    """No part of the key is null."""
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    return whole


def sort_out(changes: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Changes with a whole key and a ``seq``, and the result rows of all others: ``invalid``."""
    whole = whole_key(key) & F.col("seq").isNotNull()
    return changes.where(whole), changes.where(~whole).select(
        *key, "seq", F.lit(INVALID).alias("status")
    )


def first_change(changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """The change with the lowest ``seq`` of every key, reduced before the shuffle."""
    rest = [c for c in changes.columns if c not in key]
    picked = changes.groupBy(*key).agg(F.min_by(F.struct(*rest), "seq").alias("_change"))
    return picked.select(*key, "_change.*")


def _results(
    base: DataFrame,
    changes: DataFrame,
    key: Sequence[str],
    status: Column,
    buckets: int | None = None,
) -> DataFrame:
    """Result rows; ``status`` may use ``_present`` and ``_first`` next to the change."""
    wanted = changes.groupBy(*key).agg(F.min("seq").alias("_first_seq"))
    known = (
        beside(wanted, key, buckets)
        .join(base.select(*key, F.lit(True).alias("_present")), list(key), "left")
        .withColumn("_present", F.coalesce("_present", F.lit(False)))
    )
    return (
        lookup(changes, known, key, "inner")
        .withColumn("_first", F.col("seq") == F.col("_first_seq"))
        .select(*key, "seq", status.alias("status"))
    )


def _fill(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``; those the rows do not have are null."""
    return df.select(
        *[
            F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in like.schema.fields
        ]
    )


def create_if_absent(
    base: DataFrame,
    changes: DataFrame,
    key: Sequence[str] = ENTRY_KEY,
    buckets: int | None = None,
) -> Changed:
    """Insert rows whose key is new. A taken key, also by an earlier change, is a conflict."""
    changes, invalid = sort_out(by_lower_name(changes, key), key)
    new = beside(first_change(changes, key), key, buckets)
    if buckets:
        # An anti join would be moved below the reduction, and the base be shuffled to meet it.
        taken = base.select(*key, F.lit(True).alias("_taken"))
        new = new.join(taken, list(key), "left").where("_taken IS NULL").drop("_taken")
    else:
        new = new.join(base.select(*key), list(key), "left_anti")
    table = base.unionByName(_fill(new.withColumn("data", drop_nulls(or_empty("data"))), base))
    status = F.when(F.col("_present") | ~F.col("_first"), CONFLICT).otherwise("created")
    return Changed(table, _results(base, changes, key, status, buckets).unionByName(invalid))


def _with_change(
    base: DataFrame, changes: DataFrame, key: Sequence[str], buckets: int | None
) -> DataFrame:
    new = beside(first_change(changes, key), key, buckets).select(
        *key, F.col("data").alias("_new"), F.lit(True).alias("_matched")
    )
    return base.join(new, list(key), "left")


def replace_existing(
    base: DataFrame,
    changes: DataFrame,
    key: Sequence[str] = ENTRY_KEY,
    buckets: int | None = None,
) -> Changed:
    """Replace the whole data of rows that exist; an absent key is missing."""
    changes, invalid = sort_out(by_lower_name(changes, key), key)
    table = (
        _with_change(base, changes, key, buckets)
        .withColumn(
            "data",
            F.when(F.col("_matched"), drop_nulls(or_empty("_new"))).otherwise(F.col("data")),
        )
        .select(*base.columns)
    )
    status = (
        F.when(~F.col("_present"), "missing").when(~F.col("_first"), SKIPPED).otherwise("replaced")
    )
    return Changed(table, _results(base, changes, key, status, buckets).unionByName(invalid))


def merge_patch_existing(
    base: DataFrame,
    changes: DataFrame,
    key: Sequence[str] = ENTRY_KEY,
    buckets: int | None = None,
) -> Changed:
    """Merge a patch into rows that exist: values set, nulls remove, other keys stay."""
    changes, invalid = sort_out(by_lower_name(changes, key), key)
    table = (
        _with_change(base, changes, key, buckets)
        .withColumn(
            "data",
            F.when(F.size(or_empty("_new")) > 0, merge_patch("data", "_new")).otherwise(
                F.col("data")
            ),
        )
        .select(*base.columns)
    )
    status = (
        F.when(F.size(or_empty("data")) == 0, "noop")
        .when(~F.col("_present"), "missing")
        .when(~F.col("_first"), SKIPPED)
        .otherwise("patched")
    )
    return Changed(table, _results(base, changes, key, status, buckets).unionByName(invalid))


def upsert_labels(
    inventory: DataFrame, changes: DataFrame, insert: bool = True, buckets: int | None = None
) -> Changed:
    """Insert namespaces, or merge labels and annotations into those that exist.

    A null map leaves its side alone, and rows that no change names stay as they are; a null
    label value removes the label. Where labels are patched, the flat label columns follow the
    label map. Inserted rows have both maps. Without ``insert`` an absent namespace is missing.
    """
    key = ("namespace",)
    changes, invalid = sort_out(changes, key)
    new = beside(first_change(changes, key), key, buckets).select(
        "namespace",
        F.col("labels").alias("_labels"),
        F.col("annotations").alias("_annotations"),
    )
    how = "full_outer" if insert else "left"
    joined = inventory.withColumn("_old", F.lit(True)).join(new, list(key), how)
    patched = F.col("_labels").isNotNull()

    def side(name: str) -> Column:
        kept = F.when(F.col("_old"), F.col(name)).otherwise(or_empty(name))
        return F.when(F.col(f"_{name}").isNotNull(), merge_patch(name, f"_{name}")).otherwise(kept)

    merged = joined.withColumns({"labels": side("labels"), "annotations": side("annotations")})
    flat = {
        c: F.when(patched, F.col("labels")[label]).otherwise(F.col(c))
        for c, label in LABEL_COLUMNS.items()
        if c in inventory.columns
    }
    table = merged.withColumns(flat).select(*inventory.columns)
    nothing = F.col("labels").isNull() & F.col("annotations").isNull()
    status = (
        F.when(F.col("_present") & nothing, "noop")
        .when(~F.col("_present") & F.lit(not insert), "missing")
        .when(~F.col("_first"), SKIPPED)
        .when(F.col("_present"), "patched")
        .otherwise("created")
    )
    return Changed(table, _results(inventory, changes, key, status, buckets).unionByName(invalid))


def delete_if_present(
    base: DataFrame,
    keys: DataFrame,
    key: Sequence[str] = ENTRY_KEY,
    buckets: int | None = None,
) -> Changed:
    """Remove rows by key; an absent key is a success of its own kind.

    One result row per distinct key; a key with a null part is invalid.
    """
    wanted = beside(by_lower_name(keys, key).select(*key).distinct(), key, buckets)
    table = base.join(wanted, list(key), "left_anti")
    present = base.select(*key, F.lit(True).alias("_present"))
    results = wanted.join(present, list(key), "left").select(
        *key,
        F.when(~whole_key(key), INVALID)
        .when(F.col("_present"), "deleted")
        .otherwise("absent")
        .alias("status"),
    )
    return Changed(table, results)


def write_if_changed(
    base: DataFrame, incoming: DataFrame, key: Sequence[str], buckets: int | None = None
) -> DataFrame:
    """The merged table with the action per row: created, updated, unchanged or kept.

    Rows equal in every column are unchanged, so a sink may skip them; rows only in the
    base are kept. Both sides have one row per key.
    """
    values = [c for c in base.columns if c not in key]
    maps = {f.name for f in base.schema.fields if f.dataType.typeName() == "map"}

    def seen(side: str, c: str) -> Column:
        col = F.col(f"{side}.{c}")
        return comparable(col) if c in maps else col

    same = F.lit(True)
    for c in values:
        same = same & seen("_b", c).eqNullSafe(seen("_i", c))
    old = base.withColumn("_in_base", F.lit(True)).alias("_b")
    new = beside(incoming, key, buckets).withColumn("_in_new", F.lit(True)).alias("_i")
    joined = old.join(new, list(key), "full_outer")
    action = (
        F.when(F.col("_in_new").isNull(), "kept")
        .when(F.col("_in_base").isNull(), "created")
        .when(same, "unchanged")
        .otherwise("updated")
    )
    return joined.select(
        *key,
        *[
            F.when(F.col("_in_new"), F.col(f"_i.{c}")).otherwise(F.col(f"_b.{c}")).alias(c)
            for c in values
        ],
        action.alias("action"),
    )
