"""Files as rows and as entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkroster.functions import (
    encode,
    or_empty,
    path_base,
    path_dir,
    split_file_fields,
)
from sparkroster.schemas import ENTRY_KEY, empty_map


def _plain_path(c: Column) -> Column:
    return F.regexp_replace(c, "^file:/+", "/")


def _decoded(c: Column) -> Column:
    """A path from its form as a URI; a plus sign stands for itself there."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def files_as_rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, key, value) per file: its name as the key and its bytes as base64 text."""
    files = spark.read.format("binaryFile").load(paths)
    path = _plain_path(F.col("path"))
    return files.select(
        path.alias("path"), path_base(path).alias("key"), encode("content").alias("value")
    )


def files_as_entries(
    spark: SparkSession,
    paths: str | list[str],
    kind: str,
    namespace: str,
    name: str | Column | None = None,
) -> DataFrame:
    """Entries whose data maps file names to base64 text.

    All files are one entry called ``name``, or ``name`` is a column over ``path``, or each
    folder is an entry of its own name. The files of one entry become one map cell; for many
    or large files use :func:`files_as_rows`, which keeps one row per file. A missing path is
    an error; of equal file names in one entry the first in order of content is kept.
    """
    if name is None:
        name = path_base(path_dir(F.col("path")))
    entry = F.lit(name) if isinstance(name, str) else name
    files = files_as_rows(spark, paths).groupBy(entry.alias("name"), "key")
    return (
        files.agg(F.min("value").alias("value"))
        .groupBy("name")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("data"))
        .select(
            F.lit(kind).alias("kind"),
            F.lit(namespace).alias("namespace"),
            "name",
            empty_map().alias("labels"),
            "data",
        )
    )


def text_files_as_rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text) per file, the whole file as one UTF-8 string."""
    return spark.read.text(paths, wholetext=True).select(
        _decoded(_plain_path(F.col("_metadata.file_path"))).alias("path"), F.col("value").alias("text")
    )


def resolve_file_fields(
    entries: DataFrame, files: DataFrame, key: Sequence[str] = ENTRY_KEY
) -> DataFrame:
    """Entries with (literal, encoded, missing, status) from their ``file_X`` fields.

    ``files`` is the result of :func:`files_as_rows`. A field whose file is not there makes
    the entry ``missing_file`` and is listed. Lists here are as long as one entry's fields.
    """
    key = list(key)
    literal, by_file = split_file_fields(or_empty("data"))
    wanted = entries.select(*key, F.explode(by_file).alias("_field", "path"))
    found = wanted.join(files.select("path", "value"), "path", "left")
    pair = F.struct("_field", "value")
    there = F.col("value").isNotNull()
    per_entry = found.groupBy(*key).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.when(there, pair)))).alias("_encoded"),
        F.sort_array(F.collect_list(F.when(~there, F.col("_field")))).alias("_missing"),
    )
    missing = F.coalesce("_missing", F.array().cast("array<string>"))
    return entries.join(per_entry, key, "left").select(
        *key,
        literal.alias("literal"),
        or_empty("_encoded").alias("encoded"),
        missing.alias("missing"),
        F.when(F.size(missing) > 0, "missing_file").otherwise("ok").alias("status"),
    )
