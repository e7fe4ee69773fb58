"""Sources and sinks."""

from sparkroster.sources.files import (
    files_as_entries,
    files_as_rows,
    resolve_file_fields,
    text_files_as_rows,
)
from sparkroster.sources.parquet import verify_written, write_parquet
from sparkroster.sources.partitions import change_partitions, create_partitioned
from sparkroster.sources.samples import SAMPLE_SCHEMA, sample_columns, sample_rows
from sparkroster.sources.stored import bucket_count, change_stored, keep_versions, store, versions

__all__ = [
    "SAMPLE_SCHEMA",
    "bucket_count",
    "change_partitions",
    "change_stored",
    "create_partitioned",
    "files_as_entries",
    "files_as_rows",
    "keep_versions",
    "resolve_file_fields",
    "sample_columns",
    "sample_rows",
    "store",
    "text_files_as_rows",
    "verify_written",
    "versions",
    "write_parquet",
]
