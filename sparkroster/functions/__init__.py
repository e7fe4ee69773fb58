"""Column functions: everything here is a native Spark expression."""

from sparkroster.functions.maps import (
    comparable,
    decode_values,
    drop_nulls,
    encode,
    encode_values,
    env_collisions,
    merge_params,
    merge_patch,
    or_empty,
    params_as_args,
    params_as_env,
    params_by_prefix,
    split_file_fields,
    stringify_map,
)
from sparkroster.functions.names import (
    branch_name,
    entry_name,
    is_bad_name,
    new_id,
    path_base,
    path_dir,
    physical_name,
    repo_name,
    run_name,
    sanitize_name,
    strip_first,
)
from sparkroster.functions.text import iso_time, preview

__all__ = [
    "branch_name",
    "comparable",
    "decode_values",
    "drop_nulls",
    "encode",
    "encode_values",
    "entry_name",
    "env_collisions",
    "is_bad_name",
    "iso_time",
    "merge_params",
    "merge_patch",
    "new_id",
    "or_empty",
    "params_as_args",
    "params_as_env",
    "params_by_prefix",
    "path_base",
    "path_dir",
    "physical_name",
    "preview",
    "repo_name",
    "run_name",
    "sanitize_name",
    "split_file_fields",
    "stringify_map",
    "strip_first",
]
