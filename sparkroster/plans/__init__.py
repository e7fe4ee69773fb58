"""Saved, parameterised queries."""

from sparkroster.plans.saved import (
    bind_params,
    check_definitions,
    config_values,
    definitions_as_entries,
    definitions_from_entries,
    resolve_params,
    run_and_write,
    run_saved_query,
)

__all__ = [
    "bind_params",
    "check_definitions",
    "config_values",
    "definitions_as_entries",
    "definitions_from_entries",
    "resolve_params",
    "run_and_write",
    "run_saved_query",
]
