"""Operators: functions from DataFrames to DataFrames."""

from sparkroster.operators.cascade import drop_projects, rename_projects
from sparkroster.operators.change import (
    Changed,
    create_if_absent,
    delete_if_present,
    merge_patch_existing,
    replace_existing,
    upsert_labels,
    write_if_changed,
)
from sparkroster.operators.changelog import apply_changes
from sparkroster.operators.create import create_environments, create_projects
from sparkroster.operators.narrow import narrowed, possibly_in
from sparkroster.operators.report import (
    apply_counts,
    apply_tally,
    environments_text,
    failed_rows,
    project_counts,
    project_environment_rows,
    project_environments,
    project_summary,
)
from sparkroster.operators.resolve import (
    check_delete_targets,
    check_parents,
    inconsistent_names,
    inconsistent_pairs,
    name_owner,
    only_named,
    resolve_environments,
    resolve_names,
)
from sparkroster.operators.runs import (
    classify_exit,
    error_details,
    flatten_status,
    run_outcomes,
    tail_lines,
)
from sparkroster.operators.select import (
    describe_entry,
    label_select,
    list_entries,
    scope_filter,
)
from sparkroster.operators.upkeep import (
    added_up,
    as_inventory,
    merged_state,
    refreshed,
    report_state,
    state_change,
)

__all__ = [
    "Changed",
    "added_up",
    "apply_changes",
    "apply_counts",
    "apply_tally",
    "as_inventory",
    "check_delete_targets",
    "check_parents",
    "classify_exit",
    "create_environments",
    "create_if_absent",
    "create_projects",
    "delete_if_present",
    "describe_entry",
    "drop_projects",
    "environments_text",
    "error_details",
    "failed_rows",
    "flatten_status",
    "inconsistent_names",
    "inconsistent_pairs",
    "label_select",
    "list_entries",
    "merge_patch_existing",
    "merged_state",
    "name_owner",
    "narrowed",
    "only_named",
    "possibly_in",
    "project_counts",
    "project_environment_rows",
    "project_environments",
    "project_summary",
    "refreshed",
    "rename_projects",
    "replace_existing",
    "report_state",
    "resolve_environments",
    "resolve_names",
    "run_outcomes",
    "scope_filter",
    "state_change",
    "tail_lines",
    "upsert_labels",
    "write_if_changed",
]
