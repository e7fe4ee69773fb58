"""Column functions that build and clean names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkroster.constants import (
    EMPTY_ENVIRONMENT,
    ID_HEX_DIGITS,
    ID_PREFIX,
    NAME_LIMIT,
    REPO_PREFIX,
    RUN_PREFIX,
    RUN_SUFFIX_DIGITS,
)

# Fixed value: runs of anything else become one dash.
NAME_PATTERN = "[^a-z0-9-]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _dashed(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, NAME_PATTERN, "-"), F.lit("-"))


def sanitize_name(c: Column | str, strict: bool = False) -> Column:
    """Lower-case name of letters, digits and dashes, at most 63 characters.

    The cut comes after the dashes are stripped, so a cut name may end in a dash.
    A name with nothing left is null, or an error when ``strict``.
    """
    c = _col(c)
    name = F.nullif(F.substring(_dashed(F.lower(c)), 1, NAME_LIMIT), F.lit(""))
    if strict:
        message = F.concat(F.lit("name has no usable characters: "), c)
        return F.coalesce(name, F.when(c.isNotNull(), F.raise_error(message)))
    return name


def is_bad_name(given: Column | str, sanitized: Column | str) -> Column:
    """True where :func:`sanitize_name` found nothing to keep of a given name."""
    return _col(given).isNotNull() & _col(sanitized).isNull()


def physical_name(project_id: Column | str, environment: Column | str) -> Column:
    """Namespace of one environment of one project; the environment keeps its case rules."""
    env = _dashed(F.coalesce(_col(environment), F.lit("")))
    env = F.when(env == "", F.lit(EMPTY_ENVIRONMENT)).otherwise(env)
    return F.substring(F.concat(_col(project_id), F.lit("-"), env), 1, NAME_LIMIT)


def repo_name(c: Column | str, prefix: str = REPO_PREFIX) -> Column:
    """Repository name of a project; no length limit."""
    return F.concat(F.lit(prefix), _dashed(F.lower(_col(c))))


def branch_name(c: Column | str) -> Column:
    """Branch name of an environment; no length limit."""
    return _dashed(F.lower(_col(c)))


def entry_name(c: Column | str, prefix: str = "") -> Column:
    """Stored name of a saved entry: prefix and sanitised name."""
    return F.concat(F.lit(prefix), sanitize_name(c))


def run_name(c: Column | str, suffix: Column | None = None, prefix: str = RUN_PREFIX) -> Column:
    """Name of one execution: prefix, lower-case name, random or given suffix, cut at 63."""
    if suffix is None:
        suffix = F.substring(F.translate(F.uuid(), "-", ""), 1, RUN_SUFFIX_DIGITS)
    body = F.translate(F.lower(_col(c)), "_", "-")
    return F.substring(F.concat(F.lit(prefix), body, F.lit("-"), suffix), 1, NAME_LIMIT)


def new_id(
    seed: Column | str | None = None, prefix: str = ID_PREFIX, n: int = ID_HEX_DIGITS
) -> Column:
    """Prefix and ``n`` hex digits: random, or the same every time for the same seed.

    Use the seeded form wherever a stage may be run again after a lost executor.
    """
    if seed is None:
        digits = F.translate(F.uuid(), "-", "")
    else:
        digits = F.sha2(_col(seed).cast("string").cast("binary"), 256)
    return F.concat(F.lit(prefix), F.substring(digits, 1, n))


def strip_first(c: Column | str, text: str) -> Column:
    """Remove the first occurrence of ``text``, wherever it is."""
    c = _col(c)
    at = F.instr(c, text)
    head = F.substring(c, F.lit(1), at - 1)
    tail = F.substring(c, at + len(text), F.length(c))
    return F.when(at > 0, F.concat(head, tail)).otherwise(c)


def path_base(c: Column | str) -> Column:
    """Part of a path after its last slash."""
    return F.substring_index(_col(c), "/", -1)


def path_dir(c: Column | str) -> Column:
    """Part of a path before its last slash; the root stays the root."""
    c = _col(c)
    head = F.substring(c, F.lit(1), F.length(c) - F.length(path_base(c)))
    trimmed = F.rtrim(head, F.lit("/"))
    return F.when(trimmed == "", head).otherwise(trimmed)
