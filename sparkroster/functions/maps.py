"""Column functions over map<string,string> values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkroster.constants import ENV_PARAM_PREFIX, FILE_FIELD_PREFIX
from sparkroster.functions.names import _col
from sparkroster.schemas import empty_map


def or_empty(c: Column | str) -> Column:
    """A null map counts as an empty one."""
    return F.coalesce(_col(c), empty_map())


def drop_nulls(c: Column | str) -> Column:
    """The map without its null values."""
    return F.map_filter(_col(c), lambda _, v: v.isNotNull())


def encode(c: Column | str) -> Column:
    """Base64 text in one line; Spark's own encoder breaks lines every 76 characters."""
    return F.replace(F.base64(_col(c).cast("binary")), F.lit("\r\n"), F.lit(""))


def split_file_fields(c: Column | str, prefix: str = FILE_FIELD_PREFIX) -> tuple[Column, Column]:
    """(literal fields, file fields): ``file_X`` holds the path of the file behind ``X``.

    The bare prefix names nothing and is left out.
    """
    c = _col(c)
    literal = F.map_filter(c, lambda k, _: ~k.startswith(prefix))
    files = F.map_filter(c, lambda k, _: k.startswith(prefix) & (k != prefix))
    return literal, F.transform_keys(files, lambda k, _: F.substring(k, len(prefix) + 1, 2**31 - 1))


def encode_values(c: Column | str) -> Column:
    """Base64 of every value."""
    return F.transform_values(_col(c), lambda _, v: encode(v))


def decode_values(c: Column | str, strict: bool = True) -> Column:
    """Text behind every base64 value; bad UTF-8 is an error, or null when not ``strict``."""
    check = F.validate_utf8 if strict else F.try_validate_utf8
    return F.transform_values(
        or_empty(c), lambda _, v: check(F.unbase64(v).cast("string"))
    )


def merge_params(from_config: Column | str, inline: Column | str) -> Column:
    """Union of two parameter maps; the inline value wins for a shared key."""
    base, over = or_empty(from_config), or_empty(inline)
    return F.map_zip_with(
        base, over, lambda k, x, y: F.when(F.map_contains_key(over, k), y).otherwise(x)
    )


def params_by_prefix(c: Column | str, prefix: str = "") -> Column:
    """Entries whose key has the prefix, under the key without it."""
    if not prefix:
        return or_empty(c)
    kept = F.map_filter(or_empty(c), lambda k, _: k.startswith(prefix))
    return F.transform_keys(kept, lambda k, _: F.substring(k, len(prefix) + 1, 2**31 - 1))


def params_as_args(c: Column | str) -> Column:
    """``--key value`` pairs as one flat array, in the order of the map."""
    pairs = F.transform(
        F.map_entries(or_empty(c)),
        lambda e: F.array(F.concat(F.lit("--"), e["key"]), e["value"]),
    )
    return F.flatten(pairs)


def params_as_env(c: Column | str) -> Column:
    """Environment variables as array<struct<name,value>>, in the order of the map.

    An array, because two keys may agree once upper-cased; see :func:`env_collisions`.
    """
    return F.transform(
        F.map_entries(or_empty(c)),
        lambda e: F.struct(
            F.concat(F.lit(ENV_PARAM_PREFIX), F.upper(e["key"])).alias("name"),
            e["value"].alias("value"),
        ),
    )


def env_collisions(c: Column | str) -> Column:
    """Variable names that more than one key of the map would set, sorted."""
    names = F.transform(params_as_env(c), lambda e: e["name"])
    shared = F.filter(
        F.array_distinct(names), lambda n: F.size(F.filter(names, lambda m: m == n)) > 1
    )
    return F.sort_array(shared)


def stringify_map(columns: dict[str, Column]) -> Column:
    """Map of column values as text; null columns give no entry."""
    keys = F.array(*[F.lit(name) for name in columns])
    values = F.array(*[c.cast("string") for c in columns.values()])
    return drop_nulls(F.map_from_arrays(keys, values))


def comparable(c: Column | str) -> Column:
    """A sorted entry array, because maps have no equality in Spark."""
    return F.sort_array(F.map_entries(_col(c)))


def merge_patch(old: Column | str, patch: Column | str) -> Column:
    """Non-null values set, null values remove, other keys stay."""
    old, patch = or_empty(old), or_empty(patch)
    merged = F.map_zip_with(
        old, patch, lambda k, x, y: F.when(F.map_contains_key(patch, k), y).otherwise(x)
    )
    return drop_nulls(merged)
