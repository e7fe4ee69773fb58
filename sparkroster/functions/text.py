"""Column functions for previews and time text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkroster.constants import ELLIPSIS, NOT_AVAILABLE
from sparkroster.functions.names import _col


def preview(c: Column | str, limit: int, keep: int) -> Column:
    """Text longer than ``limit`` becomes its first ``keep`` characters and dots."""
    c = _col(c)
    return F.when(
        F.length(c) > limit, F.concat(F.substring(c, 1, keep), F.lit(ELLIPSIS))
    ).otherwise(c)


def iso_time(c: Column | str, default: str | None = NOT_AVAILABLE) -> Column:
    """ISO-8601 text with offset; microseconds are written only when there are any."""
    c = _col(c)
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssxxx")
    fine = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    text = F.when(c == F.date_trunc("second", c), whole).otherwise(fine)
    return F.coalesce(F.when(c.isNotNull(), text), F.lit(default).cast("string"))
