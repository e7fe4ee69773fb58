"""Ordered change logs: many changes of mixed kinds per key, in ``seq`` order.

Whether a change applies depends only on whether its key exists just before it, and that
is set by the last create, upsert or delete before it. What a field holds in the end is
its last applied write, unless a later create, replace or delete wiped the row. Both are
reductions, so the log of one key never has to meet in one task:

* the log of a key that holds more than its share of all changes is cut at quantiles of its
  ``seq`` values, dense or not; a window inside a piece finds the last existence-setting
  change, and a window over the few piece summaries of a key carries it from piece to piece;
* everything else is an aggregate that is combined before its shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkroster.functions import drop_nulls, merge_patch, or_empty
from sparkroster.operators.change import Changed, by_lower_name, whole_key
from sparkroster.operators.skew import default_shares, hot_keys
from sparkroster.schemas import ENTRY_KEY

MOST_PIECES = 1000


def apply_changes(
    base: DataFrame,
    changes: DataFrame,
    key: Sequence[str] = ENTRY_KEY,
    shares: int | None = None,
) -> Changed:
    """The table after the whole log, and per key (applied, rejected, noop, invalid, present).

    ``seq`` is unique within a key. A create of a present key and a replace or patch of an
    absent one are rejected; a delete of an absent key and an empty patch are noop. Changes
    with a null ``seq`` or key part are invalid: they change nothing and are counted, the
    latter under the key as it is. A piece holds about one ``shares``-th of all changes (as
    many shares as shuffle partitions by default), a thousandth of its key's at least.
    """
    key = list(key)
    sets_present = (
        F.when(F.col("op").isin("create", "upsert"), True).when(F.col("op") == "delete", False)
    )
    named = by_lower_name(changes, key).select(*key, "seq", "op", "data")
    whole = whole_key(key) & F.col("seq").isNotNull()
    invalid = named.where(~whole).groupBy(*key).agg(F.count("*").alias("_invalid"))
    log = _in_pieces(named.where(whole), key, shares).withColumn("_sets", sets_present)
    before = (
        Window.partitionBy(*key, "_piece").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    )
    pieces_before = (
        Window.partitionBy(*key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    )
    in_base = base.select(*key, F.lit(True).alias("_in_base"))
    carried = (
        log.groupBy(*key, "_piece")
        .agg(F.max_by("_sets", F.when(F.col("_sets").isNotNull(), F.col("seq"))).alias("_last"))
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(pieces_before))
        .join(in_base, key, "left")
        .select(
            *key,
            "_piece",
            F.coalesce("_carry", "_in_base", F.lit(False)).alias("_carry"),
        )
    )
    judged = (
        log.withColumn("_prior", F.last("_sets", ignorenulls=True).over(before))
        .join(carried, [*key, "_piece"])
        .withColumn("_there", F.coalesce("_prior", "_carry"))
        .withColumn("_outcome", _outcome())
    )

    resets = F.when(
        ((F.col("_outcome") == "applied") & F.col("op").isin("create", "replace"))
        | (F.col("op") == "delete"),
        F.col("seq"),
    )
    per_key = judged.groupBy(*key).agg(
        F.count_if(F.col("_outcome") == "applied").alias("applied"),
        F.count_if(F.col("_outcome") == "rejected").alias("rejected"),
        F.count_if(F.col("_outcome") == "noop").alias("noop"),
        F.max(resets).alias("_reset"),
        F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("_deleted"),
        F.max_by("_sets", F.when(F.col("_sets").isNotNull(), F.col("seq"))).alias("_after"),
    )
    fields = (
        judged.where((F.col("_outcome") == "applied") & (F.col("op") != "delete"))
        .select(*key, "seq", F.explode(or_empty("data")).alias("_field", "_value"))
        .groupBy(*key, "_field")
        .agg(F.max("seq").alias("_at"), F.max_by("_value", "seq").alias("_value"))
    )
    # Fields wiped by a later reset stop at this join, before anything is collected.
    alive = F.col("_reset").isNull() | (F.col("_at") >= F.col("_reset"))
    states = ["_reset", "_deleted", "_after"]
    left, right = per_key.select(*key, *states).alias("_k"), fields.alias("_f")
    same_key = [F.col(f"_k.{k}") == F.col(f"_f.{k}") for k in key]
    on = alive
    for test in same_key:
        on = on & test
    pair = F.struct("_field", "_value")
    state = (
        left.join(right, on, "left")
        .groupBy(*[F.col(f"_k.{k}").alias(k) for k in key], *states)
        .agg(
            F.map_from_entries(
                F.sort_array(F.collect_list(F.when(F.col("_field").isNotNull(), pair)))
            ).alias("_written")
        )
        .withColumn("_touched", F.lit(True))
    )
    present = F.coalesce("_after", "_in_base", F.lit(False))
    folded = base.withColumn("_in_base", F.lit(True)).join(state, key, "full_outer")
    data = (
        F.when(F.col("_touched").isNull(), F.col("data"))
        .when(F.col("_reset").isNotNull(), drop_nulls(or_empty("_written")))
        .otherwise(merge_patch("data", "_written"))
    )
    rest = {}
    for c in base.columns:
        if c not in (*key, "data"):
            rest[c] = F.when(F.col("_deleted").isNull(), F.col(c))
    table = (
        folded.where(present).withColumns({"data": data, **rest}).select(*base.columns)
    )
    same_keys = F.lit(True)
    for k in key:
        same_keys = same_keys & F.col(f"_p.{k}").eqNullSafe(F.col(f"_i.{k}"))
    judged_keys = per_key.alias("_p").join(invalid.alias("_i"), same_keys, "full_outer")
    results = (
        judged_keys.select(
            *[F.coalesce(f"_p.{k}", f"_i.{k}").alias(k) for k in key],
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("applied", "rejected", "noop")],
            F.coalesce("_invalid", F.lit(0)).alias("invalid"),
            "_after",
        )
        .join(in_base, key, "left")
        .select(
            *key, "applied", "rejected", "noop", "invalid", present.alias("present")
        )
    )
    return Changed(table, results)


def _in_pieces(log: DataFrame, key: list[str], shares: int | None) -> DataFrame:
    """The log with ``_piece``: 0, or for a hot key how many of its cuts lie below ``seq``.

    The hot keys and all their cuts are fewer than twice ``shares`` values, so they are sent to
    every task.
    """
    shares = shares or default_shares(log)
    marks = F.broadcast(hot_keys(log, key, shares))
    grid = [i / MOST_PIECES for i in range(1, MOST_PIECES)]
    spread = F.percentile_approx("seq", grid, 10 * MOST_PIECES)
    quantiles = log.select(*key, "seq").join(marks, key).groupBy(*key, "_parts").agg(
        spread.alias("_grid")
    )
    at = F.expr(
        f"transform(sequence(1, least(_parts, {MOST_PIECES}) - 1), "
        f"i -> element_at(_grid, cast(floor(i * {MOST_PIECES} / least(_parts, {MOST_PIECES})) AS int)))"
    )
    cuts = quantiles.select(*key, at.alias("_cuts"))
    below = F.size(F.filter("_cuts", lambda cut: cut < F.col("seq")))
    return (
        log.join(F.broadcast(cuts), key, "left")
        .withColumn("_piece", F.when(F.col("_cuts").isNull(), 0).otherwise(below))
        .drop("_cuts")
    )


def _outcome():
    op, there = F.col("op"), F.col("_there")
    empty = F.size(or_empty("data")) == 0
    return (
        F.when((op == "create") & there, "rejected")
        .when((op == "patch") & empty, "noop")
        .when(op.isin("replace", "patch") & ~there, "rejected")
        .when((op == "upsert") & there & empty, "noop")
        .when((op == "delete") & ~there, "noop")
        .otherwise("applied")
    )
