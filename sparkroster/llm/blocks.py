"""Rows of one key side by side, with keys that hold many rows cut into pairs of slices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_hash, materialised
from .components import connected_components

#: A list of hot keys up to this length is sent to every task; a longer one is joined by a shuffle.
SMALL_LIST = 10_000


def in_blocks(rows: DataFrame, key: str, row_id: str, limit: int) -> DataFrame:
    """`rows` with `_block` and `_slice`, sorted by (key, _block) within partitions.

    A key with up to `limit` rows is one block. A larger one is dealt into slices of about `limit` rows, and
    each pair of slices is a block: every pair of its rows meets in a block, in one only if pairs within a
    slice are left to the blocks of that slice alone, and no block holds more than about 2 * limit rows.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    hot = materialised(counts.select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_slices")), "hot-keys")
    n_hot = hot.count()
    if not n_hot:
        dealt = rows.withColumns({"_slice": F.lit(0), "_block": F.lit(0).cast("long")})
    else:
        joined = rows.join(F.broadcast(hot) if n_hot <= SMALL_LIST else hot, key, "left")
        slices = F.coalesce("_slices", F.lit(1))
        dealt = joined.withColumn("_of", slices).withColumn("_slice", F.pmod(fold_hash(row_id), F.col("_of")).cast("int"))
        dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
        low, high = F.least("_slice", "_other"), F.greatest("_slice", "_other")
        dealt = dealt.withColumn("_block", low.cast("long") * F.col("_of") + high).drop("_other", "_of", "_slices")
    return dealt.repartition(key, "_block").sortWithinPartitions(key, "_block")


#: Rows of a hot key that every slice of it meets first.
EXAMPLES = 4


def linked_edges(rows: DataFrame, key: str, node: str, limit: int, compare: Callable[[DataFrame], DataFrame], weight: str | None = None, most: int = 1) -> DataFrame:
    """Edges `a, b` that connect the rows of a key as all links between them would. `compare` gives edges for
    rows sorted by (key, _block), links being looked for within a block alone.

    A key of up to `limit` rows, and up to `most` of `weight` in sum, is one block. A larger one is dealt into
    slices of about that size, each with the same `EXAMPLES` rows of the key: copies that resemble an example
    are linked by way of it, for the cost of one pass. Then only what is still apart is compared: the rows
    outside a key's largest component, in slices, with all rows of the key. So the work for a key grows with
    its rows times the rows that no chain of links ties to the rest, and no link is lost. `node` must be a
    long. `rows` is read several times.
    """
    slices = F.ceil(F.count("*") / limit)
    if weight:
        slices = F.greatest(slices, F.ceil(F.sum(weight) / most))
    examples = F.array_distinct(F.array(*[F.min(F.struct(fold_hash(F.lit(i), F.col(node)), node))[node] for i in range(EXAMPLES)]))
    hot = rows.groupBy(key).agg(slices.cast("int").alias("_of"), examples.alias("_examples")).where("_of > 1")
    hot = materialised(hot, "hot-keys")
    n_hot = hot.count()
    plain = {"_slice": F.lit(0), "_block": F.lit(0).cast("long")}
    if not n_hot:
        return compare(_sorted(rows.withColumns(plain), key))
    listed = F.broadcast(hot) if n_hot <= SMALL_LIST else hot
    cold = rows.join(listed, key, "left_anti")
    dealt = rows.join(listed, key).withColumn("_slice", F.pmod(fold_hash(node), F.col("_of")).cast("int"))
    every = F.sequence(F.lit(0), F.col("_of") - 1)
    blocks = F.when(F.array_contains("_examples", F.col(node)), every).otherwise(F.array("_slice"))
    first = dealt.withColumn("_at", F.explode(blocks)).withColumn("_block", F.col("_at").cast("long")).select(*cold.columns, "_slice", "_block")
    edges = materialised(compare(_sorted(cold.withColumns(plain).unionByName(first), key)), "first-edges")
    parts = connected_components(edges).select(F.col("node").alias(node), F.col("root").alias("_part"))
    placed = dealt.drop("_examples").join(parts, node, "left").withColumn("_part", F.coalesce("_part", node))
    placed = materialised(placed, "placed")
    sizes = placed.groupBy(key, "_part").agg(F.count("*").alias("_n"), *([F.sum(weight).alias("_w")] if weight else []))
    whole = sizes.groupBy(key).agg(F.max(F.struct("_n", "_part"))["_part"].alias("_main"), F.count("*").alias("_parts"))
    apart = sizes.join(whole.where("_parts > 1"), key).where("_part != _main").groupBy(key, "_main")
    rest_slices = F.ceil(F.sum("_n") / limit)
    if weight:
        rest_slices = F.greatest(rest_slices, F.ceil(F.sum("_w") / most))
    apart = materialised(apart.agg(rest_slices.cast("int").alias("_rest")), "apart")
    n_apart = apart.count()
    if not n_apart:
        return edges
    again = placed.join(F.broadcast(apart) if n_apart <= SMALL_LIST else apart, key)
    others = again.withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("_rest") - 1))).withColumn("_block", F.col("_at").cast("long") * F.col("_of") + F.col("_slice"))
    own = F.pmod(fold_hash(F.lit("rest"), F.col(node)), F.col("_rest"))
    rest = again.where("_part != _main").withColumn("_at", F.explode(every)).withColumn("_block", own * F.col("_of") + F.col("_at"))
    columns = [*cold.columns, "_slice", "_block"]
    return edges.unionByName(compare(_sorted(others.select(columns).unionByName(rest.select(columns)), key)))


def _sorted(rows: DataFrame, key: str) -> DataFrame:
    return rows.repartition(key, "_block").sortWithinPartitions(key, "_block")


def whole_runs(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], size: int = 1 << 16) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches put together so that rows alike in `columns` come at once, and the number of each row's
    run. A piece has about `size` rows, or one run."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < size:
            continue
        rows = pa.Table.from_batches(held)
        run = _runs(rows, columns)
        last = int(np.searchsorted(run, run[-1]))
        if last:
            yield rows.slice(0, last), run[:last]
        held = rows.slice(last).to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        yield rows, _runs(rows, columns)


def _runs(rows: pa.Table, columns: tuple[str, ...]) -> np.ndarray:
    changed = np.zeros(rows.num_rows, bool)
    for name in columns:
        values = rows[name].to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    return np.cumsum(changed)


def roots_of(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The forest `parent` (each row's root) with the rows of `a` and `b` joined, smallest row as root."""
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        if not len(a):
            break
        parent = parent.copy()
        np.minimum.at(parent, b, a)
        parent = roots_of(parent)
    return parent
