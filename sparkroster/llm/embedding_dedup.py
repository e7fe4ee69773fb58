"""Near-duplicates among vectors by collision counting: vectors are sorted along many one-dimensional
projections, a pair's collisions are the windows around one vector that hold the other, and pairs with enough of
them are verified in double precision.

The windows alone cannot find the candidates of a large table: at cosine 0.95 in 64 dimensions a window that holds
a near pair on 85 of 100 lines holds a quarter of all other pairs too. So vectors first share a cell of random signs
in one of several tables (13 tables at 10^4 vectors, 29 at 10^6, 92 at 10^9), which is what narrows the search; within
a cell the windows of 24 lines decide which pairs are verified."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import in_blocks, unite, whole_runs
from .common import materialised
from .components import connected_components

CELL_ROWS = 256
BLOCK_ROWS = 2048
PROJECTIONS = 24
WIDTH = 3.0
MISSED = 1e-4
SEED = 7


def least_count(n: int = PROJECTIONS, width: float = WIDTH, missed: float = MISSED) -> int:
    """The most collisions that a pair just at the threshold reaches in all but `missed` of the cases. On a
    random line its two places differ by a normal value, and a window is `width` of its deviations wide on
    either side."""
    p = math.erf(width / math.sqrt(2))
    tail = 0.0
    for count in range(n + 1):
        tail += math.comb(n, count) * p**count * (1 - p) ** (n - count)
        if tail > missed:
            return count
    return n


def table_plan(n_rows: int, cosine: float, missed: float = MISSED) -> tuple[int, int]:
    """Signs in a cell key and number of tables. Cells are to hold about `CELL_ROWS` of evenly spread vectors;
    a pair at the threshold is in no common cell of any table with the probability `missed`."""
    signs = max(0, math.ceil(math.log2(max(1, n_rows) / CELL_ROWS)))
    if not signs:
        return 0, 1
    same = (1 - math.acos(min(1.0, cosine)) / math.pi) ** signs
    return signs, max(1, math.ceil(math.log(missed) / math.log(1 - same)))


@lru_cache(maxsize=4)
def lines(dim: int, count: int, stream: int) -> np.ndarray:
    """Directions of random lines, as columns; the same wherever they are made."""
    return np.random.default_rng((SEED, stream, dim)).standard_normal((dim, count)).astype(np.float32)


def cell_keys(vectors: np.ndarray, signs: int, tables: int) -> np.ndarray:
    """The cell of each vector in each table: the signs of its places on the table's lines."""
    if not signs:
        return np.zeros((len(vectors), 1), np.int64)
    above = (vectors.astype(np.float32) @ lines(vectors.shape[1], signs * tables, 0) > 0).reshape(len(vectors), tables, signs)
    return above @ (1 << np.arange(signs, dtype=np.int64))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def window_collisions(places: np.ndarray, queries: np.ndarray, half: float) -> np.ndarray:
    """How often each row stands in the window around each query, over all lines: on a line the rows are
    sorted, the window of a query is a range of them, and ranges are summed as a running difference."""
    n, m = len(places), len(queries)
    counts = np.zeros((m, n), np.int16)
    for line in range(places.shape[1]):
        order = np.argsort(places[:, line], kind="stable")
        sorted_ = places[order, line]
        low = np.searchsorted(sorted_, places[queries, line] - half, side="left")
        high = np.searchsorted(sorted_, places[queries, line] + half, side="right")
        marks = np.zeros((m, n + 1), np.int8)
        marks[np.arange(m), low] += 1
        marks[np.arange(m), high] -= 1
        counts[:, order] += np.cumsum(marks[:, :-1], axis=1, dtype=np.int8)
    return counts


def links_in_block(vectors: np.ndarray, slices: np.ndarray, keys: np.ndarray, table: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with at least `cosine`, each in the first table that has both in one cell. In a block of
    two slices a pair is of either slice; pairs within a slice are for the slice's own block."""
    n = len(vectors)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    two = slices[0] != slices[-1] or (slices != slices[0]).any()
    double = vectors.astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", double, double))
    unit = double / norms[:, None]
    places = unit.astype(np.float32) @ lines(vectors.shape[1], PROJECTIONS, 1)
    half, least = WIDTH * math.sqrt(max(0.0, 2 - 2 * cosine)), least_count()
    for first in range(0, n, 256):
        queries = np.arange(first, min(n, first + 256))
        q, r = np.nonzero(window_collisions(places, queries, half) >= least)
        q = q + first
        keep = (q < r) & ((slices[q] != slices[r]) if two else True)
        q, r = q[keep], r[keep]
        if table and len(q):
            keep = ~(keys[q, :table] == keys[r, :table]).any(axis=1)
            q, r = q[keep], r[keep]
        for at in range(0, len(q), 1 << 16):
            a, b = q[at : at + (1 << 16)], r[at : at + (1 << 16)]
            near = np.einsum("ij,ij->i", double[a], double[b]) / (norms[a] * norms[b]) >= cosine
            found.append((a[near], b[near]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _usable(vector: Column) -> Column:
    """Has components, none null or not finite, and not all zero."""
    infinite = (float("inf"), float("-inf"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & ~x.isin(*infinite)
    return F.coalesce(F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


def linked_vectors(vectors: DataFrame, cosine: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Counts of links and links, among distinct vectors `node, embedding, copies` of one length each.

    The first has `node, n` with one row or more for a node, to be summed: each link counts the copies of the
    other side. The second has `a, b`, enough links to connect what is connected.
    """
    n_rows = vectors.count()
    signs, tables = table_plan(n_rows, cosine)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                rows = batch.filter(pa.array(sizes == size))
                keys = cell_keys(_matrix(rows.column("embedding")), signs, tables)
                for t in range(keys.shape[1]):
                    key = (np.int64(size) << 48) ^ (np.int64(t) << 40 if signs < 40 else 0) ^ keys[:, t]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), t, np.int32)), *rows.columns], names=["key", "table", *rows.schema.names])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, run in whole_runs(batches, ("key", "table", "_block"), 1 << 13):
            bounds = np.r_[np.flatnonzero(np.r_[True, run[1:] != run[:-1]]), len(run)]
            size = np.diff(bounds)
            out: list[list[np.ndarray]] = [[], [], []]
            for a, n in zip(bounds[:-1][size > 1].tolist(), size[size > 1].tolist(), strict=True):
                part = rows.slice(a, n)
                matrix = _matrix(part["embedding"])
                keys, table = cell_keys(matrix, signs, tables), int(part["table"][0].as_py())
                q, r = links_in_block(matrix, part["_slice"].to_numpy(), keys, table, cosine)
                node, copies = part["node"].to_numpy(), part["copies"].to_numpy()
                counts = np.bincount(q, copies[r], n) + np.bincount(r, copies[q], n)
                parent = unite(np.arange(n), q, r)
                has = np.flatnonzero(counts)
                out[0].append(node[has])
                out[1].append(counts[has].astype(np.int64))
                out[2].append(node[parent[has]])
            columns = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in out]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "root"])

    cells = vectors.select("node", "embedding", "copies").mapInArrow(keyed, "key long, table int, node long, embedding array<float>, copies long")
    blocks = in_blocks(cells, "key", "node", BLOCK_ROWS)
    found = materialised(blocks.mapInArrow(linked, "node long, n long, root long"), "vector-links")
    return found.select("node", "n"), found.select(F.col("node").alias("a"), F.col("root").alias("b"))


def near_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """`vec_id, n_links, component_id, kept` for every row of `vectors(vec_id, embedding, ...)`.

    Rows of equal vectors are worked on once and count as links of each other. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing, nor do vectors of different lengths;
    their component is their own id. A row with a null id counts as a link of others, has the smallest
    other id of its component, and is never kept; repeated ids keep a row each. Other columns are ignored.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")).withColumn("_fine", _usable(F.col("embedding")))
    groups = rows.where("_fine").groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    groups = materialised(groups.withColumn("node", F.monotonically_increasing_id()), "vectors")
    counts, edges = linked_vectors(groups, cosine)
    links = counts.groupBy("node").agg(F.sum("n").alias("n"))
    roots = connected_components(edges)
    rooted = groups.join(links, "node", "left").join(roots, "node", "left")
    rooted = rooted.select("embedding", "first", F.coalesce("root", "node").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = rooted.join(lowest, "root").select("embedding", "n_links", "component_id")
    linked = rows.where("_fine").join(labels, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT _fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
