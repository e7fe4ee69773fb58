"""Texts whose sets of word shingles are alike: MinHash bands give candidates, the sets themselves decide."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import linked_edges, unite, whole_runs
from .common import materialised, text_chunks
from .components import connected_components
from .simhash_dedup import SEED, fingerprint_of, shingles_of
from .workers import held, thrifty

WORDS = 5
# A similarity of 4 / 5 or more; whole numbers, so that the test is exact.
SHARE, OF = 4, 5
# A pair just at the similarity shares none of the bands with probability 5e-5 ((1 - 0.8^5)^25), and differs in
# more bits of its sketch with 5e-6.
BAND_ROWS, BANDS = 5, 25
SKETCH_BITS, MAX_BITS = 128, 30
HASHES_AT_ONCE = 1 << 12
BLOCK_ROWS = 4096
SET_ROWS = 512
SET_SHINGLES = 1 << 18
COLUMNS = 4096


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    source = np.random.default_rng(SEED)
    return source.integers(0, 1 << 63, SKETCH_BITS, np.uint64) << np.uint64(1) | np.uint64(1), source.integers(0, 1 << 63, SKETCH_BITS, np.uint64)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ values >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return (values ^ values >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def sketch_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A bit of each of 128 MinHashes of the text's shingles as two numbers, and the keys of its bands (none
    for a text without words)."""
    times, plus = _permutations()
    least = np.full(SKETCH_BITS, np.iinfo(np.uint64).max)
    empty = True
    for hashes in shingles_of(text, WORDS):
        empty = False
        for at in range(0, len(hashes), HASHES_AT_ONCE):
            least = np.minimum(least, (hashes[at : at + HASHES_AT_ONCE, None] * times + plus).min(axis=0))
    if empty:
        return np.zeros(2, np.int64), np.empty(0, np.int64)
    bits = np.packbits(_mixed(least) >> np.uint64(63) > 0, bitorder="little").view("<i8")
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).T:
        keys = _mixed(keys ^ column)
    return bits, keys.view(np.int64)


MARK = T.StructType([T.StructField(n, T.LongType()) for n in ("words_high", "words_low", "print", "low", "high")] + [T.StructField("keys", T.ArrayType(T.LongType()))])


@F.arrow_udf(MARK)
@thrifty
def _marks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    from xxhash import xxh3_128_digest

    held("near copies")
    for texts in batches:
        words, prints, sketches, keys = [], [], [], []
        for chunk in text_chunks(texts):
            for text in chunk.to_pylist():
                words.append(xxh3_128_digest(b" ".join(text.encode().lower().split()), SEED))
                prints.append(fingerprint_of(text))
                bits, bands = sketch_of(text)
                sketches.append(bits)
                keys.append(bands)
        both = np.array(sketches, np.int64).reshape(-1, 2)
        ends = np.cumsum([0, *map(len, keys)])
        bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
        halves = np.frombuffer(b"".join(words), "<i8").reshape(-1, 2)
        of_prints = np.array(prints, np.uint64).view(np.int64)
        columns = [pa.array(c.copy()) for c in (halves[:, 0], halves[:, 1], of_prints, both[:, 0], both[:, 1])]
        yield pa.StructArray.from_arrays([*columns, bands], [f.name for f in MARK.fields])


def marks(text: Column) -> Column:
    """`struct<words_high, words_low, print, low, high, keys>` of a text column: 128 bits of a hash of its words, its
    fingerprint, its sketch and its bands' keys. All in one function, so that a task has one worker for them."""
    return _marks.asNondeterministic()(F.coalesce(text, F.lit("")))


@F.arrow_udf(T.ArrayType(T.LongType()))
@thrifty
def _sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        sets = [np.unique(np.concatenate([np.empty(0, np.uint64), *shingles_of(t, WORDS)])) for chunk in text_chunks(texts) for t in chunk.to_pylist()]
        ends = np.cumsum([0, *map(len, sets)])
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)))


@thrifty
def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, run in whole_runs(batches, ("key", "_block")):
        nodes, low, high = (rows[c].to_numpy().view(np.uint64) for c in ("node", "low", "high"))
        parent, left, gap = np.arange(len(nodes)), np.arange(len(nodes) - 1), 1
        while len(left):
            left = left[left + gap < len(nodes)]
            left = left[run[left] == run[left + gap]]
            right = left + gap
            apart = np.bitwise_count(low[left] ^ low[right]).astype(int) + np.bitwise_count(high[left] ^ high[right])
            near = left[apart <= MAX_BITS]
            parent = unite(parent, near, near + gap)
            gap += 1
        child = np.flatnonzero(parent != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[child].view(np.int64)), pa.array(nodes[parent[child]].view(np.int64))], names=["a", "b"])


def alike_forest(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the sets connected by similarities of SHARE / OF or more; at most one for each set."""
    sizes = np.array([len(s) for s in sets])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n[at] > 1
    column, owner = (np.cumsum(n > 1) - 1)[at[shared]], np.repeat(np.arange(len(sets)), sizes)[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.int64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, (first, first + COLUMNS)))
        one = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - first)), np.float32)
        one[owner[part], column[part] - first] = 1
        both += (one @ one.T).astype(np.int64)
    a, b = np.nonzero(np.triu(OF * both >= SHARE * (sizes[:, None] + sizes - both), 1))
    parent = unite(np.arange(len(sets)), a, b)
    child = np.flatnonzero(parent != np.arange(len(sets)))
    return child, parent[child]


@thrifty
def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, run in whole_runs(batches, ("cluster", "_block"), SET_ROWS):
        nodes, sets = rows["node"].to_numpy(), rows["shingles"].combine_chunks()
        ends = sets.offsets.to_numpy()
        values = sets.values.to_numpy()
        edges = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for part in np.split(np.arange(len(nodes)), np.flatnonzero(np.diff(run)) + 1):
            if len(part) > 1:
                child, parent = alike_forest([values[ends[k] : ends[k + 1]] for k in part])
                edges.append((nodes[part[child]], nodes[part[parent]]))
        a, b = (np.concatenate(side) for side in zip(*edges, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def alike_edges(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges `a, b` that connect the nodes with similar sets, from `nodes(node, row, low, high, keys)` and `texts(row, text)`.

    Nodes that share a band and have near sketches are candidates; they are connected to clusters, and in a
    cluster all sets are compared, in blocks of bounded rows and shingles. So each text is worked on once, not
    once for each pair, and blocks give forests, never all pairs. `row` names a row of `texts`, or rows alike
    in all columns, of which one is taken."""
    keyed = nodes.select(F.explode("keys").alias("key"), "node", "low", "high")
    near = linked_edges(keyed, "key", "node", BLOCK_ROWS, lambda rows: rows.mapInArrow(_candidates, "a long, b long"))
    clusters = connected_components(near)
    chosen = clusters.join(nodes, "node").select("node", "row", F.col("root").alias("cluster"))
    members = texts.join(chosen, "row").dropDuplicates(["row"])
    members = members.select("node", "cluster", _sets(F.coalesce("text", F.lit(""))).alias("shingles"))
    members = materialised(members.withColumn("n", F.size("shingles")), "shingle-sets")
    return linked_edges(members, "cluster", "node", SET_ROWS, lambda rows: rows.mapInArrow(_alike, "a long, b long"), "n", SET_SHINGLES)
