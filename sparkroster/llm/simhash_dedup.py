"""SimHash near-duplicates by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import in_blocks, unite, whole_runs
from .common import materialised, text_chunks
from .components import connected_components
from .workers import held, thrifty

SEED = 42
HASHES_AT_ONCE = 1 << 17
BLOCK_ROWS = 4096
# Fixed value: generator polynomial of the binary (23, 12, 7) Golay code.
GENERATOR = 0xC75
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_BITS = 4


def shingles_of(text: str, words: int) -> Iterator[np.ndarray]:
    """XXH64 hashes of the text's shingles, some at a time; a shorter text is one shingle, one without words none."""
    from xxhash import xxh64_intdigest

    # bytes.lower and bytes.split know the ASCII letters and the blanks 0x20 and 0x09 to 0x0D alone.
    parts = text.encode().lower().split()
    if not parts:
        return
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    size = min(words, len(parts))
    begin, end = starts[: len(parts) - size + 1].tolist(), ends[size - 1 :].tolist()
    for at in range(0, len(begin), HASHES_AT_ONCE):
        part = slice(at, at + HASHES_AT_ONCE)
        yield np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begin[part], end[part], strict=True)], "<u8")


def fingerprint_of(text: str, words: int = 4) -> int:
    """64 bits, each set if it is set in over half the XXH64 hashes of the text's shingles."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingles_of(text, words):
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
@thrifty
def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    held("near copies")
    for texts in batches:
        values = [fingerprint_of(t) for chunk in text_chunks(texts) for t in chunk.to_pylist()]
        yield pa.array(np.array(values, np.uint64).view(np.int64))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column as a signed 64-bit integer; 0 for null and for no words."""
    return _fingerprints(F.coalesce(text, F.lit("")))


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of all 23-bit words modulo the generator, the error of weight 3 or less for each remainder,
    and its errors of weight 4 (0: none)."""
    place = [1 << i for i in range(23)]
    for i in range(11, 23):
        rest = place[i]
        while rest >= 1 << 11:
            rest ^= GENERATOR << (rest.bit_length() - 12)
        place[i] = rest
    # Segments have 22 bits at most, so the words of 23 bits with the highest set are not needed.
    remainder = np.zeros(1 << 22, np.int16)
    for i, p in enumerate(place[:22]):
        remainder[1 << i : 2 << i] = remainder[: 1 << i] ^ p
    near = np.zeros(1 << 11, np.int64)
    far: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in (1, 2, 3, 4):
        for bits in combinations(range(23), weight):
            error, rest = 0, 0
            for b in bits:
                error, rest = error | 1 << b, rest ^ place[b]
            if weight == 4:
                far[rest].append(error)
            else:
                near[rest] = error
    width = max(map(len, far))
    return remainder, near, np.array([f + [0] * (width - len(f)) for f in far], np.int64)


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each 23-bit word's only codeword within 3 bits, and those of the codewords at 4 (-1: none)."""
    remainder, near, far = golay_tables()
    rest = remainder[words]
    errors = far[rest]
    return (words ^ near[rest]) >> 11, np.where(errors > 0, (words[:, None] ^ errors) >> 11, -1)


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys such that prints of 4 or fewer differing bits share a key.

    Four errors over three segments leave a segment without any, or two segments with one each. For the
    first the segment itself is a key. For the second: a word's codeword within 3 bits lies within 4 of a word
    one bit away. So with the near codeword on one segment and all those within 4 on the other, in both
    orders, two such prints share a pair of codeword indices.
    """
    values = prints.view(np.uint64)
    parts = [((values >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]
    near, around = zip(*map(golay_keys, parts), strict=True)
    columns = [((3 + i) << 24 | part)[:, None] for i, part in enumerate(parts)]
    for tag, (i, j) in enumerate(combinations(range(len(parts)), 2)):
        columns.append((tag << 24 | near[i] << 12 | near[j])[:, None])
        columns.append(np.where(around[i] >= 0, tag << 24 | around[i] << 12 | near[j][:, None], -1))
        columns.append(np.where(around[j] >= 0, tag << 24 | near[i][:, None] << 12 | around[j], -1))
    keys = np.concatenate(columns, axis=1)
    rows, at = np.nonzero(keys >= 0)
    return rows, keys[rows, at]


@thrifty
def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy()
        for first in range(0, len(prints), 1 << 15):
            part = prints[first : first + (1 << 15)]
            rows, keys = fuzzy_keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "print"])


def near_forest(run: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join, within each run, the prints that are connected by links; at most one for each row."""
    parent = np.arange(len(prints))
    left = np.arange(len(prints) - 1)
    gap = 1
    while len(left):
        left = left[left + gap < len(prints)]
        left = left[run[left] == run[left + gap]]
        near = left[np.bitwise_count((prints[left] ^ prints[left + gap]).view(np.uint64)) <= MAX_BITS]
        parent = unite(parent, near, near + gap)
        gap += 1
    child = np.flatnonzero(parent != np.arange(len(prints)))
    return prints[child], prints[parent[child]]


@thrifty
def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, run in whole_runs(batches, ("key", "_block")):
        a, b = near_forest(run, rows["print"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def print_components(prints: DataFrame) -> DataFrame:
    """`node, root` for the distinct `print` values that link to another one."""
    keyed = prints.mapInArrow(_keyed, "key long, print long")
    return connected_components(in_blocks(keyed, "key", "print", BLOCK_ROWS).mapInArrow(_links, "a long, b long"))


def simhash_groups(docs: DataFrame) -> DataFrame:
    """`doc_id, fingerprint, component_id` for every row of `docs(doc_id, text, ...)`.

    Rows of one fingerprint are a group from the start; different fingerprints link at 4 or fewer differing
    bits, whatever the number of rows. `component_id` is the smallest id reachable, null where all ids of
    the component are null; rows with a null or repeated id keep a row each. Null, empty and blank texts have
    the fingerprint zero. Other columns are ignored; an empty table gives an empty result.
    """
    marked = materialised(docs.select("doc_id", fingerprint(F.col("text")).alias("print")), "fingerprints")
    firsts = marked.groupBy("print").agg(F.min("doc_id").alias("first"))
    roots = print_components(marked.select("print").distinct())
    rooted = firsts.join(roots, firsts["print"] == roots["node"], "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    rooted = materialised(rooted, "rooted")
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = rooted.join(lowest, "root").select("print", "component_id")
    return marked.join(labels, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay: of each group of `near_groups` the one of the smallest id (of rows alike in
    it the smallest hash), and one of its rows with a null id, as nothing names those. All columns are kept;
    rows of one id with unlike texts belong to groups of their own."""
    first = near_groups(docs).groupBy("root", F.col("doc_id").isNull()).agg(F.min(F.struct("doc_id", "row")).alias("first"))
    first = first.select(F.col("first.row").alias("_row"))
    # Rows alike in all columns have one hash and lie in one partition after the join; one of them stays.
    return docs.withColumn("_row", row_hash(docs)).join(first, "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")


def row_hash(docs: DataFrame) -> Column:
    """128 bits of hashes of all columns of a row; null and empty texts have unlike ones."""
    columns = [*[F.col(c) for c in docs.columns], *[F.col(c).isNull() for c in docs.columns]]
    return F.struct(F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit("second"), *reversed(columns)).alias("h2"))


def near_groups(docs: DataFrame) -> DataFrame:
    """`doc_id, row, root` for every row of `docs(doc_id, text, ...)`, `row` its `row_hash`: rows have one root
    where links connect them. Texts link whose sets of five-word shingles have a Jaccard similarity of
    0.8 or more, and those that `simhash_groups` links. Texts of the same words are one node."""
    from .shingle_sets import alike_edges, marks

    row = row_hash(docs).alias("row")
    marked = docs.select("doc_id", row, marks(F.col("text")).alias("mark"))
    marked = materialised(marked.select("doc_id", "row", "mark.*"), "marks")
    words = ["words_high", "words_low"]
    # Nodes get running numbers, which stay as they are in the table written.
    nodes = marked.groupBy(words).agg(*[F.min(c).alias(c) for c in ("row", "print", "low", "high")], F.any_value("keys").alias("keys"))
    nodes = materialised(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    firsts = materialised(nodes.groupBy("print").agg(F.min("node").alias("first")), "firsts")
    alike_prints = nodes.join(firsts, "print").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = print_components(nodes.select("print").distinct())
    lower = firsts.select(F.col("print").alias("root"), F.col("first").alias("a"))
    near = near.join(lower, "root").join(firsts.select(F.col("print").alias("node"), F.col("first").alias("b")), "node").select("a", "b")
    texts = docs.select(row, "text")
    roots = connected_components(alike_prints.union(near).union(alike_edges(nodes, texts)))
    roots = nodes.select(*words, "node").join(roots, "node", "left").select(*words, F.coalesce("root", "node").alias("root"))
    return marked.join(roots, words).select("doc_id", "row", "root")
