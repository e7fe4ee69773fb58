"""Token ids as Parquet list columns: dictionary pages for ids, delta pages for keys and lengths, bounded row
groups and pages with indexes, so that lengths can be read without ids and a few documents without the rest."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from .common import new_folder, ragged, text_chunks
from .workers import held, thrifty

ENCODED_BYTES = 6 << 20
CACHED_WORDS = 1_000_000
CACHED_BYTES = 64
WORDS_AT_ONCE, JOINED = 20_000, 500
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#position": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


class _Known:
    """Ids of words by a hash of 128 bits: sorted hashes, and where each word's ids stand in a pool."""

    def __init__(self, kind: type) -> None:
        self.high, self.low = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int32)
        self.pool = np.empty(0, kind)

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        if not len(self.high):
            return np.full(len(high), -1)
        at = np.minimum(np.searchsorted(self.high, high), len(self.high) - 1)
        return np.where((self.high[at] == high) & (self.low[at] == low), at, -1)

    def add(self, high: np.ndarray, low: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Words that it does not have; of two with one high half the first stays, as the cache may forget any."""
        high, first = np.unique(high, return_index=True)
        fresh = self.high[np.minimum(np.searchsorted(self.high, high), len(self.high) - 1)] != high if len(self.high) else np.ones(len(high), bool)
        high, first = high[fresh], first[fresh]
        starts = np.cumsum(sizes) - sizes + len(self.pool)
        at = np.searchsorted(self.high, high)
        self.high, self.low = np.insert(self.high, at, high), np.insert(self.low, at, low[first])
        self.starts, self.sizes = np.insert(self.starts, at, starts[first]), np.insert(self.sizes, at, sizes[first])
        self.pool = np.concatenate([self.pool, ids])


class WordEncoder:
    """Encodes whole texts with the tokenizers library, each distinct blank-separated stretch once.

    The tokenizer drops white space before it merges, so no token crosses an ASCII blank and the ids of a
    text are those of its stretches, one after the other. Stretches not seen of late go to the library
    joined by blanks; a token belongs to the stretch in which its characters stand.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.recent, self.older = _Known(self.kind), _Known(self.kind)

    def library_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all ids one after the other."""
        sizes, flat = [np.empty(0, np.int64)], [np.empty(0, self.kind)]
        for first in range(0, len(words), WORDS_AT_ONCE):
            some = words[first : first + WORDS_AT_ONCE]
            lists = [some[i : i + JOINED] for i in range(0, len(some), JOINED)]
            made = self.tokenizer.encode_batch([" ".join(x) for x in lists], add_special_tokens=False)
            for part, e in zip(lists, made, strict=True):
                ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
                begins = np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids))
                sizes.append(np.bincount(np.searchsorted(ends, begins, side="right"), minlength=len(part)))
                flat.append(np.array(e.ids, self.kind))
        return np.concatenate(sizes), np.concatenate(flat)

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all ids. Short words are remembered for a while; the bound on
        how many only costs or spares time."""
        # The tokenizer lowers case; doing it first lets words share their ids. Other letters may compose with marks.
        words = pc.if_else(pc.string_is_ascii(words), pc.ascii_lower(words), words)
        data = words.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
        high, low = np.frombuffer(b"".join(map(xxh3_128_digest, data)), "<u8").reshape(-1, 2).T.copy()
        sizes, pools, starts, base = np.zeros(len(words), np.int64), [], np.zeros(len(words), np.int64), 0
        missing = np.arange(len(words))
        for known in (self.recent, self.older):
            at = known.find(high[missing], low[missing])
            here, at = missing[at >= 0], at[at >= 0]
            sizes[here], starts[here] = known.sizes[at], base + np.cumsum(known.sizes[at]) - known.sizes[at]
            pools.append(known.pool[ragged(known.starts[at].astype(np.int64), known.sizes[at].astype(np.int64))])
            base += len(pools[-1])
            missing = np.setdiff1d(missing, here, assume_unique=True)
            if known is self.recent:
                again = missing
        _, one, same = np.unique(high[missing], return_index=True, return_inverse=True)
        if not np.array_equal(low[missing], low[missing[one]][same]):
            one, same = np.arange(len(missing)), np.arange(len(missing))
        n, ids = self.library_ids(words.take(pa.array(missing[one])).to_numpy(zero_copy_only=False).tolist())
        sizes[missing], starts[missing] = n[same], (base + np.cumsum(n) - n)[same]
        pool = np.concatenate([*pools, ids])
        short = again[pc.binary_length(words).to_numpy(zero_copy_only=False)[again] <= CACHED_BYTES]
        if len(self.recent.high) + len(short) > CACHED_WORDS:
            self.recent, self.older = _Known(self.kind), self.recent
        self.recent.add(high[short], low[short], sizes[short], pool[ragged(starts[short], sizes[short])])
        return sizes, pool[ragged(starts, sizes)]

    def encode(self, texts: pa.Array, end_id: int | None) -> pa.Array:
        """One list of ids for each text of a large string array without nulls."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        sizes, pool = self.look_up(words.dictionary)
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        per_text = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        if end_id is not None:
            pool, sizes = np.r_[pool, np.array([end_id], self.kind)], np.r_[sizes, 1]
            codes = np.insert(codes, np.cumsum(per_text), len(sizes) - 1)
            per_text = per_text + 1
        starts = np.cumsum(sizes) - sizes
        ends = np.r_[0, np.cumsum(sizes[codes])]
        bounds = ends[np.r_[0, np.cumsum(per_text)]]
        values = pool[ragged(starts[codes], sizes[codes])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def _encoder(path: str) -> WordEncoder:
    return held(("words", path), lambda: WordEncoder(path))


def token_ids(text: Column, path: str, end_id: int | None) -> Column:
    """The ids of a text column as `array<int>`, `end_id` last unless it is None."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    @thrifty
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(path)
        for texts in batches:
            parts = [encoder.encode(chunk, end_id) for chunk in text_chunks(texts, ENCODED_BYTES)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return encoded.asNondeterministic()(F.coalesce(text, F.lit("")))


@F.arrow_udf(T.LongType())
def ids_crc32(lists: pa.Array) -> pa.Array:
    """Unsigned crc32 of the ids of each list as little-endian unsigned 32-bit integers."""
    offsets = lists.offsets.to_numpy()
    values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4"))
    data = memoryview(values).cast("B") if len(values) else memoryview(b"")
    return pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.int64())


def _bounds(docs: DataFrame, n_files: int) -> list[int]:
    """Ids that cut the rows into `n_files` ranges of about equal size; only their column is read."""
    wanted = [k / n_files for k in range(1, n_files)]
    if not wanted:
        return []
    row = docs.agg(F.percentile_approx("doc_id", wanted, 100 * n_files).alias("at")).first()
    return sorted(set(row["at"] or []))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, n_files: int | None = None) -> str:
    """Write `position, doc_id, n_tokens, ids` of every row of `docs(doc_id, text, ...)` below `path`.

    Rows stand in ascending order of doc_id over the files in the order of their names (null ids first, rows
    of one id by text); `position` grows in that order and its bits from 33 on number the file. `doc_id` must
    be an integer. Empty and null texts hold the end id alone; an empty table gives a file without rows;
    other columns are left out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n_files = n_files or max(1, docs.rdd.getNumPartitions())
    cuts = _bounds(docs, n_files)
    ordered = docs.repartitionById(len(cuts) + 1, _cuts_below(cuts)).sortWithinPartitions("doc_id", "text")
    rows = ordered.select("doc_id", token_ids(F.col("text"), tokenizer, end_id).alias("ids"))
    rows = rows.select(F.monotonically_increasing_id().alias("position"), "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")
    rows.write.options(**LAYOUT).parquet(path)
    return path


def _cuts_below(cuts: list[int]) -> Column:
    """How many of the cuts lie below doc_id; 0 for a null id."""
    if not cuts:
        return F.lit(0)
    below = F.filter(F.lit(cuts), lambda cut: cut < F.col("doc_id"))
    return F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(below))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def token_file_digest(spark: SparkSession, path: str) -> DataFrame:
    """`doc_id, start, n_tokens, ids_crc32` of every document, from the files alone.

    Lengths are summed within each file, and over the files before it; the totals of the files are a row
    for each file.
    """
    rows = read_token_files(spark, path).select(
        "doc_id", "n_tokens", "position", F.shiftrightunsigned("position", 33).alias("_file"), ids_crc32("ids").alias("ids_crc32")
    )
    lengths = read_token_files(spark, path).select("n_tokens", F.shiftrightunsigned("position", 33).alias("_file"))
    totals = lengths.groupBy("_file").agg(F.sum("n_tokens").alias("_n"))
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    before = Window.partitionBy("_file").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("_in_file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return within.join(totals, "_file").select("doc_id", (F.col("_base") + F.col("_in_file")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int | None = 2) -> DataFrame:
    """Write the ids of `docs` to a new folder below the shared one and return the digest read back."""
    path = write_token_files(docs, new_folder(docs.sparkSession, "token-files"), tokenizer, end_id)
    return token_file_digest(docs.sparkSession, path)
