"""Passages that repeat, found by Rabin-Karp hashes of every window of a fixed number of words.

Every task hashes all windows of its texts and packs them by bucket, so that Spark shuffles long rows of few bytes
a window. A bucket holds a share of all hash values; the windows of one value meet in it, and all but the first
are repeats. These are packed by bucket of documents in the same way; the repeats of a text, put together, give
maximal intervals of words to remove.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import SMALL_LIST, whole_runs
from .common import materialised, span_hashes, spans_of, text_bytes, text_chunks

WORDS = 20
HASHED_BYTES = 8 << 20
WORD_BYTES = 1 << 20
#: Text a bucket; a bucket's windows are in memory at once.
BUCKET_BYTES = 8 << 20
LEAST_BUCKETS = 1024
REPEATS_AT_ONCE = 1 << 20
NO_ID = np.iinfo(np.int64).max
BASES = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
PACKED = "bucket int, firsts binary, repeats binary"
FOUND = "bucket int, found binary"
STARTS = "doc long, part long, starts array<int>"
#: Buckets of windows for each bucket of documents.
WINDOW_BUCKETS = 4


def _mixed(values: np.ndarray, salt: int) -> np.ndarray:
    values = values ^ np.uint64(salt)
    values = (values ^ values >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ values >> np.uint64(29)


def word_hashes(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the texts that stand at `offsets` in `flat`, and the number of its text."""
    blank = (flat == 32) | (flat >= 9) & (flat <= 13)
    cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(flat))]
    first, last = ~blank, ~blank
    first[1:] &= blank[:-1]
    last[:-1] &= blank[1:]
    first[cuts] = ~blank[cuts]
    last[cuts - 1] = ~blank[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + WORD_BYTES, side="right")))
        out[at:to] = span_hashes(flat[base : ends[to - 1]], starts[at:to] - base, ends[at:to] - base)
        at = to
    return out, np.searchsorted(offsets, starts, side="right") - 1


def rabin_karp(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """The polynomial hash, modulo 2^64, of every `size` consecutive values. Hashes of neighbouring stretches are
    put together, so `size` costs its logarithm."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    done, done_size, part, part_size = None, 0, words, 1
    while True:
        if size & part_size:
            if done is None:
                done, done_size = part, part_size
            else:
                n = len(words) - done_size - part_size + 1
                done = part[:n] * np.uint64(pow(base, done_size, 1 << 64)) + done[part_size : part_size + n]
                done_size += part_size
        if done_size == size:
            return done
        n = len(words) - 2 * part_size + 1
        part = part[:n] * np.uint64(pow(base, part_size, 1 << 64)) + part[part_size : part_size + n]
        part_size *= 2


def _planes(values: np.ndarray) -> tuple[int, bytes]:
    """Unsigned values byte by byte, all lowest bytes first, without the highest bytes that are all zero."""
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    return width, values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(data: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T
    return out.view("<u8")[:, 0]


def packed(docs: np.ndarray, parts: np.ndarray, places: np.ndarray, hashes: np.ndarray) -> bytes:
    """Documents and parts as steps from one row to the next, and places, all as planes; hashes as they are, or none."""
    head, body = [len(docs), len(hashes)], []
    for values in (docs, parts):
        values = values.view(np.uint64)
        width, data = _planes(values[1:] - values[:-1])
        head += [int(values[0]) if len(values) else 0, width]
        body.append(data)
    width, data = _planes(places)
    return b"".join([np.array([*head, width], "<u8").tobytes(), *body, data, hashes.astype("<u8").tobytes()])


def unpacked(data: bytes) -> list[np.ndarray]:
    view = memoryview(data)
    n, n_hashes, *steps, width = np.frombuffer(view, "<u8", 7).tolist()
    at, out = 56, []
    for first, size in zip(steps[::2], steps[1::2], strict=True):
        less = max(n - 1, 0)
        moves = _from_planes(view[at:], less, size)
        at += less * size
        out.append(np.cumsum(np.r_[np.uint64(first), moves][:n], dtype=np.uint64).view(np.int64))
    places = _from_planes(view[at:], n, width).view(np.int64)
    return [*out, places, np.frombuffer(view[at + n * width :], "<u8", n_hashes)]


class _Windows:
    """Packs the windows of batches of (doc, part, text): a row a bucket and some megabytes of text."""

    def __init__(self, size: int, n_buckets: int) -> None:
        self.size, self.bits = size, n_buckets.bit_length() - 1

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, parts = (batch.column(c).to_numpy() for c in ("doc", "part"))
            order = np.lexsort((parts, docs))
            new = np.r_[True, (np.diff(docs[order]) != 0) | (np.diff(parts[order]) != 0)][: len(order)]
            order, at = order[new], 0
            for texts in text_chunks(batch.column("text").take(pa.array(order)), HASHED_BYTES):
                rows = order[at : at + len(texts)]
                at += len(texts)
                made = self.rows(docs[rows], parts[rows], texts)
                if made is not None:
                    yield made

    def rows(self, docs: np.ndarray, parts: np.ndarray, texts: pa.Array) -> pa.RecordBatch | None:
        words, owner = word_hashes(*text_bytes(texts))
        before = np.searchsorted(owner, np.arange(len(docs)))
        hashes, other = (rabin_karp(_mixed(words, b), self.size, b) for b in BASES)
        whole = np.flatnonzero(owner[: len(hashes)] == owner[self.size - 1 :])
        if not len(whole):
            return None
        owner = owner[whole]
        place = (whole - before[owner]).astype(np.uint64)
        hashes = hashes[whole]
        bucket = (other[whole] >> np.uint64(64 - self.bits)).astype(np.int32)
        # Rows stand in order of document and place, so the first of equal ones is the earliest.
        order = np.argsort(hashes, kind="stable")
        again = np.zeros(len(order), bool)
        again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (bucket[order[1:]] == bucket[order[:-1]])
        order = np.argsort(bucket, kind="stable")
        columns = [docs[owner][order], parts[owner][order], place[order], hashes[order]]
        again = again[order]
        numbers, starts = np.unique(bucket[order], return_index=True)
        firsts, repeats = [], []
        for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
            seen = again[a:b]
            firsts.append(packed(*(c[a:b][~seen] for c in columns)))
            repeats.append(packed(*(c[a:b][seen] for c in columns[:3]), np.empty(0, np.uint64)) if seen.any() else None)
        return pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(firsts, pa.binary()), pa.array(repeats, pa.binary())], names=["bucket", "firsts", "repeats"])


def repeats_of(hashes: np.ndarray, docs: np.ndarray, parts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The rows whose hash also stands at an earlier (document, part, place)."""
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    some = order[np.r_[same, False] | np.r_[False, same]] if len(order) else order
    some = some[np.lexsort((places[some], parts[some], docs[some], hashes[some]))]
    key = [c[some] for c in (hashes, docs, parts, places)]
    first = np.r_[True, key[0][1:] != key[0][:-1]][: len(some)]
    # A repeated row of the table gives its windows twice; they are the same windows.
    at_first = np.maximum.accumulate(np.where(first, np.arange(len(some)), 0))
    itself = np.logical_and.reduce([k == k[at_first] for k in key]) if len(some) else first
    return some[~itself]


class _Repeats:
    """Finds the repeats in each bucket of windows and packs them by bucket of documents."""

    def __init__(self, n_buckets: int) -> None:
        self.bits = n_buckets.bit_length() - 1

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[np.ndarray]] = []
        for rows, run in whole_runs(batches, ("bucket",), 1):
            firsts, repeats = rows["firsts"].combine_chunks(), rows["repeats"].combine_chunks()
            bounds = np.r_[np.flatnonzero(np.diff(run, prepend=-1)), len(run)]
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                docs, parts, places, hashes = (np.concatenate(c) for c in zip(*(unpacked(x.as_py()) for x in firsts[a:b]), strict=True))
                later = repeats_of(hashes, docs, parts, places)
                found.append([docs[later], parts[later], places[later]])
                found += [unpacked(x.as_py())[:3] for x in repeats[a:b] if x.is_valid]
                if sum(len(f[0]) for f in found) >= REPEATS_AT_ONCE:
                    yield self.rows(found)
                    found = []
        if any(len(f[0]) for f in found):
            yield self.rows(found)

    def rows(self, found: list[list[np.ndarray]]) -> pa.RecordBatch:
        docs, parts, places = (np.concatenate(c) for c in zip(*found, strict=True))
        bucket = (_mixed(docs.view(np.uint64) ^ parts.view(np.uint64), BASES[0]) >> np.uint64(64 - self.bits)).astype(np.int32)
        order = np.lexsort((places, parts, docs, bucket))
        numbers, starts = np.unique(bucket[order], return_index=True)
        none = np.empty(0, np.uint64)
        data = [packed(*(c[order[a:b]] for c in (docs, parts, places.view(np.uint64))), none) for a, b in zip(starts, [*starts[1:], len(order)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(data, pa.binary())], names=["bucket", "found"])


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of a bucket, with the places of all its repeats."""
    for rows, run in whole_runs(batches, ("bucket",), 1):
        data = rows["found"].combine_chunks()
        bounds = np.r_[np.flatnonzero(np.diff(run, prepend=-1)), len(run)]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            docs, parts, places, _ = (np.concatenate(c) for c in zip(*(unpacked(x.as_py()) for x in data[a:b]), strict=True))
            order = np.lexsort((places, parts, docs))
            docs, parts, places = docs[order], parts[order], places[order]
            new = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (parts[1:] != parts[:-1])])
            starts = pa.ListArray.from_arrays(pa.array(np.r_[new, len(docs)].astype(np.int32)), pa.array(places.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(docs[new]), pa.array(parts[new]), starts], names=["doc", "part", "starts"])


def keyed(docs: DataFrame) -> DataFrame:
    """`doc_id, doc, part, text`: rows alike in `doc` and `part` are one document, and documents stand in their
    order. `part` is 0 but where an id is null or repeated; there it is a hash of the text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    again = materialised(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id")), "repeated-ids")
    n_again = again.count()
    same = F.col("_id").isNotNull()
    if n_again:
        docs = docs.join(F.broadcast(again) if n_again <= SMALL_LIST else again, F.col("doc_id") == F.col("_id"), "left")
    else:
        same = F.lit(False)
    part = F.when(same | F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(int(NO_ID))).alias("doc"), part.alias("part"), "text")


def window_repeats(rows: DataFrame, size: int) -> DataFrame:
    """`doc, part, starts` of `keyed` rows: the places, in words, of windows that also start earlier; a row for each
    document that has one."""
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n_buckets = max(LEAST_BUCKETS, 1 << (total // BUCKET_BYTES).bit_length())
    windows = rows.select("doc", "part", "text").mapInArrow(_Windows(size, n_buckets), PACKED)
    found = windows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_Repeats(n_buckets // WINDOW_BUCKETS), FOUND)
    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_starts, STARTS)


SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("past", T.IntegerType())]))
CUT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", SPANS), T.StructField("kept", T.StringType())])


def _cut(text: Column, starts: Column, size: int) -> Column:
    @F.arrow_udf(CUT)
    def cut(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out, row = [], 0
        for chunk in text_chunks(texts):
            for data in chunk.cast(pa.large_binary()).to_pylist():
                words, at = data.split(), lists[row].values
                row += 1
                if at is None or not len(at):
                    out.append((len(words), 0, [], b" ".join(words).decode()))
                    continue
                at = at.to_numpy()
                edge = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + size, minlength=len(words) + 1)
                gone = np.cumsum(edge[:-1]) > 0
                spans = [{"first": int(a), "past": int(b)} for a, b in zip(*spans_of(gone), strict=True)]
                out.append((len(words), int(gone.sum()), spans, b" ".join(compress(words, ~gone)).decode()))
        n_words, n_removed, spans, kept = zip(*out, strict=True) if out else ((), (), (), ())
        pairs = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))
        columns = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pairs), pa.array(kept, pa.string())]
        return pa.StructArray.from_arrays(columns, ["n_words", "n_removed", "spans", "kept"])

    return cut.asNondeterministic()(text, starts)


def without_repeats(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """`doc_id, n_words, n_removed, spans, kept` for every row of `docs(doc_id, text, ...)`.

    Words are stretches without the blanks 0x20 and 0x09 to 0x0D, as they stand. A word goes if a window of
    `size` words that covers it also starts earlier: in a document of smaller id, or before it in the same
    one. Windows are judged on the texts as they came. `spans` are the maximal intervals of removed words,
    `kept` the other words joined by one space.

    Null and empty texts have no words, texts of fewer than `size` words no window. `doc_id` is a whole number.
    Rows alike in id and text are one document, each with its result. Rows of one id with unlike texts, and
    rows without id, which stand after all others, are documents of their own in the order of a hash of the
    text. A very long text is worked on as a whole, in a task that holds it and about 30 bytes for each of
    its words. Other columns are ignored; an empty table gives an empty result.

    Windows are one if 64 bits of their hash and their bucket (10 bits, 24 for 100 TB) agree: at 10^13
    windows about one pair of unlike ones does. A task ships a window that it meets often once, so a passage
    that stands in a third of all documents costs a row for each chunk of 8 MB of text. Texts are
    shuffled once, to meet their repeats.
    """
    rows = keyed(docs)
    joined = rows.join(window_repeats(rows, size), ["doc", "part"], "left")
    return joined.select("doc_id", _cut(F.col("text"), F.col("starts"), size).alias("cut")).select("doc_id", "cut.*")


def repeats_removed(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """`doc_id, n_words, n_removed, kept_sha256` of `without_repeats`."""
    return without_repeats(docs, size).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
