"""Benchmark decontamination: an FM-index over each shard of documents, searched backwards for every window of
every test item; occurrences are located by sampled suffix positions and merged into removal spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ragged, span_hashes, spans_of, text_bytes, text_chunks
from .workers import held, thrifty

SAMPLE_EVERY = 8
BLOCK_BYTES = 4 << 20
SHARD_SYMBOLS = 1 << 19

_byte = np.arange(256)
IS_WORD = ((_byte >= 0x30) & (_byte <= 0x39)) | ((_byte >= 0x61) & (_byte <= 0x7A)) | (_byte >= 0x80)
LOWER = np.where((_byte >= 0x41) & (_byte <= 0x5A), _byte + 32, _byte).astype(np.uint8)


class Words:
    """The words of some texts: where each stands in the lower-cased bytes, a hash of each, and its text."""

    def __init__(self, texts: pa.Array) -> None:
        flat, offsets = text_bytes(texts)
        # A blank after every text keeps words of neighbours apart.
        spread = np.full(len(flat) + len(texts), 32, np.uint8)
        lengths = np.diff(offsets)
        spread[ragged(offsets[:-1] + np.arange(len(texts)), lengths)] = flat
        self.bytes = LOWER[spread]
        self.starts, self.ends = spans_of(IS_WORD[self.bytes])
        bounds = offsets[1:] + np.arange(1, len(texts) + 1)
        self.per_text = np.diff(np.r_[0, np.searchsorted(self.starts, bounds)])
        self.text = np.repeat(np.arange(len(texts)), self.per_text)
        self.text_starts = offsets[:-1] + np.arange(len(texts))
        self.hashes = span_hashes(self.bytes, self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.bytes[self.starts[i] : self.ends[i]].tobytes()


class Patterns:
    """The windows of a block of test items over the numbered words of these items."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        words = Words(pa.array([text or "" for _, text in items], pa.large_string()))
        self.hashes, first, number = np.unique(words.hashes, return_index=True, return_inverse=True)
        spelled = [words.word(i) for i in first]
        sizes = np.array([len(w) for w in spelled], np.int64)
        self.spelled, self.sizes = np.frombuffer(b"".join(spelled), np.uint8), sizes
        self.spelled_at = np.cumsum(sizes) - sizes
        number = number + 1
        ends = np.cumsum(words.per_text)
        found: dict[bytes, int] = {}
        phrases: list[np.ndarray] = []
        of_item: list[tuple[int, int]] = []
        self.ids = [str(i) for i, _ in items]
        for k, (begin, end) in enumerate(zip(ends - words.per_text, ends, strict=True)):
            size = min(window, int(end - begin))
            for at in range(begin, end - size + 1) if size else ():
                phrase = number[at : at + size]
                w = found.setdefault(phrase.tobytes(), len(phrases))
                if w == len(phrases):
                    phrases.append(phrase)
                of_item.append((w, k))
        self.lengths = np.array([len(p) for p in phrases], np.int64)
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0
        pairs = np.unique(np.array(of_item, np.int64).reshape(-1, 2), axis=0)
        self.items_of, self.items_at = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(phrases) + 1))
        self.padded = np.zeros((len(phrases), window), np.int32)
        for i, p in enumerate(phrases):
            self.padded[i, : len(p)] = p

    def numbers(self, words: Words, which: np.ndarray) -> np.ndarray:
        """The number of each of these words among the items' words, 0 for others; spellings are compared."""
        if not len(self.hashes) or not len(which):
            return np.zeros(len(which), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, words.hashes[which]), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words.hashes[which], at + 1, 0)

    def spelled_alike(self, words: Words, which: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        sizes = words.ends[which] - words.starts[which]
        alike = sizes == self.sizes[numbers - 1]
        sizes = np.where(alike, sizes, 0)
        equal = words.bytes[ragged(words.starts[which], sizes)] == self.spelled[ragged(self.spelled_at[numbers - 1], sizes)]
        wrong = np.r_[0, np.cumsum(~equal)]
        ends = np.cumsum(sizes)
        return alike & (wrong[ends] == wrong[ends - sizes])


class FmIndex:
    """Sorted suffixes of runs of symbols, each run closed by an end of its own, as a Burrows-Wheeler string
    with wavelet ranks and a sample of suffix positions."""

    def __init__(self, symbols: np.ndarray, width: int) -> None:
        self.n = n = len(symbols)
        ends = np.flatnonzero(symbols == 0)
        rank = symbols + len(ends)
        rank[ends] = np.arange(len(ends))
        order = np.argsort(rank, kind="stable")
        rank, step = self._ranks(rank[order], order), 1
        while True:
            follow = np.zeros(n, np.int64)
            follow[:-step or None] = rank[step:] + 1 if step < n else 0
            key = rank * (n + 2) + follow
            order = np.argsort(key, kind="stable")
            rank, step = self._ranks(key[order], order), 2 * step
            if rank[order[-1]] == n - 1 or step >= n:
                break
        before = symbols[order - 1]
        self.sampled = (order % SAMPLE_EVERY == 0) | (before == 0)
        self.positions = np.where(self.sampled, order, -1)
        self.bwt = before
        counts = np.bincount(symbols, minlength=width + 1)
        self.first = np.cumsum(counts) - counts
        self.counts = counts
        self.levels: list[tuple[np.ndarray, int]] = []
        level = before
        self.bits = max(1, int(width).bit_length())
        for bit in reversed(range(self.bits)):
            ones = (level >> bit) & 1
            ranks = np.r_[0, np.cumsum(ones)].astype(np.int32)
            self.levels.append((ranks, n - int(ranks[-1])))
            level = np.r_[level[ones == 0], level[ones == 1]]

    @staticmethod
    def _ranks(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(np.r_[0, keys[1:] != keys[:-1]])
        return rank

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands among the first `at` of the string."""
        begin, end = np.zeros_like(at), at
        for bit, (ones, zeros) in zip(reversed(range(self.bits)), self.levels, strict=True):
            up = (symbol >> bit) & 1 == 1
            one_begin, one_end = ones[begin], ones[end]
            begin = np.where(up, zeros + one_begin, begin - one_begin)
            end = np.where(up, zeros + one_end, end - one_end)
        return end - begin

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of sorted suffixes that begin with each phrase, read from its last word backwards."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        live = np.arange(len(phrases))
        for back in range(phrases.shape[1]):
            live = live[(lengths[live] > back) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - 1 - back].astype(np.int64)
            both = self.rank(np.r_[symbol, symbol], np.r_[low[live], high[live]]) + np.tile(self.first[symbol], 2)
            low[live], high[live] = both[: len(live)], both[len(live) :]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of sorted suffixes: steps back through the string to the next sampled one."""
        found, row, steps = np.full(len(rows), -1), rows.copy(), 0
        live = np.arange(len(rows))
        while len(live):
            here = self.positions[row[live]]
            known = here >= 0
            found[live[known]] = here[known] + steps
            live = live[~known]
            symbol = self.bwt[row[live]]
            row[live] = self.first[symbol] + self.rank(symbol, row[live])
            steps += 1
        return found


def occurrences(words: Words, patterns: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """First word and phrase of every occurrence. A shard is indexed over the words of the test items: a
    stretch of these that is shorter than the shortest phrase can hold none and stays out."""
    begins: list[np.ndarray] = []
    phrases: list[np.ndarray] = []
    if not patterns.shortest:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    number = patterns.numbers(words, np.arange(len(words.hashes)))

    def stretches() -> tuple[np.ndarray, np.ndarray]:
        inside = number != 0
        first = np.r_[True, words.text[1:] != words.text[:-1]] if len(inside) else inside
        opens = np.flatnonzero(inside & (np.r_[True, ~inside[:-1]] | first)) if len(inside) else np.empty(0, np.int64)
        stops = np.flatnonzero(~inside | first)
        ends = np.r_[stops, len(inside)][np.searchsorted(stops, opens, side="right")]
        long = ends - opens >= patterns.shortest
        return opens[long], ends[long]

    opens, ends = stretches()
    kept = ragged(opens, ends - opens)
    other = kept[~patterns.spelled_alike(words, kept, number[kept])]
    if len(other):
        number[other] = 0
        opens, ends = stretches()
    shards = np.cumsum(ends - opens + 1) // SHARD_SYMBOLS
    for shard in np.unique(shards):
        a, b = opens[shards == shard], ends[shards == shard]
        size = b - a + 1
        symbols = np.zeros(int(size.sum()), np.int64)
        place = np.zeros(len(symbols), np.int64)
        at = np.cumsum(size) - size
        inner = ragged(at, size - 1)
        place[inner] = ragged(a, size - 1)
        symbols[inner] = number[place[inner]]
        index = FmIndex(symbols, len(patterns.hashes))
        low, high = index.search(patterns.padded, patterns.lengths)
        hits = high - low
        rows = ragged(low, hits)
        begins.append(place[index.locate(rows)])
        phrases.append(np.repeat(np.arange(len(low)), hits))
    if not begins:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(begins), np.concatenate(phrases)


RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.LongType())),
        T.StructField("spans", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _list(values: pa.Array, per_text: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per_text)].astype(np.int32)), values)


def scan(texts: pa.Array, patterns: Patterns) -> pa.Array:
    """For each text: its words, the hit words' numbers, the hit bytes as flat (start, end) pairs of merged
    spans, and the ids of the items that occur."""
    words = Words(texts)
    begin, phrase = occurrences(words, patterns)
    n = len(texts)
    cover = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + patterns.lengths[phrase] if len(begin) else begin, -1)
    hit = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
    owner = words.text[hit]
    first_word = np.cumsum(words.per_text) - words.per_text
    per_text = np.bincount(owner, minlength=n)
    joined = np.r_[False, (hit[1:] == hit[:-1] + 1) & (owner[1:] == owner[:-1])] if len(hit) else np.empty(0, bool)
    opens = np.flatnonzero(~joined)
    closes = np.r_[opens[1:], len(hit)] - 1 if len(opens) else opens
    spans = np.empty(2 * len(opens), np.int64)
    base = words.text_starts[owner[opens]]
    spans[::2], spans[1::2] = words.starts[hit[opens]] - base, words.ends[hit[closes]] - base
    per_phrase = patterns.items_at[phrase + 1] - patterns.items_at[phrase] if len(phrase) else phrase
    item = patterns.items_of[ragged(patterns.items_at[phrase], per_phrase)] if len(phrase) else phrase
    pairs = np.unique(np.stack([np.repeat(words.text[begin], per_phrase), item], axis=1), axis=0)
    names = pa.array([patterns.ids[i] for i in pairs[:, 1].tolist()], pa.string())
    return pa.StructArray.from_arrays(
        [
            pa.array(words.per_text.astype(np.int64)),
            _list(pa.array(hit - first_word[owner]), per_text),
            _list(pa.array(spans), 2 * np.bincount(owner[opens], minlength=n)),
            _list(names, np.bincount(pairs[:, 0], minlength=n)),
        ],
        names=[f.name for f in RESULT],
    )


def _searched(text: Column, patterns: object) -> Column:
    @F.arrow_udf(RESULT)
    @thrifty
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held("passages")
        for texts in batches:
            parts = [scan(chunk, patterns.value) for chunk in text_chunks(texts)]
            yield pa.concat_arrays(parts) if parts else pa.array([], scan(pa.array([], pa.large_string()), patterns.value).type)

    return found.asNondeterministic()(F.coalesce(text, F.lit("")))


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[list[tuple[str, str]]]:
    """The test items in blocks of about `block_bytes` of text: one block is on the driver at a time in
    principle, and a document passes all of them. Items without a text hold no words."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = size // block_bytes + 1
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else rows
        yield [(r["i"], r["t"]) for r in part.collect()]


def found_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 13, block_bytes: int = BLOCK_BYTES) -> Column:
    """A struct column for `docs`: `n_words`, `hits` (numbers of hit words), `spans` (merged hit byte ranges
    of the lower-cased text, flat pairs) and `items` (ids with an occurring window, repeated rows once).

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A window is `window`
    consecutive words of an item, or the whole of a shorter one. Null and empty texts have no words.
    """
    spark = docs.sparkSession
    merged = None
    for items in _blocks(benchmark, block_bytes):
        found = _searched(F.col(text), spark.sparkContext.broadcast(Patterns(items, window)))
        if merged is None:
            merged = found
        else:
            merged = F.struct(
                found["n_words"].alias("n_words"),
                F.array_sort(F.array_union(merged["hits"], found["hits"])).alias("hits"),
                F.concat(merged["spans"], found["spans"]).alias("spans"),
                F.array_union(merged["items"], found["items"]).alias("items"),
            )
    return merged


def with_passages(docs: DataFrame, benchmark: DataFrame, name: str, **options: int) -> DataFrame:
    """`docs` with the struct of `found_passages` as column `name`, which must be free."""
    return docs.withColumn(name, found_passages(docs, benchmark, **options))


def is_contaminated(n_words: Column, n_hit: Column) -> Column:
    """At least one word in twenty is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """`doc_id, n_words, n_hit, n_items, items_sha256, contaminated` for every row of `docs(doc_id, text, ...)`.

    Null ids and repeated rows keep a row each; a null item id counts as the id `null`; an empty benchmark
    hits nothing; other columns are ignored.
    """
    found = with_passages(docs.select("doc_id", "text"), benchmark, "_found", window=window)
    counts = found.select("doc_id", F.col("_found.n_words").alias("n_words"), F.size("_found.hits").cast("long").alias("n_hit"), F.array_sort(F.array_distinct("_found.items")).alias("_items"))
    return counts.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def _free_name(docs: DataFrame) -> str:
    return "_found" + "_" * max(map(len, docs.columns), default=0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """The rows of `docs` that are not contaminated, with all their columns and their whole texts."""
    name = _free_name(docs)
    found = with_passages(docs, benchmark, name, window=window)
    return found.where(~is_contaminated(F.col(name)["n_words"], F.size(F.col(name)["hits"]))).select(*docs.columns)


def without_passages(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """`docs` with the hit spans cut out of `text`; texts without hits stay as they are."""

    @F.arrow_udf(T.StringType())
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, flat in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            if flat:
                data, at, kept = text.encode(), 0, []
                for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
                    kept.append(data[at : max(at, a)])
                    at = max(at, b)
                text = b"".join([*kept, data[at:]]).decode()
            out.append(text)
        return pa.array(out, pa.string())

    name = _free_name(docs)
    found = with_passages(docs, benchmark, name, window=window)
    return found.withColumn("text", cut(F.col("text"), F.col(name)["spans"])).select(*docs.columns)
