"""Token counts of whole texts under a byte-level BPE vocabulary, by rank-synchronous array merging."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_chunks
from .workers import held

# Fixed value: the pattern of the byte-level pre-tokenizer.
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_RANK = np.iinfo(np.int64).max
COUNTED_BYTES = 8 << 20
CACHED_WORDS = 400_000
CACHED_CHARS = 48
WORDS_AT_ONCE = 200_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes
    stand for themselves, the rest take the letters from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class MergeCounter:
    """Counts the symbols that survive all merges of a vocabulary, for many pre-tokens at once."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.byte_ids = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.width = max(vocab.values()) + 1
        pairs = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks, self.made = pairs[order], order.astype(np.int64), made
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.pretokens = regex.compile(PRETOKENS)
        self.known: dict[str, int] = {}

    def merged_counts(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each word. A round merges, in every word, all places of the word's
        lowest-ranked pair: a merge only makes pairs of higher rank, so this is what merging one place
        at a time gives. In a run of equal symbols the places are taken from the left."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        counts = lengths.copy()
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        while len(symbols) > 1:
            rank = np.full(len(symbols), NO_RANK)
            key = symbols[:-1] * self.width + symbols[1:]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            fits = np.flatnonzero((self.pairs[at] == key) & (word[:-1] == word[1:]))
            rank[fits] = self.ranks[at[fits]]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(symbols)]))
            chosen = np.flatnonzero((rank == lowest) & (lowest != NO_RANK))
            if not len(chosen):
                break
            run = np.flatnonzero(np.r_[True, np.diff(chosen) != 1])
            within = np.arange(len(chosen)) - np.repeat(run, np.diff(np.r_[run, len(chosen)]))
            chosen = chosen[within % 2 == 0]
            counts -= np.bincount(word[chosen], minlength=len(words))
            symbols = symbols.copy()
            symbols[chosen] = self.made[rank[chosen]]
            keep = lowest != NO_RANK
            keep[chosen + 1] = False
            symbols, word = symbols[keep], word[keep]
        return counts

    def learn(self, words: set[str]) -> dict[str, int]:
        """Counts of `words`; short words are remembered, up to a bound that only spares time."""
        new = [w for w in words if w not in self.known]
        found = {w: self.known[w] for w in words if w in self.known}
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known.clear()
        for first in range(0, len(new), WORDS_AT_ONCE):
            part = new[first : first + WORDS_AT_ONCE]
            counts = self.merged_counts([w.encode() for w in part]).tolist()
            found.update(zip(part, counts, strict=True))
            self.known.update((w, n) for w, n in zip(part, counts, strict=True) if len(w) <= CACHED_CHARS)
        return found

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The stretches between the added tokens, and how many added tokens there are."""
        if self.added is None:
            return [text], 0
        parts = self.added.split(text)
        return parts, len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Pre-tokens are gathered over all texts before they are merged."""
        totals = [0] * len(texts)
        waiting: list[tuple[int, list[str]]] = []
        held = 0
        for i, text in enumerate(texts):
            parts, totals[i] = self.pieces(text)
            for part in parts:
                found = self.pretokens.finditer(part) if len(part) > 1 << 20 else None
                while block := ([m[0] for m in islice(found, WORDS_AT_ONCE)] if found else self.pretokens.findall(part)):
                    waiting.append((i, block))
                    held += len(block)
                    if held >= 2 * WORDS_AT_ONCE:
                        self.settle(waiting, totals)
                        held = 0
                    if not found:
                        break
        self.settle(waiting, totals)
        return totals

    def settle(self, waiting: list[tuple[int, list[str]]], totals: list[int]) -> None:
        counts = self.learn(set().union(*(block for _, block in waiting)))
        for i, block in waiting:
            totals[i] += sum(map(counts.__getitem__, block))
        waiting.clear()


def _counter(path: str) -> MergeCounter:
    return held(("merges", path), lambda: MergeCounter(path))


def n_tokens(text: Column, path: str) -> Column:
    """Tokens of a text column under the byte-level BPE file at `path` (a path on every executor)."""

    @F.arrow_udf(T.LongType())
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(path)
        for texts in batches:
            yield pa.array([n for chunk in text_chunks(texts, COUNTED_BYTES) for n in counter.count(chunk.to_pylist())], pa.int64())

    return counted(F.coalesce(text, F.lit("")))


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """`doc_id, n_bytes, n_tokens, over_limit` for every row of `docs(doc_id, text, ...)`.

    Added tokens inside a text count as one token each; nothing is added, cut or padded. A null or empty
    text has 0 bytes and tokens; null and repeated ids keep one row per input row; other columns are
    ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text, path).alias("n_tokens"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
