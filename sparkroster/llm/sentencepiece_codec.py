"""SentencePiece encoding and decoding by suffix-array matching: the batch's distinct words are indexed, every
piece is searched in the index, and the edges found are relaxed by position."""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ragged, text_chunks
from .workers import held, thrifty

BLANK = "▁"
CACHED_WORDS = 100_000
CACHED_CHARS = 48
CACHED_PAIRS = 400_000
WORDS_AT_ONCE = 40_000
CHUNK_BYTES = 2 << 20
NO_MERGE = np.iinfo(np.int64).max
# Piece kinds of the model format.
NORMAL, BYTE = 1, 6


class PieceModel:
    """The pieces of a BPE model with byte fallback, ready for matching.

    A run of blanks and the word after it are apart: no piece holds a blank after another character, and the
    merges of blanks rank last. A text is cut before its blanks and around characters that no longer piece
    holds, so that each distinct word is worked out once.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as format

        model = format.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = np.array([p.type for p in model.pieces])
        self.pieces = [p.piece for p in model.pieces]
        self.scores = np.array([p.score for p in model.pieces])
        self.ids = {p: i for i, p in enumerate(self.pieces) if kinds[i] == NORMAL}
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.unknown = model.trainer_spec.unk_id
        by_value = {p: i for i, p in enumerate(self.pieces) if kinds[i] == BYTE}
        self.byte_ids = np.array([by_value.get(f"<0x{b:02X}>", self.unknown) for b in range(256)], np.int32)
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that leave the text as it is are supported")
        if any(BLANK in p[1:] and p.strip(BLANK) for p in self.ids):
            raise ValueError("a piece holds a blank after another character")
        plain = [(p, i) for p, i in self.ids.items() if len(p) == 1 or p.strip(BLANK)]
        self.longest = max(len(p) for p, _ in plain)
        # Rank of the merge that makes a piece; single characters are there from the start.
        order = sorted((i for p, i in plain if len(p) > 1), key=lambda i: (-self.scores[i], i))
        self.rank = np.full(len(self.pieces) + 1, -1, np.int64)
        self.rank[order] = np.arange(len(order))
        lefts = [(self.ids[p[:k]], self.ids[p[k:]], self.rank[i]) for p, i in plain for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        pairs = np.array(lefts, np.int64).reshape(-1, 3)
        self.width = len(self.pieces) + 1
        key = pairs[:, 0] * self.width + pairs[:, 1]
        sort = np.argsort(key)
        self.merge_keys, self.merge_ranks = key[sort], pairs[sort, 2]
        self.rank_of_pair = dict(zip(key.tolist(), pairs[:, 2].tolist(), strict=True))
        self.piece_at_rank = order
        self.left, self.right = (np.arange(self.width) for _ in range(2))
        matched = []
        for piece, i in plain:
            last = self.last_merge(piece)
            if last is not None:
                self.left[i], self.right[i] = last
                matched.append(i)
        self.matched = np.array(matched)
        self.spelling = np.zeros((len(matched), self.longest), np.int64)
        self.length = np.zeros(self.width, np.int64)
        for row, i in enumerate(matched):
            letters = [ord(c) for c in self.pieces[i]]
            self.spelling[row, : len(letters)] = letters
            self.length[i] = len(letters)
        self.length[-1] = 1
        joined = {c for p, _ in plain if len(p) > 1 for c in p}
        breaks = "".join(c for c in "\n\t\r" if c not in joined)
        stop = re.escape(breaks)
        self.words = re.compile(f"{BLANK}+[^{BLANK}{stop}]*|[^{BLANK}{stop}]+|[{stop}]" if breaks else f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
        self.pairs: dict[int, bool] = {}
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.texts = [b"" if k not in (NORMAL, BYTE) else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(BLANK, " ").encode() for p, k in zip(self.pieces, kinds, strict=True)]
        self.text_sizes = np.array([len(t) for t in self.texts], np.int64)
        self.text_bytes = np.frombuffer(b"".join(self.texts), np.uint8)

    def last_merge(self, piece: str) -> tuple[int, int] | None:
        """The two pieces whose merge makes `piece`, itself twice for a character; None where other merges win."""
        if len(piece) == 1:
            return self.ids[piece], self.ids[piece]
        symbols = [self.ids.get(c, -1) for c in piece]
        while len(symbols) > 2:
            ranks = [self.rank_of_pair.get(a * self.width + b, NO_MERGE) for a, b in zip(symbols, symbols[1:], strict=False)]
            at = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[at] == NO_MERGE:
                return None
            symbols[at : at + 2] = [self.piece_at_rank[ranks[at]]]
        made = self.rank_of_pair.get(symbols[0] * self.width + symbols[1])
        return (symbols[0], symbols[1]) if made is not None and self.piece_at_rank[made] == self.ids[piece] else None

    def stand_together(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging keeps pieces a and b apart when they are neighbours.

        The last merges are taken back, the later of the two pieces first (of like ones the right one, which is
        made last). Where the characters now at the border have a merge of a lower rank than the one taken
        back, that merge would have come first.
        """
        keep = np.ones(len(a), bool)
        live = np.arange(len(a))
        limit = np.full(len(a), NO_MERGE)
        while len(live):
            key = a * self.width + b
            at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
            earlier = (self.merge_keys[at] == key) & (self.merge_ranks[at] < limit)
            keep[live[earlier]] = False
            go = ~earlier & (np.maximum(self.rank[a], self.rank[b]) >= 0)
            live, a, b = live[go], a[go], b[go]
            left_later = self.rank[a] > self.rank[b]
            limit = np.where(left_later, self.rank[a], self.rank[b] + 1)
            a, b = np.where(left_later, self.right[a], a), np.where(left_later, b, self.left[b])
        return keep

    def together(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`stand_together`, each distinct pair once; pairs are remembered up to a bound."""
        pairs, at = np.unique(a * self.width + b, return_inverse=True)
        known = [self.pairs.get(p) for p in pairs.tolist()]
        new = np.array([i for i, k in enumerate(known) if k is None], np.int64)
        answer = np.array([bool(k) for k in known], bool)
        if len(new):
            answer[new] = self.stand_together(pairs[new] // self.width, pairs[new] % self.width)
            if len(self.pairs) + len(new) > CACHED_PAIRS:
                self.pairs.clear()
            self.pairs.update(zip(pairs[new].tolist(), answer[new].tolist(), strict=True))
        return answer[at]

    def blank_run(self, n: int) -> list[int]:
        """Ids of n blanks that no word takes up, merged pair by pair, best score and then leftmost first."""
        symbols, sizes = list(range(n)), [1] * n
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (made := self.ids.get(BLANK * (sizes[i] + sizes[j]))) is not None:
                heapq.heappush(heap, (-self.scores[made], i, sizes[i], sizes[j]))

        for i in symbols[:-1]:
            offer(i)
        while heap:
            _, i, size, other = heapq.heappop(heap)
            j = after[i]
            if sizes[i] != size or j < 0 or sizes[j] != other:
                continue
            sizes[i], sizes[j], after[i] = size + other, 0, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [self.ids.get(BLANK * s, self.unknown) for s in sizes if s]

    def edges(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and piece of every occurrence of a piece in `letters` (0 closes a word): suffixes are sorted
        by as many characters as the longest piece has, and each piece is searched among them."""
        n = len(letters)
        _, rank = np.unique(letters, return_inverse=True)
        step = 1
        while step < self.longest:
            follow = np.zeros(n, np.int64)
            follow[: max(0, n - step)] = rank[step:] + 1
            _, rank = np.unique(rank * (n + 1) + follow, return_inverse=True)
            step *= 2
        order = np.argsort(rank, kind="stable")
        padded = np.r_[letters, np.zeros(self.longest, np.int64)]
        sizes = self.length[self.matched]
        low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), n)
        for depth in range(self.longest):
            live = np.flatnonzero((sizes > depth) & (low < high))
            if not len(live):
                break
            wanted = self.spelling[live, depth]
            low[live], high[live] = (self._edge(order, padded, depth, wanted + add, low[live], high[live]) for add in (0, 1))
        found = np.maximum(high - low, 0)
        return order[ragged(low, found)], np.repeat(self.matched, found)

    @staticmethod
    def _edge(order: np.ndarray, padded: np.ndarray, depth: int, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first suffix of each range whose character at `depth` is not below the wanted one."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            mid = (low + high) // 2
            below = open_ & (padded[order[np.minimum(mid, len(order) - 1)] + depth] < wanted)
            low = np.where(below, mid + 1, low)
            high = np.where(open_ & ~below, mid, high)
        return low

    def segment(self, words: list[str]) -> list[bytes]:
        """Ids of words that begin with one blank at most. Edges go by their start in their word, all words at
        once: an edge holds if its piece stays apart from the piece that ends where it starts, and of the
        edges that end at a place exactly one holds."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes + 1) - sizes - 1
        letters = np.zeros(int(starts[-1] + sizes[-1] + 1), np.int64)
        inner = ragged(starts, sizes)
        letters[inner] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        start, piece = self.edges(letters)
        single = np.zeros(len(letters), bool)
        single[start[self.length[piece] == 1]] = True
        strange = inner[~single[inner]]
        start, piece = np.r_[start, strange], np.r_[piece, np.full(len(strange), self.width - 1)]
        word = np.repeat(np.arange(len(words)), sizes + 1)
        place = start - starts[word[start]]
        sort = np.argsort(place, kind="stable")
        start, piece, place = start[sort], piece[sort], place[sort]
        ending = np.full(len(letters) + 1, -1)
        bounds = np.r_[np.flatnonzero(np.r_[True, place[1:] != place[:-1]]), len(place)]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            s, p = start[a:b], piece[a:b]
            holds = np.ones(len(s), bool) if place[a] == 0 else self.together(ending[s], p)
            ending[s[holds] + self.length[p[holds]]] = p[holds]
        at, live = starts + sizes, np.flatnonzero(sizes > 0)
        taken: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(live):
            p = ending[at[live]]
            at[live] -= self.length[p]
            taken.append((live, at[live], p))
            live = live[at[live] > starts[live]]
        owner, begin, p = (np.concatenate(c) for c in zip(*taken, strict=True)) if taken else (np.empty(0, np.int64),) * 3
        sort = np.argsort(begin, kind="stable")
        owner, begin, p = owner[sort], begin[sort], p[sort]
        counts = np.bincount(owner, minlength=len(words))
        flat = self.with_bytes(p, letters[begin])
        if flat is None:
            data, ends = p.astype(np.int32).tobytes(), np.cumsum(counts).tolist()
        else:
            ids, per_piece = flat
            data = ids.tobytes()
            ends = np.r_[0, np.cumsum(per_piece)][np.cumsum(counts)].tolist()
        return [data[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def with_bytes(self, pieces: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Pieces with characters that have none replaced by their bytes; None if there are no such characters."""
        strange = np.flatnonzero(pieces == self.width - 1)
        if not len(strange):
            return None
        out, sizes = [p for p in np.split(pieces.astype(np.int32), strange)], np.ones(len(pieces), np.int64)
        for k, i in enumerate(strange.tolist()):
            values = np.frombuffer(chr(letters[i]).encode(), np.uint8)
            sizes[i] = len(values)
            out[k + 1] = np.r_[self.byte_ids[values], out[k + 1][1:]]
        return np.concatenate(out).astype(np.int32), sizes

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words. Short words are remembered for a while; the bound on how many only costs or
        spares time."""
        found = {w: ids for w in words if (ids := self.recent.get(w)) is not None}
        again = {w: ids for w in words if w not in found and (ids := self.older.get(w)) is not None}
        found |= again
        new = [w for w in words if w not in found]
        if len(self.recent) + len(again) + len(new) > CACHED_WORDS:
            self.recent, self.older = {}, self.recent
        self.recent |= again
        for first in range(0, len(new), WORDS_AT_ONCE):
            part = new[first : first + WORDS_AT_ONCE]
            blanks = [len(w) - len(w.lstrip(BLANK)) for w in part]
            short = [w[b - 1 :] if b else w for w, b in zip(part, blanks, strict=True)]
            distinct = list(dict.fromkeys(short))
            ids = dict(zip(distinct, self.segment(distinct), strict=True))
            alone = np.int32(self.ids.get(BLANK, -1)).tobytes()
            for w, b, s in zip(part, blanks, short, strict=True):
                own = ids[s]
                if b > 1:
                    free = own[:4] == alone
                    own = np.array(self.blank_run(b if free else b - 1), np.int32).tobytes() + (own[4:] if free else own)
                found[w] = own
                if len(w) <= CACHED_CHARS:
                    self.recent[w] = own
        return found

    def encode(self, texts: pa.Array) -> pa.Array:
        """One list of ids for each text of a large string array without nulls."""
        lists = []
        for text in texts.to_numpy(zero_copy_only=False).tolist():
            marked = text.replace(" ", BLANK)
            lists.append(self.words.findall(BLANK + marked if self.prefix and marked else marked))
        ids = self.learn(list(set().union(*lists)))
        data = [b"".join(map(ids.__getitem__, words)) for words in lists]
        offsets = np.r_[0, np.cumsum(np.fromiter(map(len, data), np.int64, len(data)) // 4)]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(data), np.int32)))

    def decode(self, lists: pa.Array) -> pa.Array:
        """The text of each list of ids; bytes that are no UTF-8 become replacement characters."""
        out = []
        for a, b in zip(lists.offsets[:-1].to_pylist(), lists.offsets[1:].to_pylist(), strict=True):
            ids = lists.values[a:b].to_numpy(zero_copy_only=False)
            sizes = self.text_sizes[ids]
            data = self.text_bytes[ragged((np.cumsum(self.text_sizes) - self.text_sizes)[ids], sizes)].tobytes()
            out.append(data.decode("utf-8", "replace").removeprefix(" " if self.prefix else ""))
        return pa.array(out, pa.string())


def _model(path: str) -> PieceModel:
    return held(("pieces", path), lambda: PieceModel(path))


def encoded(text: Column, path: str) -> Column:
    """Ids of a text column as `array<int>`; no ids for null and for empty texts."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    @thrifty
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _model(path)
        for texts in batches:
            parts = [model.encode(chunk) for chunk in text_chunks(texts, CHUNK_BYTES)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return ids.asNondeterministic()(F.coalesce(text, F.lit("")))


def decoded(ids: Column, path: str) -> Column:
    """The text of an `array<int>` column; empty for null."""

    @F.arrow_udf(T.StringType())
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _model(path)
        for lists in batches:
            yield model.decode(lists)

    return texts(F.coalesce(ids, F.array().cast("array<int>")))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """`doc_id, n_ids, ids` for every row of `docs(doc_id, text, ...)`; other columns are ignored."""
    rows = docs.select("doc_id", encoded(F.col("text"), path).alias("ids"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids")


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """`doc_id, n_bytes, n_ids, ids_crc32, decoded_crc32, round_trip` for every row of `docs(doc_id, text, ...)`.

    `round_trip` says that decoding gives the text back; it does not where the text itself holds the blank's
    letter. Null texts count as empty; null and repeated ids keep a row each; an empty table gives an empty
    result.
    """

    kind = T.StructType([T.StructField(n, T.LongType()) for n in ("n_ids", "ids_crc32", "decoded_crc32")] + [T.StructField("round_trip", T.BooleanType())])

    @F.arrow_udf(kind)
    def both_ways(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _model(path)
        for texts in batches:
            parts = []
            for chunk in text_chunks(texts, CHUNK_BYTES):
                lists = model.encode(chunk)
                back = model.decode(lists)
                offsets = lists.offsets.to_numpy()
                data = lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                again = [zlib.crc32(t.encode()) for t in back.to_numpy(zero_copy_only=False).tolist()]
                same = pc.equal(back.cast(pa.large_string()), chunk)
                parts.append(pa.StructArray.from_arrays([pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64()), pa.array(again, pa.int64()), same], names=kind.names))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([(n, pa.int64()) for n in kind.names[:3]] + [("round_trip", pa.bool_())]))

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), both_ways.asNondeterministic()(text).alias("_r"))
    return rows.select("doc_id", "n_bytes", *[F.col("_r")[n].alias(n) for n in kind.names])
