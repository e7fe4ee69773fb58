"""Quality classifier: a generalised additive model with pairwise interactions. Cyclic boosting of shallow trees
over binned features leaves one lookup table for each feature and pair; a score is a sum of table entries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_fold, labelled_sample, span_hashes, spans_of, text_bytes, text_chunks
from .workers import held, thrifty

MAX_ROWS = 20_000
FEATURES = (
    "log_bytes", "letters", "upper", "digits", "blanks", "stops", "symbols", "high", "log_words", "word_bytes",
    "distinct_words", "top_word", "repeated_words", "log_lines", "repeated_lines", "long_word",
)

_byte = np.arange(256)
_UPPER = (_byte >= 65) & (_byte <= 90)
_LETTER = _UPPER | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)
_DIGIT = (_byte >= 48) & (_byte <= 57)
_BLANK = (_byte == 32) | ((_byte >= 9) & (_byte <= 13))
_STOP = np.isin(_byte, [ord(c) for c in ".,;:?'\"-()"])
_SYMBOL = ~(_LETTER | _DIGIT | _BLANK | _STOP)


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.r_[0, np.cumsum(values)]
    return (sums[bounds[1:]] - sums[bounds[:-1]]).astype(float)


def _repeats(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different hashes each owner has, and how often it has its most frequent one."""
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    first = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (h[1:] != h[:-1])]) if len(o) else np.empty(0, np.int64)
    size = np.diff(np.r_[first, len(o)])
    top = np.zeros(n)
    np.maximum.at(top, o[first], size)
    return np.bincount(o[first], minlength=n).astype(float), top


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text of a large string array without nulls; all are finite."""
    data, offsets = text_bytes(texts)
    n = len(texts)
    size = np.diff(offsets).astype(float)
    some = np.maximum(size, 1)
    share = {name: _per_text(kind[data], offsets) / some for name, kind in (("letters", _LETTER), ("digits", _DIGIT), ("blanks", _BLANK), ("stops", _STOP), ("symbols", _SYMBOL), ("high", _byte >= 128))}
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    columns = {"upper": _per_text(_UPPER[data], offsets) / np.maximum(_per_text(_LETTER[data], offsets), 1)}
    # A word or line ends at its separator or where the next text begins.
    for name, gap in (("words", _BLANK[data]), ("lines", (data == 10) | (data == 13))):
        starts, ends = spans_of(~gap)
        cut = offsets[1:-1]
        cut = np.unique(cut[(cut > 0) & (cut < len(data))]) if len(cut) else cut
        inside = cut[~gap[cut] & ~gap[cut - 1]] if len(cut) else cut
        starts, ends = np.sort(np.r_[starts, inside]), np.sort(np.r_[ends, inside])
        owner = np.searchsorted(offsets[1:], starts, side="right")
        count = np.bincount(owner, minlength=n).astype(float)
        hashes = span_hashes(data, starts, ends)
        different, top = _repeats(owner, hashes, n)
        many = np.maximum(count, 1)
        columns[f"log_{name}"] = np.log1p(count)
        if name == "words":
            length = ends - starts
            again = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
            columns["word_bytes"] = np.bincount(owner, length, n) / many
            columns["distinct_words"], columns["top_word"] = different / many, top / many
            columns["repeated_words"] = np.bincount(owner[1:][again], minlength=n) / many
            columns["long_word"] = np.zeros(n)
            np.maximum.at(columns["long_word"], owner, np.log1p(length))
        else:
            columns["repeated_lines"] = (count - different) / many
    columns |= share | {"log_bytes": np.log1p(size)}
    return np.stack([columns[name] for name in FEATURES], axis=1)


@dataclass
class AdditiveModel:
    """Bin edges and lookup tables: a log-odds is the base plus one entry of every table."""

    edges: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def log_odds(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for j, table in enumerate(self.tables):
            out += table[bins[:, j]]
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            out += grid[bins[:, i], bins[:, j]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(self.bins(x)), -30, 30)))


def _leaf(gradient: np.ndarray, hessian: np.ndarray, penalty: float) -> np.ndarray:
    return gradient / (hessian + penalty)


def _gains(gradient: np.ndarray, hessian: np.ndarray, penalty: float) -> np.ndarray:
    """Gain of a cut after each bin but the last."""
    g, h = np.cumsum(gradient), np.cumsum(hessian)
    return g[:-1] ** 2 / (h[:-1] + penalty) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + penalty) - g[-1] ** 2 / (h[-1] + penalty)


def _shallow_tree(gradient: np.ndarray, hessian: np.ndarray, penalty: float) -> np.ndarray:
    """A value for each bin of one feature: a cut of all bins and one of each side."""
    out = np.zeros(len(gradient))
    sides = [(0, len(gradient))]
    for _ in range(2):
        halves = []
        for a, b in sides:
            if b - a > 1:
                cut = a + 1 + int(np.argmax(_gains(gradient[a:b], hessian[a:b], penalty)))
                halves += [(a, cut), (cut, b)]
            else:
                halves.append((a, b))
        sides = halves
    for a, b in sides:
        out[a:b] = _leaf(gradient[a:b].sum(), hessian[a:b].sum(), penalty)
    return out


def _quadrants(gradient: np.ndarray, hessian: np.ndarray, penalty: float) -> np.ndarray:
    """A value for each cell of two features: the four quadrants of the pair of cuts with the best gain."""
    rows, columns = gradient.shape
    if rows < 2 or columns < 2:
        return np.zeros_like(gradient)

    def corners(values: np.ndarray) -> list[np.ndarray]:
        sums = values.cumsum(axis=0).cumsum(axis=1)
        low, up, left, total = sums[:-1, :-1], sums[:-1, -1:], sums[-1:, :-1], sums[-1, -1]
        return [low, up - low, left - low, total - up - left + low]

    parts = [(g, h + penalty) for g, h in zip(corners(gradient), corners(hessian), strict=True)]
    best = np.unravel_index(np.argmax(sum(g**2 / h for g, h in parts)), (rows - 1, columns - 1))
    values = [g[best] / h[best] for g, h in parts]
    below = np.arange(rows)[:, None] <= best[0], np.arange(columns)[None, :] <= best[1]
    return np.where(below[0], np.where(below[1], values[0], values[1]), np.where(below[1], values[2], values[3]))


def fit(x: np.ndarray, y: np.ndarray, n_bins: int = 48, rounds: int = 150, n_pairs: int = 6, pair_rounds: int = 50, rate: float = 0.1, penalty: float = 4.0) -> AdditiveModel:
    """Boost the tables of single features in turn, then those of the pairs with the largest gain on what is
    left. Without rows, or with one label only, every score is the smoothed share of label 1."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    quantiles = np.linspace(0, 1, n_bins + 1)[1:-1]
    edges = [np.unique(np.quantile(c, quantiles)) if len(x) else np.empty(0) for c in x.T]
    model = AdditiveModel(edges, float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    bins = model.bins(x)
    sizes = [len(e) + 1 for e in edges]
    model.tables = [np.zeros(s) for s in sizes]
    odds = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, size in enumerate(sizes):
            gradient, hessian = slopes()
            step = rate * _shallow_tree(np.bincount(bins[:, j], gradient, size), np.bincount(bins[:, j], hessian, size), penalty)
            model.tables[j] += step
            odds += step[bins[:, j]]
    gradient, hessian = slopes()

    def grid(i: int, j: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(bins[:, i] * sizes[j] + bins[:, j], values, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    def gain(i: int, j: int) -> float:
        g, h = grid(i, j, gradient), grid(i, j, hessian)
        values = _quadrants(g, h, penalty)
        return float((values * g - values**2 * h / 2).sum())

    ranked = sorted(((gain(i, j), i, j) for i in range(len(sizes)) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for _, i, j in ranked[:n_pairs]]
    model.grids = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), total in zip(model.pairs, model.grids, strict=True):
            gradient, hessian = slopes()
            step = rate * _quadrants(grid(i, j, gradient), grid(i, j, hessian), penalty)
            total += step
            odds += step[bins[:, i], bins[:, j]]
    return model


def _rows(texts: pa.Array) -> np.ndarray:
    parts = [features(chunk) for chunk in text_chunks(texts)]
    return np.concatenate(parts) if parts else np.empty((0, len(FEATURES)))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _features(texts: pa.Array) -> pa.Array:
    x = _rows(texts)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, held_out: int = 1, max_rows: int = MAX_ROWS) -> AdditiveModel:
    """Fit on up to `max_rows` labelled rows (the documented bound of the sample) outside the held-out fold.
    Their features, `max_rows` short rows, come to the driver; texts do not."""
    sample = labelled_sample(docs, labels, label, ~in_fold(F.col("doc_id"), modulus, held_out), max_rows)
    rows = sample.select("y", _features(F.col("text")).alias("x")).toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    order = np.lexsort((*x.T, rows["y"].to_numpy()))
    return fit(x[order], rows["y"].to_numpy(float)[order])


def quality_score(text: Column, model: AdditiveModel) -> Column:
    """The score of a text column, 0 to 1; null counts as empty."""

    @F.arrow_udf(T.DoubleType())
    @thrifty
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held("quality")
        for texts in batches:
            yield pa.array(model.scores(_rows(texts)))

    return scored.asNondeterministic()(F.coalesce(text, F.lit("")))


def quality(docs: DataFrame, labels: DataFrame, training_docs: DataFrame | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """`doc_id, held_out, score, predicted` for every row of `docs(doc_id, text, ...)`.

    Only the text enters the score. Null and empty texts get the score of an empty text; a null id is not
    held out; repeated rows keep a row each; with an empty table of labels all scores are 0.5; other columns
    are ignored.
    """
    model = train_quality(docs if training_docs is None else training_docs, labels, max_rows=max_rows)
    rows = docs.select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), quality_score(F.col("text"), model).alias("score"))
    return rows.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def of_good_quality(docs: DataFrame, labels: DataFrame, training_docs: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier does not reject, with all their columns."""
    return docs.where(quality_score(F.col("text"), train_quality(training_docs, labels)) >= 0.5)
