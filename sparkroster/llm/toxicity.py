"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding homoglyphs and digit substitutions, with
exception phrases, normalised by length."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_fold, labelled_sample, materialised, text_chunks
from .workers import held, thrifty

MAX_ROWS = 20_000
#: Least weight of a candidate, and of its weight times the root of its toxic documents: rarer terms must weigh more.
LEAST_WEIGHT, LEAST_EVIDENCE = 2.0, 8.0
STEM_SIZES = (4, 5, 6, 7, 8)
LEAST_DOCS = 4
COVERS = 5
WORD = re.compile(r"[^\W\d_]+")

# Letters of other scripts and marks that look like Latin letters, and digits and signs put for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l",
}
SUBSTITUTIONS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


@lru_cache(maxsize=1)
def _folding() -> dict[int, str]:
    """Full-width forms are a fixed distance from ASCII; the rest is listed above."""
    wide = {chr(0xFEE0 + c): chr(c).lower() for c in range(0x21, 0x7F)}
    return str.maketrans({**wide, **HOMOGLYPHS, **SUBSTITUTIONS})


def folded_words(text: str) -> list[str]:
    """Words after lower-casing and folding; digits and signs count as letters only where they touch one."""
    lower = text.lower()
    plain = lower.translate(_folding())
    if len(plain) == len(lower):
        words = []
        for m in WORD.finditer(plain):
            if any(c.isalpha() for c in lower[m.start() : m.end()]):
                words.append(m[0])
        return words
    return WORD.findall(plain)


@dataclass
class Lexicon:
    """Terms are ` word ` or a stem ` wor`; a phrase that holds a term's word takes that term's weight back."""

    weights: dict[str, float] = field(default_factory=dict)
    phrases: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_matcher"}

    def matcher(self):
        if "_matcher" not in self.__dict__:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for text, weight in [*self.weights.items(), *self.phrases.items()]:
                machine.add_word(text, (text, weight))
            if len(machine):
                machine.make_automaton()
            self._matcher = machine
        return self._matcher

    def hits(self, words: list[str]) -> Counter:
        """How often each term and phrase stands in the words."""
        machine = self.matcher()
        found: Counter = Counter()
        if len(machine):
            for _, (text, _) in machine.iter(f" {' '.join(words)} "):
                found[text] += 1
        return found

    def sums(self, words: list[str]) -> tuple[float, float]:
        """Weight of the different terms that hold, and the weight of all hits for a hundred words."""
        hits = self.hits(words)
        for phrase in [p for p in hits if p in self.phrases]:
            n = hits.pop(phrase)
            for term in [t for t in hits if t in self.weights and t in phrase]:
                hits[term] -= n
        terms = {t: n for t, n in hits.items() if n > 0 and t in self.weights}
        total = sum(self.weights[t] * n for t, n in terms.items())
        return sum(self.weights[t] for t in terms), 100 * total / max(len(words), 20)

    def score(self, text: str) -> float:
        different, dense = self.sums(folded_words(text))
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * math.log1p(different) + c * math.log1p(dense)))))


def _terms(words: list[str]) -> set[str]:
    different = set(words)
    return {f" {w} " for w in different} | {f" {w[:n]}" for w in different for n in STEM_SIZES if len(w) > n}


def _contexts(words: list[str], lexicon: Lexicon) -> set[str]:
    """The phrases of two words around each word that holds a term."""
    out = set()
    for i, word in enumerate(words):
        if any(f" {word} ".startswith(t) for t in _terms([word]) if t in lexicon.weights):
            if i:
                out.add(f" {words[i - 1]} {word} ")
            if i + 1 < len(words):
                out.add(f" {word} {words[i + 1]} ")
    return out


def _document_counts(sample: DataFrame, of: object) -> DataFrame:
    """`term, toxic, other`: documents of either label that hold a term, combined in each task first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            per_label = (Counter(), Counter())
            for y, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                per_label[1 if y == 1 else 0].update(of(words))
            terms = sorted(per_label[0].keys() | per_label[1].keys())
            yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "toxic": pa.array([per_label[1][t] for t in terms], pa.int64()), "other": pa.array([per_label[0][t] for t in terms], pa.int64())})

    rows = sample.mapInArrow(counted, "term string, toxic long, other long")
    return rows.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def folded_sample(sample: DataFrame) -> DataFrame:
    """`y, words` of `sample(y, text)`, written once, as training reads it several times."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                words = [folded_words(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_pydict({"y": part.column(0).cast(pa.int32()), "words": pa.array(words, pa.list_(pa.string()))})

    return materialised(sample.select("y", "text").mapInArrow(folded, "y int, words array<string>"), "toxicity-sample")


def _weight(toxic: Column, other: Column, n_toxic: int, n_other: int) -> Column:
    return F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((other + 0.5) / (n_other + 1))


def _choose(rows: list[tuple[int, list[str]]]) -> list[str]:
    """Terms taken one by one, the one first that reaches most toxic documents in which fewer than `COVERS`
    chosen terms hold, less a multiple of what it reaches of the others; it must gain `LEAST_DOCS`. Of equals
    the longer one is taken."""
    holders: dict[str, list[int]] = {}
    for i, (_, hits) in enumerate(rows):
        for t in hits:
            holders.setdefault(t, []).append(i)
    label = np.array([y for y, _ in rows], np.int64)
    at = {t: np.array(h) for t, h in holders.items()}
    cost = {t: 3 * int((label[h] == 0).sum()) for t, h in at.items()}
    free = np.where(label == 1, COVERS, 0)
    chosen: list[str] = []
    gains = {t: int((free[at[t]] > 0).sum()) - cost[t] for t in sorted(at)}
    while gains:
        # Gains only fall: a term whose fresh gain still leads is the best one.
        term = max(gains, key=lambda t: (gains[t], len(t), t))
        fresh = int((free[at[term]] > 0).sum()) - cost[term]
        if fresh < gains[term]:
            gains[term] = fresh
            continue
        if fresh < LEAST_DOCS:
            break
        chosen.append(term)
        free[at[term]] -= 1
        stem = term.rstrip()
        # A stem and the words it begins hold in the same places.
        gains = {t: g for t, g in gains.items() if not (t.startswith(stem) or stem.startswith(t.rstrip()))}
    return chosen


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression of the label on both sums, by Newton steps with a small ridge."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (y - p) - 0.01 * beta * [0, 1, 1]
        curve = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-6, 0.01, 0.01])
        step = np.linalg.solve(curve, slope)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(beta.tolist())


def train_lexicon(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, held_out: int = 0, max_rows: int = MAX_ROWS) -> Lexicon:
    """Learn terms, weights, exception phrases and the curve from up to `max_rows` labelled rows (the documented
    bound of the sample) outside the held-out fold. Words and stems are counted in Spark; what comes to the driver
    are the terms that reach `LEAST_DOCS`, `LEAST_WEIGHT` and `LEAST_EVIDENCE`, those of each sampled row, and the phrases that
    reach `LEAST_DOCS`: all bounded by the sample. Without rows of both labels no term is learnt and every
    score is the smoothed share of label 1."""
    sample = folded_sample(labelled_sample(docs, labels, label, ~in_fold(F.col("doc_id"), modulus, held_out), max_rows))
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    base = math.log((n_toxic + 0.5) / (n_other + 0.5))
    if not n_toxic or not n_other:
        return Lexicon(curve=(base, 0.0, 0.0))
    counts = _document_counts(sample, _terms).where(F.col("toxic") >= LEAST_DOCS)
    weighed = counts.withColumn("weight", _weight(F.col("toxic"), F.col("other"), n_toxic, n_other))
    top = weighed.where((F.col("weight") > LEAST_WEIGHT) & (F.col("weight") * F.sqrt("toxic") >= LEAST_EVIDENCE))
    lexicon = Lexicon({r["term"]: r["weight"] for r in top.orderBy("term").collect()})

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_pydict({"y": batch.column(0), "hits": pa.array([list(lexicon.hits(t)) for t in texts], pa.list_(pa.string()))})

    rows = [(r["y"], sorted(r["hits"])) for r in sample.mapInArrow(seen, "y int, hits array<string>").where("size(hits) > 0").collect()]
    chosen = _choose(sorted(rows))
    lexicon = Lexicon({t: lexicon.weights[t] for t in chosen})
    around = _document_counts(sample, lambda words: _contexts(words, lexicon)).where((F.col("other") >= LEAST_DOCS) & (F.col("toxic") * 9 <= F.col("other")))
    lexicon = Lexicon(lexicon.weights, {r["term"]: 0.0 for r in around.orderBy("term").collect()})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [lexicon.sums(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"y": batch.column(0), "a": pa.array([a for a, _ in pairs], pa.float64()), "b": pa.array([b for _, b in pairs], pa.float64())})

    fitted = sample.mapInArrow(summed, "y int, a double, b double").toPandas().sort_values(["y", "a", "b"])
    x = np.log1p(fitted[["a", "b"]].to_numpy(float))
    return Lexicon(lexicon.weights, lexicon.phrases, _curve(x, fitted["y"].to_numpy(float)))


def toxicity_score(text: Column, lexicon: Lexicon) -> Column:
    """The score of a text column, 0 to 1; null counts as empty."""

    @F.arrow_udf(T.DoubleType())
    @thrifty
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held("toxicity")
        for texts in batches:
            yield pa.array([lexicon.score(t) for chunk in text_chunks(texts) for t in chunk.to_pylist()], pa.float64())

    return scored.asNondeterministic()(F.coalesce(text, F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """`doc_id, held_out, score, predicted` for every row of `docs(doc_id, text, ...)`.

    Only the text enters the score. Null and empty texts hold no term; a null id is not held out; repeated
    rows keep a row each; with an empty table of labels all scores are 0.5; other columns are ignored.
    """
    lexicon = train_lexicon(docs, labels, max_rows=max_rows)
    rows = docs.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), toxicity_score(F.col("text"), lexicon).alias("score"))
    return rows.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def not_toxic(docs: DataFrame, labels: DataFrame, training_docs: DataFrame) -> DataFrame:
    """The rows of `docs` that the lexicon does not reject, with all their columns."""
    return docs.where(toxicity_score(F.col("text"), train_lexicon(training_docs, labels)) < 0.5)
