"""Operators 11 to 13 against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkroster.llm import prefix_trie, substring_dedup
from sparkroster.llm.centroid_clusters import LIMIT, SortedLists, cluster_report, digest
from sparkroster.llm.prefix_trie import trie_report
from sparkroster.llm.substring_dedup import packed, rabin_karp, repeats_of, repeats_removed, unpacked, without_repeats


def cut(rows, size):
    """Documents in order of id; words under windows that were seen before go."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            window = tuple(words[i : i + size])
            if window in seen:
                gone[i : i + size] = [True] * size
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_rabin_karp_is_the_polynomial():
    words = np.random.default_rng(0).integers(0, 2**63, 60).astype(np.uint64)
    for size in (1, 2, 3, 7, 20, 31, 60, 61):
        want = [sum(int(words[i + k]) * pow(12345, size - 1 - k, 1 << 64) for k in range(size)) % (1 << 64) for i in range(61 - size)]
        assert rabin_karp(words, size, 12345).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1), st.integers(-(2**63), 2**63 - 1), st.integers(0, 2**31 - 1), st.integers(0, 2**64 - 1))))
def test_packing_is_undone(rows):
    docs, parts, places, hashes = (np.array([r[i] for r in rows], kind) for i, kind in enumerate((np.int64, np.int64, np.int64, np.uint64)))
    back = unpacked(packed(docs, parts, places, hashes))
    assert all(np.array_equal(a, b) for a, b in zip(back, (docs, parts, places, hashes), strict=True))


def test_equal_windows_of_one_place_are_no_repeat():
    hashes, docs, parts, places = (np.array(c) for c in ([7, 7, 7, 8], [1, 1, 1, 0], [0, 0, 0, 0], [5, 5, 9, 1]))
    assert repeats_of(hashes, docs, parts, places).tolist() == [2]


@pytest.mark.parametrize("size", [1, 3, 6])
def test_repeats_match_brute_force(spark, size):
    source = random.Random(size)
    rows = [(i, source.choice(" \t\n").join(source.choice("ab") for _ in range(source.randrange(40)))) for i in range(200)]
    source.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r[0]: tuple(r[1:]) for r in repeats_removed(docs, size).collect()} == cut(rows, size)


def test_repeats_in_pieces_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "WORD_BYTES", 7)
    words = substring_dedup.word_hashes(np.frombuffer(b"aa bb  aa\tbbcc " + b"x" * 30 + b" aa", np.uint8), np.array([0, 5, 5, 48]))
    assert words[1].tolist() == [0, 0, 2, 2, 2, 2] and words[0][0] == words[0][2] == words[0][5] != words[0][1]
    long_text = "una storia lunga che torna " * 30_000
    rows = [(1, long_text), (2, "nothing of it"), (3, "una storia lunga che torna " * 10)]
    got = {r[0]: tuple(r[1:]) for r in repeats_removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == cut(rows, 20)


def test_odd_documents_of_repeats(spark, odd_docs):
    out = without_repeats(odd_docs, 2)
    assert out.columns == ["doc_id", "n_words", "n_removed", "spans", "kept"]
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    got = defaultdict(set)
    for r in rows:
        got[r["doc_id"]].add((r["n_words"], r["n_removed"], r["kept"]))
    # Rows alike in id and text are one document; a row without id stands after all others.
    assert got[4] == {(4, 0, "Hello, World! don't stop")}
    assert got[None] == {(4, 4, ""), (0, 0, "")}
    assert got[1] == got[2] == got[3] == {(0, 0, "")}
    assert without_repeats(odd_docs.limit(0)).collect() == []


def test_one_id_with_unlike_texts(spark):
    rows = [(1, "a b c d"), (1, "x a b c"), (2, "b c d e")]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect())
    assert [g[:2] for g in got] == [(1, 4), (1, 4), (2, 4)]
    # One of the two rows of id 1 keeps the passage that they share.
    assert sorted(g[2] for g in got[:2]) == [0, 3] and got[2][2] == 3


def lloyd(rows, k, rounds):
    points = {i: [math.floor(64 * x) for x in v] for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(64 * x) <= LIMIT for x in v)}
    names = sorted(points, key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())
    centroids = [points[i] for i in names[:k]]

    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        of = defaultdict(list)
        for p in points.values():
            of[nearest(p)[1]].append(p)
        centroids = [[sum(c) // len(of[n]) for c in zip(*of[n], strict=True)] if n in of else c for n, c in enumerate(centroids)]
    found = {i: nearest(p) for i, p in points.items()}
    sums = Counter()
    for d, n in found.values():
        sums[n] += d
    return sorted((i, n, d, sums[n], sum(sums.values()), digest(np.array(centroids[n]))) for i, (d, n) in found.items())


def test_threshold_walk_finds_the_nearest():
    source = np.random.default_rng(5)
    for k, spread in ((1, 3), (2, 2), (16, 3), (16, 1000)):
        centroids, points = source.integers(-spread, spread, (k, 6)), source.integers(-spread, spread, (300, 6))
        label, distance, _ = SortedLists(centroids).nearest(points)
        exact = ((points[:, None] - centroids) ** 2).sum(axis=2)
        assert (label == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    # Far centroids are never looked at.
    centroids = np.arange(16)[:, None] * np.full((1, 6), 1000)
    _, _, looked = SortedLists(centroids).nearest(centroids + 1)
    assert looked.max() == 1
    edge = np.array([[LIMIT] * 6, [-LIMIT] * 6])
    assert SortedLists(edge).nearest(edge)[1].tolist() == [0, 0]


def test_clusters_match_brute_force(spark):
    source = random.Random(2)
    rows = [(i, [source.choice([-0.5, 0.0, 0.24, 0.51]) + (i % 5) for _ in range(64)]) for i in range(120)]
    rows += [(i, rows[3][1]) for i in range(120, 126)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for k, rounds in ((16, 3), (3, 0), (5, 1)):
        got = cluster_report(vectors, k, rounds)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert sorted(map(tuple, got.collect())) == lloyd(rows, k, rounds)


def test_odd_vectors(spark):
    fine = [[0.1 * i] * 64 for i in range(3)]
    odd = [None, [], [0.5] * 63, [0.5] * 65, [0.5] * 63 + [None], [0.5] * 63 + [float("nan")], [0.5] * 63 + [float("inf")], [0.5] * 63 + [1e30]]
    rows = [(i, v, 1) for i, v in enumerate(fine + odd)]
    kind = "vec_id long, embedding array<float>, cluster int"
    got = sorted(map(tuple, cluster_report(spark.createDataFrame(rows, kind)).collect()))
    assert [g[0] for g in got] == [0, 1, 2] and {g[2] for g in got} == {0}
    # Repeated rows and rows without id take part, the latter are no first centroids.
    again = cluster_report(spark.createDataFrame([*rows, rows[1], (None, fine[0], 1)], kind), 2, 1).collect()
    assert sorted(str(r["vec_id"]) for r in again) == ["0", "1", "1", "2", "None"]
    assert cluster_report(spark.createDataFrame(rows[3:], kind)).collect() == []
    assert [r["cluster"] for r in cluster_report(spark.createDataFrame([(None, fine[1], 1)], kind)).collect()] == []


def trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    built = {}
    for c, turns in convs.items():
        turns.sort(key=lambda t: t[:2])
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = convs.get(c - int(math.fmod(c, 100)), [])
        built[c] = tuple(t[2:] for t in base[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids, leaves, saved = Counter(s[:-1] for s in members if s), Counter(), Counter()
    for s, m in members.items():
        for d in range(len(s) + 1):
            saved[s[:d]] += (len(m) - 1) * (len(s[-1][1]) if s else 0)
            leaves[s[:d]] += not kids[s]
    out = []
    for s, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(s))
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), kids[s], leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, block string"


@pytest.mark.parametrize("block_turns, hot, batch", [(512, 10_000, 10_000), (6, 10_000, 7), (8, 15, 3)])
def test_trie_matches_brute_force(spark, monkeypatch, block_turns, hot, batch):
    """Short blocks, pieces of few rows and long conversations that are numbered by ranges give the same nodes."""
    monkeypatch.setattr(prefix_trie, "HOT_TURNS", hot)
    source, rows = random.Random(block_turns), [(None, 1, "user", "x", 0, "")]
    for c in source.sample(range(-150, 500), 90):
        for t in range(source.choice([1, 2, 3, 8, 20, 40])):
            number = None if t == 0 and source.random() < 0.1 else t
            rows.append((c, number, source.choice("ua") if t > 6 else "u", source.choice(["x", "yy", "é😀", None]) if t % 7 == 5 else "same", 1, "b"))
    source.shuffle(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = trie_report(spark.createDataFrame(rows, CONVERSATIONS).repartition(3), block_turns)
        assert sorted(map(tuple, got.collect()), key=str) == trie(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_trie_of_many_equal_conversations(spark):
    rows = [(c, t, "u", "hello", 1, "b") for c in range(5000, 11_000, 1) for t in range(2)] + [(400, 0, "u", "y" * 200_000, 1, "b")]
    got = trie_report(spark.createDataFrame(rows, CONVERSATIONS))
    assert sorted(map(tuple, got.collect()), key=str) == trie(rows)


def test_trie_of_odd_conversations(spark):
    # Repeated rows are turns like any other; roles and texts may be null.
    rows = [(200, 0, None, None, 1, "b")] * 3 + [(200, None, "u", "", 1, "b"), (201, 5, "", "", 1, "b"), (-3, 2, "a", None, 1, "b")]
    got = trie_report(spark.createDataFrame(rows, CONVERSATIONS))
    assert sorted(map(tuple, got.collect()), key=str) == trie(rows)
    assert trie_report(spark.createDataFrame([], CONVERSATIONS)).collect() == []
    with pytest.raises(ValueError):
        trie_report(spark.createDataFrame(rows, CONVERSATIONS), 5)
