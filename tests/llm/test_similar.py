"""Near-duplicates of vectors and texts against brute force."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkroster.llm import blocks, embedding_dedup, shingle_sets, simhash_dedup
from sparkroster.llm.components import connected_components
from sparkroster.llm.embedding_dedup import least_count, near_vectors, table_plan
from sparkroster.llm.simhash_dedup import fingerprint_of, fuzzy_keys, one_of_each_group, simhash_groups

BIG = np.iinfo(np.int64).max


def labels(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    while True:
        lower = np.minimum(ids, np.where(linked, ids[None, :], BIG).min(axis=1, initial=BIG))
        if (lower == ids).all():
            return ids
        ids = lower


def test_components_of_random_graphs(spark):
    source = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in source.integers(0, 150, (120, 2))] + [(200 + i, 201 + i) for i in range(40)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    nodes = np.array(sorted({x for e in edges for x in e}))
    at = {n: i for i, n in enumerate(nodes.tolist())}
    linked = np.zeros((len(nodes), len(nodes)), bool)
    for a, b in edges:
        linked[at[a], at[b]] = linked[at[b], at[a]] = True
    want = dict(zip(nodes.tolist(), labels(linked, nodes).tolist(), strict=True))
    assert {n: got.get(n, n) for n in want} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_vectors(rows):
    n = len(rows)
    linked = np.zeros((n, n), bool)
    good = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for size in {len(rows[k][1]) for k in good}:
        same = [k for k in good if len(rows[k][1]) == size]
        x = np.array([rows[k][1] for k in same], np.float32).astype(float)
        norm = np.linalg.norm(x, axis=1)
        linked[np.ix_(same, same)] = x @ x.T / np.outer(norm, norm) >= 0.95
    np.fill_diagonal(linked, False)
    ids = np.array([i for i, _ in rows])
    return [(int(i), int(c), int(r), int(i) == int(r)) for i, c, r in zip(ids, linked.sum(axis=1), labels(linked, ids), strict=True)]


@pytest.fixture(scope="module")
def vector_rows():
    source = np.random.default_rng(0)
    centres = source.standard_normal((30, 8))
    rows = []
    for k in range(700):
        v = centres[source.integers(30)] + source.standard_normal(8) * source.choice([0, 0.1, 0.25])
        rows.append((k, [float(x) for x in v.astype(np.float32)]))
    odd = [None, [0.0] * 8, [float("nan")] * 8, [], [1.0, None], [1.0, 2.0], [2.0, 4.0], [float("inf")] + [1.0] * 7]
    return rows + [(700 + k, v) for k, v in enumerate(odd)]


@pytest.mark.parametrize(("block", "cell"), [(2048, 256), (17, 20)])
def test_vectors_are_linked_as_by_brute_force(spark, monkeypatch, vector_rows, block, cell):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block)
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", cell)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vector_rows], "vec_id long, embedding array<float>, node long, key string")
    assert sorted(map(tuple, near_vectors(df).collect())) == brute_vectors(vector_rows)
    assert near_vectors(df.limit(0)).collect() == []


def test_a_plan_of_tables_keeps_its_recall():
    assert table_plan(100, 0.95) == (0, 1)
    for n in (1_000, 100_000, 10**9):
        signs, tables = table_plan(n, 0.95)
        same = (1 - np.arccos(0.95) / np.pi) ** signs
        assert (1 - same) ** tables <= 1e-4 and n / 2**signs <= embedding_dedup.CELL_ROWS
    assert 0 < least_count() <= embedding_dedup.PROJECTIONS


def test_recall_of_pairs_at_the_threshold():
    source = np.random.default_rng(5)
    a = source.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    away = source.standard_normal((400, 64))
    away -= (away * a).sum(axis=1, keepdims=True) * a
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    b = 0.9501 * a + np.sqrt(1 - 0.9501**2) * away
    both = np.concatenate([a, b]).astype(np.float32)
    q, r = embedding_dedup.links_in_block(both, np.zeros(800, np.int32), np.zeros((800, 1), np.int64), 0, 0.95)
    assert len(set(zip(q.tolist(), r.tolist(), strict=True)) & {(i, 400 + i) for i in range(400)}) >= 398


@pytest.mark.parametrize("cell", [4096, 128])
def test_planted_pairs_are_found_end_to_end(spark, monkeypatch, cell):
    """Pairs just above the threshold among unlike vectors, with one table of cells and with several."""
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", cell)
    source = np.random.default_rng(11)
    a = source.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    away = source.standard_normal((500, 64))
    away -= (away * a[:500]).sum(axis=1, keepdims=True) * a[:500]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cosine = source.uniform(0.9502, 0.96, (500, 1))
    b = cosine * a[:500] + np.sqrt(1 - cosine**2) * away
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]).astype(np.float32))]
    signs, tables = table_plan(len(rows), 0.95)
    assert (tables > 1) == (cell == 128)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    found = sum(got[1500 + i] == (1, i) for i in range(500))
    assert found >= 498 and all(got[i] == (0, i) for i in range(500, 1500))


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), seed=42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_groups(spark, odd_docs):
    for docs in (odd_docs, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        rows = [(r["doc_id"], slow_fingerprint(r["text"])) for r in docs.collect()]
        assert all(fingerprint_of(t or "") == f for t, (_, f) in zip([r["text"] for r in docs.collect()], rows, strict=True))
        prints = np.array([f for _, f in rows], np.uint64)
        ids = np.array([BIG if i is None else i for i, _ in rows])
        roots = labels(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4, ids)
        want = [(i, f"{f:016x}", None if r == BIG else int(r)) for (i, f), r in zip(rows, roots, strict=True)]
        assert sorted(map(tuple, simhash_groups(docs).collect()), key=str) == sorted(want, key=str)
    assert simhash_groups(odd_docs.limit(0)).collect() == []


def test_one_row_of_each_group_stays(spark, odd_docs):
    kept = one_of_each_group(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 4, 5, 6, 7, 8]
    assert kept.where("doc_id IS NULL").count() == 2


def test_close_fingerprints_share_a_key():
    source = np.random.default_rng(1)
    a = source.integers(-(1 << 63), (1 << 63) - 1, 3000)
    b = a.copy()
    for _ in range(4):
        b ^= (np.uint64(1) << source.integers(0, 64, 3000).astype(np.uint64)).view(np.int64)
    keys = [set(zip(*(x.tolist() for x in fuzzy_keys(side)), strict=True)) for side in (a, b)]
    assert len({row for row, _ in keys[0] & keys[1]}) == 3000


@pytest.mark.parametrize("limit", [4096, 7])
def test_crowded_fingerprints_lose_no_link(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash_dedup, "BLOCK_ROWS", limit)
    source, prints = np.random.default_rng(0), set()
    for base in source.integers(0, 1 << 62, 20).tolist():
        for _ in range(40):
            for bit in source.integers(0, 63, source.integers(0, 5)).tolist():
                base ^= 1 << bit
            prints.add(base)
    ordered = np.array(sorted(prints), np.int64)
    linked = np.bitwise_count((ordered[:, None] ^ ordered[None, :]).view(np.uint64)) <= 4
    got = dict(map(tuple, simhash_dedup.print_components(spark.createDataFrame([(p,) for p in prints], "print long")).collect()))
    assert [got.get(p, p) for p in ordered.tolist()] == labels(linked, ordered).tolist()


def test_a_hot_key_meets_itself_in_bounded_blocks(spark):
    rows = spark.range(2000).selectExpr("id", "IF(id % 3 = 0, 1, id) AS key")
    dealt = blocks.in_blocks(rows, "key", "id", 50)
    assert dealt.groupBy("key", "_block").count().agg({"count": "max"}).first()[0] <= 200
    hot = dealt.where("key = 1").select("id", "_block", "_slice").toPandas()
    pairs = set()
    for _, part in hot.groupby("_block"):
        two = part["_slice"].nunique() > 1
        values = part[["id", "_slice"]].to_numpy().tolist()
        for i, (a, s) in enumerate(values):
            for b, t in values[i + 1 :]:
                if not two or s != t:
                    pair = (min(a, b), max(a, b))
                    assert pair not in pairs
                    pairs.add(pair)
    n = hot["id"].nunique()
    assert len(pairs) == n * (n - 1) // 2


def test_large_keys_are_connected_without_meeting_all_rows(spark):
    """Rows link where their values differ by 1; a key's rows are connected as by comparing all of them."""
    source = np.random.default_rng(3)
    rows = [(k, int(i), int(v)) for k in (1, 2, 3) for i, v in enumerate(source.permutation([*range(90), *range(200, 230), *range(400, 402), 500])[: 200 if k > 1 else 5], 1000 * k)]
    seen = []

    def compare(dealt):
        found = []
        for (_, block), part in dealt.toPandas().groupby(["key", "_block"]):
            values = part[["node", "value"]].drop_duplicates().to_numpy().tolist()
            seen.append(len(values))
            found += [(a, b) for a, x in values for b, y in values if a < b and abs(x - y) == 1]
        return spark.createDataFrame(found, "a long, b long")

    table = spark.createDataFrame(rows, "key int, node long, value int")
    edges = [tuple(r) for r in blocks.linked_edges(table, "key", "node", 20, compare).collect()]
    assert max(seen) < 80
    nodes = sorted(n for _, n, _ in rows)
    at = {n: i for i, n in enumerate(nodes)}
    value = {n: (k, v) for k, n, v in rows}
    linked = np.array([[value[a][0] == value[b][0] and abs(value[a][1] - value[b][1]) <= 1 for b in nodes] for a in nodes])
    got = np.eye(len(nodes), dtype=bool)
    for a, b in edges:
        got[at[a], at[b]] = got[at[b], at[a]] = True
    assert (labels(got, np.array(nodes)) == labels(linked, np.array(nodes))).all()
    weighed = blocks.linked_edges(table.withColumn("n", F.lit(7)), "key", "node", 10_000, compare, "n", 140)
    assert {tuple(r) for r in weighed.collect()} and max(seen) < 80


@pytest.mark.parametrize("limit, band", [(512, 4096), (3, 5)])
def test_near_copies_on_five_word_shingles_go(spark, monkeypatch, limit, band):
    monkeypatch.setattr(shingle_sets, "SET_ROWS", limit)
    monkeypatch.setattr(shingle_sets, "BLOCK_ROWS", band)
    source = np.random.default_rng(4)
    texts = []
    for _ in range(30):
        words = [f"w{k}" for k in source.integers(0, 5000, 120)]
        for edits in (0, 1, 2, 3, 6, 12):
            copy = list(words)
            for at in source.integers(0, 120, edits):
                copy[at] = f"x{source.integers(0, 5000)}"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    alike = np.array([[len(a & b) * 5 >= 4 * len(a | b) for b in sets] for a in sets])
    prints = np.array([slow_fingerprint(t) for t in texts], np.uint64)
    linked = alike | (np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4)
    ids = np.arange(len(texts))
    want = set(labels(linked, ids).tolist())
    assert sorted(r["doc_id"] for r in one_of_each_group(docs).collect()) == sorted(want)
    assert len(want) < len({r["component_id"] for r in simhash_groups(docs).collect()})
    assert one_of_each_group(docs.limit(0)).collect() == []


def test_unlike_texts_of_one_id_stay_and_copies_without_id_go(spark):
    one, other, third = (" ".join(f"{w}{k}" for k in range(40)) for w in "abc")
    rows = [(1, one, "x"), (1, other, "x"), (1, other, "y"), (2, other, "x"), (0, third, "x"), (1, third, "x"), (None, one, "x"), (None, one, "y")]
    kept = one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in kept) == [(-1, one), (0, third), (1, one), (1, other)]
