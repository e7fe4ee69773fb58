"""Benchmark passages against brute force, and the pipeline stage by stage."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkroster.llm import decontaminate
from sparkroster.llm.catalog import QUERIES, SQL
from sparkroster.llm.common import text_chunks
from sparkroster.llm.decontaminate import Patterns, contamination, drop_contaminated, scan, without_passages
from sparkroster.llm.simhash_dedup import fingerprint_of
from tests.oracle import connect, differences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, window):
    windows = {}
    for i, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for k in range(len(words) - size + 1) if size else ():
            windows.setdefault(tuple(words[k : k + size]), set()).add(str(i))
    out = []
    for text in texts:
        words, hit, found = words_of(text), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                if of := windows.get(tuple(words[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= of
        out.append((len(words), sorted(hit), sorted(found)))
    return out


def indexed(texts, items, window):
    patterns, out = Patterns(items, window), []
    for chunk in text_chunks(pa.array(texts, pa.string())):
        out += [(r["n_words"], r["hits"], sorted(set(r["items"]))) for r in scan(chunk, patterns).to_pylist()]
    return out


@pytest.mark.parametrize("symbols", [1 << 19, 12])
def test_index_finds_what_a_scan_finds(monkeypatch, symbols):
    monkeypatch.setattr(decontaminate, "SHARD_SYMBOLS", symbols)
    source = random.Random(2)
    for _ in range(150):
        words = ["a", "B", "ab", "É", "7x"][: source.randrange(2, 6)]

        def text(n, words=words):
            return "".join(source.choice(words) + source.choice([" ", "-", "\n", ", "]) for _ in range(n))

        texts = [text(source.randrange(40)) if source.random() < 0.9 else None for _ in range(source.randrange(1, 12))]
        items = [(k, text(source.randrange(9))) for k in range(source.randrange(6))]
        window = source.randrange(1, 6)
        assert indexed(texts, items, window) == brute(texts, items, window)


def expected(rows, items):
    out = []
    for (i, _), (n, hit, found) in zip(rows, brute([t for _, t in rows], items, 13), strict=True):
        out.append((i, n, len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= n))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [4 << 20, 3000])
def test_contamination_of_a_whole_table(spark, monkeypatch, block_bytes):
    docs, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    monkeypatch.setattr(decontaminate.found_passages, "__defaults__", ("text", 13, block_bytes))
    want = expected([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in benchmark.collect()])
    assert sorted(map(tuple, contamination(docs, benchmark).collect()), key=str) == want
    assert any(r[2] for r in want)


def test_odd_rows(spark, odd_docs):
    items = [(1, "Hello world"), (1, "Hello world"), (None, "don t stop"), (3, None), (4, ""), (5, "x")]
    benchmark = spark.createDataFrame([(*r, "z") for r in items], "item_id int, text string, doc_id string")
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    want = expected(rows, [("null" if i is None else i, t) for i, t in items])
    assert sorted(map(tuple, contamination(odd_docs, benchmark).collect()), key=str) == want
    assert contamination(odd_docs.limit(0), benchmark).collect() == []
    assert contamination(odd_docs, benchmark.limit(0)).where("n_hit > 0").count() == 0
    kept = drop_contaminated(odd_docs, benchmark)
    assert kept.columns == odd_docs.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 7, 8]


def test_passages_are_cut_out(spark):
    docs = spark.createDataFrame([(1, "É one, TWO three. four", "k"), (2, "clean", "k"), (3, None, "k")], "doc_id long, text string, _found string")
    benchmark = spark.createDataFrame([(1, "two three"), (2, "one two")], "item_id long, text string")
    assert [tuple(r) for r in without_passages(docs, benchmark).orderBy("doc_id").collect()] == [(1, "É . four", "k"), (2, "clean", "k"), (3, None, "k")]


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_their_sql(spark, name):
    assert differences(QUERIES[name](spark, "/root/testdata/sf0.01"), connect("/root/testdata/sf0.01"), SQL[name]) == []


def test_queries_read_whole_tables(spark):
    of = {"op2_embedding_dedup": "embeddings", "op7_url_filter": "pages", "listed_pages": "pages", "op12_centroid_clusters": "embeddings"}
    for name, query in QUERIES.items():
        if name == "op5_chat_format":
            turns = query(spark, SF).agg(F.sum("n_turns")).first()[0]
            assert turns == spark.read.parquet(f"{SF}/conversations.parquet").count()
        elif name != "op13_prefix_trie":
            table = of.get(name, "documents")
            assert query(spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count(), name


def near_copies_by_force(rows):
    """The ids that stay of `rows` of (id, text): the smallest of each group of texts whose sets of five-word
    shingles have a Jaccard similarity of 0.8 or more, or whose fingerprints differ in 4 or fewer bits."""
    sets, prints = [], []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset())
        prints.append(fingerprint_of(text or ""))
    holders = defaultdict(list)
    for i, shingles in enumerate(sets):
        for s in shingles:
            holders[s].append(i)
    shared = Counter((a, b) for held in holders.values() for k, a in enumerate(held) for b in held[k + 1 :])
    links = [(a, b) for (a, b), n in shared.items() if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n)]
    links += [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[find(a)] = find(b)
    lowest = {}
    for i, (doc, _) in enumerate(rows):
        lowest[find(i)] = min(doc, lowest.get(find(i), doc))
    return sorted(lowest.values())


def test_pipeline_stages_filter_as_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit(1))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    from sparkroster.llm.quality import quality
    from sparkroster.llm.simhash_dedup import near_groups
    from sparkroster.llm.toxicity import toxicity

    steps = [
        lambda d: quality(d, labels, docs).where("predicted = 1").select("doc_id"),
        lambda d: toxicity(docs, labels).join(d.select("doc_id"), "doc_id").where("predicted = 0").select("doc_id"),
        lambda d: near_groups(d).groupBy("root").agg(F.min("doc_id").alias("doc_id")).select("doc_id"),
        lambda d: contamination(d, spark.read.parquet(f"{SF}/benchmark.parquet")).where("NOT contaminated").select("doc_id"),
    ]
    now = docs
    for (name, stage), step in zip(corpus_pipeline.STAGES, steps, strict=False):
        kept = stage(spark, now, SF)
        assert kept.columns == docs.columns
        ids = sorted(r["doc_id"] for r in kept.collect())
        assert ids == sorted(r["doc_id"] for r in step(now).collect())
        if name == "near copies":
            assert ids == near_copies_by_force([tuple(r) for r in now.select("doc_id", "text").collect()])
        now = docs.join(spark.createDataFrame([(i,) for i in ids], "doc_id long"), "doc_id", "left_semi")
    out = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert out.columns == ["doc_id", "n_ids", "ids"] and out.count() == now.count()


def test_near_copies_of_a_whole_table(spark):
    """All links between the documents of the table that is ten times as large are found."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = corpus_pipeline.no_near_copies(spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == near_copies_by_force([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() < spark.read.parquet(f"{SF}/documents.parquet").count()


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
