"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .centroid_clusters import cluster_report
from .chat_format import formatted_conversations
from .common import ship_package, table
from .decontaminate import contamination
from .embedding_dedup import near_vectors
from .prefix_trie import trie_report
from .quality import quality
from .sentencepiece_codec import round_trips
from .simhash_dedup import simhash_groups
from .substring_dedup import repeats_removed
from .token_counts import token_counts
from .token_output import token_files
from .toxicity import toxicity
from .url_filter import judged_pages, listed_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def tokenizer(name: str) -> str:
    """The place of a public tokenizer file; the same on the driver and the executors."""
    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return run(spark, sf_dir)

        QUERIES[name] = call
        if sql:
            SQL[name] = sql
        return run

    return add


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query("op6_token_output")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@query("op8_simhash_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


PASSAGES_SQL = r"""
WITH lowered AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), sized AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, w, least(13, len(w)) AS size FROM items WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM sized)
), places AS (
  SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM lowered, (SELECT DISTINCT size FROM sized) WHERE len(w) >= size)
), hits AS (
  SELECT DISTINCT r, i, size, item FROM places JOIN windows USING (size, phrase)
), counts AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r
), found AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM lowered LEFT JOIN counts USING (r) LEFT JOIN found USING (r)
"""


@query("op9_decontaminate", PASSAGES_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_sentencepiece")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


VECTORS_SQL = """
WITH RECURSIVE fine AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0
    AND len([x for x in embedding if x <> 0]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b
    ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
), reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept
FROM (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a)
JOIN (SELECT vec_id, count(links.b) AS n_links FROM embeddings LEFT JOIN links ON vec_id = a GROUP BY vec_id) USING (vec_id)
"""


@query("op2_embedding_dedup", VECTORS_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query("op5_chat_format")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted_conversations(table(spark, sf_dir, "conversations"))


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query("op7_url_filter")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_pages(table(spark, sf_dir, "pages"), URL_RULES)


LISTED_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, coalesce(rest, '') AS rest FROM parts)
), rules(verdict, whose, below) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), rows AS (
  SELECT *, row_number() OVER () AS r FROM split
), best AS (
  SELECT r, arg_max({'rule': whose || below, 'verdict': verdict}, length(whose || below)) AS b
  FROM rows JOIN rules ON (host = whose OR ends_with(host, '.' || whose)) AND starts_with(path, below) GROUP BY r
)
SELECT page_id, host, path, b.rule AS rule, b.verdict AS listed FROM rows LEFT JOIN best USING (r)
"""


@query("listed_pages", LISTED_SQL)
def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the list of op7 says on every page, before any rule is mined."""
    return listed_pages(table(spark, sf_dir, "pages"), URL_RULES).drop("url")


REPEATS_SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS phrase
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM texts)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY phrase ORDER BY doc_id, i) AS k FROM places) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM texts
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""


@query("op11_substring_dedup", REPEATS_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_removed(table(spark, sf_dir, "documents"))


def _round_sql(n: int) -> str:
    """Centroids after one more round, in exact whole numbers."""
    return f"""
), near{n} AS (
  SELECT vec_id, arg_min(cluster, (d, cluster)) AS cluster FROM (
    SELECT v.vec_id, c.cluster, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{n} AS c USING (i) GROUP BY v.vec_id, c.cluster
  ) GROUP BY vec_id
), c{n + 1} AS (
  SELECT cluster, i, coalesce(m.x, c.x) AS x FROM c{n} AS c LEFT JOIN (
    SELECT cluster, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
    FROM v JOIN near{n} USING (vec_id) GROUP BY cluster, i
  ) AS m USING (cluster, i)"""


CLUSTERS_SQL = f"""
WITH v AS (
  SELECT vec_id, i, CAST(floor(64 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings
    WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0)
), c0 AS (
  SELECT cluster, i, x FROM v JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster FROM (SELECT DISTINCT vec_id FROM v)
  ) USING (vec_id) WHERE cluster < 16{_round_sql(0)}{_round_sql(1)}{_round_sql(2)}
), near AS (
  SELECT vec_id, arg_min(cluster, (d, cluster)) AS cluster, CAST(min(d) AS BIGINT) AS distance FROM (
    SELECT v.vec_id, c.cluster, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c3 AS c USING (i) GROUP BY v.vec_id, c.cluster
  ) GROUP BY vec_id
), digests AS (
  SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY cluster
)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM near JOIN digests USING (cluster)
"""


@query("op12_centroid_clusters", CLUSTERS_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(table(spark, sf_dir, "embeddings"))


TRIE_SQL = """
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, n, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(
    list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda s, x: CASE WHEN x = -1 THEN xor(s >> 1, 3988292384 * (s & 1)) ELSE xor(s, x) END)) % 6 AS h
  FROM (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id)
), given AS (
  SELECT c.*, least(h, coalesce(b.n, 0)) AS d0 FROM convs AS c LEFT JOIN (SELECT conv_id AS base, n FROM convs) AS b USING (base)
), turns AS (
  SELECT g.conv_id, pos AS depth, role, text FROM given AS g JOIN own ON own.conv_id = g.base AND pos <= h
  UNION ALL
  SELECT conv_id, pos - h + d0, role, text FROM given JOIN own USING (conv_id) WHERE pos > h
), rebuilt AS (
  SELECT conv_id, coalesce(t, []) AS t FROM convs LEFT JOIN (
    SELECT conv_id, list({'role': role, 'text': text} ORDER BY depth) AS t FROM turns GROUP BY conv_id
  ) USING (conv_id)
), prefixes AS (
  SELECT conv_id, d, t[1:d] AS prefix, d = len(t) AS ends FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY prefix, d
), kids AS (
  SELECT prefix[1:d - 1] AS prefix, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY ALL
), above AS (
  SELECT prefix[1:k] AS prefix, sum(leaf) AS leaves, sum(own) AS saved FROM (
    SELECT prefix, unnest(range(0, d + 1)) AS k, CAST(kids IS NULL AS BIGINT) AS leaf, (n - 1) * coalesce(length(prefix[d].text), 0) AS own
    FROM nodes LEFT JOIN kids USING (prefix)
  ) GROUP BY ALL
)
SELECT nodes.conv_id, d AS depth, up.conv_id AS parent_conv_id, n AS n_convs, coalesce(kids, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM nodes JOIN above USING (prefix) LEFT JOIN kids USING (prefix)
LEFT JOIN (SELECT prefix AS parent, conv_id FROM nodes) AS up ON d > 0 AND up.parent = prefix[1:d - 1]
"""


@query("op13_prefix_trie", TRIE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_report(table(spark, sf_dir, "conversations"))
