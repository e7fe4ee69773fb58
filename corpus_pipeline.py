"""The corpus pipeline: five stages over `documents`, each on what the one before kept."""

from __future__ import annotations

import os
import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparkroster.llm.common import materialised, ship_package, table  # noqa: E402
from sparkroster.llm.decontaminate import drop_contaminated  # noqa: E402
from sparkroster.llm.quality import of_good_quality  # noqa: E402
from sparkroster.llm.sentencepiece_codec import encode_documents  # noqa: E402
from sparkroster.llm.simhash_dedup import one_of_each_group  # noqa: E402
from sparkroster.llm.toxicity import not_toxic  # noqa: E402

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    ship_package(spark)
    return of_good_quality(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon does not reject."""
    ship_package(spark)
    return not_toxic(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    ship_package(spark)
    return one_of_each_group(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages do not contaminate."""
    ship_package(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`doc_id, n_ids, ids` of the documents that are left."""
    ship_package(spark)
    return encode_documents(docs, PIECES)


STAGES = [
    ("quality classifier", good_quality),
    ("toxicity", clean_language),
    ("near copies", no_near_copies),
    ("benchmark decontamination", no_benchmark),
    ("SentencePiece ids", pieces),
]

#: No stage before the fourth can be stated in SQL (learnt models, XXH64), so there is none for the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage keeps is written to the shared folder and read by the next."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
