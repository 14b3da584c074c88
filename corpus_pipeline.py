"""documents -> tokens: quality rules, near-duplicates, secrets, mixing, byte-pair encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as the next
stage's docs. All but the last return the columns of documents. Decisions: rows that the quality rules reject
go; of each component of near-duplicates (5-word shingles, Jaccard 0.8) the smallest doc_id stays; secrets become a mark; texts become what
the mix takes of them (a line for each piece, documents of which it takes nothing go); the last returns counts
and digests of the ids. Null and empty texts fail the quality rules; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe, jaccard_join, mixing, quality_rules, secrets
from quire.llm._shared import dropped, made, table, written
from quire.llm.queries import tokenizer

#: Near-duplicates of the stage: 5-word shingles, Jaccard 0.8 or more (op6's query takes 4 words and 0.85).
SHINGLE_WORDS = 5
SHINGLE_PERCENT = 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality_rules.kept_documents(docs, trusted)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, words=SHINGLE_WORDS, percent=SHINGLE_PERCENT)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", keep_quality),
    ("jaccard_join", one_of_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]

#: Tokenizing and n-gram hashing are beyond SQL; tests/llm/test_pipeline.py checks each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped(spark, mark, but=docs)  # what the stage wrote on its way, and its predecessor's rows
    return docs
