"""The corpus pipeline: documents in, token counts and digests of the kept ones out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next one's docs. All but the last return the columns of documents. Null texts and texts without letters
leave at the first stage; rows without doc_id are judged by their text alone and stay where a stage
decides by doc_id; an empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstack.llm import bpe, containment, hyperlang, kneser_ney, simhash
from quillstack.llm.common import cut, small_batches, table
from quillstack.llm.queries import tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the hyperdimensional profiles recognise."""
    small_batches(spark)
    return hyperlang.keep_identified(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney model of trusted text does not find odd for their language."""
    return kneser_ney.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: a Jaccard similarity of 0.8 or more over five-word shingles."""
    small_batches(spark)
    return simhash.keep_one(docs, words=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    small_batches(spark)
    return containment.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, text_matches of every document that is left."""
    small_batches(spark)
    return bpe.digests(spark, docs, *tokenizer(), states=40_000, pieces=40_000)  # executors also hold what earlier stages took


STAGES = [("language", language), ("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("bpe", encode)]

#: Models, hashes of shingles and encodings are not SQL: stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
