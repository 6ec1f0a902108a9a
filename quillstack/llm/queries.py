"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm import bpe, collision, containment, editcount, hyperlang, kneser_ney, maskedlm, packing, periodic, simhash, spelling, urlfilter, warc
from quillstack.llm.common import cut, scratch, small_batches, table


def tokenizer() -> tuple[str, str]:
    """The rank file and the pattern that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.digests(spark, table(spark, sf_dir, "documents"), *tokenizer())


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op3_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return maskedlm.score(docs, maskedlm.train(docs))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.describe(warc.read_archive(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return hyperlang.identify(table(spark, sf_dir, "documents"))


def op9_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after edits made of its own text, by trees that are stored in between."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    trees = cut(editcount.with_trees(docs, *tokenizer()), "trees")
    edited = editcount.apply_edits(editcount.own_edits(trees.withColumn("n_tokens_before", F.col("n_tokens"))), *tokenizer())
    return edited.select("doc_id", "n_tokens_before", "n_tokens", "n_encoded", F.size("leaf_tokens").cast("long").alias("n_leaves"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (document, test item) such that the document contains the item."""
    small_batches(spark)
    return containment.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return periodic.digests(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spelling.group_variants(spelling.count_words(table(spark, sf_dir, "documents"), spelling.DAMAGED))


def word_tokenizer() -> str:
    """The tokenizer file that the packing query uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_tokenizer())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_urls": op2_urls,
    "op3_masked_lm": op3_masked_lm,
    "op4_warc": op4_warc,
    "op5_neighbours": op5_neighbours,
    "op6_simhash": op6_simhash,
    "op7_quality": op7_quality,
    "op8_language": op8_language,
    "op9_edit_counts": op9_edit_counts,
    "op10_decontaminate": op10_decontaminate,
    "op11_runs": op11_runs,
    "op12_spelling": op12_spelling,
    "op13_packing": op13_packing,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {"op2_urls": urlfilter.ORACLE, "op4_warc": warc.ORACLE, "op10_decontaminate": containment.ORACLE}
