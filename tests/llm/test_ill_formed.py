"""Texts with ill-formed UTF-8: every operator reads U+FFFD for it. Columns that are named like results are not in the way."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillstack.llm import bpe, containment, editcount, hyperlang, maskedlm, nearcopies, packing, simhash, spelling

BAD, GOOD = "CAST(X'6162FFC3' AS STRING)", "ab\ufffd\ufffd"


@pytest.fixture(scope="module")
def docs(spark):
    """An ill-formed text, what it counts as, and texts to learn from; columns named like the operators' results."""
    rows = spark.range(40).selectExpr("id + 10 AS doc_id", "concat('the words of text number ', id) AS text", "'en' AS lang")
    odd = spark.range(1).selectExpr("1L AS doc_id", f"{BAD} AS text", "'en' AS lang").unionByName(spark.createDataFrame([(2, GOOD, "en")], "doc_id long, text string, lang string"))
    return rows.unionByName(odd).selectExpr("*", "'x' AS fingerprint", "7 AS component_id", "'y' AS fp", "8 AS item_id", "9 AS found", "1 AS node", "2 AS h1", "3 AS n_tokens", "4 AS lang_pred", "5 AS score")


def both(df, *columns):
    got = {r.doc_id: tuple(r[c] for c in columns) for r in df.where("doc_id < 3").collect()}
    assert set(got) == {1, 2} and got[1] == got[2]
    return got[1]


def test_encoding_and_counts(docs, tokenizer, spark):
    _, ids, decoded = both(bpe.digests(spark, docs, *tokenizer), "n_tokens", "ids_sha256", "decoded_sha256")
    assert decoded == hashlib.sha256(GOOD.encode()).hexdigest()
    both(editcount.with_trees(docs.select("doc_id", "text"), *tokenizer), "n_tokens")


def test_fingerprints_copies_and_items(docs, spark):
    assert both(simhash.near_duplicates(docs), "fingerprint", "component_id")[1] == 1
    assert both(nearcopies.near_copies(docs), "component_id") == (1,)
    items = spark.createDataFrame([(5, GOOD, "z")], "item_id long, text string, doc_id string")
    assert both(containment.search(docs, items), "item_id") == (5,)
    assert containment.drop_contaminated(docs, items).where("doc_id < 3").count() == 0


def test_models(docs):
    both(hyperlang.identify(docs), "lang_pred", "score")
    counted = maskedlm.counts_by_document(docs.select("doc_id", "text"))
    assert counted.count() > 40


def test_packing_and_words(docs):
    P = pytest.importorskip("public_tokenizers")
    both(packing.pieces(docs, P.path("word_bpe_49k.json")), "length", "ids_crc32")
    assert spelling.count_words(docs).where(F.col("word") == "words").first().n == 40
