"""The corpus pipeline on documents with odd rows, planted copies, passages and junk, stage by stage."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

WORDS = {
    "en": "the of and to in that was for with his they at be this from have not by but which are you all were her she would there been their has will more".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am".split(),
}
PASSAGE = "seven green lanterns were counted beside the old harbour wall before the tide returned at nine and nobody saw who had lit them"


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, folder = random.Random(3), tmp_path_factory.mktemp("corpus")
    rows = [(i, sentence(rng, "en" if i % 2 else "de", 80), "en" if i % 2 else "de", "s") for i in range(160)]
    copy = rows[5][1].split()
    copy[70] = "other"
    rows += [(500, rows[4][1], "de", "s"), (501, " ".join(copy), "en", "s"), (502, f"{rows[7][1]} {PASSAGE} {rows[9][1]}", "en", "s")]
    rows += [(600 + i, "".join(rng.choice("qxzjkvw") for _ in range(400)), "en", "s") for i in range(4)]
    rows += [(700, None, "en", "s"), (701, "", None, None), (702, " 12 ...", "en", "s"), (703, "日本語のテキストです" * 30, "en", "s"), (704, sentence(rng, "en", 60_000), "en", "s"), (None, sentence(rng, "en", 90), "en", "s")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 1, "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score int, n_tokens string")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None), (3, "nobody has these seven words at all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_and_run(spark, corpus, reference_encoding):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    goes = {"language": {700, 701, 702, 703}, "quality": {600, 601, 602, 603}, "near_dedup": {500, 501}, "decontaminate": {502}}
    assert [name for name, _ in corpus_pipeline.STAGES] == [*goes, "bpe"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.cut(stage(spark, docs, corpus), name)
        assert kept.schema == docs.schema and kept.count() == kept.distinct().count()
        after = {r.doc_id for r in kept.collect()}
        clean = before - after - set().union(*goes.values())
        assert not goes[name] & after and len(clean) <= (3 if name in ("language", "quality") else 0)  # models may err
        docs, before = kept, after
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = corpus_pipeline.run(spark, corpus).collect()
    assert {r.doc_id for r in rows} == set(texts) and None in texts
    for r in rows:
        ids = reference_encoding.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_an_empty_corpus(spark, corpus, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{name}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
