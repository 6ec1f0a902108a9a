"""What stages leave in the shared folder, and which texts they move."""

import os

from pyspark.sql import functions as F

from quillstack.llm import kneser_ney, nearcopies, simhash


def spoken(spark, n):
    words = [F.concat(F.lit("w"), (F.xxhash64("doc_id", F.lit(k)) % 900).cast("string")) for k in range(40)]
    return spark.range(n).select(F.col("id").alias("doc_id")).select("doc_id", F.lit("en").alias("lang"), F.array_join(F.array(*words), " ").alias("text"))


def test_only_texts_of_candidates_move(spark, monkeypatch):
    docs = spoken(spark, 60)
    copies = docs.where("doc_id < 2").select(F.col("doc_id") + 100, "lang", F.concat("text", F.lit(" more")))
    asked, plain = [], nearcopies._texts
    monkeypatch.setattr(nearcopies, "_texts", lambda d, nodes: asked.append(nodes.count()) or plain(d, nodes))
    kept = simhash.keep_one(docs.unionAll(copies))
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(range(60))
    assert sum(asked) <= 8  # 62 and more when all texts were moved for their fingerprints
    asked.clear()
    assert simhash.keep_one(docs).count() == 60 and not sum(asked)


def test_quality_leaves_no_model_behind(spark):
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(root))
    docs = spoken(spark, 80)
    kept = kneser_ney.keep_good(docs, docs.select("doc_id", F.lit(1).alias("quality"))).count()
    left = {n.split("-")[0] for n in set(os.listdir(root)) - before}
    assert 0 < kept <= 80 and left <= {"rejected", "scores", "thresholds"}
