"""Strokes of page vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.functions.columns import handwriting, path_strokes


def strokes(vectors: DataFrame) -> DataFrame:
    """vectors (file_id, page_id, svg) as one row for each stroke, in order."""
    return vectors.select("file_id", "page_id", F.posexplode(path_strokes(F.col("svg"))).alias("stroke_pos", "stroke"))


def handwriting_hash(vectors: DataFrame) -> DataFrame:
    """file_id, page_id, source_hash: a fingerprint of the strokes that recolouring does not move."""
    return vectors.select("file_id", "page_id", handwriting(F.col("svg")).alias("source_hash"))


def stroke_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Strokes of one version that the other lacks, in order and with repeats: change (added or removed), page_id, stroke_pos, stroke.

    The versions of a page meet in one shuffle, a row each, and are compared as sets within the row; only strokes that changed are rows of their own.
    """
    each = lambda df, change: df.select("page_id", F.lit(change).alias("change"), path_strokes(F.col("svg")).alias("strokes"))
    pages = each(new, "added").unionAll(each(old, "removed")).groupBy("page_id").agg(F.collect_list(F.struct("change", "strokes")).alias("all"))
    others = F.flatten(F.transform(F.filter("all", lambda v: v["change"] != F.col("v.change")), lambda v: v["strokes"]))
    lost = F.when(F.col("page_id").isNull(), F.array_distinct("v.strokes")).otherwise(F.array_except("v.strokes", others))  # pages without an id are no versions of each other
    rows = pages.select("page_id", "all", F.explode("all").alias("v")).select("page_id", "v", lost.alias("lost")).where(F.size("lost") > 0)
    changed = F.filter(F.transform("v.strokes", lambda s, i: F.struct(i.alias("stroke_pos"), s.alias("stroke"))), lambda s: F.array_contains("lost", s["stroke"]))
    return rows.select(F.col("v.change").alias("change"), "page_id", F.inline(changed))
