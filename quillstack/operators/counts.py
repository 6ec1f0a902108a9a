"""Counts and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counts(view: DataFrame, values: Column) -> DataFrame:
    each = view.select(F.explode(F.array_distinct(values)).alias("value"))
    return each.groupBy("value").agg(F.count("*").alias("count")).orderBy("value")


def keyword_counts(view: DataFrame) -> DataFrame:
    """Keywords with the number of pages that carry them, sorted by keyword."""
    return _counts(view, F.transform("keywords", lambda k: k["text"]))


def tag_counts(view: DataFrame) -> DataFrame:
    """The same for effective tags: a note's tag counts once for each of its pages."""
    return _counts(view, F.col("effective_tags"))


def duplicate_pages(placement: DataFrame) -> DataFrame:
    """Pages that more than one note claims, with the sorted owners."""
    return placement.groupBy("page_id").agg(F.array_sort(F.collect_set("file_id")).alias("owners")).where(F.size("owners") > 1)


def note_keywords(view: DataFrame, defaults: list[str] | None = None) -> DataFrame:
    """For each note: the caller's default keywords, then its own in the order they are first seen, without repeats."""
    each = view.select("file_id", "pos", F.posexplode_outer("keywords").alias("kw_pos", "k")).select("file_id", "pos", "kw_pos", "k.text")
    first = each.groupBy("file_id", "text").agg(F.min(F.struct("pos", "kw_pos")).alias("at"))
    listed = first.groupBy("file_id").agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("at", "text")))).alias("all"))
    given = F.array(*[F.lit(d) for d in defaults or []]).cast("array<string>")
    return listed.select("file_id", F.array_distinct(F.concat(given, F.col("all.text"))).alias("keywords"))


def run_summary(outcomes: DataFrame) -> DataFrame:
    """How many rows have each outcome."""
    return outcomes.groupBy("outcome").agg(F.count("*").alias("count")).orderBy("outcome")


def write_report(reconciled: DataFrame) -> DataFrame:
    """One row for each note of a reconcile report: how many pages were new, adopted, changed, pruned, parked."""
    flag = lambda c: F.count_if(F.col(c)).alias(c)
    return reconciled.groupBy("file_id").agg(*[flag(c) for c in ("is_new", "adopted", "metadata_changed", "vector_changed", "background_changed", "pruned", "parked", "repaired")], F.sum(F.size("dropped_regions")).alias("dropped_regions")).orderBy("file_id")


def first_pages(view: DataFrame) -> DataFrame:
    """The first page of each note."""
    return view.groupBy("file_id").agg(F.min_by("page_id", "pos").alias("first_page_id"))


