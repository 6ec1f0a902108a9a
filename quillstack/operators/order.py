"""Orders, neighbours, and selections set against each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.size import small
from quillstack.sources.scratch import cut

#: Pages from which a note is numbered by ranges of its order, in many tasks, instead of in one.
LARGE_NOTE = 1_000_000


def running(df: DataFrame, order: Sequence[str], within: Sequence[str] = (), weight: Column | None = None, ranges: int | None = None) -> DataFrame:
    """df with ``before``: what comes before each row in the order, in its group (the first columns of the order) or in all, as number of rows or sum of weight.

    Prefix sums on two levels: rows are dealt to ranges of the order and stored, each range (and group) is summed, these few
    sums are summed up in order, and within a range a window counts on from there. So a group may be of any size.
    """
    dealt = df.withColumn("_weight", (F.lit(1) if weight is None else weight).cast("long"))
    dealt = dealt.repartitionByRange(ranges, *order) if ranges else dealt.repartitionByRange(*order)
    parts = cut(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    so_far = lambda keys, by: Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("_range", *within).agg(F.sum("_weight").alias("_sum"))
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(so_far(within, ["_range"])), F.lit(0))).drop("_sum")
    here = F.coalesce(F.sum("_weight").over(so_far(["_range", *within], order)), F.lit(0))
    joined = parts.withColumn("_here", here).join(small(starts), ["_range", *within])
    return joined.select(*df.columns, (F.col("_start") + F.col("_here")).alias("before"))


def _large(placement: DataFrame, most: int) -> DataFrame | None:
    """The notes of more than so many pages, None if there are none."""
    many = placement.groupBy("file_id").count().where(F.col("count") > most).select("file_id")
    return None if many.isEmpty() else cut(many, "large")


def numbered(placement: DataFrame, large: int = LARGE_NOTE) -> DataFrame:
    """placement with ``nth``, counted from 1 within the note. Notes of more than ``large`` pages are numbered by ranges."""
    nth = F.row_number().over(Window.partitionBy("file_id").orderBy("pos"))
    many = _large(placement, large)
    if many is None:
        return placement.withColumn("nth", nth)
    rest = placement.join(small(many), "file_id", "left_anti").withColumn("nth", nth)
    ranged = running(placement.join(small(many), "file_id", "left_semi"), ["file_id", "pos"], ["file_id"])
    return rest.unionByName(ranged.withColumn("nth", (F.col("before") + 1).cast("int")).drop("before"))


def placement_order(placement: DataFrame) -> DataFrame:
    """placement with ``nth``, counted from 1 within the note."""
    return numbered(placement)


def page_neighbors(placement: DataFrame, large: int = LARGE_NOTE) -> DataFrame:
    """placement with the previous and the next page of the note; null at the ends. Pages of notes of more than ``large`` pages find theirs by number."""
    w = Window.partitionBy("file_id").orderBy("pos")
    beside = {"prev_page": F.lag("page_id").over(w), "next_page": F.lead("page_id").over(w)}
    many = _large(placement, large)
    if many is None:
        return placement.withColumns(beside)
    rest = placement.join(small(many), "file_id", "left_anti").withColumns(beside)
    rows = cut(numbered(placement.join(small(many), "file_id", "left_semi"), large), "numbered")
    before = rows.select("file_id", (F.col("nth") + 1).alias("nth"), F.col("page_id").alias("prev_page"))
    after = rows.select("file_id", (F.col("nth") - 1).alias("nth"), F.col("page_id").alias("next_page"))
    return rest.unionByName(rows.join(before, ["file_id", "nth"], "left").join(after, ["file_id", "nth"], "left").drop("nth"))


def renumber(placement: DataFrame) -> DataFrame:
    """placement numbered from 1 without gaps, places from 0."""
    return numbered(placement).withColumns({"number": F.col("nth"), "pos": F.col("nth") - 1}).drop("nth")


def preferred_donor(holders: DataFrame) -> DataFrame:
    """holders (page_id, holder, has_md, ...): of each page the first holder that has a text, else the first."""
    w = Window.partitionBy("page_id").orderBy(F.desc("has_md"), "holder")
    return holders.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def rect_ordinal(regions: DataFrame) -> DataFrame:
    """regions (page_id, kind, rect, pos, ...) with ``nth``: the how-manieth of its page with the same rect it is."""
    return regions.withColumn("nth", F.row_number().over(Window.partitionBy("page_id", "kind", "rect").orderBy("pos")))


def archive_order(df: DataFrame) -> DataFrame:
    return df.orderBy("file_id", "pos")


def archive_rank(df: DataFrame) -> DataFrame:
    """df with ``rank``, its place in the order of the archive from 1: as a column the order outlives writing and joins."""
    return running(df, ["file_id", "pos"]).withColumn("rank", F.col("before") + 1).drop("before")


def value_order(df: DataFrame) -> DataFrame:
    return df.orderBy("value")


def intersect(selection: DataFrame, other: DataFrame) -> DataFrame:
    """The pages of selection that other has too."""
    return selection.join(other.select("page_id").distinct(), "page_id", "left_semi")


def subtract(selection: DataFrame, other: DataFrame) -> DataFrame:
    """The pages of selection that other does not have."""
    return selection.join(other.select("page_id").distinct(), "page_id", "left_anti")
