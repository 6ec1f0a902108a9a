"""Predicates over the page view. Each is a Column that is never null, so they combine under and, or and not."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.columns import created_at
from quillstack.functions.re2 import java

Matcher = Callable[[Column], Column]


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def all_pages() -> Column:
    return F.lit(True)


def starred() -> Column:
    return _sure(F.col("starred"))


def unanalyzed() -> Column:
    """No stored analysis, even if there is text."""
    return F.col("analysis").isNull()


def templated() -> Column:
    return F.col("boxes").isNotNull()


def note_is(m: Matcher) -> Column:
    return _sure(m(F.col("file_id")))


def keyword_is(m: Matcher) -> Column:
    return _sure(F.exists("keywords", lambda k: _sure(m(k["text"]))))


def tag_is(m: Matcher) -> Column:
    return _sure(F.exists("effective_tags", lambda t: _sure(m(t))))


def content_is(m: Matcher) -> Column:
    """On the stored text: it ends in a newline, and has its section markers on templated pages."""
    return _sure(m(F.coalesce("md", F.lit(""))))


def region_is(box: str | None, m: Matcher) -> Column:
    """The text of one declared box, or of any; needs the column ``declared`` of declared_regions."""
    return _sure(F.exists("declared", lambda r: (F.lit(True) if box is None else r["id"] == box) & _sure(m(r["text"]))))


def _between(stamp: Column, lo: date | None, hi: date | None) -> Column:
    day = F.to_date(stamp)
    inside = day.isNotNull()
    if lo is not None:
        inside &= day >= F.lit(lo)
    if hi is not None:
        inside &= day <= F.lit(hi)
    return _sure(inside)


def created_between(lo: date | None, hi: date | None) -> Column:
    return _between(created_at(F.col("page_id")), lo, hi)


def modified_between(lo: date | None, hi: date | None) -> Column:
    return _between(F.col("modified_at"), lo, hi)


def device_modified_between(lo: date | None, hi: date | None) -> Column:
    return _between(F.col("device_modified_at"), lo, hi)


def mark_ids(view: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """view with a column that ids_in(name) reads. ids: page_id."""
    marks = ids.select("page_id").distinct().withColumn(name, F.lit(True))
    return view.join(marks, "page_id", "left")


def ids_in(name: str) -> Column:
    return _sure(F.col(name))


def both(*parts: Column) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def either(*parts: Column) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def negate(part: Column) -> Column:
    return ~part


def substring(s: str) -> Matcher:
    """Contains, whatever the case."""
    return lambda c: F.lower(c).contains(F.lower(F.lit(s)))


def exact(s: str) -> Matcher:
    return lambda c: c == s


def regexp(pattern: str) -> Matcher:
    """Matches anywhere. The pattern is of the RE2 dialect; what that lacks is refused."""
    return lambda c, p=java(pattern): c.rlike(p)


def query_pages(view: DataFrame, condition: Column) -> DataFrame:
    """The rows that match, in archive order."""
    return view.where(condition).orderBy("file_id", "pos")
