"""Adding and removing labels of pages and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.functions.columns import apply_tag, no_strings
from quillstack.size import listed


def _tagged(rows: DataFrame, ids: DataFrame, key: str, tag: str, remove: bool) -> tuple[DataFrame, int]:
    if missing := listed(ids.select(key).distinct().join(rows.select(key), key, "left_anti").orderBy(key)):  # before anything is written
        raise ValueError(f"unknown {key}: {missing}")
    marked = rows.join(ids.select(key).distinct().withColumn("_asked", F.lit(True)), key, "left")
    now = F.when(F.col("_asked"), apply_tag(F.col("tags"), tag, remove)).otherwise(F.col("tags"))
    out = marked.withColumn("_now", now)
    changed = out.where(F.col("_asked") & ~F.coalesce("tags", no_strings()).eqNullSafe(F.col("_now"))).count()
    return out.withColumn("tags", F.col("_now")).select(rows.columns), changed


def tag_pages(pages: DataFrame, ids: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """pages with tag on the asked ones (ids: page_id), and how many changed. Unknown ids are an error."""
    return _tagged(pages, ids, "page_id", tag, False)


def untag_pages(pages: DataFrame, ids: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """The same with tag taken away; a tag that the note gives is not the page's to lose."""
    return _tagged(pages, ids, "page_id", tag, True)


def tag_notes(notes: DataFrame, ids: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """notes with tag on the asked ones (ids: file_id); their pages inherit it when they are read."""
    return _tagged(notes, ids, "file_id", tag, False)


def untag_notes(notes: DataFrame, ids: DataFrame, tag: str) -> tuple[DataFrame, int]:
    return _tagged(notes, ids, "file_id", tag, True)
