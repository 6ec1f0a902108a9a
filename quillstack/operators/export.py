"""Listings and rendered text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.columns import denote_id, link_label, nest_headings, note_name, note_tag_line, page_content, vector_path
from quillstack.operators.view import CHUNK_PAGES, with_chunks


def list_notes(notes: DataFrame) -> DataFrame:
    return notes.select("file_id", note_name(F.col("source"), F.col("file_id")).alias("name")).orderBy("file_id")


def _tag_words(tags: Column, sign: str) -> Column:
    return F.array_join(F.transform(tags, lambda t: F.concat(F.lit(sign), t)), " ")


def list_pages(view: DataFrame) -> DataFrame:
    """One line's columns for each page: id, note, p<number>, star, headings (analysed titles), #keywords, @tags."""
    headings = F.array_join(F.transform(F.filter("titles", lambda t: t["analysis"].isNotNull()), lambda t: t["analysis"]["name"]), " / ")
    return view.select(
        "page_id",
        note_name(F.col("source"), F.col("file_id")).alias("note"),
        F.concat(F.lit("p"), F.col("number").cast("string")).alias("page"),
        F.when(F.col("starred"), "*").otherwise("").alias("star"),
        headings.alias("headings"),
        _tag_words(F.transform("keywords", lambda k: k["text"]), "#").alias("keywords"),
        _tag_words(F.col("effective_tags"), "@").alias("tags"),
    )


def gallery_notes(view: DataFrame) -> DataFrame:
    """A card for each note that has pages: id, name, first page."""
    names = view.select("file_id", note_name(F.col("source"), F.col("file_id")).alias("name"), "page_id", "pos")
    return names.groupBy("file_id", "name").agg(F.min_by("page_id", "pos").alias("first_page_id")).orderBy("file_id")


def gallery_pages(view: DataFrame) -> DataFrame:
    """A tile for each page: content, @tags, and a caption of note and number. view: page_view with md and boxes."""
    caption = F.concat(note_name(F.col("source"), F.col("file_id")), F.lit(" · "), F.col("number").cast("string"))
    content = F.coalesce(page_content(F.col("md"), F.col("boxes").isNotNull()), F.lit(""))
    return view.select("file_id", "page_id", content.alias("content"), _tag_words(F.col("effective_tags"), "@").alias("tags"), caption.alias("caption"))


def _link_line(link: Column) -> Column:
    label, link_kind = link_label(link), link["kind"]
    id_ = denote_id(link["name"])
    line = (
        F.when(F.coalesce(link["target_page_id"], F.lit("")) != "", F.concat(F.lit("[[note:"), link["target_page_id"], F.lit("]["), label, F.lit("]]")))
        .when(link_kind == "web", F.concat(F.lit("[["), F.coalesce(link["target"], F.lit("")), F.lit("]["), label, F.lit("]]")))
        .when((link_kind == "file") & (id_ != ""), F.concat(F.lit("[[denote:"), id_, F.lit("]["), label, F.lit("]]")))
        .when(link_kind == "file", label)
        .otherwise(F.concat(label, F.lit(" ("), link_kind, F.lit(": "), F.coalesce(link["target"], F.lit("")), F.lit(")")))
    )
    return F.concat(F.lit("- "), line)


def render_page(nested: str = "**") -> Column:
    """A page as outline text: heading, properties (id, vector, star), content with its own headings nested, links."""
    titles = F.array_join(F.transform(F.filter("titles", lambda t: t["analysis"].isNotNull()), lambda t: t["analysis"]["name"]), " / ")
    heading = F.concat(F.lit("** Page "), F.col("number").cast("string"), F.when(titles != "", F.concat(F.lit(": "), titles)).otherwise(""))
    star = F.when(F.coalesce("starred", F.lit(False)), F.lit("\n:STARRED: t")).otherwise("")
    properties = F.concat(F.lit(":PROPERTIES:\n:PAGE_ID: "), F.col("page_id"), F.lit("\n:VECTOR: "), vector_path(F.col("file_id"), F.col("page_id")), star, F.lit("\n:END:"))
    content = F.coalesce(page_content(F.col("md"), F.col("boxes").isNotNull()), F.lit(""))
    links = F.when(F.size("links") > 0, F.concat(F.lit("*** Links\n"), F.array_join(F.transform("links", _link_line), "\n")))
    return F.concat_ws("\n", heading, properties, F.when(content != "", nest_headings(content, nested)), links)


def _title(source: str = "source") -> Column:
    return F.concat(F.lit("#+title: "), note_name(F.col(source), F.col("file_id")), F.lit("\n"))


def render_notes(view: DataFrame) -> DataFrame:
    """file_id and text: each note as one document of its pages in order. view: page_view with md and boxes. For notes that do not fit into a row there is render_chunks."""
    pages = view.select("file_id", "source", "pos", F.transform("keywords", lambda k: k["text"]).alias("kw"), render_page().alias("page"))
    notes = pages.groupBy("file_id", "source").agg(F.array_sort(F.collect_list(F.struct("pos", "page", "kw"))).alias("all"))
    tags = note_tag_line(F.array_distinct(F.flatten(F.col("all.kw"))))
    text = F.concat(_title(), F.coalesce(tags, F.lit("")), F.lit("* Pages\n"), F.array_join(F.col("all.page"), "\n"), F.lit("\n"))
    return notes.select("file_id", text.alias("text"))


def render_chunks(view: DataFrame, pages: int = CHUNK_PAGES) -> DataFrame:
    """file_id, chunk, text: the texts of a note's chunks, one after the other, are the text of render_notes. Each ends with a line feed.

    Only a note's distinct keywords, by where they come first, meet in one row besides its chunks' pages.
    """
    rows = with_chunks(view.select("file_id", "source", "pos", F.transform("keywords", lambda k: k["text"]).alias("kw"), render_page().alias("page")), pages)
    each = rows.select("file_id", "pos", F.posexplode("kw").alias("i", "k")).groupBy("file_id", "k").agg(F.min(F.struct("pos", "i")).alias("at"))
    listed = each.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("at", "k"))).alias("all"))
    tags = listed.select("file_id", F.lit(0).cast("long").alias("chunk"), note_tag_line(F.col("all.k")).alias("tags"))
    chunks = rows.groupBy("file_id", "source", "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "page"))).alias("all"))
    head = F.when(F.col("chunk") == 0, F.concat(_title(), F.coalesce("tags", F.lit("")), F.lit("* Pages\n"))).otherwise("")
    return chunks.join(tags, ["file_id", "chunk"], "left").select("file_id", "chunk", F.concat(head, F.array_join(F.col("all.page"), "\n"), F.lit("\n")).alias("text"))
