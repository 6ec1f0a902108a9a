"""Joins that put the parts of a page together: the page view, nested notes, owners and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.functions.columns import effective_tags, link_facts, note_name, page_content, vector_path
from quillstack.model import BOX
from quillstack.operators.order import numbered
from quillstack.operators.regions import declared_column, let
from quillstack.size import listed, small

KEY = ["file_id", "page_id"]
#: Pages of a note that make a chunk: a row of bounded size, however large the note is.
CHUNK_PAGES = 500


def template_table(boxes: DataFrame) -> DataFrame:
    """One row for each template: background_hash and its boxes in order."""
    box = F.struct("box_pos", "box_id", "label", "rect", "analyze", "prompt").cast(BOX)
    return boxes.groupBy("background_hash").agg(F.array_sort(F.collect_list(box)).alias("boxes"))


def match_template(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """pages with ``boxes``, those of the template that its background is; null without one."""
    return pages.join(small(template_table(boxes)), "background_hash", "left")


def page_view(notes: DataFrame, placement: DataFrame, pages: DataFrame, md: DataFrame | None = None, boxes: DataFrame | None = None) -> DataFrame:
    """One wide row for each placed page. Text and templates are joined only if they are given."""
    own = notes.select("file_id", "signature", "device", "source", F.col("tags").alias("note_tags"))
    view = placement.join(own, "file_id").join(pages.withColumnRenamed("tags", "page_tags"), KEY)
    if md is not None:
        base = F.col("base") if "base" in md.columns else F.lit(None).cast("string")
        view = view.join(md.select(*KEY, "md", base.alias("base")), KEY, "left").withColumn("md", F.coalesce("md", F.lit("")))
    view = match_template(view, boxes) if boxes is not None else view.withColumn("boxes", F.lit(None).cast(f"array<{BOX}>"))
    return view.withColumn("effective_tags", effective_tags(F.col("note_tags"), F.col("page_tags")))


def declared_regions(view: DataFrame) -> DataFrame:
    """view (with md and boxes) with ``declared``: the declared boxes of a templated page with their text, the last section of an id counting.

    The column comes out of a generator, so that predicates over it read it instead of parsing the text again.
    """
    return view.withColumn("declared", F.explode(F.array(declared_column(F.col("boxes"), F.col("md"), last=True))))


def region_view(view: DataFrame) -> DataFrame:
    """One row for each declared box of each templated page, in order; the first section of an id counts."""
    texts = declared_column(F.col("boxes"), F.col("md"), last=False)
    rows = view.where(F.col("boxes").isNotNull()).select(*KEY, "boxes", F.posexplode(texts).alias("box_pos", "region"))
    return rows.select(*KEY, "box_pos", F.col("region.id").alias("id"), F.col("region.label").alias("label"), F.get("boxes", F.col("box_pos"))["rect"].alias("rect"), F.col("region.text").alias("text"))


def page_struct(view: DataFrame) -> Column:
    """A page as a reader sees it. view: page_view with md and boxes."""
    templated = F.col("boxes").isNotNull()
    content = lambda regions: page_content(F.col("md"), templated, F.col("analysis"), F.coalesce(F.size(regions), F.lit(0)))
    told = let(
        declared_column(F.col("boxes"), F.col("md"), last=False),
        lambda regions: let(content(regions), lambda c: F.when(c.isNotNull(), F.struct(c.alias("content"), F.col("analysis.fields").alias("fields"), regions.alias("regions")))),
    )
    return F.struct(
        "pos", "number", "page_id", "starred", vector_path(F.col("file_id"), F.col("page_id")).alias("svg"), "modified_at", "device_modified_at",
        F.col("effective_tags").alias("tags"), "titles", "keywords", link_facts(F.col("links"), F.col("file_id")).alias("links"), told.alias("analysis"),
    )


def _nested(view: DataFrame, *more: str) -> DataFrame:
    listed = view.groupBy("file_id", *more, "signature", "device", "source", "note_tags").agg(F.collect_list(page_struct(view)).alias("pages"))
    return listed.withColumn("pages", F.array_sort("pages", lambda a, b: a["pos"] - b["pos"]))  # fields is a map, which has no order


def nest_notes(view: DataFrame) -> DataFrame:
    """One row for each note, its pages in placement order. For notes that do not fit into a row there is nest_chunks."""
    return _nested(view)


def with_chunks(view: DataFrame, pages: int = CHUNK_PAGES) -> DataFrame:
    """view with ``chunk``: its pages in order, so many at a time, counted from 0 within the note."""
    return numbered(view).withColumn("chunk", F.floor((F.col("nth") - 1) / pages).cast("long")).drop("nth")


def nest_chunks(view: DataFrame, pages: int = CHUNK_PAGES) -> DataFrame:
    """Notes as ordered chunks (file_id, chunk, ..., pages): their pages one after the other are those of nest_notes."""
    return _nested(with_chunks(view, pages), "chunk")


def unknown_ids(view: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids that no placed page has, sorted."""
    return ids.select("page_id").distinct().join(view.select("page_id"), "page_id", "left_anti").orderBy("page_id")


def _asked(view: DataFrame, ids: DataFrame) -> DataFrame:
    if missing := listed(unknown_ids(view, ids)):
        raise ValueError(f"unknown pages: {missing}")
    asked = view.join(ids.select("page_id").distinct(), "page_id", "left_semi")
    first = Window.partitionBy("page_id").orderBy("file_id", "pos")
    return asked.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def retrieve(view: DataFrame, ids: DataFrame) -> DataFrame:
    """Nested notes for the asked pages; a page placed in two notes is the first note's. Unknown ids are an error that lists them, up to size.BROADCAST_ROWS; unknown_ids gives all as a table."""
    return nest_notes(_asked(view, ids)).orderBy("file_id")


def retrieve_chunks(view: DataFrame, ids: DataFrame, pages: int = CHUNK_PAGES) -> DataFrame:
    """As retrieve, in chunks of the asked pages."""
    return nest_chunks(_asked(view, ids), pages).orderBy("file_id", "chunk")


def find_owner(placement: DataFrame, ids: DataFrame) -> DataFrame:
    """page_id, file_id (null unless exactly one note places the page) and owners, how many do."""
    owners = placement.select("page_id", "file_id").distinct().groupBy("page_id").agg(F.count("*").alias("n"), F.min("file_id").alias("one"))
    found = ids.select("page_id").distinct().join(owners, "page_id", "left")
    return found.select("page_id", F.when(F.col("n") == 1, F.col("one")).alias("file_id"), F.coalesce("n", F.lit(0)).cast("long").alias("owners"))


def resolve_links(view: DataFrame) -> DataFrame:
    """One row for each link: href (null if it leads nowhere) and external."""
    links = view.select("file_id", "page_id", F.posexplode("links").alias("link_pos", "link"))
    target_file, target_page, target = (F.coalesce(F.col(f"link.{c}"), F.lit("")) for c in ("target_file_id", "target_page_id", "target"))
    here = view.select(F.col("file_id").alias("in_file"), F.col("page_id").alias("in_page"), F.lit(True).alias("in_note")).distinct()
    joined = links.join(here, (target_file == F.col("in_file")) & (target_page == F.col("in_page")), "left")
    whole = (F.col("link.kind") == "note") & (target_file != "") & (target_page != "")
    same = target_file == F.col("file_id")
    href = (
        F.when(whole & same & F.col("in_note").isNotNull(), F.concat(target_page, F.lit(".svg")))
        .when(whole & ~same, F.concat(F.lit("../"), target_file, F.lit("/"), target_page, F.lit(".svg")))
        .when((F.col("link.kind") == "web") & (target != ""), target)
    )
    return joined.select("file_id", "page_id", "link_pos", F.col("link.kind").alias("kind"), href.alias("href"), (href.isNotNull() & (F.col("link.kind") == "web")).alias("external"))


def named(view: DataFrame) -> DataFrame:
    return view.withColumn("note_name", note_name(F.col("source"), F.col("file_id")))

