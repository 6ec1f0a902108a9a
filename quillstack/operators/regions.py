"""Region sections: the text of a templated page is marker lines, each followed by its section's text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.columns import text_change
from quillstack.model import SECTION

#: A marker line: ``<!-- region <id> [(label)] -->``.
MARKER = r"\A\s*<!--\s*region\s+(\S+)(?:\s+(.*?))?\s*-->\s*\z"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once a row however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def region_sections(md: Column) -> Column:
    """The sections (id, label, text) of a text, in order; text before the first marker is dropped. One row never leaves its place."""

    def sections(lines: Column) -> Column:
        numbered = F.transform(lines, lambda line, i: F.struct(i.alias("at"), line.alias("line")))
        return let(F.filter(numbered, lambda m: m["line"].rlike(MARKER)), lambda marks: F.transform(marks, lambda mark, k: section(lines, marks, mark, k)))

    def section(lines: Column, marks: Column, mark: Column, k: Column) -> Column:
        until = F.coalesce(F.get(marks, k + 1)["at"], F.size(lines))
        text = F.array_join(F.slice(lines, mark["at"] + 2, until - mark["at"] - 1), "\n")
        label = F.regexp_extract(mark["line"], MARKER, 2)
        label = F.trim(F.regexp_replace(F.regexp_replace(label, r"\A\(", ""), r"\)\z", ""))
        return F.struct(F.regexp_extract(mark["line"], MARKER, 1).alias("id"), label.alias("label"), F.trim(text, F.lit("\n")).alias("text"))

    return let(F.split(F.coalesce(md, F.lit("")), "\n", -1), sections)


def parse_regions(texts: DataFrame) -> DataFrame:
    """texts (file_id, page_id, md) as one row for each section."""
    return texts.select("file_id", "page_id", F.posexplode(region_sections(F.col("md"))).alias("sec_pos", "s")).select("file_id", "page_id", "sec_pos", "s.id", "s.label", "s.text")


def assemble(sections: Column) -> Column:
    """Sections as one text, a blank line between them; nothing for no sections."""

    def one(s: Column) -> Column:
        label = F.when(s["label"] != "", F.concat(F.lit(" ("), s["label"], F.lit(")"))).otherwise("")
        text = F.when(s["text"] != "", F.concat(s["text"], F.lit("\n"))).otherwise("")
        return F.concat(F.lit("<!-- region "), s["id"], label, F.lit(" -->\n"), text)

    return F.array_join(F.transform(F.coalesce(sections, F.array().cast(f"array<{SECTION}>")), one), "\n")


def assemble_regions(sections: DataFrame) -> DataFrame:
    """The inverse of parse_regions: file_id, page_id, md."""
    rows = sections.groupBy("file_id", "page_id").agg(F.array_sort(F.collect_list(F.struct("sec_pos", F.struct("id", "label", "text").alias("s")))).alias("all"))
    return rows.select("file_id", "page_id", assemble(F.col("all.s").cast(f"array<{SECTION}>")).alias("md"))


def section_text(sections: Column, id_: Column, last: bool = False) -> Column:
    """The text of the first (or last) section of an id; empty if there is none."""
    of = F.filter(sections, lambda s: s["id"] == id_)
    return F.coalesce(F.get(of, F.size(of) - 1 if last else F.lit(0))["text"], F.lit(""))


def _declared(boxes: Column, sections: Column, last: bool) -> Column:
    return F.transform(boxes, lambda b: F.struct(b["box_id"].alias("id"), b["label"].alias("label"), section_text(sections, b["box_id"], last).alias("text")))


def declared_column(boxes: Column, md: Column, last: bool) -> Column:
    """The declared boxes as sections: in order, empty text where the text has none; undeclared sections are left out. Null without boxes."""
    return F.when(boxes.isNotNull(), let(region_sections(md), lambda sections: _declared(boxes, sections, last)))


def region_layout(boxes: Column, md: Column) -> Column:
    """Sections in canonical order: declared boxes, then undeclared sections as they stand. Null without boxes."""

    def layout(sections: Column) -> Column:
        known = F.transform(boxes, lambda b: b["box_id"])
        return F.concat(_declared(boxes, sections, False), F.filter(sections, lambda s: ~F.array_contains(known, s["id"])))

    return F.when(boxes.isNotNull(), let(region_sections(md), layout))


def region_changes(texts: DataFrame) -> DataFrame:
    """texts (file_id, page_id, before, after): one row for each section of either side, with its change. The first section of an id counts."""
    held = texts.select("file_id", "page_id", F.explode(F.array(F.struct(region_sections(F.col("before")).alias("b"), region_sections(F.col("after")).alias("a")))).alias("s"))
    ids = F.array_distinct(F.concat(F.transform("s.a", lambda s: s["id"]), F.transform("s.b", lambda s: s["id"])))
    rows = held.select("file_id", "page_id", "s", F.posexplode(ids).alias("sec_pos", "id"))
    change = text_change(section_text(F.col("s.b"), F.col("id")), section_text(F.col("s.a"), F.col("id")))
    return rows.select("file_id", "page_id", "sec_pos", "id", F.explode(F.array(change)).alias("change")).select("file_id", "page_id", "sec_pos", "id", "change.*")
