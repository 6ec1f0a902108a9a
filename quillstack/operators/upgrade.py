"""Lifting documents of older versions to the current one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.columns import created_at
from quillstack.model import CURRENT_VERSION


def _real(id_: Column) -> Column:
    return F.coalesce((id_ != "") & (id_ != "none"), F.lit(False))


def upgrade_docs(docs: DataFrame, kind: str) -> DataFrame:
    """docs with schema_version (null = 0) lifted to the current version. Of notes only the number changes.

    Version 2 gave links a kind and dropped placeholder ids; version 6 gave pages both stamps, from their id.
    """
    version = F.coalesce("schema_version", F.lit(0))
    out = docs
    if kind == "page":

        def link(l: Column) -> Column:
            file, page = _real(l["target_file_id"]), _real(l["target_page_id"])
            return l.withField("kind", F.when(file & page, "note").otherwise("unknown")).withField("target_file_id", F.when(file, l["target_file_id"])).withField("target_page_id", F.when(page, l["target_page_id"]))

        stamp = created_at(F.col("page_id"))
        out = out.withColumns({
            "links": F.when(version < 2, F.transform("links", link)).otherwise(F.col("links")),
            "modified_at": F.when((version < 6) & stamp.isNotNull(), stamp).otherwise(F.col("modified_at")),
            "device_modified_at": F.when((version < 6) & stamp.isNotNull(), stamp).otherwise(F.col("device_modified_at")),
        })
    return out.withColumn("schema_version", F.when(version <= CURRENT_VERSION, F.lit(CURRENT_VERSION)).otherwise(version).cast("int"))


def upgrade_outcomes(docs: DataFrame) -> DataFrame:
    """docs (path, value: the document as text) with outcome (current, migrated, failed) and error. One bad document stops no other."""
    parsed = F.try_parse_json("value")
    sound = parsed.isNotNull() & F.col("value").rlike(r"\A\s*\{")
    raw = F.get_json_object("value", "$.schema_version")
    kind = F.schema_of_variant(F.try_variant_get(parsed, "$.schema_version", "variant"))  # of the document's own key, null without it
    quoted = F.coalesce(~kind.rlike(r"\A(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))
    version = F.when(raw.isNull(), 0).otherwise(raw.try_cast("int"))
    error = (
        F.when(~F.coalesce(sound, F.lit(False)), F.lit("not a JSON object"))
        .when(quoted, F.lit("schema_version is not a number"))
        .when(version.isNull() | ~F.coalesce(raw, F.lit("0")).rlike(r"\A-?[0-9]+\z"), F.concat(F.lit("invalid schema_version "), raw))
        .when(version > CURRENT_VERSION, F.concat(F.lit("schema version "), version.cast("string"), F.lit(" is newer than "), F.lit(str(CURRENT_VERSION))))
    )
    outcome = F.when(error.isNotNull(), "failed").when(version == CURRENT_VERSION, "current").otherwise("migrated")
    return docs.withColumns({"outcome": outcome, "error": error})


def upgrade_selection(placement: DataFrame, ids: DataFrame | None, parked: DataFrame | None = None) -> DataFrame:
    """What to upgrade: kind (page, note or unknown), file_id, page_id. Chosen pages bring their notes; without ids everything, parked pages included."""
    none = F.lit(None).cast("string")
    if ids is None:
        pages = placement.select(F.lit("page").alias("kind"), "file_id", "page_id")
        if parked is not None:
            pages = pages.unionByName(parked.select(F.lit("page").alias("kind"), none.alias("file_id"), "page_id"))
        return pages.unionByName(placement.select("file_id").distinct().select(F.lit("note").alias("kind"), "file_id", none.alias("page_id")))
    asked = ids.select("page_id").distinct()
    chosen = placement.join(asked, "page_id", "left_semi")
    unknown = asked.join(placement.select("page_id"), "page_id", "left_anti")
    if parked is not None:
        unknown = unknown.join(parked.select("page_id"), "page_id", "left_anti")
    out = chosen.select(F.lit("page").alias("kind"), "file_id", "page_id").unionByName(chosen.select("file_id").distinct().select(F.lit("note").alias("kind"), "file_id", none.alias("page_id")))
    if parked is not None:
        out = out.unionByName(parked.join(asked, "page_id", "left_semi").join(placement.select("page_id"), "page_id", "left_anti").select(F.lit("page").alias("kind"), none.alias("file_id"), "page_id"))
    return out.unionByName(unknown.select(F.lit("unknown").alias("kind"), none.alias("file_id"), "page_id"))
