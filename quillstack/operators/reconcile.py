"""Incremental reconciliation: the next state of an archive as a function of a delivery, the stored state and the parked pages."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstack.functions.columns import background_bytes, background_hash, device_hash
from quillstack.model import PARKED_HOLDER, Archive, schema
from quillstack.operators.order import renumber
from quillstack.sources.scratch import cut

KEY = ["file_id", "page_id"]
#: Columns of a page that the device does not give, and those that only keep book.
STAMPS = ["modified_at", "device_modified_at"]
BOOKKEEPING = [*STAMPS, "device_hash", "schema_version"]


_DROPPED = "array<struct<kind:string,rect:struct<x:int,y:int,w:int,h:int>>>"
#: A report row: a page that changed, or a note (page_id null) whose numbering was repaired.
REPORT = "file_id string, page_id string, is_new boolean, adopted boolean, adopted_from array<string>, metadata_changed boolean, vector_changed boolean, background_changed boolean, dropped_regions array<struct<kind:string,rect:struct<x:int,y:int,w:int,h:int>>>, pruned boolean, parked boolean, repaired boolean"


# --- regions


def _same(regions: Column, rect: Column, before: Column | None = None) -> Column:
    """The regions with this rect, of all or of those before a place."""
    return F.filter(regions if before is None else F.slice(regions, 1, before), lambda x: x["rect"] == rect)


def _many(regions: Column) -> Column:
    return F.coalesce(F.size(regions), F.lit(0))


def with_names(new: Column, old: Column) -> Column:
    """An array of regions with the analysis of their partners: the same rect in the old array, the first with the first, the second with the second."""
    partner = lambda r, i: F.get(_same(old, r["rect"]), _many(_same(new, r["rect"], i)))
    return F.transform(new, lambda r, i: r.withField("analysis", F.coalesce(partner(r, i)["analysis"], r["analysis"])))


def without_partner(new: Column, old: Column, kind: str) -> Column:
    """kind and rect of the named regions of an old array that have no partner in the new one, in the old order."""
    lost = F.filter(old, lambda r, i: r["analysis"].isNotNull() & (_many(_same(new, r["rect"])) <= _many(_same(old, r["rect"], i))))
    return F.coalesce(F.transform(lost, lambda r: F.struct(F.lit(kind).alias("kind"), r["rect"].alias("rect"))), F.array()).cast(_DROPPED)


def carry_regions(new: DataFrame, old: DataFrame) -> DataFrame:
    """new pages with the names that titles and links of the old version with the same rect had. Regions are paired within the row, so the join of the versions is all that moves."""
    was = old.select("page_id", F.col("titles").alias("_titles"), F.col("links").alias("_links"))
    joined = new.join(was, "page_id", "left")
    return joined.withColumns({c: with_names(F.col(c), F.col(f"_{c}")) for c in ("titles", "links")}).select(new.columns)


def dropped_regions(new: DataFrame, old: DataFrame) -> DataFrame:
    """page_id and dropped: named regions of the old version without a partner, titles first, in the old order. Pages that are in both."""
    now = new.select("page_id", F.col("titles").alias("_titles"), F.col("links").alias("_links"))
    dropped = F.concat(*[without_partner(F.col(f"_{c}s"), F.col(f"{c}s"), c) for c in ("title", "link")])
    return old.join(now, "page_id").select("page_id", dropped.alias("dropped")).where(F.size("dropped") > 0)


def apply_name_edits(pages: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edits (page_id, kind, idx from 1, name): pages with the names that really change, marked as edited, and the changes."""
    out, changes = pages, []
    for kind in ("title", "link"):
        asked = edits.where(F.col("kind") == kind).groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "name"))).alias("_asked"))
        joined = out.join(asked, "page_id", "left")
        name = lambda r: F.coalesce(r["analysis"]["name"], F.lit(""))
        wanted = lambda i: F.element_at("_asked", i + 1)
        numbered = F.filter(F.transform(f"{kind}s", lambda r, i: F.struct((i + 1).alias("idx"), name(r).alias("was"), wanted(i).alias("now"))), lambda x: x["now"].isNotNull() & (x["now"] != x["was"]))
        changes.append(joined.where("_asked IS NOT NULL").select("page_id", F.lit(kind).alias("kind"), F.explode(numbered).alias("c")).select("page_id", "kind", "c.*"))
        edited = F.transform(f"{kind}s", lambda r, i: r.withField("analysis", F.when(wanted(i).isNotNull() & (wanted(i) != name(r)), F.struct(wanted(i).alias("name"), F.lit(True).alias("edited"))).otherwise(r["analysis"])))
        out = joined.withColumn(f"{kind}s", F.when(F.col("_asked").isNotNull(), edited).otherwise(F.col(f"{kind}s"))).drop("_asked")
    return out.select(pages.columns), changes[0].unionAll(changes[1])


# --- state


def carry_state(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """incoming pages with analysis, tags and names of the stored version of the same page, where there is one."""
    kept = stored.select("page_id", F.col("analysis").alias("_analysis"), F.col("tags").alias("_tags"), F.lit(True).alias("_had"))
    joined = incoming.join(kept, "page_id", "left")
    out = joined.withColumns({"analysis": F.when(F.col("_had"), F.col("_analysis")).otherwise(F.col("analysis")), "tags": F.when(F.col("_had"), F.col("_tags")).otherwise(F.col("tags"))})
    return carry_regions(out.select(incoming.columns), stored)


def content(columns: list[str]) -> Column:
    """What a page says, without its owner and its bookkeeping, as text that can be compared."""
    held = [c for c in columns if c not in (*BOOKKEEPING, "file_id") and not c.startswith("_")]
    return F.to_json(F.struct(*held), {"ignoreNullFields": "false"})


def device_hashes(pages: DataFrame, svg: Column | None = None) -> Column:
    """The fingerprint of what the device gives: its metadata and its raw vector."""
    bare = lambda c: F.transform(c, lambda r: r.dropFields("analysis"))
    told = F.to_json(F.struct("page_id", "starred", bare("titles").alias("titles"), "keywords", bare("links").alias("links")))
    return device_hash(told, F.lit("") if svg is None else svg)


def modified_stamp(rows: DataFrame, now: Column) -> DataFrame:
    """rows (is_new, content_changed, touched, old_modified_at) with modified_at."""
    moved = F.col("is_new") | F.col("content_changed") | F.col("touched")
    return rows.withColumn("modified_at", F.when(moved, now).otherwise(F.col("old_modified_at")))


def device_stamp(rows: DataFrame, now: Column) -> DataFrame:
    """rows (is_new, adopted, device_hash, old_device_hash, old_device_modified_at) with device_modified_at. An empty stored hash is a baseline."""
    old = F.coalesce("old_device_hash", F.lit(""))
    moved = F.col("is_new") | F.col("adopted") | ((old != "") & (old != F.col("device_hash")))
    return rows.withColumn("device_modified_at", F.when(moved, now).otherwise(F.col("old_device_modified_at")))


def dedupe_backgrounds(vectors: DataFrame) -> DataFrame:
    """One image for each distinct content of each note: file_id, background_hash, content."""
    held = vectors.select("file_id", background_hash(F.col("svg")).alias("background_hash"), background_bytes(F.col("svg")).alias("content")).where("background_hash IS NOT NULL")
    return held.dropDuplicates(["file_id", "background_hash"])


#: Where a row of a merge comes from: a claim, a stored page, its text, a parked page.
CLAIM, STORED, TEXT, STASHED = range(4)


def merge_versions(incoming: Archive, stored: Archive, parked: DataFrame | None) -> DataFrame:
    """Who holds and who claims each page of a delivery, the stored state and the parked pages, by one shuffle of keys on page_id.

    Rows of three kinds, each with ``claimant``, the note that the page goes to (the claim that arrived last: seq, then the
    larger id; null if none claims it). A claim that won (``side`` CLAIM): its place, and ``holder``, whose version it goes on
    from, which is the claimant's own if there is one (``own``), else the first of another note or of the parked pages
    that has a text, else the first. A stored page (STORED) and a parked one (STASHED). Documents and texts stay behind; they
    are joined where they are needed. All windows share the shuffle and one sort.
    """
    seq = F.col("seq") if "seq" in incoming.notes.columns else F.lit(0)
    no_text = F.lit(False).alias("text")
    # places that have their note's number already need not be joined to it
    claims = incoming.placement if "seq" in incoming.placement.columns else incoming.placement.join(incoming.notes.select("file_id", seq.cast("long").alias("seq")), "file_id")
    parts = [
        claims.select("page_id", F.lit(CLAIM).alias("side"), "file_id", "seq", "pos", "number", no_text),
        stored.pages.select("page_id", F.lit(STORED).alias("side"), "file_id", no_text),
    ]
    if stored.md is not None:
        parts.append(stored.md.select("page_id", F.lit(TEXT).alias("side"), "file_id", F.lit(True).alias("text")))
    if parked is not None:
        parts.append(parked.select("page_id", F.lit(STASHED).alias("side"), F.lit(PARKED_HOLDER).alias("file_id"), F.col("md").isNotNull().alias("text")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)

    # dealt here, else each window would bring a shuffle of its own; the same order in all, else a sort
    rows, order, all_ = rows.repartition("page_id"), ["file_id", "side", F.desc("seq"), "pos"], (Window.unboundedPreceding, Window.unboundedFollowing)
    first = Window.partitionBy("page_id", "file_id", "side").orderBy(*order[2:])
    of_note, of_page = Window.partitionBy("page_id", "file_id").orderBy(*order[1:]).rowsBetween(*all_), Window.partitionBy("page_id").orderBy(*order).rowsBetween(*all_)
    rows = rows.withColumn("nth", F.row_number().over(first)).withColumn("text", F.max("text").over(of_note))
    claim = F.when((F.col("side") == CLAIM) & (F.col("nth") == 1), F.struct("seq", "file_id"))
    rows = rows.withColumn("claimant", F.max(claim).over(of_page)["file_id"])
    mine, held = F.col("file_id") == F.col("claimant"), F.col("side").isin(STORED, STASHED)
    rank = F.struct((~mine).alias("other"), (~F.col("text")).alias("bare"), "file_id")
    rows = rows.withColumns({"holder": F.min(F.when(held & F.col("claimant").isNotNull(), rank)).over(of_page)["file_id"], "own": F.max(F.coalesce((F.col("side") == STORED) & mine, F.lit(False))).over(of_page)})
    won = (F.col("side") == CLAIM) & (F.col("nth") == 1) & mine
    return cut(rows.where(won | held).select("page_id", "side", "file_id", "claimant", "own", "seq", "pos", "number", F.when(won, F.col("holder")).alias("holder")), "merged")


def _gaps(merged: DataFrame) -> DataFrame:
    """Notes that claim a page which they do not hold. Only these search: the others leave copies elsewhere alone."""
    return merged.where(f"side = {CLAIM} AND NOT own").select(F.col("file_id").alias("claimant")).distinct()


def _lost(merged: DataFrame) -> DataFrame:
    """page_id, file_id (the holder that loses the page) and claimant."""
    elsewhere = merged.where(f"side IN ({STORED}, {STASHED}) AND claimant <> file_id").select("page_id", "file_id", "claimant")
    return elsewhere.join(_gaps(merged), "claimant", "left_semi").select("page_id", "file_id", "claimant")


def _donors(lost: DataFrame) -> DataFrame:
    return lost.groupBy("page_id", "claimant").agg(F.array_sort(F.collect_set("file_id")).alias("donors"))


def adopt_moved_pages(incoming: Archive, stored: Archive, parked: DataFrame | None = None) -> DataFrame:
    """For each claimed page that lives elsewhere: page_id, claimant, origin (the preferred donor; null if the claimant's own copy wins) and donors, all of whom lose it."""
    merged = merge_versions(incoming, stored, parked)
    won = merged.where(F.col("side") == CLAIM).select("page_id", F.when(~F.col("own"), F.col("holder")).alias("origin"))
    return _donors(_lost(merged)).join(won, "page_id").select("page_id", "claimant", "origin", "donors")


def reclaim_parked(incoming: Archive, stored: Archive, parked: DataFrame) -> DataFrame:
    """The parked pages that incoming notes take back."""
    moved = adopt_moved_pages(incoming, stored, parked)
    return moved.where(F.col("origin") == PARKED_HOLDER).select("page_id", F.col("claimant").alias("file_id"))


def prune_and_park(gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """gone (pages with md and base): those that hold a text, an edit, tags or an analysis are parked, the rest is dropped."""
    keep = F.col("md").isNotNull() | F.coalesce(F.size("tags") > 0, F.lit(False)) | F.col("analysis").isNotNull() | F.coalesce(F.col("base") != "", F.lit(False))
    return gone.where(keep), gone.where(~keep)


def _claimed(incoming: Archive) -> DataFrame:
    return incoming.placement.join(incoming.notes.select("file_id").distinct(), "file_id", "left_semi").select("page_id").distinct()


def _gone(incoming: Archive, stored: Archive, merged: DataFrame | None) -> DataFrame:
    """Stored pages that left a delivered note and are claimed by none, with md and base. Found by their keys, in merged if that is there: only documents and texts of pages that are gone are joined."""
    if merged is None:
        unclaimed = stored.pages.select(*KEY).join(_claimed(incoming), "page_id", "left_anti")
    else:
        unclaimed = merged.where(f"side = {STORED} AND claimant IS NULL").select(*KEY)
    keys = cut(unclaimed.join(incoming.notes.select("file_id").distinct(), "file_id", "left_semi").distinct(), "gone")
    pages = stored.pages.join(keys, KEY, "left_semi")
    if stored.md is None:
        return pages.withColumns({"md": F.lit(None).cast("string"), "base": F.lit(None).cast("string")})
    texts = stored.md.join(keys, KEY, "left_semi").groupBy(*KEY).agg(F.first(F.struct("md", "base")).alias("_text"))
    return cut(pages.join(texts, KEY, "left").select(*stored.pages.columns, "_text.md", "_text.base"), "gone")


@contextmanager
def _dealt_by_one_key(spark: SparkSession) -> Iterator[None]:
    """Joins on several columns, planned within, take sides that are dealt by one of these columns as they lie."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _carried(held: list[str]) -> Column:
    """What a stored document gives its next version, as a struct: its state, the rects and names of its regions if any has a name, and a fingerprint of its content in place of the rest."""
    named = lambda c: F.when(F.exists(c, lambda r: r["analysis"].isNotNull()), F.transform(c, lambda r: F.struct(r["rect"].alias("rect"), r["analysis"].alias("analysis")))).alias(c)
    return F.struct("analysis", "tags", "modified_at", "device_modified_at", "device_hash", "background_hash", named("titles"), named("links"), F.unhex(F.md5(content(held))).alias("content"))


def _versions(stored: Archive, stash: DataFrame | None, held: list[str]) -> DataFrame:
    """page_id, holder, source (old, text): what each holder of a page hands on, and the text, if there is one. Documents, texts and parked pages are dealt together, once, by page_id."""
    said = "struct<md:string,base:string>"
    key = lambda of: [F.col("page_id"), of.alias("holder")]
    version = lambda text: F.struct(_carried(held).alias("old"), text.cast(said).alias("text")).alias("held")
    rows = stored.pages.select(*key(F.col("file_id")), version(F.lit(None)))
    if stash is not None:
        rows = rows.unionByName(stash.select(*key(F.lit(PARKED_HOLDER)), version(F.when(F.col("md").isNotNull(), F.struct("md", "base")))))
    rows = rows.withColumn("text", F.lit(None).cast(said))
    if stored.md is not None:
        rows = rows.unionByName(stored.md.select(*key(F.col("file_id")), F.struct("md", "base").alias("text")), allowMissingColumns=True)
    one = rows.repartition("page_id").groupBy("page_id", "holder").agg(F.first("held", ignorenulls=True).alias("held"), F.first("text", ignorenulls=True).alias("text"))
    return one.where("held IS NOT NULL").select("page_id", "holder", F.struct("held.old", F.coalesce("text", "held.text").alias("text")).alias("source"))


def _settled_rows(merged: DataFrame, incoming: Archive, stored: Archive, stash: DataFrame | None, donors: DataFrame, now: Column) -> DataFrame:
    """The delivered pages in their next version, with what the report tells of them: the claims that won with the document that came and the version that they go on from.

    All of it meets by page_id, so a document moves once. incoming.pages may tell by ``seq`` and ``pos`` which claim a document came with.
    """
    columns = stored.pages.columns
    held = [c for c in columns if c not in KEY]
    came = [*KEY, *(c for c in ("seq", "pos") if c in incoming.pages.columns)]
    new = incoming.pages.select(*came, F.struct(*[c for c in held if c not in STAMPS]).alias("new")).repartition("page_id").dropDuplicates(came)
    claims = merged.where(F.col("side") == CLAIM).join(donors.select("page_id", "donors"), "page_id", "left")
    rows = claims.join(new, came).join(_versions(stored, stash, held), ["page_id", "holder"], "left")
    had = F.col("source").isNotNull()
    page = {c: F.col(f"new.{c}") for c in held if c not in STAMPS}
    page |= {c: F.when(had, F.col(f"source.old.{c}")).otherwise(F.col(f"new.{c}")) for c in ("analysis", "tags")}
    page |= {c: with_names(F.col(f"new.{c}"), F.col(f"source.old.{c}")) for c in ("titles", "links")}
    old_hash = F.coalesce("source.old.device_hash", F.lit(""))
    dropped = F.concat(*[without_partner(F.col(f"new.{c}s"), F.col(f"source.old.{c}s"), c) for c in ("title", "link")])
    rows = rows.withColumns(page | {
        "is_new": ~had, "adopted": had & ~F.col("own"), "old_modified_at": F.col("source.old.modified_at"), "old_device_modified_at": F.col("source.old.device_modified_at"), "old_device_hash": F.col("source.old.device_hash"),
        "background_changed": had & ~F.col("new.background_hash").eqNullSafe(F.col("source.old.background_hash")), "vector_changed": had & (old_hash != "") & (old_hash != F.coalesce("new.device_hash", F.lit(""))), "dropped_regions": dropped,
    })
    rows = rows.withColumn("adopted_from", F.when(F.col("adopted"), F.coalesce("donors", F.array())).otherwise(F.array()).cast("array<string>"))
    rows = rows.withColumn("content_changed", had & (F.unhex(F.md5(content(held))) != F.col("source.old.content")))
    rows = device_stamp(modified_stamp(rows.withColumn("touched", F.col("adopted") | F.col("vector_changed")), now), now)
    told = ["is_new", "adopted", "adopted_from", "content_changed", "vector_changed", "background_changed", "dropped_regions"]
    with _dealt_by_one_key(merged.sparkSession):
        return cut(rows.select(*columns, F.col("source.text").alias("text"), *told), "pages")


@dataclass(frozen=True)
class Reconciled:
    """The next state, the parked pages, and a report with one row for each page that changed."""

    archive: Archive
    parked: DataFrame
    report: DataFrame


class Outcome:
    """What Reconciled holds, each table made when an output first asks for it.

    Who holds and claims a page is decided on keys (merge_versions); documents and texts are joined to what came of it. What is
    asked of notes (who is delivered, who has a gap) is joined by note.
    """

    def __init__(self, incoming: Archive, stored: Archive, stash: DataFrame | None, now: Column):
        self.incoming, self.stored, self.stash, self.now = incoming, stored, stash, now

    @cached_property
    def _merged(self) -> DataFrame:
        return merge_versions(self.incoming, self.stored, self.stash)

    @property
    def _known(self) -> DataFrame | None:
        """_merged, if an output has asked for it already."""
        return self.__dict__.get("_merged")

    @cached_property
    def _lost(self) -> DataFrame:
        return cut(_lost(self._merged), "lost")

    @cached_property
    def settled(self) -> DataFrame:
        return _settled_rows(self._merged, self.incoming, self.stored, self.stash, _donors(self._lost), self.now)

    @cached_property
    def _delivered(self) -> DataFrame:
        return self.incoming.notes.select("file_id").distinct()

    @cached_property
    def _gone(self) -> DataFrame:
        return _gone(self.incoming, self.stored, self._known)

    @cached_property
    def _others(self) -> DataFrame:
        return self.stored.placement.join(self._delivered, "file_id", "left_anti")

    @cached_property
    def _hit(self) -> DataFrame:
        return cut(self._others.join(self._lost, KEY, "left_semi").select("file_id").distinct(), "hit")

    @cached_property
    def archive(self) -> Archive:
        stored, merged, rows, columns = self.stored, self._merged, self.settled, self.stored.pages.columns
        texts = [F.col("text.md").alias("md"), F.col("text.base").alias("base")]
        held = merged.where(F.col("side") == STORED).select(*KEY, "claimant").join(self._delivered, "file_id", "left_anti").distinct()
        keep = held.join(_gaps(merged).withColumn("_gap", F.lit(True)), "claimant", "left").where("_gap IS NULL OR claimant = file_id")
        keep = cut(keep.select(*KEY), "keep")
        pages = stored.pages.join(keep, KEY, "left_semi").unionByName(rows.select(columns))
        md = self.stored.md if self.stored.md is not None else rows.limit(0).select(*KEY, *texts)
        kept_md = md.select(*KEY, "md", "base").join(keep, KEY, "left_semi")
        carried_md = rows.where("text IS NOT NULL").select("file_id", "page_id", *texts)

        claims = renumber(merged.where(F.col("side") == CLAIM).select("file_id", "pos", "page_id", "number"))
        repaired = renumber(self._others.join(self._hit, "file_id", "left_semi").join(self._lost, KEY, "left_anti"))
        placement = self._others.join(self._hit, "file_id", "left_anti").unionByName(repaired).unionByName(claims)
        tags = stored.notes.select("file_id", F.col("tags").alias("_tags"))
        fresh = self.incoming.notes.join(tags, "file_id", "left").withColumn("tags", F.coalesce("_tags", "tags")).select(stored.notes.columns)
        notes = stored.notes.join(self._delivered, "file_id", "left_anti").unionByName(fresh)
        return Archive(notes, placement, pages, kept_md.unionByName(carried_md), stored.boxes)

    @cached_property
    def parked(self) -> DataFrame:
        to_park, _ = prune_and_park(self._gone)
        if self.stash is None:
            return to_park
        known = self._known
        claimed = _claimed(self.incoming) if known is None else known.where(f"side = {STASHED} AND claimant IS NOT NULL").select("page_id").distinct()
        return self.stash.join(claimed, "page_id", "left_anti").select(to_park.columns).unionByName(to_park)

    @cached_property
    def report(self) -> DataFrame:
        changed = self.settled.withColumn("metadata_changed", F.col("content_changed") | F.col("adopted")).withColumns({c: F.lit(False) for c in ("pruned", "parked", "repaired")})
        changed = changed.where("is_new OR metadata_changed OR vector_changed OR background_changed OR size(dropped_regions) > 0")
        names = [f.name for f in schema(REPORT).fields]

        def plain(df: DataFrame, **said: bool) -> DataFrame:
            flags = {c: F.lit(said.get(c, False)) for c in ("is_new", "adopted", "metadata_changed", "vector_changed", "background_changed", "pruned", "parked", "repaired")}
            page = F.col("page_id") if "page_id" in df.columns else F.lit(None).cast("string")
            return df.withColumns({"page_id": page, "adopted_from": F.array().cast("array<string>"), "dropped_regions": F.array().cast(_DROPPED), **flags}).select(names)

        to_park, to_drop = prune_and_park(self._gone)
        return changed.select(names).unionByName(plain(to_park, pruned=True, parked=True)).unionByName(plain(to_drop, pruned=True)).unionByName(plain(self._hit, repaired=True))


def reconcile_pages(incoming: Archive, stored: Archive, parked: DataFrame | None, now: Column) -> Outcome:
    """The outcome of a delivery. incoming.pages may have ``svg``, the raw vector; unchanged pages give no report row."""
    return Outcome(incoming, stored, parked, now)
