"""Queries on functions, predicates, joins, counts, orders, labels and listings."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.functions import columns as c
from quillstack.functions import filters as f
from quillstack.operators import counts, export, labels, order, regions, strokes, view
from quillstack.plans.archives import SQL, conversations_archive, documents_archive, drawn_vectors, events_archive, sectioned_documents, table
from quillstack.queries import register

EV, DOC = SQL["ev"], SQL["doc"]


def events_view(spark: SparkSession, sf_dir: str, md: bool = False, boxes: bool = False) -> DataFrame:
    a = events_archive(spark, sf_dir)
    return view.page_view(a.notes, a.placement, a.pages, a.md if md else None, a.boxes if boxes else None)


def documents_view(spark: SparkSession, sf_dir: str, md: bool = False) -> DataFrame:
    a = documents_archive(spark, sf_dir)
    return view.page_view(a.notes, a.placement, a.pages, a.md if md else None)


# --- scalar functions


@register(f"{EV} SELECT DISTINCT file_id, 'user' || user_id AS name FROM ev")
def note_name(spark, sf_dir):
    return events_archive(spark, sf_dir).notes.select("file_id", c.note_name(F.col("source"), F.col("file_id")).alias("name"))


@register(f"{EV} SELECT page_id, date_trunc('second', ts) AS created_at FROM ev")
def created_at(spark, sf_dir):
    return events_archive(spark, sf_dir).pages.select("page_id", c.created_at(F.col("page_id")).alias("created_at"))


@register(f"{EV} SELECT page_id, array_to_string(tags, ',') AS tags FROM ef")
def effective_tags(spark, sf_dir):
    return events_view(spark, sf_dir).select("page_id", F.array_join("effective_tags", ",").alias("tags"))


@register(f"{EV} SELECT page_id, strftime(ts, '%Y%m%d') || 'T' || strftime(ts, '%H%M%S') AS id, '' AS of_note, strftime(ts, '%Y%m%d') || 'T' || strftime(ts, '%H%M%S') AS of_name FROM ev")
def denote_id(spark, sf_dir):
    pages = events_archive(spark, sf_dir).pages
    id_ = c.denote_id(F.col("page_id"))
    return pages.select("page_id", id_.alias("id"), c.denote_id(F.col("file_id")).alias("of_note"), c.denote_id(F.concat(F.lit("title@@"), id_, F.lit("__kw.epub"))).alias("of_name"))


@register(f"{EV} SELECT page_id, file_id || '/' || page_id || '.svg' AS path FROM ev")
def vector_path(spark, sf_dir):
    return events_archive(spark, sf_dir).pages.select("page_id", c.vector_path(F.col("file_id"), F.col("page_id")).alias("path"))


@register(f"{DOC} SELECT page_id, sha256(md) AS stored, length(md) AS n FROM doc")
def norm_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = c.norm_text(F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n")))
    return docs.select(F.concat(F.lit("Pd"), F.col("doc_id").cast("string")).alias("page_id"), F.sha2(text, 256).alias("stored"), F.length(text).alias("n"))


@register(f"{EV} SELECT ev.page_id, ev.link_kind AS kind, coalesce(ev.link_kind = 'note' AND x.file_id = ev.file_id, false) AS internal FROM ev LEFT JOIN ev x ON x.n = ev.n + 1")
def link_facts(spark, sf_dir):
    pages = events_archive(spark, sf_dir).pages
    return pages.select("page_id", F.explode(c.link_facts(F.col("links"), F.col("file_id"))).alias("l")).select("page_id", "l.kind", "l.internal")


@register(f"{EV} SELECT ev.page_id, CASE WHEN link_kind = 'note' AND EXISTS (SELECT 1 FROM ev x WHERE x.n = ev.n + 1) THEN replace(coalesce(link_name, 'link' || n || '.note'), '.note', '') ELSE coalesce(link_name, 'link' || n || '.note') END AS label FROM ev")
def link_label(spark, sf_dir):
    return events_archive(spark, sf_dir).pages.select("page_id", c.link_label(F.get("links", F.lit(0))).alias("label"))


@register(f"{DOC} SELECT page_id, sha256(regexp_replace(md, '(^|\\n)T', '\\1TTTT', 'g')) AS nested FROM doc")
def nest_headings(spark, sf_dir):
    a = documents_archive(spark, sf_dir)
    return a.md.select("page_id", F.sha2(c.nest_headings(F.col("md"), "TTT"), 256).alias("nested"))


@register(f"{DOC} SELECT page_id, contains(md || CASE WHEN n % 4 = 0 THEN '<<<<<<< edited' ELSE '' END, '<<<<<<< edited') AS conflicts FROM doc")
def has_conflicts(spark, sf_dir):
    docs = documents_archive(spark, sf_dir).md
    marked = F.concat("md", F.when(F.substring("page_id", 3, 20).cast("long") % 4 == 0, "<<<<<<< edited").otherwise(""))
    return docs.select("page_id", c.has_conflicts(marked).alias("conflicts"))


@register("SELECT page_id, '#+filetags: :' || regexp_replace(coalesce(url, ''), '[^\\p{L}\\p{N}_@#%]', '_', 'g') || ':' || chr(10) AS line FROM pages")
def note_tag_line(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", c.note_tag_line(F.array(F.coalesce("url", F.lit("")))).alias("line"))


@register(f"{EV} SELECT page_id, CASE WHEN n % 3 = 0 THEN sha256('bg' || (n % 9)) END AS background_hash FROM ev")
def background_hash(spark, sf_dir):
    return drawn_vectors(spark, sf_dir).select("page_id", c.background_hash(F.col("svg")).alias("background_hash"))


@register(f"{EV} SELECT page_id, CASE WHEN event_type = 'error' THEN '' WHEN md <> '' OR analysed THEN rtrim(md, chr(10)) END AS content FROM ev")
def page_content(spark, sf_dir):
    rows = events_view(spark, sf_dir, md=True, boxes=True)
    return rows.select("page_id", c.page_content(F.col("md"), F.col("boxes").isNotNull(), F.col("analysis"), F.coalesce(F.size("boxes"), F.lit(0))).alias("content"))


_STROKES = "['M 0 ' || n || ' L 1 1', 'M 5 2 L ' || n || ' 2', 'm 3 3 L 4 4']"


@register(f"{EV} SELECT page_id, (s - 1)::INT AS stroke_pos, ({_STROKES})[s] AS stroke FROM ev, range(1, 4) t(s)")
def stroke_list(spark, sf_dir):
    return strokes.strokes(drawn_vectors(spark, sf_dir)).select("page_id", "stroke_pos", "stroke")


@register(f"{EV} SELECT page_id, sha256(array_to_string({_STROKES}, chr(10))) AS source_hash FROM ev")
def handwriting_hash(spark, sf_dir):
    return strokes.handwriting_hash(drawn_vectors(spark, sf_dir)).select("page_id", "source_hash")


@register(f"{EV} SELECT c AS change, page_id, 1 AS stroke_pos, 'M 5 ' || CASE c WHEN 'added' THEN '9' ELSE '2' END || ' L ' || n || ' 2' AS stroke FROM ev, (VALUES ('added'), ('removed')) v(c) WHERE n % 4 = 0")
def stroke_changes(spark, sf_dir):
    return strokes.stroke_changes(drawn_vectors(spark, sf_dir), drawn_vectors(spark, sf_dir, 2))


# --- predicates


def _ids(rows: DataFrame, condition) -> DataFrame:
    return f.query_pages(rows, condition).select("page_id")


@register(f"{EV} SELECT page_id FROM ev")
def filter_all(spark, sf_dir):
    return _ids(events_view(spark, sf_dir), f.all_pages())


@register(f"{EV} SELECT page_id FROM ev WHERE starred")
def filter_starred(spark, sf_dir):
    return _ids(events_view(spark, sf_dir), f.starred())


@register(f"{DOC} SELECT page_id FROM doc WHERE quality IS NULL")
def filter_unanalyzed(spark, sf_dir):
    return _ids(documents_view(spark, sf_dir), f.unanalyzed())


@register(f"{EV} SELECT page_id FROM ev WHERE event_type = 'error'")
def filter_templated(spark, sf_dir):
    return _ids(events_view(spark, sf_dir, boxes=True), f.templated())


@register(f"{EV} SELECT page_id FROM ev WHERE contains(file_id, '07')")
def filter_note(spark, sf_dir):
    return _ids(events_view(spark, sf_dir), f.note_is(f.substring("f")) & f.note_is(f.substring("07")))


@register(f"{EV} SELECT page_id FROM ev WHERE event_type = 'click'")
def filter_keyword(spark, sf_dir):
    return _ids(events_view(spark, sf_dir), f.keyword_is(f.exact("click")))


@register(f"{EV} SELECT page_id FROM ef WHERE list_contains(tags, 'vip')")
def filter_tag(spark, sf_dir):
    return _ids(events_view(spark, sf_dir), f.tag_is(f.exact("vip")))


@register(f"{DOC} SELECT page_id FROM doc WHERE contains(lower(md), 'the the')")
def filter_content(spark, sf_dir):
    return _ids(documents_view(spark, sf_dir, md=True), f.content_is(f.substring("The THE")))


@register(f"{DOC} SELECT page_id FROM doc WHERE regexp_matches(md, '(?i)^the [a-z]+ing\\b')")
def filter_regexp(spark, sf_dir):
    return _ids(documents_view(spark, sf_dir, md=True), f.content_is(f.regexp(r"(?i)^the [a-z]+ing\b")))


@register(f"{EV} SELECT page_id FROM ev WHERE event_type = 'error' AND (md = '' OR contains(md, 'error 1') OR n % 4 = 0)")
def filter_region(spark, sf_dir):
    rows = view.declared_regions(events_view(spark, sf_dir, md=True, boxes=True))
    fourth = F.substring("page_id", 16, 8).cast("long") % 4 == 0
    return _ids(rows, f.either(f.region_is("title", f.substring("error 1")), f.region_is("title", f.exact("")), f.region_is(None, f.exact("")) & fourth) & ~f.region_is("gone", f.exact("left over")))


@register(f"{EV} SELECT page_id FROM ev WHERE ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-10'")
def filter_created(spark, sf_dir):
    return _ids(events_view(spark, sf_dir), f.created_between(date(2024, 1, 5), date(2024, 1, 10)))


@register(f"{EV} SELECT page_id FROM ev WHERE modified_at::DATE >= DATE '2024-01-15'")
def filter_modified(spark, sf_dir):
    return _ids(events_view(spark, sf_dir), f.modified_between(date(2024, 1, 15), None))


@register(f"{EV} SELECT page_id FROM ev WHERE device_modified_at::DATE <= DATE '2024-01-15'")
def filter_device_modified(spark, sf_dir):
    return _ids(events_view(spark, sf_dir), f.device_modified_between(None, date(2024, 1, 15)))


@register(f"{EV} SELECT page_id FROM ev WHERE NOT (n % 9 = 0) AND (starred OR event_type = 'view')")
def filter_ids(spark, sf_dir):
    rows = events_view(spark, sf_dir)
    ids = events_archive(spark, sf_dir).placement.where(F.substring("page_id", 16, 8).cast("long") % 9 == 0)
    return _ids(f.mark_ids(rows, ids, "ninth"), f.both(f.negate(f.ids_in("ninth")), f.either(f.starred(), f.keyword_is(f.exact("view")))))


@register(f"{EV} SELECT page_id FROM ef WHERE NOT (starred OR event_type = 'click') AND list_contains(tags, 'vip') OR file_id = 'F000001'")
def filter_combined(spark, sf_dir):
    return _ids(events_view(spark, sf_dir), f.either(f.both(f.negate(f.either(f.starred(), f.keyword_is(f.substring("CLICK")))), f.tag_is(f.exact("vip"))), f.note_is(f.exact("F000001"))))


@register(f"{DOC} SELECT page_id FROM doc WHERE lang = 'fr' AND number % 2 = 1")
def filter_custom(spark, sf_dir):
    return _ids(documents_view(spark, sf_dir), f.both(f.keyword_is(f.exact("fr")), F.col("number") % 2 == 1))


# --- joins


@register(f"{EV} SELECT file_id, page_id, pos, number, source, event_type AS keyword, md, event_type = 'error' AS templated FROM ev")
def page_view(spark, sf_dir):
    return events_view(spark, sf_dir, md=True, boxes=True).select("file_id", "page_id", "pos", "number", "source", F.col("keywords")[0]["text"].alias("keyword"), "md", F.col("boxes").isNotNull().alias("templated"))


@register(f"{EV} SELECT file_id, count(*) AS pages, string_agg(page_id, ',' ORDER BY pos) AS ids, string_agg(array_to_string(tags, '+'), ',' ORDER BY pos) AS tags, sum((link_kind = 'note' AND EXISTS (SELECT 1 FROM ev x WHERE x.n = ef.n + 1 AND x.file_id = ef.file_id))::INT) AS internal FROM ef WHERE n % 3 = 0 GROUP BY file_id")
def retrieve(spark, sf_dir):
    rows = events_view(spark, sf_dir, md=True, boxes=True)
    ids = rows.where(F.substring("page_id", 16, 8).cast("long") % 3 == 0).select("page_id")
    nested = view.retrieve(rows, ids)
    p = F.col("pages")
    internal = F.aggregate(F.flatten(F.transform(p, lambda x: F.transform(x["links"], lambda l: (l["internal"] & (l["kind"] == "note")).cast("long")))), F.lit(0).cast("long"), lambda a, b: a + b)
    return nested.select("file_id", F.size(p).cast("long").alias("pages"), F.array_join(F.transform(p, lambda x: x["page_id"]), ",").alias("ids"), F.array_join(F.transform(p, lambda x: F.array_join(x["tags"], "+")), ",").alias("tags"), internal.alias("internal"))


@register(f"{EV} SELECT page_id, CASE WHEN event_type = 'error' THEN 'title,grade,note' END AS boxes FROM ev")
def match_template(spark, sf_dir):
    a = events_archive(spark, sf_dir)
    return view.match_template(a.pages, a.boxes).select("page_id", F.array_join(F.transform("boxes", lambda b: b["box_id"]), ",").alias("boxes"))


@register(f"{EV}, c AS (SELECT file_id, page_id FROM ev UNION ALL SELECT 'F999999', page_id FROM ev WHERE n % 50 = 0), g AS (SELECT page_id, count(DISTINCT file_id) AS owners, min(file_id) AS f FROM c GROUP BY page_id) SELECT page_id, CASE WHEN owners = 1 THEN f END AS file_id, owners FROM g UNION ALL SELECT 'Pnone', NULL, 0")
def find_owner(spark, sf_dir):
    place = events_archive(spark, sf_dir).placement
    twice = place.where(F.substring("page_id", 16, 8).cast("long") % 50 == 0).withColumn("file_id", F.lit("F999999"))
    ids = place.select("page_id").unionAll(spark.range(1).select(F.lit("Pnone").alias("page_id")))
    return view.find_owner(place.unionByName(twice), ids)


@register(f"""{EV} SELECT ev.page_id, 0 AS link_pos, ev.link_kind AS kind,
  CASE ev.link_kind WHEN 'note' THEN CASE WHEN x.file_id = ev.file_id THEN x.page_id || '.svg' ELSE '../' || x.file_id || '/' || x.page_id || '.svg' END WHEN 'web' THEN 'https://example.org/' || ev.n END AS href, ev.link_kind = 'web' AS external
  FROM ev LEFT JOIN ev x ON x.n = ev.n + 1""")
def resolve_links(spark, sf_dir):
    return view.resolve_links(events_view(spark, sf_dir)).drop("file_id")


@register(f"{EV} SELECT page_id, b.p::INT AS box_pos, b.id, b.label, CASE WHEN b.id = 'title' AND md <> '' THEN 'error ' || n ELSE '' END AS text FROM ev, (VALUES (0, 'title', 'Title'), (1, 'grade', 'Grade'), (2, 'note', 'Note')) b(p, id, label) WHERE event_type = 'error'")
def region_view(spark, sf_dir):
    return view.region_view(events_view(spark, sf_dir, md=True, boxes=True)).drop("file_id", "rect")


@register("SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS link_pos, l[i] AS target FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS l FROM pages), range(1, 100000) t(i) WHERE i <= len(l)")
def raw_links(spark, sf_dir):
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('<a href="([^"]*)"'), 1)
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(links).alias("link_pos", "target"))


# --- counts


@register(f"{EV} SELECT event_type AS value, count(*) AS count FROM ev GROUP BY 1")
def keyword_counts(spark, sf_dir):
    return counts.keyword_counts(events_view(spark, sf_dir))


@register(f"{EV} SELECT value, count(*) AS count FROM (SELECT unnest(tags) AS value FROM ef) GROUP BY 1")
def tag_counts(spark, sf_dir):
    return counts.tag_counts(events_view(spark, sf_dir))


@register(f"{EV}, c AS (SELECT file_id, page_id FROM ev UNION ALL SELECT 'F' || lpad((user_id + 1)::VARCHAR, 6, '0'), page_id FROM ev WHERE n % 10 = 1) SELECT page_id, array_to_string(list_sort(list(DISTINCT file_id)), ',') AS owners FROM c GROUP BY page_id HAVING count(DISTINCT file_id) > 1")
def duplicate_pages(spark, sf_dir):
    place = events_archive(spark, sf_dir).placement
    more = place.where(F.substring("page_id", 16, 8).cast("long") % 10 == 1).withColumn("file_id", F.concat(F.lit("F"), F.lpad((F.substring("file_id", 2, 9).cast("long") + 1).cast("string"), 6, "0")))
    return counts.duplicate_pages(place.unionByName(more)).select("page_id", F.array_join("owners", ",").alias("owners"))


@register(f"{EV} SELECT file_id, string_agg(page_id, ',' ORDER BY pos) AS pages, count(*) AS n FROM ev GROUP BY file_id")
def nest_notes(spark, sf_dir):
    nested = view.nest_notes(events_view(spark, sf_dir, md=True, boxes=True))
    return nested.select("file_id", F.array_join(F.transform("pages", lambda p: p["page_id"]), ",").alias("pages"), F.size("pages").cast("long").alias("n"))


@register(f"{EV} SELECT file_id, pos // 20 AS chunk, string_agg(page_id, ',' ORDER BY pos) AS pages, count(*) AS n FROM ev GROUP BY ALL")
def nest_chunks(spark, sf_dir):
    nested = view.nest_chunks(events_view(spark, sf_dir, md=True, boxes=True), 20)
    return nested.select("file_id", "chunk", F.array_join(F.transform("pages", lambda p: p["page_id"]), ",").alias("pages"), F.size("pages").cast("long").alias("n"))


@register(f"{EV}, k AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY pos) - 1 AS i FROM ev WHERE n % 3 = 0) SELECT file_id, i // 10 AS chunk, string_agg(page_id, ',' ORDER BY i) AS ids FROM k GROUP BY ALL")
def retrieve_chunks(spark, sf_dir):
    rows = events_view(spark, sf_dir, md=True, boxes=True)
    ids = rows.where(F.substring("page_id", 16, 8).cast("long") % 3 == 0).select("page_id")
    return view.retrieve_chunks(rows, ids, 10).select("file_id", "chunk", F.array_join(F.transform("pages", lambda x: x["page_id"]), ",").alias("ids"))


@register(f"{EV}, k AS (SELECT file_id, event_type, min(pos) AS p FROM ev WHERE event_type <> 'view' GROUP BY ALL) SELECT e.file_id, 'mine,view' || coalesce(',' || string_agg(k.event_type, ',' ORDER BY k.p), '') AS keywords FROM (SELECT DISTINCT file_id FROM ev) e LEFT JOIN k USING (file_id) GROUP BY e.file_id")
def note_keywords(spark, sf_dir):
    return counts.note_keywords(events_view(spark, sf_dir), ["mine", "view"]).select("file_id", F.array_join("keywords", ",").alias("keywords"))


@register(f"{DOC} SELECT CASE WHEN quality IS NULL THEN 'skipped' WHEN quality = 1 THEN 'analyzed' ELSE 'conflicted' END AS outcome, count(*) AS count FROM doc GROUP BY 1")
def run_summary(spark, sf_dir):
    q = F.col("analysis.fields")["quality"]
    rows = documents_view(spark, sf_dir).select(F.when(q.isNull(), "skipped").when(q == "1", "analyzed").otherwise("conflicted").alias("outcome"))
    return counts.run_summary(rows)


# --- orders and selections


@register(f"{EV} SELECT page_id, number AS nth FROM ev")
def placement_order(spark, sf_dir):
    return order.placement_order(events_archive(spark, sf_dir).placement).select("page_id", "nth")


@register(f"{EV} SELECT page_id, lag(page_id) OVER w AS prev_page, lead(page_id) OVER w AS next_page FROM ev WINDOW w AS (PARTITION BY file_id ORDER BY pos)")
def page_neighbors(spark, sf_dir):
    return order.page_neighbors(events_archive(spark, sf_dir).placement).select("page_id", "prev_page", "next_page")


@register("SELECT 'Pc' || conv_id || '_' || turn AS page_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS number FROM conversations WHERE turn <> 1")
def renumber(spark, sf_dir):
    place = conversations_archive(spark, sf_dir).placement
    return order.renumber(order.subtract(place, place.where("pos = 1"))).select("page_id", "number")


@register(f"{EV}, h AS (SELECT page_id, file_id AS holder, md <> '' AS has_md FROM ev UNION ALL SELECT page_id, 'A' || file_id, n % 2 = 0 FROM ev) SELECT page_id, holder FROM h QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY has_md DESC, holder) = 1")
def preferred_donor(spark, sf_dir):
    rows = events_view(spark, sf_dir, md=True)
    a = rows.select("page_id", F.col("file_id").alias("holder"), (F.col("md") != "").alias("has_md"))
    b = rows.select("page_id", F.concat(F.lit("A"), "file_id").alias("holder"), (F.substring("page_id", 16, 8).cast("long") % 2 == 0).alias("has_md"))
    return order.preferred_donor(a.unionAll(b)).select("page_id", "holder")


@register(f"{EV} SELECT page_id, row_number() OVER (PARTITION BY file_id, n % 7 ORDER BY pos) AS nth FROM ev")
def rect_ordinal(spark, sf_dir):
    rows = events_view(spark, sf_dir).select(F.col("page_id").alias("id"), F.col("file_id").alias("page_id"), F.lit("title").alias("kind"), F.col("titles")[0]["rect"].alias("rect"), "pos")
    return order.rect_ordinal(rows).select(F.col("id").alias("page_id"), "nth")


@register(f"{EV} SELECT page_id FROM ev WHERE starred AND n % 3 = 0")
def intersect(spark, sf_dir):
    rows = events_view(spark, sf_dir)
    return order.archive_order(order.intersect(rows.where(f.starred()), rows.where(F.size("page_tags") > 0))).select("page_id")


@register(f"{EV} SELECT page_id FROM ev WHERE starred AND n % 3 <> 0")
def subtract(spark, sf_dir):
    rows = events_view(spark, sf_dir)
    return order.archive_order(order.subtract(rows.where(f.starred()), rows.where(F.size("page_tags") > 0))).select("page_id")


@register(f"{EV} SELECT file_id, page_id, row_number() OVER (ORDER BY file_id, pos) AS rank FROM ev")
def archive_order(spark, sf_dir):
    return order.archive_rank(events_archive(spark, sf_dir).placement).select("file_id", "page_id", "rank")


@register(f"{EV} SELECT event_type AS value FROM ev GROUP BY 1")
def value_order(spark, sf_dir):
    return order.value_order(events_view(spark, sf_dir).select(F.col("keywords")[0]["text"].alias("value")).distinct())


# --- labels


@register(f"{EV} SELECT page_id, array_to_string(list_sort(list_distinct(list_append(page_tags, 'k1'))), ',') AS tags FROM ev WHERE n % 2 = 0 UNION ALL SELECT page_id, array_to_string(page_tags, ',') FROM ev WHERE n % 2 = 1")
def tag_pages(spark, sf_dir):
    pages = events_archive(spark, sf_dir).pages
    tagged, _ = labels.tag_pages(pages, pages.where(F.substring("page_id", 16, 8).cast("long") % 2 == 0).select("page_id"), "k1")
    return tagged.select("page_id", F.array_join("tags", ",").alias("tags"))


@register(f"{EV} SELECT page_id, array_to_string(list_filter(page_tags, lambda t: t <> 'vip'), ',') AS tags FROM ev")
def untag_pages(spark, sf_dir):
    pages = events_archive(spark, sf_dir).pages
    tagged, _ = labels.untag_pages(pages, pages.select("page_id"), "vip")
    return tagged.select("page_id", F.array_join("tags", ",").alias("tags"))


@register(f"{EV} SELECT DISTINCT file_id, CASE WHEN user_id % 5 = 0 THEN 'new,vip' ELSE 'new' END AS tags FROM ev")
def tag_notes(spark, sf_dir):
    notes = events_archive(spark, sf_dir).notes
    tagged, _ = labels.tag_notes(notes, notes.select("file_id"), "new")
    return tagged.select("file_id", F.array_join("tags", ",").alias("tags"))


@register(f"{EV} SELECT DISTINCT file_id, '' AS tags FROM ev")
def untag_notes(spark, sf_dir):
    notes = events_archive(spark, sf_dir).notes
    tagged, _ = labels.untag_notes(notes, notes.select("file_id"), "vip")
    return tagged.select("file_id", F.array_join("tags", ",").alias("tags"))


# --- sections


@register(f"{DOC} SELECT page_id, 0 AS sec_pos, 'body' AS id, 'Text ' || n AS label, md5(trim(md, chr(10))) AS text FROM doc UNION ALL SELECT page_id, 1, 'foot', '', md5('end ' || n) FROM doc")
def parse_regions(spark, sf_dir):
    return regions.parse_regions(sectioned_documents(spark, sf_dir)).select("page_id", "sec_pos", "id", "label", F.md5("text").alias("text"))


@register(f"{DOC} SELECT page_id, md5('<!-- region body (Text ' || n || ') -->' || chr(10) || CASE WHEN trim(md, chr(10)) = '' THEN '' ELSE trim(md, chr(10)) || chr(10) END || chr(10) || '<!-- region foot -->' || chr(10) || 'end ' || n || chr(10)) AS md FROM doc")
def assemble_regions(spark, sf_dir):
    return regions.assemble_regions(regions.parse_regions(sectioned_documents(spark, sf_dir))).select("page_id", F.md5("md").alias("md"))


@register(f"{EV} SELECT page_id, CASE WHEN md = '' THEN '' ELSE 'error ' || n END AS title FROM ev WHERE event_type = 'error'")
def declared_regions(spark, sf_dir):
    rows = view.declared_regions(events_view(spark, sf_dir, md=True, boxes=True)).where(f.templated())
    return rows.select("page_id", F.col("declared")[0]["text"].alias("title"))


@register(f"{EV} SELECT page_id, CASE WHEN md = '' THEN 'title,grade,note' ELSE 'title,grade,note,gone' END AS ids FROM ev WHERE event_type = 'error'")
def region_layout(spark, sf_dir):
    rows = events_view(spark, sf_dir, md=True, boxes=True).where(f.templated())
    return rows.select("page_id", F.array_join(F.transform(regions.region_layout(F.col("boxes"), F.col("md")), lambda s: s["id"]), ",").alias("ids"))


@register(f"{DOC} SELECT page_id, 0 AS sec_pos, 'body' AS id, CASE WHEN trim(md, chr(10)) = '' THEN 'unchanged' WHEN n % 2 = 0 THEN 'cleared' ELSE 'unchanged' END AS kind FROM doc UNION ALL SELECT page_id, 1, 'foot', CASE WHEN n % 2 = 0 THEN 'updated' ELSE 'unchanged' END FROM doc")
def region_changes(spark, sf_dir):
    before = sectioned_documents(spark, sf_dir)
    even = F.substring("page_id", 3, 20).cast("long") % 2 == 0
    after = F.when(even, F.lit("<!-- region body -->\n<!-- region foot -->\nother\n")).otherwise(F.col("md"))
    return regions.region_changes(before.select("file_id", "page_id", F.col("md").alias("before"), after.alias("after"))).select("page_id", "sec_pos", "id", "kind")


# --- listings


@register(f"{EV} SELECT DISTINCT file_id, 'user' || user_id AS name FROM ev")
def list_notes(spark, sf_dir):
    return export.list_notes(events_archive(spark, sf_dir).notes)


@register(f"{EV} SELECT page_id, 'user' || user_id AS note, 'p' || number AS page, CASE WHEN starred THEN '*' ELSE '' END AS star, coalesce(title, '') AS headings, '#' || event_type AS keywords, array_to_string(list_transform(tags, lambda t: '@' || t), ' ') AS tags FROM ef WHERE starred AND list_contains(tags, 'vip') AND ts::DATE BETWEEN DATE '2024-01-03' AND DATE '2024-01-20'")
def list_pages(spark, sf_dir):
    """Starred pages of a range of days that carry a tag, as a listing."""
    chosen = f.query_pages(events_view(spark, sf_dir), f.both(f.starred(), f.tag_is(f.exact("vip")), f.created_between(date(2024, 1, 3), date(2024, 1, 20))))
    return export.list_pages(chosen)


@register(f"{EV} SELECT file_id, 'user' || any_value(user_id) AS name, min_by(page_id, pos) AS first_page_id FROM ev GROUP BY file_id")
def gallery_notes(spark, sf_dir):
    return export.gallery_notes(events_view(spark, sf_dir))


@register(f"{EV} SELECT file_id, page_id, CASE WHEN event_type = 'error' THEN '' ELSE rtrim(md, chr(10)) END AS content, array_to_string(list_transform(tags, lambda t: '@' || t), ' ') AS tags, 'user' || user_id || ' · ' || number AS caption FROM ef")
def gallery_pages(spark, sf_dir):
    return export.gallery_pages(events_view(spark, sf_dir, md=True, boxes=True))


#: The text of each note, as exported.
RENDERED = f"""{EV}, x AS (SELECT ev.*, y.page_id AS target FROM ev LEFT JOIN ev y ON y.n = ev.n + 1),
p AS (SELECT *, coalesce(link_name, 'link' || n || '.note') AS raw FROM x),
q AS (SELECT *, '** Page ' || number || CASE WHEN title IS NOT NULL THEN ': ' || title ELSE '' END || chr(10) || ':PROPERTIES:' || chr(10) || ':PAGE_ID: ' || page_id || chr(10) || ':VECTOR: ' || file_id || '/' || page_id || '.svg' || chr(10) || CASE WHEN starred THEN ':STARRED: t' || chr(10) ELSE '' END || ':END:' || chr(10)
  || CASE WHEN event_type = 'error' OR md = '' THEN '' ELSE rtrim(md, chr(10)) || chr(10) END || '*** Links' || chr(10) || '- '
  || CASE WHEN link_kind = 'note' AND target IS NOT NULL THEN '[[note:' || target || '][' || replace(raw, '.note', '') || ']]' WHEN link_kind = 'web' THEN '[[https://example.org/' || n || '][' || raw || ']]' WHEN link_kind = 'file' THEN raw ELSE raw || ' (' || link_kind || ': )' END AS page FROM p),
k AS (SELECT file_id, event_type, min(pos) AS p FROM ev GROUP BY ALL), t AS (SELECT file_id, string_agg(event_type, ':' ORDER BY p) AS kw FROM k GROUP BY file_id)
SELECT q.file_id, '#+title: user' || any_value(user_id) || chr(10) || '#+filetags: :' || any_value(kw) || ':' || chr(10) || '* Pages' || chr(10) || string_agg(page, chr(10) ORDER BY pos) || chr(10) AS text FROM q JOIN t USING (file_id) GROUP BY q.file_id"""


@register(RENDERED)
def render_notes(spark, sf_dir):
    return export.render_notes(events_view(spark, sf_dir, md=True, boxes=True))
