import pytest
from notes import archive, day, filters_archive, link, page, title
from pyspark.sql import functions as F

from quillstack.functions import filters as f
from quillstack.operators import counts, export, labels, order, regions, view

RECT = (0, 0, 10, 10)


def seen(a, boxes=False):
    return view.page_view(a.notes, a.placement, a.pages, a.md, a.boxes if boxes else None)


def ids(df, condition):
    return [r.page_id for r in f.query_pages(df, condition).collect()]


def test_filters(spark):
    v = seen(filters_archive(spark)).cache()
    kw = lambda s: f.keyword_is(f.substring(s))
    assert ids(v, f.all_pages()) == ["P71", "P72", "P73", "P74"]
    assert ids(v, f.starred()) == ["P71", "P73"]
    assert ids(v, kw("foo")) == ids(v, kw("FOO")) == ["P71", "P72"]
    assert ids(v, f.keyword_is(f.exact("foo"))) == ["P71"]
    assert ids(v, f.keyword_is(f.exact("FOO"))) == []
    assert ids(v, f.negate(f.either(f.starred(), kw("foo")))) == ["P74"]
    assert ids(v, f.either(f.both(kw("foo"), f.starred()), f.note_is(f.exact("N20")))) == ["P71", "P73", "P74"]
    assert ids(v, f.both()) == ["P71", "P72", "P73", "P74"] and ids(v, f.either()) == []
    assert ids(v, f.content_is(f.exact("grocery list"))) == []
    assert ids(v, f.content_is(f.regexp("list$"))) == []
    assert ids(v, f.content_is(f.regexp("(?m)list$"))) == ["P73"]
    assert ids(v, f.content_is(f.exact(""))) == ["P72", "P74"]
    assert ids(v, f.templated()) == []
    with pytest.raises(ValueError):
        f.regexp("a(?=b)")


def test_id_sets(spark):
    v = seen(filters_archive(spark))
    some = spark.createDataFrame([("P71",), ("P73",), ("P74",), ("P71",)], "page_id string")
    assert ids(f.mark_ids(v, some, "set"), f.ids_in("set") & f.starred()) == ["P71", "P73"]
    assert ids(f.mark_ids(v, some.limit(0), "set"), f.ids_in("set")) == []
    assert [r.page_id for r in order.archive_order(order.intersect(v, some)).collect()] == ["P71", "P73", "P74"]
    assert [r.page_id for r in order.subtract(v, some).collect()] == ["P72"]


def test_inherited_tags(spark):
    v = seen(filters_archive(spark, note_tags=["shared"], pa_tags=["important", "todo"], pb_tags=["todo"]))
    assert ids(v, f.tag_is(f.exact("shared"))) == ["P73", "P74"]
    assert {(r.value, r["count"]) for r in counts.tag_counts(v).collect()} == {("important", 1), ("shared", 2), ("todo", 2)}


def test_days(spark):
    pages = ["P20260701090000AB", "P20260715120000CD", "P20260722080000EF", "Pnodate"]
    a = archive(spark, {"F": ("f.note", (), pages)}, [page("F", p, modified=day(10 + i), device=day(10)) for i, p in enumerate(pages)])
    v = seen(a)
    d = lambda n: day(n).date()
    assert ids(v, f.created_between(d(15), d(15))) == [pages[1]]
    assert ids(v, f.created_between(None, d(15))) == pages[:2]
    assert ids(v, f.created_between(d(15), None)) == pages[1:3]
    assert ids(v, f.created_between(d(20), d(10))) == []
    assert ids(v, f.negate(f.created_between(None, None))) == ["Pnodate"]
    assert ids(v, f.modified_between(d(13), None)) == ["Pnodate"] and len(ids(v, f.device_modified_between(d(10), d(10)))) == 4


BOXES = [("bg", 0, "title", "Title", (0, 0, 9, 9), True, ""), ("bg", 1, "grade", "", (0, 9, 9, 9), True, "")]
MD = "junk\n<!-- region title (Title) -->\n\ninvoice\n\n<!-- region gone -->\nold\n"


def templated(spark, md=MD):
    return archive(spark, {"F": ("f.note", (), ["P75", "P76", "P77"])}, [page("F", "P75", background="bg"), page("F", "P76", background="xx"), page("F", "P77")], [("F", p, md, "") for p in ("P75", "P76", "P77")], BOXES)


def test_regions(spark):
    v = view.declared_regions(seen(templated(spark), boxes=True)).cache()
    assert ids(v, f.region_is("title", f.substring("invoice"))) == ["P75"]
    assert ids(v, f.region_is("grade", f.exact(""))) == ["P75"]
    assert ids(v, f.region_is("gone", f.exact("old"))) == [] and ids(v, f.region_is(None, f.exact("old"))) == []
    assert ids(v, f.templated()) == ["P75"]
    rows = view.region_view(v).orderBy("box_pos").collect()
    assert [(r.id, r.text) for r in rows] == [("title", "invoice"), ("grade", "")]
    layout = v.where(f.templated()).select(regions.region_layout(F.col("boxes"), F.col("md"))).first()[0]
    assert [s["id"] for s in layout] == ["title", "grade", "gone"]


def test_repeated_section_ids(spark):
    twice = "<!-- region title -->\nfirst\n<!-- region title -->\nlast\n"
    v = view.declared_regions(seen(templated(spark, twice), boxes=True))
    assert ids(v, f.region_is("title", f.exact("last"))) == ["P75"] and ids(v, f.region_is("title", f.exact("first"))) == []
    assert [r.text for r in view.region_view(v).orderBy("box_pos").collect()] == ["first", ""]


def test_sections_round_trip(spark):
    df = spark.createDataFrame([("F", "P", MD), ("F", "Q", ""), ("F", "R", None)], "file_id string, page_id string, md string")
    rows = regions.parse_regions(df).orderBy("sec_pos").collect()
    assert [(r.id, r.label, r.text) for r in rows] == [("title", "Title", "invoice"), ("gone", "", "old")]
    assert [r.md for r in regions.assemble_regions(regions.parse_regions(df)).collect()] == ["<!-- region title (Title) -->\ninvoice\n\n<!-- region gone -->\nold\n"]
    changes = regions.region_changes(df.where("page_id = 'P'").select("file_id", "page_id", F.col("md").alias("before"), F.lit("<!-- region title -->\npaid\n").alias("after")))
    assert {(r.id, r.kind) for r in changes.collect()} == {("title", "updated"), ("gone", "cleared")}


def test_counts(spark):
    a = archive(spark, {"F": ("f.note", (), ["P71", "P72"])}, [page("F", "P71", keywords=["later", "later", "home"]), page("F", "P72", keywords=["later"])])
    assert [(r.value, r["count"]) for r in counts.keyword_counts(seen(a)).collect()] == [("home", 1), ("later", 2)]
    assert counts.note_keywords(seen(a), ["mine", "home"]).first().keywords == ["mine", "home", "later"]
    twice = a.placement.unionByName(a.placement.where("page_id = 'P72'").withColumn("file_id", F.lit("E")))
    assert [(r.page_id, r.owners) for r in counts.duplicate_pages(twice).collect()] == [("P72", ["E", "F"])]


def test_assembly(spark):
    links = [link(page_id="P72", file_id="F", name="b.note"), link(page_id="Px", file_id="G"), link(kind="web", target="https://e.org"), link(kind="file", target="/x"), link(page_id="Pgone", file_id="F")]
    a = archive(spark, {"F": ("f.note", ("n",), ["P71", "P72"]), "E": ("", (), ["Pe"])}, [page("F", "P71", titles=[title(name="T")], keywords=["foo"], links=links), page("F", "P72"), page("E", "Pe")], [("F", "P71", "text\n", "")])
    v = view.page_view(a.notes, a.placement, a.pages, a.md)
    asked = spark.createDataFrame([("P72",), ("P71",), ("P72",)], "page_id string")
    notes = view.retrieve(v, asked).collect()
    assert [n.file_id for n in notes] == ["F"] and [p.page_id for p in notes[0].pages] == ["P71", "P72"]
    assert notes[0].pages[0].analysis.content == "text" and notes[0].pages[1].analysis is None
    assert [x.internal for x in notes[0].pages[0].links] == [True, False, False, False, True]
    with pytest.raises(ValueError, match="Pq, Pz"):
        view.retrieve(v, spark.createDataFrame([("Pz",), ("Pq",), ("P71",)], "page_id string"))
    hrefs = [(r.href, r.external) for r in view.resolve_links(v).orderBy("link_pos").collect()]
    assert hrefs == [("P72.svg", False), ("../G/Px.svg", False), ("https://e.org", True), (None, False), (None, False)]
    owner = {r.page_id: (r.file_id, r.owners) for r in view.find_owner(a.placement.unionByName(a.placement.where("page_id = 'P72'").withColumn("file_id", F.lit("E"))), spark.createDataFrame([("P71",), ("P72",), ("Pz",)], "page_id string")).collect()}
    assert owner == {"P71": ("F", 1), "P72": (None, 2), "Pz": (None, 0)}


def test_listings(spark):
    a = archive(spark, {"F": ("f.note", ("n",), ["P71", "P72"])}, [page("F", "P71", True, tags=["t"], titles=[title(name="One"), title(), title(name="Two")], keywords=["k"], links=[link(page_id="P72", file_id="F", name="b.note")]), page("F", "P72")], [("F", "P71", "* H\nx\n", "")])
    v = seen(a).cache()
    assert tuple(export.list_pages(v).where("page_id = 'P71'").first()) == ("P71", "f", "p1", "*", "One / Two", "#k", "@n @t")
    assert [tuple(r) for r in export.gallery_notes(v).collect()] == [("F", "f", "P71")]
    assert export.gallery_pages(v).where("page_id = 'P71'").first().caption == "f · 1"
    text = export.render_notes(v).first().text
    assert text.startswith("#+title: f\n#+filetags: :k:\n* Pages\n** Page 1: One / Two\n") and "\n*** H\nx\n" in text and "- [[note:P72][b]]" in text


def test_labels(spark):
    a = filters_archive(spark, pa_tags=["x"])
    some = spark.createDataFrame([("P71",), ("P72",)], "page_id string")
    tagged, n = labels.tag_pages(a.pages, some, "x")
    assert n == 1 and {r.page_id: r.tags for r in tagged.collect()} == {"P71": ["x"], "P72": ["x"], "P73": [], "P74": []}
    assert labels.untag_pages(a.pages, some, "x")[1] == 1
    with pytest.raises(ValueError, match="Pzz"):
        labels.tag_pages(a.pages, spark.createDataFrame([("Pzz",)], "page_id string"), "x")
    notes, n = labels.tag_notes(a.notes, spark.createDataFrame([("N10",)], "file_id string"), "n")
    assert n == 1 and labels.untag_notes(notes, spark.createDataFrame([("N10",)], "file_id string"), "n")[1] == 1


def test_windows(spark):
    place = filters_archive(spark).placement
    got = {r.page_id: (r.prev_page, r.next_page) for r in order.page_neighbors(place).collect()}
    assert got == {"P71": (None, "P72"), "P72": ("P71", None), "P73": (None, "P74"), "P74": ("P73", None)}
    assert [(r.page_id, r.number) for r in order.renumber(place.where("page_id <> 'P71'")).orderBy("page_id").collect()] == [("P72", 1), ("P73", 1), ("P74", 2)]
    held = spark.createDataFrame([("P", "a", False), ("P", "b", True), ("Q", "b", False), ("Q", "a", False)], "page_id string, holder string, has_md boolean")
    assert {r.page_id: r.holder for r in order.preferred_donor(held).collect()} == {"P": "b", "Q": "a"}
