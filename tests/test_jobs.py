import itertools
import os
from datetime import datetime
from functools import reduce

import pytest
from notes import archive, day, link, page, title
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.model import LINK, PARKED, TITLE, Archive, schema
from quillstack.operators import analysis, counts, reconcile, text, upgrade, view
from quillstack.sources import files
from quillstack.streaming import ingest

NOW = datetime(2026, 8, 1)


def now():
    return F.lit(NOW).cast("timestamp")


def by_page(df, *columns):
    return {r.page_id: tuple(r[c] for c in columns) for r in df.collect()}


def settled(spark, done):
    """A reconciled state as plain tables, as a store would give them."""
    plain = lambda df: spark.createDataFrame(df.collect(), df.schema)
    a = done.archive
    return reconcile.Reconciled(Archive(plain(a.notes), plain(a.placement), plain(a.pages), plain(a.md)), plain(done.parked), plain(done.report))


# --- reconcile


def test_region_carry(spark):
    a, b = (0, 0, 10, 10), (0, 20, 10, 10)
    old = archive(spark, {"F": ("f.note", (), ["P"])}, [page("F", "P", titles=[title(a, "Head")], links=[link(a, analysed="Go")])]).pages
    new = archive(spark, {"F": ("f.note", (), ["P"])}, [page("F", "P", titles=[title(a)], links=[link(b)])]).pages
    got = reconcile.carry_regions(new, old).first()
    assert got.titles[0].analysis.name == "Head" and got.links[0].analysis is None
    assert [(d.kind, d.rect.y) for d in reconcile.dropped_regions(new, old).first().dropped] == [("link", 0)]


def test_duplicate_rects(spark):
    old = archive(spark, {"F": ("f", (), ["P"])}, [page("F", "P", titles=[title(name="first"), title(name="second")])]).pages
    new = archive(spark, {"F": ("f", (), ["P"])}, [page("F", "P", titles=[title(), title(), title()])]).pages
    assert [t.analysis and t.analysis.name for t in reconcile.carry_regions(new, old).first().titles] == ["first", "second", None]
    unnamed = archive(spark, {"F": ("f", (), ["P"])}, [page("F", "P", titles=[title(), title(name="second")])]).pages
    assert [t.analysis and t.analysis.name for t in reconcile.carry_regions(new, unnamed).first().titles] == [None, "second", None]


def state(spark):
    return archive(
        spark,
        {"N10": ("a.note", ("n",), ["P71", "P72", "P73"])},
        [page("N10", "P71", modified=day(1), device=day(1), hash_="h"), page("N10", "P72", modified=day(1), device=day(1), hash_="h"), page("N10", "P73", tags=["later"], analysis=("print3", {}, []), modified=day(1), device=day(1), hash_="h")],
        [("N10", "P73", "text\n", "base\n")],
    )


def test_move(spark):
    incoming = archive(spark, {"N20": ("b.note", (), ["P73", "Pn"])}, [page("N20", "P73", hash_="h"), page("N20", "Pn", hash_="h")])
    done = settled(spark, reconcile.reconcile_pages(incoming, state(spark), None, now()))
    report = by_page(done.report.where("page_id IS NOT NULL"), "file_id", "is_new", "adopted", "adopted_from", "pruned")
    assert report == {"P73": ("N20", False, True, ["N10"], False), "Pn": ("N20", True, False, [], False)}
    assert [r.file_id for r in done.report.where("repaired").collect()] == ["N10"]
    moved = done.archive.pages.where("page_id = 'P73'").collect()
    assert [(m.file_id, m.tags, m.analysis.source_hash, m.device_modified_at) for m in moved] == [("N20", ["later"], "print3", NOW)]
    assert [tuple(r) for r in done.archive.md.select("file_id", "page_id", "md", "base").collect()] == [("N20", "P73", "text\n", "base\n")]
    assert by_page(done.archive.placement, "file_id", "number") == {"P71": ("N10", 1), "P72": ("N10", 2), "P73": ("N20", 1), "Pn": ("N20", 2)}
    assert done.parked.count() == 0
    assert counts.write_report(done.report).where("file_id = 'N20'").first().adopted == 1


def test_unchanged_and_stamps(spark):
    incoming = archive(spark, {"N10": ("a.note", (), ["P71", "P72", "P73"])}, [page("N10", "P71", hash_="h"), page("N10", "P72", starred=True, hash_="h2"), page("N10", "P73", hash_="h")])
    done = settled(spark, reconcile.reconcile_pages(incoming, state(spark), None, now()))
    assert by_page(done.report, "metadata_changed", "vector_changed") == {"P72": (True, True)}
    assert by_page(done.archive.pages, "modified_at", "device_modified_at") == {"P71": (day(1), day(1)), "P72": (NOW, NOW), "P73": (day(1), day(1))}
    assert done.archive.notes.first().tags == ["n"] and done.archive.md.count() == 1


def test_prune_and_park(spark):
    incoming = archive(spark, {"N10": ("a.note", (), ["P71"])}, [page("N10", "P71", hash_="h")])
    done = settled(spark, reconcile.reconcile_pages(incoming, state(spark), None, now()))
    assert by_page(done.report, "pruned", "parked") == {"P72": (True, False), "P73": (True, True)}
    assert [(r.page_id, r.md, r.base) for r in done.parked.collect()] == [("P73", "text\n", "base\n")]
    again = archive(spark, {"F_C": ("c.note", (), ["P73"])}, [page("F_C", "P73", hash_="h")])
    back = settled(spark, reconcile.reconcile_pages(again, done.archive, done.parked, now()))
    assert by_page(back.report, "adopted_from") == {"P73": (["orphans"],)}
    assert back.parked.count() == 0 and back.archive.md.first().file_id == "F_C"
    assert [r.page_id for r in reconcile.reclaim_parked(again, done.archive, done.parked).collect()] == ["P73"]


def test_own_copy_wins(spark):
    stored = archive(spark, {"N10": ("a.note", (), ["P71"]), "N20": ("b.note", (), ["P71"])}, [page("N10", "P71", tags=["own"], hash_="h"), page("N20", "P71", tags=["other"], hash_="h")], [("N20", "P71", "x\n", "")])
    incoming = archive(spark, {"N10": ("a.note", (), ["P71", "Pn"])}, [page("N10", "P71", hash_="h"), page("N10", "Pn", hash_="h")])
    assert [tuple(r) for r in reconcile.adopt_moved_pages(incoming, stored).collect()] == [("P71", "N10", None, ["N20"])]
    done = settled(spark, reconcile.reconcile_pages(incoming, stored, None, now()))
    assert [(r.file_id, r.tags) for r in done.archive.pages.where("page_id = 'P71'").collect()] == [("N10", ["own"])]
    full = archive(spark, {"N10": ("a.note", (), ["P71"])}, [page("N10", "P71", hash_="h")])
    assert reconcile.adopt_moved_pages(full, stored).count() == 0


def test_backgrounds_and_names(spark):
    svg = '<image xlink:href="data:image/png;base64,aW1n"/>'
    v = spark.createDataFrame([("F", "P", svg), ("F", "Q", svg), ("G", "R", svg), ("G", "S", "<svg/>")], "file_id string, page_id string, svg string")
    assert sorted(r.file_id for r in reconcile.dedupe_backgrounds(v).collect()) == ["F", "G"]
    pages = archive(spark, {"F": ("f", (), ["P"])}, [page("F", "P", titles=[title(name="a"), title(name="b")], links=[link(name="l")])]).pages
    edits = spark.createDataFrame([("P", "title", 1, "a"), ("P", "title", 2, "B"), ("P", "link", 1, "L")], "page_id string, kind string, idx int, name string")
    out, changes = reconcile.apply_name_edits(pages, edits)
    assert [(t.analysis.name, t.analysis.edited) for t in out.first().titles] == [("a", False), ("B", True)] and out.first().links[0].analysis.name == "L"
    assert {(r.kind, r.idx, r.was, r.now) for r in changes.collect()} == {("title", 2, "b", "B"), ("link", 1, "", "L")}


def snapshot(spark, seq, file_id, ids):
    names = schema(ingest.SNAPSHOT)
    rows = [(seq, file_id, "sig", "dev", f"{file_id}.note", [page(file_id, p, hash_="h")[1:] for p in ids])]
    return spark.createDataFrame(rows, names)


@pytest.mark.parametrize("flip", [False, True])
def test_arrival_order(spark, tmp_path, flip):
    stored = archive(spark, {"N30": ("a.note", (), ["P1", "P2", "P3"])}, [page("N30", "P1", hash_="h"), page("N30", "P2", hash_="h"), page("N30", "P3", tags=["keep"], analysis=("print3", {}, []), hash_="h")], [("N30", "P3", "text\n", "")])
    store = ingest.Store(spark, f"file://{tmp_path}/s")
    store.start(stored)
    order = [("N30", ["P1", "P2"]), ("N40", ["P3"])]
    for k, (f, ids) in enumerate(order[::-1] if flip else order):
        ingest.ingest_batch(store, snapshot(spark, k, f, ids), f"v{k + 1}", now())
    a, parked = store.read()
    assert [(r.file_id, r.tags, r.analysis.source_hash) for r in a.pages.where("page_id = 'P3'").collect()] == [("N40", ["keep"], "print3")]
    assert [(r.file_id, r.md) for r in a.md.collect()] == [("N40", "text\n")] and parked.count() == 0
    assert by_page(a.placement, "file_id", "number") == {"P1": ("N30", 1), "P2": ("N30", 2), "P3": ("N40", 1)}


def test_stream(spark, tmp_path):
    snapshot(spark, 1, "N30", ["P1", "P2"]).unionAll(snapshot(spark, 2, "N40", ["P3"])).unionAll(snapshot(spark, 3, "", ["P9"])).unionAll(snapshot(spark, 4, "N30", ["P2"])).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema(ingest.SNAPSHOT)).parquet(f"{tmp_path}/in")
    ingest.stream_ingest(stream, f"file://{tmp_path}/s", f"file://{tmp_path}/c").awaitTermination()
    store = ingest.Store(spark, f"file://{tmp_path}/s")
    assert by_page(store.read()[0].placement, "file_id") == {"P2": ("N30",), "P3": ("N40",)}
    assert [(r.seq, r.reason) for r in store.failed().collect()] == [(3, "a note without an id")]


def owners(store):
    a, _ = store.read()
    held = by_page(a.placement, "file_id", "pos")
    assert {p: (f,) for p, (f, _) in held.items()} == by_page(a.pages, "file_id")
    return held


DELIVERIES = [(1, "N1", ["Q1", "Q2", "Q3"]), (2, "N2", ["Q3", "Q4"]), (3, "N2", ["Q4"]), (4, "N1", ["Q2", "Q5"])]


@pytest.mark.parametrize("order", [(3, 2, 1, 0), (1, 3, 0, 2)])
def test_the_state_does_not_depend_on_the_order_of_arrival(spark, tmp_path, order):
    store = ingest.Store(spark, f"file://{tmp_path}/s")
    for k in order:
        ingest.ingest_batch(store, snapshot(spark, *DELIVERIES[k]), f"b{k}", now())
    assert owners(store) == {"Q2": ("N1", 0), "Q5": ("N1", 1), "Q4": ("N2", 0)}


def test_a_late_snapshot_changes_nothing(spark, tmp_path):
    store = ingest.Store(spark, f"file://{tmp_path}/s")
    ingest.ingest_batch(store, snapshot(spark, 2, "N1", ["Q1", "Q2", "Q3"]), "b1", now())
    ingest.ingest_batch(store, snapshot(spark, 1, "N1", ["Q1"]), "b2", now())
    assert set(owners(store)) == {"Q1", "Q2", "Q3"}


def test_a_batch_that_runs_again_and_a_commit_that_was_not_finished(spark, tmp_path):
    store = ingest.Store(spark, f"file://{tmp_path}/s")
    first = snapshot(spark, 1, "N1", ["Q1", "Q2"])
    assert ingest.ingest_batch(store, first, "b1", now()).count() == 2
    held, commits = owners(store), store.commits()
    assert ingest.ingest_batch(store, first, "b1", now()).count() == 2 and store.commits() == commits
    ingest.ingest_batch(store, snapshot(spark, 2, "N1", ["Q2"]), "b2", now())
    after = owners(store)
    os.remove(f"{tmp_path}/s/{store.commits()[-1]}/commit/_SUCCESS")  # as if the writer had stopped just before
    assert owners(store) == held
    ingest.ingest_batch(store, snapshot(spark, 2, "N1", ["Q2"]), "b2", now())
    assert owners(store) == after == {"Q2": ("N1", 0)}


def test_a_delivery_writes_its_own_buckets(spark, tmp_path):
    store = ingest.Store(spark, f"file://{tmp_path}/s")
    many = [snapshot(spark, 1, f"N{i}", [f"Q{i}"]) for i in range(40)]
    ingest.ingest_batch(store, reduce(DataFrame.unionAll, many), "b1", now())
    ingest.ingest_batch(store, snapshot(spark, 2, "N7", ["Q7", "Q99"]), "b2", now())
    assert len(os.listdir(f"{tmp_path}/s/{store.commits()[-1]}/pages")) < 8 and len(owners(store)) == 41


# --- text

MERGES = [
    ("intro\nline one\nline two\noutro\n", "intro\nline one, edited by hand\nline two\noutro\n", "intro\nline one\nline two\noutro, reanalyzed\n", "intro\nline one, edited by hand\nline two\noutro, reanalyzed\n"),
    ("line\n", "line edited\n", "line reanalyzed\n", None),
    ("", "written by hand\n", "transcribed by AI\n", None),
    ("a\n", "a\n", "b\n", "b\n"),
    ("a\n", "b\n", "a\n", "b\n"),
    ("a\n", "b\n", "b\n", "b\n"),
]


def test_merges(spark):
    df = spark.createDataFrame([(str(i), b, e, f) for i, (b, e, f, _) in enumerate(MERGES)], "page_id string, base string, edited string, fresh string")
    got = by_page(text.merge_texts(df), "merged", "conflicts")
    for i, (_, edited, fresh, want) in enumerate(MERGES):
        merged, conflicts = got[str(i)]
        assert conflicts == (want is None)
        if want is None:
            assert merged == f"<<<<<<< edited\n{edited}=======\n{fresh}>>>>>>> reanalyzed\n"
        else:
            assert merged == want


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_lines_are_longest():
    for a in itertools.product("xyz", repeat=4):
        for b in [tuple("xyzx"), tuple("zzy"), (), tuple("yxyxz")]:
            pairs = text.common_lines(list(a), list(b))
            assert len(pairs) == longest(a, b) and all(a[i] == b[j] for i, j in pairs)
            assert pairs == sorted(pairs) and all(p[1] < q[1] for p, q in itertools.pairwise(pairs))


def test_line_changes(spark):
    df = spark.createDataFrame([("P", "a\nb\nc\n", "a\nx\nc\nd\n"), ("Q", "s\n", "s\n"), ("R", None, "n\n")], "page_id string, was string, now string")
    assert by_page(text.line_stats(df), "added", "removed") == {"P": (2, 1), "Q": (0, 0), "R": (1, 0)}
    rows = [(r.page_id, r.op, r.line) for r in text.line_changes(df).orderBy("page_id", "seq").collect()]
    assert rows == [("P", "-", "b"), ("P", "+", "x"), ("P", "+", "d"), ("R", "+", "n")]


def test_of_equal_lines_in_a_row_the_first_are_those_that_changed(spark):
    assert text.common_lines(list("xxy"), list("txy")) == [(1, 1), (2, 2)] and text.common_lines(list("xy"), list("xxy")) == [(0, 1), (1, 2)]
    df = spark.createDataFrame([("P", "x\nx\ny\nadded by hand\n", "transcribed again\nx\ny\n"), ("Q", "\n\nx\n", "transcribed again\n\nx\n")], "page_id string, was string, now string")
    rows = [(r.page_id, r.seq, r.op, r.line) for r in text.line_changes(df).orderBy("page_id", "seq").collect()]
    assert rows == [("P", 0, "-", "x"), ("P", 1, "+", "transcribed again"), ("P", 2, "-", "added by hand"), ("Q", 0, "-", ""), ("Q", 1, "+", "transcribed again")]
    assert text.merge3("x\nx\n", "x\nx\nadded by hand\n", "transcribed again\nx\n") == ("transcribed again\nx\nadded by hand\n", False)


def test_text_edits(spark):
    md = spark.createDataFrame([("F", "P", "a\n", "a\n"), ("F", "Q", "mine\n", ""), ("F", "R", "r\n", "r\n")], "file_id string, page_id string, md string, base string")
    edits = spark.createDataFrame([("P", "b"), ("Q", "")], "page_id string, content string")
    out, report = text.apply_text_edits(md, edits)
    assert by_page(out, "md", "base") == {"P": ("b\n", "a\n"), "R": ("r\n", "r\n")}
    assert by_page(report, "kind") == {"P": ("updated",), "Q": ("cleared",)}


# --- analysis


def test_transcribe(spark):
    pages = spark.createDataFrame([("P", bytearray(b"1"), "old"), ("Q", bytearray(b"2"), None), ("R", bytearray(b"3"), None)], "page_id string, image binary, base string")

    def model(prompt, image):
        if bytes(image) == b"3":
            raise RuntimeError("down")
        return f" {prompt}|{bytes(image).decode()} "

    got = by_page(analysis.transcribe(pages, model, "read", "update", 2), "text", "error")
    assert got == {"P": ("update\n\nold|1", None), "Q": ("read|2", None), "R": (None, "down")}
    fields = analysis.derive_fields(spark.createDataFrame([("P", "t\n"), ("Q", " \n")], "page_id string, md string"), lambda p, t: f"{p} {t}", {"a": "A", "b": "B"})
    assert by_page(fields, "fields") == {"P": ({"a": "A t", "b": "B t"},), "Q": (None,)}


def test_boxes(spark):
    boxes = [("bg", 0, "x", "", (0, 0, 9, 9), True, ""), ("bg", 1, "y", "", (0, 0, 9, 9), True, ""), ("bg", 2, "z", "", (0, 0, 9, 9), False, "")]
    a = archive(spark, {"F": ("f", (), ["P", "Q", "R"])}, [page("F", "P", background="bg", analysis=("s", {}, [("x", "1"), ("y", "2")])), page("F", "Q", analysis=("s", {}, [])), page("F", "R", titles=[title(name="t", edited=True), title()])], [], boxes)
    v = view.page_view(a.notes, a.placement, a.pages, None, a.boxes)
    prints = spark.createDataFrame([("P", "s"), ("Q", "s"), ("R", "s")], "page_id string, source_hash string")
    same = spark.createDataFrame([("P", "x", "1", True), ("P", "y", "2", True)], "page_id string, box_id string, fingerprint string, has_ink boolean")
    moved = spark.createDataFrame([("P", "x", "1", True), ("P", "y", "9", False)], "page_id string, box_id string, fingerprint string, has_ink boolean")
    assert by_page(analysis.pages_to_analyze(v, prints, same), "reason") == {"R": ("never",)}
    assert by_page(analysis.pages_to_analyze(v, prints, moved), "reason") == {"R": ("never",), "P": ("boxes",)}
    assert len(by_page(analysis.pages_to_analyze(v, prints, same, force=True), "reason")) == 3
    states = analysis.box_states(v, moved)
    assert {(r.box_id, r.state) for r in states.collect()} == {("x", "skipped"), ("y", "blank")}
    forced = analysis.box_states(v, same, force=True)
    assert {r.state for r in forced.collect()} == {"transcribe"}
    calls = analysis.analysis_calls(v, spark.createDataFrame([("Q",)], "page_id string"), forced, 2)
    assert by_page(calls, "content", "calls") == {"P": (2, 2), "Q": (0, 2), "R": (1, 4)}


# --- upgrades


def test_upgrade(spark):
    links = [link(kind=None, page_id="P1", file_id="F1"), link(kind=None, page_id="none", file_id="")]
    pages = archive(spark, {"F": ("f", (), [])}, [page("F", "P20260415093000AB", links=links, version=1), page("F", "Pnodate", links=links, version=5)]).pages
    got = by_page(upgrade.upgrade_docs(pages, "page"), "schema_version", "links", "modified_at")
    version, new, stamp = got["P20260415093000AB"]
    assert version == 6 and [(x.kind, x.target_page_id, x.target_file_id) for x in new] == [("note", "P1", "F1"), ("unknown", None, None)] and stamp == datetime(2026, 4, 15, 9, 30)
    assert got["Pnodate"][1][1].target_page_id == "none" and got["Pnodate"][2] is None
    docs = spark.createDataFrame([("a", '{"schema_version": 6}'), ("b", "{}"), ("c", '{"schema_version": 9}'), ("d", '{"schema_version": "6"}'), ("e", "{bad"), ("f", '{"schema_version": 1.5}')], "path string, value string")
    assert {r.path: r.outcome for r in upgrade.upgrade_outcomes(docs).collect()} == {"a": "current", "b": "migrated", "c": "failed", "d": "failed", "e": "failed", "f": "failed"}


# --- files


def test_files(spark, tmp_path):
    root = tmp_path / "a"
    (root / "F1").mkdir(parents=True)
    (root / "empty").mkdir()
    (root / "F1" / "note.json").write_text('{\n "schema_version": 6, "file_id": "F1", "signature": "s", "device": "d", "source": "x.note",\n "pages": [{"id": "P2", "number": 1}, {"id": "P1", "number": 2}]}')
    (root / "F1" / "P1.json").write_text('{"schema_version": 6, "page_id": "P1", "starred": true, "titles": [{"rect": {"x": 1, "y": 2, "w": 3, "h": 4}, "level": 1}], "keywords": [{"text": "k"}], "links": [], "modified_at": "2026-07-01T10:00:00Z"}')
    (root / "F1" / "P2.json").write_text('{"schema_version": 5, "page_id": "P2", "titles": [], "keywords": [], "links": []}')
    (root / "F1" / "P1.md").write_text("text\nmore\n")
    (root / "F1" / "P1.svg").write_text("<svg/>")
    notes, placement = files.read_notes(spark, str(root))
    assert [(r.file_id, r.tags) for r in notes.collect()] == [("F1", [])] and by_page(placement, "pos") == {"P2": (0,), "P1": (1,)}
    pages = files.read_pages(spark, str(root))
    assert by_page(pages, "file_id", "starred", "schema_version") == {"P1": ("F1", True, 6), "P2": ("F1", False, 5)}
    md = files.read_transcriptions(spark, str(root))
    assert [tuple(r) for r in md.collect()] == [("F1", "P1", "text\nmore\n")] and files.read_vectors(spark, str(root)).first().svg == "<svg/>"
    sound, refused = files.schema_gate(pages, strict=False)
    assert (sound.count(), refused.count()) == (1, 1)
    with pytest.raises(Exception, match="page P2 has schema version 5"):
        files.schema_gate(pages, kind="page").collect()
    v = view.page_view(notes, placement, pages, md)
    assert by_page(v, "md") == {"P1": ("text\nmore\n",), "P2": ("",)}
    files.write_views(v, f"{tmp_path}/views")
    files.write_export(v, f"{tmp_path}/export")
    assert spark.read.json(f"{tmp_path}/views").count() == 1 and spark.read.text(f"{tmp_path}/export", wholetext=True).first().value.startswith("#+title: x\n")


def test_templates(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"img")
    ddl = "image string, box_pos int, box_id string, label string, rect struct<x:int,y:int,w:int,h:int>, analyze boolean, prompt string"
    box = lambda id_, rect: (f"{tmp_path}/a.png", 0, id_, "", rect, True, "")
    import hashlib

    assert files.read_templates(spark, spark.createDataFrame([box("x", (0, 0, 9, 9))], ddl)).first().background_hash == hashlib.sha256(b"img").hexdigest()
    for bad in ([box("", (0, 0, 9, 9))], [box("x", (0, 0, 0, 9))], [box("x", (1919, 0, 9, 9))], [box("x", (0, 0, 9, 9)), box("x", (0, 9, 9, 9))]):
        with pytest.raises(ValueError):
            files.read_templates(spark, spark.createDataFrame(bad, ddl))


def test_write_changed(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v string")
    path = f"{tmp_path}/t"
    change = files.write_changed(rows(("a", "1"), ("b", "3"), ("d", "4")), rows(("a", "1"), ("b", "2"), ("c", "3")), path, ["k"])
    assert {(r.k, r.change) for r in change.collect()} == {("b", "updated"), ("c", "removed"), ("d", "added")}
    assert {r.k for r in spark.read.parquet(f"{path}/*/rows").collect()} == {"b", "d"}
    files.write_changed(rows(("a", "1")), rows(("a", "1")), f"{tmp_path}/none", ["k"])
    assert not (tmp_path / "none").exists()


def test_types():
    assert TITLE and LINK and schema(PARKED).fieldNames()[-2:] == ["md", "base"]
