"""What holds where a note, a store or a text is large: small parameters stand for large data."""

import itertools
import os
import random
import re
import time

import pytest
from notes import archive, page
from pyspark.sql import functions as F

from quillstack.model import PAGES, PLACEMENT, TRANSCRIPTIONS, Archive, schema
from quillstack.operators import analysis, export, order, text, upgrade, view
from quillstack.sources import files
from quillstack.streaming import ingest

# --- numbers by ranges


def hot_placement(spark, n=6000):
    """A third of all rows in one note, places out of order and with gaps."""
    id_ = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("N"), (F.col("id") % 40).cast("string")))
    return spark.range(n).select(id_.alias("file_id"), (F.col("id") * 7919 % 100_003).cast("int").alias("pos"), F.concat(F.lit("P"), F.col("id").cast("string")).alias("page_id"), F.lit(0).alias("number"))


def test_numbers_by_ranges_equal_those_of_a_window(spark):
    rows = hot_placement(spark)
    want = {r.page_id: r.nth for r in order.numbered(rows).collect()}
    assert {r.page_id: r.nth for r in order.numbered(rows, large=500).collect()} == want
    ranked = order.running(rows, ["file_id", "pos"], ranges=16)
    plain = sorted(rows.collect(), key=lambda r: (r.file_id, r.pos))
    assert {r.page_id: r.before for r in ranked.collect()} == {r.page_id: i for i, r in enumerate(plain)}
    assert [r.page_id for r in order.archive_rank(rows).orderBy("rank").collect()] == [r.page_id for r in plain]
    sums = order.running(rows, ["file_id", "pos"], ["file_id"], F.col("pos"), ranges=9).where("page_id = 'P3'").first()
    assert sums.before == sum(r.pos for r in plain if r.file_id == "hot" and r.pos < 3 * 7919)


def test_neighbours_by_number_equal_those_of_a_window(spark):
    rows = hot_placement(spark, 900)
    told = lambda df: {r.page_id: (r.prev_page, r.next_page) for r in df.collect()}
    assert told(order.page_neighbors(rows, large=100)) == told(order.page_neighbors(rows))


def test_a_large_note_is_dealt_to_many_ranges(spark):
    dealt = hot_placement(spark).repartitionByRange(16, "file_id", "pos").groupBy(F.spark_partition_id()).count().collect()
    sizes = sorted(r["count"] for r in dealt)
    assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[8]
    assert order.numbered(spark.createDataFrame([], schema(PLACEMENT)), 0).count() == 0


# --- chunks and bundles


def large_view(spark, n=90):
    """Three notes, one of a third of all pages and more, with keywords that come again."""
    rows = [(("A", "B", "A", "C")[i % 4], f"P{i:03d}", f"text {i} é\n\n## head\n" * (i % 5), i) for i in range(n)]
    notes = {f: (f"{f}.note", (), [p for g, p, _, _ in rows if g == f]) for f in "ABC"}
    a = archive(spark, notes, [page(f, p, keywords=[f"k{i % 7}", "all"]) for f, p, _, i in rows], [(f, p, t, "") for f, p, t, _ in rows])
    return view.page_view(a.notes, a.placement, a.pages, a.md)


def test_chunks_follow_each_other_as_the_whole_note(spark):
    v = large_view(spark)
    whole = {r.file_id: [p.page_id for p in r.pages] for r in view.nest_notes(v).collect()}
    chunks = view.nest_chunks(v, 7).orderBy("file_id", "chunk").collect()
    assert max(len(r.pages) for r in chunks) == 7 and {f: [p.page_id for r in chunks if r.file_id == f for p in r.pages] for f in whole} == whole
    texts = {r.file_id: r.text for r in export.render_notes(v).collect()}
    parts = export.render_chunks(v, 7).orderBy("file_id", "chunk").collect()
    assert {f: "".join(r.text for r in parts if r.file_id == f) for f in texts} == texts


def test_bundles_hold_the_texts_byte_by_byte(spark, tmp_path):
    v = large_view(spark)
    texts = {r.file_id: r.text for r in export.render_notes(v).collect()}
    files.write_export(v, f"{tmp_path}/folders")
    files.write_bundles(export.render_chunks(v, 4), f"{tmp_path}/bundles", 1500)
    found = [f"{d}/{n}" for d, _, names in os.walk(tmp_path / "bundles" / "bundles") for n in names if n.startswith("part-")]
    assert 3 < len(found) < 30 and sum(map(os.path.getsize, found)) == sum(len(t.encode()) for t in texts.values())
    back = files.read_bundles(spark, f"{tmp_path}/bundles").orderBy("file_id", "part").collect()
    assert {f: "".join(r.text for r in back if r.file_id == f) for f in texts} == texts
    some = files.read_bundles(spark, f"{tmp_path}/bundles", spark.createDataFrame([("B",)], "file_id string"))
    assert "".join(r.text for r in some.orderBy("part").collect()) == texts["B"]


# --- the change log


def test_the_change_log_is_read_back_at_every_version(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v string, w int")
    state = lambda v=None: sorted(map(tuple, files.read_changed(spark, path, ["k"], v).collect()), key=str)
    path, versions = f"{tmp_path}/log", [[("a", "1", 1), ("b", None, 2)], [("a", "2", 1), ("c", "3", None)], [("b", "4", 2)], []]
    before = rows(("z", "0", 0))
    for k, v in enumerate(versions):
        files.write_changed(rows(*v), before, path, ["k"])
        before = files.read_changed(spark, path, ["k"])
        assert state() == sorted(v, key=str)
        if k == 1:
            files.compact_changed(spark, path, ["k"])
    assert [state(k) for k in range(1, 5)] == [sorted(v, key=str) for v in versions] and state(0) == [("z", "0", 0)]
    before.sparkSession.createDataFrame([(9,)], "k int").write.parquet(f"{path}/version=000000000009/rows")  # a writer that stopped half-way
    assert state() == []
    files.expire_changed(spark, path)
    assert state() == [] and sorted(n for n in os.listdir(path) if n < "version=000000000009") == ["base=000000000002", "version=000000000003", "version=000000000004"]
    with pytest.raises(ValueError):
        files.read_changed(spark, f"{tmp_path}/none", ["k"])


# --- answers


def test_requests_are_asked_once_and_never_again(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def model(prompt, image):
        with open(f"{calls}/{random.random()}", "w") as f:
            f.write(prompt)
        if image == b"bad":
            raise RuntimeError("no answer")
        return f" {prompt}:{image.decode()} "

    pages = spark.createDataFrame([("P1", "x", None), ("P2", "x", ""), ("P3", "bad", None), ("P4", "x", "was"), ("P5", None, None)], "page_id string, image string, base string")
    answers = analysis.Answers(spark, f"file://{tmp_path}/answers", "m")
    for made in (4, 1):  # of the second run only the failure
        told = {r.page_id: (r.text, r.error) for r in analysis.transcribe(pages.where("page_id <> 'P5'").unionByName(pages.where("page_id = 'P5'").withColumn("image", F.lit(""))), model, "read", "again", answers=answers).collect()}
        assert told == {"P1": ("read:x", None), "P2": ("read:x", None), "P3": (None, "no answer"), "P4": ("again\n\nwas:x", None), "P5": ("read:", None)}
        assert len(os.listdir(calls)) == made
        for f in os.listdir(calls):
            os.remove(calls / f)
    other = analysis.Answers(spark, f"file://{tmp_path}/answers", "other model")
    analysis.transcribe(pages.limit(1), model, "read", "again", answers=other)
    assert len(os.listdir(calls)) == 1


def test_a_failed_field_leaves_the_others(spark):
    def model(prompt, md):
        if prompt == "length" and "bad" in md:
            raise RuntimeError("no length")
        return f"{prompt} {len(md)}"

    md = spark.createDataFrame([("P", "good"), ("Q", "bad"), ("R", " \n"), ("S", None)], "page_id string, md string")
    told = {r.page_id: (r.fields, r.errors) for r in analysis.derive_fields(md, model, {"n": "length", "m": "size"}).collect()}
    assert told == {"P": ({"n": "length 4", "m": "size 4"}, {}), "Q": ({"m": "size 3"}, {"n": "no length"}), "R": (None, None), "S": (None, None)}


# --- versions of documents


def test_only_a_document_s_own_version_counts(spark):
    cases = {
        '{"schema_version": 6, "x": {"schema_version": "6"}}': "current", '{"x": {"schema_version": 9}}': "migrated", '{"schema_version": "6"}': "failed", '{"schema_version": null}': "failed", '{"schema_version": 1.5}': "failed",
        '{"x": "\\"schema_version\\": true", "schema_version": 3}': "migrated", '{"schema_version": [6]}': "failed", "[6]": "failed", "{": "failed", '{"schema_version": 99}': "failed",
    }
    df = spark.createDataFrame(list(cases.items()), "value string, want string")
    assert [(r.value, r.outcome) for r in upgrade.upgrade_outcomes(df).collect() if r.outcome != r.want] == []


# --- line differences


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("table_too", [False, True])
def test_differences_are_longest_by_either_search(monkeypatch, table_too):
    if table_too:
        monkeypatch.setattr(text, "_middle", lambda a, b: None)
    rng = random.Random(1)
    for _ in range(700):
        a, b = ([rng.choice("abcd"[: rng.randrange(1, 5)]) for _ in range(rng.randrange(16))] for _ in range(2))
        pairs = text.common_lines(a, b)
        assert len(pairs) == longest(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))


def test_few_edits_in_many_lines_take_little_time():
    rng = random.Random(2)
    a = [f"line {rng.randrange(50_000)}" for _ in range(100_000)]
    b = list(a)
    for k in range(10):
        b[rng.randrange(len(b))] = f"line {k}"
    began = time.process_time()
    assert len(text.common_lines(a, b)) >= 99_990 and time.process_time() - began < 5
    a, b = ([str(rng.randrange(300)) for _ in range(3000)] for _ in range(2))  # unlike texts
    began = time.process_time()
    assert len(text.common_lines(a, b)) > 100 and time.process_time() - began < 10


# --- the store


def many_notes(spark, n):
    """An archive of n notes of two pages each, texts of uneven size."""
    ids = spark.range(n).select(F.concat(F.lit("N"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("file_id"), "id")
    notes = ids.selectExpr("file_id", "'sig' AS signature", "'dev' AS device", "concat(file_id, '.note') AS source", "CAST(array() AS ARRAY<STRING>) AS tags", "6 AS schema_version")
    placement = ids.select("file_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("pos")).selectExpr("file_id", "pos", "concat('P', file_id, '_', pos) AS page_id", "pos + 1 AS number")
    bare = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema(PAGES).fields if f.name not in ("file_id", "page_id", "titles", "links", "tags")]
    empty = [F.array().cast(schema(PAGES)[c].dataType).alias(c) for c in ("titles", "links", "tags")]
    pages = placement.select("file_id", "page_id", *bare, *empty).select([f.name for f in schema(PAGES).fields])
    md = placement.select("file_id", "page_id", F.array_join(F.transform(F.sequence(F.lit(0), (F.crc32("page_id") % 40 + 10).cast("int")), lambda i: F.sha2(F.concat("page_id", i.cast("string")), 256)), "\n").alias("md"), F.lit("").alias("base")).select([f.name for f in schema(TRANSCRIPTIONS).fields])
    return Archive(notes, placement, pages, md)


def snapshot(spark, seq, file_id, ids):
    return spark.createDataFrame([(seq, file_id, "sig", "dev", f"{file_id}.note", [page(file_id, p, hash_="h")[1:] for p in ids])], schema(ingest.SNAPSHOT))


def held(store):
    a, _ = store.read()
    return sorted(map(tuple, a.placement.collect()))


def test_buckets_split_by_size_and_old_commits_expire(spark, tmp_path):
    store = ingest.Store(spark, f"file://{tmp_path}/s", limit=60_000, kept=2)
    a = many_notes(spark, 150)
    store.start(a)
    want = sorted(map(tuple, a.placement.collect()))
    assert held(store) == want
    directory = store._directory().collect()
    for family in ("note", "page"):
        of = [r for r in directory if r.family == family]
        assert sum(2.0**-r.depth for r in of) == 1 and len({(r.depth, r.bits) for r in of}) == len(of)
        assert max(r.bytes for r in of) <= 60_000
    buckets = store.buckets("note")
    assert len(buckets) > 12
    whole = sum(r.bytes for r in directory)
    for k in range(4):  # the same note grows, so that its bucket splits again
        ids = ["PN000007_0", *(f"Q{k}_{i}" for i in range(8))]
        ingest.ingest_batch(store, snapshot(spark, k, "N000007", ids), f"b{k}", F.lit(None).cast("timestamp"))
        written = [r for r in store._directory().collect() if r.folder == store.commits()[-1]]
        assert sum(r.bytes for r in written if r.family == "note") < whole / 4
        assert store.commits() == [c for c in sorted(os.listdir(f"{tmp_path}/s")) if c in store.commits()] and len(store.commits()) == 2
    rows = [r for r in want if r[0] != "N000007"] + [("N000007", i, p, i + 1) for i, p in enumerate(ids)]
    assert held(store) == sorted(rows)
    assert len([n for n in os.listdir(f"{tmp_path}/s") if n != "_heads"]) <= 4  # the first commit's rows, and those of the commits that stay
    on_disk = {f"{d.removeprefix(f'{tmp_path}/s/')}" for d, names, _ in os.walk(f"{tmp_path}/s") if "_bucket=" in d}
    assert on_disk == {f"{r.folder}/{r.table}/_bucket={r.bucket}" for r in store._parts(store.commits()).collect()}
    (tmp_path / "s" / "000000000099-lost" / "pages").mkdir(parents=True)
    assert store.vacuum() == ["000000000099-lost"] and held(store) == sorted(rows)


def test_batches_of_a_stream_are_known_by_their_last_number(spark, tmp_path):
    store = ingest.Store(spark, f"file://{tmp_path}/s", kept=2)
    now = F.lit(None).cast("timestamp")
    for k in range(3):
        ingest.ingest_batch(store, snapshot(spark, k, "N1", [f"P{k}"]), "stream", now, k)
    assert [store.commit_of("stream", k) is not None for k in range(4)] == [True, True, True, False]
    commits = store.commits()
    assert ingest.ingest_batch(store, snapshot(spark, 9, "N1", ["P9"]), "stream", now, 0).count() > 0 and store.commits() == commits
    log = spark.read.parquet(f"{tmp_path}/s/{commits[-1]}/batches")
    assert log.count() == 1


def test_a_batch_leaves_no_tables_behind_and_splits_before_it_writes(spark, tmp_path, monkeypatch):
    """What a batch stores in between goes with it; a document is dealt once before it is settled; large buckets are not written first and split then."""
    from quillstack.operators import reconcile

    store = ingest.Store(spark, f"file://{tmp_path}/s", limit=12_000)
    shared, puts, plans, put, plain = spark.conf.get("spark.checkpoint.dir").removeprefix("file://"), [], {}, store._put, reconcile.cut

    def noted(folder, rows, leaves, mode):
        puts.append((sorted(rows), len(leaves), mode))
        return put(folder, rows, leaves, mode)

    def planned(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, name)

    monkeypatch.setattr(store, "_put", noted)
    monkeypatch.setattr(reconcile, "cut", planned)
    before, now = set(os.listdir(shared)), F.lit(None).cast("timestamp")
    page_of = lambda i: [*page("", f"P{i:05d}", hash_=f"{i * 7919:064x}")[1:]]
    rows = [(1, f"N{k:04d}", "sig", "dev", "a.note", [page_of(10 * k + i) for i in range(10)]) for k in range(120)]
    made = spark.createDataFrame([*rows, (1, "N0000", "sig", "dev", "b.note", [page_of(0)])], schema(ingest.SNAPSHOT))  # the last has the number of the first: one of them counts
    ingest.ingest_batch(store, made, "b1", now)
    assert set(os.listdir(shared)) == before
    assert next(n for tables, n, mode in puts if "pages" in tables and mode == "overwrite") > 1
    dealt = re.findall(r"Exchange hashpartitioning\((.*?)\), ", plans["pages"])
    assert plans["pages"].split("== Initial Plan ==")[-1].count("REPARTITION_BY_COL") == 2 and not any("holder" in by for by in dealt), dealt  # documents that came, and versions
    a, _ = store.read()
    first = sorted(r.page_id for r in a.pages.where("file_id = 'N0000'").collect())
    assert first in (["P00000"], [f"P{i:05d}" for i in range(10)]) and a.pages.count() == 1190 + len(first) == a.placement.count()
    ingest.ingest_batch(store, spark.createDataFrame([(2, *r[1:]) for r in rows], schema(ingest.SNAPSHOT)), "b2", now)
    assert set(os.listdir(shared)) == before and store.table("pages").count() == 1200


def test_reconcile_decides_on_keys(spark, monkeypatch):
    """Who holds and claims a page is decided without documents, in one shuffle; what is parked needs none of that."""
    from quillstack.operators import reconcile
    from quillstack.plans.query_jobs import now
    from quillstack.plans.archives import changed_snapshot, events_archive

    made, plain = {}, reconcile.cut

    def counted(df, name):
        made[name] = df
        return plain(df, name)

    monkeypatch.setattr(reconcile, "cut", counted)
    sf = "/root/testdata/sf0.001"
    done = reconcile.reconcile_pages(changed_snapshot(spark, sf), events_archive(spark, sf), None, now())
    assert done.parked.count() and set(made) == {"gone"}
    assert done.report.count() and not {"old", "new", "source", "text"} & set(made["merged"].columns)
    plan = made["merged"]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    above = plan.split("Union")[0]
    assert above.count("Exchange hashpartitioning(page_id") == 1 and above.count("+- Sort [") == 1


def test_packed_files_follow_the_tasks_not_the_pages(spark, tmp_path):
    """Texts, documents and notes of many pages in a few files, read back whole; a text may hold any line ends."""
    from quillstack.plans import query_jobs
    from quillstack.sources import files

    texts = [("F%d" % (i % 50), "P%d" % i, "a \"line\"\r\n %d\n" % i) for i in range(300)]
    files.write_packed(spark.createDataFrame(texts, "file_id string, page_id string, md string").repartition(3), f"{tmp_path}/md")
    assert sorted(map(tuple, files.read_transcriptions(spark, f"{tmp_path}/md", "part-*", packed=True).collect())) == sorted(texts)
    places, plain = [], query_jobs.scratch

    def noted(session, name):
        places.append(plain(session, name).removeprefix("file://"))
        return places[-1]

    query_jobs.scratch, sf = noted, "/root/testdata/sf0.001"
    try:
        for query in (query_jobs.read_transcriptions, query_jobs.read_vectors, query_jobs.read_pages, query_jobs.read_notes, query_jobs.write_export):
            assert query(spark, sf).count()
    finally:
        query_jobs.scratch = plain
    import os

    assert len(places) == 5 and all(sum(n.startswith("part-") for _, _, names in os.walk(at) for n in names) <= 10 for at in places)


def test_stroke_changes_meet_in_one_shuffle(spark):
    from quillstack.operators import strokes

    def pages(*rows):
        return spark.createDataFrame([("F", p, None if d is None else f'<svg><path d="{d}"/></svg>') for p, d in rows], "file_id string, page_id string, svg string")

    old = pages(("P1", "M 1 1 M 2 2 M 2 2"), ("P2", "M 1 1"), (None, "M 5 5"), ("P3", None), ("P4", "M 1 1"), ("P4", "M 7 7"))
    new = pages(("P1", "M 1 1 M 3 3"), ("P2", "M 1 1"), (None, "M 5 5"), ("P3", "M 4 4 M 4 4"), ("P4", "M 7 7 M 1 1"))
    changes = strokes.stroke_changes(old, new)
    want = [("added", "P1", 1, "M 3 3"), ("removed", "P1", 1, "M 2 2"), ("removed", "P1", 2, "M 2 2"), ("added", "P3", 0, "M 4 4"), ("added", "P3", 1, "M 4 4"), ("added", None, 0, "M 5 5"), ("removed", None, 0, "M 5 5")]
    assert sorted(map(tuple, changes.collect()), key=str) == sorted(want, key=str)
    assert changes._jdf.queryExecution().sparkPlan().toString().count("Join") == 0


def test_texts_reach_python_in_small_batches(spark):
    from quillstack.operators import text

    held = {k: spark.conf.get(k, None) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    rows = spark.createDataFrame([(f"P{i}", "a\nb\n", "a\nc\nd\n") for i in range(1200)], "page_id string, was string, now string").coalesce(1)
    for operator in (text.line_stats, text.line_changes):
        for k in held:
            spark.conf.unset(k)
        operator(rows)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
    assert {tuple(r)[1:] for r in text.line_stats(rows).collect()} == {(2, 1)}
    for k, v in held.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
