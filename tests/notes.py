"""Small archives for tests."""

from datetime import datetime

from quillstack.model import BOXES, NOTES, PAGES, PLACEMENT, TRANSCRIPTIONS, Archive, schema

RECT = (0, 0, 100, 50)


def page(file_id, page_id, starred=False, background=None, tags=(), titles=(), keywords=(), links=(), analysis=None, modified=None, device=None, hash_="", version=6):
    return (file_id, page_id, starred, background, modified, device, hash_, list(tags), list(titles), [(k,) for k in keywords], list(links), analysis, version)


def title(rect=RECT, name=None, edited=False):
    return (rect, 1, None if name is None else (name, edited))


def link(rect=RECT, kind="note", page_id=None, file_id=None, target=None, name="", analysed=None):
    return (rect, kind, page_id, file_id, target, 0, name, None if analysed is None else (analysed, False))


def archive(spark, notes, pages, md=(), boxes=None):
    """notes: file_id to (source, tags, [page ids])."""
    n = spark.createDataFrame([(f, "sig", "dev", s, list(t), 6) for f, (s, t, _) in notes.items()], schema(NOTES))
    p = spark.createDataFrame([(f, i, q, i + 1) for f, (_, _, ids) in notes.items() for i, q in enumerate(ids)], schema(PLACEMENT))
    m = spark.createDataFrame([(f, q, t, b) for f, q, t, b in md], schema(TRANSCRIPTIONS))
    return Archive(n, p, spark.createDataFrame(list(pages), schema(PAGES)), m, None if boxes is None else spark.createDataFrame(boxes, schema(BOXES)))


def day(n):
    return datetime(2026, 7, n)


def filters_archive(spark, note_tags=(), pa_tags=(), pb_tags=()):
    return archive(
        spark,
        {"N10": ("alpha.note", (), ["P71", "P72"]), "N20": ("beta.note", note_tags, ["P73", "P74"])},
        [page("N10", "P71", True, keywords=["foo"], tags=pa_tags), page("N10", "P72", keywords=["foobar"], tags=pb_tags), page("N20", "P73", True), page("N20", "P74")],
        [("N10", "P71", "meeting notes about foo\n", ""), ("N20", "P73", "grocery list\n", "")],
    )
