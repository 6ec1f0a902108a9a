import itertools
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillstack.functions import columns as c


def values(spark, rows, f, ddl="v string"):
    names = [x.split()[0] for x in ddl.split(", ")]
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], ddl)
    return [r[0] for r in df.coalesce(1).select(f(*[F.col(n) for n in names])).collect()]


def test_note_name(spark):
    assert values(spark, [("a.note", "F"), ("a.note.note", "F"), (".note", "F"), (None, "F"), ("a.notes", "F"), ("a.note\n", "F")], c.note_name, "v string, f string") == ["a", "a.note", "F", "F", "a.notes", "a.note\n"]


def test_created_at(spark):
    got = values(spark, ["P19850704081530", "F19850704081530zzz9", "19850704", "P198507", "F19850704246060", "P19851704", "draft", "", None], c.created_at)
    moment, midnight = datetime(1985, 7, 4, 8, 15, 30), datetime(1985, 7, 4)
    assert got == [moment, moment, midnight, None, midnight, None, None, None, None]


#: Every way to carry the moment, and ways that fall short of it.
MOMENT = "19850704T081530"
CARRIERS = ["{d}", "P{d}", "F{d}777", "{m}", "{m}.txt", "{m}==box--trip", "{m}__red_blue", "sketch@@{m}", "sketch@@{m}--lake.png"]
OTHERS = ["", "lake", "P198507040815", "{m}5", "{m}-lake", "sketch{m}", "in/{m}--lake", "sketch@{m}", "1985T081530--lake", "sketch@@{m}lake"]


def test_denote_id(spark):
    fill = lambda texts: [t.format(m=MOMENT, d=MOMENT.replace("T", "")) for t in texts]
    assert values(spark, fill(CARRIERS), c.denote_id) == [MOMENT] * len(CARRIERS)
    assert values(spark, fill(OTHERS), c.denote_id) == [""] * len(OTHERS)


def test_norm_text(spark):
    assert values(spark, ["a", "a\n\n", "\n\n", "", None, "\na\n"], c.norm_text) == ["a\n", "a\n", "", "", "", "\na\n"]


def test_nest_headings(spark):
    assert values(spark, ["* H\ntext\n** K\n *"], lambda v: c.nest_headings(v, "**")) == ["*** H\ntext\n**** K\n *"]
    for bad in ("", "*#"):
        with pytest.raises(ValueError):
            c.nest_headings(F.col("v"), bad)


def test_effective_tags(spark):
    assert values(spark, [(["b", "a"], ["c", "a"]), (None, ["x"]), (None, None)], c.effective_tags, "a array<string>, b array<string>") == [["a", "b", "c"], ["x"], []]


def test_tags_and_lines(spark):
    assert values(spark, [(["b"],), (None,)], lambda v: c.apply_tag(v, "a"), "v array<string>") == [["a", "b"], ["a"]]
    assert values(spark, [(["b", "a"],)], lambda v: c.apply_tag(v, "b", remove=True), "v array<string>") == [["a"]]
    assert values(spark, [(["to do", "é_@#%", "a:b"],), ([],)], c.note_tag_line, "v array<string>") == ["#+filetags: :to_do:é_@#%:a_b:\n", None]


def test_background_hash(spark):
    import base64
    import hashlib

    data = base64.b64encode(b"image").decode()
    svgs = [f'<image xlink:href="data:image/png;base64,{data}"/>', "<svg/>", '<image xlink:href="data:image/png;base64,!!"/>', None]
    assert values(spark, svgs, c.background_hash) == [hashlib.sha256(b"image").hexdigest(), None, None, None]


def test_text_change(spark):
    """All pairs of some texts: line ends behind the last line make no difference, and a text of them alone is none."""
    texts = [None, "\n", "red\nblue", "red\nblue\n\n", "\nred\n", "green", " "]
    stored = lambda t: (t or "").rstrip("\n")
    pairs = list(itertools.product(texts, repeat=2))
    for (was, now), got in zip(pairs, values(spark, pairs, c.text_change, "a string, b string"), strict=True):
        a, b = stored(was), stored(now)
        assert got["kind"] == ("unchanged" if a == b else "cleared" if not b else "new" if not a else "updated")
        assert (got["was"], got["now"], got["conflicts"]) == (a and a + "\n", b and b + "\n", False)


def test_edit_change(spark):
    kinds = [r["kind"] for r in values(spark, [("mine\n", "base\n", "base"), ("mine\n", "", ""), ("base\n", "base\n", "base\n"), ("a", "<<<<<<< edited\n", "b")], c.edit_change, "a string, b string, c string")]
    assert kinds == ["reverted", "cleared", "unchanged", "updated"]


def test_strokes(spark):
    svg = '<svg><path fill="red" d="M 0 0\n  L 1 1 m 2 2 M 3 3"/><rect/><path d=" M 4 4 "  /></svg>'
    assert values(spark, [svg, "<svg/>", None], c.path_strokes) == [["M 0 0 L 1 1", "m 2 2", "M 3 3", "M 4 4"], [], []]
    assert len(set(values(spark, [svg, svg.replace("red", "blue")], c.handwriting))) == 1


def test_page_content(spark):
    rows = [("text\n\n", False), ("text\n", True), (None, False)]
    assert values(spark, rows, c.page_content, "v string, t boolean") == ["text", "", ""]
