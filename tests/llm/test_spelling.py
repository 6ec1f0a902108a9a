import random
import re
import zlib
from collections import Counter

import numpy as np

from quillstack.llm import spelling


def plain_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            if doc_id is not None and (h := zlib.crc32(f"{doc_id}:{w}".encode())) % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def plain_groups(counts):
    out, forms = [], {}
    for w, n in counts.items():
        near = [v for v in counts if v != w and plain_near(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 2 * n else None
        out.append([w, forms[w], None, n, len(near), counts[forms[w]] if forms[w] else None])
    for row in out:
        w = row[0]
        while forms[w]:
            w = forms[w]
        row[2] = w
    return sorted(map(tuple, out), key=lambda r: r[0])


def drawn(rng, n):
    """Documents of few stems with slips, so that many words are near each other, in chains too."""
    stems = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(4, 9))) for _ in range(25)]

    def slip(w):
        k = rng.randrange(len(w))
        return rng.choice((w, w, w, w[:k] + w[k + 1 :], w[:k] + rng.choice("abcé") + w[k:], w[:k] + rng.choice("abcé") + w[k + 1 :], w.capitalize()))

    return [(i, " ".join(slip(rng.choice(stems)) + rng.choice(("", ",", " 7", "×", "́", "日")) for _ in range(rng.randrange(60)))) for i in range(n)]


def test_groups_equal_a_plain_search(spark):
    rows = [*drawn(random.Random(3), 300), (1, None), (2, ""), (None, "without number, without number, without number"), (5, "x" * 50_000), (7, "same text " * 9), (7, "same text " * 9), (8, "É" * 3 + " ÉÉÉÉÉÉ éééééé ÉÉÉÉÉÉ ÉÉÉÉÉÉ")]
    df = spark.createDataFrame([(i, t, "w", "f") for i, t in rows], "doc_id long, text string, word string, form string").repartition(3)
    got = spelling.group_variants(spelling.count_words(df, spelling.DAMAGED)).collect()
    want = plain_groups(plain_counts(rows))
    assert sorted(map(tuple, got), key=lambda r: r[0]) == want
    assert sum(r[1] is not None for r in want) > 50 and any(r[1] and r[2] != r[1] for r in want) and max(r[4] for r in want) > 5


def test_large_cells_are_tiled_without_losing_a_pair(spark, monkeypatch):
    rng = random.Random(8)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(5, 8))): rng.randrange(3, 40) for _ in range(900)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    monkeypatch.setattr(spelling, "TILE", 16)
    assert sorted(map(tuple, spelling.group_variants(df).collect()), key=lambda r: r[0]) == plain_groups(words)


def test_long_chains_of_forms_end_at_their_last_word(spark):
    rows = [("abcde"[:5] + "x" * k, 3 * 2**k) for k in range(20)]
    got = {r.word: r for r in spelling.group_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert {r.root for r in got.values()} == {rows[-1][0]} and got[rows[0][0]].form == rows[1][0] and got[rows[-1][0]].form is None


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group_variants(spelling.count_words(none, 97)).collect() == []
    assert spelling.count_words(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect() == []


def test_one_inserted_letter():
    pairs = [("abcd", "abxcd", True), ("abcd", "xabcd", True), ("abcd", "abcdx", True), ("aabb", "aaabb", True), ("abcd", "abdce", False), ("abcd", "bcdab", False)]
    short, long = ([np.frombuffer(p[k].encode(), np.uint8) for p in pairs] for k in (0, 1))
    assert spelling._one_inserted(np.stack(short), np.stack(long)).tolist() == [p[2] for p in pairs]
