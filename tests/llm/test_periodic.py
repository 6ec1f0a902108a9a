import hashlib
import random
import zlib

import numpy as np
import pytest

from quillstack.llm import periodic
from quillstack.llm.periodic import Numbers


def plain_runs(words):
    """Every period of every stretch, by comparison."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            if length >= max(6, 4 * q) and not any(all(words[s + j] == words[s + j + d] for j in range(length - d)) for d in range(1, q)):
                found.append((s, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


def numbered(words):
    memo = Numbers()
    return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))


def drawn(rng):
    """Words with repeated stretches, nested and next to each other."""
    out = []
    while len(out) < rng.randrange(1, 500):
        unit = [rng.choice("abcdefgh"[: rng.choice((1, 2, 3, 8))]) for _ in range(rng.choice((1, 2, 3, 5, 8, 9, 13, 16, 17, 31, 32, 33, 40)))]
        if rng.random() < 0.3:
            unit = unit * rng.randrange(1, 5) + [rng.choice("abcd")]
        many = rng.choice((0.5, 1, 3, 4, 4.5, 6))
        out += (unit * 7)[: int(len(unit) * many)]
        if rng.random() < 0.3:
            out.append(str(rng.random()))
    return out


def test_runs_equal_a_plain_search():
    rng = random.Random(5)
    documents = [drawn(rng) for _ in range(150)]
    found = periodic.runs_of_all([numbered(d) for d in documents])
    for words, runs in zip(documents, found, strict=True):
        assert runs == plain_runs(words)
    assert sum(map(len, found)) > 300 and any(q > 32 for runs in found for _, _, q in runs)


@pytest.mark.parametrize("q", [1, 7, 8, 9, 15, 16, 17, 31, 32, 33, 63, 64, 65, 500, 1023, 1024, 1025])
def test_every_period_at_its_least_length(q):
    unit = [f"w{i}" for i in range(q)]
    n = max(6, 4 * q)
    alone = ["x", *(unit * 6)[:n], "y"]
    short = ["x", *(unit * 6)[: n - 1], "y"]
    assert periodic.runs_of_all([numbered(alone), numbered(short), numbered(alone)]) == [[(1, n, q)], [], [(1, n, q)]]


def test_digests_equal_a_plain_computation(spark):
    rng = random.Random(9)
    texts = [" ".join(drawn(rng)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (7, texts[7]), (None, "a b " * 20), (900, None), (901, ""), (902, " \t\n "), (903, "one"), (904, "日本 é\x0bé x " * 9), (905, "w " * 30_000)]
    df = spark.createDataFrame([(i, t, "r", 3) for i, t in rows], "doc_id long, text string, words string, period int").repartition(3)
    got = sorted(map(tuple, periodic.digests(df).collect()), key=str)
    want = [plain_digest(i, t) for i, t in rows if i != 905]
    assert sorted(r for r in map(str, got) if not r.startswith("(905")) == sorted(map(str, want))
    long = next(r for r in got if r[0] == 905)
    assert long[1:5] == (1, 0, 30_000, 1)


def test_the_operator_gives_runs_and_texts(spark):
    rows = [(1, "so it goes so it goes so it goes so it goes on"), (2, None), (3, "a  b\nc"), (10, "x " * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, periodic.find_runs(df).collect())) == [(1, 0, 12, 3), (10, 0, 6, 1)]
    assert {r.doc_id: r.text for r in periodic.collapse(df).collect()} == {1: "so it goes on", 2: None, 3: "a b c", 10: "x"}
    assert periodic.digests(df.limit(0)).count() == 0 and periodic.find_runs(df.limit(0)).count() == 0


def test_ill_formed_text_is_taken_as_bytes(spark):
    df = spark.range(1).selectExpr("id AS doc_id", "CAST(X'61FF2061FF2061FF2061FF2061FF2061FF' AS STRING) AS text")
    assert tuple(periodic.find_runs(df).first()) == (0, 0, 6, 1)
