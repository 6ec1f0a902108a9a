import random

import numpy as np
import pytest

from quillstack.llm import nearcopies, simhash


def plain_shingles(text):
    parts = (text or "").lower().split()
    return {tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def plain_groups(texts):
    """The smallest place that chains of texts with a similarity of 0.8 reach; equal words are alike."""
    root = list(range(len(texts)))
    sets, words = [plain_shingles(t) for t in texts], [(t or "").lower().split() for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if words[i] == words[j] or both and both / len(sets[i] | sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.mark.parametrize("few", [0, nearcopies.FEW])
def test_near_copies_at_a_similarity_of_0_8(spark, odd, monkeypatch, few):
    random.seed(3)
    monkeypatch.setattr(nearcopies, "FEW", few)
    monkeypatch.setattr(nearcopies, "ROUNDS", 3)
    monkeypatch.setattr(nearcopies, "SLOT", 4)
    monkeypatch.setattr(nearcopies, "TILE", 8)
    words, texts = [f"w{i}" for i in range(500)], []
    for size in (3, 40, 120, 400, 400, 3000):
        base = [random.choice(words) for _ in range(size)]
        texts += [" ".join(base), " ".join(base).upper()]
        for changes in (0.01, 0.02, 0.03, 0.05, 0.2):
            copy = [random.choice(words) if random.random() < changes else w for w in base]
            texts.append(" ".join(copy))
    hot = [random.choice(words) for _ in range(200)]
    for k in range(40):  # one large group, linked in part by chains only
        hot[5 * k % 200] = "x"
        texts.append(" ".join(hot))
    want = plain_groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()}
    assert [got[i] - 100 for i in range(100, 100 + len(texts))] == want
    near = [i for i, r in enumerate(want) if r != i and simhash.fingerprint(texts[i], 5) != simhash.fingerprint(texts[r], 5)]
    assert any((simhash.fingerprint(texts[i], 5) ^ simhash.fingerprint(texts[want[i]], 5)).bit_count() > 2 for i in near)
    both = docs.unionByName(odd.select("doc_id", "text"))
    kept = simhash.keep_one(both)
    assert kept.columns == both.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted({r + 100 for r in want} | {1, 2, 5, 6})  # 2, 3 and 4 have no words
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_no_pair_of_a_family_of_unlike_texts_is_verified_twice(spark, monkeypatch):
    """Texts of one template share buckets without being near: sketches rule most pairs out, and the others are compared once."""
    random.seed(5)
    words = [f"w{i}" for i in range(900)]
    base = [random.choice(words) for _ in range(150)]
    texts = []
    for _ in range(60):
        copy = list(base)
        for at in random.sample(range(150), 9):
            copy[at] = random.choice(words)
        texts.append(" ".join(copy))
    seen, plain = [], nearcopies.verified

    def counting(pairs, *more):
        seen.extend((r.a, r.b) for r in pairs.collect())
        return plain(pairs, *more)

    monkeypatch.setattr(nearcopies, "verified", counting)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()}
    assert [got[i] for i in range(60)] == plain_groups(texts)
    assert len(seen) == len(set(seen)) < 60 * 59 / 2


def test_unit_pairs_leave_the_largest_component_out():
    rng = np.random.default_rng(1)
    sketch = np.repeat(rng.integers(0, 256, (3, 240), np.uint8), (150, 2, 3), axis=0)
    sketch[150] = sketch[0]
    node, root = np.arange(155) * 10, np.array([0] * 150 + [1500, 1510, 1520, 1530, 1540])
    a, b = nearcopies.unit_pairs(node, root, np.zeros(155, int), False, sketch)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(10 * i, 1500) for i in range(150)} | {(1520, 1530), (1520, 1540), (1530, 1540)}
    tile = np.arange(155) % 2
    a, b = nearcopies.unit_pairs(node, root, tile, True, sketch)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(10 * i, 1500) for i in range(1, 150, 2)} | {(1520, 1530), (1530, 1540)}


def test_linked_fingerprints_come_first_and_are_verified(spark, monkeypatch):
    """keep_one takes pairs from the shards of fingerprints; of equal fingerprints only near texts become one group."""
    random.seed(2)
    long = " ".join(random.choice("abcdefgh") + str(random.randrange(40)) for _ in range(2000))
    copy = long.rsplit(" ", 1)[0]
    rare = " ".join(f"q{i}" for i in range(30))
    texts = [long, copy, "the " * 4000, "the " * 3000 + rare, "quite another text of seven words here"]
    asked, plain = [], nearcopies.verified

    def noted(pairs, *more):
        asked.append({(r.a, r.b) for r in pairs.collect()})
        return plain(pairs, *more)

    monkeypatch.setattr(nearcopies, "verified", noted)
    assert simhash.fingerprint(texts[2], 5) == simhash.fingerprint(texts[3], 5)
    assert (simhash.fingerprint(long, 5) ^ simhash.fingerprint(copy, 5)).bit_count() <= 2
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == {0, 2, 3, 4} and len(asked[0]) == 2
    assert not any(asked[0] & more for more in asked[1:])
