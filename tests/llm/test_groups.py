import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillstack.llm import collision, components, containment, simhash


def plain_components(n, pairs):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def plain_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints_as_spark_hashes(spark):
    texts = ["One two three FOUR\x0bfive", "one", "É x y", "a b c a b c a b c d", "", " \n"]
    for t in texts:
        assert simhash.fingerprint(t) & (1 << 64) - 1 == plain_fingerprint(t)
    spark_hash = spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0]
    assert simhash.fingerprint("one two three") == spark_hash


def test_near_duplicates(spark, odd, monkeypatch):
    random.seed(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        text = [random.choice(words) for _ in range(random.choice([2, 40, 900]))]
        for k in range(4):  # a copy, and copies with one word changed
            rows.append((100 + 10 * i + k, " ".join(text)))
            text[random.randrange(len(text))] = random.choice(words) if k else text[0]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    monkeypatch.setattr(simhash, "LEAF", 16)
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs).collect()}
    every = [(r.doc_id, plain_fingerprint(r.text or "")) for r in docs.collect()]
    pairs = [(i, j) for i in range(len(every)) for j in range(i) if (every[i][1] ^ every[j][1]).bit_count() <= 2]
    groups = {}
    for i, root in enumerate(plain_components(len(every), pairs)):
        groups.setdefault(root, []).append(i)
    assert len(groups) < len(every) - 20 and any(every[i][1] != every[j][1] for i, j in pairs)
    for members in groups.values():
        ids = [every[i][0] for i in members if every[i][0] is not None]
        for i in members:
            assert got[every[i][0], f"{every[i][1]:016x}"] == (min(ids) if ids else None)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_shard_links_match_brute_force(monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 40).astype(np.uint64)
    fps = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for c in centres] + [centres]))
    guest = rng.random(len(fps)) < 0.3
    monkeypatch.setattr(simhash, "CELLS", 2000)
    a, b = simhash.shard_links(fps, guest)
    place = {int(f): i for i, f in enumerate(fps)}
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 2 and not (guest[i] and guest[j])]
    assert plain_components(len(fps), near) == plain_components(len(fps), [(place[int(x)], place[int(y)]) for x, y in zip(a, b, strict=True)])


def test_routing_brings_close_pairs_together():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 3000).astype(np.uint64)
    other = base ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64))
    tree = {p: (point, r) for p, point, r in simhash.fit_tree(base, 5)}
    assert len(tree) > 20
    held = {}
    for path, part, guest in simhash._route(np.concatenate([base, other]), tree):
        for fp, g in zip(part.tolist(), guest.tolist(), strict=True):
            held.setdefault(fp, {})[path] = held.get(fp, {}).get(path, True) and g
    for a, b in zip(base.tolist(), other.tolist(), strict=True):
        assert any(not (held[a][p] and held[b][p]) for p in held[a].keys() & held[b].keys())


def test_keep_one(spark):
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(3, text, "a"), (2, text, "b"), (2, text, "b"), (9, "another text altogether here now", "c"), (None, text, "d")], "doc_id long, text string, component_id string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.component_id) for r in kept.where("doc_id IS NOT NULL").collect()) == [(2, "b"), (9, "c")]
    assert kept.where("doc_id IS NULL").count() == 1


def test_components(spark):
    random.seed(4)
    pairs = [(random.randint(0, 199), random.randint(0, 199)) for _ in range(150)] + [(i, i + 1) for i in range(100, 130)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert [found.get(i, i) for i in range(200)] == plain_components(200, pairs)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_shingles(text, n=5):
    w = containment.words_of(text)
    return {tuple(w[i : i + min(n, len(w))]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_containment(spark, odd):
    random.seed(6)
    words = [f"w{i}" for i in range(15)]
    make = lambda n: " ".join(random.choice(words) for _ in range(n))
    items = [(i, make(random.choice([1, 3, 5, 8, 30]))) for i in range(40)] + [(90, None), (91, " ."), (3, "w1 w2 w3")]
    docs = [(i, make(random.choice([3, 50, 400]))) for i in range(60)]
    docs += [(100 + i, f"{make(60)}. {t.upper()}! {make(60)}") for i, (_, t) in enumerate(items[:40])]
    docs += [(200 + i, f"{make(20)} {' '.join(w for k, w in enumerate(t.split()) if k != 2)} {make(20)}") for i, (_, t) in enumerate(items[:40])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    d = d.where("doc_id IS NOT NULL AND text IS NOT NULL").unionByName(odd.select((F.col("doc_id") + 5000).alias("doc_id"), "text"))
    got = sorted((r.doc_id, r.item_id, r.found, r.of) for r in containment.search(d, b).where("doc_id IS NOT NULL").collect())
    want = []
    for i, t in [(r.doc_id, r.text) for r in d.where("doc_id IS NOT NULL").collect()]:
        for k, s in items:
            q = plain_shingles(s)
            n = len(next(iter(q))) if q else 0
            w = containment.words_of(t)
            inside = {g for g in (tuple(w[j : j + n]) for j in range(len(w) - n + 1))} & q if n else set()
            if q and len(inside) >= 0.8 * len(q):
                want.append((i, k, len(inside), len(q)))
    assert got == sorted(want) and len(got) > 40
    kept = containment.drop_contaminated(d.withColumn("item_id", F.lit("x")), b)
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == {r.doc_id for r in d.collect() if r.doc_id is not None} - {x[0] for x in want} and kept.columns == ["doc_id", "text", "item_id"]
    assert containment.search(d, b.limit(0)).count() == 0 and containment.search(d.limit(0), b).count() == 0


def test_columns_that_clash(spark, odd):
    """Columns named like results, or like columns on the way to them, change nothing."""
    names = ["fp", "first", "root", "node", "component_id", "fingerprint", "guest", "shard", "count", "bucket", "h1", "item_id", "found", "of", "containment"]
    told = lambda df: sorted(map(str, df.collect()))
    docs = odd.select("doc_id", "text")
    more = docs.select("*", *[F.lit("z").alias(c) for c in names])
    assert told(simhash.near_duplicates(more)) == told(simhash.near_duplicates(docs))
    kept = simhash.keep_one(more)
    assert kept.columns == more.columns and told(kept.select("doc_id", "text")) == told(simhash.keep_one(docs))
    items = spark.createDataFrame([(1, "quick brown fox s 123"), (2, "the the the the the"), (2, "the the the the the"), (None, "no id"), (3, None)], "item_id long, text string")
    wide = items.select("*", *[F.lit("z").alias(c) for c in ["doc_id", "block", "found", "n", "containment"]])
    hits = told(containment.search(docs, items))
    assert hits and told(containment.search(more, wide)) == hits
    clean = containment.drop_contaminated(more, wide)
    assert clean.columns == more.columns and told(clean.select("doc_id", "text")) == told(containment.drop_contaminated(docs, items))


def test_nearest(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((900, 16))
    v[300:330] = v[300]  # ties
    rows = [(i, x.tolist(), "q") for i, x in enumerate(v)] + [(1000, None, ""), (1001, [0.0] * 16, ""), (1002, [float("nan")] + [1.0] * 15, ""), (1003, [None] + [1.0] * 15, ""), (1004, [1.0] * 3, ""), (None, [1.0] * 16, ""), (0, v[0].tolist(), "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = {}
    for r in collision.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hit = 0
    assert sorted(got) == list(range(0, 900, 100))
    for q, found in got.items():
        distances = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(900), distances)) if i != q][:10]
        hit += len({i for i, _ in found.values()} & set(order))
        assert sorted(found) == list(range(1, 11))
        assert all(abs(distances[i] - s) < 1e-12 for i, s in found.values())
    assert [i for i, _ in sorted(got[300].values(), key=lambda x: (x[1], x[0]))] == list(range(301, 311))
    assert hit >= 0.9 * 90
    assert collision.nearest(df.limit(0), F.lit(True)).count() == 0
    assert collision.nearest(df.where("vec_id < 4"), F.col("vec_id") == 0).count() == 3


def test_neighbours_of_odd_rows(spark):
    """Repeated rows, an id with two vectors, several lengths, and a vector that many rows share."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (100, [0.0, 5.0]), (100, [4.0, 0.0]), (200, [1.0, 1.0, 1.0]), (201, [1.0, 1.0, 2.0]), (300, [7.0])]
    rows += [(i, [9.0, 9.0]) for i in range(301, 360)]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<float>, length string, block int")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in collision.nearest(df, F.col("vec_id") % 100 == 0, 3).collect())
    want = []
    for q, v in {(i, tuple(v)) for i, v in rows if i % 100 == 0}:
        near = sorted((float(np.linalg.norm(np.array(v) - w)), i) for i, w in rows if i != q and len(w) == len(v))[:3]
        want += [(q, k + 1, i, round(d, 6)) for k, (d, i) in enumerate(near)]
    assert got == sorted(want) and len(got) == 3 + 6 + 1
    lone = collision.nearest(df.where("vec_id > 299"), F.col("vec_id") == 340, 3).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(lone, key=lambda r: r["rank"])] == [(1, 301, 0.0), (2, 302, 0.0), (3, 303, 0.0)]


def test_neighbours_verify_few(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((6000, 32)) * rng.choice([0.2, 1.0], (6000, 1))
    block, hit = collision.Block(np.arange(6000), x), 0
    for i in range(0, 6000, 150):
        ids, distances = block.search(i, x[i], 10)
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        hit += len(set(ids.tolist()) & set(np.argsort(d)[:10].tolist()))
        assert np.array_equal(distances, d[ids]) and (np.diff(distances) >= 0).all()
    assert hit >= 0.9 * 400 and block.verified < 0.3 * 40 * 6000


def test_neighbours_take_few_steps(monkeypatch):
    """The windows begin where vectors can collide often enough, so a search widens them some twenty times and not fifty."""
    x = np.random.default_rng(3).standard_normal((6000, 64))
    block, places, steps = collision.Block(np.arange(6000), x), collision.Block._places, []
    monkeypatch.setattr(collision.Block, "_places", lambda self, at, side: steps.append(side) or places(self, at, side))
    for i in range(0, 6000, 600):
        block.search(i, x[i], 10)
    assert len(steps) <= 10 * 2 * 25 and block.verified < 0.3 * 10 * 6000


def test_size_classes_prune_and_lose_nothing():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 7, 12, 30, 70])))) for i in range(150)]
    block = containment.build(items)
    assert len({(c.words, c.least) for c in block.classes}) > 4 and max(block.hits) > 1
    memo, met, wanted = containment._Hashes(), 0, 0
    for _ in range(200):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 20, 200]))]
        text = rng.choice(items)[1].split()
        if rng.random() < 0.5:
            text[rng.randrange(len(text))] = "x"
        words[rng.randrange(len(words)) :] = text
        parts = containment.words_of(" ".join(words))
        got = {at for at, *_ in containment.find(block, parts, memo)}
        want = set()
        for at, grams in enumerate(block.grams):
            n = len(next(iter(grams)))
            have = {tuple(parts[i : i + n]) for i in range(len(parts) - n + 1)}
            if len(grams & have) >= containment.SHARE * len(grams) - 1e-9:
                want.add(at)
        assert got == want
        met, wanted = met + 1, wanted + len(want)
    assert wanted > 100
