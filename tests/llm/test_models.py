import base64
import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack.llm import hyperlang, kneser_ney, maskedlm, urlfilter, warc


# --- language

EN = "the quick brown fox jumps over the lazy dog and then goes home with his friends to sleep"
DE = "der schnelle braune fuchs springt über den faulen hund und geht dann mit seinen freunden nach hause"


def test_language(spark, odd):
    rows = [(i, " ".join(np.random.default_rng(i).permutation((EN if i % 2 else DE).split())), "en" if i % 2 else "de") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").unionByName(odd.where("doc_id > 1").select("doc_id", "text", F.lit(None).cast("string").alias("lang"))).withColumn("score", F.lit("clash"))
    got = hyperlang.identify(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    truth = {i: lang for i, _, lang in rows}
    assert all(r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in truth and r.held_out and r.doc_id not in (2, 3, 4, 5, 6))
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    odd_ones = {r.doc_id: r.lang_pred for r in hyperlang.identify(docs.where("lang IS NULL OR doc_id > 10")).collect() if r.doc_id < 7}
    assert odd_ones[2] == odd_ones[3] == odd_ones[4] == "und" and odd_ones[5] in ("de", "en")
    assert {r.lang_pred for r in hyperlang.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert hyperlang.identify(docs.limit(0)).count() == 0
    kept = hyperlang.keep_identified(docs)
    assert kept.columns == docs.columns and not {2, 3, 4} & {r.doc_id for r in kept.where("lang IS NULL").collect()}


def test_bundle_is_the_sum_of_bound_vectors():
    text, total = "Ab, a", np.zeros(hyperlang.DIMENSIONS)
    line = [0, ord("a"), ord("b"), 0, ord("a"), 0]
    for a, b, c in zip(line, line[1:], line[2:], strict=False):
        total += np.roll(hyperlang._letter_vector(a), 2) * np.roll(hyperlang._letter_vector(b), 1) * hyperlang._letter_vector(c)
    assert np.array_equal(hyperlang.bundle(text), total) and hyperlang.bundle("12 !") is None


def plain_bundle(text):
    total = np.zeros(hyperlang.DIMENSIONS)
    line = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    for three in zip(line, line[1:], line[2:], strict=False):
        a, b, c = (0 if x == " " else ord(x) for x in three)
        total += np.roll(hyperlang._letter_vector(a), 2) * np.roll(hyperlang._letter_vector(b), 1) * hyperlang._letter_vector(c)
    return total


def test_language_is_that_of_a_plain_computation(spark, monkeypatch):
    monkeypatch.setattr(hyperlang, "CHUNK", 37)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice((EN if i % 3 else DE).split(), 12)) + " 12, é!", "en" if i % 3 else "de") for i in range(60)]
    got = {r.doc_id: r for r in hyperlang.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    prototypes = {g: sum(plain_bundle(t) for i, t, lang in rows if lang == g and not got[i].held_out) for g in ("de", "en")}
    cosine = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    for i, t, _ in rows:
        cosines = {g: cosine(plain_bundle(t), p) for g, p in prototypes.items()}
        assert got[i].lang_pred == max(cosines, key=cosines.get) and abs(got[i].score - max(cosines.values())) < 1e-6


# --- quality


def kinds(text):
    """How many distinct triples of words a text has."""
    w = ["<s>", "<s>", *text.split()]
    return len(set(zip(w, w[1:], w[2:], strict=False)))


def plain_kneser_ney(texts):
    """log perplexity of a text, straight from the formulas."""
    tri = Counter()
    for t in texts:
        w = ["<s>", "<s>", *t.split()]
        tri.update(zip(w, w[1:], w[2:], strict=False))
    bi = Counter(k[1:] for k in tri)
    uni = Counter(k[1] for k in bi)

    def discounts(c):
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        if not n[0] or not n[1]:
            return [0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else (k + 1) / 2, 0), k + 1) for k in range(3)]

    d1, d2, d3 = discounts(uni), discounts(bi), discounts(tri)
    cut = lambda c, d: d[min(c, 3) - 1]
    t1 = sum(uni.values())
    unknown = sum(cut(c, d1) for c in uni.values()) / t1 / (len(uni) + 1)
    of2, of3 = defaultdict(list), defaultdict(list)
    for (v, w), c in bi.items():
        of2[v].append(c)
    for (u, v, w), c in tri.items():
        of3[u, v].append(c)

    def p(u, v, w):
        p1 = unknown + ((uni[w] - cut(uni[w], d1)) / t1 if w in uni else 0)
        p2 = p1
        if v in of2:
            s = sum(of2[v])
            p2 = sum(cut(c, d2) for c in of2[v]) / s * p1 + ((bi[v, w] - cut(bi[v, w], d2)) / s if (v, w) in bi else 0)
        if (u, v) not in of3:
            return p2
        s = sum(of3[u, v])
        return sum(cut(c, d3) for c in of3[u, v]) / s * p2 + ((tri[u, v, w] - cut(tri[u, v, w], d3)) / s if (u, v, w) in tri else 0)

    def perplexity(t):
        w = ["<s>", "<s>", *t.split()]
        logs = [-math.log(p(*k)) for k in zip(w, w[1:], w[2:], strict=False)]
        return sum(logs) / len(logs) if logs else None

    return perplexity


@pytest.mark.parametrize("small", [True, False])
def test_kneser_ney(spark, odd, small):
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(list("abcdefgh"), 30, p=[0.3, 0.2, 0.15, 0.1, 0.1, 0.05, 0.05, 0.05])) for _ in range(12)]
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    model.small = small
    docs = spark.createDataFrame([(100, "a b c zz a"), (101, texts[0]), (102, "zz yy\nxx ")], "doc_id long, text string").unionByName(odd.where("doc_id > 1").select("doc_id", "text"))
    plain = plain_kneser_ney(texts)
    got = {r.doc_id: r for r in kneser_ney.perplexities(docs, model, "doc_id").collect()}
    for r in docs.collect():
        want = plain(r.text or "")
        assert got[r.doc_id].n_words == len((r.text or "").split())
        assert (got[r.doc_id].log_perplexity is None) == (want is None) and (want is None or abs(got[r.doc_id].log_perplexity - want) < 1e-5)


def test_quality(spark, odd):
    rng = np.random.default_rng(1)
    vocabulary = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary, 40)), "en") for i in range(300)] + [(1000 + i, " ".join(f"%{rng.integers(1e9)}%" for _ in range(40)), "en") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("keep", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)] + [(1000, 0, 0), (7, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    kneser_ney.TRAIN_DOCS = 150
    try:
        got = {r.doc_id: r.keep for r in kneser_ney.judge(docs, labels).collect()}
        assert not any(got[1000 + i] for i in range(10)) and sum(got[i] for i in range(300)) >= 297
        kept = kneser_ney.keep_good(docs, labels)
        assert kept.columns == docs.columns and kept.where("doc_id >= 1000").count() == 0
    finally:
        kneser_ney.TRAIN_DOCS = 1_500
    assert {r.doc_id: r.keep for r in kneser_ney.judge(odd.withColumn("lang", F.lit("x")), labels.limit(0)).collect()}[2] is False
    assert kneser_ney.judge(docs.limit(0), labels).count() == 0


def test_quality_is_that_of_a_plain_computation(spark):
    rng = np.random.default_rng(6)
    words = {"en": [f"e{i}" for i in range(40)], "de": [f"d{i}" for i in range(40)]}
    rows = [(i, " ".join(rng.choice(words[g], rng.integers(3, 60), p=np.arange(1, 41) / 820)), g) for i in range(260) for g in ["en" if i < 200 else "de"]]
    rows += [(900, " ".join(f"%{k}" for k in range(50)), "en"), (901, "e1 d1 x", None), (902, "e1 " * 30 + "e2 " * 40, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = [i for i, _, _ in rows if i % 4 != 1 and i < 260]
    labels = spark.createDataFrame([(i, 1) for i in trusted] + [(1, 0)], "doc_id long, quality int")
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    sample = sorted(trusted, key=lambda i: (hashes[i], i))[: len(trusted) // 2]
    texts = {i: t for i, t, _ in rows}
    plain = plain_kneser_ney([texts[i] for i in sample])
    bound = {i: plain(t) * len(t.split()) / kinds(t) - kneser_ney.SLACK / math.sqrt(kinds(t)) for i, t, _ in rows}
    held = [(g, math.ceil(bound[i] * 1000)) for i, _, g in rows if i in set(trusted) - set(sample)]

    def threshold(lang):
        own = [b for g, b in held if g == lang]
        of = lambda some: math.ceil(np.quantile(some, kneser_ney.QUANTILE)) / 1000 if some else 0
        return (len(own) * of(own) + kneser_ney.PRIOR * of([b for _, b in held])) / (len(own) + kneser_ney.PRIOR) + kneser_ney.MARGIN

    got = kneser_ney.judge(docs, labels).collect()
    assert len(got) == len(rows) and len({r.threshold for r in got}) == 3
    for r in got:
        assert abs(r.threshold - threshold(r.lang)) < 0.0021 and abs(r.bound - bound[r.doc_id]) < 1e-5
        assert r.keep == (bound[r.doc_id] <= threshold(r.lang)) or abs(bound[r.doc_id] - threshold(r.lang)) < 0.003
    kept = {r.doc_id: r.keep for r in got}
    assert not kept[900] and not kept[902]  # unknown words; common words over and over


# --- language model


def test_masked_gradients():
    rng = np.random.default_rng(0)
    context, target = rng.integers(0, maskedlm.WORDS + 1, (6, 2 * maskedlm.SIDE)), rng.integers(0, maskedlm.WORDS, 6)
    flat = maskedlm.fresh() * 3
    trainer = maskedlm.Trainer(flat)
    found = {}
    trainer._move = lambda name, at, g: found.setdefault(name, []).append((at, g))
    trainer.step(context, target)
    loss = lambda f: -maskedlm.log_probabilities(maskedlm.unpack(f.astype(np.float64)), context, target).mean()
    for name in ("w", "cw", "b", "cb"):
        whole = np.zeros(maskedlm.SHAPES[name])
        for at, g in found[name]:
            whole[at] += g
        place = tuple(int(rng.integers(0, n)) for n in whole.shape)
        moved = [flat.astype(np.float64).copy() for _ in range(2)]
        for f, sign in zip(moved, (1, -1), strict=True):
            maskedlm.unpack(f)[name][place] += sign * 1e-4
        assert abs((loss(moved[0]) - loss(moved[1])) / 2e-4 - whole[place]) < 1e-3


def plain_log_probability(net, context, target):
    x = np.tanh(np.concatenate([net["embed"][c] for c in context]).astype(float) @ net["w"] + net["b"])
    out = 0.0
    for scores, at in ((x @ net["cw"] + net["cb"], target // maskedlm.CLASSES), (x @ net["ww"][target // maskedlm.CLASSES] + net["wb"][target // maskedlm.CLASSES], target % maskedlm.CLASSES)):
        out += scores[at] - math.log(np.exp(scores).sum())
    return out


@pytest.fixture(scope="module")
def spoken(spark):
    """Documents in a language of twelve words in turn, and some with a thousand and a half of rare ones."""
    rng = np.random.default_rng(2)
    rows = [(i + 10, " ".join(f"w{(k * 3 + j) % 12}" for j, k in enumerate(rng.integers(0, 4, 1).repeat(120)))) for i in range(60)]
    rows += [(100 + i, " ".join(f"r{rng.integers(1500)}" for _ in range(90))) for i in range(40)] + [(200, "x" * 70 + " once"), (200, "x" * 70 + " once"), (None, "r1 R1 once")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_masked_scores(spark, odd, spoken):
    docs = spoken.unionByName(odd.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    model = maskedlm.train(docs)
    scored = maskedlm.score(docs, model).collect()
    every, counts = docs.collect(), Counter()
    assert len(scored) == len(every)
    for r in every:
        counts.update(maskedlm.words_of(r.text))
    table, net = maskedlm.Vocabulary(model.own), maskedlm.unpack(model.flat)
    assert {r.n for r in model.counts.collect()} == set(counts.values()) and len(model.own) == maskedlm.WORDS - maskedlm.SHARED < len(counts)
    shared = defaultdict(dict)
    for w, n in counts.items():
        if table[w] >= maskedlm.WORDS - maskedlm.SHARED:
            shared[table[w]][w] = n
    by = defaultdict(list)
    for r in scored:
        by[r.doc_id].append(r)
    for r in every:
        words, got = maskedlm.words_of(r.text), by[r.doc_id]
        numbers = [table[w] for w in words]
        if len(numbers) > 300:
            continue
        line = [maskedlm.WORDS] * 2 + numbers + [maskedlm.WORDS] * 2
        want = sum(plain_log_probability(net, line[i : i + 2] + line[i + 3 : i + 5], n) for i, n in enumerate(numbers))
        want += sum(math.log((counts[w] + 1) / (sum(shared[n].values()) + len(shared[n]) + 1)) for w, n in zip(words, numbers, strict=True) if n in shared)
        assert any(abs(g.log_likelihood - want) < 1e-2 and g.n_tokens == len(words) for g in got)
    assert by[1002][0].mean_log_likelihood is None and by[1003][0].n_tokens == 0 and len(by[200]) == 2
    turn = np.mean([by[i + 10][0].mean_log_likelihood for i in range(60)])
    assert turn > -math.log(maskedlm.WORDS) + 1 and turn > np.mean([by[100 + i][0].mean_log_likelihood for i in range(40)]) + 2
    assert maskedlm.score(docs.limit(0), maskedlm.train(docs.limit(0))).count() == 0


def test_masked_scores_with_words_that_tasks_do_not_know(spark, spoken, monkeypatch):
    model = maskedlm.train(spoken)
    assert model.counts.count() == maskedlm.count_words(spoken.repartition(9)).count() and "seen" not in vars(model)  # words are not stored for each document
    key = lambda df: sorted((r.doc_id or 0, r.n_tokens, r.log_likelihood) for r in df.collect())
    known = key(maskedlm.score(spoken, model))
    for most in (0, 40, 500):
        monkeypatch.setattr(maskedlm, "KNOWN", most)
        assert key(maskedlm.score(spoken, model)) == known


def test_masked_training_does_not_depend_on_partitions(spark, spoken, monkeypatch):
    monkeypatch.setattr(maskedlm, "EXAMPLES", 300)
    a, b = maskedlm.train(spoken.repartition(1)), maskedlm.train(spoken.repartition(13, "text").withColumn("key", F.lit("clash")))
    assert a.own == b.own and np.array_equal(a.flat, b.flat) and not np.array_equal(a.flat, maskedlm.fresh())


# --- urls


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    name, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
    return host, path, name, verdict


URLS = ["http://A.example.NET/en/1", "http://example.net/fr/1", "http://x.example.com/de/2?q=1", "http://x.example.com/en/2", "https://a.org/fr/#t", "https://a.org/en/", "http://net/", "http://net", "http://xnet/", None, "", "no scheme", "http://a.b://c/d", "http://h?x=/net/", "http://é.example.net/en/ü", "x" * 5000, "http://h.org/" + "long/" * 20000]


def test_urls(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS * 3)] + [(0, URLS[0], "h"), (None, URLS[3], "h")] + [(500 + i, f"http://site{i}.example.{'net/en' if i % 2 else 'com/de'}/{i}", "h") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = urlfilter.judge(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, u, _ in rows:
        host, path, name, verdict = plain_rule(u)
        assert (by[i].host, by[i].path, by[i].rule) == (host, path, name)
        assert by[i].verdict == verdict if verdict else by[i].verdict in ("allow", "block")
    assert by[11].score is not None or by[11].rule is None
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_url_model(spark):
    """Witten-Bell probabilities against a plain computation."""
    urls = ["aab", "abb", "b.a"]
    counts = Counter()
    for u in urls:
        line = "^" * urlfilter.ORDER + u
        counts.update(line[i : i + urlfilter.ORDER + 1] for i in range(len(u)))
    df = spark.createDataFrame([(g, n) for g, n in counts.items()] + [("^^^z", 0)], "gram string, n long")

    def p(gram):
        out = 1 / (len(urlfilter.ALPHABET) + 1)
        for order in range(urlfilter.ORDER + 1):
            c = gram[urlfilter.ORDER - order : urlfilter.ORDER]
            seen = Counter()
            for g, n in counts.items():
                if g[urlfilter.ORDER - order : urlfilter.ORDER] == c:
                    seen[g[-1]] += n
            total, kinds = sum(seen.values()), len(seen)
            if total:
                out = (seen[gram[-1]] + kinds * out) / (total + kinds)
        return out

    for r in urlfilter._model(df, True).collect():
        assert abs(r.p - p(r.gram)) < 1e-12


def plain_symbols(url):
    return "".join("0" if "0" <= c <= "9" else c if c in urlfilter.ALPHABET else "~" for c in (url or "").lower())


def test_url_verdicts_are_those_of_a_plain_computation(spark, monkeypatch):
    """Held-out calibration and verdicts, with broadcast tables and without."""
    rng = np.random.default_rng(5)
    names = ["".join(rng.choice(list("abc"), 6)) for _ in range(30)]
    urls = [f"http://{rng.choice(names)}.example.{rng.choice(['net/en', 'com/de', 'org/fr', 'com/en', 'org/f'])}/{rng.choice(['pills', 'news', 'spam'])}?{rng.integers(99)}" for _ in range(400)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    held = {r.url: r.h for r in df.select("url", urlfilter.held_out(F.col("url")).alias("h")).collect()}
    counts = {"allow": defaultdict(Counter), "block": defaultdict(Counter)}  # context of any length to next symbols
    order = urlfilter.ORDER
    for u in urls:
        verdict = plain_rule(u)[3]
        if verdict and not held[u]:
            line = "^" * order + plain_symbols(u)
            for i in range(order, len(line)):
                for k in range(order + 1):
                    counts[verdict][line[i - k : i]][line[i]] += 1

    def p(kind, gram):
        out = 1 / (len(urlfilter.ALPHABET) + 1)
        for k in range(order + 1):
            seen = counts[kind][gram[order - k : order]]
            if total := sum(seen.values()):
                out = (seen[gram[-1]] + len(seen) * out) / (total + len(seen))
        return out

    def score(u):
        line = "^" * order + plain_symbols(u)
        grams = [line[i - order : i + 1] for i in range(order, len(line))]
        return math.floor(sum(round(math.log(p("allow", g) / p("block", g)) * 1e6) for g in grams) / len(grams))

    tried = [(plain_rule(u)[3], score(u) // urlfilter.BIN) for u in urls if held[u] and plain_rule(u)[3]]
    bad, good = ([b for v, b in tried if v == kind] for kind in ("block", "allow"))
    least = max(sorted({b for _, b in tried}), key=lambda x: round(sum(b < x for b in bad) / len(bad) - sum(b < x for b in good) / len(good), 12)) * urlfilter.BIN
    want = {i: plain_rule(u)[3] or ("block" if score(u) < least else "allow") for i, u in enumerate(urls)}
    assert {r.page_id: r.verdict for r in urlfilter.judge(df).collect()} == want and "block" in {want[i] for i, u in enumerate(urls) if not plain_rule(u)[3]}
    monkeypatch.setattr(urlfilter, "BROADCAST_GRAMS", 0)
    assert {r.page_id: r.verdict for r in urlfilter.judge(df).collect()} == want


# --- archive


def test_warc(spark, tmp_path):
    rows = [(3, "http://a/", "same", 1), (1, "http://b/", "same", 1), (2, None, None, 1), (5, "u\r\nx", "", 1), (7, "u", "é" * 30000, 1), (1, "http://b/", "same", 1), (None, "n", "same", 1), (None, "n", "alone", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to int")
    path = f"{tmp_path}/w"
    warc.write_archive(df, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    got = {(r.page_id, r.payload_bytes, r.payload_digest): (r.record_type, r.refers_to) for r in warc.describe(warc.read_archive(spark, path)).collect()}
    for page_id, _, html, _ in rows:
        payload = (html or "").encode()
        same = [i for i, _, h, _ in rows if (h or "") == (html or "") and i is not None]
        first = min(same, default=None)
        revisit = first is not None and page_id != first
        assert got[page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()] == (("revisit", first) if revisit else ("response", None))
    records = [bytes(r.record) for r in warc.record_bytes(warc.read_archive(spark, path)).collect()]
    assert len(records) == len(rows) and sum(b"same" in r for r in records) == 2
    for r in records:
        head, rest = r.split(b"\r\n\r\n", 1)
        length = int([x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")][0].split()[1])
        assert rest == rest[:length] + b"\r\n\r\n"
    warc.write_archive(df.limit(0), f"{tmp_path}/e")
    assert warc.read_archive(spark, f"{tmp_path}/e").count() == 0
    warc.write_archive(df, f"{tmp_path}/l", least=10)
    assert {r.record_type for r in warc.describe(warc.read_archive(spark, f"{tmp_path}/l")).where("payload_bytes < 10").collect()} == {"response"}


def test_a_changed_byte_of_a_stored_payload_fails_whoever_reads(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = f"{tmp_path}/w"
    warc.write_archive(spark.createDataFrame([(1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>two</p>")], "page_id long, url string, html string").coalesce(1), path)
    told = warc.describe(warc.read_archive(spark, path))
    assert told.count() == 2 and "sha2" in told._jdf.queryExecution().optimizedPlan().toString()
    part = next(p for p in (tmp_path / "w" / "payloads").iterdir() if p.suffix == ".parquet" and pq.read_table(p).num_rows)
    table = pq.read_table(part)
    at = table.column_names.index("payload")
    changed = [bytes([v[0] ^ 1]) + v[1:] for v in table.column("payload").to_pylist()]
    pq.write_table(table.set_column(at, table.schema.field("payload"), pa.array(changed, pa.binary())), part)
    for crc in (tmp_path / "w" / "payloads").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="does not match its digest"):
        warc.describe(warc.read_archive(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()


def test_warc_urls_cannot_forge_headers(spark, tmp_path):
    urls = [f"http://a/{end}X-Refers-To-Page: 7{end}WARC-Payload-Digest: sha1:AAAA{end}{end}WARC-Type: revisit" for end in ("\u2028", "\u2029", "\x85", "\n", "\r", "\r\n", "\x0b", "\x0c")]
    urls += ["X-Page-ID: 99", "a: b: c", " ", "WARC-Type: revisit", "http://x/" + "y" * 70000, None]
    df = spark.createDataFrame([(i, u, f"page {i}", "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, sha256 string, head string")
    warc.write_archive(df, f"{tmp_path}/a")
    back = warc.read_archive(spark, f"{tmp_path}/a")
    got = {r.page_id: r for r in warc.describe(back).collect()}
    assert sorted(got) == list(range(len(urls))) and all(r.record_type == "response" and r.refers_to is None for r in got.values())
    assert got[8].url == "X-Page-ID: 99" and got[13].url == "" and len(got[12].url) == 70009
    for r in warc.record_bytes(back).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert rest.startswith(b"page ") and len(head.decode().splitlines()) == len(head.split(b"\r\n")) == 9
