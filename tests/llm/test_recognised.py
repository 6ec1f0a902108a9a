import numpy as np

from quillstack.llm import hyperlang

EN = "the quick brown fox jumps over the lazy dog and then goes home with his friends to sleep"
DE = "der schnelle braune fuchs springt über den faulen hund und geht dann mit seinen freunden nach hause"


def test_unlearned_scripts_go_and_short_clean_texts_stay(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(400):
        words = (EN if i % 2 else DE).split()
        rows.append((i, " ".join(rng.permutation(words)[: 2 if i % 4 > 1 else 12]), "en" if i % 2 else "de"))
    for k, (first, last) in enumerate([(0x430, 0x44F), (0x3B1, 0x3C9), (0x4E00, 0x5E00)]):
        for i in range(40):
            size = 10 if i % 2 else 300
            rows.append((10_000 + 100 * k + i, "".join(map(chr, rng.integers(first, last + 1, size))), None))
    for i in range(40):  # Latin letters at random, as long as the long clean texts
        rows.append((20_000 + i, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 64)), None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in hyperlang.keep_identified(docs).collect()}
    assert not {i for i in kept if 10_000 <= i < 20_000}
    assert len({i for i in kept if i < 400}) >= 396
    assert len({i for i in kept if i >= 20_000}) <= 2
