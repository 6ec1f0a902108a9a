import numpy as np
import pytest

from quillstack.llm import kneser_ney


@pytest.mark.parametrize("trusted", [2, 20, 60])
def test_quality_with_few_trusted_documents(spark, trusted):
    """The production TRAIN_DOCS exceeds the trusted documents, and junk is rejected all the same."""
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words, 60)), "en") for i in range(120)] + [(1000 + i, " ".join(f"%{rng.integers(1e9)}%" for _ in range(60)), "en") for i in range(10)]
    rows += [(2000 + i, t, "en") for i, t in enumerate([None, "", " \n"])]  # trusted, without words
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(trusted)] + [(2000, 1), (2001, 1), (2002, 1)], "doc_id long, quality int")
    assert trusted < kneser_ney.TRAIN_DOCS
    got = {r.doc_id: r for r in kneser_ney.judge(docs, labels).collect()}
    assert len(got) == len(rows) and all(r.threshold is not None for r in got.values())
    assert not any(r.keep for i, r in got.items() if i >= 1000)
    assert sum(got[i].keep for i in range(120)) >= (115 if trusted > 2 else 1)


def test_quality_with_one_trusted_document(spark):
    docs = spark.createDataFrame([(1, "a b c", "en"), (2, "%% %%", "en"), (3, " ", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, quality int")
    assert {r.doc_id: r.keep for r in kneser_ney.judge(docs, labels).collect()} == {1: True, 2: True, 3: False}


def test_all_trusted_documents_teach_or_are_compared(spark, monkeypatch):
    """Beyond TRAIN_DOCS the whole half still trains the model."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"word{i % 7} word{i % 5} word{i % 3}", "en") for i in range(80)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(80)], "doc_id long, quality int")
    taught, plain = [], kneser_ney.train

    def noted(rows):
        taught.extend(r.doc_id for r in rows.select("doc_id").collect())
        return plain(rows)

    monkeypatch.setattr(kneser_ney, "train", noted)
    monkeypatch.setattr(kneser_ney, "TRAIN_DOCS", 10)
    got = kneser_ney.judge(docs, labels).collect()
    assert sorted(taught) == sorted(r.doc_id for r in docs.where(F.xxhash64("doc_id") < 0).collect()) and len(taught) > 20
    assert len(got) == 80 and all(r.threshold is not None for r in got)


def test_large_tables_give_the_same_and_leave_no_shuffle_files(spark, monkeypatch):
    """Tables joined by shuffle, part after part, and words without a number: results stay the same, and no part's shuffle files outlive it."""
    import glob

    rng = np.random.default_rng(8)
    words = [f"word{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 60))), "en") for i in range(60)] + [(100, "% %% %", None), (101, None, "en"), (102, "word1", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int")
    told = lambda: sorted((r.doc_id, r.n_words, r.log_perplexity, r.bound, r.threshold, r.keep) for r in kneser_ney.judge(docs, labels).collect() if r.doc_id != 101)
    want = told()
    folders = [f.toString() for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: sum(len(glob.glob(f"{f}/*/shuffle_*.data")) for f in folders)
    monkeypatch.setattr(kneser_ney, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(kneser_ney, "NUMBERED", 7)
    before = files()
    assert told() == want and files() <= before + 8  # what counts and first() ask for may stay


def test_positions_move_in_chunks(spark, monkeypatch):
    """Many groups and parts give what one gives, and what is shuffled is rows of chunks, far fewer than positions."""
    rng = np.random.default_rng(9)
    words = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 300))), "en") for i in range(200)] + [(900, "word1 \x0b word2\u00a0x " + "long" * 50, "en"), (901, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(160)], "doc_id long, quality int")
    told = lambda: sorted((r.doc_id, r.n_words, r.log_perplexity, r.bound, r.threshold, r.keep) for r in kneser_ney.judge(docs, labels).where("doc_id < 901").collect())
    want = told()
    assert [r[1] for r in want] == [len(t.encode().split()) for _, t, _ in rows[:-1]]
    seen, plain = [], kneser_ney._meet

    def met(chunks, tasks):
        seen.append(chunks.count())
        return plain(chunks, tasks)

    monkeypatch.setattr(kneser_ney, "_meet", met)
    for c, n in (("BROADCAST_ROWS", 0), ("GROUP", 2_000), ("NUMBERED", 100), ("PARTS", 3)):
        monkeypatch.setattr(kneser_ney, c, n)
    assert told() == want
    assert len(seen) == 5 and max(seen) < sum(r[1] for r in want) / 20


def test_words_are_those_of_split():
    import pyarrow as pa

    texts = [b"a b c", None, b"", b" \n\x1c\x0b", b"x" * 200 + b" " + b"x" * 199 + b"y", b"a", b"b", b"  a\tb", "caf\u00e9 \u00a0".encode(), b"bad \xff end"]
    held = pa.array(texts, pa.binary()).view(pa.string())
    h, n = kneser_ney.hashes_of(held.slice(0))
    want = [(t or b"").decode("utf-8", "replace").encode().split() for t in texts]
    assert n.tolist() == [len(t) for t in want] and (h < 0).all()
    flat = [w for t in want for w in t]
    assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))
    assert kneser_ney.hashes_of(held.slice(5))[0].tolist() == h[n[:5].sum() :].tolist()
