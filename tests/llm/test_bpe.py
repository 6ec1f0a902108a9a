import hashlib
import random

from quillstack.llm import bpe, editcount


def test_transducer_matches_merges(tokenizer, reference_encoding):
    machine = bpe.Transducer(bpe.read_ranks(tokenizer[0]), tokenizer[1])
    random.seed(1)
    for letters in ("ab", "a ", "aAé 1\n", "‍🏴é́ñ日本語", "0123456789", "'rellve t", "the in"):
        for _ in range(120):
            text = "".join(random.choice(letters) for _ in range(random.randint(0, 150)))
            assert machine.encode(text) == reference_encoding.encode_ordinary(text)


def test_small_tables_change_nothing(tokenizer, reference_encoding, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 20)
    monkeypatch.setattr(bpe, "MAX_PIECES", 3)
    machine = bpe.Transducer(bpe.read_ranks(tokenizer[0]), tokenizer[1])
    random.seed(2)
    for _ in range(60):
        text = "".join(random.choice("the aingé ") for _ in range(200))
        assert machine.encode(text) == reference_encoding.encode_ordinary(text)


def test_utf8_machine():
    data = "aé日\U0001f600".encode() + b"\xff\xe6\x97" + b"z" + b"\xf0\x9f"
    for step in (1, 2, 3, 5):
        machine = bpe.Utf8Machine()
        out = "".join(machine.feed(data[i : i + step]) for i in range(0, len(data), step)) + machine.finish()
        assert out == data.decode("utf-8", "replace")


def test_utf8_machine_on_any_bytes():
    random.seed(7)
    some = [0x41, 0x7F, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC0, 0xC2, 0xDF, 0xE0, 0xE1, 0xED, 0xEF, 0xF0, 0xF1, 0xF4, 0xF5, 0xFF]
    for _ in range(3000):
        data = bytes(random.choice(some) for _ in range(random.randint(0, 12)))
        cuts = sorted(random.randint(0, len(data)) for _ in range(3))
        machine = bpe.Utf8Machine()
        parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]
        assert "".join(map(machine.feed, parts)) + machine.finish() == data.decode("utf-8", "replace")


def test_stream_decoder_on_any_ids(monkeypatch):
    import numpy as np

    monkeypatch.setattr(bpe, "CHUNK", 3)
    random.seed(8)
    tokens = dict(enumerate([b"a", b" b", "é".encode(), b"\xc3", b"\xa9", b"\xe6\x97", b"\xa5x", b"\xff", b"z\xf0", b"\x9f\x98", b"\x80"]))
    machine = bpe.StreamDecoder(tokens)
    for _ in range(3000):
        ids = [random.randrange(len(tokens)) for _ in range(random.randint(0, 12))]
        assert machine.decode(np.array(ids, np.int32)) == b"".join(tokens[i] for i in ids).decode("utf-8", "replace")


def test_digests(spark, odd, tokenizer, reference_encoding):
    got = sorted(map(tuple, bpe.digests(spark, odd, *tokenizer).collect()), key=str)
    want = []
    for r in odd.select("doc_id", "text").collect():
        ids = reference_encoding.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest(), True))
    assert got == sorted(want, key=str)
    assert bpe.digests(spark, odd.limit(0), *tokenizer).collect() == []


def test_encode_keeps_columns(spark, odd, tokenizer):
    coded = bpe.encode(spark, odd, *tokenizer)
    assert sorted(coded.columns) == sorted(odd.columns)
    back = bpe.decode(spark, coded, tokenizer[0], as_text=True, into="back")
    assert all(r.back == (r.text or "") for r in back.collect())


def test_edit_counts(tokenizer, reference_encoding, monkeypatch):
    machine = bpe.Transducer(bpe.read_ranks(tokenizer[0]), tokenizer[1])
    counts = editcount.Counts(machine)
    random.seed(3)
    parts = ["a", "b ", " ", "  ", "\n", "'", "l", "ll", "re", "1", "é", ".", " the", "   "]
    make = lambda n: "".join(random.choice(parts) for _ in range(n))
    for leaf in (1, 3, 32):
        monkeypatch.setattr(editcount, "LEAF", leaf)
        for _ in range(250):
            text = make(random.choice([0, 1, 5, 60, 300]))
            tree = editcount.build(text, machine.pattern, counts)
            for _ in range(4):
                a = random.randint(0, len(text) + 2)
                text, _ = editcount.apply_edit(text, tree, a, a + random.choice([0, 0, 1, 3, 20]), make(random.choice([0, 1, 2, 10])), machine.pattern, counts)
                assert tree.total() == len(reference_encoding.encode_ordinary(text)) and tree.chars == len(text)


def test_edits_make_few_nodes_anew():
    random.seed(4)
    for size in (1, 2, 7, 1000, 5000):
        leaves = [(random.randint(0, 9), random.randint(0, 9)) for _ in range(size)]
        tree = editcount.CountTree([c for c, _ in leaves], [t for _, t in leaves])
        for _ in range(60):
            first = random.randint(0, len(leaves))
            last, new = min(len(leaves), first + random.randint(0, 4)), [(random.randint(0, 9), random.randint(0, 9)) for _ in range(random.randint(0, 6))]
            tree.made, leaves[first:last] = 0, new
            tree.splice(first, last, [c for c, _ in new], [t for _, t in new])
            assert tree.own() == ([c for c, _ in leaves], [t for _, t in leaves]) and tree.total() == sum(t for _, t in leaves)
            assert tree.made <= 12 * max(1, len(leaves)).bit_length() + 4 * len(new) + 12  # paths, not the tree
            depth, level = 0, [tree.root] if tree.root else []
            while level:
                depth, level = depth + 1, [n for x in level if x.left is not None for n in (x.left, x.right)]
            assert depth <= 3 * max(1, len(leaves)).bit_length() + 1


def test_edit_jobs(spark, odd, tokenizer, reference_encoding):
    trees = editcount.with_trees(odd, *tokenizer)
    edits = spark.createDataFrame([(1, 2, 4, 4, "quick "), (1, 1, 0, 3, "A"), (3, 1, 0, 99, "new text"), (5, 1, 100, None, " "), (6, 1, None, 4, "x")], "doc_id long, seq int, start int, stop int, new string")
    done = editcount.apply_edits(editcount.with_edits(trees, edits), *tokenizer).collect()
    assert len(done) == odd.count()
    assert all(r.n_tokens == len(reference_encoding.encode_ordinary(r.text)) for r in done)
    texts = {r.doc_id: r.text for r in done}
    assert texts[1].startswith("A qu") and texts[3] == "new text" and texts[5][100] == " " and texts[2] == ""
    assert {r.doc_id: r.n_encoded for r in done}[6] == 0
    own = editcount.apply_edits(editcount.own_edits(trees), *tokenizer).collect()
    assert all(r.n_tokens == len(reference_encoding.encode_ordinary(r.text)) for r in own)
    assert editcount.apply_edits(editcount.own_edits(trees.limit(0)), *tokenizer).count() == 0
