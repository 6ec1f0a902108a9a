"""Masked pseudo-likelihood with a bidirectional window network in numpy.

The network predicts a token from the ``SIDE`` tokens before it and the ``SIDE`` after it: their
embeddings, side by side, go through one hidden layer to a class and to a word within the class. A
document's score is the sum over all its tokens of the log probability of the token given its window.

Every word of the corpus is counted by Spark. The ``WORDS - SHARED`` most frequent ones have entries of
their own in the network; all others share ``SHARED`` entries by a hash, and the score of such a token adds
the log probability of the word within its entry, (n + 1) / (all of the entry + its words + 1), from the
table of counts: tasks know the ``KNOWN`` most frequent of them, the others are joined by Spark. So a score is a probability of words, not of entries.

Training masks a share ``MASKED`` of the positions of every document, chosen by a hash of their place.
These examples are dealt to shards by a hash of the document; there are as many shards as make about
``EXAMPLES`` each, so their number grows with the corpus. In each of ``ROUNDS`` rounds a copy of the network
is trained on each shard of the round, in the order of the documents' hashes, and Spark averages the copies
number by number, weighted by their steps; each document is in one round. What is gathered (the counts,
one copy for each shard) grows with the corpus; what the driver gets is one network and the hashes and logs of
``KNOWN`` words. The result depends on the rows alone, not on how they are dealt out or when tasks run.

Words are what blanks (\\x20, \\x09-\\x0D) part, A-Z in lower case, of any length. Defined cases: ill-formed UTF-8 counts as U+FFFD; null texts
and texts without words have no tokens, sum 0 and a null mean; repeated rows give repeated rows; an empty
table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import cut, text_of

SIDE, CLASSES, EMBED, HIDDEN = 2, 32, 16, 24
WORDS = CLASSES * CLASSES
#: Entries of the vocabulary that rare words share.
SHARED = 64
ROUNDS, MASKED, BATCH, RATE, SEED = 2, 0.15, 1024, 0.2, 11
#: A shard is gone through again until it has given so many steps.
STEPS = 64
#: Examples in a shard, about; positions scored at once; words whose number a task remembers.
EXAMPLES, CHUNK, MEMO = 1 << 18, 1 << 14, 300_000
#: Words without entries whose log within the entry all tasks know, at most; tokens whose words are counted at once.
KNOWN, COUNTED = 1 << 18, 1 << 21
UNIT = 1 << 24
SHAPES = {"embed": (WORDS + 1, EMBED), "w": (2 * SIDE * EMBED, HIDDEN), "b": (HIDDEN,), "cw": (HIDDEN, CLASSES), "cb": (CLASSES,), "ww": (CLASSES, HIDDEN, CLASSES), "wb": (CLASSES, CLASSES)}
NUMBERS = sum(int(np.prod(s)) for s in SHAPES.values())


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


class _Hashes(dict):
    """Word (bytes) to its hash as Spark's xxhash64 gives it."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word, 42)
        found -= found >> 63 << 64
        if len(self) < MEMO:
            self[word] = found
        return found


class Vocabulary(dict):
    """Word (bytes) to number; words without an entry share the last ones."""

    def __init__(self, own: list[int]):
        super().__init__()
        self.own = {h: i for i, h in enumerate(own)}

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word, 42)
        number = self.own.get(found - (found >> 63 << 64), WORDS - SHARED + found % SHARED)
        if len(self) < MEMO:
            self[word] = number
        return number

    def numbers(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Entries(dict):
    """Word (bytes) to code: its number, or a place behind WORDS among the known words and then those that are ``late``, met since that was emptied."""

    def __init__(self, own: list[int], known: np.ndarray):
        super().__init__()
        self.codes = {h: i for i, h in enumerate(own)} | {h: WORDS + i for i, h in enumerate(known.tolist())}
        self.first, self.late = WORDS + len(known), []

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word, 42)
        found -= found >> 63 << 64
        code = self.codes.get(found)
        if code is None:
            self.late.append(found)
            return self.first + len(self.late) - 1
        self[word] = code
        return code

    def of(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and key, a 64-bit hash of both: the same for rows that are alike."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("key"))


def counts_by_document(docs: DataFrame) -> DataFrame:
    """key, word (its hash) and c, how often it occurs, for each distinct word of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in batches:
            rows, words, counts = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for text in batch.column(1):
                parts = words_of(text_of(text))
                found, c = np.unique(np.fromiter(map(memo.__getitem__, parts), np.int64, len(parts)), return_counts=True)
                rows.append(len(found))
                words.append(found)
                counts.append(c)
            again = pa.array(np.repeat(np.arange(len(rows)), rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(again), pa.array(np.concatenate(words)), pa.array(np.concatenate(counts).astype(np.int32))], names=["key", "word", "c"])

    return keyed(docs).select("key", "text").mapInArrow(run, "key long, word long, c int")


def count_words(docs: DataFrame) -> DataFrame:
    """word (its hash) and n, how often it occurs. A task sends a row for each distinct word of about COUNTED tokens."""

    def told(held: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held, size = _Hashes(), [], 0
        for batch in batches:
            for text in batch.column(0):
                parts = words_of(text_of(text))
                held.append(np.fromiter(map(memo.__getitem__, parts), np.int64, len(parts)))
                size += len(parts)
                if size >= COUNTED:
                    yield told(held)
                    held, size = [], 0
        yield told(held)

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """own: hashes of the words with entries of their own. counts: word, n of all words."""

    own: list[int]
    flat: np.ndarray
    counts: DataFrame


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def fresh() -> np.ndarray:
    net = unpack(flat := np.zeros(NUMBERS, np.float32))
    rng = np.random.default_rng(SEED)
    for name, scale in (("embed", 0.1), ("w", 0.15), ("cw", 0.1), ("ww", 0.1)):
        net[name][...] = rng.standard_normal(SHAPES[name]) * scale
    return flat


def windows(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers of the tokens round the places ``at``; padded has SIDE blanks (WORDS) round each text."""
    offsets = [d for d in range(-SIDE, SIDE + 1) if d]
    return padded[at[:, None] + np.array(offsets)]


def _softmax_log(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def _picked(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log softmax of each column of x at one place of it. x is used up."""
    x -= x.max(axis=0)
    out = x[at, np.arange(len(at))].astype(np.float64)
    return out - np.log(np.exp(x, out=x).sum(axis=0))


def log_probabilities(net: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p(target | context) for each row. Rows go by class, and along the last axis."""
    sides = net["w"].reshape(2 * SIDE, EMBED, HIDDEN)
    hidden = np.tanh(sum((net["embed"] @ w)[context[:, i]] for i, w in enumerate(sides)) + net["b"])
    kind = target // CLASSES
    order = np.argsort(kind, kind="stable")
    kind, word, hidden = kind[order], target[order] % CLASSES, np.ascontiguousarray(hidden[order].T)
    bounds = np.searchsorted(kind, np.arange(CLASSES + 1))
    held = _picked(net["cw"].T @ hidden + net["cb"][:, None], kind)
    for c in np.flatnonzero(np.diff(bounds)):
        some = slice(bounds[c], bounds[c + 1])
        held[some] += _picked(net["ww"][c].T @ hidden[:, some] + net["wb"][c][:, None], word[some])
    out = np.empty_like(held)
    out[order] = held
    return out


class Trainer:
    """Adagrad on one copy of the network."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat.copy()
        self.net, self.seen = unpack(self.flat), unpack(np.full(NUMBERS, 1e-3, np.float32))

    def _move(self, name: str, at, gradient: np.ndarray) -> None:
        seen = self.seen[name]
        seen[at] += gradient * gradient
        self.net[name][at] -= RATE * gradient / np.sqrt(seen[at])

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        net, n = self.net, len(target)
        inputs = net["embed"][context].reshape(n, -1)
        hidden = np.tanh(inputs @ net["w"] + net["b"])
        kind, word = np.divmod(target, CLASSES)
        up = np.exp(_softmax_log(hidden @ net["cw"] + net["cb"]))
        up[np.arange(n), kind] -= 1
        up /= n
        down = up @ net["cw"].T
        moves = [("cw", ..., hidden.T @ up), ("cb", ..., up.sum(axis=0))]
        order = np.argsort(kind, kind="stable")
        bounds = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        for c in np.flatnonzero(np.diff(bounds)):
            rows = order[bounds[c] : bounds[c + 1]]
            up = np.exp(_softmax_log(hidden[rows] @ net["ww"][c] + net["wb"][c]))
            up[np.arange(len(rows)), word[rows]] -= 1
            up /= n
            down[rows] += up @ net["ww"][c].T
            moves += [("ww", c, hidden[rows].T @ up), ("wb", c, up.sum(axis=0))]
        down *= 1 - hidden * hidden
        moves += [("w", ..., inputs.T @ down), ("b", ..., down.sum(axis=0))]
        spread = (down @ net["w"].T).reshape(-1, EMBED)
        numbers, back = np.unique(context.reshape(-1), return_inverse=True)
        cells = back.reshape(-1, 1) * EMBED + np.arange(EMBED)
        gradient = np.bincount(cells.reshape(-1), spread.reshape(-1), len(numbers) * EMBED).reshape(-1, EMBED)
        moves.append(("embed", numbers, gradient.astype(spread.dtype)))
        for move in moves:
            self._move(*move)


def _padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in a row with blanks round each; where their tokens are; how many each has."""
    blank = np.full(SIDE, WORDS)
    line = np.concatenate([x for p in parts for x in (p, blank)]) if parts else np.zeros(0, int)
    line = np.concatenate([blank, line])
    return line, np.flatnonzero(line != WORDS), np.array([len(p) for p in parts])


def examples(docs: DataFrame, own: list[int], shards: int) -> DataFrame:
    """round, shard, key and blob for every row: the masked positions' windows and targets as 16-bit numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Vocabulary(shared.value)
        for batch in batches:
            line, places, sizes = _padded([table.numbers(text_of(t)) for t in batch.column(1)])
            order = np.concatenate([np.arange(n) for n in sizes]) if len(sizes) else places  # place within the text
            chosen = (order * 2654435761 + line[places] * 40503) % 1000 < 1000 * MASKED
            rows = np.column_stack([windows(line, places[chosen]), line[places[chosen]]]).astype(np.int16)
            ends = np.concatenate([[0], np.cumsum(chosen)])[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)].tolist()
            blobs = [rows[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["key", "blob"])

    rows = keyed(docs.where("text IS NOT NULL")).select("key", "text").mapInArrow(run, "key long, blob binary").where("octet_length(blob) > 0")
    return rows.select(F.pmod("key", F.lit(ROUNDS)).cast("int").alias("round"), F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "key", "blob")


def _learner(shared):
    """Trains a copy of the network on a shard's examples (key, blob)."""

    def learn(group):
        group = group.sort_by([("key", "ascending"), ("blob", "ascending")])
        rows = np.concatenate([np.frombuffer(b.as_py(), np.int16).reshape(-1, 2 * SIDE + 1) for b in group.column("blob")]).astype(np.int64)
        rows = rows[np.random.default_rng(SEED).permutation(len(rows))]
        copy, steps = Trainer(shared.value), 0
        while steps < STEPS:
            for at in range(0, len(rows), BATCH):
                copy.step(rows[at : at + BATCH, :-1], rows[at : at + BATCH, -1])
                steps += 1
        weighted = np.rint(copy.flat.astype(np.float64) * UNIT).astype(np.int64) * steps
        return pa.table({"at": pa.array(np.arange(NUMBERS, dtype=np.int32)), "value": pa.array(weighted), "steps": pa.array(np.full(NUMBERS, steps, np.int64))})

    return learn


def train(docs: DataFrame) -> Model:
    """The model of docs (doc_id, text)."""
    spark, flat = docs.sparkSession, fresh()
    counts = cut(count_words(docs), "counts")
    own = [r.word for r in counts.orderBy(F.desc("n"), "word").limit(WORDS - SHARED).collect()]
    tokens = counts.agg(F.sum("n")).first()[0] or 0
    shards = max(1, round(tokens * MASKED / ROUNDS / EXAMPLES))
    dealt = cut(examples(docs, own, shards), "examples")
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast(flat)
        copies = dealt.where(F.col("round") == k).select("shard", "key", "blob").groupBy("shard").applyInArrow(_learner(shared), "at int, value long, steps long")
        mean = copies.groupBy("at").agg(F.sum("value").alias("value"), F.sum("steps").alias("steps"))
        for row in mean.toLocalIterator():  # NUMBERS rows
            flat[row["at"]] = row["value"] / row["steps"] / UNIT
    return Model(own, flat, counts)


def within_entries(counts: DataFrame, own: list[int]) -> DataFrame:
    """word, n and micro, the log of p(word | entry) in whole millionths, so that sums do not depend on their order; words without entries of their own."""
    mine = F.broadcast(counts.sparkSession.createDataFrame([(w,) for w in own], "word long"))  # WORDS rows at most
    rare = counts.join(mine, "word", "left_anti").withColumn("entry", F.col("word").bitwiseAND(F.lit(SHARED - 1)))
    whole = rare.groupBy("entry").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))  # SHARED rows at most
    log = F.log((F.col("n") + 1) / (F.col("all") + F.col("kinds") + 1))
    return rare.join(F.broadcast(whole), "entry").select("word", "n", F.round(log * 1_000_000).cast("long").alias("micro"))


def _least(rare: DataFrame) -> int:
    """Words that occur so often are KNOWN at most."""
    held, least = 0, 1
    for r in rare.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():  # different numbers of occurrences
        held += r["count"]
        if held > KNOWN:
            return r["n"] + 1
    return least


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (nats, summed over all tokens) and mean_log_likelihood. docs: those of train()."""
    rare = cut(within_entries(model.counts, model.own), "rare")
    least = _least(rare)
    known = rare.where(F.col("n") >= least).toArrow()  # KNOWN rows at most
    words, micros = known["word"].to_numpy(), known["micro"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast((model.own, model.flat, words, micros))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, numbers, words, micros = shared.value
        table, net = Entries(own, words), unpack(numbers)
        entry = lambda h: WORDS - SHARED + (h & (SHARED - 1))
        entries, logs_within = np.concatenate([np.arange(WORDS), entry(words)]), np.concatenate([np.zeros(WORDS, np.int64), micros])
        for batch in batches:
            table.late.clear()
            parts = [table.of(text_of(t)) for t in batch.column(1)]
            codes, late = np.concatenate([np.zeros(0, np.int64), *parts]), np.array(table.late, np.int64)
            found = np.concatenate([entries, entry(late)])[codes]
            ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            line, places, sizes = _padded([found[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
            logs, seldom, within, tail = np.zeros(len(places) + 1), *np.zeros((3, len(places) + 1), np.int64)
            seldom[1:] = np.cumsum(found >= WORDS - SHARED)
            within[1:] = np.cumsum(np.concatenate([logs_within, np.zeros(len(late), np.int64)])[codes])
            tail[1:] = np.cumsum(codes >= table.first)
            for at in range(0, len(places), CHUNK):
                some = places[at : at + CHUNK]
                logs[at + 1 : at + 1 + len(some)] = log_probabilities(net, windows(line, some), line[some])
            sums = [float(logs[a + 1 : b + 1].sum()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            tails = pa.ListArray.from_arrays(pa.array(tail[ends], pa.int32()), pa.array(late))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(np.diff(seldom[ends])), pa.array(sums, pa.float64()), pa.array(np.diff(within[ends])), tails]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "rare", "sum", "micro", "late"])

    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, rare long, sum double, micro long, late array<long>")
    if least > 1:
        told = cut(told.withColumn("row", F.monotonically_increasing_id()), "scored")
        late = told.select("row", F.explode("late").alias("word")).join(rare.where(F.col("n") < least).hint("shuffle_hash"), "word")  # one row a word on that side, spread evenly: nothing need be sorted
        told = told.join(late.groupBy("row").agg(F.sum("micro").alias("more")), "row", "left").withColumn("micro", F.col("micro") + F.coalesce("more", F.lit(0)))
    inner = F.when(F.col("rare") > 0, F.col("rare") * (F.col("micro") / F.col("rare") / 1_000_000)).otherwise(F.lit(0.0))
    whole = F.col("sum") + inner
    return told.select("doc_id", "n_tokens", whole.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, whole / F.col("n_tokens")).alias("mean_log_likelihood"))
