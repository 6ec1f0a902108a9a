"""Quality classifier: interpolated modified Kneser-Ney trigrams trained on trusted text.

The NUMBERED most frequent words of the trusted texts are known by small numbers, others by a 64-bit hash, and every
text is stored once as an array of these. The logarithm of an interpolated probability is a sum of weights, one for the word, one for
its pair if the model has it, one for its triple if the model has it, and one for each context that is known:

    -log p(w | u, v) = U(w) + [G2(v)] + [E2(v, w)] + [G3(u, v)] + [E3(u, v, w)]

with U = -log p(w), G the negative logarithm of what a context leaves to shorter ones, and E the logarithm of what that would give
over what the longer one gives. The context (u, v) is the pair of the position before, so G3 is added there, with the weights
of that pair. Weights of numbered words are summed where texts are coded. Counts and positions move as chunks, a row with the arrays of many of
them for each group of pairs (a hash of v and w); within a group, sorted arrays of 64-bit hashes of pairs and triples are searched. The weights
are whole micro-nats, so a sum does not depend on its order. A document is judged by its surprise: the sum of its words' nats over the number of its
distinct triples, less a slack for short texts. Of a text that says nothing twice this is the log
perplexity; of one that repeats a few words it is many times as much, however common they are. A document
passes if that is at most its language's threshold: a quantile of the trusted documents of that language
that the model was not trained on, plus a margin. The quantile of a language's few documents says little,
so it is drawn towards the quantile of all languages by the weight of ``PRIOR`` documents.

Trusted documents (of the labelled ones, those that every label calls good) that have words are split by
a hash of their doc_id at every size: the lower half trains the model and the others give the
thresholds, so there are always some. The halves are equal while one has ``TRAIN_DOCS`` documents at most; larger ones
are told apart by the sign of the hash, without an order of all. Counts, perplexities, quantiles and thresholds use all
documents; none is sampled. There is a group for every GROUP positions of the trusted texts, so a task holds one of bounded size while the chunks of positions pass by. Beyond
``BROADCAST_ROWS`` positions the groups are judged in a fixed number of parts, one after the other, so that no more than a part of all positions is on disk at once.

Defined cases: rows of one doc_id are one document; documents without words (null, empty, blanks) have
no perplexity and do not pass; a null lang is a language of its own; a language without trusted documents
for its threshold uses the quantile over all languages; distinct triples are those of a row, so repeated
rows change nothing; with fewer than two trusted documents that have words nothing can be both learned and compared, so there is no model and every document with words
passes; empty tables give empty tables.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import cut, cut_parts, discard, free_shuffles, small_batches, text_of

TRAIN_DOCS, BROADCAST_ROWS, PRIOR = 1_500, 1_000_000, 20
QUANTILE, MARGIN, SLACK = 0.995, 0.1, 4.0
MICRO = 1_000_000
#: Stands before the first word, for words that the trusted texts do not have if all of theirs are numbered (from 1), and before a word that is looked up alone. Other words are negative hashes.
START, OTHER, ALONE = 0, -1, -2
#: Words that are known by number, parts that groups are judged in, positions of trusted texts for a group, positions that a task deals at once, and rows whose sums meet.
NUMBERED, PARTS, GROUP, DEALT, ROW_BITS = 1 << 20, 12, 100_000, 1 << 19, 12
#: What a context leaves to shorter ones at least.
LEAST_LEFT = 1e-12
#: Rejected ids (8 bytes each) and thresholds are broadcast up to this many, and joined by shuffle beyond.
BROADCAST_IDS, BROADCAST_LANGS = 2_000_000, 10_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ZSTD = pa.Codec("zstd", 1)


@dataclass
class Vocabulary:
    hashes: np.ndarray  # sorted
    numbers: np.ndarray  # of each of them
    whole: bool  # whether there are no other words


@dataclass
class Words:
    """By number: the probability of each word, and the total and what is left of its pairs as a context."""

    p1: np.ndarray
    total: np.ndarray
    left: np.ndarray


@dataclass
class Model:
    vocabulary: Vocabulary
    words: Words
    discounts: list[list[float]]  # of pairs and of triples
    groups: DataFrame  # chunks: a row for each group, with its pairs and triples (PAIRS)
    rare: DataFrame | None  # chunks: words without a number, in the groups whose pairs have them (RARE), and alone
    n_groups: int
    unknown: int  # micro-nats of words without an entry
    start: int  # micro-nats of what the contexts before the first word leave
    small: bool


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, "\\s+"), "")


def _utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends. Nulls are empty, ill-formed UTF-8 counts as U+FFFD."""
    texts = texts.cast(pa.string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    try:
        data.tobytes().decode("utf-8")
    except UnicodeDecodeError:
        return _utf8(pa.array([text_of(t) for t in texts], pa.string()))
    return data, (ends - ends[0]).astype(np.int64)


def hashes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as negative hashes, sums of a random number for each byte at each place, and how many each text has."""
    data, ends = _utf8(texts)
    inside = ~_BLANK[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = ends[:-1][ends[:-1] < len(data)]
    first[begins] = inside[begins]
    starts, places = np.flatnonzero(first), np.flatnonzero(inside)
    heads = np.flatnonzero(first[places])
    at = places - np.repeat(starts, np.diff(np.append(heads, len(places))))
    key = at * 256 + data[places]
    z = _BYTES[np.minimum(key, len(_BYTES) - 1)]
    late = np.flatnonzero(key >= len(_BYTES))
    z[late] = _mix(key[late], key[late])
    h = np.add.reduceat(z, heads) if len(heads) else np.zeros(0, np.uint64)
    return (h | np.uint64(1 << 63)).view(np.int64), np.diff(np.searchsorted(starts, ends))


def numbers_of(hashes: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """The words' numbers, or the hashes of words that have none."""
    at = np.minimum(np.searchsorted(vocabulary.hashes, hashes), len(vocabulary.hashes) - 1)
    return np.where(vocabulary.hashes[at] == hashes, vocabulary.numbers[at], hashes)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair of numbers; different for all pairs of numbers under 2^21."""
    x = a.astype(np.uint64, copy=False) * _STEP + b.astype(np.uint64, copy=False)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: ASCII blanks, as in bytes.split(), and the numbers of bytes at the first places of a word.
_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_BYTES = _mix(np.arange(64 * 256), np.arange(64 * 256))


def _fold(ids: np.ndarray) -> np.ndarray:
    """32 bits of each id; numbers stay as they are."""
    return np.where(ids >= 0, ids, ids >> 31).astype(np.uint32)


def _group(pair: np.ndarray, n_groups: int) -> np.ndarray:
    return ((pair >> np.uint64(20)) % np.uint64(n_groups)).astype(np.int32)


def types_of(ids: np.ndarray) -> int:
    """How many distinct triples of words a text has."""
    padded = np.concatenate((np.zeros(2, np.int64), ids)).view(np.uint64)
    h = np.sort((padded[:-2] * _STEP + padded[1:-1]) * _STEP + padded[2:])
    return int(np.count_nonzero(h[1:] != h[:-1])) + 1


def _starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate((np.ones(min(len(sorted_keys), 1), bool), sorted_keys[1:] != sorted_keys[:-1])))


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in keys, which are sorted and not empty, and whether they hold what was asked."""
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


#: A chunk: arrays that belong to a group. Kinds are in the order in which a group reads them.
CHUNK = "group int, kind int, a binary, b binary, c binary, d binary, e binary, f binary, g binary, h binary"
_NAMES = [f.split()[0] for f in CHUNK.split(", ")]
PAIRS, RARE, LONE, POSITIONS = range(4)
TRIPLES, CONTEXTS = range(2)


def _chunk(group: list[int], kind: int, columns: list[list[bytes]]) -> pa.RecordBatch:
    binary = [pa.array(c, pa.binary()) for c in columns] + [pa.nulls(len(group), pa.binary())] * (8 - len(columns))
    return pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array([kind] * len(group), pa.int32()), *binary], names=_NAMES)


def _bytes(*arrays: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in arrays]


def _squeezed(*arrays: np.ndarray) -> list[bytes]:
    return [x.nbytes.to_bytes(8, "little") + _ZSTD.compress(x.tobytes(), asbytes=True) for x in arrays]


def _expanded(data: list, n: int) -> list[pa.Buffer]:
    """The first n arrays of a chunk that _squeezed() packed."""
    return [_ZSTD.decompress(x.slice(8), int.from_bytes(x.slice(0, 8).to_pybytes(), "little")) for x in data[:n]]


def _deal(group: np.ndarray, kind: int, *arrays: np.ndarray, pack: Callable = _bytes) -> Iterator[pa.RecordBatch]:
    """A chunk for each group that has any rows, which stay in their order."""
    if len(group):
        order = np.argsort(group, kind="stable")
        group, arrays = group[order], [x[order] for x in arrays]
        starts = _starts(group)
        ends = [*starts[1:].tolist(), len(group)]
        packed = [pack(*(x[i:j] for x in arrays)) for i, j in zip(starts.tolist(), ends, strict=True)]
        yield _chunk(group[starts].tolist(), kind, list(zip(*packed, strict=True)))


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, list]]]]:
    """Each group, and kind and buffers of its chunks."""

    def rows() -> Iterator[tuple[int, int, list]]:
        for batch in batches:
            for i, (group, kind) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                yield group, kind, [c[i].as_buffer() for c in batch.columns[2:10]]

    for group, mine in itertools.groupby(rows(), lambda r: r[0]):
        yield group, ((kind, data) for _, kind, data in mine)


def _joined(chunks: list[list], *types: type) -> list[np.ndarray]:
    """Each array of chunks, one after the other."""
    return [np.concatenate([np.zeros(0, t), *(np.frombuffer(c[k], t) for c in chunks)]) for k, t in enumerate(types)]


def _meet(chunks: DataFrame, tasks: int) -> DataFrame:
    """The chunks of each group in one task, one after the other, by kind."""
    return chunks.repartition(max(1, min(tasks, 1_000)), "group").sortWithinPartitions("group", "kind")


def _gathered(batches: Iterable[tuple[np.ndarray, ...]], most: int) -> Iterator[list[np.ndarray]]:
    """Tuples of arrays, joined until they have most elements."""
    held, size = [], 0
    for arrays in batches:
        held.append(arrays)
        size += len(arrays[0])
        if size >= most:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, size = [], 0
    if size:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def count_words(docs: DataFrame) -> DataFrame:
    """w, the hash of each word, and n, how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (held,) in _gathered(((hashes_of(batch.column(0))[0],) for batch in batches), 4 * DEALT):
            w, n = np.unique(held, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(n.astype(np.int64))], names=["w", "n"])

    return docs.select("text").where("text IS NOT NULL").mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


def number_words(counts: DataFrame) -> Vocabulary:
    """Numbers from 1, by frequency, for the words that occur so often that there are NUMBERED of them at most."""
    least, held = 1, 0
    for r in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():  # different numbers of occurrences
        held += r["count"]
        if held > NUMBERED:
            least = r["n"] + 1
            break
    most = counts.where(F.col("n") >= least).toArrow()
    w, n = most["w"].to_numpy(), most["n"].to_numpy()
    w = w[np.lexsort((w, -n))]
    order = np.argsort(w)
    return Vocabulary(w[order], order + 1, least == 1)


def coded(docs: DataFrame, vocabulary: Vocabulary, *keys: str, weights: tuple[np.ndarray, np.ndarray, int] | None = None) -> DataFrame:
    """keys, n (how many words the text has), types (its distinct triples; null without words), nats and row, a number of its own, of each row; the first of consecutive rows has ids, the words of all of them, and sizes, how many each has.

    weights: micro-nats of each number as a word and as a context, and of other words; nats is their sum.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, weights))  # NUMBERED words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = shared.value
        u, g, unknown = weights or (np.zeros(1, np.int64), np.zeros(1, np.int64), 0)
        for batch in batches:
            w, n = hashes_of(batch.column(len(keys)))
            w, ends = numbers_of(w, known), np.cumsum(n)
            types = [types_of(w[i - k : i]) if k else None for i, k in zip(ends.tolist(), n.tolist(), strict=True)]
            nats = np.zeros(len(n), np.int64)
            if weights and len(w):
                number = np.maximum(w, 0)
                each = np.where(w > 0, u[number], unknown)
                after = np.where(w > 0, g[number], 0)
                after[ends[n > 0] - 1] = 0
                sums = np.concatenate(([0], np.cumsum(each + after)))
                nats = sums[ends] - sums[ends - n]
            rest = [None] * (len(n) - 1)
            ids, sizes = (pa.array([x, *rest][: len(n)], pa.binary()) for x in (_written(w, known.whole), n.astype(np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], ids, sizes, pa.array(n), pa.array(types, pa.int64()), pa.array(nats)], names=[*keys, "ids", "sizes", "n", "types", "nats"])

    held = docs.select(*keys, "text")
    told = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields[:-1]), "ids binary, sizes binary, n long, types long, nats long"])
    return cut(held.mapInArrow(run, told).withColumn("row", F.monotonically_increasing_id()), "coded")


def _planes(x: np.ndarray, n: int) -> bytes:
    """The lowest n bytes of each number, the lowest of all first, which compresses."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize)[:, :n].T).tobytes()


def _whole(data: np.ndarray, n: int, t: type) -> np.ndarray:
    """Numbers of type t from their lowest n bytes."""
    size = len(data) // n
    out = np.zeros((size, np.dtype(t).itemsize), np.uint8)
    out[:, :n] = data.reshape(n, size).T
    return out.reshape(-1).view(t)


def _written(ids: np.ndarray, whole: bool) -> bytes:
    """Ids as bytes: three for a number, and behind them the hashes, unless they do not matter."""
    return _planes(np.maximum(ids, 0), 3) + (b"" if whole else ids[ids < 0].tobytes())


def _read(data: pa.Buffer, n: int) -> np.ndarray:
    ids, hashes = _whole(np.frombuffer(data, np.uint8, 3 * n), 3, np.int64), np.frombuffer(data, np.int64, -1, 3 * n) if data.size > 3 * n else OTHER
    ids[ids == 0] = hashes
    return ids


def _coded(texts: DataFrame) -> DataFrame:
    return texts.select("row", "ids", "sizes").where("ids IS NOT NULL")


def _positions(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """u, v, w (each word w and the two before it), row, and more, whether another word follows, of batches of _coded()."""
    for batch in batches:
        for start, ids, sizes in zip(*batch.columns, strict=True):
            n = np.frombuffer(sizes.as_buffer(), np.int64)
            w = _read(ids.as_buffer(), int(n.sum()))
            if len(w):
                first = (np.cumsum(n) - n)[n > 0]
                v = np.concatenate(([START], w[:-1]))
                v[first] = START
                u = np.concatenate(([START], v[:-1]))
                u[first] = START
                more = np.ones(len(w), bool)
                more[(np.cumsum(n) - 1)[n > 0]] = False
                yield u, v, w, np.repeat(start.as_py() + np.arange(len(n)), n), more


def _packed(pair: np.ndarray, u: np.ndarray, row: np.ndarray, more: np.ndarray) -> list[bytes]:
    """Positions of a chunk as bytes. Rows are told by the steps between them."""
    step = np.diff(row, prepend=row[:1])
    rest = _planes(u, 4) + _planes(step, 8) + more.tobytes()
    return [pair.tobytes(), row[:1].tobytes(), _ZSTD.compress(rest, asbytes=True)]


def _unpacked(data: list) -> list[np.ndarray]:
    pair, row = np.frombuffer(data[0], np.uint64), np.frombuffer(data[1], np.int64)
    n = len(pair)
    rest = np.frombuffer(_ZSTD.decompress(data[2], 13 * n), np.uint8)
    return [pair, _whole(rest[: 4 * n], 4, np.uint32), row + np.cumsum(_whole(rest[4 * n : 12 * n], 8, np.int64)), rest[12 * n :].view(bool)]


def _classes(c: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Of each run: how many counts are one, two, and more."""
    return [np.add.reduceat(x.astype(np.int64), starts) for x in (c == 1, c == 2, c > 2)]


def _tally(c: np.ndarray) -> list[pa.Array]:
    return [pa.array([int((c == k).sum())]) for k in (1, 2, 3, 4)]


_TALLY = [f"n{k}" for k in (1, 2, 3, 4)]


def _discounts(n: list[int]) -> list[float]:
    """D1, D2 and D3+ of modified Kneser-Ney from how many counts are one, two, three and four."""
    if not n[0] or not n[1]:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else (k + 1) / 2 for k in range(3)]
    return [min(max(d, 0.0), k + 1.0) for k, d in enumerate(raw)]


def _told(df: DataFrame, *names: str) -> list[int]:
    """The sums of columns."""
    row = df.agg(*[F.sum(c).alias(c) for c in names]).first()
    return [row[c] or 0 for c in names]


def _own(d: list[float], c: np.ndarray) -> np.ndarray:
    return np.array(d)[np.minimum(c, 3) - 1]


def _micro(nats: np.ndarray) -> np.ndarray:
    return np.rint(nats * MICRO).astype(np.int64)


def _counted(texts: DataFrame, n_groups: int) -> DataFrame:
    """A chunk for each group: u, v, w, c of its triples, grouped by u and v, in runs of these. n1 to n4 of the counts; s, s1 to s3: total and classes of the first context."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, v, w, *_ in _gathered(_positions(batches), 2 * DEALT):
            context = _mix(u, v)
            _, at, c = np.unique(_mix(context, w), return_index=True, return_counts=True)
            yield from _deal(_group(context[at], n_groups), TRIPLES, u[at], v[at], w[at], c.astype(np.int32))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, chunks in _groups(batches):
            u, v, w, c = _joined([data for _, data in chunks], np.int64, np.int64, np.int64, np.int32)
            context = _mix(u, v)
            triple = _mix(context, w)
            order = np.lexsort((triple, context))
            at = _starts(triple[order])
            c = np.add.reduceat(c[order], at).astype(np.int32)
            u, v, w = (x[order[at]] for x in (u, v, w))
            first = c[(u == START) & (v == START)]
            batch = _chunk([group], TRIPLES, [[x.tobytes()] for x in (u, v, w, c)])
            s = [pa.array([int(x)]) for x in (first.sum(), (first == 1).sum(), (first == 2).sum(), (first > 2).sum())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *_tally(c), *s], names=[*_NAMES, *_TALLY, "s", "s1", "s2", "s3"])

    chunks = _coded(texts).mapInArrow(dealt, CHUNK)
    return cut(_meet(chunks, n_groups).mapInArrow(counted, ", ".join([CHUNK, *(f"{c} long" for c in (*_TALLY, "s", "s1", "s2", "s3"))])), "triples")


def _paired(triples: DataFrame, d3: list[float], n_groups: int) -> DataFrame:
    """A chunk for each group (PAIRS): v, w, c and what is left (nan if they are no context) of its pairs, by hash; fold of u, c, and total and left of the context, of the triples of each pair. n1 to n4 of the pairs' counts."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunks in _groups(batches):
            u, v, w, c = _joined([data for _, data in chunks], np.int64, np.int64, np.int64, np.int32)
            context = _mix(u, v)
            starts = _starts(context)
            n, total = np.diff([*starts, len(c)]), np.add.reduceat(c.astype(np.int64), starts)
            left = np.maximum(sum(d * x for d, x in zip(d3, _classes(c, starts), strict=True)) / total, LEAST_LEFT)
            yield from _deal(_group(context[starts], n_groups), CONTEXTS, context[starts], left)
            yield from _deal(_group(_mix(v, w), n_groups), TRIPLES, v, w, _fold(u), c, np.repeat(total, n), np.repeat(left, n), pack=_squeezed)

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, chunks in _groups(batches):
            held = defaultdict(list)
            for kind, data in chunks:
                held[kind].append(_expanded(data, 6) if kind == TRIPLES else data)
            v, w, u, c, total, left = _joined(held[TRIPLES], np.int64, np.int64, np.uint32, np.int32, np.int64, np.float64)
            if not len(v):  # the first context alone
                continue
            context, of_context = _joined(held[CONTEXTS], np.uint64, np.float64)
            pair = _mix(v, w)
            order = np.lexsort((u, pair))
            starts = _starts(pair[order])
            n, at = np.diff([*starts, len(order)]).astype(np.int32), order[starts]
            own = np.full(len(at), np.nan)
            if len(context):
                by = np.argsort(context)
                place, there = _find(context[by], pair[at])
                own[there] = of_context[by][place[there]]
            batch = _chunk([group], PAIRS, [[x.tobytes()] for x in (v[at], w[at], n, own, u[order], c[order], total[order], left[order])])
            yield pa.RecordBatch.from_arrays([*batch.columns, *_tally(n)], names=[*_NAMES, *_TALLY])

    chunks = triples.select(*_NAMES).mapInArrow(dealt, CHUNK)
    return cut(_meet(chunks, n_groups).mapInArrow(paired, ", ".join([CHUNK, *(f"{c} long" for c in _TALLY)])), "pairs")


def _word_counts(groups: DataFrame) -> DataFrame:
    """w, c (its pairs as the second word), and total and classes n1, n2, n3 of its pairs' counts as the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (tuple(_joined([data], np.int64, np.int64, np.int32)) for _, chunks in _groups(batches) for _, data in chunks)
        for v, w, n in _gathered(pairs, 4 * DEALT):
            second, c = np.unique(w, return_counts=True)
            order = np.argsort(v)
            starts = _starts(v[order])
            n = n[order]
            sums = [np.add.reduceat(n.astype(np.int64), starts), *_classes(n, starts)]
            none = np.zeros(len(second), np.int64)
            columns = [(second, v[order[starts]]), (c.astype(np.int64), np.zeros(len(starts), np.int64)), *((none, x) for x in sums)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], names=["w", "c", "total", "n1", "n2", "n3"])

    only = groups.select(*_NAMES[:5], *[F.lit(None).cast("binary").alias(c) for c in _NAMES[5:]])
    rows = only.mapInArrow(run, "w long, c long, total long, n1 long, n2 long, n3 long")
    return cut(rows.groupBy("w").agg(*[F.sum(c).alias(c) for c in ("c", "total", "n1", "n2", "n3")]), "words")


def _rare_chunks(groups: DataFrame, words: DataFrame, n_groups: int) -> DataFrame:
    """Words without a number: w, p1, total and left as in Words, for each group whose pairs have them, and alone."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, chunks in _groups(batches):
            for _, data in chunks:
                w = np.unique(np.concatenate(_joined([data], np.int64, np.int64)))
                w = w[w < 0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), group, np.int32)), pa.array(w)], names=["group", "w"])

    def packed(kind: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group, *columns in _gathered((tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns) for batch in batches), DEALT):
                yield from _deal(_group(_mix(np.full(len(columns[0]), ALONE, np.int64), columns[0]), n_groups) if kind == LONE else group, kind, *columns)

        return run

    only, rare = groups.select(*_NAMES[:4], *[F.lit(None).cast("binary").alias(c) for c in _NAMES[4:]]), words.where("w < 0")
    met = only.mapInArrow(asked, "group int, w long").join(rare, "w").select("group", "w", "p1", "total", "left")
    alone = rare.select(F.lit(0).alias("group"), "w", "p1", "total", "left")
    return cut(met.mapInArrow(packed(RARE), CHUNK).unionAll(alone.mapInArrow(packed(LONE), CHUNK)), "rare")


def train(docs: DataFrame) -> Model | None:
    """The model of all texts of docs; None if they have no words."""
    small_batches(docs.sparkSession)
    free_shuffles(docs.sparkSession)
    counts = cut(count_words(docs), "vocabulary")
    vocabulary = number_words(counts)
    if counts.isEmpty():
        return None
    texts = coded(docs, vocabulary)
    size = _told(texts, "n")[0]
    n_groups = max(1, size // GROUP)
    triples = _counted(texts, n_groups)
    discard(texts, counts)
    *n, s, s1, s2, s3 = _told(triples, *_TALLY, "s", "s1", "s2", "s3")
    d3 = _discounts(n)
    start = [max((d3[0] * s1 + d3[1] * s2 + d3[2] * s3) / s, LEAST_LEFT)]
    groups = _paired(triples, d3, n_groups)
    discard(triples)
    d2 = _discounts(_told(groups, *_TALLY))

    held = _word_counts(groups)
    single = held.where("c > 0")
    row = single.agg(F.count("*").alias("n"), F.sum("c").alias("total"), *[F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)], F.sum((F.col("c") > 2).cast("long")).alias("rest")).first()
    d1 = _discounts([row[c] for c in _TALLY])
    unknown = max((d1[0] * row["n1"] + d1[1] * row["n2"] + d1[2] * row["rest"]) / row["total"], LEAST_LEFT) / (row["n"] + 1)
    own = F.when(F.col("c") == 1, d1[0]).when(F.col("c") == 2, d1[1]).otherwise(d1[2])
    left = F.greatest((F.col("n1") * d2[0] + F.col("n2") * d2[1] + F.col("n3") * d2[2]) / F.col("total"), F.lit(LEAST_LEFT))
    words = held.select("w", F.when(F.col("c") > 0, (F.col("c") - own) / row["total"] + unknown).otherwise(1.0).alias("p1"), "total", F.when(F.col("total") > 0, left).otherwise(1.0).alias("left"))
    known = len(vocabulary.hashes) + 1
    numbered = Words(np.ones(known), np.zeros(known, np.int64), np.ones(known))
    told = words.where("w >= 0").toArrow()  # NUMBERED words at most
    for c in ("p1", "total", "left"):
        getattr(numbered, c)[told["w"].to_numpy()] = told[c].to_numpy()
    start.append(numbered.left[START])
    rare = None if vocabulary.whole else _rare_chunks(groups, words, n_groups)
    discard(held)
    return Model(vocabulary, numbered, [d2, d3], groups, rare, n_groups, round(-MICRO * math.log(unknown)), round(-MICRO * sum(map(math.log, start))), size <= BROADCAST_ROWS)


class _Weights:
    """The pairs and triples of a group, by hash, with their micro-nats."""

    def __init__(self, held: dict[int, list], words: Words, discounts: list[list[float]], unknown: int) -> None:
        v, w, n, own, u, c, total, left = _joined(held[PAIRS], np.int64, np.int64, np.int32, np.float64, np.uint32, np.int32, np.int64, np.float64)
        rare = _joined(held[RARE], np.int64, np.float64, np.int64, np.float64)
        order = np.argsort(rare[0])
        rare = [x[order] for x in rare]

        def of(ids: np.ndarray, known: np.ndarray, others: np.ndarray) -> np.ndarray:
            out, less = known[np.maximum(ids, 0)], ids < 0
            if less.any():
                out[less] = others[np.searchsorted(rare[0], ids[less])]
            return out

        plain = of(v, words.left, rare[3]) * of(w, words.p1, rare[1])
        p2 = (n - _own(discounts[0], n)) / of(v, words.total, rare[2]) + plain if len(v) else plain
        pair = _mix(v, w)
        lone, p1, _, leaves = _joined(held[LONE], np.int64, np.float64, np.int64, np.float64)
        keys = np.concatenate((pair, _mix(np.full(len(lone), ALONE, np.int64), lone)))
        order = np.argsort(keys)
        self.pairs = keys[order]
        self.of_pairs = np.concatenate((_micro(np.log(plain) - np.log(p2)), _micro(-np.log(p1)) - unknown))[order]
        self.contexts = np.concatenate((_micro(np.where(np.isnan(own), 0.0, -np.log(own))), _micro(-np.log(leaves))))[order]
        triple, shorter = _mix(np.repeat(pair, n), u), left * np.repeat(p2, n)
        order = np.argsort(triple)
        share = (c - _own(discounts[1], c)) / total if len(c) else shorter
        self.triples, self.of_triples = triple[order], _micro(np.log(shorter) - np.log(share + shorter))[order]

    def sums(self, data: list) -> tuple[np.ndarray, np.ndarray]:
        """Rows, and the nats of their positions, of a chunk of these."""
        pair, u, row, more = _unpacked(data)
        nats = np.zeros(len(pair), np.int64)
        if len(self.pairs):
            at, there = _find(self.pairs, pair)
            nats += np.where(there, self.of_pairs[at] + np.where(more, self.contexts[at], 0), 0)
        if len(self.triples):
            at, there = _find(self.triples, _mix(pair, u))
            nats += np.where(there, self.of_triples[at], 0)
        starts = _starts(row)
        return row[starts], np.add.reduceat(nats, starts)


def _longer(texts: DataFrame, model: Model) -> DataFrame:
    """row, longer: what pairs, triples and words without a number add to the nats of rows, in rows for each part."""
    parts, n_groups, whole = 1 if model.small else PARTS, model.n_groups, model.vocabulary.whole
    shared = texts.sparkSession.sparkContext.broadcast((model.words, model.discounts, model.unknown))

    def dealt(k: int) -> Callable:
        def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
            for u, v, w, row, more in _positions(batches):
                pair = _mix(v, w)
                group = _group(pair, n_groups)
                at = np.flatnonzero((group % parts == k) & (v != OTHER) & (w != OTHER) if whole else group % parts == k)
                yield group[at], pair[at], _fold(u[at]), row[at], more[at]
                if not whole:
                    w, row, more = (x[w < 0] for x in (w, row, more))
                    pair = _mix(np.full(len(w), ALONE, np.int64), w)
                    group = _group(pair, n_groups)
                    at = np.flatnonzero(group % parts == k)
                    yield group[at], pair[at], np.zeros(len(at), np.uint32), row[at], more[at]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group, *arrays in _gathered(mine(batches), DEALT):
                yield from _deal(group, POSITIONS, *arrays, pack=_packed)

        return run

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunks in _groups(batches):
            held, weights = defaultdict(list), None
            for kind, data in chunks:
                if kind != POSITIONS:
                    held[kind].append(data)
                    continue
                weights = weights or _Weights(held, *shared.value)
                row, nats = weights.sums(data)
                for bits, first, end in _blocks(row):
                    yield pa.RecordBatch.from_arrays([pa.array([bits]), pa.array([row[first:end].tobytes()], pa.binary()), pa.array([nats[first:end].tobytes()], pa.binary())], names=["block", "rows", "nats"])

    def summed(sums: pa.Table) -> pa.Table:
        row, nats = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in sums.column(c)]) for c in ("rows", "nats"))
        order = np.argsort(row, kind="stable")
        starts = _starts(row[order])
        return pa.table({"row": row[order[starts]], "longer": np.add.reduceat(nats[order], starts)})

    def part(k: int) -> DataFrame:
        tables = [t for t in (model.groups, model.rare) if t is not None]
        chunks = _coded(texts).mapInArrow(dealt(k), CHUNK)
        for t in tables:
            chunks = chunks.unionAll(t.select(*_NAMES).where(F.col("group") % parts == k))
        sums = _meet(chunks, -(-n_groups // parts)).mapInArrow(met, "block long, rows binary, nats binary")
        return sums.groupBy("block").applyInArrow(summed, "row long, longer long")

    return cut_parts(map(part, range(parts)), "sums")


def _blocks(row: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of rows that share all but their last bits, with where they begin and end."""
    bits = row >> ROW_BITS
    starts = _starts(bits)
    yield from zip(bits[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(row)], strict=True)


def perplexities(docs: DataFrame, model: Model, *keys: str) -> DataFrame:
    """keys, n_words, log_perplexity (nats a word; null without words) and bound (nats a distinct triple, less the slack), one row for each value of keys.

    Stored, so that what it was made from goes. The model stays.
    """
    small_batches(docs.sparkSession)
    free_shuffles(docs.sparkSession)
    u, g = _micro(-np.log(model.words.p1)), _micro(-np.log(model.words.left))
    texts = coded(docs, model.vocabulary, *keys, weights=(u, g, model.unknown))
    longer = _longer(texts, model)
    told = texts.select("row", *keys, "n", "types", "nats").join(longer.groupBy("row").agg(F.sum("longer").alias("longer")), "row", "left")
    told = told.withColumn("nats", F.when(F.col("n") > 0, F.col("nats") + F.coalesce("longer", F.lit(0)) + model.start))
    summed = told.groupBy(*keys).agg(F.sum("n").alias("n_words"), F.sum("nats").alias("nats"), F.sum("types").alias("types"))
    out = summed.select(*keys, "n_words", (F.col("nats") / F.col("n_words") / MICRO).alias("log_perplexity"), (F.col("nats") / F.col("types") / MICRO - SLACK / F.sqrt("types")).alias("bound"))
    out = cut(out, "scores")
    discard(texts, longer)
    return out


def _quantile(scores: DataFrame, key: list[str]) -> DataFrame:
    """key, trusted (how many) and the quantile of the bound in steps of a thousandth, from a histogram: tasks send a row for each step."""
    bins = scores.groupBy(*key, F.ceil(F.col("bound") * 1000).alias("bin")).agg(F.count("*").alias("n"))
    return bins.groupBy(*key).agg(F.sum("n").alias("trusted"), (F.ceil(F.percentile("bin", F.lit(QUANTILE), F.col("n"))) / 1000).alias("at"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_words, log_perplexity, bound, threshold, keep: one row for each document."""
    docs = docs.select("doc_id", "lang", "text")
    free_shuffles(docs.sparkSession)
    spoken = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike("\\S")).select("doc_id").distinct()
    trusted = cut(trusted_ids(labels).join(spoken, "doc_id"), "trusted")
    half = trusted.count() // 2
    h = F.xxhash64("doc_id")
    taught = cut(trusted.orderBy(h, "doc_id").limit(half) if half <= TRAIN_DOCS else trusted.where(h < 0), "taught")
    held_ids = taught
    taught = F.broadcast(taught) if half <= BROADCAST_IDS // 2 else taught
    model = train(docs.join(taught, "doc_id", "left_semi"))
    if model is None:
        plain = docs.groupBy("doc_id", F.col("lang")).agg(F.sum(F.size(words_of(F.coalesce("text", F.lit(""))))).alias("n_words"))
        return plain.select("doc_id", "lang", "n_words", *[F.lit(None).cast("double").alias(c) for c in ("log_perplexity", "bound", "threshold")], (F.col("n_words") > 0).alias("keep"))
    scores = perplexities(docs, model, "doc_id", "lang")
    discard(model.groups, model.rare)
    held = scores.join(trusted, "doc_id", "left_semi").join(taught, "doc_id", "left_anti").where("log_perplexity IS NOT NULL")
    held = held.withColumn("lang", F.coalesce("lang", F.lit("")))
    each, overall = _quantile(held, ["lang"]), _quantile(held.withColumn("every", F.lit(1)), ["every"]).first()
    fallback = F.lit(None if overall is None else float(overall["at"])).cast("double")
    drawn = (F.col("trusted") * F.col("at") + PRIOR * fallback) / (F.col("trusted") + PRIOR)
    each = each.select(F.col("lang").alias("of"), drawn.alias("at"))
    each = cut(each, "thresholds")
    discard(trusted, held_ids)
    judged = scores.join(F.broadcast(each) if each.count() <= BROADCAST_LANGS else each, F.coalesce("lang", F.lit("")) == F.col("of"), "left")
    threshold = F.coalesce("at", fallback) + MARGIN
    keep = F.coalesce(F.col("log_perplexity").isNotNull() & (F.coalesce(F.col("bound") <= threshold, F.lit(True))), F.lit(False))
    return judged.select("doc_id", "lang", "n_words", "log_perplexity", "bound", threshold.alias("threshold"), keep.alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the documents that do not pass. Rows without doc_id stay: nothing was decided about them."""
    bad = cut(judge(docs, labels).where("doc_id IS NOT NULL AND NOT keep").select("doc_id").distinct(), "rejected")
    return docs.join(F.broadcast(bad) if bad.count() <= BROADCAST_IDS else bad, "doc_id", "left_anti").select(docs.columns)
