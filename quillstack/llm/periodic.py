"""Runs of words that repeat with a period: multi-scale minimizers seed them, exact extension decides them.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length
of at least max(6, 4 * q), which no neighbouring word extends keeping the period. Words are numbers here,
equal where the words are, so nothing rests on a hash in the end.

Periods up to ``SHORT`` come from direct scans at each lag. Longer ones come from scales m = 16, 32, ...:
the scale m serves periods in (m/2, m]. Every place has the hash of its next m words, and every window of m/2
places selects its least. In a run of period q the windows at i and i + q hold the same, so both a place and the
one q behind it are selected; as m >= q, equal hashes lie in it only at multiples of q, so the next selected
place with an equal hash is q away: the run is seeded where q + m + m/2 - 1 <= 4 * q, which holds at its scale.
Each seed is extended on the words to both sides. Stretches too short, and those whose period is a multiple of
a smaller one, are dropped.

Documents of a batch lie in one array, with a number of its own between any two, so that short documents cost
no numpy calls of their own. Nothing is shuffled: each document is decided where it is read.

Defined cases: a null text has no words; without doc_id nothing is repeated by ``planted``; repeated rows give
repeated rows; texts are taken as their stored bytes, so ill-formed UTF-8 is kept as it is; an empty table gives
an empty table; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run's least length in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Periods up to this are scanned lag by lag; the scales of the others begin at twice as many words.
SHORT = 8
#: Words in one array, about; a longer document is an array of its own. Words that are numbered before the numbers begin anew.
ARRAY_WORDS, MEMO_WORDS = 200_000, 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

Run = tuple[int, int, int]


class Numbers(dict):
    """Numbers of words: equal words have equal numbers, from 0. Between documents it may be cleared."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """words with the repetition that the document's id asks for: one document in ten has each word from ``a`` on replaced by one of the ``p`` words there."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(b"%d" % doc_id)
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = left * _MIX[0] + right
    out ^= out >> np.uint64(29)
    out *= _MIX[1]
    return out ^ (out >> np.uint64(32))


def _sliding(values: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """The least or greatest of each window: running ones within blocks of the width, from both ends."""
    n = len(values)
    padded = np.resize(values, -(-n // width) * width)
    padded[n:] = values[-1]
    blocks = padded.reshape(-1, width)
    ahead = of.accumulate(blocks, axis=1).ravel()[:n]
    behind = of.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return of(behind[: n - width + 1], ahead[width - 1 :])


def _seeds(grams: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags of neighbouring selected places with equal grams, not more than m apart."""
    width = m // 2
    if len(grams) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lowest = _sliding(grams, width, np.minimum)
    # a place is selected if it is the least of a window that holds it: the greatest of these windows' least is its own
    none = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero(grams == _sliding(np.concatenate((none, lowest, none)), width, np.maximum))
    at = chosen[np.argsort(grams[chosen], kind="stable")]  # places of equal grams stay in order
    lag = at[1:] - at[:-1]
    near = (grams[at[1:]] == grams[at[:-1]]) & (lag <= m)
    return at[:-1][near], lag[near]


def _reach(left: np.ndarray, right: np.ndarray) -> int:
    """How many leading values agree, looked at in stretches of growing size."""
    at, step, n = 0, 64, min(len(left), len(right))
    while at < n:
        end = min(n, at + step)
        differ = np.flatnonzero(left[at:end] != right[at:end])
        if len(differ):
            return at + int(differ[0])
        at, step = end, step * 2
    return n


def _extended(words: np.ndarray, first: np.ndarray, lag: np.ndarray) -> Iterator[Run]:
    """The stretches (start, length, lag) that hold the seeds."""
    order = np.lexsort((first, lag))
    last, end = 0, -1
    for p, d in zip(first[order].tolist(), lag[order].tolist(), strict=True):
        if d == last and p < end:
            continue
        ahead = _reach(words[p:], words[p + d :])
        behind = _reach(words[:p][::-1], words[d : p + d][::-1])
        last, end = d, p + ahead
        yield p - behind, ahead + behind + d, d


def _scanned(words: np.ndarray, q: int) -> Iterator[Run]:
    """The stretches at one lag that are long enough."""
    same = words[q:] == words[:-q]
    ends = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).view(np.int8)))
    starts, lengths = ends[::2], ends[1::2] - ends[::2] + q
    long = lengths >= max(LEAST_WORDS, LEAST_PERIODS * q)
    yield from ((s, n, q) for s, n in zip(starts[long].tolist(), lengths[long].tolist(), strict=True))


def _least_periods(found: set[Run]) -> list[Run]:
    """The stretches of one document without those that a run of a smaller period, which divides theirs, holds: by start, then period."""
    kept: dict[int, list[Run]] = {}
    for s, n, q in sorted(found, key=lambda r: (r[2], r[0])):
        for d, runs in kept.items():
            if d < q and q % d == 0 and (k := bisect.bisect_right(runs, s, key=lambda r: r[0])) and s + n <= runs[k - 1][0] + runs[k - 1][1]:
                break
        else:
            kept.setdefault(q, []).append((s, n, q))
    return sorted((r for runs in kept.values() for r in runs), key=lambda r: (r[0], r[2]))


def runs_of_all(documents: list[np.ndarray]) -> list[list[Run]]:
    """The runs (start, length, period) of each document, by start, then period. Numbers are not negative."""
    found: list[set[Run]] = [set() for _ in documents]
    if not documents:
        return []
    lengths = np.array([len(d) for d in documents])
    each = np.arange(len(documents))
    words = np.concatenate([x for k, d in enumerate(documents) for x in (d, [-1 - k])]).astype(np.int64)  # what stands between two documents is nowhere else

    def add(runs: Iterable[Run]) -> None:
        starts = np.cumsum(lengths[each] + 1) - lengths[each] - 1
        for s, n, q in runs:
            if n >= max(LEAST_WORDS, LEAST_PERIODS * q):
                k = int(np.searchsorted(starts, s, "right")) - 1
                found[each[k]].add((s - int(starts[k]), n, q))

    for q in range(1, min(SHORT, len(words) - 1) + 1):
        add(_scanned(words, q))
    m, grams = 1, words.astype(np.uint64)
    while LEAST_PERIODS * (m + 1) <= lengths[each].max(initial=0):  # periods from m + 1 on are left
        if m >= SHORT:  # documents that are too short for them go
            long = lengths[each] >= LEAST_PERIODS * (m + 1)
            held = np.repeat(long, lengths[each] + 1)
            words, grams, each = words[held], grams[held[: len(grams)]], each[long]
        grams = _mixed(grams[:-m], grams[m:])  # of 2 * m words
        m *= 2
        if m > SHORT:
            add(_extended(words, *_seeds(grams, m)))
    return [_least_periods(f) for f in found]


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """words without those that any run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for s, n, q in runs:
        keep[s + q : s + n] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length over period; ties: smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def _groups(texts: Iterator[tuple[int | None, bytes | None]], memo: Numbers, plant: bool) -> Iterator[tuple[list, list[list[bytes]], list[np.ndarray]]]:
    """ids, words and numbers of documents, as many at a time as an array holds."""
    ids, lists, numbers, held = [], [], [], 0
    for doc_id, text in texts:
        words = (text or b"").split()  # at the six characters of white space in ASCII
        words = planted(words, doc_id) if plant else words
        ids.append(doc_id)
        lists.append(words)
        numbers.append(np.fromiter(map(memo.__getitem__, words), np.int64, len(words)))
        held += len(words) + 1
        if held >= ARRAY_WORDS:
            yield ids, lists, numbers
            ids, lists, numbers, held = [], [], [], 0
    yield ids, lists, numbers
    if len(memo) > MEMO_WORDS:
        memo.clear()


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes | None]]:
    return zip(batch.column(0).to_pylist(), (t.as_py() for t in batch.column(1)), strict=True)


def _bytes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def find_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """doc_id, start, length, period: one row for each run of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Numbers()
        for batch in batches:
            for ids, _, numbers in _groups(_texts(batch), memo, plant):
                rows = [(i, *r) for i, runs in zip(ids, runs_of_all(numbers), strict=True) for r in runs]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["doc_id", "start", "length", "period"])

    return _bytes(docs).mapInArrow(run, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame) -> DataFrame:
    """doc_id and text: the words that are left when each run keeps its first period, joined by one space; a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Numbers()
        for batch in batches:
            rest = batch.column(1).to_pylist()
            out = [b" ".join(kept_words(w, r)) for _, lists, numbers in _groups(_texts(batch), memo, False) for w, r in zip(lists, runs_of_all(numbers), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o if t is not None else None for o, t in zip(out, rest, strict=True)], pa.binary())], names=["doc_id", "text"])

    return _bytes(docs).mapInArrow(run, "doc_id long, text binary").withColumn("text", F.col("text").cast("string"))


_TOLD = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digests(docs: DataFrame) -> DataFrame:
    """One row for each document, its planted repetition included: number of runs, the strongest, and digests of all runs and of the collapsed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, kinds = Numbers(), [pa.int64()] * 6 + [pa.string()] * 2
        for batch in batches:
            for ids, lists, numbers in _groups(_texts(batch), memo, True):
                rows = []
                for doc_id, words, runs in zip(ids, lists, runs_of_all(numbers), strict=True):
                    s, n, q = strongest(runs) or (None, None, None)
                    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
                    rows.append((doc_id, len(runs), s, n, q, None if q is None else 1000 * n // q, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept_words(words, runs))).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[c.split()[0] for c in _TOLD.split(", ")])

    return _bytes(docs).mapInArrow(run, _TOLD)
