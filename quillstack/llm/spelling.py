"""Groups of spelling variants: words that differ by one letter, found by Gram matrices of letter counts.

Words are maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of ``LEAST_LENGTH`` letters and
``LEAST_COUNT`` occurrences in all documents. Two are near if one inserted, deleted or replaced letter makes one of the
other. Their vectors of letter counts then have a squared distance of 2 (same length) or 1 (adjacent lengths).

All pairs of words would be too many, so they meet in cells. The letters are dealt to ``GROUPS`` groups, balanced by how
often they occur; an edit touches two letters at most, so two near words have the same counts in all groups but two. A
cell is a choice of all groups but two, the counts in them, and a length; in it the words of that length meet each other
and those one letter longer. So no pair is lost, and it is kept only in the first choice in which it agrees.
Within a cell one NumPy product of the two blocks of counts gives all squared distances, and what they leave is
verified letter by letter. Cells of more than ``TILE`` words are cut into tiles by a hash, and each pair of tiles is a
unit of work of its own.

Units return, for each word, how many near words it met and the most frequent of them, not pairs. A word's form is its
near word with the most occurrences if these are at least ``RATIO`` times its own; forms have ever more occurrences, so
chains end, and the last of each is found by doubling pointers.

Defined cases: null texts have no words; a row without doc_id is counted without damage; ill-formed UTF-8 separates
words; repeated rows count as often as they occur; ties of forms go to the smallest in code-point order; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import cut

LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
GROUPS, TILE, FEW_CELLS = 4, 1024, 100_000
#: One run in so many loses a letter in the query, which plants variants.
DAMAGED = 97
#: Distinct words that a task counts before it passes them on.
HELD_WORDS = 300_000
_CHOICES = list(itertools.combinations(range(GROUPS), GROUPS - 2))
_FACTORS = np.random.default_rng(12).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)


def _table() -> bytes:
    """Of Latin-1: letters to themselves, A-Z to lower case, all others to a space."""
    return bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


_LETTERS = _table()


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text, in Latin-1: a byte a letter."""
    return (text or b"").decode("utf-8", "replace").encode("latin-1", "replace").translate(_LETTERS).split()


def _utf8(word: bytes) -> bytes:
    return word if word.isascii() else word.decode("latin-1").encode()


def tally(total: Counter, doc_id: int | None, words: list[bytes], damaged: int | None) -> None:
    """Adds a document's words to total; of its distinct words one in ``damaged`` counts without one of its letters."""
    total.update(words)
    if damaged is None or doc_id is None:
        return
    start = zlib.crc32(b"%d:" % doc_id)
    hit = [w for w in set(words) if len(w) >= LEAST_LENGTH and not zlib.crc32(_utf8(w), start) % damaged]
    counts = Counter(words) if len(hit) > 4 else {w: words.count(w) for w in hit}
    for w in hit:
        at = zlib.crc32(_utf8(w), start) % len(w)
        total[w] -= counts[w]
        total[w[:at] + w[at + 1 :]] += counts[w]


def count_words(docs: DataFrame, damaged: int | None = None) -> DataFrame:
    """word and n: all words that are long and frequent enough."""

    def told(total: Counter) -> pa.RecordBatch:
        kept = [(w, n) for w, n in total.items() if n and len(w) >= LEAST_LENGTH]
        total.clear()
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tally(total, doc_id, words_of(text.as_py()), damaged)
                if len(total) > HELD_WORDS:
                    yield told(total)
        yield told(total)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def letter_groups(words: DataFrame) -> np.ndarray:
    """The group of each Latin-1 letter: the most frequent are dealt to and fro. The alphabet has 90 letters, which is all that the driver sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.bincount(np.frombuffer("".join(batch.column(0).to_pylist()).encode("latin-1"), np.uint8), minlength=256)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["letter", "n"])

    seen = words.select("word").mapInArrow(run, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(256, np.int64)
    for k, r in enumerate(sorted(seen, key=lambda r: (-r["n"], r["letter"]))):
        out[r["letter"]] = min(k % (2 * GROUPS), 2 * GROUPS - 1 - k % (2 * GROUPS))
    return out


def _letter_counts(words: list[bytes]) -> np.ndarray:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8)
    return np.bincount(np.repeat(np.arange(len(words)) * 256, lengths) + flat, minlength=256 * len(words)).reshape(-1, 256)


def cells(words: DataFrame, groups: np.ndarray) -> DataFrame:
    """Each word in its cells: choice, cell (a hash of the choice, the counts and the shorter length), longer (0 or 1), word, n. Cells that share a hash only make candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            if not listed:
                continue
            counts = _letter_counts(listed).astype(np.uint64)
            lengths = np.fromiter(map(len, listed), np.uint64, len(listed))
            for k, choice in enumerate(_CHOICES):
                key = (counts * np.where(np.isin(groups, choice), _FACTORS, np.uint64(0))).sum(axis=1, dtype=np.uint64)
                for longer in (0, 1):
                    cell = (key ^ (key >> np.uint64(31))) * _FACTORS[0] + (lengths - np.uint64(longer)) * _FACTORS[1] + np.uint64(k) * _FACTORS[2]
                    same = [pa.array(np.full(len(listed), v, np.int32)) for v in (k, longer)]
                    yield pa.RecordBatch.from_arrays([same[0], pa.array((cell ^ (cell >> np.uint64(29))).view(np.int64)), same[1], batch.column(0), batch.column(1)], names=["choice", "cell", "longer", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "choice int, cell long, longer int, word string, n long")


def units(placed: DataFrame) -> DataFrame:
    """The cells' rows in units (cell, i, j) of bounded size: tile says which half of the unit a row belongs to."""
    large = cut(placed.groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).where("tiles > 1"), "cells")
    n = large.limit(FEW_CELLS + 1).count()
    one = F.lit(0)
    if not n:
        return placed.withColumns({"i": one, "j": one, "tile": one})
    tiled = placed.join(F.broadcast(large) if n <= FEW_CELLS else large, "cell", "left").withColumn("tile", F.when(F.col("tiles").isNull(), 0).otherwise(F.pmod(F.xxhash64("word"), F.col("tiles"))).cast("int"))
    met = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)))
    return met.select("choice", "cell", "longer", "word", "n", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile")


def _padded(words: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(-1, width)


def _one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which rows of long are the same row of short with one more letter."""
    differ = short != long[:, :-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), short.shape[1])
    rest = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1)[:, ::-1]
    rest = np.concatenate((rest, np.ones((len(rest), 1), bool)), axis=1)
    return rest[np.arange(len(rest)), first]


def near_pairs(words: list[bytes], longer: np.ndarray, tile: np.ndarray, split: bool, choice: int, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of near words of a unit, each pair once; of a split unit those of different tiles. Words of one kind have one length, unless cells share a hash."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    short = int(length[longer == 0].min())
    a, b = np.flatnonzero((longer == 0) & (length == short)), np.flatnonzero((longer == 1) & (length == short + 1))
    counts = _letter_counts(words)
    used = np.flatnonzero(counts.any(axis=0))
    free = used[~np.isin(groups[used], _CHOICES[choice])]  # the others agree
    block = counts[:, free].astype(np.float32)
    squares = (block * block).sum(axis=1)
    found = []
    for other, distance in ((a, 2), (b, 1)):
        if not len(a) or not len(other):
            continue
        gram = squares[a][:, None] + squares[other][None, :] - 2 * (block[a] @ block[other].T)
        p, q = np.nonzero(gram == distance)
        p, q = a[p], other[q]
        keep = (p < q) if other is a else np.ones(len(p), bool)
        if split:
            keep &= tile[p] != tile[q]
        p, q = p[keep], q[keep]
        if not len(p):
            continue
        left = _padded([words[i] for i in p.tolist()], short)
        right = _padded([words[i] for i in q.tolist()], short + (distance == 1))
        sound = _one_inserted(left, right) if distance == 1 else (left != right).sum(axis=1) == 1
        found.append((p[sound], q[sound]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p, q = (np.concatenate(x) for x in zip(*found, strict=True))
    touched = np.stack([(counts[p][:, used[groups[used] == g]] != counts[q][:, used[groups[used] == g]]).any(axis=1) for g in range(GROUPS)], axis=1)
    agrees = np.stack([~touched[:, list(c)].any(axis=1) for c in _CHOICES], axis=1)
    first = agrees[:, choice] & ~agrees[:, :choice].any(axis=1)
    return p[first], q[first]


def _told(words: list[bytes], n: np.ndarray, p: np.ndarray, q: np.ndarray) -> list[tuple[str, int, int, str]]:
    """word, number of near words, and the occurrences and name of the most frequent of them, for each word of the pairs."""
    source, target = np.concatenate((p, q)), np.concatenate((q, p))
    involved = np.unique(source)
    rank = np.zeros(len(words), np.int64)
    rank[sorted(involved.tolist(), key=words.__getitem__)] = np.arange(len(involved))  # bytes of Latin-1 are in code-point order
    order = np.lexsort((rank[target], -n[target], source))
    each, first, many = np.unique(source[order], return_index=True, return_counts=True)
    best = target[order][first]
    return [(words[i].decode("latin-1"), int(m), int(n[k]), words[k].decode("latin-1")) for i, m, k in zip(each.tolist(), many, best.tolist(), strict=True)]


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: for each word with near words how many it has and the most frequent (ties: smallest)."""
    groups = letter_groups(words)
    names = ["word", "n_near", "best_n", "best"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        listed: list[str] = []

        def all_of(columns: list[np.ndarray], words: list[str], ends: list[int]) -> pa.RecordBatch:
            rows, start = [], 0
            choice, _, i, j, longer, tile, n = columns
            for end in ends:
                if end - start > 1 and not longer[start]:  # else one word, or no word of the shorter length
                    encoded = [w.encode("latin-1") for w in words[start:end]]
                    at = slice(start, end)
                    p, q = near_pairs(encoded, longer[at], tile[at], bool(i[start] != j[start]), int(choice[start]), groups)
                    if len(p):
                        rows += _told(encoded, n[at], p, q)
                start = end
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=names)

        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
            columns = [np.concatenate((h, x)) for h, x in zip(held, new, strict=True)] if held else new
            listed += batch.column(7).to_pylist()
            moved = (columns[1][1:] != columns[1][:-1]) | (columns[2][1:] != columns[2][:-1]) | (columns[3][1:] != columns[3][:-1])
            ends = (np.flatnonzero(moved) + 1).tolist()
            last = ends[-1] if ends else 0
            yield all_of(columns, listed, ends)
            held, listed = [c[last:] for c in columns], listed[last:]
        if listed:
            yield all_of(held, listed, [len(listed)])

    dealt = units(cells(words, groups)).select("choice", "cell", "i", "j", "longer", "tile", "n", "word")
    dealt = dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "longer", "word")
    found = dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.minus")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form) to word and root, the end of each word's chain of forms: pointers are doubled until none moves."""
    now = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = cut(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def group_variants(words: DataFrame) -> DataFrame:
    """words (word, n) to word, form, root, n, n_near, form_n."""
    words = cut(words.select("word", "n"), "words")
    joined = words.join(near_words(words), "word", "left")
    strong = F.col("best_n") >= RATIO * F.col("n")
    told = cut(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n")), "forms")
    ends = roots(told.where("form IS NOT NULL").select("word", "form"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
