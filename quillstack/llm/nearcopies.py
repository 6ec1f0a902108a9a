"""Near copies by the Jaccard similarity of word shingles: banded MinHash candidates, all verified on the texts.

Texts with the same words in the same order (the same 128-bit hash of them) are one node. A node's shingles give
``BANDS`` buckets of ``ROWS`` MinHashes each; two nodes with similarity s share none of them with probability
(1 - s ** ROWS) ** BANDS, 5e-6 at 0.8. Whatever shares a bucket is a candidate, in buckets of every size.
In each round every bucket's smallest node is compared with the bucket's other nodes that are not yet
in its component, and then leaves the bucket; buckets of one component are done. So a bucket of many
near copies gives stars, not pairs. When few pairs are left, or after ``ROUNDS``, the rest of each bucket is compared pair by
pair, within the tasks that hold it; buckets of more than ``TILE`` nodes are cut into tiles, and each two tiles are a
unit of work of their own.

Candidates are first compared by sketches, a byte of each MinHash: those that agree on less than ``AGREE`` of them are
not near (at a similarity of 0.8 that happens with a probability of 7e-6, about that of sharing no bucket). Only texts of the others are moved and
compared, by the exact similarity of their sets of shingles (as 64-bit hashes), and no pair twice: what was
refused is kept. A node with many candidates is copied for each ``SLOT`` of them. Tables of past rounds are removed.

Defined cases: a text of fewer words than a shingle is one shingle of all its words; null texts and texts
without words are one node, near nothing else; ill-formed UTF-8 counts as U+FFFD; rows without doc_id take part; an
empty table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import cut, discard, free_shuffles, text_of, worker_cache
from quillstack.llm.components import components

LEAST, ROWS, BANDS, SEED = 0.8, 6, 40, 17
#: Rounds at most before what is left is compared pair by pair, shared places a node at which that may begin, and candidates for each copy of a text.
ROUNDS, FEW, SLOT = 6, 8, 64
#: Share of the sketches' bytes on which near nodes agree, and nodes of a bucket that are compared with each other in one task.
AGREE, TILE = 0.68, 2_048
MEMO_WORDS, CELLS = 200_000, 2_048
_STEP = np.uint64(0x9E3779B97F4A7C15)
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 32, (2, ROWS * BANDS), np.uint64).astype(np.uint32)
_FACTOR, _SHIFT = (_DRAWN[0] | 1)[:, None], _DRAWN[1][:, None]
#: Nodes whose texts are asked for (24 bytes each) are broadcast up to this many.
BROADCAST_NODES = 200_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()  # as in simhash


def hashes_of(parts: list[bytes]) -> tuple[int, int]:
    """128 bits of the words, as two signed numbers."""
    whole = xxhash.xxh3_128_intdigest(b" ".join(parts))
    return (whole >> 64) - (1 << 63), (whole & (1 << 64) - 1) - (1 << 63)


def shingles(parts: list[bytes], words: int, memo: _Hashes) -> np.ndarray:
    """The hashes of the distinct shingles, sorted."""
    if not parts:
        return np.zeros(0, np.uint64)
    hashes, n = np.fromiter(map(memo.__getitem__, parts), np.uint64, len(parts)), min(words, len(parts))
    out = np.full(len(parts) - n + 1, n, np.uint64)
    for j in range(n):
        out = out * _STEP + hashes[j : j + len(out)]
    out ^= out >> np.uint64(29)
    return np.unique(out * _STEP)


def buckets(found: np.ndarray) -> tuple[list[int], bytes]:
    """One number for each band, from the shingles' MinHashes, and a byte of each of these."""
    low = np.full(ROWS * BANDS, 0xFFFFFFFF, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), CELLS):
        np.minimum(low, (short[at : at + CELLS] * _FACTOR + _SHIFT).min(axis=1), out=low)
    lines = low.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(line.tobytes(), band) - (1 << 63) for band, line in enumerate(lines)], (low >> np.uint32(8)).astype(np.uint8).tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def signatures(docs: DataFrame, words: int, mark: Callable[[str], int] | None = None) -> DataFrame:
    """doc_id, h1 and h2 (the hash of the words), buckets and sketch (none for texts without words) and mark (null without the function) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = worker_cache(("words",), _Hashes)
        for batch in batches:
            texts = [text_of(t) for t in batch.column(1)]
            parts = [words_of(t) for t in texts]
            hashes = [hashes_of(p) for p in parts]
            marks = pa.array([mark(t) if mark and p else None for t, p in zip(texts, parts, strict=True)], pa.int64())
            found = [buckets(shingles(p, words, memo)) if p else ([], None) for p in parts]
            columns = [pa.array([h[k] for h in hashes], pa.int64()) for k in (0, 1)] + [pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, marks], names=["doc_id", "h1", "h2", "buckets", "sketch", "mark"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, h1 long, h2 long, buckets array<long>, sketch binary, mark long")


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and a text of it, for each of nodes (node, h1, h2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [hashes_of(words_of(text_of(t))) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*(pa.array([h[k] for h in hashes], pa.int64()) for k in (0, 1)), batch.column(0)], names=["h1", "h2", "text"])

    named = docs.select("text").where("text IS NOT NULL").mapInArrow(run, "h1 long, h2 long, text string")
    nodes = cut(nodes, "asked")
    asked = F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes
    out = cut(named.join(asked, ["h1", "h2"]).groupBy("node").agg(F.first("text").alias("text")), "texts")
    discard(nodes)
    return out


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two arrays of sketches agree well enough; arrays that are broadcast against each other."""
    return (a == b).sum(axis=-1) >= AGREE * a.shape[-1]


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose nodes' sketches (nodes: node, sketch) do not rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(_alike(a, b)))

    held = pairs.join(nodes.select(F.col("node").alias("a"), F.col("sketch").alias("of_a")), "a").join(nodes.select(F.col("node").alias("b"), F.col("sketch").alias("of_b")), "b")
    return held.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """pairs (a, b: distinct) with ``near``: whether their texts have a similarity of at least ``least``."""
    slots = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / SLOT).alias("slots")), "slots")
    first = texts.withColumnsRenamed({"node": "a", "text": "text_a"}).join(slots, "a").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
    dealt = pairs.join(slots, "a").withColumn("slot", F.pmod(F.xxhash64("b"), F.col("slots"))).drop("slots")
    second = texts.withColumnsRenamed({"node": "b", "text": "text_b"})
    rows = dealt.join(second, "b").join(first.drop("slots"), ["a", "slot"]).select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, last, mine = worker_cache(("words",), _Hashes), None, None
        for batch in batches:
            near = []
            for k, a in enumerate(batch.column(0).to_pylist()):
                if a != last:
                    last, mine = a, shingles(words_of(text_of(batch.column(2)[k])), words, memo)
                near.append(similarity(mine, shingles(words_of(text_of(batch.column(3)[k])), words, memo)) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.bool_())], names=["a", "b", "near"])

    out = cut(rows.mapInArrow(run, "a long, b long, near boolean"), "verified")
    discard(slots)
    return out


def _open(shared: DataFrame, roots: DataFrame | None) -> DataFrame:
    """shared (bucket, node) with each node's component; buckets of one component are left out."""
    if roots is None:
        placed = shared.select("bucket", "node", F.col("node").alias("root"))
    else:
        placed = shared.select("bucket", "node").join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    ends = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("node").alias("leader"), F.min_by("root", "node").alias("head"), F.count("*").alias("n")).where("low < high")
    ends = cut(ends.select("bucket", "leader", "head", "n"), "ends")  # as a table, so that Spark can split the rows of large buckets
    out = cut(placed.join(ends, "bucket"), "buckets")
    discard(ends)
    return out


def unit_pairs(node: np.ndarray, root: np.ndarray, tile: np.ndarray, split: bool, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes (smaller first) of different components, in a split unit also of different tiles, that their sketches do not rule out. What is in the largest component is not compared with itself."""
    _, which, many = np.unique(root, return_inverse=True, return_counts=True)
    most = which == many.argmax()
    order = np.concatenate((np.flatnonzero(~most), np.flatnonzero(most)))
    node, root, tile, sketch = node[order], root[order], tile[order], sketch[order]
    found, n = [np.zeros((2, 0), np.int64)], int((~most).sum())
    for at in range(0, n, 64):
        end = min(at + 64, n)
        i, j = np.nonzero(_alike(sketch[at:end, None, :], sketch[None, at:, :]))
        i, j = i + at, j + at
        keep = (i < j) & (root[i] != root[j])
        if split:
            keep &= tile[i] != tile[j]
        found.append(np.sort(np.stack((node[i[keep]], node[j[keep]])), axis=0))
    a, b = np.concatenate(found, axis=1)
    return a, b


def rest_pairs(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: the likely pairs of different components in what is left of the buckets (bucket, node, root, n)."""
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    rows = shared.select("bucket", "node", "root", tiles.alias("tiles")).withColumn("tile", F.pmod(F.xxhash64("node", F.lit(1)), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    units = rows.select("bucket", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "node", "root", "tile")
    units = units.join(nodes.select("node", "sketch"), "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").select("bucket", "i", "j", "node", "root", "tile", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def told(columns: list[np.ndarray], ends: list[int]) -> pa.RecordBatch:
            parts, start = [np.zeros((2, 0), np.int64)], 0
            for end in ends:
                at = slice(start, end)
                parts.append(np.stack(unit_pairs(columns[3][at], columns[4][at], columns[5][at], bool(columns[1][start] != columns[2][start]), columns[6][at])))
                start = end
            a, b = np.unique(np.concatenate(parts, axis=1), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)] + [np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(batch.num_rows, -1)]
            columns = [np.concatenate((h, x)) for h, x in zip(held, new, strict=True)] if held else new
            moved = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]) | (columns[2][1:] != columns[2][:-1])
            ends = (np.flatnonzero(moved) + 1).tolist()
            yield told(columns, ends)
            held = [c[ends[-1] if ends else 0 :] for c in columns]
        if held:
            yield told(held, [len(held[0])])

    return units.mapInArrow(run, "a long, b long")


def links(docs: DataFrame, nodes: DataFrame, words: int, least: float, first: DataFrame | None = None) -> DataFrame | None:
    """(node, root) as of components(), for nodes (node, h1, h2, buckets, sketch) that are near each other; None if none are.

    first: candidates (a, b: distinct, a < b) found another way, which are verified before the rounds, so that these only
    compare what is not in one component yet.
    """
    roots, texts, refused = None, None, None
    if first is not None:
        ends = first.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        held = _texts(docs, nodes.select("node", "h1", "h2").join(ends, "node", "left_semi"))
        told = verified(first, held, words, least)
        discard(held)
        roots, refused = components(told.where("near").select("a", "b")), told.where("NOT near").select("a", "b")
    shared = _open(nodes.select(F.explode("buckets").alias("bucket"), "node"), roots)
    for k in range(ROUNDS + 1):
        size = shared.agg(F.countDistinct("node").alias("nodes"), F.sum(F.col("n") - 1).alias("pairs")).first()
        if not size["nodes"]:
            break
        if texts is None:
            texts = _texts(docs, nodes.select("node", "h1", "h2").join(shared.select("node").distinct(), "node", "left_semi"))
        rest = k == ROUNDS or size["pairs"] <= FEW * size["nodes"]
        if rest:
            pairs = rest_pairs(shared, nodes).distinct()
        else:
            pairs = likely(shared.where("node > leader AND root <> head").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), nodes)
        pairs = cut(pairs if refused is None else pairs.join(refused, ["a", "b"], "left_anti"), "pairs")
        told = verified(pairs, texts, words, least)
        discard(pairs)
        found, no = told.where("near").select("a", "b"), told.where("NOT near").select("a", "b")
        refused = no if refused is None else refused.unionAll(no)
        # what earlier rounds joined comes as stars, so only the new links take rounds of their own
        roots = components(found if roots is None else found.unionAll(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        if rest:
            break
        last, shared = shared, _open(shared.where("node > leader"), roots)
        discard(last)
    discard(shared, texts)
    return roots


def near_copies(docs: DataFrame, words: int = 5, least: float = LEAST, mark: Callable[[str], int] | None = None, propose: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id and component_id, the smallest doc_id that chains of near copies reach (null if none has one), of every row.

    propose: from nodes (node, and mark, what ``mark`` makes of its text: the same for texts of the same words) candidates for
    links(). Texts are marked where they are read, so only those of candidates move.
    """
    free_shuffles(docs.sparkSession)
    signed = cut(signatures(docs, words, mark), "signatures")
    each = signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.first("buckets").alias("buckets"), F.first("sketch").alias("sketch"), F.first("mark").alias("mark"))
    nodes = cut(each.withColumn("node", F.monotonically_increasing_id()), "nodes")
    rows = cut(signed.select("doc_id", "h1", "h2"), "rows")
    discard(signed)
    first = None
    if propose is not None:
        first = cut(propose(nodes.where("sketch IS NOT NULL").select("node", "mark")), "proposed")
    roots = links(docs, nodes, words, least, first)
    placed = nodes.select("h1", "h2", "first", F.col("node").alias("root"))
    if roots is not None:
        placed = nodes.select("node", "h1", "h2", "first").join(roots, "node", "left").select("h1", "h2", "first", F.coalesce("root", "node").alias("root"))
    placed = cut(placed, "placed")
    discard(nodes, first)
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    found = placed.join(smallest, "root").select("h1", "h2", "component_id")
    return rows.join(found, ["h1", "h2"]).select("doc_id", "component_id")
