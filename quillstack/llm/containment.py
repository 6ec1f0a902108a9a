"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item of q distinct five-word shingles is contained in a document if the document has at least
need = ceil(``SHARE`` * q) of them. A document is far longer than an item, so a sketch of the document says
nothing about the item; the items carry the sketches. Items are partitioned by size: class c holds items of
2^c to 2^(c+1) - 1 shingles of one length, and all its MinHash sketches have one length, that of its largest
possible item: the k = q - need + 1 smallest shingle hashes at q = 2^(c+1) - 1 (an item with fewer gives
all). A contained item lacks q - need hashes at most, so at least (sketch length) - (q - need) of its sketch
are in the document: at least one, and more the smaller an item is in its class. Every document's shingles,
all of them, are looked up class by class; classes whose smallest items need more shingles than the document
has are passed over. The search loses nothing. Pairs with enough shared hashes are verified on the shingles'
words themselves.

Items come in blocks of bounded size (a stated query set against all rows, in blocks); each block is
broadcast, and the documents never move.

Words: lower case, ASCII punctuation parts words. An item of fewer than five words is one shingle of
all its words. Defined cases: ill-formed UTF-8 counts as U+FFFD; null texts and texts without words contain nothing and are contained in
nothing; repeated rows give repeated rows; an empty table of either kind gives no hits; columns of
the documents other than doc_id and text are not read (``drop_contaminated`` passes them on).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import text_of, worker_cache

WORDS, SHARE = 5, 0.8
#: Characters of items in a broadcast block, about, and words whose hash a task remembers.
BLOCK_CHARS, MEMO_WORDS = 32_000_000, 400_000
FILTER_BITS = 21
_TABLE = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_TABLE).split()


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for j in range(n):
        out *= _STEP
        out += hashes[j : j + len(out)]
    return out ^ (out >> np.uint64(31))


def needed(q: int, share: float) -> int:
    return math.ceil(share * q - 1e-9)


@dataclass
class SizeClass:
    """Sketches of the items of one size class: sorted hashes, the places of the items that own them, and a filter of hash ends."""

    words: int
    least: int
    keys: np.ndarray
    owners: np.ndarray
    seen: np.ndarray


@dataclass
class Items:
    """A block of items. ``hits`` says how many hashes of an item's sketch a document must have."""

    ids: list[int]
    grams: list[set[tuple[bytes, ...]]]
    hashes: list[np.ndarray]
    hits: list[int]
    classes: list[SizeClass] = field(default_factory=list)


def build(rows: list[tuple[int, str | None]], words: int = WORDS, share: float = SHARE) -> Items:
    memo, items, by_class = _Hashes(), Items([], [], [], []), {}
    for item_id, text in rows:
        parts = words_of(text)
        if not parts:
            continue
        n = min(words, len(parts))
        hashes = np.unique(shingle_hashes(np.fromiter(map(memo.__getitem__, parts), np.uint64, len(parts)), n))
        at, q = len(items.ids), len(hashes)
        largest = (1 << q.bit_length()) - 1
        sketch = hashes[: largest - needed(largest, share) + 1]
        items.ids.append(item_id)
        items.grams.append({tuple(parts[i : i + n]) for i in range(len(parts) - n + 1)})
        items.hashes.append(hashes)
        items.hits.append(max(1, len(sketch) - (q - needed(q, share))))
        by_class.setdefault((n, q.bit_length()), []).append((at, sketch))
    for (n, bits), members in sorted(by_class.items()):
        keys = np.concatenate([sketch for _, sketch in members])
        owners = np.repeat(np.array([at for at, _ in members], np.int64), [len(sketch) for _, sketch in members])
        order = np.argsort(keys, kind="stable")
        seen = np.zeros(1 << FILTER_BITS, bool)
        seen[(keys & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
        items.classes.append(SizeClass(n, needed(1 << (bits - 1), share), keys[order], owners[order], seen))
    return items


def candidates(items: Items, held: SizeClass, doc: np.ndarray) -> list[int]:
    """Places of the items of a class that have enough sketch hashes in a document's shingles."""
    hits = np.unique(doc[held.seen[(doc & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)]])
    left, right = np.searchsorted(held.keys, hits, "left"), np.searchsorted(held.keys, hits, "right")
    found = left < right
    if not found.any():
        return []
    owners = np.concatenate([held.owners[a:b] for a, b in zip(left[found], right[found], strict=True)])
    places, counts = np.unique(owners, return_counts=True)
    return [at for at, n in zip(places.tolist(), counts.tolist(), strict=True) if n >= items.hits[at]]


def find(items: Items, parts: list[bytes], memo: _Hashes, share: float = SHARE) -> Iterator[tuple[int, int, int, int, int]]:
    """(item's place, distinct shingles found, of, first word, last word) for each item contained in the words."""
    word_hashes = np.fromiter(map(memo.__getitem__, parts), np.uint64, len(parts))
    docs: dict[int, np.ndarray] = {}
    for held in items.classes:
        n = held.words
        if len(parts) - n + 1 < held.least:
            continue
        if n not in docs:
            docs[n] = shingle_hashes(word_hashes, n)
        doc = docs[n]
        for at in candidates(items, held, doc):
            places = np.flatnonzero(np.isin(doc, items.hashes[at]))
            exact = [p for p in places.tolist() if tuple(parts[p : p + n]) in items.grams[at]]
            found, of = len({tuple(parts[p : p + n]) for p in exact}), len(items.grams[at])
            if found >= share * of - 1e-9:
                yield at, found, of, exact[0], exact[-1] + n - 1


def blocks(items: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The items, block by block; a block has about BLOCK_CHARS characters at most."""
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // BLOCK_CHARS))
    keyed = items.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("block"))
    for k in range(n):
        yield [(r.item_id, r.text) for r in keyed.where(F.col("block") == k).orderBy("item_id", "text").collect()]


def search(docs: DataFrame, items: DataFrame, words: int = WORDS, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, found, of, containment, first_word, last_word: one row for each item contained in a document."""
    schema = "doc_id long, item_id long, found int, of int, containment double, first_word int, last_word int"
    names = ["doc_id", "item_id", "found", "of", "containment", "first_word", "last_word"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = None
    for rows in blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(build(rows, words, share))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            memo, block = worker_cache(("words",), _Hashes), shared.value
            for batch in batches:
                hits = [(d, block.ids[at], found, of, found / of, a, b) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for at, found, of, a, b in find(block, words_of(text_of(t)), memo, share)]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*hits, strict=True), kinds, strict=True)], names=names)

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, words: int = WORDS, share: float = SHARE) -> DataFrame:
    """docs without those that contain an item. Rows stay where they are: nothing is shuffled."""
    for rows in blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(build(rows, words, share))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            memo = worker_cache(("words",), _Hashes)
            for batch in batches:
                keep = [next(find(shared.value, words_of(text_of(t)), memo, share), None) is None for t in batch.column("text")]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


#: DuckDB SQL for the query; items are told apart by item_id there.
ORACLE = f"""
WITH cut AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
wo AS (SELECT kind, id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM cut),
it AS (SELECT id AS item_id, w, least({WORDS}, len(w)) AS n FROM wo WHERE kind = 'i' AND len(w) > 0),
ig AS (SELECT DISTINCT item_id, n, g FROM (SELECT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM it)),
q AS (SELECT item_id, count(*)::INT AS "of" FROM ig GROUP BY item_id),
dg AS (SELECT id AS doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g, unnest(range(0, len(w) - n + 1)) AS pos FROM wo, (SELECT DISTINCT n FROM it) WHERE kind = 'd'),
m AS (SELECT doc_id, item_id, count(DISTINCT g)::INT AS found, min(pos)::INT AS first_word, (max(pos) + any_value(n) - 1)::INT AS last_word FROM dg JOIN ig USING (n, g) GROUP BY ALL)
SELECT doc_id, item_id, found, "of", found / "of" AS containment, first_word, last_word FROM m JOIN q USING (item_id) WHERE found >= {SHARE} * "of" - 1e-9
"""
