"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

A document's tokens (and one end token) are cut into pieces of ``CAPACITY`` only where they are more; pieces are packed into
as few sequences as can be found. Full pieces are sequences of their own. The others are dealt to shards of about ``SHARD``
pieces by a hash of their row, so that copies and equal lengths spread evenly, and each shard is packed by ``ISLANDS``
populations. A population holds whole packings. Crossover takes well-filled sequences of one parent whole into the other,
removes the sequences there that hold the same pieces, and puts the pieces which that displaced back by best fit, largest
first; mutation dissolves the emptiest sequences and some others. Fitness is the mean square of the fill. After each round
an island's best packings go to the next island of its shard, in a ring; rounds end when every shard has a packing that
a lower bound proves to be best, or after ``ROUNDS``.

What a shard could not fill is gathered: the sequences that are less than ``GIVEN_UP`` full are dissolved and their pieces
are packed again in shards of their own, level by level, until one shard is left or no more than a tenth is gained. So
the sequences that are not full do not grow with the number of shards. Nothing but counts reaches the driver; a shard has a bounded
number of pieces whatever the data hold.

Tokens: a text is cut at spaces and line feeds, which the tokenizer's own white space covers and across which it
neither composes letters nor merges; what stands between has its ids looked up in a bounded table, and is made by the
tokenizer's own normaliser, pre-tokenizer and model where it is not there.

Defined cases: a null text is empty, an empty document is its end token; rows that repeat a doc_id are documents of their
own, and a null doc_id stays null; ill-formed UTF-8 counts as U+FFFD; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import cut, worker_cache

CAPACITY, END = 4096, 1
SHARD, ISLANDS, ROUNDS, LEVELS = 4096, 4, 3, 6
#: Packings of a population, generations in a round, and packings that leave for the next island.
POPULATION, GENERATIONS, ELITE = 6, 12, 1
#: Sequences of a shard that are less full than this go on to the next level.
GIVEN_UP = 0.97
SEED = 13
#: Texts between spaces, and pre-tokens, whose ids a worker keeps: at most twice as many.
CHUNKS, WORDS = 600_000, 250_000

# --- tokens

#: The tokenizer's pattern, written for lower-case text of ASCII and the letters of Latin-1; a fixed value of its vocabulary.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
#: Text for that pattern: its letters are composed already and lower-cased one by one. Other text takes the tokenizer's own steps.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_LETTERS = "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))


class Memo(dict):
    """What was worked out lately: when ``most`` entries are new, those not asked for since the last time go."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def work_out(self, key: str) -> bytes:
        raise NotImplementedError

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        found = self.older.get(key)
        if found is None:
            found = self.work_out(key)
        self[key] = found
        return found


class Words(Memo):
    """The ids of a pre-token (in the tokenizer's byte alphabet), as bytes of little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(WORDS)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model

    def work_out(self, key: str) -> bytes:
        return struct.pack(f"<{len(ids := [t.id for t in self.model.tokenize(key)])}I", *ids)


class Chunks(Memo):
    """The ids of a stretch without spaces and line feeds."""

    def __init__(self, path: str):
        super().__init__(CHUNKS)
        self.words = Words(path)
        split = self.words.tokenizer.pre_tokenizer.pre_tokenize_str
        self.alphabet = {ord(c): split(c)[0][0] for c in _LETTERS}  # each letter's two bytes

    def work_out(self, key: str) -> bytes:
        if _PLAIN.fullmatch(key):
            low = key.lower()
            parts = _PARTS.findall(low)
            if not low.isascii():
                parts = [p.translate(self.alphabet) for p in parts]
        else:
            t = self.words.tokenizer
            parts = [p for p, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(key))]
        return b"".join(map(self.words.__getitem__, parts))


def ids_of(text: str, chunks: Chunks) -> bytes:
    return b"".join(map(chunks.__getitem__, text.replace("\n", " ").split(" ")))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, row (a number of its own; negative for none) and, if asked for, ids of every piece. path: the tokenizer's file."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = worker_cache(("chunks", path), lambda: Chunks(path))
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows, ids = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = ids_of((text.as_py() or b"").decode("utf-8", "replace"), chunks) + end
                for k, at in enumerate(range(0, len(held), 4 * capacity)):
                    part = held[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), row))
                    row += 1
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            more = [pa.array(ids, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns + more, names=names + ["ids"] * with_ids)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, row long" + (", ids array<int>" if with_ids else ""))


# --- one packing: the number of each piece's sequence, from 0 without gaps


def least_sequences(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound: for each size, pieces too large to lie with pieces of that size stand alone, and the rest must fit in what is left."""
    sizes = np.sort(lengths)
    sums = np.concatenate(([0], np.cumsum(sizes)))
    small = np.unique(np.concatenate(([0], sizes[sizes <= capacity // 2])))
    alone = np.searchsorted(sizes, capacity - small, "right")
    half, first = int(np.searchsorted(sizes, capacity // 2, "right")), np.searchsorted(sizes, small, "left")
    middle = np.maximum(alone, half)
    room = (middle - half) * capacity - (sums[middle] - sums[half])
    need = np.ceil(np.maximum(0, sums[half] - sums[first] - room) / capacity)
    return int((len(sizes) - half + need).max(initial=0)) if len(sizes) else 0


def best_fit(lengths: list[int], order: list[int], assigned: np.ndarray, fill: dict[int, int], capacity: int) -> None:
    """Puts the pieces of order, one by one, where least room is left, in assigned and fill (sequence to tokens); new sequences where none has room."""
    new = max(fill, default=-1) + 1
    free = sorted((capacity - f, s) for s, f in fill.items() if f < capacity)
    for i in order:
        n = lengths[i]
        at = bisect.bisect_left(free, (n, -1))
        if at < len(free):
            room, s = free.pop(at)
        else:
            room, s, new = capacity, new, new + 1
            fill[s] = 0
        fill[s] += n
        assigned[i] = s
        if room > n:
            bisect.insort(free, (room - n, s))


def _fills(lengths: np.ndarray, assigned: np.ndarray) -> np.ndarray:
    return np.bincount(assigned, weights=lengths).astype(np.int64)


def fitness(lengths: np.ndarray, assigned: np.ndarray, capacity: int) -> float:
    fills = _fills(lengths, assigned)
    return float(((fills / capacity) ** 2).mean())


def _refit(lengths: np.ndarray, assigned: np.ndarray, loose: np.ndarray, capacity: int) -> np.ndarray:
    """assigned with the loose pieces (a mask) put back by best fit, largest first; the numbers are made gapless."""
    out = assigned.copy()
    rest = np.flatnonzero(~loose)
    names, dense = np.unique(out[rest], return_inverse=True)
    out[rest] = dense
    fills = np.bincount(dense, weights=lengths[rest]).astype(np.int64) if len(rest) else np.zeros(0, np.int64)
    out_at = np.flatnonzero(loose)
    order = out_at[np.argsort(-lengths[out_at], kind="stable")].tolist()
    best_fit(lengths.tolist(), order, out, dict(enumerate(fills.tolist())), capacity)
    return out


def crossover(lengths: np.ndarray, a: np.ndarray, b: np.ndarray, rng: np.random.Generator, capacity: int) -> np.ndarray:
    """a with some of b's well-filled sequences whole: a's sequences that share a piece with them go, and what else these held is put back."""
    fills = _fills(lengths, b)
    drawn = rng.random(len(fills)) * (fills / capacity) ** 4
    taken = np.argsort(-drawn, kind="stable")[: max(1, int(len(fills) * rng.uniform(0.1, 0.5)))]
    inside = np.isin(b, taken)
    hit = np.isin(a, np.unique(a[inside]))
    child = np.where(inside, b + int(a.max()) + 1, a)
    return _refit(lengths, child, hit & ~inside, capacity)


def mutation(lengths: np.ndarray, a: np.ndarray, rng: np.random.Generator, capacity: int) -> np.ndarray:
    """a with its emptiest sequences and some others dissolved, and their pieces put back in an order that is partly drawn."""
    fills = _fills(lengths, a)
    few = max(1, len(fills) // 50)
    gone = np.union1d(np.argsort(fills, kind="stable")[:few], rng.integers(0, len(fills), 2 * few))
    return _refit(lengths, a, np.isin(a, gone), capacity)


def drawn_packing(lengths: np.ndarray, rng: np.random.Generator | None, capacity: int) -> np.ndarray:
    """Best fit, largest first; with rng in an order that drifts from that."""
    weight = lengths if rng is None else lengths * rng.uniform(0.7, 1.3, len(lengths))
    out = np.zeros(len(lengths), np.int64)
    best_fit(lengths.tolist(), np.argsort(-weight, kind="stable").tolist(), out, {}, capacity)
    return out


def evolve(lengths: np.ndarray, population: list[np.ndarray], rng: np.random.Generator, capacity: int, generations: int = GENERATIONS) -> tuple[list[np.ndarray], bool]:
    """The population after some generations, best first, and whether its best is proven to be one."""
    goal = least_sequences(lengths, capacity)
    rated = sorted(((fitness(lengths, p, capacity), k, p) for k, p in enumerate(population)), key=lambda x: (-x[0], x[1]))
    made = len(rated)
    proven = lambda: int(rated[0][2].max(initial=-1)) + 1 <= goal
    for _ in range(generations):
        if proven():
            break
        for _ in range(max(1, len(rated) // 2)):
            i, j = (int(min(rng.integers(0, len(rated), 2))) for _ in range(2))  # tournaments of two
            child = crossover(lengths, rated[i][2], rated[j][2], rng, capacity) if i != j else mutation(lengths, rated[i][2], rng, capacity)
            if rng.random() < 0.3:
                child = mutation(lengths, child, rng, capacity)
            rated.append((fitness(lengths, child, capacity), made, child))
            made += 1
        rated = sorted(rated, key=lambda x: (-x[0], x[1]))[: len(population)]
    return [p for _, _, p in rated], proven()


# --- islands


_STATE = "shard long, island int, rows array<long>, lengths array<int>, population array<array<int>>, score double, proven boolean"
_NAMES = [c.split()[0] for c in _STATE.split(", ")]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one at a time: each holds a shard."""
    return (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows))


def _evolved(state: DataFrame, turn: int, capacity: int) -> DataFrame:
    """A round of every island: state (as _STATE, population empty at first) with the migrants (array<array<int>>) that come to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                lengths = np.array(row["lengths"], np.int64)
                rng = np.random.default_rng([SEED, turn, row["island"], row["shard"]])
                held = [np.array(p, np.int64) for p in row["population"]]
                if held:
                    come = [np.array(p, np.int64) for p in row["migrants"]]
                    held = held[: len(held) - len(come)] + come  # the worst make room
                else:
                    first = drawn_packing(lengths, None if row["island"] == 0 else rng, capacity)
                    done = int(first.max(initial=-1)) + 1 <= least_sequences(lengths, capacity)
                    held = [first] + [drawn_packing(lengths, rng, capacity) for _ in range(0 if done else POPULATION - 1)]
                held, proven = evolve(lengths, held, rng, capacity)
                row |= {"population": [p.tolist() for p in held], "score": fitness(lengths, held[0], capacity), "proven": proven}
                yield pa.RecordBatch.from_pylist([{n: row[n] for n in _NAMES}], schema)

    schema = pa.schema(list(zip(_NAMES, (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())), pa.float64(), pa.bool_()), strict=True)))
    return state.mapInArrow(run, _STATE)


def pack_shards(rows: DataFrame, shards: int, level: int, capacity: int = CAPACITY) -> DataFrame:
    """rows (row, length) to row, length, shard, sequence, at (its place in the sequence), fill: each shard's best packing."""
    shard = F.pmod(F.xxhash64(F.col("row"), F.lit(level)), F.lit(shards))
    listed = rows.groupBy(shard.alias("shard")).agg(F.array_sort(F.collect_list(F.struct("row", F.col("length").cast("int").alias("length")))).alias("all"))
    start = listed.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("all.row").alias("rows"), F.col("all.length").alias("lengths"))
    none = F.array().cast("array<array<int>>")
    start = start.withColumns({"population": none, "score": F.lit(0.0), "proven": F.lit(False), "migrants": none})
    state = cut(_evolved(start.repartition(F.col("shard"), F.col("island")), 0, capacity), "islands")
    for turn in range(1, ROUNDS):
        best = state.groupBy("shard").agg(F.max("proven").alias("done"))
        if best.where("NOT done").isEmpty():
            break
        come = state.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.slice("population", 1, ELITE).alias("migrants"))
        open_ = state.join(best.where("NOT done"), "shard", "left_semi").join(come, ["shard", "island"])
        state = cut(_evolved(open_, turn, capacity).unionByName(state.join(best.where("done"), "shard", "left_semi")), "islands")
    chosen = state.groupBy("shard").agg(F.max_by(F.struct("rows", "lengths", F.get("population", F.lit(0)).alias("packing")), F.struct("proven", "score", -F.col("island"))).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                lengths, packing = np.array(row["lengths"], np.int64), np.array(row["packing"], np.int64)
                fills = _fills(lengths, packing)
                order = np.argsort(packing, kind="stable")
                before = np.cumsum(lengths[order]) - lengths[order]
                at = before - (np.cumsum(fills) - fills)[packing[order]]
                columns = [np.array(row["rows"], np.int64)[order], lengths[order], np.full(len(order), row["shard"]), packing[order], at, fills[packing[order]]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "length", "shard", "sequence", "at", "fill"])

    return chosen.select("shard", "b.*").mapInArrow(run, "row long, length long, shard long, sequence long, at long, fill long")


def pack(parts: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """parts (row, length: at most capacity) to row, sequence_id (not negative for sequences of several pieces) and offset. parts must be a stored table: it is read more than once."""
    full = parts.where(F.col("length") == capacity).select("row", (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, settled = parts.where(F.col("length") < capacity).select("row", "length"), [full]
    n = rest.count()
    for level in range(LEVELS):
        if not n:
            break
        shards = -(-n // shard)
        packed = cut(pack_shards(rest, shards, level, capacity), "packed")
        loose = packed.where(F.col("fill") < int(GIVEN_UP * capacity))
        left = loose.agg(F.count("*").alias("n"), F.sum("length").alias("tokens"), F.count_distinct("shard", "sequence").alias("sequences")).first()
        again = shards > 1 and level < LEVELS - 1 and left["n"] and left["sequences"] - -(-left["tokens"] // capacity) > left["sequences"] // 10
        kept = packed.where(F.col("fill") >= int(GIVEN_UP * capacity)) if again else packed
        settled.append(kept.select("row", ((F.col("shard") * (1 << 20) + F.col("sequence")) * 8 + level).alias("sequence_id"), F.col("at").alias("offset")))
        if not again:
            break
        rest, n = loose.select("row", "length"), left["n"]
    out = settled[0]
    for df in settled[1:]:
        out = out.unionByName(df)
    return out


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    parts = cut(pieces(docs, path, capacity), "pieces")
    placed = pack(parts.select("row", "length"), capacity)
    return parts.join(placed, "row").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and ids (array<int>): the packed sequences themselves, of at most ``capacity`` tokens each."""
    parts = cut(pieces(docs, path, capacity, with_ids=True), "pieces")
    placed = parts.select("row", "ids").join(pack(parts.select("row", "length"), capacity), "row")
    listed = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("all"))
    return listed.select("sequence_id", F.flatten("all.ids").alias("ids"))
