"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

The encoding of a byte string has the property that the encodings of all its prefixes form a tree:
the last token of a prefix's encoding follows the encoding of a shorter prefix. The transducer reads
bytes and keeps the part of that tree that a later byte can still use. What all live branches share
is certain, so it is emitted; the rest is the bounded lookahead, at most the branches whose open text
is still the beginning of some token. A deterministic state is one such pending tree; states and
transitions are made when first met and kept in a bounded table.

Which token may end a prefix is decided by the merges alone: token b may follow token a iff encoding
the bytes of a and b together by merges gives exactly (a, b).

Defined cases: ill-formed UTF-8 counts as U+FFFD; a null text is encoded as the empty text (no ids); repeated rows give repeated rows;
an empty table gives an empty table; ill-formed bytes decode to U+FFFD in texts and stay as they are
in decoded bytes. Columns named like the results are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.llm.common import text_of, worker_cache

#: Bounds of the tables that a worker keeps: deterministic states, and encodings of whole pre-tokens.
MAX_STATES, MAX_PIECES, MEMO_CHARS = 250_000, 200_000, 48
#: Pre-tokens, or ids, that are handled at once.
CHUNK = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Encodes pre-tokens. ``ranks`` holds every single byte."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, states: int | None = None, pieces: int | None = None):
        self.max_states, self.max_pieces = states or MAX_STATES, pieces or MAX_PIECES
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.token_bytes = {i: b for b, i in ranks.items()}
        self.child: dict[int, int] = {}  # place and byte to the next place
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                nxt = self.child.get(node << 8 | byte)
                if nxt is None:
                    nxt = self.child[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = rank
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        self.fresh: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        #: Numbers of tokens that another operator remembers with this machine.
        self.counts: dict[str, int] | None = None
        self._forget()

    def _forget(self) -> None:
        #: A state: the last certain token (-1 none, -2 no matter), then for each live branch its open tokens and its place in the trie.
        self.states: list[tuple] = [(-1, (), 0)]
        self.number = {self.states[0]: 0}
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.final: dict[int, tuple[int, ...]] = {}

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; (-1, -1) for a byte, None if merges never make the token."""
        if token not in self.splits:
            parts, ranks = [bytes([b]) for b in self.token_bytes[token]], self.ranks
            while len(parts) > 2:
                rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
                if rank == 1 << 40:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.splits[token] = (-1, -1) if len(parts) == 1 else (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None
        return self.splits[token]

    def _may_follow(self, a: int, b: int) -> bool:
        """Takes back the merges of a and b, latest first; at no time may a merge across their border have been due."""
        if a < 0:
            return self._split(b) is not None
        found = self.follows.get((a, b))
        if found is None:
            if len(self.follows) > 4 * self.max_states:
                self.follows.clear()
            left, right, due, found = a, b, 1 << 40, self._split(b) is not None
            while found:
                across = self.ranks.get(self.token_bytes[left] + self.token_bytes[right])
                if across is not None and across < due:
                    found = False
                    break
                before, after = self._split(left), self._split(right)
                if before == after == (-1, -1):
                    break
                if after == (-1, -1) or before != (-1, -1) and left > right:
                    due, left = left, before[1]
                else:  # of equal ranks the merge on the left comes first
                    due, right = right + 1, after[0]
            self.follows[a, b] = found
        return found

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """One transition: the new state and the tokens that have become certain."""
        now = self.states[state]
        last, paths, places = now[0], now[1::2], now[2::2]
        child, token_at, follows, moved, ended = self.child, self.token_at, self.follows, [], None
        for path, place in zip(paths, places, strict=True):
            place = child.get(place << 8 | byte)
            if place is None:
                continue
            moved.append(path)
            moved.append(place)
            if ended is None and (token := token_at[place]) >= 0:
                before = path[-1] if path else last
                may = follows.get((before, token))
                if self._may_follow(before, token) if may is None else may:
                    ended = (*path, token)
        if ended is not None:
            moved.append(ended)
            moved.append(0)
        paths = moved[::2]
        out = paths[0]
        for path in paths:
            k = min(len(out), len(path))
            while path[:k] != out[:k]:
                k -= 1
            out = out[:k]
        if out:
            k, last = len(out), out[-1]
            moved[::2] = paths = [path[k:] for path in paths]
        after = (last if () in paths else -2, *moved)
        number = self.number.get(after)
        if number is None:
            number = self.number[after] = len(self.states)
            self.states.append(after)
        self.steps[state << 8 | byte] = found = (number, out)
        return found

    def _end(self, state: int) -> tuple[int, ...]:
        now = self.states[state]
        self.final[state] = found = next(path for path, place in zip(now[-2::-2], now[:0:-2], strict=False) if place == 0)
        return found

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(self.states) > self.max_states:
            self._forget()
        state, out, steps = 0, [], self.steps
        for at, byte in enumerate(data):
            found = steps.get(state << 8 | byte)
            if found is None:
                if len(self.states) > 2 * self.max_states:  # within one very long piece: keep only where we are
                    here = self.states[state]
                    self._forget()
                    steps, state = self.steps, self.number.setdefault(here, len(self.states))
                    if state == len(self.states):
                        self.states.append(here)
                found = self._step(state, byte)
            state, certain = found
            if certain:
                out += certain
        last = self.final.get(state)
        out += self._end(state) if last is None else last
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        fresh, old, out = self.fresh, self.old, []
        matches = (m.group() for m in self.pattern.finditer(text)) if len(text) > CHUNK * 16 else self.pattern.findall(text)
        for piece in matches:
            ids = fresh.get(piece)
            if ids is None:
                ids = old.get(piece)
                if ids is None:
                    ids = tuple(self.encode_piece(piece.encode("utf-8", "replace")))
                if len(piece) <= MEMO_CHARS:
                    if len(fresh) >= self.max_pieces:  # what is still in use moves on to the next generation
                        self.old, self.fresh = fresh, {}
                        fresh, old = self.fresh, self.old
                    fresh[piece] = ids
            out += ids
        return out


#: The UTF-8 machine. States: 0 between code points, 1 to 3 so many bytes to come, 4 to 7 after E0, ED, F0 and F4, whose next byte is narrower.
REJECT = 8
_RANGES = [
    (0, 0x00, 0x7F, 0), (0, 0xC2, 0xDF, 1), (0, 0xE0, 0xE0, 4), (0, 0xE1, 0xEF, 2), (0, 0xED, 0xED, 5), (0, 0xF0, 0xF0, 6), (0, 0xF1, 0xF3, 3), (0, 0xF4, 0xF4, 7),
    (1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2),
]


def _utf8_table() -> list[bytes]:
    rows = [bytearray([REJECT] * 256) for _ in range(REJECT)]
    for state, low, high, after in _RANGES:
        rows[state][low : high + 1] = bytes([after]) * (high + 1 - low)
    return [bytes(row) for row in rows]


UTF8 = _utf8_table()


class Utf8Machine:
    """Incremental UTF-8: bytes come in pieces of any size, whole code points go out; at most three bytes wait.

    What cannot be continued becomes one U+FFFD, and the byte that did not fit begins anew.
    """

    def __init__(self, held: bytes = b"", state: int = 0) -> None:
        self.held, self.state = held, state

    def feed(self, data: bytes) -> str:
        if not self.held and data.isascii():
            return data.decode("ascii")
        begun, state, done = len(self.held), self.state, 0
        data, out = self.held + data, []
        for at in range(begun, len(data)):
            state = UTF8[state][data[at]]
            if state == REJECT:
                whole = self._whole(data, done, at)
                out.append(data[done:whole].decode("utf-8"))
                if whole < at:  # an open code point ends here
                    out.append("\ufffd")
                state, done = UTF8[0][data[at]], at
                if state == REJECT:
                    out.append("\ufffd")
                    state, done = 0, at + 1
        whole = self._whole(data, done, len(data)) if state else len(data)
        out.append(data[done:whole].decode("utf-8"))
        self.held, self.state = data[whole:], state
        return "".join(out)

    @staticmethod
    def _whole(data: bytes, done: int, end: int) -> int:
        """Where the open code point before end begins; end if none is open. All from done on is sound."""
        for at in range(end - 1, max(done, end - 3) - 1, -1):
            if data[at] >= 0xC0:
                return at if at + (2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4) > end else end
        return end

    def finish(self) -> str:
        rest = "\ufffd" if self.held else ""
        self.held, self.state = b"", 0
        return rest


class StreamDecoder:
    """Token ids to text through the UTF-8 machine: what it does with a token in a state is worked out once.

    A token of whole code points is its text in the state between code points, whatever came before.
    """

    MEMO = 200_000

    def __init__(self, token_bytes: dict[int, bytes]):
        self.bytes, self.steps = token_bytes, {}
        self.whole: list[str] = [""] * (max(token_bytes, default=-1) + 1)
        self.open = np.ones(len(self.whole), bool)
        for token, data in token_bytes.items():
            machine = Utf8Machine()
            text = machine.feed(data)
            if not machine.held and "\ufffd" not in text:
                self.whole[token], self.open[token] = text, False

    def _step(self, held: bytes, state: int, token: int) -> tuple[bytes, int, str]:
        found = self.steps.get((held, token))
        if found is None:
            machine = Utf8Machine(held, state)
            text = machine.feed(self.bytes[token])
            if len(self.steps) >= self.MEMO:
                self.steps.clear()
            found = self.steps[held, token] = (machine.held, machine.state, text)
        return found

    def decode(self, ids: np.ndarray) -> str:
        out, held, state, at = [], b"", 0, 0
        for begin in range(0, len(ids), CHUNK):
            some = ids[begin : begin + CHUNK]
            tokens, stops, at = some.tolist(), [*np.flatnonzero(self.open[some]).tolist(), len(some)], 0
            for stop in stops:
                while held and at < stop:
                    held, state, text = self._step(held, state, tokens[at])
                    out.append(text)
                    at += 1
                if at < stop:
                    out += map(self.whole.__getitem__, tokens[at:stop])
                if stop < len(tokens):
                    held, state, text = self._step(held, state, tokens[stop])
                    out.append(text)
                at = stop + 1
        if held:
            out.append("\ufffd")
        return "".join(out)


def transducer(key: int, ranks: dict[bytes, int], pattern: str, states: int | None = None, pieces: int | None = None) -> Transducer:
    """One for each Python worker: states met in one task serve the next."""
    return worker_cache(("transducer", key, pattern, states, pieces), lambda: Transducer(ranks, pattern, states, pieces))


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    kept = [i for i, n in enumerate(batch.schema.names) if n not in columns]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + list(columns.values()), names=[batch.schema.names[i] for i in kept] + list(columns))


def encode(spark: SparkSession, docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids", states: int | None = None, pieces: int | None = None) -> DataFrame:
    """docs with a column of token ids. path: a file of ranks, read on the driver; its size does not depend on the data.

    states and pieces bound the tables of a worker (about 0.5 kB for each); they change time and memory only.
    """
    shared, key = spark.sparkContext.broadcast(read_ranks(path)), hash(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(key, shared.value, pattern, states, pieces)
        for batch in batches:
            offsets, parts = [0], []
            for value in batch.column(text):
                ids = np.array(machine.encode(text_of(value) or ""), np.int32)
                parts.append(ids)
                offsets.append(offsets[-1] + len(ids))
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            yield _with(batch, **{into: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))})

    fields = [f for f in docs.schema.fields if f.name != into]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(into, T.ArrayType(T.IntegerType()))]))


def decode(spark: SparkSession, encoded: DataFrame, path: str, ids: str = "ids", into: str = "decoded", as_text: bool = False) -> DataFrame:
    """encoded with the decoded bytes, or the decoded text, in place of the ids. Null ids decode to nothing."""
    shared = spark.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[int, bytes] = {i: b for b, i in shared.value.items()}
        machine = StreamDecoder(table) if as_text else None
        for batch in batches:
            out: list[bytes | str] = []
            for value in batch.column(ids):
                numbers = value.values.to_numpy(zero_copy_only=False) if value.is_valid else np.zeros(0, np.int32)
                out.append(machine.decode(numbers) if as_text else b"".join(map(table.__getitem__, numbers.tolist())))
            done = pa.array(out, pa.string() if as_text else pa.binary())
            yield _with(batch.select([n for n in batch.schema.names if n != ids]), **{into: done})

    fields = [f for f in encoded.schema.fields if f.name not in (ids, into)]
    return encoded.mapInArrow(run, T.StructType([*fields, T.StructField(into, T.StringType() if as_text else T.BinaryType())]))


def digests(spark: SparkSession, docs: DataFrame, path: str, pattern: str, states: int | None = None, pieces: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and text_matches: every text encoded, and its ids decoded again by the UTF-8 machine."""
    encoded = encode(spark, docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), path, pattern, states=states, pieces=pieces)
    summed = encoded.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), "ids")
    return decode(spark, summed, path, as_text=True).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), (F.sha2("decoded", 256) == F.col("text_sha256")).alias("text_matches"))
