"""Edit-aware token counts.

A document keeps a segment tree over its pre-tokens: a leaf stands for ``LEAF`` pre-tokens in a row and
holds how many characters and tokens they have; inner nodes hold sums. The tree's leaves are stored as two
arrays beside the text, from which the sums follow. An edit (from, to, new) is applied by walking down the sums to
the leaf that holds its first touched pre-token, less ``CONTEXT`` pre-tokens of context; from there text is
split again until a new boundary falls on an old one behind the edit, from where on nothing changes.
Only that region is encoded; its leaves are replaced, and only sums on the paths to them are made anew.

Why the context suffices: the pattern's matches run from left to right and depend on the text from their
start to at most two characters behind their end, except in a run of blanks, which is one match and at
most one more. So the first match that an edit can change is at most two before the one it touches.
Splitting again from any old boundary gives the old matches as long as the text is the old one.

Edits of a document are applied in order, each on the text that the ones before it left; places beyond
the end mean the end, a null end or new text means the place itself or nothing. Defined cases: ill-formed UTF-8 counts as U+FFFD; a null
text is empty, has a tree without leaves and can be edited; null or empty edits change nothing; repeated
rows give repeated rows; empty tables give empty tables; other columns are passed on, those named like
the results replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.llm.bpe import MEMO_CHARS, Transducer, _with, read_ranks, transducer
from quillstack.llm.common import text_of

LEAF, CONTEXT = 16, 2
#: Pre-tokens whose number of tokens a worker remembers, in each of two generations.
MAX_COUNTS = 400_000
INTS = T.ArrayType(T.IntegerType())
EDIT = "array<struct<start:int,stop:int,new:string>>"


class Node:
    """Leaves under a node and sums over them; a leaf has no children."""

    __slots__ = ("leaves", "chars", "tokens", "left", "right")

    def __init__(self, chars: int, tokens: int, leaves: int = 1, left: Node | None = None, right: Node | None = None):
        self.chars, self.tokens, self.leaves, self.left, self.right = chars, tokens, leaves, left, right


class CountTree:
    """Sums of characters and tokens over leaves in a tree balanced by weight.

    A range of leaves is replaced by cutting the tree at its two ends and joining the parts with a tree of the new
    leaves: only nodes on the two paths are made anew, which ``made`` counts; all others stay.
    """

    WEIGHT = 3

    def __init__(self, chars: list[int], tokens: list[int]):
        self.made = 0
        self.root = self._build(chars, tokens)

    def _node(self, left: Node, right: Node) -> Node:
        self.made += 1
        return Node(left.chars + right.chars, left.tokens + right.tokens, left.leaves + right.leaves, left, right)

    def _build(self, chars: list[int], tokens: list[int]) -> Node | None:
        self.made += len(chars)
        line = [Node(c, t) for c, t in zip(chars, tokens, strict=True)]
        while len(line) > 1:  # neighbours in pairs; one that is left over joins the last pair's side
            pairs = [self._node(a, b) for a, b in zip(line[::2], line[1::2], strict=False)]
            if len(line) % 2:
                pairs[-1] = self._join(pairs[-1], line[-1])
            line = pairs
        return line[0] if line else None

    def _join(self, a: Node | None, b: Node | None) -> Node | None:
        """The leaves of a, then those of b."""
        if a is None or b is None:
            return b if a is None else a
        if a.leaves > self.WEIGHT * b.leaves:
            if a.right.leaves <= a.left.leaves:
                return self._node(a.left, self._join(a.right, b))
            return self._node(self._node(a.left, a.right.left), self._join(a.right.right, b))
        if b.leaves > self.WEIGHT * a.leaves:
            if b.left.leaves <= b.right.leaves:
                return self._node(self._join(a, b.left), b.right)
            return self._node(self._join(a, b.left.left), self._node(b.left.right, b.right))
        return self._node(a, b)

    def _cut(self, node: Node | None, at: int) -> tuple[Node | None, Node | None]:
        """The first ``at`` leaves, and the rest."""
        if node is None or at <= 0:
            return None, node
        if at >= node.leaves:
            return node, None
        if at <= node.left.leaves:
            a, b = self._cut(node.left, at)
            return a, self._join(b, node.right)
        a, b = self._cut(node.right, at - node.left.leaves)
        return self._join(node.left, a), b

    @property
    def leaves(self) -> int:
        return self.root.leaves if self.root else 0

    @property
    def chars(self) -> int:
        return self.root.chars if self.root else 0

    def total(self) -> int:
        return self.root.tokens if self.root else 0

    def leaf(self, k: int) -> int:
        """How many characters leaf k has."""
        node = self.root
        while node.left is not None:
            if k < node.left.leaves:
                node = node.left
            else:
                k -= node.left.leaves
                node = node.right
        return node.chars

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at place (the last if it is the end), and where the leaf begins."""
        node, first, before = self.root, 0, 0
        while node.left is not None:
            if place >= before + node.left.chars and node.right.chars:
                before += node.left.chars
                first += node.left.leaves
                node = node.right
            else:
                node = node.left
        return first, before

    def splice(self, first: int, last: int, chars: list[int], tokens: list[int]) -> None:
        """Puts new leaves in place of first..last (last not included)."""
        a, rest = self._cut(self.root, first)
        _, b = self._cut(rest, last - first)
        self.root = self._join(self._join(a, self._build(chars, tokens)), b)

    def own(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves, in order."""
        chars, tokens, todo = [], [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if node.left is None:
                chars.append(node.chars)
                tokens.append(node.tokens)
            else:
                todo += [node.right, node.left]
        return chars, tokens


class Counts(dict):
    """Tokens of a pre-token; two generations of them are remembered."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine, self.old = machine, {}

    def __missing__(self, piece: str) -> int:
        n = self.old.get(piece)
        if n is None:
            n = len(self.machine.encode_piece(piece.encode("utf-8", "replace")))
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MAX_COUNTS:
                self.old = dict(self)
                self.clear()
            self[piece] = n
        return n


def _leaves(pieces: list[str], counts: Counts) -> tuple[list[int], list[int]]:
    if not pieces:
        return [], []
    starts = np.arange(0, len(pieces), LEAF)
    chars, tokens = np.fromiter(map(len, pieces), np.int64, len(pieces)), np.fromiter(map(counts.__getitem__, pieces), np.int64, len(pieces))
    return np.add.reduceat(chars, starts).tolist(), np.add.reduceat(tokens, starts).tolist()


def build(text: str, pattern: regex.Pattern, counts: Counts) -> CountTree:
    return CountTree(*_leaves(pattern.findall(text), counts))


def apply_edit(text: str, tree: CountTree, start: int, stop: int, new: str, pattern: regex.Pattern, counts: Counts) -> tuple[str, int]:
    """The edited text, and how many pre-tokens were encoded again. The tree is changed in place."""
    start = min(max(0, start), len(text))
    stop = min(max(start, stop), len(text))
    edited = text[:start] + new + text[stop:]
    if edited == text:
        return text, 0
    if not tree.leaves:
        pieces = pattern.findall(edited)
        tree.splice(0, 0, *_leaves(pieces, counts))
        return edited, len(pieces)
    # the leaf of the touched pre-token; its first CONTEXT pre-tokens may need those of the leaf before it
    first, begin = tree.find(max(0, start - 1))
    kept: list[int] = []
    for m in pattern.finditer(text, begin):
        if m.end() >= start:
            break
        kept.append(m.start())
    if len(kept) < CONTEXT and first:
        first -= 1
        begin -= tree.leaf(first)
    # old leaf borders behind the edit, in the edited text's places
    shift = len(edited) - len(text)
    last, border = tree.leaves, len(text)
    if stop < len(text):
        last, border = tree.find(stop)
        border += tree.leaf(last)
        last += 1
    pieces: list[str] = []
    for m in pattern.finditer(edited, begin):
        place = m.start() - shift
        while border < place and last < tree.leaves:
            border += tree.leaf(last)
            last += 1
        if place == border and border > stop and last < tree.leaves:
            break
        pieces.append(m.group())
    else:
        last = tree.leaves
    tree.splice(first, last, *_leaves(pieces, counts))
    return edited, len(pieces)


def _run(docs: DataFrame, path: str, pattern: str, add: T.StructType, work) -> DataFrame:
    shared, key = docs.sparkSession.sparkContext.broadcast(read_ranks(path)), hash(path)
    names = set(add.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(key, shared.value, pattern)
        if machine.counts is None:  # kept with the machine from task to task
            machine.counts = Counts(machine)
        for batch in batches:
            yield _with(batch, **work(batch, machine.pattern, machine.counts))

    return docs.mapInArrow(run, T.StructType([*(f for f in docs.schema.fields if f.name not in names), *add.fields]))


def with_trees(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with leaf_chars and leaf_tokens (the tree's leaves; sums follow from them) and n_tokens."""
    add = T.StructType().add("leaf_chars", INTS).add("leaf_tokens", INTS).add("n_tokens", "long")

    def work(batch: pa.RecordBatch, split: regex.Pattern, counts: Counts) -> dict[str, pa.Array]:
        own = [_leaves(split.findall(text_of(t) or ""), counts) for t in batch.column("text")]
        return {"leaf_chars": pa.array([c for c, _ in own], pa.list_(pa.int32())), "leaf_tokens": pa.array([t for _, t in own], pa.list_(pa.int32())), "n_tokens": pa.array([sum(t) for _, t in own], pa.int64())}

    return _run(docs, path, pattern, add, work)


def with_edits(treed: DataFrame, edits: DataFrame) -> DataFrame:
    """treed with the edits (doc_id, seq, start, stop, new) of each document as one array, in the order of seq."""
    one = F.struct("start", "stop", "new")
    lists = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", one.alias("edit")))).alias("all")).select("doc_id", F.col("all.edit").cast(EDIT).alias("edits"))
    return treed.drop("edits").join(lists, "doc_id", "left")


def apply_edits(treed: DataFrame, path: str, pattern: str) -> DataFrame:
    """treed after its column ``edits``: new text, leaves and n_tokens, and n_encoded, the pre-tokens that were encoded again."""
    add = T.StructType().add("text", "string").add("leaf_chars", INTS).add("leaf_tokens", INTS).add("n_tokens", "long").add("n_encoded", "long")

    def work(batch: pa.RecordBatch, split: regex.Pattern, counts: Counts) -> dict[str, pa.Array]:
        out: list[list] = [[], [], [], [], []]
        for text, chars, tokens, edits in zip(*(batch.column(n) for n in ("text", "leaf_chars", "leaf_tokens", "edits")), strict=True):
            text, encoded = text_of(text) or "", 0
            tree = CountTree(*(x.as_py() or [] for x in (chars, tokens)))
            for e in edits.as_py() or ():
                if e is not None and e["start"] is not None:
                    stop = e["start"] if e["stop"] is None else e["stop"]
                    text, n = apply_edit(text, tree, e["start"], stop, e["new"] or "", split, counts)
                    encoded += n
            for column, value in zip(out, (text, *tree.own(), tree.total(), encoded), strict=True):
                column.append(value)
        kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64())
        return {n: pa.array(v, k) for n, v, k in zip(add.names, out, kinds, strict=True)}

    return _run(treed, path, pattern, add, work).drop("edits")


def own_edits(docs: DataFrame) -> DataFrame:
    """docs with three edits each, made of the document itself: its middle tenth is moved to its end, and its first word is doubled."""
    n = F.length(F.coalesce("text", F.lit("")))
    a, size = F.floor(n / 2).cast("int"), F.floor(n / 10).cast("int")
    first = F.regexp_extract(F.coalesce("text", F.lit("")), r"\A\s*(\S+)", 1)
    edits = F.array(
        F.struct(a.alias("start"), (a + size).alias("stop"), F.lit("").alias("new")),
        F.struct((n - size).alias("start"), (n - size).alias("stop"), F.substring(F.coalesce("text", F.lit("")), a + 1, size).alias("new")),
        F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"), F.concat(first, F.lit(" ")).alias("new")),
    )
    return docs.withColumn("edits", edits.cast(EDIT))
