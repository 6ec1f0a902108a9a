"""SimHash near-duplicates: fingerprints linked through vantage-point trees.

A tree fitted on a bounded sample of distinct fingerprints cuts Hamming space into shards: at each
branch a fingerprint goes inside or outside a ball round a vantage point. Two fingerprints at most
``RADIUS`` bits apart that go different ways both lie near the ball's surface (triangle bound), so the
inner one also visits the outer shard as a guest, and a guest visits every side that can hold a
partner. Each close pair thus meets in the home shard of one of the two. Shards that turn out large are cut
again by branches of their own. Inside a shard the same
branching goes on in memory until few fingerprints are left, which are compared with each other.

A shard gives back a spanning star of each group it found, never all pairs; connected components
join the stars. Exact copies share a fingerprint and are one node, whatever their number.

Defined cases: ill-formed UTF-8 counts as U+FFFD; null and empty texts have fingerprint zero and are linked like any other; repeated
rows give repeated rows; rows without doc_id get the smallest doc_id of their group, null if it has
none; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstack.llm import nearcopies
from quillstack.llm.common import cut, text_of, worker_cache
from quillstack.llm.components import components

SEED, WORDS, RADIUS = 42, 3, 2
#: Distinct fingerprints that a round's branches are fitted on, about, those a shard shall hold, and cells of a comparison.
SAMPLE, LEAF, CELLS = 65_536, 8_192, 1 << 20
#: Leaves' worth of fingerprints beyond which a shard is cut again, and rounds of cutting at most.
SPARE, ROUNDS = 8, 32


def fingerprint(text: str, words: int = WORDS) -> int:
    """64 bits; a bit is set if over half of the shingles' XXH64 have it."""
    parts = text.encode("utf-8", "replace").lower().split()  # of bytes: A-Z, and \\x20 \\x09-\\x0D
    if not parts:
        return 0
    joined, lengths = b" ".join(parts), np.fromiter(map(len, parts), np.int64, len(parts))
    stops = np.cumsum(lengths + 1) - 1
    starts = stops - lengths
    n = max(1, len(parts) - words + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        a = starts[at : min(at + (1 << 16), n)].tolist()
        b = stops[min(words, len(parts)) - 1 :][at : at + len(a)].tolist()
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in zip(a, b, strict=True)), np.uint64, len(a))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(("none",), dict)  # lets go of what other stages left
        for batch in batches:
            found = pa.array([fingerprint(text_of(t) or "", words) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _distance(x: np.ndarray, point: int) -> np.ndarray:
    return np.bitwise_count(x ^ np.uint64(point)).astype(np.int16)


def _branch(sample: np.ndarray) -> tuple[int, int] | None:
    """A vantage point and a ball's radius that divide the sample and leave little near the surface; None if nothing divides it."""
    best = None
    for point in sample[:: max(1, len(sample) // 8)][:8]:
        d = _distance(sample, int(point))
        at = np.bincount(d, minlength=70)
        inside = np.cumsum(at)
        for r in np.unique(np.quantile(d, (0.35, 0.45, 0.5, 0.55, 0.65)).astype(int)):
            split = min(inside[r], len(sample) - inside[r])
            if split:
                cost = at[max(0, r - RADIUS + 1) : r + RADIUS + 1].sum() / len(sample) - split / len(sample)
                if best is None or cost < best[0]:
                    best = (cost, int(point), int(r))
    return best and best[1:]


def fit_tree(sample: np.ndarray, depth: int, root: int = 1) -> list[tuple[int, int, int]]:
    """Branches (path, point, radius) below root, by heap numbers: the root of all is 1, the inner side of p is 2p, the outer 2p + 1."""
    branches, todo = [], [(root, sample)]
    while todo:
        path, part = todo.pop()
        if path.bit_length() - root.bit_length() >= depth or len(part) < 8:
            continue
        found = _branch(part)
        if found is None:
            continue
        point, r = found
        branches.append((path, point, r))
        inside = _distance(part, point) <= r
        todo += [(2 * path, part[inside]), (2 * path + 1, part[~inside])]
    return branches


def _sides(d: np.ndarray, r: int, guest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Who goes in, who goes out, and who of each is a guest there."""
    inside = d <= r
    go_in = inside | guest & (d <= r + RADIUS)
    go_out = ~inside | (d > r - RADIUS)
    return go_in, go_out, guest[go_in] | ~inside[go_in], guest[go_out] | inside[go_out]


def _route(fps: np.ndarray, branches: dict[int, tuple[int, int]], root: int = 1, guests: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    todo = [(root, fps, np.zeros(len(fps), bool) if guests is None else guests)]
    while todo:
        path, part, guest = todo.pop()
        if not len(part):
            continue
        if path not in branches:
            yield path, part, guest
            continue
        point, r = branches[path]
        go_in, go_out, g_in, g_out = _sides(_distance(part, point), r, guest)
        todo += [(2 * path, part[go_in], g_in), (2 * path + 1, part[go_out], g_out)]


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that edges a-b lead to."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]


def shard_links(fps: np.ndarray, guest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all that pairs at most RADIUS apart connect, for pairs with at least one at home here."""
    edges_a: list[np.ndarray] = []
    edges_b: list[np.ndarray] = []
    kept, todo = 0, [np.arange(len(fps))]
    flags = [guest]
    while todo:
        index, out = todo.pop(), flags.pop()
        home = index[~out]
        if not len(home):
            continue
        part = fps[index]
        if len(home) * len(index) > CELLS and (found := _branch(part[:: max(1, len(part) // 512)])):
            go_in, go_out, g_in, g_out = _sides(_distance(part, found[0]), found[1], out)
            if max(go_in.sum(), go_out.sum()) <= 0.9 * len(index):
                todo += [index[go_in], index[go_out]]
                flags += [g_in, g_out]
                continue
        step = max(1, CELLS // len(index))
        for at in range(0, len(home), step):
            rows = home[at : at + step]
            i, j = np.nonzero(np.bitwise_count(fps[rows][:, None] ^ part[None, :]) <= RADIUS)
            a, b = rows[i], index[j]
            edges_a.append(a[a != b])
            edges_b.append(b[a != b])
            kept += len(edges_a[-1])
            if kept > 4 * CELLS:  # many links: only what they connect is kept
                label = stars(len(fps), np.concatenate(edges_a), np.concatenate(edges_b))
                edges_a, edges_b = [np.flatnonzero(label != np.arange(len(fps)))], [label[label != np.arange(len(fps))]]
                kept = len(edges_a[0])
    if not edges_a:
        return fps[:0], fps[:0]
    label = stars(len(fps), np.concatenate(edges_a), np.concatenate(edges_b))
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked], fps[label[linked]]


ROUTED = "shard long, fp long, guest boolean"


def _depth(rows: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, rows) / LEAF))))


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64)


def _routed(rows: DataFrame, branches: list[tuple[int, int, int]]) -> DataFrame:
    """rows (shard, fp, guest), each where the branches below its shard lead it."""
    tree = rows.sparkSession.sparkContext.broadcast({p: (point, r) for p, point, r in branches})  # SAMPLE / 8 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, fps, guests = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)
            for shard in np.unique(shards).tolist():
                here = shards == shard
                for path, part, guest in _route(fps[here], tree.value, shard, guests[here]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), path)), pa.array(part.view(np.int64)), pa.array(guest)], names=["shard", "fp", "guest"])

    return rows.mapInArrow(run, ROUTED)


def shards(nodes: DataFrame) -> DataFrame:
    """shard, fp, guest: the fingerprints by the leaves of the tree.

    Shards that hold far more than a leaf shall are cut again by branches fitted on samples of their own rows, until
    none is left or none can be divided. A round's samples are SAMPLE fingerprints in all, about. Each round routes and writes
    only the rows of shards that are still too large; the others stay where they are.
    """
    rows = nodes.select(F.lit(1).cast("long").alias("shard"), "fp", F.lit(False).alias("guest"))
    sizes, settled = {1: nodes.count()}, []
    large = None
    for k in range(ROUNDS):
        total = sum(sizes.values())
        chosen = rows if large is None else rows.join(large, "shard", "left_semi")
        sample = chosen.where(F.pmod(F.xxhash64("fp"), F.lit(max(1, -(-total // SAMPLE)))) == 0)
        sample = sample.select("shard", "fp").orderBy("shard", "fp").toArrow()
        at, fps = sample["shard"].to_numpy(), _unsigned(sample["fp"])
        branches = [b for shard, n in sizes.items() for b in fit_tree(np.random.default_rng(SEED).permutation(fps[at == shard]), _depth(n), shard)]
        if not branches:
            break
        routed = _routed(chosen.select("shard", "fp", "guest"), branches)
        rows = cut(routed if large is None else routed.unionByName(rows.join(large, "shard", "left_anti")), "shards")
        # the largest first: as many as a round's samples can serve
        counts = cut(rows.groupBy("shard").count().where(F.col("count") > SPARE * LEAF), "large")
        found = counts.orderBy(F.desc("count"), "shard").limit(SAMPLE // 64).collect()
        divided = {p for p, _, _ in branches}
        sizes = {r["shard"]: r["count"] for r in found if r["shard"] // 2 in divided}
        if not sizes:
            break
        settled.append(rows.join(counts, "shard", "left_anti"))
        rows = rows.join(counts, "shard", "left_semi")
        large = F.broadcast(nodes.sparkSession.createDataFrame([(s,) for s in sizes], "shard long"))
    for part in settled:
        rows = rows.unionByName(part.select(rows.columns))
    return rows


def links(nodes: DataFrame) -> DataFrame:
    """nodes: distinct fp. Edges (a, b) that connect exactly what pairs at most RADIUS bits apart connect."""

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.groupby("fp", as_index=False)["guest"].min()
        a, b = shard_links(pdf["fp"].to_numpy().view(np.uint64), pdf["guest"].to_numpy(bool))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return shards(nodes).groupBy("shard").applyInPandas(link, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links reach."""
    fps = cut(fingerprints(docs, words), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(nodes))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    placed = cut(placed, "placed")
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    found = placed.join(smallest, "root").select("fp", "component_id")
    return fps.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def candidates(fps: DataFrame) -> DataFrame:
    """a, b (a < b) of fps (node, mark: its fingerprint): each node with the smallest one that links between fingerprints at most RADIUS bits apart reach from it."""
    fps = fps.select(F.col("node").alias("doc_id"), F.col("mark").alias("fp"))
    roots = components(links(fps.select("fp").distinct()))
    placed = cut(fps.join(roots, fps.fp == roots.node, "left").select("doc_id", F.coalesce("root", "fp").alias("root")), "placed")
    smallest = placed.groupBy("root").agg(F.min("doc_id").alias("a"))
    return placed.join(smallest, "root").where("doc_id > a").select("a", F.col("doc_id").alias("b"))


def keep_one(docs: DataFrame, words: int = 5, least: float = nearcopies.LEAST) -> DataFrame:
    """docs with one document of each group of near copies, that of the smallest doc_id; rows without doc_id stay.

    Near copies have a Jaccard similarity of ``least`` or more over shingles of so many words. Fingerprints of these that
    the shards link propose the first pairs, which are verified on the texts. A pair at 0.8 may lie 14 bits apart, so ``nearcopies``
    then finds the pairs that are left, between the components which these make. Rows that repeat a doc_id
    count as one document; the one whose columns have the smallest hash stays.
    """
    chosen = nearcopies.near_copies(docs, words, least, partial(fingerprint, words=words), candidates).where("doc_id = component_id").groupBy("doc_id").count()
    chosen = cut(chosen, "chosen")
    once, more = chosen.where("count = 1").select("doc_id"), chosen.where("count > 1").select("doc_id")
    kept = docs.join(once, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))
    if more.isEmpty():
        return kept.select(docs.columns)
    same = Window.partitionBy("doc_id").orderBy(F.xxhash64(F.to_json(F.struct(*docs.columns))))
    again = docs.join(more, "doc_id", "left_semi").withColumn("_nth_of_id", F.row_number().over(same)).where("_nth_of_id = 1")
    return kept.unionByName(again.select(docs.columns)).select(docs.columns)
