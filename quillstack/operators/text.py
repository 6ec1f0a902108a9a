"""Text jobs: line differences, three-way merges and bulk edits. Only rows that columns cannot decide reach Python."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.columns import CONFLICT_CLOSE, CONFLICT_MID, CONFLICT_OPEN, edit_change, has_conflicts, norm_text


def _common_start(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values agree, looked at in stretches of growing size."""
    at, step, n = 0, 32, min(len(a), len(b))
    while at < n:
        end = min(n, at + step)
        differ = np.flatnonzero(a[at:end] != b[at:end])
        if len(differ):
            return at + int(differ[0])
        at, step = end, step * 2
    return n


#: Steps that all diagonals take together before those that still go on are followed one by one.
_TOGETHER = 8


def _further(reach: np.ndarray, a: np.ndarray, b: np.ndarray, d: int) -> np.ndarray:
    """The diagonals that d edits reach; reach (by diagonal, shifted by len(b) + 1) holds for d - 1 edits how many of a's values are behind, or -1, and is renewed in place."""
    n, m = len(a), len(b)
    low, high = max(-d, d - 2 * m), min(d, 2 * n - d)  # the others have left the grid
    k = np.arange(low, high + 1, 2)
    if not len(k):
        return k
    at = k + m + 1
    if d == 0:
        x = np.zeros(1, np.int64)
    else:
        down, right = reach[at + 1], reach[at - 1]
        x = np.maximum(np.where((down >= 0) & (down - k <= m), down, -1), np.where((right >= 0) & (right < n), right + 1, -1))
    going = np.flatnonzero(x >= 0)
    for _ in range(_TOGETHER):
        going = going[(x[going] < n) & (x[going] - k[going] < m)]
        going = going[a[x[going]] == b[x[going] - k[going]]] if len(going) else going
        if not len(going):
            break
        x[going] += 1
    for i in going.tolist():
        x[i] += _common_start(a[x[i] :], b[x[i] - k[i] :])
    reach[at] = x
    return k


def _by_table(p: np.ndarray, q: np.ndarray) -> list[tuple[int, int]]:
    """A longest common subsequence by the whole table, a row at a time; about the square root of one side's length times the other's is held."""

    def above(i: int, below: np.ndarray) -> np.ndarray:
        """Row i of best from row i + 1; best[i, j] is the longest common subsequence of p[i:] and q[j:]."""
        row = np.zeros(len(q) + 1, np.int32)
        row[:-1] = np.maximum.accumulate(np.where(q == p[i], below[1:] + 1, below[:-1])[::-1])[::-1]
        return row

    # every step-th row is kept, and the rows between two of them are made again on the way down
    step, row = math.isqrt(len(p)) + 1, np.zeros(len(q) + 1, np.int32)
    kept = {len(p): row}
    for i in range(len(p) - 1, -1, -1):
        row = above(i, row)
        if i % step == 0:
            kept[i] = row
    found, i, j = [], 0, 0
    best: dict[int, np.ndarray] = {}
    while i < len(p) and j < len(q):
        if i + 1 not in best:
            end = min(i - i % step + step, len(p))
            best = {end: kept[end]}
            for k in range(end - 1, i - 1, -1):
                best[k] = above(k, best[k + 1])
        if p[i] == q[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return found


def _middle(a: np.ndarray, b: np.ndarray) -> tuple[int, int] | None:
    """A place (i, j) on a shortest way of edits from a to b, about half-way: edits from both ends are counted up until they meet.

    None as soon as that has cost about as much as the table would: texts with so many edits are searched by it, which is as exact.
    """
    n, m = len(a), len(b)
    table = n * (8 + 0.003 * m)  # microseconds, about; so are those of a step below
    ahead, behind = np.full(n + m + 3, -1, np.int64), np.full(n + m + 3, -1, np.int64)
    back_a, back_b = a[::-1], b[::-1]
    for d in range(n + m + 1):
        if 60 * d + 0.04 * d * d > table:
            return None
        k = _further(ahead, a, b, d)
        other = n - m - k
        met = np.flatnonzero((ahead[k + m + 1] >= 0) & (behind[other + m + 1] >= 0) & (ahead[k + m + 1] + behind[other + m + 1] >= n)) if len(k) else k
        if len(met):
            x = int(ahead[k[met[0]] + m + 1])
            return x, x - int(k[met[0]])
        k = _further(behind, back_a, back_b, d)
        other = n - m - k
        met = np.flatnonzero((behind[k + m + 1] >= 0) & (ahead[other + m + 1] >= 0) & (behind[k + m + 1] + ahead[other + m + 1] >= n)) if len(k) else k
        if len(met):
            x = int(behind[k[met[0]] + m + 1])
            return n - x, m - (x - int(k[met[0]]))
    raise AssertionError("the two ends always meet")


def _latest(values: list[int], wanted: list[int]) -> list[int]:
    """Where the wanted values, a subsequence of values, stand if each stands as late as it can."""
    at, i = [], len(values)
    for value in reversed(wanted):
        i -= 1
        while values[i] != value:
            i -= 1
        at.append(i)
    return at[::-1]


def common_lines(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence of lines, each as late as it can stand: of equal lines in a row the first are those that changed.

    Myers' greedy search from both ends, halved at the place where they meet: time grows with the lines times the edits, memory
    with the lines. All diagonals of a step are NumPy arrays. Stretches with so many edits that the table of all
    pairs of lines is cheaper are searched by that.
    """
    numbers = {line: i for i, line in enumerate(dict.fromkeys([*a, *b]))}
    p, q = (np.fromiter(map(numbers.__getitem__, x), np.int64, len(x)) for x in (a, b))
    # what only one side has is in no common line, so it need not be searched
    in_p, in_q = np.isin(p, q), np.isin(q, p)
    at_p, at_q = np.flatnonzero(in_p), np.flatnonzero(in_q)
    p, q = p[at_p], q[at_q]
    found, todo = [], [(0, len(p), 0, len(q))]
    while todo:
        i, end_i, j, end_j = todo.pop()
        head = _common_start(p[i:end_i], q[j:end_j])
        found += [(i + t, j + t) for t in range(head)]
        i, j = i + head, j + head
        tail = _common_start(p[i:end_i][::-1], q[j:end_j][::-1])
        found += [(end_i - 1 - t, end_j - 1 - t) for t in range(tail)]
        end_i, end_j = end_i - tail, end_j - tail
        if i < end_i and j < end_j:
            if (met := _middle(p[i:end_i], q[j:end_j])) is None:
                found += [(i + x, j + y) for x, y in _by_table(p[i:end_i], q[j:end_j])]
                continue
            x, y = met
            todo += [(i, i + x, j, j + y), (i + x, end_i, j + y, end_j)]
    kept = p[sorted(i for i, _ in found)].tolist() if found else []
    return [(int(at_p[i]), int(at_q[j])) for i, j in zip(_latest(p.tolist(), kept), _latest(q.tolist(), kept), strict=True)]


def _lines(text: str) -> list[str]:
    parts = text.split("\n")
    return parts[:-1] if parts[-1] == "" else parts


def merge3(base: str, edited: str, fresh: str) -> tuple[str, bool]:
    """Both sides' changes against base in one text; where they overlap and differ, both stand between markers."""
    o, a, b = base.split("\n"), edited.split("\n"), fresh.split("\n")
    in_a, in_b = dict(common_lines(o, a)), dict(common_lines(o, b))
    stable = [(i, in_a[i], in_b[i]) for i in range(len(o)) if i in in_a and i in in_b]
    out, conflict, at = [], False, (0, 0, 0)
    for anchor in [*stable, (len(o), len(a), len(b))]:
        was, mine, theirs = o[at[0] : anchor[0]], a[at[1] : anchor[1]], b[at[2] : anchor[2]]
        if mine == theirs or theirs == was:
            out += mine
        elif mine == was:
            out += theirs
        else:
            conflict = True
            out += [CONFLICT_OPEN, *mine, CONFLICT_MID, *theirs, CONFLICT_CLOSE]
        if anchor[0] < len(o):
            out.append(o[anchor[0]])
        at = (anchor[0] + 1, anchor[1] + 1, anchor[2] + 1)
    return "\n".join(out), conflict


#: Rows and bytes of the texts that a Python worker is given at once.
BATCH_ROWS, BATCH_BYTES = 500, "16m"


def _small_batches(texts: DataFrame) -> None:
    """Keeps Arrow batches small, from here on in this session: by itself a batch is 10,000 texts of any length."""
    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def line_stats(texts: DataFrame) -> DataFrame:
    """texts (page_id, was, now): lines added and removed. Equal texts never reach Python; of the others one pair is cut into lines at a time."""
    _small_batches(texts)
    rows = texts.select("page_id", F.coalesce("was", F.lit("")).alias("was"), F.coalesce("now", F.lit("")).alias("now"))
    zero = F.lit(0).cast("long")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            added, removed = [], []
            for was, now in zip(batch["was"], batch["now"], strict=True):
                w, n = _lines(was), _lines(now)
                kept = len(common_lines(w, n))
                added.append(len(n) - kept)
                removed.append(len(w) - kept)
            yield pd.DataFrame({"page_id": batch["page_id"], "added": added, "removed": removed})

    same = rows.where("was = now").select("page_id", zero.alias("added"), zero.alias("removed"))
    return same.unionAll(rows.where("was <> now").mapInPandas(count, "page_id string, added long, removed long"))


def line_changes(texts: DataFrame) -> DataFrame:
    """texts (page_id, was, now): one row for each line removed (-) or added (+), in order."""
    _small_batches(texts)
    rows = texts.where("NOT (coalesce(was, '') = coalesce(now, ''))").select("page_id", F.coalesce("was", F.lit("")).alias("was"), F.coalesce("now", F.lit("")).alias("now"))

    def changes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, was, now in zip(batch["page_id"], batch["was"], batch["now"], strict=True):
                w, n = _lines(was), _lines(now)
                seq, i, j = 0, 0, 0
                for a, b in [*common_lines(w, n), (len(w), len(n))]:
                    for op, lines in (("-", w[i:a]), ("+", n[j:b])):
                        for line in lines:
                            out.append((page, seq, op, line))
                            seq += 1
                    i, j = a + 1, b + 1
            yield pd.DataFrame(out, columns=["page_id", "seq", "op", "line"])

    return rows.mapInPandas(changes, "page_id string, seq int, op string, line string")


def merge_texts(texts: DataFrame) -> DataFrame:
    """texts (page_id, base, edited, fresh): page_id, merged, conflicts. Columns decide rows on which a side did not move."""
    _small_batches(texts)
    texts = texts.select("page_id", F.explode(F.array(F.struct(*[norm_text(F.col(c)).alias(c) for c in ("base", "edited", "fresh")]))).alias("t"))  # worked out once a row
    rows = texts.select("page_id", "t.*")
    easy = (F.col("edited") == F.col("base")) | (F.col("fresh") == F.col("base")) | (F.col("edited") == F.col("fresh"))
    pick = F.when(F.col("edited") == F.col("base"), F.col("fresh")).otherwise(F.col("edited"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [merge3(*t) for t in zip(batch["base"], batch["edited"], batch["fresh"], strict=True)]
            yield pd.DataFrame({"page_id": batch["page_id"], "merged": [d[0] for d in done], "conflicts": [d[1] for d in done]})

    decided = rows.where(easy).select("page_id", pick.alias("merged"), has_conflicts(pick).alias("conflicts"))
    return decided.unionAll(rows.where(~easy).mapInPandas(merge, "page_id string, merged string, conflicts boolean"))


def apply_text_edits(md: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """md (file_id, page_id, md, base) after edits (page_id, content), and each edit's change.

    The base stays. A page whose base and text are both empty has no row.
    """
    asked = edits.select("page_id", F.col("content").alias("_content"), F.lit(True).alias("_asked"))
    joined = md.join(asked, "page_id", "left")
    now: Column = F.when(F.col("_asked"), norm_text(F.col("_content"))).otherwise(F.col("md"))
    gone = F.col("_asked").isNotNull() & (now == "") & (norm_text(F.col("base")) == "")
    out = joined.withColumn("_now", now).where(~gone).select("file_id", "page_id", F.col("_now").alias("md"), "base")
    change = edit_change(F.col("md"), F.col("_content"), F.col("base"))
    report = joined.where("_asked").select("file_id", "page_id", change.alias("c")).select("file_id", "page_id", "c.*")
    return out, report
