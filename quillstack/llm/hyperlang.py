"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1. Three letters in a row are bound into one vector:
the first letter's vector rotated twice, times the second's rotated once, times the third's. A text is
the bundle (sum) of the vectors of all its letter triples, words being parted by one blank; a language
prototype is the bundle of its documents. A document gets the language whose prototype has the
largest cosine with it. Prototypes are sums of integers, so they do not depend on how rows are dealt
out; a task sends one vector for each language it met, and the driver gets one for each language.

Defined cases: ill-formed UTF-8 counts as U+FFFD; null texts and texts without a letter are ``und`` with score 0; ties go to the language
that sorts first; rows whose lang is null teach nothing; with nothing learned every text is ``und``;
a null doc_id is not held out; repeated rows give repeated rows; an empty table gives an empty table.
Only doc_id, text and, for learning, lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.llm.common import text_of, worker_cache


DIMENSIONS = 512
#: Triples whose vectors a worker keeps, and characters that are handled at once.
MAX_TRIPLES, CHUNK = 30_000, 1 << 20
UNKNOWN = "und"
#: A letter is a language's if it has this share of its letters; a kept text has at least ``KNOWN`` of its letters
#: from learned languages, and is not far below the quantile ``LOW`` of the cosines of held-out texts of its length.
LETTER_SHARE, KNOWN, LOW = 1e-4, 0.5, 0.001


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=20_000)
def _letter_vector(code: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(code)).integers(0, 2, DIMENSIONS).astype(np.float32) * 2 - 1


class _Triples(dict):
    """Triple to row of the table of bound vectors."""

    def __init__(self) -> None:
        self.rows = np.zeros((MAX_TRIPLES, DIMENSIONS), np.float32)

    def __missing__(self, key: int) -> int:
        a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
        at = self[key] = len(self)
        self.rows[at] = np.roll(_letter_vector(a), 2) * np.roll(_letter_vector(b), 1) * _letter_vector(c)
        return at


def _triples() -> _Triples:
    return worker_cache(("triples",), _Triples)


def lines(text: str) -> Iterator[np.ndarray]:
    """The letters' codes with one blank (0) between words and round all, in parts of about CHUNK that share two codes."""
    tail = np.zeros(1, np.int64)
    for at in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        codes = np.where(_letters()[codes], codes, 0)
        if at + CHUNK >= len(text):
            codes = np.append(codes, 0)
        codes = codes[(codes != 0) | (np.concatenate([tail[-1:], codes[:-1]]) != 0)]
        line = np.concatenate([tail, codes])
        yield line
        tail = line[-2:]


def triples(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct letter triples of a text, and how often each occurs, part by part."""
    for codes in lines(text):
        if len(codes) > 2:
            yield np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)


def bundle(text: str) -> np.ndarray | None:
    """The vector of a text; None if it has no letter."""
    total, table = None, _triples()
    for keys, counts in triples(text):
        for at in range(0, len(keys), 8192):
            some = keys[at : at + 8192].tolist()
            if len(table) + len(some) > MAX_TRIPLES:
                table.clear()
            rows = np.fromiter(map(table.__getitem__, some), np.int64, len(some))
            part = counts[at : at + 8192].astype(np.float32) @ table.rows[rows]
            total = part.astype(np.float64) if total is None else total + part
    return total


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their prototypes, from docs (text, lang). The result is as large as the set of languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                vector = bundle(text_of(text))
                if vector is not None:
                    sums[lang] = sums[lang] + vector if lang in sums else vector
        if sums:
            values = [pa.array(np.rint(v).astype(np.int64)) for v in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.to_pylist() for v in values], pa.list_(pa.int64()))], names=["lang", "sums"])

    sums = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(run, "lang string, sums array<long>")
    total = sums.select("lang", F.posexplode("sums").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value"))
    found: dict[str, np.ndarray] = {}
    for row in total.collect():
        found.setdefault(row.lang, np.zeros(DIMENSIONS))[row.at] = row.value
    langs = sorted(k for k, v in found.items() if v.any())
    return langs, np.array([found[k] / np.linalg.norm(found[k]) for k in langs]).reshape(len(langs), DIMENSIONS)


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """docs with lang_pred and score, the cosine with the nearest prototype (0 at least)."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, prototypes))
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, proto = shared.value
        for batch in batches:
            predicted, scores = [], []
            for text in batch.column("text"):
                vector = bundle(text_of(text) or "") if known else None
                norm = 0.0 if vector is None else float(np.linalg.norm(vector))
                if not norm:
                    predicted.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cosines = proto @ vector / norm
                best = int(cosines.argmax())
                predicted.append(known[best])
                scores.append(min(1.0, max(0.0, float(cosines[best]))))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(predicted, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    kept = docs.select(*names)
    fields = T.StructType(list(kept.schema.fields))
    return kept.mapInArrow(run, fields.add("lang_pred", "string").add("score", "double"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document, learned from those that are not held out."""
    langs, prototypes = learn(docs.where(~held_out(F.col("doc_id"))))
    told = predict(docs.select("doc_id", "text"), langs, prototypes)
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def letters(docs: DataFrame) -> np.ndarray:
    """The letters, sorted, that have a share of ``LETTER_SHARE`` or more in some language of docs (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                codes = np.frombuffer(text_of(text).lower().encode("utf-32-le", "replace"), np.uint32)
                found = np.bincount(codes[_letters()[codes]])
                old = sums.get(lang, found[:0])
                if len(old) < len(found):
                    old, found = found, old
                sums[lang] = old
                old[: len(found)] += found
        for lang, counts in sums.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], names=["lang", "code", "n"])

    counted = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(run, "lang string, code long, n long")
    counted = counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    total = counted.groupBy("lang").agg(F.sum("n").alias("of"))
    known = counted.join(total, "lang").where(F.col("n") >= LETTER_SHARE * F.col("of")).select("code").distinct()
    return np.array(sorted(r.code for r in known.collect()), np.int64)  # 1 / LETTER_SHARE for each language at most


def support(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """docs with _size, the binary logarithm of the number of letters (null without any), and _known, the share of letters in known."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(0x110000, bool)
        table[shared.value] = True
        for batch in batches:
            sizes, shares = [], []
            for text in batch.column("text"):
                codes = np.frombuffer((text_of(text) or "").lower().encode("utf-32-le", "replace"), np.uint32)
                codes = codes[_letters()[codes]]
                sizes.append(len(codes).bit_length() - 1 if len(codes) else None)
                shares.append(float(table[codes].mean()) if len(codes) else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32()), pa.array(shares, pa.float64())], names=[*batch.schema.names, "_size", "_known"])

    fields = T.StructType(list(docs.schema.fields))
    return docs.mapInArrow(run, fields.add("_size", "integer").add("_known", "double"))


def lowest(told: DataFrame) -> dict[int, float]:
    """For each _size the quantile ``LOW`` of the scores of told (_size, score) less twice a cosine's noise: a row for each power of two."""
    at = told.where("_size IS NOT NULL").groupBy("_size").agg(F.percentile_approx("score", LOW, 100_000).alias("at"))
    return {r["_size"]: r["at"] - 2 / DIMENSIONS**0.5 for r in at.collect()}


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs whose language is recognised. Columns and rows stay as they are.

    Not recognised are texts without letters, texts whose letters are mostly of scripts that were not
    learned (whatever their cosine, which is noise then), and texts whose cosine is below that of nearly
    all held-out texts of as many letters whose language was predicted right, by twice the noise of a
    cosine (1 / sqrt(DIMENSIONS)). Short clean texts have low cosines and are compared with their like; a length without held-out texts has the bound of the next
    shorter one.
    """
    taught = docs.where(~held_out(F.col("doc_id")))
    langs, prototypes = learn(taught)
    known = letters(taught)
    tried = support(docs.where(held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("text", "lang"), known).where(F.col("_known") >= KNOWN)
    bounds = lowest(predict(tried, langs, prototypes).where("lang_pred = lang"))
    # columns of the documents that are named like what is added here step aside
    own = {n: f"{n}_{k}_" for k, n in enumerate(docs.columns) if n.strip("_").split("_")[0] in ("lang", "score", "size", "known") and n not in ("lang", "text", "doc_id")}
    told = predict(support(docs.withColumnsRenamed(own), known), langs, prototypes)
    least = F.lit(0.0)
    for size in sorted(bounds):  # the last that is not longer counts
        least = F.when(F.col("_size") >= size, bounds[size]).otherwise(least)
    kept = told.where((F.col("lang_pred") != UNKNOWN) & (F.col("_known") >= KNOWN) & (F.col("score") >= least)).drop("lang_pred", "score", "_size", "_known")
    return kept.withColumnsRenamed({new: old for old, new in own.items()}).select(docs.columns)
