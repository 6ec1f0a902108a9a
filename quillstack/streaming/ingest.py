"""Continuous reconciliation of arriving note snapshots."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstack.model import CURRENT_VERSION, NOTES, PAGES, PARKED, PLACEMENT, TRANSCRIPTIONS, Archive, schema
from quillstack.operators.reconcile import REPORT, reconcile_pages
from quillstack.size import BROADCAST_ROWS
from quillstack.sources.scratch import cut, free_shuffles, passing, stored_bytes

#: A snapshot of a note as it arrives: its note, and its pages in order.
SNAPSHOT = f"seq long, file_id string, signature string, device string, source string, pages array<struct<{PAGES.removeprefix('file_id string, ').replace(' string', ':string').replace(' boolean', ':boolean').replace(' timestamp', ':timestamp').replace(' array<', ':array<').replace(' struct<', ':struct<').replace(' int', ':int')}>>"
NOTE_TABLES = {"notes": f"{NOTES}, seq long", "placement": PLACEMENT, "pages": PAGES, "md": TRANSCRIPTIONS}
PAGE_TABLES = {"parked": PARKED, "claims": "page_id string, seq long, file_id string"}
FAILED = {"failed": "seq long, file_id string, reason string"}
TABLES = {**NOTE_TABLES, **PAGE_TABLES, **FAILED}
#: Tables in the codec that the session sets; the others, which are mostly ids and fingerprints, take half the room in zstd.
AS_SET = {"md"}
#: Tables that share buckets, and the columns whose hash says which.
FAMILIES = {"note": (NOTE_TABLES, ["file_id"]), "page": (PAGE_TABLES, ["page_id"]), "failure": (FAILED, ["seq", "file_id", "reason"])}

#: Bytes of files from which a bucket is split, bits of a hash that buckets may take, and commits that stay readable.
BUCKET_BYTES, MOST_BITS, KEPT_COMMITS = 64_000_000, 60, 3
_DIRECTORY = "family string, depth int, bits long, folder string, tables array<string>, bytes long"
_LOG = "batch string, number long, commit string"


class Bucket(NamedTuple):
    """Where the rows are whose key's hash ends in these ``depth`` bits: a commit's folder, and the tables that have any."""

    depth: int
    bits: int
    folder: str | None
    tables: list[str]


def _low(depth: int) -> Column:
    return F.col("_h").bitwiseAND(F.lit((1 << depth) - 1))


def place(rows: DataFrame, leaves: DataFrame, depths: Iterable[int]) -> DataFrame:
    """rows (with ``_h``) with the depth and bits of the one leaf that each belongs to; rows of no leaf are left out."""
    tried = rows.withColumn("_l", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _low(d).alias("bits")) for d in sorted(set(depths))])))
    return tried.select(*rows.columns, "_l.depth", "_l.bits").join(leaves.select("depth", "bits"), ["depth", "bits"])


class Store:
    """The tables of an archive under root, in buckets by a hash of the note (``claims`` and ``parked``: of the page).

    Buckets are the leaves of an extendible hash: each holds the rows whose hash ends in its bits. A bucket whose files
    exceed ``limit`` bytes is split by as many further bits as that takes, so buckets stay small however large the
    archive is, and a delivery rewrites the buckets of its own keys only; one note that is larger by itself
    is a bucket of its own.

    Every commit is a folder with the buckets that it changed, a directory of where all buckets are (as a table), the
    log of batches, and a report. A marker under ``_heads``, made last, says that it is there; the newest one whose
    directory is complete is the state, so a writer that stops half-way leaves a folder that nobody reads. ``kept``
    commits stay readable; what only older ones refer to is removed, so listings do not grow with the commits. One writer at
    a time, which a stream's checkpoint ensures.

    The driver holds the directory's rows of the buckets that a commit replaces and writes, and for reading whole tables one
    path a bucket: that is their metadata, some hundred bytes for each ``limit``.
    """

    def __init__(self, spark: SparkSession, root: str, limit: int = BUCKET_BYTES, kept: int = KEPT_COMMITS):
        self.spark, self.root, self.limit, self.kept = spark, root.rstrip("/"), limit, max(2, kept)
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    # --- files

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    # --- commits

    def commits(self) -> list[str]:
        """Names of the complete commits that stay readable, oldest first: a number and the batch."""
        return [n for n in self._names("_heads") if self._fs.exists(self._path(f"{n}/commit/_SUCCESS"))]

    def commit_of(self, batch: str, number: int | None = None) -> str | None:
        """The commit of a batch: by its name, or, for the batches of a stream, that of this number or a later one."""
        if not (commits := self.commits()):
            return None
        log = self.spark.read.schema(_LOG).parquet(f"{self.root}/{commits[-1]}/batches")
        row = log.where((F.col("batch") == batch) & (F.col("number") >= (-1 if number is None else number))).first()
        return row and row.commit

    def report(self, commit: str) -> DataFrame:
        """The report of a commit; empty if it has expired."""
        held = commit in self.commits()
        return self.spark.read.schema(REPORT).parquet(f"{self.root}/{commit}/report") if held else self.spark.createDataFrame([], REPORT)

    def failed(self) -> DataFrame:
        """The snapshots of all commits that could not be used: seq, file_id, reason."""
        return self.table("failed")

    # --- the directory

    def _directory(self, commit: str | None = None) -> DataFrame:
        """The buckets of a commit, or of the newest; in an empty store one for each family."""
        if commit is None and (commits := self.commits()):
            commit = commits[-1]
        if commit is None:
            return self.spark.createDataFrame([(f, 0, 0, None, [], 0) for f in FAMILIES], _DIRECTORY)
        return self.spark.read.schema(_DIRECTORY).parquet(f"{self.root}/{commit}/commit")

    def buckets(self, family: str) -> list[Bucket]:
        return [Bucket(r.depth, r.bits, r.folder, r.tables) for r in self._directory().where(F.col("family") == family).collect()]

    def buckets_of(self, keys: DataFrame, family: str) -> list[Bucket]:
        """The buckets of keys: as many as there are keys at most."""
        directory = self._directory().where(F.col("family") == family)
        depths = [r.depth for r in directory.select("depth").distinct().collect()]  # MOST_BITS + 1 numbers at most
        hashes = keys.select(F.xxhash64(*FAMILIES[family][1]).alias("_h"))
        hit = place(hashes, directory, depths).select("depth", "bits").distinct()
        return [Bucket(r.depth, r.bits, r.folder, r.tables) for r in directory.join(hit, ["depth", "bits"], "left_semi").collect()]

    def table(self, name: str, buckets: list[Bucket] | None = None) -> DataFrame:
        """A table, or those buckets of it."""
        family = next(f for f, (tables, _) in FAMILIES.items() if name in tables)
        held = self.buckets(family) if buckets is None else buckets
        paths = [f"{self.root}/{b.folder}/{name}/_bucket={b.depth}-{b.bits}" for b in held if b.folder and name in b.tables]
        if not paths:
            return self.spark.createDataFrame([], schema(TABLES[name]))
        return self.spark.read.schema(schema(TABLES[name])).parquet(*paths)

    def read(self, buckets: list[Bucket] | None = None) -> tuple[Archive, DataFrame]:
        return Archive(*[self.table(n, buckets) for n in NOTE_TABLES]), self.table("parked")

    # --- writing

    def _put(self, folder: str, rows: dict[str, DataFrame], leaves: list[tuple[int, int]], mode: str) -> dict[tuple[int, int], dict[str, int]]:
        """Writes rows (with ``_h``) by leaf; of each leaf the bytes that its tables have."""
        held = self.spark.createDataFrame(leaves, "depth int, bits long")
        for n, df in rows.items():
            placed = place(df, F.broadcast(held) if len(leaves) <= BROADCAST_ROWS else held, [d for d, _ in leaves])
            placed = placed.withColumn("_bucket", F.concat_ws("-", "depth", "bits")).drop("depth", "bits", "_h")
            out = placed.hint("rebalance", "_bucket").write.mode(mode).partitionBy("_bucket")
            (out if n in AS_SET else out.option("compression", "zstd")).parquet(f"{self.root}/{folder}/{n}")
        sizes: dict[tuple[int, int], dict[str, int]] = {leaf: {} for leaf in leaves}
        for n in rows:
            there = set(self._names(f"{folder}/{n}"))
            for depth, bits in leaves:
                if (name := f"_bucket={depth}-{bits}") in there:
                    sizes[depth, bits][n] = self._fs.getContentSummary(self._path(f"{folder}/{n}/{name}")).getLength()
        return sizes

    def _ahead(self, family: str, leaves: list[tuple[int, int]], coming: DataFrame) -> list[tuple[int, int]]:
        """leaves, of which those are split already that would be too large with the rows that come, so that these are not written twice; coming: a table that cut() made."""
        if (whole := stored_bytes(coming)) <= self.limit:
            return leaves
        held = place(coming.select(F.xxhash64(*FAMILIES[family][1]).alias("_h")), self.spark.createDataFrame(leaves, "depth int, bits long"), [d for d, _ in leaves])
        rows = held.groupBy("depth", "bits").agg(F.count("*").alias("n"), (F.min("_h") < F.max("_h")).alias("several")).collect()
        more = {(r.depth, r.bits): math.ceil(math.log2(max(1, whole * r.n / sum(x.n for x in rows) / self.limit))) for r in rows if r.several}
        return [(d + m, b | k << d) for d, b in leaves for m in [min(more.get((d, b), 0), MOST_BITS - d)] for k in range(1 << m)]

    def _written(self, folder: str, family: str, touched: list[Bucket], tables: dict[str, DataFrame], coming: DataFrame | None = None) -> DataFrame:
        """Writes the rows of a family's touched buckets and splits those that have become too large, whether or not each part has rows; the directory's new rows."""
        hashed = lambda df: df.withColumn("_h", F.xxhash64(*FAMILIES[family][1]))
        names = {n: [f.name for f in schema(TABLES[n]).fields] for n in tables}
        leaves = [(b.depth, b.bits) for b in touched]
        sizes = self._put(folder, {n: hashed(df.select(names[n])) for n, df in tables.items()}, leaves if coming is None else self._ahead(family, leaves, coming), "overwrite")
        whole: set[tuple[int, int]] = set()  # buckets of one key
        while large := [leaf for leaf, of in sizes.items() if sum(of.values()) > self.limit and leaf[0] < MOST_BITS and leaf not in whole]:
            stored = {n: hashed(self.spark.read.schema(schema(TABLES[n])).parquet(*paths)) for n in tables if (paths := [f"{self.root}/{folder}/{n}/_bucket={d}-{b}" for d, b in large if n in sizes[d, b]])}
            keys = place(reduce(DataFrame.unionAll, [df.select("_h") for df in stored.values()]), self.spark.createDataFrame(large, "depth int, bits long"), [d for d, _ in large])
            several = {(r.depth, r.bits) for r in keys.groupBy("depth", "bits").agg(F.min("_h").alias("low"), F.max("_h").alias("high")).where("low < high").collect()}
            whole |= {*large} - several
            parts = []
            for d, b in several:
                more = min(MOST_BITS - d, max(1, math.ceil(math.log2(sum(sizes[d, b].values()) / self.limit))))
                parts += [(d + more, b | k << d) for k in range(1 << more)]
            if parts:
                sizes |= self._put(folder, stored, parts, "append")
            for d, b in several:
                for n in sizes.pop((d, b)):
                    self._remove(f"{folder}/{n}/_bucket={d}-{b}")
        rows = [(family, d, b, folder, sorted(of), sum(of.values())) for (d, b), of in sizes.items()]
        return self.spark.createDataFrame(rows, _DIRECTORY)

    def write(self, batch: str, changed: dict[str, tuple[list[Bucket], dict[str, DataFrame]]], report: DataFrame, number: int | None = None, coming: dict[str, DataFrame] | None = None) -> str:
        """A commit. changed: of each family the buckets that are replaced, and all their rows by table. coming: of a family a table by which its buckets' new sizes can be told beforehand."""
        commits = self.commits()
        nth = int(commits[-1].split("-", 1)[0]) + 1 if commits else 1
        folder = f"{nth:012d}-{batch}" + ("" if number is None else f"{number:09d}")
        directory, new = self._directory(), []
        for family, (touched, tables) in changed.items():
            new.append(self._written(folder, family, touched, tables, (coming or {}).get(family)))
            gone = self.spark.createDataFrame([(family, b.depth, b.bits) for b in touched], "family string, depth int, bits long")
            directory = directory.join(gone, ["family", "depth", "bits"], "left_anti")
        names = [c.split()[0] for c in _DIRECTORY.split(", ")]
        now = reduce(DataFrame.unionByName, new, directory.select(names))
        report.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{folder}/report")
        log = self.spark.read.schema(_LOG).parquet(f"{self.root}/{commits[-1]}/batches") if commits else self.spark.createDataFrame([], _LOG)
        mine = self.spark.createDataFrame([(batch, -1 if number is None else number, folder)], _LOG)
        log.where(F.col("batch") != batch).unionAll(mine).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{folder}/batches")
        now.write.mode("overwrite").parquet(f"{self.root}/{folder}/commit")
        self._fs.mkdirs(self._path("_heads"))
        self._fs.create(self._path(f"_heads/{folder}"), True).close()
        self.expire()
        return folder

    def start(self, archive: Archive, parked: DataFrame | None = None, batch: str = "start") -> str:
        """A first commit: an archive as it stands, older than any snapshot."""
        notes = archive.notes.withColumn("seq", F.lit(-1).cast("long"))
        md = archive.md if archive.md is not None else self.table("md")
        claims = archive.placement.groupBy("page_id").agg(F.lit(-1).cast("long").alias("seq"), F.max("file_id").alias("file_id"))
        none = self.spark.createDataFrame([], REPORT)
        by_note = {"notes": notes, "placement": archive.placement, "pages": archive.pages, "md": md}
        by_page = {"parked": self.table("parked") if parked is None else parked, "claims": claims}
        return self.write(batch, {"note": (self.buckets("note"), by_note), "page": (self.buckets("page"), by_page)}, none)

    def _parts(self, commits: list[str]) -> DataFrame:
        """folder, table and bucket of all that these commits refer to."""
        every = reduce(DataFrame.unionByName, [self._directory(c) for c in commits])
        return every.where("folder IS NOT NULL").select("folder", F.explode("tables").alias("table"), F.concat_ws("-", "depth", "bits").alias("bucket")).distinct()

    def expire(self) -> None:
        """Commits but the newest ones go, with the buckets that only they refer to: as many as they changed."""
        commits = self.commits()
        old, rest = commits[: -self.kept], commits[-self.kept :]
        if not old:
            return
        dead = [tuple(r) for r in self._parts(old).join(self._parts(rest), ["folder", "table", "bucket"], "left_anti").collect()]
        live = {r.folder for r in self._parts(rest).select("folder").distinct().collect()}
        for c in old:
            self._remove(f"_heads/{c}")
        for folder, table, bucket in dead:
            if folder in live:
                self._remove(f"{folder}/{table}/_bucket={bucket}")
        for folder in {*old, *(d[0] for d in dead)}:
            for part in ("",) if folder not in live else ("/commit", "/batches", "/report") if folder in old else ():
                self._remove(f"{folder}{part}")

    def vacuum(self) -> list[str]:
        """Removes folders that no readable commit refers to, left by writers that stopped half-way; their names."""
        commits = self.commits()
        live = {*commits, *(r.folder for r in self._parts(commits).select("folder").distinct().collect())} if commits else set()
        lost = [n for n in self._names("") if n != "_heads" and n not in live]
        for n in lost:
            self._remove(n)
        return lost


def split_snapshots(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """snapshots (seq, file_id, signature, device, source, pages) that can be used, and those that cannot, with ``reason``: each fails alone."""
    reason = (
        F.when(F.coalesce("file_id", F.lit("")) == "", "a note without an id")
        .when(F.col("seq").isNull(), "a note without a sequence number")
        .when(F.col("pages").isNull(), "a note without a list of pages")
        .when(F.exists("pages", lambda p: F.coalesce(p["page_id"], F.lit("")) == ""), "a page without an id")
    )
    told = snapshots.withColumn("reason", reason)
    return told.where("reason IS NULL").drop("reason"), told.where("reason IS NOT NULL")


def _head(snapshots: DataFrame) -> DataFrame:
    """What is decided on: snapshots with the ids of their pages instead of the pages."""
    return snapshots.select("seq", "file_id", "signature", "device", "source", F.col("pages.page_id").alias("ids"))


def as_archive(notes: DataFrame, placement: DataFrame, snapshots: DataFrame) -> Archive:
    """Delivered notes (as heads, one a note) and the places that they won as an incoming archive. Its pages are those of all snapshots, and tell by ``seq`` and ``pos`` which they came with."""
    notes = notes.select("file_id", "signature", "device", "source", F.array().cast("array<string>").alias("tags"), F.lit(CURRENT_VERSION).alias("schema_version"), "seq")
    names = [f.name for f in schema(PAGES).fields if f.name != "file_id"]
    each = snapshots.select("seq", "file_id", F.posexplode("pages").alias("pos", "p"))
    return Archive(notes, placement, each.select("file_id", *[F.col(f"p.{n}").alias(n) for n in names], "seq", "pos"))


def ingest_batch(store: Store, snapshots: DataFrame, batch: str, now: Column, number: int | None = None) -> DataFrame:
    """One batch: reads what the delivery touches, reconciles, commits. Returns the report; a batch that is committed already changes nothing.

    Of a note the snapshot with the largest ``seq`` counts, whenever it comes, and a page belongs to the note whose claim
    on it has the largest ``seq`` (else the larger id) of all claims ever made, if that note still has it. So the pages'
    owners do not depend on the order of arrival. Only the buckets of the delivered notes, of the notes that hold a
    claimed page and of the claimed pages are read and written. number: of the batch within a stream named ``batch``.

    Everything is decided on ids; the pages themselves are read from snapshots once, when it is known which of them go on. So
    snapshots are read several times, and have to be the same each time.
    """
    if (done := store.commit_of(batch, number)) is not None:
        return store.report(done)
    free_shuffles(store.spark)
    with passing(store.spark):
        return store.report(_commit(store, snapshots, batch, now, number))


def _commit(store: Store, snapshots: DataFrame, batch: str, now: Column, number: int | None) -> str:
    good, failed = split_snapshots(snapshots)
    heads = cut(_head(good), "heads")
    # of snapshots of a note with the same number one counts, with all its pages; pages tell no more of where they come from
    if not heads.groupBy("file_id", "seq").count().where("count > 1").isEmpty():
        good = cut(good.withColumn("_n", F.row_number().over(Window.partitionBy("file_id", "seq").orderBy("seq"))).where("_n = 1").drop("_n"), "snapshots")
        heads = cut(_head(good), "heads")

    # of each page the claim that wins of those made before and those asked for now (``pos``: where in its note), and the claimant of before
    asked = heads.select("file_id", "seq", F.posexplode("ids").alias("pos", "page_id"))
    page_buckets = store.buckets_of(asked, "page")
    before = store.table("claims", page_buckets)
    claim = lambda back: F.struct("seq", "file_id", back.cast("int").alias("back")).alias("claim")
    both = before.select("page_id", claim(F.lit(None)), F.col("file_id").alias("was"), F.lit(False).alias("asked")).unionByName(asked.select("page_id", claim(-F.col("pos")), F.lit(None).cast("string").alias("was"), F.lit(True).alias("asked")))
    best = both.groupBy("page_id").agg(F.max("claim").alias("claim"), F.max("was").alias("was"), F.max("asked").alias("asked"))
    claims = cut(best.select("page_id", "claim.seq", "claim.file_id", (-F.col("claim.back")).alias("pos"), "was", "asked"), "claims")
    files = store.buckets_of(heads.select("file_id").unionAll(claims.where("asked AND was IS NOT NULL").select("was")), "note")
    stored, _ = store.read(files)

    # the newest snapshot of each note that is newer than what is stored, with the claims that it has won
    last = Window.partitionBy("file_id").orderBy(F.desc("seq"))
    known = stored.notes.select("file_id", F.col("seq").alias("_seq"))
    newest = cut(heads.drop("ids").withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n").join(known, "file_id", "left").where("_seq IS NULL OR seq > _seq").drop("_seq"), "newest")
    placement = cut(claims.where("pos IS NOT NULL").join(newest.select("file_id", "seq"), ["file_id", "seq"]).select("file_id", "pos", "page_id", (F.col("pos") + 1).alias("number"), "seq"), "won")
    incoming = as_archive(newest, placement, good)

    # stored notes that lose a page to a claim that is itself out of date: they are delivered again without it
    stale = cut(stored.notes.join(incoming.notes.select("file_id"), "file_id", "left_anti"), "stale")
    kept = cut(stored.placement.join(stale.select("file_id", "seq"), "file_id"), "kept")
    ids = kept.select("page_id").distinct()
    won = claims.select("page_id", F.col("seq").alias("_claim"), F.col("file_id").alias("_by")).join(ids, "page_id", "left_semi")
    moves = placement.join(ids, "page_id", "left_semi").select("page_id", F.lit(True).alias("_moves"))
    lost = (F.col("_by") != F.col("file_id")) & (F.struct(F.col("_claim"), F.col("_by")) > F.struct("seq", "file_id"))
    kept = kept.join(won, "page_id", "left").withColumn("_lost", F.coalesce(lost, F.lit(False))).join(moves, "page_id", "left")
    again = cut(kept.where("_lost AND _moves IS NULL").select("file_id").distinct(), "again")
    rest = kept.where("NOT _lost AND _moves IS NULL").join(again, "file_id", "left_semi").select("file_id", "pos", "page_id", "number", "seq")
    notes = incoming.notes.unionByName(stale.join(again, "file_id", "left_semi"))
    told_again = stored.pages.join(again, "file_id", "left_semi").join(rest.select("file_id", "page_id", "seq", "pos"), ["file_id", "page_id"])
    pages = incoming.pages.unionByName(told_again.select(incoming.pages.columns))
    delivered = Archive(notes, placement.unionByName(rest), pages)

    # pages of delivered notes that they no longer have may be parked
    left = stored.placement.join(notes.select("file_id"), "file_id", "left_semi").select("page_id")
    wider = [b for b in store.buckets_of(left, "page") if b not in page_buckets]
    done = reconcile_pages(delivered, stored, store.table("parked", page_buckets + wider), now)
    a = done.archive
    changed = {
        "note": (files, {"notes": a.notes, "placement": a.placement, "pages": a.pages, "md": a.md}),
        "page": (page_buckets + wider, {"parked": done.parked, "claims": claims.select("page_id", "seq", "file_id").unionByName(store.table("claims", wider))}),
    }
    told = cut(failed.select("seq", "file_id", "reason"), "failed")
    if failures := store.buckets_of(told, "failure"):
        changed["failure"] = (failures, {"failed": store.table("failed", failures).unionByName(told)})
    return store.write(batch, changed, done.report, number, {"note": done.settled, "page": claims})


def stream_ingest(snapshots: DataFrame, root: str, checkpoint: str, trigger: dict | None = None, version: str = "") -> StreamingQuery:
    """Reconciles a stream of snapshots into the archive under root, one commit a batch. ``version`` tells streams into one archive apart."""

    def batch(df: DataFrame, number: int) -> None:
        now = F.lit(df.sparkSession.sql("SELECT date_trunc('second', current_timestamp())").first()[0])
        ingest_batch(Store(df.sparkSession, root), df, f"v{version}", now, number)

    free_shuffles(snapshots.sparkSession)
    return snapshots.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
