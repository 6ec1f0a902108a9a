"""Reading archives of JSON, Markdown and SVG files, and writing tables and rendered text.

Every read has an explicit schema, and a file that cannot be read fails the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstack.model import ANALYSIS, CURRENT_VERSION, KEYWORD, LINK, RECT, TITLE
from quillstack.operators.export import render_chunks, render_notes
from quillstack.operators.order import running
from quillstack.operators.view import nest_chunks, nest_notes
from quillstack.sources.scratch import cut

#: The space that rects of pages live in.
PAGE_WIDTH, PAGE_HEIGHT = 1920, 2560

_NOTE = "schema_version int, file_id string, signature string, device string, source string, tags array<string>, pages array<struct<id:string,number:int>>"
_PAGE = f"schema_version int, page_id string, starred boolean, background_hash string, modified_at timestamp, device_modified_at timestamp, device_hash string, tags array<string>, titles array<{TITLE}>, keywords array<{KEYWORD}>, links array<{LINK}>, analysis {ANALYSIS}"


#: Behind a document's name Spark's writers put the name of a part; they name folders ``column=value``.
_PART = r"(?:/part-[^/]*)?\z"


def _owner(path: str = "_metadata.file_path"):
    return F.regexp_extract(F.col(path), r"([^/=]+)/[^/]+" + _PART, 1)


def _stem(path: str = "_metadata.file_path"):
    return F.regexp_extract(F.col(path), r"([^/=]+?)(?:\.[^./]+)?" + _PART, 1)


def _documents(spark: SparkSession, schema: str, paths: str, packed: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", not packed).option("mode", "FAILFAST").json(paths)


def write_packed(docs: DataFrame, root: str) -> None:
    """Documents, or texts with their file_id and page_id, a JSON object a line: as many files as there are tasks, however many notes and pages there are. For readers with ``packed``."""
    docs.write.json(root)


def read_notes(spark: SparkSession, root: str, glob: str = "*/note.json", packed: bool = False) -> tuple[DataFrame, DataFrame]:
    """notes and placement of an archive of <root>/<file_id>/note.json. A file may hold an array of documents; packed, a document a line."""
    docs = _documents(spark, _NOTE, f"{root}/{glob}", packed)
    notes = docs.select("file_id", "signature", "device", "source", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("schema_version", F.lit(0)).alias("schema_version"))
    placement = docs.select("file_id", F.posexplode("pages").alias("pos", "p")).select("file_id", "pos", F.col("p.id").alias("page_id"), F.col("p.number").alias("number"))
    return notes.orderBy("file_id"), placement


def read_pages(spark: SparkSession, root: str, glob: str = "*/P*.json", packed: bool = False) -> DataFrame:
    """Page documents, <root>/<file_id>/P*.json; the owner is the folder. A file may hold an array of documents; packed, a document a line, with its owner as file_id."""
    docs = _documents(spark, f"file_id string, {_PAGE}" if packed else _PAGE, f"{root}/{glob}", packed)
    owner = F.col("file_id") if packed else F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+)/[^/]+\z", 1)
    return docs.select(owner.alias("file_id"), "page_id", F.coalesce("starred", F.lit(False)).alias("starred"), "background_hash", "modified_at", "device_modified_at", "device_hash", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "titles", "keywords", "links", "analysis", F.coalesce("schema_version", F.lit(0)).alias("schema_version"))


def _texts(spark: SparkSession, paths: str, column: str, packed: bool) -> DataFrame:
    if packed:
        return _documents(spark, f"file_id string, page_id string, {column} string", paths, packed)
    return spark.read.text(paths, wholetext=True).select(_owner().alias("file_id"), _stem().alias("page_id"), F.col("value").alias(column))


def read_transcriptions(spark: SparkSession, root: str, glob: str = "*/P*.md", packed: bool = False) -> DataFrame:
    """Page texts, <root>/<file_id>/P*.md (or a folder of that name with one part); packed, a page a line (file_id, page_id, md). A page without a file has no row: joins read it as empty."""
    return _texts(spark, f"{root}/{glob}", "md", packed)


def read_vectors(spark: SparkSession, root: str, glob: str = "*/P*.svg", packed: bool = False) -> DataFrame:
    """Page vectors, <root>/<file_id>/P*.svg (or a folder of that name with one part); packed, a page a line (file_id, page_id, svg)."""
    return _texts(spark, f"{root}/{glob}", "svg", packed)


def box_errors(boxes: DataFrame) -> DataFrame:
    """boxes (image, box_id, rect, ...): image, box_id and what is wrong with them."""
    r = F.col("rect")
    wrong = (
        F.when(F.coalesce("box_id", F.lit("")) == "", "no id")
        .when((r["w"] <= 0) | (r["h"] <= 0), "empty rect")
        .when((r["x"] < 0) | (r["y"] < 0) | (r["x"] + r["w"] > PAGE_WIDTH) | (r["y"] + r["h"] > PAGE_HEIGHT), "rect off the page")
    )
    each = boxes.select("image", "box_id", wrong.alias("error")).where("error IS NOT NULL")
    twice = boxes.groupBy("image", "box_id").count().where("count > 1").select("image", "box_id", F.lit("duplicate id").alias("error"))
    return each.unionAll(twice)


def read_templates(spark: SparkSession, specs: DataFrame) -> DataFrame:
    """Template boxes keyed by the SHA-256 of their image. specs: image (a path), box_pos, box_id, label, rect, analyze, prompt."""
    bad = box_errors(specs).limit(20).collect()
    if bad:
        raise ValueError("; ".join(f"{b.image} box {b.box_id}: {b.error}" for b in bad))
    paths = [r.image for r in specs.select("image").distinct().collect()]  # templates are configuration: few
    images = spark.read.format("binaryFile").load(paths).select(F.col("path"), F.sha2("content", 256).alias("background_hash"))
    same = images.groupBy("background_hash").count().where("count > 1").limit(20).collect()
    if same:
        raise ValueError(f"two templates share the background {same[0].background_hash}")
    bare = F.regexp_replace("path", r"\A\w+:/*", "/")
    return specs.withColumn("_p", F.regexp_replace("image", r"\A\w+:/*", "/")).join(images.withColumn("_p", bare), "_p").select("background_hash", "box_pos", "box_id", "label", F.col("rect").cast(RECT).alias("rect"), "analyze", "prompt")


def schema_gate(docs: DataFrame, strict: bool = True, kind: str = "document", key: str = "page_id") -> DataFrame | tuple[DataFrame, DataFrame]:
    """Refuses documents of another version: strict fails the job naming one, else (sound, refused)."""
    sound = F.coalesce("schema_version", F.lit(0)) == CURRENT_VERSION
    if not strict:
        return docs.where(sound), docs.where(~sound)
    told = F.concat(F.lit(f"{kind} "), F.col(key), F.lit(" has schema version "), F.coalesce("schema_version", F.lit(0)).cast("string"), F.lit(f", not {CURRENT_VERSION}"))
    return docs.withColumn("schema_version", F.when(sound, F.col("schema_version")).otherwise(F.raise_error(told).cast("int")))


def row_hash(df: DataFrame, keys: list[str]):
    held = [c for c in sorted(df.columns) if c not in keys]
    return F.sha2(F.to_json(F.struct(*held), {"ignoreNullFields": "false"}), 256)


def changed_rows(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """new's rows whose content differs from old's or that old lacks, and keys that new lacks, with change (added, updated or removed)."""
    a = new.select(*keys, row_hash(new, keys).alias("_new"))
    b = old.select(*keys, row_hash(old.select(new.columns), keys).alias("_old"))
    both = a.join(b, keys, "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_new") != F.col("_old"), "updated")
    return both.select(*keys, change.alias("change")).where("change IS NOT NULL")


def _numbers(spark: SparkSession, path: str, kind: str, done: str) -> list[int]:
    """Numbers of the complete folders <kind>=<number> under path, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}=*/{done}/_SUCCESS")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    return sorted(int(s.getPath().getParent().getParent().getName().split("=")[1]) for s in found)


def _folder(path: str, kind: str, number: int) -> str:
    return f"{path}/{kind}={number:012d}"


def write_changed(new: DataFrame, old: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Writes the rows that moved as the next version under path, and returns what changed. Nothing is written if nothing did.

    A version is numbered; ``rows`` holds what was added or updated, and ``changes``, written last, what became of each key, so
    that removals are known too. Where no version is stored yet, old is stored as the base that versions count from. Stored
    versions are never touched, so their readers are not disturbed. One writer at a time; keys are not null.
    """
    spark = new.sparkSession
    change = cut(changed_rows(new, old, keys), "changes")
    if change.isEmpty():
        return change
    stored = [*_numbers(spark, path, "base", "whole"), *_numbers(spark, path, "version", "changes")]
    if not stored and not old.isEmpty():
        old.select(new.columns).write.mode("overwrite").parquet(f"{_folder(path, 'base', 0)}/state")
        spark.createDataFrame([(0,)], "version long").write.mode("overwrite").parquet(f"{_folder(path, 'base', 0)}/whole")
    version = _folder(path, "version", max(stored, default=0) + 1)
    new.join(change.where("change <> 'removed'").select(*keys), keys, "left_semi").write.mode("overwrite").parquet(f"{version}/rows")
    change.write.mode("overwrite").parquet(f"{version}/changes")
    return change


def read_changed(spark: SparkSession, path: str, keys: list[str], version: int | None = None) -> DataFrame:
    """The state at a version (the newest by default): of each key the newest row since the base, unless it was removed there.

    One shuffle by key of the base and the changes since; both are read in one scan each, however many versions there are.
    """
    versions = _numbers(spark, path, "version", "changes")
    bases = _numbers(spark, path, "base", "whole")
    last = max([*versions, *bases], default=0) if version is None else version
    base = max((b for b in bases if b <= last), default=None)
    since = [v for v in versions if (base is None or v > base) and v <= last]
    if base is None and not since:
        raise ValueError(f"{path} has no version {'yet' if version is None else version}")
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/version=(\d+)/", 1).cast("long")
    whole = None if base is None else spark.read.parquet(f"{_folder(path, 'base', base)}/state")
    if not since:
        return whole
    moved = spark.read.parquet(*[f"{_folder(path, 'version', v)}/rows" for v in since])
    gone = spark.read.parquet(*[f"{_folder(path, 'version', v)}/changes" for v in since]).where("change = 'removed'")
    columns = moved.columns
    every = moved.withColumns({"_version": number, "_gone": F.lit(False)}).unionByName(gone.withColumns({"_version": number, "_gone": F.lit(True)}).drop("change"), allowMissingColumns=True)
    if whole is not None:
        every = every.unionByName(whole.withColumns({"_version": F.lit(base).cast("long"), "_gone": F.lit(False)}))
    newest = every.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in every.columns if c not in (*keys, "_version")]), "_version").alias("_row"))
    return newest.where("NOT _row._gone").select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in columns])


def compact_changed(spark: SparkSession, path: str, keys: list[str]) -> int:
    """Stores the newest state as a base, from which later reads begin; its version. Older versions stay readable until expire_changed."""
    version = max(_numbers(spark, path, "version", "changes"), default=0)
    if version not in _numbers(spark, path, "base", "whole"):
        read_changed(spark, path, keys, version).write.mode("overwrite").parquet(f"{_folder(path, 'base', version)}/state")
        spark.createDataFrame([(version,)], "version long").write.mode("overwrite").parquet(f"{_folder(path, 'base', version)}/whole")
    return version


def expire_changed(spark: SparkSession, path: str) -> None:
    """Removes bases and versions older than the newest base, which no longer serve the newest state."""
    base = max(_numbers(spark, path, "base", "whole"), default=0)
    old = [("base", b) for b in _numbers(spark, path, "base", "whole") if b < base] + [("version", v) for v in _numbers(spark, path, "version", "changes") if v <= base]
    for kind, number in old:
        at = spark._jvm.org.apache.hadoop.fs.Path(_folder(path, kind, number))
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of a bundle, about: a file of the export.
BUNDLE_BYTES = 32_000_000


def write_bundles(texts: DataFrame, path: str, bundle_bytes: int = BUNDLE_BYTES) -> None:
    """texts (file_id, chunk, text; each text ends with a line feed) in order, one after the other in files of about so many bytes, and an index.

    ``bundles`` holds a file for each bundle, whose bytes are its texts; ``index`` says of each note (file_id) in which bundle,
    at which byte offset and with which length its text is: one row for each bundle that it reaches into. The place of
    every text is a prefix sum over ranges of the order, so files follow the bytes, not the notes, and a note of any size
    is written from many tasks.
    """
    placed = running(texts.withColumn("bytes", F.octet_length("text").cast("long")), ["file_id", "chunk"], weight=F.col("bytes"))
    placed = cut(placed.withColumn("bundle", F.floor(F.col("before") / bundle_bytes).cast("long")), "bundles")
    starts = placed.groupBy("bundle").agg(F.min("before").alias("start"))
    parts = placed.groupBy("file_id", "bundle").agg(F.min("before").alias("first"), F.sum("bytes").alias("length"))
    parts.join(starts, "bundle").select("file_id", "bundle", (F.col("first") - F.col("start")).alias("offset"), "length").write.parquet(f"{path}/index")
    line = F.regexp_replace("text", r"\n\z", "").alias("text")  # the writer ends each with a line feed
    placed.repartition("bundle").sortWithinPartitions("bundle", "before").select("bundle", line).write.partitionBy("bundle").text(f"{path}/bundles")


def read_bundles(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """file_id, part (from 0) and text of all notes or of those asked for (file_id), cut out of their bundles by the index. A note's parts follow each other."""
    index = spark.read.parquet(f"{path}/index")
    index = index if ids is None else index.join(ids.select("file_id").distinct(), "file_id", "left_semi")
    files = spark.read.format("binaryFile").load(f"{path}/bundles").select("bundle", "content")
    part = (F.col("bundle") - F.min("bundle").over(Window.partitionBy("file_id"))).alias("part")
    cut_out = F.substring(F.col("content"), (F.col("offset") + 1).cast("int"), F.col("length").cast("int"))
    return index.select("file_id", "bundle", "offset", "length", part).join(files.withColumn("bundle", F.col("bundle").cast("long")), "bundle").select("file_id", "part", cut_out.cast("string").alias("text"))


def write_export(view: DataFrame, path: str, folders: bool = True, bundle_bytes: int | None = None) -> None:
    """Rendered text: a folder for each note; or, with bundle_bytes, bundles and an index, which many or large notes need; or JSON lines of file_id and text."""
    if bundle_bytes:
        return write_bundles(render_chunks(view), path, bundle_bytes)
    notes = render_notes(view)
    if not folders:
        return notes.write.json(path)
    text = F.regexp_replace("text", r"\n\z", "")  # the writer ends each text with a newline
    return notes.withColumn("text", text).write.partitionBy("file_id").text(path)


def write_views(view: DataFrame, path: str, pages: int | None = None) -> None:
    """Nested notes as JSON, one note a line; with pages, a chunk of so many pages a line."""
    (nest_chunks(view, pages) if pages else nest_notes(view)).write.json(path)
