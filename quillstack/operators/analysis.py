"""Incremental analysis: which pages and boxes need a model, how many calls that takes, and running it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.sources.scratch import cut

KEY = ["file_id", "page_id"]


def box_states(view: DataFrame, prints: DataFrame, force: bool = False) -> DataFrame:
    """One row for each box to analyse of each templated page: state skipped, blank or transcribe.

    view: page_view with boxes. prints: page_id, box_id, fingerprint, has_ink.
    """
    boxes = view.where(F.col("boxes").isNotNull()).select(*KEY, F.map_from_entries(F.transform(F.coalesce("analysis.regions", F.array().cast("array<struct<id:string,source_hash:string>>")), lambda r: F.struct(r["id"], r["source_hash"]))).alias("stored"), F.explode("boxes").alias("b"))
    rows = boxes.where("b.analyze").select(*KEY, F.col("b.box_pos").alias("box_pos"), F.col("b.box_id").alias("box_id"), "stored")
    joined = rows.join(prints.select("page_id", "box_id", "fingerprint", "has_ink"), ["page_id", "box_id"], "left")
    same = F.coalesce(F.element_at("stored", F.col("box_id")) == F.col("fingerprint"), F.lit(False))
    state = F.when(same & F.lit(not force), "skipped").when(~F.coalesce("has_ink", F.lit(True)), "blank").otherwise("transcribe")
    return joined.select("file_id", "page_id", "box_pos", "box_id", "fingerprint", state.alias("state"))


def pages_to_analyze(view: DataFrame, prints: DataFrame, box_prints: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Pages that need analysis and why: forced, never, moved (the fingerprint differs) or boxes.

    view: page_view with boxes; prints: page_id, source_hash; box_prints: page_id, box_id, fingerprint.
    """
    now = prints.select("page_id", F.col("source_hash").alias("_now"))
    rows = view.join(now, "page_id", "left")
    stale = F.lit(False)
    if box_prints is not None:
        held = box_prints.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("box_id", "fingerprint"))).alias("_boxes"))
        rows = rows.join(held, "page_id", "left")
        wanted = F.array_sort(F.transform(F.filter("boxes", lambda b: b["analyze"]), lambda b: F.struct(b["box_id"].alias("id"), F.element_at("_boxes", b["box_id"]).alias("h"))))
        stored = F.array_sort(F.transform(F.coalesce("analysis.regions", F.array().cast("array<struct<id:string,source_hash:string>>")), lambda r: F.struct(r["id"].alias("id"), r["source_hash"].alias("h"))))
        stale = F.col("boxes").isNotNull() & ~wanted.eqNullSafe(stored)
    reason = (
        F.when(F.lit(force), "forced")
        .when(F.col("analysis").isNull(), "never")
        .when(~F.coalesce(F.col("analysis.source_hash") == F.col("_now"), F.lit(False)), "moved")
        .when(stale, "boxes")
    )
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select("file_id", "pos", "page_id", "reason")


def analysis_calls(view: DataFrame, blank: DataFrame, states: DataFrame, n_fields: int) -> DataFrame:
    """The model calls that each page takes at most: content or boxes, custom fields, and names that no user gave.

    blank: page_id of pages without ink; states: box_states.
    """
    unnamed = lambda c: F.size(F.filter(c, lambda r: ~F.coalesce(r["analysis"]["edited"], F.lit(False))))
    boxes = states.groupBy("page_id").agg(F.count_if(F.col("state") == "transcribe").alias("_boxes"))
    rows = view.join(boxes, "page_id", "left").join(blank.select("page_id").distinct().withColumn("_blank", F.lit(True)), "page_id", "left")
    templated = F.col("boxes").isNotNull()
    content = F.when(templated, F.coalesce("_boxes", F.lit(0))).otherwise(F.when(F.col("_blank"), 0).otherwise(1))
    fields = F.when(templated, 0).otherwise(n_fields)
    calls: Column = content + fields + unnamed("titles") + unnamed("links")
    return rows.select("file_id", "page_id", content.cast("long").alias("content"), calls.cast("long").alias("calls"))


_ANSWER = "key string, text string"


class Answers:
    """What a model has answered, stored under path by a hash of the model's name, the prompt and the input. Failures are not kept, so they are asked again."""

    def __init__(self, spark: SparkSession, path: str, model: str):
        self.spark, self.path, self.model = spark, path.rstrip("/"), model

    def key(self, prompt: Column, input_: Column) -> Column:
        """Lengths go before what they are the length of, so that no two askings look alike."""
        told = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
        return F.sha2(F.concat(told(F.lit(self.model)), told(F.coalesce(prompt, F.lit(""))), F.sha2(F.coalesce(input_, F.lit(b"")), 256)), 256)

    def table(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/*/_SUCCESS")
        done = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at) or []
        paths = [s.getPath().getParent().toString() for s in done]
        return self.spark.read.schema(_ANSWER).parquet(*paths) if paths else self.spark.createDataFrame([], _ANSWER)

    def add(self, answers: DataFrame) -> None:
        answers.select("key", "text").write.parquet(f"{self.path}/{uuid.uuid4().hex}")


def ask(requests: DataFrame, model: Callable[[str, bytes], str], partitions: int | None = None, answers: Answers | None = None) -> DataFrame:
    """requests (any columns, prompt, input: binary) with text (trimmed; null on failure) and error: a failed call is a value, not a failed job.

    With answers each distinct (prompt, input) is asked once, and none that is stored. partitions bounds how many calls run at once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, prompt, input_ in zip(batch["key"], batch["prompt"], batch["input"], strict=True):
                try:
                    out.append((key, model(prompt, input_).strip(), None))
                except Exception as e:  # noqa: BLE001  whatever the model raises is this request's result
                    out.append((key, None, str(e)))
            yield pd.DataFrame(out, columns=["key", "text", "error"])

    known = answers or Answers(requests.sparkSession, "", "")
    rows = cut(requests.withColumn("key", known.key(F.col("prompt"), F.col("input"))), "requests")
    open_ = rows.select("key", "prompt", "input").dropDuplicates(["key"])
    stored = answers.table() if answers else None
    if stored is not None:
        stored = cut(stored.dropDuplicates(["key"]).join(rows.select("key").distinct(), "key", "left_semi"), "stored")
        open_ = open_.join(stored, "key", "left_anti")
    if partitions:
        open_ = open_.repartition(partitions)
    told = cut(open_.mapInPandas(run, "key string, text string, error string"), "answers")  # each call is made once, whatever reads its answer
    if answers:
        new = told.where("error IS NULL")
        if not new.isEmpty():
            answers.add(new)
        told = told.unionByName(stored.withColumn("error", F.lit(None).cast("string")))
    return rows.join(told, "key").drop("key", "prompt", "input")


def transcribe(pages: DataFrame, model: Callable[[str, bytes], str], prompt: str, update_prompt: str, partitions: int | None = None, answers: Answers | None = None) -> DataFrame:
    """pages (page_id, image, base): page_id, text (trimmed; null on failure) and error.

    The machine's own last text goes along with the update prompt, the user's edits never do. partitions
    bounds how many calls run at once; a failed call is a value, not a failed job. Equal requests are asked once; with
    answers those that were answered before are not asked again.
    """
    base = F.coalesce("base", F.lit(""))
    asked = F.when(base != "", F.concat(F.lit(f"{update_prompt}\n\n"), base)).otherwise(F.lit(prompt))
    rows = pages.select("page_id", asked.alias("prompt"), F.col("image").cast("binary").alias("input"))
    return ask(rows, model, partitions, answers).select("page_id", "text", "error")


def derive_fields(pages: DataFrame, model: Callable[[str, str], str], prompts: dict[str, str], partitions: int | None = None, answers: Answers | None = None) -> DataFrame:
    """pages (page_id, md): page_id; fields, the model's output for each prompt; and errors, the failures of others. Both null where the text is empty.

    One failed field leaves the page's others, and all other pages, as they are. Equal requests are asked once, as in transcribe.
    """
    names = F.create_map(*[F.lit(x) for n in sorted(prompts) for x in (n, prompts[n])]) if prompts else F.create_map().cast("map<string,string>")
    rows = pages.select("page_id", "md", (F.trim(F.regexp_replace("md", r"\s+", " ")) != "").alias("_some"))
    asked = rows.where("_some").select("page_id", "md", F.explode(names).alias("field", "prompt"))
    told = ask(asked.select("page_id", "field", "prompt", F.col("md").cast("binary").alias("input")), lambda p, text: model(p, text.decode("utf-8", "replace")), partitions, answers)
    listed = lambda value, name: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct("field", value))))).alias(name)
    made = told.groupBy("page_id").agg(listed("text", "fields"), listed("error", "errors"))
    return rows.select("page_id").join(made, "page_id", "left")
