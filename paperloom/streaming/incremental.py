"""Pages as a stream: questions of a page can be queried while others are still to come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.rules import crop_issues, option_issues, sequence_issues, stem_issues
from ..operators.vision import assemble, attributed, dropped_warnings, sanitise
from ..plans import jobs

LAYOUT = "document_id string, page_number int, served_by string, warnings array<string>, reading_order array<string>, regions array<struct<region_id:string,region_type:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,question_number_hint:string,option_label_hint:string,contains_visual:boolean,confidence:double>>"


def layout_stream(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    return spark.readStream.schema(LAYOUT).option("maxFilesPerTrigger", files_at_once).json(path)


def page_batch(layouts: DataFrame, out: str, batch_id: int, crops: DataFrame | None = None) -> None:
    """One batch of whole pages: questions, their issues, warnings and progress.

    Each batch has its own folder, overwritten if the batch is run again, so a restart adds nothing twice.
    """
    layouts = layouts.persist()
    rows = attributed(sanitise(layouts))
    questions = assemble(rows)
    issues = option_issues(questions).unionByName(stem_issues(questions))
    if crops is not None:
        issues = issues.unionByName(crop_issues(questions, crops))
    for name, df in (("questions", questions), ("issues", issues), ("warnings", dropped_warnings(rows)), ("pages", layouts.select("document_id", "page_number"))):
        df.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
    layouts.unpersist()


def process_pages(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Starts the stream; it ends when what is there now has been worked on."""
    return stream.writeStream.foreachBatch(lambda df, i: page_batch(df, out, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(pages_seen: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Stage, pages done, pages in all and status of each document."""
    done = pages_seen.groupBy("document_id").agg(F.count_distinct("page_number").alias("completed"))
    out = page_counts.join(done, "document_id", "left").fillna(0, ["completed"])
    return out.select("document_id", F.lit("detect_layout").alias("stage"), "completed", F.col("page_count").alias("total"), F.when(F.col("completed") >= F.col("page_count"), "succeeded").otherwise("running").alias("status"))


def finalise(questions: DataFrame, issues: DataFrame, status: DataFrame) -> DataFrame:
    """Document-wide rules, once all pages are there: the issues with the sequence's."""
    whole = status.where("status = 'succeeded'").select("document_id")
    return issues.unionByName(sequence_issues(questions.join(whole, "document_id", "left_semi")))


def finish(spark: SparkSession, out: str, page_counts: DataFrame, run: str, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(issues, stages, jobs) of what the stream has written so far: document-wide rules for the documents whose pages are all there."""
    questions, issues, seen = (spark.read.parquet(f"{out}/{name}").drop("batch") for name in ("questions", "issues", "pages"))
    status = progress(seen, page_counts)
    log = jobs.stage_rows("extract", status.select("document_id", "completed", "total", F.col("status").alias("state")), run, at, F.col("state"))
    return finalise(questions, issues, status), log, jobs.jobs(status.select("document_id", "status", F.lit(None).cast("string").alias("error")), run, at, at)
