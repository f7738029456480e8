"""Documents from files or layout tables to scored, validated questions, all at once."""

from __future__ import annotations

import datetime
import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, get_config
from ..operators import classify, layout, review, rules, scoring, templates, vision
from ..operators.answers import document_metrics
from ..sources import ingest
from ..sources.decoders import decode, detect, layout_table, provider
from ..sources.images import region_statistics
from ..sources.shared import cut
from ..sources.sinks import json_documents, markdown_documents
from . import jobs


@dataclass
class Extract:
    """What an adapter makes of its documents; ``metrics`` has a row for each, ``errors`` those that failed."""

    questions: DataFrame
    issues: DataFrame
    metrics: DataFrame
    exported: DataFrame | None = None
    notes: DataFrame | None = None
    errors: DataFrame | None = None
    escalated: DataFrame | None = None


@dataclass
class Given:
    """What adapters may use beside the layout tables: page images (document_id, page_number, and Spark's image columns) and settings."""

    images: DataFrame | None = None
    detector: str = "mock"
    second: str | None = None
    concurrency: int | None = None


@dataclass
class Outcome:
    matches: DataFrame
    questions: DataFrame
    issues: DataFrame
    tiers: DataFrame
    status: DataFrame
    exported: DataFrame
    notes: DataFrame
    jobs: DataFrame
    stages: DataFrame
    versions: DataFrame


def match(tables: layout.Layout, versions: DataFrame) -> DataFrame:
    return templates.match(classify.fingerprints(tables.pages), versions)


def text_path(tables: layout.Layout, given: Given | None = None) -> Extract:
    """Documents with a text template."""
    exported, notes = layout.parse(tables)
    questions = cut(layout.to_canonical(exported, tables.pages))
    embedded = tables.images.join(classify.question_pages(tables.pages).select("document_id", "page_number"), ["document_id", "page_number"], "left_semi")
    metrics = cut(document_metrics(exported, embedded))
    issues = cut(rules.run_rules(questions, metrics))
    return Extract(scoring.question_confidence(questions, issues), issues, metrics, exported, notes)


def _crops(rows: DataFrame, images: DataFrame | None) -> DataFrame | None:
    """Crop statistics of the regions that are used, where there are page images."""
    if images is None:
        return None
    used = rows.where("role IN ('stem', 'option')").select("document_id", "page_number", vision.crop_path().alias("path"), "box")
    return cut(region_statistics(images, used))


def vision_path(tables: layout.Layout, given: Given | None = None) -> Extract:
    """Documents with a vision template: each page is detected once, and each page with flagged questions once more.

    Layouts are stored before anything is made of them, so a detector that is paid for isn't called again. A page that fails
    leaves its error as a warning; a document all of whose pages fail has failed.
    """
    given = given or Given()
    layouts = cut(vision.sanitise(detect(tables.pages, given.detector, given.concurrency)))
    rows = cut(vision.attributed(layouts))
    questions = cut(vision.assemble(rows))
    crops = _crops(rows, given.images)
    issues = cut(rules.run_rules(questions, crops=crops))
    failed = layouts.where("error is not null").select("document_id", "page_number", F.array(F.concat(F.lit("detect_layout failed: "), "error")).alias("warnings"))
    warned = vision.dropped_warnings(rows).unionByName(failed)
    flagged = cut(vision.select_for_escalation(questions, warned, issues).select("document_id", "question_id", "number", "page_start", "reason"))
    escalated = flagged.withColumn("outcome", F.lit("skipped: no second detector"))
    if given.second:
        again = cut(vision.sanitise(detect(vision.pages_to_look_at_again(flagged, layouts), given.second, given.concurrency)))
        new = cut(vision.escalate(questions.join(flagged.select("question_id"), "question_id", "left_semi"), again).select(*questions.columns))
        lost = again.where("error is not null").select("document_id", F.col("page_number").alias("page_start"), "error")
        escalated = flagged.join(lost, ["document_id", "page_start"], "left").withColumn("outcome", F.coalesce(F.concat(F.lit("skipped: "), "error"), F.lit("escalated"))).drop("error")
        questions = cut(review.replace_by_key(questions, new, ["question_id"]))
        issues = cut(review.recheck(questions, issues, flagged, crops)[0])
    metrics = vision.run_metrics(layouts, questions, rows).join(escalated.groupBy("document_id").agg(F.count_if(F.col("outcome") == "escalated").alias("escalated_count"), F.count_if(F.col("outcome") != "escalated").alias("skipped_count")), "document_id", "left").fillna(0)
    errors = layouts.groupBy("document_id").agg(F.min(F.col("error").isNotNull()).alias("lost"), F.min("error").alias("error")).where("lost").select("document_id", "error")
    return Extract(scoring.question_confidence(questions, issues), issues, cut(metrics), errors=errors, escalated=escalated)


#: The functions that templates name in adapter_ref.
ADAPTERS: dict[str, Callable[[layout.Layout, Given], Extract]] = {"text_layout": text_path, "vision_layout": vision_path}


def adapter(ref: str) -> Callable[[layout.Layout, Given], Extract]:
    if ref not in ADAPTERS:
        raise KeyError(f"no adapter is registered as {ref!r}")
    return ADAPTERS[ref]


def _union(parts: list[DataFrame | None], empty: DataFrame) -> DataFrame:
    out = empty
    for part in parts:
        out = out if part is None else out.unionByName(part.select(*empty.columns))
    return out


def process(tables: layout.Layout, versions: DataFrame, given: Given | None = None, run: str = "run", admitted: DataFrame | None = None) -> Outcome:
    """Each document goes to the adapter of its best template; without one it has no questions, which is no error.

    ``admitted``: document_id, status, error of files, where the tables come from files.
    """
    given, spark = given or Given(), tables.pages.sparkSession
    clock = lambda: datetime.datetime.now(datetime.UTC).isoformat()
    began = clock()
    ranked = cut(match(tables, versions))
    best = cut(ranked.where("matched").select("document_id", "kind", "adapter_ref", "template_id", "version", "score"))
    refs = [r["adapter_ref"] for r in best.select("adapter_ref").distinct().collect()]  # names in the registry of templates
    unknown = best.where(~F.col("adapter_ref").isin([*ADAPTERS])).select("document_id", F.concat(F.lit("no adapter is registered as "), "adapter_ref").alias("error"))

    def of(ref: str) -> layout.Layout:
        ids = best.where(F.col("adapter_ref") == ref).select("document_id")
        return layout.Layout(*[getattr(tables, n).join(ids, "document_id", "left_semi") for n in ("pages", "spans", "chars", "words", "images")])

    made = {ref: adapter(ref)(of(ref), given) for ref in sorted(refs) if ref in ADAPTERS}
    questions = _union([m.questions for m in made.values()], spark.createDataFrame([], "question_id string, document_id string, number string, question_type string, answer string, extraction_mode string, confidence double, status string"))
    issues = _union([m.issues for m in made.values()], spark.createDataFrame([], ", ".join(f"{c} string" for c in rules.ISSUE_COLUMNS)))
    errors = _union([unknown, *(m.errors for m in made.values())], spark.createDataFrame([], "document_id string, error string"))
    exported = next((m.exported for m in made.values() if m.exported is not None), None)
    notes = next((m.notes for m in made.values() if m.notes is not None), None)

    known = tables.pages.select("document_id").distinct().join(best, "document_id", "left").join(errors, "document_id", "left")
    state = F.when(F.col("template_id").isNull(), "unmatched").when(F.col("error").isNotNull(), "failed").otherwise("succeeded")
    status = known.select("document_id", state.alias("status"), "error", "template_id", "version")
    if admitted is not None:
        rest = admitted.join(status.select("document_id"), "document_id", "left_anti").select("document_id", "status", "error", F.lit(None).cast("string").alias("template_id"), F.lit(None).cast("int").alias("version"))
        status = status.unionByName(rest)
    status = cut(status)
    done = best.join(status.where("status = 'succeeded'").select("document_id"), "document_id", "left_semi")
    tiers = scoring.trust_tiers(questions, issues)
    scores = templates.validation_score(issues, ["document_id"], done)
    log = templates.lifecycle(done.select("document_id", "template_id", "version").join(scores, "document_id"), versions, ["document_id"])
    said = rules.summarise(issues, ["document_id"])
    checked = done.select("document_id").join(said, "document_id", "left").fillna(0).join(tiers, "document_id", "left").join(scores, "document_id")
    matched = ranked.where("rank = 1").select("document_id", "matched", "template_id", F.col("version").alias("template_version"), "score")
    parts = [jobs.stage_rows("match_template", matched, run, clock())]
    parts += [jobs.stage_rows("extract", m.metrics, run, clock()) for m in made.values()]
    parts += [jobs.stage_rows("vision_escalation", m.escalated.select("document_id", "number", "reason", "outcome").groupBy("document_id").agg(F.collect_list(F.struct("number", "reason", "outcome")).alias("questions")), run, clock()) for m in made.values() if m.escalated is not None]
    parts.append(jobs.stage_rows("validate_questions", checked, run, clock()))
    if admitted is not None:
        parts.append(jobs.stage_rows("ingest", admitted, run, began, F.when(F.col("status") == "admitted", "succeeded").otherwise(F.col("status"))))
    nothing = spark.createDataFrame([], "document_id string")
    return Outcome(
        ranked, questions, issues, tiers, status, exported if exported is not None else nothing, notes if notes is not None else nothing,
        jobs.jobs(status, run, began, clock()), jobs.stages(parts), templates.after_runs(versions, log, ["document_id"]),
    )


def process_files(spark: SparkSession, path: str, decoder: str, versions: DataFrame, known: DataFrame | None = None, given: Given | None = None, run: str = "run", allow_duplicate: bool = False) -> Outcome:
    """Files of a folder: admitted by magic and digest, decoded and processed. A document's id is its digest."""
    files = cut(ingest.admit(spark, path, known, allow_duplicate).withColumn("document_id", F.when(F.col("status") == "admitted", F.col("sha256")).otherwise(F.concat_ws("#", "sha256", "path"))))
    content = ingest.scan_files(spark, path).select("path", "content").join(files.where("status = 'admitted'").dropDuplicates(["document_id"]), "path").select("document_id", "content")
    decoded = cut(decode(content, decoder))
    tables = layout.Layout(*[layout_table(decoded, n) for n in ("pages", "spans", "chars", "words", "images")])
    tables.words = tables.words.withColumn("seq", F.struct("block_no", "line_no", "word_no"))
    broken = decoded.where("kind = 'error'").select("document_id", F.col("row").alias("said"))
    admitted = files.select("document_id", "status").distinct().join(broken, "document_id", "left").select("document_id", F.when(F.col("said").isNotNull(), "failed").otherwise(F.col("status")).alias("status"), F.col("said").alias("error"))
    return process(tables, versions, given, run, admitted)


def configured(config: Config | None = None) -> Given:
    """Detector, second detector and concurrency as the settings have them."""
    config = config or get_config()
    return Given(detector=provider(config), second=config.vision_second or None, concurrency=config.vision_concurrency)


def main(args: list[str] | None = None) -> None:
    """spark-submit entry: a folder of layout tables (Parquet) in, questions, issues and exports out."""
    source, target = (args or sys.argv[1:])[:2]
    spark = SparkSession.builder.getOrCreate()
    tables = layout.Layout(*[spark.read.parquet(f"{source}/{n}") for n in ("pages_raw", "spans", "chars", "words", "page_images")])
    tables.words = tables.words.withColumn("seq", F.struct("block_no", "line_no", "word_no")) if "seq" not in tables.words.columns else tables.words
    done = process(tables, templates.default_templates(spark), configured())
    for name in ("questions", "issues", "tiers", "status", "notes", "jobs", "stages", "versions"):
        getattr(done, name).write.mode("overwrite").parquet(f"{target}/{name}")
    if "question_number" not in done.exported.columns:
        return  # no document had a text template
    json_documents(done.exported.drop("marker_no")).write.mode("overwrite").parquet(f"{target}/json")
    markdown_documents(done.exported).write.mode("overwrite").parquet(f"{target}/markdown")


if __name__ == "__main__":
    main()
