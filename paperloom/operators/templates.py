"""Template matching and lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import cut
from .rules import severity_rank

# Statuses that may match, weights, threshold, and the lifecycle's numbers.
MATCHABLE = ["validated", "monitored", "draft"]
W_TEXT, W_BRANDING, W_QUESTIONS, W_OPTIONS, W_KEY = 0.25, 0.30, 0.20, 0.15, 0.10
W_VISION_TEXT, W_VISION_QUESTIONS = 0.70, 0.30
THRESHOLD, MIN_RUNS, TOLERANCE = 0.65, 3, 0.15

VERSION_SCHEMA = "template_id string, version int, kind string, status string, adapter_ref string, requires_text_layer boolean, branding_strings array<string>, min_question_marker_hits int, baseline_score double, run_count int, seq int"


def default_templates(spark: SparkSession) -> DataFrame:
    """The two templates that a new store starts with: a validated text one and a draft vision one."""
    return spark.createDataFrame(
        [("text_exam", 1, "deterministic_text", "validated", "text_layout", True, ["MathonGo", "Question Paper"], 10, 1.0, 8, 1), ("vision_exam", 1, "vision_layout", "draft", "vision_layout", False, [], 0, None, 0, 2)],
        VERSION_SCHEMA,
    )


def register_defaults(versions: DataFrame) -> DataFrame:
    """Adds the default versions that aren't there."""
    new = default_templates(versions.sparkSession).join(versions.select("template_id", "version"), ["template_id", "version"], "left_anti")
    return versions.unionByName(new)


def candidates(versions: DataFrame) -> DataFrame:
    return versions.where(F.col("status").isin(MATCHABLE))


def _term(hit: Column, weight: float) -> Column:
    return F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))


def score(kind: Column, text_layer: Column, needs_text: Column, branding: Column, expected: Column, hits: Column, floor: Column, option_hits: Column, key_found: Column) -> Column:
    """Weighted agreement of a fingerprint with a signature; the terms add up in this order."""
    ratio = F.when(F.size(expected) > 0, F.size(F.array_intersect(F.array_distinct(expected), branding)) / F.size(expected)).otherwise(F.lit(0.0))
    plain = _term(text_layer == needs_text, W_TEXT) + F.lit(W_BRANDING) * ratio + _term(hits >= floor, W_QUESTIONS) + _term(option_hits > 0, W_OPTIONS) + _term(key_found, W_KEY)
    vision = _term(text_layer == needs_text, W_VISION_TEXT) + _term(hits <= floor, W_VISION_QUESTIONS)
    return F.when(kind == "vision_layout", vision).otherwise(plain)


def match(prints: DataFrame, versions: DataFrame) -> DataFrame:
    """Every fingerprint against every candidate, ranked; the first one at the threshold matches.

    Templates are a registry of a few rows. With no more than 10 000 they are broadcast, else each
    side goes through a shuffled nested loop of Spark's own choice.
    """
    sig = candidates(versions).select("template_id", "version", "kind", "adapter_ref", F.col("requires_text_layer").alias("needs_text"), "branding_strings", "min_question_marker_hits", "seq")
    few = sig.limit(10_001).count() <= 10_000
    both = prints.crossJoin(F.broadcast(sig) if few else sig)
    value = score(F.col("kind"), F.col("requires_text_layer"), F.col("needs_text"), F.col("branding_strings_found"), F.col("branding_strings"), F.col("question_marker_hits"), F.col("min_question_marker_hits"), F.col("option_marker_hits"), F.col("answer_key_marker_found"))
    plain = F.col("kind") != "vision_layout"
    there, lacking = F.array_intersect("branding_strings", "branding_strings_found"), F.array_except("branding_strings", "branding_strings_found")
    enough = F.when(plain, F.col("question_marker_hits") >= F.col("min_question_marker_hits")).otherwise(F.col("question_marker_hits") <= F.col("min_question_marker_hits"))
    reasons = F.array_compact(F.array(
        F.when(F.col("requires_text_layer") == F.col("needs_text"), "text layer as expected").otherwise("text layer not as expected"),
        F.when(plain & (F.size(there) > 0), F.concat(F.lit("branding found: "), F.array_join(there, ", "))),
        F.when(plain & (F.size(lacking) > 0), F.concat(F.lit("branding not found: "), F.array_join(lacking, ", "))),
        F.concat(F.col("question_marker_hits").cast("string"), F.lit(" question marks, as expected: "), F.when(enough, "yes").otherwise("no")),
        F.when(plain, F.when(F.col("option_marker_hits") > 0, "option marks").otherwise("no option marks")),
        F.when(plain, F.when(F.col("answer_key_marker_found"), "answer key").otherwise("no answer key")),
    ))
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("score"), "seq", "template_id", "version"))
    out = both.withColumn("score", value).withColumn("reasons", reasons).withColumn("rank", rank)
    return out.select("document_id", "template_id", "version", "kind", "adapter_ref", "score", "reasons", "rank", ((F.col("rank") == 1) & (F.col("score") >= THRESHOLD)).alias("matched"))


def validation_score(issues: DataFrame, keys: list[str], documents: DataFrame) -> DataFrame:
    """1 without errors, 0.5 with errors, 0 with a blocking issue; each document has a score, also one without issues."""
    worst = issues.groupBy(*keys).agg(F.max(severity_rank(F.col("severity"))).alias("worst"))
    out = documents.select(*keys).distinct().join(worst, keys, "left")
    return out.select(*keys, F.when(F.col("worst") >= 3, 0.0).when(F.col("worst") == 2, 0.5).otherwise(1.0).alias("score"))


def lifecycle(runs: DataFrame, versions: DataFrame, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """The baseline and status after each run of the log.

    The baseline is a running mean that starts with the version's own baseline and runs; a
    validated version is demoted for good by a score below the baseline before it.

    A template may have most of all runs, so its running sums are made in parts: the log is dealt by range, each part is summed,
    and a part's rows start from the sums of the parts before it.
    """
    keys = keys or ["template_id", "version"]
    place, part, last = F.struct(*order), "__part", "__last"
    dealt = cut(runs.repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id()))
    sums = dealt.groupBy(*keys, part).agg(F.count("*").alias("__k"), F.sum("score").alias("__t"))  # a row for each key and part
    ahead = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, part, F.coalesce(F.sum("__k").over(ahead), F.lit(0)).alias("__k0"), F.coalesce(F.sum("__t").over(ahead), F.lit(0.0)).alias("__t0"))
    start = versions.select(*keys, F.col("baseline_score").alias("__b"), F.col("run_count").alias("__n"), F.col("status").alias("__s"))
    start = start.join(dealt.groupBy(*keys).agg(F.min_by("score", place).alias("__first")), keys)
    w = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.withColumns({"__k": F.count("*").over(w), "__t": F.sum("score").over(w)}).join(sums, [*keys, part]).join(start, keys)
    weight = F.when(F.col("__b").isNull(), F.lit(0)).otherwise(F.col("__n"))
    # without a baseline the first score becomes it; runs counted before then count afterwards
    seen, total = F.col("__k0") + F.col("__k"), F.col("__t0") + F.col("__t")
    extra = F.when(F.col("__b").isNull(), F.col("__n")).otherwise(F.lit(0))
    after = (F.coalesce("__b", F.lit(0.0)) * weight + F.col("__first") * extra + total) / (weight + extra + seen)
    before = F.when(seen == 1, F.col("__b")).otherwise((F.coalesce("__b", F.lit(0.0)) * weight + F.col("__first") * extra + total - F.col("score")) / (weight + extra + seen - 1))
    drops = (F.col("__n") + seen - 1 >= MIN_RUNS) & before.isNotNull() & (F.col("score") < before - TOLERANCE)
    out = out.withColumns({"baseline": after, "run_count": F.col("__n") + seen, "__d": F.coalesce(drops, F.lit(False))})
    demoted = out.where("__d").groupBy(*keys).agg(F.min(place).alias(last))
    out = out.join(demoted, keys, "left")
    fallen = F.col(last).isNotNull() & (place >= F.col(last))
    out = out.withColumn("status", F.when((F.col("__s") == "validated") & fallen, "monitored").otherwise(F.col("__s")))
    return out.drop(part, last, "__k", "__t", "__k0", "__t0", "__b", "__n", "__s", "__first", "__d")


def after_runs(versions: DataFrame, log: DataFrame, order: list[str]) -> DataFrame:
    """Versions with the baseline, run count and status after the last of their runs."""
    keys = ["template_id", "version"]
    last = log.groupBy(*keys).agg(F.max_by(F.struct("baseline", "run_count", "status"), F.struct(*order)).alias("__r"))
    out = versions.join(last, keys, "left")
    new = {"baseline_score": F.coalesce("__r.baseline", "baseline_score"), "run_count": F.coalesce("__r.run_count", "run_count").cast("int"), "status": F.coalesce("__r.status", "status")}
    return out.withColumns(new).select(*versions.columns)


def list_templates(templates: DataFrame, versions: DataFrame) -> DataFrame:
    return versions.join(templates, "template_id", "left").orderBy("template_id", "version")


def match_history(stage_runs: DataFrame, jobs: DataFrame, documents: DataFrame, template_id: str, version: int, limit: int = 20) -> DataFrame:
    """The latest runs that matched a version: a top-k report."""
    said = F.from_json("metrics", "matched boolean, template_id string, template_version int, score double")
    runs = stage_runs.where(F.col("stage") == "match_template").withColumn("m", said)
    runs = runs.where(F.col("m.matched") & (F.col("m.template_id") == template_id) & (F.col("m.template_version") == version))
    out = runs.join(jobs, "job_id", "left").join(documents, "document_id", "left")
    return out.orderBy(F.desc("completed_at"), "job_id").limit(limit)


def set_status(versions: DataFrame, template_id: str, version: int, status: str) -> DataFrame:
    hit = (F.col("template_id") == template_id) & (F.col("version") == version)
    return versions.withColumn("status", F.when(hit, status).otherwise(F.col("status")))
