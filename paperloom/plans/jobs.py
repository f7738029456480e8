"""Jobs and their stages: append-only rows, the latest state, progress."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import derived_id

# Stages in their order, and the states of a job.
STAGES = ["ingest", "match_template", "extract", "vision_escalation", "validate_questions"]
STATES = ["invalid", "duplicate", "unmatched", "failed", "succeeded"]


def job_id(run: str, document: Column) -> Column:
    return derived_id(F.lit("job"), F.lit(run), document)


def jobs(status: DataFrame, run: str, started_at: str, completed_at: str) -> DataFrame:
    """A row for each document (document_id, status, error)."""
    return status.select(job_id(run, F.col("document_id")).alias("job_id"), "document_id", F.lit("ingest_and_extract").alias("job_type"), "status", F.lit(started_at).alias("started_at"), F.lit(completed_at).alias("completed_at"), F.col("error").alias("error_message"))


def stage_rows(stage: str, metrics: DataFrame, run: str, at: str, status: Column | None = None) -> DataFrame:
    """A row for each document of a stage; its other columns are the stage's metrics, as JSON."""
    if stage not in STAGES:
        raise ValueError(stage)
    own = job_id(run, F.col("document_id"))
    said = F.to_json(F.struct(*[c for c in metrics.columns if c != "document_id"]))
    return metrics.select(derived_id(own, F.lit(stage)).alias("stage_run_id"), own.alias("job_id"), "document_id", F.lit(stage).alias("stage"), (status if status is not None else F.lit("succeeded")).alias("status"), said.alias("metrics"), F.lit(at).alias("completed_at"))


def stages(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def progress(stage_log: DataFrame) -> DataFrame:
    """document_id, stages done, the last one (by the order of STAGES) and when."""
    rank = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    last = F.max(F.struct(rank.alias("rank"), "stage", "completed_at"))
    return stage_log.groupBy("document_id").agg(F.count("*").alias("completed"), last["stage"].alias("stage"), last["completed_at"].alias("latest"))
