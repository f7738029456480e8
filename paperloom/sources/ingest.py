"""Uploads: magic check, content hash, duplicate gate, manifest of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut

PDF_MAGIC = b"%PDF-"


def scan_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """path, length, content, modificationTime of files, each read by its own task."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)


def hashed(files: DataFrame) -> DataFrame:
    """Adds sha256 and is_pdf; the content needn't leave the task."""
    return files.withColumn("sha256", F.sha2("content", 256)).withColumn("is_pdf", F.substring("content", 1, 5) == F.lit(PDF_MAGIC))


def gate(rows: DataFrame, known: DataFrame | None, order: str, digest: str = "sha256", allow_duplicate: bool = False) -> DataFrame:
    """Adds is_duplicate: the digest is known already, or an earlier row of this batch has it.

    The first of a digest is found by a minimum per digest, aggregated before the shuffle, and stored, so that
    the join can split a digest with very many rows.
    """
    firsts = cut(rows.groupBy(digest).agg(F.min(order).alias("first_of_digest")))
    out = rows.join(firsts, digest)
    again = F.col(order) != F.col("first_of_digest")
    if known is not None:
        out = out.join(known.select(digest).distinct().withColumn("__k", F.lit(True)), digest, "left")
        again = again | F.coalesce("__k", F.lit(False))
    return out.withColumn("is_duplicate", F.lit(False) if allow_duplicate else again).drop("__k")


def admit(spark: SparkSession, path: str, known: DataFrame | None = None, allow_duplicate: bool = False) -> DataFrame:
    """path, size, sha256 and a status: invalid, duplicate or admitted."""
    rows = hashed(scan_files(spark, path)).select("path", F.col("length").alias("file_size_bytes"), "sha256", "is_pdf")
    good = gate(rows.where("is_pdf"), known, "path", allow_duplicate=allow_duplicate).withColumn("status", F.when(F.col("is_duplicate"), "duplicate").otherwise("admitted"))
    bad = rows.where(~F.col("is_pdf")).withColumn("status", F.lit("invalid"))
    return good.select("path", "file_size_bytes", "sha256", "status").unionByName(bad.select("path", "file_size_bytes", "sha256", "status"))


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """Relative path and digest of every file under a folder, sorted."""
    rows = scan_files(spark, root, recursive=True)
    base = F.lit(root.rstrip("/").removeprefix("file://") + "/")
    return rows.select(F.element_at(F.split("path", base, 2), -1).alias("path"), F.sha2("content", 256).alias("sha256")).orderBy("path")
