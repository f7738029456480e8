"""Exact deduplication by a tree-merge of sorted digest runs.

Each input partition sorts its (digest, id) rows into a run and folds equal digests. The runs
then meet in binomial rounds: with ``FAN`` partners to a round, a partition hands each partner
the part of its run whose shard number has that partner's digit, so after log(P) rounds every
partition holds one shard of the digests. At each level the runs are merged in order and a
digest keeps its smallest identifier and its count only. The merge is Spark's sort of what arrives: a partition's runs come one after
the other, each in order, and TimSort finds such runs and merges them instead of sorting anew, spilling beyond its memory. A partition thus never gets more than
``FAN`` rows of one digest, however many copies there are.

Defined results: a null text counts as empty; a null id sorts after all others; of rows that
repeat both id and text exactly one stays (the first in file order); an empty table gives an
empty result; texts of any length are hashed whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import private, shuffle_width, stored, work_dir

#: Partners that exchange runs in one round.
FAN = 4
_RUN = "pid int, sha binary, n_bytes long, id_null boolean, id long, tag long, n long"


def normalised(text: Column) -> Column:
    """ASCII white space runs as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One small row for each document: id, row tag, length and digest of the normalised text."""
    norm = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("norm"))
    return norm.select(
        F.coalesce("id", F.lit(0)).alias("id"),
        F.col("id").isNull().alias("id_null"),
        F.monotonically_increasing_id().alias("tag"),
        F.octet_length("norm").cast("long").alias("n_bytes"),
        F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"),
    )


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Folds adjacent equal digests of a merged run; holds one batch and one open digest."""
    held = None
    for frame in frames:
        if held is not None:
            frame = pd.concat([held, frame], ignore_index=True)
        if not len(frame):
            continue
        opens = (frame["sha"] != frame["sha"].shift()) | (frame["n_bytes"] != frame["n_bytes"].shift())
        n = frame["n"].groupby(opens.cumsum()).sum()
        firsts = frame[opens].reset_index(drop=True)
        firsts["n"] = n.to_numpy()
        yield firsts.iloc[:-1]
        held = firsts.iloc[-1:]
    if held is not None:
        yield held


def _merged(runs: DataFrame) -> DataFrame:
    return runs.sortWithinPartitions("sha", "n_bytes", "id_null", "id", "tag").mapInPandas(_fold, _RUN)


def tree_merge(rows: DataFrame, width: int) -> DataFrame:
    """Digest rows -> one row (smallest id, count) for each digest, by binomial rounds."""
    parts, rounds = FAN, 1
    while parts < width:
        parts, rounds = parts * FAN, rounds + 1
    runs = rows.select((F.spark_partition_id() % parts).alias("pid"), "sha", "n_bytes", "id_null", "id", "tag", F.lit(1).cast("long").alias("n"))
    runs = _merged(runs)
    shard = F.pmod(F.xxhash64("sha"), F.lit(parts))
    for r in range(rounds):
        low = FAN**r
        own, want = F.floor(F.col("pid") / low) % FAN, F.floor(shard / low) % FAN
        runs = runs.withColumn("pid", (F.col("pid") + (want - own) * low).cast("int"))
        runs = _merged(runs.repartitionById(parts, "pid"))
    return runs


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    rows = stored(digests(docs, id_col, text_col), work_dir(spark), "digests")
    groups = tree_merge(rows, shuffle_width(spark)).select(
        F.col("sha").alias("g_sha"), F.col("n_bytes").alias("g_bytes"), F.col("id_null").alias("g_null"), F.col("id").alias("g_id"), F.col("tag").alias("g_tag"), F.col("n").alias("group_size")
    )
    groups = stored(groups, work_dir(spark), "groups")  # so that the join can split a digest with very many rows
    return rows.join(groups, (F.col("sha") == F.col("g_sha")) & (F.col("n_bytes") == F.col("g_bytes"))).select(
        F.when(~F.col("id_null"), F.col("id")).alias("doc_id"),
        F.when(~F.col("g_null"), F.col("g_id")).alias("keep_id"),
        "group_size",
        (F.col("tag") == F.col("g_tag")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns and no others."""
    names, spark = docs.columns, docs.sparkSession
    sha, null, own = private(docs, "sha", "null", "own")
    rows = stored(digests(docs, id_col, text_col), work_dir(spark), "digests")
    groups = stored(tree_merge(rows, shuffle_width(spark)).select(F.col("sha").alias(sha), F.col("id_null").alias(null), F.col("id").alias(own)), work_dir(spark), "groups")
    keyed = docs.withColumns({sha: F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)), null: F.col(id_col).isNull(), own: F.coalesce(F.col(id_col).cast("long"), F.lit(0))})
    kept = keyed.join(groups, [sha, null, own], "left_semi")
    # rows that repeat id and text: one stays
    return kept.dropDuplicates([sha, null, own]).select(*[F.col(f"`{c}`") for c in names])
