"""The queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, langid, minhash, pii, quality, sst, substrings, warc
from .common import held_out, table


def op1_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit_on(docs, table(spark, sf_dir, "labels")))


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "coverage", "exact")


def vocabulary() -> str:
    """Place of the public vocabulary file that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), vocabulary())
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_token_sst(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = sst.through_shards(table(spark, sf_dir, "documents"), vocabulary())
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf_dir, "documents"))


def op6_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit_on(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_words", "n_switches")


def op7_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.through_archives(table(spark, sf_dir, "pages"))
    return rows.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


#: Key of the query where the session names none: the tables hold no real persons. The operator itself has no key of its own.
SAMPLE_KEY = "paperloom sample tables"


def op9_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.pseudonyms(table(spark, sf_dir, "documents"), spark.conf.get("spark.paperloom.pseudonymKey", SAMPLE_KEY).encode())
    return made.select("doc_id", "text", F.size("found").alias("n_found"), F.array_sort(F.array_distinct("found.kind")).alias("kinds"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.clusters(table(spark, sf_dir, "documents"), size=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


QUERIES = {f.__name__: f for f in (op1_quality_compression, op2_template_decontamination, op3_bpe_prefix_dp, op4_token_sst, op5_exact_dedup, op6_language_crf, op7_warc_chunks, op8_repeated_substrings, op9_feistel_pseudonyms, op10_minhash_near_dedup)}

ORACLES = {
    "op5_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op7_warc_chunks": """
        WITH n AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
        w AS (SELECT *, strlen(t) AS b, max(page_id) OVER (PARTITION BY t) AS top FROM n)
        SELECT page_id, b AS payload_bytes, sha1(t) AS payload_digest,
               CASE WHEN b >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN b >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM w""",
}
