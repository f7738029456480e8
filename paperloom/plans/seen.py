"""Queries of the vision, repair, template, job and table operators on the driver's tables.

A page of ``pages`` gets regions that follow from its id, so what attribution, assembly and escalation must make of
them can be said in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import normalised_to_pixels, rect
from ..operators import review, templates, vision
from ..sources import decoders, images, ingest, sinks
from ..sources.shared import folder
from . import exam, jobs
from .queries import _BOX_SQL, _PRINT_SQL, _SCORE_SQL, _boxes, _prints, t
from .registry import register

_BOX = "named_struct('x0', {}D, 'y0', {}D, 'x1', {}D, 'y1', {}D)"


def _region(name: str, kind: str, box: tuple, number: str = "null", label: str = "null", visual: str = "false", confidence: str = "0.9D") -> str:
    return f"named_struct('region_id', '{name}', 'region_type', {kind}, 'bbox', {_BOX.format(*box)}, 'question_number_hint', cast({number} AS string), 'option_label_hint', cast({label} AS string), 'contains_visual', {visual}, 'confidence', {confidence})"


_KINDS = "CASE page_id % 4 WHEN 0 THEN 'question_stem' WHEN 1 THEN 'diagram' WHEN 2 THEN 'picture' ELSE 'header' END"


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number, a stem (or picture, which is no known type, or header), an option, and on some pages an option of the next number."""
    regions = [
        _region("r0", "'question_number'", (0.05, 0.05, 0.1, 0.08), "page_id % 50"), _region("r1", _KINDS, (0.1, 0.1, 0.9, 0.3), visual="page_id % 2 = 0", confidence="page_id % 10 / 10.0D"),
        _region("r2", "'option_content'", (0.1, 0.4, 0.45, 0.5), label="if(page_id % 3 = 0, '', 'A')"), _region("r3", "'option_label'", (0.55, 0.4, 0.9, 0.5), "page_id % 50 + 1", "'B'"),
    ]
    made = f"filter(array({', '.join(regions)}), r -> r.region_id <> 'r3' OR page_id % 5 = 0)"
    order = "if(page_id % 6 = 0, array('r0', 'r1', 'ghost', 'r2', 'r3'), array('r0', 'r1', 'r2', 'r3'))"
    rows = t(spark, sf_dir, "pages").selectExpr("cast(page_id div 10 AS string) AS document_id", "cast(page_id % 10 + 1 AS int) AS page_number", "'sample' AS served_by", "cast(array() AS array<string>) AS warnings", f"{made} AS regions", f"{order} AS reading_order", "page_id")
    return rows.withColumn("reading_order", F.expr("if(page_id % 5 = 0, reading_order, filter(reading_order, r -> r <> 'r3'))")).drop("page_id")


def _second(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = _region("x", "'question_stem'", (0.1, 0.1, 0.9, 0.3), "if(page_id % 2 = 0, cast(page_id % 50 AS string), concat('Q.', page_id % 50))", confidence="0.95D")
    return t(spark, sf_dir, "pages").selectExpr("cast(page_id div 10 AS string) AS document_id", "cast(page_id % 10 + 1 AS int) AS page_number", f"array({region}) AS regions")


_SEEN_SQL = """
    p AS (SELECT page_id, (page_id // 10)::VARCHAR AS document_id, (page_id % 10 + 1)::INT AS page_start FROM pages),
    s AS (SELECT p.*, (page_id % 50)::VARCHAR AS number, CASE page_id % 4 WHEN 3 THEN 0 ELSE 1 END::BIGINT AS n_stem, CASE WHEN page_id % 3 = 0 THEN '?' ELSE 'A' END AS options,
                 CASE page_id % 4 WHEN 3 THEN 0.9 ELSE least(0.9, page_id % 10 / 10.0) END::DOUBLE AS least_confidence FROM p
          UNION ALL SELECT p.*, (page_id % 50 + 1)::VARCHAR, 0, 'B', 0.9 FROM p WHERE page_id % 5 = 0)"""


def _questions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = vision.attributed(vision.sanitise(layouts(spark, sf_dir)))
    return rows, vision.assemble(rows)


def _shown(q: DataFrame) -> DataFrame:
    labels = F.array_join(F.transform("options", lambda o: o["label"]), ",")
    return q.select("document_id", "page_start", "number", F.size("stem_blocks").cast("long").alias("n_stem"), labels.alias("options"), F.round(vision.least_confidence(F.col("stem_blocks"), F.col("options")), 6).alias("least_confidence"))


@register("vision_questions", f"WITH {_SEEN_SQL} SELECT document_id, page_start, number, n_stem, options, least_confidence FROM s")
def vision_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_questions(spark, sf_dir)[1])


@register("sanitised_layouts", "SELECT page_id // 10 AS document_id, page_id % 10 + 1 AS page_number, CASE page_id % 4 WHEN 0 THEN 'question_stem' WHEN 1 THEN 'diagram' WHEN 2 THEN 'unknown' ELSE 'header' END AS region_type, CASE page_id % 4 WHEN 2 THEN 'unknown region type picture in r1' ELSE '' END AS warning FROM pages")
def sanitised_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vision.sanitise(layouts(spark, sf_dir))
    return out.select(F.col("document_id").cast("long").alias("document_id"), F.col("page_number").cast("long").alias("page_number"), F.col("regions")[1]["region_type"].alias("region_type"), F.array_join("warnings", ",").alias("warning"))


@register("vision_metrics", f"""
    WITH {_SEEN_SQL}, n AS (SELECT document_id, count(*) AS question_count FROM s GROUP BY 1)
    SELECT document_id, count(*) AS page_count, sum(CASE page_id % 5 WHEN 0 THEN 4 ELSE 3 END)::BIGINT AS region_count, any_value(question_count) AS question_count, count(*) FILTER (page_id % 6 = 0) AS pages_with_dropped_regions FROM p JOIN n USING (document_id) GROUP BY 1""")
def vision_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, q = _questions(spark, sf_dir)
    return vision.run_metrics(layouts(spark, sf_dir), q, rows)


@register("vision_flagged", f"""
    WITH {_SEEN_SQL}, r AS (SELECT s.*, CASE WHEN least_confidence < 0.6 THEN 'low detection confidence' WHEN page_id % 6 = 0 THEN 'unclear image-to-question region mapping on this page' WHEN page_start % 2 = 0 THEN 'crop appears clipped (edge-ink-density check)' END AS reason FROM s)
    SELECT document_id, page_start, number, reason FROM r WHERE reason IS NOT NULL""")
def vision_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, q = _questions(spark, sf_dir)
    clipped = q.where("page_start % 2 = 0").select("question_id", F.lit("GEOM_CROP_EDGE_CLIPPED").alias("rule_code"))
    return vision.select_for_escalation(q, vision.dropped_warnings(rows), clipped).select("document_id", "page_start", "number", "reason")


@register("vision_escalated", f"""
    WITH {_SEEN_SQL}, e AS (SELECT *, page_id % 2 = 0 AND number = (page_id % 50)::VARCHAR AS new FROM s)
    SELECT document_id, page_start, number, CASE WHEN new THEN 1 ELSE n_stem END AS n_stem, options, CASE WHEN new THEN 0.9 ELSE least_confidence END AS least_confidence FROM e""")
def vision_escalated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(vision.escalate(_questions(spark, sf_dir)[1], _second(spark, sf_dir)))


class Sample:
    """A detector and reader for the sample tables: page 7 fails, crops that end on 7 can't be read, on 3 fail."""

    def detect_layout(self, document_id: str, page_number: int) -> dict:
        if page_number == 7:
            raise RuntimeError("no page 7")
        box = {"x0": 0.1, "y0": 0.1, "x1": 0.9, "y1": 0.2}
        return {"regions": [{"region_id": "r", "region_type": "question_stem", "bbox": box, "question_number_hint": str(page_number), "option_label_hint": None, "contains_visual": False, "confidence": 0.8}], "reading_order": ["r"]}

    def transcribe_region(self, path: str) -> dict:
        if path.endswith("3.png"):
            raise RuntimeError("no such crop")
        return {"text": f"read {path}", "latex": f"${path}$", "unreadable": path.endswith("7.png")}


decoders.register_detector("sample", Sample)
decoders.register_detector("sample+mock", lambda: decoders.Retrying(Sample(), decoders.Mock(), retries=1, backoff_s=0.0))


@register("detected_pages", """
    SELECT page_id // 10 AS document_id, (page_id % 10 + 1)::INT AS page_number, CASE page_id % 10 WHEN 6 THEN 0 ELSE 1 END::BIGINT AS regions, CASE page_id % 10 WHEN 6 THEN 'no page 7' END AS error, false AS again FROM pages
    UNION ALL SELECT page_id // 10, (page_id % 10 + 1)::INT, CASE page_id % 10 WHEN 6 THEN 0 ELSE 1 END, NULL, page_id % 10 = 6 FROM pages""")
def detected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector alone, and with retries and a fallback: one page's failure is that page's."""
    pages = t(spark, sf_dir, "pages").selectExpr("cast(page_id div 10 AS string) AS document_id", "cast(page_id % 10 + 1 AS int) AS page_number")
    shown = lambda df, again: df.select(F.col("document_id").cast("long").alias("document_id"), "page_number", F.size("regions").cast("long").alias("regions"), "error", again.alias("again"))
    return shown(decoders.detect(pages, "sample"), F.lit(False)).unionByName(shown(decoders.detect(pages, "sample+mock"), F.size("warnings") > 0))


@register("crop_plan", f"""
    WITH b AS ({_BOX_SQL}) SELECT vec_id, round(greatest(x0 * 595 - 3, 0) * 200 / 72, 6) AS x0, round(greatest(y0 * 842 - 3, 0) * 200 / 72, 6) AS y0, round((x1 * 595 + 3) * 200 / 72, 6) AS x1, round((y1 * 842 + 3) * 200 / 72, 6) AS y1,
        round(x0 * 1240, 6) AS px0, round(y1 * 1754, 6) AS py1 FROM b""")
def crop_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles in points as crops of a rendered page, and shares of a page as pixels."""
    w, h = F.lit(595.0), F.lit(842.0)
    box = rect(F.col("x0") * w, F.col("y0") * h, F.col("x1") * w, F.col("y1") * h)
    rows = _boxes(spark, sf_dir).select("vec_id", images.crop_plan(box, 200).alias("b"), normalised_to_pixels(rect(*map(F.col, ("x0", "y0", "x1", "y1"))), F.lit(1240), F.lit(1754)).alias("p"))
    return rows.select("vec_id", *[F.round(f"b.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")], F.round("p.x0", 6).alias("px0"), F.round("p.y1", 6).alias("py1"))


# -- blocks and their repair ----------------------------------------------------------------------

_BLOCKS_SQL = f"""
    {exam._Q_SQL}, b AS (SELECT document_id, question_id, 's0' AS block_id, 'question_stem' AS owner, 'stem' AS field_path, stem AS text, NULL AS path FROM q
    UNION ALL SELECT document_id, question_id, 's1', 'question_stem', 'stem.1', NULL, 's/' || o_orderkey || '.png' FROM q WHERE o_orderkey % 4 = 0
    UNION ALL SELECT o_custkey::VARCHAR, o_orderkey::VARCHAR, 'b' || l_partkey, 'option_content', 'option.' || l_linenumber, 'v', CASE WHEN l_linestatus <> 'F' THEN 'c/' || l_partkey || '.png' END FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""


@register("block_lookup", f"WITH {_BLOCKS_SQL} SELECT document_id, question_id, block_id, owner, field_path, text, path FROM b")
def block_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.block_lookup(exam.order_questions(spark, sf_dir)).drop("latex")


@register("vision_repair", f"""
    WITH {_BLOCKS_SQL}, w AS (SELECT * FROM b WHERE question_id::BIGINT % 20 = 4 AND path IS NOT NULL AND right(path, 5) NOT IN ('3.png', '7.png'))
    SELECT document_id, question_id, 'vision_repair' AS action_type, field_path || '.text' AS field_path, 'read ' || path AS new_value FROM w
    UNION ALL SELECT document_id, question_id, 'vision_repair', field_path || '.latex', '$' || path || '$' FROM w""")
def vision_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader makes of the crops of some questions' blocks, as actions of the review log."""
    q = exam.order_questions(spark, sf_dir)
    wanted = review.block_lookup(q).where("cast(question_id AS long) % 20 = 4")
    return review.repair(q, wanted, "sample", "reviewer", "2024-01-05").select("document_id", "question_id", "action_type", "field_path", "new_value")


# -- templates ------------------------------------------------------------------------------------


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "nation").selectExpr("lower(n_name) AS template_id", "1 AS version", "'deterministic_text' AS kind", "if(n_nationkey % 2 = 0, 'validated', 'candidate') AS status", "'text_layout' AS adapter_ref", "true AS requires_text_layer", "cast(array() AS array<string>) AS branding_strings", "0 AS min_question_marker_hits", "1.0D AS baseline_score", "n_nationkey AS run_count", "10 + n_nationkey AS seq")
    return templates.register_defaults(templates.register_defaults(rows))


@register("template_registry", """
    WITH v AS (SELECT lower(n_name) AS template_id, CASE WHEN n_nationkey = 4 THEN 'deprecated' WHEN n_nationkey % 2 = 0 THEN 'validated' ELSE 'candidate' END AS status, n_nationkey AS run_count, n_name AS name FROM nation
               UNION ALL VALUES ('text_exam', 'validated', 8, NULL), ('vision_exam', 'draft', 0, NULL))
    SELECT template_id, status, run_count::INT AS run_count, name, status IN ('validated', 'monitored', 'draft') AS candidate FROM v""")
def template_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults registered once, one version deprecated, all listed, and which may match."""
    fourth = t(spark, sf_dir, "nation").where("n_nationkey = 4").first()["n_name"].lower()
    now = templates.set_status(_versions(spark, sf_dir), fourth, 1, "deprecated")
    names = t(spark, sf_dir, "nation").select(F.lower("n_name").alias("template_id"), F.col("n_name").alias("name"))
    may = templates.candidates(now).select("template_id", F.lit(True).alias("candidate"))
    return templates.list_templates(names, now).join(may, "template_id", "left").select("template_id", "status", "run_count", "name", F.coalesce("candidate", F.lit(False)).alias("candidate"))


@register("match_reasons", f"""
    WITH p AS ({_PRINT_SQL}), b AS (SELECT *, concat_ws(', ', CASE WHEN b1 THEN 'mit' END, CASE WHEN b2 THEN 'key' END) AS there, concat_ws(', ', CASE WHEN NOT b1 THEN 'mit' END, CASE WHEN NOT b2 THEN 'key' END) AS lacking FROM p)
    SELECT document_id, 'a' AS template_id, concat_ws('; ', CASE WHEN requires_text_layer THEN 'text layer as expected' ELSE 'text layer not as expected' END, CASE WHEN there <> '' THEN 'branding found: ' || there END, CASE WHEN lacking <> '' THEN 'branding not found: ' || lacking END,
        question_marker_hits || ' question marks, as expected: ' || CASE WHEN question_marker_hits >= 10000 THEN 'yes' ELSE 'no' END, CASE WHEN option_marker_hits > 0 THEN 'option marks' ELSE 'no option marks' END, CASE WHEN answer_key_marker_found THEN 'answer key' ELSE 'no answer key' END) AS reasons FROM b
    UNION ALL SELECT document_id, 'b', concat_ws('; ', CASE WHEN requires_text_layer THEN 'text layer not as expected' ELSE 'text layer as expected' END, question_marker_hits || ' question marks, as expected: ' || CASE WHEN question_marker_hits <= 900000 THEN 'yes' ELSE 'no' END) FROM b""")
def match_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import _VERSIONS

    ranked = templates.match(_prints(spark, sf_dir), spark.createDataFrame(_VERSIONS, templates.VERSION_SCHEMA))
    return ranked.select("document_id", "template_id", F.array_join("reasons", "; ").alias("reasons"))


@register("versions_after_runs", f"""
    WITH e AS (SELECT user_id, event_id, {_SCORE_SQL} AS score FROM events), l AS (SELECT user_id, count(*) AS k, sum(score) AS s FROM e GROUP BY 1)
    SELECT c_custkey::VARCHAR AS template_id, round(coalesce(((4 * 0.9::DOUBLE) + s) / (4 + k), 0.9), 9) AS baseline_score, (4 + coalesce(k, 0))::INT AS run_count FROM customer LEFT JOIN l ON user_id = c_custkey""")
def versions_after_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    runs = t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("template_id"), F.lit(1).alias("version"), "event_id", F.when(k == 0, 0.0).when(k == 1, 0.5).otherwise(1.0).alias("score"))
    versions = t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("template_id"), F.lit(1).alias("version"), F.lit("draft").alias("status"), F.lit(0.9).alias("baseline_score"), F.lit(4).alias("run_count"))
    out = templates.after_runs(versions, templates.lifecycle(runs, versions, ["event_id"]), ["event_id"])
    return out.select("template_id", F.round("baseline_score", 9).alias("baseline_score"), "run_count")


# -- jobs and tables ------------------------------------------------------------------------------


@register("latest_job", "SELECT user_id AS document_id, arg_max(event_id, (ts, event_id)) AS job_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1")
def latest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").alias("started_at"))
    return review.latest_job(rows).select("document_id", "job_id", "status")


@register("stage_log", """
    SELECT user_id::VARCHAR AS document_id, ['ingest', 'match_template', 'extract', 'vision_escalation', 'validate_questions'][event_id % 5 + 1] AS stage, 'succeeded' AS status, '{"value":' || event_id % 7 || '}' AS metrics FROM events""")
def stage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("document_id"), (F.col("event_id") % 7).alias("value"), "event_id")
    parts = [jobs.stage_rows(s, e.where(F.col("event_id") % 5 == i).drop("event_id"), "run", "2024-01-01") for i, s in enumerate(jobs.STAGES)]
    return jobs.stages(parts).select("document_id", "stage", "status", "metrics")


@register("stage_progress", """
    WITH s AS (SELECT user_id AS document_id, event_id % 5 AS k, ts FROM events), m AS (SELECT document_id, count(*) AS completed, max(k) AS k FROM s GROUP BY 1)
    SELECT document_id, completed, ['ingest', 'match_template', 'extract', 'vision_escalation', 'validate_questions'][k + 1] AS stage, (SELECT max(ts) FROM s WHERE s.document_id = m.document_id AND s.k = m.k) AS latest FROM m""")
def stage_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, jobs.STAGES))
    log = t(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.get(names, (F.col("event_id") % 5).cast("int")).alias("stage"), F.col("ts").alias("completed_at"))
    return jobs.progress(log)


@register("job_status", "SELECT c_custkey::VARCHAR AS document_id, CASE WHEN c_acctbal < 0 THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN c_acctbal < 0 THEN 'in debt' END AS error_message FROM customer")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "customer").selectExpr("cast(c_custkey AS string) AS document_id", "if(c_acctbal < 0, 'failed', 'succeeded') AS status", "if(c_acctbal < 0, 'in debt', null) AS error")
    return jobs.jobs(rows, "run", "2024-01-01", "2024-01-02").select("document_id", "status", "error_message")


@register("content_hash", """
    WITH c AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '%PDF-1.7 ' || html ELSE html END AS content FROM pages)
    SELECT page_id, sha256(content) AS sha256, starts_with(content, '%PDF-') AS is_pdf FROM c""")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = t(spark, sf_dir, "pages").select("page_id", F.encode(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("%PDF-1.7 "), "html")).otherwise(F.col("html")), "UTF-8").alias("content"))
    return ingest.hashed(files).drop("content")


@register("replaced_rows", "SELECT event_id, user_id, CASE WHEN user_id % 10 = 0 THEN value * 2 ELSE value END AS value FROM events WHERE NOT (user_id % 10 = 0 AND event_id % 2 = 1)")
def replaced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = t(spark, sf_dir, "events").select("event_id", "user_id", "value")
    new = old.where("user_id % 10 = 0 AND event_id % 2 = 0").withColumn("value", F.col("value") * 2)
    return review.replace_by_key(old, new.unionByName(old.where("user_id % 10 = 0 AND event_id % 2 = 1").limit(0)), ["user_id"])


@register("appended_rows", "SELECT o_orderkey, o_orderstatus, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def appended_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written in two batches to a table of the shared folder and looked up by key."""
    rows, path = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"), f"{folder(spark)}/orders"
    for rest in (0, 1):
        sinks.append(rows.where(F.col("o_orderkey") % 2 == rest), path, by=["o_orderstatus"])
    return sinks.lookup(spark.read.parquet(path), o_orderstatus="F").select("o_orderkey", "o_orderstatus", "o_custkey")


@register("json_export", """
    SELECT l_orderkey AS document_id, '[' || string_agg('{"question_number":' || l_linenumber || ',"part":' || l_partkey || ',"flag":"' || l_returnflag || '"}', ',' ORDER BY l_linenumber, '{"question_number":' || l_linenumber || ',"part":' || l_partkey || ',"flag":"' || l_returnflag || '"}') || ']' AS json FROM lineitem GROUP BY 1""")
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("question_number"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"))
    return sinks.json_documents(rows)
