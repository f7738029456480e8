"""The engine's operators on the driver's tables, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import points_to_normalised, rect, share_inside
from ..functions.text import is_float, natural_order
from ..operators import answers, classify, grouping, layout, review, rules, scoring, templates, vision
from ..sources import ingest, sinks
from ..sources.shared import cut
from .registry import register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- classification, fingerprints, templates ------------------------------------------------------

_PAGE_SQL = "CASE WHEN n_chars < 200 AND doc_id % 2 = 0 THEN 'scanned' WHEN n_chars >= 200 AND (doc_id % 4) / 4.0 < 0.5 THEN 'text_based' ELSE 'mixed' END"


@register("page_type_by_lang", f"SELECT lang, {_PAGE_SQL} AS page_type, count(*) AS n FROM documents GROUP BY ALL")
def page_type_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = classify.page_type(F.col("n_chars"), F.col("doc_id") % 2 == 0, (F.col("doc_id") % 4) / 4.0)
    return t(spark, sf_dir, "documents").groupBy("lang", kind.alias("page_type")).agg(F.count("*").alias("n"))


_PRINT_SQL = """
    SELECT source AS document_id, bool_or(length(text) >= 200) AS requires_text_layer, count(*) AS page_count,
           sum(len(regexp_extract_all(text, 'the')))::BIGINT AS question_marker_hits, sum(len(regexp_extract_all(text, '[0-9]')))::BIGINT AS option_marker_hits,
           bool_or(contains(upper(text), 'GNU GENERAL')) AS answer_key_marker_found,
           bool_or(contains(text, 'MIT License')) AS b1, bool_or(regexp_matches(text, 'AKIA[A-Z0-9]')) AS b2
    FROM documents GROUP BY source"""


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), "text")
    return classify.fingerprints(docs, question_mark="the", option_mark="[0-9]", branding={"mit": "MIT License", "key": "AKIA[A-Z0-9]"}, answer_key="GNU GENERAL")


@register("fingerprint_sources", f"""
    SELECT document_id, requires_text_layer, page_count, question_marker_hits, option_marker_hits, answer_key_marker_found,
           concat_ws(',', CASE WHEN b1 THEN 'mit' END, CASE WHEN b2 THEN 'key' END) AS branding FROM ({_PRINT_SQL})""")  # fmt: skip
def fingerprint_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prints(spark, sf_dir).withColumn("branding", F.array_join("branding_strings_found", ",")).drop("branding_strings_found")


_VERSIONS = [("a", 1, "deterministic_text", "validated", "x", True, ["mit", "key"], 10_000, 1.0, 8, 1), ("b", 1, "vision_layout", "draft", "y", False, [], 900_000, None, 0, 2), ("c", 1, "deterministic_text", "candidate", "x", True, [], 0, 1.0, 8, 3)]


@register("template_match", f"""
    WITH p AS ({_PRINT_SQL}),
    v(template_id, kind, needs, floor, seq) AS (VALUES ('a', 'text', true, 10000, 1), ('b', 'vision', false, 900000, 2)),
    s AS (SELECT document_id, template_id, seq, CASE WHEN kind = 'vision'
            THEN (CASE WHEN requires_text_layer = needs THEN 0.7::DOUBLE ELSE 0 END) + (CASE WHEN question_marker_hits <= floor THEN 0.3::DOUBLE ELSE 0 END)
            ELSE (CASE WHEN requires_text_layer = needs THEN 0.25::DOUBLE ELSE 0 END) + 0.3::DOUBLE * ((b1::INT + b2::INT) / 2.0::DOUBLE)
               + (CASE WHEN question_marker_hits >= floor THEN 0.2::DOUBLE ELSE 0 END) + (CASE WHEN option_marker_hits > 0 THEN 0.15::DOUBLE ELSE 0 END)
               + (CASE WHEN answer_key_marker_found THEN 0.1::DOUBLE ELSE 0 END) END AS score FROM p, v),
    r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, seq) AS rank FROM s)
    SELECT document_id, template_id, round(score, 6) AS score, rank, rank = 1 AND score >= 0.65 AS matched FROM r""")
def template_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = templates.match(_prints(spark, sf_dir), spark.createDataFrame(_VERSIONS, templates.VERSION_SCHEMA))
    return ranked.select("document_id", "template_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "matched")


# -- ingest ---------------------------------------------------------------------------------------


@register("duplicate_gate", """
    WITH h AS (SELECT doc_id, sha256(text) AS sha256 FROM documents)
    SELECT doc_id, sha256, min(doc_id) OVER (PARTITION BY sha256) AS first_of_digest, doc_id <> min(doc_id) OVER (PARTITION BY sha256) AS is_duplicate FROM h""")
def duplicate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return ingest.gate(rows, None, "doc_id")


# -- answers --------------------------------------------------------------------------------------


@register("answer_key_parse", r"""
    WITH e AS (SELECT doc_id, regexp_extract_all(text, '(\d+)\.(\d+)', 1) AS n, regexp_extract_all(text, '(\d+)\.(\d+)', 2) AS a FROM documents),
    r AS (SELECT doc_id, unnest(range(1, len(n) + 1)) AS i, n, a FROM e)
    SELECT doc_id, n[i]::BIGINT AS number, arg_max(a[i], i) AS answer FROM r GROUP BY ALL""")
def answer_key_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.key_entries(t(spark, sf_dir, "documents"), ["doc_id"], pattern=r"(\d+)\.(\d+)")


@register("answer_missing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def answer_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = t(spark, sf_dir, "labels").select("doc_id", "quality")
    return rules.answers_missing(t(spark, sf_dir, "documents").join(given, "doc_id", "left"), "quality").select("doc_id")


@register("answer_coverage", "SELECT lang, round(avg((quality IS NOT NULL)::INT), 6) AS coverage, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def answer_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    return both.groupBy("lang").agg(F.round(answers.answer_coverage(F.col("quality").isNotNull()), 6).alias("coverage"), F.count("*").alias("n"))


@register("answer_format", r"""
    WITH v AS (SELECT p_partkey, unnest([p_size::VARCHAR, p_brand, '-' || p_size || '.5', p_size || '_' || p_size, p_size || 'f', '1e' || p_size, ' nan ', '.' || p_size, '_1']) AS value FROM part)
    SELECT p_partkey, value, regexp_matches(lower(trim(value)), '^[+-]?(inf|infinity|nan|(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?)$') AS numeric FROM v""")
def answer_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size").cast("string")
    values = F.array(s, F.col("p_brand"), F.concat(F.lit("-"), s, F.lit(".5")), F.concat(s, F.lit("_"), s), F.concat(s, F.lit("f")), F.concat(F.lit("1e"), s), F.lit(" nan "), F.concat(F.lit("."), s), F.lit("_1"))
    return t(spark, sf_dir, "part").select("p_partkey", F.explode(values).alias("value")).select("p_partkey", "value", is_float(F.col("value")).alias("numeric"))


# -- sequence and options -------------------------------------------------------------------------


@register("seq_duplicate", "SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS occurrences FROM lineitem) WHERE occurrences > 1")
def seq_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.duplicate_numbers(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", "l_linenumber")


_GAP_SQL = """
    SELECT s.l_orderkey, s.missing FROM (SELECT l_orderkey, unnest(range(min(l_linenumber), max(l_linenumber) + 1))::INT AS missing FROM lineitem GROUP BY l_orderkey) s
    WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = s.l_orderkey AND l.l_linenumber = s.missing)"""


@register("seq_gap", _GAP_SQL)
def seq_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.number_gaps(t(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@register("contiguity", """
    SELECT 'order' AS kind, l_orderkey AS id, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS contiguous FROM lineitem GROUP BY l_orderkey
    UNION ALL SELECT 'conversation', conv_id, min(turn + 1) = 1 AND max(turn + 1) = count(*) AND count(DISTINCT turn) = count(*) FROM conversations GROUP BY conv_id""")
def contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(answers.contiguous(F.col("l_linenumber")).alias("contiguous"))
    b = t(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(answers.contiguous(F.col("turn") + 1).alias("contiguous"))
    return a.select(F.lit("order").alias("kind"), "id", "contiguous").unionByName(b.select(F.lit("conversation").alias("kind"), "id", "contiguous"))


_KIND_SQL = "CASE o_orderstatus WHEN 'F' THEN 'numerical' WHEN 'P' THEN 'unknown' ELSE 'single_correct' END"
_COUNT_SQL = f"""
    SELECT o_orderkey, o_custkey, {_KIND_SQL} AS kind, n, CASE
        WHEN {_KIND_SQL} = 'single_correct' AND n BETWEEN 1 AND 3 THEN 'OPT_PARTIAL_MARKER_SET'
        WHEN {_KIND_SQL} = 'numerical' THEN CASE WHEN n <> 0 THEN 'OPT_COUNT_UNEXPECTED' END
        WHEN {_KIND_SQL} = 'unknown' THEN NULL WHEN n <> 4 THEN 'OPT_COUNT_UNEXPECTED' END AS rule_code
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""
_COUNT_SQL = _COUNT_SQL.replace("LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey", "LEFT JOIN (SELECT l_orderkey, count(*) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey").replace("FROM orders LEFT", "FROM (SELECT *, coalesce(m, 0) AS n FROM orders LEFT") + ")"


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    kind = F.when(F.col("o_orderstatus") == "F", "numerical").when(F.col("o_orderstatus") == "P", "unknown").otherwise("single_correct")
    rows = t(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").fillna(0, ["n"]).withColumn("kind", kind)
    # both may fire: then the partial set is named
    code = F.when(rules.partial_markers(F.col("kind"), F.col("n")), "OPT_PARTIAL_MARKER_SET").when(rules.unexpected_count(F.col("kind"), F.col("n")), "OPT_COUNT_UNEXPECTED")
    return rows.withColumn("rule_code", code)


@register("option_count", f"SELECT o_orderkey, kind, n, rule_code FROM ({_COUNT_SQL})")
def option_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir).select("o_orderkey", "kind", "n", "rule_code")


@register("option_duplicate_label", "SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def option_duplicate_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.duplicate_labels(t(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag")


@register("stem_completeness", r"""
    WITH w AS (SELECT doc_id, text, regexp_split_to_array(trim(text, E' \t\n\r'), '\s+')[-1] AS last FROM documents)
    SELECT doc_id, lower(regexp_replace(last, '[^\p{L}\p{N}_]', '', 'g')) IN ('the','a','an','of','in','on','at','by','for','with','and','or','to','is','are','was') AS stopword,
           right(rtrim(text, E' \t\n\r'), 1) NOT IN ('.', '?', '!', ')') AS no_terminal,
           regexp_matches(lower(text), 'shown below|shown in the figure|shown in figure|as shown') AS visual FROM w""")
def stem_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return t(spark, sf_dir, "documents").select("doc_id", rules.ends_on_stopword(text).alias("stopword"), rules.lacks_terminal(text).alias("no_terminal"), rules.mentions_visual(text).alias("visual"))


# -- issues, confidence, trust, queue ---------------------------------------------------------------

_ISSUE_SQL = f"""
    SELECT o_custkey AS document_id, o_orderkey AS question_id, rule_code, CASE rule_code WHEN 'OPT_PARTIAL_MARKER_SET' THEN 'error' ELSE 'warning' END AS severity FROM ({_COUNT_SQL}) WHERE rule_code IS NOT NULL
    UNION ALL SELECT o_custkey, l_orderkey, 'SEQ_GAP', 'info' FROM ({_GAP_SQL}) JOIN orders ON o_orderkey = l_orderkey
    UNION ALL SELECT o_custkey, l_orderkey, 'OPT_DUPLICATE_LABEL', 'error' FROM (SELECT l_orderkey, l_linestatus, l_shipdate FROM lineitem GROUP BY ALL HAVING count(*) > 1) JOIN orders ON o_orderkey = l_orderkey
    UNION ALL SELECT o_custkey, o_orderkey, 'ANSWER_MISSING', 'blocking' FROM orders WHERE o_totalprice < 20000
    UNION ALL SELECT c_custkey, NULL, 'IMG_CONSERVATION_MISMATCH', 'error' FROM customer WHERE c_acctbal < 0"""


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    owner = orders.select("o_orderkey", "o_custkey")
    lines = t(spark, sf_dir, "lineitem")

    def rows(df: DataFrame, question: str | None, code, severity, document: str = "o_custkey") -> DataFrame:
        q = F.col(question) if question else F.lit(None)
        return df.select(F.col(document).cast("long").alias("document_id"), q.cast("long").alias("question_id"), code.alias("rule_code"), severity.alias("severity"))

    counted = _counted(spark, sf_dir).where("rule_code is not null")
    parts = [
        rows(counted, "o_orderkey", F.col("rule_code"), F.when(F.col("rule_code") == "OPT_PARTIAL_MARKER_SET", "error").otherwise("warning")),
        rows(rules.number_gaps(lines, "l_orderkey", "l_linenumber").withColumnRenamed("l_orderkey", "o_orderkey").join(owner, "o_orderkey"), "o_orderkey", F.lit("SEQ_GAP"), F.lit("info")),
        rows(rules.duplicate_labels(lines, ["l_orderkey", "l_linestatus"], "l_shipdate").withColumnRenamed("l_orderkey", "o_orderkey").join(owner, "o_orderkey"), "o_orderkey", F.lit("OPT_DUPLICATE_LABEL"), F.lit("error")),
        rows(orders.where("o_totalprice < 20000"), "o_orderkey", F.lit("ANSWER_MISSING"), F.lit("blocking")),
        rows(t(spark, sf_dir, "customer").where("c_acctbal < 0"), None, F.lit("IMG_CONSERVATION_MISMATCH"), F.lit("error"), "c_custkey"),
    ]
    return reduce(DataFrame.unionByName, parts)


@register("issues_union", _ISSUE_SQL)
def issues_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir)


@register("issue_summary", f"""
    SELECT rule_code, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'error') AS error,
           count(*) FILTER (severity = 'blocking') AS blocking, count(*) AS total FROM ({_ISSUE_SQL}) GROUP BY rule_code""")
def issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.summarise(_issues(spark, sf_dir), ["rule_code"])


_CONF_SQL = f"""
    WITH i AS ({_ISSUE_SQL}), w AS (SELECT question_id, max(CASE severity WHEN 'blocking' THEN 1.0 WHEN 'error' THEN 0.3 WHEN 'warning' THEN 0.1 ELSE 0.0 END)::DOUBLE AS worst,
             count(*) AS issue_count, bool_or(severity IN ('error', 'blocking')) AS urgent FROM i WHERE question_id IS NOT NULL GROUP BY 1),
    d AS (SELECT DISTINCT document_id FROM i WHERE question_id IS NULL),
    c AS (SELECT o_orderkey AS question_id, o_custkey AS document_id, o_orderstatus, coalesce(issue_count, 0) AS issue_count, coalesce(urgent, false) AS urgent,
             greatest(1.0::DOUBLE - coalesce(worst, 0) - CASE WHEN d.document_id IS NULL THEN 0 ELSE 0.05::DOUBLE END, 0) AS s, o_totalprice >= 20000 AS answered, o_orderstatus = 'P' AS vision
          FROM orders LEFT JOIN w ON w.question_id = o_orderkey LEFT JOIN d ON d.document_id = o_custkey),
    s AS (SELECT *, CASE WHEN answered THEN s ELSE least(s, 0.5::DOUBLE) END AS s2 FROM c)
    SELECT question_id, document_id, o_orderstatus, issue_count, urgent, round(CASE WHEN vision THEN least(s2, 0.6::DOUBLE) ELSE s2 END, 4) AS confidence FROM s"""


def _questions(spark: SparkSession, sf_dir: str, issues: DataFrame) -> DataFrame:
    worst = issues.where("question_id is not null").groupBy("question_id").agg(F.max(scoring.penalty(F.col("severity"))).alias("worst"))
    whole = issues.where("question_id is null").select("document_id").distinct().withColumn("doc", F.lit(True))
    rows = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id"), F.col("o_custkey").alias("document_id"), "o_orderstatus", "o_totalprice")
    rows = rows.join(worst, "question_id", "left").join(whole, "document_id", "left")
    score = scoring.confidence(F.col("worst"), F.coalesce("doc", F.lit(False)), F.lit(True), F.col("o_totalprice") >= 20000, F.col("o_orderstatus") == "P")
    return rows.select("question_id", "document_id", "o_orderstatus", score.alias("confidence"))


@register("question_confidence", f"SELECT question_id, document_id, o_orderstatus, confidence FROM ({_CONF_SQL})")
def question_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir, _issues(spark, sf_dir))


@register("trust_tier", f"""
    WITH i AS ({_ISSUE_SQL}), w AS (SELECT document_id, max(CASE severity WHEN 'blocking' THEN 3 WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) AS r FROM i GROUP BY 1),
    v AS (SELECT o_custkey AS document_id, bool_or(o_orderstatus = 'P') AS vision FROM orders GROUP BY 1)
    SELECT document_id, CASE WHEN r = 3 THEN 'NONE' WHEN r = 2 THEN 'LOW' WHEN r = 1 OR vision THEN 'MEDIUM' ELSE 'HIGH' END AS trust_tier FROM v LEFT JOIN w USING (document_id)""")
def trust_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("o_orderstatus") == "P", "vision_layout").otherwise("deterministic_text")
    return scoring.trust_tiers(t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), mode.alias("extraction_mode")), _issues(spark, sf_dir))


@register("review_queue", f"""
    WITH q AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY urgent DESC, confidence, question_id) AS queue_rank FROM ({_CONF_SQL}) WHERE o_orderstatus <> 'F')
    SELECT document_id, question_id, question_id::VARCHAR AS number, 'single_correct' AS question_type, o_orderstatus AS status, confidence, issue_count, urgent AS has_error_or_blocking, queue_rank
    FROM q WHERE queue_rank <= 5""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: rules, confidence and the five most urgent questions of each document."""
    issues = cut(_issues(spark, sf_dir))  # used three times
    q = _questions(spark, sf_dir, issues).where("o_orderstatus <> 'F'")
    q = q.select("document_id", "question_id", F.col("question_id").cast("string").alias("number"), F.lit("single_correct").alias("question_type"), F.col("o_orderstatus").alias("status"), "confidence")
    return review.review_queue(q, issues, top=5).withColumn("queue_rank", F.col("queue_rank").cast("long"))


# -- layout ---------------------------------------------------------------------------------------


@register("block_extent", """
    SELECT conv_id, turn, row_number() OVER w AS marker_no, turn - 0.25 AS y_start, coalesce(lead(turn) OVER w - 0.25, 1000) AS y_end, lead(turn) OVER w IS NULL AS is_last
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def block_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").cast("double").alias("y"), F.lit(1000.0).alias("end"))
    out = layout.block_extents(marks, ["conv_id"], "y", "end", ["turn"], gap=0.25)
    return out.select("conv_id", "turn", F.col("marker_no").cast("long").alias("marker_no"), "y_start", "y_end", "is_last")


_ROWS_SQL = """
    WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem),
    f AS (SELECT l_orderkey, i, l_quantity AS head, 1 AS row_no, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM s WHERE i = 1
          UNION ALL SELECT s.l_orderkey, s.i, CASE WHEN s.l_quantity - f.head > 6 THEN s.l_quantity ELSE f.head END, f.row_no + (s.l_quantity - f.head > 6)::INT,
                           s.l_linenumber, s.l_partkey, s.l_suppkey, s.l_quantity, s.l_extendedprice FROM f JOIN s ON s.l_orderkey = f.l_orderkey AND s.i = f.i + 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, row_no ORDER BY l_extendedprice, l_quantity, i) AS col_no FROM f)"""


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("seq"))


@register("row_grouping", f"{_ROWS_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_no, col_no::INT AS col_no FROM r")
def row_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.visual_rows(_marks(spark, sf_dir), ["l_orderkey"], grouping.MARK_TOLERANCE).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "row_no", "col_no")


@register("reading_order", _ROWS_SQL.replace("> 6", "> 3") + " SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ' ' ORDER BY row_no, col_no) AS text FROM r GROUP BY 1")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _marks(spark, sf_dir).withColumn("word", F.col("l_partkey").cast("string"))
    return grouping.reading_text(words, ["l_orderkey"], x="x", y="y", seq="seq")


@register("column_edges", f"""{_ROWS_SQL}, m AS (SELECT *, max(l_quantity) FILTER (col_no = 1) OVER (PARTITION BY l_orderkey, row_no) AS top FROM r)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN col_no = 1 THEN 30 ELSE l_extendedprice - 2 END, 6) AS x0, round(top - 2, 6) AS y0,
           round(coalesce(lead(l_extendedprice) OVER (PARTITION BY l_orderkey, row_no ORDER BY col_no) - 2, 565), 6) AS x1 FROM m""")
def column_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = grouping.visual_rows(_marks(spark, sf_dir), ["l_orderkey"], grouping.MARK_TOLERANCE)
    marks = marks.withColumns({"document_id": F.col("l_orderkey"), "page_number": F.lit(1), "marker_no": F.lit(1), "opt_end": F.lit(1e6), "opt_page": F.lit(1)})
    label = F.concat_ws("|", "l_linenumber", "l_partkey", "l_suppkey", "row_no", "col_no")
    boxes = layout.option_rects(marks.withColumn("label", label))
    part = F.split("label", r"\|")
    return boxes.select(F.col("document_id").alias("l_orderkey"), part[0].cast("int").alias("l_linenumber"), part[1].cast("long").alias("l_partkey"), part[2].cast("long").alias("l_suppkey"), F.round("box.x0", 6).alias("x0"), F.round("box.y0", 6).alias("y0"), F.round("box.x1", 6).alias("x1"))


_BOX_SQL = """SELECT vec_id, vec_id // 25 AS page, least(abs(embedding[1]), 1)::DOUBLE / 2 AS x0, least(abs(embedding[2]), 1)::DOUBLE / 2 AS y0,
    least(abs(embedding[1]), 1)::DOUBLE / 2 + 0.05 + least(abs(embedding[3]), 1)::DOUBLE / 3 AS x1, least(abs(embedding[2]), 1)::DOUBLE / 2 + 0.05 + least(abs(embedding[4]), 1)::DOUBLE / 3 AS y1 FROM embeddings"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of 25 to a page."""
    a, b, c, d = (F.least(F.abs(F.col("embedding")[i]), F.lit(1.0).cast("float")).cast("double") for i in range(4))
    return t(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 25).alias("page"), (a / 2).alias("x0"), (b / 2).alias("y0"), (a / 2 + F.lit(0.05) + c / 3).alias("x1"), (b / 2 + F.lit(0.05) + d / 3).alias("y1"))


@register("image_overlap", f"""
    WITH b AS ({_BOX_SQL}), p AS (SELECT a.vec_id AS image_id, r.vec_id AS rect_id, (least(a.x1, r.x1) - greatest(a.x0, r.x0)) AS w, (least(a.y1, r.y1) - greatest(a.y0, r.y0)) AS h,
             greatest((a.x1 - a.x0) * (a.y1 - a.y0), 1e-6) AS area FROM b a JOIN b r ON a.page = r.page AND a.vec_id <> r.vec_id)
    SELECT image_id, rect_id, round(w * h / area, 6) AS share FROM p WHERE w > 0 AND h > 0 AND w * h / area >= 0.5""")
def image_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, r = _boxes(spark, sf_dir).alias("a"), _boxes(spark, sf_dir).alias("r")
    both = a.join(r, (F.col("a.page") == F.col("r.page")) & (F.col("a.vec_id") != F.col("r.vec_id")))
    box = {n: rect(*[F.col(f"{n}.{c}") for c in ("x0", "y0", "x1", "y1")]) for n in "ar"}
    out = both.select(F.col("a.vec_id").alias("image_id"), F.col("r.vec_id").alias("rect_id"), share_inside(box["a"], box["r"]).alias("share")).where("share >= 0.5")
    return out.withColumn("share", F.round("share", 6))


@register("neighbor_clamp", f"""
    WITH b AS ({_BOX_SQL}), n AS (SELECT a.vec_id, a.page, a.x0, a.y0, a.x1, a.y1,
        max(CASE WHEN o.x0 < a.x1 AND o.x1 > a.x0 AND (o.y0 + o.y1) / 2 < (a.y0 + a.y1) / 2 THEN (o.y1 + a.y0) / 2 END) AS above,
        min(CASE WHEN o.x0 < a.x1 AND o.x1 > a.x0 AND (o.y0 + o.y1) / 2 > (a.y0 + a.y1) / 2 THEN (a.y1 + o.y0) / 2 END) AS below,
        max(CASE WHEN o.y0 < a.y1 AND o.y1 > a.y0 AND (o.x0 + o.x1) / 2 < (a.x0 + a.x1) / 2 THEN (o.x1 + a.x0) / 2 END) AS lft,
        min(CASE WHEN o.y0 < a.y1 AND o.y1 > a.y0 AND (o.x0 + o.x1) / 2 > (a.x0 + a.x1) / 2 THEN (a.x1 + o.x0) / 2 END) AS rgt
        FROM b a JOIN b o ON a.page = o.page GROUP BY ALL),
    e AS (SELECT *, greatest(x0 - 0.005, lft) AS a0, greatest(y0 - 0.02, above) AS b0, least(x1 + 0.005, rgt) AS a1, least(y1 + 0.01, below) AS b1 FROM n)
    SELECT vec_id, page, round(greatest(0, CASE WHEN a0 >= a1 THEN x0 ELSE a0 END), 9) AS x0, round(greatest(0, CASE WHEN b0 >= b1 THEN y0 ELSE b0 END), 9) AS y0,
           round(least(1, CASE WHEN a0 >= a1 THEN x1 ELSE a1 END), 9) AS x1, round(least(1, CASE WHEN b0 >= b1 THEN y1 ELSE b1 END), 9) AS y1 FROM e""")
def neighbor_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vision.clamped_boxes(_boxes(spark, sf_dir), ["page"], "vec_id")
    return out.select("vec_id", "page", *[F.round(c, 9).alias(c) for c in ("x0", "y0", "x1", "y1")])


@register("normalised_boxes", f"""
    WITH b AS ({_BOX_SQL}), p AS (SELECT vec_id, vec_id % 4 AS turn, x0 * 612 AS a, y0 * 792 AS b, x1 * 612 AS c, y1 * 792 AS d FROM b),
    q AS (SELECT vec_id, CASE turn WHEN 0 THEN a / 612 WHEN 1 THEN b / 792 WHEN 2 THEN (612 - c) / 612 ELSE (792 - d) / 792 END AS x0,
                 CASE turn WHEN 0 THEN b / 792 WHEN 1 THEN (612 - c) / 612 WHEN 2 THEN (792 - d) / 792 ELSE a / 612 END AS y0,
                 CASE turn WHEN 0 THEN c / 612 WHEN 1 THEN d / 792 WHEN 2 THEN (612 - a) / 612 ELSE (792 - b) / 792 END AS x1,
                 CASE turn WHEN 0 THEN d / 792 WHEN 1 THEN (612 - a) / 612 WHEN 2 THEN (792 - b) / 792 ELSE c / 612 END AS y1 FROM p)
    SELECT vec_id, round(greatest(0, least(x0, 1)), 9) AS x0, round(greatest(0, least(y0, 1)), 9) AS y0, round(greatest(0, least(x1, 1)), 9) AS x1, round(greatest(0, least(y1, 1)), 9) AS y1 FROM q""")
def normalised_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.lit(612.0), F.lit(792.0)
    box = rect(F.col("x0") * w, F.col("y0") * h, F.col("x1") * w, F.col("y1") * h)
    out = _boxes(spark, sf_dir).select("vec_id", points_to_normalised(box, w, h, F.col("vec_id") % 4 * 90).alias("b"))
    return out.select("vec_id", *[F.round(f"b.{c}", 9).alias(c) for c in ("x0", "y0", "x1", "y1")])


@register("note_severity", """
    WITH n AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'Q' || event_id || ': options continue on page 3' WHEN 'view' THEN 'Q' || event_id || ': option (2) marker not found'
               WHEN 'purchase' THEN 'Q' || event_id || ': no options found' WHEN 'error' THEN 'Q' || event_id || ': Found 3 images' ELSE 'remark ' || event_type END AS note FROM events)
    SELECT note, CASE WHEN note ILIKE '%options continue on page%' THEN 'info' WHEN note ILIKE '%option (%' THEN 'warning' WHEN note ILIKE '%no options found%' THEN 'info' WHEN note ILIKE '%found%' THEN 'warning' ELSE 'info' END AS severity,
           try_cast(nullif(regexp_extract(note, '^Q([0-9]+)[^:]*:', 1), '') AS INT) AS question_number, event_id AS document_id FROM n""")
def note_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.concat(F.lit("Q"), F.col("event_id").cast("string"))
    e = F.col("event_type")
    note = F.when(e == "click", F.concat(q, F.lit(": options continue on page 3"))).when(e == "view", F.concat(q, F.lit(": option (2) marker not found"))).when(e == "purchase", F.concat(q, F.lit(": no options found")))
    note = note.when(e == "error", F.concat(q, F.lit(": Found 3 images"))).otherwise(F.concat(F.lit("remark "), e))
    return layout.note_issues(t(spark, sf_dir, "events").select(F.col("event_id").alias("document_id"), note.alias("note")))


# -- vision ---------------------------------------------------------------------------------------


@register("carry_forward", """
    WITH h AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN substr(text, 1, 8) ELSE '' END AS hint FROM conversations)
    SELECT conv_id, turn, CASE WHEN role <> 'system' THEN last_value(CASE WHEN role <> 'system' AND hint <> '' THEN hint END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) END AS number FROM h""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(F.col("role") == "user", F.substring("text", 1, 8)).otherwise("").alias("hint"))
    return vision.carry_forward(rows, ["conv_id"], "turn", "role", "hint", ["system"]).select("conv_id", "turn", "number")


@register("mock_layout", """
    SELECT (page_id // 10)::VARCHAR AS document_id, (page_id % 10 + 1)::VARCHAR AS number, (page_id % 10 + 1)::INT AS page_start, 1 AS n_blocks, 0 AS n_options,
           0.045::DOUBLE AS x0, 0.07::DOUBLE AS y0, 0.955::DOUBLE AS x1, 0.96::DOUBLE AS y1, 0.5::DOUBLE AS least_confidence FROM pages""")
def mock_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts, attribution, padding and assembly from the stand-in detector."""
    pages = t(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 10).cast("string").alias("document_id"), (F.col("page_id") % 10 + 1).cast("int").alias("page_number"))
    q = vision.assemble(vision.attributed(vision.sanitise(vision.mock_layout(pages))))
    box = F.element_at("stem_blocks", 1)["evidence"]["bbox"]
    return q.select("document_id", "number", "page_start", F.size("stem_blocks").alias("n_blocks"), F.size("options").alias("n_options"), *[F.round(box[c], 9).alias(c) for c in ("x0", "y0", "x1", "y1")], vision.least_confidence(F.col("stem_blocks"), F.col("options")).alias("least_confidence"))


@register("escalation", """
    WITH d AS (SELECT doc_id, least(n_chars / 2000.0::DOUBLE, 1) AS c, doc_id % 7 AS n, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
    r AS (SELECT doc_id, CASE WHEN c < 0.6 THEN 'low detection confidence' WHEN n = 0 THEN 'no options detected' WHEN quality = 0 THEN 'unclear image-to-question region mapping on this page'
                 WHEN toxic = 1 THEN 'crop appears clipped (edge-ink-density check)' END AS reason FROM d)
    SELECT * FROM r WHERE reason IS NOT NULL""")
def escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    reason = vision.escalation_reason(F.least(F.col("n_chars") / F.lit(2000.0), F.lit(1.0)), F.col("doc_id") % 7, F.col("quality") == 0, F.col("toxic") == 1)
    return rows.select("doc_id", reason.alias("reason")).where("reason is not null")


# -- lifecycle, state, history --------------------------------------------------------------------

_SCORE_SQL = "CASE event_id % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 ELSE 1.0 END::DOUBLE"


@register("baseline_demotion", f"""
    WITH e AS (SELECT user_id, event_id, {_SCORE_SQL} AS score, user_id % 2 = 0 AS fresh FROM events),
    b AS (SELECT *, CASE WHEN fresh THEN sum(score) OVER w / count(*) OVER w ELSE (0.9::DOUBLE * 8 + sum(score) OVER w) / (8 + count(*) OVER w) END AS baseline, (CASE WHEN fresh THEN 0 ELSE 8 END) + count(*) OVER w AS run_count
          FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
    p AS (SELECT *, coalesce(lag(baseline) OVER (PARTITION BY user_id ORDER BY event_id), CASE WHEN fresh THEN NULL ELSE 0.9::DOUBLE END) AS before FROM b)
    SELECT user_id, event_id, round(baseline, 9) AS baseline, run_count,
           CASE WHEN max((coalesce(run_count - 1 >= 3 AND score < before - 0.15, false))::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) = 1 THEN 'monitored' ELSE 'validated' END AS status FROM p""")
def baseline_demotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    runs = t(spark, sf_dir, "events").select("user_id", "event_id", F.when(k == 0, 0.0).when(k == 1, 0.5).otherwise(1.0).alias("score"))
    fresh = F.col("user_id") % 2 == 0
    versions = runs.select("user_id").distinct().select("user_id", F.when(~fresh, 0.9).alias("baseline_score"), F.when(fresh, 0).otherwise(8).alias("run_count"), F.lit("validated").alias("status"))
    out = templates.lifecycle(runs, versions, ["event_id"], ["user_id"])
    return out.select("user_id", "event_id", F.round("baseline", 9).alias("baseline"), "run_count", "status")


@register("validation_score", f"""
    WITH i AS ({_ISSUE_SQL}) SELECT c_custkey AS document_id, CASE WHEN coalesce(bool_or(severity = 'blocking'), false) THEN 0.0 WHEN coalesce(bool_or(severity = 'error'), false) THEN 0.5 ELSE 1.0 END::DOUBLE AS score
    FROM customer LEFT JOIN i ON document_id = c_custkey GROUP BY 1""")
def validation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.validation_score(_issues(spark, sf_dir), ["document_id"], t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id")))


@register("latest_state", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max((ts, event_id))[2] AS event_id FROM events GROUP BY ALL")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.latest_state(t(spark, sf_dir, "events"), ["user_id", "event_type"], ["value"], ["ts", "event_id"]).drop("ts")


@register("value_change_audit", "SELECT event_id, user_id, event_type, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS previous_value FROM events")
def value_change_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.with_previous(t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts"), ["user_id", "event_type"], "value", ["ts", "event_id"]).drop("ts")


@register("match_history", """
    SELECT e.event_id AS job_id, e.user_id AS document_id, c_name, json_extract_string(props, '$.k')::INT AS k FROM events e LEFT JOIN customer ON c_custkey = user_id
    WHERE event_type = 'purchase' AND json_extract_string(props, '$.k')::INT % 3 = 1 ORDER BY ts DESC, event_id LIMIT 20""")
def match_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    said = F.to_json(F.struct(F.lit(True).alias("matched"), F.concat(F.lit("t"), (F.col("k") % 3).cast("string")).alias("template_id"), F.lit(1).alias("template_version")))
    runs = e.select(F.col("event_id").alias("job_id"), F.when(F.col("event_type") == "purchase", "match_template").otherwise("other").alias("stage"), said.alias("metrics"), F.col("ts").alias("completed_at"), "k")
    jobs = e.select(F.col("event_id").alias("job_id"), F.col("user_id").alias("document_id"))
    docs = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), "c_name")
    return templates.match_history(runs, jobs, docs, "t1", 1).select("job_id", "document_id", "c_name", "k")


@register("natural_sort", """
    WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE p_name END AS number FROM part)
    SELECT p_partkey, p_brand, number, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN try_cast(number AS BIGINT) IS NULL THEN 1 ELSE 0 END, coalesce(try_cast(number AS BIGINT), 0), CASE WHEN try_cast(number AS BIGINT) IS NULL THEN number ELSE '' END, p_partkey) AS place FROM p""")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_name")).alias("number"))
    return p.withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy(*natural_order(F.col("number")), "p_partkey")).cast("long"))


@register("markdown_export", """
    WITH o AS (SELECT l_orderkey, string_agg(E'\n- (' || l_linenumber || ') part ' || l_partkey, '' ORDER BY l_linenumber, l_partkey) AS shown FROM lineitem GROUP BY 1)
    SELECT o_orderkey, '### Q' || o_orderkey || E'\n\n' || o_orderpriority || coalesce(E'\n' || shown, '') || CASE WHEN o_orderstatus = 'F' THEN E'\n\n**Answer:** F' ELSE E'\n\n**Answer:** (' || o_orderstatus || ')' END || E'\n' AS markdown
    FROM orders LEFT JOIN o ON l_orderkey = o_orderkey""")
def markdown_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    item = F.struct("l_linenumber", "l_partkey", F.struct(F.col("l_linenumber").cast("string").alias("label"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("text"), none.alias("images")).alias("o"))
    lines = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.sort_array(F.collect_list(item)), lambda s: s["o"]).alias("options"))
    rows = t(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    options = F.coalesce("options", F.array().cast(lines.schema["options"].dataType))
    kind = F.when(F.col("o_orderstatus") == "F", "numerical").otherwise("mcq")
    return rows.select("o_orderkey", sinks.markdown(F.col("o_orderkey"), kind, F.col("o_orderpriority"), none, options, F.col("o_orderstatus")).alias("markdown"))


from . import exam, seen  # noqa: E402, F401  they register theirs, with helpers of this module
