"""Queries of the layout, rule and review operators on papers that are laid out from the driver's tables.

Each order is a paper: its lines are the questions, three to a page, with option marks, words and images at places that
follow from the row, and an answer key on the last page. What the operators must read off such a page
follows from the row too, so the SQL says it without any geometry. Further queries take an order for a question.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import classify, layout, review, rules, scoring
from ..operators.answers import document_metrics
from ..sources.shared import joined_by_documents, kept, width
from .registry import register

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus, l_discount, l_tax"
_KEYS = ["document_id", "page"]
#: Lines in a hash partition at most, about: ten times as many characters are sorted in each task.
PART_LINES = 100_000


def _lines(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    """A row per question: rank r of n, page of pages, mark_y, options, whether they wrap and the stem goes on; dealt by document."""
    w = Window.partitionBy("document_id")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("concat('d', l_orderkey) AS document_id", *_ORDER.split(", "))
    rows = kept(rows.repartition(parts, "document_id").withColumns({"r": F.row_number().over(w.orderBy(*_ORDER.split(", "))), "n": F.count("*").over(w)}), "document_id", parts, True)
    rows = rows.selectExpr("*", "cast((r - 1) div 3 + 1 AS int) AS page", "cast((n + 2) div 3 AS int) AS pages", "(r - 1) % 3 AS slot", "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 3 ELSE 4 END AS n_options")
    rows = rows.selectExpr("*", "100.0D + 220 * slot AS mark_y", "n_options > 0 AND slot = 2 AND l_linestatus = 'O' AND page < pages AS wrapped")
    return rows.selectExpr("*", "wrapped AND l_suppkey % 2 = 0 AS goes_on")


_LINES_SQL = f"""
    a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
    b AS (SELECT *, 'd' || l_orderkey AS document_id, ((r - 1) // 3 + 1)::INT AS page, ((n + 2) // 3)::INT AS pages, (r - 1) % 3 AS slot, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 3 ELSE 4 END AS n_options FROM a),
    c AS (SELECT *, n_options > 0 AND slot = 2 AND l_linestatus = 'O' AND page < pages AS wrapped FROM b),
    k AS (SELECT document_id, l_linenumber, arg_max(l_suppkey % 4 + 1, r)::VARCHAR AS answer FROM c WHERE l_quantity > 5 GROUP BY ALL),
    q AS (SELECT c.*, wrapped AND l_suppkey % 2 = 0 AS goes_on, answer, (l_discount > 0.05)::INT AS stem_images, (n_options > 0 AND NOT wrapped AND l_tax > 0.04)::INT AS option_images, (l_quantity < 10)::INT AS loose_images,
                 100.0::DOUBLE + 220 * slot AS mark_y FROM c LEFT JOIN k USING (document_id, l_linenumber)),
    papers AS (SELECT document_id, any_value(pages) AS pages FROM q GROUP BY 1)"""


def paper_tables(spark: SparkSession, sf_dir: str) -> layout.Layout:
    joined_by_documents(spark)
    parts = max(width(spark), -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // PART_LINES))
    lines = _lines(spark, sf_dir, parts)
    key = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("l_quantity") > 5, F.struct("r", F.expr("concat(l_linenumber, '. (', l_suppkey % 4 + 1, ')')").alias("e"))))), lambda s: s["e"]), " ")
    papers = lines.groupBy("document_id").agg(F.max("pages").alias("pages"), key.alias("key"))
    pages = papers.selectExpr("document_id", "key", "pages", "explode(sequence(1, pages + 1)) AS page_number")
    pages = pages.selectExpr("document_id", "page_number", "595.0D AS width_pt", "842.0D AS height_pt", "0 AS rotation", "CASE WHEN page_number > pages THEN concat('Answer key ', key) ELSE concat('page ', page_number) END AS text", "page_number > pages AS is_key")
    pages = kept(pages, "document_id", parts, True)
    # Each table is made in one pass without a union, so it lies as the lines do.
    no = "{block} AS block_no, {line} AS line_no, 0 AS span_no"
    heads = lines.selectExpr("*", "explode(if(slot = 0, array(0, 1, 2), array(0))) AS i")
    spans = heads.selectExpr("document_id", "page AS page_number", *no.format(block="CASE i WHEN 0 THEN r ELSE 999 + i END", line="0").split(", "), "CASE i WHEN 0 THEN concat(' Q', l_linenumber, '. ') WHEN 1 THEN 'Question Paper' ELSE 'Join the Most Relevant channel' END AS text", "CASE i WHEN 0 THEN mark_y WHEN 1 THEN 20.0D ELSE 800.0D END AS y0").selectExpr("*", "y0 + 10 AS y1")
    options = lines.selectExpr("*", "explode(if(n_options > 0, sequence(1, n_options), array(0))) AS k")  # 0: no option
    place = ["60.0D + 240 * ((k - 1) % 2) AS x", "CASE WHEN wrapped THEN 45.0D + 20 * ((k - 1) div 2) ELSE mark_y + 60 + 40 * ((k - 1) div 2) END AS y", "CASE WHEN wrapped THEN page + 1 ELSE page END AS option_page"]
    signs = options.selectExpr("*", *place).selectExpr("*", "posexplode(if(k = 0, array('f', '(', '1', ')'), array('(', cast(k AS string), ')'))) AS (char_no, c)")
    chars = signs.selectExpr("document_id", "option_page AS page_number", *no.format(block="100 + r", line="k").split(", "), "char_no", "c", "CASE k WHEN 0 THEN mark_y + 20 ELSE y END AS y0", "CASE k WHEN 0 THEN 150.0D ELSE x END + 4 * char_no AS x0")
    told = lines.selectExpr("*", "explode(sequence(0, 2 + n_options)) AS i").where("i <> 2 OR goes_on").selectExpr("*", "greatest(i - 2, 0) AS k").selectExpr("*", *place)  # 0, 1: stem, 2: what goes on, then options
    by = lambda name, stem, part, more, option: f"CASE i WHEN 0 THEN {stem} WHEN 1 THEN {part} WHEN 2 THEN {more} ELSE {option} END AS {name}"
    words = told.selectExpr(
        "document_id", by("page_number", "page", "page", "page + 1", "option_page"), *no.format(block="CASE WHEN i > 2 THEN 100 + r ELSE r END", line="k").split(", "), "CASE i WHEN 1 THEN 1 ELSE 0 END AS word_no",
        by("x0", "60.0D", "100.0D", "60.0D", "x + 20"), by("y0", "mark_y + 20", "mark_y + 21", "35.0D", "y"), by("x1", "90.0D", "140.0D", "90.0D", "x + 60"), by("y1", "mark_y + 28", "mark_y + 29", "41.0D", "y + 8"),
        by("word", "'part'", "cast(l_partkey AS string)", "'more'", "concat('v', k * l_linenumber)"),
    ).withColumn("seq", F.struct("block_no", "line_no", "word_no"))
    shown = lines.selectExpr("*", "explode(array_compact(array(if(l_discount > 0.05, 0, null), if(n_options > 0 AND NOT wrapped AND l_tax > 0.04, 1, null), if(l_quantity < 10, 2, null)))) AS i")
    at = lambda name, stem, option, loose: f"CASE i WHEN 0 THEN {stem} WHEN 1 THEN {option} ELSE {loose} END AS {name}"
    images = shown.selectExpr("document_id", "page AS page_number", "r * 10 + i AS image_no", at("x0", "100.0D", "100.0D", "570.0D"), at("y0", "mark_y + 30", "mark_y + 70", "mark_y + 30"), at("x1", "200.0D", "150.0D", "590.0D"), at("y1", "mark_y + 50", "mark_y + 85", "mark_y + 40"))
    return layout.Layout(pages.drop("is_key"), spans, chars, words, images, parts)


_PARSED: dict[tuple[str, str], tuple[layout.Layout, DataFrame, DataFrame]] = {}


def parsed(spark: SparkSession, sf_dir: str) -> tuple[layout.Layout, DataFrame, DataFrame]:
    """(tables, questions, notes): several queries ask for the parse, which is stored, so a session makes it once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PARSED:
        tables = paper_tables(spark, sf_dir)
        _PARSED[key] = (tables, *layout.parse(tables))
    return _PARSED[key]


_OPTIONS_SQL = "CASE n_options WHEN 0 THEN '' WHEN 3 THEN '1:v' || l_linenumber || '|2:v' || 2 * l_linenumber || '|3:v' || 3 * l_linenumber || '|4:' ELSE '1:v' || l_linenumber || '|2:v' || 2 * l_linenumber || '|3:v' || 3 * l_linenumber || '|4:v' || 4 * l_linenumber END"
_STEM_SQL = "'part ' || l_partkey || CASE WHEN goes_on THEN ' more' ELSE '' END"
_TYPE_SQL = "CASE n_options WHEN 0 THEN 'numerical' ELSE 'mcq' END"


def _shown(options: str = "options"):
    return F.array_join(F.transform(options, lambda o: F.concat(o["label"], F.lit(":"), o["text"])), "|")


@register("layout_questions", f"""
    WITH {_LINES_SQL} SELECT document_id, page AS stem_page, (slot + 1)::BIGINT AS marker_no, l_linenumber::BIGINT AS question_number, {_TYPE_SQL} AS question_type, {_STEM_SQL} AS stem_text, {_OPTIONS_SQL} AS options,
        CASE WHEN stem_images = 1 THEN 'images/q' || l_linenumber || '_stem_diagram_1.png' ELSE '' END AS stem_images, option_images::BIGINT AS option_images, answer, page + goes_on::INT AS stem_end_page FROM q""")
def layout_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks, blocks, option rows and rectangles, wrapped options, stems that go on, images, answers: the whole parse."""
    found = parsed(spark, sf_dir)[1]
    images = F.aggregate("options", F.lit(0), lambda n, o: n + F.size(o["images"])).cast("long")
    return found.select("document_id", "stem_page", F.col("marker_no").cast("long").alias("marker_no"), "question_number", "question_type", "stem_text", _shown().alias("options"), F.array_join("stem_images", ",").alias("stem_images"), images.alias("option_images"), "answer", "stem_end_page")


@register("layout_notes", f"""
    WITH {_LINES_SQL}, t AS (SELECT *, 'Q' || l_linenumber || ': ' AS h, ' (wrapped from page ' || page || ')' AS wr FROM q),
    x AS (SELECT document_id, page, l_linenumber, h || 'options continue on page ' || (page + 1) || wr AS note, 'info' AS severity FROM t WHERE wrapped
    UNION ALL SELECT document_id, page, l_linenumber, h || 'stem continues on page ' || (page + 1) || wr, 'info' FROM t WHERE goes_on
    UNION ALL SELECT document_id, page, l_linenumber, h || 'no options found — treated as a Numerical Value question (page ' || page || ')', 'info' FROM t WHERE n_options = 0
    UNION ALL SELECT document_id, page, l_linenumber, h || 'option (4) marker not found (page ' || page || ')', 'warning' FROM t WHERE n_options = 3
    UNION ALL SELECT document_id, page, l_linenumber, h || 'found ' || (stem_images + option_images + 1) || ' embedded image(s) in this question''s region but only assigned ' || (stem_images + option_images)
        || ' to stem/options (page ' || page || ') — check for overlap or gaps.', 'warning' FROM t WHERE NOT wrapped AND loose_images = 1)
    SELECT document_id, page AS page_number, l_linenumber::BIGINT AS question_number, note, severity FROM x""")
def layout_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir)[2].select("document_id", "page_number", "question_number", "note", "severity")


@register("document_metrics", f"""
    WITH {_LINES_SQL} SELECT document_id, count(*) AS question_count, round(avg((answer IS NOT NULL)::INT), 6) AS answer_coverage,
        coalesce(string_agg(CASE WHEN n_options = 0 THEN l_linenumber::VARCHAR END, ',' ORDER BY l_linenumber), '') AS numerical, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS contiguous_numbering,
        sum(stem_images + option_images)::BIGINT AS assigned_image_count, sum(stem_images + option_images + loose_images)::BIGINT AS embedded_image_count FROM q GROUP BY 1""")
def metrics_of_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, found, _ = parsed(spark, sf_dir)
    embedded = tables.images.join(classify.question_pages(tables.pages).select("document_id", "page_number"), ["document_id", "page_number"], "left_semi")
    m = document_metrics(found, embedded)
    return m.select("document_id", "question_count", F.round("answer_coverage", 6).alias("answer_coverage"), F.array_join("numerical_question_numbers", ",").alias("numerical"), "contiguous_numbering", F.col("assigned_image_count").cast("long").alias("assigned_image_count"), "embedded_image_count")


@register("canonical_questions", f"""
    WITH {_LINES_SQL} SELECT document_id, l_linenumber::VARCHAR AS number, CASE n_options WHEN 0 THEN 'numerical' ELSE 'single_correct' END AS question_type, page AS page_start, page + goes_on::INT AS page_end, answer,
        (1 + stem_images)::BIGINT AS stem_blocks, CASE n_options WHEN 0 THEN 0 ELSE 4 END::BIGINT AS options, CASE n_options WHEN 3 THEN 1 ELSE 0 END::BIGINT AS unreadable,
        round(30 / 595.0::DOUBLE, 9) AS x0, round((mark_y - 2) / 842.0::DOUBLE, 9) AS y0, round(565 / 595.0::DOUBLE, 9) AS x1,
        round(CASE WHEN n_options > 0 AND NOT wrapped THEN mark_y + 58 WHEN slot = 2 OR r = n THEN 798 ELSE mark_y + 218 END / 842.0::DOUBLE, 9) AS y1 FROM q""")
def canonical_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, found, _ = parsed(spark, sf_dir)
    q = layout.to_canonical(found, tables.pages)
    box = F.get("stem_blocks", F.lit(0))["evidence"]["bbox"]
    bare = F.size(F.filter("options", lambda o: o["review_required"] & (o["blocks"][0]["status"] == "unreadable")))
    return q.select("document_id", "number", "question_type", "page_start", "page_end", "answer", F.size("stem_blocks").cast("long").alias("stem_blocks"), F.size("options").cast("long").alias("options"), bare.cast("long").alias("unreadable"), *[F.round(box[c], 9).alias(c) for c in ("x0", "y0", "x1", "y1")])


@register("canonical_round_trip", f"""
    WITH {_LINES_SQL} SELECT document_id, l_linenumber::INT AS question_number, {_TYPE_SQL} AS question_type, {_STEM_SQL} AS stem_text, {_OPTIONS_SQL} AS options, 'images/q' || l_linenumber || '_stem.png' AS stem_snippet, stem_images::BIGINT AS stem_images, answer FROM q""")
def canonical_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, found, _ = parsed(spark, sf_dir)
    out = layout.to_exported(layout.to_canonical(found, tables.pages))
    return out.select("document_id", "question_number", "question_type", "stem_text", _shown().alias("options"), "stem_snippet", F.size("stem_images").cast("long").alias("stem_images"), "answer")


@register("page_frames", f"""
    WITH {_LINES_SQL}, p AS (SELECT document_id, pages, unnest(range(1, pages + 2))::INT AS page_number FROM papers)
    SELECT document_id, page_number, CASE WHEN page_number > pages THEN 55.0 ELSE 34.0 END::DOUBLE AS header_y, CASE WHEN page_number > pages THEN 822.0 ELSE 798.0 END::DOUBLE AS footer_y, pages + 1 AS answer_page, page_number <= pages AS asked FROM p""")
def page_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = paper_tables(spark, sf_dir)
    asked = classify.question_pages(tables.pages).select("document_id", "page_number", F.lit(True).alias("asked"))
    out = classify.page_frames(tables.pages, tables.spans).join(classify.answer_key_pages(tables.pages), "document_id").join(asked, ["document_id", "page_number"], "left")
    return out.withColumn("asked", F.coalesce("asked", F.lit(False)))


@register("page_inspection", f"""
    WITH {_LINES_SQL}, p AS (SELECT document_id, pages, unnest(range(1, pages + 2))::INT AS page_number FROM papers),
    i AS (SELECT document_id, page AS page_number, sum(stem_images * 2000.0 + option_images * 750 + loose_images * 200) AS area FROM q GROUP BY ALL)
    SELECT p.document_id, p.page_number, round(coalesce(area, 0) / (595.0::DOUBLE * 842), 9) AS image_coverage, false AS has_full_page_image, 'mixed' AS page_type
    FROM p LEFT JOIN i USING (document_id, page_number) WHERE page_number <= pages""")
def page_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = paper_tables(spark, sf_dir)
    out = classify.classify_pages(classify.question_pages(tables.pages), tables.images)
    return out.select("document_id", "page_number", F.round("image_coverage", 9).alias("image_coverage"), "has_full_page_image", "page_type")


# -- an order as a question -------------------------------------------------------------------------

_BLOCK = "struct<block_id:string,content_type:string,text:string,clean_crop_path:string,confidence:double,status:string>"
_STEMS = ["", "Which is the", "As shown below.", "How many?", "Name them (all)", "As shown in the figure of"]
_ANSWER = "CASE WHEN o_totalprice < 20000 THEN NULL WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'x' ELSE cast(o_orderkey % 5 + 1 AS {text}) END"
_MODE = "CASE WHEN o_orderkey % 7 = 0 THEN 'vision_layout' ELSE 'deterministic_text' END"
_NUMBER = "CASE WHEN o_orderkey % 11 = 0 THEN concat('Q.', o_orderkey % 3) ELSE cast(o_orderkey % 40 AS {text}) END"
_QTYPE = "CASE o_orderstatus WHEN 'F' THEN 'numerical' WHEN 'P' THEN 'unknown' ELSE 'single_correct' END"
_STEM_CASE = "CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_STEMS)) + " END"


def order_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    option = f"struct({_ORDER}, cast(l_linenumber AS string) AS label, array(cast(struct(concat('b', l_partkey) AS block_id, if(l_returnflag = 'R', 'image', 'text') AS content_type, 'v' AS text, if(l_linestatus = 'F', null, concat('c/', l_partkey, '.png')) AS clean_crop_path, l_discount * 10 AS confidence, 'extracted' AS status) AS {_BLOCK})) AS blocks) AS o"
    options = lines.selectExpr("l_orderkey AS o_orderkey", option).groupBy("o_orderkey").agg(F.transform(F.sort_array(F.collect_list("o")), lambda o: F.struct(o["label"].alias("label"), o["blocks"].alias("blocks"))).alias("options"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").join(options, "o_orderkey", "left")
    block = f"cast(struct('s0' AS block_id, 'mixed' AS content_type, {_STEM_CASE} AS text, cast(null AS string) AS clean_crop_path, 1.0D AS confidence, 'extracted' AS status) AS {_BLOCK})"
    picture = f"cast(struct('s1' AS block_id, 'image' AS content_type, cast(null AS string) AS text, concat('s/', o_orderkey, '.png') AS clean_crop_path, 1.0D AS confidence, 'extracted' AS status) AS {_BLOCK})"
    rows = rows.selectExpr(
        "cast(o_orderkey AS string) AS question_id", "cast(o_custkey AS string) AS document_id", _NUMBER.format(text="string") + " AS number", _QTYPE + " AS question_type", _ANSWER.format(text="string") + " AS answer", _MODE + " AS extraction_mode",
        "1.0D AS confidence", "'draft' AS status", f"if(o_orderkey % 4 = 0, array({block}, {picture}), array({block})) AS stem_blocks", "options",
    )
    return rows.withColumn("options", F.coalesce("options", F.array().cast(options.schema["options"].dataType)))


def _crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 17 <> 0").selectExpr("concat('c/', p_partkey, '.png') AS path", "p_size AS width", "p_size + 5 AS height", "cast(p_partkey % 7 AS double) AS stddev", "p_partkey % 13 = 0 AS clipped")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").cast("string").alias("document_id")).agg(F.count("*").alias("embedded_image_count"), F.count_if(F.col("o_orderstatus") != "F").alias("assigned_image_count"))


def _engine(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    q = order_questions(spark, sf_dir)
    return q, rules.run_rules(q, _counts(spark, sf_dir), _crops(spark, sf_dir))


_Q_SQL = f"""
    q AS (SELECT o_orderkey::VARCHAR AS question_id, o_custkey::VARCHAR AS document_id, o_orderkey, {_NUMBER.format(text='VARCHAR')} AS number, {_QTYPE} AS question_type, {_ANSWER.format(text='VARCHAR')} AS answer, {_MODE} AS extraction_mode, {_STEM_CASE} AS stem FROM orders),
    l AS (SELECT q.*, l_linenumber::VARCHAR AS label, l_returnflag, CASE WHEN l_linestatus <> 'F' THEN 'c/' || l_partkey || '.png' END AS path FROM q JOIN lineitem ON l_orderkey = o_orderkey),
    n AS (SELECT q.*, coalesce(m, 0) AS n FROM q LEFT JOIN (SELECT question_id, count(*) AS m FROM l GROUP BY 1) USING (question_id))"""


def _families_sql(n: str = "n", l: str = "l") -> str:  # noqa: E741
    """Option and stem issues in SQL, of questions n and their options l."""
    word = "lower(regexp_replace(regexp_split_to_array(trim(stem), '\\s+')[-1], '[^\\p{L}\\p{N}_]', '', 'g'))"
    return f"""
    SELECT document_id, question_id, 'OPT_DUPLICATE_LABEL' AS rule_code, 'error' AS severity, 'options' AS field_path, NULL AS evidence_path FROM {l} GROUP BY document_id, question_id, label HAVING count(*) > 1
    UNION ALL SELECT document_id, question_id, 'OPT_COUNT_UNEXPECTED', 'warning', 'options', NULL FROM {n} WHERE CASE question_type WHEN 'numerical' THEN n <> 0 WHEN 'unknown' THEN false ELSE n <> 4 END
    UNION ALL SELECT document_id, question_id, 'OPT_PARTIAL_MARKER_SET', 'error', 'options', NULL FROM {n} WHERE question_type NOT IN ('numerical', 'unknown') AND n BETWEEN 1 AND 3
    UNION ALL SELECT document_id, question_id, 'OPT_IMAGE_OPTION_NO_ASSET', 'error', 'options', NULL FROM {l} WHERE l_returnflag = 'R' AND path IS NULL
    UNION ALL SELECT document_id, question_id, 'STEM_TRAILING_STOPWORD', 'warning', 'stem_blocks', NULL FROM {n} WHERE stem <> '' AND {word} IN ('the', 'a', 'an', 'of', 'in', 'on', 'at', 'by', 'for', 'with', 'and', 'or', 'to', 'is', 'are', 'was')
    UNION ALL SELECT document_id, question_id, 'STEM_NO_TERMINAL_PUNCTUATION', 'warning', 'stem_blocks', NULL FROM {n} WHERE stem = '' OR right(stem, 1) NOT IN ('.', '?', '!', ')')
    UNION ALL SELECT document_id, question_id, 'STEM_REFERENCES_VISUAL_WITHOUT_IMAGE', 'warning', 'stem_blocks', NULL FROM {n} WHERE regexp_matches(lower(stem), 'shown below|shown in the figure|shown in figure|as shown') AND o_orderkey % 4 <> 0"""


_CROPS_SQL = """
    used AS (SELECT document_id, question_id, 'options' AS field_path, path FROM l WHERE path IS NOT NULL UNION ALL SELECT document_id, question_id, 'stem_blocks', 's/' || o_orderkey || '.png' FROM q WHERE o_orderkey % 4 = 0),
    seen AS (SELECT used.*, p_partkey, p_size FROM used LEFT JOIN part ON p_partkey % 17 <> 0 AND path = 'c/' || p_partkey || '.png')"""
_GEOM_SQL = """
    SELECT document_id, question_id, 'GEOM_CROP_FILE_MISSING' AS rule_code, 'error' AS severity, field_path, path AS evidence_path FROM seen WHERE p_partkey IS NULL
    UNION ALL SELECT document_id, question_id, 'GEOM_CROP_TOO_SMALL', 'warning', field_path, path FROM seen WHERE p_size < 20 OR p_size + 5 < 20
    UNION ALL SELECT document_id, question_id, 'GEOM_CROP_BLANK', 'warning', field_path, path FROM seen WHERE p_partkey % 7 < 3
    UNION ALL SELECT document_id, question_id, 'GEOM_CROP_EDGE_CLIPPED', 'warning', field_path, path FROM seen WHERE p_partkey % 13 = 0"""
_REST_SQL = """
    SELECT document_id, question_id, 'ANSWER_MISSING' AS rule_code, 'blocking' AS severity, 'answer' AS field_path, NULL AS evidence_path FROM q WHERE extraction_mode <> 'vision_layout' AND answer IS NULL
    UNION ALL SELECT document_id, question_id, 'ANSWER_UNSUPPORTED_FORMAT', 'warning', 'answer', NULL FROM q WHERE extraction_mode <> 'vision_layout' AND question_type = 'numerical' AND answer = 'x'
    UNION ALL SELECT document_id, question_id, 'ANSWER_POINTS_TO_MISSING_OPTION', 'error', 'answer', NULL FROM q WHERE extraction_mode <> 'vision_layout' AND question_type <> 'numerical' AND answer IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM l WHERE l.question_id = q.question_id AND l.label = q.answer)
    UNION ALL SELECT document_id, question_id, 'SEQ_DUPLICATE_NUMBER', 'blocking', 'number', NULL FROM (SELECT *, count(*) OVER (PARTITION BY document_id, number) AS c FROM q) WHERE c > 1
    UNION ALL SELECT s.document_id, NULL, 'SEQ_GAP', 'warning', 'number', NULL FROM (SELECT document_id, unnest(range(min(try_cast(number AS BIGINT)), max(try_cast(number AS BIGINT)) + 1)) AS x FROM q GROUP BY 1) s
        WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.document_id = s.document_id AND try_cast(q.number AS BIGINT) = s.x)
    UNION ALL SELECT o_custkey::VARCHAR, NULL, 'IMG_CONSERVATION_MISMATCH', 'error', NULL, NULL FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'F') > 0"""
_ENGINE_SQL = f"{_Q_SQL}, {_CROPS_SQL}, i AS ({_REST_SQL} UNION ALL {_families_sql()} UNION ALL {_GEOM_SQL})"


@register("rule_engine", f"WITH {_ENGINE_SQL} SELECT document_id, question_id, rule_code, severity, field_path, evidence_path FROM i")
def rule_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 17 rules over all questions, with image counts and crops."""
    return _engine(spark, sf_dir)[1].select("document_id", "question_id", "rule_code", "severity", "field_path", "evidence_path")


_CONFIDENCE_SQL = """
    w AS (SELECT document_id, question_id, max(CASE severity WHEN 'blocking' THEN 1.0 WHEN 'error' THEN 0.3 WHEN 'warning' THEN 0.1 ELSE 0.0 END)::DOUBLE AS worst FROM i WHERE question_id IS NOT NULL GROUP BY ALL),
    d AS (SELECT DISTINCT document_id, true AS whole FROM i WHERE question_id IS NULL),
    s AS (SELECT q.*, greatest(1.0::DOUBLE - coalesce(worst, 0) - CASE WHEN whole THEN 0.05::DOUBLE ELSE 0 END, 0) AS s FROM q LEFT JOIN w USING (document_id, question_id) LEFT JOIN d USING (document_id)),
    s2 AS (SELECT *, CASE WHEN answer IS NULL OR (stem = '' AND o_orderkey % 4 <> 0) THEN least(s, 0.5::DOUBLE) ELSE s END AS t FROM s)"""


@register("engine_confidence", f"WITH {_ENGINE_SQL}, {_CONFIDENCE_SQL} SELECT document_id, question_id, round(CASE WHEN extraction_mode = 'vision_layout' THEN least(t, 0.6::DOUBLE) ELSE t END, 4) AS confidence FROM s2")
def engine_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.question_confidence(*_engine(spark, sf_dir)).select("document_id", "question_id", "confidence")


# -- review ---------------------------------------------------------------------------------------

_ACTIONS = [
    (1, "edit_stem_text", "stem.text", "old the", "2024-01-01"), (1, "edit_stem_text", "stem.text", "Now it ends.", "2024-01-02"), (2, "approve", "status", "approved", "2024-01-01"),
    (3, "change_type", "question_type", "numerical", "2024-01-01"), (4, "edit_option_text", "option.1.text", "new", "2024-01-01"), (5, "mark_block_status", "stem.status", "unreadable", "2024-01-01"), (6, "reject", "status", "rejected", "2024-01-03"),
]
_ACTION_SCHEMA = "document_id string, question_id string, action_type string, field_path string, new_value string, reason string, actor string, created_at string"


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [review.change("", "", kind, path, value, "checked", "reviewer", at) | {"k": k} for k, kind, path, value, at in _ACTIONS]
    kinds = spark.createDataFrame(kinds, f"{_ACTION_SCHEMA}, k int").drop("document_id", "question_id")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("cast(o_custkey AS string) AS document_id", "cast(o_orderkey AS string) AS question_id", "cast(o_orderkey % 10 AS int) AS k")
    return review.record(rows.join(F.broadcast(kinds), "k").drop("k"))  # seven kinds


_ACTIONS_SQL = "v(k, action_type, field_path, new_value, created_at) AS (VALUES " + ", ".join(f"({k}, '{a}', '{p}', '{v}', '{t}')" for k, a, p, v, t in _ACTIONS) + "), acts AS (SELECT o_custkey::VARCHAR AS document_id, o_orderkey::VARCHAR AS question_id, v.* FROM orders JOIN v ON k = o_orderkey % 10)"


@register("review_changes", f"""
    WITH {_Q_SQL} SELECT question_id, CASE o_orderkey % 10 WHEN 3 THEN 'numerical' ELSE question_type END AS question_type, CASE o_orderkey % 10 WHEN 2 THEN 'approved' WHEN 6 THEN 'rejected' ELSE 'draft' END AS status,
        CASE o_orderkey % 10 WHEN 1 THEN 'Now it ends.' ELSE stem END AS stem, CASE o_orderkey % 10 WHEN 5 THEN 'unreadable' ELSE 'extracted' END AS stem_status,
        coalesce((SELECT string_agg(CASE WHEN label = '1' AND l.o_orderkey % 10 = 4 THEN 'new' ELSE 'v' END, ',' ORDER BY label::INT) FROM l WHERE l.question_id = q.question_id), '') AS options FROM q""")
def review_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = review.apply_changes(order_questions(spark, sf_dir), _actions(spark, sf_dir))
    texts = F.array_join(F.transform("options", lambda o: o["blocks"][0]["text"]), ",")
    return now.select("question_id", "question_type", "status", F.col("stem_blocks")[0]["text"].alias("stem"), F.col("stem_blocks")[0]["status"].alias("stem_status"), texts.alias("options"))


@register("recheck", f"""
    WITH {_ENGINE_SQL}, changed AS (SELECT * REPLACE (CASE o_orderkey % 10 WHEN 1 THEN 'Now it ends.' ELSE stem END AS stem, CASE o_orderkey % 10 WHEN 3 THEN 'numerical' ELSE question_type END AS question_type) FROM n WHERE o_orderkey % 10 BETWEEN 1 AND 6),
    lines AS (SELECT * FROM l WHERE o_orderkey % 10 BETWEEN 1 AND 6),
    fresh AS ({_families_sql("changed", "lines")} UNION ALL SELECT * FROM ({_GEOM_SQL}) WHERE question_id::BIGINT % 10 BETWEEN 1 AND 6),
    kept AS (SELECT * FROM i WHERE question_id IS NULL OR NOT (question_id::BIGINT % 10 BETWEEN 1 AND 6) OR NOT (rule_code LIKE 'OPT%' OR rule_code LIKE 'STEM%' OR rule_code LIKE 'GEOM%'))
    SELECT document_id, question_id, rule_code, severity, field_path FROM kept UNION ALL SELECT document_id, question_id, rule_code, severity, field_path FROM fresh""")
def recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, issues = _engine(spark, sf_dir)
    actions = _actions(spark, sf_dir)
    return review.recheck(review.apply_changes(q, actions), issues, actions, _crops(spark, sf_dir))[0].select("document_id", "question_id", "rule_code", "severity", "field_path")


@register("audit_trail", f"""
    WITH {_ACTIONS_SQL} SELECT document_id, question_id, action_type, field_path, new_value, lag(new_value) OVER (PARTITION BY document_id, question_id, field_path ORDER BY created_at) AS previous_value, created_at FROM acts""")
def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review.with_previous(_actions(spark, sf_dir), ["document_id", "question_id", "field_path"], "new_value", ["created_at", "action_id"])
    return review.audit_trail(rows).select("document_id", "question_id", "action_type", "field_path", "new_value", "previous_value", "created_at")


@register("question_detail", f"""
    WITH {_ENGINE_SQL}, {_ACTIONS_SQL} SELECT 'question' AS kind, number AS what, status FROM (SELECT *, 'draft' AS status FROM q) WHERE question_id = '21'
    UNION ALL SELECT 'issue', rule_code, severity FROM i WHERE question_id = '21' UNION ALL SELECT 'action', action_type, created_at FROM acts WHERE question_id = '21'""")
def question_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, issues = _engine(spark, sf_dir)
    one, found, done = review.question_detail(q, issues, _actions(spark, sf_dir), "21")
    parts = [one.selectExpr("'question' AS kind", "number AS what", "status"), found.selectExpr("'issue' AS kind", "rule_code AS what", "severity AS status"), done.selectExpr("'action' AS kind", "action_type AS what", "created_at AS status")]
    return reduce(DataFrame.unionByName, parts)


@register("canonical_tables", """
    WITH o AS (SELECT l_orderkey, string_agg(l_linenumber || '=' || l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS options FROM lineitem GROUP BY 1)
    SELECT o_orderkey::VARCHAR AS question_id, o_orderpriority || ' ' || o_orderstatus AS stem, coalesce(options, '') AS options, CASE WHEN o_totalprice >= 20000 THEN o_orderstatus END AS answer FROM orders LEFT JOIN o ON l_orderkey = o_orderkey""")
def canonical_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested questions from the flat tables of questions, blocks, options and answers."""
    orders, lines = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rest = ["'text' AS content_type", "cast(null AS string) AS latex", "cast(null AS string) AS clean_crop_path", "1.0D AS confidence", "'extracted' AS status"]
    option_id = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"
    stems = orders.selectExpr("'question' AS owner_type", "cast(o_orderkey AS string) AS owner_id", "posexplode(array(o_orderpriority, o_orderstatus)) AS (sequence, text)").selectExpr("*", "concat(owner_id, '/', sequence) AS block_id", *rest)
    texts = lines.selectExpr("'option' AS owner_type", f"{option_id} AS owner_id", "0 AS sequence", "cast(l_partkey AS string) AS text", f"{option_id} AS block_id", *rest)
    options = lines.selectExpr("cast(l_orderkey AS string) AS question_id", f"{option_id} AS option_id", "lpad(l_linenumber, 3, '0') AS label", "1.0D AS confidence", "false AS review_required", "l_partkey", "l_suppkey")
    answers = orders.where("o_totalprice >= 20000").selectExpr("cast(o_orderkey AS string) AS question_id", "o_orderstatus AS raw_value")
    q = review.canonical(orders.selectExpr("cast(o_orderkey AS string) AS question_id"), stems.unionByName(texts), options, answers)
    shown = F.array_sort(F.transform("options", lambda o: F.struct(o["label"].cast("int").alias("n"), o["blocks"][0]["text"].cast("long").alias("t"))))
    shown = F.array_join(F.transform(shown, lambda o: F.concat(o["n"].cast("string"), F.lit("="), o["t"].cast("string"))), ",")
    return q.select("question_id", F.array_join(F.transform("stem_blocks", lambda b: b["text"]), " ").alias("stem"), F.coalesce(shown, F.lit("")).alias("options"), "answer")
