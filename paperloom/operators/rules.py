"""The rule engine: each rule is a DataFrame of questions in, a DataFrame of issues out.

Rules on numbers and options take column names, so they also hold on other tables of that shape.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import derived_id, is_float, last_word, whole_number

SEVERITIES = {"info": 0, "warning": 1, "error": 2, "blocking": 3}
# Fixed values of the stem rules.
STOPWORDS = ["the", "a", "an", "of", "in", "on", "at", "by", "for", "with", "and", "or", "to", "is", "are", "was"]
VISUAL_PHRASES = ["shown below", "shown in the figure", "shown in figure", "as shown"]
TERMINALS = [".", "?", "!", ")"]
OPTIONS = 4

ISSUE_COLUMNS = ["issue_id", "document_id", "question_id", "field_path", "rule_code", "severity", "message", "evidence_path"]


def issue_rows(df: DataFrame, code: str, severity: str, message: Column, document: Column | None = None, question: Column | None = None, field: Column | None = None, evidence: Column | None = None) -> DataFrame:
    """Rows of ``df`` as issues; the id is derived from what names the issue."""
    null = F.lit(None).cast("string")
    doc, q = document if document is not None else F.col("document_id"), question if question is not None else null
    f, e = field if field is not None else null, evidence if evidence is not None else null
    return df.select(
        derived_id(doc, q, F.lit(code), f, e, message).alias("issue_id"),
        doc.cast("string").alias("document_id"), q.cast("string").alias("question_id"), f.alias("field_path"),
        F.lit(code).alias("rule_code"), F.lit(severity).alias("severity"), message.alias("message"), e.alias("evidence_path"),
    )


def severity_rank(severity: Column) -> Column:
    return reduce(lambda c, kv: c.when(severity == kv[0], kv[1]), SEVERITIES.items(), F).otherwise(-1)


def stem_text(blocks: Column) -> Column:
    texts = F.transform(F.filter(blocks, lambda b: F.coalesce(b["text"], F.lit("")) != ""), lambda b: b["text"])
    return F.trim(F.array_join(texts, " "))


# -- sequence -----------------------------------------------------------------------------------


def duplicate_numbers(df: DataFrame, document: str, number: str) -> DataFrame:
    """Rows whose number occurs more than once in their document."""
    n = F.count("*").over(Window.partitionBy(document, number))
    return df.withColumn("occurrences", n).where("occurrences > 1")


def number_gaps(df: DataFrame, document: str, number: str) -> DataFrame:
    """(document, missing): whole numbers between a document's smallest and largest that it lacks."""
    span = df.groupBy(document).agg(F.min(number).alias("lo"), F.max(number).alias("hi")).where("lo is not null")
    wanted = span.select(document, F.explode(F.sequence("lo", "hi")).alias("missing"))
    have = df.select(document, F.col(number).alias("missing")).distinct()
    return wanted.join(have, [document, "missing"], "left_anti")


def sequence_issues(questions: DataFrame) -> DataFrame:
    twice = issue_rows(duplicate_numbers(questions, "document_id", "number"), "SEQ_DUPLICATE_NUMBER", "blocking", F.concat(F.lit("Question number "), "number", F.lit(" occurs more than once.")), question=F.col("question_id"), field=F.lit("number"))
    numbers = questions.select("document_id", whole_number(F.col("number")).alias("n")).where("n is not null")
    gaps = issue_rows(number_gaps(numbers, "document_id", "n"), "SEQ_GAP", "warning", F.concat(F.lit("Question number "), F.col("missing").cast("string"), F.lit(" is missing.")), field=F.lit("number"))
    return twice.unionByName(gaps)


# -- answers ------------------------------------------------------------------------------------


def answers_missing(df: DataFrame, answer: str) -> DataFrame:
    return df.where(F.col(answer).isNull())


def answer_issues(questions: DataFrame) -> DataFrame:
    """Missing answers, numerical ones that aren't numbers, and ones that name no option."""
    q = questions.where(F.col("extraction_mode") != "vision_layout")
    numerical = F.col("question_type") == "numerical"
    labels = F.transform("options", lambda o: o["label"])
    own = {"question": F.col("question_id"), "field": F.lit("answer")}
    about = F.concat(F.lit("Question "), "number")
    parts = [
        issue_rows(answers_missing(q, "answer"), "ANSWER_MISSING", "blocking", F.concat(about, F.lit(" has no answer.")), **own),
        issue_rows(q.where(F.col("answer").isNotNull() & numerical & ~is_float(F.col("answer"))), "ANSWER_UNSUPPORTED_FORMAT", "warning", F.concat(about, F.lit("'s answer is not a number.")), **own),
        issue_rows(q.where(F.col("answer").isNotNull() & ~numerical & ~F.array_contains(labels, F.col("answer"))), "ANSWER_POINTS_TO_MISSING_OPTION", "error", F.concat(about, F.lit("'s answer names no option.")), **own),
    ]
    return reduce(DataFrame.unionByName, parts)


# -- options ------------------------------------------------------------------------------------


def duplicate_labels(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, label, n) for labels that occur more than once."""
    return df.groupBy(*keys, label).agg(F.count("*").alias("n")).where("n > 1")


def partial_markers(question_type: Column, n: Column) -> Column:
    return ~question_type.isin("numerical", "unknown") & n.between(1, OPTIONS - 1)


def unexpected_count(question_type: Column, n: Column) -> Column:
    return F.when(question_type == "numerical", n != 0).when(question_type == "unknown", F.lit(False)).otherwise(n != OPTIONS)


def option_issues(questions: DataFrame) -> DataFrame:
    n, kind = F.size("options"), F.col("question_type")
    own = {"question": F.col("question_id"), "field": F.lit("options")}
    about = F.concat(F.lit("Question "), "number")
    options = questions.select("document_id", "question_id", "number", F.explode("options").alias("o"))
    twice = duplicate_labels(options.select("document_id", "question_id", "number", F.col("o.label").alias("label")), ["document_id", "question_id", "number"], "label")
    blocks = options.select("document_id", "question_id", "number", F.col("o.label").alias("label"), F.posexplode("o.blocks").alias("at", "b"))
    bare = blocks.where((F.col("b.content_type") == "image") & F.col("b.clean_crop_path").isNull())
    parts = [
        issue_rows(twice, "OPT_DUPLICATE_LABEL", "error", F.concat(about, F.lit(" has option label "), "label", F.lit(" more than once.")), **own),
        issue_rows(questions.where(unexpected_count(kind, n)), "OPT_COUNT_UNEXPECTED", "warning", F.concat(about, F.lit(" has "), n.cast("string"), F.lit(" options.")), **own),
        issue_rows(questions.where(partial_markers(kind, n)), "OPT_PARTIAL_MARKER_SET", "error", F.concat(about, F.lit(" has some option markers only.")), **own),
        issue_rows(bare, "OPT_IMAGE_OPTION_NO_ASSET", "error", F.concat(about, F.lit("'s option "), "label", F.lit(" has an image block without a crop: "), F.col("at").cast("string")), **own),
    ]
    return reduce(DataFrame.unionByName, parts)


# -- stems --------------------------------------------------------------------------------------


def ends_on_stopword(text: Column) -> Column:
    return last_word(text).isin(STOPWORDS)


def lacks_terminal(text: Column) -> Column:
    t = F.regexp_replace(text, r"(?U)\s+$", "")
    return (F.length(t) == 0) | ~F.substring(t, -1, 1).isin(TERMINALS)


def mentions_visual(text: Column) -> Column:
    return F.lower(text).rlike("|".join(VISUAL_PHRASES))


def stem_issues(questions: DataFrame) -> DataFrame:
    q = questions.withColumn("__t", F.coalesce(stem_text(F.col("stem_blocks")), F.lit("")))
    own = {"question": F.col("question_id"), "field": F.lit("stem_blocks")}
    about = F.concat(F.lit("Question "), "number", F.lit("'s stem "))
    pictured = F.exists("stem_blocks", lambda b: b["content_type"] == "image")
    parts = [
        issue_rows(q.where((F.col("__t") != "") & ends_on_stopword(F.col("__t"))), "STEM_TRAILING_STOPWORD", "warning", F.concat(about, F.lit("ends on a stopword.")), **own),
        issue_rows(q.where(lacks_terminal(F.col("__t"))), "STEM_NO_TERMINAL_PUNCTUATION", "warning", F.concat(about, F.lit("lacks terminal punctuation.")), **own),
        issue_rows(q.where(mentions_visual(F.col("__t")) & ~pictured), "STEM_REFERENCES_VISUAL_WITHOUT_IMAGE", "warning", F.concat(about, F.lit("refers to a visual and has none.")), **own),
    ]
    return reduce(DataFrame.unionByName, parts)


# -- images and crops ---------------------------------------------------------------------------


def image_conservation_issues(metrics: DataFrame) -> DataFrame:
    bad = metrics.where(F.col("embedded_image_count") != F.col("assigned_image_count"))
    return issue_rows(bad, "IMG_CONSERVATION_MISMATCH", "error", F.concat(F.col("embedded_image_count").cast("string"), F.lit(" embedded images, "), F.col("assigned_image_count").cast("string"), F.lit(" assigned.")))


def crop_issues(questions: DataFrame, crops: DataFrame) -> DataFrame:
    """crops: path, width, height, stddev, clipped (of ``sources.images.crop_statistics``)."""
    stems = questions.select("document_id", "question_id", F.lit("stem_blocks").alias("field"), F.explode("stem_blocks").alias("b"))
    options = questions.select("document_id", "question_id", F.explode("options").alias("o")).select("document_id", "question_id", F.lit("options").alias("field"), F.explode("o.blocks").alias("b"))
    used = stems.unionByName(options).select("document_id", "question_id", "field", F.col("b.clean_crop_path").alias("path")).where("path is not null")
    seen = used.join(crops.withColumn("__there", F.lit(True)), "path", "left")
    own = {"question": F.col("question_id"), "field": F.col("field"), "evidence": F.col("path")}
    parts = [
        issue_rows(seen.where("__there is null"), "GEOM_CROP_FILE_MISSING", "error", F.concat(F.lit("No crop file "), "path"), **own),
        issue_rows(seen.where("width < 20 or height < 20"), "GEOM_CROP_TOO_SMALL", "warning", F.concat(F.lit("Too small: "), "path"), **own),
        issue_rows(seen.where("stddev < 3.0"), "GEOM_CROP_BLANK", "warning", F.concat(F.lit("Looks blank: "), "path"), **own),
        issue_rows(seen.where("clipped"), "GEOM_CROP_EDGE_CLIPPED", "warning", F.concat(F.lit("Ink at the edge of "), "path"), **own),
    ]
    return reduce(DataFrame.unionByName, parts)


# -- all together -------------------------------------------------------------------------------


def run_rules(questions: DataFrame, metrics: DataFrame | None = None, crops: DataFrame | None = None) -> DataFrame:
    """All rules; image conservation with metrics, crop rules with crops."""
    parts = [image_conservation_issues(metrics)] if metrics is not None else []
    parts += [answer_issues(questions), sequence_issues(questions), option_issues(questions), stem_issues(questions)]
    parts += [crop_issues(questions, crops)] if crops is not None else []
    return reduce(DataFrame.unionByName, parts)


def issues_by_question(issues: DataFrame) -> DataFrame:
    return issues.where("question_id is not null").groupBy("document_id", "question_id").agg(F.collect_list(F.struct("issue_id", "rule_code", "severity", "message")).alias("issues"))


def summarise(issues: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by severity."""
    return issues.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], F.count("*").alias("total"))
