"""Rules, scoring, review and lifecycle on hand-made questions."""

import json

import pytest
from pyspark.sql import functions as F

from paperloom.functions.text import is_float
from paperloom.operators import review, rules, scoring, templates

BLOCK = "struct<block_id:string,content_type:string,text:string,clean_crop_path:string,confidence:double,status:string>"
SCHEMA = f"question_id string, document_id string, number string, question_type string, answer string, extraction_mode string, confidence double, status string, stem_blocks array<{BLOCK}>, options array<struct<label:string,blocks:array<{BLOCK}>>>"


def block(text="Is this it?", kind="mixed", crop="a.png"):
    return ("b", kind, text, crop, 1.0, "extracted")


def question(qid="q1", number="1", kind="single_correct", answer="2", mode="deterministic_text", stem=None, options=None, status="draft"):
    options = [(x, [block(x)]) for x in "1234"] if options is None else options
    return (qid, "d", number, kind, answer, mode, 1.0, status, [block()] if stem is None else stem, options)


def codes(spark, *questions):
    issues = rules.run_rules(spark.createDataFrame(list(questions), SCHEMA))
    return sorted(((r["question_id"], r["rule_code"], r["severity"]) for r in issues.collect()), key=lambda x: (x[0] or "", *x[1:]))


CASES = {
    "clean": (question(), []),
    "answer missing": (question(answer=None), ["ANSWER_MISSING"]),
    "vision has no answer": (question(answer=None, mode="vision_layout", kind="unknown", options=[]), []),
    "numerical text": (question(kind="numerical", answer="x", options=[]), ["ANSWER_UNSUPPORTED_FORMAT"]),
    "numerical number": (question(kind="numerical", answer="-2.7", options=[]), []),
    "answer names no option": (question(answer="7"), ["ANSWER_POINTS_TO_MISSING_OPTION"]),
    "label twice": (question(options=[(x, [block(x)]) for x in "1223"]), ["OPT_DUPLICATE_LABEL"]),
    "three options": (question(options=[(x, [block(x)]) for x in "123"]), ["OPT_COUNT_UNEXPECTED", "OPT_PARTIAL_MARKER_SET"]),
    "numerical with options": (question(kind="numerical", answer="1"), ["OPT_COUNT_UNEXPECTED"]),
    "image without crop": (question(options=[("1", [block("", "image", None)])] + [(x, [block(x)]) for x in "234"]), ["OPT_IMAGE_OPTION_NO_ASSET"]),
    "stopword": (question(stem=[block("ends with the")]), ["STEM_NO_TERMINAL_PUNCTUATION", "STEM_TRAILING_STOPWORD"]),
    "no stopword in another alphabet": (question(stem=[block("ends with äthe.")]), []),
    "visual": (question(stem=[block("as shown below.")]), ["STEM_REFERENCES_VISUAL_WITHOUT_IMAGE"]),
    "visual with image": (question(stem=[block("as shown below."), block(None, "image")]), []),
    "empty stem": (question(stem=[]), ["STEM_NO_TERMINAL_PUNCTUATION"]),
}


@pytest.mark.parametrize("name", CASES)
def test_rule(spark, name):
    q, want = CASES[name]
    assert [c for _, c, _ in codes(spark, q)] == want


def test_sequence(spark):
    got = codes(spark, question("a", "1"), question("b", "1"), question("c", "4"), question("d", "²"))
    assert [x for x in got if x[1].startswith("SEQ")] == [(None, "SEQ_GAP", "warning")] * 2 + [("a", "SEQ_DUPLICATE_NUMBER", "blocking"), ("b", "SEQ_DUPLICATE_NUMBER", "blocking")]


def test_confidence_and_tier(spark):
    q = spark.createDataFrame([question("a"), question("b", "2", answer=None), question("c", "3", mode="vision_layout", kind="unknown", answer=None, options=[])], SCHEMA)
    issues = rules.run_rules(q)
    got = {r["question_id"]: r["confidence"] for r in scoring.question_confidence(q, issues).collect()}
    assert got == {"a": 1.0, "b": 0.0, "c": 0.5}
    assert scoring.trust_tiers(q, issues).first()["trust_tier"] == "NONE"
    none = issues.where("false")
    assert scoring.trust_tiers(q, none).first()["trust_tier"] == "MEDIUM"
    assert scoring.trust_tiers(q.where("question_id = 'a'"), none).first()["trust_tier"] == "HIGH"


def test_review_and_recheck(spark):
    q = spark.createDataFrame([question("a", "10"), question("b", "9", stem=[block("ends with the")]), question("c", "Q.4", answer=None), question("d", "1", status="approved")], SCHEMA)
    issues = rules.run_rules(q).where("rule_code not like 'SEQ%'")
    scored = scoring.question_confidence(q, issues)
    queue = review.review_queue(scored, issues).orderBy("queue_rank").collect()
    assert [r["question_id"] for r in queue] == ["c", "b", "a"]
    actions = review.record(spark.createDataFrame([review.change("d", "b", "edit_stem_text", "stem.text", "Now it ends.", None, "me", "2024-01-02"), review.change("d", "b", "edit_stem_text", "stem.text", "old", None, "me", "2024-01-01"), review.change("d", "a", "approve", "status", "approved", None, "me", "2024-01-01")], "document_id string, question_id string, action_type string, field_path string, new_value string, reason string, actor string, created_at string"))
    now = review.apply_changes(q, actions)
    assert {r["question_id"]: (r["stem_blocks"][0]["text"], r["status"]) for r in now.collect()}["b"] == ("Now it ends.", "draft")
    everything, again = review.recheck(now, issues, actions)
    left = sorted((r["question_id"], r["rule_code"]) for r in everything.collect())
    assert left == [("c", "ANSWER_MISSING")]
    assert {r["question_id"]: r["confidence"] for r in again.collect()} == {"a": 1.0, "b": 1.0}
    old = {(r["question_id"], r["created_at"]): r["previous_value"] for r in review.with_previous(actions, ["document_id", "question_id", "field_path"], "new_value", ["created_at"]).collect()}
    assert old[("b", "2024-01-02")] == "old"
    with pytest.raises(ValueError):
        review.change("d", "a", "nothing", "x", None, None, "me", "t")


def test_replace_by_key(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("a", 5), ("a", 6)], "k string, v int")
    assert sorted(map(tuple, review.replace_by_key(old, new, ["k"]).collect())) == [("a", 5), ("a", 6), ("b", 2)]


@pytest.mark.parametrize(("start", "scores", "baselines", "last"), [
    ((1.0, 8), [1.0], [1.0], "validated"), ((1.0, 8), [0.9], [(8 + 0.9) / 9], "validated"), ((1.0, 8), [0.5, 1.0], [8.5 / 9, 9.5 / 10], "monitored"),
    ((None, 0), [0.8, 0.2], [0.8, 0.5], "validated"), ((1.0, 1), [0.0], [0.5], "validated"),
])
def test_lifecycle(spark, start, scores, baselines, last):
    runs = spark.createDataFrame([("t", 1, i, s) for i, s in enumerate(scores)], "template_id string, version int, at int, score double")
    versions = spark.createDataFrame([("t", 1, start[0], start[1], "validated")], "template_id string, version int, baseline_score double, run_count int, status string")
    got = templates.lifecycle(runs, versions, ["at"]).orderBy("at").collect()
    assert [round(r["baseline"], 9) for r in got] == [round(b, 9) for b in baselines] and got[-1]["status"] == last and got[-1]["run_count"] == start[1] + len(scores)


def test_defaults_register_once(spark):
    once = templates.register_defaults(templates.default_templates(spark).where("false"))
    assert templates.register_defaults(once).count() == 2 and templates.candidates(once).count() == 2


def test_float_pattern(spark):
    values = ["1", "-2.7", "1_000", "1f", "0x1p3", "nan", "Inf", ".5", "5.", "1e5", "", "_1", "1__0", "+.e1"]

    def plain(x):
        try:
            float(x)
            return True
        except ValueError:
            return False

    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert {r["v"]: r["f"] for r in df.select("v", is_float(F.col("v")).alias("f")).collect()} == {v: plain(v) for v in values}


def test_summary(spark):
    issues = rules.run_rules(spark.createDataFrame([question("a", answer=None), question("b", "2", answer="7")], SCHEMA))
    s = rules.summarise(issues, ["document_id"]).first()
    assert (s["blocking"], s["error"], s["total"]) == (1, 1, 2) and rules.issues_by_question(issues).count() == 2
    assert json.dumps(rules.STOPWORDS).count(",") == 15
