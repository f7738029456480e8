"""Vision attribution, decoders, images, sinks and the stream."""

import hashlib
import json
import os
import random

import numpy as np
import pytest

from paperloom.config import get_config
from paperloom.operators import rules, vision
from paperloom.sources import decoders, images, ingest, sinks
from paperloom.streaming import incremental


def region(rid, kind, box=(0.1, 0.1, 0.2, 0.2), number=None, label=None, visual=False, confidence=0.9):
    return (rid, kind, box, number, label, visual, confidence)


def layouts(spark, *pages):
    return spark.createDataFrame([("d", n, "x", [], order, regions) for n, order, regions in pages], incremental.LAYOUT)


def test_attribution(spark):
    regions = [region("lost", "diagram"), region("n1", "question_number", number="7"), region("s1", "question_stem", (0.1, 0.3, 0.9, 0.4)), region("h", "header", number="99"), region("o1", "option_label", (0.1, 0.5, 0.2, 0.6), "", "1"), region("o2", "option_content", (0.3, 0.5, 0.9, 0.6), None, "1"), region("s2", "options", (0.1, 0.7, 0.9, 0.8), "8"), region("bad", "table", (0.9, 0.9, 1.5, 0.2), "9")]
    rows = vision.attributed(vision.sanitise(layouts(spark, (1, ["lost", "n1", "s1", "h", "o1", "o2", "ghost", "s2", "bad"], regions))))
    got = {r["region_id"]: (r["role"], r["number"]) for r in rows.collect()}
    assert got["lost"][0] == "dropped" and got["n1"] == ("state", "7") and got["s1"] == ("stem", "7") and got["h"][0] == "skipped" and got["o2"] == ("option", "7") and got["ghost"][0] == "missing" and got["s2"] == ("stem", "8")
    q = {r["number"]: r for r in vision.assemble(rows).collect()}
    assert set(q) >= {"7", "8"} and len(q["7"]["stem_blocks"]) == 1 and [(o["label"], len(o["blocks"])) for o in q["7"]["options"]] == [("1", 2)]
    assert q["8"]["options"] == []
    warned = vision.dropped_warnings(rows).first()["warnings"]
    assert "ghost: missing" in warned and "lost: dropped" in warned


def test_sanitise_warns(spark):
    out = vision.sanitise(layouts(spark, (1, ["a"], [region("a", "options")]))).first()
    assert out["regions"][0]["region_type"] == "unknown" and len(out["warnings"]) == 1


def test_escalation(spark):
    first = layouts(spark, (1, ["a", "b"], [region("a", "question_stem", (0.1, 0.1, 0.9, 0.2), "1", confidence=0.4), region("b", "question_stem", (0.1, 0.5, 0.9, 0.6), "2")]))
    rows = vision.attributed(first)
    q = vision.assemble(rows)
    flagged = {r["number"]: r["reason"] for r in vision.select_for_escalation(q, vision.dropped_warnings(rows), rules.option_issues(q)).collect()}
    assert flagged == {"1": "low detection confidence", "2": "no options detected"}
    again = layouts(spark, (1, [], [region("x", "question_stem", (0.1, 0.1, 0.9, 0.2), "1", confidence=0.95), region("y", "option_content", (0.1, 0.3, 0.9, 0.4), "1", "A"), region("z", "question_stem", (0.1, 0.5, 0.9, 0.6), "Q.2")]))
    new = {r["number"]: r for r in vision.escalate(q, again).collect()}
    assert new["1"]["stem_blocks"][0]["confidence"] == 0.95 and [o["label"] for o in new["1"]["options"]] == ["A"]
    assert new["2"]["stem_blocks"][0]["confidence"] == 0.9 and new["2"]["options"] == []


def test_clamp_against_plain_python(spark):
    rnd = random.Random(3)
    boxes = []
    for p in range(4):
        for i in range(12):
            x, y = rnd.random() * 0.8, rnd.random() * 0.8
            boxes.append((p, i, x, y, x + 0.02 + rnd.random() * 0.3, y + 0.02 + rnd.random() * 0.2))

    def plain(own, others):
        x0, y0, x1, y1 = own[2] - 0.005, own[3] - 0.02, own[4] + 0.005, own[5] + 0.01
        for o in others:
            if o is own:
                continue
            if o[2] < own[4] and o[4] > own[2]:
                if (o[3] + o[5]) / 2 < (own[3] + own[5]) / 2:
                    y0 = max(y0, (o[5] + own[3]) / 2)
                elif (o[3] + o[5]) / 2 > (own[3] + own[5]) / 2:
                    y1 = min(y1, (own[5] + o[3]) / 2)
            if o[3] < own[5] and o[5] > own[3]:
                if (o[2] + o[4]) / 2 < (own[2] + own[4]) / 2:
                    x0 = max(x0, (o[4] + own[2]) / 2)
                elif (o[2] + o[4]) / 2 > (own[2] + own[4]) / 2:
                    x1 = min(x1, (own[4] + o[2]) / 2)
        x0, x1 = (own[2], own[4]) if x0 >= x1 else (x0, x1)
        y0, y1 = (own[3], own[5]) if y0 >= y1 else (y0, y1)
        return max(0.0, x0), max(0.0, y0), min(1.0, x1), min(1.0, y1)

    want = {b[:2]: plain(b, [o for o in boxes if o[0] == b[0]]) for b in boxes}
    df = spark.createDataFrame(boxes, "page int, i int, x0 double, y0 double, x1 double, y1 double")
    got = {(r["page"], r["i"]): (r["x0"], r["y0"], r["x1"], r["y1"]) for r in vision.clamped_boxes(df, ["page"], "i").collect()}
    assert got == want


def test_retrying():
    class Bad:
        def __init__(self):
            self.calls = 0

        def detect_layout(self, document_id, page):
            self.calls += 1
            raise RuntimeError("down")

    class Good:
        def detect_layout(self, document_id, page):
            return {"warnings": ["w"], "regions": []}

    bad, slept = Bad(), []
    out = decoders.Retrying(bad, Good(), sleep=slept.append).detect_layout("d", 1)
    assert bad.calls == 3 and slept == [2.0, 4.0] and len(out["warnings"]) == 2
    with pytest.raises(RuntimeError):
        decoders.Retrying(bad, sleep=slept.append).detect_layout("d", 1)


def test_detector_failure_is_a_row(spark):
    class Flaky:
        def detect_layout(self, document_id, page):
            if page == 2:
                raise RuntimeError("no page 2")
            return {"regions": [{"region_id": "r", "region_type": "diagram", "bbox": {"x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0}, "question_number_hint": None, "option_label_hint": None, "contains_visual": True, "confidence": 0.7}], "reading_order": ["r"]}

    decoders.register_detector("flaky", Flaky)
    pages = spark.createDataFrame([("d", n) for n in (1, 2, 3)], "document_id string, page_number int")
    got = {r["page_number"]: r for r in decoders.detect(pages, "flaky").collect()}
    assert len(got) == 3 and "no page 2" in got[2]["error"] and got[1]["error"] is None and got[1]["regions"][0]["region_id"] == "r"
    with pytest.raises(KeyError):
        decoders.detect(pages, "nothing")


def test_crops(spark, tmp_path):
    white = np.full((100, 100), 255, np.uint8)
    clipped, clean, small = white.copy(), white.copy(), white[:10].copy()
    clipped[:2], clipped[50, :30] = 0, 0
    clean[50:52, 20:80] = 0
    clean[60:64, 20:80] = 0
    small[:5] = 0
    for name, a in {"clipped": clipped, "clean": clean, "small": small, "blank": white, "rgb": np.stack([white, clean, clipped], 2)}.items():
        (tmp_path / f"{name}.png").write_bytes(images.png(a))
    got = {r["path"]: r for r in images.crop_statistics(images.read_images(spark, str(tmp_path)), str(tmp_path)).collect()}
    assert got["clipped.png"]["clipped"] and not got["clean.png"]["clipped"] and got["blank.png"]["stddev"] == 0 and got["small.png"]["height"] == 10
    luma = (299 * 255 + 587 * clean.astype(int) + 114 * clipped.astype(int)) / 1000
    assert abs(got["rgb.png"]["stddev"] - luma.std()) < 0.5
    assert images.cut(clean, (0.0, 0.5, 1.0, 0.525)).shape == (2, 100) and images.stack([white, white[:, :50]]).shape == (300, 100)
    from pyspark.sql import functions as F

    whole = images.read_images(spark, str(tmp_path))
    cropped = images.region_crops(whole, whole.select("origin", F.lit("c.png").alias("crop_path"), F.expr("struct(0.0D as x0, 0.0D as y0, 0.5D as x1, 0.5D as y1)").alias("box")))
    assert cropped.count() == 5 and bytes(cropped.first()["content"]).startswith(b"\x89PNG")


def test_ingest(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 one")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 one")
    (tmp_path / "c.pdf").write_bytes(b"not one")
    got = {os.path.basename(r["path"]): r["status"] for r in ingest.admit(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": "admitted", "b.pdf": "duplicate", "c.pdf": "invalid"}
    known = spark.createDataFrame([(hashlib.sha256(b"%PDF-1.4 one").hexdigest(),)], "sha256 string")
    assert ingest.admit(spark, str(tmp_path), known).where("status = 'admitted'").count() == 0
    assert ingest.admit(spark, str(tmp_path), known, allow_duplicate=True).where("status = 'admitted'").count() == 2
    listed = [(r["path"], r["sha256"]) for r in ingest.manifest(spark, str(tmp_path)).collect()]
    assert [p for p, _ in listed] == ["a.pdf", "b.pdf", "c.pdf"] and listed[2][1] == hashlib.sha256(b"not one").hexdigest()


def test_exports(spark, tmp_path):
    schema = "document_id string, question_number int, question_type string, stem_text string, stem_images array<string>, options array<struct<label:string,text:string,images:array<string>>>, answer string"
    q = spark.createDataFrame([("d", 2, "numerical", "How many?", [], [], "4"), ("d", 1, "mcq", "Which?", ["images/x.png"], [("1", "a", []), ("2", "b", [])], "2")], schema)
    md = sinks.markdown_documents(q).first()["markdown"]
    assert md.index("### Q1") < md.index("### Q2") and "**Answer:** (2)" in md and "**Answer:** 4" in md and "![](images/x.png)" in md
    assert [x["question_number"] for x in json.loads(sinks.json_documents(q).first()["json"])] == [1, 2]
    (tmp_path / "out").mkdir()
    (tmp_path / "out/a.txt").write_text("x")
    import zipfile

    assert zipfile.ZipFile(sinks.zip_folder(str(tmp_path / "out"), str(tmp_path / "o.zip"))).namelist() == ["a.txt"]
    sinks.append(q, str(tmp_path / "t"))
    sinks.append(q, str(tmp_path / "t"))
    assert sinks.lookup(spark.read.parquet(str(tmp_path / "t")), question_number=1).count() == 2


def test_stream(spark, small_plans, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for n in (1, 2, 3):
        row = {"document_id": "d", "page_number": n, "served_by": "x", "warnings": [], "reading_order": ["a"], "regions": [{"region_id": "a", "region_type": "question_stem", "bbox": {"x0": 0.1, "y0": 0.1, "x1": 0.5, "y1": 0.5}, "question_number_hint": str(n if n < 3 else 4), "contains_visual": False, "confidence": 0.9}]}
        (src / f"{n}.json").write_text(json.dumps(row))
    incremental.process_pages(incremental.layout_stream(spark, str(src)), out, str(tmp_path / "ck")).awaitTermination()
    questions, issues, seen = (spark.read.parquet(f"{out}/{t}") for t in ("questions", "issues", "pages"))
    assert questions.count() == 3 and questions.select("batch").distinct().count() == 3
    status = incremental.progress(seen, spark.createDataFrame([("d", 3), ("e", 2)], "document_id string, page_count int"))
    assert {r["document_id"]: (r["completed"], r["status"]) for r in status.collect()} == {"d": (3, "succeeded"), "e": (0, "running")}
    final = incremental.finalise(questions, issues.drop("batch"), status)
    assert final.where("rule_code = 'SEQ_GAP'").count() == 1
    counts = spark.createDataFrame([("d", 3), ("e", 2)], "document_id string, page_count int")
    again, stages, jobs = incremental.finish(spark, out, counts, "run", "2024-01-01")
    assert again.count() == final.count() and {r["document_id"]: r["status"] for r in jobs.collect()} == {"d": "succeeded", "e": "running"}
    assert {json.loads(r["metrics"])["completed"] for r in stages.collect()} == {3, 0}


def counting(log):
    """Made here, so that workers get it by value."""

    class Counting:
        """Writes a line for each call: a detector that is paid for."""

        def _say(self, what):
            with open(log, "a") as f:
                f.write(what + "\n")

        def detect_layout(self, document_id, page):
            self._say(f"first {page}")
            if page == 3:
                raise RuntimeError("no page 3")
            one = lambda rid, kind, y, number, label=None, confidence=0.9: {"region_id": rid, "region_type": kind, "bbox": {"x0": 0.1, "y0": y, "x1": 0.9, "y1": y + 0.1}, "question_number_hint": number, "option_label_hint": label, "contains_visual": False, "confidence": confidence}
            regions = [one("s", "question_stem", 0.1, str(page), confidence=0.3 if page == 2 else 0.9), *(one(f"o{k}", "option_content", 0.3 + k / 10, str(page), str(k)) for k in (1, 2, 3, 4))]
            return {"regions": regions, "reading_order": [r["region_id"] for r in regions]}

    return Counting


def test_vision_path_calls_the_detector_once_a_page(spark, tmp_path):
    from paperloom.plans import pipeline

    log = str(tmp_path / "calls")
    first_detector = counting(log)

    class Second(first_detector):
        def detect_again(self, document_id, page, reason, first):
            self._say(f"again {page}: {reason} ({len(first)} regions)")
            return {"regions": [dict(first[0], region_id="n", confidence=0.95)], "reading_order": []}

    decoders.register_detector("first", first_detector)
    decoders.register_detector("second", Second)
    pages = spark.createDataFrame([("d", n) for n in (1, 2, 3)], "document_id string, page_number int")
    tables = pipeline.layout.Layout(pages, None, None, None, None)
    out = pipeline.vision_path(tables, pipeline.Given(detector="first", second="second"))
    for _ in range(2):
        got = {r["number"]: (r["stem_blocks"][0]["confidence"], len(r["options"]), r["confidence"]) for r in out.questions.collect()}
    assert got == {"1": (0.9, 4, 0.5), "2": (0.95, 4, 0.5)}
    assert sorted(open(log).read().split("\n")[:-1]) == ["again 2: Q2: low detection confidence (5 regions)", "first 1", "first 2", "first 3"]
    m = out.metrics.first()
    assert (m["page_count"], m["question_count"], m["escalated_count"], m["skipped_count"]) == (3, 2, 1, 0) and out.errors.count() == 0
    assert {(r["number"], r["outcome"]) for r in out.escalated.collect()} == {("2", "escalated")}


def test_provider_factory():
    assert decoders.provider(get_config("U_")) == "mock"
    from paperloom.config import Config

    decoders.register_detector("paid", counting(""))
    name = decoders.provider(Config(vision_provider="paid", vision_fallback="mock", vision_retries=1))
    made = decoders._DETECTORS[name]()
    assert isinstance(made, decoders.Retrying) and isinstance(made.fallback, decoders.Mock) and made.retries == 1
    assert decoders._DETECTORS[decoders.provider(Config(vision_provider="paid"))]().fallback is None
    with pytest.raises(KeyError):
        decoders.provider(Config(vision_provider="nothing"))


def test_stitched_and_planned_crops(spark):
    a, b = np.full((10, 20), 10, np.uint8), np.full((6, 10), 200, np.uint8)
    rows = [("c", 1, 6, 10, 1, b.tobytes()), ("c", 0, 10, 20, 1, a.tobytes())]
    got = images.stitched(spark.createDataFrame(rows, "crop_path string, part int, height int, width int, nChannels int, data binary")).first()
    assert bytes(got["content"]) == images.png(images.stack([np.repeat(x[:, :, None], 3, 2) for x in (a, b)]))
    page = spark.createDataFrame([("d", 1, 100, 100, 1, np.arange(10_000, dtype=np.int64).astype(np.uint8).tobytes())], "document_id string, page_number int, height int, width int, nChannels int, data binary")
    rect = spark.sql("SELECT 'd' AS document_id, 1 AS page_number, 'p' AS crop_path, named_struct('x0', 8.0D, 'y0', 8.0D, 'x1', 18.0D, 'y1', 18.0D) AS box")
    want = np.arange(10_000).astype(np.uint8).reshape(100, 100)[5:21, 5:21]
    assert bytes(images.page_crops(page, rect, 72).first()["content"]) == images.png(want)
    stat = images.region_statistics(page, spark.sql("SELECT 'd' AS document_id, 1 AS page_number, 'p' AS path, named_struct('x0', 0.0D, 'y0', 0.0D, 'x1', 0.5D, 'y1', 0.25D) AS box")).first()
    assert (stat["width"], stat["height"]) == (50, 25)


def pdf(pages, flate=True):
    """A small file: each page is (content, number of images)."""
    import zlib

    out, kids = [], []
    for i, content in enumerate(pages):
        raw = zlib.compress(content.encode("latin-1")) if flate else content.encode("latin-1")
        kids.append(f"{10 + 2 * i} 0 R")
        out.append(f"{10 + 2 * i} 0 obj << /Type /Page /Parent 2 0 R /Contents {11 + 2 * i} 0 R >> endobj\n".encode())
        out.append(f"{11 + 2 * i} 0 obj << /Length {len(raw)} {'/Filter /FlateDecode' if flate else ''} >>\nstream\n".encode() + raw + b"\nendstream endobj\n")
    head = f"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [{' '.join(kids)}] /Count {len(pages)} /MediaBox [0 0 595 842] /Resources 3 0 R >> endobj\n3 0 obj << /Font << /F1 4 0 R >> /XObject << /I1 5 0 R >> >> endobj\n4 0 obj << /Type /Font /FirstChar 32 /Widths [{' '.join(['250'] + ['600'] * 94)}] >> endobj\n5 0 obj << /Subtype /Image >> endobj\n"
    return head.encode() + b"".join(out) + b"trailer << /Root 1 0 R >>"


@pytest.mark.parametrize("flate", [True, False])
def test_pdf_decoder(flate):
    from paperloom.sources.pdf import PdfDecoder

    page = "BT /F1 10 Tf 30 742 Td (Q1.) Tj 40 0 Td [(Which \\(one\\)) -500 (is it?)] TJ ET q 100 0 0 50 200 300 cm /I1 Do Q 0 0 m 10 10 l S 5 5 20 20 re f"
    rows = list(PdfDecoder().decode("d", pdf([page, "BT /F1 10 Tf 30 700 Td (ANSWER KEY 1. \\(2\\)) Tj ET"], flate)))
    by = lambda kind, n=1: [r for k, r in rows if k == kind and r["page_number"] == n]
    assert [(p["text"], p["drawing_count"], p["height_pt"]) for p in by("pages") + by("pages", 2)] == [("Q1.Which (one)is it?", 2, 842.0), ("ANSWER KEY 1. (2)", 0, 842.0)]
    assert [s["text"] for s in by("spans")] == ["Q1.", "Which (one)is it?"] and [w["word"] for w in by("words")] == ["Q1.", "Which", "(one)", "is", "it?"]
    mark = by("spans")[0]
    assert (mark["x0"], mark["x1"]) == (30, 48) and abs(mark["y0"] - 92) < 1e-9 and abs(mark["y1"] - 102) < 1e-9 and len(by("chars")) == 20
    assert [(i["x0"], i["y0"], i["x1"], i["y1"]) for i in by("images")] == [(200, 492, 300, 542)]


def test_files_to_outcome(spark, tmp_path):
    """Files of all fates: a paper, its copy, an unknown paper, no PDF, a broken one."""
    from paperloom.operators import templates
    from paperloom.plans import pipeline
    from pyspark.sql import functions as F

    long = "x" * 220
    option = lambda k, x: f"{x} 600 Td (\\({k}\\) v{k}) Tj {-x} -600 Td "
    paper = f"BT /F1 10 Tf 30 742 Td (Q1.) Tj 0 -20 Td (How many?) Tj 0 -702 Td (Question Paper MathonGo {long}) Tj 30 -20 Td ET BT /F1 10 Tf 0 0 Td {''.join(option(k, 60 + 120 * k) for k in range(1, 5))}ET"
    (tmp_path / "a.pdf").write_bytes(pdf([paper, "BT /F1 10 Tf 30 700 Td (ANSWER KEY 1. \\(2\\)) Tj ET"]))
    (tmp_path / "b.pdf").write_bytes((tmp_path / "a.pdf").read_bytes())
    (tmp_path / "c.pdf").write_bytes(pdf([f"BT /F1 10 Tf 30 700 Td ({long}) Tj ET"]))
    (tmp_path / "d.pdf").write_bytes(b"no PDF")
    (tmp_path / "e.pdf").write_bytes(b"%PDF-1.4 broken")
    versions = templates.default_templates(spark).withColumn("min_question_marker_hits", F.lit(1))
    done = pipeline.process_files(spark, str(tmp_path), "pdf", versions)
    status = {r["document_id"]: r for r in done.status.collect()}
    assert sorted(r["status"] for r in status.values()) == ["duplicate", "failed", "invalid", "succeeded", "unmatched"]
    assert next(r["error"] for r in status.values() if r["status"] == "failed") == "the file has no catalog"
    q = done.questions.collect()
    assert [(r["number"], r["question_type"], r["answer"]) for r in q] == [("1", "single_correct", "2")]
    assert done.jobs.count() == 5 and {r["stage"] for r in done.stages.collect()} == {"ingest", "match_template", "extract", "validate_questions"}
    after = {r["template_id"]: (r["run_count"], r["status"]) for r in done.versions.collect()}
    assert after == {"text_exam": (9, "validated"), "vision_exam": (0, "draft")}


def test_config(monkeypatch):
    monkeypatch.setenv("T_RENDER_DPI", "72")
    assert get_config("T_").render_dpi == 72 and get_config("U_").vision_concurrency == 5
