"""Questions from detected page regions: sanitising, attribution, boxes, assembly, escalation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import rect, valid_box
from ..functions.text import derived_id

# Region types, those skipped and those of a stem, box padding, thresholds.
REGION_TYPES = ["header", "footer", "subject_heading", "section_heading", "instructions", "shared_passage", "question_number", "question_stem", "option_label", "option_content", "diagram", "equation", "table", "answer_key", "page_number", "unknown"]
SKIPPED = ["header", "footer", "subject_heading", "section_heading", "instructions", "answer_key", "page_number"]
STEM = ["question_stem", "diagram", "equation", "table", "shared_passage", "unknown"]
OPTION = ["option_label", "option_content"]
PAD_TOP, PAD_BOTTOM, PAD_SIDES = 0.02, 0.01, 0.005
ESCALATE_BELOW = 0.6

REGION = "struct<region_id:string,region_type:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,question_number_hint:string,option_label_hint:string,contains_visual:boolean,confidence:double>"


def mock_layout(pages: DataFrame) -> DataFrame:
    """A stand-in for a detector: a number region and an unknown one on each page."""

    def region(name: str, kind: str, box: tuple, hint: Column, visual: bool) -> Column:
        return F.struct(
            F.concat(F.lit(f"{name}-p"), F.col("page_number").cast("string")).alias("region_id"), F.lit(kind).alias("region_type"), rect(*map(F.lit, box)).alias("bbox"),
            hint.alias("question_number_hint"), F.lit(None).cast("string").alias("option_label_hint"), F.lit(visual).alias("contains_visual"), F.lit(0.5).alias("confidence"),
        )

    number, rest = region("number", "question_number", (0.02, 0.02, 0.15, 0.06), F.col("page_number").cast("string"), False), region("body", "unknown", (0.05, 0.08, 0.95, 0.95), F.lit(None).cast("string"), True)
    return pages.select("document_id", "page_number").withColumns({
        "served_by": F.lit("mock"), "warnings": F.array(F.lit("mock layout: nothing was detected")), "regions": F.array(number, rest),
        "reading_order": F.array(number["region_id"], rest["region_id"]),
    })


def sanitise(layouts: DataFrame) -> DataFrame:
    """Unknown region types become ``unknown``, each with a warning."""
    known = F.array(*map(F.lit, REGION_TYPES))
    odd = F.filter("regions", lambda r: ~F.array_contains(known, r["region_type"]))
    said = F.transform(odd, lambda r: F.concat(F.lit("unknown region type "), r["region_type"], F.lit(" in "), r["region_id"]))
    fixed = F.transform("regions", lambda r: r.withField("region_type", F.when(F.array_contains(known, r["region_type"]), r["region_type"]).otherwise("unknown")))
    return layouts.withColumn("warnings", F.concat("warnings", said)).withColumn("regions", fixed)


def ordered_regions(layouts: DataFrame) -> DataFrame:
    """Regions in reading order; an id without a region has a null region. The first of equal ids counts."""
    keys = ["document_id", "page_number"]
    order = layouts.select(*keys, F.posexplode("reading_order").alias("pos", "region_id"))
    regions = layouts.select(*keys, F.posexplode("regions").alias("at", "region")).withColumn("region_id", F.col("region.region_id"))
    firsts = regions.groupBy(*keys, "region_id").agg(F.min_by("region", "at").alias("region"))
    return order.join(firsts, [*keys, "region_id"], "left")


def carry_forward(rows: DataFrame, page: list[str], pos: str, kind: str, hint: str, skipped: list[str], out: str = "number") -> DataFrame:
    """The own hint, else the last one seen on the page. An empty hint is none; skipped kinds neither give nor get one."""
    own = F.when(~F.col(kind).isin(skipped) & (F.col(hint) != ""), F.col(hint))
    w = Window.partitionBy(*page).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(out, F.when(~F.col(kind).isin(skipped), F.last(own, ignorenulls=True).over(w)))


def clamped_boxes(boxes: DataFrame, page: list[str], box_id: str, pads: tuple[float, float, float] = (PAD_TOP, PAD_BOTTOM, PAD_SIDES)) -> DataFrame:
    """Padded boxes (x0, y0, x1, y1), each edge no further than halfway to the neighbour it faces.

    A box's own row has an equal centre and so no effect. Pages are the equi-key of the self-join.
    """
    top, bottom, sides = (F.lit(p) for p in pads)
    other = boxes.select(*page, *[F.col(c).alias(f"o_{c}") for c in ("x0", "y0", "x1", "y1")])
    both = boxes.join(other, page)
    across = (F.col("o_x0") < F.col("x1")) & (F.col("o_x1") > F.col("x0"))
    along = (F.col("o_y0") < F.col("y1")) & (F.col("o_y1") > F.col("y0"))
    own_y, other_y = (F.col("y0") + F.col("y1")) / 2, (F.col("o_y0") + F.col("o_y1")) / 2
    own_x, other_x = (F.col("x0") + F.col("x1")) / 2, (F.col("o_x0") + F.col("o_x1")) / 2
    near = both.groupBy(*page, box_id, "x0", "y0", "x1", "y1").agg(
        F.max(F.when(across & (other_y < own_y), (F.col("o_y1") + F.col("y0")) / 2)).alias("above"),
        F.min(F.when(across & (other_y > own_y), (F.col("y1") + F.col("o_y0")) / 2)).alias("below"),
        F.max(F.when(along & (other_x < own_x), (F.col("o_x1") + F.col("x0")) / 2)).alias("left"),
        F.min(F.when(along & (other_x > own_x), (F.col("x1") + F.col("o_x0")) / 2)).alias("right"),
    )
    near = near.select(
        *page, box_id, *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")],
        F.greatest(F.col("x0") - sides, F.col("left")).alias("a0"), F.greatest(F.col("y0") - top, F.col("above")).alias("b0"),
        F.least(F.col("x1") + sides, F.col("right")).alias("a1"), F.least(F.col("y1") + bottom, F.col("below")).alias("b1"),
    )
    flat_x, flat_y = F.col("a0") >= F.col("a1"), F.col("b0") >= F.col("b1")
    return near.select(
        *page, box_id,
        F.greatest(F.lit(0.0), F.when(flat_x, F.col("r_x0")).otherwise(F.col("a0"))).alias("x0"), F.greatest(F.lit(0.0), F.when(flat_y, F.col("r_y0")).otherwise(F.col("b0"))).alias("y0"),
        F.least(F.lit(1.0), F.when(flat_x, F.col("r_x1")).otherwise(F.col("a1"))).alias("x1"), F.least(F.lit(1.0), F.when(flat_y, F.col("r_y1")).otherwise(F.col("b1"))).alias("y1"),
    )


def _page_boxes(layouts: DataFrame) -> DataFrame:
    rows = layouts.select("document_id", "page_number", F.posexplode("regions").alias("at", "r"))
    boxes = rows.select("document_id", "page_number", F.concat(F.col("r.region_id"), F.lit("#"), F.col("at").cast("string")).alias("box_id"), "r.bbox.*", F.col("r.region_id").alias("region_id"), "at")
    clamped = clamped_boxes(boxes.select("document_id", "page_number", "box_id", "x0", "y0", "x1", "y1"), ["document_id", "page_number"], "box_id")
    first = boxes.groupBy("document_id", "page_number", "region_id").agg(F.min_by("box_id", "at").alias("box_id"))
    return first.join(clamped, ["document_id", "page_number", "box_id"]).select("document_id", "page_number", "region_id", rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("box"))


def attributed(layouts: DataFrame) -> DataFrame:
    """Regions in reading order with question number, padded box, and what becomes of them.

    role: stem, option, state (a number region that only sets the number), skipped, missing (no
    region of that id), dropped (nothing seen yet), invalid (box out of bounds).
    """
    rows = ordered_regions(layouts).select("document_id", "page_number", "pos", "region_id", "region.region_type", "region.question_number_hint", "region.option_label_hint", "region.contains_visual", "region.confidence")
    rows = carry_forward(rows, ["document_id", "page_number"], "pos", "region_type", "question_number_hint", SKIPPED)
    rows = rows.join(_page_boxes(layouts), ["document_id", "page_number", "region_id"], "left")
    kind, hinted = F.col("region_type"), F.coalesce(F.col("question_number_hint"), F.lit("")) != ""
    role = (
        F.when(kind.isNull(), "missing").when(kind.isin(SKIPPED), "skipped").when((kind == "question_number") & hinted, "state").when(F.col("number").isNull(), "dropped")
        .when(~valid_box(F.col("box")), "invalid").when(kind.isin(STEM), "stem").when(kind.isin(OPTION), "option").otherwise("state")
    )
    return rows.withColumn("role", role)


def dropped_warnings(rows: DataFrame) -> DataFrame:
    """Pages with regions that couldn't be placed."""
    bad = rows.where(F.col("role").isin("missing", "dropped", "invalid"))
    return bad.groupBy("document_id", "page_number").agg(F.sort_array(F.collect_list(F.concat("region_id", F.lit(": "), "role"))).alias("warnings"))


def crop_path() -> Column:
    """Where the crop of an attributed region belongs."""
    return F.concat(F.lit("images/"), F.col("document_id").cast("string"), F.lit("_p"), F.col("page_number").cast("string"), F.lit("_"), F.col("region_id"), F.lit(".png"))


def block(row: str = "") -> Column:
    """A content block of an attributed region."""
    evidence = F.struct(F.col("page_number").alias("page_number"), F.col("box").alias("bbox"), F.lit("vision_layout").alias("extraction_method"), F.lit(None).cast("string").alias("source_crop_path"))
    return F.struct(
        F.col("pos").alias("sequence"), derived_id(F.col("document_id"), F.col("page_number"), F.col("pos"), F.lit(row)).alias("block_id"),
        F.when(F.col("contains_visual"), "image").otherwise("text").alias("content_type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("latex"),
        crop_path().alias("clean_crop_path"),
        evidence.alias("evidence"), F.col("confidence").alias("confidence"), F.lit("needs_review").alias("status"),
    )


def assemble(rows: DataFrame) -> DataFrame:
    """Questions from attributed regions. A number seen makes a question, even if no block is valid."""
    keys = ["document_id", "page_number", "number"]
    seen = rows.where(F.col("number").isNotNull() & F.col("role").isin("stem", "option", "invalid") | (F.col("role") == "state") & (F.coalesce(F.col("question_number_hint"), F.lit("")) == ""))
    questions = seen.groupBy(*keys).agg(F.min("pos").alias("first"))
    stems = rows.where("role = 'stem'").groupBy(*keys).agg(F.sort_array(F.collect_list(block())).alias("stem_blocks"))
    label = F.when(F.coalesce(F.col("option_label_hint"), F.lit("")) == "", "?").otherwise(F.col("option_label_hint"))
    per = rows.where("role = 'option'").withColumn("label", label).groupBy(*keys, "label").agg(F.min("pos").alias("at"), F.sort_array(F.collect_list(block())).alias("blocks"))
    item = F.struct("at", "label", F.element_at("blocks", 1)["confidence"].alias("confidence"), F.lit(True).alias("review_required"), "blocks")
    options = per.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("options"))
    out = questions.join(stems, keys, "left").join(options, keys, "left")
    return out.select(
        derived_id(F.col("document_id"), F.col("page_number"), F.col("number")).alias("question_id"), "document_id", "number", F.lit("unknown").alias("question_type"),
        F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"), F.lit("vision_layout").alias("extraction_mode"), F.lit(0.5).alias("confidence"),
        F.lit("needs_review").alias("status"), F.lit(None).cast("string").alias("answer"),
        F.coalesce("stem_blocks", F.from_json(F.lit("[]"), stems.schema["stem_blocks"].dataType)).alias("stem_blocks"),
        F.coalesce("options", F.from_json(F.lit("[]"), options.schema["options"].dataType)).alias("options"),
    )


def run_metrics(layouts: DataFrame, questions: DataFrame, rows: DataFrame) -> DataFrame:
    """Per document: pages, regions, questions, pages with regions that couldn't be placed."""
    per = layouts.groupBy("document_id").agg(F.count("*").alias("page_count"), F.sum(F.size("regions")).alias("region_count"))
    found = questions.groupBy("document_id").agg(F.count("*").alias("question_count"))
    bad = dropped_warnings(rows).groupBy("document_id").agg(F.count("*").alias("pages_with_dropped_regions"))
    return per.join(found, "document_id", "left").join(bad, "document_id", "left").fillna(0)


def pages_to_look_at_again(flagged: DataFrame, layouts: DataFrame) -> DataFrame:
    """document_id, page_number, reason, first: each page with flagged questions once, its reasons, and its first regions as JSON."""
    asked = flagged.groupBy("document_id", F.col("page_start").alias("page_number")).agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("Q"), "number", F.lit(": "), "reason"))), "; ").alias("reason"))
    return asked.join(layouts.select("document_id", "page_number", F.to_json("regions").alias("first")), ["document_id", "page_number"], "left")


def least_confidence(stem: Column, options: Column) -> Column:
    """The smallest confidence of a question's blocks; 0 without any."""
    stems = F.transform(stem, lambda b: b["confidence"])
    rest = F.flatten(F.transform(options, lambda o: F.transform(o["blocks"], lambda b: b["confidence"])))
    return F.coalesce(F.array_min(F.concat(stems, rest)), F.lit(0.0))


# The reasons in escalation_reason are output values.
def escalation_reason(confidence: Column, option_count: Column, page_warned: Column, clipped: Column) -> Column:
    """Why a question goes to the second detector, or null; the first reason counts."""
    return (
        F.when(confidence < ESCALATE_BELOW, "low detection confidence").when(option_count == 0, "no options detected")
        .when(page_warned, "unclear image-to-question region mapping on this page").when(clipped, "crop appears clipped (edge-ink-density check)")
    )


def select_for_escalation(questions: DataFrame, warned: DataFrame, issues: DataFrame) -> DataFrame:
    pages = warned.select("document_id", F.col("page_number").alias("page_start"), F.lit(True).alias("__w0")).distinct()
    ends = warned.select("document_id", F.col("page_number").alias("page_end"), F.lit(True).alias("__w1")).distinct()
    clipped = issues.where("rule_code = 'GEOM_CROP_EDGE_CLIPPED'").select("question_id").distinct().withColumn("__c", F.lit(True))
    rows = questions.join(pages, ["document_id", "page_start"], "left").join(ends, ["document_id", "page_end"], "left").join(clipped, "question_id", "left")
    on_page = F.coalesce("__w0", F.lit(False)) | F.coalesce("__w1", F.lit(False))
    reason = escalation_reason(least_confidence(F.col("stem_blocks"), F.col("options")), F.size("options"), on_page, F.coalesce("__c", F.lit(False)))
    return rows.withColumn("reason", reason).where("reason is not null").drop("__w0", "__w1", "__c")


def escalate(questions: DataFrame, layouts: DataFrame) -> DataFrame:
    """New blocks from a second detection of the page: regions whose own hint is the question's number.

    A new stem replaces the stem, new options the options; what isn't found again stays.
    """
    rows = layouts.select("document_id", "page_number", F.posexplode("regions").alias("pos", "r"))
    rows = rows.select("document_id", "page_number", "pos", "r.region_id", "r.region_type", "r.option_label_hint", "r.contains_visual", "r.confidence", F.col("r.question_number_hint").alias("number"))
    rows = rows.where(~F.col("region_type").isin([*SKIPPED, "question_number"]) & (F.coalesce(F.col("number"), F.lit("")) != ""))
    rows = rows.join(_page_boxes(layouts), ["document_id", "page_number", "region_id"]).where(valid_box(F.col("box")))
    rows = rows.withColumn("role", F.when(F.col("region_type").isin(STEM), "stem").otherwise("option")).withColumn("question_number_hint", F.col("number"))
    found = assemble(rows).select("document_id", "page_start", "number", F.col("stem_blocks").alias("__s"), F.col("options").alias("__o"))
    out = questions.join(found, ["document_id", "page_start", "number"], "left")
    out = out.withColumn("stem_blocks", F.when(F.size("__s") > 0, F.col("__s")).otherwise(F.col("stem_blocks")))
    return out.withColumn("options", F.when(F.size("__o") > 0, F.col("__o")).otherwise(F.col("options"))).drop("__s", "__o")
