"""Issue rollups, quality gates, scores, layout checks and corpus reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.integrity import explode_issues, issue

# Severity order, and the penalties and caps of the scores.
SEVERITY_RANK = {"error": 3, "warning": 2, "info": 1}
BLOCKING_STEP, BLOCKING_CAP = 0.35, 0.85
WARNING_STEP, WARNING_CAP, ENVIRONMENT_PENALTY = 0.04, 0.16, 0.01
CRITIQUE_PENALTY = {"error": 0.35, "warning": 0.12, "info": 0.03}
TEXT_LIMIT = {"pptx": 260}
DEFAULT_TEXT_LIMIT, CELL_LIMIT = 1400, 140
SLIDE_WIDTH, SLIDE_HEIGHT = 961, 541
DENSE_OBJECTS, DENSE_CHARACTERS = 18, 950


def severity_rank(column: str = "severity") -> Column:
    rank = F.lit(0)
    for name, value in SEVERITY_RANK.items():
        rank = F.when(F.col(column) == name, value).otherwise(rank)
    return rank


def severity_name(rank: Column) -> Column:
    name = F.lit(None).cast("string")
    for label, value in SEVERITY_RANK.items():
        name = F.when(rank == value, label).otherwise(name)
    return name


def category(code: str = "code") -> Column:
    """Warning category from the shape of the code."""
    c = F.col(code)
    has = lambda word: F.contains(c, F.lit(word))
    return (
        F.when(c.startswith("SECURITY_") | has("MACRO") | has("EXTERNAL_LINK"), "security")
        .when(c.isin("ZIP_EMBEDDED_OBJECT", "ZIP_EXTERNAL_RELATIONSHIP"), "security")
        .when(c.startswith("ZIP_"), "compatibility")
        .when(c.isin("NATIVE_RENDERER_NOT_RUN", "VERIFY_TIMEOUT") | has("RENDERER"), "environment")
        .when(has("REPAIR") | has("OPENABLE") | has("UNSUPPORTED"), "compatibility")
        .otherwise("quality")
    )


def summarize_issues(issues: DataFrame, order: list[str], examples: int = 3) -> DataFrame:
    """Per document and code: count, worst severity, category, first ``examples`` messages.

    Counts are partial aggregates; the examples are a ranked cut that Spark
    applies before the shuffle. No group of issues is gathered whole; ``issues``
    tells how many messages there are in all.
    """
    keys = ["doc_id", "code"]
    counted = issues.groupBy(*keys).agg(F.count(F.lit(1)).alias("issues"), F.max(severity_rank()).alias("rank"))
    spot = Window.partitionBy(*keys).orderBy(*order)
    first = issues.withColumn("rn", F.row_number().over(spot)).filter(F.col("rn") <= examples)
    shown = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rn", "message"))).alias("e"))
    return counted.join(shown, keys).select(
        *keys, "issues", severity_name(F.col("rank")).alias("severity"), category().alias("category"),
        F.array_join(F.transform("e", lambda e: e["message"]), " | ").alias("examples"),
    )


def top_risks(summary: DataFrame, limit: int = 8) -> DataFrame:
    """Highest risks of a document by severity, count, code."""
    order = [severity_rank().desc(), F.col("issues").desc(), F.col("code")]
    ranked = summary.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
    return ranked.filter(F.col("position") <= limit)


def worst_overflows(issues: DataFrame, limit: int = 5) -> DataFrame:
    """Longest overflow messages of a document."""
    order = [F.length("message").desc(), F.col("message")]
    hits = issues.filter(F.col("code") == "TEXT_OVERFLOW_RISK")
    ranked = hits.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
    return ranked.filter(F.col("position") <= limit)


def evaluate_gates(summary: DataFrame, objects: DataFrame, gates: DataFrame) -> DataFrame:
    """Failed gates per document.

    ``gates`` has ``doc_id`` and nullable ``expected_slides, expected_pages,
    required_text, forbidden_text (arrays), max_warnings, max_blank_pages``.
    Texts are tested object by object and the hits are aggregated. A gate on a
    document that is not there fails wherever it expects something.
    """
    joined = gates.join(summary, "doc_id", "left")

    def differs(found: str, expected: str) -> Column:
        return F.col(expected).isNotNull() & ~F.col(found).eqNullSafe(F.col(expected))

    numeric = explode_issues(joined, ["doc_id"], [
        issue(differs("slides", "expected_slides"), "GATE_EXPECTED_SLIDES", "error"),
        issue(differs("pages", "expected_pages"), "GATE_EXPECTED_PAGES", "error"),
        issue(F.col("warnings") > F.col("max_warnings"), "GATE_MAX_WARNINGS", "error"),
        issue(F.col("blank_pages") > F.col("max_blank_pages"), "GATE_MAX_BLANK_PAGES", "error"),
    ]).withColumn("text", F.lit(None).cast("string"))
    wanted = gates.select("doc_id", F.explode(F.coalesce("required_text", F.array().cast("array<string>"))).alias("needle"), F.lit(True).alias("required"))
    banned = gates.select("doc_id", F.explode(F.coalesce("forbidden_text", F.array().cast("array<string>"))).alias("needle"), F.lit(False).alias("required"))
    tests = wanted.unionByName(banned)
    found = objects.select("doc_id", "text").join(tests, "doc_id").groupBy("doc_id", "needle", "required").agg(
        F.bool_or(F.contains("text", F.col("needle"))).alias("hit"))
    results = tests.join(found, ["doc_id", "needle", "required"], "left")
    hit = F.coalesce("hit", F.lit(False))
    texts = explode_issues(results.withColumnRenamed("needle", "text"), ["doc_id", "text"], [
        issue(F.col("required") & ~hit, "GATE_REQUIRED_TEXT_MISSING", "error"),
        issue(~F.col("required") & hit, "GATE_FORBIDDEN_TEXT_PRESENT", "error"),
    ])
    return numeric.unionByName(texts.select(numeric.columns))


def verify_score(issues: DataFrame) -> DataFrame:
    """Score and readiness per document from error, warning and environment counts."""
    per_code = issues.groupBy("doc_id", "code").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") != "error").alias("warnings"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn("category", category())
    capped = F.least(F.lit(WARNING_CAP), F.col("n") * WARNING_STEP)
    penalty = F.when(F.col("category") == "environment", F.lit(ENVIRONMENT_PENALTY)).otherwise(capped)
    per_doc = per_code.groupBy("doc_id").agg(
        F.sum("errors").alias("blocking"), F.sum("warnings").alias("warnings"), F.sum(penalty).alias("penalty"),
        F.bool_or((F.col("errors") == 0) & (F.col("category") != "environment")).alias("quality_warning"),
    )
    blocking = F.least(F.lit(BLOCKING_CAP), F.col("blocking") * BLOCKING_STEP)
    readiness = (
        F.when(F.col("blocking") > 0, "blocked").when(F.col("quality_warning"), "warning")
        .when(F.col("warnings") > 0, "pass_with_environment_gap").otherwise("pass")
    )
    # Rounded twice: the inner one removes summation noise at the cut.
    score = F.round(F.greatest(F.lit(0.0), F.round(1 - blocking - F.col("penalty"), 8)), 2)
    return per_doc.select("doc_id", "blocking", "warnings", score.alias("score"), readiness.alias("readiness"))


def content_hints(packages: DataFrame, objects: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Empty documents, over-long texts and over-long table cells."""
    limit = F.lit(DEFAULT_TEXT_LIMIT)
    for fmt, value in TEXT_LIMIT.items():
        limit = F.when(F.col("format") == fmt, value).otherwise(limit)
    docs = packages.select("doc_id", "format").withColumn("limit", limit)
    over = F.length("text") > F.col("limit")
    longest = objects.select("doc_id", "idx", "text").join(docs, "doc_id").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("texts"),
        F.min_by(F.when(over, F.length("text")), F.when(over, F.col("idx"))).alias("characters"),
    )
    out = docs.select("doc_id").join(longest, "doc_id", "left")
    if cells is not None:
        wide = cells.groupBy("doc_id").agg(F.max(F.length("text")).alias("widest"))
        out = out.join(wide, "doc_id", "left")
    else:
        out = out.withColumn("widest", F.lit(None).cast("int"))
    empty = F.col("texts").isNull() & F.col("widest").isNull()
    return explode_issues(out, ["doc_id", "characters"], [
        issue(empty, "OOXML_EMPTY_CONTENT_HINT", "warning"),
        issue(F.col("characters").isNotNull(), "TEXT_OVERFLOW_HINT", "warning"),
        issue(F.col("widest") > CELL_LIMIT, "TABLE_CELL_OVERFLOW_HINT", "warning"),
    ]).withColumn("characters", F.when(F.col("code") == "TEXT_OVERFLOW_HINT", F.col("characters")))


def verify(packages: DataFrame, *issue_tables: DataFrame) -> DataFrame:
    """Structural verdict: fail on any error, else pass with an environment gap."""
    issues = None
    for table in issue_tables:
        part = table.select("doc_id", "code", "severity")
        issues = part if issues is None else issues.unionByName(part)
    counted = issues.groupBy("doc_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    out = packages.select("doc_id").join(counted, "doc_id", "left").na.fill(0, ["errors", "warnings"]).na.fill("", ["codes"])
    return out.withColumn("status", F.when(F.col("errors") > 0, "fail").otherwise("pass_with_environment_gap"))


# --- text overflow and slide layout ----------------------------------------------------


def upper_median(values: Column) -> Column:
    """Element ``floor(n / 2)`` of the sorted positive values, NULL if there are none."""
    kept = F.sort_array(F.filter(values, lambda v: v > 0))
    return F.try_element_at(kept, (F.floor(F.size(kept) / 2) + 1).cast("int"))


def estimated_height(text: Column, width: Column, font_pt: Column, paragraphs: Column) -> Column:
    """Height in pixels of wrapped text; lengths are code points."""
    px = F.greatest(F.lit(8.0), font_pt * 1.333)
    per_line = F.greatest(F.lit(8), F.floor(F.greatest(F.lit(48.0), width) / F.greatest(F.lit(4.5), px * 0.52)))
    lines = F.aggregate(
        F.split(text, "\r?\n", -1), F.lit(0).cast("bigint"),
        lambda total, line: total + F.greatest(F.lit(1), F.ceil(F.length(line) / per_line)))
    lines = F.greatest(lines, paragraphs)
    return lines * px * 1.22 + F.greatest(F.lit(0), paragraphs - 1) * px * 0.28 + 8


def overflow_risk(objects: DataFrame, max_len: int = 220) -> DataFrame:
    """Objects whose text exceeds its box or the length limit.

    Needs ``text, kind, w, h, font_sizes (array), paragraphs``; a NULL box
    leaves only the length rule. Row by row, without a shuffle.
    """
    size = F.coalesce(upper_median(F.col("font_sizes")), F.when(F.col("kind") == "shape", 18.0).otherwise(11.0))
    sized = objects.filter(F.col("text").rlike(r"\S")).withColumn("font_pt", size)
    height = estimated_height(F.col("text"), F.col("w"), F.col("font_pt"), F.greatest(F.lit(1), F.col("paragraphs")))
    measured = sized.withColumn("height", height)
    tall = F.coalesce(F.col("height") > F.col("h") * 1.15, F.lit(False))
    reason = F.when(tall, "height").when(F.length("text") > max_len, "length")
    return measured.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(
        "doc_id", "object_id", F.lit("TEXT_OVERFLOW_RISK").alias("code"), F.lit("warning").alias("severity"), "reason",
        F.length("text").alias("text_length"), "font_pt", F.when(tall, F.round("height", 1)).alias("estimated_height"),
        F.concat(F.substring("text", 1, max_len - 1), F.lit("…")).alias("suggested_text"),
    )


def shape_runs(runs: DataFrame) -> DataFrame:
    """Run facts per shape, as aggregates: a shape's runs are never gathered."""
    shaped = runs.groupBy("doc_id", "part", "shape").agg(
        F.count_distinct("para").alias("paragraphs"), F.min(F.when(F.col("font_pt") > 0, F.col("font_pt"))).alias("smallest_pt"),
        F.bool_or(F.coalesce("italic", F.lit(False))).alias("italic"), F.count_if(F.col("text") == "\n").alias("line_breaks"),
        F.max("level").alias("deepest_level"), F.sum(F.length("text")).alias("characters"),
    )
    return shaped


def font_families(runs: DataFrame) -> DataFrame:
    """Number of distinct font families per shape."""
    fonts = F.array_compact(F.array("font_latin", "font_ea", "font_cs"))
    return runs.select("doc_id", "part", "shape", F.explode(fonts).alias("font")).groupBy("doc_id", "part", "shape").agg(
        F.count_distinct("font").alias("families"))


def layout_lint(objects: DataFrame, runs: DataFrame) -> DataFrame:
    """Off-slide boxes, tiny text, long italic text, font mixes and overflow on slides.

    ``objects`` carries ``doc_id, part, pos, text_body, text, kind, x, y, w, h``; runs meet it on
    the text body, and a finding names the element by its position as ``shape``.
    """
    keys = ["doc_id", "part", "shape"]
    fonts = font_families(runs)
    sizes = runs.filter(F.col("font_pt") > 0).groupBy(*keys, "font_pt").agg(F.count(F.lit(1)).alias("n"))
    # Upper median from the size histogram: the smallest size whose running count passes half.
    histogram = sizes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("font_pt", "n"))).alias("hist"), F.sum("n").alias("total"))
    running = F.aggregate(
        "hist", F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("size")),
        lambda acc, item: F.struct(
            (acc["seen"] + item["n"]).alias("seen"),
            F.when(acc["size"].isNull() & (acc["seen"] + item["n"] > F.floor(F.col("total") / 2)), item["font_pt"]).otherwise(acc["size"]).alias("size")))
    median = histogram.select(*keys, running["size"].alias("median_pt"))
    joined = objects.withColumn("shape", F.col("text_body")).join(shape_runs(runs), keys, "left").join(fonts, keys, "left").join(median, keys, "left")
    off = (F.col("x") < -1) | (F.col("y") < -1) | (F.col("x") + F.col("w") > SLIDE_WIDTH) | (F.col("y") + F.col("h") > SLIDE_HEIGHT)
    has_text = F.col("text").rlike(r"\S") & F.col("paragraphs").isNotNull()
    size = F.coalesce("median_pt", F.when(F.col("kind") == "shape", 18.0).otherwise(12.0))
    height = estimated_height(F.col("text"), F.col("w").cast("double"), size, F.greatest(F.lit(1), F.col("paragraphs")))
    return explode_issues(joined.withColumn("shape", F.col("pos")), keys, [
        issue(off, "PPTX_OBJECT_OFF_SLIDE", "warning"),
        issue(has_text & (F.col("smallest_pt") < 9), "PPTX_TINY_TEXT", "warning"),
        issue(has_text & F.col("italic") & (F.length("text") > 24), "PPTX_ITALIC_BODY_TEXT", "info"),
        issue(has_text & (F.col("families") > 2), "PPTX_MIXED_FONT_FAMILIES", "warning"),
        issue(has_text & (height > F.col("h") * 1.15), "PPTX_TEXT_OVERFLOW_ESTIMATE", "warning"),
    ])


def slide_density(objects: DataFrame, slides: DataFrame) -> DataFrame:
    """Dense slides, and documents in which some slide has no text."""
    per_slide = objects.filter(F.col("text").rlike(r"\S")).groupBy("doc_id", "slide").agg(
        F.count(F.lit(1)).alias("text_objects"), F.sum(F.length("text")).alias("characters"))
    dense = per_slide.filter((F.col("text_objects") > DENSE_OBJECTS) | (F.col("characters") > DENSE_CHARACTERS)).select(
        "doc_id", "slide", F.lit("PPTX_SLIDE_DENSITY_HIGH").alias("code"), F.lit("warning").alias("severity"))
    blank = slides.select("doc_id", "slide").join(per_slide.select("doc_id", "slide"), ["doc_id", "slide"], "left_anti")
    many = slides.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    risk = many.join(blank, "doc_id", "left_semi").select(
        "doc_id", F.lit(None).cast("int").alias("slide"), F.lit("PPTX_BLANK_SLIDE_RISK").alias("code"), F.lit("warning").alias("severity"))
    return dense.unionByName(risk)


def diagnose(packages: DataFrame, objects: DataFrame, overflow: DataFrame, macros: DataFrame, repair: DataFrame) -> DataFrame:
    """Overflow, macro, no-text and repair-risk issues in one table.

    ``suggested_op`` names the edit that would repair the issue, if there is one.
    """
    shape = lambda d, op=None: d.select(
        "doc_id", "code", "severity",
        (F.col("object_id") if "object_id" in d.columns else F.lit(None)).cast("string").alias("object_id"),
        F.lit(op).cast("string").alias("suggested_op"))
    macro = macros.filter(F.col("code") == "ZIP_MACRO_PART").select("doc_id").distinct().select(
        "doc_id", F.lit("MACRO_PRESENT").alias("code"), F.lit("warning").alias("severity"))
    silent = packages.filter(F.col("format") != "pdf").select("doc_id").join(objects.select("doc_id"), "doc_id", "left_anti").select(
        "doc_id", F.lit("NO_TEXT_OBJECTS").alias("code"), F.lit("info").alias("severity"))
    return shape(overflow, "setText").unionByName(shape(macro)).unionByName(shape(silent)).unionByName(shape(repair))


# --- critique, improvement, repair -------------------------------------------------------


def critique_score(documents: DataFrame, findings: DataFrame) -> DataFrame:
    penalty = F.lit(CRITIQUE_PENALTY["info"])
    for name in ("warning", "error"):
        penalty = F.when(F.col("severity") == name, CRITIQUE_PENALTY[name]).otherwise(penalty)
    summed = findings.groupBy("doc_id").agg(
        F.sum(penalty).alias("penalty"), F.count(F.lit(1)).alias("findings"), F.bool_or(F.col("severity") == "error").alias("blocked"))
    out = documents.select("doc_id").join(summed, "doc_id", "left").na.fill(0, ["findings"])
    score = F.round(F.greatest(F.lit(0.0), F.round(1 - F.coalesce("penalty", F.lit(0.0)), 8)), 2)
    readiness = F.when(F.col("blocked"), "blocked").when(F.col("findings") > 0, "warning").otherwise("pass")
    return out.select("doc_id", "findings", score.alias("score"), readiness.alias("readiness"))


# Finding code -> skeleton operation of the improvement plan.
STYLE_CODES = [
    "PPTX_FONT_TOO_SMALL", "PPTX_FONT_FAMILY_FRAGMENTED", "PPTX_STRAY_ITALIC_TEXT", "PPTX_BULLET_TOO_LONG", "PPTX_BULLET_DEPTH_HIGH",
    "PPTX_EXPLICIT_LINE_BREAKS_HIGH", "PPTX_TEXT_OVERFLOW_ESTIMATE", "PPTX_OBJECT_OFF_SLIDE", "PPTX_SLIDE_DENSITY_HIGH",
]
SKELETON_OPS = {
    "PPTX_ASSETS_NONE": "pptx.replaceImageByShape", "PPTX_CHARTS_NONE": "pptx.updateChartData",
    "XLSX_DASHBOARD_CHARTS_NONE": "xlsx.writeTable", "XLSX_TABLES_NONE": "xlsx.writeTable",
    **{code: "pptx.setText" for code in STYLE_CODES},
}


def improvement_plan(findings: DataFrame) -> DataFrame:
    """Plan only: finding, skeleton operation or NULL, never applied."""
    known = F.create_map(*[F.lit(v) for pair in SKELETON_OPS.items() for v in pair])
    return findings.select("doc_id", F.col("code").alias("finding_code"), "severity",
                           F.try_element_at(known, F.col("code")).alias("skeleton_op"), F.lit(True).alias("dry_run_only"))


def repair_taxonomy(issues: DataFrame, repairable: Column) -> DataFrame:
    """Category and repairability per issue; documents without any repair get a sentinel row."""
    c = F.col("code")
    has = lambda word: F.contains(c, F.lit(word))
    kind = (
        F.when(c.startswith("MACRO") | c.startswith("SECURITY_"), "security")
        .when(has("REPAIR") | has("RELATIONSHIP") | has("MISSING_PART"), "compatibility")
        .when(has("NATIVE") | has("RENDERER"), "environment").otherwise("quality")
    )
    rows = issues.select("doc_id", "code", kind.alias("category"), "severity", repairable.alias("auto_repairable"))
    totals = rows.groupBy("doc_id").agg(
        F.bool_or("auto_repairable").alias("any"), F.bool_or(F.col("severity") == "error").alias("error"))
    sentinel = totals.filter(~F.col("any")).select(
        "doc_id", F.lit("REPAIR_NO_SAFE_OPS").alias("code"), F.lit("compatibility").alias("category"),
        F.when(F.col("error"), "error").otherwise("warning").alias("severity"), F.lit(False).alias("auto_repairable"))
    return rows.unionByName(sentinel)


# --- corpus level -----------------------------------------------------------------------


def corpus_report(results: DataFrame, errors: int = 8) -> DataFrame:
    """One row for the corpus: counts, readiness, status, the first distinct errors.

    ``results``: ``doc_id, ok, error, position``. Errors are reduced to their
    first position before ``errors`` of them are chosen, as they end up in one text.
    """
    failed = F.when(~F.col("ok"), F.coalesce("error", F.lit("unknown")))
    totals = results.agg(F.count(F.lit(1)).alias("documents"), F.count_if("ok").alias("ok_count")).withColumn(
        "e", F.lit(None).cast("struct<first:bigint,error:string>"))
    distinct = results.filter(~F.col("ok")).groupBy(failed.alias("error")).agg(F.min("position").alias("first")).filter(F.col("error") != "")
    head = distinct.orderBy("first", "error").limit(errors).select(
        F.lit(0).cast("bigint").alias("documents"), F.lit(0).cast("bigint").alias("ok_count"),
        F.struct(F.col("first").cast("bigint").alias("first"), "error").alias("e"))
    # One row of totals and the few rows of errors are folded into one.
    out = totals.unionByName(head).agg(
        F.sum("documents").alias("documents"), F.sum("ok_count").alias("ok_count"), F.array_sort(F.collect_list("e")).alias("e"))
    done, total = F.col("ok_count"), F.col("documents")
    return out.select(
        "documents", "ok_count", (total - done).alias("failed_count"),
        F.when((done == total) & (total > 0), "pass").when(done == 0, "blocked").otherwise("warning").alias("readiness"),
        F.when(total == 0, "empty").when(done == total, "complete").when(done == 0, "missing_or_unreadable").otherwise("partial").alias("corpus_status"),
        F.array_join(F.transform("e", lambda e: e["error"]), " | ").alias("errors"),
    )


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Mean score and ok count of two corpus runs, and the change of the mean."""
    both = before.select("score", "ok", F.lit("before").alias("side")).unionByName(after.select("score", "ok", F.lit("after").alias("side")))
    mean = lambda side: F.coalesce(F.round(F.avg(F.when(F.col("side") == side, F.col("score"))), 4), F.lit(0.0)).alias(f"{side}_score")
    good = lambda side: F.count_if((F.col("side") == side) & F.col("ok")).alias(f"{side}_ok")
    out = both.agg(mean("before"), good("before"), mean("after"), good("after"))
    return out.withColumn("delta", F.round(F.col("after_score") - F.col("before_score"), 4))


def page_quality(objects: DataFrame, pages: DataFrame) -> DataFrame:
    """Per document: identical pages, all-identical flag, blank pages.

    A page is digested from its ordered objects (a page is a bounded group);
    only digests are grouped per document.
    """
    row = F.struct("idx", "text")
    digests = objects.filter(F.col("text").rlike(r"\S")).groupBy("doc_id", "page").agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["text"]), "\n"), 256).alias("digest"))
    full = pages.select("doc_id", "page").join(digests, ["doc_id", "page"], "left")
    groups = full.filter(F.col("digest").isNotNull()).groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    same = groups.groupBy("doc_id").agg(
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("identical_pages"), F.max("n").alias("largest"))
    totals = full.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("digest").isNull()).alias("blank_pages"))
    return totals.join(same, "doc_id", "left").select(
        "doc_id", "pages", "blank_pages", F.coalesce("identical_pages", F.lit(0).cast("bigint")).alias("identical_pages"),
        ((F.col("pages") > 1) & (F.coalesce("largest", F.lit(0)) == F.col("pages"))).alias("all_identical"))
