"""Selectors: which objects of a document a set of criteria names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import nearest as at_digits
from folioscope.operators.geometry import box_pairs, box_side, edges_of, overlap_ratio
from folioscope.operators.integrity import explode_issues, issue
from folioscope.plans.intervals import overlapping
from folioscope.plans.search import WORD

# Tie band, distance limit, confidence weights.
TIE_DISTANCE, TIE_RATIO, MAX_DISTANCE = 24.0, 1.15, 1000.0
WEIGHTS = {"object_id": 1.0, "kind": 0.62, "slide": 0.58, "page": 0.58, "sheet": 0.58, "text_exact": 0.84, "text": 0.74,
           "bbox": 0.7, "relation": 0.82, "right_of": 0.82}
LOW_CONFIDENCE = 0.65
TITLE_BOOST, PROMINENCE_BAND = 2.25, 0.95


@dataclass(frozen=True)
class Criterion:
    """What a selector may ask for, and the columns of objects that can answer.

    Any of the ``hints`` may, or only the ``first`` that an object has; with ``fold`` case does not count.
    """

    name: str
    hints: tuple[str, ...]
    first: bool = False
    fold: bool = False


# Criteria that more than one column of an object, or either case, can answer.
CRITERIA = {c.name: c for c in (
    Criterion("shape_name", ("label", "shape_name", "name")), Criterion("page", ("page", "slide", "sheet"), first=True),
    Criterion("story", ("story", "part_kind")), Criterion("table", ("table", "table_index"), first=True), Criterion("range", ("range", "ref"), first=True),
    Criterion("placeholder", ("placeholder_key", "placeholder")), Criterion("content_control_tag", ("content_control_tag", "tag")),
    Criterion("named_range", ("named_range", "label")), Criterion("sheet_name", ("sheet_name", "sheet number"), fold=True),
    Criterion("cell", ("cell", "label"), first=True, fold=True), Criterion("table_name", ("table_name", "label"), first=True),
    Criterion("chart_path", ("chart_path", "xml_path"), first=True))}
ID, EXACT, INNER_WORD, ANY, FIRST = 0, 1, 2, -1, 3
# Selectors of a document that are checked at every object of it.
LIST = 64


def hints(rule: Criterion, objects: DataFrame) -> list[Column]:
    """What of an object can answer a criterion, as text; any of these may."""
    has = set(objects.columns)
    named = lambda c: F.concat(F.lit("sheet"), F.col("sheet").cast("string")) if c == "sheet number" else F.col(c).cast("string")
    values = [named(c) for c in rule.hints if c in has or (c == "sheet number" and "sheet" in has)]
    folded = [F.lower(v) if rule.fold else v for v in values]
    return [F.coalesce(*folded)] if rule.first and folded else folded


def answers(rule: Criterion, objects: DataFrame) -> Column:
    """Values of an object for a criterion, as one array."""
    values = hints(rule, objects)
    return F.array_distinct(F.array_compact(F.array(*values))) if values else F.array().cast("array<string>")


def _anchor_word(needle: Column) -> Column:
    inner = F.regexp_extract_all(needle, F.lit(rf"(?<=[^\p{{L}}\p{{N}}])({WORD})(?=[^\p{{L}}\p{{N}}])"), F.lit(1))
    return F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]


def fits(selector, object_id: Column, texts: Column, values: list[Column]) -> Column:
    """Whether an object has what a selector asks: its id alone, or the text and all criteria (``_s0`` ... in the order of the values)."""
    text = F.when(selector["equals"].isNotNull(), F.array_contains(texts, selector["equals"])).otherwise(
        selector["contains"].isNull() | F.exists(texts, lambda t: F.contains(t, selector["contains"])))
    rest = reduce(lambda a, b: a & b, [selector[f"_s{i}"].isNull() | F.array_contains(v, selector[f"_s{i}"]) for i, v in enumerate(values)], F.lit(True))
    return F.when(selector["_id"].isNotNull(), selector["_id"] == object_id.cast("string")).otherwise(rest & text)


def meets(selector, object_id: Column, texts: list[Column], values: list[list[Column]]) -> Column:
    """``fits`` on the columns of an object, where no arrays of them are made."""
    some = lambda tests: reduce(lambda a, b: a | b, tests, F.lit(False))
    text = F.when(selector["equals"].isNotNull(), some([t == selector["equals"] for t in texts])).otherwise(
        selector["contains"].isNull() | some([F.contains(t, selector["contains"]) for t in texts]))
    rest = reduce(lambda a, b: a & b, [selector[f"_s{i}"].isNull() | some([v == selector[f"_s{i}"] for v in vs]) for i, vs in enumerate(values)], F.lit(True))
    return F.when(selector["_id"].isNotNull(), selector["_id"] == object_id.cast("string")).otherwise(rest & text)


def matches(objects: DataFrame, selectors: DataFrame, criteria: list[str], keep: list[str] | None = None,
            unfold: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``(selector_id, doc_id, object_id, keep)`` for every object a selector matches.

    ``selectors``: ``selector_id, doc_id`` plus nullable ``object_id``, the ``criteria`` and ``contains`` / ``equals`` on the
    text (of cells also on the ``formula``). A selector without criteria matches nothing; one with an id is bound to it alone.

    Objects and selectors of a document meet on its id, and an object is sent with nothing but its own columns: what it answers is
    worked out where it is checked. Where objects come out of shorter rows, ``objects`` are these rows and ``unfold`` makes
    objects of them, keeping the columns it does not know: the rows are sent, not the objects.
    Where a document has more than ``LIST`` selectors, each is looked up by one key: its object id, whole text, an
    inner word of the contained text, or the first criterion it has; only one whose contained text has no inner word meets all
    objects. Keys travel without texts, and only objects with a candidate meet it again.
    """
    unfold = unfold or (lambda rows: rows)
    made = unfold(objects)
    rules = [CRITERIA.get(c, Criterion(c, (c,))) for c in criteria]
    formula = [F.when(F.col("kind") == "cell", F.col("formula"))] if {"kind", "formula"} <= set(made.columns) else []
    texts = [F.col("text"), *formula]
    asked = [F.lower(F.col(r.name).cast("string")) if r.fold else F.col(r.name).cast("string") for r in rules]
    any_of = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in ("object_id", "equals", "contains", *[r.name for r in rules])])
    fields = ["selector_id", "_id", "equals", "contains", *[f"_s{i}" for i in range(len(rules))]]
    wanted = selectors.filter(any_of).select("selector_id", "doc_id", F.col("object_id").cast("string").alias("_id"), "equals", "contains",
                                             *[v.alias(f"_s{i}") for i, v in enumerate(asked)])

    picked = ["doc_id", "object_id", *(keep or [])]
    crowded = selectors.filter(any_of).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > LIST).select("doc_id")
    crowds = not crowded.isEmpty()
    few = wanted.join(crowded, "doc_id", "left_anti") if crowds else wanted
    met = unfold(objects.join(few.select("doc_id", F.struct(*fields).alias("_ask")), "doc_id"))
    hit = meets(F.col("_ask"), F.col("object_id"), texts, [hints(rule, made) for rule in rules])
    found = met.filter(hit).select(F.col("_ask")["selector_id"].alias("selector_id"), *picked)
    if not crowds:
        return found
    read = made.select(*picked, F.array_distinct(F.array_compact(F.array(*texts))).alias("_texts"),
                       *[answers(rule, made).alias(f"_v{i}") for i, rule in enumerate(rules)])
    led = _by_key(read.join(crowded, "doc_id", "left_semi"), wanted.join(crowded, "doc_id", "left_semi"), len(rules))
    check = fits({f: F.col(f) for f in fields}, F.col("object_id"), F.col("_texts"), [F.col(f"_v{i}") for i in range(len(rules))])
    return found.unionByName(led.filter(check).select("selector_id", *picked))


def _by_key(read: DataFrame, wanted: DataFrame, n_rules: int) -> DataFrame:
    """Objects with the selectors whose key they have."""
    word = _anchor_word(F.col("contains"))
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("key"))
    lead = F.when(F.col("_id").isNotNull(), key(ID, F.col("_id"))).when(F.col("equals").isNotNull(), key(EXACT, F.col("equals"))).when(
        word.isNotNull(), key(INNER_WORD, word))
    for i in range(n_rules):
        lead = lead.when(F.col(f"_s{i}").isNotNull(), key(FIRST + i, F.col(f"_s{i}")))
    lead = lead.otherwise(key(ANY, F.lit("")))
    asked = wanted.select("*", lead.alias("lead")).select("*", "lead.*").drop("lead")
    kinds = asked.agg(F.collect_set("kind")).scalar()
    none = F.array().cast("array<struct<kind: int, key: string>>")
    give = lambda kind, values: F.when(F.array_contains("_kinds", kind), F.transform(values, lambda v: key(kind, v))).otherwise(none)
    words = F.array_distinct(F.flatten(F.transform("_texts", lambda t: F.regexp_extract_all(t, F.lit(rf"({WORD})"), F.lit(1)))))
    keys = F.concat(give(ID, F.array(F.col("object_id").cast("string"))), give(EXACT, F.col("_texts")), give(INNER_WORD, words), give(ANY, F.array(F.lit(""))),
                    *[give(FIRST + i, F.col(f"_v{i}")) for i in range(n_rules)])
    # Objects may share an id: a key counts once an id, and each of them is checked.
    slim = read.withColumn("_kinds", kinds).select("doc_id", "object_id", F.inline(keys)).distinct()
    return slim.join(asked, ["doc_id", "kind", "key"]).drop("kind", "key").join(read, ["doc_id", "object_id"])


def resolve(found: DataFrame, selectors: DataFrame) -> DataFrame:
    """Status per selector: matched, not_found or ambiguous, with the count."""
    counted = found.groupBy("selector_id").agg(F.count(F.lit(1)).alias("match_count"), F.min("object_id").alias("one"))
    out = selectors.select("selector_id", "doc_id").join(counted, "selector_id", "left")
    n = F.coalesce("match_count", F.lit(0).cast("bigint"))
    status = F.when(n == 0, "not_found").when(n == 1, "matched").otherwise("ambiguous")
    return out.select("selector_id", "doc_id", status.alias("status"), n.alias("match_count"), F.when(n == 1, F.col("one")).alias("object_id"))


def nearest(objects: DataFrame, points: DataFrame, max_distance: float = MAX_DISTANCE, cell: float = 128.0) -> DataFrame:
    """Objects nearest to a point, with everything inside the tie band.

    Objects are binned into grid cells first. A point meets the cells of its
    slide, drops those that provably hold no member of the tie band, and only
    then the objects of the remaining cells.
    """
    centred = objects.select(
        "doc_id", "slide", "object_id", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy")
    ).withColumn("gx", F.floor(F.col("cx") / cell)).withColumn("gy", F.floor(F.col("cy") / cell))
    keys = ["doc_id", "slide", "gx", "gy"]
    grid = centred.groupBy(*keys).agg(F.min("cx").alias("x0"), F.max("cx").alias("x1"), F.min("cy").alias("y0"), F.max("cy").alias("y1"))
    px, py = F.col("px"), F.col("py")
    gap = lambda p, a, b: F.greatest(F.col(a) - p, p - F.col(b), F.lit(0.0))
    far = lambda p, a, b: F.greatest(F.abs(p - F.col(a)), F.abs(p - F.col(b)))
    scoped = points.withColumnRenamed("slide", "want_slide")
    near_cells = grid.join(scoped, "doc_id").filter(F.col("want_slide").isNull() | (F.col("want_slide") == F.col("slide"))).select(
        "selector_id", *keys, "px", "py",
        F.hypot(gap(px, "x0", "x1"), gap(py, "y0", "y1")).alias("low"), F.hypot(far(px, "x0", "x1"), far(py, "y0", "y1")).alias("high"))
    bound = F.min("high").over(Window.partitionBy("selector_id"))
    kept = near_cells.withColumn("bound", bound).filter(
        (F.col("low") <= F.greatest(F.col("bound") + TIE_DISTANCE, F.col("bound") * TIE_RATIO)) & (F.col("low") <= max_distance))
    candidates = kept.select("selector_id", *keys, "px", "py").join(centred, keys).withColumn(
        "distance", F.hypot(F.col("cx") - px, F.col("cy") - py)).filter(F.col("distance") <= max_distance)
    ranked = candidates.withColumn("best", F.min("distance").over(Window.partitionBy("selector_id")))
    tie = (F.col("distance") - F.col("best") <= TIE_DISTANCE) | (F.col("distance") <= F.col("best") * TIE_RATIO)
    share = at_digits(F.greatest(F.lit(0.55), F.least(F.lit(0.98), 1 - F.col("distance") / max_distance)), 2)
    return ranked.filter(tie).select("selector_id", "doc_id", "object_id", "distance", share.alias("confidence"))


def right_of(objects: DataFrame, anchors: DataFrame, size: float = 64.0) -> DataFrame:
    """Nearest objects to the right of a unique anchor.

    ``anchors``: ``selector_id, doc_id, slide, object_id`` of the objects each
    selector's anchor text matched. Several anchors make the selector ambiguous
    and are returned themselves. Candidates share a vertical band with the anchor.
    """
    counted = anchors.groupBy("selector_id").agg(F.count(F.lit(1)).alias("n"))
    several = anchors.join(counted.filter(F.col("n") > 1), "selector_id").select(
        "selector_id", "doc_id", "object_id", F.lit(None).cast("double").alias("gap"), F.lit("ambiguous").alias("status"))
    boxed = objects.select("doc_id", "slide", "object_id", "x", "y", "w", "h")
    unique = anchors.join(counted.filter(F.col("n") == 1).select("selector_id"), "selector_id").join(boxed, ["doc_id", "slide", "object_id"])
    targets = box_side(unique, "t", "selector_id")
    hits = box_pairs(box_side(boxed, "f"), targets, "y", size).filter(
        (F.col("f_x") >= F.col("t_x") + F.col("t_w")) & (overlap_ratio("y") >= 0.25)
    ).withColumn("gap", F.col("f_x") - F.col("t_x") - F.col("t_w"))
    best = hits.groupBy("selector_id").agg(F.min("gap").alias("best"))
    close = hits.join(best, "selector_id").filter(F.col("gap") - F.col("best") <= TIE_DISTANCE).select(
        "selector_id", "doc_id", F.col("f_object_id").alias("object_id"), "gap", F.lit("candidate").alias("status"))
    return close.unionByName(several)


def largest_text(objects: DataFrame, keys: list[str]) -> DataFrame:
    """Objects within 95 % of the most prominent text of a slide."""
    boost = F.when(F.col("placeholder").isin("title", "ctrTitle"), TITLE_BOOST).otherwise(1.0)
    length = F.greatest(F.lit(1), F.length(F.trim("text")))
    scored = objects.filter(F.col("text") != "").withColumn("score", F.col("h") * F.sqrt(length) * boost)
    best = scored.groupBy(*keys).agg(F.max("score").alias("best"))
    return scored.join(best, keys).filter((F.col("best") > 0) & (F.col("score") >= F.col("best") * PROMINENCE_BAND)).drop("best")


def nth_body(objects: DataFrame, n: int, keys: list[str], order: str = "pos") -> DataFrame:
    """The n-th shape of a slide that is not a title; ranks beyond n are cut early."""
    body = objects.filter((F.col("kind") == "shape") & ~F.coalesce(F.col("placeholder").isin("title", "ctrTitle"), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return body.withColumn("rank", rank).filter(F.col("rank") <= n).filter(F.col("rank") == n).drop("rank")


def selector_confidence(selectors: DataFrame, criteria: dict[str, str]) -> DataFrame:
    """Confidence from the criteria a selector uses.

    ``criteria`` maps selector columns to weight names. The mean gains 0.04 per
    extra criterion up to 0.12, is capped at 0.98, and is 1 with an exact id.
    """
    used = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(WEIGHTS[w])) for c, w in criteria.items()]))
    total = F.aggregate(used, F.lit(0.0), lambda a, b: a + b)
    n = F.size(used)
    bonus = F.least(F.lit(0.12), F.greatest(F.lit(0), n - 1) * 0.04)
    exact = F.array_contains(used, 1.0)
    score = F.when(n == 0, 0.0).when(exact, 1.0).otherwise(at_digits(F.least(F.lit(0.98), total / n + bonus), 2))
    return selectors.withColumn("confidence", score)


def final_status(resolved: DataFrame) -> DataFrame:
    """Matched selectors below the threshold become ``low_confidence``."""
    low = (F.col("status") == "matched") & (F.col("confidence") < LOW_CONFIDENCE)
    return resolved.withColumn("status", F.when(low, "low_confidence").otherwise(F.col("status")))


def near_misses(objects: DataFrame, selectors: DataFrame, resolved: DataFrame, limit: int = 5, order: str = "idx") -> DataFrame:
    """First objects an unmatched text selector would match without white space and case.

    Both sides lose these, and then meet as in ``matches``.
    """
    compact = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    missed = resolved.filter(F.col("status") == "not_found").select("selector_id")
    none = F.lit(None).cast("string")
    asked = selectors.join(missed, "selector_id", "left_semi").select(
        "selector_id", "doc_id", none.alias("object_id"), compact(F.col("equals")).alias("equals"),
        F.when(F.col("equals").isNull(), compact(F.col("contains"))).alias("contains")).filter(F.coalesce("equals", "contains") != "")
    pressed = objects.select("doc_id", "object_id", F.col(order).alias("at"), compact(F.col("text")).alias("text"))
    hits = matches(pressed, asked, [], ["at"])
    rank = F.row_number().over(Window.partitionBy("selector_id").orderBy("at"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= limit).select("selector_id", "doc_id", "object_id", "rank")


def by_relation(objects: DataFrame, anchors: DataFrame, relation: str, outgoing: bool = True) -> DataFrame:
    """Objects with a geometric edge to the anchor; an ambiguous anchor returns its candidates.

    ``objects`` carry boxes, ``anchors``: ``selector_id, doc_id, object_id``. Only edges at unique anchors are built.
    """
    counted = anchors.groupBy("selector_id").agg(F.count(F.lit(1)).alias("n"))
    unique = anchors.join(counted.filter(F.col("n") == 1), "selector_id")
    node, anchor = ("from_id", "to_id") if outgoing else ("to_id", "from_id")
    edges = edges_of(objects, unique, relation, outgoing)
    related = (
        edges.select("doc_id", F.col(anchor).alias("object_id"), F.col(node).alias("found"))
        .join(unique, ["doc_id", "object_id"]).select("selector_id", "doc_id", F.col("found").alias("object_id")).distinct()
        .withColumn("status", F.lit("candidate"))
    )
    several = anchors.join(counted.filter(F.col("n") > 1), "selector_id").select(
        "selector_id", "doc_id", "object_id", F.lit("ambiguous").alias("status"))
    return related.select("selector_id", "doc_id", "object_id", "status").unionByName(several)


def by_bbox(objects: DataFrame, boxes: DataFrame, size: float = 64.0) -> DataFrame:
    """Objects near, intersecting or containing a requested box.

    ``boxes``: ``selector_id, doc_id, slide, bx, by, bw, bh, tolerance, mode``.
    Both sides meet by the vertical extents of a slide.
    """
    wanted = boxes.withColumn("_low", F.col("by") - F.col("tolerance")).withColumn("_high", F.col("by") + F.col("bh") + F.col("tolerance"))
    have = objects.select("doc_id", "slide", "object_id", "x", "y", "w", "h", (F.col("y") + F.col("h")).alias("_end"))
    pairs = overlapping(wanted, have, ["doc_id", "slide"], ("_low", "_high"), ("y", "_end"), size)
    c = F.col
    close = lambda a, b: F.abs(c(a) - c(b)) <= c("tolerance")
    near = close("x", "bx") & close("y", "by") & close("w", "bw") & close("h", "bh")
    crossing = (
        (c("x") < c("bx") + c("bw")) & (c("x") + c("w") > c("bx")) & (c("y") < c("by") + c("bh")) & (c("y") + c("h") > c("by")))
    inside = (
        (c("bx") >= c("x")) & (c("by") >= c("y")) & (c("bx") + c("bw") <= c("x") + c("w")) & (c("by") + c("bh") <= c("y") + c("h")))
    hit = F.when(c("mode") == "intersects", crossing).when(c("mode") == "contains", inside).otherwise(near)
    return pairs.filter(hit).select("selector_id", "doc_id", "object_id")


def lock_violations(ops: DataFrame, locks: DataFrame) -> DataFrame:
    """Operations not provably inside the lock scope of their document.

    ``ops``: ``op_id, doc_id`` and nullable ``slide, sheet, paragraph, range,
    object_id``; ``locks``: ``doc_id, scope`` such as ``slide:3``.
    """
    joined = ops.join(locks, "doc_id")
    kind = F.split_part("scope", F.lit(":"), F.lit(1))
    value = F.split_part("scope", F.lit(":"), F.lit(2))
    number = value.try_cast("int")
    inside = (
        F.when((F.col("scope") == "") | (kind == "document"), True)
        .when(kind == "slide", F.col("slide") == number)
        .when(kind == "sheet", (F.lower("sheet") == F.lower(value)) | (F.col("sheet") == number.cast("string")))
        .when(kind == "paragraph", F.col("paragraph") == number)
        .when(kind == "range", F.upper("range") == F.upper(value))
        .when(kind == "stableObjectId", F.col("object_id") == value)
    )
    return explode_issues(joined, ["op_id", "doc_id", "scope"], [
        issue(~F.coalesce(inside, F.lit(False)), "EDIT_OUTSIDE_LOCK_SCOPE", "error")])
