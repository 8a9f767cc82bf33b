"""Box geometry: relations between boxes of a scope, constraints, alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import round_half_up
from folioscope.plans.intervals import crowded, overlapping
from folioscope.plans.ordered import chunk_of, numbered

# Confidence of each geometric relation, overlap share, evidence weights.
CONFIDENCE = {"contains": 0.86, "rightOf": 0.82, "below": 0.78}
OVERLAP = 0.25
BAND = 64.0


def box_side(boxes: DataFrame, prefix: str, *more: str) -> DataFrame:
    """One side of ``box_pairs``: ids, boxes and where they end, under a prefix."""
    return boxes.select("doc_id", "slide", *more, *[F.col(c).alias(f"{prefix}_{c}") for c in ("object_id", "x", "y", "w", "h")],
                        *[(F.col(a) + F.greatest(F.col(e), F.lit(0.0))).alias(f"{prefix}_{a}_end") for a, e in (("x", "w"), ("y", "h"))])


def box_pairs(left: DataFrame, right: DataFrame, axis: str, size: float = BAND) -> DataFrame:
    """Pairs of different boxes of a slide whose extents on the axis overlap; columns ``f_*`` and ``t_*``."""
    pairs = overlapping(left, right, ["doc_id", "slide"], (f"f_{axis}", f"f_{axis}_end"), (f"t_{axis}", f"t_{axis}_end"), size)
    return pairs.filter(F.col("f_object_id") != F.col("t_object_id"))


def overlap_ratio(axis: str, left: str = "f", right: str = "t") -> Column:
    start, extent = ("y", "h") if axis == "y" else ("x", "w")
    a, b = F.col(f"{left}_{start}"), F.col(f"{right}_{start}")
    ea, eb = F.col(f"{left}_{extent}"), F.col(f"{right}_{extent}")
    shared = F.greatest(F.lit(0.0), F.least(a + ea, b + eb) - F.greatest(a, b))
    return shared / F.greatest(F.lit(1.0), F.least(ea, eb))


def edge_tests() -> dict[str, tuple[str, Column]]:
    """Relation -> the axis on which its boxes overlap, and its test on a pair."""
    inside = (
        (F.col("f_w") * F.col("f_h") > F.col("t_w") * F.col("t_h"))
        & (F.col("t_x") >= F.col("f_x")) & (F.col("t_y") >= F.col("f_y"))
        & (F.col("t_x") + F.col("t_w") <= F.col("f_x") + F.col("f_w"))
        & (F.col("t_y") + F.col("t_h") <= F.col("f_y") + F.col("f_h"))
    )
    right = (F.col("f_x") >= F.col("t_x") + F.col("t_w")) & (overlap_ratio("y") >= OVERLAP)
    below = (F.col("f_y") >= F.col("t_y") + F.col("t_h")) & (overlap_ratio("x") >= OVERLAP)
    return {"contains": ("y", inside), "rightOf": ("y", right), "below": ("x", below)}


def geometry_edges(boxes: DataFrame, size: float = BAND) -> DataFrame:
    """``contains``, ``rightOf`` and ``below`` edges between boxes of one slide.

    Every relation needs a shared stretch on one axis. The boxes of a slide with few of them meet once, for all relations;
    those of a crowded one meet by interval joins, where ``contains`` and ``rightOf`` share the vertical axis.
    """
    many = crowded(boxes, ["doc_id", "slide"])
    if many.isEmpty():
        return _edges_of_small(boxes)
    return _edges_of_small(boxes.join(many, ["doc_id", "slide"], "left_anti")).unionByName(_edges_of_crowded(boxes.join(many, ["doc_id", "slide"], "left_semi"), size))


def _edge(name: str, test: Column) -> Column:
    return F.when(test, F.struct(F.lit(name).alias("relation"), F.lit(CONFIDENCE[name]).alias("confidence")))


def _edges_of_small(boxes: DataFrame) -> DataFrame:
    c = F.col
    touch = lambda axis: (c(f"f_{axis}") <= c(f"t_{axis}_end")) & (c(f"t_{axis}") <= c(f"f_{axis}_end"))
    edges = F.array_compact(F.array(*[_edge(name, test & touch(axis)) for name, (axis, test) in edge_tests().items()]))
    met = box_side(boxes, "f").join(box_side(boxes, "t").hint("merge"), ["doc_id", "slide"]).filter(c("f_object_id") != c("t_object_id"))
    return met.select("doc_id", "slide", c("f_object_id").alias("from_id"), c("t_object_id").alias("to_id"), F.inline(edges))


def _edges_of_crowded(boxes: DataFrame, size: float) -> DataFrame:
    tests = edge_tests()
    ids = [F.col("f_object_id").alias("from_id"), F.col("t_object_id").alias("to_id")]
    left, right = box_side(boxes, "f"), box_side(boxes, "t")
    rows = box_pairs(left, right, "y", size).filter(tests["contains"][1] | tests["rightOf"][1]).select(
        "doc_id", "slide", *ids, F.inline(F.array_compact(F.array(*[_edge(name, tests[name][1]) for name in ("contains", "rightOf")]))))
    columns = box_pairs(left, right, "x", size).filter(tests["below"][1]).select(
        "doc_id", "slide", *ids, F.lit("below").alias("relation"), F.lit(CONFIDENCE["below"]).alias("confidence"))
    return rows.unionByName(columns)


def edges_of(boxes: DataFrame, anchors: DataFrame, relation: str, outgoing: bool = True, size: float = BAND) -> DataFrame:
    """``(doc_id, slide, from_id, to_id)`` of one relation at the anchors (``doc_id, object_id``); no other edge is built.

    ``outgoing``: the anchor is the target, so that edges lead from the objects asked for.
    """
    ends = boxes.join(anchors.select("doc_id", "object_id").distinct(), ["doc_id", "object_id"], "left_semi")
    axis, test = edge_tests()[relation]
    sides = (boxes, ends) if outgoing else (ends, boxes)
    pairs = box_pairs(box_side(sides[0], "f"), box_side(sides[1], "t"), axis, size).filter(test)
    return pairs.select("doc_id", "slide", F.col("f_object_id").alias("from_id"), F.col("t_object_id").alias("to_id"))


def graph_nodes(objects: DataFrame, hints: list[str], box: str | None = None) -> DataFrame:
    """Nodes with evidence confidence and risk flags.

    Evidence: 1 for the object itself, 0.95 for a box, 0.9 per scope hint; the
    mean is given at two decimals.
    """
    has_box = F.col(box).isNotNull().cast("int") if box else F.lit(0)
    scoped = sum((F.col(h).isNotNull().cast("int") for h in hints), F.lit(0))
    hundredths = (100 + 95 * has_box + 90 * scoped) / (1 + has_box + scoped)
    # 97.5 hundredths is the one tie; its binary value lies below and is cut to 0.97.
    confidence = F.when(hundredths == 97.5, F.lit(0.97)).otherwise(F.floor(hundredths + 0.5) / 100)
    flags = F.array_compact(F.array(
        F.lit("UNTRUSTED_DOCUMENT_CONTENT"),
        F.when(F.contains(F.lower("kind"), F.lit("annotation")), F.lit("ANNOTATION_CONTENT"))))
    return objects.select("doc_id", "object_id", "kind", confidence.alias("confidence"), F.array_join(flags, ",").alias("risk_flags"))


def graph_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node counts by type and edge counts by relation per document."""
    by_type = nodes.groupBy("doc_id", F.lit("node").alias("entry"), F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    by_relation = edges.groupBy("doc_id", F.lit("edge").alias("entry"), F.col("relation").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return by_type.unionByName(by_relation)


# --- constraints and arrangement ----------------------------------------------------------


def _clamp(value: Column, low: Column, high: Column) -> Column:
    """``least`` and ``greatest`` skip NULL limits."""
    return F.least(high, F.greatest(low, value))


def apply_constraints(boxes: DataFrame, constraints: DataFrame) -> DataFrame:
    """Clamp size, align to bounds, snap, clamp again; one constraint row per object.

    ``constraints``: ``doc_id, object_id`` and nullable ``min_w, max_w, min_h,
    max_h, bx, by, bw, bh, align_x, align_y, snap``.
    """
    c = F.col
    out = boxes.join(constraints, ["doc_id", "object_id"], "left").select(
        *[c(n) for n in boxes.columns if n not in "xywh"],
        *[c(n).alias(f"before_{n}") for n in "xywh"], *[c(n) for n in "xywh"],
        *[c(n) for n in ("min_w", "max_w", "min_h", "max_h", "bx", "by", "bw", "bh", "align_x", "align_y", "snap")])

    def size(d):
        return d.withColumns({"w": _clamp(c("w"), c("min_w"), c("max_w")), "h": _clamp(c("h"), c("min_h"), c("max_h"))})

    def keep(d):
        bound = c("bx").isNotNull()
        return d.withColumns({
            "x": F.when(bound, _clamp(c("x"), c("bx"), c("bx") + c("bw") - c("w"))).otherwise(c("x")),
            "y": F.when(bound, _clamp(c("y"), c("by"), c("by") + c("bh") - c("h"))).otherwise(c("y"))})

    out = size(out)
    bound = c("bx").isNotNull()
    out = out.withColumns({
        "x": F.when(bound & (c("align_x") == "center"), c("bx") + (c("bw") - c("w")) / 2)
        .when(bound & (c("align_x") == "right"), c("bx") + c("bw") - c("w")).when(bound & (c("align_x") == "left"), c("bx")).otherwise(c("x")),
        "y": F.when(bound & (c("align_y") == "middle"), c("by") + (c("bh") - c("h")) / 2)
        .when(bound & (c("align_y") == "bottom"), c("by") + c("bh") - c("h")).when(bound & (c("align_y") == "top"), c("by")).otherwise(c("y"))})
    out = keep(out)
    out = out.withColumns({n: F.when(c("snap") > 0, round_half_up(c(n) / c("snap")) * c("snap")).otherwise(c(n)) for n in "xywh"})
    out = keep(size(out))
    changed = F.lit(False)
    for n in "xywh":
        changed = changed | (c(n) != c(f"before_{n}"))
    return out.withColumn("changed", changed).select(
        *[n for n in boxes.columns if n not in "xywh"], "x", "y", "w", "h", "changed")


def align(boxes: DataFrame, mode: str, keys: list[str], order: str) -> DataFrame:
    """Boxes of a set aligned to its first box; sets of one box stay as they are."""
    spot = F.struct(F.col(order).alias("at"), "object_id")
    anchors = boxes.groupBy(*keys).agg(
        F.min_by(F.struct("x", "y", "w", "h"), spot).alias("a"), F.min(spot).alias("first"), F.count(F.lit(1)).alias("n"))
    joined = boxes.join(anchors, keys)
    c = F.col
    moves = {
        "left": ("x", c("a.x")), "right": ("x", c("a.x") + c("a.w") - c("w")), "center": ("x", c("a.x") + (c("a.w") - c("w")) / 2),
        "top": ("y", c("a.y")), "bottom": ("y", c("a.y") + c("a.h") - c("h")), "middle": ("y", c("a.y") + (c("a.h") - c("h")) / 2),
    }
    axis, target = moves[mode]
    follows = (c("n") >= 2) & ~((c(order) == c("first.at")) & (c("object_id") == c("first.object_id")))
    return joined.withColumn(axis, F.when(follows, target).otherwise(c(axis))).select(*boxes.columns)


def distribute(boxes: DataFrame, axis: str, keys: list[str], width: int = 4096) -> DataFrame:
    """Inner boxes of a set spread evenly between its first and last box.

    Positions inside a set come from chunked numbering along the axis.
    """
    ends = boxes.groupBy(*keys).agg(F.min(axis).alias("start"), F.max(axis).alias("stop"), F.count(F.lit(1)).alias("n"))
    ranked = numbered(boxes, keys, [F.col(axis), F.col("object_id")], chunk_of(F.col(axis), width), "rank")
    joined = ranked.join(ends, keys)
    inner = (F.col("n") >= 3) & (F.col("rank") > 1) & (F.col("rank") < F.col("n"))
    step = (F.col("stop") - F.col("start")) / (F.col("n") - 1)
    return joined.withColumn(axis, F.when(inner, F.col("start") + step * (F.col("rank") - 1)).otherwise(F.col(axis))).select(*boxes.columns)
