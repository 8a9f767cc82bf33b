"""Operations of a document applied one after the other: each meets what the one before left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.selectors import CRITERIA, Criterion, answers, fits, matches
from folioscope.plans.ordered import chunk_of, filled, numbered, previous
from folioscope.session import cut

SET, REPLACE = "setText", "replaceText"
LIST = 64
# Documents up to this size are edited in one row: objects, characters of their texts, operations.
OBJECTS, CHARACTERS, OPERATIONS = 4096, 1 << 22, 256


def waves(ops: DataFrame, depends: Column, chunk: int = 65536) -> DataFrame:
    """Adds ``wave``: operations of one wave cannot see each other's results.

    One that ``depends`` on texts is a wave of its own; those between two of these, which name
    their object, share one. Numbered in chunks of ``op_idx``, so a document with most operations is spread.
    """
    keyed = ops.withColumn("_depends", depends)
    lagged = previous(keyed, ["doc_id"], ["op_idx", "op_id"], chunk_of(F.col("op_idx"), chunk), {"_depends": "_before"})
    starts = lagged.withColumn("_starts", F.col("_depends") | F.coalesce("_before", F.lit(True)))
    firsts = numbered(starts.filter("_starts").select("doc_id", "op_id", "op_idx"), ["doc_id"], [F.col("op_idx"), F.col("op_id")],
                      chunk_of(F.col("op_idx"), chunk), "_wave").select("doc_id", "op_id", "_wave")
    marked = starts.join(firsts, ["doc_id", "op_id"], "left")
    return filled(marked, ["doc_id"], ["op_idx", "op_id"], chunk_of(F.col("op_idx"), chunk), "_wave", "wave").drop("_depends", "_before", "_starts", "_wave")


def apply_in_order(objects: DataFrame, ops: DataFrame, criteria: list[str]) -> tuple[DataFrame, DataFrame]:
    """Objects after all operations, and the outcome of each operation.

    ``objects``: ``doc_id, object_id, text`` and the ``criteria`` columns. ``ops``: ``op_id, doc_id, op_idx, op, object_id, equals,
    contains, old, new_text`` and the criteria. ``setText`` needs exactly one object that its selector
    matches at that point; ``replaceText`` changes every object that holds ``old``. Outcomes: ``applied``, ``SELECTOR_NOT_FOUND``,
    ``SELECTOR_AMBIGUOUS``; a failed operation changes nothing and later ones go on (``apply_batch`` decides what is kept).

    The objects and operations of a document come together once, in one row, and are edited there. Documents beyond ``OBJECTS``,
    ``CHARACTERS`` or ``OPERATIONS`` are edited in rounds, row by row.
    """
    crowded = _crowded(objects, ops)
    if crowded.isEmpty():
        return _in_place(objects, ops, criteria)
    apart = lambda how: (objects.join(crowded, "doc_id", how), ops.join(crowded, "doc_id", how), criteria)
    return tuple(a.unionByName(b.select(a.columns)) for a, b in zip(_in_place(*apart("left_anti")), _in_rounds(*apart("left_semi"))))


def _crowded(objects: DataFrame, ops: DataFrame) -> DataFrame:
    """Documents that are not edited in one row."""
    of_objects = objects.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.length("text")).alias("_chars"))
    of_ops = ops.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    return of_objects.filter((F.col("_n") > OBJECTS) | (F.col("_chars") > CHARACTERS)).select("doc_id").unionByName(
        of_ops.filter(F.col("_n") > OPERATIONS).select("doc_id")).distinct()


def _in_place(objects: DataFrame, ops: DataFrame, criteria: list[str]) -> tuple[DataFrame, DataFrame]:
    """``apply_in_order`` with the objects and the operations of a document as two lists."""
    rules = [CRITERIA.get(c, Criterion(c, (c,))) for c in criteria]
    formula = F.when(F.col("kind") == "cell", F.col("formula")) if {"kind", "formula"} <= set(objects.columns) else F.lit(None).cast("string")
    rows = objects.groupBy("doc_id").agg(F.collect_list(F.struct(F.struct(*[c for c in objects.columns if c != "doc_id"]).alias("row"), formula.alias("formula"), *[
        answers(rule, objects).alias(f"_v{i}") for i, rule in enumerate(rules)])).alias("_rows"))
    asked = [(F.lower(F.col(r.name).cast("string")) if r.fold else F.col(r.name).cast("string")).alias(f"_s{i}") for i, r in enumerate(rules)]
    id_type, at_type = (ops.schema[c].dataType.simpleString() for c in ("op_id", "op_idx"))
    lists = ops.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(
        "op_idx", "op_id", "op", F.col("object_id").cast("string").alias("_id"), "equals", "contains", "old", "new_text", *asked))).alias("_ops"))
    outs = f"array<struct<op_id: {id_type}, op_idx: {at_type}, outcome: string, match_count: bigint>>"
    let = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)

    def hit(op, text, r) -> Column:
        some = F.coalesce(op["_id"], op["equals"], op["contains"], *[op[f"_s{i}"] for i in range(len(rules))]).isNotNull()
        chosen = some & fits(op, r["row"]["object_id"], F.array_compact(F.array(text, r["formula"])), [r[f"_v{i}"] for i in range(len(rules))])
        return F.coalesce(F.when(op["op"] == SET, chosen).otherwise((op["old"] != "") & F.contains(text, op["old"])), F.lit(False))

    def step(state, op) -> Column:
        def after(hits, n) -> Column:
            outcome = F.when(n == 0, "SELECTOR_NOT_FOUND").when((op["op"] == SET) & (n > 1), "SELECTOR_AMBIGUOUS").otherwise("applied")
            change = lambda text: F.when(op["op"] == SET, op["new_text"]).otherwise(F.replace(text, op["old"], op["new_text"]))
            applied = (op["op"] != SET) | (n == 1)
            return F.struct(
                F.zip_with(state["texts"], hits, lambda text, h: F.when(h & applied, change(text)).otherwise(text)).alias("texts"),
                F.zip_with(state["edited"], hits, lambda e, h: e | (h & applied)).alias("edited"),
                F.concat(state["outs"], F.array(F.struct(op["op_id"].alias("op_id"), op["op_idx"].alias("op_idx"), outcome.alias("outcome"), n.alias("match_count")))).alias("outs"))

        hits = F.zip_with(state["texts"], "_rows", lambda text, r: hit(op, text, r))
        return let(hits, lambda h: let(F.size(F.filter(h, lambda x: x)).cast("bigint"), lambda n: after(h, n)))

    met = rows.join(lists, "doc_id", "full").select(
        "doc_id", F.coalesce("_rows", F.array().cast(rows.schema["_rows"].dataType)).alias("_rows"), F.coalesce("_ops", F.array().cast(lists.schema["_ops"].dataType)).alias("_ops"))
    start = F.struct(F.transform("_rows", lambda r: r["row"]["text"]).alias("texts"), F.transform("_rows", lambda r: F.lit(False)).alias("edited"), F.array().cast(outs).alias("outs"))
    done = met.select("doc_id", "_rows", F.aggregate("_ops", start, step).alias("s"))
    kept = [F.col("doc_id") if c == "doc_id" else F.col("z.t").alias("text") if c == "text" else F.col(f"z.r.row.{c}").alias(c) for c in objects.columns]
    zipped = F.arrays_zip(F.col("_rows").alias("r"), F.col("s.texts").alias("t"), F.col("s.edited").alias("e"))
    after = done.select("doc_id", F.explode(zipped).alias("z")).select(*kept, F.col("z.e").alias("edited"))
    return after, done.select("doc_id", F.inline("s.outs")).select("op_id", "doc_id", "op_idx", "outcome", "match_count")


def _in_rounds(objects: DataFrame, ops: DataFrame, criteria: list[str]) -> tuple[DataFrame, DataFrame]:
    """``apply_in_order`` by rounds.

    Which objects match while they are unchanged is found once, for all operations. The rounds then handle only
    changed objects and the matches of the operations whose turn it is: a document with k operations
    that depend on texts takes k rounds, all documents together, each cut off by a checkpoint.
    """
    is_set = F.col("op") == SET
    by_text = ~is_set | F.col("object_id").isNull()
    fields = ["op_id", "doc_id", "op_idx", "op", "object_id", "equals", "contains", "old", "new_text", *criteria]
    turns = cut(waves(ops.select(*fields), by_text))
    asked = turns.select(
        F.col("op_id").alias("selector_id"), "doc_id", F.when(is_set, F.col("object_id")).alias("object_id"), F.when(is_set, F.col("equals")).alias("equals"),
        F.when(is_set, F.col("contains")).otherwise(F.nullif("old", F.lit(""))).alias("contains"),
        *[F.when(is_set, F.col(c)).alias(c) for c in criteria])
    found = matches(objects, asked, criteria).withColumnRenamed("selector_id", "op_id")
    # The criteria of each match, and its text where it is to be replaced.
    described = found.join(objects.select("doc_id", "object_id", F.col("text").alias("was"), *criteria), ["doc_id", "object_id"])
    steps = turns.select("op_id", "op", "op_idx", "wave", "old", "new_text")
    hits = cut(described.join(steps, "op_id").withColumn("was", F.when(F.col("op") == REPLACE, F.col("was"))))
    last = turns.agg(F.max("wave")).first()[0] or 0
    changed = None
    outcomes = None
    for wave in range(1, last + 1):
        now = turns.filter(F.col("wave") == wave)
        fresh = hits.filter(F.col("wave") == wave)
        columns = ["op_id", "op", "op_idx", "doc_id", "object_id", *criteria, "was", "old", "new_text"]
        if changed is not None:
            c, o = changed.alias("c"), now.alias("o")
            agrees = reduce(lambda a, b: a & b, [F.col(f"o.{x}").isNull() | F.col(f"o.{x}").eqNullSafe(F.col(f"c.{x}")) for x in criteria], F.lit(True))
            some = reduce(lambda a, b: a | b, [F.col(f"o.{x}").isNotNull() for x in ("equals", "contains", *criteria)], F.lit(False))
            chosen = F.when(F.col("o.equals").isNotNull(), F.col("c.text") == F.col("o.equals")).otherwise(
                F.col("o.contains").isNull() | F.contains(F.col("c.text"), F.col("o.contains"))) & agrees & some
            meets = F.when(F.col("o.op") == REPLACE, (F.col("o.old") != "") & F.contains(F.col("c.text"), F.col("o.old"))).when(
                F.col("o.object_id").isNotNull(), F.col("o.object_id") == F.col("c.object_id")).otherwise(chosen)
            again = c.join(o, (F.col("c.doc_id") == F.col("o.doc_id")) & meets).select(
                "o.op_id", "o.op", "o.op_idx", "c.doc_id", "c.object_id", *[F.col(f"c.{x}") for x in criteria], F.col("c.text").alias("was"), "o.old", "o.new_text")
            fresh = fresh.join(changed, ["doc_id", "object_id"], "left_anti").select(*columns).unionByName(again)
        counts = fresh.groupBy("op_id").agg(F.count(F.lit(1)).alias("n"))
        n = F.coalesce("n", F.lit(0).cast("bigint"))
        outcome = F.when(n == 0, "SELECTOR_NOT_FOUND").when((F.col("op") == SET) & (n > 1), "SELECTOR_AMBIGUOUS").otherwise("applied")
        done = cut(now.select("op_id", "doc_id", "op_idx", "op").join(counts, "op_id", "left").select("op_id", "doc_id", "op_idx", outcome.alias("outcome"), n.alias("match_count")))
        outcomes = done if outcomes is None else outcomes.unionByName(done)
        text = F.when(F.col("op") == SET, F.col("new_text")).otherwise(F.replace("was", "old", "new_text"))
        new = fresh.join(done.filter("outcome = 'applied'").select("op_id"), "op_id", "left_semi").groupBy("doc_id", "object_id", *criteria).agg(
            F.max_by(text, F.struct("op_idx", "op_id")).alias("text"))
        changed = cut(new if changed is None else changed.join(new, ["doc_id", "object_id"], "left_anti").unionByName(new))
    if changed is None:
        changed = objects.limit(0).select("doc_id", "object_id", *criteria, "text")
        outcomes = ops.limit(0).select("op_id", "doc_id", "op_idx", F.lit("").alias("outcome"), F.lit(0).cast("bigint").alias("match_count"))
    edits = changed.select("doc_id", "object_id", F.col("text").alias("_text"), F.lit(True).alias("_changed"))
    after = objects.join(edits, ["doc_id", "object_id"], "left")
    kept = F.when(F.col("_changed"), F.col("_text")).otherwise(F.col("text"))
    return after.withColumn("edited", F.coalesce("_changed", F.lit(False))).withColumn("text", kept).drop("_text", "_changed"), outcomes


def replace_in_order(objects: DataFrame, ops: DataFrame, chunk: int = 65536) -> DataFrame:
    """Literal replacements in every text object, in operation order.

    Operations travel in lists of at most ``LIST``; a document with more takes another round over its objects per list.
    """
    ranked = numbered(ops.filter(F.col("old") != ""), ["doc_id"], [F.col("op_idx")], chunk_of(F.col("op_idx"), chunk), "_rank")
    part = F.floor((F.col("_rank") - 1) / LIST).cast("int")
    lists = cut(ranked.groupBy("doc_id", part.alias("_part")).agg(F.array_sort(F.collect_list(F.struct("_rank", "old", "new"))).alias("_steps")))
    out = objects.withColumn("_was", F.col("text"))
    for k in range((lists.agg(F.max("_part")).first()[0] or 0) + 1):
        mine = lists.filter(F.col("_part") == k).drop("_part")
        folded = F.aggregate("_steps", F.col("text"), lambda text, s: F.replace(text, s["old"], s["new"]))
        out = out.join(mine, "doc_id", "left").withColumn("text", F.coalesce(folded, "text")).drop("_steps")
    return out.withColumn("edited", F.col("text") != F.col("_was")).drop("_was")
