"""Operations in order, against a plain loop."""

import random

from folioscope.operators import sequence

OPS = "op_id string, doc_id int, op_idx int, op string, object_id string, equals string, contains string, old string, new_text string, slide int"


def plain(objects, ops):
    state = {(d, o): [t, s] for d, o, t, s in objects}
    outcomes = {}
    for op_id, d, _, op, oid, eq, has, old, new, slide in sorted(ops, key=lambda x: (x[1], x[2], x[0])):
        mine = [(k, v) for k, v in state.items() if k[0] == d]
        if op == "replaceText":
            found = [k for k, v in mine if old and old in v[0]]
        elif oid is not None:
            found = [k for k, v in mine if k[1] == oid]
        elif eq is None and has is None and slide is None:
            found = []
        else:
            found = [k for k, v in mine if (eq is None or v[0] == eq) and (has is None or has in v[0]) and (slide is None or v[1] == slide)]
        if not found:
            outcomes[op_id] = "SELECTOR_NOT_FOUND"
        elif op == "setText" and len(found) > 1:
            outcomes[op_id] = "SELECTOR_AMBIGUOUS"
        else:
            outcomes[op_id] = "applied"
            for k in found:
                state[k][0] = state[k][0].replace(old, new) if op == "replaceText" else new
    return {k: v[0] for k, v in state.items()}, outcomes


def test_in_order_equals_a_loop(spark):
    r = random.Random(4)
    words = ["ab", "ba", "abc", "c", "a b", "bb"]
    objects = [(d, f"o{i}", " ".join(r.choices(words, k=r.randint(1, 2))), i % 2) for d in range(6) for i in range(4)]
    ops = []
    for d in range(7):  # document 6 does not exist
        for k in range(r.randint(0, 9)):
            kind = r.choice(["id", "eq", "has", "slide", "none", "rep"])
            ops.append((f"{d}-{k}", d, k // 2 if d == 1 else k, "replaceText" if kind == "rep" else "setText", f"o{r.randint(0, 4)}" if kind == "id" else None,
                        r.choice(words) if kind == "eq" else None, r.choice("abc") + r.choice(["", "b"]) if kind == "has" else None,
                        r.choice(["a", "b", "", "zz"]) if kind == "rep" else None, r.choice(words), r.randint(0, 1) if kind in ("slide", "has") and r.random() < 0.5 else None))
    want, outcomes = plain(objects, ops)
    after, got = sequence.apply_in_order(spark.createDataFrame(objects, "doc_id int, object_id string, text string, slide int"), spark.createDataFrame(ops, OPS), ["slide"])
    assert {(x.doc_id, x.object_id): x.text for x in after.collect()} == want
    assert {x.op_id: x.outcome for x in got.collect()} == outcomes and {"applied", "SELECTOR_NOT_FOUND", "SELECTOR_AMBIGUOUS"} == set(outcomes.values())


def test_large_documents_equal_a_loop(spark, monkeypatch):
    for name, most in (("OBJECTS", 0), ("CHARACTERS", 9), ("OPERATIONS", 4)):
        with monkeypatch.context() as m:
            m.setattr(sequence, name, most)
            test_in_order_equals_a_loop(spark)


def test_documents_are_edited_without_rounds(spark, monkeypatch):
    """Rounds would write the changed texts once each."""
    written = []
    monkeypatch.setattr(sequence, "cut", lambda df: written.append(df) or df.localCheckpoint())
    ops = [(str(k), 1, k, "replaceText" if k % 2 else "setText", None, None if k % 2 else f"t{k}", None, "t", f"t{k + 2}" if k % 2 == 0 else "t", None) for k in range(6)]
    objects = spark.createDataFrame([(1, "o1", "t0", 0), (2, "o1", "t0", 0), (1, "o2", None, 0)], "doc_id int, object_id string, text string, slide int")
    after, got = sequence.apply_in_order(objects, spark.createDataFrame(ops, OPS), ["slide"])
    assert sorted(tuple(r) for r in after.select("doc_id", "object_id", "text", "edited").collect()) == [(1, "o1", "t6", True), (1, "o2", None, False), (2, "o1", "t0", False)]
    assert {r.outcome for r in got.collect()} == {"applied"} and not written


def test_operations_on_named_objects_share_a_wave(spark):
    ops = [(str(k), 1, k, "setText", "o1", None, None, None, f"t{k}", None) for k in range(40)] + [("x", 1, 40, "setText", None, "t39", None, None, "end", None)]
    table = spark.createDataFrame(ops, OPS)
    waves = sequence.waves(table, table.object_id.isNull(), chunk=7)
    assert {r.wave for r in waves.filter("object_id IS NOT NULL").collect()} == {1} and waves.filter("object_id IS NULL").first().wave == 2
    after, got = sequence.apply_in_order(spark.createDataFrame([(1, "o1", "a", 0)], "doc_id int, object_id string, text string, slide int"), table, ["slide"])
    assert [r.text for r in after.collect()] == ["end"] and {r.outcome for r in got.collect()} == {"applied"}


def test_no_operations(spark):
    objects = spark.createDataFrame([(1, "o1", "a", 0)], "doc_id int, object_id string, text string, slide int")
    after, got = sequence.apply_in_order(objects, spark.createDataFrame([], OPS), ["slide"])
    assert [(r.text, r.edited) for r in after.collect()] == [("a", False)] and got.collect() == []


def test_many_replacements_travel_in_lists(spark):
    objects = spark.createDataFrame([(1, "o1", "n0"), (2, "o2", "n0")], "doc_id int, object_id string, text string")
    ops = spark.createDataFrame([(1, k, f"n{k}", f"n{k + 1}") for k in range(200)], "doc_id int, op_idx int, old string, new string")
    assert {(r.doc_id, r.text, r.edited) for r in sequence.replace_in_order(objects, ops).collect()} == {(1, "n200", True), (2, "n0", False)}
