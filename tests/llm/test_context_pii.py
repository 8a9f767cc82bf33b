"""Personal data: base spans by the plain patterns, bootstrapping by a plain version."""

import hashlib
import math
import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import context_pii as cp

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        odd = sum(int(d) for d in digits[::-2])
        even = sum(sum(map(int, str(2 * int(d)))) for d in digits[-2::-2])
        return 12 <= len(digits) <= 19 and (odd + even) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text) if valid(kind, m.group()))


def written(spans):
    return ",".join(f"{cp.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from(list("a9@.+-( )%4٣é\n0123456789")), max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert cp.base_spans(text) == plain(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["4111111111111111", "4111-1111 1111-1111", "+1 (212) 555-0100", "10.0.0.256", "1.2.3.4.5.6.7.8", "a.b@c.d@e.f", "@", "+", "x@y", " ", ", ", "77"]), max_size=12))
def test_base_spans_of_joined_pieces(pieces):
    text = "".join(pieces)
    assert cp.base_spans(text) == plain(text)


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 150_000, "1 " * 150_000, "a.b@" * 80_000, "0" * 9000 + ".1.1.1"):
        spans = cp.base_spans(text)
        cp.others(text, spans)
    assert cp.base_spans("0" * 9000 + ".1.1.1") == [(0, 1, 9006)]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, key int, row int, spans int")


def plain_members(texts, support=cp.SUPPORT, confidence=cp.CONFIDENCE):
    """The same rounds with dictionaries."""
    kind, may, at = {}, defaultdict(int), defaultdict(set)
    for text in texts:
        base = plain(text)
        for a, k, b in base:
            for p in cp.patterns(text, a, b):
                kind[p, text[a:b].lower()] = max(k, kind.get((p, text[a:b].lower()), -1))
                at[p].add(text[a:b].lower())
        for a, b in cp.others(text, base):
            for p in cp.patterns(text, a, b):
                kind.setdefault((p, text[a:b].lower()), -1)
                may[p, text[a:b].lower()] |= cp.forms(text[a:b])
                at[p].add(text[a:b].lower())
    members = {}
    for _ in range(cp.ROUNDS):
        doubt = defaultdict(lambda: [0.0] * 4)
        for p, strings in at.items():
            for k in range(4):
                many = sum(kind[p, s] == k or (kind[p, s] < 0 and may[p, s] and members.get(s) == k) for s in strings)
                trust = many / (len(strings) + 2)
                if many >= support and trust >= confidence:
                    for s in strings:
                        if kind[p, s] < 0 and may[p, s] & (1 << k):
                            doubt[s][k] += math.log1p(-trust)
        new = {}
        for s, d in doubt.items():
            score = [-math.expm1(x) for x in d]
            if max(score) >= confidence:
                new[s] = score.index(max(score))
        if len(new) == len(members):
            break
        members = new
    return members


def corpus():
    texts = [f"Please call the office at +1 (212) 555-01{i:02d} before noon. The code was {i}{i} today." for i in range(12)]
    texts += ["Please call the office at 212 555 0177 before noon.", "You may call the office at 030-1234567 for help.", "Then dial extension 030-1234567 or stop",
              "Meet in room 030-7654321 now"]
    texts += [f"write mail: user{i}@host{i}.example.org today" for i in range(12)] + ["write mail: someone(at)example.org today", "write mail: 44 today"]
    texts += [f"see the page {i * 1003} of it" for i in range(20)] + ["see the page 5550100200 of it"]
    texts += ["", "plain words only", texts[0], texts[0], "server 10.0.0.1 and card 4111 1111 1111 1111, é 10.0.0.999"]
    return texts


def test_rows_equal_a_plain_version(spark):
    texts = corpus()
    got = {r.doc_id: r for r in cp.personal(table(spark, [(i, t, 1, 2, 3) for i, t in enumerate(texts)])).collect()}
    members = plain_members(texts)
    assert members.get("212 555 0177") == 3 and members.get("030-1234567") == 3 and members.get("someone(at)example.org") == 0
    assert "5550100200" not in members and "030-7654321" not in members
    for i, text in enumerate(texts):
        base = plain(text)
        added = [(a, members[text[a:b].lower()], b) for a, b in cp.others(text, base) if text[a:b].lower() in members and cp.forms(text[a:b])]
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(written(base).encode()).hexdigest() and r.spans == written(base + added) and r.n_added == len(added)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]


def test_query_equals_plain_patterns(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = cp.op13_context_pii(spark, sf).collect()
    assert len(found) == len(docs)
    for r in found:
        base = plain(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(written(base).encode()).hexdigest()
        assert set(written(base).split(",")) <= set(r.spans.split(",")) or not base


def test_edges(spark):
    rows = [(None, "a@b.c", 1, 1, 1), (1, None, 1, 1, 1), (1, "", 1, 1, 1), (2, "x" * 200_000 + " a@b.c", 1, 1, 1), (2, "x" * 200_000 + " a@b.c", 1, 1, 1)]
    got = cp.personal(table(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.spans) for r in got) == [(0, "email:0:5"), (1, ""), (1, ""), (2, "email:200001:200006"), (2, "email:200001:200006")]
    assert cp.personal(table(spark, [])).collect() == []


def test_copies_give_no_support(spark):
    rows = [(i, "ask desk 7 +1 (212) 555-0100 now", 1, 1, 1) for i in range(30)] + [(99, "ask desk 7 212 555 0177 now", 1, 1, 1)]
    assert {r.n_added for r in cp.personal(table(spark, rows)).collect()} == {0}
