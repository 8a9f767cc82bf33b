"""Personal data: patterns of the four kinds, and identifiers found by bootstrapped contexts (operator 13).

Base spans come from fixed patterns (e-mail, IP, card with Luhn, phone). They are the seeds. What a seed
stands in, the word before it, the two before, the words on both sides, are lexical patterns; so are the contexts of
all other strings with digits or an at sign, also written out. Spark holds the graph of (pattern, string) and scores it in rounds: a pattern is
trusted for a kind if at least ``SUPPORT`` different strings of the kind stand in it and make up ``CONFIDENCE`` of
all strings there (smoothed by two); a string whose form allows the kind and whose trusted patterns
together (noisy-or) reach ``CONFIDENCE`` becomes a member of it and counts in the next round, until nothing is
added or ``ROUNDS`` are over. All places of a member become spans.

Strings are counted once however often they occur, so copies of a text give a pattern no weight. Context is
what lies within ``NEAR`` characters; words with a digit count as ``#``. Identity of
patterns and strings is a 64-bit hash.

Defined results: counts and digest are those of the base spans, ``spans`` has the added ones too. NULL and empty
texts have no spans. Repeated rows and NULL ids are treated like others; of equally strong kinds the
first wins; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import map_batches, shared_table, texts_of

KINDS = ("email", "ip", "card", "phone")
SUPPORT, CONFIDENCE, ROUNDS, NEAR = 5, 0.7, 10, 100

# Each runs once over a text, in time linear in its length: a start inside a run of digits fails at once.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TELLING = re.compile(r"[0-9@]+|[(\[]at[)\]]", re.IGNORECASE)
TRIMMED = ".,;:!?\"'<>[]{}"
LABEL = re.compile(r"[A-Za-z_]+[:=]")
NUMBERS = frozenset("0123456789().+-")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the longest run before an at sign, and the domain behind it."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append((start, end))
        else:
            end = max(end, at + 1)  # no match can go over this at sign
        at = text.find("@", end)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        found = m.group()
        if len(found) >= 12 and 12 <= len(digits := found.replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def forms(string: str) -> int:
    """Which kinds a string could be of, as bits."""
    digits = sum("0" <= c <= "9" for c in string)
    lower = string.lower()
    out = 0
    if any(c.isalpha() for c in lower) and ("@" in lower or "(at)" in lower or "[at]" in lower):
        out |= 1
    if digits and re.fullmatch(r"[0-9a-f.:]+", lower) and lower.count(".") + lower.count(":") >= 2:
        out |= 2
    if digits >= 6 and all(c in NUMBERS or c == " " for c in string):
        out |= 8 | (4 if digits >= 8 else 0)
    return out


def others(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Strings with digits or an at sign outside the base spans; groups of numbers next to each other are one."""
    covered, last = [], 0
    for a, _, b in taken:
        if b > last:
            covered.append((max(a, last), b))
            last = b
    out: list[tuple[int, int]] = []
    fences = iter([*covered, (len(text), len(text))])
    left, (right, after) = 0, next(fences)
    numeric = False  # the last string is a number
    for m in TELLING.finditer(text):
        at = m.start()
        while at >= right and right < len(text):
            left, (right, after) = after, next(fences)
        if at < left or (out and at < out[-1][1]):
            continue
        start, end = at, m.end()
        while start > left and not text[start - 1].isspace():
            start -= 1
        while end < right and not text[end].isspace():
            end += 1
        label = LABEL.match(text, start, at)
        if label:
            start = label.end()
        number = NUMBERS.issuperset(text[start:end])
        if number and numeric and out[-1][1] + 1 == start and text[start - 1] == " " and start - 1 >= left:
            out[-1] = out[-1][0], end
        else:
            out.append((start, end))
        numeric = number
    trimmed = []
    for a, b in out:
        while a < b and text[a] in TRIMMED:
            a += 1
        while b > a and text[b - 1] in TRIMMED:
            b -= 1
        if a < b:
            trimmed.append((a, b))
    return trimmed


def _word(word: str) -> str:
    return "#" if any("0" <= c <= "9" for c in word) else word.lower()


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical contexts of a span; those without a letter on the left are none."""
    before = list(map(_word, text[max(0, start - NEAR) : start].split()[-2:]))
    after = list(map(_word, text[end : end + NEAR].split()[:1]))
    if not before or not any(c.isalpha() for c in before[-1]):
        return []
    out = ["1 " + before[-1]]
    if len(before) == 2:
        out.append("2 " + " ".join(before))
    if after and any(c.isalpha() for c in after[0]):
        out.append("3 " + before[-1] + " " + after[0])
    return out


def identity(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
PLACE = pa.struct([("string", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
EDGE = pa.struct([("pattern", pa.int64()), ("string", pa.int64()), ("kind", pa.int32()), ("forms", pa.int32())])


def scanned(docs: DataFrame) -> DataFrame:
    """(key, base, places, edges) of docs (key, text): base spans, other strings, and the contexts of both."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            bases, places, edges = [], [], []
            for text in texts_of(batch):
                base, place, edge = [], [], []
                if TELLING.search(text):
                    base = base_spans(text)
                    for a, kind, b in base:
                        string = identity(text[a:b].lower())
                        edge += [{"pattern": identity(p), "string": string, "kind": kind, "forms": 0} for p in patterns(text, a, b)]
                    for a, b in others(text, base):
                        string, may = identity(text[a:b].lower()), forms(text[a:b])
                        edge += [{"pattern": identity(p), "string": string, "kind": -1, "forms": may} for p in patterns(text, a, b)]
                        if may:
                            place.append({"string": string, "start": a, "end": b})
                bases.append([{"start": a, "kind": k, "end": b} for a, k, b in base])
                places.append(place)
                edges.append(edge)
            return pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(bases, pa.list_(SPAN)), pa.array(places, pa.list_(PLACE)), pa.array(edges, pa.list_(EDGE))],
                ["key", "base", "places", "edges"])

        return step

    schema = ("key string, base array<struct<start: int, kind: int, end: int>>, places array<struct<string: bigint, start: int, end: int>>, "
              "edges array<struct<pattern: bigint, string: bigint, kind: int, forms: int>>")
    return map_batches(docs.select("key", "text"), make, schema)


def _per_kind(of) -> list[Column]:
    return [F.sum(of(k)).cast("double").alias(f"k{k}") for k in range(len(KINDS))]


def bootstrapped(edges: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """(string, kind): unseen strings that trusted patterns put into a kind; edges (pattern, string, kind, forms)."""
    spark = edges.sparkSession
    edges = shared_table(edges.groupBy("pattern", "string").agg(F.max("kind").alias("kind"), F.max("forms").alias("forms")))
    seeds = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *_per_kind(lambda k: F.when(F.col("kind") == k, 1).otherwise(0)))
    # Patterns that no kind could be trusted in, even if every other string there became its member, drop out.
    strong = F.greatest(*[F.col(f"k{k}") for k in range(len(KINDS))])
    rest = F.col("n") - sum((F.col(f"k{k}") for k in range(len(KINDS))), F.lit(0.0))
    seeds = shared_table(seeds.where((strong > 0) & (rest > 0) & (strong + rest >= support) & (strong + rest >= confidence * (F.col("n") + 2))))
    open_edges = shared_table(edges.where("kind < 0 AND forms > 0").join(seeds.select("pattern"), "pattern", "left_semi").select("pattern", "string", "forms"))
    members = spark.createDataFrame([], "string bigint, kind int")
    known = 0
    for _ in range(rounds):
        counts = seeds
        if known:
            won = open_edges.join(members, "string").groupBy("pattern").agg(
                *[F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"m{k}") for k in range(len(KINDS))])
            counts = seeds.join(won, "pattern", "left").select(
                "pattern", "n", *[(F.col(f"k{k}") + F.coalesce(f"m{k}", F.lit(0))).alias(f"k{k}") for k in range(len(KINDS))])
        trust = F.array(*[F.when((F.col(f"k{k}") >= support) & (F.col(f"k{k}") / (F.col("n") + 2) >= confidence), F.col(f"k{k}") / (F.col("n") + 2))
                          .otherwise(0.0) for k in range(len(KINDS))])
        trusted = counts.select("pattern", trust.alias("trust")).where(F.array_max("trust") > 0)
        votes = open_edges.join(trusted, "pattern")
        doubt = [F.sum(F.when(F.col("forms").bitwiseAND(1 << k) > 0, F.log1p(-F.col("trust")[k])).otherwise(0.0)).alias(f"d{k}") for k in range(len(KINDS))]
        scored = votes.groupBy("string").agg(*doubt)
        best = F.greatest(*[F.struct((-F.expm1(f"d{k}")).alias("score"), F.lit(-k).alias("kind")) for k in range(len(KINDS))])
        members = shared_table(scored.select("string", best.alias("best")).where(F.col("best.score") >= confidence).select(
            "string", (-F.col("best.kind")).cast("int").alias("kind")))
        many = members.count()
        if many == known:
            break
        known = many
    return members


def _is(kind: int):
    return lambda x: x == kind


def personal(df: DataFrame, key: str = "doc_id", text: str = "text", support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every whole text."""
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = shared_table(scanned(docs).withColumn("row", F.monotonically_increasing_id()))
    members = bootstrapped(rows.select(F.inline("edges")), support, confidence)
    places = rows.where(F.size("places") > 0).select("row", F.inline("places"))
    added = places.join(members, "string").groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))  # of one text
    none = F.array().cast("array<struct<start: int, kind: int, end: int>>")
    out = rows.drop("places", "edges").join(added, "row", "left").withColumn("added", F.coalesce("added", none))

    def written(spans: Column) -> Column:
        names = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    many = [F.size(F.filter(F.col("base.kind"), _is(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select(
        F.col("key").alias(key), *many, F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op13_context_pii(spark, sf_dir):
    return personal(spark.read.parquet(f"{sf_dir}/documents.parquet"))
