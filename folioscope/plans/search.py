"""Many patterns in many texts: each pattern is looked up by its rarest key.

Keys of a pattern are its inner words (a word with other characters on both sides, which must be
a whole word of any text that holds the pattern) or, where it has none, its runs of ``GRAM``
characters, or all of it if it is shorter. How many texts hold a key is counted on one text in ``SHARE``,
for keys of patterns only; the count decides which key a pattern is looked up by, never what is found. A word
that all texts share therefore joins nothing unless a pattern consists of it. Texts give up only the
kinds of keys that some pattern is looked up by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
GRAM, SHARE = 3, 16
INNER = rf"(?<=[^\p{{L}}\p{{N}}])({WORD})(?=[^\p{{L}}\p{{N}}])"


def _grams(text: Column, size: int) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))"), F.lit(1))


def pattern_keys(patterns: DataFrame) -> DataFrame:
    """``(pattern_id, kind, key)`` of patterns ``(pattern_id, needle)``; kind 0 are words, kind n runs of n characters."""
    words = F.regexp_extract_all("needle", F.lit(INNER), F.lit(1))
    runs = F.when(F.length("needle") >= GRAM, _grams(F.col("needle"), GRAM)).otherwise(F.array("needle"))
    by_word = F.size(words) > 0
    kind = F.when(by_word, 0).otherwise(F.least(F.length("needle"), F.lit(GRAM)))
    return patterns.select("pattern_id", kind.alias("kind"), F.explode(F.array_distinct(F.when(by_word, words).otherwise(runs))).alias("key"))


def _text_keys(texts: DataFrame, keep: list[str], kinds: Column) -> DataFrame:
    """``(keep, kind, key)`` of texts, for the kinds in the array."""
    some = texts.select(*keep, "text", kinds.alias("_kinds"))
    found = lambda kind, keys: F.when(F.array_contains("_kinds", kind), F.transform(
        F.array_distinct(keys), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))).otherwise(F.array())
    words = found(0, F.regexp_extract_all("text", F.lit(rf"({WORD})"), F.lit(1)))
    return some.select(*keep, F.inline(F.concat(words, *[found(n, _grams(F.col("text"), n)) for n in range(1, GRAM + 1)])))


def rarest(texts: DataFrame, patterns: DataFrame, ids: list[str]) -> DataFrame:
    """``(pattern_id, kind, key)``: the key by which each pattern is looked up."""
    keys = pattern_keys(patterns)
    kinds = keys.agg(F.collect_set("kind")).scalar()
    some = texts.filter(F.pmod(F.xxhash64(*ids), F.lit(SHARE)) == 0)
    counts = _text_keys(some, [], kinds).join(keys.select("kind", "key").distinct(), ["kind", "key"], "left_semi").groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.coalesce("n", F.lit(0)), -F.length("key"), "key")
    return keys.join(counts, ["kind", "key"], "left").groupBy("pattern_id").agg(F.min_by(F.struct("kind", "key"), order).alias("least")).select("pattern_id", "least.*")


def contained(texts: DataFrame, patterns: DataFrame, ids: list[str], keep: list[str] | None = None) -> DataFrame:
    """``(ids, pattern_id, keep)`` for every text that contains a pattern.

    ``texts``: ``ids, text`` and ``keep``; ``patterns``: ``pattern_id, needle``. An empty needle is in no text. Candidates meet
    their text again once, and only texts with candidates are sent.
    """
    asked = patterns.filter(F.col("needle") != "")
    chosen = rarest(texts, asked, ids).join(asked, "pattern_id")
    kinds = pattern_keys(asked).agg(F.collect_set("kind")).scalar()
    candidates = _text_keys(texts, ids, kinds).join(chosen, ["kind", "key"]).select(*ids, "pattern_id", "needle")
    return candidates.join(texts.select(*ids, "text", *(keep or [])), ids).filter(F.contains("text", F.col("needle"))).select(*ids, "pattern_id", *(keep or []))
