"""Quality rules from tokeniser fertility, beside plain counts (operator 9).

Public vocabularies are the yardstick: text like what they were made from needs few tokens,
noise needs many. Per text, over its words: characters per token of a piece vocabulary and of
a byte-level vocabulary, the share of tokens that fall back to single bytes, and the entropy
of the token distribution against that of equally many distinct tokens. A text is rejected if
a measure lies outside its group's band. The group is the language, or the main script where
no language is given. A band reaches ``REACH`` interquartile ranges beyond the quartiles of
the group's texts that pass the plain rules, at least ``FLOOR`` to either side; the quartiles
come from all documents. A group of under ``FEW`` texts takes the bands of all texts.

Plain counts use words between the six blank characters; see ``counts``.

Defined results: NULL and empty texts have no words, fail the plain rules and are not kept.
NULL and empty languages are grouped by script; texts without letters form the group ``Zyyy``. Repeated rows
count each time; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import unicodedata

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm import piece_codec
from folioscope.llm.shared import Shipped, Words, map_batches, shared_table, shingles, texts_of

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MEASURES = ("piece_chars", "byte_chars", "fallback_share", "entropy")
FLOOR = {"piece_chars": 0.2, "byte_chars": 0.2, "fallback_share": 0.02, "entropy": 0.05}
REACH, PRIOR = 3.0, 100
REMEMBERED, SHORT = 400_000, 48
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def byte_vocabulary() -> tuple[str, list[tuple[str, int]]]:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")) as lines:
        return public_tokenizers.PATTERN, [(a, int(b)) for a, b in map(str.split, lines)]


def counts(words: Words, raw: bytes) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, and words in repeated three-word windows."""
    data, starts, ends = words.spans(raw)
    n = len(starts)
    if not n:
        return 0, 0, int(SYMBOLS[data].sum()), 0, 0
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    hashes = words.hashes(data, starts, ends)
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            dup += line in seen
            seen.add(line)
    repeated = 0
    if n >= 3:
        windows = shingles(hashes, 3)
        ordered = np.sort(windows)
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(again):
            twice = np.isin(windows, again)
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= twice
            repeated = int(covered.sum())
    return n, int((points[ends] - points[starts]).sum()), int(SYMBOLS[data].sum()), dup, repeated


class Costs(dict):
    """Of a word (UTF-8): its piece ids as bytes, and its tokens in a byte-level vocabulary with the blank before it."""

    def __init__(self, model: bytes, value: tuple[str, list[tuple[str, int]]]):
        super().__init__()
        ranks = {base64.b64decode(a): b for a, b in value[1]}
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.encode = tiktoken.Encoding("bytes", pat_str=value[0], mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.spelled = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])

    def of(self, words: list[bytes]) -> list[tuple[bytes, int]]:
        """The costs of all words; unknown ones are encoded together, and short ones remembered."""
        new = [w for w in set(words) if w not in self]
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = list(set(words))
        texts = [w.decode("utf-8", "replace") for w in new]
        for word, text, ids in zip(new, texts, self.pieces.encode(texts, num_threads=1)):
            self[word] = np.array(ids, "<u4").tobytes(), len(self.encode(" " + text))
        found = [self[w] for w in words]
        for word in new:
            if len(word) > SHORT:
                del self[word]
        return found


@functools.lru_cache(1 << 16)
def script_of(letter: str) -> str:
    """First word of the character's Unicode name: LATIN, CYRILLIC, CJK ..."""
    return unicodedata.name(letter, "Zyyy").split(" ")[0].split("-")[0].title()


def main_script(text: str) -> str:
    found: dict[str, int] = {}
    if text.isascii():
        return "Latin" if any(map(str.isalpha, text)) else "Zyyy"
    for c in set(text):
        if c.isalpha():
            name = script_of(c)
            found[name] = found.get(name, 0) + text.count(c)
    return max(sorted(found), key=found.get) if found else "Zyyy"


def measured(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", model: str | None = None) -> DataFrame:
    """(key, band, script, counts, measures) of every whole text."""
    spark = df.sparkSession
    with open(model or piece_codec.default_model(), "rb") as file:
        shipped = Shipped(spark, (file.read(), byte_vocabulary()))

    def make():
        words = Words()
        costs = shipped.state(lambda v: Costs(*v))
        spelled = costs.spelled

        def measures(raw: bytes, chars: int) -> tuple:
            found = costs.of(raw.split())
            ids = np.frombuffer(b"".join([a for a, _ in found]), "<u4")
            if not len(ids):
                return None, None, None, None
            many = np.unique(ids, return_counts=True)[1] / len(ids)
            entropy = float(-(many * np.log2(many)).sum() / np.log2(len(ids))) if len(ids) > 1 else 0.0
            return chars / len(ids), chars / sum([n for _, n in found]), float(spelled[ids].mean()), entropy

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for x, name in zip(texts_of(batch), batch.column("lang").to_pylist()):
                raw = x.encode("utf-8", "surrogatepass")
                found = counts(words, raw)
                script = main_script(x)
                rows.append((name or script, script, *found, *measures(raw, found[1])))
            columns = list(zip(*rows)) if rows else [()] * 11
            kinds = [pa.string(), pa.string(), *[pa.int64()] * 5, *[pa.float64()] * 4]
            return pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["key", "band", "script", *COUNTS, *MEASURES])

        return step

    narrow = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    schema = "key string, band string, script string, " + ", ".join([*(f"{c} bigint" for c in COUNTS), *(f"{m} double" for m in MEASURES)])
    return map_batches(narrow, make, schema)


def failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _quartiles(level: str) -> list[Column]:
    """The number of texts and quartiles of each measure, named after the ``level``."""
    ends = [F.percentile_approx(m, p, 10000).alias(f"{level}_{m}_{name}") for m in MEASURES for p, name in ((0.25, "low"), (0.75, "high"))]
    return [F.count(F.lit(1)).alias(f"{level}_n"), *ends]


def bands(rows: DataFrame) -> DataFrame:
    """(band, script, <measure>_low, <measure>_high) for every pair of group and script that passes the plain rules."""
    good = rows.where(~failed())
    pairs = good.groupBy("band", "script").agg(F.count(F.lit(1)).alias("n")).drop("n")
    every = good.agg(F.struct(*_quartiles("all")).alias("all")).scalar()
    tables = pairs.join(good.groupBy("band").agg(*_quartiles("own")), "band").join(good.groupBy("script").agg(*_quartiles("script")), "script")
    tables = tables.withColumn("all", every).select("*", "all.*")
    edges = []
    for m in MEASURES:
        wide = lambda level: F.col(f"{level}_{m}_high") - F.col(f"{level}_{m}_low")  # noqa: B023,E731
        drawn = lambda level, towards: (F.col(f"{level}_n") * wide(level) + PRIOR * towards) / (F.col(f"{level}_n") + PRIOR)  # noqa: B023,E731
        room = F.greatest(REACH * drawn("own", drawn("script", wide("all"))), F.lit(FLOOR[m]))
        edges += [(F.col(f"own_{m}_low") - room).alias(f"{m}_low"), (F.col(f"own_{m}_high") + room).alias(f"{m}_high")]
    return tables.select("band", "script", *edges)


def judged(rows: DataFrame) -> DataFrame:
    """Adds base_failed and kept to measured rows.

    The bands are written first: Spark then knows how small they are when it plans the join, and rows stay where they are.
    """
    limits = shared_table(bands(rows))
    joined = rows.join(limits, ["band", "script"], "left")
    inside = F.lit(True)
    for m in MEASURES:
        inside &= F.coalesce((F.col(m) >= F.col(f"{m}_low")) & (F.col(m) <= F.col(f"{m}_high")), F.lit(True))
    return joined.withColumn("base_failed", failed()).withColumn("kept", ~failed() & inside).drop(*limits.columns[2:])


def quality(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", model: str | None = None) -> DataFrame:
    """(key, counts, base_failed, kept, band, measures) of every text."""
    rows = shared_table(measured(df, key, text, lang, model))
    return judged(rows).select(F.col("key").alias(key), *COUNTS, "base_failed", "kept", "band", *MEASURES)


def op9_fertility_rules(spark, sf_dir):
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
