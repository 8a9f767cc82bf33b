"""Toxicity by multiple-instance learning (operator 8).

A document is a bag of sentences. A sentence's probability is logistic in the words it holds;
the document's is their noisy-or, one minus the product of the complements. Only documents
are labelled: the gradient of the document's likelihood reaches the sentences through the
noisy-or, so a toxic document's most suspect sentences take the blame, and the fitted model
locates offending sentences it never saw a label for.

Words are runs of letters and digits. In scripts that put no blanks between words, every one, two and three
neighbouring characters are words. Sentences end at a line feed and at the stops of all scripts.

The fit uses at most ``sample`` labelled documents of either class, chosen by hash, one row of each id and
the first ``excerpt`` characters of it. Words, as
64-bit hashes, whose share of toxic documents exceeds that of the others by ``SURE`` standard
errors become features; Spark counts them, and only their hits by sentence come to the driver,
where a short Adam run with decay fits their weights and the bias. Classes are weighted back to their true shares. Scoring covers every
whole text.

Defined results: NULL, empty and wordless texts score 0.0. Without labels of both classes all
texts score 0.0. A document with several labels counts as toxic if one says so. NULL labels and
NULL keys are not learned from; of rows with one id one is. Repeated rows are scored like others; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import Shipped, Words, map_batches, remainder, shared_table, texts_of

SAMPLE, EXCERPT = 3000, 100_000
SURE, LEAST = 5.0, 4
THRESHOLD = 0.7
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256)
LOWER[65:91] += 32
STOPS = np.zeros(256, np.int64)
STOPS[[10, 33, 46, 63]] = 1  # line feed ! . ?
# Stops beyond ASCII, as code points.
WIDE_STOPS = np.array([0x0589, 0x061F, 0x06D4, 0x0964, 0x0965, 0x104A, 0x104B, 0x1362, 0x17D4, 0x17D5, 0x2026, 0x203C, 0x2047, 0x2048, 0x2049,
                       0x3002, 0xFE52, 0xFF01, 0xFF0E, 0xFF1F, 0xFF61])
# Scripts without blanks between words (Thai and Lao, Tibetan, Myanmar, Khmer, kana, Han).
UNSPACED = [(0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF),
            (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xF900, 0xFAFF), (0xFF66, 0xFF9D), (0x20000, 0x3FFFF)]
# Blocks of signs that are no letters.
SIGNS = [(0x00A0, 0x00A9), (0x00AB, 0x00B1), (0x2000, 0x206F), (0x2190, 0x2BFF), (0x3000, 0x303F), (0xFE30, 0xFE6F), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20),
         (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)]
GRAMS = 3


def _within(points: np.ndarray, ranges: list[tuple[int, int]]) -> np.ndarray:
    edges = np.array(sorted(x for a, b in ranges for x in (a, b + 1)))
    return np.searchsorted(edges, points, "right") % 2 == 1


@dataclass
class Bag:
    """Words as hashes, the sentence of each, and each sentence's first and last byte."""

    feature: np.ndarray
    sentence: np.ndarray
    begins: np.ndarray
    ends: np.ndarray


class Bags:
    def __init__(self):
        self.words = Words(LETTERS, LOWER)

    def of(self, raw: bytes) -> Bag:
        data = np.frombuffer(raw, np.uint8)
        if (data >= 0xC2).any():
            starts, ends, stops = self._wide(raw, data)
        else:
            (_, starts, ends), stops = self.words.spans(raw), STOPS[data]
        if not len(starts):
            none = np.zeros(0, np.int64)
            return Bag(none.view(np.uint64), none, none, none)
        place = np.cumsum(stops)[starts]
        fresh = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        return Bag(self.words.hashes(data, starts, ends), np.cumsum(np.r_[True, place[1:] != place[:-1]]) - 1, starts[fresh], np.maximum.reduceat(ends, fresh))

    def _wide(self, raw: bytes, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words in order, and the stops, of a text beyond ASCII."""
        points = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]  # first byte of each character
        wide = points >= 128
        stop, dense = np.zeros(len(points), bool), np.zeros(len(points), bool)
        letter = LETTERS[np.minimum(points, 128)]
        beyond = points[wide]
        stop[wide], dense[wide] = np.isin(beyond, WIDE_STOPS), _within(beyond, UNSPACED)
        letter[wide] = ~(stop[wide] | _within(beyond, SIGNS))
        stop[~wide] = STOPS[points[~wide]] > 0
        dense &= letter
        steps = np.diff((letter & ~dense).astype(np.int8), prepend=0, append=0)
        starts, ends = [at[np.flatnonzero(steps == 1)]], [at[np.flatnonzero(steps == -1)]]
        run = dense.copy()
        for k in range(1, GRAMS + 1):
            first = np.flatnonzero(run)
            starts.append(at[first])
            ends.append(at[first + k])
            run = run[:-1] & dense[k:] if len(run) > 1 else run[:0]
        starts, ends = np.concatenate(starts), np.concatenate(ends)
        order = np.lexsort((ends, starts))
        stops = np.zeros(len(data), np.int64)
        stops[at[:-1][stop]] = 1
        return starts[order], ends[order], stops


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def noisy_or(probabilities: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-probabilities).sum())) if len(probabilities) else 0.0


def telling(sample: DataFrame) -> np.ndarray:
    """Words that occur in clearly more of the toxic documents than of the others; sample (toxic, text)."""

    def make():
        bags = Bags()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [np.unique(bags.of(x.encode("utf-8", "surrogatepass")).feature).view(np.int64) for x in texts_of(batch)]
            return pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.int64()))], ["toxic", "word"])

        return step

    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n, m = sizes.get(1, 0), sizes.get(0, 0)
    if not n or not m:
        return np.zeros(0, np.uint64)
    words = map_batches(sample, make, "toxic int, word array<bigint>").select("toxic", F.explode("word").alias("word"))
    counts = words.groupBy("word").agg(F.sum("toxic").alias("yes"), F.sum(1 - F.col("toxic")).alias("no"))
    share = (F.col("yes") + F.col("no")) / (n + m)
    error = F.sqrt(share * (1 - share) * (1 / n + 1 / m)) + 1e-12
    sure = counts.where((F.col("yes") >= LEAST) & ((F.col("yes") / n - F.col("no") / m) / error >= SURE))
    return np.sort(sure.select("word").toArrow().column("word").to_numpy().view(np.uint64))


def hits(known: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of known words, and which they are; ``known`` is sorted."""
    at = np.searchsorted(known, features)
    at[at == len(known)] = 0
    found = np.flatnonzero(known[at] == features) if len(known) else np.zeros(0, np.int64)
    return found, at[found]


def fit(known: int, features: np.ndarray, sentences: np.ndarray, documents: np.ndarray, labels: np.ndarray, weights: np.ndarray,
        steps: int = 200, rate: float = 0.15, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights of the ``known`` words and the bias. ``sentences`` is each hit's sentence, ``documents`` each sentence's document."""
    w, bias = np.zeros(known), -6.0
    first, second = np.zeros(known + 1), np.zeros(known + 1)
    many, total = len(documents), weights.sum()
    for step in range(1, steps + 1):
        p = sigmoid(bias + np.bincount(sentences, w[features], many))
        none = np.exp(np.maximum(np.bincount(documents, np.log1p(-p), len(labels)), -600.0))
        pull = weights * np.where(labels == 1, none / np.maximum(1.0 - none, 1e-9), -1.0) / total
        slope = p * pull[documents]
        gradient = np.r_[np.bincount(features, slope[sentences], known) - decay * w, slope.sum()]
        first += 0.1 * (gradient - first)
        second += 0.01 * (gradient**2 - second)
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-7)
        w, bias = w + move[:-1], bias + move[-1]
    return w, float(bias)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, excerpt: int = EXCERPT) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Fit on docs (key, text) with labels (key, toxic); None unless both classes occur."""
    known = labels.where("key IS NOT NULL AND toxic IS NOT NULL").groupBy("key").agg(F.max("toxic").alias("toxic")).where("toxic IN (0, 1)")
    shares = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(shares) < 2:
        return None
    picked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("key"), "key").limit(sample) for y in (0, 1)]
    chosen = F.broadcast(picked[0].union(picked[1]))  # 2 * sample rows

    part = F.substring(F.coalesce("text", F.lit("")), 1, excerpt)
    one = docs.join(chosen, "key").groupBy("key").agg(F.first(F.col("toxic").cast("int")).alias("toxic"), F.min(part).alias("text"))
    rows = shared_table(one.select("toxic", "text"))
    known = telling(rows)
    shipped = Shipped(docs.sparkSession, known)

    def make():
        bags = Bags()
        words = shipped.state(lambda x: x)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            features, sentences, sizes = [], [], []
            for x in texts_of(batch):
                bag = bags.of(x.encode("utf-8", "surrogatepass"))
                found, which = hits(words, bag.feature)
                features.append(which.astype(np.int32))
                sentences.append(bag.sentence[found].astype(np.int32))
                sizes.append(len(bag.begins))
            lists = [pa.array(features, pa.list_(pa.int32())), pa.array(sentences, pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(sizes, pa.int32()), *lists], ["toxic", "size", "feature", "sentence"])

        return step

    got = map_batches(rows, make, "toxic int, size int, feature array<int>, sentence array<int>").toArrow()
    y, sizes = got.column("toxic").to_numpy(), got.column("size").to_numpy()
    if len(np.unique(y)) < 2 or not sizes.sum():
        return None
    starts = np.cumsum(sizes) - sizes
    features = np.concatenate([x.values.to_numpy() for x in got.column("feature")])
    sentences = np.concatenate([x.values.to_numpy() + start for x, start in zip(got.column("sentence"), starts)])
    weight = np.where(y == 1, shares[1] / (y == 1).sum(), shares[0] / (y == 0).sum())
    w, bias = fit(len(known), features, sentences, np.repeat(np.arange(len(y)), sizes), y, weight)
    return known, w, bias


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float] | None, spots: bool = False, threshold: float = 0.5) -> DataFrame:
    """(key, score) of every text; with ``spots`` also the offending sentences as code point spans."""
    shipped = Shipped(docs.sparkSession, model)

    def make():
        bags = Bags()
        value = shipped.state(lambda x: x)

        def sentences(bag: Bag) -> np.ndarray:
            if value is None or not len(bag.begins):
                return np.zeros(0)
            known, w, bias = value
            found, which = hits(known, bag.feature)
            return sigmoid(bias + np.bincount(bag.sentence[found], w[which], len(bag.begins)))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores, found = [], []
            for x in texts_of(batch):
                raw = x.encode("utf-8", "surrogatepass")
                bag = bags.of(raw)
                p = sentences(bag)
                scores.append(noisy_or(p))
                if spots:
                    found.append([{"start": len(raw[: bag.begins[i]].decode("utf-8", "replace")), "end": len(raw[: bag.ends[i]].decode("utf-8", "replace")), "score": float(p[i])}
                                  for i in np.flatnonzero(p >= threshold)])
            columns = [batch.column("key"), pa.array(scores, pa.float64())]
            if not spots:
                return pa.RecordBatch.from_arrays(columns, ["key", "score"])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            return pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], ["key", "score", "spots"])

        return step

    more = ", spots array<struct<start: int, end: int, score: double>>" if spots else ""
    return map_batches(docs.select("key", "text"), make, f"key string, score double{more}")


def toxicity(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(key, held_out, score, predicted, n_spots): learned from rows whose crc32 remainder by 3 is not 1."""
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    told = labels.select(F.col(key).alias("key"), "toxic").where(remainder("key", 3) != 1)
    out = scored(docs, train(docs, told, sample), spots=True)
    return out.select(
        F.col("key").alias(key), F.coalesce(remainder("key", 3) == 1, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), F.size("spots").alias("n_spots"))


def op8_toxic_sentences(spark, sf_dir):
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
