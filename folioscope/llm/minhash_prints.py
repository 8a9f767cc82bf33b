"""Document fingerprints by MinHash over word shingles (operator 3).

Every text is the set of its five-word shingles. 120 universal hash functions (an odd factor
and a summand modulo 2**64, the upper half kept) are applied to all shingles at once in numpy;
the minima are the signature, their low 16 bits the fingerprint. Equal texts have equal
fingerprints, and two fingerprints agree at a position with the probability of the texts'
Jaccard similarity. ``near_duplicates`` cuts signatures into bands, joins them and verifies the
Jaccard similarity on the texts; ``neighbour_prints`` compares each text with an edited form
and with the next document.

The next document is found without one global sort: keys are cut into ranges at approximate
quantiles, each range is sorted on its own, and the first row of every range is also sent to
the range before it. A text travels once.

Defined results: NULL and empty texts have the empty fingerprint; two empty fingerprints are
alike with 1.0, an empty and another one with 0.0. Texts under five words are one shingle.
NULL keys come first in the order, rows with equal keys follow in the order of their texts'
digests. In a table of one row the row follows itself; an empty table gives an empty table.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.near_groups import near_classes, node_of, one_of_each
from folioscope.llm.shared import Words, map_batches, mixed, shingles, texts_of

BANDS, ROWS = 20, 6
FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
SUMMANDS = mixed(np.arange(1001, 1001 + BANDS * ROWS, dtype=np.uint64))
BLOCK = 512
RANGES_PER_PARTITION = 4


def minima(hashes: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over the shingles."""
    low = np.full(len(FACTORS), (1 << 32) - 1, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        values = FACTORS[:, None] * hashes[None, at : at + BLOCK]
        values += SUMMANDS[:, None]
        low = np.minimum(low, values.min(axis=1) >> np.uint64(32))
    return low


def signature(hashes: np.ndarray) -> np.ndarray | None:
    return minima(hashes).astype(np.uint32).view(np.int32) if len(hashes) else None


def elements(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles as a set: each counts once."""
    found = np.unique(hashes)
    return found, np.ones(len(found), np.int64)


def printed(low: np.ndarray | None) -> np.ndarray:
    return np.zeros(0, np.uint16) if low is None else low.astype(np.uint16)


def alike(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) != len(b):
        return 0.0
    return float((a == b).mean()) if len(a) else 1.0


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every whole text."""

    def make():
        words = Words()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = []
            for x in texts_of(batch):
                hashes = shingles(words.of(x))
                found.append(printed(minima(hashes) if len(hashes) else None).tobytes().hex())
            return pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.string())], ["key", "fingerprint"])

        return step

    return map_batches(df.select(F.col(key).alias("key"), F.col(text).alias("text")), make, "key string, fingerprint string").withColumnRenamed("key", key)


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    return near_classes(df.select(F.col(key).alias("key"), F.col(text).alias("text")), signature, elements, BANDS, ROWS, threshold, slack=0.15)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """(key, class_id, copies): the near-duplicate class of every row, and how often its text occurs."""
    blank = df.where(F.col(text).isNull()).select(F.col(key).alias("key"), F.col(key).alias("class_id"), F.lit(1).cast("bigint").alias("copies"))
    return classes(df, key, text, threshold).select("key", "class_id", "copies").unionByName(blank).withColumnRenamed("key", key)


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """``df`` with one row of each near-duplicate class, the one with the least key; rows without text stay."""
    return one_of_each(df, classes(df, key, text, threshold), key, text)


class Pair:
    """A text's length, shingles and minima, and the same for its edited form."""

    def __init__(self, words: Words, key, text: str):
        self.key, self.text = key, text
        self.hashes = shingles(words.of(text))
        self.low = minima(self.hashes) if len(self.hashes) else None
        self.print = printed(self.low)

    def edited(self, words: Words, following: str) -> tuple[str, np.ndarray]:
        cut = len(self.text) // 4
        text = self.text[: len(self.text) - cut] + following[:cut]
        hashes = shingles(words.of(text))
        if not len(hashes):
            return text, printed(None)
        if np.array_equal(hashes, self.hashes):
            return text, self.print
        return text, printed(minima(hashes))


def neighbour_prints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranges = RANGES_PER_PARTITION * parts
    cuts = sorted({int(x) for x in docs.approxQuantile("key", [i / ranges for i in range(1, ranges)], 0.25 / ranges)})
    # Cuts and first rows are as many as there are ranges, whatever the table's size.
    place = F.coalesce(F.size(F.filter(F.array(*[F.lit(c).cast("bigint") for c in cuts]), lambda c: c <= F.col("key"))), F.lit(0)) if cuts else F.lit(0)
    place = F.when(F.col("key").isNull(), F.lit(-1)).otherwise(place)
    ranged = docs.select(place.alias("range"), "key", node_of(F.col("text")).alias("node"), "text")
    heads = ranged.groupBy("range").agg(F.min(F.struct("key", "node")).alias("head")).orderBy("range").collect()
    follows = [(heads[i - 1]["range"], h["range"], h["head"]["key"], bytes(h["head"]["node"])) for i, h in enumerate(heads)]
    told = F.broadcast(spark.createDataFrame(follows, "before int, range int, key bigint, node binary"))
    same = (ranged["range"] == told["range"]) & ranged["key"].eqNullSafe(told["key"]) & (ranged["node"] == told["node"])
    first = ranged.join(told, same).select(told["before"].alias("range"), ranged["key"], ranged["node"], ranged["text"], F.lit(True).alias("peek"))
    first = first.dropDuplicates(["range"])
    sorted_rows = (
        ranged.withColumn("peek", F.lit(False)).unionByName(first)
        .repartition(parts, "range").sortWithinPartitions("range", "peek", F.col("key").asc_nulls_first(), "node")
        .select("range", "peek", "key", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, last_range = Words(), None, None
        for batch in batches:
            out = []
            for where, peek, k, x in zip(*(batch.column(i).to_pylist() for i in range(4))):
                row = last if last is not None and last.text == x and last.key == k else Pair(words, k, x)
                if last is not None and last_range == where:
                    changed, changed_print = last.edited(words, x)
                    out.append((last.key, len(last.text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), last.print.tobytes().hex(),
                                changed_print.tobytes().hex(), alike(last.print, changed_print), alike(last.print, row.print)))
                last, last_range = (None, None) if peek else (row, where)
            if out:
                columns = list(zip(*out))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], NAMES)

    return sorted_rows.mapInArrow(run, "key bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("key", key)


NAMES = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def op3_minhash_prints(spark, sf_dir):
    return neighbour_prints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
