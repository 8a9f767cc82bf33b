"""Near duplicates by weighted Jaccard similarity: BagMinHash signatures (operator 2).

A text is the multiset of its five-word shingles. Each (shingle, weight) owns a Poisson
process over time and over the weight axis, which is cut into the blocks (0, 1], (1, 2], (2, 4],
(4, 8] ... and, inside a block, into unit levels. A point belongs to the text if its level is
within the shingle's count, and falls on one signature position at random; a position keeps
its earliest point. Two texts then agree at a position with exactly the probability of their
weighted Jaccard similarity. Points are generated in time order up to a horizon that fills all
positions for most texts; where one stays empty the horizon is doubled.

Signatures are cut into bands; see ``near_groups`` for buckets, verification and classes.

Defined results: a NULL text is a class of its own. Equal texts, empty ones too, are one class.
Texts under five words are one shingle; texts without words are like nothing but their copies.
NULL keys and repeated rows take part as they are; the class id is the least key of the class
that is not NULL. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.near_groups import near_classes, one_of_each
from folioscope.llm.shared import MASK, mixed

BANDS, ROWS = 20, 6
TIME, PLACE, BLOCK = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), 0xD1B54A32D192ED03
UNIT = 2.0**-53


def multiset(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(hashes, return_counts=True)


def _fill(best: np.ndarray, seeds: np.ndarray, counts: np.ndarray, block: int, horizon: float) -> None:
    """Earliest times per position from the processes of one block of the weight axis."""
    width = 1 if block == 0 else 1 << (block - 1)
    below = 0 if block == 0 else width
    seeds = mixed(seeds + np.uint64(block * BLOCK & MASK))
    times = np.zeros(len(seeds))
    expected = horizon * width
    chunk = math.ceil(expected + 2 * math.sqrt(expected))  # points of most processes: each further chunk is for the few that have more
    done = 0
    while len(seeds):
        draws = mixed(seeds[:, None] + np.arange(done + 1, done + chunk + 1, dtype=np.uint64) * TIME)
        waits = -np.log1p(-((draws >> np.uint64(11)).astype(np.float64) * UNIT)) / width
        points = np.cumsum(np.c_[times, waits], axis=1)[:, 1:]  # one sum from the start: the same times for every chunk length
        places = mixed(draws ^ PLACE)
        levels = below + 1 + (places & np.uint64(width - 1)).astype(np.int64)
        valid = (points <= horizon) & (levels <= counts[:, None])
        at = ((places[valid] >> np.uint64(32)) * np.uint64(len(best))) >> np.uint64(32)
        np.minimum.at(best, at.astype(np.int64), points[valid])
        going = points[:, -1] <= horizon
        seeds, counts, times = seeds[going], counts[going], points[going, -1]
        done += chunk


def signature(hashes: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray | None:
    """``size`` 32-bit integers for the multiset of shingle hashes; None if it is empty."""
    if not len(hashes):
        return None
    elements, counts = multiset(hashes)
    horizon = size * (math.log(size) + 4.5) / len(hashes)
    while True:
        best = np.full(size, np.inf)
        block = 0
        heavy = np.ones(len(elements), bool)
        while heavy.any():
            _fill(best, elements[heavy], counts[heavy], block, horizon)
            heavy = counts > (1 << block)
            block += 1
        if np.isfinite(best).all():
            return (mixed(best.view(np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        horizon *= 2


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    return near_classes(df.select(F.col(key).alias("key"), F.col(text).alias("text")), signature, multiset, BANDS, ROWS, threshold, slack=0.15)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """(key, class_id, copies): the near-duplicate class of every row, and how often its text occurs."""
    blank = df.where(F.col(text).isNull()).select(F.col(key).alias("key"), F.col(key).alias("class_id"), F.lit(1).cast("bigint").alias("copies"))
    return classes(df, key, text, threshold).select("key", "class_id", "copies").unionByName(blank).withColumnRenamed("key", key)


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """``df`` with one row of each near-duplicate class, the one with the least key; rows without text stay."""
    return one_of_each(df, classes(df, key, text, threshold), key, text)


def op2_bag_minhash(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
