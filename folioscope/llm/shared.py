"""What the operators of this subpackage have in common: text batches, word hashes, written tables.

Words are maximal runs of code points other than space and U+0009..U+000D, which in UTF-8
are runs of bytes other than those six, so all word work happens on the encoded bytes.
"""

from __future__ import annotations

import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WORD = r"[^\x20\x09-\x0D]+"
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def shared_table(df: DataFrame) -> DataFrame:
    """Write ``df`` to the folder that ``spark.checkpoint.dir`` names and read it back.

    The lineage ends there, so a lost executor costs no earlier stage. Without the setting
    (tests on one machine) a scratch folder is used. The files go with the folder.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or _scratch(spark)
    path = f"{folder.rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _scratch(spark: SparkSession) -> str:
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the value as text, modulo ``divisor``; NULL for a NULL value."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(divisor)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, rows: int = 512) -> DataFrame:
    """``make()`` once per task, its result once per slice of at most ``rows`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the tasks make no cycles, and their tables are large
        try:
            step = make()
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    yield step(batch.slice(at, rows))
        finally:
            gc.enable()  # workers are used again

    found = StructType.fromDDL(schema)
    for name in ("key", "node"):  # passed through: their types may not be expressible in text
        if name in found.names and name in df.columns:
            found[name].dataType = df.schema[name].dataType
    return df.mapInArrow(run, found)


class Shipped:
    """A plain value broadcast to the workers; what is made of it there lasts for later tasks."""

    def __init__(self, spark: SparkSession, value):
        self.value = spark.sparkContext.broadcast(value)
        self.token = uuid.uuid4().hex

    def __reduce__(self):
        return Shipped._loaded, (self.value, self.token)

    @staticmethod
    def _loaded(value, token):
        out = Shipped.__new__(Shipped)
        out.value, out.token = value, token
        return out

    def state(self, make: Callable):
        """``make(value)``, once per Python worker; it goes when another value is asked for."""
        kept = sys.__dict__.setdefault("_folioscope_state", {})
        if self.token not in kept:
            kept.clear()
            kept[self.token] = make(self.value.value)
        return kept[self.token]


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """64-bit hashes of the words of a text, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, keep: np.ndarray | None = None, fold: np.ndarray | None = None):
        self.keep = ~SPACE if keep is None else keep
        values = np.arange(256, dtype=np.uint64) if fold is None else fold.astype(np.uint64)
        self.value = mixed((values + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        size = max(n + 1, 4096, 2 * len(self.powers))
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(size, BASE, np.uint64)])
            self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(size, BASE_INVERSE, np.uint64)])

    def spans(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes as an array, and where words start and end."""
        data = np.frombuffer(raw, np.uint8)
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = self.keep[data]
        steps = np.diff(inside)
        return data, np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.powers):
            self._grow(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.powers[: len(data)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def of(self, text: str) -> np.ndarray:
        return self.hashes(*self.spans(text.encode("utf-8", "surrogatepass")))


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of ``size`` words; a shorter text is one shingle, an empty one none."""
    n = len(words)
    if n == 0:
        return words
    width = min(size, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = mixed(out * np.uint64(BASE) + words[k : n - width + 1 + k])
    return out
