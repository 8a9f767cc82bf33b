"""Hard-negative mining by a vertical scan with branch and bound (operator 12).

Rows are dealt into blocks and each block is turned into columns, one per dimension. An anchor
reads the columns in the order of its own entries, largest magnitude first. After every few
columns, what the dimensions still unread can add at least and at most (from each column's
smallest and largest entry) bounds every candidate's score; candidates that cannot reach the
current k-th score or cannot end inside a window leave the bitmap. The scan ends with exact scores of what is left.

Two scans: the first finds each anchor's best rows of its own label, the second, for every
positive's window of scores, the best rows of other labels. Anchors are streamed past each block, so a
task holds one block and a batch of anchors; a block gives at most k rows per anchor or
window, and Spark ranks these. Labels are never grouped: a hot one is spread over all blocks.

Defined results: rows with a NULL id, a NULL label, a NULL vector, a NULL or non-finite component
or one of 2**18 or more in magnitude (its products could leave 64 bits) take no part, nor do empty
vectors. Vectors of different lengths have no product: each anchor meets those of its own length. Of rows with one
id the one with the smallest (label, vector) counts. Anchors without positives or windows without rows give no row. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import shared_table

SCALE = 256
LARGEST = float(1 << 18)
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
LEAST_ENTRIES, MOST_ENTRIES = 1 << 16, 1 << 24
STRIDE = 8


def prepared(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, label, x): usable rows with whole-number components, one per id."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v"), F.col(label).cast("long").alias("label"))
    usable = rows.where("key IS NOT NULL AND label IS NOT NULL AND size(v) > 0").where(F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < LARGEST)))
    shifted = F.when(F.col("key") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    whole = F.transform("v", lambda c: F.floor(c.cast("double") * SCALE).cast("int"))
    one = usable.select("key", F.struct(shifted.alias("label"), whole.alias("x")).alias("row")).groupBy("key").agg(F.min("row").alias("row"))
    return one.select("key", "row.label", "row.x")


class Block:
    """Rows of one block and length as columns, sorted by label and id."""

    def __init__(self, keys: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        order = np.lexsort((keys, labels))
        self.keys, self.labels = keys[order], labels[order]
        self.columns = np.ascontiguousarray(rows[order].T)
        self.least = self.columns.min(axis=1).astype(np.int64)
        self.most = self.columns.max(axis=1).astype(np.int64)
        self.reach = int(np.abs(self.columns).max(initial=0))

    def parts(self, label: int) -> tuple[slice, list[slice]]:
        """Rows of a label, and rows of all others."""
        a, b = np.searchsorted(self.labels, [label, label + 1])
        return slice(a, b), [slice(0, a), slice(b, len(self.keys))]

    def scanner(self, anchor: np.ndarray) -> "Scanner":
        return Scanner(self, anchor)


class Scanner:
    """One anchor's reading order and what the dimensions unread after each step can still add."""

    def __init__(self, block: Block, anchor: np.ndarray):
        self.block = block
        self.order = np.argsort(-np.abs(anchor), kind="stable")
        weights = anchor[self.order].astype(np.int64)
        a, b = weights * block.least[self.order], weights * block.most[self.order]
        self.low = np.r_[np.cumsum(np.minimum(a, b)[::-1])[::-1], 0]
        self.high = np.r_[np.cumsum(np.maximum(a, b)[::-1])[::-1], 0]
        small = int(np.abs(weights).sum()) * block.reach < 1 << 31
        self.kind = np.int32 if small else np.int64
        self.weights = weights.astype(self.kind)

    def scan(self, part: slice, keep) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``part`` that ``keep(lower, upper)`` never drops, and their scores.

        ``keep`` sees bounds of all candidates left and says which stay.
        """
        columns = self.block.columns
        alive = np.arange(part.start, part.stop)
        score = np.zeros(len(alive), self.kind)
        whole = True  # nothing dropped yet: columns are read as they lie
        steps = len(self.order)
        for at in range(0, steps, STRIDE):
            if not len(alive):
                break
            for k in range(at, min(at + STRIDE, steps)):
                column = columns[self.order[k], part] if whole else columns[self.order[k]][alive]
                score += column * self.weights[k]
            after = min(at + STRIDE, steps)
            stays = keep(score + self.low[after], score + self.high[after])
            if not stays.all():
                alive, score, whole = alive[stays], score[stays], False
        return alive, score.astype(np.int64)


def best(keys: np.ndarray, scores: np.ndarray, many: int) -> np.ndarray:
    """Positions of the ``many`` highest scores, ties by smaller key."""
    if len(scores) > 8 * many:
        cut = np.partition(scores, len(scores) - many)[len(scores) - many]
        near = np.flatnonzero(scores >= cut)
        return near[np.lexsort((keys[near], -scores[near]))[:many]]
    return np.lexsort((keys, -scores))[:many]


def top_same(block: Block, key: int, label: int, anchor: np.ndarray, many: int = POSITIVES) -> tuple[np.ndarray, np.ndarray]:
    """The block's ``many`` best rows of the anchor's own label, without itself."""
    part, _ = block.parts(label)

    def keep(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        if len(lower) <= many + 1:
            return np.ones(len(lower), bool)
        # One more than wanted, as the anchor may be among them.
        return upper >= np.partition(lower, len(lower) - many - 1)[len(lower) - many - 1]

    rows, scores = block.scanner(anchor).scan(part, keep)
    other = block.keys[rows] != key
    rows, scores = rows[other], scores[other]
    top = best(block.keys[rows], scores, many)
    return block.keys[rows[top]], scores[top]


def window(positive: int) -> tuple[int, int]:
    """Whole scores s with LOW * positive <= 100 * s <= HIGH * positive."""
    return -(-LOW * positive // 100), HIGH * positive // 100


def top_others(block: Block, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], many: int = NEGATIVES) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per window of scores the block's ``many`` best rows of other labels."""

    def keep(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        stays = np.zeros(len(lower), bool)
        for a, b in windows:
            touches = (upper >= a) & (lower <= b)
            sure = lower[(lower >= a) & (upper <= b)]  # these end inside
            if len(sure) >= many:
                touches &= upper >= np.partition(sure, len(sure) - many)[len(sure) - many]
            stays |= touches
        return stays

    scanner = block.scanner(anchor)
    found = [scanner.scan(p, keep) for p in block.parts(label)[1]] if windows else []
    rows = np.concatenate([r for r, _ in found]) if found else np.zeros(0, np.int64)
    scores = np.concatenate([s for _, s in found]) if found else np.zeros(0, np.int64)
    out = []
    for a, b in windows:
        inside = np.flatnonzero((scores >= a) & (scores <= b))
        top = inside[best(block.keys[rows[inside]], scores[inside], many)]
        out.append((block.keys[rows[top]], scores[top]))
    return out


def _matrix(column: pa.ListArray, rows: np.ndarray, size: int) -> np.ndarray:
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, size)


def _past_blocks(rows: DataFrame, anchors: DataFrame, blocks: int, step, schema: str, names: list[str], kinds: list) -> DataFrame:
    """``step(block, anchor batch row values)`` for every block of ``rows`` and every anchor.

    Rows go to the block of their id; anchors, the stated query set, go to every block. A block's rows come first in its partition,
    then the anchors stream past. Vectors of each length form a block of their own.
    """
    dealt = rows.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"),
                        "key", "label", "x", F.lit(None).cast("array<bigint>").alias("scores"))
    everywhere = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "key", "label", "x", "scores")
    lined_up = dealt.unionByName(everywhere).repartition(blocks, "block").sortWithinPartitions("block", "kind", "key")

    def run(batches):
        now, held, built = None, [], None

        def build() -> dict[int, Block]:
            """Blocks by vector length."""
            parts: dict[int, list] = {}
            for keys, labels, column in held:
                sizes = np.asarray(column.value_lengths())
                for size in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == size)
                    matrix = _matrix(column, at, size)
                    if np.abs(matrix).max(initial=0) < 1 << 15:
                        matrix = matrix.astype(np.int16)
                    parts.setdefault(size, []).append((keys[at], labels[at], matrix))
            return {size: Block(*(np.concatenate(p) for p in zip(*found))) for size, found in parts.items()}

        for batch in batches:
            block = batch.column("block").to_numpy()
            kind = batch.column("kind").to_numpy()
            # Stretches of one block and kind.
            edges = np.r_[0, np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1, len(block)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if a == b:
                    continue
                if block[a] != now:
                    now, held, built = block[a], [], None
                piece = batch.slice(a, b - a)
                keys, labels, column = piece.column("key").to_numpy(), piece.column("label").to_numpy(), piece.column("x")
                if kind[a] == 0:
                    held.append((keys, labels, column))
                    continue
                if built is None:
                    built, held = build(), []
                out: list[list] = [[] for _ in names]
                scores = piece.column("scores")
                for i in range(b - a):
                    anchor = column[i].values.to_numpy(zero_copy_only=False)
                    if len(anchor) in built:
                        given = None if not scores[i].is_valid else scores[i].as_py()
                        for name_values in step(built[len(anchor)], int(keys[i]), int(labels[i]), anchor, given):
                            for into, value in zip(out, name_values):
                                into.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return lined_up.mapInArrow(run, schema)


def _ranked(found: DataFrame, by: list[str], many: int) -> DataFrame:
    """The ``many`` best rows per group; Spark cuts each group before and after the exchange."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= many)


def _same(block: Block, key: int, label: int, anchor: np.ndarray, _):
    keys, scores = top_same(block, key, label, anchor)
    return [(key, k, s) for k, s in zip(keys.tolist(), scores.tolist())]


def _others(block: Block, key: int, label: int, anchor: np.ndarray, given: list[int]):
    positives = sorted(p for p in set(given) if window(p)[0] <= window(p)[1])  # equal positives share a window
    found = top_others(block, label, anchor, [window(p) for p in positives])
    return [(key, p, k, s) for p, (keys, scores) in zip(positives, found) for k, s in zip(keys.tolist(), scores.tolist())]


def mined(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor."""
    rows = shared_table(prepared(df, key, vector, label))
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = rows.agg(F.sum(F.size("x"))).first()[0] or 0
    # A task holds one block; blocks that are too small would only repeat every anchor's work.
    blocks = max(min(2 * spread, -(-entries // LEAST_ENTRIES)), -(-entries // MOST_ENTRIES), 1)
    anchors = rows.where(F.col("key") % ANCHOR_EVERY == 0)
    near = _past_blocks(rows, anchors.withColumn("scores", F.lit(None).cast("array<bigint>")), blocks, _same,
                        "anchor long, other long, score long", ["anchor", "other", "score"], [pa.int64()] * 3)
    positives = shared_table(_ranked(near, ["anchor"], POSITIVES).drop("rank"))
    asked = positives.groupBy("anchor").agg(F.collect_list("score").alias("scores"))  # five at most
    again = anchors.join(asked.withColumnRenamed("anchor", "key"), "key").select("key", "label", "x", "scores")
    far = _past_blocks(rows, again, blocks, _others, "anchor long, positive_score long, other long, score long",
                       ["anchor", "positive_score", "other", "score"], [pa.int64()] * 4)
    negatives = _ranked(far, ["anchor", "positive_score"], NEGATIVES)
    pairs = positives.withColumnsRenamed({"other": "positive_id", "score": "positive_score"})
    return pairs.join(negatives, ["anchor", "positive_score"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


# One score per anchor and row; windows and ranks as stated.
SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 256) AS BIGINT)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same,
         list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5),
n AS (
  SELECT p.anchor, positive_id, positive_score, s.other AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, positive_id ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor AS anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id,
       CAST(positive_score AS BIGINT) AS positive_score, CAST(negative_score AS BIGINT) AS negative_score
FROM n WHERE rank <= 3
"""


def op12_vertical_negatives(spark, sf_dir):
    return mined(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
