"""Near-duplicate classes from sketches: banding, verification on the texts, connected classes.

A sketch is an array of integers; two texts agree at a position with the probability of their
likeness. Texts that agree on all rows of a band meet in a bucket. No bucket is expanded into
pairs: its most connected member is the hub, every member is verified against the best hub
of its buckets first, and the verified links give classes. Only members of a bucket that are
then still in different classes can be compared, and two exact or nearly exact tests rule most
of them out inside the join: what two texts share beyond their common hub, and how often their
sketches agree. Exact copies are one node from the start.

Nodes are 128 bits of the text's SHA-256. Nothing is collected: steps that are read more than
once are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import Words, map_batches, shared_table, shingles


HARDLY = 0.3


def node_of(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b): label is the least node of its class.

    Alternating stars: every node hands its larger neighbours, then its smaller ones, to the
    least node it knows, until nothing changes.
    """
    edges = shared_table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = shared_table(small.select("e.*").where("u != v").distinct())
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if found == state:
            break
        state = found
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def agreement(a: Column, b: Column) -> Column:
    """Share of positions at which two sketches agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, int, np.ndarray]:
    """Sum of minima over sum of maxima of two multisets (sorted elements, counts), the former, and what a has beyond b."""
    if not len(a[0]) or not len(b[0]):
        return 0.0, 0, a[0]
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    other = np.where(b[0][at] == a[0], b[1][at], 0)
    common = int(np.minimum(a[1], other).sum())
    return common / (int(a[1].sum()) + int(b[1].sum()) - common), common, a[0][a[1] > other]


def compared(pairs: DataFrame, texts: DataFrame, elements: Callable) -> DataFrame:
    """(a, b, likeness, common, size, beyond): how alike two texts are by ``elements``.

    ``common`` is what a shares with b, ``size`` all of a, ``beyond`` the elements that a has more often than b. For
    texts that are hardly alike these three are NULL.
    """
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))

    def make():
        words, last = Words(), [None, None]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[], [], [], []]
            for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                if last[0] != y:  # the rows of a hub follow one another
                    last[:] = y, elements(shingles(words.of(y)))
                mine = elements(shingles(words.of(x)))
                alike, common, beyond = likeness(mine, last[1])
                near = alike >= HARDLY
                for column, value in zip(out, (alike, common if near else None, int(mine[1].sum()) if near else None, beyond.view(np.int64) if near else None)):
                    column.append(value)
            kinds = [pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), *(pa.array(c, t) for c, t in zip(out, kinds))], ["a", "b", "likeness", "common", "size", "beyond"])

        return step

    return map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right"), make,
                       "a binary, b binary, likeness double, common bigint, size bigint, beyond array<bigint>")


def near_classes(docs: DataFrame, sketch: Callable, elements: Callable, bands: int, rows: int, threshold: float, slack: float) -> DataFrame:
    """(key, node, class_id, copies, stays) for docs (key, text) with a text.

    ``sketch(shingle hashes)`` gives bands * rows integers. A pair that no hub decides is compared
    if its sketches agree on ``threshold - slack`` of the positions.
    """

    def make():
        words = Words()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [sketch(shingles(words.of(x))) for x in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("node"), pa.array(found, pa.list_(pa.int32()))], ["key", "node", "sketch"])

        return step

    named = docs.select("key", node_of(F.col("text")).alias("node"), "text")
    marked = shared_table(map_batches(named.where("text IS NOT NULL"), make, "key string, node binary, sketch array<int>"))
    nodes = shared_table(marked.groupBy("node").agg(F.min("key").alias("rep"), F.count("*").alias("copies"), F.first("sketch").alias("sketch")))

    keys = F.array(*[F.xxhash64(F.lit(i), F.slice("sketch", i * rows + 1, rows)) for i in range(bands)])
    banded = nodes.where("sketch IS NOT NULL").select("node", F.explode(keys).alias("band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = shared_table(banded.join(sizes, "band").select("band", "node", "n"))
    scores = members.groupBy("node").agg(F.sum("n").alias("score"))
    hubs = members.join(scores, "node").groupBy("band").agg(F.max(F.struct("score", "node")).alias("hub"))
    first = members.join(hubs, "band").groupBy("node").agg(F.max("hub").alias("hub")).select(F.col("node").alias("a"), F.col("hub.node").alias("b")).where("a != b")

    wanted = members.select("node").distinct().join(nodes.select("node", "rep"), "node")
    same = (named["node"] == wanted["node"]) & named["key"].eqNullSafe(wanted["rep"])
    texts = shared_table(named.join(wanted, same, "left_semi").select("node", "text").dropDuplicates(["node"]))

    tried = shared_table(compared(first, texts, elements))
    direct = tried.where(F.col("likeness") >= threshold).select("a", "b")
    labels = components(direct)
    open_members = members.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    homes = tried.select(F.col("a").alias("node"), F.col("b").alias("home"), "common", "size", "beyond")
    mark = F.xxhash64("label")
    undecided = open_members.groupBy("band").agg(F.min(mark).alias("x"), F.max(mark).alias("y")).where("x != y").select("band")
    left = shared_table(open_members.join(undecided, "band").join(nodes.select("node", "sketch"), "node").join(homes, "node", "left"))
    right = left.select("band", *[F.col(c).alias(f"{c}_b") for c in left.columns if c != "band"])
    # With nothing in common beyond the hub of both, two texts share at most what either shares with the hub.
    few = F.least("common", "common_b") < threshold / (1 + threshold) * (F.col("size") + F.col("size_b"))
    apart = (F.col("home") == F.col("home_b")) & few & ~F.arrays_overlap("beyond", "beyond_b")
    likely = (
        (F.col("node") < F.col("node_b")) & (F.col("label") != F.col("label_b"))
        & (agreement(F.col("sketch"), F.col("sketch_b")) >= threshold - slack) & ~F.coalesce(apart, F.lit(False)))
    rest = left.join(right, (left["band"] == right["band"]) & likely).select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()
    known_pairs = tried.select("a", "b").union(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = compared(rest.join(known_pairs, ["a", "b"], "left_anti"), texts, elements)
    links = direct.union(more.where(F.col("likeness") >= threshold).select("a", "b"))

    # The class is named after its least key that is not NULL; that row is the one that stays.
    chosen = F.struct(F.col("rep").isNull().alias("blank"), F.col("rep").alias("rep"), F.col("node").alias("node"))
    classed = nodes.select("node", "rep", "copies").join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = classed.groupBy("label").agg(F.min(chosen).alias("chosen"))
    known = classed.join(least, "label").select("node", "copies", F.col("chosen.rep").alias("class_id"), F.col("chosen.node").alias("stays"))
    told = marked.select("key", "node").join(known, "node")
    return told.select("key", "node", "class_id", "copies", ((F.col("node") == F.col("stays")) & F.col("key").eqNullSafe(F.col("class_id"))).alias("stays"))


def one_of_each(df: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``df`` that stay by ``found`` (:func:`near_classes`), one of each class; rows without text stay."""
    staying = found.where("stays").select(F.col("key").alias("k"), F.col("node").alias("n")).distinct()
    rows = df.select(F.struct("*").alias("row"), F.col(key).alias("key"), node_of(F.col(text)).alias("node"))
    same = rows["key"].eqNullSafe(staying["k"]) & (rows["node"] == staying["n"])
    kept = rows.join(staying, same, "left_semi").groupBy("key", "node").agg(F.first("row").alias("row"))
    return kept.select("row.*").union(df.where(F.col(text).isNull()))
