"""Language-model scores from a probabilistic suffix tree (operator 5).

Symbols are the bytes of a text with A-Z lower-cased, runs of blanks as one space, and an end
symbol. Spark counts every window of ``DEPTH`` context bytes and a next byte over all training
texts, and rolls the counts up level by level. A context stays in the tree if it occurs
``LEAST_COUNT`` times and if its next-symbol distribution diverges enough from that of its shorter
suffix: occurrences times divergence must reach ``LEAST_GAIN`` bits. Both are the same for every
corpus, so the tree grows with it and stays in tables. Distributions are smoothed into their
suffix's by the number of different followers.

A text's score is the sum of log10 probabilities, each from the longest suffix in the tree of what
precedes. The probability of every window that occurs in any text, learned from or not, is found
level by level with joins. The most frequent windows, ``HEAD_WINDOWS`` at most, are shipped to the
tasks with theirs; all others of a text are looked up by a join.

The base score is a smoothed unigram of words. Word counts cover all training texts. The most
frequent words, ``HEAD`` at most, are shipped to the tasks; all others of a text are looked up
by a join, so the result is exact for every word. Words are 64-bit hashes.

Defined results: NULL and empty texts are the end symbol alone. Rows with a NULL key are scored,
not learned from and not held out. Without training rows the tree is empty and all words are
unknown. Repeated rows count and score each; extra columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import SPACE, Shipped, Words, remainder, shared_table, texts_of

DEPTH, LEAST_COUNT = 6, 2
LEAST_GAIN = 12.0  # bits
HEAD, HEAD_WINDOWS = 200_000, 2_000_000
SLICE = 1 << 20
START, END, BLANK = 13, 10, 32  # codes no word holds
CODES = 252  # byte values a symbol can have: all but the four other blanks
BLOCK = 512
PENDING, HELD = 2_000_000, 1_500_000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
FOLD = LOWER.copy()
FOLD[SPACE] = BLANK
WORD_KIND, WINDOW_KIND, TEXT_KIND = 0, 1, 2


def symbols(raw: bytes) -> np.ndarray:
    """Start marks, the text's symbols, the end."""
    data = FOLD[np.frombuffer(raw, np.uint8)]
    blank = data == BLANK
    kept = data[~blank | np.r_[False, ~blank[:-1]]] if len(data) else data
    if len(kept) and kept[-1] == BLANK:
        kept = kept[:-1]
    return np.r_[np.full(DEPTH, START, np.uint8), kept, np.uint8(END)]


def windows(coded: np.ndarray) -> np.ndarray:
    """Each symbol with the ``DEPTH`` symbols before it, as one integer."""
    wide, n = coded.astype(np.int64), len(coded) - DEPTH
    out = np.zeros(n, np.int64)
    for k in range(DEPTH + 1):
        out = (out << 8) | wide[k : k + n]
    return out


class Tally:
    """Counts of integers in bounded memory: full tables are handed on and started anew."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size < PENDING:
            return None
        keys, counts = self.take()
        if len(keys) >= HELD:
            return keys, counts
        self.parts, self.size = [(keys, counts)], len(keys)
        return None

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in self.parts]) if self.parts else np.zeros(0, np.int64)
        counts = np.concatenate([c for _, c in self.parts]) if self.parts else np.zeros(0, np.int64)
        self.parts, self.size = [], 0
        found, where = np.unique(keys, return_inverse=True)
        return found, np.bincount(where, counts, len(found)).astype(np.int64)


def counted(docs: DataFrame) -> DataFrame:
    """(kind, key, n): words, windows and texts of docs (text)."""

    def told(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys), pa.array(counts)], ["kind", "key", "n"])

    def run(batches):
        words, tallies, texts = Words(fold=LOWER), {WORD_KIND: Tally(), WINDOW_KIND: Tally()}, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found, seen = [], []
                for x in texts_of(batch.slice(at, 256)):
                    raw = x.encode("utf-8", "surrogatepass")
                    found.append(words.hashes(*words.spans(raw)).view(np.int64))
                    seen.append(windows(symbols(raw)))
                    texts += 1
                for kind, keys in ((WORD_KIND, found), (WINDOW_KIND, seen)):
                    full = tallies[kind].add(np.concatenate(keys))
                    if full:
                        yield told(kind, *full)
        for kind, tally in tallies.items():
            yield told(kind, *tally.take())
        yield told(TEXT_KIND, np.zeros(1, np.int64), np.array([texts], np.int64))

    return docs.select("text").mapInArrow(run, "kind tinyint, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def levels(grams: DataFrame, total: int) -> list[DataFrame]:
    """(w, context, n, all, kinds, kept, p) of the windows of ``grams`` (key, n) with a context of 0, 1, ... ``DEPTH`` bytes.

    ``all`` and ``kinds`` are the context's occurrences and different followers, ``kept`` tells whether it is in the
    tree, ``p`` is the probability of the window's last byte. Windows with n = 0 are not learned from, they get ``p`` only.
    """
    counts = {DEPTH: grams.select(F.col("key").alias("w"), "n")}
    for k in range(DEPTH - 1, -1, -1):
        mask = (1 << (8 * (k + 1))) - 1
        counts[k] = shared_table(counts[k + 1].groupBy(F.col("w").bitwiseAND(F.lit(mask)).alias("w")).agg(F.sum("n").alias("n")))
    root = counts[0].select(
        "w", F.lit(0).cast("bigint").alias("context"), "n", F.lit(total).cast("bigint").alias("all"), F.lit(0).cast("bigint").alias("kinds"), F.lit(False).alias("kept"),
        ((F.col("n") + 0.5) / (total + 0.5 * CODES)).alias("p"))
    tables = [shared_table(root)]
    for k in range(1, DEPTH + 1):
        mask = (1 << (8 * k)) - 1
        shorter = tables[k - 1].select(F.col("w").alias("v"), F.when(F.col("n") > 0, F.col("n") / F.col("all")).alias("q"), F.col("p").alias("below"))
        joined = counts[k].withColumn("context", F.shiftright("w", 8)).join(shorter, F.col("w").bitwiseAND(F.lit(mask)) == F.col("v"))
        same = Window.partitionBy("context")  # as many rows as there are byte values, at most
        learned = joined.withColumn("all", F.sum("n").over(same)).withColumn("kinds", F.sum((F.col("n") > 0).cast("bigint")).over(same))
        bits = F.when(F.col("n") > 0, F.col("n") * F.log2(F.col("n") / F.col("all") / F.col("q"))).otherwise(0.0)
        kept = (F.col("all") >= LEAST_COUNT) & (F.col("gain") >= LEAST_GAIN)
        p = F.when(F.col("kept"), (F.col("n") + F.col("kinds") * F.col("below")) / (F.col("all") + F.col("kinds"))).otherwise(F.col("below"))
        told = learned.withColumn("gain", F.sum(bits).over(same)).withColumn("kept", kept).withColumn("p", p)
        tables.append(shared_table(told.select("w", "context", "n", "all", "kinds", "kept", "p")))
    return tables


def retained(grams: DataFrame, total: int) -> tuple[pa.Table, dict[int, int]]:
    """Rows (context, depth, symbol, n) of the contexts that stay, and the counts of single symbols, for a :class:`Tree`."""
    tables = levels(grams, total)
    rows = [
        t.where(F.col("kept") & (F.col("n") > 0)).select("context", F.lit(k).alias("depth"), F.col("w").bitwiseAND(F.lit(255)).alias("symbol"), "n")
        for k, t in enumerate(tables) if k]
    found = rows[0]
    for more in rows[1:]:
        found = found.union(more)
    single = {r["w"]: r["n"] for r in tables[0].where("n > 0").select("w", "n").collect()}  # 256 rows at most
    return found.toArrow(), single


class Tree:
    """A small table's model as an automaton, to compare with: for each state and symbol class the next state's row offset and log10 probability."""

    def __init__(self, rows, single: dict[int, int]):
        used = sorted(set(single) | {START})
        self.classes = np.zeros(256, np.uint8)  # class 0: never seen
        for i, c in enumerate(used, 1):
            self.classes[c] = i
        width = len(used) + 1
        contexts, depths, follower, times = (rows.column(c).to_numpy() for c in ("context", "depth", "symbol", "n"))
        by = np.lexsort((contexts, depths))
        contexts, depths, follower, times = contexts[by], depths[by], self.classes[follower[by].astype(np.int64)], times[by]
        edges = np.flatnonzero(np.r_[True, (contexts[1:] != contexts[:-1]) | (depths[1:] != depths[:-1])]) if len(by) else np.zeros(0, np.int64)
        followers = {  # context to its first and last row
            int(contexts[a]).to_bytes(int(depths[a]), "big"): (a, b) for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(by)])}
        states = {b""}
        for context in followers:  # closed under prefixes and suffixes
            states.update(context[i:j] for i in range(len(context)) for j in range(i + 1, len(context) + 1))
        order = sorted(states, key=lambda s: (len(s), s))
        place = {s: i for i, s in enumerate(order)}
        total = sum(single.values())
        share = np.full(width, 0.5 / (total + 0.5 * CODES))
        for c, n in single.items():
            share[self.classes[c]] = (n + 0.5) / (total + 0.5 * CODES)
        moves = np.zeros((len(order), width), np.int32)
        shares = np.zeros((len(order), width), np.float32)
        shares[0] = share
        for _, level in groupby(order[1:], len):
            level = list(level)
            for s in level:  # first the prefixes, all a level shorter, learn where they lead
                moves[place[s[:-1]], self.classes[s[-1]]] = place[s] * width
            for s in level:
                i, back = place[s], place[s[1:]]
                moves[i] = moves[back]
                shares[i] = shares[back]
                if s in followers:
                    first, last = followers[s]
                    counts = np.zeros(width)
                    counts[follower[first:last]] = times[first:last]
                    shares[i] = (counts + (last - first) * shares[back]) / (counts.sum() + last - first)
        self.states = order
        self.moves, self.logs = moves.ravel(), np.log10(shares, out=shares).ravel()


def scores(moves: np.ndarray, logs: np.ndarray, classes: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """Log10 probability of each coded text."""
    data = classes[np.concatenate(texts)].astype(np.int32)
    sizes = np.array([len(t) - DEPTH for t in texts])
    blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(texts)), blocks)
    offsets = np.cumsum(sizes + DEPTH) - sizes - DEPTH
    within = (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
    begin, size = offsets[owner] + within, np.minimum(sizes[owner] - within, BLOCK)
    order = np.argsort(-size, kind="stable")
    owner, begin, size = owner[order], begin[order], size[order]
    states, sums, running = np.zeros(len(owner), np.int32), np.zeros(len(owner)), len(owner)
    for at in range(DEPTH + BLOCK):  # the first steps only lead to the state a block begins in
        while running and size[running - 1] <= at - DEPTH:
            running -= 1
        if not running:
            break
        place = states[:running] + data[begin[:running] + at]
        if at >= DEPTH:
            sums[:running] += logs[place]
        states[:running] = moves[place]
    return np.bincount(owner, sums, len(texts))


def looked_up(seen: list[np.ndarray], keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Per text the sum of its windows' values by the sorted keys, and its other windows with how often each occurs."""
    sums, flat, owner = np.zeros(len(seen)), np.concatenate(seen), np.repeat(np.arange(len(seen)), [len(x) for x in seen])
    missed, missing = [], []
    for at in range(0, len(flat), SLICE):
        part, mine = flat[at : at + SLICE], owner[at : at + SLICE]
        found, back = np.unique(part, return_inverse=True)
        hit = np.zeros(len(found), bool)
        if len(keys):
            where = np.searchsorted(keys, found)
            where[where == len(keys)] = 0
            hit = keys[where] == found
            sums += np.bincount(mine, np.where(hit, values[where], 0.0)[back], len(seen))
        miss = ~hit[back]
        missed.append(part[miss])
        missing.append(mine[miss])
    windows, texts = np.concatenate(missed), np.concatenate(missing)
    by = np.lexsort((windows, texts))
    windows, texts = windows[by], texts[by]
    first = np.flatnonzero(np.r_[True, (windows[1:] != windows[:-1]) | (texts[1:] != texts[:-1])]) if len(by) else np.zeros(0, np.int64)
    times = np.diff(np.r_[first, len(by)]).astype(np.int32)
    offsets = pa.array(np.searchsorted(texts[first], np.arange(len(seen) + 1)).astype(np.int32))
    return sums, pa.ListArray.from_arrays(offsets, pa.array(windows[first])), pa.ListArray.from_arrays(offsets, pa.array(times))


def most_frequent(rows: DataFrame, head: int) -> pa.Table:
    """The most frequent of ``rows`` (key, n, ...), ``head`` at most: those above a count that the histogram of counts gives."""
    step = F.floor(F.log2("n") * 8)
    sizes = sorted(((r["step"], r["count"]) for r in rows.groupBy(step.alias("step")).count().collect()), reverse=True)  # 512 rows at most
    taken, least = 0, None
    for at, n in sizes:
        if taken + n > head:
            break
        taken, least = taken + n, at
    chosen = rows.where(step >= least) if least is not None else rows.where("false")
    return chosen.toArrow().sort_by("key")


def model_scores(df: DataFrame, key: str = "doc_id", text: str = "text", head: int = HEAD, head_windows: int = HEAD_WINDOWS) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text.

    Learned from rows whose crc32 remainder by 10 is not 0.
    """
    spark: SparkSession = df.sparkSession
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    learned = F.coalesce(remainder("key", 10) != 0, F.lit(False))
    counts = shared_table(counted(docs.where(learned)))
    words = counts.where(F.col("kind") == WORD_KIND).select("key", "n")
    facts = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("different")).collect()}
    total, different, texts, grams = 0, 0, 0, 0
    if WORD_KIND in facts:
        total, different = facts[WORD_KIND]["n"], facts[WORD_KIND]["different"]
    if TEXT_KIND in facts:
        texts = facts[TEXT_KIND]["n"]
    if WINDOW_KIND in facts:
        grams = facts[WINDOW_KIND]["n"]
    tokens, kinds = total + texts, different + (texts > 0)
    others = counted(docs.where(~learned)).where(F.col("kind") == WINDOW_KIND).select("key", F.lit(0).cast("bigint").alias("n"))
    every = counts.where(F.col("kind") == WINDOW_KIND).select("key", "n").union(others).groupBy("key").agg(F.sum("n").alias("n"))
    values = levels(shared_table(every), grams)[DEPTH].select(F.col("w").alias("key"), "n", F.log10("p").alias("value"))
    frequent, common = most_frequent(words, head), most_frequent(values.where("n > 0"), head_windows)
    shipped = Shipped(spark, tuple(t.column(c).to_numpy() for t, cs in ((common, ("key", "value")), (frequent, ("key", "n"))) for c in cs))

    def run(batches):
        hashing = Words(fold=LOWER)
        keys, logs, known, often = shipped.state(lambda x: x)
        logged = np.log10(often + 0.1)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                seen, sizes, base, sure, rest, times = [], [], [], [], [], []
                for x in texts_of(part):
                    raw = x.encode("utf-8", "surrogatepass")
                    seen.append(windows(symbols(raw)))
                    found, many = np.unique(hashing.hashes(*hashing.spans(raw)).view(np.int64), return_counts=True)
                    sizes.append(int(many.sum()) + 1)
                    where = np.searchsorted(known, found)
                    where[where == len(known)] = 0
                    hit = known[where] == found if len(known) else np.zeros(len(found), bool)
                    base.append(float((many[hit] * logged[where[hit]]).sum()) if len(known) else 0.0)
                    sure.append(int(many[hit].sum()))
                    rest.append(found[~hit])
                    times.append(many[~hit].astype(np.int32))
                if not seen:
                    continue
                sums, open_, often_ = looked_up(seen, keys, logs)
                columns = [pa.array(sizes, pa.int64()), pa.array(base, pa.float64()), pa.array(sure, pa.int64()), pa.array(sums),
                           pa.array(rest, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32())), open_, often_]
                yield pa.RecordBatch.from_arrays([part.column("key"), *columns], ["key", "n_tokens", "base", "known", "sums", "rest", "times", "windows", "often"])

    rows = docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, n_tokens bigint, base double, known bigint, sums double, rest array<bigint>, times array<int>, windows array<bigint>, often array<int>")
    rows = shared_table(rows.withColumn("row", F.monotonically_increasing_id()))
    open_words = rows.select("row", F.explode(F.arrays_zip("rest", "times")).alias("w")).select("row", F.col("w.rest").alias("word"), F.col("w.times").alias("times"))
    joined = open_words.join(words.withColumnRenamed("key", "word"), "word", "left")
    found = joined.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("more"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("also"))
    open_windows = rows.select("row", F.explode(F.arrays_zip("windows", "often")).alias("w")).select("row", F.col("w.windows").alias("key"), F.col("w.often").alias("often"))
    rare = open_windows.join(values.select("key", "value"), "key").groupBy("row").agg(F.sum(F.col("often") * F.col("value")).alias("rare"))
    ending = math.log10(texts + 0.1)
    norm = math.log10(tokens + 0.1 * (kinds + 1))
    return rows.drop("rest", "times", "windows", "often").join(found, "row", "left").join(rare, "row", "left").select(
        F.col("key").alias(key), F.coalesce(remainder("key", 10) == 0, F.lit(False)).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("also", F.lit(0)) + F.lit(int(texts > 0))).alias("n_known"), F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) + F.lit(ending) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("sums") + F.coalesce("rare", F.lit(0.0))).alias("score"))


def op5_suffix_tree_lm(spark, sf_dir):
    return model_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
