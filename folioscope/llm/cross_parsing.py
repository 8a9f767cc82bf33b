"""Language identification by cross-parsing entropy (operator 4).

For each language a suffix automaton is built over sampled labelled text. A text is parsed
into phrases, each the longest string the automaton knows; the language that needs the fewest
phrases per symbol wins. Letters are lower-cased, all other runs become one blank.

The automata are flattened into one table: for every state and symbol the next state and the
number of phrases that end. Only the ``ALPHABET`` commonest symbols have columns there; the
transitions of all others are in sorted arrays, so every symbol of a sample counts. Texts are cut into blocks of ``BLOCK`` symbols and
all blocks of a batch step through the table together, once per language. Phrases go over
the cuts: every block is entered once more with the state its predecessor ends in, until both runs are
in one state (they soon are, as states stand for sets of places in the sample); a run that never
meets the other hands its own last state on.

The sample is at most ``documents`` labelled rows per language, chosen by hash, of each the first
``longest`` code points, and ``symbols`` symbols of them; beyond ``ALL_SYMBOLS`` / ``symbols`` languages each
gets an equal part of ``ALL_SYMBOLS``, which bounds what is shipped to the tasks. The ``LANGUAGES`` languages
with most labelled rows are learned. Prediction reads whole texts.

Defined results: NULL texts and texts without a letter are ``und`` with score 0.0, and so is
every text if nothing could be learned. Ties go to the language with more labelled rows. NULL keys
are not learned from; repeated rows are predicted like others; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import Shipped, map_batches, remainder, texts_of

UNKNOWN = "und"
DOCUMENTS, LONGEST, SYMBOLS, ALPHABET, BLOCK = 200, 8000, 40_000, 48, 512
LANGUAGES, ALL_SYMBOLS = 500, 400_000
BLANKS = re.compile(r"[\W\d_]+")
LETTER = re.compile(r"[^\W\d_]")


def plain(text: str) -> str:
    return BLANKS.sub(" ", text.lower()).strip()


def automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton; state 0 is the start."""
    edges: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        now = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = now
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return edges


class Parser:
    """The flattened automata of all languages.

    Symbol 0 pads: it ends a pending phrase. Symbol 1 is any character outside all samples: a
    phrase of its own. An entry holds the next state's row offset times four plus the phrases ended.
    Transitions by symbols from ``width`` on are the sorted ``keys`` (row offset times ``many`` plus
    symbol) with their ``values``.
    """

    def __init__(self, texts: dict[str, str]):
        self.languages = list(texts)
        every = Counter(c for t in texts.values() for c in t).most_common()
        self.symbols = {c: i + 2 for i, (c, _) in enumerate(sorted(every[:ALPHABET]) + sorted(every[ALPHABET:]))}
        width = self.width = min(len(every), ALPHABET) + 2
        many = self.many = len(every) + 2
        tables, self.roots, base = [], [], 0
        rare: dict[int, int] = {}
        # A suffix automaton has under two states per symbol.
        kind = np.int32 if 8 * width * sum(len(t) + 1 for t in texts.values()) < 1 << 31 else np.int64
        for language in self.languages:
            edges = automaton(texts[language])
            root = base * width
            table = np.full((len(edges), width), root * 4 + 1, kind)
            start = np.full(width, root * 4 + 1, kind)
            for c, to in edges[0].items():
                if self.symbols[c] < width:
                    start[self.symbols[c]] = (base + to) * width * 4
            for state in range(len(edges)):
                if state:
                    table[state] = start + 1  # the phrase ends, the symbol begins the next
                    table[state, 0] = root * 4 + 1
                for c, to in edges[state].items():
                    if self.symbols[c] < width:
                        table[state, self.symbols[c]] = (base + to) * width * 4
                    else:
                        rare[(base + state) * width * many + self.symbols[c]] = (base + to) * width * 4
            table[0] = start
            table[0, 0] = root * 4
            tables.append(table)
            self.roots.append(root)
            base += len(edges)
        self.table = np.concatenate(tables).ravel()
        self.keys = np.array(sorted(rare), np.int64)
        self.values = np.array([rare[k] for k in self.keys.tolist()], kind)

    @property
    def codes(self) -> np.ndarray:
        """Symbol of each code point; the last one stands for all above."""
        codes = np.ones(max(map(ord, self.symbols), default=0) + 2, np.int32)
        for c, i in self.symbols.items():
            codes[ord(c)] = i
        return codes

    def shipped(self) -> tuple:
        return self.table, self.roots, self.codes, self.keys, self.values, self.width, self.many


class Steps:
    """One step of many runs through the table; ``rare`` symbols go by the sorted transitions."""

    def __init__(self, value: tuple, data: np.ndarray):
        self.table, roots, codes, self.keys, self.values, width, self.many = value
        self.roots = np.array(roots, np.int64)
        symbols = codes[np.minimum(data, len(codes) - 1)]
        self.rare, self.symbols = None, symbols
        if (symbols >= width).any():
            self.rare, self.symbols = np.where(symbols >= width, symbols, 0), np.where(symbols < width, symbols, 1)

    def __call__(self, states: np.ndarray, roots: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Table entries for states at the symbols of ``places``; the three broadcast to one shape."""
        found = self.table[states + self.symbols[places]]
        if self.rare is None:
            return found
        seen = np.broadcast_to(self.rare[places], found.shape)
        if not seen.any():
            return found
        where = np.nonzero(seen)
        symbol, old = seen[where].astype(np.int64), np.broadcast_to(states, found.shape)[where].astype(np.int64)
        root = np.broadcast_to(roots, found.shape)[where]
        new = found[where]
        for state, ended in ((root, old != root), (old, 0)):  # going on counts over beginning anew
            at = np.minimum(np.searchsorted(self.keys, state * self.many + symbol), len(self.keys) - 1)
            new = np.where(self.keys[at] == state * self.many + symbol, self.values[at] + ended, new)
        found[where] = new
        return found


def phrases(value: tuple, texts: list[str]) -> np.ndarray:
    """Phrases per text and language."""
    table, roots = value[:2]
    counts = np.zeros((len(texts), len(roots)), np.int64)
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts])
    blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(texts)), blocks)
    if not len(owner):
        return counts
    step = Steps(value, data)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = (np.cumsum(sizes) - sizes)[owner] + within * BLOCK
    size = np.minimum(sizes[owner] - within * BLOCK, BLOCK)
    # All blocks from the start state, long ones first: those still running are a prefix.
    order = np.argsort(-size, kind="stable")
    first, long = begin[order], size[order]
    start = np.array(roots, table.dtype)[:, None]
    states = np.repeat(start, len(owner), axis=1)
    ended = np.zeros(states.shape, np.int64)
    running = len(owner)
    for at in range(BLOCK):
        while running and long[running - 1] <= at:
            running -= 1
        if not running:
            break
        found = step(states[:, :running], step.roots[:, None], first[:running] + at)
        ended[:, :running] += found & 3
        states[:, :running] = found >> 2
    back = np.argsort(order, kind="stable")
    states, ended = states[:, back], ended[:, back]
    # Blocks that follow another, entered with its last state: first with that of its fresh run, then, where its
    # true last state is another, once more in the order of the text.
    more, final = np.zeros(states.shape, np.int64), states.copy()
    language, block = (x.ravel() for x in np.meshgrid(np.arange(len(roots)), np.flatnonzero(within), indexing="ij"))
    while len(block):
        before = final[language, block]
        added, last = _entered(step, final[language, block - 1], start[language, 0], language, begin[block], size[block])
        more[language, block] = added
        final[language, block] = np.where(last < 0, states[language, block], last)
        if not len(moved := np.flatnonzero(final[language, block] != before)):
            break
        language, block = language[moved], block[moved] + 1
        inside = block < len(owner)
        language, block = language[inside], block[inside]
        follows = within[block] > 0
        language, block = language[follows], block[follows]
    ends = np.r_[within[1:] == 0, True]
    ended += more
    ended[:, ends] += table[final[:, ends]] & 3  # the pad symbol closes what is pending
    for k in range(len(roots)):
        counts[:, k] = np.bincount(owner, ended[k], len(texts))
    return counts


def _entered(step: Steps, left: np.ndarray, fresh: np.ndarray, language: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What entering blocks with state ``left`` adds to the phrases of their fresh runs, and the last state (-1: that of the fresh run)."""
    left, right, roots = left.copy(), fresh.copy(), step.roots[language]
    added, last = np.zeros(len(left), np.int64), np.full(len(left), -1, left.dtype)
    apart = np.flatnonzero(left != right)
    for at in range(BLOCK + 1):
        over = apart[size[apart] <= at]
        last[over] = left[over]
        apart = apart[size[apart] > at]
        if not len(apart):
            break
        a, b = (step(x[apart], roots[apart], begin[apart] + at) for x in (left, right))
        added[apart] += (a & 3).astype(np.int64) - (b & 3)
        left[apart], right[apart] = a >> 2, b >> 2
        apart = apart[left[apart] != right[apart]]
    return added, last


def train(docs: DataFrame, documents: int = DOCUMENTS, longest: int = LONGEST, symbols: int = SYMBOLS) -> dict[str, str]:
    """Sampled plain text per language from docs (key, text, lang), the most frequent one first."""
    usable = docs.where((F.col("lang") != UNKNOWN) & F.col("key").isNotNull() & F.col("text").rlike(r"\p{L}"))
    most = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    counts = {r["lang"]: r["count"] for r in most}
    if not counts:
        return {}
    symbols = min(symbols, ALL_SYMBOLS // len(counts))
    # A hash threshold per language keeps about twice the rows wanted, however many there are.
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (2.0 * documents + 50) / n))]), F.col("lang"))
    order = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30))
    rows = usable.withColumn("order", order).where(F.col("order") < share * float(1 << 30)).select(
        "lang", "order", "key", F.substring("text", 1, longest).alias("text")).toArrow().to_pylist()
    out: dict[str, list[str]] = {}
    size: Counter = Counter()
    taken: Counter = Counter()
    for r in sorted(rows, key=lambda r: (r["order"], str(r["key"]), r["text"])):
        k = r["lang"]
        if size[k] < symbols and taken[k] < documents:
            text = plain(r["text"])
            if not text:
                continue
            out.setdefault(k, []).append(text)
            size[k] += len(text) + 1
            taken[k] += 1
    return {k: " ".join(out[k])[:symbols] for k in sorted(out, key=lambda k: (-counts[k], k))}


def completed(counts: np.ndarray, texts: list[str]) -> np.ndarray:
    """Phrases that end inside a text, where the next symbol did not fit: none if a text is one phrase."""
    return counts - np.array([len(t) > 0 for t in texts], np.int64)[:, None]


def limits(texts: dict[str, str]) -> np.ndarray:
    """Per language the completed phrases per symbol up to which a text is in line with it.

    The one half of a sample is parsed by the other, as it is and with its symbols in random order; the limit
    is the geometric mean of both rates.
    """
    out = []
    for text in texts.values():
        known, other = text[: len(text) // 2], text[len(text) // 2 :]
        if not known:
            out.append(np.inf)
            continue
        mixed_up = "".join(np.random.default_rng(0).permutation(list(other)))
        own, noise = completed(phrases(Parser({"": known}).shipped(), [other, mixed_up]), [other, mixed_up])[:, 0] / len(other)
        out.append(float(np.sqrt(max(own, 1 / len(other)) * max(own, noise, 1 / len(other)))))
    return np.array(out)


def predicted(docs: DataFrame, texts: dict[str, str]) -> DataFrame:
    """(key, lang_pred, score, phrases_per_symbol, in_line) of docs (key, text).

    ``in_line``: the text has a letter of the samples and, for some language, not more completed phrases than the
    language's limit and two deviations allow for its length.
    """
    parser = Parser(texts) if texts else None
    languages = parser.languages if parser else []
    shipped = Shipped(docs.sparkSession, (*parser.shipped(), limits(texts)) if parser else None)

    def make():
        value = shipped.state(lambda x: x)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [plain(x) if LETTER.search(x) else "" for x in texts_of(batch)]
            names, scores, rates, fits = [], [], [], []
            if value is not None:
                *tables, limit = value
                counts = phrases(tables, texts)
                most = limit * np.array([len(t) for t in texts])[:, None] if len(texts) else counts
                inside = (completed(counts, texts) <= most + 2 * np.sqrt(most)).any(axis=1)
                codes = tables[2]
            for i, x in enumerate(texts):
                if not x or value is None:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    rates.append(None)
                    fits.append(False)
                    continue
                best = int(counts[i].argmin())
                names.append(languages[best])
                scores.append(float(1.0 / np.exp(np.maximum(counts[i, best] - counts[i], -700.0)).sum()))
                rates.append(counts[i, best] / len(x))
                fits.append(bool(inside[i]) and any(codes[min(ord(c), len(codes) - 1)] > 1 for c in x if c != " "))
            return pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64()), pa.array(fits, pa.bool_())],
                ["key", "lang_pred", "score", "phrases_per_symbol", "in_line"])

        return step

    return map_batches(docs.select("key", "text"), make, "key string, lang_pred string, score double, phrases_per_symbol double, in_line boolean")


def languages(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score, phrases_per_symbol): learned from rows whose crc32 remainder by 3 is not 1."""
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    out = predicted(docs, train(docs.where(remainder("key", 3) != 1)))
    return out.select(F.col("key").alias(key), F.coalesce(remainder("key", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "phrases_per_symbol")


def op4_cross_parsing(spark, sf_dir):
    return languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
