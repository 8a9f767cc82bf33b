"""Greedy word-piece token counts by one automaton pass (operator 7).

A word is matched from the left with the longest vocabulary piece each time. The automaton is
the vocabulary's trie with failure links; each node also holds how many tokens are complete
when its link is taken. A word then needs one step per character and no piece is built.
Words start with the vocabulary's space mark; a word with a character the vocabulary cannot
match counts as one unknown token, as usual for word pieces.

Defined results: NULL, empty and blank texts have no words and no tokens. Other columns are
ignored, repeated rows give repeated results, an empty table gives an empty table.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import piece_codec
from folioscope.llm.piece_codec import MARK
from folioscope.llm.shared import Shipped, map_batches, texts_of

UNKNOWN = -1
REMEMBERED, SHORT = 600_000, 64


class Automaton:
    def __init__(self, pieces: Iterable[str]):
        self.children: list[dict[str, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                following = self.children[node].get(c)
                if following is None:
                    following = self.children[node][c] = len(self.children)
                    self.children.append({})
                    final.append(False)
                node = following
            final[node] = True
        # Link of a piece: back to the root with one token done. Link of another node: what its
        # parent's link leads to, with the tokens that are completed on the way.
        self.link: list[int | None] = [None] * len(final)
        self.done = [0] * len(final)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for c, child in self.children[node].items():
                queue.append(child)
                if final[child]:
                    self.link[child], self.done[child] = 0, 1
                    continue
                count, back = self.done[node], self.link[node]
                while back is not None and c not in self.children[back]:
                    count, back = count + self.done[back], self.link[back]
                if back is not None:
                    self.link[child], self.done[child] = self.children[back][c], count

    def length(self, word: str) -> int:
        """Tokens of a word, or UNKNOWN."""
        node, count = 0, 0
        for c in word:
            while c not in self.children[node]:
                back = self.link[node]
                if back is None:
                    return UNKNOWN
                count += self.done[node]
                node = back
            node = self.children[node][c]
        while node:
            back = self.link[node]
            if back is None:
                return UNKNOWN
            count += self.done[node]
            node = back
        return count


class Lengths(dict):
    """Word (UTF-8) to token count; short words are remembered up to a bound."""

    def __init__(self, pieces: Iterable[str]):
        super().__init__()
        self.automaton = Automaton(pieces)

    def __missing__(self, word: bytes) -> int:
        out = self.automaton.length(MARK + word.decode("utf-8", "surrogatepass"))
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = out
        return out


def token_lengths(df: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """(key, n_words, n_tokens, n_unknown) of every whole text."""
    pieces = Shipped(df.sparkSession, list(piece_codec.load(model or piece_codec.default_model()).ids))

    def make():
        lengths = pieces.state(Lengths)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, tokens, unknown = [], [], []
            for x in texts_of(batch, "text"):
                # bytes.split() parts at exactly the six blank bytes
                found = list(map(lengths.__getitem__, x.encode("utf-8", "surrogatepass").split()))
                missing = found.count(UNKNOWN)
                words.append(len(found))
                tokens.append(sum(found) + 2 * missing)
                unknown.append(missing)
            return pa.RecordBatch.from_arrays(
                [batch.column("key"), *(pa.array(c, pa.int64()) for c in (words, tokens, unknown))], ["key", "n_words", "n_tokens", "n_unknown"])

        return step

    narrow = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return map_batches(narrow, make, "key string, n_words bigint, n_tokens bigint, n_unknown bigint").withColumnRenamed("key", key)


def op7_token_lengths(spark, sf_dir):
    return token_lengths(spark.read.parquet(f"{sf_dir}/documents.parquet"))
