"""Merge-type piece encoding and decoding (operator 10).

The encoding is the one a SentencePiece BPE model defines: characters are merged in order of
piece score, leftmost first. It is found without running those merges over the text: the
longest vocabulary match at a position is taken if it is compatible with the token before
it, a shorter match otherwise, and positions from which no match leads on are remembered in a
bitfield, so each is tried once. Two adjacent tokens are compatible when re-merging their
characters gives the two tokens back. A prefix has one compatible tokenisation only, which is
why a failed position stays failed.

Texts fall into independent segments: no merge ever crosses a border between two characters
that no piece holds next to each other, the end of a word above all. Segments repeat, so each
worker remembers the encodings of short ones in a bounded table.

Defined results: NULL and empty texts encode to the begin and end ids alone and decode to the
empty text. Other columns are ignored, repeated rows give repeated results, an empty table
gives an empty table, and texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import Shipped, map_batches, texts_of

MARK = "▁"
REMEMBERED, SHORT = 500_000, 48
NEVER = float("-inf")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces that merge (with scores), ids of single bytes, begin and end ids, ids that print nothing."""

    scores: dict[str, float]
    ids: dict[str, int]
    byte_ids: list[int]
    begin: int
    end: int
    size: int
    silent: frozenset[int]


def load(path: str) -> Vocabulary:
    """Read on the driver; tasks get the vocabulary with the closure's broadcast, not the file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = "ﬁ①Ａ  e\u0301"
    if model.normalize(probe).replace(MARK, " ").strip(" ") != probe:
        raise ValueError("models that normalise texts are not supported")
    scores, ids, silent, byte_ids = {}, {}, set(), [0] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif model.is_control(i) or model.is_unknown(i):
            silent.add(i)
        elif model.is_unused(i):
            raise ValueError("models with unused pieces are not supported")
        else:
            scores[piece], ids[piece] = model.get_score(i), i
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in ids):
        raise ValueError("models with pieces that cross a space are not supported")
    return Vocabulary(scores, ids, byte_ids, model.bos_id(), model.eos_id(), model.get_piece_size(), frozenset(silent))


def best_pair(parts: list[str], scores: dict[str, float]) -> int:
    """The defining step: position of the adjacent pair with the best score, leftmost first; -1 for none."""
    best, at = NEVER, -1
    for i in range(len(parts) - 1):
        score = scores.get(parts[i] + parts[i + 1], NEVER)
        if score > best:
            best, at = score, i
    return at


class Matcher:
    """Aho-Corasick automaton over the pieces: all pieces that end at a character, in one pass.

    Nodes are dictionaries by character, because the first level alone has thousands of them.
    """

    def __init__(self, pieces: list[str]):
        self.goto: list[dict[str, int]] = [{}]
        own: dict[int, str] = {}
        for piece in pieces:
            node = 0
            for c in piece:
                following = self.goto[node].get(c)
                if following is None:
                    following = self.goto[node][c] = len(self.goto)
                    self.goto.append({})
                node = following
            own[node] = piece
        self.back = [0] * len(self.goto)
        self.ends: list[tuple[tuple[int, str], ...]] = [()] * len(self.goto)
        queue = deque(self.goto[0].values())
        for node in queue:
            self.ends[node] = ((len(own[node]), own[node]),) if node in own else ()
        while queue:
            node = queue.popleft()
            for c, child in self.goto[node].items():
                back = self.back[node]
                while back and c not in self.goto[back]:
                    back = self.back[back]
                self.back[child] = back = self.goto[back].get(c, 0)
                self.ends[child] = (((len(own[child]), own[child]),) if child in own else ()) + self.ends[back]
                queue.append(child)

    def longest(self, text: str) -> list[str]:
        """The longest piece that starts at each character; the character itself where there is none."""
        out = list(text)
        goto, back, ends, node = self.goto, self.back, self.ends, 0
        for at, c in enumerate(text, 1):
            following = goto[node].get(c)
            while following is None and node:
                node = back[node]
                following = goto[node].get(c)
            node = following or 0
            for length, piece in ends[node]:  # a later end is a longer match of the same start
                out[at - length] = piece
        return out


class Known(dict):
    """Encodings by text; short texts are remembered, up to a bound."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, text: str) -> bytes:
        out = self.make(text)
        if len(text) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[text] = out
        return out


class Encoder:
    """Exact encoding of whole texts; one per task."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.built: dict[str, tuple | None] = {}
        reachable = [piece for piece in sorted(vocabulary.ids, key=len) if self.history(piece) is not None]
        self.shorter: dict[str, str | None] = {}
        for piece in reachable:
            self.shorter[piece] = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if n == 1 or piece[:n] in self.shorter), None)
        self.matcher = Matcher(reachable)
        self.id_bytes = {piece: i.to_bytes(4, "little") for piece, i in vocabulary.ids.items()}
        self.adjacent = {piece[i : i + 2] for piece in vocabulary.ids for i in range(len(piece) - 1)}
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.pairs: dict[str, bool] = {}
        self.known = Known(self.word)
        self.bytes_of = [b""] * vocabulary.size
        for piece, i in vocabulary.ids.items():
            self.bytes_of[i] = piece.replace(MARK, " ").encode("utf-8", "surrogatepass")
        for byte, i in enumerate(vocabulary.byte_ids):
            self.bytes_of[i] = bytes([byte])

    def history(self, token: str) -> tuple | None:
        """Scores of the merges that build a token, and its first and last part before each of them.

        None if the token's own characters do not merge into it.
        """
        try:
            return self.built[token]
        except KeyError:
            parts, steps, firsts, lasts = list(token), [], [token[0]], [token[-1]]
            while (at := best_pair(parts, self.v.scores)) >= 0:
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                steps.append(self.v.scores[parts[at]])
                firsts.append(parts[0])
                lasts.append(parts[-1])
            out = self.built[token] = (steps + [NEVER], firsts, lasts) if len(parts) == 1 else None
            return out

    def compatible(self, left: str, right: str) -> bool:
        """Re-merge both tokens side by side: no merge may ever win across the border."""
        (left_steps, _, lasts), (right_steps, firsts, _) = self.history(left), self.history(right)
        i = j = 0
        get = self.v.scores.get
        while True:
            across, a, b = get(lasts[i] + firsts[j], NEVER), left_steps[i], right_steps[j]
            if across > a and across >= b and across != NEVER:
                return False
            if a >= b:
                if a == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def tokens(self, segment: str) -> list[str]:
        """Backtracking over longest matches; single characters always match."""
        size = len(segment)
        if size == 1:
            return [segment]
        longest = self.matcher.longest(segment)
        failed = bytearray(size + 1)
        chain: list[str] = []
        at, before, pairs, shorter = 0, "", self.pairs, self.shorter
        piece: str | None = ""
        while at < size:
            if piece == "":  # a position reached for the first time, or from another token
                piece = longest[at]
            while piece is not None:
                if not failed[at + len(piece)]:
                    if not chain:
                        break
                    key = f"{before}\0{piece}"
                    ok = pairs.get(key)
                    if ok is None:
                        ok = pairs[key] = self.compatible(before, piece)
                    if ok:
                        break
                piece = shorter.get(piece)
            if piece is not None:
                chain.append(piece)
                at += len(piece)
                before, piece = piece, ""
            else:
                failed[at] = 1
                last = chain.pop()
                at -= len(last)
                before, piece = (chain[-1] if chain else ""), shorter.get(last)
        if len(pairs) > REMEMBERED:
            pairs.clear()
        return chain

    def _encoded(self, segment: str) -> bytes:
        tokens = self.tokens(segment)
        try:
            return b"".join(map(self.id_bytes.__getitem__, tokens))
        except KeyError:  # characters without a piece are spelled in bytes
            return b"".join(
                self.id_bytes.get(token) or b"".join(self.v.byte_ids[b].to_bytes(4, "little") for b in token.encode("utf-8", "surrogatepass"))
                for token in tokens)

    def word(self, word: str) -> bytes:
        """Ids of a word by its segments, each of which is looked up in turn."""
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.adjacent]
        if not cuts:
            return self._encoded(word)
        return b"".join(map(self.known.__getitem__, map(word.__getitem__, map(slice, [0, *cuts], [*cuts, len(word)]))))

    def encode(self, text: str, ends: bool = True) -> bytes:
        body = b"".join(map(self.known.__getitem__, self.words.findall(MARK + text.replace(" ", MARK)))) if text else b""
        if not ends:
            return body
        return self.v.begin.to_bytes(4, "little") + body + self.v.end.to_bytes(4, "little")

    def decode(self, ids: bytes) -> str:
        joined = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return joined.removeprefix(b" ").decode("utf-8", "replace")


def encoded(df: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """(key, ids array<int>, decoded): the exact ids of every text, and what they decode to."""
    vocabulary = Shipped(df.sparkSession, astuple(load(model or default_model())))

    def make():
        encoder = vocabulary.state(lambda v: Encoder(Vocabulary(*v)))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = [encoder.encode(x) for x in texts_of(batch, "text")]
            offsets = np.cumsum([0, *(len(x) // 4 for x in raw)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            return pa.RecordBatch.from_arrays([batch.column("key"), ids, pa.array([encoder.decode(x) for x in raw], pa.string())], ["key", "ids", "decoded"])

        return step

    return map_batches(_narrow(df, key, text), make, "key string, ids array<int>, decoded string").withColumnRenamed("key", key)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of :func:`encoded`, without shipping the ids."""
    vocabulary = Shipped(df.sparkSession, astuple(load(model or default_model())))

    def make():
        encoder = vocabulary.state(lambda v: Encoder(Vocabulary(*v)))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, ids, decoded = [], [], []
            for x in texts_of(batch, "text"):
                raw = encoder.encode(x)
                counts.append(len(raw) // 4)
                ids.append(hashlib.sha256(raw).hexdigest())
                decoded.append(hashlib.sha256(encoder.decode(raw).encode("utf-8", "surrogatepass")).hexdigest())
            return pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    return map_batches(_narrow(df, key, text), make, "key string, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def _narrow(df: DataFrame, key: str, text: str) -> DataFrame:
    chosen: list[Column] = [F.col(key).alias("key"), F.col(text).alias("text")]
    return df.select(*chosen)


def op10_piece_codec(spark, sf_dir):
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
