"""Chat formatting into budgeted windows with a loss mask (operator 6).

A conversation becomes training windows of at most ``budget`` tokens. A window holds the
conversation's system turn, then a limited history, then new turns; prefix sums of turn tokens
say how far back the history and how far on the new turns reach, and both are cut between turns
only. History is repeated with its targets masked, so each assistant turn is learned from once.
A turn that does not fit beside system turn and history gets a window of its own, whole.

Turns are written between control strings, ``[INST]`` role, line feed, text ``[/INST]`` for
context and ``<s>`` role, line feed, text ``</s>`` for assistants; control strings in texts and
roles get a backslash after their first character, one more if there are some already, which
:func:`read_window` takes back. The loss mask is a list of code point spans, one per new
assistant turn, over its escaped text.

A conversation is cut into chunks of ``CHUNK`` turns; windows do not cross chunks, but a chunk
begins with the history before it, so even one conversation with most rows is spread over tasks.
Turns stream through in order and only a window, the history and one Arrow batch are held.

Defined results: rows are ordered by turn, NULL turns first, then role and text. NULL texts and
roles are empty. The system turn is the first row if its role is ``system``. Repeated rows are
turns of their own, a NULL conversation id is a conversation, extra columns are ignored, an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import WORD, shared_table

BUDGET, HISTORY, CHUNK = 512, 128, 1024
CONTROL = re.compile(r"([\[<])(\\*)(/?INST\]|/?s>)")
ESCAPED = re.compile(r"([\[<])\\(\\*)(/?INST\]|/?s>)")
TURN = re.compile(r"(?:\[INST\]|<s>)([^\n]*)\n(.*?)(?:\[/INST\]|</s>)", re.DOTALL)
WORDS = re.compile(WORD)


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def role_line(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def role_read(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(line))


def tokens(role: str, text: str) -> int:
    """Words of the text, and two for the marks."""
    return len(WORDS.findall(text)) + 2


def write_window(context: list[tuple[str, str]], new: list[tuple[str, str]]) -> tuple[str, int, list[tuple[int, int]]]:
    """The formatted window, where its new turns begin, and the loss spans."""
    parts, at, fresh, spans = [], 0, 0, []
    for i, (role, text) in enumerate(context + new):
        if i == len(context):
            fresh = at
        target = role == "assistant"
        head, body, tail = ("<s>" if target else "[INST]") + role_line(role) + "\n", escape(text), "</s>" if target else "[/INST]"
        if target and i >= len(context):
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(parts), fresh, spans


def read_window(text: str, fresh: int) -> list[tuple[str, str]]:
    """The new turns of a window, from its text alone."""
    return [(role_read(m[1]), unescape(m[2])) for m in TURN.finditer(text, fresh)]


def windows(df: DataFrame, budget: int = BUDGET, history: int = HISTORY, chunk: int = CHUNK, conversation: str = "conv_id") -> DataFrame:
    """(conv, chunk, window, text, fresh, spans) of df (conversation, turn, role, text)."""
    kind = df.schema[conversation].dataType.simpleString()
    rows = df.select(F.col(conversation).alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Positions within a conversation: counts per hash-free range of turns first, then inside each range.
    spread = rows.withColumn("range", F.floor(F.col("turn") / F.lit(chunk)))
    sizes = spread.groupBy("conv", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy(F.col("range").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("conv").alias("of"), F.col("range").alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv", "range").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = shared_table(
        spread.withColumn("inside", F.row_number().over(inside))
        .join(offsets, F.col("conv").eqNullSafe(F.col("of")) & F.col("range").eqNullSafe(F.col("at")))
        .select("conv", (F.col("before") + F.col("inside") - 1).alias("position"), "role", "text"))
    # Each turn goes to its chunk; the last turns of a chunk and the system turn also to later ones, as context.
    own = placed.withColumn("chunk", F.floor(F.col("position") / F.lit(chunk))).withColumn("context", F.lit(False))
    # A turn is two tokens at least, so no more turns than half the history can be repeated.
    repeat = own.where(F.pmod("position", F.lit(chunk)) >= chunk - max(1, history // 2)).withColumn("chunk", F.col("chunk") + 1)
    chunks = own.groupBy("conv", "chunk").agg(F.count("*").alias("n")).select(F.col("conv").alias("of"), F.col("chunk").alias("at"))
    system = own.where((F.col("position") == 0) & (F.col("role") == "system")).drop("chunk").join(
        chunks.where("at > 0"), F.col("conv").eqNullSafe(F.col("of"))).select("conv", "position", "role", "text", F.col("at").alias("chunk"))
    context = repeat.select("conv", "position", "role", "text", "chunk").where("position > 0").union(system)
    context = context.join(chunks, F.col("conv").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("at")), "left_semi").withColumn("context", F.lit(True))
    ready = own.select("conv", "chunk", "position", "context", "role", "text").union(context.select("conv", "chunk", "position", "context", "role", "text"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = ready.repartition(parts, "conv", "chunk").sortWithinPartitions("conv", "chunk", "position")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, packer = None, None
        for batch in batches:
            out: list[tuple] = []
            for conv, part, position, known, role, text in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if packer is None or key != (conv, part):
                    if packer:
                        out += packer.close()
                    key, packer = (conv, part), Packer(conv, part, budget, history)
                out += packer.add(position, known, role, text)
            if out:
                yield batch_of(out, batch.schema.field(0).type)
            last_type = batch.schema.field(0).type
        if packer and (out := packer.close()):
            yield batch_of(out, last_type)

    return ready.mapInArrow(run, f"conv {kind}, chunk bigint, window int, text string, fresh int, spans array<struct<start: int, end: int>>")


def batch_of(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    kinds = [key_type, pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["conv", "chunk", "window", "text", "fresh", "spans"])


class Packer:
    """Turns of one chunk in order; windows come out as they fill.

    ``prefix[i]`` is the tokens of the chunk's turns before turn i, the repeated ones first. Texts
    are kept only as far back as history reaches.
    """

    def __init__(self, conv, chunk: int, budget: int, history: int):
        self.conv, self.chunk, self.budget, self.history = conv, chunk, budget, history
        self.system: list[tuple[str, str]] = []
        self.system_tokens = 0
        self.prefix = [0]
        self.turns: dict[int, tuple[str, str]] = {}
        self.oldest = self.begin = self.start = 0  # first turn kept, of the window's new turns, of its history
        self.alone = False  # the window has no room for context
        self.opening = None  # a system turn that is still new itself
        self.count = 0

    def add(self, position: int, known: bool, role: str, text: str) -> list[tuple]:
        size, out = tokens(role, text), []
        at = len(self.prefix) - 1  # this turn
        if position == 0 and known:
            self.system, self.system_tokens = [(role, text)], size
            return out
        if not known:
            used = self.prefix[at] - self.prefix[self.start] + (0 if self.alone else self.system_tokens)
            if at > self.begin and used + size > self.budget:
                out = self.close()
            if at == self.begin:  # this turn opens a window
                room = self.budget - self.system_tokens - size
                self.alone = room < 0
                reach = self.prefix[at] - max(0, min(self.history, room))
                self.start = at if self.alone else bisect_left(self.prefix, reach, max(self.oldest, len(self.system) if self.chunk == 0 else 0))
        self.turns[at] = (role, text)
        self.prefix.append(self.prefix[at] + size)
        if known:
            self.begin = self.start = at + 1
        if position == 0 and role == "system":
            self.opening = (role, text), size
        while self.oldest < self.start and self.prefix[-1] - self.prefix[self.oldest] > self.history:
            del self.turns[self.oldest]
            self.oldest += 1
        return out

    def close(self) -> list[tuple]:
        end = len(self.prefix) - 1
        if end == self.begin:
            return []
        context = ([] if self.alone else self.system) + [self.turns[i] for i in range(self.start, self.begin)]
        text, fresh, spans = write_window(context, [self.turns[i] for i in range(self.begin, end)])
        row = (self.conv, self.chunk, self.count, text, fresh, [{"start": a, "end": b} for a, b in spans])
        self.count += 1
        self.begin = self.start = end
        if self.opening:  # from here on it is repeated as such, never as history
            self.system, self.system_tokens, self.opening = [self.opening[0]], self.opening[1], None
        return [row]


def read_back(made: DataFrame) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows) read from windows in order.

    A digest of a whole conversation is sequential by nature; it streams through one task.
    """
    kind = made.schema["conv"].dataType.simpleString()
    parts = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = made.repartition(parts, "conv").sortWithinPartitions("conv", "chunk", "window").select("conv", "text", "fresh", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums = None, None
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]

        def told(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
            kinds = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        def row() -> tuple:
            turns, turn_hash, chars, loss_hash, formatted, count = sums
            return key, turns, turn_hash.hexdigest(), chars, loss_hash.hexdigest(), formatted, count

        for batch in batches:
            out = []
            key_type = batch.schema.field(0).type
            for conv, text, fresh, spans in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if sums is None or conv != key:
                    if sums:
                        out.append(row())
                    key, sums = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said in read_window(text, fresh):
                    sums[0] += 1
                    sums[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in spans:
                    said = unescape(text[span["start"] : span["end"]])
                    sums[2] += len(said)
                    sums[3].update(said.encode("utf-8", "surrogatepass"))
                sums[4] += len(text)
                sums[5] += 1
            if out:
                yield told(out, key_type)
        if sums:
            yield told([row()], key_type)

    return ordered.mapInArrow(run, f"conv {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint")


def op6_chat_windows(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(windows(table.unionByName(more))).withColumnRenamed("conv", "conv_id")
