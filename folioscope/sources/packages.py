"""Package scan, shredding into parts, and packing parts back into bytes."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Default limits for untrusted packages.
MAX_INPUT_BYTES = 104_857_600
MAX_ENTRIES = 20_000
MAX_EXPANDED_BYTES = 524_288_000
MAX_XML_PART_BYTES = 52_428_800
MAX_RELATIONSHIPS = 50_000
MAX_RATIO = 100
MAX_NESTED_DEPTH = 1

# File extension -> format.
FORMATS = {
    "pptx": "pptx", "docx": "docx", "xlsx": "xlsx", "pdf": "pdf",
    "svg": "svg", "html": "html", "htm": "html", "json": "json",
}

# Names of entries that are archives themselves.
ARCHIVE_NAME = r"(?i)\.(zip|docx|pptx|xlsx|docm|pptm|xlsm)$"

PARTS_SCHEMA = (
    "doc_id string, format string, part string, ord int, size bigint, comp_size bigint, "
    "flags int, sha256 string, xml string, content binary, blocked string, depth int"
)


ARROW_TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
ARROW_PARTS = pa.schema([(name, ARROW_TYPES[kind]) for name, kind in map(str.split, PARTS_SCHEMA.split(", "))])
# Bytes of parts that leave a worker together.
FRAME_BYTES = 4_000_000


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW_PARTS.types)], schema=ARROW_PARTS)


@dataclass(frozen=True)
class Limits:
    input_bytes: int = MAX_INPUT_BYTES
    entries: int = MAX_ENTRIES
    expanded_bytes: int = MAX_EXPANDED_BYTES
    xml_part_bytes: int = MAX_XML_PART_BYTES
    relationships: int = MAX_RELATIONSHIPS
    ratio: int = MAX_RATIO
    nested_depth: int = MAX_NESTED_DEPTH


def format_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    pairs = [item for key, value in FORMATS.items() for item in (F.lit(key), F.lit(value))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), ext), F.lit("unknown"))


def scan_packages(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """One row per file: format by extension, size, digest, bytes.

    A file above the input limit is a row without bytes whose ``blocked`` says why. The length
    filters are pushed into the source, so such a file is never read into memory.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small, large = F.col("length") <= limits.input_bytes, F.col("length") > limits.input_bytes

    def rows(kept: DataFrame, digest: Column, content: Column, blocked: Column) -> DataFrame:
        return kept.select(
            F.col("path").alias("doc_id"), "path", format_of(F.col("path")).alias("format"), F.col("length").alias("byte_len"),
            digest.alias("sha256"), content.alias("content"), blocked.cast("string").alias("blocked"))

    read = rows(files.filter(small), F.sha2("content", 256), F.col("content"), F.lit(None))
    refused = rows(files.filter(large), F.lit(None).cast("string"), F.lit(None).cast("binary"), F.lit("INPUT_TOO_LARGE"))
    return read.unionByName(refused)


def oversized(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """Files above the input limit, as issues; only file metadata is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(F.col("length") > limits.input_bytes).select(
        F.col("path").alias("doc_id"),
        F.lit("INPUT_TOO_LARGE").alias("code"),
        F.lit("error").alias("severity"),
        F.col("length").alias("byte_len"),
    )


class Budget:
    """Entries and bytes of a package and all archives inside it, against one set of limits."""

    def __init__(self, limits: Limits):
        self.limits, self.entries, self.expanded = limits, 0, 0

    def refusal(self, archive: zipfile.ZipFile, depth: int) -> str | None:
        """Limits that can be checked on a directory, before anything of that archive is inflated."""
        limits, entries = self.limits, archive.infolist()
        self.entries += len(entries)
        self.expanded += sum(e.file_size for e in entries)
        if self.entries > limits.entries:
            return "ZIP_ENTRY_LIMIT_EXCEEDED"
        if self.expanded > limits.expanded_bytes:
            return "ZIP_EXPANDED_BYTES_EXCEEDED"
        for entry in entries:
            if entry.flag_bits & 1:
                return "ZIP_ENCRYPTED_ENTRY"
            if entry.compress_size and entry.file_size / entry.compress_size > limits.ratio:
                return "ZIP_COMPRESSION_RATIO_EXCEEDED"
            if entry.filename.lower().endswith((".xml", ".rels")) and entry.file_size > limits.xml_part_bytes:
                return "ZIP_XML_PART_TOO_LARGE"
            if depth >= limits.nested_depth and re.search(ARCHIVE_NAME, entry.filename):
                return "ZIP_NESTED_ZIP_DETECTED"
        return None


def _decode(name: str, data: bytes) -> str | None:
    if not name.lower().endswith((".xml", ".rels")):
        return None
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return None


def _shred_one(doc_id, fmt, content: bytes | None, blocked: str | None, limits: Limits, inner: bool) -> list[tuple]:
    """Parts of a package; a work list holds the archives found inside it, each a level deeper."""
    refused = lambda code: [(doc_id, fmt, *[None] * 8, code, 0)]
    if content is None:
        return refused(blocked or "INPUT_MISSING")
    rows, budget, work = [], Budget(limits), [("", content, 0)]
    while work:
        prefix, data, depth = work.pop()
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                reason = budget.refusal(archive, depth)
                if reason:
                    return refused(reason)
                for entry in archive.infolist():
                    with archive.open(entry) as handle:
                        part = handle.read()
                    name = prefix + entry.orig_filename
                    if inner or not depth:
                        rows.append((doc_id, fmt, name, len(rows), entry.file_size, entry.compress_size, entry.flag_bits,
                                     hashlib.sha256(part).hexdigest(), _decode(name, part), part, None, depth))
                    if re.search(ARCHIVE_NAME, entry.filename) and zipfile.is_zipfile(io.BytesIO(part)):
                        work.append((name + "!/", part, depth + 1))
        except (zipfile.BadZipFile, ValueError, NotImplementedError, EOFError, OSError) as error:
            return refused("ZIP_ENCRYPTED_ENTRY" if "encrypted" in str(error) else "ZIP_CENTRAL_DIRECTORY_INVALID")
    return rows


def shred(packages: DataFrame, limits: Limits = Limits(), inner: bool = False) -> DataFrame:
    """Parts of every package; a refused package is one row with ``blocked`` set.

    Archives inside a package count against the limits of the package and are opened down to the depth
    allowed; one that lies deeper refuses the package. With ``inner`` their parts are rows as well, named after the part that holds them
    (``word/embeddings/book.xlsx!/xl/workbook.xml``), with their ``depth``.

    File splits are already balanced by size, so no shuffle is needed: each
    package is read where its bytes are. Parts are handed on as soon as there are ``FRAME_BYTES`` of them.
    """
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for values in zip(*[batch.column(c) for c in ("doc_id", "format", "content", "blocked")]):
                doc_id, fmt, content, blocked = (v.as_py() for v in values)
                found = _shred_one(doc_id, fmt, content, blocked, limits, inner)
                rows += found
                held += sum(row[4] or 0 for row in found) + 1000 * len(found)
                if held > FRAME_BYTES:
                    yield _frame(rows)
                    rows, held = [], 0
            if rows:
                yield _frame(rows)

    blocked = F.col("blocked") if "blocked" in packages.columns else F.lit(None).cast("string")
    narrow = packages.select(F.col("doc_id").cast("string").alias("doc_id"), "format", "content", blocked.alias("blocked"))
    return narrow.mapInArrow(explode, PARTS_SCHEMA)


def readable(parts: DataFrame) -> DataFrame:
    """Parts of the packages that passed the limits."""
    return parts.filter(F.col("blocked").isNull())


def pack(parts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Parts back to package bytes in original order.

    A package is one zip and therefore one group, but its size is bounded:
    documents above the entry or byte limit are returned with ``blocked`` set
    and their bytes are not gathered.
    """
    body = F.coalesce(F.col("content"), F.encode(F.col("xml"), "UTF-8")) if "content" in parts.columns \
        else F.encode(F.col("xml"), "UTF-8")
    rows = parts.select("doc_id", "format", "part", "ord", body.alias("content"))
    totals = rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("entries"), F.sum(F.octet_length("content")).alias("bytes"), F.min(F.struct("ord", "part")).alias("first")
    )
    over = (F.col("entries") > limits.entries) | (F.col("bytes") > limits.expanded_bytes)

    def build(group: pa.Table) -> pa.Table:
        one = lambda fmt, content, why: pa.table({
            "doc_id": group.column("doc_id").slice(0, 1), "format": fmt, "content": pa.array([content], pa.binary()), "blocked": pa.array([why], pa.string())})
        if group.column("over")[0].as_py():
            return one(pa.array([None], pa.string()), None, "PACKAGE_TOO_LARGE")
        order, names = group.column("ord").to_pylist(), group.column("part").to_pylist()
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            for i in sorted(range(len(order)), key=lambda i: (order[i] is None, order[i] or 0)):
                archive.writestr(zipfile.ZipInfo(names[i], (1980, 1, 1, 0, 0, 0)), group.column("content")[i].as_py(), zipfile.ZIP_DEFLATED)
        return one(group.column("format").slice(0, 1), buffer.getvalue(), None)

    id_type = parts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, format string, content binary, blocked string"
    # Of a package above the limits one row without bytes is left, so that nothing large is gathered.
    sized = rows.join(totals.select("doc_id", over.alias("over"), "first"), "doc_id")
    kept = sized.filter(~F.col("over") | (F.struct("ord", "part") == F.col("first"))).withColumn(
        "content", F.when(~F.col("over"), F.col("content")))
    return kept.drop("first").groupBy("doc_id").applyInArrow(build, schema)


def write_packages(packed: DataFrame, path: str) -> None:
    """Package bytes as a Parquet table; the commit protocol makes the write atomic."""
    packed.filter(F.col("blocked").isNull()).select("doc_id", "format", "content").write.mode("overwrite").parquet(path)
