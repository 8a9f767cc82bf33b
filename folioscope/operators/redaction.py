"""Redaction of secrets and absolute paths in text and JSON documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.xml import matches, substitute

MASK = "<redacted:secret-like-token>"

# Secret patterns in the order they apply, with their replacements.
SECRETS = [
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?s:.*?)-----END [A-Z ]*PRIVATE KEY-----", MASK),
    (r"\bBearer\s+[A-Za-z0-9._~+/=-]{12,}\b", "Bearer " + MASK),
    (r"(?i)\b(?:sk|pk|api|key|token|secret)[-_]?[A-Za-z0-9]{16,}\b", MASK),
    (r"(?i)\b([A-Za-z0-9_.-]*(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret)"
     r"""[A-Za-z0-9_.-]*\s*)=\s*["']?(?:[^"'\s;&]{6,})["']?""", "$1=" + MASK),
    (r"(?i)([?&](?:access[_-]?token|api[_-]?key|token|key|secret|signature)=)[^&#\s]+", "$1" + MASK),
    (r"(?i)\b(?:Cookie|Set-Cookie):\s*[^\n\r]+", "Cookie: " + MASK),
]

# Path patterns in order. A prefix group stands for a look-behind.
UNC = r"\\\\[^\\/\s]+[\\/][^\\/\s]+(?:[\\/][^\"'\s,;)]*)?"
DRIVE = r"\b[A-Za-z]:[\\/][^\"'\s,;)]*"
HOME = r"(^|[^\w:>/])~[\\/][^\"'\s,;)]*"
POSIX = r"(^|[^\w:>/.])/[^/\"'\s,;)][^\"'\s,;)]*/[^\"'\s,;)]+"


# What a text must hold before a secret pattern can match at all; cheap to test.
SECRET_WORDS = "(?i)passw|pwd|secret|token|key"
SECRET_HINTS = [
    lambda t: F.contains(t, F.lit("-----BEGIN")),
    lambda t: F.contains(t, F.lit("Bearer")),
    lambda t: t.rlike("[A-Za-z0-9]{16}"),
    lambda t: F.contains(t, F.lit("=")) & t.rlike(SECRET_WORDS),
    lambda t: F.contains(t, F.lit("=")) & t.rlike("[?&]"),
    lambda t: t.rlike("(?i)cookie:"),
]


def _masked(text: str, step: int) -> Column:
    pattern, replacement = SECRETS[step]
    column = F.col(text)
    return F.when(SECRET_HINTS[step](column), F.regexp_replace(column, pattern, replacement)).otherwise(column)


def _hits(text: str, step: int) -> Column:
    column = F.col(text)
    return F.when(SECRET_HINTS[step](column), F.regexp_count(column, F.lit(SECRETS[step][0]))).otherwise(0)


def redact_secrets(df: DataFrame, column: str) -> DataFrame:
    """Text with secrets masked and the number of redactions.

    Each step is a column of its own, so a later pattern sees the earlier masks.
    """
    out = df.withColumn("redacted", F.col(column)).withColumn("redactions", F.lit(0))
    for step in range(len(SECRETS)):
        out = out.withColumn("redactions", F.col("redactions") + _hits("redacted", step))
        out = out.withColumn("redacted", _masked("redacted", step))
    return out


def _record(step: int):
    return lambda m: F.struct(F.lit(step).alias("step"), F.length(m).alias("matched_chars"))


def _relabel(label: str):
    return lambda suffix: F.concat(F.lit(label), F.replace(suffix, F.lit("\\"), F.lit("/")))


def secret_records(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """One record per redaction: pattern step and location; matched text is not kept."""
    out = df.select(*keys, F.col(column).alias("_t0"))
    steps = []
    none = F.array().cast("array<struct<step:int,matched_chars:int>>")
    for step, (pattern, _) in enumerate(SECRETS):
        found = F.when(SECRET_HINTS[step](F.col(f"_t{step}")), F.transform(matches(f"_t{step}", pattern, 0), _record(step))).otherwise(none)
        out = out.withColumn(f"_r{step}", found).withColumn(f"_t{step + 1}", _masked(f"_t{step}", step))
        steps.append(F.col(f"_r{step}"))
    return out.select(*keys, F.inline(F.concat(*steps)))


def _root_pattern(root: str) -> str:
    escaped = "".join("[\\\\/]" if ch in "\\/" else re.escape(ch) for ch in root.rstrip("\\/"))
    return rf"(?i){escaped}((?:[\\/][^\"'\s,;)]*)?)"


def redact_paths(df: DataFrame, column: str, roots: dict[str, str] | None = None) -> DataFrame:
    """Known roots become labels (longest first), then UNC, drive, home and POSIX paths."""
    out = df.withColumn("redacted", F.col(column))
    for root, label in sorted((roots or {}).items(), key=lambda item: -len(item[0])):
        out = out.withColumn("redacted", substitute(F.col("redacted"), _root_pattern(root), _relabel(label), 1))
    for pattern, replacement in ((UNC, "<uncPath>"), (DRIVE, "<absolutePath>"), (HOME, "$1<userHome>")):
        out = out.withColumn("redacted", F.regexp_replace("redacted", pattern, replacement))
    posix = F.regexp_replace("redacted", POSIX, "$1<absolutePath>")
    return out.withColumn("redacted", F.when(F.col("redacted").startswith("#/"), F.col("redacted")).otherwise(posix))


def _children(node: Column) -> Column:
    """Members of an object or items of an array, with their paths."""
    value, path = node["v"], node["location"]
    members = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    items = F.try_variant_get(value, "$", "array<variant>")
    named = F.transform(members, lambda m: F.struct(F.concat(path, F.lit("."), m["key"]).alias("location"), m["value"].alias("v")))
    numbered = F.transform(items, lambda x, i: F.struct(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")).alias("location"), x.alias("v")))
    return F.when(_kind(value).startswith("OBJECT"), named).otherwise(numbered)


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _depth(text: Column) -> Column:
    """Nesting depth of a JSON text: the most brackets open at once, strings left out."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\\.", ""), '"[^"]*"', "")
    steps = F.transform(F.regexp_extract_all(bare, F.lit(r"[\[{\]}]"), F.lit(0)), lambda c: F.when(c.isin("[", "{"), 1).otherwise(-1))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(steps, start, lambda s, d: F.struct((s["now"] + d).alias("now"), F.greatest(s["most"], s["now"] + d).alias("most")), lambda s: s["most"])


def json_leaves(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``(keys, location, value, kind)`` for every leaf of a JSON document, however deep.

    Objects and arrays are opened level by level inside the row, as many levels as the document
    has: one scan, one explode, no join.
    """
    is_open = lambda n: _kind(n["v"]).rlike("^(OBJECT|ARRAY)")
    node, leaf = "array<struct<location:string,v:variant>>", "array<struct<location:string,value:string,kind:string>>"
    told = lambda n: F.struct(n["location"].alias("location"), F.try_variant_get(n["v"], "$", "string").alias("value"), _kind(n["v"]).alias("kind"))
    root = F.struct(F.lit("$").alias("location"), F.try_parse_json(column).alias("v"))
    rows = df.select(*keys, _depth(F.col(column)).alias("depth"), root.alias("root")).filter(F.col("root.v").isNotNull())

    def opened(state: Column, _: Column) -> Column:
        below = F.flatten(F.transform(F.filter(state["open"], is_open), _children))
        found = F.transform(F.filter(state["open"], lambda n: ~is_open(n)), told)
        return F.struct(below.cast(node).alias("open"), F.concat(state["leaves"], found).cast(leaf).alias("leaves"))

    start = F.struct(F.array("root").cast(node).alias("open"), F.array().cast(leaf).alias("leaves"))
    # One step more than there are levels: the last one takes the leaves of the deepest.
    leaves = F.aggregate(F.sequence(F.lit(0), F.col("depth")), start, opened, lambda s: s["leaves"])
    return rows.select(*keys, F.inline(leaves))


# Locations that are pointers, and locations with the start of a markup file.
POINTERS = r"\.(?:instancePath|schemaPath)$"
MARKUP = {r"(?i)\.svg$": r"(?i)^<svg\b", r"(?i)\.html?$": r"(?i)^(?:<!doctype\s+html|<html\b)", r"(?i)\.xml$": r"(?i)^<\?xml\b"}


def redact_json(df: DataFrame, keys: list[str], column: str, roots: dict[str, str] | None = None) -> DataFrame:
    """Every string leaf with paths, then secrets masked, and its location.

    Pointers into a document and whole markup files keep their paths.
    """
    leaves = json_leaves(df, keys, column)
    exempt = F.col("location").rlike(POINTERS)
    for name, start in MARKUP.items():
        exempt = exempt | (F.col("location").rlike(name) & F.ltrim(F.col("value")).rlike(start))
    masked = redact_paths(leaves, "value", roots).withColumn("_path", F.when(F.coalesce(exempt, F.lit(False)), F.col("value")).otherwise(F.col("redacted")))
    return redact_secrets(masked.drop("redacted"), "_path").select(
        *keys, "location", "redacted", (F.col("redacted") != F.col("value")).alias("changed"))
