"""Run logs and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Commands that change documents; code prefix -> error category.
MUTATIONS = [
    "edit", "repair", "render", "export", "asset replace", "template fill", "design apply", "layout apply", "chart render",
    "diagram render", "schema fetch",
]
CATEGORIES = [("INPUT_", "input"), ("SCHEMA_", "schema"), ("SECURITY_", "security"), ("WORKFLOW_", "workflow"), ("FEATURE_", "unsupported")]
UNSUPPORTED = ["EXPORT_UNSUPPORTED", "UNSUPPORTED_FORMAT", "FORMAT_UNSUPPORTED"]


def trace_aggregates() -> list[Column]:
    """Aggregates of a run that a batch job and a stream share."""
    failed = F.when(F.col("status") == "fail", F.struct(F.col("step_idx").alias("at"), F.col("step_id").alias("id")))
    return [
        F.count(F.lit(1)).alias("steps"), F.count_if(F.col("status") == "pass").alias("passed"), F.min(failed).alias("first_failed"),
        F.min("started_ms").alias("started_ms"), F.max("finished_ms").alias("finished_ms")]


def run_summary(trace: DataFrame) -> DataFrame:
    """Per run: completed steps, first failed step, status, duration.

    A run ends at its first failure: later steps of the log do not count.
    """
    first = trace.filter(F.col("status") == "fail").groupBy("run_id").agg(F.min("step_idx").alias("stop_at"))
    seen = trace.join(first, "run_id", "left").filter(F.col("stop_at").isNull() | (F.col("step_idx") <= F.col("stop_at")))
    return finish_summary(seen.groupBy("run_id").agg(*trace_aggregates()))


def finish_summary(aggregated: DataFrame) -> DataFrame:
    return aggregated.select(
        "run_id", "steps", F.col("passed").alias("completed_steps"), F.col("first_failed.id").alias("failed_step"),
        F.when(F.col("first_failed").isNull(), "pass").otherwise("fail").alias("status"),
        (F.col("finished_ms") - F.col("started_ms")).alias("duration_ms"))


def run_changed(trace: DataFrame) -> DataFrame:
    """Whether any passing step of a run changed a document."""
    member = lambda path: F.get_json_object("envelope", path)
    hit = (member("$.mutationStatus") == "changed") | (member("$.result.changed") == "true") | (member("$.result.documentChanged") == "true")
    step = F.coalesce((F.col("status") == "pass") & F.coalesce(hit, F.lit(False)), F.lit(False))
    return trace.groupBy("run_id").agg(F.bool_or(step).alias("document_changed"))


def verify_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Existence and digest of every listed artifact; the digest prefix is optional."""
    bare = lambda c: F.regexp_replace(c, "^sha256:", "")
    joined = expected.select("path", F.col("sha256").alias("expected_sha256")).join(
        actual.select("path", "sha256", F.lit(True).alias("found")), "path", "left")
    same = bare("expected_sha256") == bare("sha256")
    status = (
        F.when(F.col("found").isNull(), "missing").when(F.col("expected_sha256").isNull(), "unchecked")
        .when(same, "ok").otherwise("digest_mismatch"))
    return joined.select("path", status.alias("status"))


def artifact_delta(expected: DataFrame, before: DataFrame, after: DataFrame, root: str) -> DataFrame:
    """Missing and unexpected artifacts, and artifacts outside the output root."""
    tag = lambda d, code: d.select("path", F.lit(code).alias("code"))
    missing = tag(expected.join(after, "path", "left_anti"), "ARTIFACT_MISSING")
    extra = tag(after.join(before, "path", "left_anti").join(expected, "path", "left_anti"), "ARTIFACT_UNEXPECTED")
    outside = tag(after.filter(~F.col("path").startswith(root.rstrip("/") + "/")), "SECURITY_PATH_OUTSIDE_ROOT")
    return missing.unionByName(extra).unionByName(outside)


def build_manifest(trace: DataFrame) -> DataFrame:
    """Artifacts of all steps; a bare file name takes the step's output path.

    ``args`` is a JSON array of command words; the word after ``--out`` names
    the output.
    """
    schema = "array<struct<path:string,kind:string,format:string,sha256:string,bytes:bigint>>"
    listed = F.coalesce(F.get_json_object("envelope", "$.artifacts"), F.get_json_object("envelope", "$.result.artifacts"))
    words = F.from_json("args", "array<string>")
    spot = F.array_position(words, "--out")
    out = F.when(spot > 0, F.try_element_at(words, (spot + 1).cast("int")))
    rows = trace.select("run_id", "step_idx", out.alias("out"), F.inline(F.from_json(listed, schema)))
    name = F.element_at(F.split(F.replace("out", F.lit("\\"), F.lit("/")), "/"), -1)
    path = F.when(F.col("path") == name, F.replace("out", F.lit("\\"), F.lit("/"))).otherwise(F.col("path"))
    return rows.select("run_id", "step_idx", path.alias("path"), "kind", "format", "sha256", "bytes")


def error_category(code: str = "code") -> Column:
    c = F.col(code)
    kind = F.when(c.isin("UNKNOWN_COMMAND", "UNKNOWN_OPTION"), "usage")
    for prefix, name in CATEGORIES:
        kind = kind.when(c.startswith(prefix), name)
    return kind.when(c.isin(UNSUPPORTED), "unsupported").otherwise("runtime")


def classify_results(results: DataFrame) -> DataFrame:
    """Mutation status, artifact status, error category and failure class per result.

    ``results`` keeps its key columns and has ``command, ok, code, plan_only,
    dry_run, would_change, changed, artifacts``.
    """
    c = F.col
    mutates = c("command").isin(MUTATIONS)
    mutation = (
        F.when(c("plan_only"), "plan_only").when(c("dry_run") & c("would_change"), "planned")
        .when(mutates & c("changed"), "changed").when(mutates & ~c("changed"), "noop").otherwise("not_applicable"))
    category = F.when(~c("ok"), error_category())
    return results.withColumns({
        "mutation_status": mutation, "artifact_status": F.when(c("artifacts") > 0, "complete").otherwise("not_expected"),
        "error_category": category, "failure_class": F.when(c("ok"), "none").otherwise(category)})
