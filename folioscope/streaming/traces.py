"""Run logs as a stream of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.operators.runs import finish_summary

TRACE_SCHEMA = (
    "run_id string, step_idx int, step_id string, command string, status string, exit_code int, started_ms bigint, "
    "finished_ms bigint, args string, envelope string"
)
SUMMARISED = ["run_id", "step_idx", "step_id", "status", "started_ms", "finished_ms"]
STEP = "run_id string, step_idx int, rows bigint, passed bigint, failed struct<id: string>, started_ms bigint, finished_ms bigint"


def read_traces(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Append-only log files, picked up as they appear."""
    return spark.readStream.schema(TRACE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def start_summaries(traces: DataFrame, table_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep the steps of every run, as aggregates whose state lives in the checkpoint.

    A batch reads its own rows only, and puts out the steps that it changed. Which steps count depends on the first failure, and that
    may arrive after later steps, or be followed by an earlier one: :func:`latest` decides it, so the same log
    gives the same answer as the batch. State is a row a step, so no run is one state. Rows without a position are not part of a
    run. Each micro-batch writes its own folder, so a replayed batch overwrites itself.
    """
    failed = F.when(F.col("status") == "fail", F.struct(F.col("step_id").alias("id")))
    steps = traces.select(*SUMMARISED).filter(F.col("step_idx").isNotNull()).groupBy("run_id", F.col("step_idx").cast("int").alias("step_idx")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "pass").alias("passed"), F.min(failed).alias("failed"),
        F.min("started_ms").alias("started_ms"), F.max("finished_ms").alias("finished_ms"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")

    writer = steps.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def latest(spark: SparkSession, table_path: str) -> DataFrame:
    """Summary of every run seen so far, from what the last batch said of each of its steps."""
    fields = ["rows", "passed", "failed", "started_ms", "finished_ms"]
    table = spark.read.schema(f"{STEP}, batch bigint").parquet(table_path)
    last = table.groupBy("run_id", "step_idx").agg(F.max_by(F.struct(*fields), "batch").alias("s")).select("run_id", "step_idx", "s.*")
    stop = last.filter(F.col("failed").isNotNull()).groupBy("run_id").agg(
        F.min(F.struct(F.col("step_idx").alias("at"), F.col("failed.id").alias("id"))).alias("first_failed"))
    counted = last.join(stop, "run_id", "left").filter(F.col("first_failed").isNull() | (F.col("step_idx") <= F.col("first_failed.at")))
    return finish_summary(counted.groupBy("run_id").agg(
        F.sum("rows").alias("steps"), F.sum("passed").alias("passed"), F.first("first_failed").alias("first_failed"),
        F.min("started_ms").alias("started_ms"), F.max("finished_ms").alias("finished_ms")))
