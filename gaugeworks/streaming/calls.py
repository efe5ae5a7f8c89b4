"""The call log as a stream: idempotent progress, and event-time windows as an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeworks import schemas
from gaugeworks.sources.readers import log_order


def call_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Lines appended under ``path``; those that are half written are dropped."""
    rows = spark.readStream.schema(f"{schemas.LOGGED_CALL}, _bad string").option("columnNameOfCorruptRecord", "_bad").option("maxFilesPerTrigger", files_per_batch).json(path)
    return rows.withColumn("seq", log_order(scanned=False)).where("_bad is null and id is not null").drop("_bad", "append", "row")


def last_scores(calls: DataFrame) -> DataFrame:
    """The last score of each task in the log's order, as the batch reader has it, for an update or
    complete-mode sink. The log has no event time, so the state keeps every task: it is as large as
    the grid of tasks, which is known beforehand."""
    return calls.where("score is not null").groupBy("label", "id", "key", "run").agg(F.max_by("score", "seq").alias("score"))


def running_progress(calls: DataFrame) -> DataFrame:
    """Scores and failures per label, for a complete-mode sink."""
    return calls.groupBy("label").agg(F.count("score").alias("scored"), F.sum(F.col("score").isNull().cast("int")).alias("failed"))


def windowed(events: DataFrame, delay: str = "10 minutes", length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums per event type and window of event time; rows later than ``delay`` behind
    the newest are dropped when ``events`` is a stream, whose ts must be a timestamp with a zone."""
    at = F.window("ts", length, slide) if slide else F.window("ts", length)
    agg = events.withWatermark("ts", delay).groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return agg.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> StreamingQuery:
    """All that is available now, into an in-memory table."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return query
