"""Structured Streaming over folders: source decisions, continuous upserts by version, daily sales kept up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.buckets import BucketTable


def source_decisions(rows: DataFrame, state: DataFrame, version: str = "version") -> DataFrame:
    """source_key, content_hash, max_version, decision of each source file in rows (source_key, version, others).

    state holds source_key, content_hash and last_version of what was processed. unchanged: same content; not_newer:
    no version above the last one; process otherwise. The content hash doesn't depend on row order.
    """
    cols = [c for c in rows.columns if c != "source_key"]
    h = F.xxhash64(*cols)
    files = rows.groupBy("source_key").agg(F.concat_ws(":", F.count("*").cast("string"), F.bit_xor(h).cast("string"), F.sum(h.cast("decimal(38,0)")).cast("string")).alias("content_hash"), F.max(F.col(version).cast("string").try_cast("bigint")).alias("max_version"))
    known = state.select("source_key", F.col("content_hash").alias("_hash"), F.col("last_version").alias("_last"))
    decision = (
        F.when(F.col("_hash").isNull(), "process").when(F.col("_hash") == F.col("content_hash"), "unchanged")
        .when(F.col("max_version") <= F.col("_last"), "not_newer").otherwise("process")
    )
    return files.join(known, "source_key", "left").select("source_key", "content_hash", "max_version", decision.alias("decision"))


def mark_success(state: DataFrame, decided: DataFrame) -> DataFrame:
    """state after the decided files were processed; versions never go back."""
    done = decided.where("decision = 'process'").select("source_key", "content_hash", F.col("max_version").alias("last_version"))
    old = state.select("source_key", "content_hash", "last_version")
    both = old.alias("o").join(done.alias("d"), "source_key", "full_outer")
    return both.select("source_key", F.coalesce("d.content_hash", "o.content_hash").alias("content_hash"), F.greatest("o.last_version", "d.last_version").alias("last_version"))


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], timeout_s: int = 600) -> int:
    """Feeds what is new since the checkpoint to `each` in micro-batches, then stops; returns how many there were."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"the stream had more than {timeout_s} s of work")
    return sum(1 for p in query.recentProgress if p["numInputRows"])


def upsert_stream(stream: DataFrame, checkpoint: str, table: BucketTable, version: str, tie_break: tuple[str, ...] = ()) -> int:
    """Merges each micro-batch into the table, of which it rewrites the buckets of the batch's keys alone.

    Late rows lose by their version, whatever the order of arrival; a batch that runs again changes nothing.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # a merge reads it several times
        try:
            table.merge(batch, version, tie_break, by=f"{checkpoint}#{number}")
        finally:
            batch.unpersist()

    return run_available(stream, checkpoint, each)


def daily_stream(events: DataFrame, time: str, value: str, delay: str = "1 day") -> DataFrame:
    """Count and sum of each day of an append-only stream, kept until the watermark passes the day."""
    at = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return at.groupBy(F.window(time, "1 day").alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n", "total")


def file_stream(spark: SparkSession, schema, folder: str, pattern: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
