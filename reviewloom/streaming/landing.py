"""Streams over landing folders of pull-request records and of listings.

The batch operators work on records as they are; here new files are picked up as
they land, repeats of a pull request within the watermark are dropped with state
that is bounded by the watermark, and each micro-batch goes through the same
proposals as a batch would.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.operators.label import review_file
from reviewloom.sources import listing
from reviewloom.sources.records import RAW


def landed(spark: SparkSession, path: str, delay: str = "1 day", files_per_trigger: int = 1000) -> DataFrame:
    """New records, the first of each (repository, pullNumber) within the delay."""
    rows = spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_trigger).json(path)
    timed = rows.withColumn("collected", F.to_timestamp("collectedAt"))
    return timed.withWatermark("collected", delay).dropDuplicatesWithinWatermark(["repository", "pullNumber"])


def to_raw(df: DataFrame) -> DataFrame:
    """Landed names to the names that the operators use."""
    comments = F.transform("reviewComments", lambda c: F.struct(c["path"].alias("path"), c["body"].alias("body")))
    return df.select("repository", F.col("pullNumber").alias("pull_number"), F.col("sourceUrl").alias("source_url"), "title", comments.alias("comments"))


def propose_stream(spark: SparkSession, path: str, checkpoint: str, sink: Callable[[DataFrame, int], None], delay: str = "1 day"):
    """A query that hands each micro-batch's review entries to ``sink``; runs through what is there, then stops."""

    def handle(batch: DataFrame, epoch: int) -> None:
        sink(review_file(to_raw(batch)), epoch)

    return landed(spark, path, delay).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_pulls(spark: SparkSession, path: str, since: str = "") -> DataFrame:
    """Merged pull requests of a landed listing from ``since`` on, as crawls land; one that is edited comes again with its later ``updated_at``."""
    listing.register(spark)
    rows = spark.readStream.format("pull_listing").option("since", since).load(path)
    return rows.where(F.col("merged_at").isNotNull() & (F.coalesce("merge_commit_sha", F.lit("")) != ""))


def merged_per_window(events: DataFrame, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts by event type and tumbling window; late rows beyond the delay are dropped in a stream."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
