"""E1: pages landing in a folder -> flattened approaches -> the two tables.

Two forms:

* ``ingest_stream``: ``foreachBatch`` loads every micro-batch.  No streaming state is kept, and back-filled
  pages of old days are merged like any other.  Strict: the idempotent upsert of
  ``perigee.sources.tables``; a replayed batch (after a failure, foreachBatch is at-least-once) changes
  nothing.  Tolerant: ``perigee.sources.ledger`` writes the rows and the dead letters (broken pages,
  approaches that do not parse) under one record that also holds the epoch, so a replay writes
  neither twice.
* ``dedup_stream``: the watermark form; duplicates within ``delay`` of each other
  are dropped by streaming state, and rows later than the watermark are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from perigee.sources import feed, ledger, tables


def page_stream(spark: SparkSession, landing: str, max_files_per_trigger: int | None = None, strict: bool = True) -> DataFrame:
    """Pages as they land; tolerant reading keeps broken ones as ``feed.read_pages`` does."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return feed.pages_of(reader, landing, strict)


def flat_stream(spark: SparkSession, landing: str, max_files_per_trigger: int | None = None,
                strict: bool = True, all_approaches: bool = True) -> DataFrame:
    objects = feed.explode_objects(feed.explode_days(page_stream(spark, landing, max_files_per_trigger, strict)))
    return feed.flatten_all_approaches(objects, strict) if all_approaches else feed.flatten(objects, strict)


def ingest_stream(
    spark: SparkSession,
    landing: str,
    root: str,
    checkpoint: str,
    max_files_per_trigger: int | None = None,
    available_now: bool = True,
    strict: bool = True,
    keep: int | None = None,
) -> StreamingQuery:
    """Start the ingest; with ``available_now`` it stops once every landed page is loaded.

    ``strict=False`` goes on over broken pages and unreadable fields and keeps them as dead letters
    (``ledger.read_rejects``, ``ledger.read_ledger``).

    ``keep`` removes, after each batch, the records but the newest ``keep`` and the versions that only older ones
    name (``tables.retain`` without grace): for a folder that no other writer loads and nobody reads meanwhile.
    """

    def tidy(spark: SparkSession) -> None:
        if keep is not None:
            tables.retain(spark, root, keep, grace_seconds=0)

    def load(batch: DataFrame, epoch_id: int) -> None:
        tables.upsert(batch.sparkSession, root, batch)
        tidy(batch.sparkSession)

    def load_pages(batch: DataFrame, epoch_id: int) -> None:
        ledger.load_pages(batch.sparkSession, root, batch, stream=checkpoint, epoch=epoch_id)
        tidy(batch.sparkSession)

    if strict:
        writer = flat_stream(spark, landing, max_files_per_trigger).writeStream.foreachBatch(load)
    else:
        writer = page_stream(spark, landing, max_files_per_trigger, strict=False).writeStream.foreachBatch(load_pages)
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def dedup_stream(flat: DataFrame, delay: str = "7 days") -> DataFrame:
    """Drop repeated (object, day) rows arriving within ``delay`` of each other."""
    return (
        flat.withColumn("_event_time", F.col("close_approach_date").cast("timestamp"))
        .withWatermark("_event_time", delay)
        .dropDuplicatesWithinWatermark(["neo_reference_id", "close_approach_date"])
        .drop("_event_time")
    )
