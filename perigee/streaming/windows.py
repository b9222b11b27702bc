"""E2: event-time tumbling-window counts over a stream of events.

The event time is cast to TIMESTAMP (the test tables store ``timestamp_ntz``, which
``withWatermark`` rejects).  Output modes:

* ``update``: each trigger emits the windows whose counts changed; they replace their
  rows in a table of versioned window days: touched days are written anew beside the old
  ones, and one record with the days' versions and the stream's epoch switches them at once, so a
  crash before it leaves the old counts and a replayed epoch changes nothing.  State older than the
  watermark is evicted, late rows are dropped, and the table always holds the current count
  of every window.  The mode for long-running streams.
* ``append``: a window is written once the watermark passes its end.
* ``complete``: every trigger rewrites the whole result and all windows stay in state.
"""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from perigee.sources import store

WINDOW_KEY = ["window_start", "window_end", "event_type"]
WINDOW_DAY = "window_day"


def window_counts(events: DataFrame, window: str = "1 day", watermark: str = "1 day",
                  time_col: str = "ts") -> DataFrame:
    """Per (window, event_type): number of events and the largest value."""
    return (
        events.withColumn("_t", F.col(time_col).cast("timestamp"))
        .withWatermark("_t", watermark)
        .groupBy(F.window("_t", window).alias("w"), F.col("event_type"))
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.max("value").alias("max_value"),
        )
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("w.end").cast("timestamp_ntz").alias("window_end"),
            "event_type",
            "n_events",
            "max_value",
        )
    )


def events_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream the Parquet files of ``path``; a single file streams from its folder
    (the file source watches folders) with a glob naming the file."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if path.endswith(".parquet"):
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def run_window_counts(
    spark: SparkSession,
    source: str,
    out: str,
    checkpoint: str,
    mode: str = "complete",
    window: str = "1 day",
    watermark: str = "1 day",
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Run to the end of the available input.

    ``complete``: every trigger writes the full result to ``out/batch=<id>``
    (``read_latest`` picks the last one).  ``append``: closed windows are appended to
    ``out`` as Parquet.
    """
    counts = window_counts(events_stream(spark, source, max_files_per_trigger), window, watermark)
    if mode == "append":
        writer = counts.writeStream.outputMode("append").format("parquet").option("path", out)
    elif mode == "update":

        def merge(batch: DataFrame, epoch_id: int) -> None:
            merge_window_counts(batch.sparkSession, out, batch, stream=checkpoint, epoch=epoch_id)

        writer = counts.writeStream.outputMode("update").foreachBatch(merge)
    elif mode == "complete":

        def write(batch: DataFrame, epoch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={epoch_id:012d}")

        writer = counts.writeStream.outputMode("complete").foreachBatch(write)
    else:
        raise ValueError(mode)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@contextmanager
def session_time_zone(spark: SparkSession, tz: str = "UTC"):
    """Run with ``spark.sql.session.timeZone`` set to ``tz``, restoring it afterwards.

    ``timestamp_ntz`` event times become instants in the session zone; pinning UTC makes
    the windows align to UTC wall-clock days, as the stored event times are written.
    """
    key = "spark.sql.session.timeZone"
    old = spark.conf.get(key)
    spark.conf.set(key, tz)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def _counts_schema(updates: DataFrame) -> T.StructType:
    return T.StructType([*updates.schema.fields, T.StructField(WINDOW_DAY, T.DateType())])


def _days(spark: SparkSession, out: str, schema: T.StructType, days: dict[str, str]) -> DataFrame:
    paths = [f"{out}/counts/{run}/{WINDOW_DAY}={day}" for day, run in sorted(days.items())]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{out}/counts").parquet(*paths).select(*schema.names)


def merge_window_counts(
    spark: SparkSession, out: str, updates: DataFrame, stream: str = "", epoch: int | None = None
) -> int:
    """Replace the rows of updated windows; returns the number of the record that holds them.

    The updates (a stateful plan) are evaluated once, into a staging folder.  The days they touch are merged
    with their stored versions and written as new ones; the next record names the version of each day and,
    with ``epoch``, how far ``stream`` has come.  An epoch that is committed already changes nothing.
    """
    before = store.newest(spark, out) or {"run_no": 0, "days": {}, "streams": {}}
    if epoch is not None and before["streams"].get(stream, -1) >= epoch:
        return before["run_no"]
    run_no, schema = before["run_no"] + 1, _counts_schema(updates)
    run, staging = f"run={run_no:012d}-{uuid.uuid4().hex[:8]}", f"{out}/staging/{uuid.uuid4().hex}"
    updates.withColumn(WINDOW_DAY, F.to_date("window_start")).write.parquet(staging)
    staged = spark.read.schema(schema).parquet(staging)
    touched = {str(r[0]) for r in staged.select(WINDOW_DAY).distinct().collect()}  # one row per calendar day
    old = _days(spark, out, schema, {d: r for d, r in before["days"].items() if d in touched})
    keys = staged.select(*[F.col(k).alias(f"_u_{k}") for k in WINDOW_KEY])
    match = [old[k].eqNullSafe(keys[f"_u_{k}"]) for k in WINDOW_KEY]
    merged = old.join(keys, match, "left_anti").unionByName(staged)
    seen = Observation()
    # a day has few rows: one task writes whole days
    placed = merged.repartition(WINDOW_DAY).observe(seen, F.count(F.lit(1)).alias("n"))
    placed.write.partitionBy(WINDOW_DAY).parquet(f"{out}/counts/{run}")
    n = _days(spark, out, schema, dict.fromkeys(touched, run)).count()
    if n != seen.get["n"]:
        raise RuntimeError(f"{run}: {n} windows read back, {seen.get['n']} written; not committed")
    streams = before["streams"] | ({} if epoch is None else {stream: epoch})
    record = {"run_no": run_no, "days": before["days"] | dict.fromkeys(touched, run), "streams": streams, "schema": schema.json()}
    if not store.create_new(spark, store.record_path(out, run_no), record):
        raise RuntimeError(f"another stream committed {run_no} under {out}")
    store.remove(spark, staging)
    return run_no


def read_counts(spark: SparkSession, out: str) -> DataFrame:
    """The table maintained by ``run_window_counts(mode='update')``."""
    record = store.newest(spark, out)
    if record is None:
        raise FileNotFoundError(f"nothing committed under {out}")
    schema = T.StructType.fromJson(json.loads(record["schema"]))
    return _days(spark, out, schema, record["days"]).drop(WINDOW_DAY)


def retain_counts(spark: SparkSession, out: str, grace_seconds: float = 86_400) -> list[str]:
    """Remove records but the newest, and day versions and staging folders that it does not name and that have
    not changed for ``grace_seconds``."""
    numbers = store.record_numbers(spark, out)
    removed = [store.record_path(out, n) for n in numbers[:-1]]
    for path in removed:
        store.remove(spark, path)
    days = (store.newest(spark, out) or {"days": {}})["days"]
    reachable = {f"{run}/{WINDOW_DAY}={day}" for day, run in days.items()}
    old = [f"{out}/staging/{x}" for x in store.names(spark, f"{out}/staging")]
    for run in store.names(spark, f"{out}/counts"):
        parts = [x for x in store.names(spark, f"{out}/counts/{run}") if "=" in x]
        held = [x for x in parts if f"{run}/{x}" in reachable]
        old += [f"{out}/counts/{run}/{x}" for x in parts if x not in held] if held else [f"{out}/counts/{run}"]
    latest = time.time() - grace_seconds
    for path in old:
        if store.modified(spark, path) <= latest:
            store.remove(spark, path)
            removed.append(path)
    return removed


def read_latest(spark: SparkSession, out: str) -> DataFrame:
    """The newest complete result written by ``run_window_counts(mode='complete')``."""
    batches = spark.read.parquet(out)
    last = batches.agg(F.max("batch").alias("batch"))
    return batches.join(last, "batch", "left_semi").drop("batch")
