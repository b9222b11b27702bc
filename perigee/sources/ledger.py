"""Landed pages into the tables, with every page and approach accounted for.

One pass routes what tolerant reading finds: ``good`` rows for the tables, rejected ``record``s (approaches
with fields that do not parse, any element of a list), rejected ``page``s (texts that are no page of the feed),
and ``bare`` objects without approaches, which only the dimension takes.  The routes are written once, side by
side; the load reads its part, the rejects stay as dead letters with their text.  The commit's record carries
the counts, and nothing is committed unless they add up:

* pages read = broken pages + pages whose content was routed;
* approaches read = rejected + good, where read is what the pages' own lists sum up to;
* good = new rows + duplicates, as the merge counted them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perigee.schemas import ASTEROIDS_SCHEMA, CLOSE_APPROACH_SCHEMA, FLAT_COLUMNS
from perigee.session import shuffle_files_removed
from perigee.sources import feed, store, tables

GOOD, BARE, RECORD, PAGE = "good", "bare", "record", "page"
FIELDS = {f.name: f for f in [*ASTEROIDS_SCHEMA.fields, *CLOSE_APPROACH_SCHEMA.fields]}
REJECT_SCHEMA = T.StructType(
    [
        T.StructField("page", T.StringType()),
        T.StructField("day", T.StringType()),
        T.StructField("element", T.IntegerType()),
        T.StructField("bad_fields", T.ArrayType(T.StringType())),
        T.StructField("text", T.StringType()),
    ]
)
ROUTED_SCHEMA = T.StructType(
    [*REJECT_SCHEMA.fields, *[FIELDS[c] for c in FLAT_COLUMNS], T.StructField("route", T.StringType())]
)


def listed_approaches(days: F.Column) -> F.Column:
    """How many approaches the lists of a page hold."""
    per_object = lambda n, o: n + F.coalesce(F.greatest(F.size(o["close_approach_data"]), F.lit(0)), F.lit(0))
    per_day = lambda n, objects: n + F.coalesce(F.aggregate(objects, F.lit(0), per_object), F.lit(0))
    return F.coalesce(F.aggregate(F.map_values(days), F.lit(0), per_day), F.lit(0)).cast("bigint")


def route(pages: DataFrame, read: Observation | None = None) -> DataFrame:
    """``ROUTED_SCHEMA`` rows of tolerantly read pages (``feed.read_pages(strict=False)``); ``read`` counts the
    pages, the broken ones and the approaches their lists hold."""
    broken = F.col(feed.CORRUPT).isNotNull()
    named = F.nullif(F.regexp_extract(feed.CORRUPT, r'"self"\s*:\s*"([^"]*)"', 1), F.lit(""))
    pages = pages.select(
        F.when(broken, F.coalesce(named, "page")).otherwise(F.col("page")).alias("page"),
        F.col(feed.CORRUPT).alias("text"),
        F.when(~broken, F.col("near_earth_objects")).alias("days"),
    )
    if read is not None:
        pages = pages.observe(
            read,
            F.count(F.lit(1)).alias("pages"),
            F.count("text").alias("broken_pages"),
            F.coalesce(F.sum(listed_approaches(F.col("days"))), F.lit(0)).alias("approaches"),
        )
    days = pages.select("page", "text", F.explode_outer("days").alias("day", "objects"))
    objects = days.select("page", "text", "day", F.explode_outer("objects").alias("obj"))
    found = objects.select(
        "page", "text", "day", "obj", F.posexplode_outer(F.col("obj").getField("close_approach_data")).alias("element", "_ap")
    )
    obj, ap, bad = F.col("obj"), F.col("_ap"), F.col("bad_fields")
    # an object without approaches still can have an id that does not parse; parsed once for all that asks
    found = found.select("*", feed.unreadable(obj, ap).alias("bad_fields"))
    kind = (
        F.when(F.col("text").isNotNull(), PAGE).when(F.size(bad) > 0, RECORD).when(F.col("element").isNull(), BARE).otherwise(GOOD)
    )
    record = F.to_json(F.struct(obj["id"].alias("id"), obj["neo_reference_id"].alias("neo_reference_id"), ap.alias("approach")))
    return found.where(F.col("text").isNotNull() | obj.isNotNull()).select(
        "page",
        "day",
        "element",
        bad,
        F.when(F.col("text").isNotNull(), F.col("text")).when(F.size(bad) > 0, record).alias("text"),
        *feed.flat_columns(obj, ap, strict=False),
        kind.alias("route"),
    )


def load_pages(spark: SparkSession, root: str, pages: DataFrame, stream: str | None = None, epoch: int | None = None) -> int:
    """Load tolerantly read pages into the tables under ``root`` and keep what is rejected; the run number.

    ``stream`` and ``epoch`` name a batch that may come again: once committed it changes nothing any more.
    """
    before = store.newest(spark, root)
    if stream is not None and before and before["streams"].get(stream, -1) >= epoch:
        return before["run_no"]
    run = tables.new_run(before["run_no"] + 1 if before else 1)
    read, folder = Observation(), f"{root}/landed/{run}"
    # where a row that parses came from is asked no more: only what is rejected keeps its place
    kept = [F.when(F.col("route").isin(RECORD, PAGE), F.col(f.name)).alias(f.name) for f in REJECT_SCHEMA.fields]
    routed = route(pages, read).select(*kept, *FLAT_COLUMNS, "route")
    routed.write.mode("errorifexists").option("compression", "zstd").partitionBy("route").parquet(folder)
    routed = spark.read.schema(ROUTED_SCHEMA).parquet(folder)
    listed = F.count_if((F.col("route") == GOOD) | F.col("element").isNotNull())  # rows that stand for an element of a list
    found = routed.groupBy("route").agg(F.count(F.lit(1)), listed).collect()  # four routes
    counts, routed_approaches = {r[0]: r[1] for r in found}, sum(r[2] for r in found)
    seen = read.get
    if routed_approaches != seen["approaches"] or counts.get(PAGE, 0) != seen["broken_pages"]:
        raise RuntimeError(f"{run}: routed {counts}, read {seen}; not committed")
    ledger = {
        "pages": seen["pages"],
        "broken_pages": seen["broken_pages"],
        "approaches": seen["approaches"],
        "rejected": counts.get(RECORD, 0),
        "bare_objects": counts.get(BARE, 0),
        "good": counts.get(GOOD, 0),
    }
    n_rejects = counts.get(RECORD, 0) + counts.get(PAGE, 0)
    batch = routed.where(F.col("route").isin(GOOD, BARE)).select(*FLAT_COLUMNS)
    with shuffle_files_removed(spark):
        run_no = tables.load_staged(spark, root, batch, ledger, {run: n_rejects} if n_rejects else {}, stream, epoch)
    for part in (GOOD, BARE):
        store.remove(spark, f"{folder}/route={part}")
    return run_no


def read_rejects(spark: SparkSession, root: str, run_no: int | None = None) -> DataFrame:
    """(page, day, element, bad_fields, text, route) of everything rejected by the loads behind a record."""
    record = tables._manifest(spark, root, run_no)
    schema = T.StructType([*REJECT_SCHEMA.fields, T.StructField("route", T.StringType())])
    if record is None or not record["rejects"]:
        return spark.createDataFrame([], schema)
    paths = [f"{root}/landed/{run}" for run in sorted(record["rejects"])]
    found = spark.read.schema(schema).option("basePath", f"{root}/landed").parquet(*paths)
    return found.where(F.col("route").isin(RECORD, PAGE)).select(*schema.names)


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """One row per kept commit that loaded pages: run_no and its counts."""
    names = ["pages", "broken_pages", "approaches", "rejected", "bare_objects", "good", "new", "duplicates"]
    rows = []
    for n in store.record_numbers(spark, root):
        ledger = store.read_record(spark, store.record_path(root, n))["ledger"]
        if ledger and "pages" in ledger:
            rows.append((n, *[ledger[k] for k in names]))
    return spark.createDataFrame(rows, "run_no bigint, " + ", ".join(f"{k} bigint" for k in names))
