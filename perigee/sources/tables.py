"""Loading the two tables: projection, de-duplication, versioned upsert, publication.

Layout (Parquet) under ``<root>``; a ``<run>`` is named by the number it was begun with and a random part:

* ``asteroids/<run>``: one row per ``id`` plus ``seen_day``, the newest feed day on which it stood.
* ``close_approach/<run>/approach_month=<month>``: files range-partitioned and sorted by (day,
  object), so date predicates prune months and skip row groups inside a month.
* ``summary/<run>/approach_month=<month>``: rows and keyed rows per orbiting body of that month's version.
* ``landed/<run>/route=<route>``: what a load of pages routed (``perigee.sources.ledger``); the rejects stay.
* ``manifest/<n>.json``: one record per commit: the run of the dimension, the run and rows of each month, the
  runs with rejects, the last epoch of each stream, and the ledger of the load.

Nothing stored is ever changed in place.  A load writes its batch once, writes new versions of what the batch
touches (the dimension, the months) beside the old ones, checks their row counts against those seen while
writing, and then creates the next record, which switches everything at once.  A crash before that leaves
files that no reader looks at; the load can be run again.  Readers resolve the newest record.

Several writers: creating a record succeeds for one of them.  The other reads the new record, merges anew
what its batch shares with it (months that got another run since, and the dimension), keeps its other
versions, and tries the next number.  ``retain`` removes versions no kept record refers to.

The survivor per object (newest feed day, then a total order) and per (object, day) does not depend on
the order of rows, batches, writers or replays.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perigee.operators.dedup import APPROACH_ORDER, ASTEROID_ORDER, SPREAD, dedup_by_key, dedup_placed, spread
from perigee.operators.filters import MONTH_PARTITION
from perigee.schemas import APPROACH_COLUMNS, ASTEROID_COLUMNS, ASTEROIDS_SCHEMA, CLOSE_APPROACH_SCHEMA, FLAT_COLUMNS
from perigee.session import shuffle_files_removed
from perigee.sources import store

FACT_PARTITION = MONTH_PARTITION
NO_MONTH = "__HIVE_DEFAULT_PARTITION__"  # Spark's directory name for a NULL partition value
APPROACH_KEY = ("neo_reference_id", "close_approach_date")
# Rows per output file; a hot day is split over several files and tasks.
MAX_RECORDS_PER_FILE = 5_000_000
# A load merges up to GROUPS runs of the calendar one after another, and the dimension in as many sets of ids (dealt by
# their hash); rows of one, at least.
GROUPS, GROUP_ROWS, DIMENSION_ROWS = 16, 4_000_000, 16_000_000


# --------------------------------------------------------------------------- I8, I9
def load_asteroids(flat: DataFrame) -> DataFrame:
    """The dimension from flat feed rows: one row per id.

    The feed lists an object under each day it passes: equal rows become one before the versions of an id are compared,
    as their strings make that a sort of all rows (and its spill), while equal rows are found by their hash.
    """
    return dedup_by_key(flat.select(*ASTEROID_COLUMNS).distinct(), ["id"], ASTEROID_ORDER)


def load_asteroids_in_parts(spark: SparkSession, parts: Iterable[DataFrame], path: str) -> DataFrame:
    """``load_asteroids`` of flat feed rows that come in parts (an object may stand in several): each part is merged into
    the dimension of those before it, whose version goes then, so the shuffle files of one part lie on the disks."""
    current: DataFrame | None = None
    for i, part in enumerate(parts):
        rows = part.select(*ASTEROID_COLUMNS)
        merged = load_asteroids(rows if current is None else current.unionByName(rows))
        with shuffle_files_removed(spark):
            merged.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/{i}")
        if current is not None:
            store.remove(spark, f"{path}/{i - 1}")
        current = spark.read.schema(ASTEROIDS_SCHEMA).parquet(f"{path}/{i}")
    return current


def has_approach() -> F.Column:
    return F.greatest(*[F.col(c).isNotNull() for c in APPROACH_COLUMNS if c != "neo_reference_id"])


def load_close_approach(flat: DataFrame) -> DataFrame:
    """The fact from flat feed rows: rows carrying an approach, one per (object, day)."""
    rows = flat.select(*APPROACH_COLUMNS).where(has_approach())
    return dedup_by_key(rows, list(APPROACH_KEY), APPROACH_ORDER)


# --------------------------------------------------------------------------- I10
def create_tables(spark: SparkSession, database: str, location: str) -> tuple[str, str]:
    """Create the typed tables if absent (external, at ``location``)."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{location}'")
    a_cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ASTEROIDS_SCHEMA.fields)
    c_cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _fact_schema().fields)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {database}.asteroids ({a_cols}) USING parquet LOCATION '{location}/asteroids'"
    )
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {database}.close_approach ({c_cols}) USING parquet "
        f"PARTITIONED BY ({FACT_PARTITION}) LOCATION '{location}/close_approach'"
    )
    return f"{database}.asteroids", f"{database}.close_approach"


def _absent(new: DataFrame, stored: DataFrame, keys: tuple[str, ...], columns: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored; with a NULL in the key, rows that are not stored as they are."""

    def row(df: DataFrame) -> F.Column:
        unknown = F.greatest(*[df[k].isNull() for k in keys], F.lit(False))
        return F.when(unknown, F.xxhash64(*[df[c] for c in columns]))

    there = stored.select(*[F.col(k).alias(f"_{k}") for k in keys], row(stored).alias("_there"))
    same = row(new).eqNullSafe(F.col("_there"))
    for k in keys:
        same = same & new[k].eqNullSafe(F.col(f"_{k}"))
    return new.join(there, same, "left_anti")


def insert_tables(spark: SparkSession, names: tuple[str, str], asteroids: DataFrame, approaches: DataFrame) -> None:
    """Add rows whose key is not in the catalog tables yet (a repeated insert adds nothing; a newer version of
    an object that is there is not taken: use ``upsert`` for that).

    Rows with a NULL in the key have no identity to be found by: an equal row counts as present.
    Columns are matched by name, the partition column comes last; rows are dealt by (month, day,
    object), so a task writes few months.
    """
    a_name, c_name = names
    stored = spark.table(a_name)
    absent = _absent(asteroids, stored, ("id",), ASTEROID_COLUMNS).select(*stored.columns)
    with shuffle_files_removed(spark):
        absent.write.insertInto(a_name)
    stored = spark.table(c_name)
    new = _absent(approaches.select(*APPROACH_COLUMNS), stored, APPROACH_KEY, APPROACH_COLUMNS)
    order = [FACT_PARTITION, "close_approach_date", "neo_reference_id"]
    new = new.select(*APPROACH_COLUMNS, month_of(F.col("close_approach_date"))).repartitionByRange(*order)
    with shuffle_files_removed(spark):
        new.select(*stored.columns).write.insertInto(c_name)


# --------------------------------------------------------------------------- storage helpers
SEEN = "seen_day"
SEEN_ORDER = ((SEEN, "desc"), *ASTEROID_ORDER)
SUMMARY_SCHEMA = T.StructType(
    [
        T.StructField("orbiting_body", T.StringType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("n_keyed", T.LongType()),
        T.StructField(FACT_PARTITION, T.DateType()),
    ]
)


def month_of(day: F.Column) -> F.Column:
    return F.trunc(day, "MM").alias(FACT_PARTITION)


def month_name(month: F.Column) -> F.Column:
    return F.coalesce(F.date_format(month, "yyyy-MM-dd"), F.lit(NO_MONTH)).alias("month")


def new_run(run_no: int) -> str:
    return f"run={run_no:012d}-{uuid.uuid4().hex[:8]}"


def write_fact(approaches: DataFrame, path: str, rows: Observation | None = None, placed: bool = False) -> None:
    """Range-partition by (month, day, object) so a hot day spreads over several tasks,
    sort each task's rows, and write one directory per month; ``rows`` gets the count as ``n`` and, where
    ``approaches`` has ``_n`` (input rows of each row), their sum as ``total``.  ``placed``: they come with their month,
    partitioned and sorted so already (``merged_months``)."""
    merged = F.col("_n") if "_n" in approaches.columns else F.lit(1).cast("bigint")
    if placed:
        there = approaches.select(*APPROACH_COLUMNS, merged.alias("_n"), FACT_PARTITION)
    else:
        order = [FACT_PARTITION, "close_approach_date", "neo_reference_id"]
        there = (
            approaches.select(*APPROACH_COLUMNS, merged.alias("_n"), month_of(F.col("close_approach_date")))
            .repartitionByRange(*order)
            .sortWithinPartitions(*order)
        )
    # counted after the exchange: the stages before it run once more to find the ranges
    if rows is not None:
        there = there.observe(rows, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_n"), F.lit(0)).alias("total"))
    (
        there.drop("_n")
        .write.mode("errorifexists")
        .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        .partitionBy(FACT_PARTITION)
        .parquet(path)
    )


def _fact_schema() -> T.StructType:
    return T.StructType([*CLOSE_APPROACH_SCHEMA.fields, T.StructField(FACT_PARTITION, T.DateType())])


def _stored_asteroids_schema() -> T.StructType:
    return T.StructType([*ASTEROIDS_SCHEMA.fields, T.StructField(SEEN, T.IntegerType())])


def _manifest(spark: SparkSession, root: str, run_no: int | None = None) -> dict | None:
    """The newest record (or that of ``run_no``); None where nothing was committed."""
    return store.newest(spark, root) if run_no is None else store.read_record(spark, store.record_path(root, run_no))


def _read_months(spark: SparkSession, root: str, months: dict[str, str], table: str = "close_approach") -> DataFrame:
    """The month directories a record names, with ``approach_month``."""
    schema = _fact_schema() if table == "close_approach" else SUMMARY_SCHEMA
    if not months:
        return spark.createDataFrame([], schema)
    base = f"{root}/{table}"
    paths = [f"{base}/{run}/{FACT_PARTITION}={month}" for month, run in sorted(months.items())]
    return spark.read.schema(schema).option("basePath", base).parquet(*paths).select(*[f.name for f in schema.fields])


def _read_dimension(spark: SparkSession, root: str, run: str) -> DataFrame:
    return spark.read.schema(_stored_asteroids_schema()).parquet(f"{root}/asteroids/{run}")


def _write_dimension(spark: SparkSession, root: str, asteroids: Iterable[DataFrame], run: str) -> int:
    """Write a version of the dimension, part after part, and check it; returns its rows."""
    written = 0
    for i, part in enumerate(asteroids):
        seen = Observation()
        mode = "append" if i else "errorifexists"
        part.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).parquet(f"{root}/asteroids/{run}")
        written += seen.get["n"]
    n = _read_dimension(spark, root, run).count()
    if n != written:
        raise RuntimeError(f"{run}: {n} objects read back, {written} written; not committed")
    return n


def _write_months(spark: SparkSession, root: str, approaches: DataFrame, run: str, placed: bool = False) -> tuple[dict[str, int], int]:
    """Write versions of months with their summaries and check them; returns rows by month and the input rows
    that went into them."""
    seen = Observation()
    write_fact(approaches, f"{root}/close_approach/{run}", seen, placed)
    there = spark.read.schema(_fact_schema()).parquet(f"{root}/close_approach/{run}")
    summary = there.groupBy(FACT_PARTITION, "orbiting_body").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("neo_reference_id").alias("n_keyed")
    )
    # one task for each month: a row per month and body
    summary.repartition(FACT_PARTITION).write.mode("errorifexists").partitionBy(FACT_PARTITION).parquet(f"{root}/summary/{run}")
    stored = spark.read.schema(SUMMARY_SCHEMA).parquet(f"{root}/summary/{run}")
    per_month = stored.groupBy(month_name(F.col(FACT_PARTITION))).agg(F.sum("n_rows").alias("n"))
    rows = {r["month"]: r["n"] for r in per_month.collect()}  # one row per calendar month
    if sum(rows.values()) != seen.get["n"]:
        raise RuntimeError(f"{run}: {sum(rows.values())} rows read back, {seen.get['n']} written; not committed")
    return rows, seen.get["total"]


def _record(spark: SparkSession, root: str, before: dict | None, run_no: int, dimension: tuple[str, int],
            months: dict[str, str], month_rows: dict[str, int], **more) -> dict:
    """The next record; ``approaches_without_object`` looks at the months that are new in it."""
    old = before or {}
    new = {m: run for m, run in months.items() if old.get("months", {}).get(m) != run}
    orphans = 0
    if new:
        objects = _read_dimension(spark, root, dimension[0])
        # an object's approaches are counted before they meet the dimension
        fact = _read_months(spark, root, new).groupBy("neo_reference_id").agg(F.count(F.lit(1)).alias("n"))
        alone = fact.join(objects, fact["neo_reference_id"] == objects["id"], "left_anti")
        orphans = alone.agg(F.sum("n")).first()[0] or 0
    return {
        "run_no": run_no,
        "asteroids_run": dimension[0],
        "asteroid_rows": dimension[1],
        "months": months,
        "month_rows": month_rows,
        "approach_rows": sum(month_rows.values()),
        "approaches_without_object": orphans,
        "rejects": old.get("rejects", {}) | more.get("rejects", {}),
        "streams": old.get("streams", {}) | more.get("streams", {}),
        "ledger": more.get("ledger"),
    }


# --------------------------------------------------------------------------- I11
def _versions(flat: DataFrame) -> DataFrame:
    """The versions of the objects in flat feed rows, each with the newest feed day on which it stood.

    Equal rows become one by their hash before versions are compared (see ``load_asteroids``); without an id a row has no
    identity, so its day stays its own.
    """
    rows = flat.select(*ASTEROID_COLUMNS, F.unix_date("close_approach_date").cast("int").alias(SEEN))
    apart = F.when(F.col("id").isNull(), F.col(SEEN)).alias("_day")
    newest = rows.groupBy(*ASTEROID_COLUMNS, apart).agg(F.max(SEEN).alias(SEEN))
    return newest.select(*ASTEROID_COLUMNS, SEEN)


def seen_asteroids(flat: DataFrame) -> DataFrame:
    """The dimension of flat feed rows with the newest feed day of each version of an object."""
    return merged_asteroids(None, _versions(flat))


def merged_asteroids(current: DataFrame | None, rows: DataFrame) -> DataFrame:
    """One row per id of the stored dimension and new rows: the version seen last wins.

    Rows come once for each version, so they go to their id's partition and are compared there only.
    """
    both = rows if current is None else current.unionByName(rows)
    return dedup_placed(spread(both, ["id"]).repartition("id", SPREAD), ["id"], SEEN_ORDER)


def merged_months(stored: DataFrame | None, batch: DataFrame, count: str | None = None) -> DataFrame:
    """Stored rows of the touched months plus the batch, one survivor per (object, day).

    The rows go once to the place where they are written, range-partitioned by (month, day, object), and are sorted and
    compared there.  With ``count`` they come with their month, as ``write_fact(placed=True)`` takes them.
    """
    rows = batch.select(*APPROACH_COLUMNS)
    if stored is not None:
        rows = stored.select(*APPROACH_COLUMNS).unionByName(rows)
    rows = rows.where(has_approach()).withColumn(FACT_PARTITION, F.trunc("close_approach_date", "MM"))
    key = [FACT_PARTITION, *APPROACH_KEY[::-1]]
    merged = dedup_placed(spread(rows, key).repartitionByRange(*key, SPREAD), key, APPROACH_ORDER, count)
    return merged if count else merged.select(*APPROACH_COLUMNS)


def merged_in_parts(current: DataFrame | None, batch: DataFrame, parts: int) -> Iterator[DataFrame]:
    """``merged_asteroids`` of the stored dimension and a batch of flat rows, ``parts`` disjoint sets of ids."""
    for k in range(parts):
        own = F.pmod(F.xxhash64("id"), F.lit(parts)) == k if parts > 1 else F.lit(True)
        yield merged_asteroids(None if current is None else current.where(own), _versions(batch.where(own)))


def _parts(rows: int, least: int) -> int:
    return max(1, min(GROUPS, rows // least))


def _month_groups(rows: dict[str, int]) -> list[list[str]]:
    """Runs of months with about the same number of rows; months that follow each other stand together."""
    total = sum(rows.values())
    many = _parts(total, GROUP_ROWS)
    groups: dict[int, list[str]] = {}
    seen = 0
    for m in sorted(rows):
        groups.setdefault(seen * many // total, []).append(m)
        seen += rows[m]
    return list(groups.values())


def _of_months(batch: DataFrame, months: dict[str, tuple[int, int] | None]) -> DataFrame:
    """Rows of these months; their first and last day (None: rows without one) let the scan skip what lies outside."""
    day = F.col("close_approach_date")
    rows = batch.where(month_name(month_of(day)).isin(sorted(months)))
    if None in months.values():
        return rows
    first, last = min(lo for lo, _ in months.values()), max(hi for _, hi in months.values())
    return rows.where(day.between(F.date_from_unix_date(F.lit(first)), F.date_from_unix_date(F.lit(last))))


def load_staged(spark: SparkSession, root: str, batch: DataFrame, ledger: dict | None = None,
                rejects: dict[str, int] | None = None, stream: str | None = None, epoch: int | None = None) -> int:
    """Load a batch of flat rows that is written already; returns the run number.

    Only the directories of the months that the batch touches are read and written anew, a group of months at a
    time, as the dimension is a set of ids at a time: with ``shuffle_files_removed`` the shuffle files of one
    group lie on the disks and not those of the whole batch.  Another writer's
    commit in between is met by merging anew what both touch.  Rows are conserved: the rows of the batch and
    those stored in its months must be the rows written plus the duplicates merged away, else nothing is
    committed.  With ``stream`` and ``epoch`` a batch that was committed before is not loaded again.
    """
    day = F.col("close_approach_date")
    per_month = batch.where(has_approach()).groupBy(month_name(month_of(day))).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.unix_date(day)).alias("first"), F.max(F.unix_date(day)).alias("last")
    )
    found = per_month.collect()  # one row per calendar month
    incoming = {r["month"]: r["n"] for r in found}
    days = {r["month"]: None if r["first"] is None else (r["first"], r["last"]) for r in found}
    done: dict[str, tuple[str | None, str, int]] = {}  # month: version it was merged with, version written, its rows
    dimension: tuple[str, int] | None = None
    merged_with: str | None = None
    while True:
        before = _manifest(spark, root)
        old = before or {"run_no": 0, "months": {}, "month_rows": {}, "asteroids_run": None, "streams": {}}
        if stream is not None and old["streams"].get(stream, -1) >= epoch:
            return old["run_no"]
        run = new_run(old["run_no"] + 1)
        todo = {m for m in incoming if m not in done or done[m][0] != old["months"].get(m)}
        with ThreadPoolExecutor(1) as beside:  # the dimension and the months have nothing to do with each other
            writing = None
            if dimension is None or merged_with != old["asteroids_run"]:
                merged_with = old["asteroids_run"]
                current = _read_dimension(spark, root, merged_with) if merged_with else None
                parts = merged_in_parts(current, batch, _parts(sum(incoming.values()), DIMENSION_ROWS))
                writing = beside.submit(_write_dimension, spark, root, parts, run)
            for months in _month_groups({m: incoming[m] + old["month_rows"].get(m, 0) for m in todo}):
                part = new_run(old["run_no"] + 1)
                held = {m: old["months"][m] for m in months if m in old["months"]}
                rows = _of_months(batch, {m: days[m] for m in months})
                merged = merged_months(_read_months(spark, root, held) if held else None, rows, "_n")
                written, total = _write_months(spark, root, merged, part, True)
                expected = sum(incoming[m] for m in months) + sum(old["month_rows"][m] for m in held)
                if total != expected or written.keys() != set(months):
                    raise RuntimeError(f"{part}: {total} rows merged, {expected} stored and loaded; not committed")
                done.update({m: (old["months"].get(m), part, n) for m, n in written.items()})
            if writing:
                dimension = (run, writing.result())
        month_rows = old["month_rows"] | {m: n for m, (_, _, n) in done.items()}
        new_rows = sum(n - old["month_rows"].get(m, 0) for m, (_, _, n) in done.items())
        counts = (ledger or {}) | {"new": new_rows, "duplicates": sum(incoming.values()) - new_rows}
        record = _record(
            spark, root, before, old["run_no"] + 1, dimension, old["months"] | {m: r for m, (_, r, _) in done.items()},
            month_rows, ledger=counts, rejects=rejects or {}, streams={} if stream is None else {stream: epoch},
        )
        if store.create_new(spark, store.record_path(root, record["run_no"]), record):
            return record["run_no"]


def upsert(spark: SparkSession, root: str, flat_batch: DataFrame) -> int:
    """Load one batch of flat feed rows into ``root``; returns the run number.

    The batch is evaluated once, into a staging folder that goes when it is loaded."""
    staging = f"{root}/staging/{uuid.uuid4().hex}"
    rows = flat_batch.select(*FLAT_COLUMNS)
    with shuffle_files_removed(spark):
        rows.write.mode("errorifexists").option("compression", "zstd").parquet(staging)
        run_no = load_staged(spark, root, spark.read.schema(rows.schema).parquet(staging))
    store.remove(spark, staging)
    return run_no


def read_tables(
    spark: SparkSession, root: str, with_partition: bool = False, run_no: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """The tables of the newest committed run (or of a kept ``run_no``); ``with_partition`` keeps
    ``approach_month`` on the fact so date filters of the catalogue also prune month directories."""
    record = _manifest(spark, root, run_no)
    if record is None:
        raise FileNotFoundError(f"nothing committed under {root}")
    fact = _read_months(spark, root, record["months"])
    asteroids = _read_dimension(spark, root, record["asteroids_run"]).select(*ASTEROID_COLUMNS)
    return asteroids, fact if with_partition else fact.select(*APPROACH_COLUMNS)


# --------------------------------------------------------------------------- summaries (q05, q11, body list)
def read_summary(spark: SparkSession, root: str, run_no: int | None = None) -> DataFrame:
    """(orbiting_body, n_rows, n_keyed, approach_month): a row per month and body of the newest tables, read from
    the summaries written with each month's version (only touched months get new ones)."""
    record = _manifest(spark, root, run_no)
    if record is None:
        raise FileNotFoundError(f"nothing committed under {root}")
    return _read_months(spark, root, record["months"], "summary")


# --------------------------------------------------------------------------- I12
def publish(spark: SparkSession, root: str, asteroids: DataFrame, approaches: DataFrame) -> int:
    """Replace both tables at once by the given ones; returns the run number.  Of two writers that
    publish at once the later record is the one readers see."""
    dimension = asteroids.select(*ASTEROID_COLUMNS, F.lit(None).cast("int").alias(SEEN))
    written = None
    while True:
        before = _manifest(spark, root)
        run_no = before["run_no"] + 1 if before else 1
        if written is None:
            run = new_run(run_no)
            with shuffle_files_removed(spark):
                rows, _ = _write_months(spark, root, approaches.select(*APPROACH_COLUMNS), run)
                written = (run, _write_dimension(spark, root, [dimension], run)), {m: run for m in rows}, rows
        record = _record(spark, root, before, run_no, *written)
        if store.create_new(spark, store.record_path(root, run_no), record):
            return run_no


def read_published(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The tables of the newest run."""
    return read_tables(spark, root)


# --------------------------------------------------------------------------- clean-up
def compact(spark: SparkSession, root: str, max_files: int = 16) -> int | None:
    """Write months with more than ``max_files`` files, and more than their rows need, anew as few files; the
    run number, or None where no month needs it."""
    before = _manifest(spark, root)
    if before is None:
        return None
    files = {m: store.n_files(spark, f"{root}/close_approach/{r}/{FACT_PARTITION}={m}") for m, r in before["months"].items()}
    needed = {m: math.ceil(n / MAX_RECORDS_PER_FILE) for m, n in before["month_rows"].items()}
    held = {m: before["months"][m] for m, n in files.items() if n > max(max_files, 2 * needed[m])}
    if not held:
        return None
    run_no = before["run_no"] + 1
    run = new_run(run_no)
    rows, _ = _write_months(spark, root, _read_months(spark, root, held), run)
    if rows != {m: before["month_rows"][m] for m in held}:
        raise RuntimeError(f"{run}: the rows of a compacted month changed; not committed")
    dimension = (before["asteroids_run"], before["asteroid_rows"])
    record = _record(spark, root, before, run_no, dimension, before["months"] | {m: run for m in rows}, before["month_rows"])
    # the next compaction tries again if a writer was first: its versions are the newer ones
    return run_no if store.create_new(spark, store.record_path(root, run_no), record) else None


def retain(spark: SparkSession, root: str, keep: int = 1, grace_seconds: float = 86_400) -> list[str]:
    """Remove records older than the newest ``keep`` and every version, staging folder and routed batch that no
    kept record refers to; returns what was removed.

    Folders changed less than ``grace_seconds`` ago stay: a writer may be about to commit them.  Records go
    first, so that no record ever refers to a removed folder.
    """
    numbers = store.record_numbers(spark, root)
    kept = [store.read_record(spark, store.record_path(root, n)) for n in numbers[-keep:]]
    removed = [store.record_path(root, n) for n in numbers[:-keep]]
    for path in removed:
        store.remove(spark, path)
    reachable = {f"asteroids/{r['asteroids_run']}" for r in kept}
    for r in kept:
        for m, run in r["months"].items():
            reachable |= {f"{t}/{run}/{FACT_PARTITION}={m}" for t in ("close_approach", "summary")}
        for run in r["rejects"]:
            reachable |= {f"landed/{run}/{x}" for x in store.names(spark, f"{root}/landed/{run}") if x != "route=good"}
    parents = {p.rsplit("/", 1)[0] for p in reachable}
    latest = time.time() - grace_seconds
    for table in ("asteroids", "close_approach", "summary", "landed", "staging"):
        for run in store.names(spark, f"{root}/{table}"):
            folder = f"{table}/{run}"
            if folder in reachable or store.modified(spark, f"{root}/{folder}") > latest:
                continue
            parts = [f"{folder}/{x}" for x in store.names(spark, f"{root}/{folder}") if "=" in x] if folder in parents else []
            for path in [p for p in parts if p not in reachable] if folder in parents else [folder]:
                store.remove(spark, f"{root}/{path}")
                removed.append(f"{root}/{path}")
    return removed
