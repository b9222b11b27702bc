"""How the test tables are landed as a feed: the fixture behind the ingest keys.

Pages have a bounded size: each request window (7 days) is split into ``ceil(records / page_size)`` pages
and a record goes to the page picked by its object, day and part, so no page collects a whole window or
a whole object.  Page numbers that no record falls on are not landed, which leaves gaps in the chain of
links as a feed that is still being fetched has them.

The soiled landing holds the same pages with what a feed can get wrong: dates in another format, numbers
with a unit behind them, and pages whose text breaks off.
"""

from __future__ import annotations

import datetime as dt
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perigee.schemas import ASTEROID_COLUMNS
from perigee.session import new_run_dir, scratch_root, shuffle_files_removed
from perigee.sources import binding, store
from perigee.sources.feed import DATE_FORMAT, DEFAULT_ANCHOR, WINDOW_DAYS, window_start

# The links of the feed; order of the approaches in a landed record.
PAGE_LINK = "feed?start_date={start}&end_date={end}&page={page}"
APPROACH_SORT = ("astronomical", "relative_velocity_kmph", "orbiting_body", "miss_distance_km", "miss_distance_lunar")
DEFAULT_PAGE_SIZE = 1000
RECORDS_A_FILE = 250_000  # a gzipped file is read by one task: some 115 MB of text, a usual split
LEAST_FILES = 8  # of a slice with enough rows: so many tasks read and write it
GZIP = {"compression": "gzip", "zlib.compress.level": "FOUR"}  # an eighth larger than at the usual level, in half its time
SLICES, SLICE_ROWS = 24, 500_000  # parts of the calendar landed one after another; approaches of a part, at least
LAYOUT = 6  # part of a landing's name: raise it with every change of what is landed

# What the soiled landing gets wrong, by the order line an approach comes from and by page number.
BAD_DATE_LINE, BAD_VELOCITY_LINE, BROKEN_PAGE = 7, 6, 4
BAD_DATE_FORMAT, VELOCITY_UNIT = "dd/MM/yyyy", " km/h"


def _dated(approaches: DataFrame) -> DataFrame:
    """Approaches with a day, with their ``_part``."""
    rows = approaches if "_part" in approaches.columns else approaches.withColumn("_part", F.lit(0))
    return rows.where(F.col("close_approach_date").isNotNull())


def _page_counts(asteroids: DataFrame, rows: DataFrame, page_size: int) -> DataFrame:
    """(window_start, _pages): ``ceil(records / page_size)`` of each request window; a record is an object row, a day and a
    part.  One row per request window: bounded by the calendar (52 per year)."""
    return (
        rows.select("neo_reference_id", "close_approach_date", "_part")
        .distinct()
        .join(asteroids.select("id"), F.col("neo_reference_id") == F.col("id"))
        .groupBy(window_start(F.col("close_approach_date")).alias("window_start"))
        .agg(F.ceil(F.count(F.lit(1)) / page_size).cast("int").alias("_pages"))
    )


def _placed(asteroids: DataFrame, rows: DataFrame, per_window: DataFrame) -> DataFrame:
    """``_dated`` approaches that have an object, with the object's columns, its ``_nth`` row, their window and page."""
    # an id with several rows is several objects
    same = Window.partitionBy("id").orderBy(*[F.asc(c) for c in asteroids.columns])
    numbered = asteroids.where(F.col("id").isNotNull()).withColumn("_nth", F.row_number().over(same))
    deal = F.col("id") * 7 + F.datediff("close_approach_date", F.lit(DEFAULT_ANCHOR)) * 3 + F.col("_part")
    return (
        rows.join(numbered, F.col("neo_reference_id") == F.col("id"))
        .drop("neo_reference_id")
        .withColumn("window_start", window_start(F.col("close_approach_date")))
        .join(F.broadcast(per_window), "window_start")
        .withColumn("page_no", F.pmod(deal, F.col("_pages")).cast("int"))
    )


def _dealt(asteroids: DataFrame, approaches: DataFrame, page_size: int, files: int, counts: list[tuple]) -> DataFrame:
    """``_placed`` approaches, the rows of a page in one partition, pages in the order of the calendar; ``files``: number of
    partitions, with about the same number of pages each, for the windows and numbers of pages in ``counts`` (0: by size)."""
    rows = _dated(approaches)
    if not files:
        placed = _placed(asteroids, rows, _page_counts(asteroids, rows, page_size)).withColumn("_file", F.lit(0))
        return placed.repartitionByRange("window_start", "page_no")
    before, known = 0, []
    for start, pages in counts:
        known.append(F.struct(F.lit(start).alias("window_start"), F.lit(pages).alias("_pages"), F.lit(before).alias("_before")))
        before += pages
    per_window = asteroids.sparkSession.range(1).select(F.inline(F.array(*known)))
    file = F.floor((F.col("_before") + F.col("page_no")) * F.lit(files).cast("bigint") / F.lit(before)).cast("int")
    return _placed(asteroids, rows, per_window).withColumn("_file", file).repartitionById(files, "_file")


def _objects(placed: DataFrame) -> DataFrame:
    """One feed object per record (the feed lists an object under each day it passes), with its approaches of that
    day in order: nearest first, then by the other columns.

    ``_part`` splits the approaches of an object and day over several records; ``_line``, where present, says which
    approaches are soiled.
    """
    soiled = "_line" in placed.columns
    line = F.col("_line") if soiled else F.lit(0)
    day = F.col("close_approach_date")
    velocity = F.col("relative_velocity_kmph").cast("string")
    text = F.date_format(day, DATE_FORMAT)
    approach = F.struct(
        (F.when(line == BAD_DATE_LINE, F.date_format(day, BAD_DATE_FORMAT)).otherwise(text) if soiled else text).alias(
            "close_approach_date"
        ),
        F.struct(
            F.when(line == BAD_VELOCITY_LINE, F.concat(velocity, F.lit(VELOCITY_UNIT)))
            .otherwise(velocity)
            .alias("kilometers_per_hour")
        ).alias("relative_velocity"),
        F.struct(
            F.col("astronomical").cast("string").alias("astronomical"),
            F.col("miss_distance_lunar").cast("string").alias("lunar"),
            F.col("miss_distance_km").cast("string").alias("kilometers"),
        ).alias("miss_distance"),
        F.col("orbiting_body").alias("orbiting_body"),
    )
    ordered = F.struct(*[F.col(c) for c in APPROACH_SORT], approach.alias("approach"))
    object_columns = [c for c in ASTEROID_COLUMNS if c != "id"]
    listed = placed.groupBy("_file", "window_start", "_pages", "page_no", "close_approach_date", "id", "_nth", "_part").agg(
        F.array_sort(F.collect_list(ordered)).alias("_l"),
        F.first(F.struct(*object_columns)).alias("_o"),
    )
    obj = F.struct(
        F.col("id").cast("string").alias("id"),
        F.col("id").cast("string").alias("neo_reference_id"),
        F.col("_o.name").alias("name"),
        F.col("_o.absolute_magnitude_h").alias("absolute_magnitude_h"),
        F.struct(
            F.struct(
                F.col("_o.estimated_diameter_min_km").alias("estimated_diameter_min"),
                F.col("_o.estimated_diameter_max_km").alias("estimated_diameter_max"),
            ).alias("kilometers")
        ).alias("estimated_diameter"),
        F.col("_o.is_potentially_hazardous_asteroid").alias("is_potentially_hazardous_asteroid"),
        F.transform("_l", lambda x: x.getField("approach")).alias("close_approach_data"),
    )
    return listed.select("_file", "window_start", "_pages", "page_no", "close_approach_date", obj.alias("obj"))


def _link(start: Column, page: Column) -> Column:
    end = F.date_add(start, WINDOW_DAYS - 1)
    return F.format_string(
        PAGE_LINK.replace("{start}", "%s").replace("{end}", "%s").replace("{page}", "%d"),
        F.date_format(start, DATE_FORMAT),
        F.date_format(end, DATE_FORMAT),
        page,
    )


def build_pages(
    asteroids: DataFrame, approaches: DataFrame, page_size: int = DEFAULT_PAGE_SIZE, files: int = 0, counts: list[tuple] = ()
) -> DataFrame:
    """Pages (links, near_earth_objects) of about ``page_size`` objects each, in ``files`` partitions (see ``_dealt``).

    The flat rows are dealt to their pages once; records, days and pages are then grouped where they lie.
    """
    dealt = _dealt(asteroids, approaches, page_size, files, counts)
    per_day = _objects(dealt).groupBy("_file", "window_start", "_pages", "page_no", "close_approach_date").agg(
        F.array_sort(F.collect_list("obj")).alias("objects")
    )
    day = F.date_format("close_approach_date", DATE_FORMAT).alias("day")
    pages = per_day.groupBy("_file", "window_start", "_pages", "page_no").agg(
        F.map_from_entries(F.collect_list(F.struct(day, "objects"))).alias("near_earth_objects")
    )
    last = F.col("page_no") + 1 >= F.col("_pages")
    next_start = F.when(last, F.date_add("window_start", WINDOW_DAYS)).otherwise(F.col("window_start"))
    next_page = F.when(last, F.lit(0)).otherwise(F.col("page_no") + 1)
    return pages.select(
        F.struct(
            _link(F.col("window_start"), F.col("page_no")).alias("self"),
            _link(next_start, next_page).alias("next"),
        ).alias("links"),
        "near_earth_objects",
    )


def land_pages(pages: DataFrame, path: str, mode: str = "errorifexists", pages_a_file: int = 0) -> str:
    """Write pages as gzipped JSON Lines (one page document per line), at most ``pages_a_file`` in a file (0: any)."""
    pages.write.mode(mode).options(**GZIP).option("maxRecordsPerFile", pages_a_file).json(path)
    return path


def land_soiled(pages: DataFrame, path: str, mode: str = "errorifexists", pages_a_file: int = 0) -> str:
    """As ``land_pages``; pages with the number ``BROKEN_PAGE`` break off after half their text."""
    text = F.to_json(F.struct("links", "near_earth_objects"))
    half = F.floor(F.length(text) / 2).cast("int")
    broken = F.col("links.self").endswith(f"&page={BROKEN_PAGE}")
    lines = pages.select(F.when(broken, F.left(text, half)).otherwise(text).alias("value"))
    lines.write.mode(mode).options(**GZIP).option("maxRecordsPerFile", pages_a_file).text(path)
    return path


# --------------------------------------------------------------------------- landings of the test tables
def _fingerprint(spark: SparkSession, path: str) -> str:
    """Digest of the files behind a table (names, sizes, times of change), from a listing."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    listed = F.array_sort(F.collect_list(F.struct("path", "length", "modificationTime")))
    return files.select("path", "length", "modificationTime").agg(F.md5(F.to_json(listed))).first()[0]


def _slices(approaches: DataFrame) -> list[tuple]:
    """First and last day of up to ``SLICES`` runs of whole request windows with about the same number of approaches, and
    that number."""
    window = window_start(F.col("close_approach_date")).alias("w")
    counted = approaches.groupBy(window).agg(F.count(F.lit(1)).alias("n")).where("w IS NOT NULL")
    rows = sorted(tuple(r) for r in counted.collect())  # one row per request window
    total = sum(n for _, n in rows)
    many = max(1, min(SLICES, total // SLICE_ROWS))
    runs: dict[int, list] = {}
    seen = 0
    for w, n in rows:
        runs.setdefault(seen * many // total, []).append((w, n))
        seen += n
    return [(ws[0][0], ws[-1][0] + dt.timedelta(days=WINDOW_DAYS - 1), sum(n for _, n in ws)) for ws in runs.values()]


def _sliced(spark: SparkSession, approaches: DataFrame, slices: list[tuple], staging: str) -> list[DataFrame]:
    """The approaches of each slice, from files written once: a slice's work does not go through the whole table."""
    if len(slices) < 2:
        return [approaches]
    day, rows = F.col("close_approach_date"), _dated(approaches)
    number = F.coalesce(*[F.when(day >= F.lit(slices[i][0]), F.lit(i)) for i in reversed(range(len(slices)))])
    rows.withColumn("_slice", number).write.option("compression", "zstd").partitionBy("_slice").parquet(staging)
    return [spark.read.schema(rows.schema).parquet(f"{staging}/_slice={i}") for i in range(len(slices))]


def _n_files(rows: int) -> int:
    return max(math.ceil(rows / RECORDS_A_FILE), min(LEAST_FILES, math.ceil(rows * LEAST_FILES / RECORDS_A_FILE)))


def landed(spark: SparkSession, sf_dir: str, page_size: int = DEFAULT_PAGE_SIZE, soiled: bool = False) -> str:
    """Folder with the bound tables landed as feed pages; a landing of the very same files is used again.

    The calendar is landed slice by slice, so that the shuffle files of one slice lie on the disks at a time; the table is
    read once to deal its rows to the slices, and once to count the pages of all windows.  The slices gather beside the
    landing's place and go there together.
    """
    folder = sf_dir.rstrip("/")
    marks = "-".join(_fingerprint(spark, f"{folder}/{t}.parquet") for t in ("part", "lineitem"))
    path = f"{scratch_root(spark)}/landing/v{LAYOUT}-{page_size}{'-soiled' if soiled else ''}-{marks}"
    if "_SUCCESS" not in store.names(spark, path):  # its writer did not finish
        a = binding.asteroids_from_part(binding.table(spark, sf_dir, "part"))
        ca = binding.approaches_from_lineitem(binding.table(spark, sf_dir, "lineitem"), keep_part=True, keep_line=soiled)
        land, beside = land_soiled if soiled else land_pages, f"{path}.{uuid.uuid4().hex}"
        pages_a_file = max(1, RECORDS_A_FILE // page_size)
        staging = new_run_dir(spark, "slices")
        with shuffle_files_removed(spark):
            slices = _slices(ca)
            counts = sorted(tuple(r) for r in _page_counts(a, _dated(ca), page_size).collect())  # one row per request window
            for rows, (first, last, n) in zip(_sliced(spark, ca, slices, staging), slices or [(None, None, 0)]):
                inside = [c for c in counts if n and first <= c[0] <= last]
                land(build_pages(a, rows, page_size, _n_files(n) if inside else 0, inside), beside, "append", pages_a_file)
        store.remove(spark, staging)
        if not store.move_new(spark, beside, path):  # another writer was first
            store.remove(spark, beside)
    return path
