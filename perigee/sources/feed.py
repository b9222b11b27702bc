"""The paged JSON feed: landing pages, reading them, and flattening to typed rows.

A page is one JSON document ``{"links": {...}, "near_earth_objects": {day: [object]}}``.
Reading is a plain ``spark.read.json`` with an explicit schema (one task per file
split); flattening is two ``explode``s and a projection (narrow, no shuffle).
"""

from __future__ import annotations

import datetime as dt
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader

from perigee.schemas import FEED_SCHEMA, FLAT_COLUMNS
from perigee.session import new_run_dir

# Request window length, its default anchor (the first requested day)
# and the text formats of the feed.
WINDOW_DAYS = 7
DEFAULT_ANCHOR = dt.date(2024, 1, 1)
DATE_FORMAT = "yyyy-MM-dd"
CORRUPT = "_corrupt_record"
# A landing is gone through in up to PARTS runs of the calendar, one after another; approaches of one, at least.
PARTS, PART_ROWS = 16, 1_000_000


# --------------------------------------------------------------------------- windows (I2)
def window_start(day: Column, anchor: dt.date = DEFAULT_ANCHOR, days: int = WINDOW_DAYS) -> Column:
    """Start of the request window holding ``day`` (windows tile the calendar from ``anchor``)."""
    offset = F.datediff(day, F.lit(anchor))
    return F.date_add(F.lit(anchor), (F.floor(offset / days) * days).cast("int"))


def plan_windows(
    spark: SparkSession, start: dt.date, end: dt.date, days: int = WINDOW_DAYS
) -> DataFrame:
    """Request windows ``[w, min(w + days - 1, end)]`` covering ``start..end``."""
    bounds = spark.range(1).select(F.lit(start).alias("_s"), F.lit(end).alias("_e"))
    return _windows_between(bounds, days)


def windows_covering(dates: DataFrame, column: str = "close_approach_date", anchor: dt.date = DEFAULT_ANCHOR,
                     days: int = WINDOW_DAYS) -> DataFrame:
    """Anchored request windows covering the date range present in ``dates``."""
    bounds = dates.agg(
        window_start(F.min(column), anchor, days).alias("_s"), F.max(column).alias("_e")
    )
    return _windows_between(bounds, days)


def _windows_between(bounds: DataFrame, days: int) -> DataFrame:
    step = F.make_dt_interval(F.lit(days))
    starts = F.explode(F.sequence(F.col("_s"), F.col("_e"), step)).alias("window_start")
    return (
        bounds.where(F.col("_s") <= F.col("_e"))
        .select(starts, F.col("_e"))
        .select(
            "window_start",
            F.least(F.date_add("window_start", days - 1), F.col("_e")).alias("window_end"),
        )
    )


def page_window(pages: DataFrame) -> Column:
    """Request window start of a landed page, read from its own link."""
    return F.to_date(F.regexp_extract(F.col("links.self"), r"start_date=([0-9-]+)", 1), DATE_FORMAT)


def missing_windows(windows: DataFrame, pages: DataFrame) -> DataFrame:
    """Planned windows with no landed page yet (what still has to be fetched)."""
    landed = pages.select(page_window(pages).alias("window_start")).distinct()
    return windows.join(landed, "window_start", "left_anti")


# --------------------------------------------------------------------------- reading (I1, I4, I5)
def read_pages(spark: SparkSession, path: str | list[str], multi_line: bool = False, strict: bool = True) -> DataFrame:
    """Landed pages with the explicit feed schema; ``multi_line`` for one pretty document per file.

    Strict reading fails at a broken page; tolerant reading keeps its text in ``_corrupt_record``
    (``corrupt_pages`` lists them, ``explode_days`` finds no days in them).
    """
    return pages_of(spark.read.option("multiLine", multi_line), path, strict)


def pages_of(reader: DataFrameReader | DataStreamReader, path: str | list[str], strict: bool) -> DataFrame:
    """Pages from a batch or stream reader."""
    if strict:
        pages = reader.schema(FEED_SCHEMA).option("mode", "FAILFAST").json(path)
    else:
        reader = reader.schema(T.StructType([*FEED_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())]))
        pages = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return pages.withColumn("page", F.coalesce(F.col("links.self"), F.col("_metadata.file_path")))


def corrupt_pages(pages: DataFrame) -> DataFrame:
    """(page, text) of tolerantly read pages that are no JSON documents of the feed."""
    return pages.where(F.col(CORRUPT).isNotNull()).select("page", F.col(CORRUPT).alias("text"))


def explode_days(pages: DataFrame) -> DataFrame:
    """Map of day -> objects into one row per (page, day)."""
    return pages.select("page", F.explode("near_earth_objects").alias("day", "objects"))


def explode_objects(days: DataFrame) -> DataFrame:
    """One row per (page, day, object)."""
    return days.select("page", "day", F.explode("objects").alias("obj"))


# --------------------------------------------------------------------------- flattening (I6, I7)
def flat_columns(obj: Column, approach: Column, strict: bool) -> list[Column]:
    """The 13 typed columns of an object and one of its approaches."""

    def num(c: Column, t: str) -> Column:
        return c.cast(t) if strict else c.try_cast(t)

    day = approach.getField("close_approach_date")
    return [
        num(obj.getField("id"), "bigint").alias("id"),
        num(obj.getField("neo_reference_id"), "bigint").alias("neo_reference_id"),
        obj.getField("name").alias("name"),
        obj.getField("absolute_magnitude_h").alias("absolute_magnitude_h"),
        obj["estimated_diameter"]["kilometers"]["estimated_diameter_min"].alias("estimated_diameter_min_km"),
        obj["estimated_diameter"]["kilometers"]["estimated_diameter_max"].alias("estimated_diameter_max_km"),
        obj.getField("is_potentially_hazardous_asteroid").alias("is_potentially_hazardous_asteroid"),
        (F.to_date(day, DATE_FORMAT) if strict else F.try_to_date(day, DATE_FORMAT)).alias(
            "close_approach_date"
        ),
        num(approach["relative_velocity"]["kilometers_per_hour"], "double").alias("relative_velocity_kmph"),
        num(approach["miss_distance"]["astronomical"], "double").alias("astronomical"),
        num(approach["miss_distance"]["kilometers"], "double").alias("miss_distance_km"),
        num(approach["miss_distance"]["lunar"], "double").alias("miss_distance_lunar"),
        approach.getField("orbiting_body").alias("orbiting_body"),
    ]


def flatten(objects: DataFrame, strict: bool = True, keep_page: bool = False) -> DataFrame:
    """13 typed columns from the first approach of each object (as the reference reads it).

    ``get(arr, 0)`` yields NULL approach fields for an empty list instead of failing.
    """
    obj = F.col("obj")
    cols = flat_columns(obj, F.get(obj.getField("close_approach_data"), 0), strict)
    extra = [F.col("page")] if keep_page else []
    return objects.select(*extra, *cols)


def flatten_all_approaches(objects: DataFrame, strict: bool = True, keep_page: bool = False) -> DataFrame:
    """As ``flatten`` with one row per element of ``close_approach_data``; an object with an
    empty list keeps one row with NULL approach fields."""
    exploded = objects.select(
        "page", "obj", F.explode_outer(F.col("obj").getField("close_approach_data")).alias("_ap")
    )
    cols = flat_columns(F.col("obj"), F.col("_ap"), strict)
    extra = [F.col("page")] if keep_page else []
    return exploded.select(*extra, *cols)


def unreadable(obj: Column, ap: Column) -> Column:
    """Names of the fields of an object and one of its approaches whose text does not parse."""
    raw = {
        "id": obj.getField("id"),
        "neo_reference_id": obj.getField("neo_reference_id"),
        "close_approach_date": ap.getField("close_approach_date"),
        "relative_velocity_kmph": ap["relative_velocity"]["kilometers_per_hour"],
        "astronomical": ap["miss_distance"]["astronomical"],
        "miss_distance_km": ap["miss_distance"]["kilometers"],
        "miss_distance_lunar": ap["miss_distance"]["lunar"],
    }
    parsed = {
        "id": raw["id"].try_cast("bigint"),
        "neo_reference_id": raw["neo_reference_id"].try_cast("bigint"),
        "close_approach_date": F.try_to_date(raw["close_approach_date"], DATE_FORMAT),
        **{k: raw[k].try_cast("double") for k in ("relative_velocity_kmph", "astronomical", "miss_distance_km",
                                                  "miss_distance_lunar")},
    }
    # joined and split again: a lambda over the names would take all of it out of the generated code
    bad = F.concat_ws(",", *[F.when(raw[k].isNotNull() & parsed[k].isNull(), F.lit(k)) for k in raw])
    return F.when(bad == "", F.array().cast("array<string>")).otherwise(F.split(bad, ","))


def rejects(objects: DataFrame) -> DataFrame:
    """Approaches (page, day, obj, element) with text fields that do not parse, every element of the
    list included; an object without approaches is one row, element NULL.

    Tolerant flattening keeps these rows with NULL in the fields named here.
    """
    objects = objects.select(
        "page", "day", "obj", F.posexplode_outer(F.col("obj").getField("close_approach_data")).alias("element", "_ap")
    )
    bad = unreadable(F.col("obj"), F.col("_ap"))
    return objects.select("page", "day", "obj", "element", bad.alias("bad_fields")).where(F.size("bad_fields") > 0)


def read_flat(spark: SparkSession, path: str, strict: bool = True, all_approaches: bool = True) -> DataFrame:
    """I1 -> I4 -> I5 -> I7 in one call; ``all_approaches=False`` reads the first approach only (I6)."""
    objects = explode_objects(explode_days(read_pages(spark, path, strict=strict)))
    return flatten_all_approaches(objects, strict) if all_approaches else flatten(objects, strict)


# --------------------------------------------------------------------------- part after part
def file_days(flat: DataFrame) -> DataFrame:
    """(file, first, last, n, undated) of the files that flat rows are read from: the days of a file's rows, their number
    and that of its rows without a day."""
    day = F.col("close_approach_date")
    return flat.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min(day).alias("first"), F.max(day).alias("last"), F.count(day).alias("n"), F.count_if(day.isNull()).alias("undated")
    )


def _calendar_cuts(files: list, parts: int) -> list[dt.date]:
    """Days that cut the calendar into up to ``parts`` runs of whole request windows with about the same number of
    approaches, those of a file taken as even over its windows."""
    per_window: Counter = Counter()
    for f in files:
        if f["first"] is not None:
            first, last = ((day - DEFAULT_ANCHOR).days // WINDOW_DAYS for day in (f["first"], f["last"]))
            for w in range(first, last + 1):
                per_window[w] += f["n"] / (last - first + 1)
    total, seen, runs = sum(per_window.values()), 0.0, {}
    for w in sorted(per_window):
        runs.setdefault(int(seen * parts / total), w)
        seen += per_window[w]
    return [DEFAULT_ANCHOR + dt.timedelta(days=w * WINDOW_DAYS) for w in sorted(runs.values())][1:]


def read_flat_parts(spark: SparkSession, path: str, keep_page: bool = False, staging: str | None = None) -> Iterator[DataFrame]:
    """``read_flat`` of a folder of page files as disjoint sets of rows: runs of whole request windows, and the rows
    without a day.

    The pages are parsed once, into ``staging`` (a new folder, which is the caller's to remove).  Work by window or day that
    is done for one set after another, with ``shuffle_files_removed``, holds the shuffle files of one set.  A set is read
    from the staged files that have a day in it: in a feed that lies by days, few.
    """
    flat = flatten_all_approaches(explode_objects(explode_days(read_pages(spark, path))), keep_page=keep_page)
    staging = staging or new_run_dir(spark, "flat")
    flat.write.option("compression", "zstd").parquet(staging)

    def staged(*names: str) -> DataFrame:
        return spark.read.schema(flat.schema).parquet(*[f"{staging}/{n}" for n in names] or [staging])

    files = file_days(staged()).collect()  # one row per file
    day = F.col("close_approach_date")
    parts = max(1, min(PARTS, sum(f["n"] + f["undated"] for f in files) // PART_ROWS))
    cuts = _calendar_cuts(files, parts) if parts > 1 else []
    if not cuts:
        yield staged()
        return
    for begin, end in zip([dt.date.min, *cuts], [*cuts, None]):
        own = [f["file"] for f in files if f["n"] and f["last"] >= begin and (end is None or f["first"] < end)]
        inside = (F.lit(True) if begin == dt.date.min else day >= F.lit(begin)) & (F.lit(True) if end is None else day < F.lit(end))
        yield staged(*own).where(day.isNotNull() & inside)
    undated = [f["file"] for f in files if f["undated"]]
    if undated:
        yield staged(*undated).where(day.isNull())


# --------------------------------------------------------------------------- I3, I14
FEED_ORDER = ["close_approach_date"] + [c for c in FLAT_COLUMNS if c != "close_approach_date"]


LIMIT_RANGES = 4096


def limit_candidates(flat: DataFrame, target: int) -> DataFrame:
    """The rows that can be among the first ``target`` in feed order: the days before the one in which the target
    is reached, and of that day the ids up to the range in which it is reached.

    Both cuts come from counts: per calendar day, then per range of ids inside the boundary day (its ids' span in
    ``LIMIT_RANGES`` equal parts, NULL ids last), so a day with a third of all rows is cut as well.  Rows of one range
    of that day are not told apart: an object with more rows on one day than the target all stay.
    """
    day, number = F.col("close_approach_date"), F.col("id")
    per_day = flat.groupBy(day).agg(F.count(F.lit(1)).alias("_n"), F.min(number).alias("_lo"), F.max(number).alias("_hi"))
    # One row per calendar day (bounded by the calendar): a single-partition window is fine.
    running = Window.orderBy(F.asc_nulls_last("close_approach_date")).rowsBetween(Window.unboundedPreceding, 0)
    needed = (
        per_day.withColumn("_upto", F.sum("_n").over(running))
        .where(F.col("_upto") - F.col("_n") < target)
        .select(
            day.alias("_day"), "_lo", "_hi", (F.col("_upto") >= target).alias("_last"),
            (F.lit(target) - F.col("_upto") + F.col("_n")).alias("_left"),
        )
    )
    rows = flat.join(F.broadcast(needed), day.eqNullSafe(F.col("_day")))
    part = F.coalesce(
        F.width_bucket(number.cast("double"), F.col("_lo").cast("double"), F.col("_hi").cast("double") + 1, F.lit(LIMIT_RANGES)),
        F.lit(LIMIT_RANGES + 1).cast("bigint"),
    )
    rows = rows.withColumn("_part", F.when(F.col("_last"), part))
    per_part = rows.where("_last").groupBy("_part", "_left").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    wanted = per_part.withColumn("_before", F.sum("_n").over(running) - F.col("_n")).where("_before < _left")
    wanted = wanted.select(F.col("_part").alias("_wanted"))  # at most LIMIT_RANGES + 1 rows
    kept = rows.join(F.broadcast(wanted), F.col("_part") == F.col("_wanted"), "left")
    return kept.where(~F.col("_last") | F.col("_wanted").isNotNull()).select(*FLAT_COLUMNS)


def limit_rows(flat: DataFrame, target: int) -> DataFrame:
    """The first ``target`` records in feed order (day, then every other column; NULLs last).

    The top-n runs on ``limit_candidates`` only: the target plus, at most, the rest of one range of ids.
    """
    order = [F.asc_nulls_last(c) for c in FEED_ORDER]
    return limit_candidates(flat, target).orderBy(*order).limit(target).select(*FLAT_COLUMNS)


def audit(flat: DataFrame) -> DataFrame:
    """Per request window: records, distinct objects, days and NULLs per parsed field.

    One row per (window, object) comes first, with map-side partial sums and the object's days as bits
    of the window; counting those rows gives the distinct objects, their united bits the days.
    """
    null_fields = {"null_velocity": "relative_velocity_kmph", "null_au": "astronomical", "null_body": "orbiting_body"}
    placed = flat.withColumn("window_start", window_start(F.col("close_approach_date")))
    bit = F.call_function("shiftleft", F.lit(1), F.datediff("close_approach_date", "window_start"))
    per_object = placed.groupBy("window_start", "id").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_or(bit).alias("days"),
        *[F.count_if(F.col(c).isNull()).alias(k) for k, c in null_fields.items()],
    )
    return per_object.groupBy("window_start").agg(
        F.sum("n").alias("n_records"),
        F.count("id").alias("n_objects"),
        F.coalesce(F.bit_count(F.bit_or("days")), F.lit(0)).cast("bigint").alias("n_days"),
        *[F.sum(k).alias(k) for k in null_fields],
    )


def audit_pages(objects: DataFrame) -> DataFrame:
    """Per landed page: records (all approaches), distinct objects and approaches with unreadable fields."""
    flat = flatten_all_approaches(objects, strict=False, keep_page=True)
    bad = rejects(objects).groupBy("page").agg(F.count(F.lit(1)).alias("rejected"))
    per_page = flat.groupBy("page").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.countDistinct("id").alias("n_objects"),
        F.count_if(F.col("close_approach_date").isNull()).alias("null_date"),
        F.count_if(F.col("relative_velocity_kmph").isNull()).alias("null_velocity"),
        F.count_if(F.col("astronomical").isNull()).alias("null_au"),
    )
    return per_page.join(bad, "page", "left").fillna(0, subset=["rejected"])


# --------------------------------------------------------------------------- mergeable audit (I14)
SKETCH_LG_K = 14  # 16,384 registers: a standard error of 0.65 %


def audit_sketches(flat: DataFrame, lg_k: int = SKETCH_LG_K) -> DataFrame:
    """Per page and request window: counts that add up, the days as bits, and a sketch of the distinct objects.

    ``flat`` has its ``page`` (``keep_page=True``).  The rows can be stored with the pages and merged later, over any
    set of pages, without reading these again (``merged_audit``).
    """
    placed = flat.withColumn("window_start", window_start(F.col("close_approach_date")))
    bit = F.call_function("shiftleft", F.lit(1), F.datediff("close_approach_date", "window_start"))
    nulls = {"null_velocity": "relative_velocity_kmph", "null_au": "astronomical", "null_body": "orbiting_body"}
    return placed.groupBy("page", "window_start").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.coalesce(F.bit_or(bit), F.lit(0)).alias("days"),
        F.hll_sketch_agg("id", lg_k).alias("objects"),
        *[F.count_if(F.col(c).isNull()).alias(k) for k, c in nulls.items()],
    )


def merged_audit(sketches: DataFrame) -> DataFrame:
    """``audit`` of a window from stored ``audit_sketches``; ``n_objects`` is an estimate."""
    return sketches.groupBy("window_start").agg(
        F.sum("n_records").alias("n_records"),
        F.hll_sketch_estimate(F.hll_union_agg("objects")).alias("n_objects"),
        F.bit_count(F.bit_or("days")).cast("bigint").alias("n_days"),
        *[F.sum(k).alias(k) for k in ("null_velocity", "null_au", "null_body")],
    )
