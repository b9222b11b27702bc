"""Driver keys for the feed, load and streaming operators, with their oracle SQL.

The feed is landed from the whole test tables (``perigee.plans.landing``) once per
set of input files, into the shared scratch folder; every key then reads it back
through the same code a production ingest uses.  Oracles compute the expected result
directly from the tables, independent of how rows were spread over pages.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.operators import catalogue as cat
from perigee.plans import landing
from perigee.plans.oracle import JOIN, with_binding
from perigee.schemas import APPROACH_COLUMNS
from perigee.session import new_run_dir, shuffle_files_removed
from perigee.sources import binding, chain, feed, ledger, store, tables
from perigee.streaming import ingest, windows

FEED_TARGET_ROWS = 10000  # the reference's stop condition
STREAM_FILES = 8
UPSERT_FIRST_END = dt.date(1998, 7, 1)
UPSERT_SECOND_START = dt.date(1998, 1, 1)

SMALL_PAGES = 4  # records a page where keys look at page numbers: some fall on no record and are not landed
SOILED_PAGES = 20
BEFORE_DAYS, AFTER_DAYS = 3, 17  # the days asked for begin and end off the windows of the feed


def landed_pages(spark: SparkSession, sf_dir: str) -> str:
    return landing.landed(spark, sf_dir)


def flat_feed(spark: SparkSession, sf_dir: str, all_approaches: bool = True) -> DataFrame:
    return feed.read_flat(spark, landed_pages(spark, sf_dir), all_approaches=all_approaches)


@contextmanager
def _flat_read_once(spark: SparkSession, sf_dir: str) -> Iterator[DataFrame]:
    """``flat_feed`` from files of its own that last as long as the block: the pages are parsed once for all that read it."""
    flat, path = flat_feed(spark, sf_dir), new_run_dir(spark, "flat")
    flat.write.option("compression", "zstd").parquet(path)
    yield spark.read.schema(flat.schema).parquet(path)
    store.remove(spark, path)


def _upsert(spark: SparkSession, root: str, batch: DataFrame) -> None:
    """Load a batch; versions that the new record does not name go (the folder has one writer)."""
    tables.upsert(spark, root, batch)
    tables.retain(spark, root, keep=1, grace_seconds=0)


# --------------------------------------------------------------------------- keys
def k_feed_windows(spark, sf_dir):
    _, ca = binding.bind(spark, sf_dir)
    return feed.windows_covering(ca)


def k_feed_scan(spark, sf_dir):
    pages = feed.read_pages(spark, landed_pages(spark, sf_dir))
    per_page_day = pages.select(
        feed.page_window(pages).alias("window_start"),
        F.explode("near_earth_objects").alias("day", "objects"),
    )
    return per_page_day.groupBy("window_start").agg(
        F.sum(F.size("objects")).cast("bigint").alias("n_objects"),
        F.countDistinct("day").alias("n_days"),
    )


def k_feed_explode_days(spark, sf_dir):
    days = feed.explode_days(feed.read_pages(spark, landed_pages(spark, sf_dir)))
    return days.groupBy(F.to_date("day", feed.DATE_FORMAT).alias("close_approach_date")).agg(
        F.sum(F.size("objects")).cast("bigint").alias("n_objects")
    )


def k_feed_explode_objects(spark, sf_dir):
    objs = feed.explode_objects(feed.explode_days(feed.read_pages(spark, landed_pages(spark, sf_dir))))
    return objs.select(
        F.to_date("day", feed.DATE_FORMAT).alias("close_approach_date"),
        F.col("obj.id").cast("bigint").alias("id"),
        F.col("obj.name").alias("name"),
    )


def k_feed_flatten(spark, sf_dir):
    return flat_feed(spark, sf_dir, all_approaches=False)


def k_feed_all_approaches(spark, sf_dir):
    return flat_feed(spark, sf_dir)


def k_feed_limit(spark, sf_dir):
    return feed.limit_rows(flat_feed(spark, sf_dir), FEED_TARGET_ROWS)


def _written_in_parts(spark: SparkSession, parts: Iterable[DataFrame], path: str) -> DataFrame:
    """Results of disjoint parts of the feed, written one after another: the shuffle files of one lie on the disks."""
    with shuffle_files_removed(spark):
        for part in parts:
            part.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(part.schema).parquet(path)


@contextmanager
def _flat_parts(spark: SparkSession, sf_dir: str, keep_page: bool = False) -> Iterator[Iterable[DataFrame]]:
    """``feed.read_flat_parts`` of the landing; the rows it stages last as long as the block."""
    staging = new_run_dir(spark, "flat")
    yield feed.read_flat_parts(spark, landed_pages(spark, sf_dir), keep_page, staging)
    store.remove(spark, staging)


def k_ingest_audit(spark, sf_dir):
    with _flat_parts(spark, sf_dir) as parts:
        return _written_in_parts(spark, (feed.audit(flat) for flat in parts), new_run_dir(spark, "audit"))


def k_ingest_audit_sketches(spark, sf_dir):
    """The audit from stored page sketches; the estimated objects are held against the exact ones."""
    with _flat_parts(spark, sf_dir, keep_page=True) as found:
        parts = list(found)
        sketches = _written_in_parts(spark, map(feed.audit_sketches, parts), new_run_dir(spark, "audit-sketches"))
        exact = _written_in_parts(spark, (feed.audit(flat.drop("page")) for flat in parts), new_run_dir(spark, "audit"))
    exact = exact.select(F.col("window_start").alias("w"), F.col("n_objects").alias("exact"))
    merged = feed.merged_audit(sketches)
    near = (F.abs(F.col("n_objects") - F.col("exact")) <= 0.03 * F.col("exact")).alias("within_3_pct")
    return merged.join(exact, F.col("window_start").eqNullSafe(F.col("w"))).select(
        "window_start", "n_records", "n_days", "null_velocity", "null_au", "null_body", near
    )


def k_load_asteroids(spark, sf_dir):
    with _flat_parts(spark, sf_dir) as parts:
        return tables.load_asteroids_in_parts(spark, parts, new_run_dir(spark, "dimension"))


def k_load_close_approach(spark, sf_dir):
    with _flat_parts(spark, sf_dir) as parts:
        loaded = (tables.load_close_approach(flat).sortWithinPartitions(*tables.APPROACH_KEY[::-1]) for flat in parts)
        return _written_in_parts(spark, loaded, new_run_dir(spark, "loaded"))


def k_create_tables(spark, sf_dir):
    flat = flat_feed(spark, sf_dir)
    names = tables.create_tables(spark, f"perigee_{uuid.uuid4().hex[:10]}", new_run_dir(spark, "catalog"))
    tables.insert_tables(spark, names, tables.load_asteroids(flat), tables.load_close_approach(flat))
    return spark.table(names[1]).select(*APPROACH_COLUMNS)


def k_upsert_load(spark, sf_dir):
    """Two overlapping batches, the second one replayed: equals one load of everything."""
    root = new_run_dir(spark, "tables")
    day = F.col("close_approach_date")
    with _flat_read_once(spark, sf_dir) as flat:
        _upsert(spark, root, flat.where(day < F.lit(UPSERT_FIRST_END)))
        second = flat.where(day >= F.lit(UPSERT_SECOND_START))
        _upsert(spark, root, second)
        _upsert(spark, root, second)
    return tables.read_tables(spark, root)[1]


def k_atomic_publish(spark, sf_dir):
    root = new_run_dir(spark, "published")
    with _flat_read_once(spark, sf_dir) as flat:
        tables.publish(spark, root, tables.load_asteroids(flat), tables.load_close_approach(flat))
    return tables.read_published(spark, root)[1]


def k_stream_ingest(spark, sf_dir):
    root = new_run_dir(spark, "stream-tables")
    q = ingest.ingest_stream(
        spark, landed_pages(spark, sf_dir), root, new_run_dir(spark, "stream-ckpt"), max_files_per_trigger=STREAM_FILES, keep=1
    )
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    return tables.read_tables(spark, root)[1]


def k_upsert_load_asteroids(spark, sf_dir):
    """The dimension after the same batches."""
    root = new_run_dir(spark, "tables")
    day = F.col("close_approach_date")
    with _flat_read_once(spark, sf_dir) as flat:
        _upsert(spark, root, flat.where(day < F.lit(UPSERT_FIRST_END)))
        _upsert(spark, root, flat.where(day >= F.lit(UPSERT_SECOND_START)))
    return tables.read_tables(spark, root)[0]


def k_atomic_publish_asteroids(spark, sf_dir):
    root = new_run_dir(spark, "published")
    with _flat_read_once(spark, sf_dir) as flat:
        tables.publish(spark, root, tables.load_asteroids(flat), tables.load_close_approach(flat))
    return tables.read_published(spark, root)[0]


def k_ingest_audit_pages(spark, sf_dir):
    """The per-page audit, summed over the pages of a window (how rows fall on pages is the landing's)."""
    pages = feed.read_pages(spark, landed_pages(spark, sf_dir), strict=False)
    per_page = feed.audit_pages(feed.explode_objects(feed.explode_days(pages)))
    window = F.to_date(F.regexp_extract("page", r"start_date=([0-9-]+)", 1)).alias("window_start")
    return per_page.groupBy(window).agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("n_records", "null_date", "null_velocity", "null_au", "rejected")]
    )


def small_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.read_pages(spark, landing.landed(spark, sf_dir, SMALL_PAGES))


def k_feed_chain(spark, sf_dir):
    return chain.chains(small_pages(spark, sf_dir))


def k_feed_missing(spark, sf_dir):
    """What is to be fetched for a range of days that begins and ends off the windows."""
    _, ca = binding.bind(spark, sf_dir)
    first, last = ca.agg(F.min("close_approach_date"), F.max("close_approach_date")).first()
    start, end = first + dt.timedelta(days=BEFORE_DAYS), last + dt.timedelta(days=AFTER_DAYS)
    return chain.missing_pages(small_pages(spark, sf_dir), start, end)


def soiled_pages(spark: SparkSession, sf_dir: str) -> str:
    return landing.landed(spark, sf_dir, SOILED_PAGES, soiled=True)


def _ledger_root(spark, sf_dir) -> str:
    root = new_run_dir(spark, "ledger")
    ledger.load_pages(spark, root, feed.read_pages(spark, soiled_pages(spark, sf_dir), strict=False))
    return root


def _rejects(spark, root) -> DataFrame:
    return ledger.read_rejects(spark, root).select(
        "page",
        "day",
        F.get_json_object("text", "$.id").try_cast("bigint").alias("id"),
        "element",
        F.array_join("bad_fields", ",").alias("bad_fields"),
        "route",
    )


def k_feed_rejects(spark, sf_dir):
    return _rejects(spark, _ledger_root(spark, sf_dir))


def k_feed_ledger(spark, sf_dir):
    return ledger.read_ledger(spark, _ledger_root(spark, sf_dir)).drop("run_no")


def _tolerant_stream(spark, sf_dir) -> str:
    root = new_run_dir(spark, "stream-ledger")
    q = ingest.ingest_stream(
        spark, soiled_pages(spark, sf_dir), root, new_run_dir(spark, "stream-ckpt"), STREAM_FILES, strict=False, keep=1
    )
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    return root


def k_stream_rejects(spark, sf_dir):
    """The dead letters of the tolerant stream, over all its batches."""
    return _rejects(spark, _tolerant_stream(spark, sf_dir))


def k_stream_ingest_tolerant(spark, sf_dir):
    """What the tolerant stream stored."""
    return tables.read_tables(spark, _tolerant_stream(spark, sf_dir))[1]


def _loaded_in_three(spark, sf_dir) -> str:
    root = new_run_dir(spark, "tables")
    day = F.col("close_approach_date")
    with _flat_read_once(spark, sf_dir) as flat:
        _upsert(spark, root, flat.where(day < F.lit(UPSERT_FIRST_END)))
        _upsert(spark, root, flat.where(day >= F.lit(UPSERT_SECOND_START)))
        _upsert(spark, root, flat.where(day < F.lit(UPSERT_SECOND_START)))
    return root


def k_summary_monthly(spark, sf_dir):
    """Monthly counts (q11, and so q05) from the months' summaries, after three overlapping loads."""
    return cat.monthly_of_summary(tables.read_summary(spark, _loaded_in_three(spark, sf_dir)))


def k_summary_bodies(spark, sf_dir):
    """The body list from the months' summaries."""
    return cat.bodies_of_summary(tables.read_summary(spark, _loaded_in_three(spark, sf_dir)))


def k_stream_window_counts(spark, sf_dir):
    out = new_run_dir(spark, "window-counts")
    with windows.session_time_zone(spark, "UTC"):
        q = windows.run_window_counts(
            spark, f"{sf_dir.rstrip('/')}/events.parquet", out, new_run_dir(spark, "window-ckpt"), mode="update"
        )
        q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    return windows.read_counts(spark, out)


INGEST_KEYS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "feed_windows": k_feed_windows,
    "feed_scan": k_feed_scan,
    "feed_explode_days": k_feed_explode_days,
    "feed_explode_objects": k_feed_explode_objects,
    "feed_flatten": k_feed_flatten,
    "feed_all_approaches": k_feed_all_approaches,
    "feed_limit": k_feed_limit,
    "ingest_audit": k_ingest_audit,
    "load_asteroids": k_load_asteroids,
    "load_close_approach": k_load_close_approach,
    "create_tables": k_create_tables,
    "upsert_load": k_upsert_load,
    "atomic_publish": k_atomic_publish,
    "upsert_load_asteroids": k_upsert_load_asteroids,
    "atomic_publish_asteroids": k_atomic_publish_asteroids,
    "ingest_audit_pages": k_ingest_audit_pages,
    "stream_ingest": k_stream_ingest,
    "stream_window_counts": k_stream_window_counts,
    "ingest_audit_sketches": k_ingest_audit_sketches,
    "feed_chain": k_feed_chain,
    "feed_missing": k_feed_missing,
    "feed_rejects": k_feed_rejects,
    "feed_ledger": k_feed_ledger,
    "stream_rejects": k_stream_rejects,
    "stream_ingest_tolerant": k_stream_ingest_tolerant,
    "summary_monthly": k_summary_monthly,
    "summary_bodies": k_summary_bodies,
}


# --------------------------------------------------------------------------- oracles
ANCHOR = f"DATE '{feed.DEFAULT_ANCHOR.isoformat()}'"


def _window_sql(col: str) -> str:
    return f"{ANCHOR} + CAST(7 * FLOOR(({col} - {ANCHOR}) / 7.0) AS INTEGER)"


FLAT_SQL = (
    "SELECT a.id, a.id AS neo_reference_id, a.name, a.absolute_magnitude_h, a.estimated_diameter_min_km, "
    "a.estimated_diameter_max_km, a.is_potentially_hazardous_asteroid, c.close_approach_date, "
    "c.relative_velocity_kmph, c.astronomical, c.miss_distance_km, c.miss_distance_lunar, c.orbiting_body "
    f"FROM {JOIN}"
)
RECORD = "a.id, c.close_approach_date, c._part"
FIRST_SQL = (
    f"{FLAT_SQL} QUALIFY ROW_NUMBER() OVER (PARTITION BY {RECORD} ORDER BY c.astronomical, c.relative_velocity_kmph, "
    "c.orbiting_body, c.miss_distance_km, c.miss_distance_lunar) = 1"
)
ASTEROIDS_SQL = with_binding(
    "SELECT DISTINCT a.id, a.name, a.absolute_magnitude_h, a.estimated_diameter_min_km, "
    f"a.estimated_diameter_max_km, a.is_potentially_hazardous_asteroid FROM {JOIN}"
)
RECORDS = f"(SELECT DISTINCT {RECORD}, a.name FROM {JOIN})"
FLAT_ORDER = ", ".join(f"{c} ASC NULLS LAST" for c in feed.FEED_ORDER)
FACT_COLUMNS = (
    "neo_reference_id, close_approach_date, relative_velocity_kmph, astronomical, miss_distance_km, "
    "miss_distance_lunar, orbiting_body"
)


def _ranked(rows: str) -> str:
    """CTE: rows ranked within (object, day); the survivor has rn = 1."""
    return (
        "ranked AS (SELECT c.*, ROW_NUMBER() OVER (PARTITION BY c.neo_reference_id, c.close_approach_date "
        "ORDER BY c.astronomical ASC NULLS LAST, c.relative_velocity_kmph DESC NULLS LAST, "
        "c.orbiting_body ASC NULLS LAST, c.miss_distance_km ASC NULLS LAST, c.miss_distance_lunar ASC NULLS LAST) AS rn "
        f"FROM {rows})"
    )


DEDUP_FACT_SQL = with_binding(f"SELECT {FACT_COLUMNS} FROM ranked WHERE rn = 1", _ranked(JOIN))


def _pages_sql(size: int) -> str:
    """CTEs: the records of the feed, and the page each was landed on."""
    return f"""
rec AS (SELECT DISTINCT a.id, c.close_approach_date AS d, c._part AS part, {_window_sql("c.close_approach_date")} AS w FROM {JOIN}),
cnt AS (SELECT w, CAST(ceil(COUNT(*) / {size}.0) AS BIGINT) AS pages FROM rec GROUP BY w),
placed AS (SELECT rec.*, pages, ((id * 7 + (d - {ANCHOR}) * 3 + part) % pages + pages) % pages AS page FROM rec JOIN cnt ON cnt.w = rec.w),
landed AS (SELECT DISTINCT w, pages, page FROM placed)"""


def _link_sql(w: str, page: str) -> str:
    return f"'feed?start_date=' || strftime({w}, '%Y-%m-%d') || '&end_date=' || strftime({w} + 6, '%Y-%m-%d') || '&page=' || {page}"


CHAIN_SQL = with_binding(
    f"""SELECT {_link_sql("w", "page")} AS page, 'missing' AS ends, {_link_sql("lw", "lp")} AS "end",
       n - pos AS steps, pos AS place, n AS length, {_link_sql("lnw", "lnp")} AS to_fetch
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY chain ORDER BY w, page) AS pos, COUNT(*) OVER (PARTITION BY chain) AS n,
      LAST_VALUE(w) OVER z AS lw, LAST_VALUE(page) OVER z AS lp, LAST_VALUE(nw) OVER z AS lnw, LAST_VALUE(np) OVER z AS lnp
      FROM island WINDOW z AS (PARTITION BY chain ORDER BY w, page ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""",
    _pages_sql(SMALL_PAGES)
    + """,
nxt AS (SELECT w, page, CASE WHEN page + 1 < pages THEN w ELSE w + 7 END AS nw, CASE WHEN page + 1 < pages THEN page + 1 ELSE 0 END AS np FROM landed),
fol AS (SELECT *, LEAD(w) OVER k AS fw, LEAD(page) OVER k AS fp FROM nxt WINDOW k AS (ORDER BY w, page)),
island AS (SELECT *, coalesce(SUM(CASE WHEN fw = nw AND fp = np THEN 0 ELSE 1 END)
           OVER (ORDER BY w, page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chain FROM fol)""",
)
MISSING_SQL = with_binding(
    """SELECT w AS window_start, w + 6 AS window_end, CAST(page AS INTEGER) AS page, CASE WHEN page < last THEN 'gap' ELSE 'next' END AS reason
FROM known k WHERE NOT EXISTS (SELECT 1 FROM landed l WHERE l.w = k.w AND l.page = k.page)
UNION ALL
SELECT MIN(day), MAX(day), CAST(0 AS INTEGER), 'window' FROM (SELECT day, run, (day - MIN(day) OVER (PARTITION BY run)) // 7 AS piece FROM runs) GROUP BY run, piece""",
    _pages_sql(SMALL_PAGES)
    + f""",
b AS (SELECT MIN(close_approach_date) + {BEFORE_DAYS} AS lo, MAX(close_approach_date) + {AFTER_DAYS} AS hi FROM close_approach),
lw AS (SELECT w, MAX(page) AS last, any_value(pages) AS pages FROM landed, b WHERE w <= hi AND w + 6 >= lo GROUP BY w),
known AS (SELECT w, last, unnest(range(0, CASE WHEN last + 1 < pages THEN last + 2 ELSE last + 1 END)) AS page FROM lw),
days AS (SELECT CAST(t.x AS DATE) AS day FROM b, generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY) AS t(x)),
free AS (SELECT day FROM days WHERE NOT EXISTS (SELECT 1 FROM lw WHERE day BETWEEN w AND w + 6)),
runs AS (SELECT day, day - CAST(ROW_NUMBER() OVER (ORDER BY day) AS INTEGER) AS run FROM free)""",
)
# every approach with the page it was landed on, its place in its record's list and what is wrong with it
_SOILED = (
    _pages_sql(SOILED_PAGES)
    + f""",
element AS (SELECT c.*, p.w, p.page, strftime(p.d, '%Y-%m-%d') AS day, CAST(ROW_NUMBER() OVER (PARTITION BY a.id, p.d, p.part
   ORDER BY c.astronomical, c.relative_velocity_kmph, c.orbiting_body, c.miss_distance_km, c.miss_distance_lunar,
   CASE WHEN c._line = {landing.BAD_DATE_LINE} THEN strftime(p.d, '%d/%m/%Y') ELSE strftime(p.d, '%Y-%m-%d') END,
   c._line = {landing.BAD_VELOCITY_LINE}) - 1 AS INTEGER) AS element,
   CASE c._line WHEN {landing.BAD_DATE_LINE} THEN 'close_approach_date' WHEN {landing.BAD_VELOCITY_LINE} THEN 'relative_velocity_kmph' END AS bad
   FROM {JOIN} JOIN placed p ON p.id = a.id AND p.d = c.close_approach_date AND p.part = c._part),
good AS (SELECT * FROM element WHERE page <> {landing.BROKEN_PAGE} AND bad IS NULL)"""
)
REJECTS_SQL = with_binding(
    f"""SELECT {_link_sql("w", "page")} AS page, day, neo_reference_id AS id, element, bad AS bad_fields, 'record' AS route
FROM element WHERE page <> {landing.BROKEN_PAGE} AND bad IS NOT NULL
UNION ALL SELECT {_link_sql("w", "page")}, NULL, NULL, NULL, '', 'page' FROM landed WHERE page = {landing.BROKEN_PAGE}""",
    _SOILED,
)
LEDGER_SQL = with_binding(
    f"""SELECT pages, broken_pages, approaches, approaches - good AS rejected, CAST(0 AS BIGINT) AS bare_objects, good, new, good - new AS duplicates
FROM (SELECT COUNT(*) AS pages, COUNT(*) FILTER (WHERE page = {landing.BROKEN_PAGE}) AS broken_pages FROM landed),
     (SELECT COUNT(*) AS approaches FROM element WHERE page <> {landing.BROKEN_PAGE}),
     (SELECT COUNT(*) AS good, COUNT(DISTINCT (neo_reference_id, close_approach_date)) AS new FROM good)""",
    _SOILED,
)
TOLERANT_SQL = with_binding(f"SELECT {FACT_COLUMNS} FROM ranked WHERE rn = 1", _SOILED + ", " + _ranked("good c"))

INGEST_ORACLES: dict[str, str] = {
    "feed_windows": with_binding(
        "SELECT CAST(w AS DATE) AS window_start, LEAST(CAST(w AS DATE) + 6, hi) AS window_end "
        "FROM s, generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 7 DAY) AS t(w)",
        "b AS (SELECT MIN(close_approach_date) AS d0, MAX(close_approach_date) AS hi FROM close_approach), "
        f"s AS (SELECT {_window_sql('d0')} AS lo, hi FROM b)",
    ),
    "feed_scan": with_binding(
        f"SELECT {_window_sql('close_approach_date')} AS window_start, COUNT(*) AS n_objects, "
        f"COUNT(DISTINCT close_approach_date) AS n_days FROM {RECORDS} r GROUP BY 1"
    ),
    "feed_explode_days": with_binding(
        f"SELECT close_approach_date, COUNT(*) AS n_objects FROM {RECORDS} r GROUP BY 1"
    ),
    "feed_explode_objects": with_binding(f"SELECT close_approach_date, id, name FROM {RECORDS} r"),
    "feed_flatten": with_binding(FIRST_SQL),
    "feed_all_approaches": with_binding(FLAT_SQL),
    "feed_limit": with_binding(f"SELECT * FROM ({FLAT_SQL}) f ORDER BY {FLAT_ORDER} LIMIT {FEED_TARGET_ROWS}"),
    "ingest_audit": with_binding(
        f"SELECT {_window_sql('c.close_approach_date')} AS window_start, COUNT(*) AS n_records, "
        "COUNT(DISTINCT a.id) AS n_objects, COUNT(DISTINCT c.close_approach_date) AS n_days, "
        "COUNT(*) FILTER (WHERE c.relative_velocity_kmph IS NULL) AS null_velocity, "
        "COUNT(*) FILTER (WHERE c.astronomical IS NULL) AS null_au, "
        "COUNT(*) FILTER (WHERE c.orbiting_body IS NULL) AS null_body "
        f"FROM {JOIN} GROUP BY 1"
    ),
    "ingest_audit_sketches": with_binding(
        f"SELECT {_window_sql('c.close_approach_date')} AS window_start, COUNT(*) AS n_records, "
        "COUNT(DISTINCT c.close_approach_date) AS n_days, "
        "COUNT(*) FILTER (WHERE c.relative_velocity_kmph IS NULL) AS null_velocity, "
        "COUNT(*) FILTER (WHERE c.astronomical IS NULL) AS null_au, "
        f"COUNT(*) FILTER (WHERE c.orbiting_body IS NULL) AS null_body, TRUE AS within_3_pct FROM {JOIN} GROUP BY 1"
    ),
    "load_asteroids": ASTEROIDS_SQL,
    "upsert_load_asteroids": ASTEROIDS_SQL,
    "atomic_publish_asteroids": ASTEROIDS_SQL,
    "ingest_audit_pages": with_binding(
        f"SELECT {_window_sql('c.close_approach_date')} AS window_start, COUNT(*) AS n_records, "
        "CAST(0 AS BIGINT) AS null_date, COUNT(*) FILTER (WHERE c.relative_velocity_kmph IS NULL) AS null_velocity, "
        f"COUNT(*) FILTER (WHERE c.astronomical IS NULL) AS null_au, CAST(0 AS BIGINT) AS rejected FROM {JOIN} GROUP BY 1"
    ),
    "load_close_approach": DEDUP_FACT_SQL,
    "create_tables": DEDUP_FACT_SQL,
    "upsert_load": DEDUP_FACT_SQL,
    "atomic_publish": DEDUP_FACT_SQL,
    "stream_ingest": DEDUP_FACT_SQL,
    "feed_chain": CHAIN_SQL,
    "feed_missing": MISSING_SQL,
    "feed_rejects": REJECTS_SQL,
    "stream_rejects": REJECTS_SQL,
    "feed_ledger": LEDGER_SQL,
    "stream_ingest_tolerant": TOLERANT_SQL,
    "summary_monthly": with_binding(
        "SELECT strftime(close_approach_date, '%Y-%m') AS approach_month, COUNT(*) AS approaches_count FROM ranked WHERE rn = 1 GROUP BY 1",
        _ranked(JOIN),
    ),
    "summary_bodies": with_binding("SELECT DISTINCT orbiting_body FROM ranked WHERE rn = 1", _ranked(JOIN)),
    "stream_window_counts": (
        "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, "
        "time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, event_type, "
        "COUNT(*) AS n_events, MAX(value) AS max_value FROM events WHERE ts IS NOT NULL GROUP BY 1, 2, 3"
    ),
}
