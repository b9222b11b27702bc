"""Page links: how landed pages hang together by ``links.next``, and which pages are still to be fetched.

A page is named by its own link (``links.self``); the same page landed several times is one page (of
different ``next`` links the least counts), a page without a link of its own cannot be pointed to and
is left out.  Links name a request window and a page number: ``start_date``, ``end_date``, ``page``
(0 where absent).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from perigee.session import new_run_dir, shuffle_files_removed
from perigee.sources import store
from perigee.sources.feed import DATE_FORMAT, WINDOW_DAYS


# --------------------------------------------------------------------------- links
def page_links(pages: DataFrame) -> DataFrame:
    """(page, next): each landed page once."""
    named = pages.select(F.col("links.self").alias("page"), F.col("links.next").alias("next"))
    return named.where(F.col("page").isNotNull()).groupBy("page").agg(F.min("next").alias("next"))


def link_parts(link: Column) -> Column:
    """(start, end, page) of a link; NULL dates where it names none."""
    part = lambda pattern: F.nullif(F.regexp_extract(link, pattern, 1), F.lit(""))
    return F.struct(
        F.try_to_date(part(r"start_date=([0-9-]+)"), DATE_FORMAT).alias("start"),
        F.try_to_date(part(r"end_date=([0-9-]+)"), DATE_FORMAT).alias("end"),
        F.coalesce(part(r"[?&]page=([0-9]+)").try_cast("int"), F.lit(0)).alias("page"),
    )


# --------------------------------------------------------------------------- chains
def _kept(df: DataFrame, open_rows: Observation) -> tuple[DataFrame, str]:
    with shuffle_files_removed(df.sparkSession):
        path = new_run_dir(df.sparkSession, "chain")
        df.observe(open_rows, F.count(F.lit(1)).alias("all"), F.count_if(~F.col("done")).alias("open")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _doubled(start: DataFrame) -> tuple[DataFrame, bool]:
    """Pointer doubling of (page, at, steps, low, done): ``at`` is where ``steps`` links from the page lead,
    ``low`` the least page passed.  After round k a page has gone 2^k links or to its end, so the rounds
    grow with the logarithm of the longest chain; pages that are still going after as many links as there
    are pages run in a loop (True is returned then).  A round replaces the one before, whose files go.
    """
    seen = Observation()
    now, path = _kept(start, seen)
    n, gone = seen.get["all"], 1
    while seen.get["open"] and gone < n:
        there = now.select(
            F.col("page").alias("at"), F.col("at").alias("at2"), F.col("steps").alias("steps2"),
            F.col("low").alias("low2"), F.col("done").alias("done2"),
        )
        going = now.where("NOT done").join(there, "at").select(
            "page", F.col("at2").alias("at"), (F.col("steps") + F.col("steps2")).alias("steps"),
            F.least("low", "low2").alias("low"), F.col("done2").alias("done"),
        )
        seen = Observation()
        now, new_path = _kept(now.where("done").unionByName(going), seen)
        store.remove(start.sparkSession, path)
        path, gone = new_path, gone * 2
    return now, bool(seen.get["open"])


def chains(pages: DataFrame) -> DataFrame:
    """Where each landed page stands in its chain of ``next`` links.

    * ``ends``: 'feed' (a page without a next link), 'missing' (the next page is not landed) or 'loop';
    * ``end``: the chain's last landed page; for a loop its least page;
    * ``steps``: links from the page to that end; to the first page of the loop (0 in the loop itself);
    * ``place``, ``length``: 1 for the first page; NULL for loops.  Where several chains run into one, the
      longest sets the length;
    * ``to_fetch``: the link that is not landed.
    """
    links = page_links(pages)
    known = links.select(F.col("page").alias("target"))
    named = links.join(known, F.col("next") == F.col("target"), "left")
    goes_on = F.col("target").isNotNull()
    start = named.select(
        "page",
        F.coalesce("target", "page").alias("at"),
        goes_on.cast("bigint").alias("steps"),
        F.least("page", "target").alias("low"),
        (~goes_on).alias("done"),
    )
    ranked, loops = _doubled(start)
    ended = ranked.where("done").select("page", F.col("at").alias("end"), "steps")
    out = _placed(ended, links)
    if loops:
        out = out.unionByName(_loops(ranked.where("NOT done"), links))
    return out


def _placed(ended: DataFrame, links: DataFrame) -> DataFrame:
    lengths = ended.groupBy("end").agg((F.max("steps") + 1).alias("length"))
    ends = lengths.join(links, lengths["end"] == links["page"]).select("end", "length", F.col("next").alias("to_fetch"))
    return ended.join(ends, "end").select(
        "page",
        F.when(F.col("to_fetch").isNull(), "feed").otherwise("missing").alias("ends"),
        "end",
        "steps",
        (F.col("length") - F.col("steps")).alias("place"),
        "length",
        "to_fetch",
    )


def _loops(going: DataFrame, links: DataFrame) -> DataFrame:
    """Pages that never reach an end: after as many links as there are pages each stands on its loop, and
    every page of a loop is stood on."""
    on_loop = going.select(F.col("at").alias("page")).distinct().join(going.select("page", "low"), "page")
    outside = going.select("page").join(links, "page").join(on_loop.withColumnRenamed("low", "name"), "page", "left")
    inside = F.col("name").isNotNull()
    start = outside.select(
        "page",
        F.when(inside, F.col("page")).otherwise(F.col("next")).alias("at"),
        F.when(inside, 0).otherwise(1).cast("bigint").alias("steps"),
        F.col("page").alias("low"),
        inside.alias("done"),
    )
    ranked, _ = _doubled(start)
    # the first page of the loop and the loop's name
    entry = on_loop.select(F.col("page").alias("at"), F.col("low").alias("end"))
    return ranked.join(entry, "at").select(
        "page",
        F.lit("loop").alias("ends"),
        "end",
        "steps",
        F.lit(None).cast("bigint").alias("place"),
        F.lit(None).cast("bigint").alias("length"),
        F.lit(None).cast("string").alias("to_fetch"),
    )


# --------------------------------------------------------------------------- what is missing
def missing_pages(pages: DataFrame, start: dt.date, end: dt.date, days: int = WINDOW_DAYS) -> DataFrame:
    """(window_start, window_end, page, reason): what is to be fetched for ``start..end``.

    * 'window': days that no landed window covers, cut into windows of at most ``days`` days from the first
      uncovered day on (landed windows may begin on any day and overlap); their page 0 is asked for;
    * 'gap': page numbers of a landed window below one that is landed;
    * 'next': the page after the last landed one, where that one's link names it; what follows is unknown.

    Rows for windows and days are bounded by the calendar; pages are spread by (window, number).
    """
    spark = pages.sparkSession
    links = page_links(pages).select(link_parts(F.col("page")).alias("own"), link_parts(F.col("next")).alias("next"))
    wanted = (F.col("own.start") <= F.lit(end)) & (F.col("own.end") >= F.lit(start))
    landed = links.where(wanted).select(
        F.col("own.start").alias("window_start"), F.col("own.end").alias("window_end"), F.col("own.page").alias("page"), "next"
    )
    stays = (F.col("next.start") == F.col("window_start")) & (F.col("next.end") == F.col("window_end"))
    per_window = landed.groupBy("window_start", "window_end").agg(
        F.max("page").alias("last"), F.max(F.when(stays, F.col("next.page"))).alias("named")
    )
    upto = F.greatest("last", "named")
    known = per_window.select(
        "window_start", "window_end", F.explode(F.sequence(F.lit(0), upto)).alias("page"), F.col("last")
    ).select("window_start", "window_end", "page", F.when(F.col("page") < F.col("last"), "gap").otherwise("next").alias("reason"))
    inside = known.join(landed.select("window_start", "window_end", "page"), ["window_start", "window_end", "page"], "left_anti")

    bounds = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("day"))
    covered = per_window.select(F.explode(F.sequence("window_start", "window_end")).alias("day")).distinct()
    free = bounds.join(covered, "day", "left_anti")
    # one row per calendar day: a window without partitions is fine
    run = free.withColumn("run", F.date_sub("day", F.row_number().over(Window.orderBy("day"))))
    first = F.min("day").over(Window.partitionBy("run"))
    piece = F.floor(F.datediff("day", first) / days).alias("piece")
    asked = run.select("day", "run", piece).groupBy("run", "piece").agg(
        F.min("day").alias("window_start"), F.max("day").alias("window_end")
    )
    return inside.unionByName(
        asked.select("window_start", "window_end", F.lit(0).alias("page"), F.lit("window").alias("reason"))
    )
