"""The analytical catalogue: 21 dashboard questions plus three corrected variants.

Every function has the signature ``q(asteroids, approaches, filters=None, **params)``
and returns a lazy DataFrame whose columns carry the dashboard's aliases.

Plan shape (what holds at 100 TB):

* Predicates from ``FilterSpec`` and from the query itself are applied to each base
  table before any join or grouping, so they reach the Parquet scan.
* Aggregates over approaches are computed per object first (``groupBy(neo_reference_id)``
  with map-side partial aggregation) and only then joined to the dimension.  The fact
  side collapses to one row per object before the join, and a hot object costs no more
  than any other, because partial aggregation already combined its rows per task.
  This equals join-then-aggregate for count/sum/min/max, also when ids repeat in the
  dimension.
* Row-level joins use plain equi-joins: Catalyst broadcasts the dimension only when its
  estimated size is under ``spark.sql.autoBroadcastJoinThreshold``; otherwise a
  sort-merge join whose skewed partitions AQE splits.
* Top-k uses ``orderBy().limit()`` -> ``TakeOrderedAndProject`` (per-task top-k, then
  a k-row merge); ties are broken by a total order so results are deterministic.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perigee.functions.columns import (
    DEFAULT_BAND_EDGES,
    closest_key,
    hazard_label,
    in_year,
    month_start,
    month_text,
    velocity_band,
)
from perigee.operators.filters import FilterSpec, filter_approaches, filter_asteroids, month_range
from perigee.schemas import DETAIL_COLUMNS

A_KEY = "id"
C_KEY = "neo_reference_id"


def _sides(a: DataFrame, ca: DataFrame, filters: FilterSpec | None) -> tuple[DataFrame, DataFrame]:
    return filter_asteroids(a, filters), filter_approaches(ca, filters)


def _join(a: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Dimension-to-fact equi-join (column names of the two tables are disjoint)."""
    return a.join(right, a[A_KEY] == right[C_KEY], how)


def _per_object(ca: DataFrame, *aggs: Column) -> DataFrame:
    """Fact aggregated to one row per object (rows without a key never join)."""
    ca = ca.where(F.col(C_KEY).isNotNull())
    return ca.groupBy(C_KEY).agg(*aggs) if aggs else ca.select(C_KEY).distinct()


def _per_day(ca: DataFrame, *aggs: Column) -> DataFrame:
    """Fact aggregated to one row per object and day."""
    return ca.where(F.col(C_KEY).isNotNull()).groupBy(C_KEY, "close_approach_date").agg(*aggs)


# --------------------------------------------------------------------------- q00
def q00_details(a: DataFrame, ca: DataFrame, filters: FilterSpec | None = None) -> DataFrame:
    """Every approach with its object's attributes (inner join, no order)."""
    a, ca = _sides(a, ca, filters)
    return _join(a, ca).select(*DETAIL_COLUMNS)


# --------------------------------------------------------------------------- q01
def q01_approach_count(
    a: DataFrame, ca: DataFrame, filters: FilterSpec | None = None, count_approaches: bool = False
) -> DataFrame:
    """Per name, ``COUNT(a.id)`` over ``asteroids LEFT JOIN close_approach``.

    As in the dashboard an object without approaches counts 1; ``count_approaches``
    counts approach rows instead (an object without approaches counts 0).  An active
    approach filter acts as a ``WHERE`` after the outer join, i.e. it turns it inner.
    """
    approach_filtered = filters is not None and filters.filters_approaches
    a, ca = _sides(a, ca, filters)
    per_id = _per_object(ca, F.count(F.lit(1)).alias("_n"))
    joined = _join(a, per_id, "inner" if approach_filtered else "left")
    if count_approaches:
        contrib = F.coalesce(F.col("_n"), F.lit(0))
    else:
        contrib = F.when(F.col(A_KEY).isNull(), F.lit(0)).otherwise(F.coalesce(F.col("_n"), F.lit(1)))
    return (
        joined.groupBy(F.col("name"))
        .agg(F.sum(contrib).cast("bigint").alias("number_of_approaches"))
        .select(F.col("name").alias("asteroid_name"), "number_of_approaches")
        .orderBy(F.desc("number_of_approaches"), F.asc("asteroid_name"))
    )


def q01b_true_approach_count(a: DataFrame, ca: DataFrame, filters: FilterSpec | None = None) -> DataFrame:
    return q01_approach_count(a, ca, filters, count_approaches=True)


# --------------------------------------------------------------------------- q02
def q02_avg_velocity(
    a: DataFrame,
    ca: DataFrame,
    filters: FilterSpec | None = None,
    min_count: int = 1,
    exact_digits: int | None = None,
) -> DataFrame:
    """Average velocity per name over names with more than ``min_count`` approaches.

    ``exact_digits=k`` averages the values as integers of 10^-k (exact, independent of
    summation order) for velocities recorded with at most k decimals.
    """
    a, ca = _sides(a, ca, filters)
    if exact_digits is None:
        part_sum = F.sum(F.col("relative_velocity_kmph"))
    else:
        part_sum = F.sum(F.round(F.col("relative_velocity_kmph") * float(10**exact_digits)).cast("bigint"))
    per_id = _per_object(
        ca, F.count(F.lit(1)).alias("_n"), part_sum.alias("_s"), F.count(F.col("relative_velocity_kmph")).alias("_c")
    )
    total = F.sum("_s") if exact_digits is None else F.sum("_s").cast("double")
    avg = F.try_divide(total, F.sum("_c"))
    if exact_digits is not None:
        avg = avg / float(10**exact_digits)
    return (
        _join(a, per_id)
        .groupBy(F.col("name"))
        .agg(avg.alias("average_velocity_kmph"), F.sum("_n").alias("_n"))
        .where(F.col("_n") > min_count)
        .select(F.col("name").alias("asteroid_name"), "average_velocity_kmph")
        .orderBy(F.desc("average_velocity_kmph"), F.asc("asteroid_name"))
    )


# --------------------------------------------------------------------------- q03
def q03_top_fastest(a: DataFrame, ca: DataFrame, filters: FilterSpec | None = None, k: int = 10) -> DataFrame:
    """Top k (name, date) groups by their fastest approach.

    The fact is first cut to one row per object and day (hash aggregate, map-side), which is
    what meets the dimension.
    """
    a, ca = _sides(a, ca, filters)
    return (
        _join(a, _per_day(ca, F.max("relative_velocity_kmph").alias("relative_velocity_kmph")))
        .groupBy(F.col("name"), F.col("close_approach_date"))
        .agg(F.max(F.col("relative_velocity_kmph")).alias("fastest_velocity_kmph"))
        .orderBy(F.desc("fastest_velocity_kmph"), F.asc("name"), F.asc("close_approach_date"))
        .limit(k)
        .select(F.col("name").alias("asteroid_name"), "fastest_velocity_kmph", "close_approach_date")
    )


def q03b_top_fastest_objects(
    a: DataFrame, ca: DataFrame, filters: FilterSpec | None = None, k: int = 10
) -> DataFrame:
    """Top k objects by fastest approach, one row per object, with that approach's date
    (earliest date among equal speeds; NULL only where none of them has one).

    Two steps: the greatest speed of each object (a hash aggregate with map-side partial results) gives the
    k-th speed; only objects that reach it go on, and only their rows at their greatest speed are looked at for the
    date.  Ties at the k-th speed all go on, so the final order decides among them.
    """
    a, ca = _sides(a, ca, filters)
    speed = F.col("relative_velocity_kmph")
    fastest = _per_object(ca.where(speed.isNotNull()), F.max(speed).alias("_v"))
    named = _join(a, fastest).select(F.col(A_KEY).alias("_id"), "name", "_v")
    reached = named.where(F.col("_v") >= _kth_greatest(named, "_v", k, fewer=F.min("_v")))
    rows = ca.select(F.col(C_KEY).alias("_c"), speed, "close_approach_date")
    first = rows.join(reached, (F.col("_c") == F.col("_id")) & (speed == F.col("_v")))
    return (
        first.groupBy("_id", "name", "_v")
        .agg(F.min("close_approach_date").alias("close_approach_date"))
        .select(
            F.col("_id").alias("asteroid_id"),
            F.col("name").alias("asteroid_name"),
            F.col("_v").alias("fastest_velocity_kmph"),
            "close_approach_date",
        )
        .orderBy(
            F.desc("fastest_velocity_kmph"),
            F.asc("asteroid_name"),
            F.asc("close_approach_date"),
            F.asc("asteroid_id"),
        )
        .limit(k)
    )


def _kth_greatest(rows: DataFrame, value: str, k: int, fewer: Column) -> Column:
    """The ``k``-th greatest value of ``rows`` as a scalar subquery; ``fewer`` (an aggregate of the rows) where
    there are not ``k``."""
    first = rows.select(value).orderBy(F.desc(value)).limit(k)
    return first.agg(F.when(F.count(F.lit(1)) >= k, F.min(value)).otherwise(fewer).alias("bound")).scalar()


# --------------------------------------------------------------------------- q04
def q04_hazardous_frequent(
    a: DataFrame, ca: DataFrame, filters: FilterSpec | None = None, min_count: int = 3
) -> DataFrame:
    a, ca = _sides(a, ca, filters)
    per_id = _per_object(ca, F.count(F.lit(1)).alias("_n"))
    return (
        _join(a.where(F.col("is_potentially_hazardous_asteroid") == F.lit(True)), per_id)
        .groupBy(F.col("name"))
        .agg(F.sum("_n").alias("number_of_approaches"))
        .where(F.col("number_of_approaches") > min_count)
        .select(F.col("name").alias("asteroid_name"), "number_of_approaches")
        .orderBy(F.desc("number_of_approaches"), F.asc("asteroid_name"))
    )


# --------------------------------------------------------------------------- q05 / q11
def _monthly(ca: DataFrame) -> DataFrame:
    return (
        ca.groupBy(month_start(F.col("close_approach_date")).alias("_m"))
        .agg(F.count(C_KEY).alias("approaches_count"))
        .select(month_text(F.col("_m")).alias("approach_month"), "approaches_count")
    )


def q05_busiest_month(a: DataFrame, ca: DataFrame, filters: FilterSpec | None = None, k: int = 1) -> DataFrame:
    ca = filter_approaches(ca, filters)
    return _monthly(ca).orderBy(F.desc("approaches_count"), F.asc("approach_month")).limit(k)


def q11_monthly_counts(a: DataFrame, ca: DataFrame, filters: FilterSpec | None = None) -> DataFrame:
    ca = filter_approaches(ca, filters)
    return _monthly(ca).orderBy(F.asc("approach_month"))


# --------------------------------------------------------------------------- q06
def q06_fastest_ever(a: DataFrame, ca: DataFrame, filters: FilterSpec | None = None, k: int = 1) -> DataFrame:
    """The k fastest approaches.

    The k-th of the objects' greatest speeds (a hash aggregate) is a bound that at least k approaches reach: only
    rows that reach it meet the dimension again.  With fewer than k objects that have a speed every row may count.
    """
    a, ca = _sides(a, ca, filters)
    speed = F.col("relative_velocity_kmph")
    fastest = _join(a, _per_object(ca.where(speed.isNotNull()), F.max(speed).alias("_v"))).select("_v")
    bound = _kth_greatest(fastest, "_v", k, fewer=F.lit(None).cast("double"))
    return (
        _join(a, ca.where((speed >= bound) | bound.isNull()).select(C_KEY, "relative_velocity_kmph", "close_approach_date"))
        .orderBy(speed.desc(), F.col("name").asc(), F.col("close_approach_date").asc())
        .limit(k)
        .select(F.col("name").alias("asteroid_name"), "relative_velocity_kmph", "close_approach_date")
    )


# --------------------------------------------------------------------------- q07
def q07_by_diameter(a: DataFrame, ca: DataFrame, filters: FilterSpec | None = None) -> DataFrame:
    a = filter_asteroids(a, filters)
    return a.select(F.col("name").alias("asteroid_name"), "estimated_diameter_max_km").orderBy(
        F.desc("estimated_diameter_max_km"), F.asc("asteroid_name")
    )


# --------------------------------------------------------------------------- q08
def getting_nearer_ids(ca: DataFrame) -> DataFrame:
    """Objects with an approach that is both later and nearer than another one.

    Equivalent to the self-join ``c1.date < c2.date AND c1.au > c2.au`` without
    emitting pairs: per (object, day) keep the smallest and largest distance; a pair
    exists iff some day's largest distance exceeds the next recorded day's smallest
    (if every day's max <= next day's min, the chain max_i <= min_j holds for all
    i < j).  The per-object window therefore sees at most one row per calendar day,
    however many approaches a hot object has.
    """
    daily = (
        ca.where(
            F.col(C_KEY).isNotNull() & F.col("close_approach_date").isNotNull() & F.col("astronomical").isNotNull()
        )
        .groupBy(C_KEY, F.col("close_approach_date"))
        .agg(F.min(F.col("astronomical")).alias("_lo"), F.max(F.col("astronomical")).alias("_hi"))
    )
    by_day = Window.partitionBy(C_KEY).orderBy(F.col("close_approach_date"))
    return (
        daily.withColumn("_prev_hi", F.lag("_hi").over(by_day))
        .where(F.col("_prev_hi") > F.col("_lo"))
        .select(C_KEY)
        .distinct()
    )


def q08_getting_nearer(
    a: DataFrame, ca: DataFrame, filters: FilterSpec | None = None, min_ids: int = 1
) -> DataFrame:
    """Names under which more than ``min_ids`` objects are getting nearer (dashboard form)."""
    a, ca = _sides(a, ca, filters)
    ids = getting_nearer_ids(ca)
    return (
        _join(a, ids)
        .groupBy(F.col("name"))
        .agg(F.countDistinct(A_KEY).alias("_ids"))
        .where(F.col("_ids") > min_ids)
        .select(F.col("name").alias("asteroid_name"))
    )


def q08b_getting_nearer_objects(a: DataFrame, ca: DataFrame, filters: FilterSpec | None = None) -> DataFrame:
    """Every object having a later approach nearer than an earlier one."""
    a, ca = _sides(a, ca, filters)
    ids = getting_nearer_ids(ca)
    return _join(a, ids).select(F.col(A_KEY).alias("asteroid_id"), F.col("name").alias("asteroid_name")).distinct()


# --------------------------------------------------------------------------- q09
def q09_closest_approach(a: DataFrame, ca: DataFrame, filters: FilterSpec | None = None) -> DataFrame:
    """Per name: smallest distance and the date it happened (earliest date among ties).

    Both outputs come from one row: rows without a distance or a date take no part, and a name that
    has no other rows gets NULL for both.  Two steps: the smallest distance of each object is a hash aggregate
    (a struct minimum would sort the fact); the rows at that distance then give the earliest date.
    """
    a, ca = _sides(a, ca, filters)
    au, day = F.col("astronomical"), F.col("close_approach_date")
    known = ca.where(F.col(C_KEY).isNotNull() & au.isNotNull() & day.isNotNull())
    least = ca.where(F.col(C_KEY).isNotNull()).groupBy(F.col(C_KEY).alias("_id"))
    least = least.agg(F.min(F.when(day.isNotNull(), au)).alias("_au"))
    at_least = known.select(C_KEY, au, day).join(least, (F.col(C_KEY) == F.col("_id")) & (au == F.col("_au")))
    dated = at_least.groupBy("_id", "_au").agg(F.min(day).alias("_day"))
    # an object without such a row still has its name listed
    bare = least.where(F.col("_au").isNull()).select("_id", "_au", F.lit(None).cast("date").alias("_day"))
    per_id = dated.unionByName(bare).select(F.col("_id").alias(C_KEY), closest_key(F.col("_au"), F.col("_day")).alias("_k"))
    key = F.min("_k")
    return (
        _join(a, per_id)
        .groupBy(F.col("name"))
        .agg(key.getField("au").alias("closest_astronomical_distance"), key.getField("day").alias("closest_approach_date"))
        .select(F.col("name").alias("asteroid_name"), "closest_astronomical_distance", "closest_approach_date")
        .orderBy(F.asc("closest_astronomical_distance"), F.asc("asteroid_name"))
    )


# --------------------------------------------------------------------------- q10
def q10_fast_approaches(
    a: DataFrame, ca: DataFrame, filters: FilterSpec | None = None, min_velocity: float = 50000.0
) -> DataFrame:
    a, ca = _sides(a, ca, filters)
    return (
        _join(a, ca.where(F.col("relative_velocity_kmph") > F.lit(float(min_velocity))))
        .select(F.col("name").alias("asteroid_name"), "relative_velocity_kmph", "close_approach_date")
        .distinct()
        .orderBy(F.desc("relative_velocity_kmph"), F.asc("asteroid_name"), F.asc("close_approach_date"))
    )


# --------------------------------------------------------------------------- q12
def q12_brightest(a: DataFrame, ca: DataFrame, filters: FilterSpec | None = None, k: int = 1) -> DataFrame:
    """Lowest absolute magnitude (ascending order puts NULL first, as in the dashboard)."""
    a = filter_asteroids(a, filters)
    return (
        a.orderBy(F.asc_nulls_first("absolute_magnitude_h"), F.asc(A_KEY))
        .limit(k)
        .select(F.col("name").alias("asteroid_name"), "absolute_magnitude_h")
    )


# --------------------------------------------------------------------------- q13
def q13_hazard_split(a: DataFrame, ca: DataFrame, filters: FilterSpec | None = None) -> DataFrame:
    a = filter_asteroids(a, filters)
    label = hazard_label(F.col("is_potentially_hazardous_asteroid")).alias("hazard_status")
    return a.groupBy(label).agg(F.count(A_KEY).alias("asteroid_count"))


# --------------------------------------------------------------------------- q14
def q14_within_lunar(
    a: DataFrame, ca: DataFrame, filters: FilterSpec | None = None, max_lunar: float = 1.0
) -> DataFrame:
    a, ca = _sides(a, ca, filters)
    return (
        _join(a, ca.where(F.col("miss_distance_lunar") < F.lit(float(max_lunar))))
        .select(
            F.col("name").alias("asteroid_name"),
            "close_approach_date",
            F.col("miss_distance_lunar").alias("miss_distance_lunar_distances"),
            F.col("astronomical").alias("astronomical_units_distance"),
        )
        .orderBy(F.asc("miss_distance_lunar_distances"), F.asc("asteroid_name"), F.asc("close_approach_date"))
    )


# --------------------------------------------------------------------------- q15
def q15_within_au(a: DataFrame, ca: DataFrame, filters: FilterSpec | None = None, max_au: float = 0.05) -> DataFrame:
    a, ca = _sides(a, ca, filters)
    return (
        _join(a, ca.where(F.col("astronomical") <= F.lit(float(max_au))))
        .select(F.col("name").alias("asteroid_name"), "close_approach_date", "astronomical")
        .distinct()
        .orderBy(F.asc("astronomical"), F.asc("asteroid_name"), F.asc("close_approach_date"))
    )


# --------------------------------------------------------------------------- q16
def q16_name_prefix(a: DataFrame, ca: DataFrame, filters: FilterSpec | None = None, prefix: str = "6") -> DataFrame:
    """Names starting with ``prefix`` (a literal prefix; reaches Parquet as StringStartsWith)."""
    a = filter_asteroids(a, filters)
    return a.where(F.col("name").startswith(prefix)).select(
        F.col("name").alias("asteroid_name"), "is_potentially_hazardous_asteroid"
    )


# --------------------------------------------------------------------------- q17
def q17_unique_in_year(a: DataFrame, ca: DataFrame, filters: FilterSpec | None = None, year: int = 2024) -> DataFrame:
    """Distinct objects with an approach in ``year`` (one row)."""
    a, ca = _sides(a, ca, filters)
    pred = in_year(F.col("close_approach_date"), year) & F.col(C_KEY).isNotNull()
    months = month_range(ca, dt.date(year, 1, 1), dt.date(year, 12, 31))
    ids = ca.where(pred if months is None else pred & months).select(C_KEY).distinct()
    return ids.join(a.select(A_KEY), ids[C_KEY] == a[A_KEY], "left_semi").agg(
        F.count(F.lit(1)).alias("unique_asteroids_in_year")
    )


# --------------------------------------------------------------------------- q18
def q18_safe_but_close(
    a: DataFrame, ca: DataFrame, filters: FilterSpec | None = None, max_au: float = 0.001
) -> DataFrame:
    a, ca = _sides(a, ca, filters)
    return (
        _join(
            a.where(F.col("is_potentially_hazardous_asteroid") == F.lit(False)),
            ca.where(F.col("astronomical") < F.lit(float(max_au))),
        )
        .select(
            F.col("name").alias("asteroid_name"),
            "close_approach_date",
            F.col("astronomical").alias("astronomical_distance"),
            "is_potentially_hazardous_asteroid",
        )
        .distinct()
        .orderBy(F.asc("astronomical_distance"), F.asc("asteroid_name"), F.asc("close_approach_date"))
    )


# --------------------------------------------------------------------------- q19
def q19_first_last(a: DataFrame, ca: DataFrame, filters: FilterSpec | None = None) -> DataFrame:
    a, ca = _sides(a, ca, filters)
    per_id = _per_object(
        ca,
        F.min("close_approach_date").alias("_first"),
        F.max("close_approach_date").alias("_last"),
        F.count(F.lit(1)).alias("_n"),
    )
    return (
        _join(a, per_id)
        .groupBy(F.col("name"))
        .agg(
            F.min("_first").alias("earliest_approach_date"),
            F.max("_last").alias("latest_approach_date"),
            F.sum("_n").alias("total_approaches"),
        )
        .select(
            F.col("name").alias("asteroid_name"),
            "earliest_approach_date",
            "latest_approach_date",
            "total_approaches",
        )
        .orderBy("asteroid_name")
    )


# --------------------------------------------------------------------------- q20
def q20_velocity_bands(
    a: DataFrame,
    ca: DataFrame,
    filters: FilterSpec | None = None,
    edges: tuple[float, float] = DEFAULT_BAND_EDGES,
) -> DataFrame:
    """Approach counts in three velocity bands, ordered by the band's slowest approach."""
    ca = filter_approaches(ca, filters)
    return (
        ca.groupBy(velocity_band(F.col("relative_velocity_kmph"), *edges).alias("velocity_range"))
        .agg(F.count(C_KEY).alias("number_of_approaches"), F.min(F.col("relative_velocity_kmph")).alias("_min_v"))
        .orderBy(F.asc_nulls_first("_min_v"))
        .select("velocity_range", "number_of_approaches")
    )


# --------------------------------------------------------------------------- filter page
def filter_summary(a: DataFrame, ca: DataFrame, filters: FilterSpec | None = None) -> DataFrame:
    """Number of distinct objects with at least one approach passing all filters."""
    a, ca = _sides(a, ca, filters)
    ids = ca.where(F.col(C_KEY).isNotNull()).select(C_KEY).distinct()
    return ids.join(a.select(A_KEY), ids[C_KEY] == a[A_KEY], "left_semi").agg(
        F.count(F.lit(1)).alias("unique_asteroids")
    )


def orbiting_bodies(a: DataFrame, ca: DataFrame, filters: FilterSpec | None = None) -> DataFrame:
    """Distinct non-null orbiting bodies, sorted (the choices of the body filter)."""
    return (
        ca.where(F.col("orbiting_body").isNotNull())
        .select("orbiting_body")
        .distinct()
        .orderBy("orbiting_body")
    )


# --------------------------------------------------------------------------- from the summaries of the stored months
def monthly_of_summary(summary: DataFrame) -> DataFrame:
    """q11 of a stored fact from its month summaries (``tables.read_summary``); its first row by count is q05."""
    month = F.col("approach_month")
    counts = summary.groupBy(month.alias("_m")).agg(F.sum("n_keyed").alias("approaches_count"))
    return counts.select(month_text(F.col("_m")).alias("approach_month"), "approaches_count").orderBy(F.asc("approach_month"))


def bodies_of_summary(summary: DataFrame) -> DataFrame:
    """The body list of a stored fact from its month summaries."""
    return summary.where(F.col("orbiting_body").isNotNull()).select("orbiting_body").distinct().orderBy("orbiting_body")


# --------------------------------------------------------------------------- names under a collation
def fold_names(a: DataFrame, collation: str = "UTF8_LCASE") -> DataFrame:
    """Objects with names that a collation holds for equal written alike (the least spelling by code points),
    so that every catalogue query groups them as one, as a database with such a collation does.

    ``UTF8_LCASE`` ignores case; ``UNICODE_CI_AI`` ignores accents, too.  Without this step names are compared
    as they are and predicates on them reach the scan.
    """
    key = F.collate(F.col("name"), collation)
    spelled = a.groupBy(key.alias("_key")).agg(F.min(F.collate(F.col("name"), "UTF8_BINARY")).alias("_name"))
    folded = a.join(spelled, key.eqNullSafe(F.col("_key")), "left")
    return folded.select(*[F.col("_name").alias("name") if c == "name" else a[c] for c in a.columns])


# Which tables each query reads.  A filter side applies only to queries reading it;
# this is structural here (each function filters exactly the tables it reads).
CATALOGUE = {
    "q00_details": (q00_details, {"asteroids", "close_approach"}),
    "q01_approach_count": (q01_approach_count, {"asteroids", "close_approach"}),
    "q01b_true_approach_count": (q01b_true_approach_count, {"asteroids", "close_approach"}),
    "q02_avg_velocity": (q02_avg_velocity, {"asteroids", "close_approach"}),
    "q03_top_fastest": (q03_top_fastest, {"asteroids", "close_approach"}),
    "q03b_top_fastest_objects": (q03b_top_fastest_objects, {"asteroids", "close_approach"}),
    "q04_hazardous_frequent": (q04_hazardous_frequent, {"asteroids", "close_approach"}),
    "q05_busiest_month": (q05_busiest_month, {"close_approach"}),
    "q06_fastest_ever": (q06_fastest_ever, {"asteroids", "close_approach"}),
    "q07_by_diameter": (q07_by_diameter, {"asteroids"}),
    "q08_getting_nearer": (q08_getting_nearer, {"asteroids", "close_approach"}),
    "q08b_getting_nearer_objects": (q08b_getting_nearer_objects, {"asteroids", "close_approach"}),
    "q09_closest_approach": (q09_closest_approach, {"asteroids", "close_approach"}),
    "q10_fast_approaches": (q10_fast_approaches, {"asteroids", "close_approach"}),
    "q11_monthly_counts": (q11_monthly_counts, {"close_approach"}),
    "q12_brightest": (q12_brightest, {"asteroids"}),
    "q13_hazard_split": (q13_hazard_split, {"asteroids"}),
    "q14_within_lunar": (q14_within_lunar, {"asteroids", "close_approach"}),
    "q15_within_au": (q15_within_au, {"asteroids", "close_approach"}),
    "q16_name_prefix": (q16_name_prefix, {"asteroids"}),
    "q17_unique_in_year": (q17_unique_in_year, {"asteroids", "close_approach"}),
    "q18_safe_but_close": (q18_safe_but_close, {"asteroids", "close_approach"}),
    "q19_first_last": (q19_first_last, {"asteroids", "close_approach"}),
    "q20_velocity_bands": (q20_velocity_bands, {"close_approach"}),
}


def filtered_query(
    key: str, a: DataFrame, ca: DataFrame, filters: FilterSpec | None = None, **params
) -> DataFrame:
    """Run any catalogue query under the filters (the Queries page)."""
    fn, _ = CATALOGUE[key]
    return fn(a, ca, filters, **params)


def filtered_details(a: DataFrame, ca: DataFrame, filters: FilterSpec | None = None) -> DataFrame:
    return q00_details(a, ca, filters)
