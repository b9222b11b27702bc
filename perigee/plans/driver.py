"""Driver registry: key -> (spark, sf_dir) -> DataFrame, and key -> oracle SQL.

Every query reads the whole test tables (through the binding in
``perigee.sources.binding``) so its work grows with them.  Parameters are those of
the dashboard, except where the bound data needs another value to be selective
(the year of q17: the bound dates run 1995-2001).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.operators import catalogue as cat
from perigee.operators.filters import FilterSpec
from perigee.plans import oracle
from perigee.plans.ingest_keys import INGEST_KEYS, INGEST_ORACLES
from perigee.sources.binding import bind

QUERY_YEAR = 1998
# q02 on the bound data: velocities are prices in cents, so the exact average applies.
Q02_EXACT_DIGITS = 2

# Filter cases run through the driver (each selects a proper subset of the bound data).
SINGLE_FILTERS: dict[str, FilterSpec] = {
    "filter_name": FilterSpec(name="Blue"),
    "filter_hazard": FilterSpec(hazardous=True),
    "filter_velocity": FilterSpec(velocity=(20000.0, 50000.0)),
    "filter_date": FilterSpec(date=(dt.date(1996, 1, 1), dt.date(1996, 12, 31))),
    "filter_magnitude": FilterSpec(magnitude=(12.0, 20.0)),
    "filter_diameter": FilterSpec(diameter=(0.1, 0.3)),
    "filter_au": FilterSpec(au=(0.0, 0.05)),
    "filter_body": FilterSpec(bodies=("Earth", "Venus")),
}
ALL_FILTERS = FilterSpec(
    name="1",
    hazardous=False,
    velocity=(10000.0, 90000.0),
    date=(dt.date(1995, 6, 1), dt.date(2000, 6, 30)),
    magnitude=(11.0, 25.0),
    diameter=(0.05, 0.4),
    au=(0.0, 0.3),
    bodies=("Earth", "Mars"),
)
# The dashboard's activation rules: untouched sliders stay inactive, the date window
# defaults to (2000-01-01, as_of).
DASHBOARD_FILTERS = FilterSpec.from_dashboard(
    as_of=dt.date(2001, 6, 30),
    velocity=(0.0, 60000.0),
    magnitude=(0.0, 40.0),
    bodies=["Venus"],
)
# Queries page: catalogue queries under filters, one per plan shape.
FILTERED_QUERIES: dict[str, tuple[str, FilterSpec, dict]] = {
    "filtered_query": (
        "q09_closest_approach",
        FilterSpec(hazardous=True, bodies=("Earth", "Mars"), magnitude=(12.0, 25.0)),
        {},
    ),
    "filtered_query_q01": ("q01_approach_count", FilterSpec(name="blue", au=(0.0, 0.2)), {}),
    "filtered_query_q08b": (
        "q08b_getting_nearer_objects",
        FilterSpec(date=(dt.date(1998, 1, 1), dt.date(1998, 12, 31)), au=(0.3, 1.0)),
        {},
    ),
    "filtered_query_q20": ("q20_velocity_bands", FilterSpec(hazardous=True, bodies=("Venus",)), {}),
}

CATALOGUE_PARAMS = {
    "q02_avg_velocity": {"exact_digits": Q02_EXACT_DIGITS},
    "q17_unique_in_year": {"year": QUERY_YEAR},
}


def _catalogue_query(key: str, spec: FilterSpec | None = None, **params) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a, ca = bind(spark, sf_dir)
        merged = {**CATALOGUE_PARAMS.get(key, {}), **params}
        return cat.filtered_query(key, a, ca, spec, **merged)

    run.__name__ = key
    return run


def _with_tables(fn, spec: FilterSpec | None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a, ca = bind(spark, sf_dir)
        return fn(a, ca, spec)

    return run


def catalogue_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {key: _catalogue_query(key) for key in cat.CATALOGUE}
    for key, spec in SINGLE_FILTERS.items():
        out[key] = _with_tables(cat.filtered_details, spec)
    out["filter_all"] = _with_tables(cat.filtered_details, ALL_FILTERS)
    out["filter_summary"] = _with_tables(cat.filter_summary, ALL_FILTERS)
    out["filtered_details"] = _with_tables(cat.filtered_details, DASHBOARD_FILTERS)
    for key, (qkey, spec, params) in FILTERED_QUERIES.items():
        out[key] = _catalogue_query(qkey, spec, **params)
    out["orbiting_bodies"] = _with_tables(cat.orbiting_bodies, None)
    return out


# Keys beside the catalogue's own: objects without a row on the right side of q01's outer join (most objects pass
# in no one month), and names grouped under a collation.
MONTH = (dt.date(1998, 1, 1), dt.date(1998, 1, 31))


def _in_month(count_approaches: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a, ca = bind(spark, sf_dir)
        return cat.q01_approach_count(a, ca.where(F.col("close_approach_date").between(*MONTH)), count_approaches=count_approaches)

    return run


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, ca = bind(spark, sf_dir)
    return cat.q01_approach_count(cat.fold_names(a), ca)


EXTRA_KEYS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q01_in_month": _in_month(False),
    "q01b_in_month": _in_month(True),
    "q01_folded_names": _folded,
}
_MONTH_JOIN = (
    "FROM asteroids a LEFT JOIN (SELECT * FROM close_approach WHERE close_approach_date "
    f"BETWEEN DATE '{MONTH[0]}' AND DATE '{MONTH[1]}') c ON a.id = c.neo_reference_id GROUP BY a.name"
)
EXTRA_ORACLES: dict[str, str] = {
    "q01_in_month": oracle.with_binding(f"SELECT a.name AS asteroid_name, COUNT(a.id) AS number_of_approaches {_MONTH_JOIN}"),
    "q01b_in_month": oracle.with_binding(
        f"SELECT a.name AS asteroid_name, COUNT(c.neo_reference_id) AS number_of_approaches {_MONTH_JOIN}"
    ),
    "q01_folded_names": oracle.with_binding(
        "SELECT MIN(a.name) AS asteroid_name, COUNT(a.id) AS number_of_approaches "
        "FROM asteroids a LEFT JOIN close_approach c ON a.id = c.neo_reference_id GROUP BY lower(a.name)"
    ),
}


def catalogue_oracles() -> dict[str, str]:
    out = dict(oracle.catalogue_sql(None, year=QUERY_YEAR))
    for key, spec in SINGLE_FILTERS.items():
        out[key] = oracle.details_sql(spec)
    out["filter_all"] = oracle.details_sql(ALL_FILTERS)
    out["filter_summary"] = oracle.summary_sql(ALL_FILTERS)
    out["filtered_details"] = oracle.details_sql(DASHBOARD_FILTERS)
    for key, (qkey, spec, _params) in FILTERED_QUERIES.items():
        out[key] = oracle.catalogue_sql(spec, year=QUERY_YEAR)[qkey]
    out["orbiting_bodies"] = oracle.bodies_sql()
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**catalogue_queries(), **INGEST_KEYS, **EXTRA_KEYS}


def oracle_sql() -> dict[str, str]:
    return {**catalogue_oracles(), **INGEST_ORACLES, **EXTRA_ORACLES}
