"""Column expressions used by the catalogue.  All are built-in (JVM, codegen)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and formats that must read exactly as the dashboard shows them.
HAZARDOUS_LABEL = "Hazardous"
NON_HAZARDOUS_LABEL = "Non-Hazardous"
SLOW_LABEL = "Slow (< {lo} km/h)"
MEDIUM_LABEL = "Medium ({lo}-{hi} km/h)"
FAST_LABEL = "Fast (> {hi} km/h)"
DEFAULT_BAND_EDGES = (20000.0, 50000.0)
MONTH_FORMAT = "yyyy-MM"


def _kmh(x: float) -> str:
    return f"{x:,.0f}" if float(x).is_integer() else f"{x:,}"


def band_labels(lo: float, hi: float) -> tuple[str, str, str]:
    return (
        SLOW_LABEL.format(lo=_kmh(lo)),
        MEDIUM_LABEL.format(lo=_kmh(lo), hi=_kmh(hi)),
        FAST_LABEL.format(hi=_kmh(hi)),
    )


def velocity_band(v: Column, lo: float = DEFAULT_BAND_EDGES[0], hi: float = DEFAULT_BAND_EDGES[1]) -> Column:
    """Three bands; both ends of the middle band inclusive; NULL falls to the last band."""
    slow, medium, fast = band_labels(lo, hi)
    return F.when(v < F.lit(lo), slow).when((v >= F.lit(lo)) & (v <= F.lit(hi)), medium).otherwise(fast)


def hazard_label(flag: Column) -> Column:
    """TRUE -> Hazardous; FALSE and NULL -> Non-Hazardous."""
    return F.when(flag == F.lit(True), HAZARDOUS_LABEL).otherwise(NON_HAZARDOUS_LABEL)


def month_start(d: Column) -> Column:
    """Group key for monthly buckets: a date (cheap to hash), formatted after aggregation."""
    return F.trunc(d, "MM")


def month_text(d: Column) -> Column:
    return F.date_format(d, MONTH_FORMAT)


def in_year(d: Column, year: int) -> Column:
    """``year(d) = y`` written as a half-open date range so both bounds reach the scan."""
    return (d >= F.lit(dt.date(year, 1, 1))) & (d < F.lit(dt.date(year + 1, 1, 1)))


def closest_key(au: Column, day: Column) -> Column:
    """Ordering struct for arg-min by distance (date breaks ties); NULL when either is missing."""
    return F.when(au.isNotNull() & day.isNotNull(), F.struct(au.alias("au"), day.alias("day")))
