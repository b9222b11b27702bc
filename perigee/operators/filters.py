"""The eight dashboard filters as an immutable spec that yields predicate Columns.

Predicates are split by side: asteroid predicates reference only dimension columns,
approach predicates only fact columns.  Queries apply a side's predicate only when
they read that table, before grouping (SQL ``WHERE`` semantics), so Catalyst can
push each one into its own scan.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Range = tuple[float, float]

# The dashboard's slider limits and default date window start.
# A range equal to its limits means "not filtered" (the sentinel rule).
VELOCITY_LIMITS = (0.0, 200000.0)
MAGNITUDE_LIMITS = (0.0, 40.0)
DIAMETER_LIMITS = (0.0, 100.0)
AU_LIMITS = (0.0, 1.0)
DEFAULT_DATE_START = dt.date(2000, 1, 1)
HAZARD_CHOICES = ("All", "Yes", "No")


def _and(preds: list[Column]) -> Column | None:
    return reduce(lambda x, y: x & y, preds) if preds else None


@dataclass(frozen=True)
class FilterSpec:
    """All fields default to inactive.  Ranges are inclusive ``(lo, hi)``."""

    name: str = ""
    hazardous: bool | None = None
    velocity: Range | None = None
    date: tuple[dt.date, dt.date] | None = None
    magnitude: Range | None = None
    diameter: Range | None = None
    au: Range | None = None
    bodies: tuple[str, ...] = ()

    # -- construction -------------------------------------------------------
    @classmethod
    def from_dashboard(
        cls,
        *,
        as_of: dt.date,
        name: str = "",
        hazardous: str = "All",
        velocity: Range = VELOCITY_LIMITS,
        date_range: tuple[dt.date | None, dt.date | None] | None = None,
        magnitude: Range = MAGNITUDE_LIMITS,
        diameter: Range = DIAMETER_LIMITS,
        au: Range = AU_LIMITS,
        bodies: tuple[str, ...] | list[str] = (),
    ) -> "FilterSpec":
        """Widget values -> spec with the dashboard's activation rules.

        A range is active when its low end is above the lower limit or its high end is
        below the upper limit; the date window defaults to (2000-01-01, as_of) and is
        ignored when incomplete or inverted.  ``as_of`` replaces the wall clock.
        """
        if hazardous not in HAZARD_CHOICES:
            raise ValueError(f"hazardous must be one of {HAZARD_CHOICES}")

        def active(r: Range, limits: Range) -> Range | None:
            return (float(r[0]), float(r[1])) if (r[0] > limits[0] or r[1] < limits[1]) else None

        start, end = date_range if date_range is not None else (DEFAULT_DATE_START, as_of)
        window = (start, end) if (start and end and start <= end) else None
        return cls(
            name=name or "",
            hazardous=None if hazardous == "All" else hazardous == "Yes",
            velocity=active(velocity, VELOCITY_LIMITS),
            date=window,
            magnitude=active(magnitude, MAGNITUDE_LIMITS),
            diameter=active(diameter, DIAMETER_LIMITS),
            au=active(au, AU_LIMITS),
            bodies=tuple(bodies),
        )

    # -- predicates ---------------------------------------------------------
    def asteroid_predicate(self) -> Column | None:
        preds = []
        if self.name:
            # Partial, case-insensitive match; % and _ in the text keep their LIKE meaning.
            # A backslash is a letter like any other (it would escape the next one).
            text = self.name.replace("\\", "\\\\")
            preds.append(F.col("name").ilike(f"%{text}%"))
        if self.hazardous is not None:
            preds.append(F.col("is_potentially_hazardous_asteroid") == F.lit(bool(self.hazardous)))
        if self.magnitude is not None:
            preds.append(F.col("absolute_magnitude_h").between(*self.magnitude))
        if self.diameter is not None:
            preds.append(F.col("estimated_diameter_min_km").between(*self.diameter))
        return _and(preds)

    def approach_predicate(self) -> Column | None:
        preds = []
        if self.velocity is not None:
            preds.append(F.col("relative_velocity_kmph").between(*self.velocity))
        if self.date is not None and self.date[0] <= self.date[1]:
            preds.append(F.col("close_approach_date").between(F.lit(self.date[0]), F.lit(self.date[1])))
        if self.au is not None:
            preds.append(F.col("astronomical").between(*self.au))
        if self.bodies:
            preds.append(F.col("orbiting_body").isin(list(self.bodies)))
        return _and(preds)

    @property
    def filters_asteroids(self) -> bool:
        return self.asteroid_predicate() is not None

    @property
    def filters_approaches(self) -> bool:
        return self.approach_predicate() is not None


NO_FILTERS = FilterSpec()


def filter_asteroids(asteroids: DataFrame, spec: FilterSpec | None) -> DataFrame:
    pred = (spec or NO_FILTERS).asteroid_predicate()
    return asteroids if pred is None else asteroids.where(pred)


# Partition column of the stored approach table (first day of the approach's month).
MONTH_PARTITION = "approach_month"


def month_range(approaches: DataFrame, lo: dt.date, hi: dt.date) -> Column | None:
    """Predicate on the month partition column implied by a date range, when the frame
    carries that column: lets the scan prune whole month directories."""
    if MONTH_PARTITION not in approaches.columns:
        return None
    return F.col(MONTH_PARTITION).between(F.trunc(F.lit(lo), "MM"), F.trunc(F.lit(hi), "MM"))


def filter_approaches(approaches: DataFrame, spec: FilterSpec | None) -> DataFrame:
    spec = spec or NO_FILTERS
    pred = spec.approach_predicate()
    if pred is None:
        return approaches
    if spec.date is not None and spec.date[0] <= spec.date[1]:
        months = month_range(approaches, *spec.date)
        pred = pred if months is None else pred & months
    return approaches.where(pred)
