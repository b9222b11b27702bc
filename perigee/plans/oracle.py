"""Independent DuckDB SQL for every registered key (the correctness oracle).

Written as plain SQL over the driver's views, with the binding as CTEs.  Where the
Spark plan uses a rewrite (per-object pre-aggregation, the window form of the
"getting nearer" self-join, struct arg-min), the oracle uses the direct form.
"""

from __future__ import annotations

import datetime as dt
from functools import partial

from perigee.operators.filters import FilterSpec
from perigee.sources.binding import ORACLE_BINDING

A_COLS = (
    "a.id, a.name, a.absolute_magnitude_h, a.estimated_diameter_min_km, a.estimated_diameter_max_km, "
    "a.is_potentially_hazardous_asteroid"
)
C_COLS = (
    "c.close_approach_date, c.relative_velocity_kmph, c.astronomical, c.miss_distance_km, "
    "c.miss_distance_lunar, c.orbiting_body"
)
JOIN = "asteroids a JOIN close_approach c ON a.id = c.neo_reference_id"


def with_binding(body: str, extra_ctes: str = "", bound: bool = True) -> str:
    """Prefix the CTEs; ``bound=False`` runs over real ``asteroids`` / ``close_approach``
    tables (unit fixtures) instead of the binding of the test tables."""
    parts = ([ORACLE_BINDING] if bound else []) + ([extra_ctes] if extra_ctes else [])
    return f"WITH {', '.join(parts)}\n{body}" if parts else body


def unbound_catalogue_sql(spec: FilterSpec | None = None, year: int = 1998) -> dict[str, str]:
    """The catalogue oracle over tables named ``asteroids`` and ``close_approach``."""
    return catalogue_sql(spec, year, bound=False)


def _lit(v) -> str:
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, dt.date):
        return f"DATE '{v.isoformat()}'"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return f"{float(v)!r}e0" if "e" not in repr(float(v)) else repr(float(v))


def spec_where(spec: FilterSpec | None, a: str | None = "a", c: str | None = "c") -> list[str]:
    """SQL conjuncts of a FilterSpec for the tables a query reads (alias None = not read)."""
    if spec is None:
        return []
    out: list[str] = []
    if a is not None:
        if spec.name:
            out.append(f"{a}.name ILIKE {_lit('%' + spec.name + '%')}")
        if spec.hazardous is not None:
            out.append(f"{a}.is_potentially_hazardous_asteroid = {_lit(bool(spec.hazardous))}")
        if spec.magnitude is not None:
            out.append(f"{a}.absolute_magnitude_h BETWEEN {_lit(spec.magnitude[0])} AND {_lit(spec.magnitude[1])}")
        if spec.diameter is not None:
            out.append(
                f"{a}.estimated_diameter_min_km BETWEEN {_lit(spec.diameter[0])} AND {_lit(spec.diameter[1])}"
            )
    if c is not None:
        if spec.velocity is not None:
            out.append(f"{c}.relative_velocity_kmph BETWEEN {_lit(spec.velocity[0])} AND {_lit(spec.velocity[1])}")
        if spec.date is not None and spec.date[0] <= spec.date[1]:
            out.append(f"{c}.close_approach_date BETWEEN {_lit(spec.date[0])} AND {_lit(spec.date[1])}")
        if spec.au is not None:
            out.append(f"{c}.astronomical BETWEEN {_lit(spec.au[0])} AND {_lit(spec.au[1])}")
        if spec.bodies:
            out.append(f"{c}.orbiting_body IN ({', '.join(_lit(b) for b in spec.bodies)})")
    return out


def _where(*conds: str | list[str]) -> str:
    flat: list[str] = []
    for c in conds:
        flat.extend([c] if isinstance(c, str) else c)
    return ("WHERE " + " AND ".join(flat)) if flat else ""


# --------------------------------------------------------------------------- catalogue
def details_sql(spec: FilterSpec | None = None, bound: bool = True) -> str:
    return with_binding(f"SELECT {A_COLS}, {C_COLS} FROM {JOIN} {_where(spec_where(spec))}", bound=bound)


def catalogue_sql(spec: FilterSpec | None = None, year: int = 1998, bound: bool = True) -> dict[str, str]:
    wb = partial(with_binding, bound=bound)
    w = spec_where(spec)
    wa = spec_where(spec, c=None)
    wc = spec_where(spec, a=None, c="close_approach")
    month = "strftime(close_approach_date, '%Y-%m')"
    pair = (
        "asteroids a JOIN close_approach c1 ON a.id = c1.neo_reference_id "
        "JOIN close_approach c2 ON a.id = c2.neo_reference_id"
    )
    pair_where = _where(
        "c1.close_approach_date < c2.close_approach_date",
        "c1.astronomical > c2.astronomical",
        spec_where(spec, c="c1"),
        spec_where(spec, a=None, c="c2"),
    )
    return {
        "q00_details": details_sql(spec, bound),
        "q01_approach_count": wb(
            "SELECT a.name AS asteroid_name, COUNT(a.id) AS number_of_approaches "
            f"FROM asteroids a LEFT JOIN close_approach c ON a.id = c.neo_reference_id {_where(w)} GROUP BY a.name"
        ),
        "q01b_true_approach_count": wb(
            "SELECT a.name AS asteroid_name, COUNT(c.neo_reference_id) AS number_of_approaches "
            f"FROM asteroids a LEFT JOIN close_approach c ON a.id = c.neo_reference_id {_where(w)} GROUP BY a.name"
        ),
        "q02_avg_velocity": wb(
            "SELECT a.name AS asteroid_name, "
            "CAST(SUM(CAST(ROUND(c.relative_velocity_kmph * 100) AS BIGINT)) AS DOUBLE) "
            "/ COUNT(c.relative_velocity_kmph) / 100.0e0 AS average_velocity_kmph "
            f"FROM {JOIN} {_where(w)} GROUP BY a.name HAVING COUNT(a.id) > 1"
        ),
        "q03_top_fastest": wb(
            "SELECT a.name AS asteroid_name, MAX(c.relative_velocity_kmph) AS fastest_velocity_kmph, "
            f"c.close_approach_date FROM {JOIN} {_where(w)} GROUP BY a.name, c.close_approach_date "
            "ORDER BY fastest_velocity_kmph DESC NULLS LAST, asteroid_name ASC NULLS FIRST, "
            "c.close_approach_date ASC NULLS FIRST LIMIT 10"
        ),
        "q03b_top_fastest_objects": wb(
            "SELECT id AS asteroid_id, name AS asteroid_name, v AS fastest_velocity_kmph, d AS close_approach_date "
            "FROM ranked WHERE rn = 1 "
            "ORDER BY v DESC, name ASC NULLS FIRST, d ASC NULLS FIRST, id ASC LIMIT 10",
            "ranked AS (SELECT a.id, a.name, c.relative_velocity_kmph AS v, c.close_approach_date AS d, "
            "ROW_NUMBER() OVER (PARTITION BY a.id ORDER BY c.relative_velocity_kmph DESC, "
            f"c.close_approach_date ASC NULLS LAST) AS rn FROM {JOIN} "
            f"{_where('c.relative_velocity_kmph IS NOT NULL', w)})",
        ),
        "q04_hazardous_frequent": wb(
            "SELECT a.name AS asteroid_name, COUNT(a.id) AS number_of_approaches "
            f"FROM {JOIN} {_where('a.is_potentially_hazardous_asteroid = TRUE', w)} "
            "GROUP BY a.name HAVING COUNT(a.id) > 3"
        ),
        "q05_busiest_month": wb(
            f"SELECT {month} AS approach_month, COUNT(neo_reference_id) AS approaches_count "
            f"FROM close_approach {_where(wc)} GROUP BY approach_month "
            "ORDER BY approaches_count DESC, approach_month ASC NULLS FIRST LIMIT 1"
        ),
        "q06_fastest_ever": wb(
            "SELECT a.name AS asteroid_name, c.relative_velocity_kmph, c.close_approach_date "
            f"FROM {JOIN} {_where(w)} ORDER BY c.relative_velocity_kmph DESC NULLS LAST, "
            "a.name ASC NULLS FIRST, c.close_approach_date ASC NULLS FIRST LIMIT 1"
        ),
        "q07_by_diameter": wb(
            f"SELECT a.name AS asteroid_name, a.estimated_diameter_max_km FROM asteroids a {_where(wa)}"
        ),
        "q08_getting_nearer": wb(
            f"SELECT a.name AS asteroid_name FROM {pair} {pair_where} "
            "GROUP BY a.name HAVING COUNT(DISTINCT c1.neo_reference_id) > 1"
        ),
        "q08b_getting_nearer_objects": wb(
            f"SELECT DISTINCT a.id AS asteroid_id, a.name AS asteroid_name FROM {pair} {pair_where}"
        ),
        "q09_closest_approach": wb(
            "SELECT n.name AS asteroid_name, r.au AS closest_astronomical_distance, r.d AS closest_approach_date "
            "FROM n LEFT JOIN r ON n.name IS NOT DISTINCT FROM r.name AND r.rn = 1",
            f"j AS (SELECT a.name, c.astronomical AS au, c.close_approach_date AS d FROM {JOIN} {_where(w)}), "
            "n AS (SELECT DISTINCT name FROM j), "
            "r AS (SELECT name, au, d, ROW_NUMBER() OVER (PARTITION BY name ORDER BY au, d) AS rn "
            "FROM j WHERE au IS NOT NULL AND d IS NOT NULL)",
        ),
        "q10_fast_approaches": wb(
            "SELECT DISTINCT a.name AS asteroid_name, c.relative_velocity_kmph, c.close_approach_date "
            f"FROM {JOIN} {_where('c.relative_velocity_kmph > 50000', w)}"
        ),
        "q11_monthly_counts": wb(
            f"SELECT {month} AS approach_month, COUNT(neo_reference_id) AS approaches_count "
            f"FROM close_approach {_where(wc)} GROUP BY approach_month"
        ),
        "q12_brightest": wb(
            "SELECT a.name AS asteroid_name, a.absolute_magnitude_h FROM asteroids a "
            f"{_where(wa)} ORDER BY a.absolute_magnitude_h ASC NULLS FIRST, a.id ASC LIMIT 1"
        ),
        "q13_hazard_split": wb(
            "SELECT CASE WHEN a.is_potentially_hazardous_asteroid = TRUE THEN 'Hazardous' "
            "ELSE 'Non-Hazardous' END AS hazard_status, COUNT(a.id) AS asteroid_count "
            f"FROM asteroids a {_where(wa)} GROUP BY hazard_status"
        ),
        "q14_within_lunar": wb(
            "SELECT a.name AS asteroid_name, c.close_approach_date, "
            "c.miss_distance_lunar AS miss_distance_lunar_distances, c.astronomical AS astronomical_units_distance "
            f"FROM {JOIN} {_where('c.miss_distance_lunar < 1', w)}"
        ),
        "q15_within_au": wb(
            "SELECT DISTINCT a.name AS asteroid_name, c.close_approach_date, c.astronomical "
            f"FROM {JOIN} {_where('c.astronomical <= 0.05e0', w)}"
        ),
        "q16_name_prefix": wb(
            "SELECT a.name AS asteroid_name, a.is_potentially_hazardous_asteroid FROM asteroids a "
            + _where("a.name LIKE '6%'", wa)
        ),
        "q17_unique_in_year": wb(
            "SELECT COUNT(DISTINCT a.id) AS unique_asteroids_in_year "
            f"FROM {JOIN} {_where(f'YEAR(c.close_approach_date) = {year}', w)}"
        ),
        "q18_safe_but_close": wb(
            "SELECT DISTINCT a.name AS asteroid_name, c.close_approach_date, c.astronomical AS astronomical_distance, "
            "a.is_potentially_hazardous_asteroid "
            f"FROM {JOIN} {_where('a.is_potentially_hazardous_asteroid = FALSE', 'c.astronomical < 0.001e0', w)}"
        ),
        "q19_first_last": wb(
            "SELECT a.name AS asteroid_name, MIN(c.close_approach_date) AS earliest_approach_date, "
            "MAX(c.close_approach_date) AS latest_approach_date, COUNT(c.neo_reference_id) AS total_approaches "
            f"FROM {JOIN} {_where(w)} GROUP BY a.name"
        ),
        "q20_velocity_bands": wb(
            "SELECT CASE WHEN relative_velocity_kmph < 20000 THEN 'Slow (< 20,000 km/h)' "
            "WHEN relative_velocity_kmph >= 20000 AND relative_velocity_kmph <= 50000 "
            "THEN 'Medium (20,000-50,000 km/h)' ELSE 'Fast (> 50,000 km/h)' END AS velocity_range, "
            f"COUNT(neo_reference_id) AS number_of_approaches FROM close_approach {_where(wc)} "
            "GROUP BY velocity_range"
        ),
    }


def summary_sql(spec: FilterSpec | None, bound: bool = True) -> str:
    return with_binding(
        f"SELECT COUNT(DISTINCT a.id) AS unique_asteroids FROM {JOIN} {_where(spec_where(spec))}", bound=bound
    )


def bodies_sql() -> str:
    return with_binding(
        "SELECT DISTINCT orbiting_body FROM close_approach WHERE orbiting_body IS NOT NULL ORDER BY orbiting_body"
    )
