"""SQL access: the two tables and every catalogue query as session views.

Users who work in SQL keep doing so: ``spark.sql("SELECT * FROM q09_closest_approach
WHERE closest_astronomical_distance < 0.01")``.  The views are the same lazy plans as
the DataFrame functions, so Catalyst pushes such outer predicates down as far as
the query's semantics allow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from perigee.operators import catalogue as cat
from perigee.operators.filters import FilterSpec


def register_views(
    asteroids: DataFrame,
    approaches: DataFrame,
    filters: FilterSpec | None = None,
    prefix: str = "",
    params: dict[str, dict] | None = None,
) -> list[str]:
    """Create or replace temp views ``asteroids``, ``close_approach`` and one per query key."""
    names = [f"{prefix}asteroids", f"{prefix}close_approach"]
    asteroids.createOrReplaceTempView(names[0])
    approaches.createOrReplaceTempView(names[1])
    for key in cat.CATALOGUE:
        view = cat.filtered_query(key, asteroids, approaches, filters, **(params or {}).get(key, {}))
        view.createOrReplaceTempView(f"{prefix}{key}")
        names.append(f"{prefix}{key}")
    cat.filter_summary(asteroids, approaches, filters).createOrReplaceTempView(f"{prefix}filter_summary")
    cat.orbiting_bodies(asteroids, approaches, filters).createOrReplaceTempView(f"{prefix}orbiting_bodies")
    return names + [f"{prefix}filter_summary", f"{prefix}orbiting_bodies"]
