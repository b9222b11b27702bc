"""Hand-made asteroid and approach rows (all values invented), per FIXTURES.md §3-4."""

from __future__ import annotations

import datetime as dt

import duckdb
import pandas as pd

from perigee.schemas import ASTEROIDS_SCHEMA, CLOSE_APPROACH_SCHEMA

D = dt.date
KM = 149597870.7
LD = 389.17

ASTEROIDS = [
    # id, name, magnitude, diameter min, diameter max, hazardous
    (1, "6 Alpha", 18.0, 0.10, 0.25, True),
    (2, "6 Alpha", 18.0, 0.12, 0.25, False),
    (3, "Beta 50%", 15.5, 0.50, 1.20, True),
    (4, "gamma_x", 15.5, 0.30, 1.20, None),
    (5, "GAMMA_X", 22.0, None, None, False),
    (6, "Delta", None, 0.01, 0.02, False),
    (7, "Lonely", 25.0, 0.02, 0.05, True),
    (8, "Riser", 20.0, 0.20, 0.40, False),
    (9, "Faller", 21.0, 0.20, 0.40, True),
    (10, "Flat", 19.0, 0.20, 0.40, False),
    (11, "Single", 19.5, 0.20, 0.40, True),
    (12, "SameDay", 23.0, 0.20, 0.40, False),
    (13, None, 24.0, 0.30, 0.60, False),
]


def _ap(i, day, v, au, body, lunar=None):
    km = None if au is None else au * KM
    ld = lunar if lunar is not None else (None if au is None else au * LD)
    return (i, day, v, au, km, ld, body)


APPROACHES = [
    _ap(1, D(2030, 1, 1), 50000.0, 0.30, "Earth"),
    _ap(1, D(2030, 2, 1), 20000.0, 0.05, "Earth", lunar=1.0),
    _ap(2, D(2030, 1, 15), 19999.99, 0.20, "Venus"),
    _ap(2, D(2030, 12, 31), 50000.01, 0.001, "Venus"),
    _ap(3, D(2030, 2, 28), 200000.0, 0.0500001, "Mars"),
    _ap(3, D(2030, 2, 28), 200000.5, 0.0009, "Earth"),
    _ap(4, D(2031, 1, 1), 30000.0, 0.0009, None),
    _ap(4, D(2031, 6, 30), None, 0.0009, "Earth"),
    _ap(5, D(2030, 5, 5), 45000.0, None, "Venus"),
    _ap(5, None, 60000.0, 0.4, "Mars"),
    _ap(6, D(2030, 6, 30), 20000.0, 0.0008, "Earth"),
    _ap(6, D(2030, 7, 1), 21000.0, 0.0025, "Earth", lunar=0.9999),
    _ap(8, D(2030, 1, 10), 25000.0, 0.1, "Earth"),
    _ap(8, D(2030, 2, 10), 25000.0, 0.2, "Earth"),
    _ap(8, D(2030, 3, 10), 25000.0, 0.3, "Earth"),
    _ap(9, D(2030, 1, 10), 26000.0, 0.3, "Earth"),
    _ap(9, D(2030, 2, 10), 26000.0, 0.2, "Earth"),
    _ap(9, D(2030, 3, 10), 26000.0, 0.1, "Earth"),
    _ap(10, D(2030, 1, 10), 27000.0, 0.2, "Mars"),
    _ap(10, D(2030, 2, 10), 27000.0, 0.2, "Mars"),
    _ap(11, D(2030, 4, 4), 28000.0, 0.15, "Venus"),
    _ap(12, D(2030, 6, 6), 29000.0, 0.1, "Earth"),
    _ap(12, D(2030, 6, 6), 29500.0, 0.4, "Earth"),
    _ap(13, D(2030, 10, 10), 10000.0, 0.5, "Mars"),
    _ap(13, D(2030, 11, 10), 10000.0, 0.45, "Mars"),
    _ap(99, D(2030, 8, 8), 70000.0, 0.01, "Earth"),
    _ap(None, D(2030, 9, 9), 80000.0, 0.02, "Earth"),
]


def frames(spark):
    return (
        spark.createDataFrame(ASTEROIDS, ASTEROIDS_SCHEMA),
        spark.createDataFrame(APPROACHES, CLOSE_APPROACH_SCHEMA),
    )


def duck_fixture(asteroids=ASTEROIDS, approaches=APPROACHES) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    a = pd.DataFrame(asteroids, columns=[f.name for f in ASTEROIDS_SCHEMA.fields], dtype=object)
    c = pd.DataFrame(approaches, columns=[f.name for f in CLOSE_APPROACH_SCHEMA.fields], dtype=object)
    con.register("_a", a)
    con.register("_c", c)
    con.execute(
        "CREATE TABLE asteroids AS SELECT CAST(id AS BIGINT) AS id, CAST(name AS VARCHAR) AS name, "
        "CAST(absolute_magnitude_h AS DOUBLE) AS absolute_magnitude_h, "
        "CAST(estimated_diameter_min_km AS DOUBLE) AS estimated_diameter_min_km, "
        "CAST(estimated_diameter_max_km AS DOUBLE) AS estimated_diameter_max_km, "
        "CAST(is_potentially_hazardous_asteroid AS BOOLEAN) AS is_potentially_hazardous_asteroid FROM _a"
    )
    con.execute(
        "CREATE TABLE close_approach AS SELECT CAST(neo_reference_id AS BIGINT) AS neo_reference_id, "
        "CAST(close_approach_date AS DATE) AS close_approach_date, "
        "CAST(relative_velocity_kmph AS DOUBLE) AS relative_velocity_kmph, "
        "CAST(astronomical AS DOUBLE) AS astronomical, CAST(miss_distance_km AS DOUBLE) AS miss_distance_km, "
        "CAST(miss_distance_lunar AS DOUBLE) AS miss_distance_lunar, "
        "CAST(orbiting_body AS VARCHAR) AS orbiting_body FROM _c"
    )
    return con


def rows(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]
