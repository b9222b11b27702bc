"""Bind the driver's test tables to the domain's two tables.

``part`` becomes ``asteroids`` and ``lineitem`` becomes ``close_approach``; the
expressions are narrow projections (no shuffle) and read only the columns they use,
so the scans carry a pruned ReadSchema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Unit conversions of the binding (1 AU in km, 1 AU in lunar distances)
# and the return-flag -> orbiting body map.
KM_PER_AU = 149597870.7
LD_PER_AU = 389.17
BODY_BY_FLAG = (("A", "Earth"), ("N", "Venus"))
OTHER_BODY = "Mars"
SHARED_NAME_MODULUS = 1000
RECORD_PARTS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, listed anew on every call."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def asteroids_from_part(part: DataFrame) -> DataFrame:
    """``part`` as the object table (one SQL-expression projection: cheap to plan)."""
    return part.selectExpr(
        "CAST(p_partkey AS BIGINT) AS id",
        f"concat(CAST(p_partkey % {SHARED_NAME_MODULUS} AS STRING), ' ', p_name) AS name",
        "10.0D + p_size * 0.4D AS absolute_magnitude_h",
        "p_size / 100.0D AS estimated_diameter_min_km",
        "p_size / 50.0D AS estimated_diameter_max_km",
        "p_type = 'PROMO' AS is_potentially_hazardous_asteroid",
    )


def _body_sql(flag: str) -> str:
    cases = " ".join(f"WHEN '{code}' THEN '{body}'" for code, body in BODY_BY_FLAG)
    return f"CASE {flag} {cases} ELSE '{OTHER_BODY}' END"


def approaches_from_lineitem(lineitem: DataFrame, keep_part: bool = False, keep_line: bool = False) -> DataFrame:
    """``lineitem`` as the approach table."""
    au = "l_quantity * l_discount / 10.0D"
    exprs = [
        "CAST(l_partkey AS BIGINT) AS neo_reference_id",
        "CAST(l_shipdate AS DATE) AS close_approach_date",
        "l_extendedprice AS relative_velocity_kmph",
        f"{au} AS astronomical",
        f"{au} * {KM_PER_AU}D AS miss_distance_km",
        f"{au} * {LD_PER_AU}D AS miss_distance_lunar",
        f"{_body_sql('l_returnflag')} AS orbiting_body",
    ]
    if keep_part:
        # splits the approaches of one object and day over four landed records; never part of the tables
        exprs.append(f"l_suppkey % {RECORD_PARTS} AS _part")
    if keep_line:
        exprs.append("l_linenumber AS _line")  # says what the soiled landing gets wrong
    return lineitem.selectExpr(*exprs)


def bind(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(asteroids, close_approach) over the whole test tables."""
    return (
        asteroids_from_part(table(spark, sf_dir, "part")),
        approaches_from_lineitem(table(spark, sf_dir, "lineitem")),
    )


# The same binding as DuckDB SQL, for the oracle (written independently of the above).
ORACLE_BINDING = f"""
asteroids AS (
  SELECT p_partkey AS id,
         CAST(p_partkey % {SHARED_NAME_MODULUS} AS VARCHAR) || ' ' || p_name AS name,
         10.0e0 + p_size * 0.4e0 AS absolute_magnitude_h,
         p_size / 100.0e0 AS estimated_diameter_min_km,
         p_size / 50.0e0 AS estimated_diameter_max_km,
         p_type = 'PROMO' AS is_potentially_hazardous_asteroid
  FROM part),
close_approach AS (
  SELECT l_partkey AS neo_reference_id,
         CAST(l_shipdate AS DATE) AS close_approach_date,
         l_extendedprice AS relative_velocity_kmph,
         l_quantity * l_discount / 10.0e0 AS astronomical,
         l_quantity * l_discount / 10.0e0 * {KM_PER_AU}e0 AS miss_distance_km,
         l_quantity * l_discount / 10.0e0 * {LD_PER_AU}e0 AS miss_distance_lunar,
         CASE l_returnflag WHEN 'A' THEN 'Earth' WHEN 'N' THEN 'Venus' ELSE 'Mars' END AS orbiting_body,
         l_suppkey % {RECORD_PARTS} AS _part,
         l_linenumber AS _line
  FROM lineitem)"""
