"""Explicit schemas: the feed page read schema and the two typed tables.

The feed is never schema-inferred: inference over the date-keyed map would turn
every day into its own column.
"""

from __future__ import annotations

from pyspark.sql import types as T

APPROACH_STRUCT = T.StructType(
    [
        T.StructField("close_approach_date", T.StringType()),
        T.StructField(
            "relative_velocity",
            T.StructType([T.StructField("kilometers_per_hour", T.StringType())]),
        ),
        T.StructField(
            "miss_distance",
            T.StructType(
                [
                    T.StructField("astronomical", T.StringType()),
                    T.StructField("lunar", T.StringType()),
                    T.StructField("kilometers", T.StringType()),
                ]
            ),
        ),
        T.StructField("orbiting_body", T.StringType()),
    ]
)

OBJECT_STRUCT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("neo_reference_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("absolute_magnitude_h", T.DoubleType()),
        T.StructField(
            "estimated_diameter",
            T.StructType(
                [
                    T.StructField(
                        "kilometers",
                        T.StructType(
                            [
                                T.StructField("estimated_diameter_min", T.DoubleType()),
                                T.StructField("estimated_diameter_max", T.DoubleType()),
                            ]
                        ),
                    )
                ]
            ),
        ),
        T.StructField("is_potentially_hazardous_asteroid", T.BooleanType()),
        T.StructField("close_approach_data", T.ArrayType(APPROACH_STRUCT)),
    ]
)

FEED_SCHEMA = T.StructType(
    [
        T.StructField(
            "links", T.StructType([T.StructField("self", T.StringType()), T.StructField("next", T.StringType())])
        ),
        T.StructField("near_earth_objects", T.MapType(T.StringType(), T.ArrayType(OBJECT_STRUCT))),
    ]
)

ASTEROIDS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("absolute_magnitude_h", T.DoubleType()),
        T.StructField("estimated_diameter_min_km", T.DoubleType()),
        T.StructField("estimated_diameter_max_km", T.DoubleType()),
        T.StructField("is_potentially_hazardous_asteroid", T.BooleanType()),
    ]
)

CLOSE_APPROACH_SCHEMA = T.StructType(
    [
        T.StructField("neo_reference_id", T.LongType()),
        T.StructField("close_approach_date", T.DateType()),
        T.StructField("relative_velocity_kmph", T.DoubleType()),
        T.StructField("astronomical", T.DoubleType()),
        T.StructField("miss_distance_km", T.DoubleType()),
        T.StructField("miss_distance_lunar", T.DoubleType()),
        T.StructField("orbiting_body", T.StringType()),
    ]
)

ASTEROID_COLUMNS = [f.name for f in ASTEROIDS_SCHEMA.fields]
APPROACH_COLUMNS = [f.name for f in CLOSE_APPROACH_SCHEMA.fields]

# One flat feed row: object fields followed by the fields of one approach.
FLAT_COLUMNS = [
    "id",
    "neo_reference_id",
    "name",
    "absolute_magnitude_h",
    "estimated_diameter_min_km",
    "estimated_diameter_max_km",
    "is_potentially_hazardous_asteroid",
    "close_approach_date",
    "relative_velocity_kmph",
    "astronomical",
    "miss_distance_km",
    "miss_distance_lunar",
    "orbiting_body",
]

# q00 output: the dimension columns then the fact columns without the join key.
DETAIL_COLUMNS = ASTEROID_COLUMNS + [c for c in APPROACH_COLUMNS if c != "neo_reference_id"]
