"""Relational database sink and source over Spark's JDBC data source.

The write is parallel (one connection and one transaction per partition, rows sent in
``batchsize`` groups), so it is not atomic as a whole: write to a staging table and
swap it in the database, or publish Parquet (``tables.publish``) when atomicity
matters.  The read splits a numeric or date column into ``num_partitions`` ranges,
and filters/projections placed on the result reach the database as SQL.

No database driver ships with this repository; pass the driver class and URL of the
target database.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from perigee.schemas import APPROACH_COLUMNS, ASTEROID_COLUMNS

# Column types for CREATE TABLE on the database side (portable SQL types).
CREATE_COLUMN_TYPES = {
    "asteroids": "id BIGINT, name VARCHAR(150), absolute_magnitude_h DOUBLE PRECISION, "
    "estimated_diameter_min_km DOUBLE PRECISION, estimated_diameter_max_km DOUBLE PRECISION, "
    "is_potentially_hazardous_asteroid BOOLEAN",
    "close_approach": "neo_reference_id BIGINT, close_approach_date DATE, relative_velocity_kmph DOUBLE PRECISION, "
    "astronomical DOUBLE PRECISION, miss_distance_km DOUBLE PRECISION, miss_distance_lunar DOUBLE PRECISION, "
    "orbiting_body VARCHAR(50)",
}
COLUMNS = {"asteroids": ASTEROID_COLUMNS, "close_approach": APPROACH_COLUMNS}


def write_table(
    df: DataFrame,
    url: str,
    table: str,
    properties: dict[str, str],
    mode: str = "append",
    batchsize: int = 10_000,
    num_partitions: int = 32,
    target: str | None = None,
) -> None:
    """Write one of the two tables (``table``) to the database table ``target`` (default: the same
    name; a schema-qualified or staging name otherwise).

    ``num_partitions`` caps concurrent connections; the rows are dealt anew, so the stages before the
    write keep their own parallelism.
    """
    (
        df.select(*COLUMNS[table])
        .repartition(num_partitions)
        .write.mode(mode)
        .option("batchsize", batchsize)
        .option("createTableColumnTypes", CREATE_COLUMN_TYPES[table])
        .option("isolationLevel", "READ_COMMITTED")
        .jdbc(url, target or table, properties=properties)
    )


def read_table(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str],
    partition_column: str,
    lower_bound: int | str,
    upper_bound: int | str,
    num_partitions: int = 32,
    fetchsize: int = 10_000,
    source: str | None = None,
) -> DataFrame:
    """Parallel read of ``source`` (default: ``table``) split on ``partition_column`` (bounds only shape the split; every
    row is read)."""
    return (
        spark.read.option("fetchsize", fetchsize)
        .option("pushDownPredicate", True)
        .jdbc(
            url,
            source or table,
            column=partition_column,
            lowerBound=lower_bound,
            upperBound=upper_bound,
            numPartitions=num_partitions,
            properties=properties,
        )
        .select(*COLUMNS[table])
    )
