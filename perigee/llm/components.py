"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a partial-aggregated minimum per vertex and an equi-join, so a vertex with a third
of all edges is pre-aggregated and never gathered.  Lineage is cut by writing each round to the
shared folder, which then replaces the one before; the loop ends when a round changes nothing (number and checksum of the edges).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.llm.common import drop_written, written_at


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u > v).  Large star: larger neighbours of u point to u's least neighbour.
    Small star: smaller neighbours and u itself point to u's least neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) of every vertex of ``edges`` (u, v); component_id is the least vertex."""
    spark = edges.sparkSession
    current, path = written_at(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "cc"
    )
    mark = lambda df: df.select(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    before = mark(current)
    while before[0]:
        current, new_path = written_at(_star(_star(current, True), False), "cc")
        after = mark(current)
        drop_written(spark, path)
        path = new_path
        if after == before:
            break
        before = after
    if not before[0]:
        return spark.createDataFrame([], "id bigint, component_id bigint")
    stars = current.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return stars.unionByName(stars.select(F.col("component_id").alias("id"), "component_id").distinct())
