"""Shared helpers: tables, whole-text words and shingles as column expressions, written cuts.

All text rules of the operators are here: a word is a run of ``[^\\x20\\x09-\\x0D]`` and
lower-casing touches A-Z only, so that every engine splits a text alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.session import new_run_dir
from perigee.sources import store

SPACE = r"[\x20\x09-\x0D]+"
BROADCAST_BYTES = 16 << 20  # of Parquet: some five times as much in memory
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written_at(df: DataFrame, purpose: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back, with the folder: lineage ends at replicated files."""
    spark = df.sparkSession
    path = new_run_dir(spark, purpose)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, purpose: str) -> DataFrame:
    return written_at(df, purpose)[0]


def drop_written(spark: SparkSession, *paths: str) -> None:
    """Remove folders of ``written_at`` that nothing reads any more."""
    for path in paths:
        store.remove(spark, path)


def packed(docs: DataFrame) -> DataFrame:
    """The whole rows in one column ``row``: no name of the user's can clash with those of an operator."""
    return docs.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("row"))


def small_side(df: DataFrame) -> DataFrame:
    """``df``, written, with a broadcast hint if its files have at most ``BROADCAST_BYTES``;
    beyond that the join with it is shuffled."""
    df, path = written_at(df, "side")
    return F.broadcast(df) if store.n_bytes(df.sparkSession, path) <= BROADCAST_BYTES else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Words of the whole text, in order; null and blank texts have none."""
    return F.array_remove(F.split(text_or_empty(text), SPACE), "")


def window_hashes(w: Column, width: int) -> Column:
    """64-bit hash of each window of ``width`` words of the array ``w``, by position."""
    return let(
        w,
        lambda a: F.when(
            F.size(a) >= width,
            F.transform(
                F.sequence(F.lit(0), F.size(a) - width),
                lambda i: F.xxhash64(*[F.get(a, i + k) for k in range(width)]),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )


def shingles(w: Column, width: int) -> Column:
    """Window hashes by position; with fewer words the whole sequence is one; none without words."""
    return let(
        w,
        lambda a: F.when(F.size(a) == 0, F.array().cast("array<bigint>"))
        .when(F.size(a) < width, F.array(F.xxhash64(a)))
        .otherwise(window_hashes(a, width)),
    )
