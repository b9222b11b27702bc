"""Keep one row per key, chosen by a total order, as an aggregation.

``groupBy(key).agg(min(struct(order, payload)))`` combines rows map-side before the
shuffle, so a key holding a third of all rows costs one buffer per task, not one task
holding the whole group (which ``row_number()`` over a window would need).  The
survivor is the same under any partitioning or retry, because the order is total.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Order = Sequence[tuple[str, str]]  # (column, "asc" | "desc"); NULLs always last

# Survivor of several approach rows for one (object, day): the nearest, then the fastest.
APPROACH_ORDER: Order = (
    ("astronomical", "asc"),
    ("relative_velocity_kmph", "desc"),
    ("orbiting_body", "asc"),
    ("miss_distance_km", "asc"),
    ("miss_distance_lunar", "asc"),
)
ASTEROID_ORDER: Order = (
    ("name", "asc"),
    ("absolute_magnitude_h", "asc"),
    ("estimated_diameter_min_km", "asc"),
    ("estimated_diameter_max_km", "asc"),
    ("is_potentially_hazardous_asteroid", "asc"),
)


def order_struct(order: Order) -> Column:
    """A struct whose natural ordering is the requested order with NULLs last."""
    fields = []
    for i, (name, direction) in enumerate(order):
        c = F.col(name)
        fields.append(c.isNull().alias(f"n{i}"))
        if direction == "asc":
            fields.append(c.alias(f"v{i}"))
        elif direction == "desc":
            fields.append((-c).alias(f"v{i}"))  # numeric columns only
        else:
            raise ValueError(direction)
    return F.struct(*fields)


def dedup_by_key(df: DataFrame, keys: Sequence[str], order: Order, count: str | None = None) -> DataFrame:
    """One row per ``keys``, columns in input order; ``order`` names every other column.  ``count`` adds a
    column of that name: the rows that became one.

    The order struct already holds all columns that are not keys, so the survivor is rebuilt from it
    and no second copy travels.  A NULL in a key is no value: rows with one are not de-duplicated
    against each other, only equal rows become one.
    """
    apart = F.when(_unknown(keys), order_struct(order)).alias("_apart")
    return _survivors(df, df.columns, keys, [apart], order, count)


SPREAD = "_spread"


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with a hash of the row where a key is NULL: such rows may be many, and are never one for their key."""
    return df.withColumn(SPREAD, F.when(_unknown(keys), F.xxhash64(*[F.col(c) for c in df.columns])))


def dedup_placed(placed: DataFrame, keys: Sequence[str], order: Order, count: str | None = None) -> DataFrame:
    """As ``dedup_by_key``, for rows with their ``spread`` that are partitioned by some of ``keys`` and by it.

    They are compared where they lie, by one sort and no exchange, and stay in the order of ``keys``.  For rows of which few
    share a key.
    """
    # what sets rows with a NULL in the key apart is text: Spark sorts anew by keys that hold numbers with a fraction
    exact = [F.col(n) + F.lit(0.0) if t in ("double", "float") else F.col(n) for n, t in placed.dtypes if n in dict(order)]
    apart = F.when(_unknown(keys), F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(exact)])))
    return _survivors(placed, [c for c in placed.columns if c != SPREAD], keys, [F.col(SPREAD), apart.alias("_apart")], order, count)


def _unknown(keys: Sequence[str]) -> Column:
    return F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))


def _survivors(df: DataFrame, columns: list[str], keys: Sequence[str], more: list[Column], order: Order, count: str | None) -> DataFrame:
    rest = [name for name, _ in order]
    if set(rest) | set(keys) != set(columns):
        raise ValueError("order must name every column that is not a key")
    counted = [F.count(F.lit(1)).alias(count)] if count else []
    best = df.groupBy(*keys, *more).agg(F.min(order_struct(order)).alias("_best"), *counted)
    sign = {name: (1 if direction == "asc" else -1) for name, direction in order}
    rebuilt = {
        name: F.col(f"_best.v{i}") if sign[name] == 1 else -F.col(f"_best.v{i}") for i, name in enumerate(rest)
    }
    out = [rebuilt[c].alias(c) if c in rebuilt else F.col(c) for c in columns]
    return best.select(*out, *([count] if count else []))
