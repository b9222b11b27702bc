"""Operator 3, sharding: a keyed permutation of global row numbers gives shard and slot.

Rows get gapless global numbers, a Feistel network permutes the numbers, and the permuted
number ``p`` says shard ``p % shards`` and slot ``p / shards``: counts differ by at most one
(law ``rows``), slots have no gaps, and anyone who knows the row number, the row count and the
seed computes both without the table.

* Row numbers come from two short steps, never from one task: rows fall into hash buckets
  (4096 by default), a window numbers them inside a bucket, and the buckets' running sum (one
  row per bucket) gives the offsets.  Equal rows are counted before the shuffle and unfolded
  after numbering, so a row repeated a billion times is one row in the window.
* The network works on Z_a x Z_b with ``a = ceil(sqrt(n))`` and ``b = ceil(n / a)``; a number
  outside ``0..n-1`` is permuted again (cycle walking).  Fewer than ``a`` of ``a * b`` numbers
  lie outside, so a walk beyond 32 steps is impossible for n <= 1024 and has a probability
  under 32 ** -32 above; it would raise, never lose a row.

Null doc_id is a value like any other; a null text has size 1 and crc32 0; repeated rows each
get a slot; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee.llm.common import text_or_empty

ROUNDS = 8
WALK = 32


def round_value(seed: str, key: Column, half: Column) -> Column:
    """60 bits of md5(seed | round | half): reproducible outside Spark."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), key.cast("string"), half.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def feistel(x: Column, a: Column, b: Column, seed: str, rounds: int = ROUNDS) -> Column:
    """One pass of the alternating network over Z_a x Z_b: a bijection of 0..a*b-1."""
    start = F.struct((x % a).alias("l"), F.floor(x / a).cast("bigint").alias("r"))

    def step(s: Column, i: Column) -> Column:
        left, right = s.getField("l"), s.getField("r")
        return F.when(
            i % 2 == 0,
            F.struct(F.pmod(left + round_value(seed, i, right), a).alias("l"), right.alias("r")),
        ).otherwise(F.struct(left.alias("l"), F.pmod(right + round_value(seed, i, left), b).alias("r")))

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, lambda s: s.getField("l") + s.getField("r") * a
    )


def permuted(number: Column, n: Column, a: Column, b: Column, seed: str) -> Column:
    """Place of a row number in the shuffled order of 0..n-1."""
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        feistel(number, a, b, seed),
        lambda p, _: F.when(p < n, p).otherwise(feistel(p, a, b, seed)),
    )
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("bigint"))


def row_numbers(rows: DataFrame, keys: list[str], buckets: int = 4096) -> DataFrame:
    """``rows[keys]`` with ``row_no`` (0..n-1, the same for any file layout) and ``n_rows``."""
    digest = F.md5(F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"}))
    grouped = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    placed = grouped.withColumn(
        "bucket", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets).cast("int")
    )
    names = ", ".join(f"`{k}`" for k in keys)
    placed = placed.withColumn(
        "ahead",
        F.expr(f"sum(copies) OVER (PARTITION BY bucket ORDER BY {names} ROWS UNBOUNDED PRECEDING)") - F.col("copies"),
    )
    offsets = (
        grouped.select(
            (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets).cast("int").alias("bucket"), "copies"
        )
        .groupBy("bucket")
        .agg(F.sum("copies").alias("in_bucket"))
        # one row per bucket: at most ``buckets`` rows in this window and in the broadcast
        .selectExpr(
            "bucket",
            "sum(in_bucket) OVER (ORDER BY bucket ROWS UNBOUNDED PRECEDING) - in_bucket AS before",
            "sum(in_bucket) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n_rows",
        )
    )
    return placed.join(F.broadcast(offsets), "bucket").select(
        *keys,
        "n_rows",
        F.explode(F.sequence(F.col("before") + F.col("ahead"), F.col("before") + F.col("ahead") + F.col("copies") - 1)).alias("row_no"),
    )


def shard_rows(rows: DataFrame, keys: list[str], shards: int, seed: str = "0", buckets: int = 4096) -> DataFrame:
    """One row per input row: ``keys``, row_no, shard, slot (law ``rows``)."""
    n = F.col("n_rows")
    a = F.ceil(F.sqrt(n.cast("double"))).cast("bigint")
    numbered = row_numbers(rows, keys, buckets).withColumn("a", a)
    numbered = numbered.withColumn("b", F.ceil(n / F.col("a")).cast("bigint"))
    return numbered.withColumn("place", permuted(F.col("row_no"), n, F.col("a"), F.col("b"), seed)).select(
        *keys,
        "row_no",
        (F.col("place") % shards).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("bigint").alias("slot"),
    )


def shard_documents(docs: DataFrame, shards: int = 8, seed: str = "0", buckets: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_no of every document."""
    text = text_or_empty(F.col("text"))
    ident = docs.select(
        "doc_id",
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    return shard_rows(ident, ["doc_id", "size", "text_crc32"], shards, seed, buckets).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row_no",
    )
