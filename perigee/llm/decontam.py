"""Operator 9, benchmark decontamination: SimHash of item-sized windows, exact check after it.

A document is contaminated by a benchmark item if some window of the item's size (in words,
lower-cased A-Z) has a weighted-shingle similarity of at least 0.8 to the item: sum of the
smaller over sum of the larger multiplicities of all five-word shingles of the two.

1. Starts: a window with m shingles is similar to an item with k only if at least
   0.8 * (m + k) / 1.8 of its shingles are shingles of the item.  Per document and item size, the
   positions that hold a shingle of any item of that size are counted in a sliding window, and
   every start that reaches this number is looked at, wherever the shingles stand in the item (no
   similar window is lost, also if sentences of the item are swapped).
2. Each such window, of the size of that item, gets a 64-bit SimHash of its shingles.  Windows of
   items with fewer than five words are hashed whole, at their own width.
3. Multi-index: a fingerprint is cut into ``RADIUS + 1`` blocks; two fingerprints within the
   radius agree on at least one block, so an equi-join on (size, block number, block) of windows
   and items yields every pair within the radius.
4. The exact similarity decides about each pair.

At similarity 0.8 the expected Hamming distance is 9.7 of 64 bits (deviation 2.9); the radius of
20 loses a pair at the very threshold with a probability under 0.0005, closer ones far less.

The items' shingles are broadcast only if their counted number is at most ``BROADCAST_ROWS``;
beyond it the same join is shuffled.  A text or item with fewer than five words is one shingle;
documents shorter than an item are one window.  Items or documents without words (null, empty,
blank) match nothing.  Repeated documents are judged each; ties between windows go to those that
line up a shingle with its place in the item, then to the least start; empty tables give empty results; other columns pass untouched (``drop_contaminated``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee.llm.common import (
    ascii_lower, drop_written, let, packed, shingles, small_side, text_or_empty, window_hashes, words, written, written_at,
)

WIDTH = 5
RADIUS = 20
SIMILARITY_PCT = 80
BROADCAST_ROWS = 200_000
STARTS = 512  # windows taken from a text at a time


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of an array of 64-bit shingle hashes; each occurrence counts once."""

    def bit(h: Column, b: Column) -> Column:
        return F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1).cast("bigint"))

    def voted(hs: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(63)),
            F.lit(0).cast("bigint"),
            lambda acc, b: F.when(
                2 * F.aggregate(hs, F.lit(0).cast("bigint"), lambda n, h: n + bit(h, b)) > F.size(hs),
                acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b)),
            ).otherwise(acc),
        )

    return let(hashes, voted)


def blocks(fp: Column, radius: int = RADIUS) -> Column:
    """(number, bits) of the ``radius + 1`` blocks of a fingerprint."""
    n = radius + 1
    ends = [64 * j // n for j in range(n + 1)]
    return F.array(
        *[
            F.struct(
                F.lit(j).alias("no"),
                F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("bigint")).alias("bits"),
            )
            for j, (lo, hi) in enumerate(zip(ends, ends[1:]))
        ]
    )


def common_weight(a: Column, b: Column) -> Column:
    """Sum over shingles of the smaller multiplicity in the arrays ``a`` and ``b``."""
    many = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(
        F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(many(a, x), many(b, x)))
    )


def item_table(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, size (words), sh (shingles by place), fp of every item with words."""
    w = words(ascii_lower(text_or_empty(F.col("text"))))
    return (
        benchmark.select("item_id", w.alias("w"))
        .select("item_id", F.size("w").alias("size"), shingles(F.col("w"), width).alias("sh"))
        .where(F.size("sh") > 0)
        .distinct()
        .withColumn("fp", simhash(F.col("sh")))
    )


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    radius: int = RADIUS,
    similarity_pct: int = SIMILARITY_PCT,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(doc_id, text_key, item_id, start, similarity): the best window per document and item."""
    items = written(item_table(benchmark, width), "decontam-items")
    places = items.select("size", F.least("size", F.lit(width)).alias("w"), F.posexplode("sh").alias("place", "h")).distinct()
    places = written(places, "decontam-places")
    asked = places.select("size", "w", "h").distinct()
    if asked.count() <= broadcast_rows:
        asked = F.broadcast(asked)
    low = words(ascii_lower(text_or_empty(F.col("text"))))
    docs = docs.select("doc_id", "text")
    # sizes of items that are one shingle of their own width: under ``width`` numbers
    short = [r[0] for r in items.where(F.col("size") < width).select("size").distinct().collect()]
    rows = None
    for w in [width, *short]:
        found = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.lit(w).alias("w"), window_hashes(low, w).alias("sh"))
        found = found.select("doc_id", "text_key", "w", F.size("sh").alias("total"), F.posexplode("sh").alias("pos", "h"))
        rows = found if rows is None else rows.unionByName(found)
    hits = (
        rows.join(asked, ["w", "h"])
        .groupBy("doc_id", "text_key", "size")
        .agg(F.max("total").alias("total"), F.array_sort(F.collect_set(F.struct("pos", "h"))).alias("hits"))
        .withColumn("k", F.greatest(F.col("size") - (width - 1), F.lit(1)))
        .withColumn("m", F.least("k", "total"))  # shingles of a window: the whole text if it is shorter
        .withColumn("need", F.ceil(similarity_pct * (F.col("m") + F.col("k")) / (100 + similarity_pct)).cast("int"))
        .where(F.size("hits") >= F.col("need"))
    )
    hits = written(hits, "decontam-hits")

    def held(j: Column) -> Column:
        """Starts of the windows that hold the ``need`` hits up to number ``j``."""
        first = F.greatest(F.lit(0), F.get("hits.pos", j) - F.col("m") + 1)
        last = F.least(F.get("hits.pos", j - F.col("need") + 1), F.col("total") - F.col("m"))
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    reached = F.array_distinct(F.flatten(F.transform(F.sequence(F.col("need") - 1, F.size("hits") - 1), held)))
    # some starts at a time: the windows of one row stay few
    part = F.sequence(F.lit(0), F.floor((F.size("reached") - 1) / STARTS).cast("int"))
    parts = F.transform(part, lambda i: F.slice("reached", i * STARTS + 1, F.lit(STARTS)))
    starts = (
        hits.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "size", reached.alias("reached"))
        .where(F.size("reached") > 0)
        .select("id", "key", "size", F.explode(parts).alias("starts"))
    )
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    spotted = keyed.join(small_side(starts), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")))
    windows = spotted.select(
        "doc_id",
        "text_key",
        "size",
        F.explode(
            let(
                F.struct(window_hashes(low, width).alias("sh"), low.alias("w"), F.col("starts"), F.col("size")),
                lambda x: F.transform(
                    x["starts"],
                    lambda s: F.struct(
                        s.alias("start"),
                        F.when(x["size"] < width, F.array(F.xxhash64(F.slice(x["w"], s + 1, x["size"]))))
                        .otherwise(F.slice(x["sh"], s + 1, x["size"] - (width - 1)))
                        .alias("sh"),
                    ),
                ),
            )
        ).alias("win"),
    ).select("doc_id", "text_key", "size", "win.*")
    windows, windows_path = written_at(windows.withColumn("win_key", F.xxhash64("sh")), "decontam-windows")
    # one fingerprint for each distinct window content, however many documents hold it
    contents = (
        windows.groupBy("size", "win_key").agg(F.first("sh").alias("sh")).withColumn("fp", simhash(F.col("sh")))
    )
    contents, contents_path = written_at(contents, "decontam-contents")
    # only keys and fingerprints meet in the blocks; the shingles come back to the pairs within the radius
    probes = contents.select("size", "win_key", "fp", F.explode(blocks(F.col("fp"), radius)).alias("b"))
    index = items.select("item_id", "size", F.col("fp").alias("item_fp"), F.explode(blocks(F.col("fp"), radius)).alias("ib"))
    near = (
        probes.select("size", "win_key", "fp", "b.no", "b.bits")
        .join(index.select("item_id", "size", "item_fp", "ib.no", "ib.bits"), ["size", "no", "bits"])
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
        .select("size", "win_key", "item_id")
        .distinct()
    )
    both = F.size("sh") + F.size("item_sh")
    verified = (
        near.join(contents.select("size", "win_key", "sh"), ["size", "win_key"])
        .join(items.select("item_id", "size", F.col("sh").alias("item_sh")), ["item_id", "size"])
        .withColumn("shared", common_weight(F.col("sh"), F.col("item_sh")))
        .where(100 * F.col("shared") >= similarity_pct * (both - F.col("shared")))
        .groupBy("size", "win_key", "item_id")  # an id may be held by several items
        .agg(F.max(F.col("shared") / (both - F.col("shared"))).alias("similarity"))
    )
    verified, verified_path = written_at(
        windows.select("doc_id", "text_key", "size", "start", "win_key").join(verified, ["size", "win_key"]).drop("win_key"),
        "decontam-verified",
    )
    # for the ties: starts that line up a shingle with its place in some item of the size
    fitted = (
        hits.join(verified.select("doc_id", "text_key", "size").distinct().withColumnsRenamed(_IDS), _same_text() & (F.col("size") == F.col("size2")), "left_semi")
        .select("doc_id", "text_key", "size", "total", "m", F.explode("hits").alias("hit"))
        .join(places.select(F.col("size").alias("size2"), "place", "h"), (F.col("size") == F.col("size2")) & (F.col("hit.h") == F.col("h")))
        .groupBy("doc_id", "text_key", "size")
        .agg(
            F.collect_set(
                F.greatest(F.lit(0), F.least(F.col("hit.pos") - F.col("place"), F.col("total") - F.col("m")))
            ).alias("fitted")
        )
        .withColumnsRenamed(_IDS)
    )
    lined = F.coalesce(F.array_contains("fitted", F.col("start")), F.lit(False))
    best = (
        verified.join(fitted, _same_text() & (F.col("size") == F.col("size2")), "left")
        .groupBy("doc_id", "text_key", "item_id")
        .agg(F.max(F.struct("similarity", lined.alias("lined"), (-F.col("start")).alias("s"))).alias("best"))
        .select("doc_id", "text_key", "item_id", (-F.col("best.s")).cast("bigint").alias("start"), "best.similarity")
    )
    out = written(best, "decontam-found")
    drop_written(docs.sparkSession, windows_path, contents_path, verified_path)
    return out


_IDS = {"doc_id": "id", "text_key": "key", "size": "size2"}


def _same_text() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start (first word of the best window), similarity."""
    return contaminated(docs, benchmark).select("doc_id", "item_id", "start", "similarity")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without any benchmark item, all columns unchanged."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct()
    own = F.col("row")["doc_id"].eqNullSafe(F.col("id")) & (F.xxhash64(F.col("row")["text"]) == F.col("key"))
    return packed(docs).join(bad, own, "left_anti").select("row.*")
