"""Operator 8, quality rules: thresholds from mergeable quantile sketches per language and source.

Every document gets counts over its whole text; four ratios and the word length are compared
with limits that follow the document's own (lang, source) group.

Sketch: a ratio in parts per million, v, falls into the bucket (e, m) of its binary exponent and
its four next bits, an integer rule without logarithms (relative width 1/16).  A sketch is the
set of (bucket, count) rows: sketches merge by adding counts, in any order and with the same
result, are pre-aggregated before the shuffle and have at most some hundred rows per group, so a
group with a third of all rows costs no more than any other.  A quantile is the lower end of the
bucket in which the running count reaches its rank.

Limits: upper = Q75 + max(reach * (Q75 - Q25), Q75 / 8, margin), lower likewise.  The spread of the group
decides for ratios that documents have as a rule (capitals, word length); an eighth of the quartile, two
buckets, is what a sketch can tell, and keeps groups whose documents are all alike from rejecting their
next neighbour.  Of symbols, repeated lines and repeated words most documents have none, both quartiles are 0
or little more and no spread tells where an outlier begins: there ``margin`` (a parameter for each ratio) does.
A group with fewer than ``min_group`` documents takes the limits of its language, then of all.
Documents that fail the base rule (under 50 words, or more than half of the words inside
repeated 3-word windows) don't enter the sketches.

The filter is a join of the documents with the limits, one row per group.  Null and empty texts
have no words and fail; null lang or source is a group of its own; repeated rows are judged each;
an empty table gives an empty result; extra columns pass through ``keep_clean`` untouched.
Windows are compared by 64-bit hashes (a false repeat needs a hash collision inside one text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee.llm.common import UPPER, let, small_side, text_or_empty, window_hashes, words, written

# Least distance of a limit from the quartile, in parts per million; 0 where the spread decides.
MARGINS = {
    "symbols": 200_000,
    "dup_lines": 400_000,
    "repeats": 350_000,
    "capitals": 0,
    "word_length": 0,
}
REACH = 5
MIN_GROUP = 100
SYMBOLS = "#*$%&|<>"


def repeated_words(w: Column) -> Column:
    """Number of words inside 3-word windows that occur twice or more in the text.

    Texts without a repeated window stop after one distinct count; the others sort
    (hash, position) pairs, keep windows equal to a neighbour and measure the union of
    their spans.
    """

    def spans(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(
            pairs,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(
                        F.transform(
                            s,
                            lambda x, k: F.struct(
                                x.getField("i").alias("i"),
                                (
                                    F.coalesce(F.get(s, k - 1).getField("h") == x.getField("h"), F.lit(False))
                                    | F.coalesce(F.get(s, k + 1).getField("h") == x.getField("h"), F.lit(False))
                                ).alias("twice"),
                            ),
                        ),
                        lambda x: x.getField("twice"),
                    ),
                    lambda x: x.getField("i"),
                )
            ),
        )

    def covered(h: Column) -> Column:
        return let(
            spans(h),
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
                F.lit(0).cast("bigint"),
                lambda acc, x: acc + x,
            ),
        )

    return let(
        window_hashes(w, 3),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)),
    )


def base_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` plus the counts of the whole text and ``base_failed``."""
    text = text_or_empty(F.col("text"))
    lines = F.filter(F.split(F.col("__t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = (
        docs.select(*keep, text.alias("__t"), words(F.col("text")).alias("__w"))
        .withColumn(
            "__c",
            let(
                F.struct(F.col("__w").alias("w"), lines.alias("l"), F.col("__t").alias("t")),
                lambda x: F.struct(
                    F.size(x.getField("w")).cast("bigint").alias("n_words"),
                    F.length(F.array_join(x.getField("w"), "")).cast("bigint").alias("word_chars"),
                    (F.length(x.getField("t")) - F.length(F.translate(x.getField("t"), SYMBOLS, "")))
                    .cast("bigint")
                    .alias("n_symbols"),
                    (F.size(x.getField("l")) - F.size(F.array_distinct(x.getField("l"))))
                    .cast("bigint")
                    .alias("n_dup_lines"),
                    repeated_words(x.getField("w")).alias("n_repeat_words"),
                    F.size(x.getField("l")).cast("bigint").alias("n_lines"),
                    (F.length(x.getField("t")) - F.length(F.translate(x.getField("t"), UPPER, "")))
                    .cast("bigint")
                    .alias("n_capitals"),
                ),
            ),
        )
        .select(*keep, "__c.*")
    )
    return counted.withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )


def _ratios() -> dict[str, Column]:
    ppm = lambda a, b: F.floor(F.lit(1_000_000) * a / F.greatest(b, F.lit(1))).cast("bigint")
    c = F.col
    return {
        "symbols": ppm(c("n_symbols"), c("n_words")),
        "dup_lines": ppm(c("n_dup_lines"), c("n_lines")),
        "repeats": ppm(c("n_repeat_words"), c("n_words")),
        "capitals": ppm(c("n_capitals"), c("word_chars")),
        "word_length": ppm(c("word_chars"), c("n_words")),
    }


def bucket(v: Column) -> Column:
    """Lower end of the sketch bucket of a non-negative integer: its five leading bits."""
    drop = F.greatest(F.length(F.bin(v)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n): the mergeable sketch rows of the documents past the base rule."""
    ratios = _ratios()
    stacked = F.explode(
        F.array(*[F.struct(F.lit(k).alias("ratio"), bucket(v).alias("bucket")) for k, v in ratios.items()])
    )
    return (
        counts.where(~F.col("base_failed"))
        .select("lang", "source", stacked.alias("s"))
        .groupBy("lang", "source", "s.ratio", "s.bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def limits(sketch: DataFrame, margins: dict[str, int] = MARGINS, reach: int = REACH) -> DataFrame:
    """Per (lang, source), per lang and overall: ``docs`` and the limits of every ratio.

    Rolled-up sketches are sums of the finer ones.  One row per group and level (``level`` 0
    group, 1 language, 2 all).
    """
    levels = F.array(
        F.struct(F.lit(0).alias("level"), "lang", "source"),
        F.struct(F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source")),
        F.struct(F.lit(2).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source")),
    )
    merged = (
        sketch.select(F.explode(levels).alias("g"), "ratio", "bucket", "n")
        .groupBy("g.level", "g.lang", "g.source", "ratio", "bucket")
        .agg(F.sum("n").alias("n"))
    )
    by = "PARTITION BY level, lang, source, ratio"
    ranked = merged.selectExpr(
        "*",
        f"sum(n) OVER ({by} ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto",
        f"sum(n) OVER ({by}) AS docs",
    )
    quart = ranked.groupBy("level", "lang", "source", "ratio").agg(
        F.max("docs").alias("docs"),
        F.min(F.when(4 * F.col("upto") >= F.col("docs"), F.col("bucket"))).alias("q25"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("docs"), F.col("bucket"))).alias("q75"),
    )
    margin = F.create_map(*[F.lit(x) for k, v in margins.items() for x in (k, v)])[F.col("ratio")]
    span = F.greatest(reach * (F.col("q75") - F.col("q25")), F.shiftright("q75", 3), margin)
    return (
        quart.withColumn("low", F.col("q25") - span)
        .withColumn("high", F.col("q75") + span)
        .groupBy("level", "lang", "source")
        .pivot("ratio", list(margins))
        .agg(F.max("low").alias("low"), F.max("high").alias("high"), F.max("docs").alias("docs"))
        .withColumn("docs", F.greatest(*[F.col(f"{k}_docs") for k in margins]))
        .drop(*[f"{k}_docs" for k in margins])
    )


def group_limits(sketch: DataFrame, min_group: int = MIN_GROUP, margins: dict[str, int] = MARGINS) -> DataFrame:
    """One row per (lang, source): the limits of the finest level with ``min_group`` documents."""
    lim = limits(sketch, margins)
    names = [f"{k}_{end}" for k in margins for end in ("low", "high")]

    def level(k: int, least: int) -> DataFrame:
        enough = F.when(F.col("docs") >= least, F.struct(*names))
        return lim.where(F.col("level") == k).select("lang", "source", enough.alias(f"lim{k}"))

    lang = level(1, min_group).select(F.col("lang").alias("__lang1"), "lim1")
    whole = level(2, 1).select(F.lit(1).alias("__one"), "lim2")  # a single row
    return (
        level(0, min_group)
        .join(lang, F.col("lang").eqNullSafe(F.col("__lang1")), "left")
        .withColumn("__one", F.lit(1))
        .join(F.broadcast(whole), "__one", "left")
        .select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), F.coalesce("lim0", "lim1", "lim2").alias("__lim"))
    )


def judge(
    counts: DataFrame, min_group: int = MIN_GROUP, margins: dict[str, int] = MARGINS
) -> DataFrame:
    """``counts`` with ``kept``: false if base_failed, else whether all ratios are inside the limits."""
    lim = small_side(group_limits(sketches(counts), min_group, margins))  # one row per group: texts stay where they are
    joined = counts.join(
        lim,
        F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")),
        "left",
    )
    inside = F.lit(True)
    for k, v in _ratios().items():
        inside &= (v >= F.col(f"__lim.{k}_low")) & (v <= F.col(f"__lim.{k}_high"))
    keep = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(inside, F.lit(False)))
    return joined.withColumn("kept", keep).select(*counts.columns, "kept")


def quality_report(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """The verdict of every document with its counts."""
    counts = written(base_counts(docs, ["doc_id", "lang", "source"]), "quality")  # read twice
    return judge(counts, min_group).drop("lang", "source", "n_lines", "n_capitals")


def keep_clean(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Documents that pass, all their columns unchanged."""
    own = [f"`{c}`" for c in docs.columns]
    carried = docs.select(
        F.struct(*own).alias("__row"), *[F.col(c) for c in ("text", "lang", "source")]
    )
    counts = written(base_counts(carried, ["__row", "lang", "source"]), "quality")  # read twice, texts are counted once
    return judge(counts, min_group).where("kept").select("__row.*")
