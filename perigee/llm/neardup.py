"""Operator 6, MinHash near-dedup: bottom-k sketches of one hash function.

A document's set is its distinct five-word shingles (lower-cased A-Z; fewer words: one shingle;
no words: empty, linked with nothing), held as 64-bit hashes of one function.

1. Class: documents with equal sets are one class (id: least doc_id); pre-aggregated, so a group
   of copies of any size is one row from here on.
2. Sketch: the ``K`` least hashes of the class.  The ``PROBES`` least go into inverted lists
   (value -> classes).
3. Overlaps, by the length of a list:
   * up to ``SMALL``: its pairs are counted; two classes that share at least two lists (or one, if
     one of the classes also stands in a long list) and whose sizes allow the similarity are a
     candidate;
   * up to ``BLOCK``: its members meet in one task with their full sets, which tells all links
     among them exactly and returns no more of them than connect them (fewer than members); lists
     that share members meet as one where the union is not over ``BLOCK`` either, so that a set
     travels once and not with each list;
   * longer lists (a passage that many texts share, or thousands of near copies) are never paired:
     their members are listed again under pairs of long-list values.  Members of pair lists that are still
     long look at their whole sketch: a value that at most ``BLOCK`` of these members hold is rare.  Linked
     sketches differ in few values, so the shares of rare ones differ little.  Members with a share of at
     least ``RARE_LOW`` percent are listed under as many of their least rare values as in the first lists, which
     texts that only have a passage in common do not share; members under ``RARE_HIGH`` percent, near copies of each other above all,
     are joined into families with all they share a long list with (between the two, both).  A family
     falls into half blocks by hash.
     First each of them meets the family's pivots, the half block of number 0; what these links
     connect needs no comparison any more.  Then the members are dealt anew, those of one large
     component together, and two half blocks meet unless both hold the same component.
4. Filter: the union sketch of a candidate (K least values of both sketches) estimates the
   similarity; pairs far below the threshold go, the others meet like lists of two.  Where lists meet,
   sketches come first, too: only members with a likely partner in the list bring their full sets.
5. Verification: wherever classes meet, their full sets decide exactly.
6. Components of the verified links; ``component_id`` is the least doc_id reachable.

Nothing is capped: every list is paired, met in blocks or split further.  A link with similarity
s >= 0.85 can be missed only by chance of the hash: if the two share fewer than two of 8 least values
(under 1e-5 at s = 0.85, or at s = 0.8 with 10 values; falling fast with s), or if the estimate (K = 64, deviation 0.045) errs by
more than ``MARGIN_PCT`` = 25 points (5 deviations); in families also if the rare shares of the two sketches differ by
40 points (at s = 0.8 some 9 +- 3 of 64 values differ) or if they share fewer than two of their listed rare values.

A null doc_id joins the class of its text: its component_id is null only where no equal text has
an id, and it is kept only then.  Repeated rows are returned each (``drop_near_duplicates`` keeps
one row of equal id and text); empty tables give empty results; extra columns pass untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee.llm.common import ascii_lower, drop_written, let, packed, shingles, small_side, text_or_empty, words, written, written_at
from perigee.llm.components import components

WIDTH = 5
K = 64
PROBES = 8
SMALL = 16
BLOCK = 512
MARGIN_PCT = 25
RARE_LOW, RARE_HIGH = 30, 70


def shingle_set(text: Column, width: int = WIDTH) -> Column:
    """Distinct shingle hashes of the whole text, ascending."""
    return F.sort_array(F.array_distinct(shingles(words(ascii_lower(text_or_empty(text))), width)))


def shingled(docs: DataFrame, width: int, k: int) -> DataFrame:
    """doc_id, text_key, n (set size), s1, s2 (two hashes that name the set) and its bottom-k sketch, written once."""
    sets = docs.select("doc_id", F.xxhash64("text").alias("text_key"), shingle_set(F.col("text"), width).alias("sh"))
    return written(
        sets.select(
            "doc_id",
            "text_key",
            let(
                F.col("sh"),
                lambda s: F.struct(
                    F.size(s).cast("bigint").alias("n"),
                    F.xxhash64(s).alias("s1"),
                    F.hash(s).alias("s2"),
                    F.slice(s, 1, k).alias("sketch"),
                ),
            ).alias("x"),
        ).select("doc_id", "text_key", "x.*"),
        "neardup-sets",
    )


def _lists(members: DataFrame, depth: int) -> DataFrame:
    """Members (cls, n, vals) listed under every ascending combination of ``depth`` values."""
    out = members.select("cls", "n", "vals", F.explode(F.sequence(F.lit(1), F.size("vals"))).alias("at"))
    out = out.withColumn("key", F.xxhash64(F.lit(depth), F.get("vals", F.col("at") - 1)))
    for _ in range(depth - 1):
        nexts = F.filter(F.sequence(F.lit(1), F.size("vals")), lambda i: i > F.col("at"))
        out = out.select("cls", "n", "vals", "key", F.explode(nexts).alias("at")).withColumn(
            "key", F.xxhash64("key", F.get("vals", F.col("at") - 1))
        )
    return out.select("key", "cls", "n", F.get("vals", F.col("at") - 1).alias("val"))


def _pairs(listed: DataFrame, threshold_pct: int) -> DataFrame:
    """Pairs of members of the same list whose sizes allow the similarity, once for each list."""
    a = listed.selectExpr("key", "cls AS c1", "n AS n1")
    b = listed.selectExpr("key", "cls AS c2", "n AS n2")
    fits = (100 * F.least("n1", "n2") >= threshold_pct * F.greatest("n1", "n2")) & (F.col("c1") < F.col("c2"))
    return a.join(b, "key").where(fits).select("c1", "c2")


def _shared(row: np.ndarray, values: np.ndarray, n: int, columns: int = 1 << 14) -> np.ndarray:
    """(n x n) numbers of values that two members share: products of the incidence matrix, some columns at a time."""
    _, col, many = np.unique(values, return_inverse=True, return_counts=True)
    rank = np.cumsum(many > 1) - 1
    kept = many[col] > 1
    row, col = row[kept], rank[col[kept]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((n, n), np.float32)
    for a in range(0, int(col[-1]) + 1 if len(col) else 0, columns):
        lo, hi = np.searchsorted(col, [a, a + columns])
        part = np.zeros((n, columns), np.float32)
        part[row[lo:hi], col[lo:hi] - a] = 1
        out += part @ part.T
    return out


def block_links(threshold_pct: int):
    """For a group (cls, sh) of at most ``BLOCK`` members: verified links that connect all that link."""

    def run(group: pa.Table) -> pa.Table:
        cls = group["cls"].to_numpy()
        sets = group["sh"].combine_chunks()
        ends = sets.offsets.to_numpy()
        values = sets.values.to_numpy()[ends[0] : ends[-1]]
        sizes = np.diff(ends)
        inter = _shared(np.repeat(np.arange(len(cls)), sizes), values, len(cls))
        union = sizes[:, None] + sizes[None, :] - inter
        linked = (100 * inter >= threshold_pct * union) & (cls[:, None] != cls[None, :])
        left = np.ones(len(cls), bool)
        out: list[tuple[int, int]] = []
        for seed in range(len(cls)):  # spanning trees, breadth first
            if not left[seed]:
                continue
            left[seed] = False
            todo = [seed]
            for at in todo:
                found = np.flatnonzero(linked[at] & left)
                left[found] = False
                out += [(at, int(x)) for x in found]
                todo += found.tolist()
        pairs = np.array(out, np.int64).reshape(-1, 2)
        ids = np.sort(cls[pairs], axis=1)
        return pa.table({"c1": pa.array(ids[:, 0], pa.int64()), "c2": pa.array(ids[:, 1], pa.int64())})

    return run


def block_likely(threshold_pct: int, margin_pct: int):
    """For a group (key, cls, sketch) of at most ``BLOCK`` members: those whose sketch shares so many of its values with
    another's as a linked pair's does, but for ``margin_pct`` points or, if that is more, five deviations of the estimate."""

    def run(group: pa.Table) -> pa.Table:
        sketches = group["sketch"].combine_chunks()
        sizes = sketches.value_lengths().to_numpy()
        common = _shared(np.repeat(np.arange(len(sizes)), sizes), sketches.flatten().to_numpy(), len(sizes))
        np.fill_diagonal(common, 0)
        larger = np.maximum(sizes[:, None], sizes[None, :])
        margin = np.maximum(margin_pct, 5 * np.sqrt(threshold_pct * (100 - threshold_pct) / np.maximum(larger, 1)))
        likely = (100 * common >= (threshold_pct - margin) * larger) & (common > 0)
        return group.select(["key", "cls"]).filter(pa.array(likely.any(axis=1)))

    return run


def links(
    classes: DataFrame, docs_sets, threshold_pct: int, probes: int, small: int, block: int, margin_pct: int
) -> DataFrame:
    """Verified links (c1 < c2) that connect the classes (cls, n, sketch) as all links do.

    ``docs_sets(ids)`` gives (cls, sh) with the full sets of the classes in ``ids``.
    """
    members = classes.select("cls", "n", F.slice("sketch", 1, probes).alias("vals"))
    pairs, meets = [], []
    families = None
    long_values = None  # (cls) that stand in a long list
    for level in (1, 2):
        listed = _lists(members, level)
        # the number of members of a list goes back to them: lists of one are dropped at once
        many = listed.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
        listed = written(listed.join(many, "key"), "neardup-lists")
        found = _pairs(listed.where(F.col("many") <= small), threshold_pct)
        pairs.append(found.groupBy("c1", "c2").agg((F.count(F.lit(1)) + (level > 1) * 1).alias("lists")))
        meets.append(listed.where((F.col("many") > small) & (F.col("many") <= block)).select("key", "cls"))
        over = listed.where(F.col("many") > block)
        if over.isEmpty():
            break
        if level == 1:
            # only values of long lists are combined further
            members = written(
                over.groupBy("cls", "n").agg(F.array_sort(F.collect_set("val")).alias("vals")), "neardup-long"
            )
            long_values = members.select("cls")
        else:
            # a member of pair lists stands in up to probes * (probes - 1) / 2 of them: one row holds them all
            over = written(over.groupBy("cls").agg(F.array_sort(F.collect_set("key")).alias("keys")), "neardup-over")
            rare, rest = _by_rare_values(over.select("cls"), classes, probes, block)
            pairs.append(_pairs(rare.where(F.col("many") <= small), threshold_pct).groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("lists")))
            meets.append(rare.where(F.col("many") > small).select("key", "cls"))
            families = _families(_joining(over.join(rest, "cls")), block)
            families = None if families.isEmpty() else families
    candidates = pairs[0]
    if long_values is not None:
        flagged = long_values.withColumnRenamed("cls", "c1").withColumn("more", F.lit(1))
        candidates = candidates.join(flagged, "c1", "left").withColumn("lists", F.col("lists") + F.coalesce("more", F.lit(0))).drop("more")
    for p in pairs[1:]:
        candidates = candidates.unionByName(p)
    candidates = candidates.where("lists > 1").select("c1", "c2").distinct()

    candidates = written(candidates, "neardup-candidates")
    named = candidates.select(F.explode(F.array("c1", "c2")).alias("cls")).distinct()
    sketch = classes.select("cls", "sketch").join(small_side(named), "cls", "left_semi")
    both = candidates.join(sketch.selectExpr("cls AS c1", "sketch AS k1"), "c1").join(
        sketch.selectExpr("cls AS c2", "sketch AS k2"), "c2"
    )
    union = F.slice(F.sort_array(F.array_union("k1", "k2")), F.lit(1), F.greatest(F.size("k1"), F.size("k2")))
    agree = F.size(F.array_intersect(F.array_intersect(F.col("k1"), F.col("k2")), union))
    likely = both.where(100 * agree >= (threshold_pct - margin_pct) * F.size(union))
    # a likely pair is a list of two: pairs that share members meet together, like the middle lists
    meet = likely.select(F.xxhash64("c1", "c2").alias("key"), F.explode(F.array("c1", "c2")).alias("cls"))
    for m in meets:
        meet = meet.unionByName(m)
    meet = _joined(meet, block)
    meet = written(meet if families is None else meet.unionByName(_with_pivots(families, block)), "neardup-meets")
    sketches = classes.select("cls", "sketch")
    found = _met(meet, sketches, docs_sets, threshold_pct, margin_pct)
    if families is None:
        return found
    meet = written(_unlinked(families, components(found.select(F.col("c1").alias("u"), F.col("c2").alias("v"))), block), "neardup-meets")
    return found if meet.isEmpty() else found.unionByName(_met(meet, sketches, docs_sets, threshold_pct, margin_pct))


def _met(meet: DataFrame, sketches: DataFrame, docs_sets, threshold_pct: int, margin_pct: int) -> DataFrame:
    """Verified links among the members of each list of ``meet`` (key, cls): sketches tell who may have a
    partner there, the full sets of these decide."""
    known = sketches.join(small_side(meet.select("cls").distinct()), "cls", "left_semi")
    near = known.join(meet, "cls").select("key", "cls", "sketch").groupBy("key")
    likely, path = written_at(near.applyInArrow(block_likely(threshold_pct, margin_pct), "key bigint, cls bigint"), "neardup-likely")
    sets = docs_sets(likely.select("cls").distinct())
    groups = sets.join(small_side(likely), "cls").select("key", "cls", "sh").groupBy("key")
    out = written(groups.applyInArrow(block_links(threshold_pct), "c1 bigint, c2 bigint").distinct(), "neardup-links")
    drop_written(meet.sparkSession, path)
    return out


def _by_rare_values(over: DataFrame, classes: DataFrame, probes: int, block: int) -> tuple[DataFrame, DataFrame]:
    """For the members (cls) of lists that are too long: (key, cls, n, many), the lists of their rare values, and (cls),
    those that have few rare values.  A sketch that is neither the whole set nor deeper than the probes says nothing
    about rare values: its member stays with the families."""
    values = classes.join(small_side(over), "cls", "left_semi").select("cls", "n", F.explode("sketch").alias("val"))
    many = values.groupBy("val").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") <= block)
    rare = F.struct("val", "many")
    held = values.join(many, "val", "left").groupBy("cls", "n").agg(
        F.count(F.lit(1)).alias("size"),
        F.count("many").alias("rare"),
        # at most K values
        F.array_sort(F.collect_list(F.when(F.col("many") > 1, rare))).alias("vals"),
    )
    held = written(held, "neardup-rare")
    share = 100 * F.col("rare")
    known = (F.col("size") > probes) | (F.col("size") == F.col("n"))
    listed = held.where(known & (share >= RARE_LOW * F.col("size"))).select("cls", "n", F.explode(F.slice("vals", 1, probes)).alias("v"))
    lists = listed.select(F.xxhash64(F.lit("rare"), "v.val").alias("key"), "cls", "n")
    # members that list a value: fewer than hold it
    there = lists.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    return written(lists.join(there, "key"), "neardup-lists"), held.where(~known | (share < RARE_HIGH * F.col("size"))).select("cls")


def _to_least(lists: DataFrame) -> DataFrame:
    """(u, v): each member of the lists (key, cls) with the least of its list."""
    least = lists.groupBy("key").agg(F.min("cls").alias("v"))
    return lists.join(least, "key").select(F.col("cls").alias("u"), "v")


def _joined(lists: DataFrame, block: int) -> DataFrame:
    """(key, cls): lists that share members as one list, where it has at most ``block`` members."""
    lists = written(lists, "neardup-middle")
    group = components(_to_least(lists))
    sizes = group.groupBy("component_id").agg((F.count(F.lit(1)) <= block).alias("fits"))
    group = group.join(sizes, "component_id").select(F.col("id").alias("cls"), "component_id", "fits")
    # one (the least) member of a list alone is in no component: it is its own
    known = lists.join(group, "cls", "left")
    key = F.when(F.col("fits"), F.xxhash64(F.lit("joined"), "component_id")).otherwise(F.col("key"))
    return known.select(key.alias("key"), "cls").distinct()


def _joining(members: DataFrame) -> DataFrame:
    """(u, v) that join members (cls, keys) where they share a list.

    Members of the very same lists, as thousands of near copies are, point to the least of them; it alone goes
    through the lists."""
    same = members.groupBy("keys").agg(F.min("cls").alias("v"))
    to_same = members.join(same, "keys").select(F.col("cls").alias("u"), "v")
    return to_same.unionByName(_to_least(same.select(F.explode("keys").alias("key"), F.col("v").alias("cls"))))


def _families(edges: DataFrame, block: int) -> DataFrame:
    """(cls, family, parts, own): what ``edges`` (u, v) of members of lists too long for a block join, dealt by hash
    into ``parts`` half blocks."""
    family = components(edges)
    sizes = family.groupBy("component_id").agg(F.ceil(2 * F.count(F.lit(1)) / F.lit(block)).cast("int").alias("parts"))
    placed = family.join(sizes, "component_id").select(F.col("id").alias("cls"), F.col("component_id").alias("family"), "parts")
    return written(placed.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")), "neardup-families")


def _with_pivots(families: DataFrame, block: int) -> DataFrame:
    """(key, cls): each half block of a family with the half block 0, its pivots."""
    others = F.when(F.col("own") == 0, F.sequence(F.lit(1), F.col("parts") - 1)).otherwise(F.array("own"))
    return families.select("cls", "family", F.explode(others).alias("with")).select(
        F.xxhash64("family", F.lit(0), "with").alias("key"), "cls"
    )


def _unlinked(families: DataFrame, linked: DataFrame, block: int) -> DataFrame:
    """(key, cls): pairs of half blocks in which members of a family not connected so far meet.

    ``linked`` (id, component_id) is what the links so far connect.  Members of a component of at
    least half a block's size get half blocks of their own, the others share theirs.
    """
    placed = families.select("cls", "family").join(linked.withColumnRenamed("id", "cls"), "cls", "left")
    placed = placed.withColumn("component", F.coalesce("component_id", "cls")).drop("component_id")
    sizes = placed.groupBy("family", "component").agg(F.count(F.lit(1)).alias("many"))
    sizes = sizes.withColumn("bin", F.when(2 * F.col("many") >= block, F.col("component")))  # null: the others
    bins = sizes.groupBy("family", "bin").agg(F.ceil(2 * F.sum("many") / F.lit(block)).alias("parts"))
    placed = placed.join(sizes.select("family", "component", "bin"), ["family", "component"])
    halves = bins.select("family", "bin", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    halves = halves.withColumn("half", F.xxhash64("family", F.coalesce("bin", F.lit(0)), F.col("bin").isNull(), "part"))
    halves = written(halves, "neardup-halves")
    left = halves.select("family", F.col("bin").alias("b1"), F.col("half").alias("h1"))
    right = halves.select("family", F.col("bin").alias("b2"), F.col("half").alias("h2"))
    met = left.join(right, "family").where("h1 <= h2 AND (b1 IS NULL OR b2 IS NULL OR b1 <> b2)")
    met = met.select(F.xxhash64("h1", "h2").alias("key"), F.explode(F.array_distinct(F.array("h1", "h2"))).alias("half"))
    own = F.pmod(F.xxhash64("cls"), F.col("parts"))
    placed = placed.withColumnRenamed("family", "f").withColumnRenamed("bin", "b").join(
        halves, (F.col("f") == F.col("family")) & F.col("b").eqNullSafe(F.col("bin")) & (own == F.col("part"))
    )
    return placed.select("cls", "half").join(met, "half").select("key", "cls")


def near_rows(
    docs: DataFrame,
    threshold_pct: int = 85,
    width: int = WIDTH,
    k: int = K,
    probes: int = PROBES,
    small: int = SMALL,
    block: int = BLOCK,
    margin_pct: int = MARGIN_PCT,
) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept for every document (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    own = shingled(docs, width, k)
    by_set = (
        own.where("n > 0")
        .groupBy("n", "s1", "s2")
        .agg(F.min("doc_id").alias("cls"), F.first("sketch").alias("sketch"))
    )
    by_set = written(by_set.where("cls IS NOT NULL"), "neardup-classes")

    twice = own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 AND doc_id IS NOT NULL")
    repeated = not twice.isEmpty()

    def full_sets(ids: DataFrame) -> DataFrame:
        wanted = small_side(ids.join(by_set.select("cls", "s1"), "cls"))
        sets = docs.join(wanted, docs.doc_id == wanted.cls).select("cls", "s1", shingle_set(F.col("text"), width).alias("sh"))
        # an id may be held by rows with different texts: the set must be the class's own
        sets = sets.where(F.xxhash64("sh") == F.col("s1"))
        return (sets.dropDuplicates(["cls", "s1"]) if repeated else sets).select("cls", "sh")

    found = links(by_set.select("cls", "n", "sketch"), full_sets, threshold_pct, probes, small, block, margin_pct)
    comp = components(found.select(F.col("c1").alias("u"), F.col("c2").alias("v"))).withColumnRenamed("id", "cls")
    named = by_set.join(comp, "cls", "left").select(
        "n", "s1", "s2", F.coalesce("component_id", "cls").alias("component_id")
    )
    joined = own.join(named, ["n", "s1", "s2"], "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select(
        "doc_id",
        "text_key",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def near_components(docs: DataFrame, threshold_pct: int = 85, **how: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document (doc_id, text)."""
    return near_rows(docs, threshold_pct, **how).drop("text_key")


def drop_near_duplicates(docs: DataFrame, threshold_pct: int = 80, probes: int = 10) -> DataFrame:
    """The document with the least doc_id of each component, all columns unchanged."""
    kept = near_rows(docs, threshold_pct, probes=probes).where("kept")
    kept = kept.groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg(F.count(F.lit(1)).alias("many"))
    own = F.xxhash64(F.col("row")["text"]) == F.col("key")
    stay = packed(docs).join(kept, F.col("row")["doc_id"].eqNullSafe(F.col("id")) & own, "inner")
    once = stay.where((F.col("many") == 1) | F.col("id").isNull()).select("row.*")
    again = stay.where((F.col("many") > 1) & F.col("id").isNotNull())
    again = again.groupBy("id", F.col("row")["text"].alias("text")).agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return once.unionByName(again.select("row.*"))
