import datetime as dt
import os

import pytest
from fixtures import APPROACHES, ASTEROIDS, frames, rows
from pyspark.sql import functions as F

from test_plans import plan_text

from perigee.operators.dedup import APPROACH_ORDER, dedup_by_key
from perigee.schemas import APPROACH_COLUMNS, CLOSE_APPROACH_SCHEMA
from perigee.sources import store, tables

D = dt.date


def flat_rows(spark):
    """Flat feed rows (13 columns) from the fixtures: each approach with its object."""
    a, ca = frames(spark)
    return a.join(ca, a["id"] == ca["neo_reference_id"]).select(
        "id", "neo_reference_id", "name", "absolute_magnitude_h", "estimated_diameter_min_km",
        "estimated_diameter_max_km", "is_potentially_hazardous_asteroid", *APPROACH_COLUMNS[1:]
    )


def sorted_rows(df):
    return sorted(rows(df), key=repr)


def test_dedup_survivor_is_nearest_then_fastest_and_partitioning_independent(spark):
    dup = APPROACHES + [
        (3, D(2030, 2, 28), 210000.0, 0.0009, 1.0, 1.0, "Earth"),  # same distance, faster: wins
        (9, D(2030, 1, 10), 1.0, None, None, None, None),  # NULL distance sorts last
    ]
    df = spark.createDataFrame(dup, CLOSE_APPROACH_SCHEMA)
    keys = ["neo_reference_id", "close_approach_date"]
    one = sorted_rows(dedup_by_key(df.repartition(1), keys, APPROACH_ORDER))
    many = sorted_rows(dedup_by_key(df.repartition(7, "orbiting_body"), keys, APPROACH_ORDER))
    assert one == many
    got = {(r[0], r[1]): r for r in one}
    assert got[(3, D(2030, 2, 28))][2] == 210000.0
    assert got[(9, D(2030, 1, 10))][3] == 0.3
    assert got[(12, D(2030, 6, 6))][3] == 0.1  # near and far on one day: the near one
    assert len(one) == len({(r[0], r[1]) for r in dup})


def test_load_tables_from_flat_rows(spark):
    flat = flat_rows(spark)
    a = tables.load_asteroids(flat)
    assert a.count() == len({r[0] for r in ASTEROIDS if r[0] in {x[0] for x in APPROACHES}})
    c = tables.load_close_approach(flat)
    assert c.columns == APPROACH_COLUMNS
    assert c.count() == flat.select("neo_reference_id", "close_approach_date").distinct().count()


def test_upsert_is_order_independent_and_idempotent(spark, scratch):
    flat = flat_rows(spark)
    early = flat.where(F.col("close_approach_date") < F.lit(D(2030, 3, 1)))
    late = flat.where((F.col("close_approach_date") >= F.lit(D(2030, 2, 1))) | F.col("close_approach_date").isNull())
    r1, r2 = os.path.join(scratch, "one"), os.path.join(scratch, "two")
    for b in (early, late, early):
        tables.upsert(spark, r1, b)
    for b in (late, early):
        tables.upsert(spark, r2, b)
    a1, c1 = tables.read_tables(spark, r1)
    a2, c2 = tables.read_tables(spark, r2)
    assert sorted_rows(c1) == sorted_rows(c2) == sorted_rows(tables.load_close_approach(flat))
    assert sorted_rows(a1) == sorted_rows(a2) == sorted_rows(tables.load_asteroids(flat))


def test_newest_version_of_an_object_wins_in_any_batch_order(spark, scratch):
    flat = flat_rows(spark).where("id = 1")
    old = flat.where(F.col("close_approach_date") < F.lit(D(2030, 6, 1)))
    new = old.select(*[c for c in old.columns if c not in ("absolute_magnitude_h", "close_approach_date")],
                     F.lit(99.5).alias("absolute_magnitude_h"), F.date_add("close_approach_date", 4000).alias("close_approach_date"))
    assert old.count()
    for name, batches in (("ab", (old, new)), ("ba", (new, old)), ("aba", (old, new, old))):
        for x in batches:
            tables.upsert(spark, os.path.join(scratch, name), x.select(*flat.columns))
        a, _ = tables.read_tables(spark, os.path.join(scratch, name))
        assert [r["absolute_magnitude_h"] for r in a.collect()] == [99.5]


def test_fact_layout_is_monthly(spark, scratch):
    root = os.path.join(scratch, "layout")
    tables.upsert(spark, root, flat_rows(spark))
    (run,) = os.listdir(os.path.join(root, "close_approach"))
    dirs = os.listdir(os.path.join(root, "close_approach", run))
    assert "approach_month=2030-01-01" in dirs and "approach_month=__HIVE_DEFAULT_PARTITION__" in dirs
    _, fact = tables.read_tables(spark, root, with_partition=True)
    plan = plan_text(fact.where(F.col("approach_month") == F.lit(D(2030, 2, 1))))
    assert "PartitionFilters: [isnotnull(approach_month" in plan


def test_a_crash_before_the_switch_changes_nothing(spark, scratch, monkeypatch):
    """Versions are written, then the manifest fails: readers see the old tables, a replay the new ones."""
    root = os.path.join(scratch, "crash")
    flat = flat_rows(spark)
    early = flat.where(F.col("close_approach_date") < F.lit(D(2030, 3, 1)))
    tables.upsert(spark, root, early)
    want = [sorted_rows(t) for t in tables.read_tables(spark, root)]
    monkeypatch.setattr(store, "create_new", _raise)
    with pytest.raises(RuntimeError, match="no record"):
        tables.upsert(spark, root, flat)
    monkeypatch.undo()
    assert len(os.listdir(os.path.join(root, "close_approach"))) == 2  # the new versions are there, unseen
    assert [sorted_rows(t) for t in tables.read_tables(spark, root)] == want
    assert tables.upsert(spark, root, flat) == 2
    assert sorted_rows(tables.read_tables(spark, root)[1]) == sorted_rows(tables.load_close_approach(flat))


def _raise(*_args):
    raise RuntimeError("no record")


def test_publish_is_all_or_nothing_and_latest_wins(spark, scratch):
    root = os.path.join(scratch, "pub")
    a, ca = frames(spark)
    assert tables.publish(spark, root, a, ca.where("neo_reference_id = 1")) == 1
    assert tables.publish(spark, root, a, ca) == 2
    pa, pc = tables.read_published(spark, root)
    assert pc.count() == ca.count() and pa.count() == a.count()
    # A run folder without a manifest record is invisible to readers.
    os.makedirs(os.path.join(root, "close_approach", "run=9-orphan", "approach_month=2030-01-01"))
    pa, pc = tables.read_published(spark, root)
    assert pc.count() == ca.count()
    assert tables._manifest(spark, root)["approaches_without_object"] == ca.join(a, ca["neo_reference_id"] == a["id"], "left_anti").count()


def test_create_tables_and_insert(spark, scratch):
    names = tables.create_tables(spark, "perigee_t", os.path.join(scratch, "db"))
    flat = flat_rows(spark)
    tables.insert_tables(spark, names, tables.load_asteroids(flat), tables.load_close_approach(flat))
    assert spark.table(names[0]).count() == tables.load_asteroids(flat).count()
    again = tables.create_tables(spark, "perigee_t", os.path.join(scratch, "db"))  # IF NOT EXISTS
    assert again == names
    got = spark.table(names[1]).select(*APPROACH_COLUMNS)
    assert sorted_rows(got) == sorted_rows(tables.load_close_approach(flat))
    tables.insert_tables(spark, names, tables.load_asteroids(flat), tables.load_close_approach(flat))  # adds nothing
    assert spark.table(names[0]).count() == tables.load_asteroids(flat).count()
    assert sorted_rows(spark.table(names[1]).select(*APPROACH_COLUMNS)) == sorted_rows(tables.load_close_approach(flat))


def test_dimension_duplicate_id_keeps_one_deterministic_row(spark):
    from perigee.schemas import ASTEROIDS_SCHEMA

    rows_in = ASTEROIDS + [(1, "6 Alpha", 17.5, 0.10, 0.25, True), (1, "6 alpha", 18.0, 0.10, 0.25, True)]
    df = spark.createDataFrame(rows_in, ASTEROIDS_SCHEMA)
    flat = df.withColumn("neo_reference_id", F.col("id"))
    one = sorted_rows(tables.load_asteroids(flat.repartition(1)))
    many = sorted_rows(tables.load_asteroids(flat.repartition(5, "absolute_magnitude_h")))
    assert one == many and len(one) == len(ASTEROIDS)
    # order: name, magnitude, ... ascending -> "6 Alpha" with magnitude 17.5
    assert [r for r in one if r[0] == 1] == [(1, "6 Alpha", 17.5, 0.10, 0.25, True)]


def test_null_ids_are_inserted_once(spark, scratch):
    from perigee.schemas import ASTEROIDS_SCHEMA

    names = tables.create_tables(spark, "perigee_n", os.path.join(scratch, "ndb"))
    a = spark.createDataFrame([(None, "x", 1.0, None, None, None), (None, "y", 1.0, None, None, None), (1, "z", 1.0, None, None, True)], ASTEROIDS_SCHEMA)
    c = spark.createDataFrame([(None, D(2030, 1, 1), 1.0, None, None, None, None), (1, None, 2.0, None, None, None, None)], CLOSE_APPROACH_SCHEMA)
    for _ in range(2):
        tables.insert_tables(spark, names, a, c)
    assert sorted_rows(spark.table(names[0])) == sorted_rows(a)
    assert sorted_rows(spark.table(names[1]).select(*APPROACH_COLUMNS)) == sorted_rows(c)


def _meanwhile(monkeypatch, others):
    """The first record to be created waits until ``others`` (functions) have committed theirs."""
    real, todo = store.create_new, list(others)

    def create(*args):
        while todo:
            todo.pop(0)()
        return real(*args)

    monkeypatch.setattr(store, "create_new", create)


def test_two_interleaved_upserts_both_end_in_the_tables(spark, scratch, monkeypatch):
    flat = flat_rows(spark)
    parts = [flat.where(f"pmod(xxhash64(id, close_approach_date), 3) = {i}") for i in range(3)]
    root = os.path.join(scratch, "two")
    tables.upsert(spark, root, parts[0])
    _meanwhile(monkeypatch, [lambda: tables.upsert(spark, root, parts[1])])
    assert tables.upsert(spark, root, parts[2]) == 3
    monkeypatch.undo()
    a, c = tables.read_tables(spark, root)
    assert sorted_rows(c) == sorted_rows(tables.load_close_approach(flat))
    assert sorted_rows(a) == sorted_rows(tables.load_asteroids(flat))
    record = tables._manifest(spark, root)
    assert record["approach_rows"] == c.count() and record["ledger"]["new"] + record["ledger"]["duplicates"] == parts[2].where(tables.has_approach()).count()


def test_an_upsert_over_other_months_keeps_its_versions(spark, scratch, monkeypatch):
    """A commit in between that touches other months costs no second merge of this batch's months."""
    flat = flat_rows(spark).where("close_approach_date IS NOT NULL")
    month = F.trunc("close_approach_date", "MM")
    jan, feb = (flat.where(month == F.lit(D(2030, m, 1))) for m in (1, 2))
    root = os.path.join(scratch, "apart")
    _meanwhile(monkeypatch, [lambda: tables.upsert(spark, root, jan)])
    merges = []
    real = tables._write_months
    monkeypatch.setattr(tables, "_write_months", lambda *a: merges.append(a[3]) or real(*a))
    tables.upsert(spark, root, feb)
    monkeypatch.undo()
    assert len(merges) == 2  # one for each batch
    _, c = tables.read_tables(spark, root)
    assert sorted_rows(c) == sorted_rows(tables.load_close_approach(jan.unionByName(feb)))


def test_publish_beside_an_upsert_is_the_later_record(spark, scratch, monkeypatch):
    a, ca = frames(spark)
    root = os.path.join(scratch, "beside")
    _meanwhile(monkeypatch, [lambda: tables.upsert(spark, root, flat_rows(spark).where("id = 1"))])
    assert tables.publish(spark, root, a, ca) == 2
    monkeypatch.undo()
    assert tables.read_published(spark, root)[1].count() == ca.count()


def test_a_record_is_created_once(spark, scratch):
    path = store.record_path(os.path.join(scratch, "once"), 1)
    assert store.create_new(spark, path, {"run_no": 1, "by": "a"}) and not store.create_new(spark, path, {"run_no": 1, "by": "b"})
    assert store.newest(spark, os.path.join(scratch, "once")) == {"run_no": 1, "by": "a"}
    assert len(os.listdir(os.path.dirname(path))) <= 2  # the record and its checksum; nothing left beside


def test_retention_removes_what_no_kept_record_names(spark, scratch):
    flat = flat_rows(spark)
    root = os.path.join(scratch, "kept")
    for i in range(4):
        tables.upsert(spark, root, flat.where(f"pmod(xxhash64(id, close_approach_date), 4) = {i}"))
    before = [sorted_rows(t) for t in tables.read_tables(spark, root)]
    older = [sorted_rows(t) for t in tables.read_tables(spark, root, run_no=3)]
    assert tables.retain(spark, root, keep=4, grace_seconds=3600) == []  # a writer may still need new folders
    removed = tables.retain(spark, root, keep=2, grace_seconds=-5)
    assert removed and store.record_numbers(spark, root) == [3, 4]
    assert [sorted_rows(t) for t in tables.read_tables(spark, root)] == before
    assert [sorted_rows(t) for t in tables.read_tables(spark, root, run_no=3)] == older
    assert len(os.listdir(os.path.join(root, "asteroids"))) == 2
    tables.retain(spark, root, keep=1, grace_seconds=-5)
    months = [os.path.join(r, m) for r in os.listdir(os.path.join(root, "close_approach"))
              for m in os.listdir(os.path.join(root, "close_approach", r)) if "=" in m]
    assert len(months) == len(tables._manifest(spark, root)["months"])
    assert [sorted_rows(t) for t in tables.read_tables(spark, root)] == before
    assert tables.retain(spark, root, keep=1, grace_seconds=-5) == []
    assert tables.upsert(spark, root, flat) == 5


def test_compaction_keeps_rows_and_makes_files_fewer(spark, scratch, monkeypatch):
    flat = flat_rows(spark)
    root = os.path.join(scratch, "small")
    monkeypatch.setattr(tables, "MAX_RECORDS_PER_FILE", 1)
    tables.upsert(spark, root, flat)
    monkeypatch.undo()
    record = tables._manifest(spark, root)
    files = lambda r: {m: store.n_files(spark, f"{root}/close_approach/{run}/approach_month={m}") for m, run in r["months"].items()}
    many = [m for m, n in files(record).items() if n > 2]
    assert many
    want = [sorted_rows(t) for t in tables.read_tables(spark, root)]
    assert tables.compact(spark, root, max_files=2) == 2
    after = tables._manifest(spark, root)
    assert {m for m in after["months"] if after["months"][m] != record["months"][m]} == set(many)
    assert max(files(after).values()) <= 2
    assert [sorted_rows(t) for t in tables.read_tables(spark, root)] == want
    assert tables.compact(spark, root, max_files=2) is None


def test_summaries_follow_the_months(spark, scratch):
    from perigee.operators import catalogue as cat

    flat = flat_rows(spark)
    root = os.path.join(scratch, "sums")
    for i in (0, 1, 2, 1):
        tables.upsert(spark, root, flat.where(f"pmod(xxhash64(id), 3) = {i}"))
        a, c = tables.read_tables(spark, root)
        summary = tables.read_summary(spark, root)
        assert rows(cat.monthly_of_summary(summary)) == rows(cat.q11_monthly_counts(a, c))
        assert rows(cat.bodies_of_summary(summary)) == rows(cat.orbiting_bodies(a, c))
        assert summary.agg(F.sum("n_rows")).first()[0] == c.count()


def test_a_load_merges_its_months_and_objects_in_parts(spark, scratch, monkeypatch):
    flat = flat_rows(spark)
    flat = flat.unionByName(flat.where("id = 5").withColumn("id", F.lit(None).cast("bigint")))
    whole, parts = os.path.join(scratch, "whole"), os.path.join(scratch, "parts")
    later = flat.where(F.col("close_approach_date") >= F.lit(D(2030, 2, 1)))
    for batch in (flat, later):
        tables.upsert(spark, whole, batch)
    monkeypatch.setattr(tables, "GROUP_ROWS", 4)
    merged = []
    real = tables.merged_months
    monkeypatch.setattr(tables, "merged_months", lambda stored, batch, count=None: (merged.append(batch.count()), real(stored, batch, count))[1])
    for batch in (flat, later):
        tables.upsert(spark, parts, batch)
    assert len(merged) > 4 and max(merged) < flat.count() / 2
    record = tables._manifest(spark, parts)
    assert len(set(record["months"].values())) > 2 and tables.NO_MONTH in record["months"]
    for a, b in zip(tables.read_tables(spark, whole), tables.read_tables(spark, parts), strict=True):
        assert sorted_rows(a) == sorted_rows(b)
    assert sorted_rows(tables.read_summary(spark, whole)) == sorted_rows(tables.read_summary(spark, parts))
    same = ("asteroid_rows", "month_rows", "approach_rows", "approaches_without_object", "ledger")
    assert {k: record[k] for k in same} == {k: tables._manifest(spark, whole)[k] for k in same}


def test_merged_months_are_placed_and_sorted_once(spark):
    """One exchange to where the rows are written and one sort; the survivors are those of ``dedup_by_key``."""
    some = [(i % 7 or None, D(2030, 1 + i % 3, 1 + i % 5) if i % 11 else None, float(i % 4), float(i % 3) or None, None, -0.0 if i % 2 else 0.0, "EMV"[i % 3]) for i in range(400)]
    df = spark.createDataFrame([*some, *some[:50], (1, D(2030, 1, 1), None, None, None, None, None)], CLOSE_APPROACH_SCHEMA)
    stored, batch = df.where("miss_distance_lunar IS NULL OR orbiting_body <> 'M'"), df.where("orbiting_body = 'M'")
    want = dedup_by_key(stored.unionByName(batch).where(tables.has_approach()), list(tables.APPROACH_KEY), APPROACH_ORDER, "_n")
    got = tables.merged_months(stored, batch, "_n")
    assert sorted_rows(got.select(*want.columns)) == sorted_rows(want)
    plan = plan_text(got)
    assert plan.count("- Exchange (") == plan.count("- Sort (") == 1 and "rangepartitioning(" in plan


def test_versions_of_objects_are_found_by_their_hash(spark):
    """Equal rows of an object become one before its versions are sorted; rows without an id keep each its own day."""
    flat = flat_rows(spark)
    flat = flat.unionByName(flat.where("id = 5").withColumn("id", F.lit(None).cast("bigint")))
    flat = flat.unionByName(flat.where("id = 1").withColumn("name", F.lit("Z")).withColumn("close_approach_date", F.lit(None).cast("date")))
    rows_ = flat.select(*tables.ASTEROID_COLUMNS, F.unix_date("close_approach_date").cast("int").alias(tables.SEEN))
    assert sorted_rows(tables.seen_asteroids(flat)) == sorted_rows(dedup_by_key(rows_, ["id"], tables.SEEN_ORDER))
    assert "HashAggregate" in plan_text(tables.seen_asteroids(flat))
