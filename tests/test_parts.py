"""Work on a landing part after part: disjoint sets of rows, the same results, fewer files read and kept."""

import json

import pytest
from pyspark.sql import functions as F
from test_feed import _tables_of, obj

from perigee.plans import ingest_keys, landing
from perigee.sources import feed, store, tables


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture()
def by_days(spark, scratch, monkeypatch):
    """Twelve files of a week each and one with approaches of all weeks, some without a day."""
    monkeypatch.setattr(feed, "PART_ROWS", 10)
    weeks = [[f"2024-{m:02d}-{d:02d}" for d in (1, 2, 3, 4, 5)] for m in range(1, 13)]
    files = [{day: [obj(n, f"n{n}", day) for n in range(4)] for day in days} for days in weeks]
    files.append({"2024-01-01": [obj(9, "mixed", days[0]) for days in weeks] + [obj(8, "none", None), obj(6, "nameless", None) | {"id": None, "neo_reference_id": None}, obj(7, "bare", "", approaches=[])]})
    for i, days in enumerate(files):
        with open(f"{scratch}/f{i:02d}.json", "w") as f:
            f.write(json.dumps({"links": {"self": f"p{i}", "next": f"p{i + 1}"}, "near_earth_objects": days}) + "\n")
    return scratch


def test_parts_are_disjoint_and_whole(spark, by_days):
    parts = list(feed.read_flat_parts(spark, by_days))
    assert len(parts) > 8
    got = [sorted_rows(p) for p in parts]
    assert sorted((r for g in got for r in g), key=str) == sorted(sorted_rows(feed.read_flat(spark, by_days)), key=str)
    windows = [{r["w"] for r in p.select(feed.window_start(F.col("close_approach_date")).alias("w")).distinct().collect()} for p in parts]
    assert sum(map(len, windows)) == len(set().union(*windows)) and {None} in windows
    assert all(len(p.inputFiles()) <= 4 for p in parts)


def test_audits_and_loads_by_parts_are_those_of_all_rows(spark, by_days, monkeypatch):
    monkeypatch.setattr(ingest_keys, "landed_pages", lambda *_: by_days)
    flat = feed.read_flat(spark, by_days)
    for key, whole in (("ingest_audit", feed.audit(flat)), ("load_asteroids", tables.load_asteroids(flat)),
                       ("load_close_approach", tables.load_close_approach(flat))):
        got = ingest_keys.INGEST_KEYS[key](spark, by_days)
        assert got.columns == whole.columns and sorted_rows(got) == sorted_rows(whole), key
    sketches = ingest_keys.k_ingest_audit_sketches(spark, by_days)
    exact = feed.audit(flat).select("window_start", "n_records", "n_days", "null_velocity", "null_au", "null_body")
    assert sorted_rows(sketches.drop("within_3_pct")) == sorted_rows(exact)


def test_shuffle_files_of_audits_and_loads_are_gone(spark, by_days, monkeypatch):
    monkeypatch.setattr(ingest_keys, "landed_pages", lambda *_: by_days)
    kept = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses
    for key in ("ingest_audit", "load_asteroids", "load_close_approach"):
        n = kept().size()
        ingest_keys.INGEST_KEYS[key](spark, by_days).collect()
        assert kept().size() <= n + 1, key  # file_days; the rows themselves lie in files


def test_versions_of_an_object_in_several_parts(spark, scratch):
    columns = "id bigint, name string, absolute_magnitude_h double, estimated_diameter_min_km double, estimated_diameter_max_km double, is_potentially_hazardous_asteroid boolean"
    rows = [(1, "b", 1.0, 0.1, 0.2, True), (None, "x", None, 0.1, 0.2, None), (1, "a", 2.0, 0.1, 0.2, False), (None, "x", None, 0.1, 0.2, None), (2, None, 1.0, 0.1, 0.2, True)]
    parts = [spark.createDataFrame([r], columns) for r in rows]
    got = tables.load_asteroids_in_parts(spark, parts, f"{scratch}/dimension")
    assert sorted_rows(got) == sorted_rows(tables.load_asteroids(spark.createDataFrame(rows, columns)))
    assert store.names(spark, f"{scratch}/dimension") == ["4"]


def test_nothing_landed(spark, scratch, monkeypatch):
    monkeypatch.setattr(ingest_keys, "landed_pages", lambda *_: f"{scratch}/none")
    spark.createDataFrame([], feed.FEED_SCHEMA).write.json(f"{scratch}/none")
    for key in ("ingest_audit", "load_asteroids", "load_close_approach", "ingest_audit_sketches"):
        assert ingest_keys.INGEST_KEYS[key](spark, scratch).count() == 0


def test_large_landing_has_smaller_slices(spark, scratch, monkeypatch):
    monkeypatch.setattr(landing, "SLICE_ROWS", 100)
    from perigee.sources import binding

    _, approaches = binding.bind(spark, _tables_of(scratch, 50, 5000))
    assert len(landing._slices(approaches)) > 8  # as many as its 13 windows allow


def test_pages_are_parsed_once(spark, by_days, monkeypatch):
    """The sets of an audit and the batches of a load are read from staged rows, which go when they are done."""
    monkeypatch.setattr(ingest_keys, "landed_pages", lambda *_: by_days)
    from perigee.session import scratch_root

    sources = []
    for module, name in ((feed, "audit"), (feed, "audit_sketches"), (tables, "upsert"), (tables, "load_asteroids")):
        real = getattr(module, name)
        seen = lambda *a, real=real: sources.append(a[-1].inputFiles()) or real(*a)
        monkeypatch.setattr(module, name, seen)
    flats = f"{scratch_root(spark)}/flat"
    before = store.names(spark, flats)
    for key in ("ingest_audit_sketches", "upsert_load", "upsert_load_asteroids", "summary_bodies", "atomic_publish"):
        sources.clear()
        ingest_keys.INGEST_KEYS[key](spark, by_days).collect()
        assert sources and not any(".json" in f for files in sources for f in files), key
    assert store.names(spark, flats) == before
