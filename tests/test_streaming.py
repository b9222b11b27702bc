import datetime as dt
import glob
import json
import os
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import SF_SMALL
from fixtures import rows
from pyspark.sql import functions as F
from test_feed import PAGE_MULTI, PAGE_NEXT, PAGE_PLAIN, land

from perigee.sources import feed, ledger, store, tables
from perigee.streaming import ingest, windows


def sorted_rows(df):
    return sorted(rows(df), key=repr)


def test_stream_ingest_equals_batch_and_restarts(spark, scratch):
    landing = land(scratch, "landing", PAGE_PLAIN, PAGE_NEXT)
    root, ckpt = os.path.join(scratch, "t"), os.path.join(scratch, "ckpt")
    q = ingest.ingest_stream(spark, landing, root, ckpt, max_files_per_trigger=1)
    q.awaitTermination()
    assert q.exception() is None
    batch = feed.read_flat(spark, landing)
    _, fact = tables.read_tables(spark, root)
    assert sorted_rows(fact) == sorted_rows(tables.load_close_approach(batch))

    # restart on the same checkpoint: nothing new, nothing doubled
    q = ingest.ingest_stream(spark, landing, root, ckpt, max_files_per_trigger=1)
    q.awaitTermination()
    assert tables.read_tables(spark, root)[1].count() == 4

    # a page landing later is picked up on the next run
    with open(os.path.join(landing, "page-late.json"), "w") as f:
        import json

        f.write(json.dumps(PAGE_MULTI))
    q = ingest.ingest_stream(spark, landing, root, ckpt, max_files_per_trigger=1)
    q.awaitTermination()
    a, fact = tables.read_tables(spark, root)
    assert fact.count() == 6 and a.count() == 4  # both approaches of the late page's object


def test_dedup_stream_drops_repeats(spark, scratch):
    landing = land(scratch, "dl", PAGE_PLAIN, PAGE_NEXT, PAGE_PLAIN)
    out, ckpt = os.path.join(scratch, "dout"), os.path.join(scratch, "dckpt")
    q = (
        ingest.dedup_stream(ingest.flat_stream(spark, landing, max_files_per_trigger=1))
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", ckpt)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    assert spark.read.parquet(out).count() == 4


def test_window_counts_complete_mode_equals_batch(spark, scratch):
    source = f"{SF_SMALL}/events.parquet"
    out, ckpt = os.path.join(scratch, "wout"), os.path.join(scratch, "wckpt")
    q = windows.run_window_counts(spark, source, out, ckpt)
    q.awaitTermination()
    got = windows.read_latest(spark, out)
    events = spark.read.parquet(source)
    expected = (
        events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n_events"), F.max("value").alias("max_value"))
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("w.end").cast("timestamp_ntz").alias("window_end"),
            "event_type",
            "n_events",
            "max_value",
        )
    )
    assert sorted_rows(got) == sorted_rows(expected)


def _events_file(path, ts_list, start_id):
    table = pa.table(
        {
            "event_id": pa.array(range(start_id, start_id + len(ts_list)), pa.int64()),
            "ts": pa.array(ts_list, pa.timestamp("us")),
            "user_id": pa.array([1] * len(ts_list), pa.int64()),
            "event_type": pa.array(["view"] * len(ts_list)),
            "value": pa.array([1.0] * len(ts_list)),
            "props": pa.array(["{}"] * len(ts_list)),
        }
    )
    pq.write_table(table, path)


def test_append_mode_drops_late_rows(spark, scratch):
    src = os.path.join(scratch, "events")
    os.makedirs(src)
    t = dt.datetime
    files = [
        [t(2024, 1, 1, 10)],  # on time
        [t(2024, 1, 5, 10)],  # jump ahead: watermark -> 2024-01-04 10:00
        [t(2024, 1, 5, 11)],  # filler: the new watermark takes effect
        [t(2024, 1, 1, 11)],  # late: behind the watermark, dropped
    ]
    now = time.time()
    for i, ts in enumerate(files):
        p = os.path.join(src, f"part-{i}.parquet")
        _events_file(p, ts, i * 10)
        os.utime(p, (now + i, now + i))
    out, ckpt = os.path.join(scratch, "aout"), os.path.join(scratch, "ackpt")
    q = windows.run_window_counts(spark, src, out, ckpt, mode="append", max_files_per_trigger=1)
    q.awaitTermination()
    dropped = sum(
        op.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for op in p.get("stateOperators", [])
    )
    assert dropped >= 1
    got = rows(spark.read.parquet(out).select("window_start", "n_events"))
    assert got == [(t(2024, 1, 1), 1)]  # closed window only, without the late row


def test_window_key_independent_of_session_time_zone(spark):
    from oracle_compare import compare, duck

    import __spark_entry__ as entry

    key = "spark.sql.session.timeZone"
    old = spark.conf.get(key)
    spark.conf.set(key, "America/Los_Angeles")
    try:
        r = compare(spark, duck(SF_SMALL), "stream_window_counts", entry.queries()["stream_window_counts"],
                    entry.oracle_sql()["stream_window_counts"], SF_SMALL)
    finally:
        spark.conf.set(key, old)
    assert r["status"] == "ok", r


def test_dedup_stream_drops_pages_behind_the_watermark(spark, scratch):
    import json

    from test_feed import obj, page

    landing = os.path.join(scratch, "late-pages")
    os.makedirs(landing)
    pages = [
        page({"2030-01-01": [obj(1, "a", "2030-01-01")]}),  # on time
        page({"2030-03-01": [obj(2, "b", "2030-03-01")]}),  # jump ahead: watermark -> 2030-02-22
        page({"2030-03-02": [obj(3, "c", "2030-03-02")]}),  # filler: the new watermark takes effect
        page({"2030-01-05": [obj(4, "d", "2030-01-05")]}),  # late: dropped
    ]
    now = time.time()
    for i, p in enumerate(pages):
        path = os.path.join(landing, f"page-{i}.json")
        with open(path, "w") as f:
            f.write(json.dumps(p))
        os.utime(path, (now + i, now + i))
    out, ckpt = os.path.join(scratch, "late-out"), os.path.join(scratch, "late-ckpt")
    q = (
        ingest.dedup_stream(ingest.flat_stream(spark, landing, max_files_per_trigger=1))
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", ckpt)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    dropped = sum(
        op.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for op in p.get("stateOperators", [])
    )
    assert dropped >= 1
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_update_mode_keeps_current_counts_across_batches(spark, scratch):
    src = os.path.join(scratch, "uevents")
    os.makedirs(src)
    t = dt.datetime
    files = [
        [t(2024, 1, 1, 10), t(2024, 1, 1, 12)],
        [t(2024, 1, 1, 13), t(2024, 1, 2, 9)],  # updates an existing window
        [t(2024, 1, 5, 10)],  # jump ahead: watermark -> 2024-01-04 10:00
        [t(2024, 1, 5, 11)],  # filler
        [t(2024, 1, 1, 14), t(2024, 1, 5, 12)],  # first is late and dropped, second updates
    ]
    now = time.time()
    for i, ts in enumerate(files):
        p = os.path.join(src, f"part-{i}.parquet")
        _events_file(p, ts, i * 10)
        os.utime(p, (now + i, now + i))
    out, ckpt = os.path.join(scratch, "uout"), os.path.join(scratch, "uckpt")
    q = windows.run_window_counts(spark, src, out, ckpt, mode="update", max_files_per_trigger=1)
    q.awaitTermination()
    assert q.exception() is None
    got = sorted(rows(windows.read_counts(spark, out).select("window_start", "n_events")))
    assert got == [(t(2024, 1, 1), 3), (t(2024, 1, 2), 1), (t(2024, 1, 5), 3)]


def test_dead_letters_of_the_stream_are_written_once(spark, scratch):
    """A broken page and a bad field end in the rejects once, also after a forced replay of their batch."""
    from test_feed import obj, page

    landing = land(scratch, "dead", PAGE_PLAIN)
    with open(os.path.join(landing, "torn.json"), "w") as f:
        f.write(json.dumps(PAGE_NEXT)[:150] + "\n")
        f.write(json.dumps(page({"2030-01-01": [obj(77, "bad", "01/01/2030"), obj(78, "good", "2030-01-01")]})) + "\n")
    root, ckpt = os.path.join(scratch, "deadt"), os.path.join(scratch, "deadc")

    def run():
        q = ingest.ingest_stream(spark, landing, root, ckpt, max_files_per_trigger=1, strict=False)
        q.awaitTermination()
        assert q.exception() is None
        found = ledger.read_rejects(spark, root)
        return sorted_rows(found.select("route", "element", "bad_fields")), [sorted_rows(t) for t in tables.read_tables(spark, root)]

    first = run()
    assert first[0] == [("page", None, []), ("record", 0, ["close_approach_date"])]
    records = store.record_numbers(spark, root)
    # the stream forgets that its last batch was committed: it comes again
    commits = sorted(int(os.path.basename(p)) for p in glob.glob(os.path.join(ckpt, "commits", "[0-9]*")))
    for name in (str(commits[-1]), f".{commits[-1]}.crc"):
        os.remove(os.path.join(ckpt, "commits", name))
    assert run() == first
    assert store.record_numbers(spark, root) == records
    counts = ledger.read_ledger(spark, root).agg(F.sum("pages"), F.sum("broken_pages"), F.sum("rejected"), F.sum("new")).first()
    assert tuple(counts) == (3, 1, 1, first[1][1].__len__())


def _updates(spark, *rows_):
    schema = "window_start timestamp_ntz, window_end timestamp_ntz, event_type string, n_events bigint, max_value double"
    return spark.createDataFrame([(d, d + dt.timedelta(days=1), e, n, 1.0) for d, e, n in rows_], schema)


def test_window_counts_are_switched_at_once(spark, scratch, monkeypatch):
    t, out = dt.datetime, os.path.join(scratch, "wcounts")
    count = lambda: sorted(rows(windows.read_counts(spark, out).select("window_start", "event_type", "n_events")), key=repr)
    windows.merge_window_counts(spark, out, _updates(spark, (t(2024, 1, 1), "a", 1), (t(2024, 1, 2), "a", 2)), "s", 0)
    want = count()
    # the new days are written, then the record fails: the old counts are read
    real = store.create_new

    def crash(*_args):
        raise RuntimeError("crash")

    monkeypatch.setattr(store, "create_new", crash)
    second = _updates(spark, (t(2024, 1, 2), "a", 5), (t(2024, 1, 2), "b", 1), (t(2024, 1, 3), None, 7))
    with pytest.raises(RuntimeError, match="crash"):
        windows.merge_window_counts(spark, out, second, "s", 1)
    monkeypatch.setattr(store, "create_new", real)
    assert len(os.listdir(os.path.join(out, "counts"))) == 2 and count() == want
    # the epoch comes again, and once more: it counts once
    for _ in range(2):
        assert windows.merge_window_counts(spark, out, second, "s", 1) == 2
    assert windows.merge_window_counts(spark, out, _updates(spark, (t(2024, 1, 1), "a", 99)), "s", 0) == 2
    key = lambda r: repr(r)
    assert sorted(count(), key=key) == sorted(
        [(t(2024, 1, 1), "a", 1), (t(2024, 1, 2), "a", 5), (t(2024, 1, 2), "b", 1), (t(2024, 1, 3), None, 7)], key=key
    )
    removed = windows.retain_counts(spark, out, grace_seconds=-5)
    assert removed and len(count()) == 4
    assert windows.retain_counts(spark, out, grace_seconds=-5) == []


@pytest.mark.parametrize("strict", [True, False])
def test_stream_that_keeps_one_version_holds_the_same_rows(spark, scratch, strict):
    landing = land(scratch, "landing", PAGE_PLAIN, PAGE_NEXT, PAGE_MULTI)
    left = {}
    for keep in (None, 1):
        root = os.path.join(scratch, f"t{keep}")
        ingest.ingest_stream(spark, landing, root, f"{root}-c", 1, strict=strict, keep=keep).awaitTermination()
        left[keep] = [sorted_rows(t) for t in tables.read_tables(spark, root)]
        assert len(store.record_numbers(spark, root)) == (3 if keep is None else 1)
        assert len(store.names(spark, f"{root}/asteroids")) == (3 if keep is None else 1)
    assert left[None] == left[1] and left[1][1]
