"""Every page and approach of a landing is stored, a duplicate, or a dead letter."""

import json
import os

import pytest
from fixtures import rows
from pyspark.sql import functions as F
from test_feed import obj, page

from perigee.sources import feed, ledger, store, tables


def approach(day, v="1.5"):
    return {
        "close_approach_date": day,
        "relative_velocity": {"kilometers_per_hour": v},
        "miss_distance": {"astronomical": "0.1", "lunar": "38.9", "kilometers": "100"},
        "orbiting_body": "Earth",
    }


def thing(i, *approaches):
    return {"id": i, "neo_reference_id": i, "name": f"n{i}", "absolute_magnitude_h": 1.0, "close_approach_data": list(approaches)}


def landing(scratch, name, *lines):
    path = os.path.join(scratch, name)
    os.makedirs(path)
    with open(os.path.join(path, "pages.json"), "w") as f:
        f.writelines((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines)
    return path


SOILED = (
    page({"2030-01-01": [
        thing("1", approach("2030-01-01"), approach("01/02/2030"), approach("2030-01-03", "fast")),
        thing("2", approach("2030-01-01"), approach("2030-01-01")),
        thing("x3", approach("2030-01-01")),
        thing("4"),
        thing("x5"),
    ], "2030-01-02": []}),
    page({"2030-01-01": [thing("2", approach("2030-01-01"))]}),
    json.dumps(page({"2030-01-05": [obj(9, "torn", "2030-01-05")]}))[:-30],
    "not json at all",
    json.dumps({"links": {"self": "s", "next": None}, "near_earth_objects": None}),
    page({}),
)


def load(spark, path, root, **how):
    return ledger.load_pages(spark, root, feed.read_pages(spark, path, strict=False), **how)


def test_identity_and_dead_letters(spark, scratch):
    path, root = landing(scratch, "soiled", *SOILED), os.path.join(scratch, "t")
    assert load(spark, path, root) == 1
    (counts,) = [r.asDict() for r in ledger.read_ledger(spark, root).collect()]
    assert counts == {
        "run_no": 1, "pages": 6, "broken_pages": 2, "approaches": 7, "rejected": 4, "bare_objects": 1, "good": 4, "new": 2, "duplicates": 2,
    }
    found = ledger.read_rejects(spark, root)
    got = sorted(rows(found.select("route", "element", "bad_fields")), key=repr)
    assert got == [
        ("page", None, []),
        ("page", None, []),
        ("record", 0, ["id", "neo_reference_id"]),
        ("record", 1, ["close_approach_date"]),
        ("record", 2, ["relative_velocity_kmph"]),
        ("record", None, ["id", "neo_reference_id"]),
    ]
    texts = {r["text"] for r in found.where("route = 'page'").collect()}
    assert texts == {SOILED[2], SOILED[3]}
    again = json.loads(found.where("element = 2").first()["text"])
    assert again["id"] == "1" and again["approach"]["relative_velocity"]["kilometers_per_hour"] == "fast"
    a, c = tables.read_tables(spark, root)
    assert sorted(r["id"] for r in a.collect()) == [1, 2, 4] and sorted(r["neo_reference_id"] for r in c.collect()) == [1, 2]


def test_a_second_landing_adds_its_own(spark, scratch):
    path, root = landing(scratch, "again", *SOILED), os.path.join(scratch, "t2")
    load(spark, path, root)
    load(spark, path, root)
    counts = [(r["new"], r["duplicates"], r["rejected"]) for r in ledger.read_ledger(spark, root).orderBy("run_no").collect()]
    assert counts == [(2, 2, 4), (0, 4, 4)]
    assert ledger.read_rejects(spark, root).count() == 12
    assert ledger.read_rejects(spark, root, run_no=1).count() == 6
    # what was routed as good is not kept; the rejects are, also after retention
    kept = [p for r in os.listdir(os.path.join(root, "landed")) for p in os.listdir(os.path.join(root, "landed", r)) if "=" in p]
    assert set(kept) == {"route=record", "route=page"}
    tables.retain(spark, root, keep=1, grace_seconds=-5)
    assert ledger.read_rejects(spark, root).count() == 12


def test_an_epoch_is_loaded_once(spark, scratch):
    path, root = landing(scratch, "epochs", *SOILED), os.path.join(scratch, "t3")
    assert load(spark, path, root, stream="a", epoch=0) == 1
    assert load(spark, path, root, stream="a", epoch=0) == 1
    assert load(spark, path, root, stream="b", epoch=0) == 2
    assert load(spark, path, root, stream="a", epoch=1) == 3
    assert load(spark, path, root, stream="b", epoch=0) == 3
    assert tables._manifest(spark, root)["streams"] == {"a": 1, "b": 0}


def test_counts_that_do_not_add_up_are_not_committed(spark, scratch, monkeypatch):
    path, root = landing(scratch, "lost", *SOILED), os.path.join(scratch, "t4")
    real = ledger.route
    monkeypatch.setattr(ledger, "route", lambda pages, read=None: real(pages, read).where("NOT (route = 'good' AND element = 1)"))
    with pytest.raises(RuntimeError, match="not committed"):
        load(spark, path, root)
    assert store.newest(spark, root) is None
    monkeypatch.undo()
    assert load(spark, path, root) == 1


def test_an_empty_landing(spark, scratch):
    path, root = landing(scratch, "none"), os.path.join(scratch, "t5")
    assert load(spark, path, root) == 1
    assert ledger.read_rejects(spark, root).count() == 0
    assert [t.count() for t in tables.read_tables(spark, root)] == [0, 0]
    assert rows(ledger.read_ledger(spark, root).select("pages", "good", "new"))[0] == (0, 0, 0)
    assert ledger.route(feed.read_pages(spark, path, strict=False)).select(F.count("page")).first()[0] == 0


def test_rows_that_parse_are_staged_without_their_place(spark, scratch, monkeypatch):
    path, root = landing(scratch, "narrow", *SOILED), os.path.join(scratch, "t6")
    monkeypatch.setattr(ledger.store, "remove", lambda *a: True)
    load(spark, path, root)
    (run,) = os.listdir(os.path.join(root, "landed"))
    routed = spark.read.schema(ledger.ROUTED_SCHEMA).parquet(os.path.join(root, "landed", run))
    staged = routed.where("route IN ('good', 'bare')")
    assert staged.count() == 5 and staged.where("page IS NOT NULL OR day IS NOT NULL OR element IS NOT NULL").count() == 0
    assert routed.where("route = 'record' AND (page IS NULL OR day IS NULL OR bad_fields IS NULL OR text IS NULL)").count() == 0
