import datetime as dt
import json
import os

import pytest
from conftest import SF_SMALL
from fixtures import rows
from pyspark.sql import functions as F

from perigee.schemas import FLAT_COLUMNS
from perigee.plans import landing
from perigee.sources import binding, feed, tables

D = dt.date


def obj(i, name, day, v="50000.0", au="0.05", lunar="19.4585", km="7479893.535", body="Earth", approaches=None,
        miss=True):
    ap = {
        "close_approach_date": day,
        "relative_velocity": {"kilometers_per_hour": v},
        "orbiting_body": body,
    }
    if miss:
        ap["miss_distance"] = {"astronomical": au, "lunar": lunar, "kilometers": km}
    return {
        "id": str(i),
        "neo_reference_id": str(i),
        "name": name,
        "absolute_magnitude_h": 21.5,
        "estimated_diameter": {"kilometers": {"estimated_diameter_min": 0.13, "estimated_diameter_max": 0.29}},
        "is_potentially_hazardous_asteroid": False,
        "close_approach_data": [ap] if approaches is None else approaches,
    }


def page(days, nxt="next"):
    return {"links": {"next": nxt, "self": "self"}, "near_earth_objects": days}


PAGE_PLAIN = page(
    {
        "2030-01-01": [obj(101, "6 alpha", "2030-01-01"), obj(102, "beta", "2030-01-01", v="60000.5")],
        "2030-01-02": [obj(103, "gamma", "2030-01-02", au="0.001")],
    }
)
PAGE_NEXT = page({"2030-01-08": [obj(101, "6 alpha", "2030-01-08", au="0.04")]})
PAGE_MULTI = page(
    {
        "2030-02-01": [
            obj(
                201,
                "multi",
                "2030-02-01",
                approaches=[
                    {"close_approach_date": "2030-02-01", "relative_velocity": {"kilometers_per_hour": "1.5"},
                     "miss_distance": {"astronomical": "0.1", "lunar": "38.9", "kilometers": "1.0"},
                     "orbiting_body": "Earth"},
                    {"close_approach_date": "2031-02-01", "relative_velocity": {"kilometers_per_hour": "2.5"},
                     "miss_distance": {"astronomical": "0.2", "lunar": "77.8", "kilometers": "2.0"},
                     "orbiting_body": "Mars"},
                ],
            )
        ]
    }
)
PAGE_EMPTY_DAY = page({"2030-03-01": [], "2030-03-02": [obj(301, "x", "2030-03-02")]})
PAGE_BAD_NUMBER = page({"2030-04-01": [obj(401, "bad", "2030-04-01", v="n/a")]})
PAGE_BAD_DATE = page({"2030-04-02": [obj(402, "bad date", "2030-13-01")]})
PAGE_MISSING_KEY = page({"2030-05-01": [obj(501, "no distance", "2030-05-01", miss=False)]})
PAGE_NO_APPROACH = page({"2030-06-01": [obj(601, "none", "2030-06-01", approaches=[])]})


def land(scratch, name, *pages, pretty=False):
    path = os.path.join(scratch, name)
    os.makedirs(path, exist_ok=True)
    for i, p in enumerate(pages):
        with open(os.path.join(path, f"page-{i}.json"), "w") as f:
            f.write(json.dumps(p, indent=2) if pretty else json.dumps(p))
    return path


def objects(spark, path, strict=True):
    return feed.explode_objects(feed.explode_days(feed.read_pages(spark, path, strict=strict)))


def test_plain_and_next_pages(spark, scratch):
    flat = feed.read_flat(spark, land(scratch, "p", PAGE_PLAIN, PAGE_NEXT))
    assert flat.columns == FLAT_COLUMNS
    assert flat.count() == 4
    assert tables.load_asteroids(flat).count() == 3  # 101 repeated -> one dimension row
    assert tables.load_close_approach(flat).count() == 4
    r = flat.where("id = 102").first()
    assert r["relative_velocity_kmph"] == 60000.5 and r["close_approach_date"] == D(2030, 1, 1)
    assert r["miss_distance_km"] == 7479893.535 and r["astronomical"] == 0.05


def test_repeated_page_adds_nothing(spark, scratch):
    root = os.path.join(scratch, "tables")
    for p in (PAGE_PLAIN, PAGE_NEXT, PAGE_PLAIN):
        tables.upsert(spark, root, feed.read_flat(spark, land(scratch, f"r{id(p)}", p)))
    a, c = tables.read_tables(spark, root)
    assert a.count() == 3 and c.count() == 4
    tables.upsert(spark, root, feed.read_flat(spark, land(scratch, "all", PAGE_PLAIN, PAGE_NEXT)))
    a, c = tables.read_tables(spark, root)
    assert a.count() == 3 and c.count() == 4


def test_first_approach_only_vs_all(spark, scratch):
    objs = objects(spark, land(scratch, "m", PAGE_MULTI))
    assert feed.flatten(objs).count() == 1
    every = feed.flatten_all_approaches(objs)
    assert sorted(r["close_approach_date"] for r in every.collect()) == [D(2030, 2, 1), D(2031, 2, 1)]


def test_empty_day(spark, scratch):
    path = land(scratch, "e", PAGE_EMPTY_DAY)
    days = feed.explode_days(feed.read_pages(spark, path))
    assert days.count() == 2
    assert [r["day"] for r in feed.explode_objects(days).collect()] == ["2030-03-02"]


@pytest.mark.parametrize("bad, field", [(PAGE_BAD_NUMBER, "relative_velocity_kmph"), (PAGE_BAD_DATE,
                                                                                    "close_approach_date")])
def test_malformed_values_strict_and_tolerant(spark, scratch, bad, field):
    path = land(scratch, "b", bad)
    with pytest.raises(Exception):
        feed.read_flat(spark, path).collect()
    tolerant = feed.flatten(objects(spark, path, strict=False), strict=False).collect()
    assert len(tolerant) == 1 and tolerant[0][field] is None
    rej = feed.rejects(objects(spark, path, strict=False)).collect()
    assert len(rej) == 1 and rej[0]["bad_fields"] == [field]


def test_missing_key_gives_null_distances(spark, scratch):
    r = feed.read_flat(spark, land(scratch, "k", PAGE_MISSING_KEY)).first()
    assert r["astronomical"] is None and r["miss_distance_km"] is None and r["relative_velocity_kmph"] == 50000.0


def test_object_without_approach(spark, scratch):
    path = land(scratch, "n", PAGE_NO_APPROACH)
    flat = feed.read_flat(spark, path)
    r = flat.first()
    assert r["id"] == 601 and r["close_approach_date"] is None and r["orbiting_body"] is None
    assert tables.load_close_approach(flat).count() == 0
    assert tables.load_asteroids(flat).count() == 1
    assert feed.read_flat(spark, path, all_approaches=True).count() == 1


def test_multiline_documents(spark, scratch):
    path = land(scratch, "pretty", PAGE_PLAIN, pretty=True)
    pages = feed.read_pages(spark, path, multi_line=True)
    assert feed.flatten(feed.explode_objects(feed.explode_days(pages))).count() == 3


def test_windows_and_missing_windows(spark, scratch):
    w = rows(feed.plan_windows(spark, D(2024, 1, 1), D(2024, 1, 20)).orderBy("window_start"))
    assert w == [(D(2024, 1, 1), D(2024, 1, 7)), (D(2024, 1, 8), D(2024, 1, 14)), (D(2024, 1, 15), D(2024, 1, 20))]
    landed = spark.createDataFrame(
        [({"self": "feed?start_date=2024-01-08&end_date=2024-01-14&page=0", "next": None},)],
        "links struct<self:string,next:string>",
    )
    missing = rows(feed.missing_windows(feed.plan_windows(spark, D(2024, 1, 1), D(2024, 1, 20)), landed))
    assert sorted(m[0] for m in missing) == [D(2024, 1, 1), D(2024, 1, 15)]
    assert rows(spark.range(1).select(feed.window_start(F.lit(D(2023, 12, 31))))) == [(D(2023, 12, 25),)]


def test_round_trip_through_pages_is_exact(spark, scratch):
    a, ca = binding.bind(spark, SF_SMALL)
    ca_keyed = binding.approaches_from_lineitem(binding.table(spark, SF_SMALL, "lineitem"), keep_part=True)
    path = landing.land_pages(landing.build_pages(a, ca_keyed, page_size=100), os.path.join(scratch, "rt"))
    flat = feed.read_flat(spark, path, all_approaches=True)
    expected = a.join(ca, a["id"] == ca["neo_reference_id"]).select(
        "id", F.col("id").alias("neo_reference_id"), *FLAT_COLUMNS[2:]
    )
    assert flat.count() == expected.count()
    assert flat.exceptAll(expected).count() == 0 and expected.exceptAll(flat).count() == 0
    # records with several approaches are landed, so the first alone are fewer
    assert feed.read_flat(spark, path, all_approaches=False).count() < flat.count()


def test_pages_have_bounded_size_and_valid_links(spark, scratch):
    a, ca = binding.bind(spark, SF_SMALL)
    pages = landing.build_pages(a, ca, page_size=20)
    sizes = pages.select(
        F.aggregate(F.map_values("near_earth_objects"), F.lit(0), lambda acc, x: acc + F.size(x)).alias("n"),
        "links",
    )
    stats = sizes.agg(F.max("n").alias("mx"), F.sum("n").alias("tot"), F.count(F.lit(1)).alias("pages")).first()
    assert stats["tot"] == ca.select("neo_reference_id", "close_approach_date").distinct().count()
    assert stats["mx"] <= 3 * 20
    # every "next" link names a page that exists, except after the last window
    selfs = sizes.select(F.col("links.self").alias("link"))
    nexts = sizes.select(F.col("links.next").alias("link"))
    dangling = nexts.join(selfs, "link", "left_anti").count()
    assert dangling == 1


def test_limit_rows_total_order(spark, scratch):
    flat = feed.read_flat(spark, land(scratch, "l", PAGE_PLAIN, PAGE_NEXT))
    got = [(r["close_approach_date"], r["id"]) for r in feed.limit_rows(flat, 3).collect()]
    assert got == [(D(2030, 1, 1), 101), (D(2030, 1, 1), 102), (D(2030, 1, 2), 103)]
    assert feed.limit_rows(flat, 10).count() == 4


def test_audit(spark, scratch):
    flat = feed.read_flat(spark, land(scratch, "au", PAGE_PLAIN, PAGE_NEXT, PAGE_MISSING_KEY))
    got = {r["window_start"]: r for r in feed.audit(flat).collect()}
    assert got[D(2029, 12, 31)]["n_records"] == 3
    assert got[D(2029, 12, 31)]["n_objects"] == 3 and got[D(2029, 12, 31)]["n_days"] == 2
    assert got[D(2030, 4, 29)]["null_au"] == 1


def test_audit_pages(spark, scratch):
    p1 = dict(PAGE_PLAIN, links={"self": "p1", "next": "p2"})
    p2 = dict(PAGE_BAD_NUMBER, links={"self": "p2", "next": None})
    objs = objects(spark, land(scratch, "ap", p1, p2), strict=False)
    got = {r["page"]: r for r in feed.audit_pages(objs).collect()}
    assert got["p1"]["n_records"] == 3 and got["p1"]["rejected"] == 0 and got["p1"]["n_objects"] == 3
    assert got["p2"]["rejected"] == 1 and got["p2"]["null_velocity"] == 1


def _page(objects_by_day, link="feed?start_date=2030-01-01&end_date=2030-01-07&page=0"):
    return {"links": {"self": link, "next": link}, "near_earth_objects": objects_by_day}


def _approach(day, v="1.5", au="0.1"):
    return {
        "close_approach_date": day,
        "relative_velocity": {"kilometers_per_hour": v},
        "miss_distance": {"astronomical": au, "lunar": "1", "kilometers": "2"},
        "orbiting_body": "Earth",
    }


def _object(i, *approaches):
    return {
        "id": str(i), "neo_reference_id": str(i), "name": f"o{i}", "absolute_magnitude_h": 1.0,
        "estimated_diameter": {"kilometers": {"estimated_diameter_min": 0.1, "estimated_diameter_max": 0.2}},
        "is_potentially_hazardous_asteroid": False, "close_approach_data": list(approaches),
    }


def test_rows_read_are_stored_or_counted(spark, scratch):
    """Approaches after the first, unreadable values in any element and broken pages: none is lost."""
    import json

    good = _page({"2030-01-01": [
        _object(1, _approach("2030-01-01"), _approach("2030-01-02", v="x")),
        _object(2, _approach("soon"), _approach("later", au="0.2")),
        _object(3),
    ]})
    os.makedirs(f"{scratch}/mixed")
    with open(f"{scratch}/mixed/p.json", "w") as f:
        f.write(json.dumps(good) + "\n" + '{"links": {"self": "broken"\n')
    pages = feed.read_pages(spark, f"{scratch}/mixed", strict=False)
    assert pages.count() == 2
    corrupt = feed.corrupt_pages(pages).collect()
    assert len(corrupt) == 1 and "broken" in corrupt[0]["text"]
    objs = feed.explode_objects(feed.explode_days(pages))
    bad = {(r["obj"]["id"], r["element"]): r["bad_fields"] for r in feed.rejects(objs).collect()}
    assert bad == {
        ("1", 1): ["relative_velocity_kmph"], ("2", 0): ["close_approach_date"], ("2", 1): ["close_approach_date"],
    }
    flat = feed.flatten_all_approaches(objs, strict=False)
    assert flat.count() == 5
    fact = tables.load_close_approach(flat).collect()
    # both undated approaches of object 2 stay: a NULL in the key is no identity
    assert sorted((r["neo_reference_id"], r["astronomical"]) for r in fact) == [(1, 0.1), (1, 0.1), (2, 0.1), (2, 0.2)]
    with pytest.raises(Exception):
        feed.read_pages(spark, f"{scratch}/mixed").collect()


def test_equal_rows_with_a_null_key_become_one(spark):
    from perigee.operators.dedup import APPROACH_ORDER, dedup_by_key
    from perigee.schemas import CLOSE_APPROACH_SCHEMA

    a, b = (1, None, 1.0, 0.1, 2.0, 3.0, "Earth"), (1, None, 9.0, 0.1, 2.0, 3.0, "Earth")
    df = spark.createDataFrame([a, a, b, (1, D(2030, 1, 1), 1.0, 0.3, None, None, "Mars"), (1, D(2030, 1, 1), 2.0, 0.2, None, None, None)],
                               CLOSE_APPROACH_SCHEMA)
    got = dedup_by_key(df, ["neo_reference_id", "close_approach_date"], APPROACH_ORDER).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([a, b, (1, D(2030, 1, 1), 2.0, 0.2, None, None, None)], key=str)


def test_tolerant_stream_stores_every_approach(spark, scratch):
    import json

    from perigee.streaming import ingest

    page = _page({"2030-01-01": [_object(1, _approach("2030-01-01"), _approach("2030-01-02"), _approach("bad"))]})
    os.makedirs(f"{scratch}/in")
    with open(f"{scratch}/in/p.json", "w") as f:
        f.write(json.dumps(page) + "\n{broken\n")
    ingest.ingest_stream(spark, f"{scratch}/in", f"{scratch}/t", f"{scratch}/c", strict=False).awaitTermination()
    _, fact = tables.read_tables(spark, f"{scratch}/t")
    assert sorted(str(r["close_approach_date"]) for r in fact.collect()) == ["2030-01-01", "2030-01-02", "None"]


def test_files_added_to_a_table_are_seen(spark, scratch):
    from perigee.plans.ingest_keys import landed_pages
    from perigee.sources import binding

    for name in ("part", "lineitem"):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        df.limit(50).write.parquet(f"{scratch}/{name}.parquet")
    before = binding.bind(spark, scratch)[1].count()
    first = landed_pages(spark, scratch)
    assert landed_pages(spark, scratch) == first
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(70).write.mode("append").parquet(f"{scratch}/lineitem.parquet")
    assert binding.bind(spark, scratch)[1].count() == before + 70
    assert landed_pages(spark, scratch) != first


def _flat_frame(spark, rows_):
    """Flat rows from (id, day, velocity)."""
    df = spark.createDataFrame(rows_, "id bigint, close_approach_date date, relative_velocity_kmph double")
    types = dict(zip(FLAT_COLUMNS, ["bigint", "bigint", "string", "double", "double", "double", "boolean", "date", *["double"] * 4, "string"]))
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(types[c]).alias(c) for c in FLAT_COLUMNS])


@pytest.mark.parametrize("target", [1, 7, 300, 2000, 4990, 5000, 9000])
def test_limit_cuts_inside_a_hot_day(spark, target):
    """Half of all rows on one day: the merge sees the target and little more, and the rows are the first ones."""
    rows_ = [(i * 17 % 5003, D(2030, 1, 5), float(i)) for i in range(3000)]
    rows_ += [(i, D(2030, 1, 1 + i % 4), 1.0) for i in range(400)] + [(i, D(2030, 2, 1 + i % 20), 2.0) for i in range(1500)]
    rows_ += [(None, D(2030, 1, 5), 5.0)] * 40 + [(3, None, 1.0)] * 50 + [(7, D(2030, 1, 5), float(i)) for i in range(10)]
    flat = _flat_frame(spark, rows_).repartition(6)
    got = [(r["id"], r["close_approach_date"], r["relative_velocity_kmph"]) for r in feed.limit_rows(flat, target).collect()]
    key = lambda r: (r[1] is None, r[1] or D(1, 1, 1), r[0] is None, r[0] or 0, r[2])
    assert sorted(got, key=key) == sorted(rows_, key=key)[:target]
    assert feed.limit_candidates(flat, target).count() <= min(len(rows_), target + 60)


def test_merged_audit_is_near_the_exact_one(spark):
    rows_ = [(i % 4000, D(2030, 1, 1 + (i * 7) % 28), None if i % 9 == 0 else 1.0) for i in range(20_000)]
    flat = _flat_frame(spark, rows_)
    paged = flat.withColumn("page", F.concat(F.lit("p"), F.pmod(F.xxhash64("id", "close_approach_date"), F.lit(13))))
    sketches = feed.audit_sketches(paged)
    exact = {r["window_start"]: r for r in feed.audit(flat).collect()}
    merged = {r["window_start"]: r for r in feed.merged_audit(sketches).collect()}
    assert merged.keys() == exact.keys()
    for w, e in exact.items():
        m = merged[w]
        assert abs(m["n_objects"] - e["n_objects"]) <= 0.03 * e["n_objects"]
        assert all(m[c] == e[c] for c in ("n_records", "n_days", "null_velocity", "null_au", "null_body"))
    assert feed.merged_audit(feed.audit_sketches(paged.limit(0))).count() == 0


def _tables_of(scratch, n_objects, n_rows):
    """A part and a lineitem table of own rows, as files."""
    import pandas as pd

    part = [(i, f"thing {i}", "PROMO" if i % 2 else "PLAIN", i % 40) for i in range(n_objects)]
    pd.DataFrame(part, columns=["p_partkey", "p_name", "p_type", "p_size"]).to_parquet(f"{scratch}/part.parquet")
    line = [
        (i % n_objects, i % 5, i % 7 + 1, 1.0 + i % 50, 100.0 + i, 0.01 * (i % 11), "ANR"[i % 3], pd.Timestamp(D(2020, 1, 1)) + pd.Timedelta(days=i % 90))
        for i in range(n_rows)
    ]
    columns = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"]
    pd.DataFrame(line, columns=columns).astype({"l_linenumber": "int32"}).to_parquet(
        f"{scratch}/lineitem.parquet", coerce_timestamps="us", allow_truncated_timestamps=True
    )
    return scratch


def test_landing_takes_less_disk_than_its_text(spark, scratch):
    from perigee.sources import store

    path = landing.landed(spark, _tables_of(scratch, 50, 5000))
    text = sum(len(r[0]) + 1 for r in spark.read.text(path).collect())
    assert 5 * store.n_bytes(spark, path) < text
    assert not [n for n in store.names(spark, path.rsplit("/", 1)[0]) if n.startswith(path.rsplit("/", 1)[1] + ".")]


def test_landing_in_slices_is_the_same(spark, scratch, monkeypatch):
    folder = _tables_of(scratch, 50, 5000)
    flat = {}
    for page_size in (7, 8):
        whole = landing.build_pages(
            binding.asteroids_from_part(binding.table(spark, folder, "part")),
            binding.approaches_from_lineitem(binding.table(spark, folder, "lineitem"), keep_part=True),
            page_size,
        )
        monkeypatch.setattr(landing, "SLICE_ROWS", 600 if page_size == 7 else 10**9)
        assert len(landing._slices(binding.bind(spark, folder)[1])) == (8 if page_size == 7 else 1)
        pages = feed.read_pages(spark, landing.landed(spark, folder, page_size)).select("links", F.to_json("near_earth_objects").alias("o"))
        sizes = F.length(F.to_json("near_earth_objects"))
        assert sorted(pages.select("links.self", F.length("o")).collect()) == sorted(whole.select("links.self", sizes).collect())
        flat[page_size] = sorted(map(tuple, feed.read_flat(spark, landing.landed(spark, folder, page_size)).collect()), key=str)
    assert flat[7] == flat[8] and len(flat[7]) == 5000


def test_objects_with_one_id_and_rows_without_day_or_object(spark):
    rows = [(1, "a", 1.0, 0.1, 0.2, True), (1, "a", 1.0, 0.1, 0.2, True), (1, "b", 1.0, 0.1, 0.2, None), (None, "c", 1.0, 0.1, 0.2, True)]
    asteroids = spark.createDataFrame(rows, "id bigint, name string, absolute_magnitude_h double, estimated_diameter_min_km double, "
                                      "estimated_diameter_max_km double, is_potentially_hazardous_asteroid boolean")  # fmt: skip
    day, rest = D(2020, 1, 1), (1.0, 0.1, 2.0, 3.0, "Earth")
    approaches = spark.createDataFrame(
        [(1, day, *rest), (1, day, *rest), (1, None, *rest), (2, day, *rest), (None, day, *rest)],
        "neo_reference_id bigint, close_approach_date date, relative_velocity_kmph double, astronomical double, "
        "miss_distance_km double, miss_distance_lunar double, orbiting_body string",
    )
    objects = landing.build_pages(asteroids, approaches).select(F.explode("near_earth_objects")).select(F.explode("value").alias("o"))
    assert sorted((r["o"]["name"], len(r["o"]["close_approach_data"])) for r in objects.collect()) == [("a", 2), ("a", 2), ("b", 2)]


def test_shuffle_files_go_with_their_write(spark, scratch):
    from perigee.session import shuffle_files_removed

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    status = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    there = lambda: status.shuffleStatuses().size()
    n = there()
    with shuffle_files_removed(spark):
        spark.range(1000).groupBy(F.col("id") % 7).count().write.parquet(f"{scratch}/out")
    assert there() == n and spark.conf.get(key) == before
    assert spark.read.parquet(f"{scratch}/out").count() == 7


def test_slices_are_dealt_once_to_files_of_a_known_number(spark, scratch, monkeypatch):
    """A slice's files have about the same number of pages, however small its shuffle partitions would be."""
    from perigee.sources import store

    monkeypatch.setattr(landing, "SLICE_ROWS", 1200)
    monkeypatch.setattr(landing, "RECORDS_A_FILE", 160)
    folder = _tables_of(scratch, 50, 5000)
    scans, real = [], landing.build_pages
    monkeypatch.setattr(landing, "build_pages", lambda a, rows, *more: scans.append(rows.inputFiles()) or real(a, rows, *more))
    path = landing.landed(spark, folder, 10)
    slices = landing._slices(binding.bind(spark, folder)[1])
    assert len(slices) == len(scans) == 4 and sum(n for _, _, n in slices) == 5000
    assert not any("lineitem" in f for files in scans for f in files)  # not the whole table for each slice
    files = [f for f in store.names(spark, path) if f.endswith(".gz")]
    assert len(files) == sum(map(landing._n_files, (n for _, _, n in slices))) == 34
    pages = feed.read_pages(spark, path).groupBy(F.col("_metadata.file_name")).count()
    few, many = pages.agg(F.min("count"), F.max("count")).first()
    assert pages.count() == 34 and many <= 2 * few


def test_unreadable_fields_in_generated_code(spark):
    """No lambda and no array function takes the parsing of an approach out of the generated code."""
    from pyspark.sql import Row

    names = {"id": "1", "neo_reference_id": "x", "close_approach_date": "01/02/2030", "kmph": "5 km/h", "au": None, "km": "1e3", "lunar": ""}
    df = spark.createDataFrame([Row(**names), Row(**{k: None for k in names}), Row(**(names | {"id": "y"}))], "id string, neo_reference_id string, close_approach_date string, kmph string, au string, km string, lunar string")
    obj = F.struct("id", "neo_reference_id")
    ap = F.struct(
        "close_approach_date", F.struct(F.col("kmph").alias("kilometers_per_hour")).alias("relative_velocity"),
        F.struct(F.col("au").alias("astronomical"), F.col("km").alias("kilometers"), F.col("lunar").alias("lunar")).alias("miss_distance"),
    )
    out = df.select(feed.unreadable(obj, ap).alias("bad"))
    rest = ["neo_reference_id", "close_approach_date", "relative_velocity_kmph", "miss_distance_lunar"]
    assert [r["bad"] for r in out.collect()] == [rest, [], ["id", *rest]]
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
