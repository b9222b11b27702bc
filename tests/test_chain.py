"""Page chains and missing pages against plain computations."""

import datetime as dt
import random

import pytest
from fixtures import rows

from perigee.sources import chain

D = dt.date
SCHEMA = "links struct<self: string, next: string>"


def pages(spark, links, parts=3):
    return spark.createDataFrame([({"self": a, "next": b},) for a, b in links], SCHEMA).repartition(parts)


def walk(links):
    """Follow each page link by link."""
    nxt = {}
    for a, b in links:
        if a is not None:
            nxt[a] = min((x for x in (nxt.get(a), b) if x is not None), default=None) if a in nxt else b
    out, longest = {}, {}
    for p in nxt:
        seen, at = [], p
        while at in nxt and at not in seen:
            seen.append(at)
            at = nxt[at]
        if at in seen:  # runs into a loop at ``at``
            loop = seen[seen.index(at):]
            out[p] = ["loop", min(loop), seen.index(at), None, None, None]
        else:
            out[p] = ["feed" if at is None else "missing", seen[-1], len(seen) - 1, None, None, at]
            longest[seen[-1]] = max(longest.get(seen[-1], 0), len(seen))
    for v in out.values():
        if v[0] != "loop":
            v[4] = longest[v[1]]
            v[3] = v[4] - v[2]
    return sorted((p, *v) for p, v in out.items())


def got(spark, links):
    df = chain.chains(pages(spark, links))
    assert df.columns == ["page", "ends", "end", "steps", "place", "length", "to_fetch"]
    return sorted(rows(df))


def test_plain_chain_dangling_link_and_loops(spark):
    links = [("a", "b"), ("b", "c"), ("c", None), ("d", "e"), ("e", "gone"), ("x", "y"), ("y", "z"), ("z", "x"), ("t", "y"), ("s", "s"), ("u", "t")]
    found = {r[0]: r[1:] for r in got(spark, links)}
    assert found["a"] == ("feed", "c", 2, 1, 3, None) and found["c"] == ("feed", "c", 0, 3, 3, None)
    assert found["d"] == ("missing", "e", 1, 1, 2, "gone")
    assert found["x"] == ("loop", "x", 0, None, None, None) and found["t"][:3] == ("loop", "x", 1) and found["u"][2] == 2
    assert found["s"] == ("loop", "s", 0, None, None, None)  # a page that names itself
    assert sorted((k, *v) for k, v in found.items()) == walk(links)


@pytest.mark.parametrize("seed", range(4))
def test_random_links(spark, seed):
    rnd = random.Random(seed)
    names = [f"p{i:03d}" for i in range(60)]
    links = [(p, rnd.choice([None, "gone1", "gone2", *names, *names])) for p in names[:50]]
    links += [(links[0][0], "p049"), links[1], (None, "p001")]  # landed again, with another link and the same; without a name
    assert got(spark, links) == walk(links)


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds = 700, []
    real = chain._kept
    monkeypatch.setattr(chain, "_kept", lambda *a: rounds.append(1) or real(*a))
    links = [(f"{i:04d}", f"{i + 1:04d}") for i in range(n)]
    found = got(spark, links)
    assert len(rounds) <= 12 and found == walk(links)


def test_no_pages(spark):
    assert rows(chain.chains(spark.createDataFrame([], SCHEMA))) == []


def link(a, b, p):
    return f"feed?start_date={a}&end_date={b}&page={p}"


def plain_missing(links, start, end, days=7):
    """Day by day and number by number."""
    def parts(x):
        q = dict(y.split("=") for y in x.split("?")[1].split("&"))
        return D.fromisoformat(q["start_date"]), D.fromisoformat(q["end_date"]), int(q.get("page", 0))

    landed, named = {}, {}
    for a, b in links:
        s, e, p = parts(a)
        if s <= end and e >= start:
            landed.setdefault((s, e), set()).add(p)
            if b and parts(b)[:2] == (s, e):
                named.setdefault((s, e), set()).add(parts(b)[2])
    out = []
    for (s, e), have in landed.items():
        for p in range(max(have | named.get((s, e), set())) + 1):
            if p not in have:
                out.append((s, e, p, "gap" if p < max(have) else "next"))
    day, run = start, []
    while day <= end + dt.timedelta(days=1):
        free = day <= end and not any(s <= day <= e for s, e in landed)
        if free:
            run.append(day)
        if run and (not free or len(run) == days):
            out.append((run[0], run[-1], 0, "window"))
            run = []
        day += dt.timedelta(days=1)
    return sorted(out)


def test_half_landed_and_unaligned_windows(spark):
    links = [
        (link("2024-01-03", "2024-01-09", 0), link("2024-01-03", "2024-01-09", 1)),
        (link("2024-01-03", "2024-01-09", 4), link("2024-01-03", "2024-01-09", 5)),  # 1-3 skipped, 5 to come
        (link("2024-01-08", "2024-01-12", 0), link("2024-01-13", "2024-01-19", 0)),  # overlaps, whole
        (link("2024-02-10", "2024-02-16", 0), None),
        (link("2023-11-01", "2023-11-07", 3), None),  # outside what is asked for
    ]
    start, end = D(2024, 1, 1), D(2024, 2, 20)
    found = sorted(rows(chain.missing_pages(pages(spark, links), start, end)))
    assert found == plain_missing(links, start, end)
    assert (D(2024, 1, 3), D(2024, 1, 9), 5, "next") in found and (D(2024, 1, 3), D(2024, 1, 9), 2, "gap") in found
    assert (D(2024, 1, 1), D(2024, 1, 2), 0, "window") in found and (D(2024, 1, 13), D(2024, 1, 19), 0, "window") in found


@pytest.mark.parametrize("seed", range(3))
def test_random_landings(spark, seed):
    rnd = random.Random(seed)
    links = []
    for _ in range(12):
        s = D(2024, 1, 1) + dt.timedelta(days=rnd.randrange(90))
        e, n = s + dt.timedelta(days=rnd.randrange(7)), rnd.randrange(1, 6)
        for p in range(n):
            if rnd.random() < 0.7:
                nxt = link(s, e, p + 1) if p + 1 < n else rnd.choice([None, link(e + dt.timedelta(days=1), e + dt.timedelta(days=7), 0)])
                links.append((link(s, e, p), nxt))
    start, end = D(2024, 1, 5), D(2024, 4, 9)
    assert sorted(rows(chain.missing_pages(pages(spark, links), start, end))) == plain_missing(links, start, end)


def test_nothing_landed(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sorted(rows(chain.missing_pages(empty, D(2024, 1, 1), D(2024, 1, 10)))) == [
        (D(2024, 1, 1), D(2024, 1, 7), 0, "window"),
        (D(2024, 1, 8), D(2024, 1, 10), 0, "window"),
    ]


def test_each_round_removes_its_shuffle_files(spark, scratch, monkeypatch):
    seen, real = [], chain.new_run_dir

    def run_dir(s, purpose):
        seen.append(s.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled"))
        return real(s, purpose)

    monkeypatch.setattr(chain, "new_run_dir", run_dir)
    pages = spark.range(5).selectExpr("struct(string(id) AS self, string(id + 1) AS next) AS links")
    assert chain.chains(pages).count() == 5
    assert len(seen) > 1 and set(seen) == {"true"}
