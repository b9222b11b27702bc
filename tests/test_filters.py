import datetime as dt

import pytest
from fixtures import duck_fixture, frames, rows
from oracle_compare import rows_of

from perigee.operators import catalogue as cat
from perigee.operators.filters import FilterSpec
from perigee.plans.oracle import summary_sql, unbound_catalogue_sql

D = dt.date


def ids(df):
    return sorted({r["id"] for r in df.collect()})


def details(spark, spec):
    a, ca = frames(spark)
    return cat.filtered_details(a, ca, spec)


def test_dashboard_defaults_are_inactive_except_date():
    spec = FilterSpec.from_dashboard(as_of=D(2031, 1, 1))
    assert spec == FilterSpec(date=(D(2000, 1, 1), D(2031, 1, 1)))


def test_sentinel_rule_keeps_limit_when_only_other_end_moves():
    spec = FilterSpec.from_dashboard(as_of=D(2031, 1, 1), velocity=(1000.0, 200000.0))
    assert spec.velocity == (1000.0, 200000.0)  # now active: values above 200000 drop out
    spec = FilterSpec.from_dashboard(as_of=D(2031, 1, 1), au=(0.0, 1.0), magnitude=(0.0, 39.9))
    assert spec.au is None and spec.magnitude == (0.0, 39.9)


def test_inverted_or_missing_date_is_ignored():
    assert FilterSpec.from_dashboard(as_of=D(2031, 1, 1), date_range=(D(2030, 5, 1), D(2030, 1, 1))).date is None
    assert FilterSpec.from_dashboard(as_of=D(2031, 1, 1), date_range=(None, D(2030, 1, 1))).date is None


def test_bad_hazard_choice():
    with pytest.raises(ValueError):
        FilterSpec.from_dashboard(as_of=D(2031, 1, 1), hazardous="maybe")


def test_name_filter_is_case_insensitive_partial_and_keeps_wildcards(spark):
    assert ids(details(spark, FilterSpec(name="GAMMA"))) == [4, 5]
    assert ids(details(spark, FilterSpec(name="alpha"))) == [1, 2]
    assert ids(details(spark, FilterSpec(name="50%"))) == [3]
    # "_" is a one-character wildcard, as in the dashboard's LIKE
    assert ids(details(spark, FilterSpec(name="a_x"))) == [4, 5]


def test_hazard_filter_null_matches_neither(spark):
    assert 4 not in ids(details(spark, FilterSpec(hazardous=True)))
    assert 4 not in ids(details(spark, FilterSpec(hazardous=False)))


def test_range_filters_are_inclusive(spark):
    got = details(spark, FilterSpec(velocity=(20000.0, 50000.0)))
    v = {r["relative_velocity_kmph"] for r in got.collect()}
    assert 20000.0 in v and 50000.0 in v and 19999.99 not in v and 50000.01 not in v
    got = details(spark, FilterSpec(au=(0.0009, 0.05)))
    au = {r["astronomical"] for r in got.collect()}
    assert 0.0009 in au and 0.05 in au and 0.0500001 not in au and 0.0008 not in au
    assert ids(details(spark, FilterSpec(magnitude=(15.5, 15.5)))) == [3, 4]
    assert ids(details(spark, FilterSpec(diameter=(0.12, 0.12)))) == [2]  # tests the minimum diameter


def test_date_and_body_filters(spark):
    got = details(spark, FilterSpec(date=(D(2030, 2, 28), D(2030, 2, 28))))
    assert len(got.collect()) == 2
    assert ids(details(spark, FilterSpec(bodies=("Venus",)))) == [2, 5, 11]
    assert ids(details(spark, FilterSpec(bodies=("Pluto",)))) == []
    both = details(spark, FilterSpec(bodies=("Venus", "Mars")))
    assert {r["orbiting_body"] for r in both.collect()} == {"Venus", "Mars"}


def test_filters_apply_only_to_tables_a_query_reads(spark):
    a, ca = frames(spark)
    asteroid_only = FilterSpec(name="zzz")
    approach_only = FilterSpec(bodies=("Pluto",))
    # q05/q11/q20 read only approaches; q07/q12/q13/q16 only asteroids
    assert rows(cat.q11_monthly_counts(a, ca, asteroid_only)) == rows(cat.q11_monthly_counts(a, ca))
    assert rows(cat.q13_hazard_split(a, ca, approach_only)) == rows(cat.q13_hazard_split(a, ca))
    assert rows(cat.q11_monthly_counts(a, ca, approach_only)) == []
    assert rows(cat.q13_hazard_split(a, ca, asteroid_only)) == []


def test_q01_left_join_with_approach_filter_drops_unmatched(spark):
    a, ca = frames(spark)
    got = dict(rows(cat.q01_approach_count(a, ca, FilterSpec(bodies=("Earth",)))))
    assert "Lonely" not in got and got["6 Alpha"] == 2
    got = dict(rows(cat.q01_approach_count(a, ca, FilterSpec(name="Lonely"))))
    assert got == {"Lonely": 1}


def test_q08_filters_both_uses_of_the_fact(spark):
    a, ca = frames(spark)
    # Only the January and March approaches: Faller still falls, the 6 Alpha ids do not.
    spec = FilterSpec(date=(D(2030, 1, 1), D(2030, 1, 31)))
    assert {r[0] for r in rows(cat.q08b_getting_nearer_objects(a, ca, spec))} == set()
    spec = FilterSpec(bodies=("Earth",))
    assert {r[0] for r in rows(cat.q08b_getting_nearer_objects(a, ca, spec))} == {1, 9}


SPECS = [
    FilterSpec(name="a", hazardous=False),
    FilterSpec(velocity=(20000.0, 60000.0), au=(0.0, 0.3)),
    FilterSpec(date=(D(2030, 1, 1), D(2030, 6, 30)), bodies=("Earth", "Mars"), magnitude=(15.0, 22.0)),
    FilterSpec(name="6", diameter=(0.1, 0.2), bodies=("Venus",)),
]


@pytest.mark.parametrize("spec_i", range(len(SPECS)))
def test_every_query_under_filters_matches_independent_sql(spark, spec_i):
    spec = SPECS[spec_i]
    a, ca = frames(spark)
    con = duck_fixture()
    sqls = unbound_catalogue_sql(spec, year=2030)
    for key in cat.CATALOGUE:
        params = {"q02_avg_velocity": {"exact_digits": 2}, "q17_unique_in_year": {"year": 2030}}.get(key, {})
        df = cat.filtered_query(key, a, ca, spec, **params)
        res = con.execute(sqls[key])
        cols = [c[0] for c in res.description]
        assert rows_of(df.columns, rows(df), 12) == rows_of(cols, res.fetchall(), 12), key
    res = con.execute(summary_sql(spec, bound=False)).fetchall()
    assert rows(cat.filter_summary(a, ca, spec)) == res


def test_orbiting_bodies(spark):
    a, ca = frames(spark)
    assert rows(cat.orbiting_bodies(a, ca)) == [("Earth",), ("Mars",), ("Venus",)]


def _random_spec(rnd):
    def rng(lo, hi, step):
        a, b = sorted(rnd.choice([lo + step * i for i in range(int((hi - lo) / step) + 1)]) for _ in range(2))
        return (a, b)

    return FilterSpec(
        name=rnd.choice(["", "", "a", "A_", "%", "6 "]),
        hazardous=rnd.choice([None, None, True, False]),
        velocity=rnd.choice([None, rng(0.0, 210000.0, 10000.0), (19999.99, 50000.01)]),
        date=rnd.choice([None, (D(2030, 1, 1), D(2030, 6, 30)), (D(2030, 2, 28), D(2030, 2, 28)),
                         (D(2031, 1, 1), D(2030, 1, 1))]),
        magnitude=rnd.choice([None, rng(10.0, 25.0, 2.5)]),
        diameter=rnd.choice([None, rng(0.0, 1.2, 0.1)]),
        au=rnd.choice([None, rng(0.0, 0.5, 0.05), (0.0009, 0.0009)]),
        bodies=rnd.choice([(), ("Earth",), ("Mars", "Venus"), ("Pluto",)]),
    )


def test_random_filter_combinations_match_independent_sql(spark):
    import random

    rnd = random.Random(11)
    a, ca = frames(spark)
    con = duck_fixture()
    for _ in range(12):
        spec = _random_spec(rnd)
        df = cat.filtered_details(a, ca, spec)
        sql = unbound_catalogue_sql(spec, year=2030)["q00_details"]
        res = con.execute(sql)
        cols = [c[0] for c in res.description]
        assert rows_of(df.columns, rows(df), 12) == rows_of(cols, res.fetchall(), 12), spec
        expected = con.execute(summary_sql(spec, bound=False)).fetchall()
        assert rows(cat.filter_summary(a, ca, spec)) == expected, spec
