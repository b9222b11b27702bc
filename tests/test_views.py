from fixtures import frames, rows

from perigee.operators import catalogue as cat
from perigee.operators.filters import FilterSpec
from perigee.plans.views import register_views


def test_views_answer_like_the_functions(spark):
    a, ca = frames(spark)
    names = register_views(a, ca, prefix="v_")
    assert "v_q09_closest_approach" in names and "v_asteroids" in names
    got = rows(spark.sql("SELECT asteroid_name FROM v_q08_getting_nearer"))
    assert got == [("6 Alpha",)]
    got = spark.sql("SELECT count(*) FROM v_q00_details").first()[0]
    assert got == cat.q00_details(a, ca).count()
    got = rows(spark.sql("SELECT * FROM v_q09_closest_approach WHERE closest_astronomical_distance < 0.001"))
    assert sorted(r[0] for r in got) == ["Beta 50%", "Delta", "gamma_x"]


def test_views_under_filters(spark):
    a, ca = frames(spark)
    register_views(a, ca, FilterSpec(bodies=("Venus",)), prefix="f_")
    assert rows(spark.sql("SELECT * FROM f_filter_summary")) == [(3,)]
    assert rows(spark.sql("SELECT * FROM f_orbiting_bodies")) == [("Earth",), ("Mars",), ("Venus",)]
