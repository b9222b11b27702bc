"""perigee: close-approach analytics as Spark DataFrame plans.

Two tables carry the data model:

* ``asteroids`` (dimension, one row per ``id``)
* ``close_approach`` (fact, one row per approach, ``neo_reference_id`` -> ``asteroids.id``)

Every operator takes and returns DataFrames; nothing is collected to the driver.
"""

from perigee.operators import catalogue
from perigee.operators.filters import FilterSpec
from perigee.sources import feed, tables

__all__ = ["FilterSpec", "catalogue", "feed", "tables"]
