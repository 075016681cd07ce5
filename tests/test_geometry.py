"""Geometry functions against known values."""

import pytest
from pyspark.sql import functions as F

from lodestar.functions import geometry as geo


def one(spark, value):
    return spark.range(1).select(value.alias("v")).first().v


def test_geodesic_distance(spark):
    london, paris = geo.xyz(-0.1278, 51.5074), geo.xyz(2.3522, 48.8566)
    assert one(spark, geo.geodesic(london, paris)) == pytest.approx(343923.12, abs=0.01)
    assert one(spark, geo.geodesic(london, london)) == pytest.approx(0.0, abs=1e-6)


def test_distance_kinds_of_circles(spark):
    a, b = geo.circle(0, 0, 1), geo.circle(10, 0, 2)
    assert [one(spark, geo.distance(a, b, k)) for k in ("center", "min", "max")] == [10.0, 7.0, 13.0]


def test_known_types_and_types_of_columns_agree(spark):
    p, c = geo.point(1, 1), geo.circle(0, 0, 2)
    df = spark.range(1).select(p.alias("p"), c.alias("c"))
    assert df.select(geo.within("p", "c").alias("v")).first().v is one(spark, geo.within(p, c)) is True


def test_interpolate_and_substring(spark):
    g = geo.linestring(F.array(geo.xyz(0, 0), geo.xyz(4, 0), geo.xyz(4, 4)))
    at = one(spark, geo.center(geo.interpolate(g, 0.75)))
    assert (at.x, at.y) == (4.0, 2.0)
    assert one(spark, geo.linelength(geo.linesubstring(g, 0.25, 0.75))) == pytest.approx(4.0)
