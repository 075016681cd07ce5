"""Polygon overlay, triangles, spheres and joins of ranges, against plain answers."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lodestar.functions import geometry as geo
from lodestar.functions import geometry_kernels as kernels
from lodestar.functions import scalar
from lodestar.operators import joins, tables, ticks


def _box(x1, y1, x2, y2):
    return [(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]


def _area(rings):
    return sum(kernels._signed(r) for r in rings)


@pytest.mark.parametrize(
    ("h", "union", "common", "rest"),
    [
        (_box(0, 0, 4, 4), 16, 16, 0),  # itself
        (_box(4, 0, 8, 4), 32, 0, 16),  # a side in common
        (_box(2, 0, 6, 4), 24, 8, 8),  # borders along one another
        (_box(4, 4, 8, 8), 32, 0, 16),  # a corner in common
        (_box(1, 1, 3, 3), 16, 4, 12),  # inside
        (_box(0, 1, 2, 3), 16, 4, 12),  # inside, at a side
        (_box(-1, -1, 5, 5), 36, 16, 0),  # around
        (_box(9, 9, 10, 10), 17, 0, 16),  # apart
        (_box(-1, 1, 5, 2), 18, 4, 12),  # across
    ],
)
def test_overlay_of_squares(h, union, common, rest):
    g = [_box(0, 0, 4, 4)]
    assert [_area(kernels.combine(g, [h], how)) for how in ("union", "intersection", "difference")] == pytest.approx([union, common, rest])


def test_overlay_of_grid_polygons():
    """Unions of random cells, whose borders often meet, against sets of cells."""
    rng = random.Random(3)
    for _ in range(60):
        cells = [{(rng.randrange(4), rng.randrange(4)) for _ in range(5)} for _ in range(2)]
        g, h = ([] for _ in range(2))
        for c in sorted(cells[0]):
            g = kernels.combine(g, [_box(c[0], c[1], c[0] + 1, c[1] + 1)], "union")
        for c in sorted(cells[1]):
            h = kernels.combine(h, [_box(c[0], c[1], c[0] + 1, c[1] + 1)], "union")
        got = [_area(kernels.combine(g, h, how)) for how in ("union", "intersection", "difference")]
        assert got == pytest.approx([len(cells[0] | cells[1]), len(cells[0] & cells[1]), len(cells[0] - cells[1])])


def test_triangles_fill_the_hull_and_have_empty_circles():
    rng = random.Random(5)
    points = [(rng.random(), rng.random()) for _ in range(60)]
    found = kernels.delaunay(points)
    assert sum(kernels._turn(*t) for t in found) / 2 == pytest.approx(kernels._signed(kernels.hull(points)))
    for a, b, c in found:
        x, y, r = kernels.bounding_circle([a, b, c])
        d = 2 * kernels._turn(a, b, c)
        bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
        x, y = a[0] + (cy * (bx**2 + by**2) - by * (cx**2 + cy**2)) / d, a[1] + (bx * (cx**2 + cy**2) - cx * (bx**2 + by**2)) / d
        assert all((p[0] - x) ** 2 + (p[1] - y) ** 2 >= (a[0] - x) ** 2 + (a[1] - y) ** 2 - 1e-9 for p in points)
    cells = kernels.voronoi(points, (0.0, 0.0, 1.0, 1.0))
    assert sum(map(kernels._signed, cells)) == pytest.approx(1.0)


def test_ten_thousand_points_take_seconds():
    rng = random.Random(7)
    start = time.perf_counter()
    assert len(kernels.delaunay([(rng.random(), rng.random()) for _ in range(10_000)])) > 19_000
    assert time.perf_counter() - start < 20


def test_the_smallest_sphere():
    rng = random.Random(9)
    for _ in range(20):
        points = [tuple(rng.gauss(0, 1) for _ in range(3)) for _ in range(12)]
        x, y, z, r = kernels.bounding_sphere(points)
        far = lambda c: max(sum((a - b) ** 2 for a, b in zip(c, p, strict=True)) ** 0.5 for p in points)
        assert far((x, y, z)) == pytest.approx(r)
        assert all(far((x + dx, y + dy, z + dz)) >= r - 1e-9 for dx in (-0.01, 0.01) for dy in (-0.01, 0.01) for dz in (-0.01, 0.01))


def test_a_concave_outline(spark):
    shape = [(x, y) for x in range(6) for y in range(6) if x < 2 or y < 2]
    df = spark.range(1).select(geo.multipoint(F.array(*[geo.xyz(*p) for p in shape])).alias("g"))
    made = kernels.with_shapes(df, o=kernels.concavehull("g", 1.5)).select(geo.area("o").alias("o"), geo.area(geo.convexhull("g")).alias("h")).first()
    assert made.o == pytest.approx(9.5) and made.h > made.o


def test_long_and_short_ranges_overlap(spark):
    rng = random.Random(2)
    spans = lambda n: [(k, a, a + rng.choice([0.5, 3.0, 50.0, 5_000.0])) for k in range(n) for a in [rng.uniform(-100, 100)]]
    a, b = spans(60), spans(60)
    got = joins.overlap_join(spark.createDataFrame(a, "i int, a double, b double"), spark.createDataFrame(b, "j int, c double, d double"), "a", "b", "c", "d", 1.0)
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((i, j) for i, p, q in a for j, r, s in b if q > r and s > p)


def test_cut_rings_are_closed(spark):
    text = spark.range(1).select(geo.geojson(geo.circle(0, 0, 1), 5).alias("t")).first().t
    points = text[text.index("[[[") + 3 : text.index("]]]")].split("],[")
    assert len(points) == 5 and points[0] == points[-1]


def test_a_final_newline_is_part_of_a_string(spark):
    assert spark.createDataFrame([("abc\n",), ("abc",)], "s string").select(scalar.match("s", "abc")).collect() == [(False,), (True,)]


def test_declarations_are_checked(spark):
    with pytest.raises(ValueError):
        ticks.parse_timeseries("7m:1d")
    with pytest.raises(ValueError):
        ticks.TimeSeries().set_retention("5m", "1d")
    one = spark.range(1)
    for change in (lambda s: tables.update(one, s, F.lit(True), x=1), lambda s: tables.delete(one, s, F.lit(True))):
        with pytest.raises(ValueError):
            change(tables.TableSpec(["id"], append_only=True))
