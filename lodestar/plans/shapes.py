"""Queries of shapes with known answers: relations, parts, changes, hulls, overlays and points along lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import geometry as geo
from lodestar.functions import geometry_kernels as kernels
from lodestar.functions import line_kernels as along
from lodestar.plans.registry import register
from lodestar.plans.spatial import _LINES, _S, _items, _lines, _suppliers


def _r(c, n=6):
    return F.round(c, n)


def _polygons(c):
    """A column that has polygons only."""
    return geo.known(F.col(c), "multipolygon")


def _x(g):
    return geo.center(g)["x"]


def _y(g):
    return geo.center(g)["y"]


@register(
    "geo_relations",
    f"""SELECT id, abs(x - 25) < 12 AND abs(y - 40) < 20 AS contains, abs(x - 25) <= 12 AND abs(y - 40) <= 20 AS covers, abs(x - 25) + a <= 12 AND abs(y - 40) + b <= 20 AS covers_shape,
        NOT (abs(x - 25) <= 12 + a AND abs(y - 40) <= 20 + b) AS apart, power(x - 25, 2) + power(y - 40, 2) > power(10 + a, 2) AS circles_apart FROM {_S}""",
)
def geo_relations(spark, sf):
    p, own, fixed = geo.point("x", "y"), geo.rectangle("x", "y", "a", "b"), geo.rectangle(25, 40, 12, 20)
    return _suppliers(spark, sf).select(
        "id", geo.contain(fixed, p).alias("contains"), geo.cover(fixed, p).alias("covers"), geo.cover(fixed, own).alias("covers_shape"), geo.disjoint(fixed, own).alias("apart"),
        geo.disjoint(geo.circle(25, 40, 10), geo.circle("x", "y", "a")).alias("circles_apart"))


@register(
    "geo_sides",
    f"""SELECT id, n / 2.0 AS on_left, m / 2.0 AS on_right, n = 2 AS all_left, m = 2 AS all_right, round(degrees(acos((a + 2 * b) / (sqrt(a * a + b * b) * sqrt(5)))), 4) AS angle
        FROM (SELECT *, (50 * y - 100 * x > 1e-9)::INT + (50 * (y + b) - 100 * (x + a) > 1e-9)::INT AS n, (50 * y - 100 * x < -1e-9)::INT + (50 * (y + b) - 100 * (x + a) < -1e-9)::INT AS m FROM {_S})""",
)
def geo_sides(spark, sf):
    own = geo.line(geo.xyz("x", "y"), geo.xyz(F.col("x") + F.col("a"), F.col("y") + F.col("b")))
    axis = geo.line(geo.xyz(0, 0), geo.xyz(50, 100))
    return _suppliers(spark, sf).select(
        "id", geo.leftratio(own, axis).alias("on_left"), geo.rightratio(own, axis).alias("on_right"), geo.isonleft(own, axis).alias("all_left"), geo.isonright(own, axis).alias("all_right"),
        _r(geo.angle(own, axis), 4).alias("angle"))


@register(
    "geo_space",
    f"""SELECT id, a - 3 AS z1, a + 3 AS z2, a - b / 2 AS cylinder_z1, a + b / 2 AS cylinder_z2, x AS first_x, x + a AS last_x, y - b AS low_y, y AS high_y, a AS low_z, a + b AS high_z,
        3 AS dim, abs(x - 25) < 12 AND abs(y - 40) < 20 AND a < 5 AS in_box FROM {_S}""",
)
def geo_space(spark, sf):
    box, cylinder = geo.box("x", "y", "a", "a", "b", 3), geo.cylinder("x", "y", "a", "a", "b")
    line = geo.line(geo.xyz("x", "y", "a"), geo.xyz(F.col("x") + F.col("a"), F.col("y") - F.col("b"), F.col("a") + F.col("b")), dim=3)
    return _suppliers(spark, sf).select(
        "id", geo.zmin(box).alias("z1"), geo.zmax(box).alias("z2"), geo.zmin(cylinder).alias("cylinder_z1"), geo.zmax(cylinder).alias("cylinder_z2"),
        _x(geo.xminpoint(line)).alias("first_x"), _x(geo.xmaxpoint(line)).alias("last_x"), _y(geo.yminpoint(line)).alias("low_y"), _y(geo.ymaxpoint(line)).alias("high_y"),
        geo.center(geo.zminpoint(line))["z"].alias("low_z"), geo.center(geo.zmaxpoint(line))["z"].alias("high_z"), geo.dimension(line).alias("dim"),
        geo.within(geo.point("x", "y", "a"), geo.box(25, 40, 0, 12, 20, 5)).alias("in_box"))


def _ring(x, y, a, b, turns=True):
    """A rectangle's closed ring, counter-clockwise or not."""
    corners = [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]
    return F.array(*[geo.xyz(x + a * i, y + b * j) for i, j in (corners if turns else corners[::-1])])


def _with_hole(spark, sf):
    x, y, a, b = (F.col(c) for c in "xyab")
    outer, hole, other = _ring(x, y, 2 * a, 2 * b), _ring(x, y, a, b, False), _ring(x + 100, y, a, b)
    return _suppliers(spark, sf).select("id", geo.polygon(F.array(outer, hole)).alias("p"), geo.multipolygon(F.array(F.array(outer, hole), F.array(other))).alias("m"), geo.polygon(F.array(other)).alias("o"))


@register(
    "geo_rings",
    f"""SELECT id, 2 AS polygons, 3 AS rings, 1 AS inner_rings, 12 * a * b AS area, 16 * a * b AS total, x - 2 * a AS outer_x, x - a AS inner_x, x - a AS second_x, 4 * a * b AS last_area, 2 AS outers, 1 AS inners, 5 AS outer_points,
        'polygon 2 0 10' AS summary FROM {_S}""",
)
def geo_rings(spark, sf):
    return _with_hole(spark, sf).select(
        "id", geo.numpolygons("m").alias("polygons"), geo.numrings("m").alias("rings"), geo.numinnerrings("m").alias("inner_rings"), geo.area("p").alias("area"), geo.area("m").alias("total"),
        geo.xmin(geo.outerring("p")).alias("outer_x"), geo.xmin(geo.innerringn("p", 1)).alias("inner_x"), geo.xmin(geo.ringn("p", 2)).alias("second_x"), geo.area(geo.polygonn("m", 2)).alias("last_area"),
        geo.numlines(geo.outerrings("m")).alias("outers"), geo.numlines(geo.innerrings("m")).alias("inners"), geo.numpoints(geo.outerring("p")).alias("outer_points"), geo.summary("p").alias("summary"))


@register(
    "geo_checks",
    f"""SELECT id, true AS ccw, false AS cw, true AS turned_cw, true AS convex, (id % 2 = 0) AS kite_convex, true AS valid, true AS ring, (id % 2 = 0) AS simple, true AS closed FROM {_S}""",
)
def geo_checks(spark, sf):
    x, y, a, b = (F.col(c) for c in "xyab")
    even = F.col("id") % 2 == 0
    far, near = geo.xyz(x + a, y + b), geo.xyz(x - a * 0.5, y)
    kite = geo.polygon(F.array(F.array(geo.xyz(x, y - b), F.when(even, geo.xyz(x + a, y)).otherwise(near), geo.xyz(x, y + b), geo.xyz(x - a, y), geo.xyz(x, y - b))))
    line = geo.linestring(F.array(geo.xyz(x, y), F.when(even, geo.xyz(x + a, y)).otherwise(far), F.when(even, far).otherwise(geo.xyz(x + a, y)), geo.xyz(x, y + b)))
    df = _with_hole(spark, sf).join(_suppliers(spark, sf).select("id", kite.alias("kite"), line.alias("line")), "id")
    return df.select(
        "id", geo.ispolygonccw("p").alias("ccw"), geo.ispolygoncw("p").alias("cw"), geo.ispolygoncw(geo.reverse("p")).alias("turned_cw"), geo.isconvex("o").alias("convex"), geo.isconvex("kite").alias("kite_convex"),
        geo.isvalid("o").alias("valid"), geo.isring(geo.outerring("p")).alias("ring"), geo.issimple("line").alias("simple"), geo.isclosed(geo.outerring("p")).alias("closed"))


@register(
    "geo_editing",
    f"""SELECT id, 4 AS added, 7::DOUBLE AS new_end, 7::DOUBLE AS second_x, x + a AS third_x, 9::DOUBLE AS set_x, 2 AS left_over, x + a AS removed_x, x + a AS reversed_x, x + a AS point_x, 3 AS without_repeats, 2 AS lines, 6 AS all_points,
        'multipoint' AS kind, 3 AS point_count, 'LINESTRING(' || x::BIGINT || ' 0,' || (x + a)::BIGINT || ' 0,' || (x + a)::BIGINT || ' ' || b::BIGINT || ')' AS wkt,
        'linestring(' || x::BIGINT || ' 0,' || (x + a)::BIGINT || ' 0,' || (x + a)::BIGINT || ' ' || b::BIGINT || ')' AS as_text FROM {_S}""",
)
def geo_editing(spark, sf):
    x, a, b = F.col("x"), F.col("a"), F.col("b")
    df = _suppliers(spark, sf).select("id", "x", "a", "b", geo.linestring(F.array(geo.xyz(x, 0), geo.xyz(x + a, 0), geo.xyz(x + a, b))).alias("g"))
    p = geo.xyz(7, 8)
    return df.select(
        "id", geo.numpoints(geo.addpoint("g", p)).alias("added"), _x(geo.endpoint(geo.addpoint("g", p))).alias("new_end"), _x(geo.pointn(geo.addpoint("g", p, 2), 2)).alias("second_x"), _x(geo.pointn(geo.addpoint("g", p, 2), 3)).alias("third_x"),
        _x(geo.pointn(geo.setpoint("g", geo.xyz(9, 9), 2), 2)).alias("set_x"), geo.numpoints(geo.removepoint("g", 1)).alias("left_over"), _x(geo.startpoint(geo.removepoint("g", 1))).alias("removed_x"),
        _x(geo.startpoint(geo.reverse("g"))).alias("reversed_x"), _x(geo.pointn("g", 2)).alias("point_x"), geo.numpoints(geo.unique(geo.addpoint("g", geo.xyz(x + a, 0), 2))).alias("without_repeats"),
        geo.numlines(geo.collect("g", "g")).alias("lines"), geo.numpoints(geo.collect("g", "g")).alias("all_points"), geo.geotype(geo.tomultipoint("g")).alias("kind"), geo.numpoints(geo.tomultipoint("g")).alias("point_count"),
        geo.wkt("g").alias("wkt"), geo.astext("g").alias("as_text"))


@register(
    "geo_centers",
    f"""SELECT id, round(x + a / 3, 6) AS triangle_x, round(y + b / 3, 6) AS triangle_y, x AS polygon_x, x + a / 2 AS line_x, 0::DOUBLE AS near_x, greatest(0, least(60, y)) AS near_y, round(3 - y, 6) AS turned_x, round(x + 1, 6) AS turned_y,
        round(x + a, 6) AS own_turn_x, (x + 1) * 2 AS ts_x, (y + 2) * 3 AS ts_y, (a + 3) * 4 AS ts_z, 'supplier ' || id || ' seven' AS metrics, id::VARCHAR AS word FROM {_S}""",
)
def geo_centers(spark, sf):
    x, y, a, b = (F.col(c) for c in "xyab")
    triangle = geo.triangle(geo.xyz(x, y), geo.xyz(x + a, y), geo.xyz(x, y + b))
    line, wall = geo.line(geo.xyz(x, y), geo.xyz(x + a, y)), geo.line(geo.xyz(0, 0), geo.xyz(0, 60))
    p, q = geo.point("x", "y"), geo.point("x", "y", "a")
    named = geo.point("x", "y", metrics=F.array(F.concat(F.lit("supplier "), F.col("id").cast("string")), F.lit("seven")))
    turned = geo.rotateat(p, 90, "degree", 1, 2)
    return _suppliers(spark, sf).select(
        "id", _r(_x(geo.centroid(triangle))).alias("triangle_x"), _r(_y(geo.centroid(triangle))).alias("triangle_y"), _r(_x(geo.centroid(geo.topolygon(geo.rectangle("x", "y", "a", "b"))))).alias("polygon_x"),
        _x(geo.centroid(line)).alias("line_x"), _x(geo.closestpoint(geo.xyz("x", "y"), wall)).alias("near_x"), _y(geo.closestpoint(geo.xyz("x", "y"), wall)).alias("near_y"), _r(_x(turned)).alias("turned_x"), _r(_y(turned)).alias("turned_y"),
        _r(_x(geo.startpoint(geo.rotateself(line, 180)))).alias("own_turn_x"), _x(geo.transscale(p, 1, 2, 2, 3)).alias("ts_x"), _y(geo.transscale(p, 1, 2, 2, 3)).alias("ts_y"), geo.center(geo.transscale(q, 1, 2, 3, 2, 3, 4))["z"].alias("ts_z"),
        geo.metricn(named).alias("metrics"), geo.metricn(named, 1, 2).alias("word"))


@register(
    "geo_midpoints",
    f"""WITH s AS (SELECT *, sqrt(power(x - px, 2) + power(y - py, 2)) AS d FROM {_LINES} WHERE px IS NOT NULL), c AS (SELECT *, sum(d) OVER (PARTITION BY id ORDER BY n) AS e, sum(d) OVER (PARTITION BY id) AS total FROM s),
        h AS (SELECT id, arg_min(px + (x - px) * (total / 2 - (e - d)) / d, n) AS mid_x, arg_min(py + (y - py) * (total / 2 - (e - d)) / d, n) AS mid_y FROM c WHERE e >= total / 2 AND d > 0 GROUP BY id),
        k AS (SELECT id, least(count(*), 2) AS near, min(sqrt(power(x - 25, 2) + power(y - 30, 2))) AS nearest FROM {_LINES} GROUP BY id HAVING count(*) > 1)
        SELECT id, round(mid_x, 7) AS mid_x, round(mid_y, 7) AS mid_y, 0.5::DOUBLE AS part, near, round(nearest, 5) AS nearest FROM h JOIN k USING (id)""",
)
def geo_midpoints(spark, sf):
    """Points, parts and neighbours along each order's line."""
    def measures(lines):
        half = along.interpolate(lines, 0.5)
        return {"mid_x": half[0], "mid_y": half[1], "part": along.substring_length(lines, 0.25, 0.75), "total": lines.total, "nearest": along.nearest(lines, 25, 30)}

    made = along.of_items(*_items(spark, sf), measures, "mid_x double, mid_y double, part double, total double, nearest double").where("total > 0").withColumn("near", F.least("points", F.lit(2).cast("long")))
    return made.select("id", _r("mid_x", 7).alias("mid_x"), _r("mid_y", 7).alias("mid_y"), _r(F.col("part") / F.col("total"), 5).alias("part"), "near", _r("nearest", 5).alias("nearest"))


@register("geo_locate", f"SELECT id, round(((id % 10) / 10)::DOUBLE, 6) AS at FROM {_S}")
def geo_locate(spark, sf):
    x, y, a, b, f = F.col("x"), F.col("y"), F.col("a"), F.col("b"), (F.col("id") % 10) / 10.0
    line = geo.line(geo.xyz(x, y), geo.xyz(x + a, y + b))
    return _suppliers(spark, sf).select("id", _r(geo.locatepoint(line, geo.xyz(x + a * f, y + b * f))).alias("at"))


@register(
    "geo_geojson",
    f"""SELECT id, 'linestring' AS line_kind, 2 AS line_points, 'polygon' AS polygon_kind, 4 * a * a AS polygon_area, 'multipolygon' AS multi_kind, 8 * a * a AS multi_area, true AS line_back, true AS multi_back FROM (SELECT *, a AS a_ FROM {_S})""",
)
def geo_geojson(spark, sf):
    x, y, a = F.col("x"), F.lit(0.0), F.col("a")
    line = geo.linestring(F.array(geo.xyz(x, y), geo.xyz(x + a, y + a)))
    multi = geo.multipolygon(F.array(F.array(_ring(x, y, a, a)), F.array(_ring(x + 100, y, a, a))))
    df = _suppliers(spark, sf).select("id", "a", line.alias("line"), multi.alias("multi"), geo.polygon(F.array(_ring(x, y, a, a))).alias("polygon"))
    kinds = {"line": "linestring", "polygon": "polygon", "multi": "multipolygon"}
    read = {c: geo.from_geojson(geo.geojson(geo.known(F.col(c), kind))) for c, kind in kinds.items()}
    df = df.withColumns({f"{c}_read": g for c, g in read.items()})
    return df.select(
        "id", geo.geotype("line_read").alias("line_kind"), geo.numpoints("line_read").alias("line_points"), geo.geotype("polygon_read").alias("polygon_kind"), geo.area("polygon_read").alias("polygon_area"),
        geo.geotype("multi_read").alias("multi_kind"), geo.area("multi_read").alias("multi_area"), geo.same("line_read", "line").alias("line_back"), geo.same("multi_read", "multi").alias("multi_back"))


@register("geo_all_points", f"SELECT CAST(id % 5 AS BIGINT) AS part, count(*)::INT AS points, min(x) AS x1, max(y) AS y2 FROM {_S} GROUP BY 1")
def geo_all_points(spark, sf):
    df = _suppliers(spark, sf).select((F.col("id") % 5).cast("long").alias("part"), geo.point("x", "y").alias("p"))
    made = df.groupBy("part").agg(geo.all_points("p").alias("g"))
    return made.select("part", geo.numpoints("g").alias("points"), geo.xmin("g").alias("x1"), geo.ymax("g").alias("y2"))


@register(
    "geo_constructions",
    f"""SELECT id, 4 * a * b AS hull, round(sqrt(a * a + b * b), 6) AS radius, 4 AS triangles, 4 * a * b AS triangle_area, round(16 * a * b, 6) AS cells, round(sqrt(a * a + b * b + 9), 6) AS sphere, 4 * a * b AS outline,
        round(32 * sin(pi() / 32), 6) AS disc, 4::DOUBLE AS square, round(4 * a * b + 4 * (a + b) + 32 * sin(pi() / 32), 5) AS around, round(4 * (a + 1) * (b + 1), 5) AS mitred, 4 * a AS flat_line FROM {_S}""",
)
def geo_constructions(spark, sf):
    """Hulls, bounding circles and spheres, triangles, cells and buffers of corners and their middle."""
    x, y, a, b = (F.col(c) for c in "xyab")
    corners = [geo.xyz(x + a * i, y + b * j) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1), (0, 0))]
    solid = geo.multipoint(F.array(*[geo.xyz(x + a * i, y + b * j, 3.0 * k) for i in (-1, 1) for j in (-1, 1) for k in (-1, 1)]), dim=3)
    line = geo.line(geo.xyz(x - a, y), geo.xyz(x + a, y))
    df = kernels.spread(_suppliers(spark, sf)).select("id", "a", "b", geo.multipoint(F.array(*corners)).alias("g"), solid.alias("s"), geo.topolygon(geo.rectangle("x", "y", "a", "b")).alias("r"), geo.point("x", "y").alias("p"), line.alias("l"))
    made = kernels.with_shapes(
        df, circle=kernels.minimumboundingcircle("g"), t=kernels.delaunaytriangles("g"), c=kernels.voronoipolygons("g"), sphere=kernels.minimumboundingsphere("s"), o=kernels.concavehull("g", 100.0),
        disc=kernels.buffer("p", 1.0), square=kernels.buffer("p", 1.0, point="square"), around=kernels.buffer("r", 1.0), mitred=kernels.buffer("r", 1.0, join="miter"), flat=kernels.buffer("l", 1.0, right=1.0, end="flat"))
    return made.select(
        "id", geo.area(geo.convexhull(geo.known(F.col("g"), "multipoint"))).alias("hull"), _r(F.col("circle")["params"][0]).alias("radius"), geo.numpolygons(_polygons("t")).alias("triangles"), _r(geo.area(_polygons("t"))).alias("triangle_area"),
        _r(geo.area(_polygons("c"))).alias("cells"), _r(F.col("sphere")["params"][0]).alias("sphere"), _r(geo.area(_polygons("o"))).alias("outline"), _r(geo.area(_polygons("disc"))).alias("disc"), _r(geo.area(_polygons("square"))).alias("square"),
        _r(geo.area(_polygons("around")), 5).alias("around"), _r(geo.area(_polygons("mitred")), 5).alias("mitred"), _r(geo.area(_polygons("flat"))).alias("flat_line"))


@register(
    "geo_hulls",
)
def geo_hulls(spark, sf):
    """Hulls, bounding circles, triangles, cells and their borders of each order's points."""
    df = _lines(spark, sf).where(geo.numpoints("g") > 3)
    bounds = (0.0, 0.0, 60.0, 120.0)
    made = kernels.with_shapes(
        df, circle=kernels.minimumboundingcircle("g"), triangles=kernels.delaunaytriangles("g"), cells=kernels.voronoipolygons("g", 0.0, bounds), borders=kernels.voronoilines("g", 0.0, bounds))
    return made.select(
        "id", _r(geo.area(geo.convexhull(geo.known(F.col("g"), "linestring")))).alias("hull"), _r(F.col("circle")["params"][0]).alias("radius"), _r(geo.area(_polygons("triangles"))).alias("triangles"),
        _r(geo.area(_polygons("cells"))).alias("cells"), _r(geo.linelength(geo.known(F.col("borders"), "multilinestring"))).alias("borders"))


@register(
    "geo_overlay",
    f"""SELECT id, round(i, 6) AS common, round(8 * a * b - i, 6) AS both, round(4 * a * b - i, 6) AS rest, round(8 * a * b - 2 * i, 6) AS either FROM (SELECT *, (2 * a - 0.5) * (2 * b - 0.25) AS i FROM {_S})""",
)
def geo_overlay(spark, sf):
    """Union, intersection and differences of a rectangle and itself moved."""
    g = geo.rectangle("x", "y", "a", "b")
    df = kernels.spread(_suppliers(spark, sf)).select("id", g.alias("g"), geo.translate(g, 0.5, 0.25).alias("h"))
    made = kernels.with_shapes(df, common=kernels.intersection("g", "h"), both=kernels.union("g", "h"), rest=kernels.difference("g", "h"), either=kernels.symdifference("g", "h"))
    return made.select("id", *[_r(geo.area(_polygons(c))).alias(c) for c in ("common", "both", "rest", "either")])


@register(
    "geo_overlay_borders",
    f"""SELECT id, 4 * a * b AS same_union, 4 * a * b AS same_common, 0::DOUBLE AS same_rest, 8 * a * b AS beside_union, 0::DOUBLE AS beside_common, 4 * a * b AS beside_rest, round(6 * a * b, 6) AS along_union, round(2 * a * b, 6) AS along_common,
        round(2 * a * b, 6) AS along_rest, 12 * a * b AS hole FROM {_S}""",
)
def geo_overlay_borders(spark, sf):
    """Rectangles whose borders lie on one another: equal ones, neighbours, one moved along its own side, and one in the middle of another."""
    x, y, a, b = (F.col(c) for c in "xyab")
    g, at = geo.rectangle("x", "y", "a", "b"), lambda dx: geo.rectangle(x + dx, y, a, b)
    df = kernels.spread(_suppliers(spark, sf)).select("id", g.alias("g"), at(F.lit(0.0)).alias("same"), at(2 * a).alias("beside"), at(a).alias("along"), geo.rectangle(x, y, 2 * a, 2 * b).alias("large"))
    ways = {"union": kernels.union, "common": kernels.intersection, "rest": kernels.difference}
    made = kernels.with_shapes(df, **{f"{c}_{n}": way("g", c) for c in ("same", "beside", "along") for n, way in ways.items()}, hole=kernels.difference("large", "g"))
    return made.select("id", *[_r(geo.area(_polygons(f"{c}_{n}"))).alias(f"{c}_{n}") for c in ("same", "beside", "along") for n in ways], _r(geo.area(_polygons("hole"))).alias("hole"))
