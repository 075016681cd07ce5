"""Geometries as structs, and functions on them as Columns.

A geometry is gtype, srid, dim, parts, params and metrics.  parts[p][r][v] is
vertex v of ring r of polygon (or line, or point set) p; shapes with a center
have it as their only vertex, and their sizes in params: a radius, or half
extents.  Everything here is built of higher-order functions, so it runs in the
JVM; lodestar.functions.geometry_kernels has what needs a loop.
"""

from __future__ import annotations

import functools
import math
import types

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double,z:double>"
GEOMETRY = f"struct<gtype:string,srid:int,dim:int,parts:array<array<array<{POINT}>>>,params:array<double>,metrics:array<string>>"

#: Shapes with a center and sizes, and what their sizes are.
CENTERED = {
    "circle": ("r",), "square": ("a",), "rectangle": ("a", "b"), "ellipse": ("a", "b"),
    "sphere": ("r",), "cube": ("a",), "box": ("a", "b", "c"), "cylinder": ("r", "h"), "cone": ("r", "h"), "ellipsoid": ("a", "b", "c"),
}
SOLIDS = ("sphere", "cube", "box", "cylinder", "cone", "ellipsoid")
AREAL = ("polygon", "multipolygon", "triangle")
LINEAR = ("line", "linestring", "multilinestring")
#: Vertices of a polygon that stands for an ellipse or a circle.
SIDES = 64
#: Two numbers this close are equal.
EPSILON = 1e-9


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def _number(x) -> Column:
    return col(x).cast("double")


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def known(g: Column, gtype: str | None = None, srid: int | None = None) -> Column:
    """g, with what is known of it when the query is built: plans then have the branches for its type only."""
    vars(g)["_known"] = (gtype, srid)
    return g


def kind_of(g: Column) -> str | None:
    return vars(g).get("_known", (None, None))[0]


def srid_of(g: Column) -> Column | int:
    srid = vars(g).get("_known", (None, None))[1]
    return g["srid"] if srid is None else srid


def is_a(g: Column, *kinds: str) -> Column | bool:
    return g["gtype"].isin(*kinds) if kind_of(g) is None else kind_of(g) in kinds


def both(p: Column | bool, q: Column | bool) -> Column | bool:
    if p is False or q is False:
        return False
    return q if p is True else p if q is True else p & q


def first_of(cases: list, otherwise) -> Column:
    """The value of the first case (test, function that makes the value) that holds; tests known to fail leave no branch."""
    out = None
    for test, make in cases:
        if test is True:
            return make() if out is None else out.otherwise(make())
        if test is not False:
            out = F.when(test, make()) if out is None else out.when(test, make())
    return otherwise() if out is None else out.otherwise(otherwise())


def let_all(values: dict, body) -> Column:
    """body(struct) with all named values worked out once."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), body)


def on_geometry(function):
    """The first argument, a geometry, is worked out once however often it is used."""

    @functools.wraps(function)
    def bound(g, *args, **options):
        g = col(g)
        return let(g, lambda v: function(known(v, *vars(g).get("_known", ())), *args, **options))

    return bound


def on_geometries(function):
    """The same for the first two arguments."""

    @functools.wraps(function)
    def bound(g, h, *args, **options):
        g, h = col(g), col(h)
        k, m = (vars(x).get("_known", ()) for x in (g, h))
        return let(g, lambda v: let(h, lambda w: function(known(v, *k), known(w, *m), *args, **options)))

    return bound


# --- making -----------------------------------------------------------------------------------


def xyz(x, y, z=None) -> Column:
    return F.struct(_number(x).alias("x"), _number(y).alias("y"), (F.lit(None).cast("double") if z is None else _number(z)).alias("z"))


def geometry(gtype: str, parts: Column, params: list | None = None, srid: int = 0, dim: int = 2, metrics: Column | None = None) -> Column:
    values = F.array(*[_number(p) for p in params]) if params else F.array().cast("array<double>")
    made = F.struct(
        F.lit(gtype).alias("gtype"), F.lit(srid).alias("srid"), F.lit(dim).alias("dim"), parts.alias("parts"), values.alias("params"),
        (F.array().cast("array<string>") if metrics is None else metrics).alias("metrics"),
    ).cast(GEOMETRY)
    return known(made, gtype, srid)


def _like(g: Column, gtype: str | Column, parts: Column, params: Column | None = None) -> Column:
    """A geometry of another type or place, with the rest of g."""
    made = F.struct(
        (F.lit(gtype) if isinstance(gtype, str) else gtype).alias("gtype"), g["srid"].alias("srid"), g["dim"].alias("dim"), parts.alias("parts"),
        (F.array().cast("array<double>") if params is None else params).alias("params"), g["metrics"].alias("metrics"),
    ).cast(GEOMETRY)
    return known(made, gtype if isinstance(gtype, str) else None, vars(g).get("_known", (None, None))[1])


def point(x, y, z=None, srid: int = 0, metrics: Column | None = None) -> Column:
    return geometry("point", F.array(F.array(F.array(xyz(x, y, z)))), None, srid, 2 if z is None else 3, metrics)


def centered(gtype: str, center: list, sizes: list, srid: int = 0) -> Column:
    """A circle, square, rectangle, ellipse, or a solid, by its center and sizes."""
    if len(sizes) != len(CENTERED[gtype]):
        raise ValueError(f"{gtype} has the sizes {CENTERED[gtype]}")
    return geometry(gtype, F.array(F.array(F.array(xyz(*center)))), sizes, srid, len(center))


def circle(x, y, r, srid: int = 0) -> Column:
    return centered("circle", [x, y], [r], srid)


def square(x, y, a, srid: int = 0) -> Column:
    return centered("square", [x, y], [a], srid)


def rectangle(x, y, a, b, srid: int = 0) -> Column:
    return centered("rectangle", [x, y], [a, b], srid)


def ellipse(x, y, a, b, srid: int = 0) -> Column:
    return centered("ellipse", [x, y], [a, b], srid)


def sphere(x, y, z, r) -> Column:
    return centered("sphere", [x, y, z], [r])


def cube(x, y, z, a) -> Column:
    return centered("cube", [x, y, z], [a])


def box(x, y, z, a, b, c) -> Column:
    return centered("box", [x, y, z], [a, b, c])


def cylinder(x, y, z, r, h) -> Column:
    return centered("cylinder", [x, y, z], [r, h])


def cone(x, y, z, r, h) -> Column:
    return centered("cone", [x, y, z], [r, h])


def ellipsoid(x, y, z, a, b, c) -> Column:
    return centered("ellipsoid", [x, y, z], [a, b, c])


def line(p: Column, q: Column, srid: int = 0, dim: int = 2) -> Column:
    return geometry("line", F.array(F.array(F.array(p, q))), None, srid, dim)


def linestring(points: Column, srid: int = 0, dim: int = 2) -> Column:
    """Of an array of ``xyz``."""
    return geometry("linestring", F.array(F.array(points)), None, srid, dim)


def multipoint(points: Column, srid: int = 0, dim: int = 2) -> Column:
    return geometry("multipoint", F.array(F.array(points)), None, srid, dim)


def multilinestring(lines: Column, srid: int = 0, dim: int = 2) -> Column:
    return geometry("multilinestring", F.transform(lines, lambda x: F.array(x)), None, srid, dim)


def polygon(rings: Column, srid: int = 0, dim: int = 2) -> Column:
    """Of an array of closed rings, the outer ring first."""
    return geometry("polygon", F.array(rings), None, srid, dim)


def multipolygon(polygons: Column, srid: int = 0, dim: int = 2) -> Column:
    return geometry("multipolygon", polygons, None, srid, dim)


def triangle(p: Column, q: Column, r: Column, srid: int = 0, dim: int = 2) -> Column:
    return geometry("triangle", F.array(F.array(F.array(p, q, r, p))), None, srid, dim)


def bbox(x1, y1, x2, y2, srid: int = 0) -> Column:
    x1, y1, x2, y2 = map(_number, (x1, y1, x2, y2))
    return rectangle((x1 + x2) / 2, (y1 + y2) / 2, (x2 - x1) / 2, (y2 - y1) / 2, srid)


def from_geojson(text, srid: int = 0) -> Column:
    """A geometry of GeoJSON text: Point, LineString, Polygon and their Multi forms; null for others."""
    def read(raw: Column, depth: int, body) -> Column:
        return let(F.from_json(raw, "array<" * depth + "double" + ">" * depth), body)

    pt = lambda c: F.struct(c[0].alias("x"), c[1].alias("y"), F.try_element_at(c, F.lit(3)).alias("z"))
    pts = lambda a: F.transform(a, pt)
    rings = lambda a: F.transform(a, pts)

    def parts_of(head: Column) -> Column:
        kind, raw = head["type"], head["coordinates"]
        return (
            F.when(kind == "Point", read(raw, 1, lambda c: F.array(F.array(F.array(pt(c))))))
            .when(kind.isin("LineString", "MultiPoint"), read(raw, 2, lambda c: F.array(F.array(pts(c)))))
            .when(kind == "MultiLineString", read(raw, 3, lambda c: F.transform(c, lambda a: F.array(pts(a)))))
            .when(kind == "Polygon", read(raw, 3, lambda c: F.array(rings(c))))
            .when(kind == "MultiPolygon", read(raw, 4, lambda c: F.transform(c, rings)))
        )

    def made(head: Column, parts: Column) -> Column:
        dim = F.when(parts[0][0][0]["z"].isNull(), 2).otherwise(3)
        g = F.struct(
            F.lower(head["type"]).alias("gtype"), F.lit(srid).alias("srid"), dim.alias("dim"), parts.alias("parts"), F.array().cast("array<double>").alias("params"), F.array().cast("array<string>").alias("metrics")
        ).cast(GEOMETRY)
        return F.when(parts.isNotNull(), g)

    # the text, which may be a large expression, is in the plan once
    return let(F.from_json(col(text), "type string, coordinates string"), lambda head: let(parts_of(head), lambda parts: made(head, parts)))


# --- vertices, rings and segments -------------------------------------------------------------


def vertices(g) -> Column:
    return F.flatten(F.flatten(col(g)["parts"]))


def rings_of(g) -> Column:
    return F.flatten(col(g)["parts"])


def segments_of(points: Column) -> Column:
    """Pairs (a, b) of neighbouring vertices."""
    n = F.greatest(F.size(points) - 1, F.lit(0))
    return F.zip_with(F.slice(points, 1, n), F.slice(points, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def edges(g) -> Column:
    return F.flatten(F.transform(rings_of(g), segments_of))


def center(g) -> Column:
    return col(g)["parts"][0][0][0]


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def _z(p: Column) -> Column:
    return F.coalesce(p["z"], F.lit(0.0))


def straight(p: Column, q: Column) -> Column:
    """Distance of two points in the plane or in space."""
    dx, dy, dz = p["x"] - q["x"], p["y"] - q["y"], _z(p) - _z(q)
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def geodesic(p: Column, q: Column, rounds: int = 20) -> Column:
    """Metres between two points (x: longitude, y: latitude, in degrees) on the WGS84 ellipsoid, by Vincenty's formula.

    Within a millimetre but for nearly opposite points, where the rounds don't settle.
    """
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)

    def arc(lam: Column, k: Column) -> dict:
        return {
            "sin_s": F.sqrt(F.pow(k["c2"] * F.sin(lam), F.lit(2)) + F.pow(k["c1"] * k["s2"] - k["s1"] * k["c2"] * F.cos(lam), F.lit(2))),
            "cos_s": k["s1"] * k["s2"] + k["c1"] * k["c2"] * F.cos(lam),
        }

    def bend(lam: Column, k: Column, body) -> Column:
        """body over the arc's sine, cosine and angle, and the azimuth's."""

        def with_azimuth(v: Column) -> Column:
            sin_a = F.coalesce(F.try_divide(k["c1"] * k["c2"] * F.sin(lam), v["sin_s"]), F.lit(0.0))
            return let_all(
                {"sin_s": v["sin_s"], "cos_s": v["cos_s"], "sigma": F.atan2(v["sin_s"], v["cos_s"]), "sin_a": sin_a},
                lambda w: let(1 - w["sin_a"] * w["sin_a"], lambda c: let(F.coalesce(w["cos_s"] - F.try_divide(2 * k["s1"] * k["s2"], c), F.lit(0.0)), lambda m: body(w, c, m))),
            )

        return let_all(arc(lam, k), with_azimuth)

    def turn(lam: Column, k: Column) -> Column:
        def next_lam(w: Column, cos2a: Column, m: Column) -> Column:
            return let(
                f / 16 * cos2a * (4 + f * (4 - 3 * cos2a)),
                lambda c: k["diff"] + (1 - c) * f * w["sin_a"] * (w["sigma"] + c * w["sin_s"] * (m + c * w["cos_s"] * (2 * m * m - 1))),
            )

        return bend(lam, k, next_lam)

    def length(lam: Column, k: Column) -> Column:
        def metres(w: Column, cos2a: Column, m: Column) -> Column:
            def with_series(uu: Column) -> Column:
                big_a = 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu)))
                big_b = uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu)))
                return let(big_b, lambda s: b * big_a * (w["sigma"] - s * w["sin_s"] * (
                    m + s / 4 * (w["cos_s"] * (2 * m * m - 1) - s / 6 * m * (4 * w["sin_s"] * w["sin_s"] - 3) * (4 * m * m - 3)))))

            return let(cos2a * ((a * a - b * b) / (b * b)), with_series)

        return bend(lam, k, metres)

    def over(k: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), k["diff"], lambda lam, _: turn(lam, k), lambda lam: length(lam, k))

    reduced = lambda point: F.atan((1 - f) * F.tan(F.radians(point["y"])))
    return let_all({"u1": reduced(p), "u2": reduced(q), "diff": F.radians(q["x"] - p["x"])}, lambda u: let_all(
        {"s1": F.sin(u["u1"]), "c1": F.cos(u["u1"]), "s2": F.sin(u["u2"]), "c2": F.cos(u["u2"]), "diff": u["diff"]}, over))


def point_distance(p: Column, q: Column, srid: Column | int = 0) -> Column:
    if isinstance(srid, int):
        return geodesic(p, q) if srid == 4326 else straight(p, q)
    return let(p, lambda a: let(q, lambda b: F.when(srid == 4326, geodesic(a, b)).otherwise(straight(a, b))))


def _project(p: Column, e: Column) -> Column:
    """The fraction along a segment that is nearest to p, 0 to 1."""
    dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
    dz = _z(e["b"]) - _z(e["a"])
    along = (p["x"] - e["a"]["x"]) * dx + (p["y"] - e["a"]["y"]) * dy + (_z(p) - _z(e["a"])) * dz
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(along, dx * dx + dy * dy + dz * dz), F.lit(0.0))))


def between(a: Column, b: Column, t: Column) -> Column:
    return F.struct((a["x"] + (b["x"] - a["x"]) * t).alias("x"), (a["y"] + (b["y"] - a["y"]) * t).alias("y"), (a["z"] + (b["z"] - a["z"]) * t).alias("z"))


def _to_segment(p: Column, e: Column) -> Column:
    return let(_project(p, e), lambda t: let(between(e["a"], e["b"], t), lambda q: straight(p, q)))


def cross(o: Column, a: Column, b: Column) -> Column:
    """Twice the signed area of a triangle: positive if it turns left."""
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def signed_area(ring: Column) -> Column:
    return _sum(F.transform(segments_of(ring), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def _case(g: Column, cases: dict, otherwise=None) -> Column:
    """The value for g's type; values that are functions are made only if a plan needs them."""
    made = lambda value: value() if isinstance(value, types.FunctionType) else value
    if kind_of(g) is not None:
        fits = [value for kinds, value in cases.items() if kind_of(g) in ([kinds] if isinstance(kinds, str) else kinds)]
        return made(fits[0]) if fits else F.lit(None) if otherwise is None else made(otherwise)
    out = None
    for kinds, value in cases.items():
        test = g["gtype"].isin(*([kinds] if isinstance(kinds, str) else kinds))
        out = F.when(test, made(value)) if out is None else out.when(test, made(value))
    return out if otherwise is None else out.otherwise(made(otherwise))


# --- measures ---------------------------------------------------------------------------------


@on_geometry
def area(g) -> Column:
    """Area of flat shapes, surface of solids; null for points and lines.  h of cylinders and cones is their height."""
    g = col(g)
    p = g["params"]
    a, b, c = p[0], F.try_element_at(p, F.lit(2)), F.try_element_at(p, F.lit(3))
    flat = lambda: _sum(F.transform(g["parts"], lambda rings: F.abs(signed_area(rings[0])) - _sum(F.transform(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: F.abs(signed_area(r))))))
    pw = 1.6075
    mean = lambda: F.pow((F.pow(a * b, F.lit(pw)) + F.pow(a * c, F.lit(pw)) + F.pow(b * c, F.lit(pw))) / 3, F.lit(1 / pw))
    return _case(g, {
        "circle": math.pi * a * a, "square": 4 * a * a, "rectangle": 4 * a * b, "ellipse": math.pi * a * b, AREAL: flat, "sphere": 4 * math.pi * a * a, "cube": 24 * a * a,
        "box": 8 * (a * b + b * c + a * c), "cylinder": 2 * math.pi * a * (a + b), "cone": math.pi * a * (a + F.sqrt(a * a + b * b)), "ellipsoid": lambda: 4 * math.pi * mean(),
    })


@on_geometry
def volume(g) -> Column:
    g = col(g)
    p = g["params"]
    a, b, c = p[0], F.try_element_at(p, F.lit(2)), F.try_element_at(p, F.lit(3))
    return _case(g, {
        "sphere": 4 / 3 * math.pi * a * a * a, "cube": 8 * a * a * a, "box": 8 * a * b * c, "cylinder": math.pi * a * a * b, "cone": math.pi * a * a * b / 3, "ellipsoid": 4 / 3 * math.pi * a * b * c,
    })


def _length(g: Column) -> Column:
    return _sum(F.transform(edges(g), lambda e: point_distance(e["a"], e["b"], srid_of(g))))


@on_geometry
def linelength(g) -> Column:
    g = col(g)
    return _case(g, {LINEAR: lambda: _length(g)})


@on_geometry
def perimeter(g) -> Column:
    """Of closed shapes; an ellipse's by Ramanujan's second formula, of solids all edges."""
    g = col(g)
    p = g["params"]
    a, b, c = p[0], F.try_element_at(p, F.lit(2)), F.try_element_at(p, F.lit(3))
    h = F.pow((a - b) / (a + b), F.lit(2))
    round_ = math.pi * (a + b) * (1 + 3 * h / (10 + F.sqrt(4 - 3 * h)))
    return _case(g, {"circle": 2 * math.pi * a, "square": 8 * a, "rectangle": 4 * (a + b), "ellipse": round_, "cube": 24 * a, "box": 8 * (a + b + c), AREAL: lambda: _length(g)})


@on_geometry
def centroid_xyz(g) -> Column:
    """Center of mass: of areas for polygons, of lengths for lines, of vertices for points."""
    g = col(g)

    def weighted(parts: Column) -> Column:
        x, y, z, w = (_sum(parts[k]) for k in ("x", "y", "z", "w"))
        return F.struct(F.try_divide(x, w).alias("x"), F.try_divide(y, w).alias("y"), F.when(g["dim"] == 3, F.try_divide(z, w)).alias("z"))

    def ring_moments(r: Column, sign: Column) -> Column:
        own = segments_of(r)
        cr = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
        s = F.when(signed_area(r) < 0, -1.0).otherwise(1.0) * sign
        return F.struct(
            (_sum(F.transform(own, lambda e: (e["a"]["x"] + e["b"]["x"]) * cr(e))) / 6 * s).alias("x"),
            (_sum(F.transform(own, lambda e: (e["a"]["y"] + e["b"]["y"]) * cr(e))) / 6 * s).alias("y"),
            F.lit(0.0).alias("z"), (signed_area(r) * s).alias("w"),
        )

    by_area = lambda: F.flatten(F.transform(g["parts"], lambda rings: F.transform(rings, lambda r, i: ring_moments(r, F.when(i == 0, 1.0).otherwise(-1.0)))))
    by_length = lambda: F.transform(edges(g), lambda e: F.struct(
        ((e["a"]["x"] + e["b"]["x"]) / 2 * straight(e["a"], e["b"])).alias("x"), ((e["a"]["y"] + e["b"]["y"]) / 2 * straight(e["a"], e["b"])).alias("y"),
        ((_z(e["a"]) + _z(e["b"])) / 2 * straight(e["a"], e["b"])).alias("z"), straight(e["a"], e["b"]).alias("w")))
    by_point = lambda: F.transform(vertices(g), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), _z(p).alias("z"), F.lit(1.0).alias("w")))
    return _case(g, {(*CENTERED, "point"): lambda: center(g), AREAL: lambda: weighted(by_area()), LINEAR: lambda: weighted(by_length())}, lambda: weighted(by_point()))


def _as_point(g: Column, p: Column) -> Column:
    return _like(g, "point", F.array(F.array(F.array(p))))


def centroid(g) -> Column:
    return _as_point(col(g), centroid_xyz(g))


def _half(g: Column, axis: str) -> Column:
    """Half extent of a centered shape along an axis, 0 for others."""
    p = g["params"]
    second, third = F.try_element_at(p, F.lit(2)), F.try_element_at(p, F.lit(3))
    same = ("circle", "square", "sphere", "cube")
    if axis == "x":
        return _case(g, {tuple(CENTERED): p[0]}, F.lit(0.0))
    if axis == "y":
        return _case(g, {(*same, "cylinder", "cone"): p[0], ("rectangle", "ellipse", "box", "ellipsoid"): second}, F.lit(0.0))
    return _case(g, {("sphere", "cube"): p[0], ("box", "ellipsoid"): third, ("cylinder", "cone"): second / 2}, F.lit(0.0))


def _least(axis: str):
    def of(g) -> Column:
        g = col(g)
        return F.array_min(F.transform(vertices(g), lambda p: p[axis])) - _half(g, axis)

    return of


def _most(axis: str):
    def of(g) -> Column:
        g = col(g)
        return F.array_max(F.transform(vertices(g), lambda p: p[axis])) + _half(g, axis)

    return of


xmin, ymin, zmin = map(_least, "xyz")
xmax, ymax, zmax = map(_most, "xyz")


def _extreme(axis: str, most: bool):
    def of(g) -> Column:
        keyed = F.transform(vertices(g), lambda p: F.struct(p[axis].alias("key"), p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z")))
        best = (F.array_max if most else F.array_min)(keyed)
        return _as_point(col(g), F.struct(best["x"].alias("x"), best["y"].alias("y"), best["z"].alias("z")))

    return of


xminpoint, yminpoint, zminpoint = (_extreme(a, False) for a in "xyz")
xmaxpoint, ymaxpoint, zmaxpoint = (_extreme(a, True) for a in "xyz")


@on_geometry
def extent(g) -> Column:
    """The bounding rectangle, or box in space."""
    g = col(g)
    mid = lambda lo, hi: (lo(g) + hi(g)) / 2
    half = lambda lo, hi: (hi(g) - lo(g)) / 2
    at = F.struct(mid(xmin, xmax).alias("x"), mid(ymin, ymax).alias("y"), F.when(g["dim"] == 3, mid(zmin, zmax)).alias("z"))
    sizes = F.when(g["dim"] == 3, F.array(half(xmin, xmax), half(ymin, ymax), half(zmin, zmax))).otherwise(F.array(half(xmin, xmax), half(ymin, ymax)))
    return _like(g, F.when(g["dim"] == 3, "box").otherwise("rectangle"), F.array(F.array(F.array(at))), sizes)


envelope = extent


@on_geometries
def angle(l1, l2) -> Column:
    """Degrees between two lines, by their first and last vertices."""
    def way(g):
        a, b = F.element_at(vertices(g), 1), F.element_at(vertices(g), -1)
        return b["x"] - a["x"], b["y"] - a["y"], _z(b) - _z(a)

    u, v = way(l1), way(l2)
    dot = sum((x * y for x, y in zip(u, v, strict=True)), F.lit(0.0))
    size = lambda w: F.sqrt(sum((x * x for x in w), F.lit(0.0)))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot, size(u) * size(v))))))


# --- shapes as polygons -----------------------------------------------------------------------


def topolygon(g, n: int = SIDES) -> Column:
    """A flat shape as a polygon; of n sides where it is round."""
    g = col(g)
    kind = kind_of(g)
    if kind is None:
        return _topolygon(g, n)
    if kind not in ("square", "rectangle", "circle", "ellipse", "triangle"):
        return g
    return known(_topolygon(g, n), "polygon", vars(g)["_known"][1])


@on_geometry
def _topolygon(g, n: int) -> Column:
    c = center(g)
    a, b = g["params"][0], F.coalesce(F.try_element_at(g["params"], F.lit(2)), g["params"][0])
    corners = lambda: F.array(*[F.struct((c["x"] + a * sx).alias("x"), (c["y"] + b * sy).alias("y"), c["z"].alias("z")) for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])
    turns = lambda: F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.struct(F.cos(2 * math.pi / n * (k % n)).alias("c"), F.sin(2 * math.pi / n * (k % n)).alias("s")))
    round_ = lambda: F.transform(turns(), lambda t: F.struct((c["x"] + a * t["c"]).alias("x"), (c["y"] + b * t["s"]).alias("y"), c["z"].alias("z")))
    return _case(g, {
        ("square", "rectangle"): lambda: _like(g, "polygon", F.array(F.array(corners()))), ("circle", "ellipse"): lambda: _like(g, "polygon", F.array(F.array(round_()))), "triangle": lambda: _like(g, "polygon", g["parts"]),
    }, g)


def tomultipoint(g, n: int = SIDES) -> Column:
    g = topolygon(g, n)
    return _like(g, "multipoint", F.array(F.array(vertices(g))))


# --- predicates -------------------------------------------------------------------------------


def _on_ring(p: Column, ring: Column) -> Column:
    return F.exists(segments_of(ring), lambda e: _to_segment(p, e) <= EPSILON)


def _in_ring(p: Column, ring: Column) -> Column:
    """By the crossings of a ray to the right."""
    hits = F.filter(segments_of(ring), lambda e: ((e["a"]["y"] > p["y"]) != (e["b"]["y"] > p["y"])) & (
        p["x"] < e["a"]["x"] + F.coalesce(F.try_divide((e["b"]["x"] - e["a"]["x"]) * (p["y"] - e["a"]["y"]), e["b"]["y"] - e["a"]["y"]), F.lit(0.0))))
    return F.size(hits) % 2 == 1


@on_geometries
def holds_point(g, p: Column, strict: bool = True) -> Column:
    """The shape holds a point; strict: not on its border."""
    g = col(g)
    c, s = center(g), g["params"]
    a, b = s[0], F.coalesce(F.try_element_at(s, F.lit(2)), s[0])
    third = F.coalesce(F.try_element_at(s, F.lit(3)), b)
    dx, dy, dz = F.abs(p["x"] - c["x"]), F.abs(p["y"] - c["y"]), F.abs(_z(p) - _z(c))
    less = (lambda x, y: x < y) if strict else (lambda x, y: x <= y)
    border = lambda: F.exists(rings_of(g), lambda r: _on_ring(p, r))
    inside = lambda: F.exists(g["parts"], lambda rings: _in_ring(p, rings[0]) & ~F.exists(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: _in_ring(p, r)))
    square_ = lambda x: x * x
    top = _z(c) + b / 2 - _z(p)  # of a cone, down from its tip
    return _case(g, {
        "circle": lambda: less(square_(dx) + square_(dy), square_(a)), "square": lambda: less(dx, a) & less(dy, a), "rectangle": lambda: less(dx, a) & less(dy, b), "ellipse": lambda: less(square_(dx / a) + square_(dy / b), F.lit(1.0)),
        "sphere": lambda: less(square_(dx) + square_(dy) + square_(dz), square_(a)), "cube": lambda: less(dx, a) & less(dy, a) & less(dz, a), "box": lambda: less(dx, a) & less(dy, b) & less(dz, third),
        "ellipsoid": lambda: less(square_(dx / a) + square_(dy / b) + square_(dz / third), F.lit(1.0)), "cylinder": lambda: less(square_(dx) + square_(dy), square_(a)) & less(dz, b / 2),
        "cone": lambda: less(dz, b / 2) & less(F.sqrt(square_(dx) + square_(dy)), a * top / b),
        AREAL: lambda: (inside() & ~border()) if strict else (inside() | border()), "point": lambda: (dx <= EPSILON) & (dy <= EPSILON) & (dz <= EPSILON) & F.lit(not strict),
        LINEAR: border if not strict else F.lit(False), "multipoint": lambda: F.exists(vertices(g), lambda q: straight(p, q) <= EPSILON) & F.lit(not strict),
    }, F.lit(False))


def _same_srid(g: Column, h: Column) -> Column:
    return (g["srid"] == h["srid"]) | (g["srid"] == 0) | (h["srid"] == 0)


def _cross_edges(g: Column, h: Column, touch: bool) -> Column:
    """Some edge of g crosses an edge of h; touch: or meets it."""
    def meet(e: Column, f: Column) -> Column:
        d1, d2 = cross(e["a"], e["b"], f["a"]), cross(e["a"], e["b"], f["b"])
        d3, d4 = cross(f["a"], f["b"], e["a"]), cross(f["a"], f["b"], e["b"])
        proper = (F.signum(d1) * F.signum(d2) < 0) & (F.signum(d3) * F.signum(d4) < 0)
        if not touch:
            return proper
        near = (_to_segment(f["a"], e) <= EPSILON) | (_to_segment(f["b"], e) <= EPSILON) | (_to_segment(e["a"], f) <= EPSILON) | (_to_segment(e["b"], f) <= EPSILON)
        return proper | near

    return F.exists(edges(g), lambda e: F.exists(edges(h), lambda f: meet(e, f)))


def _bounds_meet(g: Column, h: Column) -> Column:
    return (xmin(g) <= xmax(h)) & (xmin(h) <= xmax(g)) & (ymin(g) <= ymax(h)) & (ymin(h) <= ymax(g))


def _to_edges(p: Column, g: Column) -> Column:
    """Distance of a point from the nearest edge or vertex."""
    by_edge = F.array_min(F.transform(edges(g), lambda e: _to_segment(p, e)))
    return F.least(by_edge, F.array_min(F.transform(vertices(g), lambda q: straight(p, q))))


@on_geometries
def _within(g, h, strict: bool) -> Column:
    g, h = col(g), col(h)
    less = (lambda x, y: x < y) if strict else (lambda x, y: x <= y)
    gc, r = center(g), g["params"][0]
    in_circle = lambda: less(straight(gc, center(h)) + r, h["params"][0])
    round_in = lambda: first_of([(is_a(h, "circle", "sphere"), in_circle)], lambda: holds_point(h, gc) & let(topolygon(h), lambda q: less(r, _to_edges(gc, q))))
    # no border of h may run through g: none of its corners inside, and no edges that cross
    flat = on_geometries(lambda p, q: F.forall(vertices(p), lambda v: holds_point(h, v, strict)) & ~_cross_edges(p, q, False))
    solid = lambda p: holds_point(h, p, strict)
    corners = lambda: F.array(*[F.struct((gc["x"] + _half(g, "x") * i).alias("x"), (gc["y"] + _half(g, "y") * j).alias("y"), (_z(gc) + _half(g, "z") * k).alias("z")) for i in (-1, 1) for j in (-1, 1) for k in (-1, 1)])
    in_flat = is_a(h, *[k for k in (*CENTERED, *AREAL, *LINEAR, "point", "multipoint") if k not in ("ellipse", *SOLIDS)])
    test = first_of([
        (is_a(g, "point", "multipoint"), lambda: F.forall(vertices(g), solid)),
        (both(is_a(g, "circle"), in_flat), round_in),
        (both(is_a(g, "sphere"), is_a(h, "sphere")), in_circle),
        (is_a(g, *SOLIDS), lambda: F.forall(corners(), solid)),
    ], lambda: flat(topolygon(g), topolygon(h)))
    return F.coalesce(_same_srid(g, h) & test, F.lit(False))


def within(g, h) -> Column:
    """g lies inside h and doesn't meet its border.  Round shapes other than circles stand for 64-sided polygons, solids for their bounding boxes."""
    return _within(g, h, True)


def coveredby(g, h) -> Column:
    return _within(g, h, False)


def contain(g, h) -> Column:
    return _within(h, g, True)


def cover(g, h) -> Column:
    return _within(h, g, False)


@on_geometries
def intersect(g, h) -> Column:
    """The shapes share a point.  Bounds are compared first; rectangles by their centers and sizes, which no rounding of bounds moves."""
    g, h = col(g), col(h)
    reach = lambda axis: F.abs(center(g)[axis] - center(h)[axis]) <= _half(g, axis) + _half(h, axis)
    circles = lambda: straight(center(g), center(h)) <= g["params"][0] + h["params"][0]
    round_ = lambda c, other: holds_point(other, center(c), False) | let(topolygon(other), lambda q: _to_edges(center(c), q) <= c["params"][0])
    flat = on_geometries(lambda p, q: F.exists(vertices(p), lambda v: holds_point(h, v, False)) | F.exists(vertices(q), lambda v: holds_point(g, v, False)) | _cross_edges(p, q, True))
    flat_kinds = [k for k in (*CENTERED, *AREAL, *LINEAR, "point", "multipoint") if k != "ellipse"]
    test = first_of([
        (both(is_a(g, "circle", "sphere"), is_a(h, "circle", "sphere")), circles),
        (both(is_a(g, *SOLIDS), is_a(h, *SOLIDS)), lambda: _bounds_meet(g, h) & (zmin(g) <= zmax(h)) & (zmin(h) <= zmax(g))),
        (both(is_a(g, "square", "rectangle"), is_a(h, "square", "rectangle")), lambda: reach("x") & reach("y")),
        (~_bounds_meet(g, h), lambda: F.lit(False)),
        (both(is_a(g, "circle"), is_a(h, *flat_kinds)), lambda: round_(g, h)),
        (both(is_a(h, "circle"), is_a(g, *flat_kinds)), lambda: round_(h, g)),
    ], lambda: flat(topolygon(g), topolygon(h)))
    return F.coalesce(_same_srid(g, h) & test, F.lit(False))


def disjoint(g, h) -> Column:
    return ~intersect(g, h)


@on_geometries
def distance(g, h, kind: str = "center") -> Column:
    """Between centers, or the least or greatest between points of the shapes; geodesic for points of SRID 4326."""
    centers = point_distance(centroid_xyz(g), centroid_xyz(h), srid_of(g))
    if kind == "center":
        return centers
    r = _case(g, {"circle": g["params"][0]}, F.lit(0.0)) + _case(h, {"circle": h["params"][0]}, F.lit(0.0))
    rounds = both(is_a(g, "circle", "point"), is_a(h, "circle", "point"))
    if kind == "min":
        apart = on_geometries(lambda p, q: F.least(F.array_min(F.transform(vertices(p), lambda v: _to_edges(v, q))), F.array_min(F.transform(vertices(q), lambda v: _to_edges(v, p)))))
        return first_of([(rounds, lambda: F.greatest(centers - r, F.lit(0.0)))], lambda: F.when(intersect(g, h), 0.0).otherwise(apart(topolygon(g), topolygon(h))))
    if kind == "max":
        far = on_geometries(lambda p, q: F.array_max(F.transform(vertices(p), lambda v: F.array_max(F.transform(vertices(q), lambda w: straight(v, w))))))
        return first_of([(rounds, lambda: centers + r)], lambda: far(topolygon(g), topolygon(h)))
    raise ValueError(f"unknown distance {kind}")


def nearby(g, h, radius) -> Column:
    """The shapes come within a radius."""
    return F.coalesce(distance(g, h, "min") <= _number(radius), F.lit(False))


@on_geometries
def same(g, h) -> Column:
    g, h = col(g), col(h)
    return (g["gtype"] == h["gtype"]) & (g["parts"] == h["parts"]) & (g["params"] == h["params"])


equal = same


def _side(g, h, sign: int) -> Column:
    """Share of g's vertices on one side of the line through h's ends."""
    a, b = F.element_at(vertices(h), 1), F.element_at(vertices(h), -1)
    v = vertices(g)
    return F.try_divide(F.size(F.filter(v, lambda p: cross(a, b, p) * sign > EPSILON)).cast("double"), F.size(v).cast("double"))


def leftratio(g, h) -> Column:
    return _side(g, h, 1)


def rightratio(g, h) -> Column:
    return _side(g, h, -1)


def isonleft(g, h) -> Column:
    return leftratio(g, h) == 1.0


def isonright(g, h) -> Column:
    return rightratio(g, h) == 1.0


# --- parts ------------------------------------------------------------------------------------


def part(g, name: str) -> Column:
    """A named part of a shape: x, y or z of its first vertex, or a size by its place, a, b or c."""
    g = col(g)
    return center(g)[name] if name in "xyz" else F.try_element_at(g["params"], F.lit(1 + "abc".index(name)))


def dimension(g) -> Column:
    return col(g)["dim"]


def geotype(g) -> Column:
    return col(g)["gtype"]


def srid(g) -> Column:
    return col(g)["srid"]


def numpoints(g) -> Column:
    return F.size(vertices(g))


def numsegments(g) -> Column:
    return F.size(edges(g))


def numlines(g) -> Column:
    g = col(g)
    return _case(g, {LINEAR: lambda: F.size(g["parts"])}, F.lit(0))


def numrings(g) -> Column:
    g = col(g)
    return _case(g, {AREAL: lambda: F.size(rings_of(g))}, F.lit(0))


@on_geometry
def numinnerrings(g) -> Column:
    g = col(g)
    return _case(g, {AREAL: lambda: F.size(rings_of(g)) - F.size(g["parts"])}, F.lit(0))


def numpolygons(g) -> Column:
    g = col(g)
    return _case(g, {AREAL: lambda: F.size(g["parts"])}, F.lit(0))


@on_geometry
def summary(g) -> Column:
    g = col(g)
    return F.concat_ws(" ", g["gtype"], g["dim"].cast("string"), g["srid"].cast("string"), numpoints(g).cast("string"))


@on_geometry
def isclosed(g) -> Column:
    v = vertices(g)
    return (F.size(v) > 1) & (F.element_at(v, 1) == F.element_at(v, -1))


@on_geometry
def issimple(g) -> Column:
    """No two edges meet but neighbours at their common vertex."""
    g = col(g)
    own = F.transform(edges(g), lambda e, i: F.struct(e["a"].alias("a"), e["b"].alias("b"), i.alias("i")))
    last = F.size(own) - 1
    def clash(e, f):
        next_ = (f["i"] - e["i"] == 1) | ((e["i"] == 0) & (f["i"] == last) & (e["a"] == f["b"]))
        d1, d2, d3, d4 = cross(e["a"], e["b"], f["a"]), cross(e["a"], e["b"], f["b"]), cross(f["a"], f["b"], e["a"]), cross(f["a"], f["b"], e["b"])
        proper = (F.signum(d1) * F.signum(d2) < 0) & (F.signum(d3) * F.signum(d4) < 0)
        touch = (_to_segment(f["a"], e) <= EPSILON) | (_to_segment(f["b"], e) <= EPSILON) | (_to_segment(e["a"], f) <= EPSILON) | (_to_segment(e["b"], f) <= EPSILON)
        return (f["i"] > e["i"]) & (proper | (touch & ~next_))
    return ~F.exists(own, lambda e: F.exists(own, lambda f: clash(e, f)))


def isring(g) -> Column:
    return isclosed(g) & issimple(g)


@on_geometry
def isvalid(g) -> Column:
    """Rings are closed, have four vertices or more, and don't cross themselves; lines have two points."""
    g = col(g)
    ring = lambda r: (F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -1))
    rings_ok = lambda: F.forall(rings_of(g), lambda r: ring(r) & (F.abs(signed_area(r)) > 0))
    simple = lambda: F.forall(g["parts"], lambda rings: F.size(rings) >= 1) & issimple(g)
    return _case(g, {AREAL: lambda: rings_ok() & simple(), LINEAR: lambda: F.forall(rings_of(g), lambda r: F.size(r) >= 2)}, lambda: F.size(vertices(g)) > 0)


@on_geometry
def isconvex(g) -> Column:
    """The outer ring turns one way only."""
    r = col(g)["parts"][0][0]
    n = F.size(r) - 1
    turns = F.transform(F.sequence(F.lit(0), n - 1), lambda i: cross(F.get(r, i), F.get(r, i + 1), F.get(r, (i + 1) % n + 1)))
    return F.forall(turns, lambda t: t >= 0) | F.forall(turns, lambda t: t <= 0)


@on_geometry
def _winding(g, outer: int) -> Column:
    g = col(g)
    return F.forall(g["parts"], lambda rings: F.forall(F.transform(rings, lambda r, i: signed_area(r) * F.when(i == 0, outer).otherwise(-outer)), lambda s: s > 0))


def ispolygonccw(g) -> Column:
    return _winding(g, 1)


def ispolygoncw(g) -> Column:
    return _winding(g, -1)


def metricn(g, n: int | None = None, m: int | None = None) -> Column:
    """All metrics, the n-th (1-based), or the m-th blank-separated word of the n-th."""
    values = col(g)["metrics"]
    if n is None:
        return F.array_join(values, " ")
    own = F.try_element_at(values, F.lit(n))
    return own if m is None else F.try_element_at(F.split(own, " "), F.lit(m))


def pointn(g, n) -> Column:
    return _as_point(col(g), F.try_element_at(vertices(g), col(n).cast("int")))


def startpoint(g) -> Column:
    return pointn(g, 1)


def endpoint(g) -> Column:
    return pointn(g, -1)


def _line_of(g: Column, ring: Column) -> Column:
    return F.when(ring.isNotNull(), _like(g, "linestring", F.array(F.array(ring))))


def outerring(g) -> Column:
    return _line_of(col(g), col(g)["parts"][0][0])


def outerrings(g) -> Column:
    g = col(g)
    return _like(g, "multilinestring", F.transform(g["parts"], lambda rings: F.array(rings[0])))


def innerrings(g) -> Column:
    g = col(g)
    inner = F.flatten(F.transform(g["parts"], lambda rings: F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))))
    return _like(g, "multilinestring", F.transform(inner, lambda r: F.array(r)))


def ringn(g, n: int) -> Column:
    return _line_of(col(g), F.try_element_at(col(g)["parts"][0], F.lit(n)))


def innerringn(g, n: int) -> Column:
    return ringn(g, n + 1)


def polygonn(g, n: int) -> Column:
    g = col(g)
    own = F.try_element_at(g["parts"], F.lit(n))
    return F.when(own.isNotNull(), _like(g, "polygon", F.array(own)))


def explode_vertices(df, g: str):
    """A row for each vertex: its place and coordinates."""
    return df.select("*", F.posexplode(vertices(g)).alias("i", "v")).select("*", "v.x", "v.y", "v.z").drop("v")


# --- changes ----------------------------------------------------------------------------------


def _map_points(g: Column, f) -> Column:
    return F.transform(g["parts"], lambda rings: F.transform(rings, lambda r: F.transform(r, f)))


def _moved(g, f, params: Column | None = None) -> Column:
    g = col(g)
    return _like(g, g["gtype"], _map_points(g, f), g["params"] if params is None else params)


def translate(g, dx, dy, dz=0.0) -> Column:
    dx, dy, dz = map(_number, (dx, dy, dz))
    return _moved(g, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y"), (p["z"] + dz).alias("z")))


def scale(g, fx, fy=None, fz=None) -> Column:
    """Coordinates times factors, one for all or one for each axis."""
    return scaleat(g, xyz(0.0, 0.0, 0.0), fx, fy, fz)


def scaleat(g, at: Column, fx, fy=None, fz=None) -> Column:
    fx = _number(fx)
    fy, fz = (fx if f is None else _number(f) for f in (fy, fz))
    rel = lambda p, a, f: at[a] + (p[a] - at[a]) * f
    z = lambda p: _z(at) + (p["z"] - _z(at)) * fz
    return _moved(g, lambda p: F.struct(rel(p, "x", fx).alias("x"), rel(p, "y", fy).alias("y"), z(p).alias("z")))


def scalesize(g, fx, fy=None, fz=None) -> Column:
    """Sizes of centered shapes times factors."""
    fx = _number(fx)
    factors = F.array(fx, *(fx if f is None else _number(f) for f in (fy, fz)))
    return _moved(g, lambda p: p, F.transform(col(g)["params"], lambda s, i: s * F.get(factors, i)))


def transscale(g, dx, dy, *rest) -> Column:
    """Moved, then scaled: dx, dy, f; dx, dy, fx, fy; or dx, dy, dz, fx, fy, fz."""
    if len(rest) == 4:
        return scale(translate(g, dx, dy, rest[0]), *rest[1:])
    return scale(translate(g, dx, dy), *rest)


def rotateat(g, amount, unit: str, x, y) -> Column:
    """Counter-clockwise about (x, y)."""
    a = F.radians(_number(amount)) if unit == "degree" else _number(amount)
    x, y, c, s = _number(x), _number(y), F.cos(a), F.sin(a)
    return _moved(g, lambda p: F.struct(
        (x + (p["x"] - x) * c - (p["y"] - y) * s).alias("x"), (y + (p["x"] - x) * s + (p["y"] - y) * c).alias("y"), p["z"].alias("z")))


def rotate(g, amount, unit: str = "degree") -> Column:
    return rotateat(g, amount, unit, 0.0, 0.0)


def rotateself(g, amount, unit: str = "degree") -> Column:
    c = centroid_xyz(g)
    return rotateat(g, amount, unit, c["x"], c["y"])


def affine(g, *m) -> Column:
    """(a, b, d, e, dx, dy) in the plane, (a, b, c, d, e, f, g, h, i, dx, dy, dz) in space."""
    m = [_number(v) for v in m]
    if len(m) == 6:
        a, b, d, e, dx, dy = m
        return _moved(g, lambda p: F.struct((a * p["x"] + b * p["y"] + dx).alias("x"), (d * p["x"] + e * p["y"] + dy).alias("y"), p["z"].alias("z")))
    if len(m) != 12:
        raise ValueError("an affine map has 6 numbers, or 12")
    rows = [m[0:3], m[3:6], m[6:9]]
    made = lambda p, k: rows[k][0] * p["x"] + rows[k][1] * p["y"] + rows[k][2] * p["z"] + m[9 + k]
    return _moved(g, lambda p: F.struct(*[made(p, k).alias(n) for k, n in enumerate("xyz")]))


def reverse(g) -> Column:
    g = col(g)
    return _like(g, g["gtype"], F.transform(g["parts"], lambda rings: F.transform(rings, lambda r: F.reverse(r))), g["params"])


def unique(g) -> Column:
    """Without vertices equal to the one before."""
    g = col(g)
    keep = lambda r: F.filter(r, lambda p, i: (i == 0) | (p != F.get(r, i - 1)))
    return _like(g, g["gtype"], F.transform(g["parts"], lambda rings: F.transform(rings, keep)), g["params"])


def collect(g, h) -> Column:
    g, h = col(g), col(h)
    kind = F.when(g["gtype"].isin(*AREAL) & h["gtype"].isin(*AREAL), "multipolygon").when(g["gtype"].isin(*LINEAR) & h["gtype"].isin(*LINEAR), "multilinestring").when(
        g["gtype"].isin("point", "multipoint") & h["gtype"].isin("point", "multipoint"), "multipoint").otherwise("geometrycollection")
    return _like(g, kind, F.concat(g["parts"], h["parts"]))


def _with_line(g: Column, points: Column) -> Column:
    return _like(g, g["gtype"], F.array(F.array(points)))


def addpoint(g, p: Column, at: int = -1) -> Column:
    """At a 1-based position, or at the end."""
    g = col(g)
    v = vertices(g)
    return _with_line(g, F.array_append(v, p) if at < 0 else F.concat(F.slice(v, 1, at - 1), F.array(p), F.slice(v, at, F.size(v))))


def setpoint(g, p: Column, at: int) -> Column:
    return _with_line(col(g), F.transform(vertices(g), lambda q, i: F.when(i == at - 1, p).otherwise(q)))


def removepoint(g, at: int) -> Column:
    return _with_line(col(g), F.filter(vertices(g), lambda q, i: i != at - 1))


# --- along lines ------------------------------------------------------------------------------


@on_geometry
def _measured(g) -> Column:
    """Segments with the length before each."""
    own = F.transform(edges(g), lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b"), straight(e["a"], e["b"]).alias("d")))
    start = F.array().cast(f"array<struct<a:{POINT},b:{POINT},d:double,s:double>>")
    return F.aggregate(own, start, lambda acc, e: F.array_append(acc, F.struct(
        e["a"].alias("a"), e["b"].alias("b"), e["d"].alias("d"), F.when(F.size(acc) == 0, 0.0).otherwise(F.element_at(acc, -1)["s"] + F.element_at(acc, -1)["d"]).alias("s"))))


def _at_length(m: Column, d: Column) -> Column:
    hit = F.coalesce(F.get(F.filter(m, lambda e: e["s"] + e["d"] >= d), 0), F.element_at(m, -1))
    return let(hit, lambda e: let(F.coalesce(F.try_divide(d - e["s"], e["d"]), F.lit(0.0)), lambda t: between(e["a"], e["b"], t)))


def _along(g: Column, body) -> Column:
    """body(segments with the length before each, length of all)."""
    return let(_measured(g), lambda m: let(_sum(m["d"]), lambda total: body(m, total)))


@on_geometry
def interpolate(g, fraction) -> Column:
    """The point at a share of a line's length."""
    return _as_point(g, _along(g, lambda m, total: let(total * _number(fraction), lambda d: _at_length(m, d))))


@on_geometry
def linesubstring(g, f1, f2) -> Column:
    def part(m: Column, total: Column) -> Column:
        def cut(d1: Column, d2: Column) -> Column:
            inner = F.transform(F.filter(m, lambda e: (e["s"] > d1) & (e["s"] < d2)), lambda e: e["a"])
            return F.concat(F.array(_at_length(m, d1)), inner, F.array(_at_length(m, d2)))

        return let(total * _number(f1), lambda d1: let(total * _number(f2), lambda d2: cut(d1, d2)))

    return _like(g, "linestring", F.array(F.array(_along(g, part))))


@on_geometry
def locatepoint(g, p: Column) -> Column:
    """The share of a line's length where it is nearest to a point."""
    near = lambda m, q: F.array_min(F.transform(m, lambda e: F.struct(_to_segment(q, e).alias("d"), (e["s"] + _project(q, e) * e["d"]).alias("at"))))
    return let(p, lambda q: _along(g, lambda m, total: F.try_divide(near(m, q)["at"], total)))


def closestpoint(p: Column, g) -> Column:
    """The point of a shape's border nearest to p; of a circle, toward p."""
    g = col(g)
    c, r = center(g), g["params"][0]
    toward = lambda: between(c, p, F.coalesce(F.try_divide(r, straight(c, p)), F.lit(0.0)))
    found = lambda: F.array_min(F.transform(edges(topolygon(g)), lambda e: F.struct(_to_segment(p, e).alias("d"), between(e["a"], e["b"], _project(p, e)).alias("q"))))["q"]
    nearest = lambda: F.array_min(F.transform(vertices(g), lambda q: F.struct(straight(p, q).alias("d"), q.alias("q"))))["q"]
    return _as_point(g, _case(g, {"circle": toward, ("point", "multipoint"): nearest}, found))


def knn(g, p: Column, k: int, low: float = -1.0, high: float = float("inf")) -> Column:
    """The k vertices nearest to p, of those between two distances, as a multipoint."""
    g = col(g)
    scored = F.array_sort(F.transform(vertices(g), lambda q: F.struct(straight(p, q).alias("d"), q.alias("q"))))
    near = F.filter(scored, lambda s: (s["d"] >= low) & (s["d"] <= high))
    return _like(g, "multipoint", F.array(F.array(F.transform(F.slice(near, 1, k), lambda s: s["q"]))))


# --- hulls ------------------------------------------------------------------------------------


def _half_hull(points: Column) -> Column:
    """One side of the hull of sorted points: each point in turn takes the place of those behind which it bends to the right."""
    xy = "struct<x:double,y:double>"

    def keep(stack: Column, p: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(stack))
        bends = lambda i: (i == 1) | (cross(F.get(stack, i - 2), F.get(stack, i - 1), p) > 0)
        return F.when(F.size(stack) == 0, 0).otherwise(F.array_max(F.filter(places, bends)))

    return F.aggregate(points, F.array().cast(f"array<{xy}>"), lambda stack, p: F.concat(F.slice(stack, 1, keep(stack, p)), F.array(p)))


@on_geometry
def convexhull(g) -> Column:
    """The convex hull of the vertices in the plane, counter-clockwise, as a polygon (monotone chain)."""
    points = F.array_sort(F.array_distinct(F.transform(vertices(topolygon(g)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))))

    def ring(pts: Column) -> Column:
        lower, upper = _half_hull(pts), _half_hull(F.reverse(pts))
        return F.concat(F.slice(lower, 1, F.greatest(F.size(lower) - 1, F.lit(0))), upper)

    flat = let(points, lambda pts: F.transform(ring(pts), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(None).cast("double").alias("z"))))
    return _like(g, "polygon", F.array(F.array(flat)))


# --- text -------------------------------------------------------------------------------------


def _coordinates(p: Column, sep: str) -> Column:
    # a double without a fraction is written as an integer
    text = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    return F.concat_ws(sep, text(p["x"]), text(p["y"]), text(p["z"]))


@on_geometry
def geojson(g, most: int = 3000, samples: int = SIDES) -> Column:
    """GeoJSON text; shapes with a center as polygons of so many samples, lines and point sets cut after so many points.

    A closed ring that is cut is closed again.
    """
    g = topolygon(g, samples)
    pt = lambda p: F.concat(F.lit("["), _coordinates(p, ","), F.lit("]"))
    seq = lambda xs: F.concat(F.lit("["), F.array_join(xs, ","), F.lit("]"))
    shut = lambda r: (F.size(r) > most) & (F.element_at(r, 1) == F.element_at(r, -1))
    ring = lambda r: seq(F.transform(F.when(shut(r), F.concat(F.slice(r, 1, most - 1), F.slice(r, 1, 1))).otherwise(F.slice(r, 1, most)), pt))
    rings = lambda rs: seq(F.transform(rs, ring))
    names = {"point": "Point", "line": "LineString", "linestring": "LineString", "multipoint": "MultiPoint", "multilinestring": "MultiLineString", "polygon": "Polygon", "triangle": "Polygon", "multipolygon": "MultiPolygon"}
    body = _case(g, {
        ("point", *SOLIDS): lambda: pt(center(g)), ("line", "linestring", "multipoint"): lambda: ring(g["parts"][0][0]), "multilinestring": lambda: seq(F.transform(g["parts"], lambda rs: ring(rs[0]))),
        ("polygon", "triangle"): lambda: rings(g["parts"][0]), "multipolygon": lambda: seq(F.transform(g["parts"], rings)),
    })
    name = _case(g, {k: F.lit(v) for k, v in names.items()}, F.lit("Point"))
    return F.concat(F.lit('{"type":"'), name, F.lit('","coordinates":'), body, F.lit("}"))


def all_points(g) -> Column:
    """Aggregate: the vertices of all rows' geometries as one multipoint, in the order of their coordinates."""
    pts = F.array_sort(F.flatten(F.collect_list(vertices(col(g)))))
    return F.struct(
        F.lit("multipoint").alias("gtype"), F.max(col(g)["srid"]).alias("srid"), F.max(col(g)["dim"]).alias("dim"), F.array(F.array(pts)).alias("parts"),
        F.array().cast("array<double>").alias("params"), F.array().cast("array<string>").alias("metrics")).cast(GEOMETRY)


@on_geometry
def wkt(g) -> Column:
    g = topolygon(g)
    pt = lambda p: _coordinates(p, " ")
    seq = lambda xs: F.concat(F.lit("("), F.array_join(xs, ","), F.lit(")"))
    ring = lambda r: seq(F.transform(r, pt))
    rings = lambda rs: seq(F.transform(rs, ring))
    body = _case(g, {
        ("point", *SOLIDS): lambda: F.concat(F.lit("("), pt(center(g)), F.lit(")")), ("line", "linestring", "multipoint"): lambda: ring(g["parts"][0][0]), "multilinestring": lambda: seq(F.transform(g["parts"], lambda rs: ring(rs[0]))),
        ("polygon", "triangle"): lambda: rings(g["parts"][0]), "multipolygon": lambda: seq(F.transform(g["parts"], rings)),
    })
    name = _case(g, {"line": F.lit("LINESTRING"), "triangle": F.lit("POLYGON"), SOLIDS: F.lit("POINT")}, F.upper(g["gtype"]))
    return F.concat(name, body)


@on_geometry
def text(g) -> Column:
    """Type, then coordinates and sizes."""
    g = col(g)
    sizes = F.array_join(F.transform(g["params"], lambda s: F.regexp_replace(s.cast("string"), r"\.0$", "")), " ")
    return F.concat(g["gtype"], F.lit("("), F.array_join(F.transform(vertices(g), lambda p: _coordinates(p, " ")), ","), F.when(F.size(g["params"]) > 0, F.concat(F.lit(" "), sizes)).otherwise(""), F.lit(")"))


astext = text
