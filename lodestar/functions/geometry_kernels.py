"""Constructions on geometries that need a loop over their vertices.

Each function names its inputs and what is made of one geometry; ``with_shapes``
adds the results to a DataFrame, over Arrow batches.  Geometries are as in
lodestar.functions.geometry.  Coordinates closer than 1e-9 are one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar import session
from lodestar.functions import geometry as geo

XY = tuple[float, float]


@dataclass
class Construction:
    """Geometries to be made, one for each row, of the geometries of some columns; null if one of these is."""

    inputs: list[str | Column]
    make: Callable[..., dict | None]


_POINT = pa.struct([(c, pa.float64()) for c in "xyz"])
_SHAPE = pa.struct(
    [("gtype", pa.string()), ("srid", pa.int32()), ("dim", pa.int32()), ("parts", pa.list_(pa.list_(pa.list_(_POINT)))), ("params", pa.list_(pa.float64())), ("metrics", pa.list_(pa.string()))]
)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores: a small file is one partition, however long its rows' constructions take."""
    return df.repartition(session.partitions(df.sparkSession))


def _nested(column: pa.ListArray) -> tuple[list[np.ndarray], pa.Array]:
    """The offsets of each level of lists, the outermost first, and what the innermost hold."""
    offsets = []
    while isinstance(column, pa.ListArray):
        offsets.append(column.offsets.to_numpy())
        column = column.values
    return offsets, column


def _read(column: pa.StructArray) -> list[dict | None]:
    """Geometries of an Arrow column; vertices are tuples (x, y, z), a missing z is nan."""
    (of_row, of_part, of_ring), values = _nested(column.field("parts"))
    x, y, z = (values.field(c).to_numpy(zero_copy_only=False).tolist() for c in "xyz")
    points = list(zip(x, y, z, strict=True))
    rings = [points[i:j] for i, j in zip(of_ring.tolist(), of_ring[1:].tolist(), strict=False)]
    parts = [rings[i:j] for i, j in zip(of_part.tolist(), of_part[1:].tolist(), strict=False)]
    own = [parts[i:j] for i, j in zip(of_row.tolist(), of_row[1:].tolist(), strict=False)]
    columns = (column.field("gtype").to_pylist(), column.field("srid").to_pylist(), column.field("params").to_pylist(), column.is_valid().to_pylist())
    return [{"gtype": t, "srid": s, "parts": q, "params": r} if ok else None for t, s, q, r, ok in zip(columns[0], columns[1], own, *columns[2:], strict=True)]


def _lists(values: pa.Array, counts: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), values)


def _written(shapes: list[dict | None]) -> pa.StructArray:
    """An Arrow column of geometries whose vertices are tuples."""
    parts = [p for g in shapes if g for p in g["parts"]]
    rings = [r for p in parts for r in p]
    points = [v for r in rings for v in r]
    x, y = (pa.array([float(v[k]) for v in points], pa.float64()) for k in (0, 1))
    z = pa.array([float(v[2]) if len(v) > 2 else None for v in points], pa.float64())
    made = pa.StructArray.from_arrays([x, y, z], fields=list(_POINT))
    for level in ([len(r) for r in rings], [len(p) for p in parts], [len(g["parts"]) if g else 0 for g in shapes]):
        made = _lists(made, level)
    own = lambda key, kind: pa.array([g[key] if g else None for g in shapes], kind)
    columns = [own(f.name, f.type) if f.name != "parts" else made for f in _SHAPE]
    return pa.StructArray.from_arrays(columns, fields=list(_SHAPE), mask=pa.array([g is None for g in shapes], pa.bool_()))


def with_shapes(df: DataFrame, **made: Construction) -> DataFrame:
    """df with a column for each construction.  A row needs no other row: nothing is shuffled."""
    columns = df.columns
    names: dict[str, list[str]] = {}
    staged: list[Column] = []
    for name, m in made.items():
        for i, c in enumerate(m.inputs):  # a column of df that several constructions take goes over once
            own = c if isinstance(c, str) else f"__{name}_{i}"
            names.setdefault(name, []).append(own)
            if not isinstance(c, str):
                staged.append(c.alias(own))
    shape = T._parse_datatype_string(geo.GEOMETRY)
    schema = T.StructType([*df.schema.fields, *(T.StructField(name, shape) for name in made)])
    makers = {name: (names[name], m.make) for name, m in made.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(batch.columns[: len(columns)])
            inputs = list(dict.fromkeys(c for own, _ in makers.values() for c in own))
            places = [([inputs.index(c) for c in own], make) for own, make in makers.values()]
            shapes: list[list[dict | None]] = [[] for _ in places]
            for row in zip(*(_read(batch.column(c)) for c in inputs), strict=True):
                for (own, make), to in zip(places, shapes, strict=True):
                    given = [row[i] for i in own]
                    to.append(None if any(g is None for g in given) else make(*given))
            out += map(_written, shapes)
            yield pa.RecordBatch.from_arrays(out, names=[*columns, *makers])

    return df.select("*", *staged).mapInArrow(run, schema)


def flat(g: dict) -> dict:
    """As lodestar.functions.geometry.topolygon: a flat shape as a polygon, of SIDES sides where it is round."""
    kind = g["gtype"]
    if kind == "triangle":
        return g | {"gtype": "polygon", "params": []}
    if kind not in ("square", "rectangle", "circle", "ellipse"):
        return g
    x, y, z = g["parts"][0][0][0]
    a, b = g["params"][0], g["params"][-1]
    turns = ((-1, -1), (1, -1), (1, 1), (-1, 1)) if kind in ("square", "rectangle") else [(math.cos(2 * math.pi / geo.SIDES * k), math.sin(2 * math.pi / geo.SIDES * k)) for k in range(geo.SIDES)]
    ring = [(x + a * i, y + b * j, z) for i, j in turns]
    return g | {"gtype": "polygon", "parts": [[[*ring, ring[0]]]], "params": []}


def _turn(o: XY, a: XY, b: XY) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def hull(points: list[XY]) -> list[XY]:
    """The convex hull, counter-clockwise, closed (monotone chain)."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return [*pts, pts[0]] if pts else []
    out: list[XY] = []
    for way in (pts, pts[::-1]):
        half: list[XY] = []
        for p in way:
            while len(half) > 1 and _turn(half[-2], half[-1], p) <= 0:
                half.pop()
            half.append(p)
        out += half[:-1]
    return [*out, out[0]]


def bounding_circle(points: list[XY]) -> tuple[float, float, float]:
    """(x, y, r) of the smallest circle, point by point (Welzl's order)."""
    def of_two(a, b):
        return (a[0] + b[0]) / 2, (a[1] + b[1]) / 2, math.dist(a, b) / 2

    def of_three(a, b, c):
        d = 2 * _turn(a, b, c)
        if abs(d) < 1e-12:
            return max((of_two(*p) for p in ((a, b), (b, c), (a, c))), key=lambda s: s[2])
        bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
        ux = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d
        uy = (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
        return a[0] + ux, a[1] + uy, math.hypot(ux, uy)

    holds = lambda c, p: math.dist(c[:2], p) <= c[2] * (1 + 1e-12) + 1e-12
    pts = hull(points)[:-1] or points[:1]
    c = (*pts[0], 0.0)
    for i, p in enumerate(pts):
        if not holds(c, p):
            c = (*p, 0.0)
            for j, q in enumerate(pts[:i]):
                if not holds(c, q):
                    c = of_two(p, q)
                    for r in pts[:j]:
                        if not holds(c, r):
                            c = of_three(p, q, r)
    return c


def snapped(points: list[XY], tolerance: float = 0.0) -> list[XY]:
    """Distinct points, sorted; those that share a square as wide as the tolerance are the first of them."""
    if tolerance <= 0:
        return sorted(set(points))
    first: dict[tuple[int, int], XY] = {}
    for p in sorted(set(points)):
        first.setdefault((math.floor(p[0] / tolerance), math.floor(p[1] / tolerance)), p)
    return sorted(first.values())


def delaunay(points: list[XY], tolerance: float = 0.0) -> list[tuple[XY, XY, XY]]:
    """Triangles, counter-clockwise.

    Points are added from left to right; a triangle whose circle lies to the left of
    a point is done with, so each point looks at the few that are still open.
    """
    return list(_triangles(tuple(snapped(points, tolerance))))


def _triangles(pts: tuple[XY, ...]) -> list[tuple[XY, XY, XY]]:
    """The triangles of distinct sorted points."""
    if len(pts) < 3:
        return []
    span = max(pts[-1][0] - pts[0][0], max(p[1] for p in pts) - min(p[1] for p in pts), 1e-9) * 1e3
    mx, my = pts[len(pts) // 2]
    outer = [(mx - 2 * span, my - span), (mx + 2 * span, my - span), (mx, my + 2 * span)]

    def round_(a: XY, b: XY, c: XY) -> tuple:
        """(triangle, circle's center, its squared radius)"""
        bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
        d = 2 * (bx * cy - by * cx)
        ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
        return (a, b, c), a[0] + ux, a[1] + uy, ux * ux + uy * uy

    done, waiting = [], [round_(*outer)]
    for p in pts:
        still, rim = [], {}
        for t in waiting:
            (a, b, c), x, y, r = t
            dx, dy = p[0] - x, p[1] - y
            if dx > 0 and dx * dx > r:
                done.append(t[0])
            elif dx * dx + dy * dy >= r * (1 - 1e-12):
                still.append(t)
            else:
                for e in ((a, b), (b, c), (c, a)):
                    if rim.pop(e[::-1], None) is None:
                        rim[e] = e
        waiting = still + [round_(a, b, p) for a, b in rim if _turn(a, b, p) > 0]
    return [t for t in done + [w[0] for w in waiting] if not set(t) & set(outer)]


def cut_by_line(ring: list[XY], keep: Callable[[XY], float]) -> list[XY]:
    """The part of a convex ring (open) where ``keep`` is 0 or more."""
    out = []
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        fa, fb = keep(a), keep(b)
        if fa >= 0:
            out.append(a)
        if fa * fb < 0:
            t = fa / (fa - fb)
            out.append((a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t))
    return out


def voronoi(points: list[XY], bounds: tuple[float, float, float, float] | None = None, tolerance: float = 0.0) -> list[list[XY]]:
    """Closed cells of the points, within bounds (by default theirs, wider by a half).

    A cell is the bounds cut by the points that share a triangle with its own.
    """
    return list(_cells(tuple(snapped(points, tolerance)), bounds))


def _cells(pts: tuple[XY, ...], bounds: tuple[float, float, float, float] | None) -> list[list[XY]]:
    """The cells of distinct sorted points."""
    if not pts:
        return []
    x1, y1, x2, y2 = bounds or (min(p[0] for p in pts), min(p[1] for p in pts), max(p[0] for p in pts), max(p[1] for p in pts))
    if bounds is None:
        dx, dy = (x2 - x1) / 2 or 1.0, (y2 - y1) / 2 or 1.0
        x1, y1, x2, y2 = x1 - dx, y1 - dy, x2 + dx, y2 + dy
    near: dict[XY, set[XY]] = {p: set() for p in pts}
    triangles = _triangles(pts)
    for t in triangles:
        for p in t:
            near[p].update(t)
    if not triangles:  # all on one line: neighbours in order
        for a, b in zip(pts, pts[1:], strict=False):
            near[a].add(b)
            near[b].add(a)
    cells = []
    for p in pts:
        cell = [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]
        for q in sorted(near[p] - {p}):
            mx, my, nx, ny = (p[0] + q[0]) / 2, (p[1] + q[1]) / 2, p[0] - q[0], p[1] - q[1]
            cell = cut_by_line(cell, lambda v, mx=mx, my=my, nx=nx, ny=ny: (v[0] - mx) * nx + (v[1] - my) * ny)
        if len(cell) > 2:
            cells.append([*cell, cell[0]])
    return cells


def _inside(p: XY, rings: list[list[XY]]) -> bool:
    odd = False
    for ring in rings:
        for a, b in zip(ring, ring[1:], strict=False):
            if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]):
                odd = not odd
    return odd


#: Pairs of edges, or of points and edges, that are looked at one by one; more are compared as arrays, so many at once.
FEW, MANY = 64, 1 << 20


def _edges(rings: list[list[XY]]) -> list[tuple[XY, XY]]:
    return [(a, b) for ring in rings for a, b in zip(ring, ring[1:], strict=False)]


def _corners(edges: list[tuple[XY, XY]]) -> np.ndarray:
    """x and y of the begins and of the ends, a row each."""
    return np.array([(a[0], a[1], b[0], b[1]) for a, b in edges]).reshape(-1, 4).T


def _inside_all(points: list[XY], rings: list[list[XY]]) -> list[bool]:
    """Whether each point is inside, as ``_inside`` finds."""
    edges = _edges(rings)
    if len(points) * len(edges) <= FEW:
        return [_inside(p, rings) for p in points]
    ax, ay, bx, by = _corners(edges)
    out: list[bool] = []
    step = max(MANY // len(edges), 1)
    for k in range(0, len(points), step):
        px, py = np.array(points[k : k + step])[:, :2].T[:, :, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            hits = ((ay > py) != (by > py)) & (px < ax + (bx - ax) * (py - ay) / (by - ay))
        out += (hits.sum(axis=1) % 2 == 1).tolist()
    return out


def _near(edges: list[tuple[XY, XY]], others: list[tuple[XY, XY]]) -> list[list[tuple[XY, XY]]]:
    """Of each edge those others whose bounds meet its own, or come so close that they may touch."""
    if len(edges) * len(others) <= FEW:
        return [others] * len(edges)
    e, o = _corners(edges), _corners(others)
    room = 1e-8 * (1 + max(np.abs(e).max(), np.abs(o).max()))
    (ex1, ex2), (ey1, ey2), (ox1, ox2), (oy1, oy2) = ((np.minimum(v[k], v[k + 2]) - room * w, np.maximum(v[k], v[k + 2]) + room * w) for v, w in ((e, 1), (o, 0)) for k in (0, 1))
    out: list[list[tuple[XY, XY]]] = [[] for _ in edges]
    step = max(MANY // len(others), 1)
    for k in range(0, len(edges), step):
        at = slice(k, k + step)
        meet = (ex1[at, None] <= ox2) & (ox1 <= ex2[at, None]) & (ey1[at, None] <= oy2) & (oy1 <= ey2[at, None])
        for i, j in zip(*(v.tolist() for v in np.nonzero(meet)), strict=True):
            out[k + i].append(others[j])
    return out


def _key(p: XY) -> XY:
    return round(p[0], 9) + 0.0, round(p[1], 9) + 0.0


def _split(rings: list[list[XY]], others: list[list[XY]]) -> dict[tuple[XY, XY], tuple[XY, XY]]:
    """Edges of rings by their ends, cut where edges or ends of the others meet them."""
    out = {}
    own = _edges(rings)
    for (a, b), near in zip(own, _near(own, _edges(others)), strict=True):
        ux, uy = b[0] - a[0], b[1] - a[1]
        size = ux * ux + uy * uy
        if size < 1e-18:
            continue
        cuts = {0.0: a, 1.0: b}
        for c, d in near:
            vx, vy = d[0] - c[0], d[1] - c[1]
            det = ux * vy - uy * vx
            if abs(det) > 1e-12 * math.sqrt(size * (vx * vx + vy * vy)):
                t = ((c[0] - a[0]) * vy - (c[1] - a[1]) * vx) / det
                u = ((c[0] - a[0]) * uy - (c[1] - a[1]) * ux) / det
                if -1e-12 < t < 1 + 1e-12 and -1e-12 < u < 1 + 1e-12:
                    cuts[t] = (a[0] + ux * t, a[1] + uy * t)
            for p in (c, d):  # ends that lie on the edge
                t = ((p[0] - a[0]) * ux + (p[1] - a[1]) * uy) / size
                if 0 < t < 1 and math.hypot(a[0] + ux * t - p[0], a[1] + uy * t - p[1]) < 1e-9:
                    cuts[t] = p
        at = [cuts[t] for t in sorted(cuts)]
        keys = [_key(p) for p in at]
        for p, q, k, m in zip(at, at[1:], keys, keys[1:], strict=False):
            if k != m:
                out[k, m] = (p, q)
    return out


def combine(g: list[list[XY]], h: list[list[XY]], how: str) -> list[list[XY]]:
    """Rings of the union, intersection or difference of two polygons, given as rings; outer ones counter-clockwise.

    Edges are cut where they meet, those on the border of the result are kept and
    strung together.  Where borders lie on one another, what is inside of both, or of
    one only, shows by their directions, and such an edge is kept once.
    """
    middle = lambda e: ((e[0][0] + e[1][0]) / 2, (e[0][1] + e[1][1]) / 2)
    first, second = _split(g, h), _split(h, g)
    inner = how == "intersection"
    shared = lambda k, m: k in m or k[::-1] in m
    alone, others = [k for k in first if not shared(k, second)], [e for k, e in second.items() if not shared(k, first)]
    within = dict(zip(alone, _inside_all([middle(first[k]) for k in alone], h), strict=True))
    edges = [e for k, e in first.items() if (within[k] == inner if k in within else (k[::-1] if how == "difference" else k) in second)]
    for e, is_in in zip(others, _inside_all([middle(e) for e in others], g), strict=True):
        if is_in == (how != "union"):
            edges.append(e[::-1] if how == "difference" else e)
    after: dict[XY, list[tuple[XY, XY]]] = {}
    for e in edges:
        after.setdefault(_key(e[0]), []).append(e)
    rings = []
    while after:
        begin = at = next(iter(after))
        ring: list[XY] = []
        while at in after:
            ways = after[at]
            if len(ways) > 1 and ring:  # where borders touch in a point: the sharpest turn to the left keeps rings apart
                back = math.atan2(ring[-1][1] - ways[0][0][1], ring[-1][0] - ways[0][0][0])
                ways.sort(key=lambda e: (back - math.atan2(e[1][1] - e[0][1], e[1][0] - e[0][0])) % (2 * math.pi), reverse=True)
            e = ways.pop()
            if not ways:
                del after[at]
            ring.append(e[0])
            at = _key(e[1])
            if at == begin:
                break
        if len(ring) > 2 and at == begin:
            rings.append([*ring, ring[0]])
    return rings


def _signed(ring: list[XY]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def _oriented(parts) -> list[list[XY]]:
    """Rings of all polygons: outer ones counter-clockwise, inner ones clockwise."""
    out = []
    for rings in parts:
        for k, r in enumerate(rings):
            ring = [p[:2] for p in r]
            out.append(ring if (_signed(ring) > 0) == (k == 0) else ring[::-1])
    return out


def _grouped(rings: list[list[XY]]) -> list[list[list[XY]]]:
    """Polygons of rings: holes go to the smallest outer ring around them."""
    outers = sorted((r for r in rings if _signed(r) > 0), key=_signed)
    out = [[r] for r in outers]
    for hole in (r for r in rings if _signed(r) < 0):
        home = next((p for p in out if _inside(hole[0], [p[0]])), None)
        if home:
            home.append(hole)
    return out


def _geometry(gtype: str, parts: list[list[list[XY]]], like) -> dict:
    return {"gtype": gtype, "srid": like["srid"], "dim": 2, "params": [], "metrics": [], "parts": parts}


def _points(g: dict) -> list[XY]:
    return [p[:2] for rings in g["parts"] for r in rings for p in r]


def minimumboundingcircle(g) -> Construction:
    def made(g):
        x, y, r = bounding_circle(_points(flat(g)))
        return _geometry("circle", [[[(x, y)]]], g) | {"params": [r]}

    return Construction([g], made)


def bounding_sphere(points: list[tuple[float, float, float]]) -> tuple[float, ...]:
    """(x, y, z, r) of the smallest sphere: of those on two, three or four of the points, grown point by point."""

    def on(border: list[tuple]) -> tuple[float, ...]:
        """The smallest sphere through some points: its center is theirs plus a combination of the ways between them."""
        if not border:
            return 0.0, 0.0, 0.0, -1.0
        o, ways = border[0], [[b - a for a, b in zip(border[0], p, strict=True)] for p in border[1:]]
        dot = lambda u, v: sum(a * b for a, b in zip(u, v, strict=True))
        rows = [[2 * dot(u, v) for v in ways] + [dot(u, u)] for u in ways]
        for i in range(len(rows)):
            pivot = max(range(i, len(rows)), key=lambda k: abs(rows[k][i]))
            rows[i], rows[pivot] = rows[pivot], rows[i]
            if abs(rows[i][i]) < 1e-12:
                return (*o, -1.0)
            for k in range(len(rows)):
                if k != i:
                    f = rows[k][i] / rows[i][i]
                    rows[k] = [x - f * y for x, y in zip(rows[k], rows[i], strict=True)]
        share = [row[-1] / row[i] for i, row in enumerate(rows)]
        c = [o[j] + sum(f * w[j] for f, w in zip(share, ways, strict=True)) for j in range(3)]
        return (*c, math.dist(c, o))

    holds = lambda s, p: s[3] >= 0 and math.dist(s[:3], p) <= s[3] * (1 + 1e-12) + 1e-12

    def grown(pts: list[tuple], border: list[tuple]) -> tuple[float, ...]:
        best = on(border)
        if len(border) == 4:
            return best
        for i, p in enumerate(pts):
            if not holds(best, p):
                best = grown(pts[:i], [*border, p])
        return best

    return grown(list(dict.fromkeys(points)), [])


def minimumboundingsphere(g) -> Construction:
    """Of the vertices in space; a missing z is 0."""
    def made(g):
        x, y, z, r = bounding_sphere([(p[0], p[1], 0.0 if math.isnan(p[2]) else p[2]) for rings in g["parts"] for ring in rings for p in ring])
        return {"gtype": "sphere", "srid": g["srid"], "dim": 3, "params": [r], "metrics": [], "parts": [[[(x, y, z)]]]}

    return Construction([g], made)


def concavehull(g, longest: float) -> Construction:
    """The outline of the Delaunay triangles whose sides are no longer than ``longest``; the convex hull if that leaves none."""
    def made(g):
        points = _points(flat(g))
        kept = [t for t in delaunay(points) if all(math.dist(a, b) <= longest for a, b in zip(t, (*t[1:], t[0]), strict=True))]
        edges = {(a, b) for t in kept for a, b in zip(t, (*t[1:], t[0]), strict=True)}
        after: dict[XY, list[XY]] = {}
        for a, b in sorted(edges):
            if (b, a) not in edges:
                after.setdefault(a, []).append(b)
        rings = []
        while after:
            ring = [next(iter(after))]
            while ring[-1] in after:
                ways = after[ring[-1]]
                step = ways.pop()
                if not ways:
                    del after[ring[-1]]
                ring.append(step)
                if step == ring[0]:
                    break
            rings.append(ring)
        polygons = _grouped(rings) or [[hull(points)]]
        return _geometry("polygon" if len(polygons) == 1 else "multipolygon", polygons, g)

    return Construction([g], made)


def delaunaytriangles(g, tolerance: float = 0.0) -> Construction:
    """The Delaunay triangles of the vertices, as a multipolygon."""
    return Construction([g], lambda g: _geometry("multipolygon", [[[a, b, c, a]] for a, b, c in delaunay(_points(g), tolerance)], g))


def voronoipolygons(g, tolerance: float = 0.0, bounds: tuple[float, float, float, float] | None = None) -> Construction:
    return Construction([g], lambda g: _geometry("multipolygon", [[c] for c in voronoi(_points(g), bounds, tolerance)], g))


def voronoilines(g, tolerance: float = 0.0, bounds: tuple[float, float, float, float] | None = None) -> Construction:
    """The borders of the cells, each once."""
    def made(g):
        sides = {frozenset((_key(a), _key(b))): (a, b) for c in voronoi(_points(g), bounds, tolerance) for a, b in zip(c, c[1:], strict=False)}
        return _geometry("multilinestring", [[list(s)] for k, s in sides.items() if len(k) == 2], g)

    return Construction([g], made)


def _boolean(how: str):
    def made(g, h):
        polygons = _grouped(combine(_oriented(flat(g)["parts"]), _oriented(flat(h)["parts"]), how))
        return _geometry("polygon" if len(polygons) == 1 else "multipolygon", polygons, g)

    return lambda g, h: Construction([g, h], made)


union, intersection, difference = map(_boolean, ("union", "intersection", "difference"))


def symdifference(g, h) -> Construction:
    """Both differences together, as a multipolygon."""
    def made(g, h):
        p, q = (_oriented(flat(v)["parts"]) for v in (g, h))
        return _geometry("multipolygon", _grouped(combine(p, q, "difference")) + _grouped(combine(q, p, "difference")), g)

    return Construction([g, h], made)


def buffer(g, distance: float, sides: int = geo.SIDES, right: float | None = None, join: str = "round", end: str = "round", point: str = "circle") -> Construction:
    """All within a distance, as polygons that are united.

    right: another distance to the right of lines.  join: corners, "round" or "miter";
    end: of lines, "round" or "flat"; point: around points, "circle" or "square".
    """
    right = distance if right is None else right
    turns = [(math.cos(2 * math.pi * k / sides), math.sin(2 * math.pi * k / sides)) for k in range(sides)]
    disc = lambda p, r: [(p[0] + x * r, p[1] + y * r) for x, y in turns]

    def strip(a: XY, b: XY) -> list[XY]:
        size = math.dist(a, b)
        nx, ny = -(b[1] - a[1]) / size, (b[0] - a[0]) / size
        return [(p[0] + nx * d, p[1] + ny * d) for p, d in ((a, -right), (b, -right), (b, distance), (a, distance))]

    def corner(a: XY, b: XY, c: XY) -> list[XY]:
        """What two strips leave open on the outer side of a corner."""
        d = distance if _turn(a, b, c) < 0 else right
        if join == "round":
            return disc(b, d)
        ways = [(-(q[1] - p[1]) / math.dist(p, q), (q[0] - p[0]) / math.dist(p, q)) for p, q in ((a, b), (b, c))]
        sign = 1 if _turn(a, b, c) < 0 else -1
        (px, py), (qx, qy) = ((sign * d * x, sign * d * y) for x, y in ways)
        det = 1 + (px * qx + py * qy) / (d * d)
        tip = [] if det < 1e-6 else [(b[0] + (px + qx) / det, b[1] + (py + qy) / det)]
        return [b, (b[0] + px, b[1] + py), *tip, (b[0] + qx, b[1] + qy)]

    def around(line: list[XY], closed: bool) -> list[list[XY]]:
        line = [p for k, p in enumerate(line) if not k or p != line[k - 1]]
        if len(line) < 2:
            return [disc(line[0], distance)]
        out = [strip(a, b) for a, b in zip(line, line[1:], strict=False)]
        turns_ = list(zip(line, line[1:], line[2:], strict=False)) + ([(line[-2], line[0], line[1])] if closed else [])
        out += [corner(*t) for t in turns_ if abs(_turn(*t)) > 1e-12 or join == "round"]
        return out if closed or end == "flat" else [*out, disc(line[0], max(distance, right)), disc(line[-1], max(distance, right))]

    def made(g):
        g = flat(g)
        pieces: list[list[XY]] = []
        if g["gtype"] in ("point", "multipoint"):
            square_ = lambda p: [(p[0] + x * distance, p[1] + y * distance) for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
            pieces = [square_(p) if point == "square" else disc(p, distance) for p in _points(g)]
            whole: list[list[XY]] = []
        else:
            areal = g["gtype"] in geo.AREAL
            for rings in g["parts"]:
                for r in rings:
                    pieces += around([p[:2] for p in r], areal)
            whole = _oriented(g["parts"]) if areal else []
        for p in pieces:
            ring = hull(p)
            if len(ring) > 3:
                whole = combine(whole, [ring], "union") if whole else [ring]
        polygons = _grouped(whole)
        return _geometry("polygon" if len(polygons) == 1 else "multipolygon", polygons, g)

    return Construction([g], made)
