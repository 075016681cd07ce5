"""What keeps queries from growing faster than their tables: rows dealt over all cores, plans that stay small, comparisons that are bounded."""

import math
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestar.functions import geometry as geo
from lodestar.functions import geometry_kernels as kernels
from lodestar.functions import line_kernels as along
from lodestar.operators import joins
from lodestar.plans import registry, shapes, spatial  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["geo_constructions", "geo_overlay", "geo_overlay_borders"])
def test_rows_of_a_small_file_are_dealt_over_all_cores(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).rdd.getNumPartitions() >= 48


def test_edges_compared_as_arrays_are_those_compared_one_by_one(monkeypatch):
    """Unions and differences of many-sided discs, some of which touch, are the same either way."""
    rng = random.Random(4)
    disc = lambda x, y, r: [(x + r * math.cos(math.pi * k / 16), y + r * math.sin(math.pi * k / 16)) for k in (*range(32), 0)]
    for _ in range(10):
        g, h = [disc(0, 0, 2)], [disc(rng.choice([4.0, rng.uniform(-3, 3)]), rng.choice([0.0, rng.uniform(-3, 3)]), 2)]
        got = []
        for few in (0, 1 << 30):
            monkeypatch.setattr(kernels, "FEW", few)
            got.append([kernels.combine(g, h, how) for how in ("union", "intersection", "difference")])
        assert got[0] == got[1]


def test_shapes_go_through_arrow_whole(spark):
    """Nulls, a z, sizes and the SRID come and go as they are; an input of several constructions is one column."""
    df = spark.range(3).select("id", F.when(F.col("id") > 0, geo.circle("id", 1, 2, srid=7)).alias("g"))
    made = kernels.with_shapes(df, a=kernels.minimumboundingcircle("g"), b=kernels.minimumboundingsphere(geo.point("id", 1, "id")), c=kernels.minimumboundingcircle("g")).orderBy("id").collect()
    assert [r.a is None for r in made] == [True, False, False] and [r.b.parts[0][0][0].z for r in made] == [0.0, 1.0, 2.0]
    assert made[2].a == made[2].c and made[2].a.srid == 7 and made[2].a.params[0] == pytest.approx(2) and made[2].a.parts[0][0][0].z is None


def test_a_plan_of_geojson_holds_its_text_once(spark):
    """The text that is read is a large expression itself; with a copy of it for each use the driver's memory ran out."""
    df = registry.QUERIES["geo_geojson"](spark, FOLDER)
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 100_000


def _suppliers(folder, balances):
    pq.write_table(pa.table({"s_suppkey": list(balances), "s_acctbal": list(balances.values())}), f"{folder}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{folder}/supplier.parquet'")
    return {tuple(row) for row in con.execute(registry.ORACLE_SQL["geo_intersect"]).fetchall()}


def test_rectangles_that_just_meet(spark, tmp_path):
    """Supplier k + 50 lies above k by just their heights, where bounds may round to either side."""
    rng = random.Random(6)
    low = {k: rng.randrange(-99_999, 999_999) for k in (m + 100 * i for i in range(40) for m in range(1, 51))}
    expected = _suppliers(tmp_path, {**{k: v / 100 for k, v in low.items()}, **{k + 50: (v + 20_000 * (2 + k % 5)) / 100 for k, v in low.items()}})
    assert {tuple(row) for row in registry.QUERIES["geo_intersect"](spark, str(tmp_path)).collect()} == expected


def test_points_of_one_cell_are_dealt_to_several_tasks(spark):
    """Nearness of points that all lie in one cell, and of some beside it, against all pairs; no task has all of them."""
    rng = random.Random(8)
    points = lambda n: [(k, rng.uniform(0, 1), rng.choice([0.5, rng.uniform(-4, 4)])) for k in range(n)]
    a, b = points(300), points(40)
    made = joins.within_join(spark.createDataFrame(a, "i int, x double, y double"), spark.createDataFrame(b, "j int, p double, q double"), "x", "y", "p", "q", 2.0, split=4)
    rows = made.withColumn("task", F.spark_partition_id()).collect()
    assert {(r.i, r.j) for r in rows} == {(i, j) for i, x, y in a for j, p, q in b if math.hypot(x - p, y - q) <= 2.0} and len(rows) == len({(r.i, r.j) for r in rows})
    assert len({r.task for r in rows}) > 4


def _simple(v):
    """No two edges meet but neighbours; a closed line's first and last are neighbours."""
    turn = lambda o, p, q: (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
    on = lambda p, a, b: turn(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])
    edges = list(zip(v, v[1:], strict=False))
    for i, (a, b) in enumerate(edges):
        for j in range(i + 1, len(edges)):
            c, d = edges[j]
            touch = on(a, c, d) or on(b, c, d) or on(c, a, b) or on(d, a, b)
            if turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0 or touch and j > i + 1 and not (i == 0 and j == len(edges) - 1 and a == d):
                return False
    return True


def test_measures_of_many_lines_are_those_of_the_functions(spark):
    """Lines of two to nine points on a coarse grid, so that many touch, cross, close or stand still; some have a z, two are null or in two pieces."""
    rng = random.Random(11)
    rows = [(k, [tuple(float(rng.randrange(4)) for _ in "xy") + (rng.choice([None, 1.0]) if k % 3 == 0 else None,) for _ in range(2 + k % 8)]) for k in range(400)]
    df = spark.createDataFrame(rows, f"id int, v array<{geo.POINT}>").select("id", F.when(F.col("id") != 7, geo.linestring(F.col("v"))).alias("g"))
    df = df.withColumn("g", F.when(F.col("id") == 9, geo.multilinestring(F.array(geo.vertices("g"), geo.vertices("g")))).otherwise(F.col("g"))).localCheckpoint()

    def measures(lines):
        half = along.interpolate(lines, 0.5)
        return {"x": half[0], "z": half[2], "part": along.substring_length(lines, 0.25, 0.75), "at": along.locate(lines, half), "near": along.nearest(lines, 1.2, 2.1), "simple": along.simple(lines)}

    got = along.with_measures(df, "g", ["id"], measures, "x double, z double, part double, at double, near double, simple boolean")
    g = geo.known(F.col("g"), "linestring", 0)
    half, p = geo.center(geo.interpolate(g, 0.5)), geo.xyz(1.2, 2.1)
    flat = df.select("id", half["x"].alias("x"), F.coalesce(half["z"], F.lit(0.0)).alias("z"), geo.linelength(geo.linesubstring(g, 0.25, 0.75)).alias("part"), geo.locatepoint(g, half).alias("at"), geo.straight(geo.center(geo.knn(g, p, 1)), p).alias("near"))
    mixed = {r[0] for r in rows if len({v[2] is None for v in r[1]}) > 1}  # where the functions have no z between a point with one and a point without
    own, expected = ({r.id: r[1:] for r in d.collect()} for d in (got, flat))
    assert own[7] == own[9] == (None,) * 6 and len(own) == len(rows)
    for k in own.keys() - mixed - {7, 9}:
        assert [v if v is None else round(v, 9) for v in own[k][:-1]] == [v if v is None else round(v, 9) for v in expected[k]], rows[k]
    plain = [r for r in rows if r[0] % 3 and r[0] not in (7, 9)]
    assert [own[k][-1] for k, _ in plain] == [_simple([p[:2] for p in v]) for k, v in plain] and {own[k][-1] for k, _ in plain} == {True, False}


def test_lines_of_orders_are_dealt_over_all_cores(spark):
    assert all(registry.QUERIES[name](spark, FOLDER).rdd.getNumPartitions() >= 48 for name in ("geo_along_lines", "geo_midpoints"))


def test_tasks_of_near_points_grow_with_their_pairs(spark, monkeypatch):
    """Cells of many pairs are split further, others aren't; the result is that of all pairs, also far below and above a usual distance."""
    monkeypatch.setattr(joins, "PAIRS", 500)
    rng = random.Random(9)
    points = lambda n: [(k, rng.uniform(0, 1), rng.uniform(0, 1)) for k in range(n)] + [(n + k, 20.0 + k, 7.0) for k in range(20)]
    a, b = [*points(600), (-1, 0.5, 1e-200), (-2, 1e200, 0.0)], [*points(60), (-1, 0.5, 0.0)]
    made = joins.within_join(spark.createDataFrame(a, "i int, x double, y double"), spark.createDataFrame(b, "j int, p double, q double"), "x", "y", "p", "q", 2.0, split=2)
    rows = made.withColumn("task", F.spark_partition_id()).collect()
    assert {(r.i, r.j): r.distance for r in rows} == {(i, j): pytest.approx(d, rel=1e-14, abs=0) for i, x, y in a for j, p, q in b if (d := math.hypot(x - p, y - q)) <= 2.0}
    assert len(rows) == len({(r.i, r.j) for r in rows}) and made.columns == ["i", "x", "y", "j", "p", "q", "distance"]
    of = [0] * (1 + max(r.task for r in rows))
    for r in rows:
        of[r.task] += 1
    assert max(of) < 6 * 500


def test_lines_are_made_of_sorted_items(spark):
    """Lines of one to nine vertices in many small batches, with repeats, nulls and an id of null, against plain Python; no items are gathered into arrays by Spark."""
    rng = random.Random(12)
    rows = [(rng.choice([None, *range(60)]), rng.randrange(9), float(rng.randrange(5)), float(rng.randrange(5))) for _ in range(400)] + [(70, k, float(k), 0.0) for k in range(95)] + [(71, 1, 0.0, 0.0)]
    expected = {}
    for i, n, x, y in rows:
        own = expected.setdefault(i, {})
        own[n] = min(own.get(n, (x, y)), (x, y))
    expected = {i: [own[n] for n in sorted(own)] for i, own in expected.items() if len(own) > 1}
    items = spark.createDataFrame(rows, "id long, n int, x double, y double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        made = {r.id: [(p.x, p.y) for p in r.v] for r in along.as_lines(items, 3, rows=5).collect()}
        measured = {r.id: (r.points, r.total) for r in along.of_items(items, 3, lambda lines: {"total": lines.total}, "total double", rows=5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert made == expected
    assert measured == {i: (len(v), pytest.approx(sum(math.dist(p, q) for p, q in zip(v, v[1:], strict=False)))) for i, v in expected.items()}
    plan = registry.QUERIES["geo_midpoints"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Exchange") == 1
