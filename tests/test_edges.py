"""The index of polygon edges against the tests that walk whole rings."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexweave.functions.geometry import length_inside_rings, planar_length, point_in_rings
from hexweave.operators import edges as ed
from hexweave.operators import lines as ln

SHAPE = "id long, ring array<array<struct<x double, y double>>>"


def star(n, x, y, r, seed):
    """A coast line: its distance from the middle wanders."""
    rng = random.Random(seed)
    ring, d = [], 0.7 * r
    for i in range(n):
        a = 2 * math.pi * i / n
        d = min(r, max(0.3 * r, d + r * rng.uniform(-9, 9) / n))
        ring.append((x + d * math.cos(a), y + d * math.sin(a)))
    return [*ring, ring[0]]


def box(w, s, e, n):
    return [(float(x), float(y)) for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))]


@pytest.fixture(scope="module")
def polygons(spark):
    rows = [
        (1, [star(400, 10, 20, 8, 1)]), (2, [star(90, 14, 22, 5, 2), box(13, 21, 15, 23)]),
        (3, [box(0, 0, 1, 1), box(4, 0, 6, 2)]), (4, [box(9, 19, 9.5, 19.5)]), (5, None), (6, []),
        (7, [box(-179, -80, 179, 80)]), (8, [[(0.0, 0.0), (2.0, 2.0), (4.0, 0.0), (2.0, -2.0), (0.0, 0.0)]]),
    ]
    return spark.createDataFrame(rows, SHAPE)


def points(spark):
    rng = random.Random(8)
    spots = [(rng.uniform(0, 24), rng.uniform(-3, 30)) for _ in range(300)]
    spots += [(a, b) for a in (0.0, 0.5, 1.0, 2.0, 4.0, 6.0, 9.0, 9.5, 13.0, 15.0) for b in (-2.0, 0.0, 1.0, 2.0, 19.0, 19.5, 21.0, 23.0)]
    return spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "pid long, x double, y double")


def test_points_as_by_the_rings(spark, polygons, monkeypatch):
    monkeypatch.setattr(ed, "MOST", 8)
    index = ed.edge_index(polygons, "id")
    assert index.squares.agg(F.max(F.size("edges"))).first()[0] <= 12
    pts = points(spark)
    got = {(r.pid, r.id) for r in ln.points_in_polygons(pts, polygons, "id").collect()}
    walked = pts.crossJoin(polygons.where("ring is not null")).where(point_in_rings("ring", "x", "y"))
    assert got == {(r.pid, r.id) for r in walked.collect()}
    # Every point is counted, those in no polygon in the group of none.
    stats = {r.id: r.n_pixels for r in ln.zonal_stats(pts, polygons, "id", "y").collect()}
    held = {p for p, _ in got}
    assert stats.get(None, 0) == pts.count() - len(held)
    assert all(stats[k] == sum(i == k for _, i in got) for k in {i for _, i in got})


def test_lengths_as_by_the_rings(spark, polygons):
    rng = random.Random(3)
    lines = [(i, [(rng.uniform(0, 22), rng.uniform(-2, 28)) for _ in range(rng.randint(2, 6))]) for i in range(40)]
    lines += [(50, [(9.0, 19.0), (9.5, 19.0)]), (51, [(0.5, -1.0), (0.5, 3.0)]), (52, [(3.0, 3.0), (3.0, 3.0)])]
    df = spark.createDataFrame([(i, 1.0, p) for i, p in lines], "lid long, km double, line array<struct<x double, y double>>").withColumn("km", planar_length("line"))
    shapes = polygons.where("ring is not null and size(ring) > 0")
    cells = lambda d, k: d.select(k, F.lit(8).cast("long").alias("h8"), F.lit(0).cast("long").alias("h0"))
    got = {r.id: r.length_inside for r in ln.clip_length(cells(df, "lid"), cells(shapes, "id"), df, shapes, 8, "lid", "id", "km").collect()}
    walked = df.crossJoin(shapes).groupBy("id").agg(F.sum(length_inside_rings("line", "ring")).alias("v"))
    want = {r.id: r.v for r in walked.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_a_region_of_a_hundred_thousand_vertices(spark):
    """Squares hold few edges each, so a point's cost does not follow the ring."""
    ring = star(100_000, 5, 45, 6, 4)
    index = ed.edge_index(spark.createDataFrame([(1, [ring])], SHAPE), "id")
    sizes = [r[0] for r in index.squares.select(F.size("edges")).collect()]
    assert max(sizes) <= ed.MOST and len(sizes) < 50_000
    rng = np.random.default_rng(1)
    xy = np.column_stack([rng.uniform(-2, 12, 300), rng.uniform(38, 52, 300)])
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "pid long, x double, y double")
    got = {r.pid for r in ed.with_holders(pts, index, "x", "y", "held").where(F.size("held") > 0).collect()}
    v = np.array(ring)
    a, b = v[:-1], v[1:]
    want = set()
    for i, (x, y) in enumerate(xy):
        spans = (a[:, 1] > y) != (b[:, 1] > y)
        at = a[spans, 0] + (y - a[spans, 1]) * (b[spans, 0] - a[spans, 0]) / (b[spans, 1] - a[spans, 1])
        if (x < at).sum() % 2:
            want.add(i)
    assert got == want


def test_totals_make_no_pairs(spark):
    """Counts and sums equal those of the pairs, though points inside a shape are counted by square and few are tested."""
    rng = random.Random(7)
    rows = [(i, rng.uniform(-60, 60), rng.uniform(-40, 40)) for i in range(12000)] + [(-1, None, 3.0), (-2, 10.0, 10.0), (-2, 10.0, 10.0)]
    points = spark.createDataFrame(rows, "pid long, x double, y double").repartition(4)
    shapes = []
    for i in range(120):
        w, s, d = rng.uniform(-60, 20), rng.uniform(-40, 10), rng.uniform(5, 30)
        shapes.append((None if i == 5 else i % 119, [(w, s), (w + d, s), (w + d, s + d), (w, s + d), (w, s)]))
    polygons = spark.createDataFrame(shapes, "id int, ring array<struct<x double, y double>>")
    pairs = ln.points_in_polygons(points, polygons, "id")
    want = {r.id: (r.n, r.ids) for r in pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("pid").alias("ids")).collect()}
    got = ln.points_in_polygons(points, polygons, "id", sums={"ids": "pid"}).collect()
    assert len(got) == len(want) and {r.id: (r.n, r.ids) for r in got} == want
    met = ed.meet(points, ed.edge_index(polygons, "id"), "x", "y", {"ids": "pid"})
    tested = sum(met.tested(level).join(met.located(met.points, level), (F.col("s.bx") == F.col("_bx")) & (F.col("s.by") == F.col("_by"))).count() for level in met.levels)
    assert tested < sum(n for n, _ in want.values())
    held = {r.pid for r in pairs.select("pid").collect()}
    assert sorted(r.ids for r in ed.outside_all(met).collect()) == sorted(p for p, _, _ in rows if p not in held)
    stats = {r.id: r.n_pixels for r in ln.zonal_stats(points, polygons, "id", "y").collect()}
    assert stats == {k: n for k, (n, _) in want.items() if k is not None} | {None: want.get(None, (0, 0))[0] + sum(p not in held for p, _, _ in rows)}


def test_segments_meet_the_edges_that_reach_them(spark):
    """Lines through corners, along edges, past edges whose own line they cross, and out of the squares."""
    from pyspark.sql import functions as F

    from hexweave.functions.geometry import length_inside_rings, planar_length
    from hexweave.operators.edges import edge_index, lengths_inside

    box = [(0.0, 0.0), (10.0, 0.0), (10.0, 8.0), (0.0, 8.0), (0.0, 0.0)]
    hole = [(3.0, 2.0), (7.0, 2.0), (7.0, 6.0), (3.0, 6.0), (3.0, 2.0)]
    lines = [
        [(-1.0, -1.0), (11.0, 11.0)], [(0.0, 0.0), (10.0, 8.0)], [(3.0, -5.0), (3.0, 20.0)], [(-4.0, 4.0), (30.0, 4.0)],
        [(1.0, 1.0), (2.0, 1.5)], [(20.0, 1.0), (21.0, 9.0)], [(5.0, 4.0), (5.0, 4.0)], [(9.5, -0.5), (10.5, 0.5)], [(2.9, 9.0), (7.3, -1.0)],
    ]
    schema = "id bigint, ring array<array<struct<x:double,y:double>>>"
    regions = spark.createDataFrame([(1, [box, hole]), (2, [box]), (3, [hole, box])], schema)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_id bigint, line array<struct<x:double,y:double>>")
    for i, line in enumerate(lines):
        one = rows.where(F.col("line_id") == i).crossJoin(regions)
        want = {r.id: r.v for r in one.select("id", length_inside_rings("line", "ring").alias("v")).collect()}
        (ax, ay), (bx, by) = line
        s = F.struct(F.lit(ax).alias("ax"), F.lit(ay).alias("ay"), F.lit(bx).alias("bx"), F.lit(by).alias("by"))
        segments = regions.select("id", s.alias("s"), F.lit(((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5).alias("m"))
        got = {r.id: r.v for r in lengths_inside(segments, edge_index(regions, "id"), "m", "v").collect()}
        assert all(abs(got.get(k, 0.0) - (v or 0.0)) < 1e-9 for k, v in want.items()), (i, got, want)


def test_squares_of_a_segment_are_no_list_of_lists(spark):
    """They were flattened element by element, which took most of the time of a segment."""
    from pyspark.sql import functions as F

    from hexweave.operators.edges import edge_index, lengths_inside

    box = [(0.0, 0.0), (10.0, 0.0), (10.0, 8.0), (0.0, 8.0), (0.0, 0.0)]
    regions = spark.createDataFrame([(1, [box])], "id bigint, ring array<array<struct<x:double,y:double>>>")
    s = F.struct(*[F.lit(float(v)).alias(c) for c, v in (("ax", 1), ("ay", 1), ("bx", 9), ("by", 7))])
    found = lengths_inside(regions.select("id", s.alias("s"), F.lit(10.0).alias("m")), edge_index(regions, "id"), "m", "v")
    assert "flatten" not in found._jdf.queryExecution().optimizedPlan().toString() and abs(found.first().v - 10.0) < 1e-9


def test_squares_with_one_edge_are_cut_by_compiled_code(spark):
    """As by the lists that were walked for each of them, which took most of the time of many polygons."""
    rng = random.Random(4)
    ends = [(rng.uniform(-30, 30), rng.uniform(-30, 30), rng.uniform(-30, 30), rng.uniform(-30, 30)) for _ in range(40)]
    ends += [(0.0, -9.0, 0.0, 9.0), (-22.5, 5.0, 22.5, 5.0), (5.0, 5.0, 5.0, 5.0), (None, 1.0, 2.0, 3.0), (float("nan"), 1.0, 2.0, 3.0)]
    rows = [
        (None if i == 3 else i, (4, bx, by, bx * 22.5 - 180 + 22.5 * ed.AT_X, by * 22.5 - 90 + 22.5 * ed.AT_Y, i % 2 == 0, [e]))
        for i, e in enumerate(ends) for bx in (7, 8) for by in (3, 4)
    ]
    struct = "struct<level int, bx long, by long, cx double, cy double, inside boolean, edges array<struct<ax double, ay double, bx double, by double>>>"
    squares = spark.createDataFrame(rows, f"id long, s {struct}")
    cut = ed._cut_children(squares, "id", 4)
    walked = squares.select("id", F.explode(ed._children(F.col("s"))).alias("s"))
    assert cut.schema["s"].dataType.simpleString() == walked.schema["s"].dataType.simpleString()
    assert sorted(map(repr, cut.collect())) == sorted(map(repr, walked.collect())) and "lambda" not in cut._jdf.queryExecution().optimizedPlan().toString()
    x, y = F.lit(1.3), F.lit(-2.1)
    both = squares.select(ed.inside_cut_square(F.col("s"), x, y).alias("a"), ed.inside_square(F.col("s"), x, y).alias("b"))
    assert both.where("not a <=> b").isEmpty()
