"""Shapes over the antimeridian and the poles, and shapes given as text."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from hexweave.functions import icosahedron as ico
from hexweave.functions.geodesy import register, with_centers
from hexweave.functions.geometry import dateline_parts, parse_wkt, polygon_wkt
from hexweave.operators import lines as ln
from hexweave.operators import places as pl

SHAPE = "id long, ring array<array<struct<x double, y double>>>"


def ring(*xy):
    return [(float(x), float(y)) for x, y in xy]


# Two islands on both sides, one with a hole over the line; a cap; an ordinary shape.
FIJI = [ring((177, -19), (-179, -19), (-179, -16), (177, -16), (177, -19)), ring((179.5, -18), (-179.75, -18), (-179.75, -17), (179.5, -17), (179.5, -18))]
ANTARCTICA = [ring(*[(x, -70 + 5 * np.sin(np.radians(3 * x))) for x in range(-180, 180, 5)], (-180, -70 + 5 * np.sin(np.radians(-540))))]
PLAIN = [ring((10, 40), (14, 40), (12, 44), (10, 40))]


def inside(name, x, y):
    if name == 1:
        x = x % 360
        return (177 <= x < 181) and -19 <= y < -16 and not (179.5 <= x < 180.25 and -18 <= y < -17)
    if name == 2:
        knots = [(k, v) for k, v in ANTARCTICA[0][:-1]] + [(180.0, ANTARCTICA[0][0][1])]
        return y < np.interp(x, [k for k, _ in knots], [v for _, v in knots])
    return 40 <= y < 44 and 10 + (y - 40) / 2 <= x < 14 - (y - 40) / 2


@pytest.fixture(scope="module")
def shapes(spark):
    return spark.createDataFrame([(1, FIJI), (2, ANTARCTICA), (3, PLAIN), (4, []), (5, None)], SHAPE)


def test_points(spark, shapes):
    rng = np.random.default_rng(2)
    spots = [(float(x), float(y)) for x, y in np.column_stack([rng.uniform(-180, 180, 400), rng.uniform(-90, -55, 400)])]
    spots += [(float((x + 180) % 360 - 180), float(y)) for x, y in np.column_stack([rng.uniform(176, 182, 300), rng.uniform(-20, -15, 300)])]
    spots += [(float(x), float(y)) for x, y in np.column_stack([rng.uniform(9, 15, 80), rng.uniform(39, 45, 80)])]
    pts = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "pid long, x double, y double")
    got = {(r.pid, r.id) for r in ln.points_in_polygons(pts, shapes, "id", dateline=True).collect()}
    assert got == {(i, k) for i, p in enumerate(spots) for k in (1, 2, 3) if inside(k, *p)}


def test_parts(shapes):
    parts = {r.id: r.parts for r in shapes.select("id", dateline_parts("ring").alias("parts")).collect()}
    assert len(parts[1]) == 2 and len(parts[3]) == 1 and parts[3][0] == [[tuple(v) for v in PLAIN[0]]]
    for x in (v.x for k in (1, 2) for part in parts[k] for one in part for v in one):
        assert -180 <= x <= 180


def test_cells(spark, shapes):
    found = with_centers(pl.polygons_to_cells(shapes.where("ring is not null"), "id", 3, dateline=True), "h3")
    got = {}
    for r in found.collect():
        got.setdefault(r.id, set()).add(r.h3)
    cells = spark.range(122).select(pl.base_cell_centers()[F.col("id").cast("int")]["h0"].alias("h"))
    for _ in range(3):
        cells = cells.select(F.explode(pl.direct_children(F.col("h"))).alias("h"))
    every = with_centers(cells, "h").collect()
    for k in (1, 2, 3):
        assert got[k] == {r.h for r in every if inside(k, r.lng, r.lat)}
    assert found.count() == sum(map(len, got.values()))  # no cell twice


def test_texts(spark):
    long = ", ".join(f"{i / 1000} {i % 7}" for i in range(30_000)) + ", 0.0 0"
    rows = [
        ("POLYGON ((0 0, 4 0, 4 4, 0 0))", 1), ("polygon((0 0,4 0,4 4,0 0),(1 1 , 2 1, 2 2, 1 1))", 2),
        (" MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, -6.5e0 5, 6 .5, 5 5), (5.1 5.1, 5.2 5.1, 5.2 5.2, 5.1 5.1))) ", 3),
        ("POLYGON Z ((0 0 9, 4 0 9, 4 4 9, 0 0 9))", 1), ("POLYGON EMPTY", 0), ("MULTIPOLYGON EMPTY", 0), (f"POLYGON (({long}))", 1),
        ("POINT (1 2)", None), ("POLYGON ((a b, c d))", None), ("POLYGON ((1, 2 3))", None), ("", None), (None, None), ("POLYGON ((0 0, 1 1", None),
    ]
    out = spark.createDataFrame([(i, w) for i, (w, _) in enumerate(rows)], "i int, w string").select("i", parse_wkt("w").alias("r")).collect()
    for r in out:
        assert (None if r.r is None else len(r.r)) == rows[r.i][1]
        if r.r:
            want = [[tuple(float(n) for n in v.split()[:2]) for v in part.split(",")] for part in re.findall(r"\(([^()]+)\)", rows[r.i][0])]
            assert [[tuple(v) for v in one] for one in r.r] == want


def test_table_function(spark, sf):
    """From SQL, with columns and with literals, as the operator that spreads shapes."""
    queries = entry_point.queries()
    from hexweave.plans import inputs as t

    got = {tuple(r) for r in queries["polygon_cells_wkt"](spark, sf).collect()}
    want = {(r.aoi_id, r.h3) for r in pl.polygons_to_cells(t.boxes(spark, sf), "aoi_id", 3).collect()}
    assert got == want and got
    register(spark)
    hole = "POLYGON ((0 50, 10 50, 10 60, 0 60, 0 50), (2 52, 8 52, 8 58, 2 58, 2 52))"
    one = {r.h for r in spark.sql(f"SELECT h FROM h3_polygon_wkt_to_cells('{hole}', 4)").collect()}
    lat, lng = ico.to_latlng(ico.center(np.array(sorted(one))))
    assert ((lng >= 0) & (lng < 10) & (lat >= 50) & (lat < 60) & ~((lng >= 2) & (lng < 8) & (lat >= 52) & (lat < 58))).all()
    spread = spark.createDataFrame([(1, hole)], "id int, w string").select("id", parse_wkt("w").alias("ring"))
    assert one == {r.h4 for r in pl.polygons_to_cells(spread, "id", 4).collect()}
    assert spark.sql("SELECT h FROM h3_polygon_wkt_to_cells('POINT (1 2)', 2)").collect() == []
    assert spark.createDataFrame([(1, hole)], "id int, w string").select(polygon_wkt(parse_wkt("w")).alias("w")).first().w.count("(") == 3
