"""Queries on cell geometry that SQL cannot derive: invariants and brute force over their results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from hexweave.functions import icosahedron as ico
from hexweave.functions import tilemath as tm
from hexweave.functions.cells import cell_parent, great_circle
from hexweave.functions.geodesy import cell_area, cell_center, latlng_to_cell, with_centers
from hexweave.functions.geometry import bounds
from hexweave.operators import measures as m
from hexweave.operators import places as pl
from hexweave.plans import inputs as t

QUERIES = entry_point.queries()
REACH = 1.5  # a cell's farthest corner, in edges


@pytest.fixture
def run(spark, sf):
    return lambda name: QUERIES[name](spark, sf)


def test_points_lie_nearest_to_the_centre_of_their_cell(spark, sf):
    """The centres of a cell's neighbours are farther from its points than its own."""
    points = pl.index_points(t.points(spark, sf).limit(400), 7).withColumn("c", cell_center("h7"))
    points = points.withColumn("km", great_circle("lat", "lng", "c.lat", "c.lng"))
    assert points.where(F.col("km") > REACH * tm.EDGE_KM[7]).isEmpty()
    around = points.select("lat", "lng", "km", F.explode(pl.grid_disk("h7", 1)).alias("n")).withColumn("c", cell_center("n"))
    closer = great_circle("lat", "lng", "c.lat", "c.lng") < F.col("km") * 0.8
    assert around.where(closer).isEmpty()
    back = with_centers(points.select("h7").distinct(), "h7")
    assert back.where(latlng_to_cell("lat", "lng", 7) != F.col("h7")).isEmpty()


def test_areas(spark, sf, run):
    rows = run("cell_area").collect()
    rings = {r.h8: r for r in run("cell_boundary").collect()}
    for r in rows[:300]:
        assert abs(r.m2 / r.km2 - 1e6) < 1e-3
        # The outline's planar area, shrunk by the latitude, is the sphere's to a thousandth at this size.
        ring = rings[r.h8].ring
        k = ico.EARTH_RADIUS_KM * math.pi / 180
        planar = abs(sum(a.x * b.y - b.x * a.y for a, b in zip(ring, ring[1:]))) / 2 * k * k * math.cos(math.radians(rings[r.h8].lat))
        assert abs(planar / r.km2 - 1) < 2e-3
    km2 = {r.h8: r.km2 for r in rows}
    feature = {r.h8 for r in t.feature_hex(spark, sf).select("h8").distinct().collect()}
    direct = {r.h8: r.a for r in t.feature_hex(spark, sf).select("h8").distinct().withColumn("a", cell_area("h8")).collect()}
    assert all(abs(direct[h] - km2[h]) < 1e-12 for h in feature & km2.keys())
    assert abs(run("area_exact").first().area - sum(direct.values())) < 1e-6
    groups = {}
    for r in t.feature_hex(spark, sf).select("status", "h8").distinct().collect():
        groups[r.status] = groups.get(r.status, 0) + direct[r.h8] * m.ACRES_PER_KM2
    assert {r.status: round(r.area, 3) for r in run("area_by_group").collect()} == {k: round(v, 3) for k, v in groups.items()}
    classes = {}
    for r in t.fraction_hex(spark, sf).where("class <> 'N'").withColumn("a", cell_area("h8")).collect():
        classes[r["class"]] = classes.get(r["class"], 0) + r.frac * r.a
    assert {r["class"]: round(r.area, 6) for r in run("class_area").collect()} == {k: round(v, 6) for k, v in classes.items()}
    assert all(0 <= r.by_area <= 100 for r in run("overlay_share_area").collect())


def test_outlines(run):
    for r in run("cell_boundary").limit(300).collect():
        assert 6 <= len(r.ring) <= 11 and r.ring[0] == r.ring[-1]
    texts = {r.h8: r.wkt for r in run("cell_boundary_wkt").collect()}
    for r in run("cell_boundary").limit(50).collect():
        corners = [tuple(float(x) for x in v.split()) for v in texts[r.h8][len("POLYGON (("):-2].replace("(", "").split(",")]
        assert len(corners) == len(r.ring) and corners[0] == corners[-1]
        assert all(abs(a - b.x) < 1e-6 and abs(c - b.y) < 1e-6 for (a, c), b in zip(corners, r.ring))


def test_disks(spark, run):
    near = run("grid_disk")
    sizes = {r["n"] for r in near.groupBy("h8").agg(F.count_distinct("near").alias("n")).collect()}
    assert sizes <= {16, 17, 18, 19}
    back = near.where(~F.array_contains(pl.grid_disk("near", 2), F.col("h8")))
    assert back.isEmpty()


def test_sql_functions(spark, sf, run):
    got = {r.h2: r for r in run("sql_functions").collect()}
    own = pl.index_points(t.points(spark, sf), 5).withColumn("h2", cell_parent("h5", 2)).withColumn("a", cell_area("h5"))
    for r in own.groupBy("h2").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("area")).collect():
        assert got[r.h2].n == r.n and abs(got[r.h2].area - r.area) < 1e-6 and got[r.h2].mean_km < REACH * tm.EDGE_KM[5]


def test_centroids_and_distances(spark, sf, run):
    spots = {r.fid: r for r in with_centers(t.line_hex(spark, sf).select("fid", "h8"), "h8").groupBy("fid").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng")).collect()}
    for r in run("feature_centroid").collect():
        assert abs(r.lat - spots[r.fid].lat) < 1e-9 and abs(r.lng - spots[r.fid].lng) < 1e-9
    pairs = run("cell_distance").withColumn("a", cell_center("h6")).withColumn("b", cell_center("h8")).collect()
    for r in pairs:
        p, q = (ico.from_latlng(np.array([c.lat]), np.array([c.lng]))[0] for c in (r.a, r.b))
        assert abs(math.acos(max(-1, min(1, float(p @ q)))) * ico.EARTH_RADIUS_KM - r.distance) < 1e-3


def test_covers(spark, sf, run):
    """All cells of the sphere whose centres lie in a box, and no others."""
    cells = spark.range(122).select(pl.base_cell_centers()[F.col("id").cast("int")]["h0"].alias("h"))
    for _ in range(4):
        cells = cells.select(F.explode(pl.direct_children(F.col("h"))).alias("h"))
    every = with_centers(cells.repartition(8), "h")
    boxes = t.boxes(spark, sf).limit(3).select("aoi_id", bounds("ring").alias("b"))
    want = every.join(F.broadcast(boxes), F.col("lng").between(F.col("b.west"), F.col("b.east")) & F.col("lat").between(F.col("b.south"), F.col("b.north")))
    ids = [r.aoi_id for r in boxes.collect()]
    got = {(r.aoi_id, r.h4) for r in run("polygon_cells").where(F.col("aoi_id").isin(ids)).collect()}
    assert got == {(r.aoi_id, r.h) for r in want.select("aoi_id", "h").collect()}


def test_pyramids_and_tiles(spark, sf, run):
    points = pl.index_points(t.points(spark, sf), 5)
    centers = with_centers(points.select("h5").distinct(), "h5").agg(
        F.min("lng").alias("west"), F.max("lng").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.count(F.lit(1)).alias("n")
    ).first()
    b = run("pyramid_bounds").first()
    assert (b.west, b.east, b.south, b.north, b.feature_count) == tuple(centers)
    children = points.groupBy("h5").agg(F.count_distinct("species").alias("n")).groupBy(cell_parent("h5", 4).alias("h")).agg(F.max("n").alias("n"))
    assert {tuple(r) for r in run("pyramid_richness").collect()} == {tuple(r) for r in children.collect()}
    tiles = run("tile_features_cells")
    assert {r.z for r in tiles.select("z").distinct().collect()} == {3, 5}
    for r in tiles.limit(500).collect():
        assert r.ring[0] == r.ring[-1] and all(abs(v.x) < 3 * tm.HALF_WORLD_M and abs(v.y) <= tm.HALF_WORLD_M + 1 for v in r.ring)


def test_checks_stand_beside_the_values(spark, sf, run):
    """Seven queries whose checks were left out when they came to return values."""
    assert all(r.mutual and r.full for r in run("grid_disk").select("mutual", "full").distinct().collect())
    cells = t.feature_hex(spark, sf).select("status", "h8").distinct()
    exact = run("area_exact").first()
    assert exact.plausible and exact.cells == cells.select("h8").distinct().count()
    groups = {r.status: r["count"] for r in cells.groupBy("status").count().collect()}
    assert {r.status: (r.cells, r.plausible) for r in run("area_by_group").collect()} == {k: (n, True) for k, n in groups.items()}
    sums = {r["class"]: r.f for r in t.fraction_hex(spark, sf).where("class <> 'N'").groupBy("class").agg(F.round(F.sum("frac"), 6).alias("f")).collect()}
    assert {r["class"]: (r.cells, r.plausible) for r in run("class_area").collect()} == {k: (f, True) for k, f in sums.items()}
    assert all(r.bounded and 0 <= r.by_cells <= 100 for r in run("overlay_share_area").collect())
    assert all(r.inside and r.fills for r in run("polygon_cells").select("inside", "fills").distinct().collect())
    b = run("pyramid_bounds").first()
    assert b.n == t.points(spark, sf).count() and b.holds_all and b.counts_cells


def test_the_seven_with_checks_have_sql(spark, sf, run):
    """SQL works their geometry out; `test_queries` compares every row. Here: its own areas and centres, pentagons included."""
    import duckdb

    from hexweave.plans import geometry_sql as g

    seven = {"grid_disk", "area_exact", "area_by_group", "class_area", "overlay_share_area", "polygon_cells", "pyramid_bounds"}
    assert seven <= set(entry_point.oracle_sql())
    cells = f"every AS ({g.all_cells(2)}), {g.area_ctes('every', 'h', 2)}"
    rows = duckdb.execute(f"WITH {cells} SELECT h, lat, lng, km2 FROM areas JOIN ({g.centers('every', 'h', 2)}) USING (h) ORDER BY h").fetchall()
    h = np.array([r[0] for r in rows])
    assert len(h) == 5882 and abs(sum(r[3] for r in rows) / ico.EARTH_RADIUS_KM**2 - 4 * math.pi) < 1e-9
    assert np.allclose([r[3] for r in rows], ico.area_rads2(h) * ico.EARTH_RADIUS_KM**2, rtol=1e-9)
    lat, lng = ico.to_latlng(ico.center(h))
    assert np.allclose([r[1] for r in rows], lat) and np.allclose([r[2] for r in rows], lng)
