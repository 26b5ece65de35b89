import numpy as np
import pytest
from pyspark.sql import functions as F

from hexweave.functions import cells as c
from hexweave.functions import geodesy as gd
from hexweave.functions import icosahedron as ico
from hexweave.functions.geometry import length_inside, planar_length, point_in_ring, to_wkt, unwrap_dateline, vertex
from hexweave.functions.cells import cell_parent, direct_children, res0_cell
from hexweave.functions.geodesy import with_centers
from hexweave.operators import places as pl
from hexweave.operators import tiles as tl

BASE = np.array([(1 << 59) | (b << 45) | ((1 << 45) - 1) for b in range(122)])


def at(lat, lng, res):
    return int(ico.index(ico.from_latlng(np.array([lat]), np.array([lng])), res)[0])


def children(h):
    res = int((h[0] >> 52) & 15)
    out = []
    for cell in h:
        zero = (cell & ((1 << 45) - 1)) == (1 << (3 * (15 - res))) - 1
        pent = zero and ((cell >> 45) & 127) in ico.PENTAGONS
        out += [cell + (1 << 52) - (7 - d) * (1 << (3 * (14 - res))) for d in range(7) if not (pent and d == 1)]
    return np.array(out)


def test_published_cells():
    assert "%x" % at(37.7752702151959, -122.418307270836, 9) == "8928308280fffff"
    assert "%x" % at(37.3615593, -122.0553238, 5) == "85283473fffffff"
    lat, lng = ico.to_latlng(ico.center(np.array([0x8928308280FFFFF])))
    assert lat[0] == pytest.approx(37.77670234943567) and lng[0] == pytest.approx(-122.41845932318311)


def test_reference_places():
    assert at(37.0, -122.0, 5) != at(37.2, -122.0, 5)
    assert at(37.0, -122.0, 4) == at(37.2, -122.0, 4)
    assert at(37.8, -122.3, 5) == at(37.80001, -122.30001, 5) != at(38.0, -122.5, 5)
    california = {at(lat, lng, 0) for lat in np.arange(32.5, 42, 0.5) for lng in np.arange(-124, -114, 0.5)}
    assert {577762574070710271, 577199624117288959} <= california
    lat, lng = ico.to_latlng(ico.center(np.array([at(36.5, -119.5, 2)])))
    n = 2**7
    assert int((lng[0] + 180) / 360 * n) == 21
    s = np.sin(np.radians(lat[0]))
    assert int((0.5 - np.log((1 + s) / (1 - s)) / (4 * np.pi)) * n) == 50


def test_base_cells_run_north_to_south():
    lat, _ = ico.to_latlng(ico.center(BASE))
    assert (np.diff(lat) < 0).all()


def test_areas():
    got = [ico.area_rads2(np.array([at(0.0, 0.0, r)]))[0] * ico.EARTH_RADIUS_KM**2 for r in range(6)]
    # published areas of the cells at latitude 0, longitude 0
    known = [2562182.162955496, 447684.2018179411, 65961.62242711056, 9228.87291900259, 1318.69449079711, 187.9593512281298]
    assert got == pytest.approx(known, rel=1e-8)
    level = BASE
    for _ in range(4):
        assert ico.area_rads2(level).sum() == pytest.approx(4 * np.pi, rel=1e-10)
        level = children(level)


def test_random_points_round_trip():
    rng = np.random.default_rng(7)
    v = rng.normal(size=(20000, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for res in (0, 1, 2, 5, 8, 11, 15):
        h = ico.index(v, res)
        c = ico.center(h)
        assert (ico.index(c, res) == h).all()
        # a point is never farther from its cell's centre than the farthest corner
        ring, real = ico.ring(h)
        reach = np.where(real, np.linalg.norm(ring - c[:, None], axis=2), 0).max(axis=1)
        assert (np.linalg.norm(v - c, axis=1) <= reach * (1 + 1e-6)).all()


def test_pentagons_have_five_sides_and_neighbours():
    for res in (0, 1, 2, 3):
        pent = np.array([(1 << 59) | (res << 52) | (int(b) << 45) | ((1 << (3 * (15 - res))) - 1) for b in ico.PENTAGONS])
        _, real = ico.ring(pent)
        assert (real[:, 0::2].sum(axis=1) == 5).all()
        assert (real[:, 1::2].sum(axis=1) == (5 if res % 2 else 0)).all()
        near, mask = ico.neighbours(pent)
        assert (mask.sum(axis=1) == 5).all()
        assert all(len(set(near[i][mask[i]])) == 5 for i in range(12))


def test_neighbours_are_mutual():
    level = children(children(BASE))
    near, real = ico.neighbours(level)
    pairs = {(int(a), int(b)) for i, a in enumerate(level) for b in near[i][real[i]]}
    assert len(pairs) == 6 * len(level) - 12
    assert all((b, a) in pairs for a, b in pairs) and all(a != b for a, b in pairs)


def test_column_functions(spark):
    df = spark.createDataFrame([(37.8, -122.3), (0.0, 179.95), (None, 1.0), (90.0, 0.0)], "lat double, lng double")
    df = pl.index_points(df, 5)
    rows = gd.with_centers(df.withColumn("ring", gd.cell_boundary("h5")).withColumn("a", gd.cell_area("h5", "acre")), "h5").collect()
    assert rows[0].h5 == at(37.8, -122.3, 5) and rows[0].h0 == at(37.8, -122.3, 0)
    assert rows[2].h5 is None and rows[2].ring is None and rows[2].a is None
    assert np.isnan(rows[0].a)
    for r in (rows[0], rows[1], rows[3]):
        assert r.ring[0] == r.ring[-1] and len(r.ring) >= 6
    disk = df.select(gd.grid_disk("h5", 2).alias("d")).first().d
    assert len(disk) == 19 and disk == sorted(disk)


def test_disks_on_the_plane_are_those_of_the_walk():
    """Anywhere, on face edges and around corners, where the plane misses a sixth; odd ids take the walk."""
    rng = np.random.default_rng(7)
    corners = ico.to_vector(np.repeat(np.arange(20), 3), np.tile(ico._CORNERS, 20))
    ends = np.tile(ico._CORNERS, 20), np.tile(ico._CORNERS[[1, 2, 0]], 20)
    for res in (0, 1, 2, 3, 5, 8, 11):
        edge = ico.to_vector(np.repeat(np.arange(20), 3), ends[0] + (ends[1] - ends[0]) * rng.random(60))
        near = corners + rng.normal(size=(60, 3)) / 7 ** (res / 2)
        v = np.concatenate([rng.normal(size=(80, 3)), edge, near, corners])
        h = np.append(np.unique(ico.index(v / np.linalg.norm(v, axis=1, keepdims=True), res)), [0, 7])
        for k in (0, 1, 2, 3):
            want = [[] for _ in h]
            for row, cell in gd._walked(h, k).tolist():
                want[row].append(cell)
            assert gd._disk(gd.pa.array(h), k).to_pylist() == want
        # Few cells are walked where a disk is small beside a face.
        assert res < 8 or ico.disk(h, 2)[1].sum() >= 100


def test_sql_functions(spark):
    gd.register(spark)
    row = spark.sql("""
        SELECT h3_cell_to_parent(h3_latlng_to_cell(37.8D, -122.3D, 8), 5) AS p, h3_latlng_to_cell(37.8D, -122.3D, 8) AS h,
               h3_cell_area(577762574070710271, 'acre') AS a, h3_get_resolution(613762179077668863) AS r""").first()
    assert row.r == 8 and np.isnan(row.a) and row.h == at(37.8, -122.3, 8)
    assert row.p == (row.h & ~(15 << 52)) | (5 << 52) | ((1 << 30) - 1)


def test_sql_families(spark):
    gd.register(spark)
    row = spark.sql("""
        SELECT COUNT(*) AS n, SUM(size(h3_cell_to_children(h, 2))) AS kids, MAX(h3_cell_to_children(577762574070710271, 1)) AS one,
               MAX(size(h3_cell_to_children(h, 0))) AS self, MAX(mercator_x(180.0D)) AS x, MAX(mercator_y(0.0D)) AS y
        FROM (SELECT explode(c) AS h FROM (SELECT h3_get_res0_cells() AS c))""").first()
    assert (row.n, row.kids, row.self) == (122, 2 + 120 * 49, 1) and len(row.one) == 7
    assert row.x == pytest.approx(20037508.34) and row.y == pytest.approx(0.0, abs=1e-6)
    rows = spark.sql("""
        SELECT k, h3_grid_disk(h, k) AS d, h3_cell_to_boundary_wkt(h) AS wkt FROM VALUES
        (577762574070710271, 1), (577762574070710271, 0), (CAST(NULL AS BIGINT), 1), (577762574070710271, NULL) AS t(h, k)""").collect()
    got = {(r.k, r.d is None, r.wkt is None): r for r in rows}
    assert len(got[(1, False, False)].d) == 7 and got[(0, False, False)].d == [577762574070710271]
    assert (1, True, True) in got and (None, True, False) in got
    wkt = got[(1, False, False)].wkt
    assert wkt.startswith("POLYGON ((") and len(wkt.split(",")) == 7


def test_dateline_cells_unwrap(spark):
    df = spark.createDataFrame([(0.0, 179.95, 5), (0.0, -179.97, 7)], "lat double, lng double, res int")
    for res in (5, 7):
        some = pl.index_points(df.where(F.col("res") == res), res)
        some = gd.with_centers(some.select(f"h{res}"), f"h{res}").withColumn("ring", gd.cell_boundary(f"h{res}"))
        row = some.withColumn("fixed", unwrap_dateline("ring", "lng")).first()
        raw = [p.x for p in row.ring]
        fixed = [p.x for p in row.fixed]
        assert (max(raw) - min(raw) > 180) == (res == 5) and max(fixed) - min(fixed) < 1
        assert all(abs(x - row.lng) < 1 for x in fixed)


def test_line_inside_ring(spark):
    def shape(points):
        return F.array(*[vertex(F.lit(float(x)), F.lit(float(y))) for x, y in points])

    square = shape([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)])
    hollow = shape([(0, 0), (6, 0), (6, 6), (3, 2), (0, 6), (0, 0)])
    cases = {
        "through": (shape([(-2, 2), (6, 2)]), square, 4.0),
        "outside": (shape([(-2, 5), (6, 5)]), square, 0.0),
        "inside": (shape([(1, 1), (2, 1), (2, 3)]), square, 3.0),
        "notch": (shape([(0, 4), (6, 4)]), hollow, 3.0),
        "corner": (shape([(-2, 2), (2, -2)]), square, 0.0),
    }
    row = spark.range(1).select(*[F.round(length_inside(a, b), 9).alias(k) for k, (a, b, _) in cases.items()]).first()
    assert row.asDict() == {k: want for k, (_, _, want) in cases.items()}
    row = spark.range(1).select(
        planar_length(shape([(0, 0), (3, 4)])).alias("n"), planar_length(shape([(1, 1)])).alias("one"),
        point_in_ring(square, F.lit(4.0), F.lit(1.0)).alias("east"), point_in_ring(square, F.lit(0.0), F.lit(1.0)).alias("west"),
        to_wkt(shape([(0, 1), (2, 3)])).alias("wkt"),
    ).first()
    assert (row.n, row.one, row.east, row.west, row.wkt) == (5.0, 0.0, False, True, "LINESTRING (0.0 1.0, 2.0 3.0)")


def test_polygon_cover_is_complete(spark):
    ring = [(-10.0, 40.0), (5.0, 38.0), (8.0, 52.0), (-3.0, 47.0), (-10.0, 40.0)]
    polygons = spark.createDataFrame([(1, ring)], "id int, ring array<struct<x:double,y:double>>")
    got = {r.h3 for r in pl.polygons_to_cells(polygons, "id", 3).collect()}
    level = BASE
    for _ in range(3):
        level = children(level)
    lat, lng = ico.to_latlng(ico.center(level))
    centers = spark.createDataFrame([(int(h), float(a), float(b)) for h, a, b in zip(level, lat, lng)], "h bigint, lat double, lng double")
    shape = F.array(*[vertex(F.lit(x), F.lit(y)) for x, y in ring])
    want = {r.h for r in centers.where(point_in_ring(shape, "lng", "lat")).collect()}
    assert got == want and len(want) > 50


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    a = [(i, float(np.degrees(np.arcsin(u))), float(v)) for i, (u, v) in enumerate(zip(rng.uniform(-1, 1, 300), rng.uniform(-180, 180, 300)))]
    dense = [(1000 + i, 10 + float(x), 20 + float(y)) for i, (x, y) in enumerate(rng.normal(0, 0.01, (200, 2)))]
    b = dense + [(i, float(x), float(y)) for i, x, y in zip(range(40), rng.uniform(-80, 80, 40), rng.uniform(-180, 180, 40))]
    a += [(900, 89.9, 10.0), (901, -89.9, 10.0), (902, 0.0, 179.99), (903, 10.0, 20.0)]
    left = spark.createDataFrame(a, "aid int, lat double, lng double")
    right = spark.createDataFrame(b, "bid int, lat double, lng double")
    got = {r.aid: (r.bid, r.distance_km) for r in pl.nearest(left, right, "aid", "bid").collect()}
    vb = ico.from_latlng(np.array([x[1] for x in b]), np.array([x[2] for x in b]))
    assert len(got) == len(a)
    for i, lat, lng in a:
        v = ico.from_latlng(np.array([lat]), np.array([lng]))[0]
        d = 2 * np.arcsin(np.linalg.norm(vb - v, axis=1) / 2) * c.EARTH_RADIUS_KM
        assert got[i][1] == pytest.approx(d.min(), abs=1e-6)


def test_nearest_of_nothing(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0)], "aid int, lat double, lng double")
    right = spark.createDataFrame([], "bid int, lat double, lng double")
    assert [tuple(r) for r in pl.nearest(left, right, "aid", "bid").collect()] == [(1, None, None)]


def test_nearest_keeps_rows_without_coordinates(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0)], "aid int, lat double, lng double")
    right = spark.createDataFrame([(7, 0.0, 1.0)], "bid int, lat double, lng double")
    found = {r["aid"]: (r["bid"], r["distance_km"]) for r in pl.nearest(left, right, "aid", "bid").collect()}
    assert found[2] == (None, None) and found[1][0] == 7


def _all_cells(spark, res):
    cells = spark.range(122).select(res0_cell("id").alias("h"))
    for _ in range(res):
        cells = cells.select(F.explode(direct_children(F.col("h"))).alias("h"))
    return with_centers(cells.withColumn("h0", cell_parent("h", 0)), "h").cache()


@pytest.mark.parametrize("box", [(-100, -55, 20, 55), (60, -30, 150, 30), (30, 42, 179, 78), (-10, 35, 40, 70), (170, -20, 190, 5)])
def test_cover_of_large_boxes_loses_no_cell(spark, box):
    west, south, east, north = box
    cells = _all_cells(spark, 3)
    lng = F.when(F.col("lng") + 360 <= east, F.col("lng") + 360).otherwise(F.col("lng")) if east > 180 else F.col("lng")
    inside = cells.where(lng.between(west, east) & F.col("lat").between(south, north))
    spot = spark.range(1).select(F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(box, ("west", "south", "east", "north"))]).alias("b"))
    near = pl.base_cells_of_boxes(spot, "b")
    assert inside.count() == inside.where(F.col("h0").isin(near)).count() > 0


@pytest.mark.parametrize("z", [3, 4])
def test_tiles_pruned_equal_unpruned(spark, z):
    cells = _all_cells(spark, 3)
    for x, y in [(0, 0), (1, 2**z - 1), (2, 3), (2**z - 1, 4), (5, 5), (3, 1), (6, 2)]:
        near = pl.tile_base_cells(spark, z, x, y, 3)
        assert tl.tile_cells(cells, 3, z, x, y).count() == tl.tile_cells(cells, 3, z, x, y, near).count()
