"""Queries that use true cell geometry.

They return their values. SQL can derive those that do not depend on a cell's outline: cells of the finest resolution are under
a metre wide, so that points a tenth of a degree apart share one only if they are equal, and its centre is the point
to four decimals. Seven carry checks of the values beside them, and SQL that works out the geometry (`geometry_sql`). The others have
no SQL: `tests/test_places.py` holds their results against invariants and brute force, and `tests/test_geometry.py` against published cells.
"""

from pyspark.sql import functions as F

from hexweave.functions import icosahedron as ico
from hexweave.functions.cells import cell_resolution
from hexweave.functions.geodesy import (
    cell_area, cell_boundary, cell_boundary_wkt, grid_disk, register, with_centers,
)
from hexweave.functions.geometry import polygon_wkt, vertex
from hexweave.operators import measures as m
from hexweave.operators import places as pl
from hexweave.operators import pyramid as py
from hexweave.operators import tiles as tl
from hexweave.operators.filters import valid_values
from hexweave.operators.sizing import small_side
from hexweave.plans import geometry_sql as g
from hexweave.plans import inputs as t
from hexweave.plans.inputs import parent_sql
from hexweave.plans.registry import query
from hexweave.session import materialize


def count(name="n"):
    return F.count(F.lit(1)).alias(name)


def cells(spark, sf):
    return t.value_hex(spark, sf).select("h8").distinct()


# Cells narrower than any distance between two given points.
FINEST = 15


def to_point(df, h):
    """``df`` with the centre of its finest cells as lat and lng, to four decimals."""
    return with_centers(df, h).withColumn("lat", F.round("lat", 4)).withColumn("lng", F.round("lng", 4))


_POINTS = "ROUND(lat, 4) AS lat, ROUND(lng, 4) AS lng"


# The range of areas of resolution 8.
AREAS_KM2 = (0.35, 0.95)


def plausible(factor: float = 1.0):
    """Is ``area`` that of ``cells`` cells."""
    low, high = AREAS_KM2
    return F.try_divide(F.col("area"), F.col("cells")).between(low * factor, high * factor)


def plausible_sql(area: str, cells: str, factor: float = 1.0) -> str:
    low, high = AREAS_KM2
    return f"{area} / {cells} BETWEEN {low * factor:.17e} AND {high * factor:.17e} AS plausible"


def rounded(df, *columns):
    """Sums to six decimals, so that they do not depend on the order of their parts."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def beside(df, other, key):
    """``df`` with the columns of ``other``, one row per key; NULL is a key like others."""
    other = other.withColumnRenamed(key, "_key")
    return df.join(other, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


@query("index_points", "points", f"SELECT event_id, {FINEST} AS res, {_POINTS} FROM points")
def index_points(spark, sf):
    found = pl.index_points(t.points(spark, sf), FINEST).drop("lat", "lng")
    return to_point(found, "h15").select("event_id", cell_resolution("h15").alias("res"), "lat", "lng")


@query("cell_centers", "points", f"SELECT {_POINTS}, COUNT(*) AS n, MIN(event_id) AS first FROM points GROUP BY lat, lng")
def cell_centers(spark, sf):
    cells = pl.index_points(t.points(spark, sf), FINEST).groupBy("h15").agg(count(), F.min("event_id").alias("first"))
    return to_point(cells, "h15").select("lat", "lng", "n", "first")


@query("cell_area")
def cell_area_(spark, sf):
    return cells(spark, sf).select("h8", cell_area("h8").alias("km2"), cell_area("h8", "m^2").alias("m2"))


@query("cell_boundary")
def cell_boundary_(spark, sf):
    return with_centers(cells(spark, sf), "h8").withColumn("ring", cell_boundary("h8")).select("h8", "lat", "lng", "ring")


@query("cell_boundary_wkt")
def cell_boundary_wkt_(spark, sf):
    return cells(spark, sf).select("h8", cell_boundary_wkt("h8").alias("wkt"))


@query("grid_disk", "value_hex", f"""
    , cells AS (SELECT DISTINCT h8 FROM value_hex), disks AS MATERIALIZED ({g.disks('cells', 'h8', 8, 2)}),
    found AS (SELECT DISTINCT near FROM disks), back AS ({g.disks('found', 'near', 8, 2)})
    SELECT d.h AS h8, d.near, b.h IS NOT NULL AS mutual, COUNT(*) OVER (PARTITION BY d.h) BETWEEN 16 AND 19 AS "full"
    FROM disks d LEFT JOIN back b ON b.h = d.near AND b.near = d.h""")
def grid_disk_(spark, sf):
    """The disks, whether each neighbour's disk holds the cell too, and whether the disk has all of its cells."""
    disks = cells(spark, sf).withColumn("disk", grid_disk("h8", 2))
    full = F.size(F.array_distinct("disk")).between(16, 19)
    # An inner explode would have Spark look for empty disks before the cells are distinct, one disk for each row.
    near = disks.select("h8", F.explode_outer("disk").alias("near"), full.alias("full")).where("near is not null")
    # A neighbour's own disk is found once for all the cells around it: 19 at most.
    around = near.groupBy("near").agg(F.collect_list(F.struct("h8", "full")).alias("cells"))
    back = around.withColumn("back", grid_disk("near", 2)).select("near", "back", F.explode("cells").alias("cell"))
    return back.select("cell.h8", "near", F.array_contains("back", F.col("cell.h8")).alias("mutual"), "cell.full")


@query("sql_functions")
def sql_functions(spark, sf):
    register(spark)
    t.points(spark, sf).createOrReplaceTempView("hexweave_points")
    return spark.sql("""
        SELECT h3_cell_to_parent(h, 2) AS h2, COUNT(*) AS n, SUM(h3_cell_area(h, 'km^2')) AS area,
               AVG(h3_great_circle_distance(lat, lng, h3_cell_to_lat(h), h3_cell_to_lng(h), 'km')) AS mean_km
        FROM (SELECT lat, lng, h3_latlng_to_cell(lat, lng, 5) AS h FROM hexweave_points) GROUP BY 1""")

@query("area_exact", "feature_hex", f"""
    , cells AS (SELECT DISTINCT h8 FROM feature_hex), {g.area_ctes('cells', 'h8', 8)}
    SELECT ROUND(SUM(km2), 6) AS area, COUNT(*) AS cells, {plausible_sql('SUM(km2)', 'COUNT(*)')} FROM areas""")
def area_exact(spark, sf):
    n = t.feature_hex(spark, sf).agg(F.count_distinct("h8"))
    return rounded(pl.area(t.feature_hex(spark, sf), 8).withColumn("cells", n.scalar()).withColumn("plausible", plausible()), "area")


@query("area_by_group", "feature_hex", f"""
    , cells AS (SELECT DISTINCT h8 FROM feature_hex), {g.area_ctes('cells', 'h8', 8)}
    SELECT status, ROUND(SUM(km2) * {m.ACRES_PER_KM2:.17e}, 6) AS area, COUNT(*) AS cells, {plausible_sql('SUM(km2)', 'COUNT(*)')}
    FROM (SELECT DISTINCT status, h8 FROM feature_hex) JOIN areas ON h = h8 GROUP BY 1""")
def area_by_group(spark, sf):
    n = t.feature_hex(spark, sf).groupBy("status").agg(F.count_distinct("h8").alias("cells"))
    areas = beside(pl.area(t.feature_hex(spark, sf), 8, "status", "acres"), n, "status")
    return rounded(areas.withColumn("plausible", plausible(m.ACRES_PER_KM2)), "area")


@query("class_area", "fraction_hex", f"""
    , cells AS (SELECT DISTINCT h8 FROM fraction_hex), {g.area_ctes('cells', 'h8', 8)}
    SELECT class, ROUND(SUM(frac * km2), 6) AS area, ROUND(SUM(frac), 6) AS cells, {plausible_sql('SUM(frac * km2)', 'SUM(frac)')}
    FROM fraction_hex JOIN areas ON h = h8 WHERE class <> 'N' GROUP BY 1""")
def class_area(spark, sf):
    areas = m.class_area(t.fraction_hex(spark, sf), 8, "class", cell_area("h8"), "N")
    n = m.class_area(t.fraction_hex(spark, sf), 8, "class", F.lit(1.0), "N").select("class", F.round("area", 6).alias("cells"))
    return rounded(beside(areas, n, "class").withColumn("plausible", plausible()), "area")


@query("overlay_share_area", "fraction_hex weights_hex land_hex", f"""
    , cells AS (SELECT DISTINCT h8 FROM fraction_hex), {g.area_ctes('cells', 'h8', 8)},
    on_land AS (SELECT class, h8, h0, frac, km2 FROM fraction_hex f JOIN areas ON h = h8
        WHERE EXISTS (SELECT 1 FROM land_hex l WHERE l.h8 = f.h8 AND l.h0 = f.h0)),
    whole AS (SELECT class, SUM(frac) AS cells, SUM(frac * km2) AS km2 FROM on_land GROUP BY 1),
    part AS (SELECT class, SUM(frac * (w1 + w2)) AS cells, SUM(frac * km2 * (w1 + w2)) AS km2 FROM on_land JOIN weights_hex USING (h8, h0) GROUP BY 1),
    shares AS (SELECT class, coalesce(p.km2, 0) / w.km2 * 100 AS by_area, coalesce(p.cells, 0) / w.cells * 100 AS by_cells FROM whole w LEFT JOIN part p USING (class))
    SELECT class, ROUND(by_area, 6) AS by_area, ROUND(by_cells, 6) AS by_cells,
           by_area BETWEEN by_cells / ({AREAS_KM2[1]} / {AREAS_KM2[0]}) AND by_cells * ({AREAS_KM2[1]} / {AREAS_KM2[0]}) AS bounded FROM shares""")
def overlay_share_area(spark, sf):
    """The share by area and by cells, which cannot differ more than the areas do from one another."""
    def share(area, out):
        return m.overlay_share(
            t.fraction_hex(spark, sf), t.weights_hex(spark, sf), t.land_hex(spark, sf).select("h8", "h0"), 8,
            F.col("w1") + F.col("w2"), area, by="class", frac="frac", out=out,
        )

    most = AREAS_KM2[1] / AREAS_KM2[0]
    both = beside(share(cell_area("h8"), "by_area"), share(F.lit(1.0), "by_cells"), "class")
    both = both.withColumn("bounded", F.col("by_area").between(F.col("by_cells") / most, F.col("by_cells") * most))
    return rounded(both, "by_area", "by_cells")


@query("feature_centroid")
def feature_centroid(spark, sf):
    return pl.feature_centroid(t.line_hex(spark, sf), 8, "fid")


@query("pixels_to_cells", "pixels", """
    SELECT ROUND(y, 4) AS lat, ROUND(x, 4) AS lng, COUNT(*) AS n_pixels, ROUND(AVG(band_1), 6) AS mean_value
    FROM pixels WHERE band_1 <> -9999 GROUP BY x, y""")
def pixels_to_cells(spark, sf):
    valid = valid_values(t.pixels(spark, sf), "band_1", [-9999])
    located = pl.index_points(valid, FINEST, "y", "x")
    means = m.aggregate_cells(located, FINEST, F.avg("band_1").alias("mean_value"), count("n_pixels"))
    return to_point(means, "h15").select("lat", "lng", "n_pixels", F.round("mean_value", 6).alias("mean_value"))

def _located(spark, sf):
    return pl.index_points(t.points(spark, sf), 5).select("event_id", "species", "class", "value", "h5", "h0")


@query("value_at", "points", """
    SELECT s.event_id AS spot, COUNT(*) AS n, ROUND(SUM(p.value), 6) AS total FROM points s
    JOIN points p ON p.lat = s.lat AND p.lng = s.lng WHERE s.class = 'click' AND s.event_id % 10 = 0 GROUP BY 1""")
def value_at(spark, sf):
    """Rows of a layer at the cells of the spots."""
    spots = t.points(spark, sf).where("class = 'click' AND event_id % 10 = 0").select(F.col("event_id").alias("spot"), "lat", "lng")
    layer = pl.index_points(t.points(spark, sf), FINEST).select("h15", "h0", "value")
    return pl.value_at(layer, spots, FINEST).groupBy("spot").agg(count(), F.round(F.sum("value"), 6).alias("total"))


@query("scope_by_points", "points boxes", """
    SELECT event_id, class, value FROM points
    WHERE abs(lat - (SELECT south FROM boxes WHERE aoi_id = 7)) <= 4 AND abs(lng - (SELECT west FROM boxes WHERE aoi_id = 7)) <= 4""")
def scope_by_points(spark, sf):
    """Events around a known point, read from the base cells near it alone."""
    spot = t.boxes(spark, sf).where("aoi_id = 7").select(F.col("ring")[0]["x"].alias("lng"), F.col("ring")[0]["y"].alias("lat"))
    at = spot.first()
    near = (F.abs(F.col("lat") - at["lat"]) <= 4) & (F.abs(F.col("lng") - at["lng"]) <= 4)
    rows = pl.index_points(t.points(spark, sf), 5)
    return pl.scope_by_points(rows, spot, near).select("event_id", "class", "value")


@query("scope_by_name", "points", "SELECT event_id, class, value FROM points WHERE species % 100 = 7")
def scope_by_name(spark, sf):
    """Rows of the features that a flat table names, read from the base cells of their boxes alone."""
    flat = t.points(spark, sf).select("event_id", "species", F.array(vertex("lng", "lat")).alias("line"))
    rows = pl.index_points(t.points(spark, sf), 5).select("event_id", "class", "value", "h5", "h0")
    found = pl.scope_by_name(rows, flat, "event_id", F.col("species") % 100 == 7, "line")
    return found.select("event_id", "class", "value")


@query("cell_distance")
def cell_distance(spark, sf):
    first = t.value_hex(spark, sf).groupBy("h0").agg(F.min("h8").alias("h8"))  # one row per base cell
    pairs = t.coarse_feature(spark, sf).select("h6", "h0").distinct().join(first, "h0")
    return pl.cell_distance(pairs.select("h6", "h8"), "h6", "h8")


@query("nearest", "points boxes", """
    SELECT event_id, best.site AS aoi_id, ROUND(best.km, 5) AS distance_km FROM (
      SELECT event_id, min({'km': 2 * 6371.007180918475 * asin(sqrt(least(1.0, pow(sin(radians(south - lat) / 2), 2)
        + cos(radians(lat)) * cos(radians(south)) * pow(sin(radians(west - lng) / 2), 2)))), 'site': aoi_id}) AS best
      FROM points CROSS JOIN boxes GROUP BY 1)""")
def nearest(spark, sf):
    sites = t.boxes(spark, sf).select("aoi_id", F.col("ring")[0]["x"].alias("lng"), F.col("ring")[0]["y"].alias("lat"))
    found = pl.nearest(t.points(spark, sf), sites, "event_id", "aoi_id")
    return found.select("event_id", "aoi_id", F.round("distance_km", 5).alias("distance_km"))


@query("polygon_cells", "boxes", f"""
    , every AS ({g.all_cells(4)}), spots AS MATERIALIZED ({g.centers('every', 'h', 4)}),
    found AS MATERIALIZED (SELECT * FROM boxes JOIN spots ON lng >= west AND lng < east AND lat >= south AND lat < north),
    held AS (SELECT DISTINCT h FROM found), {g.area_ctes('held', 'h', 4)},
    filled AS (SELECT aoi_id, SUM(km2) AS km2 FROM found JOIN areas USING (h) GROUP BY 1)
    SELECT aoi_id, h AS h4, {parent_sql('h', 0)} AS h0, lng BETWEEN west AND east AND lat BETWEEN south AND north AS inside,
           km2 / (radians(east - west) * (sin(radians(north)) - sin(radians(south))) * {ico.EARTH_RADIUS_KM**2:.17e}) BETWEEN 0.9 AND 1.1 AS fills
    FROM found JOIN filled USING (aoi_id)""")
def polygon_cells(spark, sf):
    """The cells, whether each lies in the polygon's box, and whether a polygon's cells fill its box on the sphere."""
    found = materialize(pl.polygons_to_cells(t.boxes(spark, sf), "aoi_id", 4), "cells")
    # A cell's centre and area are found once, however many polygons hold it.
    located = small_side(with_centers(found.select("h4").distinct(), "h4").withColumn("area", cell_area("h4")))
    a, c = F.col("ring")[0], F.col("ring")[2]
    size = F.radians(c["x"] - a["x"]) * (F.sin(F.radians(c["y"])) - F.sin(F.radians(a["y"]))) * ico.EARTH_RADIUS_KM**2
    boxes = t.boxes(spark, sf).groupBy("aoi_id").agg(
        F.min(a["x"]).alias("west"), F.min(a["y"]).alias("south"), F.max(c["x"]).alias("east"), F.max(c["y"]).alias("north"),
        F.first(size).alias("size"),
    )
    areas = found.join(located.select("h4", "area"), "h4").groupBy("aoi_id").agg(F.sum("area").alias("area"))
    filled = small_side(beside(boxes, areas, "aoi_id"))
    within = F.col("lng").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north"))
    return beside(found.join(located.select("h4", "lat", "lng"), "h4"), filled, "aoi_id").select(
        "aoi_id", "h4", "h0", within.alias("inside"), F.try_divide("area", "size").between(0.9, 1.1).alias("fills")
    )


@query("polygon_cells_wkt")
def polygon_cells_wkt(spark, sf):
    """Cells of polygons given as text, from SQL. No SQL elsewhere has the cells: tests compare them with `polygons_to_cells`."""
    register(spark)
    t.boxes(spark, sf).select("aoi_id", polygon_wkt(F.array("ring")).alias("wkt")).createOrReplaceTempView("hexweave_texts")
    return spark.sql("SELECT aoi_id, h FROM hexweave_texts, LATERAL h3_polygon_wkt_to_cells(wkt, 3)")


@query("pyramid_bounds", "points", f"""
    , located AS ({g.point_cells('points', 5)}),
    level AS MATERIALIZED (SELECT any_value(clat) AS lat, any_value(clng) AS lng, COUNT(*) AS n FROM located GROUP BY round(clat, 6), round(clng, 6)),
    bounds AS (SELECT MIN(lng) AS west, MIN(lat) AS south, MAX(lng) AS east, MAX(lat) AS north, COUNT(*) AS feature_count FROM level)
    SELECT west, south, east, north, feature_count, CAST(SUM(n) AS BIGINT) AS n,
           bool_and(lng BETWEEN west AND east AND lat BETWEEN south AND north) AS holds_all, COUNT(*) = feature_count AS counts_cells
    FROM level, bounds GROUP BY west, south, east, north, feature_count""")
def pyramid_bounds(spark, sf):
    level = with_centers(py.finest_level(_located(spark, sf), "COUNT", h="h5"), "h")
    found = py.pyramid_bounds(level)
    b = found.select(F.struct("*").alias("b")).scalar()
    inside = F.col("lng").between(F.col("b.west"), F.col("b.east")) & F.col("lat").between(F.col("b.south"), F.col("b.north"))
    checks = level.withColumn("b", b).agg(
        F.sum("count").alias("n"), F.every(inside).alias("holds_all"),
        (F.count(F.lit(1)) == F.max("b.feature_count")).alias("counts_cells"),
    )
    return found.crossJoin(checks)  # one row each


@query("tile_cells_pruned", "points", """
    SELECT ROUND(lat, 4) AS lat, ROUND(lng, 4) AS lng, COUNT(*) AS n FROM points, (
      SELECT x / 32 * 360 - 180 AS west, (x + 1) / 32 * 360 - 180 AS east, degrees(atan(sinh(pi() * (1 - 2 * y / 32)))) AS north,
             degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 32)))) AS south
      FROM (SELECT unnest([1.0::DOUBLE, 8.0, 20.0]) AS x, unnest([13.0::DOUBLE, 12.0, 18.0]) AS y))
    WHERE lng BETWEEN west AND east AND lat BETWEEN south AND north GROUP BY points.lat, points.lng""")
def tile_cells_pruned(spark, sf):
    """Cells of three tiles, read from the base cells that can hold one."""
    rows = pl.index_points(t.points(spark, sf), FINEST).select("event_id", "h15", "h0")
    level, out = with_centers(py.finest_level(rows, "COUNT", h="h15"), "h"), None
    for x, y in ((1, 13), (8, 12), (20, 18)):
        one = tl.tile_cells(level, FINEST, 5, x, y, pl.tile_base_cells(spark, 5, x, y, FINEST)).select("lat", "lng", F.col("count").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out.select(F.round("lat", 4).alias("lat"), F.round("lng", 4).alias("lng"), "n")


@query("tile_features_cells")
def tile_features_cells(spark, sf):
    level = with_centers(py.finest_level(_located(spark, sf), "COUNT", h="h5"), "h")
    tiles = tl.build_tiles(level.withColumn("outline", cell_boundary("h")), 5, [3, 5])
    return tiles.select("z", "x", "y", "h", "count", tl.mercator_ring("outline", "lng").alias("ring"))


@query("pyramid_richness")
def pyramid_richness(spark, sf):
    """A parent's number of species is its richest child's: a lower bound of its own."""
    level = py.finest_level(_located(spark, sf), "COUNT_DISTINCT", ["species"], "h5")
    return py.parent_level(level, 4, "COUNT_DISTINCT", ["species"]).select("h", "species")
