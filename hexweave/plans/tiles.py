"""Queries for tile arithmetic and tile tables."""

from pyspark.sql import functions as F

from hexweave.functions import tilemath as tm
from hexweave.functions.geometry import unwrap_dateline, vertex
from hexweave.operators import tiles as tl
from hexweave.operators.pyramid import build_pyramid
from hexweave.plans import inputs as t
from hexweave.plans.inputs import parent_sql
from hexweave.plans.registry import query
from hexweave.session import fresh_dir


def count():
    return F.count(F.lit(1)).alias("n")


def _yn(lat: str) -> str:
    s = f"sin(radians(greatest(-85.0511, least(85.0511, {lat}))))"
    return f"(0.5 - ln((1 + {s}) / (1 - {s})) / (4 * pi()))"


def _tx(lng: str, n: str) -> str:
    return f"CAST(least({n} - 1, greatest(0, floor(({lng} + 180.0) / 360.0 * {n}))) AS BIGINT)"


def _ty(lat: str, n: str) -> str:
    return f"CAST(least({n} - 1, greatest(0, floor({_yn(lat)} * {n}))) AS BIGINT)"


def _north(y: str, n: str) -> str:
    return f"degrees(atan(sinh(pi() * (1 - 2 * {y} / {n}))))"


@query("point_tiles", "points", f"""
    SELECT {_tx('lng', '64.0')} AS x, {_ty('lat', '64.0')} AS y, COUNT(*) AS n FROM points GROUP BY 1, 2""")
def point_tiles(spark, sf):
    return t.points(spark, sf).groupBy(tm.tile_x("lng", F.lit(6)).alias("x"), tm.tile_y("lat", F.lit(6)).alias("y")).agg(count())


@query("tile_bounds", "points", f"""
    SELECT x, y, ROUND(x / 64.0 * 360 - 180, 9) AS west, ROUND({_north('(y + 1)', '64.0')}, 9) AS south,
           ROUND((x + 1) / 64.0 * 360 - 180, 9) AS east, ROUND({_north('y', '64.0')}, 9) AS north FROM (
      SELECT DISTINCT {_tx('lng', '64.0')} AS x, {_ty('lat', '64.0')} AS y FROM points)""")
def tile_bounds(spark, sf):
    z = F.lit(6)
    tiles = t.points(spark, sf).select(tm.tile_x("lng", z).alias("x"), tm.tile_y("lat", z).alias("y")).distinct()
    box = tiles.withColumn("b", tm.tile_bounds(z, "x", "y"))
    return box.select("x", "y", *[F.round(f"b.{c}", 9).alias(c) for c in ("west", "south", "east", "north")])


_COVER = "(" + " * ".join([
    f"greatest(1, {_tx('east', 'n')} - {_tx('west', 'n')} + 1)", f"greatest(1, {_ty('south', 'n')} - {_ty('north', 'n')} + 1)"
]) + ")"
_ZOOMS = "(SELECT z, pow(2.0, z) AS n FROM (SELECT unnest(range(0, 12)) AS z))"


def _boxes_by_zoom(spark, sf):
    boxes = t.boxes(spark, sf).select("aoi_id", F.element_at("ring", 1).alias("a"), F.element_at("ring", 3).alias("c"))
    zoom = F.explode(F.sequence(F.lit(0), F.lit(11)))
    return boxes.select(
        "aoi_id", zoom.alias("z"), F.col("a.x").alias("west"), F.col("a.y").alias("south"),
        F.col("c.x").alias("east"), F.col("c.y").alias("north"),
    ).withColumn("tiles", tm.tiles_covering("z", "west", "south", "east", "north"))


@query("tiles_covering", "boxes", f"""
    SELECT aoi_id, CAST(z AS INT) AS z, CAST({_COVER} AS BIGINT) AS tiles FROM boxes CROSS JOIN {_ZOOMS}""")
def tiles_covering(spark, sf):
    return _boxes_by_zoom(spark, sf).select("aoi_id", "z", "tiles")


@query("zoom_resolution", "boxes", f"""
    SELECT aoi_id, CAST(z AS INT) AS z, CAST(greatest(2, least(8, floor(8 + ln(4000.0 * tiles / cells) / ln(7.0) + 0.5) + 2 - zoom_offset)) AS INT) AS res,
           CAST(greatest(2, least(8, z - zoom_offset)) AS INT) AS linear_res FROM (
      SELECT aoi_id, z, {_COVER} AS tiles, 1000 + aoi_id * 50000 AS cells, aoi_id % 4 AS zoom_offset FROM boxes CROSS JOIN {_ZOOMS})""")
def zoom_resolution(spark, sf):
    cells, offset = F.lit(1000) + F.col("aoi_id") * 50000, F.col("aoi_id") % 4
    adaptive = tm.zoom_resolution("z", F.lit(2), F.lit(8), offset, cells, "tiles")
    linear = tm.zoom_resolution("z", F.lit(2), F.lit(8), offset)
    return _boxes_by_zoom(spark, sf).select("aoi_id", "z", adaptive.alias("res"), linear.alias("linear_res"))


@query("edge_padding", "points", f"""
    SELECT event_id, CAST(event_id % 16 AS INT) AS res, ROUND(e[event_id % 16 + 1] / 111.195, 9) AS pad_lat,
           ROUND(e[event_id % 16 + 1] / 111.195 / greatest(0.01, cos(radians(lat))), 9) AS pad_lng
    FROM points CROSS JOIN (SELECT [{', '.join(f'{v}::DOUBLE' for v in tm.EDGE_KM)}] AS e)""")
def edge_padding(spark, sf):
    res = (F.col("event_id") % 16).cast("int")
    return t.points(spark, sf).select(
        "event_id", res.alias("res"), F.round(tm.pad_lat(res), 9).alias("pad_lat"), F.round(tm.pad_lng(res, "lat"), 9).alias("pad_lng")
    )


def _in_tile(res: int, n: str, x: str, y: str) -> str:
    pad = f"({tm.EDGE_KM[res]}::DOUBLE / 111.195)"
    north, south = _north(y, n), _north(f"({y} + 1)", n)
    dx = f"({pad} / greatest(0.01, cos(radians(greatest(abs({north}), abs({south}))))))"
    return (
        f"lat BETWEEN {south} - {pad} AND {north} + {pad} AND "
        f"lng BETWEEN {x} / {n} * 360 - 180 - {dx} AND ({x} + 1) / {n} * 360 - 180 + {dx}"
    )


@query("tile_cells", "centers", f"SELECT h, h0, lat, lng, value FROM centers WHERE {_in_tile(4, '8.0', '5', '3')}")
def tile_cells(spark, sf):
    return tl.tile_cells(t.centers(spark, sf), 4, 3, 5, 3)


_TILES = "(SELECT z, pow(2.0, z) AS n, x, y FROM (SELECT unnest([2, 4]) AS z) CROSS JOIN range(16) a(x) CROSS JOIN range(16) b(y) WHERE x < pow(2, z) AND y < pow(2, z))"


@query("build_tiles", "centers", f"""
    SELECT CAST(z AS INT) AS z, x, y, COUNT(*) AS n, ROUND(SUM(value), 4) AS value, MIN(h) AS first_cell
    FROM centers JOIN {_TILES} ON {_in_tile(2, 'n', 'x', 'y')} GROUP BY 1, 2, 3""")
def build_tiles(spark, sf):
    tiles = tl.build_tiles(t.centers(spark, sf), 2, [2, 4])
    return tiles.groupBy("z", "x", "y").agg(count(), F.round(F.sum("value"), 4).alias("value"), F.min("h").alias("first_cell"))


@query("tile_features", "centers", f"""
    , px AS (SELECT h, CAST(z AS INT) AS z, x, y,
        CAST(round(((lng + 180) / 360 * n - x) * 4096) AS INT) AS px, my, n FROM (
        SELECT *, ln(tan((90.0 + greatest(-{tm.WORLD_EDGE!r}, least({tm.WORLD_EDGE!r}, lat))) * pi() / 360.0)) / (pi() / 180.0) AS my FROM centers)
        JOIN {_TILES} ON {_in_tile(3, 'n', 'x', 'y')})
    SELECT h, z, x, y, px, py, px BETWEEN -256 AND 4352 AND py BETWEEN -256 AND 4352 AS in_buffer FROM (
      SELECT *, CAST(round(((180 - my) / 360 * n - y) * 4096) AS INT) AS py FROM px)""")
def tile_features(spark, sf):
    tiles = tl.build_tiles(t.centers(spark, sf), 3, [2, 4]).withColumn("mx", tm.mercator_x("lng")).withColumn("my", tm.mercator_y("lat"))
    return tl.tile_features(tiles, "mx", "my").select("h", "z", "x", "y", "px", "py", "in_buffer")


def _ring(half_x: float):
    lng, lat = F.col("lng"), F.col("lat")

    def wrap(x):
        return F.when(x > 180, x - 360).when(x < -180, x + 360).otherwise(x)

    return F.array(*[
        vertex(wrap(lng + dx), lat + dy) for dx, dy in ((-half_x, -1), (half_x, -1), (half_x, 1), (-half_x, 1), (-half_x, -1))
    ])


@query("dateline_unwrap", "centers", """
    , v AS (SELECT h, lng, unnest([1, 2, 3, 4]) AS i, unnest([lng - 3, lng + 3, lng + 3, lng - 3]) AS raw FROM centers),
    w AS (SELECT *, CASE WHEN raw > 180 THEN raw - 360 WHEN raw < -180 THEN raw + 360 ELSE raw END AS x FROM v),
    c AS (SELECT h, lng, MIN(x) AS low, MAX(x) AS high, MAX(x) - MIN(x) > 180 AS crosses FROM w GROUP BY 1, 2)
    SELECT crosses, COUNT(*) AS n, ROUND(MIN(x0), 6) AS west, ROUND(MAX(x1), 6) AS east FROM (
      SELECT c.crosses, c.h, MIN(x2) AS x0, MAX(x2) AS x1 FROM (SELECT w.h, w.lng, crosses,
        CASE WHEN crosses AND x - w.lng > 180 THEN x - 360 WHEN crosses AND x - w.lng < -180 THEN x + 360 ELSE x END AS x2
        FROM w JOIN c ON w.h = c.h AND w.lng = c.lng) c GROUP BY 1, 2) GROUP BY 1""")
def dateline_unwrap(spark, sf):
    rings = t.centers(spark, sf).withColumn("ring", _ring(3.0)).withColumn("fixed", unwrap_dateline("ring", "lng"))
    xs = F.transform("ring", lambda v: v["x"])
    ends = rings.select(
        (F.array_max(xs) - F.array_min(xs) > 180).alias("crosses"),
        F.array_min(F.transform("fixed", lambda v: v["x"])).alias("x0"),
        F.array_max(F.transform("fixed", lambda v: v["x"])).alias("x1"),
    )
    return ends.groupBy("crosses").agg(count(), F.round(F.min("x0"), 6).alias("west"), F.round(F.max("x1"), 6).alias("east"))


@query("mercator_ring", "centers", f"""
    SELECT h, ROUND((lng - 3) * {tm.HALF_WORLD_M / 180.0!r}, 3) AS west,
           ROUND(ln(tan((90.0 + greatest(-{tm.WORLD_EDGE!r}, least({tm.WORLD_EDGE!r}, lat + 1))) * pi() / 360.0)) / (pi() / 180.0) * {tm.HALF_WORLD_M / 180.0!r}, 3) AS north FROM centers""")
def mercator_ring(spark, sf):
    ring = tl.mercator_ring(_ring(3.0), "lng")
    return t.centers(spark, sf).select(
        "h", F.round(F.array_min(F.transform(ring, lambda v: v["x"])), 3).alias("west"),
        F.round(F.array_max(F.transform(ring, lambda v: v["y"])), 3).alias("north"),
    )


def _placed(df, h):
    """Given places for cells of any level."""
    part = F.shiftright(F.col(h), 23)
    return df.withColumn("lat", (part % 1601) / 10.0 - 80.0).withColumn("lng", (part % 3499) / 10.0 - 175.0)


def _level_tiles(z: int, res: int) -> str:
    level = f"SELECT {parent_sql('h8', res)} AS h, COUNT(*) AS count FROM value_hex GROUP BY 1"
    placed = f"SELECT *, ((h >> 23) % 1601) / 10.0 - 80.0 AS lat, ((h >> 23) % 3499) / 10.0 - 175.0 AS lng FROM ({level})"
    return (
        f"SELECT {z} AS z, x, y, {res} AS res, COUNT(*) AS cells, CAST(SUM(count) AS BIGINT) AS n FROM ({placed}) CROSS JOIN "
        f"(SELECT a.x AS x, b.y AS y, {2.0 ** z} AS n FROM range({2 ** z}) a(x) CROSS JOIN range({2 ** z}) b(y)) WHERE {_in_tile(res, 'n', 'x', 'y')} GROUP BY 2, 3"
    )


@query("pyramid_tiles", "value_hex", " UNION ALL ".join(_level_tiles(z, r) for z, r in ((2, 5), (4, 5))))
def pyramid_tiles(spark, sf):
    built = build_pyramid(t.value_hex(spark, sf).select("h8"), fresh_dir(spark, "pyramid"), "value_hex", "COUNT", min_res=5)
    folder = fresh_dir(spark, "tiles")
    tl.write_tiles(tl.tiles_of(spark, built["path"], [2, 4], _placed), folder)
    tiles = spark.read.parquet(folder)
    return tiles.groupBy("z", "x", "y", "res").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("count").alias("n")
    ).select(F.col("z").cast("int").alias("z"), F.col("x").cast("bigint").alias("x"), "y", "res", "cells", "n")
