"""Web-mercator tile arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from hexweave.functions.cells import as_column

# Mean hexagon edge length in km for resolutions 0..15, kilometres
# per degree, the mercator latitude limit and the mercator half-width in metres.
EDGE_KM = [
    1107.712591, 418.6760055, 158.2446558, 59.81085794, 22.6063794, 8.544408276,
    3.229482772, 1.220629759, 0.461354684, 0.174375668, 0.065907807, 0.024910561,
    0.009415526, 0.003559893, 0.001348575, 0.000509713,
]
KM_PER_DEGREE = 111.195
LAT_LIMIT = 85.0511
WORLD_EDGE = math.degrees(math.atan(math.sinh(math.pi)))
HALF_WORLD_M = 20037508.34
TARGET_CELLS_PER_TILE = 4000
APERTURE = 7.0
NEUTRAL_ZOOM_OFFSET = 2
TILE_EXTENT = 4096
TILE_BUFFER = 256


def mercator_x(lng) -> Column:
    return as_column(lng) * F.lit(HALF_WORLD_M / 180.0)


def mercator_y(lat) -> Column:
    """Mercator metres; latitudes beyond the edge of the square world count as the edge."""
    lat = F.greatest(F.lit(-WORLD_EDGE), F.least(F.lit(WORLD_EDGE), as_column(lat)))
    half_angle = (F.lit(90.0) + lat) * F.lit(math.pi / 360.0)
    return F.ln(F.tan(half_angle)) / F.lit(math.pi / 180.0) * F.lit(HALF_WORLD_M / 180.0)


def mercator_y_norm(lat) -> Column:
    """Latitude to [0, 1] from north to south, clamped to the mercator limit."""
    lat = F.greatest(F.lit(-LAT_LIMIT), F.least(F.lit(LAT_LIMIT), as_column(lat)))
    s = F.sin(F.radians(lat))
    return F.lit(0.5) - F.ln((F.lit(1.0) + s) / (F.lit(1.0) - s)) / F.lit(4 * math.pi)


def _side(z) -> Column:
    return F.pow(F.lit(2.0), as_column(z))


def _index(v: Column, z) -> Column:
    top = (_side(z) - 1).cast("bigint")
    return F.least(top, F.greatest(F.lit(0).cast("bigint"), F.floor(v).cast("bigint")))


def tile_x(lng, z) -> Column:
    return _index((as_column(lng) + 180.0) / 360.0 * _side(z), z)


def tile_y(lat, z) -> Column:
    return _index(mercator_y_norm(lat) * _side(z), z)


def tile_west(x, z) -> Column:
    return as_column(x) / _side(z) * 360.0 - 180.0


def tile_north(y, z) -> Column:
    frac = F.lit(1.0) - F.lit(2.0) * as_column(y) / _side(z)
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * frac)))


def tile_bounds(z, x, y) -> Column:
    """struct(west, south, east, north) in degrees."""
    x, y = as_column(x), as_column(y)
    return F.struct(
        tile_west(x, z).alias("west"),
        tile_north(y + 1, z).alias("south"),
        tile_west(x + 1, z).alias("east"),
        tile_north(y, z).alias("north"),
    )


def tiles_covering(z, west, south, east, north) -> Column:
    cols = tile_x(east, z) - tile_x(west, z) + 1
    rows = tile_y(south, z) - tile_y(north, z) + 1
    one = F.lit(1).cast("bigint")
    return F.greatest(one, cols) * F.greatest(one, rows)


def edge_km(res) -> Column:
    table = F.array(*[F.lit(v) for v in EDGE_KM])
    return F.element_at(table, (F.greatest(F.lit(0), F.least(F.lit(15), as_column(res))) + 1).cast("int"))


def pad_lat(res) -> Column:
    """Degrees of latitude spanned by one circumradius at ``res``."""
    return edge_km(res) / F.lit(KM_PER_DEGREE)


def pad_lng(res, lat) -> Column:
    return pad_lat(res) / F.greatest(F.lit(0.01), F.cos(F.radians(as_column(lat))))


def zoom_resolution(
    z, min_res, finest_res, zoom_offset=None, feature_count=None, n_tiles=None,
    target: int = TARGET_CELLS_PER_TILE,
) -> Column:
    """Resolution to show at zoom ``z``, clamped to the levels that exist.

    With a cell count and the number of tiles the data covers, the finest
    resolution whose mean load per tile stays below ``target``; otherwise the
    linear ``z - zoom_offset``.
    """
    z, min_res, finest_res = as_column(z), as_column(min_res), as_column(finest_res)
    offset = F.lit(NEUTRAL_ZOOM_OFFSET) if zoom_offset is None else as_column(zoom_offset)
    linear = (z - offset).cast("bigint")
    if feature_count is None or n_tiles is None:
        wanted = linear
    else:
        count = as_column(feature_count)
        load = F.lit(float(target)) * as_column(n_tiles) / F.nullif(count, F.lit(0))
        fine = F.floor(finest_res + F.ln(load) / F.lit(math.log(APERTURE)) + 0.5).cast("bigint")
        adaptive = fine + (F.lit(NEUTRAL_ZOOM_OFFSET) - offset)
        wanted = F.when(count > 0, adaptive).otherwise(linear)
    return F.greatest(min_res, F.least(finest_res, wanted)).cast("int")


def tile_pixel(merc, low, high) -> Column:
    """Mercator coordinate to tile pixels, measured from ``low``."""
    return F.round((merc - low) / (high - low) * F.lit(float(TILE_EXTENT))).cast("int")
