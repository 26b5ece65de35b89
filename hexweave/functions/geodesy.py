"""Cell geometry as Arrow-batched column functions.

Spark partitions the rows; each batch is one call into vectorised numpy. Use these
on distinct cells where possible, and the bit functions of `cells` for the rest.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexweave.functions import icosahedron as ico
from hexweave.functions.cells import BASE_CELL_COUNT, PENTAGON_BASE_CELLS, as_column, res0_id
from hexweave.functions.tilemath import EDGE_KM, HALF_WORLD_M, KM_PER_DEGREE

AREA_UNITS = {
    "km^2": ico.EARTH_RADIUS_KM**2,
    "m^2": ico.EARTH_RADIUS_KM**2 * 1e6,
    "rads^2": 1.0,
}


def _cells(h: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cell ids with NULLs replaced by some valid cell, and the NULL mask."""
    missing = np.asarray(h.is_null())
    return h.fill_null(int(_ANY_CELL)).to_numpy(zero_copy_only=False).astype(np.int64), missing


_ANY_CELL = (1 << 59) | ((1 << 45) - 1)


def _lists(values: pa.Array, real: np.ndarray, missing: np.ndarray) -> pa.Array:
    """List array of the real entries of every row; a NULL row stays NULL."""
    sizes = np.where(missing, 0, real.sum(axis=1))
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array(missing))


def latlng_to_cell(lat: Column | str, lng: Column | str, res: int) -> Column:
    """Cell at ``res`` containing a point given in degrees."""

    @F.arrow_udf("bigint")
    def run(lat: pa.Array, lng: pa.Array) -> pa.Array:
        y = lat.cast(pa.float64()).to_numpy(zero_copy_only=False)
        x = lng.cast(pa.float64()).to_numpy(zero_copy_only=False)
        bad = ~(np.isfinite(x) & np.isfinite(y))
        v = ico.from_latlng(np.where(bad, 0.0, y), np.where(bad, 0.0, x))
        return pa.array(ico.index(v, res) if len(v) else np.zeros(0, dtype=np.int64), mask=bad)

    return run(as_column(lat), as_column(lng))


def cell_center(h: Column | str) -> Column:
    """struct(lat, lng) of the cell centre in degrees."""

    @F.arrow_udf("struct<lat:double,lng:double>")
    def run(h: pa.Array) -> pa.Array:
        cells, missing = _cells(h)
        lat, lng = ico.to_latlng(ico.center(cells))
        parts = [pa.array(lat, mask=missing), pa.array(lng, mask=missing)]
        return pa.StructArray.from_arrays(parts, ["lat", "lng"])

    return run(as_column(h))


def cell_lat(h: Column | str) -> Column:
    return cell_center(h)["lat"]


def cell_lng(h: Column | str) -> Column:
    return cell_center(h)["lng"]


def cell_area(h: Column | str, unit: str = "km^2") -> Column:
    """Exact spherical area of a cell; an unknown unit gives NaN, not an error."""
    scale = AREA_UNITS.get(unit, float("nan"))

    @F.arrow_udf("double")
    def run(h: pa.Array) -> pa.Array:
        cells, missing = _cells(h)
        return pa.array(ico.area_rads2(cells) * scale, mask=missing)

    return run(as_column(h))


def _rings(h: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Closed boundary (n, 13, 3), mask of its real points, mask of NULL cells."""
    cells, missing = _cells(h)
    vectors, real = ico.ring(cells)
    # a pentagon has no point in some slots, so its first corner is looked up
    first = np.take_along_axis(vectors, real.argmax(axis=1)[:, None, None], axis=1)
    vectors = np.concatenate([vectors, first], axis=1)
    real = np.concatenate([real, np.ones((len(cells), 1), dtype=bool)], axis=1)
    return vectors, real & ~missing[:, None], missing


def cell_boundary(h: Column | str) -> Column:
    """Closed ring of the cell as ``array<struct<x, y>>`` in lon/lat order."""

    @F.arrow_udf("array<struct<x:double,y:double>>")
    def run(h: pa.Array) -> pa.Array:
        vectors, real, missing = _rings(h)
        lat, lng = ico.to_latlng(vectors[real])
        points = pa.StructArray.from_arrays([pa.array(lng), pa.array(lat)], ["x", "y"])
        return _lists(points, real, missing)

    return run(as_column(h))


def _boundary_wkt(h: pa.Array) -> pa.Array:
    vectors, real, missing = _rings(h)
    lat, lng = ico.to_latlng(vectors)
    texts = [
        None if skip else "POLYGON ((" + ", ".join(f"{x:.6f} {y:.6f}" for x, y in zip(xs[keep], ys[keep])) + "))"
        for xs, ys, keep, skip in zip(lng, lat, real, missing)
    ]
    return pa.array(texts, pa.string())


def cell_boundary_wkt(h: Column | str) -> Column:
    """The closed ring as POLYGON text with six decimals, spelled from `cell_boundary` in the JVM."""
    corners = F.transform(cell_boundary(h), lambda v: F.format_string("%.6f %.6f", v["x"], v["y"]))
    return F.concat(F.lit("POLYGON (("), F.array_join(corners, ", "), F.lit("))"))


def grid_disk(h: Column | str, k: int = 1) -> Column:
    """Array of the cells within ``k`` steps of a cell, itself included, ascending."""

    @F.arrow_udf("array<bigint>")
    def run(h: pa.Array) -> pa.Array:
        return _disk(h, k)

    return run(as_column(h))


def _disk(h: pa.Array, k: int) -> pa.Array:
    cells, missing = _cells(h)
    near, plain = ico.disk(cells, k)
    rows = np.flatnonzero(~plain)
    found = _walked(cells[rows], k)
    found[:, 0] = rows[found[:, 0]]
    plain_rows = np.flatnonzero(plain)
    own = np.stack([np.repeat(plain_rows, near.shape[1]), np.sort(near[plain_rows], axis=1).reshape(-1)], axis=1)
    found = np.concatenate([found, own])
    if len(rows):
        found = found[np.argsort(found[:, 0], kind="stable")]
    found = found[~missing[found[:, 0]]]
    sizes = np.bincount(found[:, 0], minlength=len(cells))
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(found[:, 1]), mask=pa.array(missing))


def _walked(cells: np.ndarray, k: int) -> np.ndarray:
    """(row, cell) of the cells within ``k`` steps, from neighbour to neighbour, ascending."""
    found = np.stack([np.arange(len(cells)), cells], axis=1)
    edge = found
    for _ in range(k):
        near, real = ico.neighbours(edge[:, 1])
        step = np.stack([np.repeat(edge[:, 0], 6), near.reshape(-1)], axis=1)[real.reshape(-1)]
        edge = np.unique(step, axis=0)
        found = np.unique(np.concatenate([found, edge]), axis=0)
    return found


def with_centers(df: DataFrame, h: str) -> DataFrame:
    """``df`` with ``lat`` and ``lng`` of its cells, from one geometry call per row."""
    return (
        df.withColumn("_center", cell_center(h))
        .withColumn("lat", F.col("_center.lat")).withColumn("lng", F.col("_center.lng")).drop("_center")
    )


def register(spark: SparkSession) -> None:
    """Make the cell functions callable from SQL.

    Bit functions become SQL functions, which Spark inlines as expressions.
    """
    pentagons = ", ".join(f"{b}L" for b in PENTAGON_BASE_CELLS)
    sql = {
        "h3_get_resolution(h BIGINT) RETURNS INT": "CAST(shiftright(h, 52) & 15 AS INT)",
        "h3_cell_to_parent(h BIGINT, res INT) RETURNS BIGINT": (
            f"CASE WHEN (shiftright(h, 52) & 15) >= res THEN (h & {~(15 << 52)}L)"
            " | shiftleft(CAST(res AS BIGINT), 52) | (shiftleft(1L, 3 * (15 - res)) - 1L) END"
        ),
        "h3_cell_to_children(h BIGINT, res INT) RETURNS ARRAY<BIGINT>": (
            "reduce(IF(res > (shiftright(h, 52) & 15), sequence(CAST(shiftright(h, 52) & 15 AS INT) + 1, res), array()),"
            " array(h), (found, r) -> flatten(transform(found, c -> transform("
            f" IF(array_contains(array({pentagons}), shiftright(c, 45) & 127)"
            " AND (c & 35184372088831L) = shiftleft(1L, 3 * (16 - r)) - 1L, array(0, 2, 3, 4, 5, 6), array(0, 1, 2, 3, 4, 5, 6)),"
            " d -> c + 4503599627370496L - (7 - d) * shiftleft(1L, 3 * (15 - r))))))"
        ),
        "h3_get_res0_cells() RETURNS ARRAY<BIGINT>": (
            f"transform(sequence(0L, {BASE_CELL_COUNT - 1}L), b -> {_ANY_CELL}L + b * 35184372088832L)"
        ),
        "mercator_x(lng DOUBLE) RETURNS DOUBLE": f"lng * {HALF_WORLD_M / 180.0!r}D",
        "mercator_y(lat DOUBLE) RETURNS DOUBLE": (
            f"ln(tan((90.0D + lat) * pi() / 360.0D)) / (pi() / 180.0D) * {HALF_WORLD_M / 180.0!r}D"
        ),
        "h3_string_to_h3(s STRING) RETURNS BIGINT": "CAST(conv(s, 16, 10) AS BIGINT)",
        "h3_h3_to_string(h BIGINT) RETURNS STRING": "lower(hex(h))",
        "h3_great_circle_distance(lat1 DOUBLE, lng1 DOUBLE, lat2 DOUBLE, lng2 DOUBLE, unit STRING) RETURNS DOUBLE": (
            "2 * asin(sqrt(least(1.0D, power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2))"
            f" * power(sin(radians(lng2 - lng1) / 2), 2)))) * CASE unit WHEN 'km' THEN {ico.EARTH_RADIUS_KM}D"
            f" WHEN 'm' THEN {ico.EARTH_RADIUS_KM * 1000}D WHEN 'rads' THEN 1.0D ELSE double('NaN') END"
        ),
    }
    for head, body in sql.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for name, kind, f in _SQL_UDFS:
        spark.udf.register(name, F.arrow_udf(f, kind))
    spark.udtf.register("h3_polygon_wkt_to_cells", F.udtf(PolygonCells, returnType="h BIGINT"))


class PolygonCells:
    """Table function: the cells of a resolution whose centres lie in a POLYGON or MULTIPOLYGON text, even-odd and planar.

    For shapes of which a task holds the cells; `operators.places.polygons_to_cells` spreads one shape over tasks. Other
    texts and NULL have no cells.
    """

    def eval(self, wkt: str, res: int):
        if wkt is None or res is None or not re.match(r"(?i)\s*(multi)?polygon\b", wkt):
            return
        rings = [
            np.array([[float(n) for n in v.split()[:2]] for v in ring.split(",")]) for ring in re.findall(r"\(([^()]+)\)", wkt)
        ]
        if not rings:
            return
        ends = np.vstack([np.hstack([r[:-1], r[1:]]) for r in rings])
        (west, south), (east, north) = ends[:, :2].min(0), ends[:, :2].max(0)
        cells = np.array([res0_id(b) for b in range(BASE_CELL_COUNT)], np.int64)
        for r in range(res + 1):
            if r:
                cells = _children(cells, r)
            lat, lng = ico.to_latlng(ico.center(cells))
            # Descendants stay within some 1.5 edges of the centre; cells that are stretched most have 1.6.
            reach = 1.6 * EDGE_KM[r] / KM_PER_DEGREE if r < res else 0.0
            polar = np.minimum(90, np.maximum(np.abs(lat), max(abs(south), abs(north))) + reach)
            spread = np.where(polar >= 89, 360.0, reach / np.cos(np.radians(np.minimum(polar, 89))))
            near = np.zeros(len(cells), bool)
            for turn in (-360, 0, 360) if reach else (0,):
                near |= (lng + turn >= west - spread) & (lng + turn <= east + spread)
            cells = cells[near & (lat >= south - reach) & (lat <= north + reach)]
        lat, lng = ico.to_latlng(ico.center(cells))
        inside = np.zeros(len(cells), bool)
        for ax, ay, bx, by in ends:
            spans = (ay > lat) != (by > lat)
            inside[spans] ^= lng[spans] < ax + (lat[spans] - ay) * (bx - ax) / (by - ay)
        for h in cells[inside].tolist():
            yield (h,)


def _children(cells: np.ndarray, res: int) -> np.ndarray:
    """The children at ``res`` of cells one resolution coarser; a pentagon has none along its first axis."""
    digits = np.arange(7)
    every = cells[:, None] + (1 << 52) - ((7 - digits) << 3 * (15 - res))
    pentagon = np.isin(cells >> 45 & 127, PENTAGON_BASE_CELLS) & (cells & (1 << 45) - 1 == (1 << 3 * (16 - res)) - 1)
    return every[~(pentagon[:, None] & (digits == 1))]


def _per_value(values: pa.Array, f: Callable[[np.ndarray, object], None]) -> None:
    """Call ``f(rows, value)`` for each distinct value of a small-domain argument."""
    codes = values.to_numpy(zero_copy_only=False)
    for value in set(values.to_pylist()):
        if value is not None:
            f(np.flatnonzero(codes == value), value)


def _sql_index(lat: pa.Array, lng: pa.Array, res: pa.Array) -> pa.Array:
    v = ico.from_latlng(lat.to_numpy(zero_copy_only=False), lng.to_numpy(zero_copy_only=False))
    out, bad = np.zeros(len(v), dtype=np.int64), ~np.isfinite(v).all(axis=1) | np.asarray(res.is_null())

    def fill(rows, r):
        rows = rows[~bad[rows]]
        out[rows] = ico.index(v[rows], int(r))

    _per_value(res, fill)
    return pa.array(out, mask=bad)


def _sql_lat(h: pa.Array) -> pa.Array:
    cells, missing = _cells(h)
    return pa.array(ico.to_latlng(ico.center(cells))[0], mask=missing)


def _sql_lng(h: pa.Array) -> pa.Array:
    cells, missing = _cells(h)
    return pa.array(ico.to_latlng(ico.center(cells))[1], mask=missing)


def _sql_area(h: pa.Array, unit: pa.Array) -> pa.Array:
    cells, missing = _cells(h)
    out = ico.area_rads2(cells)
    scale = np.full(len(out), np.nan)
    _per_value(unit, lambda rows, u: scale.__setitem__(rows, AREA_UNITS.get(u, np.nan)))
    return pa.array(out * scale, mask=missing)


def _sql_disk(h: pa.Array, k: pa.Array) -> pa.Array:
    parts, order = [], []

    def fill(rows, steps):
        parts.append(_disk(h.take(pa.array(rows)), int(steps)))
        order.append(rows)

    _per_value(k, fill)
    rest = np.flatnonzero(np.asarray(k.is_null()))
    parts.append(pa.nulls(len(rest), pa.list_(pa.int64())))
    order.append(rest)
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(order), kind="stable")))


_SQL_UDFS = [
    ("h3_latlng_to_cell", "bigint", _sql_index),
    ("h3_cell_to_lat", "double", _sql_lat),
    ("h3_cell_to_lng", "double", _sql_lng),
    ("h3_cell_area", "double", _sql_area),
    ("h3_grid_disk", "array<bigint>", _sql_disk),
    ("h3_cell_to_boundary_wkt", "string", _boundary_wkt),
]
