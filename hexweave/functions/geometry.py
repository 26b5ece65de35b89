"""Planar and spherical geometry on vertex arrays, as column expressions.

A line or ring is ``array<struct<x:double, y:double>>`` in lon/lat order; a ring
repeats its first vertex at the end.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from hexweave.functions.cells import as_column, great_circle


def vertex(x, y) -> Column:
    return F.struct(as_column(x).cast("double").alias("x"), as_column(y).cast("double").alias("y"))


def flip(line) -> Column:
    """Swap the axes of every vertex."""
    return F.transform(as_column(line), lambda v: vertex(v["y"], v["x"]))


def over_segments(line, f: Callable[[Column, Column], Column]) -> Column:
    """Array of ``f(start, end)`` over consecutive vertices."""
    line = as_column(line)
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), f)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _distance(a: Column, b: Column) -> Column:
    return F.hypot(b["x"] - a["x"], b["y"] - a["y"])


def planar_length(line) -> Column:
    """Length in the line's own units (degrees for lon/lat)."""
    return array_sum(over_segments(line, _distance))


def line_length_m(line) -> Column:
    """Length in metres of a lon/lat line on the sphere."""
    return array_sum(
        over_segments(line, lambda a, b: great_circle(a["y"], a["x"], b["y"], b["x"], "m"))
    )


# The WGS84 ellipsoid, as its semi-major axis in metres and its flattening.
WGS84_AXIS_M, WGS84_FLATTENING = 6378137.0, 1 / 298.257223563


def spheroid_distance_m(lat1, lng1, lat2, lng2) -> Column:
    """Metres between two points on the ellipsoid, by Lambert's flattening correction of the great circle.

    Good to some metres over thousands of kilometres; antipodal points take the uncorrected half circle.
    """
    f = WGS84_FLATTENING
    b1, b2 = (F.atan((1 - f) * F.tan(F.radians(as_column(v)))) for v in (lat1, lat2))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    across = F.radians(as_column(lng2) - as_column(lng1)) / 2
    # half of the central angle on the auxiliary sphere
    s = F.least(F.lit(1.0), F.pow(F.sin(q), 2) + F.cos(b1) * F.cos(b2) * F.pow(F.sin(across), 2))
    angle = 2 * F.asin(F.sqrt(s))
    x = F.try_divide((angle - F.sin(angle)) * F.pow(F.sin(p) * F.cos(q), 2), 1 - s)
    y = F.try_divide((angle + F.sin(angle)) * F.pow(F.cos(p) * F.sin(q), 2), s)
    return WGS84_AXIS_M * (angle - f / 2 * (F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))))


def line_length_spheroid_m(line) -> Column:
    """Length in metres of a lon/lat line on the ellipsoid."""
    return array_sum(over_segments(line, lambda a, b: spheroid_distance_m(a["y"], a["x"], b["y"], b["x"])))


def _crossings(ring, x: Column, y: Column) -> Column:
    """How many of a ring's edges lie east of a point, each half-open."""
    def crosses(a: Column, b: Column) -> Column:
        spans = (a["y"] > y) != (b["y"] > y)
        at = a["x"] + F.try_divide((y - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"])
        return F.when(spans & (x < at), F.lit(1)).otherwise(F.lit(0))

    return F.aggregate(over_segments(ring, crosses), F.lit(0), lambda acc, v: acc + v)


def point_in_ring(ring, x, y) -> Column:
    """Even-odd test, half-open so that a point on a shared edge is in one ring."""
    return _crossings(ring, as_column(x), as_column(y)) % 2 == 1


def point_in_rings(rings, x, y) -> Column:
    """The same over all rings of a shape: parts add, holes take away."""
    x, y = as_column(x), as_column(y)
    hits = F.aggregate(as_column(rings), F.lit(0), lambda acc, ring: acc + _crossings(ring, x, y))
    return hits % 2 == 1


def rings_of(df: DataFrame, shape: str) -> Column:
    """Column ``shape`` of ``df`` as an array of rings, whatever it holds: a ring, the rings of a polygon, or polygons."""
    depth, kind = 0, df.schema[shape].dataType
    while isinstance(kind, ArrayType):
        depth, kind = depth + 1, kind.elementType
    column = F.col(f"`{shape}`")
    if depth not in (1, 2, 3):
        raise ValueError(f"{shape!r} is no ring, polygon or multipolygon")
    return F.array(column) if depth == 1 else column if depth == 2 else F.flatten(column)


def _crossing(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Where along a-b it meets c-d, as 0..1; NULL when parallel or apart."""
    rx, ry = b["x"] - a["x"], b["y"] - a["y"]
    sx, sy = d["x"] - c["x"], d["y"] - c["y"]
    cross = rx * sy - ry * sx
    t = F.try_divide((c["x"] - a["x"]) * sy - (c["y"] - a["y"]) * sx, cross)
    u = F.try_divide((c["x"] - a["x"]) * ry - (c["y"] - a["y"]) * rx, cross)
    return F.when(t.between(0.0, 1.0) & u.between(0.0, 1.0), t)


def length_inside(line, ring) -> Column:
    """Planar length of the part of ``line`` inside ``ring``."""
    return length_inside_rings(line, F.array(as_column(ring)))


def length_inside_rings(line, rings) -> Column:
    """Planar length of the part of ``line`` inside a shape of several rings.

    Each segment is cut where it meets a ring; a piece counts when its midpoint
    is inside, which settles touching vertices and collinear edges.
    """
    rings = as_column(rings)

    def inside(a: Column, b: Column) -> Column:
        met = F.flatten(F.transform(rings, lambda ring: over_segments(ring, lambda c, d: _crossing(a, b, c, d))))
        cuts = F.filter(met, lambda t: t.isNotNull())
        stops = F.array_sort(F.concat(F.array(F.lit(0.0)), cuts, F.array(F.lit(1.0))))
        n = F.size(stops) - 1

        def piece(t0: Column, t1: Column) -> Column:
            mid = (t0 + t1) / 2
            hit = point_in_rings(
                rings, a["x"] + mid * (b["x"] - a["x"]), a["y"] + mid * (b["y"] - a["y"])
            )
            return F.when(hit, t1 - t0).otherwise(F.lit(0.0))

        pieces = F.zip_with(F.slice(stops, F.lit(1), n), F.slice(stops, F.lit(2), n), piece)
        return array_sum(pieces) * _distance(a, b)

    return array_sum(over_segments(line, inside))


def polygon_wkt(rings) -> Column:
    """Well-known text of a polygon's rings, the outer one first."""
    def text(ring: Column) -> Column:
        points = F.transform(ring, lambda v: F.concat_ws(" ", v["x"].cast("string"), v["y"].cast("string")))
        return F.concat(F.lit("("), F.array_join(points, ", "), F.lit(")"))

    return F.concat(F.lit("POLYGON ("), F.array_join(F.transform(as_column(rings), text), ", "), F.lit(")"))


def to_wkt(line, kind: str = "LINESTRING") -> Column:
    """Well-known text of a line (or of a ring, with ``kind='POLYGON'``)."""
    body = F.array_join(
        F.transform(
            as_column(line),
            lambda v: F.concat_ws(" ", v["x"].cast("string"), v["y"].cast("string")),
        ),
        ", ",
    )
    if kind == "POLYGON":
        return F.concat(F.lit("POLYGON (("), body, F.lit("))"))
    return F.concat(F.lit(f"{kind} ("), body, F.lit(")"))


def bounds(line) -> Column:
    """struct(west, south, east, north) of a vertex array."""
    line = as_column(line)
    xs = F.transform(line, lambda v: v["x"])
    ys = F.transform(line, lambda v: v["y"])
    return F.struct(
        F.array_min(xs).alias("west"), F.array_min(ys).alias("south"),
        F.array_max(xs).alias("east"), F.array_max(ys).alias("north"),
    )


def unwrap_dateline(ring, center_lng) -> Column:
    """Shift a ring that spans more than 180 degrees into one frame.

    Vertices move by 360 degrees towards the cell centre, so a cell across the
    antimeridian stays one small polygon just past the world edge.
    """
    ring, center = as_column(ring), as_column(center_lng)
    box = bounds(ring)
    crosses = box["east"] - box["west"] > 180.0

    def shift(v: Column) -> Column:
        x = (
            F.when(crosses & (v["x"] - center > 180.0), v["x"] - 360.0)
            .when(crosses & (v["x"] - center < -180.0), v["x"] + 360.0)
            .otherwise(v["x"])
        )
        return vertex(x, v["y"])

    return F.transform(ring, shift)


def parse_wkt(text) -> Column:
    """Rings of a POLYGON or MULTIPOLYGON text, all parts and holes in one array: their even-odd rule is the shape's.

    Further ordinates of a vertex are left out. NULL for any other text, an empty array for an EMPTY shape.
    """
    text = F.trim(as_column(text))
    head = r"(?i)^(?:SRID\s*=\s*[0-9]+\s*;\s*)?(?:MULTI)?POLYGON\s*(?:ZM|Z|M)?\s*"
    # Character classes only: a pattern with repeated groups would overflow the stack on long rings.
    known = text.rlike(head + r"\([-+0-9.eE,()\s]+\)$")
    empty = text.rlike(head + r"EMPTY$")

    def at(v: Column, i: int) -> Column:
        return F.get(F.split(F.trim(v), r"\s+"), i).try_cast("double")

    rings = F.transform(
        F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), F.lit(1)),
        lambda ring: F.transform(F.split(ring, ","), lambda v: vertex(at(v, 0), at(v, 1))),
    )
    broken = F.exists(F.flatten(rings), lambda v: v["x"].isNull() | v["y"].isNull()) | (F.size(rings) == 0)
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    return F.when(known & ~broken, rings).when(empty, none)


# --- shapes over the antimeridian ----------------------------------------------------


def _unwrapped(ring: Column) -> Column:
    """A closed ring without jumps: every edge goes the short way round. A ring around a pole is closed over it."""
    def jump(v: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(ring, i - 1)["x"]).otherwise(v["x"])
        return F.struct(i.alias("i"), F.rint((before - v["x"]) / 360.0).alias("turns"))

    # Few vertices follow a jump, so each adds up those before it.
    jumps = F.filter(F.transform(ring, jump), lambda j: j["turns"] != 0)

    def shifted(found: Column) -> Column:
        def shift(v: Column, i: Column) -> Column:
            turns = F.aggregate(found, F.lit(0.0), lambda a, j: a + F.when(j["i"] <= i, j["turns"]).otherwise(F.lit(0.0)))
            return vertex(v["x"] + 360.0 * turns, v["y"])

        moved = F.transform(ring, shift)
        around = F.aggregate(found, F.lit(0.0), lambda a, j: a + j["turns"]) != 0
        pole = F.when(array_sum(F.transform(ring, lambda v: v["y"])) < 0, F.lit(-90.0)).otherwise(F.lit(90.0))
        first, last = F.element_at(moved, 1), F.element_at(moved, -1)
        over = F.array(vertex(last["x"], pole), vertex(first["x"], pole), vertex(first["x"], first["y"]))
        return F.when(around, F.concat(moved, over)).otherwise(moved)

    return F.transform(F.array(jumps), shifted)[0]


def _cut(ring: Column, bound: float, keep_above: bool) -> Column:
    """The part of a closed ring on one side of a meridian, closed along it."""
    def inside(v: Column) -> Column:
        return v["x"] >= bound if keep_above else v["x"] <= bound

    def edge(a: Column, b: Column) -> Column:
        at = vertex(F.lit(bound), a["y"] + F.try_divide((F.lit(bound) - a["x"]) * (b["y"] - a["y"]), b["x"] - a["x"]))
        own = vertex(b["x"], b["y"])
        return (
            F.when(inside(a) & inside(b), F.array(own)).when(inside(b), F.array(at, own)).when(inside(a), F.array(at))
            .otherwise(F.array().cast("array<struct<x:double,y:double>>"))
        )

    cut = F.flatten(over_segments(ring, edge))
    return F.when(F.size(cut) > 0, F.concat(cut, F.array(F.element_at(cut, 1)))).otherwise(cut)


def dateline_parts(rings) -> Column:
    """A shape as an array of shapes that do not cross the antimeridian: itself, or its halves east and west of Greenwich.

    An edge of more than 180 degrees of longitude is taken the short way, over the antimeridian. A ring that winds around the
    earth holds the pole of the hemisphere that its vertices are in on average.
    """
    rings = as_column(rings)
    crosses = F.exists(rings, lambda ring: F.exists(over_segments(ring, lambda a, b: F.abs(b["x"] - a["x"]) > 180.0), lambda j: j))
    copies = F.flatten(F.transform(
        F.transform(rings, _unwrapped),
        lambda ring: F.transform(
            F.array(*[F.lit(360.0 * k) for k in (-2, -1, 0, 1, 2)]),
            lambda by: F.transform(ring, lambda v: vertex(v["x"] + by, v["y"])),
        ),
    ))

    def half(low: float, high: float) -> Column:
        cut = F.transform(copies, lambda ring: F.transform(F.array(_cut(ring, low, True)), lambda r: _cut(r, high, False))[0])
        return F.filter(cut, lambda ring: F.size(ring) > 3)

    halves = F.filter(F.array(half(0.0, 180.0), half(-180.0, 0.0)), lambda part: F.size(part) > 0)
    return F.when(crosses, halves).otherwise(F.array(rings))


def across_dateline(df: DataFrame, shape: str) -> DataFrame:
    """``df`` with a row for each of the `dateline_parts` of a shape; the parts of one shape do not overlap."""
    kept = df.withColumn(shape, F.explode_outer(dateline_parts(rings_of(df, shape))))
    return kept.select(*df.columns)


# --- geodesics -----------------------------------------------------------------------


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _inverse(lat1: Column, lat2: Column, turn: Column) -> Column:
    """Metres between two latitudes (degrees) whose longitudes differ by ``turn`` radians; NULL where the iteration fails.

    Vincenty's inverse: the longitude on the auxiliary sphere is iterated until it stays.
    """
    f = WGS84_FLATTENING
    short = WGS84_AXIS_M * (1 - f)

    def reduced(lat: Column) -> Column:
        return F.atan((1 - f) * F.tan(F.radians(lat)))

    def from_latitudes(u: Column) -> Column:
        def on_sphere(lam: Column) -> Column:
            across = F.hypot(u["c2"] * F.sin(lam), u["c1"] * u["s2"] - u["s1"] * u["c2"] * F.cos(lam))
            along = u["s1"] * u["s2"] + u["c1"] * u["c2"] * F.cos(lam)

            def azimuth(p: Column) -> Column:
                sin_a = F.coalesce(F.try_divide(u["c1"] * u["c2"] * F.sin(lam), p["ss"]), F.lit(0.0))
                return _let(sin_a, lambda a: F.struct(
                    p["ss"].alias("ss"), p["cs"].alias("cs"), F.atan2(p["ss"], p["cs"]).alias("s"), a.alias("a"), (1 - a * a).alias("c2a"),
                    F.coalesce(p["cs"] - F.try_divide(2 * u["s1"] * u["s2"], F.when(1 - a * a > 1e-15, 1 - a * a)), F.lit(0.0)).alias("cm"),
                ))

            return _let(F.struct(across.alias("ss"), along.alias("cs")), azimuth)

        def step(state: Column, _: Column) -> Column:
            def moved(p: Column) -> Column:
                c = f / 16 * p["c2a"] * (4 + f * (4 - 3 * p["c2a"]))
                pull = p["s"] + c * p["ss"] * (p["cm"] + c * p["cs"] * (2 * p["cm"] * p["cm"] - 1))
                return _let(turn + (1 - c) * f * p["a"] * pull, lambda lam: F.struct(lam.alias("lam"), F.abs(lam - state["lam"]).alias("gap")))

            return F.when(state["gap"] < 1e-13, state).otherwise(_let(on_sphere(state["lam"]), moved))

        def metres(state: Column) -> Column:
            def length(p: Column) -> Column:
                w = p["c2a"] * (1 / (1 - f) ** 2 - 1)
                big = 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w)))
                b = w / 1024 * (256 + w * (-128 + w * (74 - 47 * w)))
                m = p["cm"]
                less = b * p["ss"] * (m + b / 4 * (p["cs"] * (2 * m * m - 1) - b / 6 * m * (4 * p["ss"] * p["ss"] - 3) * (4 * m * m - 3)))
                return short * big * (p["s"] - less)

            settled = (state["gap"] < 1e-11) & (F.abs(state["lam"]) <= math.pi)
            return F.when(settled, _let(on_sphere(state["lam"]), length))

        start = F.struct(turn.alias("lam"), F.lit(1.0).alias("gap"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, step, metres)

    u1, u2 = reduced(lat1), reduced(lat2)
    return _let(
        F.struct(F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2")), from_latitudes
    )


def geodesic_m(lat1, lng1, lat2, lng2) -> Column:
    """Metres of the shortest line between two points on the ellipsoid, to about a millimetre.

    Nearly antipodal points, for which the iteration does not settle, go through the meridian half way between them: the
    shortest sum of both halves is searched along it, first on a grid and then by thirds.
    """
    lat1, lng1, lat2, lng2 = (as_column(v).cast("double") for v in (lat1, lng1, lat2, lng2))

    def between(p: Column) -> Column:
        def through(lat: Column) -> Column:
            return _inverse(p["a"], lat, p["turn"] / 2) + _inverse(lat, p["b"], p["turn"] / 2)

        def search(near: Column) -> Column:
            def third(r: Column, _: Column) -> Column:
                low, high = r["low"] + (r["high"] - r["low"]) / 3, r["high"] - (r["high"] - r["low"]) / 3
                return F.when(through(low) < through(high), F.struct(r["low"].alias("low"), high.alias("high"))).otherwise(
                    F.struct(low.alias("low"), r["high"].alias("high"))
                )

            first = F.struct(F.greatest(F.lit(-90.0), near - 5.0).alias("low"), F.least(F.lit(90.0), near + 5.0).alias("high"))
            return F.aggregate(F.sequence(F.lit(1), F.lit(36)), first, third, lambda r: through((r["low"] + r["high"]) / 2))

        def around() -> Column:
            grid = F.transform(F.sequence(F.lit(-18), F.lit(18)), lambda k: F.struct(through(k * 5.0).alias("m"), (k * 5.0).alias("lat")))
            return _let(F.array_min(F.filter(grid, lambda g: g["m"].isNotNull()))["lat"], search)

        return _let(_inverse(p["a"], p["b"], p["turn"]), lambda m: F.when(m.isNotNull(), m).otherwise(around()))

    turn = F.radians(F.pmod(lng2 - lng1 + 180.0, F.lit(360.0)) - 180.0)
    known = lat1.isNotNull() & lat2.isNotNull() & turn.isNotNull()
    return F.when(known, _let(F.struct(lat1.alias("a"), lat2.alias("b"), turn.alias("turn")), between))


def line_length_geodesic_m(line) -> Column:
    """Length in metres of a lon/lat line, each segment being a geodesic of the ellipsoid."""
    return array_sum(over_segments(line, lambda a, b: geodesic_m(a["y"], a["x"], b["y"], b["x"])))
