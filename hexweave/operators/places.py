"""Operators that need true cell geometry: areas, places, neighbours, covers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hexweave.functions import icosahedron as ico
from hexweave.functions import tilemath as tm
from hexweave.functions.cells import (
    BASE_CELL_COUNT, cell_parent, column_name, direct_children, great_circle, res0_id,
)
from hexweave.functions.crs import require_lonlat
from hexweave.functions.geodesy import cell_area, cell_center, grid_disk, latlng_to_cell, with_centers
from hexweave.functions.geometry import across_dateline, bounds, over_segments, point_in_rings, rings_of
from hexweave.operators.joins import keys, static_partitions, with_h0
from hexweave.operators.measures import ACRES_PER_KM2
from hexweave.operators.sizing import shuffle_width, small_side
from hexweave.session import materialize


def area(df: DataFrame, res: int, by: str | Sequence[str] | None = None, unit: str = "km^2") -> DataFrame:
    """Exact area of the distinct cells of each group.

    Accepts the units of `cell_area`, and ``acres``.
    """
    by = [] if by is None else [by] if isinstance(by, str) else list(by)
    acres = unit == "acres"
    one = cell_area(column_name(res), "km^2" if acres else unit)
    cells = df.select(*by, column_name(res)).distinct()
    total = F.sum(one) * F.lit(ACRES_PER_KM2 if acres else 1.0)
    return cells.groupBy(*by).agg(total.alias("area"))


def feature_centroid(df: DataFrame, res: int, by: str) -> DataFrame:
    """Mean centre of the cells of each feature.

    Rows are counted per (feature, cell) first, so geometry runs once per cell.
    """
    cells = df.groupBy(by, column_name(res)).agg(F.count(F.lit(1)).alias("_n"))
    located = with_centers(cells, column_name(res))
    n = F.sum("_n")
    return located.groupBy(by).agg(
        (F.sum(F.col("lat") * F.col("_n")) / n).alias("lat"), (F.sum(F.col("lng") * F.col("_n")) / n).alias("lng")
    )


def index_points(df: DataFrame, res: int, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """``df`` with ``h<res>`` and ``h0`` of its points."""
    df = df.withColumn(column_name(res), latlng_to_cell(lat, lng, res))
    return df.withColumn("h0", cell_parent(column_name(res), 0)) if res else df


def value_at(df: DataFrame, points: DataFrame, res: int, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Rows of a hex table at the cells of some points."""
    located = index_points(points, res, lat, lng)
    return with_h0(df, res).join(small_side(located), keys(res))


def nearby_base_cells(points: DataFrame, lat: str = "lat", lng: str = "lng") -> list[int]:
    """Base cells of some points and their neighbours: at most 122 values."""
    cells = points.select(latlng_to_cell(lat, lng, 0).alias("h0")).distinct()
    return static_partitions(cells.select(F.explode(grid_disk("h0", 1)).alias("h0")))


def scope_by_points(df: DataFrame, points: DataFrame, where: Column, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Rows that satisfy ``where``, read only from the partitions near some points."""
    return df.where(F.col("h0").isin(nearby_base_cells(points, lat, lng)) & where)


def base_cell_centers() -> Column:
    """The 122 base cells with their centres, as a literal array."""
    cells = [res0_id(b) for b in range(BASE_CELL_COUNT)]
    lats, lngs = ico.to_latlng(ico.center(np.array(cells, np.int64)))
    return F.array(*[
        F.struct(F.lit(h).cast("bigint").alias("h0"), F.lit(float(lat)).alias("lat"), F.lit(float(lng)).alias("lng"))
        for h, lat, lng in zip(cells, lats, lngs, strict=True)
    ])


def base_cells_of_boxes(boxes: DataFrame, box: str) -> list[int]:
    """Base cells that hold a cell whose centre can lie in one of the boxes.

    All 122 centres are tested against every box, widened by the reach of a base cell, so a box of any size is
    covered whole. ``box`` has west, south, east and north.
    """
    b = F.col(box)
    hit = F.filter(base_cell_centers(), lambda c: _near_box(c, b, _reach(0)))
    return static_partitions(boxes.select(F.explode(F.transform(hit, lambda c: c["h0"])).alias("h0")))


def scope_by_name(df: DataFrame, flat: DataFrame, feature_id: str, where: Column, line: str) -> DataFrame:
    """Rows of the features a predicate on the flat table selects.

    The features' boxes give the partitions to read; the ids give the rows.
    """
    found = flat.where(where).select(feature_id, bounds(line).alias("b"))
    near = df.where(F.col("h0").isin(base_cells_of_boxes(found, "b")))
    return near.join(found.select(feature_id).distinct(), feature_id, "left_semi")


def cell_distance(df: DataFrame, a: str, b: str, unit: str = "km", out: str = "distance") -> DataFrame:
    """Distance between the centres of two cell columns."""
    df = df.withColumn("_a", cell_center(a)).withColumn("_b", cell_center(b))
    args = F.col("_a.lat"), F.col("_a.lng"), F.col("_b.lat"), F.col("_b.lng")
    return df.withColumn(out, great_circle(*args, unit)).drop("_a", "_b")


def polygons_to_cells(
    polygons: DataFrame, polygon_id: str, res: int, ring: str = "ring", spread_at: Sequence[int] = (3, 6, 9),
    dateline: bool = False,
) -> DataFrame:
    """Cells whose centre lies inside each polygon.

    Starts from the base cells and opens only cells whose centre is near enough to
    the polygon's box for a descendant to be inside, one level at a time. A cell all of whose descendants must lie inside, since
    no edge comes near it, is not opened: its descendants are listed at the end. The last level takes the exact test, so
    geometry runs along outlines only, and centres are found once per distinct cell, whatever number of polygons hold it.
    The open cells are written at each level, and spread over the tasks again at
    the ``spread_at`` levels, so a huge polygon does not stay in one. Rings are
    planar in lon/lat; holes and further parts count. With ``dateline`` edges of more than 180 degrees go over the
    antimeridian, and a ring around the earth holds its pole.
    """
    require_lonlat((polygons, ring))
    polygons = polygons.select(polygon_id, rings_of(polygons, ring).alias(ring))
    if dateline:
        part = F.concat_ws(":", F.col(polygon_id).cast("string"), F.monotonically_increasing_id().cast("string"))
        parts = small_side(across_dateline(polygons, ring).withColumn("_part", part))
        covered = polygons_to_cells(parts.select("_part", ring), "_part", res, ring, spread_at)
        return covered.join(parts.select("_part", polygon_id), "_part").select(polygon_id, column_name(res), "h0")
    boxes = polygons.select(polygon_id, bounds(F.flatten(ring)).alias("_box"))
    shapes = boxes.join(small_side(polygons.select(polygon_id, F.col(ring).alias("_rings"))), polygon_id)
    # Rows of one id are tested each in its own box.
    shapes = materialize(shapes.withColumn("_p", F.monotonically_increasing_id()), "shapes")
    start = F.filter(base_cell_centers(), lambda c: _near_box(c, F.col("_box"), _reach(0) if res else 0.0))
    level = shapes.select(polygon_id, "_p", F.explode(F.transform(start, lambda c: c["h0"])).alias("_h"))
    if not res:
        found = _tested(level.withColumn("_c", cell_center("_h")), shapes, 0, 0)
        return found.select(polygon_id, F.col("_h").alias(column_name(0)), F.col("_h").alias("h0"))
    out = None
    for r in range(1, res + 1):
        level = materialize(level, "open")
        kids = level.select("_h").distinct().withColumn("_k", F.explode(direct_children(F.col("_h"))))
        kid = F.struct(F.col("_k").alias("h"), cell_center("_k").alias("c"))
        kids = small_side(kids.select("_h", kid.alias("_kid")).groupBy("_h").agg(F.collect_list("_kid").alias("_kids")))
        opened = level.join(kids, "_h").select(polygon_id, "_p", F.explode("_kids").alias("_kid"))
        level = _tested(opened.select(polygon_id, "_p", F.col("_kid.h").alias("_h"), F.col("_kid.c").alias("_c")), shapes, r, res)
        if r in spread_at and r < res:
            level = level.repartition(shuffle_width(level.sparkSession), polygon_id, "_h")
        if r < res:
            level = materialize(level, "level")
            whole = level.where("_whole").select(polygon_id, "_h")
            for _ in range(r, res):
                whole = whole.select(polygon_id, F.explode(direct_children(F.col("_h"))).alias("_h"))
            out = whole if out is None else out.unionByName(whole)
            level = level.where("not _whole").select(polygon_id, "_p", "_h")
    last = level.select(polygon_id, "_h")
    out = last if out is None else out.unionByName(last)
    return out.select(polygon_id, F.col("_h").alias(column_name(res)), cell_parent("_h", 0).alias("h0"))


def _tested(level: DataFrame, shapes: DataFrame, r: int, res: int) -> DataFrame:
    """Rows of ``level`` (_p, _h, _c) that can hold a cell of ``res`` inside their shape, and whether all of theirs are inside.

    At the last level, rows whose centre is inside.
    """
    met = level.join(shapes.select("_p", "_box", "_rings"), "_p").where(_near_box(F.col("_c"), F.col("_box"), _reach(r) if r < res else 0.0))
    inside = point_in_rings("_rings", F.col("_c.lng"), F.col("_c.lat"))
    rows = met.drop("_box", "_rings", "_c")
    if r == res:
        return met.where(inside).select(*rows.columns)
    whole = _clear(F.col("_c"), F.col("_box"), F.col("_rings"), _reach(r)) & inside
    return met.select(*rows.columns, F.coalesce(whole, F.lit(False)).alias("_whole"))


def _clear(c: Column, box: Column, rings: Column, reach: float) -> Column:
    """Is all within ``reach`` degrees of a centre, measured along the sphere, in the box and off the edges of closed rings."""
    polar = F.abs(c["lat"]) + reach
    wide = F.when(polar < 89.0, F.lit(reach) / F.cos(F.radians(polar)))
    within = (
        (c["lat"] - reach > box["south"]) & (c["lat"] + reach < box["north"])
        & (c["lng"] - wide > F.greatest(box["west"], F.lit(-180.0))) & (c["lng"] + wide < F.least(box["east"], F.lit(180.0)))
    )

    def touches(a: Column, b: Column) -> Column:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        near = (
            (F.least(a["x"], b["x"]) <= c["lng"] + wide) & (F.greatest(a["x"], b["x"]) >= c["lng"] - wide)
            & (F.least(a["y"], b["y"]) <= c["lat"] + reach) & (F.greatest(a["y"], b["y"]) >= c["lat"] - reach)
        )
        apart = F.abs(dx * (c["lat"] - a["y"]) - dy * (c["lng"] - a["x"])) > (wide * F.abs(dy) + reach * F.abs(dx)) * (1 + 1e-9)
        return F.coalesce(near & ~apart, F.lit(True))

    closed = F.forall(rings, lambda ring: (F.size(ring) > 0) & (F.element_at(ring, 1) == F.element_at(ring, -1)))
    free = F.forall(rings, lambda ring: ~F.exists(over_segments(ring, touches), lambda hit: hit))
    return within & closed & free


def _reach(res: int) -> float:
    """Degrees within which a cell's descendants have their centres: about 1.1 edges, and cells stretch by 1.3."""
    return 1.6 * tm.EDGE_KM[res] / tm.KM_PER_DEGREE


def _near_box(c: Column, box: Column, reach: float) -> Column:
    """Centre within ``reach`` degrees of a box, measured along the sphere."""
    lat_ok = c["lat"].between(box["south"] - reach, box["north"] + reach)
    polar = F.least(F.lit(90.0), F.greatest(F.abs(c["lat"]), F.abs(box["south"]), F.abs(box["north"])) + reach)
    spread = F.when(polar >= 89.0, F.lit(360.0)).otherwise(F.lit(reach) / F.cos(F.radians(polar)))

    def within(shift: float) -> Column:
        return (c["lng"] + shift).between(box["west"] - spread, box["east"] + spread)

    return lat_ok & (within(0.0) | within(360.0) | within(-360.0))


def tile_base_cells(spark: SparkSession, z: int, x: int, y: int, res: int) -> list[int]:
    """Base cells with a cell in the tile's padded box: the cover of that box, on any zoom."""
    box = tm.tile_bounds(F.lit(z), F.lit(x), F.lit(y))
    dy = tm.pad_lat(F.lit(res))
    dx = tm.pad_lng(F.lit(res), F.greatest(F.abs(box["north"]), F.abs(box["south"])))
    padded = F.struct(
        (box["west"] - dx).alias("west"), (box["south"] - dy).alias("south"),
        (box["east"] + dx).alias("east"), (box["north"] + dy).alias("north"),
    )
    return base_cells_of_boxes(spark.range(1).select(padded.alias("b")), "b")


def _nodes(points: DataFrame, levels: Sequence[int]) -> DataFrame:
    """Occupied cells of all levels (res, h, c, reach): their centre, and a bound on how far their points are from it.

    The bound of the last level is measured, on the points themselves; those above take it from the cells of the last level, as the
    distance of the two centres plus the lower bound. Centres are computed once per distinct cell.
    """
    last = points.select("_lat", "_lng", cell_parent("_cell", levels[-1]).alias("_h"))
    centers = last.select("_h").distinct().withColumn("_c", cell_center("_h"))
    far = F.max(great_circle("_c.lat", "_c.lng", "_lat", "_lng"))
    low = last.join(centers, "_h").groupBy("_h", "_c").agg(far.alias("_far"))
    above = F.array(*[F.struct(F.lit(r).alias("res"), cell_parent("_h", r).alias("h")) for r in levels])
    up = low.select("_c", "_far", F.explode(above).alias("_up")).select("_c", "_far", "_up.*")
    own = up.select("h").distinct().withColumn("c", cell_center("h"))
    reach = F.max(F.col("_far") + great_circle("_c.lat", "_c.lng", "c.lat", "c.lng"))
    return materialize(up.join(own, "h").groupBy("res", "h", "c").agg(reach.alias("reach")), "cells")


def _level(nodes: DataFrame, res: int, side: str) -> DataFrame:
    return nodes.where(F.col("res") == res).select(*[F.col(c).alias(f"{side}_{c}") for c in ("h", "c", "reach")])


def _finest_needed(points: DataFrame, levels: Sequence[int], few: int = 64) -> list[int]:
    """The levels down to the first whose fullest cell holds few points."""
    cells = F.array(*[F.struct(F.lit(r).alias("res"), cell_parent("_cell", r).alias("h")) for r in levels])
    counts = points.select(F.explode(cells).alias("p")).groupBy("p.res", "p.h").count()
    fullest = {r["res"]: r["n"] for r in counts.groupBy("res").agg(F.max("count").alias("n")).collect()}
    for i, res in enumerate(levels):
        if fullest.get(res, 0) <= few:
            return list(levels[: i + 1])
    return list(levels)


def _point(center: dict) -> Column:
    return F.struct(F.lit(center["lat"]).alias("lat"), F.lit(center["lng"]).alias("lng"))


def _closest(pairs: DataFrame, key: Sequence[str], d: Column, slack: Column) -> DataFrame:
    """Pairs of every key that can still hold its nearest point."""
    upper = F.min(F.col("_d") + F.col("_r")).over(Window.partitionBy(*key))
    bounded = pairs.withColumn("_d", d).withColumn("_r", slack).withColumn("_upper", upper)
    return bounded.where(F.col("_d") - F.col("_r") <= F.col("_upper") + _SLACK_KM)


def _lists(df: DataFrame, key: str, by: str, item: Column, out: str, at_once: int = 256) -> DataFrame:
    """The items of every key as lists (``out``) of some ``at_once`` each, dealt by the hash of ``by``."""
    parts = F.ceil(F.count(F.lit(1)).over(Window.partitionBy(key)) / F.lit(at_once))
    dealt = df.select(key, F.pmod(F.xxhash64(by), parts).alias("_part"), item.alias("_item"))
    return dealt.groupBy(key, "_part").agg(F.collect_list("_item").alias(out)).drop("_part")


def _near_enough(lat: str, lng: str, others: Column) -> Column:
    """Cells of a row's list that can still hold the point nearest to a place, found within the row."""
    def gap(o: Column) -> Column:
        return F.struct(o["b_h"].alias("b_h"), great_circle(lat, lng, o["lat"], o["lng"]).alias("d"), o["r"].alias("r"))

    def bounded(gaps: Column) -> Column:
        upper = F.array_min(F.transform(gaps, lambda g: g["d"] + g["r"]))
        return F.struct(gaps.alias("gaps"), upper.alias("upper"))

    def kept(b: Column) -> Column:
        return F.transform(F.filter(b["gaps"], lambda g: g["d"] - g["r"] <= b["upper"] + _SLACK_KM), lambda g: g["b_h"])

    # Lambda variables are computed once per row.
    return F.transform(F.transform(F.array(F.transform(others, gap)), bounded), kept)[0]


def nearest(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, lat: str = "lat", lng: str = "lng",
    levels: Sequence[int] = (0, 2, 4, 6, 8, 10, 12),
) -> DataFrame:
    """The nearest right point of every left point, with its distance in km.

    Both sides are described by their occupied cells. Two cells' points are between
    ``d - r`` and ``d + r`` apart, ``d`` being the distance of the centres and ``r``
    the sum of the cells' reaches, bounds that are rolled up from the finest cells. Going down level
    by level, a left cell keeps only the right cells whose lower bound does not
    exceed its smallest upper bound, so whole regions are settled at once. A left point meets its cell's candidates as lists, and
    the cells that remain bring in their points as lists too, so no pair of points is shuffled or sorted. Equal positions are
    searched once; the smallest id wins a tie. A left row without coordinates, and every row if the right side has none,
    gets NULL. ``levels`` starts at 0.
    """
    left = left.select(F.col(left_id), F.col(lat).alias("_lat"), F.col(lng).alias("_lng"))
    right = right.select(F.col(right_id), F.col(lat).alias("_lat"), F.col(lng).alias("_lng")).dropna()
    right = right.groupBy("_lat", "_lng").agg(F.min(right_id).alias(right_id))
    right = materialize(right.withColumn("_cell", latlng_to_cell("_lat", "_lng", levels[-1])))
    spots = left.select("_lat", "_lng").dropna().distinct()
    spots = materialize(spots.withColumn("_cell", latlng_to_cell("_lat", "_lng", levels[-1])))
    levels = _finest_needed(right, levels)
    ours, theirs = _nodes(spots, levels), _nodes(right, levels)

    # the base cells of the right side, 122 at most, as a literal array
    top = [r.asDict(True) for r in _level(theirs, 0, "b").collect()]
    if not top:
        nobody = F.lit(None).cast(right.schema[right_id].dataType)
        return left.select(left_id, nobody.alias(right_id), F.lit(None).cast("double").alias("distance_km"))
    others = F.array(*[
        F.struct(F.lit(r["b_h"]).alias("b_h"), _point(r["b_c"]).alias("b_c"), F.lit(r["b_reach"]).alias("b_reach"))
        for r in top
    ])
    between = great_circle("a_c.lat", "a_c.lng", "b_c.lat", "b_c.lng")
    both = F.col("a_reach") + F.col("b_reach")
    pairs = _level(ours, 0, "a").withColumn("_o", F.explode(others)).select("*", "_o.*")
    pairs = _closest(pairs, ["a_h"], between, both)
    for up, res in zip(levels, levels[1:]):
        pairs = pairs.select(F.col("a_h").alias("a_up"), F.col("b_h").alias("b_up"))
        a = _level(ours, res, "a").withColumn("a_up", cell_parent("a_h", up))
        b = _level(theirs, res, "b").withColumn("b_up", cell_parent("b_h", up))
        pairs = _closest(pairs.join(a, "a_up").join(b, "b_up"), ["a_h"], between, both)

    last = levels[-1]
    other = F.struct("b_h", F.col("b_c.lat").alias("lat"), F.col("b_c.lng").alias("lng"), F.col("b_reach").alias("r"))
    others = _lists(pairs, "a_h", "b_h", other, "_others")
    here = spots.select("_lat", "_lng", cell_parent("_cell", last).alias("a_h")).join(others, "a_h")
    here = here.select("_lat", "_lng", F.explode(_near_enough("_lat", "_lng", F.col("_others"))).alias("b_h"))
    place = F.struct(F.col("_lat").alias("lat"), F.col("_lng").alias("lng"), F.col(right_id).alias("id"))
    there = _lists(right.withColumn("b_h", cell_parent("_cell", last)), "b_h", "_cell", place, "_places")

    def measured(p: Column) -> Column:
        return F.struct(great_circle("_lat", "_lng", p["lat"], p["lng"]).alias("_km"), p["id"].alias(right_id))

    closest = F.array_min(F.transform("_places", measured))
    best = here.join(there, "b_h").select("_lat", "_lng", closest.alias("_c")).groupBy("_lat", "_lng").agg(F.min("_c").alias("_b"))
    found = best.select("_lat", "_lng", F.col(f"_b.{right_id}").alias(right_id), F.col("_b._km").alias("distance_km"))
    return left.join(found, ["_lat", "_lng"], "left").select(left_id, right_id, "distance_km")


# Covers rounding in the distance bounds.
_SLACK_KM = 1e-6
