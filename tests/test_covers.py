"""Covers of polygons: what lies well inside is listed, not tested."""

import pyarrow as pa
from pyspark.sql import functions as F

from hexweave.functions.geodesy import with_centers
from hexweave.functions.geometry import bounds, point_in_rings
from hexweave.operators import places as pl


def _box(w, s, e, n):
    return [(float(x), float(y)) for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))]


SCHEMA = "id bigint, ring array<array<struct<x:double,y:double>>>"


def _brute(spark, polygons, res):
    """All cells of the sphere against all rings and boxes of an id."""
    cells = spark.range(122).select(pl.base_cell_centers()[F.col("id").cast("int")]["h0"].alias("h"))
    for _ in range(res):
        cells = cells.select(F.explode(pl.direct_children(F.col("h"))).alias("h"))
    every = with_centers(cells.repartition(8), "h")
    b = polygons.select("id", bounds(F.flatten("ring")).alias("b")).join(polygons, "id")
    inside = F.col("lng").between(F.col("b.west"), F.col("b.east")) & F.col("lat").between(F.col("b.south"), F.col("b.north"))
    found = every.join(F.broadcast(b), inside).where(point_in_rings("ring", F.col("lng"), F.col("lat")))
    return sorted((r.id, r.h) for r in found.select("id", "h").collect())


def test_covers_of_odd_shapes(spark):
    """Holes, concave rings, rings that do not close, the edge of the map, a pole, and ids that repeat."""
    open_ring = _box(20, 0, 50, 30)[:-1]
    star = [(-100.0, 0.0), (-70.0, 30.0), (-100.0, 20.0), (-130.0, 30.0), (-100.0, 0.0)]
    rows = [
        (1, [_box(0, -40, 40, 0), _box(10, -30, 30, -10)]), (2, [star]), (3, [open_ring]), (4, [_box(150, -20, 180, 10)]),
        (5, [_box(-180, 60, 180, 90)]), (6, [_box(-60, -50, -20, -20)]), (6, [_box(-60, -50, -20, -20)]),
        (6, [_box(-50, -60, -10, -30)]), (7, None), (None, [_box(0, 0, 9, 9)]),
    ]
    polygons = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.id, r.h3) for r in pl.polygons_to_cells(polygons, "id", 3).collect())
    want = _brute(spark, polygons, 3)
    assert len(want) > 5000 and got == want


def test_centres_are_found_once_per_cell(spark, monkeypatch):
    """Ten equal boxes cost the centres of one; cells well inside cost none."""
    rows, found = spark.sparkContext.accumulator(0), pl.cell_center

    def counted(h):
        @F.arrow_udf("bigint")
        def seen(h: pa.Array) -> pa.Array:
            rows.add(len(h))
            return h

        return found(seen(h))

    monkeypatch.setattr(pl, "cell_center", counted)
    polygons = spark.createDataFrame([(i, [_box(-40, -20, 0, 20)]) for i in range(10)], SCHEMA)
    cells = pl.polygons_to_cells(polygons, "id", 4)
    assert cells.count() > 60_000 > 10 * rows.value
