"""Nearest points: candidates travel as lists."""

import functools
import math

from hexweave.operators import places as pl


def _points(n, a, b):
    return [(i, (i * a % 1201) / 10 - 60, (i * b % 2999) / 10 - 150) for i in range(n)]


def _km(p, q):
    (a, b), (c, d) = p, q
    s = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.007180918475 * math.asin(math.sqrt(min(1.0, s)))


def test_lists_of_any_length_hold_every_candidate(spark, monkeypatch):
    """Lists of two, so that cells have many: ties, doubles and missing places as before."""
    monkeypatch.setattr(pl, "_lists", functools.partial(pl._lists, at_once=2))
    left = [*_points(150, 37, 53), (150, None, 3.0), (151, 0.5, 0.5), (None, 10.0, 10.0)]
    right = [*_points(300, 91, 17), (300, 0.5, 1.0), (301, 0.5, 0.0), (302, 0.5, 0.0), (303, None, None)]
    schema = "{} bigint, lat double, lng double"
    found = pl.nearest(spark.createDataFrame(left, schema.format("a")), spark.createDataFrame(right, schema.format("b")), "a", "b")
    got = {r.a: (r.b, r.distance_km) for r in found.collect()}
    assert len(got) == len(left) and got[150] == (None, None) and got[151][0] == 300
    for i, lat, lng in left:
        if lat is not None:
            want = min(_km((lat, lng), (y, x)) for _, y, x in right if y is not None)
            assert abs(got[i][1] - want) < 1e-6


def test_no_pair_is_shuffled(spark):
    """Points and the cells near them were exchanged, sorted and spilled for a window by place."""
    schema = "{} bigint, lat double, lng double"
    left, right = spark.createDataFrame(_points(50, 37, 53), schema.format("a")), spark.createDataFrame(_points(300, 91, 17), schema.format("b"))
    plan = pl.nearest(left, right, "a", "b")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert windows and not any("_lat" in line for line in windows)
