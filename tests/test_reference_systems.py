"""Tags of reference systems, geodesics, lookups of many keys, and links from a root."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from hexweave.functions import crs
from hexweave.functions.geometry import geodesic_m
from hexweave.operators import lines as ln
from hexweave.operators import places as pl
from hexweave.sources import catalog as c

BOX = [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]]


def test_tags_travel_and_are_checked(spark):
    polygons = spark.createDataFrame([(1, BOX)], "id int, ring array<array<struct<x double, y double>>>")
    points = spark.createDataFrame([(1.0, 1.0)], "x double, y double")
    tagged = crs.set_crs(polygons, "ring", "ogc:crs84")
    assert crs.crs_of(tagged.where("id = 1").select("ring", "id"), "ring") == "OGC:CRS84"
    assert crs.crs_of(tagged.join(points), "ring") == "OGC:CRS84"
    assert ln.points_in_polygons(points, tagged, "id").count() == 1  # untagged passes
    other = crs.set_crs(points, "x", "EPSG:4326")
    with pytest.raises(ValueError, match="different"):
        ln.points_in_polygons(other, tagged, "id")
    assert ln.points_in_polygons(crs.set_crs(other, "x", "OGC:CRS84"), tagged, "id").count() == 1
    assert ln.points_in_polygons(crs.set_crs(other, "x", None), tagged, "id").count() == 1
    flat = crs.to_mercator(tagged, "ring")
    assert crs.crs_of(flat, "ring") == "EPSG:3857" and abs(flat.first().ring[0][1].x - 222638.98) < 0.01
    with pytest.raises(ValueError, match="different"):
        ln.zonal_stats(crs.set_crs(points.withColumn("band_1", F.lit(1.0)), "y", "OGC:CRS84"), flat, "id")
    for df in (flat,):
        with pytest.raises(ValueError, match="lon/lat"):
            pl.polygons_to_cells(df, "id", 2)
        with pytest.raises(ValueError, match="lon/lat"):
            crs.to_mercator(df, "ring")


# A fifth of a degree along the parallel of 10 degrees, which a geodesic leaves by under a millimetre.
PARALLEL = math.radians(0.2) * 6378137 * math.cos(math.radians(10)) / math.sqrt(1 - (2 - 1 / 298.257223563) / 298.257223563 * math.sin(math.radians(10)) ** 2)
# Published geodesics of WGS84: latitude and longitude of both ends, metres.
PUBLISHED = [
    (40.6, -73.8, 51.6, -0.5, 5551759.400), (-41.32, 174.81, 40.96, -5.50, 19959679.267),
    (-37.95103341666667, 144.42486788888889, -37.65282113888889, 143.92649552777777, 54972.271),
    (0.0, 0.0, 0.5, 179.5, 19936288.579), (0.0, 0.0, 0.0, 180.0, 20003931.459), (90.0, 0.0, -90.0, 0.0, 20003931.459),
    (0.0, 0.0, 0.0, 1.0, 111319.491), (0.0, 0.0, 1.0, 0.0, 110574.389), (10.0, 179.9, 10.0, -179.9, PARALLEL),
    (5.0, 5.0, 5.0, 5.0, 0.0),
]


def test_published_geodesics(spark):
    df = spark.createDataFrame(PUBLISHED + [(None, 0.0, 1.0, 1.0, None)], "a double, b double, c double, d double, m double")
    for r in df.withColumn("got", geodesic_m("a", "b", "c", "d")).withColumn("back", geodesic_m("c", "d", "a", "b")).collect():
        if r.m is None:
            assert r.got is None
        else:
            assert abs(r.got - r.m) < 0.9 and abs(r.back - r.got) < 0.01, r


def test_many_keys_at_once(spark):
    rng = random.Random(6)
    ids = ["", "A", "ab", "Abc", "abcd", "xabcdx", "ABCDE", "ünï", "%_", "aaaaaa"] + ["".join(rng.choice("abAB-") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    keys = ids[::3] + ["", "a", "B", "bc", "abc", "BCD", "abcde", "nothing", "aaaa", "ÜN", "%", None, "ab", "ab"]
    table = spark.createDataFrame([(i, i.lower()) for i in ids] + [(None, "none")], "id string, title string")

    def one(key):
        rank = {i: 0 if i == key else 1 if i.lower().startswith(key.lower()) else 2 for i in ids if key.lower() in i.lower()}
        return min(rank, key=lambda i: (rank[i], i), default=None)

    got = {r.key: r.id for r in c.lookup_all(table, spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    assert got == {k: one(k) for k in keys if k is not None and one(k) is not None}


def test_links_from_the_root(spark):
    def doc(name, *children, kind="Collection"):
        return f"https://x.org/{name}.json", json.dumps({"type": kind, "id": name, "links": [{"rel": "child", "href": h} for h in children]})

    docs = [
        doc("root", "a.json", "./b.json", kind="Catalog"), doc("a", "https://x.org/deep/../c.json", "c.json"), doc("b", "gone.json", "d.json"),
        doc("c", "e.json"), doc("d"), doc("e", "a.json", "f.json"), doc("f"), doc("lost", "lost2.json"), doc("lost2", "lost.json"),
        ("https://x.org/broken.json", "{"), doc("self", "self.json"),
    ]
    df = spark.createDataFrame(docs, "path string, value string")
    got = {(r.address.split("/")[-1][:-5], r.status, r.depth) for r in c.reachability(df, "https://x.org/root.json").collect()}
    reached = {"root": 0, "a": 1, "b": 1, "c": 2, "d": 2, "e": 3, "f": 4}
    want = {(k, "reached", v) for k, v in reached.items()} | {("gone", "missing", 2)}
    want |= {(k, "orphan", None) for k in ("lost", "lost2", "broken", "self")} | {(k, "cycle", reached[k]) for k in ("a", "c", "e")}
    assert got == want
    alone = c.reachability(df.limit(0), "https://x.org/root.json").collect()
    assert [(r.status, r.depth) for r in alone] == [("missing", 0)]
