"""Sides that grow with the tables are not broadcast, however few bytes they are written in."""

from pyspark.sql import functions as F

from hexweave.functions.cells import cell_parent
from hexweave.operators import joins as j
from hexweave.operators import measures as m
from hexweave.plans.inputs import cell
from hexweave.sources import catalog as c


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_presence_share_shuffles(spark):
    land = spark.range(490).select(cell("id", 10).alias("h10")).withColumn("h0", cell_parent("h10", 0))
    land = land.withColumn("h8", cell_parent("h10", 8, 10))
    here = land.where("h10 % 3 = 0").select("h10", "h0")
    feature = land.select("h8", "h0", F.lit("a").alias("kind")).unionByName(land.select("h8", "h0", F.lit("b").alias("kind")).limit(49))
    out = m.presence_share(feature, here, land, 8, 10, by="kind")
    assert "Broadcast" not in plan(out)
    pairs = feature.distinct().join(land, ["h8", "h0"]).join(here.distinct().withColumn("x", F.lit(1.0)), ["h10", "h0"], "left")
    want = {r.kind: r.p for r in pairs.groupBy("kind").agg((100 * F.avg(F.coalesce("x", F.lit(0.0)))).alias("p")).collect()}
    assert {r.kind: round(r.pct, 9) for r in out.collect()} == {k: round(v, 9) for k, v in want.items()}


def test_reachability_shuffles(spark):
    def doc(name, *kids):
        links = ", ".join(f'{{"rel": "child", "href": "{k}.json"}}' for k in kids)
        return f"https://x.org/{name}.json", f'{{"type": "Collection", "id": "{name}", "links": [{links}]}}'

    docs = spark.createDataFrame([doc("root", "a", "b"), doc("a", "b", "gone"), doc("b", "a"), doc("alone")], "path string, value string")
    out = c.reachability(docs, "https://x.org/root.json")
    assert "Broadcast" not in plan(out)
    got = {(r.address.split("/")[-1], r.status, r.depth) for r in out.collect()}
    assert got == {
        ("root.json", "reached", 0), ("a.json", "reached", 1), ("b.json", "reached", 1), ("gone.json", "missing", 2),
        ("alone.json", "orphan", None), ("a.json", "cycle", 1), ("b.json", "cycle", 1),
    }


def test_assigned_features_shuffle(spark):
    features = spark.range(60).select((F.col("id") % 20).alias("fid"), cell("id", 8).alias("h8"))
    regions = spark.range(40).select((F.col("id") % 3).cast("string").alias("region"), cell("id", 8).alias("h8"))
    flat = spark.range(20).select(F.col("id").alias("fid"), (F.col("id") * 1.0).alias("x"))
    out = j.assign_then_sum(features, regions, flat, 8, "fid", "region", "x")
    assert "Broadcast" not in plan(out)
    want = {r: float(sum({i % 20 for i in range(40) if i % 3 == int(r)})) for r in "012"}
    assert {r.region: r.x for r in out.collect()} == want


def test_lookup_of_many_keys_shuffles(spark):
    table = spark.createDataFrame([("group-1", "a"), ("group-12", "b"), (None, "c")], "id string, title string")
    keys = spark.createDataFrame([("GROUP-1",), ("12",), ("group-12",), ("none",), (None,)], "key string")
    out = c.lookup_all(table, keys)
    assert "Broadcast" not in plan(out)
    assert {r.key: r.id for r in out.collect()} == {"GROUP-1": "group-1", "12": "group-12", "group-12": "group-12"}
