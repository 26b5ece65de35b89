"""Co-located and clustered tables: results, plans, rows that scans read."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from hexweave.functions.cells import cell_parent
from hexweave.plans import inputs as t
from hexweave.session import fresh_dir
from hexweave.sources import layout as lo


@pytest.fixture
def plain(spark):
    """No broadcasts and no adaptive plans, so that every exchange shows."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_read(df):
    """What the scans put out, once the query has run."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    leaves = execution.executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


def test_no_exchange_between_colocated_tables(plain, sf):
    folder = fresh_dir(plain, "colocated")
    layers = [lo.save_colocated(make(plain, sf), f"{folder}/{make.__name__}", 8, 4) for make in (t.mask_hex, t.land_hex, t.weights_hex)]
    values = lo.save_colocated(t.value_hex(plain, sf), f"{folder}/value", 8, 4).groupBy("h8").agg(F.sum("carbon").alias("carbon"))
    joined = lo.colocated_join([*layers, values], 8)
    assert "Exchange" not in plan_of(joined)
    want = t.mask_hex(plain, sf).join(t.land_hex(plain, sf).drop("h0"), "h8").join(t.weights_hex(plain, sf).drop("h0"), "h8")
    want = want.join(t.value_hex(plain, sf).groupBy("h8").agg(F.sum("carbon").alias("carbon")), "h8")
    assert joined.columns == want.columns
    key = lambda r: str(r)
    assert sorted(joined.drop("carbon").collect(), key=key) == sorted(want.drop("carbon").collect(), key=key)


def test_another_session_opens_the_layout(plain, sf):
    path = f"{fresh_dir(plain, 'colocated')}/land"
    saved = lo.save_colocated(t.land_hex(plain, sf), path, 8, 4)
    n = saved.count()
    plain.sql(f"DROP TABLE {lo._table(path)}")
    opened = lo.open_colocated(plain, path)
    assert opened.count() == n and opened.schema.simpleString() == saved.schema.simpleString()
    assert "Exchange" not in plan_of(opened.join(opened.drop("h0").withColumnRenamed("land_area_km2", "x"), "h8"))


def test_keys_prune_row_groups(plain):
    root = fresh_dir(plain, "clustered")
    rows = plain.range(200_000).select(
        F.xxhash64("id").alias("key"), F.concat(F.lit("name "), F.xxhash64("id", F.lit(1))).alias("name"), F.col("id").alias("value")
    )
    lo.write_clustered(rows, root, "key", bloom=["name"], files=4, group_bytes=1 << 16)
    layer = plain.read.parquet(root)
    one = layer.where(F.col("value") == 1234).first()
    by_key = layer.where(F.col("key") == one["key"])
    by_name = layer.where(F.col("name") == one["name"])
    assert [r["value"] for r in by_key.collect()] == [r["value"] for r in by_name.collect()] == [1234]
    assert rows_read(layer.where(F.col("value") == 1234)) > 100_000  # neither sorted nor with a filter
    assert rows_read(by_key) < 20_000 and rows_read(by_name) < 40_000


def test_cells_of_a_parent_are_a_range(plain, sf):
    values = t.value_hex(plain, sf)
    root = fresh_dir(plain, "clustered")
    lo.write_clustered(values, root, "h8", files=4, group_bytes=1 << 14)
    layer = plain.read.parquet(root)
    for res in (2, 4, 6, 8):
        parents = values.select(cell_parent("h8", res, 8).alias("p")).distinct().orderBy("p").limit(3).collect()
        for (p,) in parents:
            found = layer.where(lo.within_cell(8, p))
            assert found.count() == values.where(cell_parent("h8", res, 8) == p).count() > 0
    with pytest.raises(ValueError):
        lo.cell_range(parents[0][0], 7)


def test_hot_key_and_odd_tables(plain):
    """One key with most rows, NULL keys, an empty table."""
    root = fresh_dir(plain, "clustered")
    df = plain.range(5000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 7 != 0, F.col("id")).alias("h8"), "id")
    lo.write_clustered(df, root, "h8", files=8)
    assert plain.read.parquet(root).groupBy("h8").count().where("h8 = 7").first()["count"] == df.where("h8 = 7").count()
    saved = lo.save_colocated(df, f"{root}-b", 8, 4)
    assert saved.where("h8 is null").count() == df.where("h8 is null").count()
    assert lo.save_colocated(df.limit(0), f"{root}-e", 8, 4).count() == 0


def test_queries(spark, sf):
    queries = entry_point.queries()
    for a, b in (("hex_join3_colocated", "hex_join3"), ("text_exact_clustered", "text_exact")):
        assert sorted(queries[a](spark, sf).collect()) == sorted(queries[b](spark, sf).collect())
