import json
import re

import pytest
from pyspark.sql import functions as F

from hexweave.functions.cells import cell_parent
from hexweave.functions.text import geometry_columns, preview, render_columns
from hexweave.operators import filters, joins, lines, measures, pyramid, sizing, tiles
from hexweave.operators.places import area, index_points
from hexweave.plans import inputs
from hexweave.session import fresh_dir
from hexweave.sources import hexio


def plan(df):
    return df._jdf.queryExecution().toString()


def test_clip_refuses_the_storage_key(spark, sf):
    with pytest.raises(ValueError):
        joins.clip_to_mask(inputs.value_hex(spark, sf), inputs.mask_hex(spark, sf), 0)


def test_masks_prune_partitions(spark, sf):
    root = fresh_dir(spark, "prune")
    hexio.write_hex(inputs.value_hex(spark, sf), root)
    stored = hexio.read_hex(spark, root)
    assert dict(stored.dtypes)["h0"] == "bigint"
    mask = inputs.mask_hex(spark, sf).where("STUSPS = 'NATION_3'")
    # all cells of the mask in one base cell: one directory is read
    one = mask.where(F.col("h0") == mask.agg(F.min("h0")).first()[0])
    clipped = joins.clip_to_mask(stored, one, 8).groupBy("h8").count()
    assert re.search(r"PartitionFilters: \[.*\(?h0#\d+L = \d+", plan(clipped))
    named = stored.withColumn("f", F.col("_metadata.file_path"))
    scanned = joins.clip_to_mask(named, one, 8).select("f").distinct().collect()
    assert len({re.search(r"h0=(\d+)", r.f).group(1) for r in scanned}) == 1
    # a plain join on both keys prunes at run time
    joined = stored.join(mask.select("h8", "h0"), ["h8", "h0"], "left_semi")
    assert "dynamicpruning" in plan(joined).lower()


def test_a_mask_too_large_to_broadcast_gives_the_same(spark, sf):
    values, mask = inputs.value_hex(spark, sf), inputs.mask_hex(spark, sf)
    small = sorted(map(tuple, joins.clip_to_mask(values, mask, 8, F.col("region") == "ASIA").collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = joins.clip_to_mask(values, mask, 8, F.col("region") == "ASIA")
        assert "Broadcast" not in plan(large)
        assert sorted(map(tuple, large.collect())) == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_column_pruning_and_pushdown(spark, sf):
    text = plan(inputs.table(spark, sf, "lineitem").where("l_quantity > 10").groupBy("l_returnflag").count())
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity" in text
    assert "l_comment" not in text and "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in text


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 101).alias("k"), F.col("id").alias("v")
    ).unionByName(spark.createDataFrame([(None, 1), (7, 0), (7, 0)], "k bigint, v bigint"))
    right = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    hot = {r.k for r in sizing.hot_keys(left, ["k"], 0.05).collect()}
    assert hot == {7}
    a = sizing.salted_join(left, right, ["k"], how, salts=5, share=0.05)
    b = left.join(right, ["k"], how)
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_small_side_is_broadcast_by_its_bytes(spark):
    big = spark.range(1000)
    assert "BroadcastHashJoin" in plan(big.join(sizing.small_side(spark.range(100)), "id"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        assert "SortMergeJoin" in plan(big.join(sizing.small_side(spark.range(100)), "id"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_salted_join_spreads_equal_rows(spark):
    left = spark.range(10_000).select(F.lit(1).alias("k"), F.lit("x").alias("v")).unionByName(
        spark.range(20).select(F.col("id").cast("int").alias("k"), F.lit("y").alias("v"))
    )
    right = spark.range(5).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("w"))
    for how in ("inner", "left", "left_semi"):
        salted = sizing.salted_join(left, right, ["k"], how, salts=4)
        want = left.join(right, ["k"], how)
        assert salted.columns == want.columns
        assert sorted(map(repr, salted.collect())) == sorted(map(repr, want.collect()))


def test_global_rank_averages_ties(spark):
    values = [5, 1, 3, 3, 3, 9, None, 1, 7, 100]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int")
    got = {r.i: r.rk for r in sizing.global_rank(df, "v", "rk", buckets=4).collect()}
    known = sorted(v for v in values if v is not None)
    for i, v in enumerate(values):
        want = None if v is None else known.index(v) + (known.count(v) + 1) / 2
        assert got[i] == want


def test_null_parent_columns_do_not_drop_rows(spark, sf):
    fine = inputs.value_hex(spark, sf).withColumn("h6", F.lit(None).cast("bigint"))
    filled = joins.with_parent(fine, 8, 6)
    assert filled.where(~F.col("h6").eqNullSafe(cell_parent("h8", 6))).count() == 0


def test_shares_stay_within_bounds(spark, sf):
    share = measures.share_of_region(inputs.mask_hex(spark, sf), inputs.weights_hex(spark, sf), 8, "STUSPS")
    assert share.where("share < 0 OR share > 1").count() == 0
    assert measures.check_shares(inputs.fraction_hex(spark, sf), "frac", 1.0, ["h8", "h0"]).count() == 0


def test_overlay_share_is_the_same_at_two_resolutions(spark):
    # four coarse cells whose children are covered by an exact fraction
    base = spark.range(4).select(F.col("id").alias("k"))
    kids = base.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(48)))).select(
        inputs.cell(F.col("k") * 49 + F.col("j"), 10).alias("h10"), (F.col("j") % 5 / 10.0).alias("w")
    )
    fine = measures.overlay_share(kids.select("h10"), kids, kids.select("h10"), 10, F.col("w"), F.lit(1.0))
    rolled = measures.rollup_fraction(kids, 10, 8, "w", kids.select("h10"))
    cells = rolled.select("h8", "h0")
    coarse = measures.overlay_share(cells, rolled, cells, 8, F.col("w"), F.lit(1.0))
    assert fine.first()[0] == pytest.approx(coarse.first()[0])


def test_area_units(spark):
    points = spark.createDataFrame([(37.8, -122.3), (37.8, -122.3), (40.0, -100.0)], "lat double, lng double")
    cells = index_points(points, 5)
    km2, m2, acres, other = (area(cells, 5, unit=u).first()[0] for u in ("km^2", "m^2", "acres", "furlong"))
    assert 300 < km2 < 700 and m2 == pytest.approx(km2 * 1e6) and acres == pytest.approx(km2 * 247.105)
    assert other != other


def test_coverage_counts_sentinels(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", -9999.0, 1.0), ("b", float("nan"), 5.0), ("b", None, 2.0)], "g string, v double, m double")
    rows = {r.g: r for r in measures.coverage_report(df, "v", "m", "g", [-9999], floating=True).collect()}
    assert rows["a"].row_share == 0.5 and rows["b"].row_share == 0.0
    assert rows["a"].measure_share == pytest.approx(2 / 3) and rows[None].overall == 1 and rows[None].n_valid == 1


def test_pyramid_invariants(spark):
    rows = [(37.8, -122.3, 4.0), (37.80001, -122.30001, 6.0), (38.0, -122.5, 1.0), (40.0, -100.0, 9.0), (-30.0, 140.0, -2.0)]
    df = index_points(spark.createDataFrame(rows, "lat double, lng double, val double"), 5).select("h5", "val")
    for agg in ("COUNT", "SUM", "MIN", "MAX"):
        value = "count" if agg == "COUNT" else "val"
        level = pyramid.finest_level(df, agg, ["val"])
        fold = {"COUNT": F.sum, "SUM": F.sum, "MIN": F.min, "MAX": F.max}[agg]
        whole = level.agg(fold(value)).first()[0]
        for res in (4, 3, 2, 1, 0):
            below, level = level, pyramid.parent_level(level, res, agg, ["val"])
            assert level.agg(fold(value)).first()[0] == pytest.approx(whole)
            assert level.count() <= below.count()


def test_average_is_weighted(spark):
    rows = [(37.0, -122.0, v) for v in (10.0, 20.0, 30.0, 40.0)] + [(37.2, -122.0, 100.0)]
    df = index_points(spark.createDataFrame(rows, "lat double, lng double, val double"), 5).select("h5", "val")
    level = pyramid.parent_level(pyramid.finest_level(df, "avg", ["val"]), 4, "AVG", ["val"])
    row = level.first()
    assert level.count() == 1 and row.val == pytest.approx(40.0) and row[pyramid.WEIGHT] == 5


def test_distinct_rolls_up_as_a_lower_bound(spark):
    kids = [(inputs_cell(spark, 0), 1), (inputs_cell(spark, 0), 2), (inputs_cell(spark, 1), 2), (inputs_cell(spark, 1), 3)]
    df = spark.createDataFrame(kids, "h6 bigint, key int")
    level = pyramid.parent_level(pyramid.finest_level(df, "COUNT_DISTINCT", ["key"]), 5, "COUNT_DISTINCT", ["key"])
    assert level.first().key == 2
    exact = {(r.res): r.n_distinct for r in pyramid.distinct_levels(df, "h6", "key", 5, 5).collect()}
    assert exact[5] == 3


def inputs_cell(spark, k):
    return spark.range(1).select(inputs.cell(F.lit(k), 6)).first()[0]


def test_pyramid_build_and_reuse(spark):
    df = spark.range(200).select(
        inputs.cell(F.when(F.col("id") < 100, 3).otherwise(F.col("id")), 6).alias("h6"), F.lit(1.0).alias("val"),
        F.lit(5).alias("h3"),
    )
    root = fresh_dir(spark, "build")
    built = pyramid.build_pyramid(df, root, "q", "SUM", min_res=3, centers=lambda d, h: d.withColumn("lat", F.lit(1.0)).withColumn("lng", F.lit(2.0)))
    assert built["finest_res"] == 6 and built["value_columns"] == ["val"] and not built["cached"]
    assert built["value_stats"]["val"]["suggested_scale"] == "log" and built["bounds"] == [2.0, 1.0, 2.0, 1.0]
    again = pyramid.build_pyramid(df, root, "q", "SUM", min_res=3)
    assert again["cached"] and again["path"] == built["path"]
    assert pyramid.build_name("q", 6, 3, "sum", 2) == built["name"] != pyramid.build_name("q", 6, 3, "MAX", 2)
    assert pyramid.read_levels(spark, built["path"], 3, 6).groupBy("res").agg(F.sum("val").alias("v")).where("v <> 200").count() == 0
    assert "PartitionFilters: [isnotnull(h0" in plan(pyramid.read_level(spark, built["path"], 6).where("h0 = 576671858535956479"))
    text = spark.read.text(built["path"] + "/manifest").first()[0]
    assert json.loads(text)["feature_count_finest"] == 101


def test_pyramid_rejects_bad_input(spark):
    df = spark.range(3).select(inputs.cell("id", 6).alias("h6"), F.lit(1).alias("h0"))
    for call in (
        lambda: pyramid.build_pyramid(df, "/nowhere", "q", "MEDIAN"),
        lambda: pyramid.build_pyramid(df, "/nowhere", "q", "SUM"),
        lambda: pyramid.build_pyramid(df, "/nowhere", "q", "COUNT", finest=1),
        lambda: pyramid.build_pyramid(df.where("false"), "/nowhere", "q", "COUNT"),
    ):
        with pytest.raises(ValueError):
            call()


def test_cells_on_a_seam_are_in_both_tiles(spark):
    level = spark.createDataFrame([(1, 10.0, 0.01), (2, 10.0, 30.0), (3, 89.9, 10.0), (4, 0.0, 180.0)], "h bigint, lat double, lng double")
    got = {(r.h, r.x, r.y) for r in tiles.build_tiles(level, 4, [4]).collect()}
    assert {x for h, x, _ in got if h == 1} == {7, 8} and {x for h, x, _ in got if h == 2} == {9}
    for x, y in ((7, 7), (8, 7), (9, 7), (15, 7), (15, 8), (0, 0), (8, 0)):
        one = {(r.h, x, y) for r in tiles.tile_cells(level, 4, 4, x, y).collect()}
        assert one == {g for g in got if g[1:] == (x, y)}


def test_render_and_preview(spark):
    df = spark.sql("""
        SELECT 613762179077668863 AS h, CAST(1.7400000000000002 AS DOUBLE) AS d, double('NaN') AS n, CAST(NULL AS DOUBLE) AS e,
               CAST(26471500.25 AS DOUBLE) AS a, CAST(1e-7 AS DOUBLE) AS s, CAST(-0.00012345678912 AS DOUBLE) AS t,
               CAST(123456789012 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS z, CAST(1.50 AS DECIMAL(10,2)) AS x,
               DATE'2026-08-01' AS day, TIMESTAMP_NTZ'2026-08-01 10:11:12.5' AS ts, 3 AS i, X'00' AS geom""")
    assert geometry_columns(df) == ["geom"]
    assert render_columns(df).first().asDict() == {
        "h": "613762179077668863", "d": "1.74", "n": "nan", "e": "", "a": "26471500.25", "s": "1e-07", "t": "-0.0001234567891",
        "w": "1.23456789e+11", "z": "0", "x": "1.50", "day": "2026-08-01", "ts": "2026-08-01 10:11:12", "i": 3,
    }
    assert [preview(spark.range(n)).count() for n in (0, 50, 51)] == [0, 50, 50]
    assert [preview(spark.range(n)).first().truncated for n in (50, 51)] == [False, True]


def test_value_columns_leave_keys_out(spark, sf):
    assert filters.value_columns(inputs.value_hex(spark, sf)) == ["carbon", "lc_class", "species"]
    assert filters.hex_columns(inputs.land_grid(spark, sf)) == ["h10", "h9", "h8", "h0"]


def test_csv_and_profile(spark, sf):
    path = fresh_dir(spark, "csv")
    hexio.export_csv(spark.range(5), path)
    assert spark.read.option("header", True).csv(path).count() == 5
    row = hexio.dataset_profile(spark.read.parquet(f"{sf}/lineitem.parquet")).first()
    assert row.n_files == 1 and row.n_bytes > 0


def test_points_meet_polygons_of_every_size(spark):
    def box(w, s, e, n):
        return [(w, s), (e, s), (e, n), (w, n), (w, s)]

    shapes = [(1, box(-180.0, -90.0, 180.0, 90.0)), (2, box(0.0, 0.0, 10.0, 10.0)), (3, box(9.999, 9.999, 10.001, 10.001)), (4, box(-0.5, -0.5, 0.5, 0.5))]
    polygons = spark.createDataFrame(shapes, "id int, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 10.0, 9.9995, 4.0), (2, 0.2, 0.2, 8.0), (3, -50.0, 3.0, 1.0)], "pid int, x double, y double, band_1 double")
    got = {(r.pid, r.id) for r in lines.points_in_polygons(points, polygons, "id").collect()}
    assert got == {(1, 1), (1, 3), (2, 1), (2, 2), (2, 4), (3, 1)}
    stats = {r.id: (r.n_pixels, r.mean_value) for r in lines.zonal_stats(points, polygons.where("id > 1"), "id").collect()}
    assert stats == {2: (1, 8.0), 3: (1, 4.0), 4: (1, 8.0), None: (1, 1.0)}
    nothing = lines.zonal_stats(points, polygons.where("id > 9"), "id").collect()
    assert [(r.id, r.n_pixels) for r in nothing] == [(None, 3)]


def test_hot_cell_measures(spark):
    """A third of the rows in one cell: every measure still counts all of them."""
    rows = spark.range(30000).select(
        inputs.cell(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 700), 8).alias("h8"),
        (F.col("id") % 4).alias("kind"), F.lit(1.0).alias("v"), F.col("id").alias("fid"),
    )
    mask = rows.select("h8").distinct().withColumn("name", F.lit("all"))
    kept = joins.clip_to_mask(rows, mask, 8)
    assert kept.count() == 30000
    assert measures.aggregate_cells(kept, 8, F.sum("v").alias("v")).agg(F.sum("v"), F.max("v")).first()[0:2] == (30000.0, 10029.0)
    assert measures.dominant_class(rows, 8, "kind").agg(F.max("n_rows")).first()[0] >= 2500
    pairs = joins.assign_features(rows, mask, 8, "fid", "name")
    assert pairs.count() == 30000
    salted = joins.hex_join(rows, mask, 8, salts=8)
    assert salted.count() == 30000


def test_means_weigh_values_not_rows(spark):
    """Two children of one parent, one with NULL values: the parent's mean is that of the values."""
    from hexweave.functions.cells import direct_children, res0_cell

    two = F.slice(direct_children(res0_cell(F.lit(20))), 1, 2)
    cells = spark.range(1).select(F.explode(two).alias("h"))
    rows = cells.crossJoin(spark.createDataFrame([(10.0,), (10.0,), (None,)], "val double"))
    level = pyramid.parent_level(pyramid.finest_level(rows, "AVG", ["val"], "h"), 0, "AVG", ["val"])
    row = level.first()
    assert row.val == 10.0 and row[pyramid.WEIGHT] == 6 and row[pyramid.own_weight("val")] == 4


def test_mixed_resolutions_are_refused(spark):
    from hexweave.functions.cells import direct_children, res0_cell

    mixed = spark.range(2).select(res0_cell("id").alias("h"))
    mixed = mixed.unionByName(mixed.select(F.explode(direct_children(F.col("h"))).alias("h")))
    with pytest.raises(ValueError, match="resolutions 0 to 1"):
        pyramid.detect_resolution(mixed, "h")


def test_text_partitions(spark):
    root = fresh_dir(spark, "text")
    df = spark.createDataFrame([("8029fffffffffff", 1), ("802bfffffffffff", 2)], "h0 string, v int")
    df.write.partitionBy("h0").parquet(root)
    got = hexio.read_hex(spark, root)
    assert dict(got.dtypes)["h0"] == "bigint"
    assert got.where(F.col("h0") == int("802bfffffffffff", 16)).select("v").collect() == [(2,)]


def test_spheroid_length(spark):
    from hexweave.functions.geometry import spheroid_distance_m

    # geodesics published for the WGS84 ellipsoid: a degree of the equator, a quarter meridian, London to Paris
    cases = [(0.0, 0.0, 0.0, 1.0, 111319.491, 0.01), (0.0, 0.0, 90.0, 0.0, 10001965.729, 60.0), (5.0, 5.0, 5.0, 5.0, 0.0, 1e-9)]
    for a, b, c_, d, want, off in cases:
        got = spark.range(1).select(spheroid_distance_m(F.lit(a), F.lit(b), F.lit(c_), F.lit(d))).first()[0]
        assert abs(got - want) < off


def test_a_double_is_formatted_once(spark):
    from hexweave.functions.text import render_columns

    df = spark.range(3).select((F.col("id") * 1.5).alias("a.b"), (F.col("id") / 7e9).alias("c"))
    out = render_columns(df)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("format_string") == 2
    assert [tuple(r) for r in out.orderBy("c").collect()] == [("0", "0"), ("1.5", "1.428571429e-10"), ("3", "2.857142857e-10")]
