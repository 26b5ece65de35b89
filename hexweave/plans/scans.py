"""Queries for scans, sinks and text output."""

from pyspark.sql import functions as F

from hexweave.functions.cells import cell_parent
from hexweave.functions.text import preview, render_columns
from hexweave.operators.filters import guard_pixels, slice_cube
from hexweave.operators.pyramid import build_pyramid, finest_level, read_level, read_levels, write_level
from hexweave.plans import inputs as t
from hexweave.plans.inputs import parent_sql
from hexweave.plans.registry import query
from hexweave.session import fresh_dir
from hexweave.sources import hexio
from hexweave.sources.hexio import read_hex
from hexweave.sources.layout import within_cell, write_clustered


@query("scan_file", sql="SELECT s_nationkey, COUNT(*) AS n, MIN(s_name) AS first_name FROM supplier GROUP BY 1")
def scan_file(spark, sf):
    df = spark.read.parquet(f"{sf}/supplier.parquet")
    return df.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.min("s_name").alias("first_name"))


@query("scan_hex", "value_hex", """
    SELECT h0, COUNT(*) AS n, COUNT(DISTINCT h8) AS cells, ROUND(SUM(carbon), 2) AS carbon FROM value_hex GROUP BY h0""")
def scan_hex(spark, sf):
    root = fresh_dir(spark, "hex")
    hexio.write_hex(t.value_hex(spark, sf), root)
    df = hexio.read_hex(spark, root, "h0=*")
    return df.groupBy("h0").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("h8").alias("cells"), F.round(F.sum("carbon"), 2).alias("carbon")
    )


@query("scan_level", "value_hex", "SELECT h8 AS h, h0, COUNT(*) AS count FROM value_hex GROUP BY 1, 2")
def scan_level(spark, sf):
    root = fresh_dir(spark, "level")
    write_level(finest_level(t.value_hex(spark, sf), "COUNT", h="h8"), root, 8, True)
    return read_level(spark, root, 8).select("h", "h0", "count")


@query("scan_view", sql="SELECT l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY 1")
def scan_view(spark, sf):
    hexio.register_view(spark, "hexweave_lineitem", f"{sf}/lineitem.parquet")
    return spark.sql("SELECT l_returnflag, COUNT(*) AS n FROM hexweave_lineitem GROUP BY 1")


def _levels_sql(columns: str, group: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {r} AS res, {parent_sql('h8', r)} AS h, h0, {columns} FROM value_hex GROUP BY 1, 2, 3"
        for r in range(5, 9)
    )


@query("pyramid_write", "value_hex", _levels_sql("COUNT(*) AS count"))
def pyramid_write(spark, sf):
    df = t.value_hex(spark, sf).select("h8")
    built = build_pyramid(df, fresh_dir(spark, "pyramid"), "value_hex", "COUNT", min_res=5)
    return read_levels(spark, built["path"], 5, 8).select("res", "h", "h0", "count")


@query("manifest", "value_hex", """
    SELECT 8 AS finest_res, 5 AS min_res, 'SUM' AS agg, COUNT(*) AS feature_count_finest,
           ROUND(MAX(c), 2) AS finest_max FROM (SELECT h8, SUM(carbon) AS c FROM value_hex GROUP BY 1)""")
def manifest(spark, sf):
    df = t.value_hex(spark, sf).select("h8", "carbon")
    built = build_pyramid(df, fresh_dir(spark, "pyramid"), "value_hex", "SUM", min_res=5)
    return spark.read.json(f"{built['path']}/manifest").select(
        F.col("finest_res").cast("int").alias("finest_res"), F.col("min_res").cast("int").alias("min_res"), "agg",
        "feature_count_finest", F.round(F.col("value_stats.carbon.by_res.`8`.max"), 2).alias("finest_max"),
    )


@query("pyramid_build_once", "value_hex", "SELECT TRUE AS cached, TRUE AS same_place, COUNT(DISTINCT h8) AS cells FROM value_hex")
def pyramid_build_once(spark, sf):
    df = t.value_hex(spark, sf).select("h8")
    root = fresh_dir(spark, "pyramid")
    first = build_pyramid(df, root, "value_hex", "COUNT", min_res=7, centers=_no_centers)
    again = build_pyramid(df, root, "value_hex", "COUNT", min_res=7, centers=_no_centers)
    level = read_level(spark, again["path"], 8)
    return level.agg(F.count(F.lit(1)).alias("cells")).select(
        F.lit(again["cached"]).alias("cached"), F.lit(first["path"] == again["path"]).alias("same_place"), "cells"
    )


def _no_centers(df, h):
    return df.withColumn("lat", F.lit(0.0)).withColumn("lng", F.lit(0.0))


@query("export_csv", "value_hex", "SELECT h8, COUNT(*) AS n, ROUND(SUM(carbon), 2) AS carbon FROM value_hex GROUP BY h8")
def export_csv(spark, sf):
    path = fresh_dir(spark, "csv")
    out = t.value_hex(spark, sf).groupBy("h8").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("carbon"), 2).alias("carbon")
    )
    hexio.export_csv(out, path)
    return spark.read.option("header", True).schema("h8 bigint, n bigint, carbon double").csv(path)


@query("describe", "value_hex", """
    SELECT 0 AS position, 'h8' AS column_name, 'bigint' AS column_type, COUNT(h8) AS n_valid FROM value_hex
    UNION ALL SELECT 1, 'carbon', 'double', COUNT(carbon) FROM value_hex
    UNION ALL SELECT 2, 'lc_class', 'int', COUNT(lc_class) FROM value_hex
    UNION ALL SELECT 3, 'species', 'bigint', COUNT(species) FROM value_hex
    UNION ALL SELECT 4, 'h0', 'bigint', COUNT(h0) FROM value_hex""")
def describe(spark, sf):
    df = t.value_hex(spark, sf)
    counts = df.select(*[F.count(c).alias(c) for c in df.columns]).unpivot(
        [], df.columns, "column_name", "n_valid"
    )
    return F.broadcast(hexio.describe(df)).join(counts, "column_name")


@query("dataset_profile", sql="SELECT COUNT(*) AS n_rows, TRUE AS has_files, TRUE AS has_bytes FROM lineitem")
def dataset_profile(spark, sf):
    profile = hexio.dataset_profile(spark.read.parquet(f"{sf}/lineitem.parquet"))
    return profile.select("n_rows", (F.col("n_files") > 0).alias("has_files"), (F.col("n_bytes") > 0).alias("has_bytes"))


@query("values_scope", "mask_hex", """
    SELECT s.region, COUNT(*) AS cells FROM (VALUES ('ASIA'), ('EUROPE')) s(region)
    JOIN mask_hex m ON m.region = s.region GROUP BY 1""")
def values_scope(spark, sf):
    t.mask_hex(spark, sf).createOrReplaceTempView("hexweave_mask")
    return spark.sql("""
        SELECT s.region, COUNT(*) AS cells FROM VALUES ('ASIA'), ('EUROPE') AS s(region)
        JOIN hexweave_mask m ON m.region = s.region GROUP BY 1""")


@query("int_range", sql="""
    SELECT i, COUNT(o_orderkey) AS n FROM (SELECT unnest(range(0, (SELECT CAST(floor(MAX(o_totalprice) / 10000) AS BIGINT) + 1 FROM orders))) AS i) LEFT JOIN orders
    ON i = CAST(floor(o_totalprice / 10000) AS BIGINT) GROUP BY i""")
def int_range(spark, sf):
    prices = t.table(spark, sf, "orders").groupBy(F.floor(F.col("o_totalprice") / 10000).alias("i")).agg(
        F.count(F.lit(1)).alias("n")
    )
    top = prices.agg(F.max("i")).first()[0]
    return spark.range(0 if top is None else int(top) + 1).withColumnRenamed("id", "i").join(prices, "i", "left").select(
        "i", F.coalesce("n", F.lit(0)).alias("n")
    )


@query("pixel_guard", "raster_headers", """
    SELECT raster, rows * cols AS n_pixels, rows * cols <= 1000000 AS allowed FROM raster_headers""")
def pixel_guard(spark, sf):
    return guard_pixels(t.raster_headers(spark, sf), 1_000_000).select("raster", "n_pixels", "allowed")


@query("slice_cube", "pixels", """
    SELECT raster, COUNT(*) AS n, ROUND(AVG(band_1), 6) AS mean_value FROM pixels
    WHERE x BETWEEN -60 AND 60 AND y BETWEEN 0 AND 45 AND band_1 <> -9999 GROUP BY 1""")
def slice_cube_(spark, sf):
    cut = slice_cube(t.pixels(spark, sf), {"x": (-60, 60), "y": (0, 45)}).where("band_1 <> -9999")
    return cut.groupBy("raster").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("band_1"), 6).alias("mean_value"))


@query("preview", sql="""
    SELECT c_custkey, c_acctbal, (SELECT COUNT(*) FROM customer) > 50 AS truncated FROM customer
    ORDER BY c_acctbal DESC, c_custkey LIMIT 50""")
def preview_(spark, sf):
    ordered = t.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return preview(ordered.orderBy(F.desc("c_acctbal"), "c_custkey"))


@query("render", "value_hex", """
    SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, l_linenumber,
           COALESCE(printf('%.10g', l_extendedprice * l_discount), '') AS price,
           COALESCE(printf('%.10g', CASE l_linenumber WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN NULL
                    ELSE l_extendedprice / 7e9 / l_linenumber END), '') AS tiny,
           strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate, strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') AS day,
           CAST(CAST(l_quantity AS DECIMAL(12,3)) AS VARCHAR) AS quantity,
           COALESCE(CAST(CASE WHEN l_linenumber <> 3 THEN l_partkey END AS VARCHAR), '') AS part FROM lineitem""")
def render(spark, sf):
    n = F.col("l_linenumber")
    tiny = F.when(n == 1, float("nan")).when(n != 2, F.col("l_extendedprice") / 7e9 / n)
    df = t.table(spark, sf, "lineitem", "l_orderkey").select(
        "l_orderkey", n, (F.col("l_extendedprice") * F.col("l_discount")).alias("price"), tiny.alias("tiny"),
        "l_shipdate", F.col("l_shipdate").cast("date").alias("day"), F.col("l_quantity").cast("decimal(12,3)").alias("quantity"),
        F.when(n != 3, F.col("l_partkey")).alias("part"), F.encode(F.lit("x"), "utf-8").alias("geom"),
    )
    return render_columns(df)


@query("scan_clustered", "value_hex", f"""
    SELECT h0, COUNT(*) AS n, ROUND(SUM(carbon), 2) AS carbon FROM value_hex
    WHERE {parent_sql("h8", 3)} = (SELECT {parent_sql("MIN(h8)", 3)} FROM value_hex) GROUP BY 1""")
def scan_clustered(spark, sf):
    """Cells of one parent of resolution 3 from files sorted by cell: a range of ids, which prunes row groups."""
    root = fresh_dir(spark, "clustered")
    write_clustered(t.value_hex(spark, sf), root, "h8", partition_by=["h0"])
    layer = read_hex(spark, root)
    parent = layer.agg(cell_parent(F.min("h8"), 3, 8)).first()[0]
    return layer.where(within_cell(8, parent)).groupBy("h0").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("carbon"), 2).alias("carbon")
    )


@query("text_exact_clustered", sql="SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#13'")
def text_exact_clustered(spark, sf):
    """An exact key, from files sorted by it that carry its bloom filter."""
    root = fresh_dir(spark, "clustered")
    write_clustered(t.table(spark, sf, "part"), root, "p_brand", bloom=["p_brand"])
    return spark.read.parquet(root).where(F.col("p_brand") == "Brand#13").select("p_partkey", "p_name")
