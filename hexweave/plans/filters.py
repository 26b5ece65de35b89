"""Queries for projections, filters and predicates."""

from pyspark.sql import functions as F

from hexweave.operators import filters as f
from hexweave.operators import joins as j
from hexweave.plans import inputs as t
from hexweave.plans.registry import query

def count():
    return F.count(F.lit(1)).alias("n")


@query("project", "value_hex", "SELECT lc_class, ROUND(SUM(carbon) / 1e6, 6) AS carbon_m FROM value_hex GROUP BY 1")
def project(spark, sf):
    return t.value_hex(spark, sf).groupBy("lc_class").agg(F.round(F.sum("carbon") / 1e6, 6).alias("carbon_m"))


@query("filter_flags", sql="""
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND NOT (o_totalprice < 100000)""")
def filter_flags(spark, sf):
    keep = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT") & ~(F.col("o_totalprice") < 100000)
    return t.table(spark, sf, "orders").where(keep).select("o_orderkey", "o_totalprice")


_ASIA = "SELECT {0} FROM mask_hex WHERE region = 'ASIA'"


@query("h0_static", "value_hex mask_hex", f"""
    SELECT h0, COUNT(*) AS n FROM value_hex WHERE h0 IN ({_ASIA.format('h0')}) GROUP BY 1""")
def h0_static(spark, sf):
    base = j.static_partitions(t.mask_hex(spark, sf).where("region = 'ASIA'"))
    return t.value_hex(spark, sf).where(F.col("h0").isin(base)).groupBy("h0").agg(count())


@query("mask_in", "value_hex mask_hex", f"""
    SELECT h8, ROUND(SUM(carbon), 2) AS carbon FROM value_hex
    WHERE h0 IN ({_ASIA.format('h0')}) AND h8 IN ({_ASIA.format('h8')}) GROUP BY 1""")
def mask_in(spark, sf):
    t.value_hex(spark, sf).createOrReplaceTempView("hexweave_value")
    t.mask_hex(spark, sf).createOrReplaceTempView("hexweave_mask")
    return spark.sql("""
        SELECT h8, ROUND(SUM(carbon), 2) AS carbon FROM hexweave_value
        WHERE (h8, h0) IN (SELECT h8, h0 FROM hexweave_mask WHERE region = 'ASIA') GROUP BY h8""")


@query("clip_to_mask", "value_hex mask_hex", """
    SELECT h8, h0, COUNT(*) AS n, ROUND(SUM(carbon), 2) AS carbon FROM value_hex v WHERE EXISTS (
      SELECT 1 FROM mask_hex m WHERE m.h8 = v.h8 AND m.h0 = v.h0 AND m.STUSPS = 'NATION_7') GROUP BY 1, 2""")
def clip_to_mask(spark, sf):
    inside = j.clip_to_mask(t.value_hex(spark, sf), t.mask_hex(spark, sf), 8, F.col("STUSPS") == "NATION_7")
    return inside.groupBy("h8", "h0").agg(count(), F.round(F.sum("carbon"), 2).alias("carbon"))


@query("valid_values", "pixels", """
    SELECT raster, COUNT(*) AS n, ROUND(AVG(v), 6) AS mean_value FROM (
      SELECT raster, CASE WHEN pixel_id % 17 = 0 THEN 'nan'::DOUBLE WHEN pixel_id % 19 <> 0 THEN band_1 END AS v FROM pixels)
    WHERE v IS NOT NULL AND NOT isnan(v) AND v NOT IN (-9999, 0) GROUP BY 1""")
def valid_values(spark, sf):
    k = F.col("pixel_id")
    v = F.when(k % 17 == 0, float("nan")).when(k % 19 != 0, F.col("band_1"))
    valid = f.valid_values(t.pixels(spark, sf).withColumn("v", v), "v", [-9999, 0])
    return valid.groupBy("raster").agg(count(), F.round(F.avg("v"), 6).alias("mean_value"))


@query("text_fuzzy", sql="SELECT doc_id, n_chars FROM documents WHERE lower(text) LIKE '%' || lower('The') || '%'")
def text_fuzzy(spark, sf):
    return t.table(spark, sf, "documents").where(f.contains_text("text", "The")).select("doc_id", "n_chars")


@query("text_exact", sql="SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#13'")
def text_exact(spark, sf):
    return t.table(spark, sf, "part").where(F.col("p_brand") == "Brand#13").select("p_partkey", "p_name")


@query("text_quote", sql="SELECT doc_id, source || '''s' AS owner FROM documents WHERE source || '''s' = 'src4''s'")
def text_quote(spark, sf):
    docs = t.table(spark, sf, "documents")
    return spark.sql(
        "SELECT doc_id, source || :tail AS owner FROM {docs} WHERE source || :tail = :name",
        args={"tail": "'s", "name": "src4's"}, docs=docs,
    )


@query("conditional", sql="""
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END AS band,
           COALESCE(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END, 0) AS third, LEAST(c_acctbal, 5000) AS capped FROM customer""")
def conditional(spark, sf):
    bal = F.col("c_acctbal")
    return t.table(spark, sf, "customer").select(
        "c_custkey", F.when(bal < 0, "debt").when(bal < 1000, "low").otherwise("high").alias("band"),
        F.coalesce(F.when(F.col("c_custkey") % 3 == 0, bal), F.lit(0.0)).alias("third"),
        F.least(bal, F.lit(5000.0)).alias("capped"),
    )


@query("bbox_filter", "points", """
    SELECT class, COUNT(*) AS n FROM points
    WHERE lat BETWEEN -20.0 - 8.544408276 / 111.195 AND 35.0 + 8.544408276 / 111.195
      AND lng BETWEEN -60.0 - 8.544408276 / 111.195 / cos(radians(35.0)) AND 44.0 + 8.544408276 / 111.195 / cos(radians(35.0))
    GROUP BY 1""")
def bbox_filter(spark, sf):
    inside = t.points(spark, sf).where(f.in_bbox("lat", "lng", -60.0, -20.0, 44.0, 35.0, res=5))
    return inside.groupBy("class").agg(count())


@query("distinct_cells", "feature_hex", "SELECT DISTINCT h8, h0 FROM feature_hex")
def distinct_cells(spark, sf):
    return j.unique_cells(t.feature_hex(spark, sf), 8)


@query("value_columns", "value_hex", "SELECT carbon, lc_class, species FROM value_hex")
def value_columns(spark, sf):
    df = t.value_hex(spark, sf).withColumn("geom", F.encode(F.lit("x"), "utf-8"))
    return df.select(*f.value_columns(df))


@query("concat_key", "blocks_hex", """
    SELECT STATEFP || COUNTYFP || TRACTCE AS tract, COUNT(*) AS n, CAST(SUM(TotPop) AS BIGINT) AS population FROM blocks_hex GROUP BY 1""")
def concat_key(spark, sf):
    tract = F.concat("STATEFP", "COUNTYFP", "TRACTCE").alias("tract")
    return t.blocks_hex(spark, sf).groupBy(tract).agg(count(), F.sum("TotPop").alias("population"))


@query("union_all", sql="""
    SELECT kind, COUNT(*) AS n, ROUND(SUM(balance), 2) AS balance FROM (
      SELECT 'customer' AS kind, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_acctbal FROM supplier) GROUP BY 1""")
def union_all(spark, sf):
    a = t.table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_acctbal").alias("balance"))
    b = t.table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b).groupBy("kind").agg(count(), F.round(F.sum("balance"), 2).alias("balance"))


@query("sort", "value_hex", "SELECT lc_class, COUNT(*) AS n FROM value_hex GROUP BY 1 ORDER BY n DESC")
def sort(spark, sf):
    return t.value_hex(spark, sf).groupBy("lc_class").agg(count()).orderBy(F.desc("n"))


@query("top_k", "value_hex", """
    SELECT h8, ROUND(SUM(carbon), 2) AS carbon FROM value_hex GROUP BY 1 ORDER BY SUM(carbon) DESC, h8 LIMIT 10""")
def top_k(spark, sf):
    sums = t.value_hex(spark, sf).groupBy("h8").agg(F.sum("carbon").alias("c"))
    return sums.orderBy(F.desc("c"), "h8").limit(10).select("h8", F.round("c", 2).alias("carbon"))
