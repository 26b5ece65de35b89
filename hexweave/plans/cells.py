"""Queries for cell arithmetic and scalar column functions."""

from pyspark.sql import functions as F

from hexweave.functions import cells as c
from hexweave.functions import tilemath as tm
from hexweave.functions.geometry import bounds, planar_length, to_wkt
from hexweave.plans import inputs as t
from hexweave.plans.inputs import cell_sql, parent_sql
from hexweave.plans.registry import query

def count():
    return F.count(F.lit(1)).alias("n")


@query("cell_parent", "value_hex", f"""
    SELECT {parent_sql('h8', 7)} AS h7, {parent_sql('h8', 5)} AS h5, {parent_sql('h8', 1)} AS h1, COUNT(*) AS n
    FROM value_hex GROUP BY 1, 2, 3""")
def cell_parent(spark, sf):
    parents = [c.cell_parent("h8", r).alias(f"h{r}") for r in (7, 5, 1)]
    return t.value_hex(spark, sf).groupBy(*parents).agg(count())


@query("cell_resolution", "value_hex land_grid", """
    SELECT CAST((h >> 52) & 15 AS INT) AS res, COUNT(*) AS n
    FROM (SELECT h8 AS h FROM value_hex UNION ALL SELECT h10 FROM land_grid) GROUP BY 1""")
def cell_resolution(spark, sf):
    both = t.value_hex(spark, sf).select(F.col("h8").alias("h")).unionAll(t.land_grid(spark, sf).select("h10"))
    return both.groupBy(c.cell_resolution("h").alias("res")).agg(count())


@query("cell_children", sql=f"""
    SELECT {cell_sql('p_partkey', 8)} AS h8, {cell_sql('(p_partkey * 49 + j)', 10)} AS h10
    FROM part CROSS JOIN range(49) t(j)""")
def cell_children(spark, sf):
    parts = t.table(spark, sf, "part", "p_partkey").select(t.cell("p_partkey", 8).alias("h8"))
    return c.explode_children(parts, "h8", 8, 10, "h10")


@query("cell_string", "value_hex", """
    SELECT printf('%x', h8) AS text, h8 AS back, COUNT(*) AS n FROM value_hex GROUP BY 1, 2""")
def cell_string(spark, sf):
    text = t.value_hex(spark, sf).withColumn("text", c.cell_to_string("h8"))
    return text.groupBy("text", c.cell_from_string("text").alias("back")).agg(count())


@query("res0_cells", "value_hex", f"""
    SELECT cells.h0, COUNT(v.h8) AS n FROM (
      SELECT CAST({2**59 + 2**45 - 1} + b * {2**45} AS BIGINT) AS h0 FROM range(122) t(b)) cells
    LEFT JOIN value_hex v ON v.h0 = cells.h0 GROUP BY 1""")
def res0_cells(spark, sf):
    base = spark.range(c.BASE_CELL_COUNT).select(c.res0_cell("id").alias("h0"))
    counts = t.value_hex(spark, sf).groupBy("h0").agg(count())
    return base.join(counts, "h0", "left").select("h0", F.coalesce("n", F.lit(0)).alias("n"))


_HAVERSINE = """2 * asin(sqrt(least(1.0, pow(sin((radians(lat2) - radians(lat1)) / 2), 2)
    + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lng2) - radians(lng1)) / 2), 2))))"""


@query("great_circle", "points", f"""
    SELECT event_id, ROUND({_HAVERSINE} * 6371.007180918475, 6) AS km, ROUND({_HAVERSINE}, 9) AS rads FROM (
      SELECT event_id, lat AS lat1, lng AS lng1, -lat / 2 AS lat2, lng / 3 AS lng2 FROM points)""")
def great_circle(spark, sf):
    lat, lng = F.col("lat"), F.col("lng")
    args = (lat, lng, -lat / 2, lng / 3)
    return t.points(spark, sf).select(
        "event_id", F.round(c.great_circle(*args), 6).alias("km"), F.round(c.great_circle(*args, "rads"), 9).alias("rads")
    )


@query("planar_length", "segments", """
    SELECT line_id, ROUND(SUM(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))), 6) AS length FROM segments GROUP BY 1""")
def planar_length_(spark, sf):
    return t.polylines(spark, sf).select("line_id", F.round(planar_length("line"), 6).alias("length"))


@query("to_wkt", "segments", """
    SELECT line_id, 'LINESTRING (' || string_agg(x1 || ' ' || y1, ', ' ORDER BY i) || ', '
           || max_by(x2 || ' ' || y2, i) || ')' AS wkt FROM segments GROUP BY 1""")
def to_wkt_(spark, sf):
    return t.polylines(spark, sf).select("line_id", to_wkt("line").alias("wkt"))


@query("mercator", "points", """
    SELECT event_id, ROUND(lng * 20037508.34 / 180.0, 4) AS mx,
           ROUND(ln(tan((90.0 + lat) * pi() / 360.0)) / (pi() / 180.0) * 20037508.34 / 180.0, 4) AS my FROM points""")
def mercator(spark, sf):
    return t.points(spark, sf).select(
        "event_id", F.round(tm.mercator_x("lng"), 4).alias("mx"), F.round(tm.mercator_y("lat"), 4).alias("my")
    )


@query("math", "points", """
    SELECT class, ROUND(SUM(cos(radians(lat))), 6) AS c, ROUND(SUM(ln(1 + abs(lat))), 6) AS l,
           ROUND(SUM(sinh(lng / 180)), 6) AS s, ROUND(SUM(atan(lat)), 6) AS a, CAST(SUM(floor(lng / pi())) AS BIGINT) AS f,
           COUNT(*) FILTER (WHERE NOT isnan(lat)) AS n FROM points GROUP BY 1""")
def math_(spark, sf):
    def total(x):
        return F.round(F.sum(x), 6)

    return t.points(spark, sf).groupBy("class").agg(
        total(F.cos(F.radians("lat"))).alias("c"), total(F.ln(1 + F.abs("lat"))).alias("l"),
        total(F.sinh(F.col("lng") / 180)).alias("s"), total(F.atan("lat")).alias("a"),
        F.sum(F.floor(F.col("lng") / F.pi())).alias("f"), F.count_if(~F.isnan("lat")).alias("n"),
    )


@query("string", sql="""
    SELECT lower(p_name) AS name, p_brand || '/' || p_type AS label, printf('%05d', p_size) AS size,
           p_type LIKE '%STEEL%' AS steel FROM part""")
def string(spark, sf):
    return t.table(spark, sf, "part").select(
        F.lower("p_name").alias("name"), F.concat_ws("/", "p_brand", "p_type").alias("label"),
        F.format_string("%05d", "p_size").alias("size"), F.col("p_type").like("%STEEL%").alias("steel"),
    )


@query("date_text", sql="""
    SELECT strftime(o_orderdate, '%Y-%m') AS month, MIN(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')) AS first_order,
           COUNT(*) FILTER (WHERE o_orderdate < CURRENT_DATE) AS past FROM orders GROUP BY 1""")
def date_text(spark, sf):
    return t.table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.min(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("first_order"),
        F.count_if(F.col("o_orderdate") < F.current_date()).alias("past"),
    )


@query("json_path", "raster_headers", """
    SELECT e.raster, ROUND(step, 6) AS dx, ROUND(-step, 6) AS dy, COUNT(*) AS n FROM (SELECT event_id % 8 AS raster FROM events) e
    JOIN raster_headers h ON e.raster = h.raster GROUP BY 1, 2, 3""")
def json_path(spark, sf):
    headers = t.raster_headers(spark, sf).select(
        "raster", F.get_json_object("transform", "$[1]").cast("double").alias("dx"),
        F.get_json_object("transform", "$[5]").cast("double").alias("dy"), F.col("rows").alias("n"),
    )
    return headers


@query("array_ordered", "segments", """
    SELECT line_id, string_agg(CAST(y1 AS VARCHAR), ' ' ORDER BY y1) AS by_latitude FROM (
      SELECT line_id, y1 FROM segments UNION ALL SELECT line_id, y2 FROM segments WHERE i = 3) GROUP BY 1""")
def array_ordered(spark, sf):
    by_y = F.array_sort(F.transform("line", lambda v: F.struct(v["y"].alias("y"), v["x"].alias("x"))))
    text = F.transform(by_y, lambda v: v["y"].cast("string"))
    return t.polylines(spark, sf).select("line_id", F.array_join(text, " ").alias("by_latitude"))


@query("lateral_unnest", "boxes", """
    SELECT i, ROUND(AVG(x), 6) AS x, ROUND(AVG(y), 6) AS y, COUNT(*) AS n FROM (
      SELECT unnest([0, 1, 2, 3, 4]) AS i, unnest([west, east, east, west, west]) AS x,
             unnest([south, south, north, north, south]) AS y FROM boxes) GROUP BY 1""")
def lateral_unnest(spark, sf):
    vertices = t.boxes(spark, sf).select(F.posexplode("ring").alias("i", "v"))
    return vertices.groupBy("i").agg(F.round(F.avg("v.x"), 6).alias("x"), F.round(F.avg("v.y"), 6).alias("y"), count())


@query("ring_bounds", "boxes", "SELECT aoi_id, west, south, east, north FROM boxes")
def ring_bounds(spark, sf):
    return t.boxes(spark, sf).select("aoi_id", bounds("ring").alias("b")).select("aoi_id", "b.*")
