"""Hex layers derived from the benchmark tables, for Spark and as SQL text.

The tables have no coordinates. ``cell(k, res)`` turns a key into a valid cell id
whose finest digit is the last base-7 digit of the key, so neighbouring keys are
siblings and ``parent(cell(k, res), r) = cell(k div 7**(res - r), r)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexweave.functions.cells import as_column, cell_parent
from hexweave.functions.geometry import vertex
from hexweave.operators.sizing import shuffled

# --- cell ids ----------------------------------------------------------------


def _fixed(res: int) -> int:
    """The bits that do not depend on the key: mode, resolution, base 5, unused digits."""
    return 2**59 + res * 2**52 + 5 * 2**45 + (2 ** (3 * (15 - res)) - 1)


def cell(k: Column | str, res: int) -> Column:
    """Cell of a key: its base-7 digits, read as octal, are the id's 3-bit digits.

    Like a stored cell column the result is never NULL, and the expression is short,
    since Spark repeats it in every filter it infers.
    """
    digits = F.conv((as_column(k).cast("bigint") % 7**res).cast("string"), 10, 7)
    octal = F.conv(digits, 8, 10).cast("bigint")
    fifth = F.shiftright(octal, 3 * (res - 5)).bitwiseAND(F.lit(7))
    out = F.shiftleft(octal, 3 * (15 - res)) + fifth * F.lit(2**45) + F.lit(_fixed(res))
    return F.coalesce(out, F.lit(0))


def cell_sql(k: str, res: int) -> str:
    weights = [(7 ** (res - 5), 2**45)] + [(7 ** (res - r), 2 ** (3 * (15 - r))) for r in range(1, res + 1)]
    parts = [f"(CAST({k} AS BIGINT) // {div}) % 7 * {weight}" for div, weight in weights]
    return f"CAST({_fixed(res)} + " + " + ".join(parts) + " AS BIGINT)"


def parent_sql(h: str, res: int) -> str:
    tail = (res << 52) | ((1 << (3 * (15 - res))) - 1)
    return f"CAST(({h} & {~(15 << 52)}) | {tail} AS BIGINT)"


# --- layers ------------------------------------------------------------------


def table(spark: SparkSession, sf: str, name: str, deal_by: str | None = None) -> DataFrame:
    """A benchmark table, dealt over the cores where the layer made from it takes long per row.

    The files have one row group each, which no setting splits; datasets on storage have many, so no
    operator does this.
    """
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df if deal_by is None else df.repartition(spark.sparkContext.defaultParallelism, deal_by)


def _with_h0(df: DataFrame, h: str) -> DataFrame:
    return df.withColumn("h0", cell_parent(h, 0))


def value_hex(spark, sf) -> DataFrame:
    """Raster: many rows per cell."""
    df = table(spark, sf, "lineitem").select(
        cell("l_partkey", 8).alias("h8"), F.col("l_extendedprice").alias("carbon"),
        F.col("l_linenumber").alias("lc_class"), F.col("l_suppkey").alias("species"),
    )
    return _with_h0(df, "h8")


def feature_hex(spark, sf) -> DataFrame:
    """Vector features tiled over overlapping cells."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("fid"), F.col("o_totalprice").alias("amount"),
        F.col("o_orderstatus").alias("status"),
    )
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("fid"), cell("l_partkey", 8).alias("h8")
    )
    return _with_h0(shuffled(orders).join(lines, "fid"), "h8")


def mask_hex(spark, sf) -> DataFrame:
    """Region mask: customers' cells with nation and region names."""
    nation = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("STUSPS"),
        F.col("n_regionkey").alias("r_regionkey"),
    )
    region = table(spark, sf, "region").select("r_regionkey", F.col("r_name").alias("region"))
    df = table(spark, sf, "customer").select("c_nationkey", cell("c_custkey", 8).alias("h8"))
    df = df.join(nation, "c_nationkey").join(region, "r_regionkey").select("STUSPS", "region", "h8")
    return _with_h0(df.distinct(), "h8")


def line_hex(spark, sf) -> DataFrame:
    """Lines: full length repeated on every cell the line crosses."""
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("fid"), F.col("p_size").cast("double").alias("length_km"),
        F.col("p_brand").alias("class"),
    )
    lines = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("fid"), cell("l_suppkey", 8).alias("h8")
    )
    return _with_h0(part.join(lines, "fid").distinct(), "h8")


def fraction_hex(spark, sf) -> DataFrame:
    """Class fractions per cell, adding up to one."""
    rows = table(spark, sf, "lineitem").groupBy(
        cell("l_partkey", 8).alias("h8"), F.col("l_returnflag").alias("class")
    ).agg(F.count(F.lit(1)).alias("n"))
    totals = rows.groupBy("h8").agg(F.sum("n").alias("t"))
    df = rows.join(totals, "h8").select("class", (F.col("n") / F.col("t")).alias("frac"), "h8")
    return _with_h0(df, "h8")


def weights_hex(spark, sf) -> DataFrame:
    """Coverage shares on a partial footprint."""
    df = table(spark, sf, "part").where("p_size <= 40").select(
        cell("p_partkey", 8).alias("h8"),
        ((F.col("p_size") % 5) / 10).alias("w1"), ((F.col("p_size") % 4) / 10).alias("w2"),
    )
    return _with_h0(df, "h8")


def land_hex(spark, sf) -> DataFrame:
    """Coarse land grid with the land area of every cell."""
    df = table(spark, sf, "part").select(
        cell("p_partkey", 8).alias("h8"), (F.lit(0.5) + (F.col("p_size") % 10) / 40).alias("land_area_km2")
    )
    return _with_h0(df, "h8")


def land_grid(spark, sf) -> DataFrame:
    """Dense fine land grid; every fifth child is missing, as at a coast."""
    df = (
        table(spark, sf, "part", "p_partkey").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(48))).alias("j"))
        .where("j % 5 <> 4")
        .select(cell(F.col("p_partkey") * 49 + F.col("j"), 10).alias("h10"))
    )
    df = df.withColumn("h9", cell_parent("h10", 9, 10)).withColumn("h8", cell_parent("h10", 8, 10))
    return _with_h0(df, "h10")


def presence_hex(spark, sf) -> DataFrame:
    """Fine cells where something occurs; no fraction column."""
    df = table(spark, sf, "lineitem", "l_orderkey").select(
        cell(F.col("l_partkey") * 49 + F.col("l_quantity").cast("bigint") % 49, 10).alias("h10")
    )
    return _with_h0(df.distinct(), "h10")


def coarse_feature(spark, sf) -> DataFrame:
    df = table(spark, sf, "supplier").select(
        cell(F.floor(F.col("s_suppkey") / 2), 6).alias("h6"), F.col("s_nationkey").alias("feature_type")
    )
    return _with_h0(df, "h6")


def points(spark, sf) -> DataFrame:
    """Occurrences with coordinates."""
    return table(spark, sf, "events", "event_id").select(
        "event_id", (F.col("event_id") % 1600 / 10.0 - 80.0).alias("lat"),
        (F.col("user_id") * 37 % 3599 / 10.0 - 179.9).alias("lng"),
        F.col("user_id").alias("species"), F.col("event_type").alias("class"), "value",
    )


def occurrence_hex(spark, sf) -> DataFrame:
    """Occurrences by cell, a class and a species each."""
    df = table(spark, sf, "events").select(
        cell("user_id", 8).alias("h8"), F.col("event_type").alias("class"), F.col("event_id").alias("species")
    )
    return _with_h0(df, "h8")


def blocks_hex(spark, sf) -> DataFrame:
    """Block groups by cell; income is suppressed for some of them."""
    income = F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal"))
    df = table(spark, sf, "customer").select(
        cell("c_custkey", 8).alias("h8"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("STATEFP"),
        F.lpad((F.col("c_custkey") % 3).cast("string"), 3, "0").alias("COUNTYFP"),
        F.lpad((F.col("c_custkey") % 4).cast("string"), 6, "0").alias("TRACTCE"),
        F.col("c_custkey").alias("GEOID"), (F.col("c_custkey") % 97 + 1).alias("TotPop"), income.alias("MHHI"),
    )
    return _with_h0(df, "h8")


def pixels(spark, sf) -> DataFrame:
    """Raster pixels in eight rasters; some hold the no-data value."""
    band = F.when(F.col("event_id") % 13 == 0, -9999.0).otherwise(F.col("value"))
    return table(spark, sf, "events", "event_id").select(
        (F.col("event_id") % 8).alias("raster"), F.col("event_id").alias("pixel_id"),
        (F.col("user_id") * 7 % 3000 / 10.0 - 150.03).alias("x"),
        (F.col("event_id") * 11 % 1400 / 10.0 - 70.07).alias("y"), band.alias("band_1"),
    )


def raster_headers(spark, sf) -> DataFrame:
    """One header per raster, derived from its pixels."""
    rows = table(spark, sf, "events").groupBy((F.col("event_id") % 8).alias("raster")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("user_id").alias("cols")
    )
    step = (F.col("raster") + 1) / 1000.0
    return rows.withColumn(
        "transform",
        F.concat(F.lit("[-150.0,"), step.cast("string"), F.lit(",0.0,70.0,0.0,"), (-step).cast("string"), F.lit("]")),
    )


def polylines(spark, sf) -> DataFrame:
    """Zigzag lines of four vertices."""
    k = F.col("p_partkey")
    x0 = (k * 53 % 280 - 140).cast("double") + 0.25
    y0 = (k * 29 % 100 - 50).cast("double") + 0.25
    line = F.array(
        vertex(x0, y0), vertex(x0 + 12, y0 + 9), vertex(x0 + 20, y0 - 6), vertex(x0 + 31, y0 + 3)
    )
    return table(spark, sf, "part", "p_partkey").select(
        k.alias("line_id"), F.col("p_size").cast("double").alias("length_km"),
        F.col("p_brand").alias("class"), line.alias("line"),
    )


def boxes(spark, sf) -> DataFrame:
    """Axis-aligned polygons, one per supplier."""
    k = F.col("s_suppkey")
    west = (k * 37 % 260 - 140).cast("double")
    south = (k * 17 % 90 - 55).cast("double")
    width, height = (F.lit(10) + k % 30).cast("double"), (F.lit(8) + k % 20).cast("double")
    ring = F.array(
        vertex(west, south), vertex(west + width, south), vertex(west + width, south + height),
        vertex(west, south + height), vertex(west, south),
    )
    return table(spark, sf, "supplier", "s_suppkey").select(
        k.alias("aoi_id"), ring.alias("ring"), F.col("s_name").alias("name")
    )


def line_cells(spark, sf) -> DataFrame:
    df = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("line_id"), cell("l_suppkey", 8).alias("h8")
    )
    return _with_h0(df, "h8")


def aoi_cells(spark, sf) -> DataFrame:
    df = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("aoi_id"), cell("s_suppkey", 8).alias("h8"))
    return _with_h0(df, "h8")


def centers(spark, sf) -> DataFrame:
    """A level of cells with given centres, one per event."""
    return table(spark, sf, "events", "event_id").select(
        cell("event_id", 8).alias("h"), cell_parent(cell("event_id", 8), 0).alias("h0"),
        (F.col("event_id") * 7 % 1700 / 10.0 - 85.0).alias("lat"),
        (F.col("event_id") * 13 % 3600 / 10.0 - 180.0).alias("lng"), "value",
    )


def documents(spark, sf) -> DataFrame:
    """Catalogue documents: per supplier one parent and three children, some broken."""
    base = F.concat(F.lit("https://data.example.org/catalog/"), F.col("s_suppkey").cast("string"))
    k = F.col("s_suppkey").cast("string")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")

    def link(rel: str, href: Column, title: Column | None = None) -> Column:
        t = F.lit(None).cast("string") if title is None else title
        return F.struct(F.lit(rel).alias("rel"), href.alias("href"), t.alias("title"))

    def child_href(j) -> Column:
        return F.concat(base, F.lit("/set-"), j.cast("string"), F.lit(".json"))

    parent_doc = F.struct(
        F.lit("Collection").alias("type"), F.concat(F.lit("group-"), k).alias("id"), F.col("s_name").alias("title"),
        F.when(F.col("s_suppkey") % 7 != 0, F.lit("CC-BY-4.0")).alias("license"),
        F.array(
            link("root", F.lit("https://data.example.org/catalog.json")),
            link("about", F.concat(base, F.lit("/readme.html")), F.lit("About")),
            *[link("child", child_href(F.lit(j)), F.concat(F.lit("Part "), F.lit(j).cast("string"))) for j in range(4)],
        ).alias("links"),
    )
    parents = s.select(
        F.concat(base, F.lit("/stac-collection.json")).alias("path"), F.to_json(parent_doc).alias("value")
    )

    def col(name, kind, text=None, values=None) -> Column:
        return F.struct(
            F.lit(name).alias("name"), F.lit(kind).alias("type"),
            (F.lit(None).cast("string") if text is None else F.lit(text)).alias("description"),
            (F.lit(None).cast("array<string>") if values is None else F.array(*[F.lit(v) for v in values])).alias("values"),
        )

    root = F.concat(
        F.when(F.col("s_suppkey") % 2 == 0, F.lit("https://data.example.org/store/"))
        .otherwise(F.lit("https://minio.example.edu/open/")),
        k, F.lit("/"), F.col("j").cast("string"),
    )
    flat_cols = F.array(
        col("id", "bigint", "Feature id"), col("area_km2", "double"),
        col("category", "varchar", "Kind", ["a", "b"]), col("geometry", "binary"),
    )
    hex_cols = F.array(
        col("id", "bigint"), col("area_km2", "double", "Area"), col("h0", "bigint"), col("h8", "bigint", "Cell"),
    )

    def asset(tail: str, kind: str, title: str, size: Column, cols: Column) -> Column:
        return F.struct(
            F.concat(root, F.lit(tail)).alias("href"), F.lit(kind).alias("type"), F.lit(title).alias("title"),
            size.alias("file:size"), cols.alias("table:columns"),
        )

    own = F.col("j") != 2  # the last child describes its columns on the collection only
    none = F.lit(None).cast("bigint")
    child_doc = F.struct(
        F.lit("Collection").alias("type"),
        F.concat(F.lit("group-"), k, F.lit("-set-"), F.col("j").cast("string")).alias("id"),
        F.concat(F.col("s_name"), F.lit(" part "), F.col("j").cast("string")).alias("title"),
        F.struct(
            asset("/flat.parquet", "application/x-parquet", "Flat", F.col("s_suppkey") * 40000000, F.when(own, flat_cols)).alias("flat"),
            asset("/hex/", "application/x-parquet", "Hex", none, F.when(own, hex_cols)).alias("hex"),
            asset("/map.pmtiles", "application/vnd.pmtiles", "Map", none, F.lit(None).cast(_COLS)).alias("map"),
            asset("/cover.tif", "image/tiff", "Cover", none, F.lit(None).cast(_COLS)).alias("cover"),
        ).alias("assets"),
        F.array(col("CODE", "varchar", "Code"), col("geom", "binary")).alias("table:columns"),
    )
    kids = s.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2))))
    text = F.to_json(child_doc)
    broken = (F.col("s_suppkey") + F.col("j")) % 5 == 0
    children = kids.select(
        child_href(F.col("j")).alias("path"),
        F.when(broken, F.substring(text, F.lit(1), F.length(text) - 9)).otherwise(text).alias("value"),
    )
    return parents.unionByName(children)


_COLS = "array<struct<name:string,type:string,description:string,values:array<string>>>"


def builtin_sources(spark, sf) -> DataFrame:
    """Registry entries: one per nation, plus the catalogue's own store."""
    n = table(spark, sf, "nation")
    named = n.select(
        F.lower("n_name").alias("name"), F.col("n_nationkey").cast("bigint").alias("priority"),
        F.concat(F.lit("https://n"), F.col("n_nationkey").cast("string"), F.lit(".example.org/")).alias("https_prefix"),
        F.concat(F.lit("s3://n"), F.col("n_nationkey").cast("string"), F.lit("/")).alias("s3_prefix"),
        F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("http://int"), F.col("n_nationkey").cast("string"), F.lit("/")))
        .alias("metadata_url_prefix"),
    )
    store = n.agg(F.count(F.lit(1))).select(
        F.lit("store").alias("name"), F.lit(100).cast("bigint").alias("priority"),
        F.lit("https://data.example.org/").alias("https_prefix"), F.lit("s3://").alias("s3_prefix"),
        F.lit(None).cast("string").alias("metadata_url_prefix"),
    )
    return named.unionByName(store)


def source_overrides(spark, sf) -> DataFrame:
    """Overrides by nation name: some replace a prefix, some disable, some are new."""
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        F.when(k % 5 == 4, F.concat(F.lit("new_"), F.lower("n_name"))).otherwise(F.lower("n_name")).alias("name"),
        (k + 200).cast("bigint").alias("priority"),
        F.when(k % 5 == 4, F.concat(F.lit("https://new"), k.cast("string"), F.lit(".example.org/"))).alias("https_prefix"),
        F.when(k % 5 >= 3, F.concat(F.lit("s3://over"), k.cast("string"), F.lit("/"))).alias("s3_prefix"),
        F.lit(None).cast("string").alias("metadata_url_prefix"),
        (k % 5 == 1).alias("disabled"),
    )


def customer_hrefs(spark, sf) -> DataFrame:
    """Addresses on known, unknown and virtual-host stores."""
    k = F.col("c_custkey").cast("string")
    n = F.col("c_nationkey").cast("string")
    href = (
        F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("https://minio.example.edu/b"), n, F.lit("/f"), k, F.lit(".parquet")))
        .when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("https://b"), n, F.lit(".s3.us-west-2.amazonaws.com/f"), k))
        .when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("https://n"), n, F.lit(".example.org/d/f"), k, F.lit("/")))
        .otherwise(F.concat(F.lit("s3://b"), n, F.lit("/f"), k))
    )
    return table(spark, sf, "customer").select("c_custkey", href.alias("href"))


# --- the same layers for DuckDB ----------------------------------------------


def _h0(h: str) -> str:
    return f"{parent_sql(h, 0)} AS h0"


VIEWS: dict[str, str] = {
    "value_hex": f"""
        SELECT h8, {_h0('h8')}, carbon, lc_class, species FROM (
          SELECT {cell_sql('l_partkey', 8)} AS h8, l_extendedprice AS carbon, l_linenumber AS lc_class,
                 l_suppkey AS species FROM lineitem)""",
    "feature_hex": f"""
        SELECT fid, amount, status, h8, {_h0('h8')} FROM (
          SELECT o_orderkey AS fid, o_totalprice AS amount, o_orderstatus AS status,
                 {cell_sql('l_partkey', 8)} AS h8
          FROM orders JOIN lineitem ON o_orderkey = l_orderkey)""",
    "mask_hex": f"""
        SELECT DISTINCT STUSPS, region, h8, {_h0('h8')} FROM (
          SELECT n_name AS STUSPS, r_name AS region, {cell_sql('c_custkey', 8)} AS h8
          FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "line_hex": f"""
        SELECT DISTINCT fid, length_km, class, h8, {_h0('h8')} FROM (
          SELECT p_partkey AS fid, CAST(p_size AS DOUBLE) AS length_km, p_brand AS class,
                 {cell_sql('l_suppkey', 8)} AS h8
          FROM part JOIN lineitem ON p_partkey = l_partkey)""",
    "fraction_hex": f"""
        SELECT class, n / SUM(n) OVER (PARTITION BY h8) AS frac, h8, {_h0('h8')} FROM (
          SELECT {cell_sql('l_partkey', 8)} AS h8, l_returnflag AS class, COUNT(*) AS n
          FROM lineitem GROUP BY 1, 2)""",
    "weights_hex": f"""
        SELECT h8, {_h0('h8')}, w1, w2 FROM (
          SELECT {cell_sql('p_partkey', 8)} AS h8, CAST((p_size % 5) / 10 AS DOUBLE) AS w1,
                 CAST((p_size % 4) / 10 AS DOUBLE) AS w2 FROM part WHERE p_size <= 40)""",
    "land_hex": f"""
        SELECT h8, {_h0('h8')}, land_area_km2 FROM (
          SELECT {cell_sql('p_partkey', 8)} AS h8, CAST(0.5 + (p_size % 10) / 40 AS DOUBLE) AS land_area_km2
          FROM part)""",
    "land_grid": f"""
        SELECT h10, {parent_sql('h10', 9)} AS h9, {parent_sql('h10', 8)} AS h8, {_h0('h10')} FROM (
          SELECT {cell_sql('(p_partkey * 49 + j)', 10)} AS h10
          FROM part CROSS JOIN range(49) t(j) WHERE j % 5 <> 4)""",
    "presence_hex": f"""
        SELECT DISTINCT h10, {_h0('h10')} FROM (
          SELECT {cell_sql('(l_partkey * 49 + CAST(l_quantity AS BIGINT) % 49)', 10)} AS h10 FROM lineitem)""",
    "coarse_feature": f"""
        SELECT h6, {_h0('h6')}, feature_type FROM (
          SELECT {cell_sql('(s_suppkey // 2)', 6)} AS h6, s_nationkey AS feature_type FROM supplier)""",
    "points": """
        SELECT event_id, event_id % 1600 / 10.0::DOUBLE - 80.0::DOUBLE AS lat,
               user_id * 37 % 3599 / 10.0::DOUBLE - 179.9::DOUBLE AS lng,
               user_id AS species, event_type AS class, value FROM events""",
    "occurrence_hex": f"""
        SELECT h8, {_h0('h8')}, class, species FROM (
          SELECT {cell_sql('user_id', 8)} AS h8, event_type AS class, event_id AS species FROM events)""",
    "blocks_hex": f"""
        SELECT h8, {_h0('h8')}, STATEFP, COUNTYFP, TRACTCE, GEOID, TotPop, MHHI FROM (
          SELECT {cell_sql('c_custkey', 8)} AS h8, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS STATEFP,
                 lpad(CAST(c_custkey % 3 AS VARCHAR), 3, '0') AS COUNTYFP,
                 lpad(CAST(c_custkey % 4 AS VARCHAR), 6, '0') AS TRACTCE,
                 c_custkey AS GEOID, c_custkey % 97 + 1 AS TotPop,
                 CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal END AS MHHI FROM customer)""",
    "pixels": """
        SELECT event_id % 8 AS raster, event_id AS pixel_id,
               user_id * 7 % 3000 / 10.0::DOUBLE - 150.03::DOUBLE AS x,
               event_id * 11 % 1400 / 10.0::DOUBLE - 70.07::DOUBLE AS y,
               CASE WHEN event_id % 13 = 0 THEN -9999.0 ELSE value END AS band_1 FROM events""",
    "raster_headers": """
        SELECT event_id % 8 AS raster, COUNT(*) AS rows, COUNT(DISTINCT user_id) AS cols,
               (event_id % 8 + 1) / 1000.0::DOUBLE AS step FROM events GROUP BY 1, 4""",
    "boxes": """
        SELECT s_suppkey AS aoi_id, west, south, west + 10 + s_suppkey % 30 AS east,
               south + 8 + s_suppkey % 20 AS north FROM (
          SELECT s_suppkey, CAST(s_suppkey * 37 % 260 - 140 AS DOUBLE) AS west,
                 CAST(s_suppkey * 17 % 90 - 55 AS DOUBLE) AS south FROM supplier)""",
    "segments": """
        SELECT line_id, length_km, class, i, x0 + dx[i] AS x1, y0 + dy[i] AS y1,
               x0 + dx[i + 1] AS x2, y0 + dy[i + 1] AS y2 FROM (
          SELECT p_partkey AS line_id, CAST(p_size AS DOUBLE) AS length_km, p_brand AS class,
                 CAST(p_partkey * 53 % 280 - 140 AS DOUBLE) + 0.25 AS x0,
                 CAST(p_partkey * 29 % 100 - 50 AS DOUBLE) + 0.25 AS y0,
                 [0.0::DOUBLE, 12, 20, 31] AS dx, [0.0::DOUBLE, 9, -6, 3] AS dy FROM part)
        CROSS JOIN (SELECT CAST(unnest([1, 2, 3]) AS BIGINT) AS i)""",
    "line_cells": f"""
        SELECT line_id, h8, {_h0('h8')} FROM (
          SELECT l_partkey AS line_id, {cell_sql('l_suppkey', 8)} AS h8 FROM lineitem)""",
    "aoi_cells": f"""
        SELECT aoi_id, h8, {_h0('h8')} FROM (
          SELECT s_suppkey AS aoi_id, {cell_sql('s_suppkey', 8)} AS h8 FROM supplier)""",
    "centers": f"""
        SELECT h, {_h0('h')}, lat, lng, value FROM (
          SELECT {cell_sql('event_id', 8)} AS h, event_id * 7 % 1700 / 10.0::DOUBLE - 85.0::DOUBLE AS lat,
                 event_id * 13 % 3600 / 10.0::DOUBLE - 180.0::DOUBLE AS lng, value FROM events)""",
    "kids": """
        SELECT s_suppkey AS k, j, s_name, (s_suppkey + j) % 5 = 0 AS broken,
               'group-' || s_suppkey AS parent_id, 'group-' || s_suppkey || '-set-' || j AS id,
               CASE WHEN s_suppkey % 2 = 0 THEN 's3://store/' || s_suppkey || '/' || j
                    ELSE 's3://open/' || s_suppkey || '/' || j END AS storage,
               CASE WHEN s_suppkey % 2 = 0 THEN 'https://data.example.org/store/' || s_suppkey || '/' || j
                    ELSE 'https://minio.example.edu/open/' || s_suppkey || '/' || j END AS root
        FROM supplier CROSS JOIN range(3) t(j)""",
    "builtin_sources": """
        SELECT lower(n_name) AS name, CAST(n_nationkey AS BIGINT) AS priority,
               'https://n' || n_nationkey || '.example.org/' AS https_prefix, 's3://n' || n_nationkey || '/' AS s3_prefix,
               CASE WHEN n_nationkey % 2 = 0 THEN 'http://int' || n_nationkey || '/' END AS metadata_url_prefix FROM nation
        UNION ALL SELECT 'store', 100, 'https://data.example.org/', 's3://', NULL""",
    "source_overrides": """
        SELECT CASE WHEN n_nationkey % 5 = 4 THEN 'new_' || lower(n_name) ELSE lower(n_name) END AS name,
               CAST(n_nationkey + 200 AS BIGINT) AS priority,
               CASE WHEN n_nationkey % 5 = 4 THEN 'https://new' || n_nationkey || '.example.org/' END AS https_prefix,
               CASE WHEN n_nationkey % 5 >= 3 THEN 's3://over' || n_nationkey || '/' END AS s3_prefix,
               CAST(NULL AS VARCHAR) AS metadata_url_prefix, n_nationkey % 5 = 1 AS disabled FROM nation""",
    "customer_hrefs": """
        SELECT c_custkey, c_nationkey, CASE c_custkey % 4
          WHEN 0 THEN 'https://minio.example.edu/b' || c_nationkey || '/f' || c_custkey || '.parquet'
          WHEN 1 THEN 'https://b' || c_nationkey || '.s3.us-west-2.amazonaws.com/f' || c_custkey
          WHEN 2 THEN 'https://n' || c_nationkey || '.example.org/d/f' || c_custkey || '/'
          ELSE 's3://b' || c_nationkey || '/f' || c_custkey END AS href FROM customer""",
}


def oracle(views: str, body: str) -> str:
    """SQL text with the named layers (space-separated) as common table expressions."""
    names = views.split()
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {ctes}\n{body}"
