"""Queries for the dataset catalogue and the source registry."""

from pyspark.sql import functions as F

from hexweave.plans import inputs as t
from hexweave.plans.registry import query
from hexweave.sources import catalog as c
from hexweave.sources import registry as r

_CHILD = "SELECT * FROM kids WHERE NOT broken"


@query("catalog_collections", "kids", """
    SELECT 'group-' || s_suppkey AS id, s_name AS title, CASE WHEN s_suppkey % 7 <> 0 THEN 'CC-BY-4.0' END AS license,
           CAST(NULL AS VARCHAR) AS parent_id FROM supplier
    UNION ALL SELECT id, s_name || ' part ' || j, NULL, parent_id FROM kids WHERE NOT broken""")
def catalog_collections(spark, sf):
    return c.collections(t.documents(spark, sf)).select("id", "title", "license", "parent_id")


@query("catalog_assets", "kids", """
    SELECT id AS collection_id, a.asset_id, CAST(a.position AS INT) AS position, root || a.tail AS href, a.type,
           CASE WHEN a.position = 0 THEN k * 40000000 END AS size FROM kids
    CROSS JOIN (VALUES (0, 'flat', '/flat.parquet', 'application/x-parquet'), (1, 'hex', '/hex/', 'application/x-parquet'),
      (2, 'map', '/map.pmtiles', 'application/vnd.pmtiles'), (3, 'cover', '/cover.tif', 'image/tiff')) a(position, asset_id, tail, type)
    WHERE NOT broken""")
def catalog_assets(spark, sf):
    return c.assets(t.documents(spark, sf)).select("collection_id", "asset_id", "position", "href", "type", "size")


_COLUMNS = """(VALUES ('flat', 0, 'id', 'bigint', 'Feature id', FALSE), ('flat', 1, 'area_km2', 'double', NULL, FALSE),
    ('flat', 2, 'category', 'varchar', 'Kind', TRUE), ('flat', 3, 'geometry', 'binary', NULL, FALSE),
    ('hex', 0, 'id', 'bigint', NULL, FALSE), ('hex', 1, 'area_km2', 'double', 'Area', FALSE), ('hex', 2, 'h0', 'bigint', NULL, FALSE),
    ('hex', 3, 'h8', 'bigint', 'Cell', FALSE)) a(asset_id, position, name, type, description, listed)"""


@query("catalog_columns", "kids", f"""
    SELECT id AS collection_id, asset_id, CAST(position AS INT) AS position, name, type, description
    FROM kids CROSS JOIN {_COLUMNS} WHERE NOT broken AND j <> 2""")
def catalog_columns(spark, sf):
    return c.asset_columns(t.documents(spark, sf)).select("collection_id", "asset_id", "position", "name", "type", "description")


@query("catalog_errors", "kids", """
    SELECT 'set-' || j AS identifier, 'unreadable document' AS reason, COUNT(*) AS n FROM kids WHERE broken GROUP BY 1
    UNION ALL SELECT 'set-3 (Part 3)', 'missing document', COUNT(*) FROM supplier""")
def catalog_errors(spark, sf):
    return c.load_errors(t.documents(spark, sf)).groupBy("identifier", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("catalog_inline", "kids", """
    SELECT 'group-' || s_suppkey AS id, 'Collection' AS type, '1.0.0' AS stac_version,
           CASE WHEN s_suppkey % 7 <> 0 THEN 'CC-BY-4.0' ELSE 'various' END AS license, '' AS description, 6 AS n_links FROM supplier
    UNION ALL SELECT id, 'Collection', '1.0.0', 'various', '', 0 FROM kids WHERE NOT broken""")
def catalog_inline(spark, sf):
    full = c.with_defaults(c.parse(t.documents(spark, sf))).where("doc.id is not null")
    fields = [f"doc.{n}" for n in ("id", "type", "stac_version", "license", "description")]
    return full.select(*fields, F.size("doc.links").alias("n_links"))


@query("catalog_refresh", "kids", """
    SELECT 'kept' AS snapshot, COUNT(*) + (SELECT COUNT(*) FROM supplier) AS n FROM kids WHERE NOT broken
    UNION ALL SELECT 'replaced', COUNT(*) FROM supplier""")
def catalog_refresh(spark, sf):
    docs = t.documents(spark, sf)
    previous = c.collections(docs)
    empty = c.collections(docs.withColumn("value", F.lit("not json")))
    newer = previous.where("parent_id is null")
    kept, replaced = c.refresh(previous, empty), c.refresh(previous, newer)
    tagged = kept.withColumn("snapshot", F.lit("kept")).unionByName(replaced.withColumn("snapshot", F.lit("replaced")))
    return tagged.groupBy("snapshot").agg(F.count(F.lit(1)).alias("n"))


@query("catalog_list", "kids", """
    , failed AS (SELECT COUNT(*) FILTER (WHERE broken) + (SELECT COUNT(*) FROM supplier) AS n_failed FROM kids)
    SELECT 'group-' || s_suppkey AS id, s_name AS title, 'parent' AS kind, n_failed FROM supplier CROSS JOIN failed
    UNION ALL SELECT id, s_name || ' part ' || j, 'child', n_failed FROM kids CROSS JOIN failed WHERE NOT broken""")
def catalog_list(spark, sf):
    docs = t.documents(spark, sf)
    return c.list_collections(c.collections(docs), c.load_errors(docs))


@query("catalog_lookup", "kids", """
    , ids AS (SELECT 'group-' || s_suppkey AS id FROM supplier UNION ALL SELECT id FROM kids WHERE NOT broken),
    asked AS (SELECT unnest(['group-2', 'GROUP-1', 'SET-1', 'nowhere']) AS key)
    SELECT key, (SELECT id FROM ids WHERE id = key OR contains(lower(id), lower(key))
      ORDER BY CASE WHEN id = key THEN 0 WHEN starts_with(lower(id), lower(key)) THEN 1 ELSE 2 END, id LIMIT 1) AS id
    FROM asked WHERE key <> 'nowhere'""")
def catalog_lookup(spark, sf):
    table, out = c.collections(t.documents(spark, sf)), None
    for key in ("group-2", "GROUP-1", "SET-1", "nowhere"):
        hit = c.lookup(table, key).select(F.lit(key).alias("key"), "id")
        out = hit if out is None else out.unionByName(hit)
    return out


@query("catalog_lookup_all", "kids", """
    , ids AS (SELECT 'group-' || s_suppkey AS id FROM supplier UNION ALL SELECT id FROM kids WHERE NOT broken),
    asked AS (SELECT DISTINCT unnest(['GROUP-' || s_suppkey, s_suppkey || '-SET', CAST(s_suppkey AS VARCHAR), 'no-' || s_suppkey]) AS key FROM supplier)
    SELECT key, (SELECT id FROM ids WHERE id = key OR contains(lower(id), lower(key))
      ORDER BY CASE WHEN id = key THEN 0 WHEN starts_with(lower(id), lower(key)) THEN 1 ELSE 2 END, id LIMIT 1) AS id
    FROM asked WHERE EXISTS (SELECT 1 FROM ids WHERE contains(lower(id), lower(key)))""")
def catalog_lookup_all(spark, sf):
    """Four keys per supplier at once: a prefix, an inner part, a number, and one that names nothing."""
    k = F.col("s_suppkey").cast("string")
    asked = F.array(F.concat(F.lit("GROUP-"), k), F.concat(k, F.lit("-SET")), k, F.concat(F.lit("no-"), k))
    keys = t.table(spark, sf, "supplier").select(F.explode(asked).alias("key"))
    return c.lookup_all(c.collections(t.documents(spark, sf)), keys).select("key", "id")


@query("catalog_reach", sql="""
    WITH kids AS (SELECT s_suppkey, unnest(range(4)) AS j FROM supplier),
    found AS (
      SELECT 'reached' AS status, 0 AS depth
      UNION ALL SELECT 'reached', 1 FROM supplier WHERE s_suppkey % 11 <> 0
      UNION ALL SELECT CASE WHEN j < 3 THEN 'reached' ELSE 'missing' END, 2 FROM kids WHERE s_suppkey % 11 <> 0
      UNION ALL SELECT 'orphan', NULL FROM supplier WHERE s_suppkey % 11 = 0
      UNION ALL SELECT 'orphan', NULL FROM kids WHERE s_suppkey % 11 = 0 AND j < 3)
    SELECT status, depth, COUNT(*) AS n FROM found GROUP BY 1, 2""")
def catalog_reach(spark, sf):
    """From a root that lists all suppliers but every eleventh."""
    docs = t.documents(spark, sf)
    listed = docs.where(F.col("path").endswith("/stac-collection.json")).where(
        F.regexp_extract("path", r"catalog/(\d+)/", 1).cast("long") % 11 != 0
    )
    link = F.struct(F.lit("child").alias("rel"), F.col("path").alias("href"))
    root = listed.agg(F.collect_list(link).alias("links")).select(
        F.lit("https://data.example.org/catalog.json").alias("path"),
        F.to_json(F.struct(F.lit("Catalog").alias("type"), F.lit("root").alias("id"), "links")).alias("value"),
    )
    found = c.reachability(docs.unionByName(root), "https://data.example.org/catalog.json")
    return found.groupBy("status", "depth").agg(F.count(F.lit(1)).alias("n"))


@query("queryable_assets", "kids", """
    SELECT asset_id, asset_id IN ('flat', 'hex') AS queryable, COUNT(*) AS n FROM kids
    CROSS JOIN (SELECT unnest(['flat', 'hex', 'map', 'cover']) AS asset_id) WHERE NOT broken GROUP BY 1, 2""")
def queryable_assets(spark, sf):
    table = c.assets(t.documents(spark, sf))
    return table.groupBy("asset_id", c.is_queryable("href", "type").alias("queryable")).agg(F.count(F.lit(1)).alias("n"))


_STORE = "SELECT * FROM builtin_sources WHERE name = 'store'"


@query("asset_paths", "kids", """
    SELECT id AS collection_id, asset_id, storage || CASE asset_id WHEN 'flat' THEN '/flat.parquet' ELSE '/hex/**' END AS path,
           CASE WHEN k % 2 = 1 THEN 'minio.example.edu' END AS endpoint, CASE WHEN k % 2 = 1 THEN 's3://open' END AS scope,
           CASE WHEN asset_id = 'flat' AND k * 40000000 > 1048576 THEN printf('%.2f GiB', k * 40000000 / 1073741824.0::DOUBLE) ELSE '' END AS size_note
    FROM kids CROSS JOIN (SELECT unnest(['flat', 'hex']) AS asset_id) WHERE NOT broken""")
def asset_paths(spark, sf):
    paths = c.asset_paths(c.assets(t.documents(spark, sf)), t.builtin_sources(spark, sf))
    return paths.select("collection_id", "asset_id", "path", "endpoint", "scope", "size_note")


@query("column_dictionary", "kids", f"""
    SELECT id AS collection_id, name, MIN(type) AS type, MAX(description) AS description, MAX(CASE WHEN listed THEN 'a,b' END) AS "values",
           COUNT(*) AS n_assets FROM kids CROSS JOIN {_COLUMNS} WHERE NOT broken AND j <> 2 AND name <> 'geometry' GROUP BY 1, 2""")
def column_dictionary(spark, sf):
    out = c.column_dictionary(c.asset_columns(t.documents(spark, sf)))
    return out.withColumn("values", F.when(F.size("values") > 0, F.array_join("values", ",")))


@query("fallback_columns", "kids", """
    SELECT id AS collection_id, 'CODE' AS name, 'varchar' AS type, 'Code' AS description FROM kids WHERE NOT broken AND j = 2""")
def fallback_columns(spark, sf):
    docs = t.documents(spark, sf)
    out = c.fallback_columns(c.collection_columns(docs), c.asset_columns(docs))
    return out.select("collection_id", "name", "type", "description")


@query("parent_index", "kids", """
    SELECT parent_id, id AS collection_id, asset_id, storage || CASE asset_id WHEN 'flat' THEN '/flat.parquet' ELSE '/hex/**' END AS path
    FROM kids CROSS JOIN (SELECT unnest(['flat', 'hex']) AS asset_id) WHERE NOT broken""")
def parent_index(spark, sf):
    docs = t.documents(spark, sf)
    return c.parent_index(c.collections(docs), c.asset_paths(c.assets(docs), t.builtin_sources(spark, sf)))


@query("collection_record", "kids", """
    SELECT 'group-' || s_suppkey AS id, s_name AS title, 0 AS n_assets, 4 AS n_children, 1 AS n_links,
           CAST(NULL AS VARCHAR) AS first_href, CAST(NULL AS VARCHAR) AS first_endpoint, 0 AS n_columns FROM supplier
    UNION ALL SELECT id, s_name || ' part ' || j, 4, 0, 0, CASE WHEN k % 2 = 0 THEN storage ELSE root END || '/flat.parquet',
           CASE WHEN k % 2 = 1 THEN 'minio.example.edu' END, CASE WHEN j <> 2 THEN 4 ELSE 0 END
    FROM kids WHERE NOT broken""")
def collection_record(spark, sf):
    records = c.collection_records(t.documents(spark, sf), t.builtin_sources(spark, sf))

    def size(path):
        return F.coalesce(F.json_array_length(F.get_json_object("record", path)), F.lit(0))

    return records.select(
        "id", F.get_json_object("record", "$.title").alias("title"), size("$.assets").alias("n_assets"),
        size("$.children").alias("n_children"), size("$.links").alias("n_links"),
        F.get_json_object("record", "$.assets[0].href").alias("first_href"),
        F.get_json_object("record", "$.assets[0].s3_endpoint").alias("first_endpoint"),
        size("$.assets[0]['table:columns']").alias("n_columns"),
    )


@query("child_identifier", "customer_hrefs", r"""
    SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'f' || c_custkey || '.parquet (Part)' ELSE 'f' || c_custkey || ' (Part)' END AS name,
           CASE WHEN c_custkey % 2 = 0 THEN 'd' || c_custkey ELSE 'x' || c_custkey || '-stac' END AS bare FROM customer_hrefs""")
def child_identifier(spark, sf):
    k = F.col("c_custkey").cast("string")
    doc = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("https://a.example.org/d"), k, F.lit("/stac-collection.json")))
    doc = doc.otherwise(F.concat(F.lit("https://a.example.org/x"), k, F.lit("-stac.json")))
    return t.customer_hrefs(spark, sf).select(
        "c_custkey", c.child_identifier("href", F.lit("Part")).alias("name"), c.child_identifier(doc).alias("bare")
    )


_MERGED = """SELECT COALESCE(b.name, o.name) AS name, COALESCE(b.priority, o.priority) AS priority,
    COALESCE(o.https_prefix, b.https_prefix) AS https_prefix, COALESCE(o.s3_prefix, b.s3_prefix) AS s3_prefix,
    COALESCE(o.metadata_url_prefix, b.metadata_url_prefix) AS metadata_url_prefix
    FROM builtin_sources b FULL JOIN source_overrides o ON b.name = o.name WHERE NOT COALESCE(o.disabled, FALSE)"""


@query("source_registry", "builtin_sources source_overrides", _MERGED)
def source_registry(spark, sf):
    return r.merge_sources(t.builtin_sources(spark, sf), t.source_overrides(spark, sf))


@query("href_rewrite", "builtin_sources source_overrides customer_hrefs", f"""
    , m AS ({_MERGED})
    SELECT c_custkey, COALESCE(s3_prefix || substr(href, length(https_prefix) + 1), href) AS path,
           COALESCE(metadata_url_prefix || substr(href, length(https_prefix) + 1), href) AS document
    FROM customer_hrefs LEFT JOIN m ON starts_with(href, https_prefix)""")
def href_rewrite(spark, sf):
    sources = r.merge_sources(t.builtin_sources(spark, sf), t.source_overrides(spark, sf))
    paths = r.rewrite(t.customer_hrefs(spark, sf), "href", sources)
    return r.rewrite(paths, "href", sources, "metadata_url_prefix", "document").drop("href")


@query("route_hint", "customer_hrefs", """
    SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 's3://b' || c_nationkey || '/f' || c_custkey || '.parquet'
      WHEN 1 THEN 's3://b' || c_nationkey || '/f' || c_custkey WHEN 2 THEN 's3://d/f' || c_custkey || '/' END AS path,
      CASE c_custkey % 4 WHEN 0 THEN 'minio.example.edu' WHEN 1 THEN 's3.us-west-2.amazonaws.com'
      WHEN 2 THEN 'n' || c_nationkey || '.example.org' END AS endpoint,
      CASE c_custkey % 4 WHEN 0 THEN 's3://b' || c_nationkey WHEN 1 THEN 's3://b' || c_nationkey WHEN 2 THEN 's3://d' END AS scope
    FROM customer_hrefs""")
def route_hint(spark, sf):
    hints = t.customer_hrefs(spark, sf).select("c_custkey", r.route_hint("href").alias("h"))
    return hints.select("c_custkey", "h.path", "h.endpoint", "h.scope")
