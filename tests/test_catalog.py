import json

from pyspark.sql import functions as F

from hexweave.session import fresh_dir
from hexweave.sources import catalog as c
from hexweave.sources import registry as r


def write_docs(spark, docs):
    """Store documents under their names and return (path, value) as read back."""
    root = fresh_dir(spark, "docs")
    for name, text in docs.items():
        body = text if isinstance(text, str) else json.dumps(text)
        spark.createDataFrame([(body,)], "value string").coalesce(1).write.text(f"{root}/{name}")
    return c.read_documents(spark, f"{root}/*").withColumn(
        "path", F.concat(F.lit("https://x.example.org/"), F.regexp_extract("path", r".*/([^/]+)/part-", 1), F.lit(".json"))
    )


def test_partial_catalogue(spark):
    docs = write_docs(spark, {
        "lakes": {"id": "lakes", "title": "Lakes", "links": [
            {"rel": "child", "href": "https://x.example.org/upper.json"},
            {"rel": "child", "href": "https://x.example.org/gone.json", "title": "Lost"},
            {"rel": "self", "href": "https://x.example.org/lakes.json"}]},
        "upper": {"id": "upper", "links": [], "table:columns": [{"name": "CODE", "type": "string"}, {"name": "geom", "type": "binary"}],
                  "assets": {"hex": {"href": "https://x.example.org/upper/hex/", "type": "application/x-parquet"}}},
        "broken": "{\"id\": \"bro",
    })
    table = {row.id: row for row in c.collections(docs).collect()}
    assert set(table) == {"lakes", "upper"} and table["upper"].parent_id == "lakes" and table["upper"].title == "upper"
    assert {(e.identifier, e.reason) for e in c.load_errors(docs).collect()} == {
        ("broken", "unreadable document"), ("gone (Lost)", "missing document")
    }
    columns = c.fallback_columns(c.collection_columns(docs), c.asset_columns(docs))
    assert [row.name for row in columns.collect()] == ["CODE"]


def test_lookup_order(spark):
    table = spark.createDataFrame([("rivers-2020-large", "a"), ("large", "b"), ("all-rivers", "c")], "id string, title string")
    assert c.lookup(table, "large").first().id == "large"
    assert c.lookup(table, "RIVERS").first().id == "rivers-2020-large"
    assert c.lookup(table, "l-riv").first().id == "all-rivers"
    assert c.lookup(table, "absent").count() == 0


def test_routes(spark):
    cases = {
        "https://minio.example.edu/bucket/a/b.parquet": ("s3://bucket/a/b.parquet", "minio.example.edu", "s3://bucket"),
        "https://data.s3.us-west-2.amazonaws.com/k/v": ("s3://data/k/v", "s3.us-west-2.amazonaws.com", "s3://data"),
        "https://data.s3.amazonaws.com/k": ("s3://data/k", "s3.amazonaws.com", "s3://data"),
        "https://host/bucket": None, "http://host/bucket/key": None, "s3://bucket/key": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "href string").select("href", r.route_hint("href").alias("h")).collect()
    assert {row.href: tuple(row.h) if row.h else None for row in rows} == cases


def test_rewrite_takes_the_first_prefix(spark):
    sources = spark.createDataFrame([
        ("a", 2, "https://h.example/", "s3://", "http://in/"), ("b", 1, "https://h.example/deep/", "s3://deep-", None),
    ], "name string, priority bigint, https_prefix string, s3_prefix string, metadata_url_prefix string")
    hrefs = spark.createDataFrame([("https://h.example/deep/x",), ("https://h.example/y",), ("https://other/z",), (None,)], "href string")
    got = {row.href: row.path for row in r.rewrite(hrefs, "href", sources).collect()}
    assert got == {"https://h.example/deep/x": "s3://deep-x", "https://h.example/y": "s3://y", "https://other/z": "https://other/z", None: None}


def test_overrides(spark):
    schema = "name string, priority bigint, https_prefix string, s3_prefix string, metadata_url_prefix string"
    builtin = spark.createDataFrame([("a", 1, "https://a/", "s3://a/", None), ("b", 2, "https://b/", "s3://b/", None)], schema)
    over = spark.createDataFrame([
        ("a", None, None, "s3://new/", None, False), ("b", None, None, None, None, True),
        ("c", 3, "https://c/", "s3://c/", None, None), (None, 9, "https://d/", "s3://d/", None, None),
    ], schema + ", disabled boolean")
    got = {row.name: (row.https_prefix, row.s3_prefix) for row in r.merge_sources(builtin, over).collect()}
    assert got == {"a": ("https://a/", "s3://new/"), "c": ("https://c/", "s3://c/")}


def test_refresh_keeps_the_last_good_snapshot(spark):
    old, new = spark.range(3), spark.range(5)
    assert c.refresh(old, new.where("false")).count() == 3 and c.refresh(old, new).count() == 5


def test_child_identifiers(spark):
    cases = {
        "https://x/y/dir/stac-collection.json": "dir", "https://x/y/foo-stac.json": "foo-stac", "https://x/name/": "name",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "href string").select("href", c.child_identifier("href").alias("n")).collect()
    assert {row.href: row.n for row in rows} == cases


def test_links_of_stored_documents(spark):
    """Relative and https links lead to the files the documents were read from; the root catalogue is no parent."""
    root = fresh_dir(spark, "stored")
    web = "https://meta.example.org/c/"
    docs = {
        "catalog": {"type": "Catalog", "id": "all", "links": [{"rel": "child", "href": "./lakes/"}]},
        "lakes": {"id": "lakes", "links": [{"rel": "child", "href": "../kid"}, {"rel": "child", "href": f"{web}far"}]},
        "kid": {"id": "kid"}, "far": {"id": "far"},
    }
    for name, doc in docs.items():
        spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.text(f"{root}/{name}")
    at = c.read_documents(spark, f"{root}/*")
    folder = F.regexp_replace("path", r"/part-[^/]*$", "")
    docs = at.withColumn("path", F.when(folder.endswith("lakes"), F.concat(folder, F.lit("/"))).otherwise(folder))
    sources = spark.createDataFrame(
        [("meta", 1, web, None, f"{root}/")], "name string, priority int, https_prefix string, s3_prefix string, metadata_url_prefix string"
    ).withColumn("metadata_url_prefix", F.concat(F.lit("file:"), F.regexp_replace("metadata_url_prefix", "^file:/*", "/")))
    parents = {row.id: row.parent_id for row in c.collections(docs, sources).collect()}
    assert parents == {"lakes": None, "kid": "lakes", "far": "lakes"}
    assert c.load_errors(docs, sources).collect() == []


def test_addresses(spark):
    cases = [
        ("file:///a/b/c.json", "./kid/x.json", "file:/a/b/kid/x.json"), ("s3a://b/k/c.json", "../x.json", "s3a://b/x.json"),
        ("https://h/a/c.json", "/root.json", "https://h/root.json"), ("https://h/a/", "https://o/z.json", "https://o/z.json"),
    ]
    rows = spark.createDataFrame(cases, "b string, h string, want string").select(c.resolve(F.col("b"), F.col("h")).alias("got"), "want")
    assert all(row.got == row.want for row in rows.collect())


def test_prefixes_that_end_inside_a_host(spark):
    sources = spark.createDataFrame(
        [("a", 2, "https://data.", "s3://any/"), ("b", 1, "https://data.example.org/x/", "s3://x/")],
        "name string, priority int, https_prefix string, s3_prefix string",
    )
    hrefs = spark.createDataFrame([("https://data.example.org/k",), ("https://data.example.org/x/k",), ("https://other/k",)], "href string")
    got = {row.href: row.path for row in r.rewrite(hrefs, "href", sources).collect()}
    assert got == {
        "https://data.example.org/k": "s3://any/example.org/k", "https://data.example.org/x/k": "s3://x/k", "https://other/k": "https://other/k",
    }


def test_dual_stack_hosts(spark):
    cases = {
        "https://b.s3.dualstack.eu-west-1.amazonaws.com/k": "s3.dualstack.eu-west-1.amazonaws.com",
        "https://a.b.s3-us-west-2.amazonaws.com/k": "s3-us-west-2.amazonaws.com",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "href string").select("href", r.route_hint("href").alias("h")).collect()
    assert {row.href: row.h.endpoint for row in rows} == cases
