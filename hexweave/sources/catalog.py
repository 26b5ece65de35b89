"""Dataset catalogue: collection JSON documents as tables, and queries on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexweave.functions.cells import as_column
from hexweave.operators.sizing import shuffle_width, shuffled
from hexweave.session import fresh_dir, materialize
from hexweave.sources.registry import rewrite, route_hint

COLUMN_DDL = "array<struct<name:string,type:string,description:string,values:array<string>>>"
COLLECTION_DDL = f"""
    type string, stac_version string, id string, title string, description string,
    license string, keywords array<string>,
    providers array<struct<name:string,description:string,roles:array<string>,url:string>>,
    extent struct<spatial:struct<bbox:array<array<double>>>,temporal:struct<interval:array<array<string>>>>,
    links array<struct<rel:string,href:string,title:string>>,
    assets map<string,struct<href:string,type:string,title:string,description:string,
        `file:size`:bigint,`h3:native_resolution`:int,`table:columns`:{COLUMN_DDL}>>,
    `table:columns` {COLUMN_DDL}
"""
# Link relations that only navigate, hidden columns, defaults.
NAVIGATION = ["root", "parent", "self", "child", "item"]
HIDDEN_COLUMNS = ["geometry", "geom", "bbox"]
DEFAULTS = {"type": "Collection", "stac_version": "1.0.0", "license": "various", "description": ""}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(path, value)`` for every JSON document below ``path``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), "value"
    )


def parse(docs: DataFrame) -> DataFrame:
    """Documents with a parsed ``doc`` struct; its id is NULL when parsing failed."""
    return docs.withColumn("doc", F.from_json("value", COLLECTION_DDL))


def with_defaults(parsed: DataFrame) -> DataFrame:
    """Fill the envelope fields a hand-written collection may leave out."""
    doc = F.col("doc")
    for name, value in DEFAULTS.items():
        doc = doc.withField(name, F.coalesce(F.col(f"doc.{name}"), F.lit(value)))
    empty = F.from_json(F.lit("[]"), "array<struct<rel:string,href:string,title:string>>")
    doc = doc.withField("links", F.coalesce(F.col("doc.links"), empty))
    return parsed.withColumn("doc", doc)


def address(path: Column) -> Column:
    """One spelling of a document's address: ``.`` and ``..`` resolved, one slash after ``file:``."""
    scheme = F.regexp_extract(path, r"^([a-z0-9+.-]+:/*)", 1)
    parts = F.split(F.substring(path, F.char_length(scheme) + 1, F.char_length(path)), "/", -1)
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done).when(
            s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        ).otherwise(F.concat(done, F.array(s))),
    )
    return F.concat(F.regexp_replace(scheme, "^file:/+$", "file:/"), F.array_join(kept, "/"))


def resolve(base: Column, href: Column) -> Column:
    """Address of a link in the document at ``base``: absolute, from the host's root, or relative."""
    host = F.regexp_extract(base, r"^([a-z0-9+.-]+:/*[^/]*)", 1)
    folder = F.regexp_replace(base, "[^/]*$", "")
    full = F.when(href.rlike(r"^[a-z0-9+.-]+:"), href).when(href.startswith("/"), F.concat(host, href))
    return address(F.coalesce(full, F.concat(folder, href)))


def _is_root(doc: str = "doc") -> Column:
    return F.coalesce(F.col(f"{doc}.type") == "Catalog", F.lit(False))


def child_links(parsed: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """``(parent_id, href, title, from_root)`` of every child link, with the address it leads to.

    ``sources`` is the source registry: where it has a ``metadata_url_prefix``, an https link leads to
    the place the catalogue's documents are read from. Links of the root catalogue are marked.
    """
    links = (
        parsed.where(F.col("doc.id").isNotNull())
        .select("path", F.col("doc.id").alias("parent_id"), _is_root().alias("from_root"), F.col("doc.links").alias("_links"))
        .select("path", "parent_id", "from_root", F.explode("_links").alias("l"))  # links do not carry their document
        .where("l.rel = 'child'")
        .select("parent_id", resolve(F.col("path"), F.col("l.href")).alias("href"), F.col("l.title").alias("title"), "from_root")
    )
    if sources is None:
        return links
    stored = rewrite(links, "href", sources, "metadata_url_prefix", "stored")
    return stored.select("parent_id", address(F.col("stored")).alias("href"), "title", "from_root")


def collections(docs: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Every collection with its parent. The root catalogue is no collection, and what it lists has no parent."""
    parsed = parse(docs).where(F.col("doc.id").isNotNull()).withColumn("address", address(F.col("path")))
    links = child_links(parsed, sources).where(~F.col("from_root")).select("parent_id", F.col("href").alias("address"))
    return parsed.where(~_is_root()).join(shuffled(links), "address", "left").select(
        F.col("doc.id").alias("id"),
        F.coalesce("doc.title", "doc.id").alias("title"),
        F.col("doc.description").alias("description"),
        F.col("doc.license").alias("license"),
        "parent_id", "path",
    )


def _assets(docs: DataFrame) -> DataFrame:
    parsed = parse(docs).where(F.col("doc.id").isNotNull())
    return parsed.select(
        F.col("doc.id").alias("collection_id"),
        F.posexplode("doc.assets").alias("position", "asset_id", "a"),
    )


def assets(docs: DataFrame) -> DataFrame:
    return _assets(docs).select(
        "collection_id", "asset_id", "position", F.col("a.href").alias("href"),
        F.coalesce("a.type", F.lit("")).alias("type"),
        F.coalesce("a.title", "asset_id").alias("title"),
        F.col("a.description").alias("description"),
        F.col("a.`file:size`").alias("size"),
        F.col("a.`h3:native_resolution`").alias("native_resolution"),
    )


def asset_columns(docs: DataFrame) -> DataFrame:
    """Columns that assets describe, in asset order."""
    cols = _assets(docs).select(
        "collection_id", "asset_id", F.col("position").alias("asset_position"),
        F.col("a.href").alias("href"), F.coalesce("a.type", F.lit("")).alias("asset_type"),
        F.posexplode("a.`table:columns`").alias("position", "c"),
    )
    return cols.select("collection_id", "asset_id", "asset_position", "href", "asset_type", "position", "c.*")


def collection_columns(docs: DataFrame) -> DataFrame:
    """Columns described on the collection itself."""
    parsed = parse(docs).where(F.col("doc.id").isNotNull())
    return parsed.select(
        F.col("doc.id").alias("collection_id"), F.posexplode("doc.`table:columns`").alias("position", "c")
    ).select("collection_id", "position", "c.*")


def child_identifier(href: Column | str, title: Column | None = None) -> Column:
    """Name of a child whose document could not be read, from its address."""
    href = as_column(href)
    parts = F.filter(F.split(F.rtrim(href, F.lit("/")), "/"), lambda s: s != "")
    tail, before = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))
    generic = tail.isin("stac-collection.json", "catalog.json")
    name = F.when(generic, F.coalesce(before, tail)).otherwise(F.regexp_replace(tail, r"\.json$", ""))
    if title is None:
        return F.coalesce(name, href)
    redundant = title.isNull() | (title == "") | F.lower(name).contains(F.lower(title))
    return F.coalesce(
        F.when(redundant, name).otherwise(F.concat(name, F.lit(" ("), title, F.lit(")"))), title, href
    )


def load_errors(docs: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Documents that gave no collection, and child links that lead nowhere."""
    parsed = parse(docs)
    bad = parsed.where(F.col("doc.id").isNull()).select(
        child_identifier("path").alias("identifier"), F.lit("unreadable document").alias("reason")
    )
    links = child_links(parsed, sources)
    missing = links.join(docs.select(address(F.col("path")).alias("href")), "href", "left_anti").select(
        child_identifier("href", F.col("title")).alias("identifier"), F.lit("missing document").alias("reason")
    )
    return bad.unionByName(missing)


def is_queryable(href: Column | str, kind: Column | str) -> Column:
    """True for assets that are tables: not tile archives, not images."""
    href, kind = as_column(href), as_column(kind)
    tiles = kind.contains("pmtiles") | href.endswith(".pmtiles")
    image = kind.contains("tif") | href.endswith(".tif") | href.endswith(".tiff")
    table = kind.contains("parquet") | href.endswith(".parquet") | href.endswith("/") | href.contains("/hex/")
    return ~tiles & ~image & table


def asset_paths(asset_table: DataFrame, sources: DataFrame) -> DataFrame:
    """Readable path of every queryable asset, with a size note and a route hint."""
    tables = asset_table.where(is_queryable("href", "type"))
    tables = rewrite(tables, "href", sources)
    hint = F.when(F.col("path").startswith("http"), route_hint("path"))
    gib = F.col("size") / F.lit(1024.0**3)
    return (
        tables.withColumn("hint", hint)
        .withColumn("path", F.coalesce("hint.path", "path"))
        .withColumn(
            "path",
            F.when(F.col("path").endswith("/"), F.concat(F.rtrim(F.col("path"), F.lit("/")), F.lit("/**")))
            .otherwise(F.col("path")),
        )
        .withColumn("endpoint", F.col("hint.endpoint")).withColumn("scope", F.col("hint.scope"))
        .withColumn(
            "size_note",
            F.when(F.col("size") > 1024**2, F.format_string("%.2f GiB", gib)).otherwise(F.lit("")),
        )
        .drop("hint")
    )


def _filled(c: str) -> Column:
    return F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))


def column_dictionary(columns: DataFrame) -> DataFrame:
    """One row per column name of a collection across its queryable assets.

    The first asset's value of each field wins and later ones fill gaps; geometry
    columns are hidden.
    """
    order = F.struct("asset_position", "position")
    shown = columns.where(
        is_queryable("href", "asset_type") & F.col("name").isNotNull()
        & ~F.lower("name").isin(HIDDEN_COLUMNS)
    )

    def first(c: str, present: Column) -> Column:
        return F.min_by(F.col(c), F.when(present, order)).alias(c)

    return shown.groupBy("collection_id", "name").agg(
        first("type", _filled("type").isNotNull()),
        first("description", _filled("description").isNotNull()),
        first("values", F.size("values") > 0),
        F.count(F.lit(1)).alias("n_assets"),
    )


def fallback_columns(collection_cols: DataFrame, columns: DataFrame) -> DataFrame:
    """Collection-level columns, only where no queryable asset describes its own."""
    described = columns.where(is_queryable("href", "asset_type")).select("collection_id").distinct()
    return collection_cols.join(described, "collection_id", "left_anti").where(
        ~F.lower("name").isin(HIDDEN_COLUMNS)
    )


def list_collections(collection_table: DataFrame, errors: DataFrame) -> DataFrame:
    """Every collection with its kind, and the number that failed to load."""
    failed = errors.agg(F.count(F.lit(1)))
    kind = F.when(F.col("parent_id").isNull(), "parent").otherwise("child")
    return collection_table.select("id", "title", kind.alias("kind"), failed.scalar().alias("n_failed"))


def lookup(collection_table: DataFrame, key: str) -> DataFrame:
    """The collection a key names: exact id, else prefix, else substring.

    Prefix and substring ignore case; the first id in order wins.
    """
    low = F.lower("id")
    rank = (
        F.when(F.col("id") == key, 0).when(low.startswith(key.lower()), 1).when(low.contains(key.lower()), 2)
    )
    hits = collection_table.withColumn("_r", rank).where("_r is not null")
    best = F.struct("_r", "id")
    return hits.agg(F.min_by("id", best).alias("id"), F.min_by("title", best).alias("title")).where("id is not null")


GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """Distinct pieces of ``size`` characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(text) - size + 1))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def lookup_all(collection_table: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """(key, id, title) for every distinct key that names a collection, by the rules of `lookup`.

    An inverted index of the ids' pieces of `GRAM` characters gives the candidates: those of the key's rarest piece, which
    are then compared with the whole key. A key no longer than a piece is a piece itself, and its answer is the least
    id of that piece's list, found once for all keys. NULL keys name nothing. No join broadcasts ids or keys, as their bytes tell
    little of their size.
    """
    named = collection_table.where("id is not null").select("id", "title", F.lower("id").alias("_low"))
    # An id's row becomes a row per piece: AQE would leave them all to few tasks.
    named = named.repartition(shuffle_width(named.sparkSession), "id")
    asked = keys.select(F.col(key).alias("key")).where("key is not null").distinct().withColumn("_key", F.lower("key"))
    exact = asked.join(shuffled(named), F.col("key") == F.col("id")).select("key", F.lit(0).alias("_r"), "id", "title")

    # Short keys: the best id of each piece of up to GRAM characters.
    def ranked(text: Column, low: Column) -> Column:
        return F.when(low.startswith(text), 1).otherwise(2)

    sizes = F.array(*[F.lit(n) for n in range(GRAM + 1)])
    pieces = F.flatten(F.transform(sizes, lambda n: F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("_low") - n + 1)), lambda i: F.substring(F.col("_low"), i, n))))
    best = named.select("id", "title", "_low", F.explode(F.array_distinct(pieces)).alias("_key")).groupBy("_key").agg(
        F.min(F.struct(ranked(F.col("_key"), F.col("_low")).alias("_r"), "id", "title")).alias("b")
    )
    short = asked.where(F.char_length("_key") <= GRAM).join(shuffled(best), "_key").select("key", "b.*")

    # Longer keys: the candidates of their rarest piece.
    postings = named.select("id", "title", "_low", F.explode(_grams(F.col("_low"), GRAM)).alias("_gram"))
    counts = postings.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    long = asked.where(F.char_length("_key") > GRAM).withColumn("_size", F.size(_grams(F.col("_key"), GRAM)))
    met = long.select("key", "_key", "_size", F.explode(_grams(F.col("_key"), GRAM)).alias("_gram")).join(shuffled(counts), "_gram")
    rarest = met.groupBy("key", "_key", "_size").agg(
        F.min(F.struct("_n", "_gram")).alias("g"), F.count(F.lit(1)).alias("_found")
    ).where(F.col("_found") == F.col("_size")).select("key", "_key", F.col("g._gram").alias("_gram"))
    hits = rarest.join(shuffled(postings), "_gram").where(F.col("_low").contains(F.col("_key")))
    other = hits.select("key", ranked(F.col("_key"), F.col("_low")).alias("_r"), "id", "title")

    every = exact.unionByName(short).unionByName(other)
    return every.groupBy("key").agg(F.min(F.struct("_r", "id", "title")).alias("b")).select("key", "b.id", "b.title")


def reachability(docs: DataFrame, root: str, sources: DataFrame | None = None) -> DataFrame:
    """(address, status, depth): what child links lead to from the document at ``root``, and what they do not.

    ``reached`` documents have the number of links on their shortest way; ``missing`` addresses are linked from a reached
    document and have none; ``orphan`` documents are not led to; ``cycle`` rows repeat the reached documents that
    lie on a cycle of links, or between two. One join per tier, each frontier written; documents met before are not met again.
    Addresses are many and compress well, so no join broadcasts them.
    """
    spark, folder = docs.sparkSession, fresh_dir(docs.sparkSession, "reach")
    parsed = parse(docs).where(F.col("doc.id").isNotNull()).withColumn("doc", F.col("doc").withField("id", address(F.col("path"))))
    child_links(parsed, sources).select(F.col("parent_id").alias("a"), F.col("href").alias("b")).distinct().write.parquet(f"{folder}/links")
    links = spark.read.schema("a string, b string").parquet(f"{folder}/links")
    here = materialize(docs.select(address(F.col("path")).alias("address")).distinct(), "documents")

    start = spark.range(1).select(address(F.lit(root)).alias("address"), F.lit(0).alias("depth"))
    start.write.parquet(f"{folder}/tier=0")
    depth = 0
    while True:
        read = spark.read.schema("address string, depth int").parquet
        met, last = read(*[f"{folder}/tier={d}" for d in range(depth + 1)]), read(f"{folder}/tier={depth}")
        if last.isEmpty():
            break
        depth += 1
        further = links.join(shuffled(last.select(F.col("address").alias("a"))), "a", "left_semi").select(F.col("b").alias("address")).distinct()
        further.join(shuffled(met), "address", "left_anti").select("address", F.lit(depth).alias("depth")).write.parquet(f"{folder}/tier={depth}")
    reached, missing = met.join(shuffled(here), "address", "left_semi"), met.join(shuffled(here), "address", "left_anti")
    orphans = here.join(shuffled(met), "address", "left_anti")

    # Links from reached documents, without those that begin or end where no other link leads on.
    core, turn = links.join(shuffled(met.select(F.col("address").alias("a"))), "a", "left_semi"), 0
    core.write.parquet(f"{folder}/core0")
    size = -1
    while True:
        core = spark.read.schema("a string, b string").parquet(f"{folder}/core{turn}")
        now = core.count()
        if now in (0, size):
            break
        size, turn = now, turn + 1
        inner = core.join(shuffled(core.select(F.col("a").alias("b")).distinct()), "b", "left_semi")
        inner.join(shuffled(core.select(F.col("b").alias("a")).distinct()), "a", "left_semi").select("a", "b").write.parquet(f"{folder}/core{turn}")
    cyclic = core.select(F.col("a").alias("address")).distinct().join(shuffled(reached), "address")

    def with_status(df: DataFrame, status: str, known: bool = True) -> DataFrame:
        return df.select("address", F.lit(status).alias("status"), F.col("depth") if known else F.lit(None).cast("int").alias("depth"))

    return with_status(reached, "reached").unionByName(with_status(missing, "missing")).unionByName(
        with_status(orphans, "orphan", False)
    ).unionByName(with_status(cyclic, "cycle"))


def parent_index(collection_table: DataFrame, paths: DataFrame) -> DataFrame:
    """Child collections of every parent with their asset paths, no columns."""
    children = collection_table.where("parent_id is not null").select("parent_id", F.col("id").alias("collection_id"))
    return children.join(paths.select("collection_id", "asset_id", "path"), "collection_id")


def refresh(previous: DataFrame, current: DataFrame) -> DataFrame:
    """The new snapshot, or the previous one when the new one is empty."""
    return previous if current.isEmpty() else current


def collection_records(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Every collection as one JSON record with storage paths instead of hrefs.

    Queryable assets on unknown hosts keep their href and get a route hint.
    Assets are regrouped by the document they came from, so a group is never
    larger than one input row.
    """
    parsed = with_defaults(parse(docs).where(F.col("doc.id").isNotNull()))
    each = parsed.select("path", F.posexplode("doc.assets").alias("position", "asset_id", "a"))
    flat = each.select(F.col("path").alias("doc_path"), "position", "asset_id", "a.*")
    paths = rewrite(flat, "href", sources, out="storage")
    unknown = F.col("storage").startswith("http") & is_queryable("href", F.coalesce("type", F.lit("")))
    paths = paths.withColumn("hint", F.when(unknown, route_hint("storage")))
    entry = F.struct(
        "position", "asset_id", F.col("storage").alias("href"), "type", "title", "description",
        F.col("hint.path").alias("s3_href"), F.col("hint.endpoint").alias("s3_endpoint"),
        F.col("hint.scope").alias("s3_scope"), "file:size", "h3:native_resolution", "table:columns",
    )
    grouped = paths.groupBy(F.col("doc_path").alias("path")).agg(F.sort_array(F.collect_list(entry)).alias("assets"))
    links = F.filter("doc.links", lambda l: ~l["rel"].isin(NAVIGATION))
    children = F.transform(F.filter("doc.links", lambda l: l["rel"] == "child"), lambda l: l["href"])
    record = F.struct(
        F.col("doc.id").alias("id"), F.col("doc.title").alias("title"),
        F.col("doc.description").alias("description"), F.col("doc.license").alias("license"),
        F.coalesce("doc.keywords", F.array().cast("array<string>")).alias("keywords"),
        F.col("doc.providers").alias("providers"), F.col("doc.extent").alias("extent"),
        links.alias("links"),
        F.transform("assets", lambda a: a.dropFields("position")).alias("assets"),
        F.col("doc.`table:columns`").alias("table:columns"),
        children.alias("children"),
    )
    return parsed.join(grouped, "path", "left").select(F.col("doc.id").alias("id"), F.to_json(record).alias("record"))
