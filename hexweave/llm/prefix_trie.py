"""Conversation prefix trie by whole-sequence collapse.

Rebuilt conversations that are equal become one weighted sequence with the list of its ends. A sequence that is a
proper prefix of another is found by an anti-join; those that are not are the leaves. Nodes are the weighted
prefixes, added up. So the rows that move are the turns of distinct sequences, without their texts.

A node is named by its depth and the sum, over its turns, of hashes of (place, role, text): two sums of 64-bit
hashes. Sums run along a conversation in blocks, so that one of any length is spread over tasks; turns are numbered
after a sort by ranges, which splits a long conversation too.

What is saved below a node needs no pairs of nodes: every node belongs to one leaf that passes it, each leaf sums
what belongs to it from its end upwards, and a node adds up its leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hexweave.llm.common import pick, words
from hexweave.session import fresh_dir

# Conversations that share a beginning, and how many turns of it at most.
FAMILY = 20
HEADS = 4
BLOCK = 4096


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(turns: DataFrame, folder: str) -> DataFrame:
    """``turns`` of known conversations with ``pos``, their place from 1: by turn (NULL first), role and text."""
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    # The last key deals equal turns to several ranges as well.
    ranged = turns.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, "conv_id", *order, "_row")
    placed = _write(ranged.withColumn("_part", F.spark_partition_id()), f"{folder}/placed")
    sizes = placed.groupBy("conv_id", "_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # Only conversations that cross a border have a part that does not start at 0.
    starts = sizes.withColumn("_start", F.sum("_n").over(ahead)).where("_start is not null").drop("_n")
    inside = Window.partitionBy("conv_id", "_part").orderBy(*order, "_row")
    return placed.withColumn("pos", F.row_number().over(inside).cast("long")).join(starts, ["conv_id", "_part"], "left").withColumn(
        "pos", F.col("pos") + F.coalesce("_start", F.lit(0))
    ).drop("_row", "_part", "_start")


def running(rows: DataFrame, group: str, place: str, sums: list[str], folder: str) -> DataFrame:
    """``rows`` with each of ``sums`` replaced by its sum over the group's rows up to that place."""
    blocked = _write(rows.withColumn("_block", F.floor(F.col(place) / BLOCK)), folder)
    totals = blocked.groupBy(group, "_block").agg(*[F.sum(c).alias(c) for c in sums])
    ahead = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(group, "_block", *[F.sum(c).over(ahead).alias(f"_{c}") for c in sums]).where(
        F.col(f"_{sums[0]}").isNotNull()
    )
    inside = Window.partitionBy(group, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    out = blocked.withColumns({c: F.sum(c).over(inside) for c in sums}).join(carried, [group, "_block"], "left")
    return out.withColumns(
        {c: (F.col(c) + F.coalesce(f"_{c}", F.lit(0))).cast(blocked.schema[c].dataType) for c in sums}
    ).drop("_block", *[f"_{c}" for c in sums])


def heads_of(conv_id: str) -> Column:
    return F.crc32(F.col(conv_id).cast("string").cast("binary")) % HEADS


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations, and their rebuilt turns (conv_id, pos, and the further columns of ``turns``).

    The first h turns come from the head of the family, all it has if fewer; the own turns after the first h follow.
    """
    convs = turns.select("conv_id").distinct().withColumn("_h", heads_of("conv_id")).withColumn(
        "_head", F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))
    )
    rest = [c for c in turns.columns if c not in ("conv_id", "pos")]
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv_id", "_head")
    begun = convs.join(heads, "_head").where("pos <= _h").select("conv_id", "pos", *rest)
    taken = begun.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_taken"))
    own = turns.withColumn("_h", heads_of("conv_id")).where("pos > _h").join(taken, "conv_id", "left")
    own = own.select("conv_id", (F.col("pos") - F.col("_h") + F.coalesce("_taken", F.lit(0))).alias("pos"), *rest)
    return convs.select("conv_id"), begun.unionByName(own)


def _key(*sums: str) -> Column:
    """Name of a node: 128 bits of its depth and sums."""
    parts = [F.col(c).cast("string") for c in sums]
    return F.unhex(F.md5(F.concat_ws(" ", *parts).cast("binary")))


def end_lists(ends: DataFrame) -> DataFrame:
    """key and ``ends_sha256`` of the ids (key, conv_id), ascending and comma-joined.

    Ids are joined to texts in blocks of neighbouring ids. A list of several blocks is hashed block after block, in
    the order of the sort, so a task holds one block whatever the list's length.
    """
    blocks = ends.groupBy("key", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )
    several = blocks.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    single = blocks.join(several, "key", "left_anti").select("key", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for key, ids in zip(batch["key"], batch["ids"], strict=True):
                key = bytes(key)
                if key == last:
                    state.update(b",")
                elif last is not None:
                    done.append((last, state.hexdigest()))
                if key != last:
                    last, state = key, hashlib.sha256()
                state.update(ids.encode())
            yield pd.DataFrame(done, columns=["key", "ends_sha256"])
        if last is not None:
            yield pd.DataFrame([(last, state.hexdigest())], columns=["key", "ends_sha256"])

    many = blocks.join(several, "key", "left_semi").repartition("key").sortWithinPartitions("key", "block")
    return single.unionByName(many.select("key", "ids").mapInPandas(run, "key binary, ends_sha256 string"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations.

    Rows of a NULL conv_id belong to no conversation. Turns that tie are ordered by role and then text; repeated rows
    are turns of their own. NULL role or text is the empty one, so it equals it. A conversation without a turn left
    ends at the root. Below 0 a family is its 20 ids from a multiple of 20 upwards, too. An empty table has no root and gives an empty result. Other columns are ignored.
    """
    spark: SparkSession = conversations.sparkSession
    folder = fresh_dir(spark, "trie")
    turns = pick(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    # From here on a turn is two hashes and a number of words.
    placed = numbered(turns, folder).select(
        "conv_id", "pos", F.xxhash64("role", "text").alias("a"), F.xxhash64("text", F.lit(1), "role").alias("b"),
        F.size(words(F.col("text"))).cast("long").alias("words"),
    )
    convs, whole = rebuilt(_write(placed, f"{folder}/turns"))
    whole = whole.select(
        "conv_id", F.col("pos").alias("depth"), "words",
        *[F.xxhash64("pos", c).cast("decimal(38,0)").alias(c) for c in ("a", "b")],
        *[F.xxhash64("pos", c).cast("decimal(38,0)").alias(f"own_{c}") for c in ("a", "b")],
    )
    summed = running(whole, "conv_id", "depth", ["a", "b"], f"{folder}/whole")
    before = summed.withColumns({f"up_{c}": F.col(c) - F.col(f"own_{c}") for c in "ab"}).withColumn("up", F.col("depth") - 1)
    zero = F.lit(0).cast("decimal(38,0)")
    root = spark.range(1).select(F.lit(0).cast("long").alias("depth"), zero.alias("a"), zero.alias("b")).select(
        _key("depth", "a", "b").alias("root")
    )
    path = _write(
        before.select("conv_id", "depth", "words", _key("depth", "a", "b").alias("key"), _key("up", "up_a", "up_b").alias("parent")),
        f"{folder}/path",
    )

    # Whole sequences: their weights, first members, ends.
    deepest = path.groupBy("conv_id").agg(F.max(F.struct("depth", "key")).alias("last"))
    ends = _write(
        convs.join(deepest, "conv_id", "left").withColumn("root", root.scalar()).select(
            "conv_id", F.coalesce("last.key", "root").alias("key"), F.coalesce("last.depth", F.lit(0)).alias("length")
        ), f"{folder}/ends",
    )
    sequences = ends.groupBy("key", "length").agg(F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("first"))
    on_paths = sequences.select("key", "weight", F.col("first").alias("conv_id"))
    steps = path.join(on_paths.select("conv_id", "weight"), "conv_id")
    longer = steps.select(F.col("parent").alias("key")).distinct()  # the ends of proper prefixes
    leaves = on_paths.join(longer, "key", "left_anti").select("conv_id", F.lit(True).alias("leaf"))
    marked = on_paths.select("conv_id", "weight").join(leaves, "conv_id", "left").withColumn("leaf", F.coalesce("leaf", F.lit(False)))
    marked = _write(marked, f"{folder}/sequences")

    # Nodes: the prefixes of all sequences, the root among them.
    prefixes = path.join(marked, "conv_id")
    top = marked.withColumn("_root", root.scalar()).select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), F.col("_root").alias("key"),
        F.lit(None).cast("binary").alias("parent"), "weight", "leaf",
    )
    rows = _write(prefixes.select(*top.columns).unionByName(top), f"{folder}/prefixes")
    nodes = _write(
        rows.groupBy("key").agg(
            F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"),
            F.sum("weight").alias("n_convs"), F.count(F.when(F.col("leaf"), 1)).alias("n_leaves"),
            F.max("words").alias("words"), F.min(F.when(F.col("leaf"), F.col("conv_id"))).alias("owner"),
        ), f"{folder}/nodes",
    )

    # A node's tokens belong to one leaf; a leaf sums them from its end upwards; a node adds up its leaves.
    spared = nodes.select(F.col("owner").alias("conv_id"), "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("spared"))
    of_leaves = rows.where("leaf").select("conv_id", "depth", "key").join(spared, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "key", F.coalesce("spared", F.lit(0)).cast("long").alias("own"),
        F.coalesce("spared", F.lit(0)).cast("long").alias("spared"),
    )
    summed = _write(running(of_leaves, "conv_id", "depth", ["spared"], f"{folder}/spared"), f"{folder}/upto")
    whole_leaf = summed.groupBy("conv_id").agg(F.sum("own").alias("all"))
    saved = summed.join(whole_leaf, "conv_id").groupBy("key").agg(
        F.sum(F.col("all") - F.col("spared") + F.col("own")).alias("saved_tokens")
    )

    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    # A node's parent is asked for by its children, of which the root may have very many.
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        nodes.join(above, "parent", "left").join(children, "key", "left").join(saved, "key")
        .join(end_lists(ends.select("key", "conv_id")), "key", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
            "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
        )
    )


def prefix_trie_sql() -> str:
    """The same over ``conversations`` for DuckDB, with nodes as lists of turns: for small tables."""
    return f"""
    WITH crc AS (
        SELECT list(c ORDER BY i) AS t FROM (
            SELECT i, list_reduce([i] || [k::UBIGINT FOR k IN range(8)],
                                  lambda a, k: CASE WHEN a & 1 = 1 THEN xor(3988292384::UBIGINT, a >> 1) ELSE a >> 1 END) AS c
            FROM (SELECT unnest(range(256))::UBIGINT AS i))
    ), turns AS (
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
               coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations WHERE conv_id IS NOT NULL
    ), convs AS (
        SELECT conv_id, conv_id - (conv_id % {FAMILY} + {FAMILY}) % {FAMILY} AS head, CAST(xor(4294967295::UBIGINT, list_reduce(
            [4294967295::UBIGINT] || [unicode(c)::UBIGINT FOR c IN string_split(CAST(conv_id AS VARCHAR), '')],
            lambda a, b: xor(t[1 + (xor(a, b) & 255)::BIGINT], a >> 8))) % {HEADS} AS BIGINT) AS h
        FROM (SELECT DISTINCT conv_id FROM turns), crc
    ), rebuilt AS (
        SELECT conv_id, coalesce((SELECT list((role, text) ORDER BY pos) FROM turns t WHERE t.conv_id = c.head AND pos <= c.h), [])
            || coalesce((SELECT list((role, text) ORDER BY pos) FROM turns t WHERE t.conv_id = c.conv_id AND pos > c.h), []) AS seq
        FROM convs c
    ), prefixes AS (
        SELECT conv_id, seq[:d] AS node, d AS depth, d = len(seq) AS ends FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM rebuilt)
    ), nodes AS (
        SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
               sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
        FROM prefixes GROUP BY 1, 2
    ), below AS (
        SELECT a.node, count(*) FILTER (WHERE b.depth = a.depth + 1) AS n_children,
               count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM nodes c WHERE c.depth = b.depth + 1 AND c.node[:b.depth] = b.node)) AS n_leaves,
               CAST(sum(CASE WHEN b.depth = 0 THEN 0 ELSE (b.n_convs - 1) * len(regexp_extract_all(b.node[b.depth][2], '[^\\x20\\x09-\\x0D]+')) END) AS BIGINT) AS saved_tokens
        FROM nodes a JOIN nodes b ON b.depth >= a.depth AND b.node[:a.depth] = a.node GROUP BY 1
    )
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, b.n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
    FROM nodes n JOIN below b ON n.node = b.node LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.node[:n.depth - 1]"""
