"""URL filters: a path-template tree per host, judged by smoothed labelled purity.

Fixed rules come first; the URLs they cover are the labelled ones. For the rest, every host has a
tree of path templates. Segments that look like ids become ``*`` at once; branching by branching, a segment
whose parent has many different children, and that holds a small share of them, becomes ``*`` too unless
its labels show another share of blocked pages than its parent's, and sibling branches whose labelled share does not differ from their parent's by a two-sided test are
merged into ``*``. A template is rejected if its smoothed share of blocked labels exceeds a half: a
host's template leans on the same template over all hosts, and that on the whole table.

The tree goes as deep as the paths do. What all paths of a node have in common is one step, and so is the rest of a
single path, so rounds follow how often paths branch and not how long they are.

Counts are combined per (host, generalised path) in each task before anything shuffles, so a host with
a third of all rows costs one row per task and path. No step gathers a host.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexweave.llm.common import pick
from hexweave.session import fresh_dir

MANY = 12
SHARE = 0.05
Z = 1.96
PRIOR = 4.0

# The rules, as (verdict, host and path prefix).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

# Segments that name an item: numbers, hexadecimal ids, dates, each with a file ending or not.
ITEM = r"^(?:[0-9]+|[0-9a-fA-F]{8,}|[0-9a-fA-F-]{32,}|[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?)(?:\.[A-Za-z0-9]{1,5})?$"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parse(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for NULL or a text without ``://``."""
    pattern = r"://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; NULL where none does."""
    name = verdict = F.lit(None).cast("string")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):
        at, _, start = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{start}")
        name = F.when(fits, F.lit(rule)).otherwise(name)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """All segments, id-like ones as ``*``."""
    parts = F.filter(F.split(path, "/", -1), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(x.rlike(ITEM), F.lit("*")).otherwise(x))


def templates(
    paths: DataFrame, folder: str, many: int = MANY, share: float = SHARE, z: float = Z, prior: float = PRIOR,
) -> DataFrame:
    """Verdict of every (host, segments) row of ``paths``, which has the counts n, labelled, blocked.

    One branching of the tree at a time: aggregates over the pre-counted paths, written below
    ``folder`` so that no round computes the ones above again. Only paths that go on are in the next
    round.

    A segment with fewer labels than ``prior`` has too few to tell its share from its parent's.
    """
    spark = paths.sparkSession
    open_, rounds = paths.withColumn("template", F.array().cast("array<string>")), []
    while True:
        # Where a node's paths part: the common beginning of the least and the greatest of what is left of them.
        left = F.slice("segments", F.size("template") + 1, F.size("segments"))
        tree = open_.withColumn("left", left)
        ends = tree.groupBy("host", "template").agg(F.min("left").alias("low"), F.max("left").alias("high"))
        longest = F.least(F.size("low"), F.size("high"))
        same = F.filter(F.sequence(F.lit(0), longest), lambda i: (i == longest) | (F.get("low", i) != F.get("high", i)))
        steps = ends.select("host", "template", F.element_at(same, 1).alias("step"))
        tree = tree.join(steps, ["host", "template"]).withColumn("template", F.concat("template", F.slice("left", F.lit(1), F.col("step"))))
        tree = tree.withColumn("seg", F.coalesce(F.get("left", F.col("step")), F.lit(""))).drop("left", "step")
        sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
        nodes = tree.groupBy("host", "template", "seg").agg(*sums)
        parents = nodes.groupBy("host", "template").agg(
            F.count(F.lit(1)).alias("p_children"), *[F.sum(c).alias(f"p_{c}") for c in ("n", "labelled", "blocked")]
        )
        rate = F.col("p_blocked") / F.nullif(F.col("p_labelled"), F.lit(0))
        spread = F.sqrt(rate * (1 - rate) / F.col("labelled"))
        apart = F.abs(F.col("blocked") / F.nullif(F.col("labelled"), F.lit(0)) - rate)
        rare = (F.col("p_children") > many) & (F.col("n") < share * F.col("p_n")) & (
            (F.col("labelled") < prior) | (apart <= z * spread)
        )
        # At a share of 0 or 1 there is no spread, and equal shares are alike.
        alike = (F.col("labelled") > 0) & (F.col("p_children") > 1) & (apart <= z * spread)
        becomes = F.when(F.col("seg") == "", F.col("seg")).when(
            rare | F.coalesce(alike, F.lit(False)), F.lit("*")
        ).otherwise(F.col("seg"))
        chosen = nodes.join(parents, ["host", "template"]).select("host", "template", "seg", becomes.alias("_to"))
        tree = tree.join(chosen, ["host", "template", "seg"]).withColumn(
            "template", F.when(F.col("_to") == "", F.col("template")).otherwise(F.concat("template", F.array("_to")))
        ).withColumn("done", F.col("_to") == "").drop("_to", "seg")
        path = f"{folder}/round{len(rounds)}"
        tree.write.parquet(path)
        rounds.append(spark.read.schema(tree.schema).parquet(path))
        open_ = rounds[-1].where("not done").select(*open_.columns)
        if open_.isEmpty():
            break

    # A path has its template in the round in which it ends.
    tree = reduce(DataFrame.unionByName, [t.where("done") for t in rounds])
    tree.write.parquet(f"{folder}/tree")
    tree = spark.read.schema(tree.schema).parquet(f"{folder}/tree")
    own = tree.groupBy("host", "template").agg(F.sum("labelled").alias("t_labelled"), F.sum("blocked").alias("t_blocked"))
    shared = tree.groupBy("template").agg(F.sum("labelled").alias("g_labelled"), F.sum("blocked").alias("g_blocked"))
    whole = tree.agg(((F.sum("blocked") + 1) / (F.sum("labelled") + 2)).alias("base"))
    everywhere = (F.col("g_blocked") + prior * F.col("base")) / (F.col("g_labelled") + prior)
    purity = (F.col("t_blocked") + prior * everywhere) / (F.col("t_labelled") + prior)
    judged = own.join(shared, "template").withColumn("base", whole.scalar()).select(
        "host", "template", purity.alias("p_block")
    )
    return tree.select("host", "segments", "template").join(judged, ["host", "template"]).select(
        "host", "segments", F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "p_block"
    )


def url_filters(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """host, path, rule, template, p_block and verdict of every row of ``pages`` (page_id, url).

    NULL urls and those without ``://`` have an empty host and path and the root template. Repeated
    rows are judged alike and counted each. Without any labelled page every purity is a half, which
    does not exceed the limit: allow. An empty table gives an empty result. Other columns of
    ``pages`` are ignored.
    """
    host, path = parse(F.col("url"))
    named = pick(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = named.withColumns({"rule": name, "_rule_verdict": verdict, "segments": segments(F.col("path"))})
    counts = judged.groupBy("host", "segments").agg(
        F.count(F.lit(1)).alias("n"), F.count("_rule_verdict").alias("labelled"),
        F.sum((F.coalesce("_rule_verdict", F.lit("")) == "block").cast("long")).alias("blocked"),
    )
    folder = fresh_dir(pages.sparkSession, "templates")
    counts.write.parquet(f"{folder}/counts")
    schema = "host string, segments array<string>, n long, labelled long, blocked long"
    counted = pages.sparkSession.read.schema(schema).parquet(f"{folder}/counts")
    templates(counted, folder).write.parquet(f"{folder}/verdicts")
    # Read back, so that Spark knows the size: broadcast if small, else a join whose hot hosts AQE splits.
    known = pages.sparkSession.read.schema(
        "host string, segments array<string>, template string, p_block double"
    ).parquet(f"{folder}/verdicts")
    out = judged.join(known, ["host", "segments"], "left")
    by_method = F.when(F.round("p_block", 9) > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(
        "page_id", "host", "path", "rule", "template", F.round("p_block", 9).alias("p_block"),
        F.coalesce("_rule_verdict", by_method).alias("verdict"),
    )
