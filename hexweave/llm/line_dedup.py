"""Line dedup by site-relative frequency.

Per host, the pages that hold a line are divided by the host's page total; lines above a ratio are
boilerplate and are dropped from every page of that host. Counting combines (host, line digest) in
each task before it shuffles. A host's boilerplate list is bounded: a line of it is on more than
``ratio`` of the pages, so the list holds at most (mean distinct lines per page) / ``ratio`` lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexweave.llm.common import let, whole_row
from hexweave.session import fresh_dir

RATIO = 0.05
MIN_PAGES = 2  # a line of one page alone is not shared by its site


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``_host`` and ``_drop``, the hex digests of its boilerplate lines, for hosts that have any."""
    pages = docs.select(F.coalesce(F.col(f"`{host}`"), F.lit("")).alias("_host"), "text")
    # As text, distinct digests are found by a hash set; binary ones would be compared with each other.
    digests = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), _has_word), lambda x: F.md5(x)))
    counts = pages.select("_host", F.explode(digests).alias("_line")).select("_host", F.unhex("_line").alias("_line"))
    counts = counts.groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_pages")).where(F.col("_pages") >= min_pages)
    totals = pages.groupBy("_host").agg(F.count(F.lit(1)).alias("_total"))
    return (
        counts.join(totals, "_host").where(F.col("_pages") > F.lit(ratio) * F.col("_total"))
        .groupBy("_host").agg(F.sort_array(F.collect_list(F.lower(F.hex("_line")))).alias("_drop"))
    )


def line_dedup(
    docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, spare: bool = False
) -> DataFrame:
    """``docs`` with ``text`` cut and the counts ``n_lines`` and ``n_dropped``, row by row.

    Lines are the ``\\n`` separated pieces; only those with a word count and can go. A page all of
    whose lines are boilerplate keeps only its blank ones, so its text may become empty; with ``spare`` it
    stays as it is, for a near-duplicate step to come, which keeps one of such copies. Lines on fewer than
    ``min_pages`` pages of a host are not boilerplate, so hosts of fewer pages are not judged. A NULL host
    is the host ``''``. NULL text stays NULL with 0 lines, an empty text has 0 lines. Repeated rows count
    as pages of their own. An empty table gives an empty result. Other columns of ``docs`` are kept, but
    for ones named like the two counts, which are replaced.

    The boilerplate table is written first, so that Spark knows its size when it plans the join: it
    is broadcast below ``spark.sql.autoBroadcastJoinThreshold``, and shuffled, with skewed hosts split
    by AQE, above it. A page meets its host's list once, by a hash set, and its lines what they share.
    """
    docs = docs.drop("n_lines", "n_dropped")
    path = fresh_dir(docs.sparkSession, "boilerplate")
    boilerplate(docs, host, ratio, min_pages).write.parquet(path)
    table = docs.sparkSession.read.schema("_host string, _drop array<string>").parquet(path)

    text, drop = F.col("row.text"), F.col("_drop")

    def marked(line: Column) -> Column:
        """A line and its mark: NULL without a word, its digest where the host has a list."""
        mark = F.when(_has_word(line), F.when(drop.isNotNull(), F.md5(line)).otherwise(F.lit("")))
        return F.struct(line.alias("line"), mark.alias("mark"))

    def cut(lines: Column) -> Column:
        def with_hits(hits: Column) -> Column:
            return let(F.filter(lines, lambda x: x["mark"].isNull() | ~F.array_contains(hits, x["mark"])), chosen)

        def chosen(kept: Column) -> Column:
            left = F.size(F.filter(kept, lambda x: x["mark"].isNotNull()))
            same = (left == worded) | ((left == 0) & F.lit(spare))
            return F.struct(
                F.when(same, text).otherwise(F.array_join(kept.getField("line"), "\n")).alias("text"),
                worded.cast("long").alias("n_lines"),
                F.when(same, F.lit(0)).otherwise(worded - left).cast("long").alias("n_dropped"),
            )

        worded = F.size(F.filter(lines, lambda x: x["mark"].isNotNull()))
        none = F.array().cast("array<string>")
        return let(F.array_intersect(lines.getField("mark"), F.coalesce(drop, none)), with_hits)

    # The row travels as one struct: no name of its columns can clash.
    rows = docs.select(whole_row(docs), F.coalesce(F.col(f"`{host}`"), F.lit("")).alias("_host"))
    cut_rows = rows.join(table, "_host", "left").withColumn("cut", let(F.transform(_lines(text), marked), cut))
    columns = [F.col("cut.text").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    return cut_rows.select(*columns, "cut.n_lines", "cut.n_dropped")


def line_dedup_sql(ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    """The same over ``documents`` for DuckDB: doc_id, n_lines, n_dropped, text."""
    return f"""
    WITH lines AS (
        SELECT doc_id, coalesce(source, '') AS host, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents
    ), worded AS (
        SELECT *, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS counts FROM lines
    ), totals AS (
        SELECT coalesce(source, '') AS host, count(*) AS total FROM documents GROUP BY 1
    ), gone AS (
        SELECT host, line FROM (SELECT host, line, count(DISTINCT doc_id) AS pages FROM worded WHERE counts GROUP BY 1, 2)
        JOIN totals USING (host) WHERE pages >= {min_pages} AND pages > {ratio} * total
    ), marked AS (
        SELECT w.doc_id, w.pos, w.line, w.counts, w.counts AND g.line IS NOT NULL AS goes
        FROM worded w LEFT JOIN gone g ON w.host = g.host AND w.line = g.line
    ), cut AS (
        SELECT doc_id, count(*) FILTER (WHERE counts) AS n_lines, count(*) FILTER (WHERE goes) AS n_goes,
               string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT goes) AS rest
        FROM marked GROUP BY 1
    )
    SELECT d.doc_id, n_lines, n_goes AS n_dropped, CASE WHEN n_goes = 0 THEN d.text ELSE coalesce(rest, '') END AS text
    FROM documents d JOIN cut USING (doc_id)"""
