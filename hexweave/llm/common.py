"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: what counts as a word.
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A plain column reference inside a lambda may be inlined by the optimizer and then be
    computed once per element; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Every word of a text; NULL has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that further ones of any name cannot clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, ``row``."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Ids that a broadcast may hold: some ten MB. More of them meet the documents in a shuffle join.
BROADCAST_IDS = 200_000


def with_trust(docs: DataFrame, labels: DataFrame, columns: Sequence[str], broadcast: int = BROADCAST_IDS) -> DataFrame:
    """``columns`` of every document and ``_trusted``: labelled good and not toxic.

    All trusted ids count. Up to ``broadcast`` of them are broadcast; more are shuffled with the documents.
    """
    good = (
        labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0))
        .select(F.col("doc_id").alias("_id")).where("_id is not null").distinct().withColumn("_trusted", F.lit(True))
    )
    good = F.broadcast(good) if good.limit(broadcast + 1).count() <= broadcast else good.hint("merge")
    docs = pick(docs, *columns)
    return (
        docs.join(good, F.col("doc_id") == F.col("_id"), "left")
        .drop("_id").withColumn("_trusted", F.coalesce("_trusted", F.lit(False)))
    )
