"""The corpus pipeline: quality, lines, near duplicates, private data, packing.

`STAGES` is run in order; every stage gets what the one before kept, written as Parquet and read again.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexweave.llm import packing, private_data
from hexweave.llm.common import pick
from hexweave.llm.kneser_ney import classify
from hexweave.llm.line_dedup import line_dedup
from hexweave.llm.near_dedup import near_dedup
from hexweave.llm.queries import tokenizer
from hexweave.session import fresh_dir, ship, tune

# SQL cannot express the classifier, the sketches or the packing; tests compare the stages with brute force.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Stage) -> Stage:
    """A stage with the session's settings, whose executors have the package, however it is started."""
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return f(ship(tune(spark)), docs, sf_dir)

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the Kneser-Ney classifier keeps."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return pick(classify(docs, labels).where("kept"), *docs.columns)


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their site's boilerplate lines; all stay, and whole copies are left to the next stage."""
    return counted(pick(line_dedup(docs, spare=True), *docs.columns))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    dropped = near_dedup(docs).where(~F.col("kept")).select("doc_id").distinct()
    return pick(docs.join(dropped, "doc_id", "left_anti"), *docs.columns)


@stage
def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and revealing terms generalised; all of them stay."""
    return counted(private_data.sanitise(docs))


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), ids=False).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` after a change of the text, where the table has the column."""
    if "n_chars" not in docs.columns:
        return docs
    n = F.char_length("text").cast("long")
    return pick(docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(n)), *docs.columns)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("private", private),
    ("packed", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the packed pieces."""
    folder = fresh_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        result = apply(spark, docs, sf_dir)
        result.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(result.schema).parquet(f"{folder}/{name}")
    return docs
