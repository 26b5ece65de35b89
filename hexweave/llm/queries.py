"""Registered queries of the operators of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexweave.llm import fingerprints, kneser_ney, packing, pieces, suffixes
from hexweave.llm import private_data as pii
from hexweave.llm.common import pick, table
from hexweave.llm.line_dedup import line_dedup, line_dedup_sql
from hexweave.llm.near_dedup import near_dedup, near_dedup_sql
from hexweave.llm.prefix_trie import prefix_trie, prefix_trie_sql
from hexweave.llm.quality_rules import quality_rules
from hexweave.llm.spelling import spelling_sql, spelling_variants
from hexweave.llm.toxicity import toxicity
from hexweave.llm.url_filters import url_filters

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("llr", F.round("llr", 9))


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(line_dedup(table(spark, sf_dir, "documents")), "doc_id", "n_lines", "n_dropped", "text")


SQL["op2_line_dedup"] = line_dedup_sql()


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), width=2)


SQL["op4_near_dedup"] = near_dedup_sql(width=2)


@query
def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.suffix_dedup(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


@query
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.with_edits(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.spelled(F.col("print")).alias("fingerprint"),
        fingerprints.spelled(F.col("edited_print")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


@query
def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return pick(out, "doc_id", "lang", "perplexity", "threshold", "kept")


@query
def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return out.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op9_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_private(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] < len(pii.PATTERNS))
    counts = [F.size(pii.of_kind(spans, k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return out.select(
        "doc_id", *counts, F.sha2(pii.spelled(base).cast("binary"), 256).alias("base_sha256"),
        pii.spelled(spans).alias("spans"),
    )


@query
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters(table(spark, sf_dir, "pages"))


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


SQL["op11_spelling"] = spelling_sql()


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


SQL["op12_prefix_trie"] = prefix_trie_sql()


@query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
