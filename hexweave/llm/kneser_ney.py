"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters, each its own symbol whatever its script, of order `ORDER`, and is trained on
all trusted text. An n-gram is its context, packed into one number, and its symbol. Counts are combined in
each task and then sharded by n-gram; continuation counts, context sums, discounted shares, back-off
weights and the interpolation come from joins of these sharded tables, order by order, and the tables
stay sharded, so they may grow with the text.

Scores come from joins too. Texts are dealt to parts of about `PART_BYTES`; a part asks for its distinct
n-grams, each distinct one of all parts meets the tables once, and the parts get back a value for each.
So an n-gram moves once a part and not once for each place or document.

A document is kept if its perplexity does not exceed its language's threshold: a high quantile of the
trusted documents of that language, times a margin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexweave.llm.common import pick
from hexweave.llm.subwords import raw, slices
from hexweave.session import fresh_dir, materialize

ORDER = 4
TRUSTED = 1_000_000
QUANTILE = 0.99
MARGIN = 1.15
BITS = 21  # of a character's code point
PART_BYTES = 16 << 20
START = ord("\n")

_rng = np.random.default_rng(20240307)
ODD = _rng.integers(1, 2**62, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after the other, and the offsets of each."""
    content, at = raw(texts)
    points = np.frombuffer(content.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    first = np.concatenate([[0], np.cumsum((content & 0xC0) != 0x80)])  # a character's first byte
    return points, first[at]


def _contexts(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The symbols before each one, as one number; texts start after `START`."""
    pad = ORDER - 1
    padded = np.full(len(symbols) + pad * (len(offsets) - 1), START, np.int64)
    where = np.repeat(pad * np.arange(1, len(offsets)), np.diff(offsets)) + np.arange(len(symbols))
    padded[where] = symbols
    context = np.zeros(len(symbols), np.int64)
    for back in range(pad, 0, -1):
        context = context << BITS | padded[where - back]
    return context


def _mixed(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """One number for an n-gram, by which a part finds it among its own."""
    h = context.astype(np.uint64) * ODD[0] + symbol.astype(np.uint64) * ODD[1]
    h = (h ^ (h >> np.uint64(32))) * ODD[2]
    return h ^ (h >> np.uint64(29))


def _coded(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers in the order they come, one place of each, and the number of each one's; by hash, without a sort."""
    which, distinct = pd.factorize(numbers)
    at = np.empty(len(distinct), np.int64)
    at[which[::-1]] = np.arange(len(numbers) - 1, -1, -1)
    return distinct, at, which


def _distinct(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mixed number, context, symbol and count of the distinct n-grams of some texts."""
    symbols, offsets = _characters(texts)
    context = _contexts(symbols, offsets)
    mixed, at, which = _coded(_mixed(context, symbols))
    return mixed, context[at], symbols[at].astype(np.int32), np.bincount(which, minlength=len(at))


def count_grams(docs: DataFrame) -> DataFrame:
    """context, symbol and count over all texts, one row per n-gram."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            _, context, symbol, times = _distinct(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(context), pa.array(symbol), pa.array(times, pa.int64())], ["context", "symbol", "n"])

    rows = docs.select("text").mapInArrow(run, "context long, symbol int, n long")
    return rows.groupBy("context", "symbol").agg(F.sum("n").alias("n"))


def shares(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One order's grams (context, symbol, value) and contexts (context, weight), from its (context, symbol, n).

    A gram's value is its discounted share of its context, the weight is that of the lower order. The
    discounts D1, D2, D3+ come from the numbers of grams counted once to four times.
    """
    times = counts.agg(*[F.count(F.when(F.col("n") == k, 1)).cast("double").alias(f"t{k}") for k in (1, 2, 3, 4)])
    y = F.col("t1") / F.nullif(F.col("t1") + 2 * F.col("t2"), F.lit(0.0))

    def discount(k: int) -> Column:
        d = k - (k + 1) * y * F.col(f"t{k + 1}") / F.nullif(F.col(f"t{k}"), F.lit(0.0))
        # Small corpora can miss a count class; the classic absolute discount then stands in. None is 0, so no weight is.
        return F.when((d > 0) & (d <= k), d).otherwise(F.coalesce(F.nullif(y, F.lit(0.0)), F.lit(0.5)) * (1 if k == 1 else k / 2))

    d = times.select(F.struct(*[discount(k).alias(f"d{k}") for k in (1, 2, 3)]).alias("d"))
    rows = counts.withColumn("d", d.scalar())
    cut = F.when(F.col("n") == 1, F.col("d.d1")).when(F.col("n") == 2, F.col("d.d2")).otherwise(F.col("d.d3"))
    rows = rows.withColumn("cut", F.least(cut, F.col("n").cast("double")))
    contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("held"))
    return rows.join(contexts, "context").select(
        "context", "symbol", ((F.col("n") - F.col("cut")) / F.col("total")).alias("value")
    ), contexts.select("context", (F.col("held") / F.col("total")).alias("weight"))


def _low(order: int) -> Column:
    """The part of ``context`` that an order looks at."""
    return F.col("context").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1).cast("long"))


def levels(longest: DataFrame) -> tuple[list[DataFrame], list[DataFrame], float]:
    """Of every order: its grams (context, symbol, p) and its contexts (context, weight); and what a symbol has below.

    ``longest`` are the counts of `count_grams`. Each table is written once, sharded by gram. Below
    the single symbols all are alike: the number of those seen, and one for all others.
    """
    spark, folder = longest.sparkSession, fresh_dir(longest.sparkSession, "grams")
    of_counts, of_grams, of_contexts = (f"context long, {x}" for x in ("symbol int, n long", "symbol int, p double", "weight double"))
    longest.write.parquet(f"{folder}/n{ORDER}")
    for order in range(ORDER - 1, 0, -1):  # how many symbols a gram of this order continues
        longer = spark.read.schema(of_counts).parquet(f"{folder}/n{order + 1}")
        longer.groupBy(_low(order).alias("context"), "symbol").agg(
            F.count(F.lit(1)).alias("n")
        ).write.parquet(f"{folder}/n{order}")
    grams, contexts = [], []
    floor = 1 / (spark.read.schema(of_counts).parquet(f"{folder}/n1").count() + 1)
    for order in range(1, ORDER + 1):
        value, weight = shares(spark.read.schema(of_counts).parquet(f"{folder}/n{order}"))
        weight.write.parquet(f"{folder}/w{order}")
        contexts.append(spark.read.schema(of_contexts).parquet(f"{folder}/w{order}"))
        rows = value.join(contexts[-1], "context")
        if order == 1:
            below = F.lit(floor)
        else:
            shorter = grams[-1].select(F.col("context").alias("_low"), "symbol", F.col("p").alias("_p"))
            rows, below = rows.withColumn("_low", _low(order - 1)).join(shorter, ["_low", "symbol"]), F.col("_p")
        rows.select("context", "symbol", (F.col("value") + F.col("weight") * below).alias("p")).write.parquet(f"{folder}/p{order}")
        grams.append(spark.read.schema(of_grams).parquet(f"{folder}/p{order}"))
    return grams, contexts, floor


def probabilities(wanted: DataFrame, grams: list[DataFrame], contexts: list[DataFrame], floor: float) -> DataFrame:
    """``wanted`` (context, symbol), each once, with ``p``: of the longest gram seen, weighed down from longer contexts.

    The single characters and the contexts of one character are broadcast: Unicode bounds them.
    """
    p = F.lit(floor)
    for order, (gram, context) in enumerate(zip(grams, contexts, strict=True), 1):
        wanted = wanted.withColumn("_low", _low(order))
        gram = gram.select(F.col("context").alias("_low"), "symbol", F.col("p").alias(f"_p{order}"))
        context = context.select(F.col("context").alias("_low"), F.col("weight").alias(f"_w{order}"))
        wanted = wanted.join(F.broadcast(gram) if order == 1 else gram, ["_low", "symbol"], "left")
        wanted = wanted.join(F.broadcast(context) if order <= 2 else context, "_low", "left").drop("_low")
        p = F.coalesce(F.col(f"_p{order}"), F.coalesce(F.col(f"_w{order}"), F.lit(1.0)) * p)
    return wanted.select("context", "symbol", p.alias("p"))


def entropies(docs: DataFrame, grams: list[DataFrame], contexts: list[DataFrame], floor: float) -> DataFrame:
    """``docs`` with columns c_0, c_1, ... and ``entropy``: the mean negative log probability of a text's characters.

    It is NULL for NULL and empty texts. The exchange that deals the rows to parts is used for the n-grams they ask for,
    and for the scores.
    """
    text = f"c_{docs.columns.index('text')}"
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in ("doc_id", "text")]), F.lit(max(1, size // PART_BYTES)))
    dealt = docs.select(*[F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(docs.columns)], part.alias("part"))
    schema = T.StructType([*dealt.schema.fields[:-1], T.StructField("entropy", T.DoubleType())])

    def ask(rows: pa.Table) -> pa.Table:
        known = [np.zeros(0, k) for k in (np.uint64, np.int64, np.int32)]
        for batch in slices(iter(rows.to_batches()), text):
            new = _distinct(batch.column(text))[:3]
            mixed, context, symbol = (np.concatenate([x, y]) for x, y in zip(known, new, strict=True))
            mixed, at, _ = _coded(mixed)
            known = [mixed, context[at], symbol[at]]
        number = np.full(len(known[0]), rows.column("part")[0].as_py())
        return pa.table([pa.array(number, pa.int64()), pa.array(known[1]), pa.array(known[2])], names=["part", "context", "symbol"])

    def score(rows: pa.Table, values: pa.Table) -> pa.Table:
        mixed = _mixed(values.column("context").to_numpy(), values.column("symbol").to_numpy())
        order = np.argsort(mixed)
        mixed, logs = mixed[order], np.log(values.column("p").to_numpy())[order]
        out = []
        for batch in slices(iter(rows.to_batches()), text):
            symbols, offsets = _characters(batch.column(text))
            own, _, which = _coded(_mixed(_contexts(symbols, offsets), symbols))
            sizes = np.diff(offsets)
            some = sizes > 0
            sums = np.zeros(len(sizes))
            if some.any():
                sums[some] = np.add.reduceat(logs[np.searchsorted(mixed, own)][which], offsets[:-1][some])
            out.append(pa.array(np.round(-sums / np.maximum(sizes, 1), 3), mask=~some))
        return rows.drop_columns(["part"]).append_column("entropy", pa.chunked_array(out, pa.float64()))

    asked = dealt.groupBy("part").applyInArrow(ask, "part long, context long, symbol int")
    known = probabilities(asked.select("context", "symbol").distinct(), grams, contexts, floor)
    values = asked.join(known, ["context", "symbol"])
    return dealt.groupBy("part").cogroup(values.groupBy("part")).applyInArrow(score, schema)


def thresholds(scored: DataFrame, quantile: float, margin: float) -> DataFrame:
    """lang and ``limit`` (of the entropy) from (lang, entropy) of trusted rows; ``lang`` NULL is the overall one.

    Entropies are rounded, so that the histogram per language is bounded and the quantile exact.
    """
    bins = materialize(
        scored.where("entropy is not null").groupBy("lang", "entropy").agg(F.count(F.lit(1)).alias("n")), "bins"
    )
    both = bins.where("lang is not null").unionByName(
        bins.groupBy("entropy").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "entropy", "n")
    )
    each = Window.partitionBy("lang")
    up_to = each.orderBy("entropy").rowsBetween(Window.unboundedPreceding, 0)
    ranked = both.withColumn("below", F.sum("n").over(up_to)).withColumn("total", F.sum("n").over(each))
    return ranked.where(F.col("below") >= quantile * F.col("total")).groupBy("lang").agg(
        (F.min("entropy") + float(np.log(margin))).alias("limit")
    )


def trusted_rows(docs: DataFrame, labels: DataFrame, broadcast: int) -> DataFrame:
    """doc_id, text and lang of the documents labelled good and not toxic; up to ``broadcast`` ids are broadcast."""
    good = (
        labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0))
        .select(F.col("doc_id").alias("_id")).where("_id is not null").distinct()
    )
    good = F.broadcast(good) if good.count() <= broadcast else good
    docs = pick(docs, "doc_id", "text", "lang")
    return docs.join(good, F.col("doc_id") == F.col("_id"), "left_semi")


def classify(
    docs: DataFrame, labels: DataFrame, trusted: int = TRUSTED, quantile: float = QUANTILE, margin: float = MARGIN
) -> DataFrame:
    """``docs`` with ``perplexity``, ``threshold`` and ``kept``; all rows and columns stay.

    The model is trained on every labelled document, and the thresholds are taken from them all; above
    ``trusted`` their ids are joined by a shuffle, not broadcast. NULL and empty texts have no
    perplexity and are not kept. A language
    without trusted documents, and NULL, take the overall threshold; without any trusted document every
    text with a character is kept. Repeated rows are judged alike. An empty table gives an empty result.
    Columns of ``docs`` named like the three are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("perplexity", "threshold", "kept")
    good = trusted_rows(docs, labels, trusted)
    tables = levels(count_grams(good))
    folder = fresh_dir(spark, "thresholds")
    scored = entropies(good, *tables).select(F.col("c_2").alias("lang"), "entropy")
    thresholds(scored, quantile, margin).write.parquet(folder)
    limits = spark.read.schema("lang string, limit double").parquet(folder)
    overall = limits.where("lang is null").agg(F.max("limit").alias("limit"))
    own = limits.where("lang is not null").select(F.col("lang").alias("_lang"), F.col("limit").alias("_own"))
    lang = F.col(f"c_{docs.columns.index('lang')}")
    out = entropies(docs, *tables).join(own, lang == F.col("_lang"), "left")
    limit = F.coalesce("_own", overall.scalar())
    kept = F.col("entropy").isNotNull() & F.coalesce(F.col("entropy") <= limit, F.lit(True))
    return out.select(
        *[F.col(f"c_{i}").alias(c) for i, c in enumerate(docs.columns)], F.round(F.exp("entropy"), 4).alias("perplexity"),
        F.round(F.exp(limit), 4).alias("threshold"), kept.alias("kept"),
    )
