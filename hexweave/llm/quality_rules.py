"""Quality rules: hashed n-gram log-likelihood ratio against a trusted target.

Two multinomials over hashed words and word pairs are counted, one over trusted documents and one
over the whole corpus. A document's score is the mean, over its n-grams, of the log ratio of the two
probabilities (all trusted documents count); a document is kept if its score reaches a fixed threshold and the base rules pass.
Everything is DataFrame code: counting combines in each task before it shuffles, so the shuffle
holds at most ``buckets`` rows per task, and the ratio table is one array of ``buckets`` doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexweave.llm.common import let, pick, with_trust, words

BUCKETS = 1 << 15
THRESHOLD = -0.06
WINDOW = 8


def _covered(positions: Column, width: int) -> Column:
    """Number of words inside windows that start at the sorted positions."""
    gaps = F.transform(
        positions, lambda p, j: F.when(j == 0, F.lit(width)).otherwise(F.least(F.lit(width), p - F.get(positions, j - 1)))
    )
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)


def repeated_words(w: Column, width: int = WINDOW) -> Column:
    """Words of ``w`` in ``width``-word windows that are found twice or more.

    Window hashes only decide whether a document needs the exact comparison, which sorts the
    window texts: linear work for most documents, n log n for the rest.
    """
    starts = F.sequence(F.lit(0), F.size(w) - width)

    def exact(keyed: Column) -> Column:
        twice = F.filter(
            keyed,
            lambda x, j: (x["k"] == F.coalesce(F.get(keyed, j - 1)["k"], F.lit("")))
            | (x["k"] == F.coalesce(F.get(keyed, j + 1)["k"], F.lit(""))),
        )
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), lambda p: _covered(p, width))

    def by_hash(h: Column) -> Column:
        windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
        keyed = F.transform(
            starts, lambda i: F.struct(F.array_join(F.slice(w, i + 1, width), " ").alias("k"), i.alias("i"))
        )
        repeats = let(windows, lambda x: F.size(F.array_distinct(x)) < F.size(x))
        return F.when(repeats, let(F.sort_array(keyed), exact)).otherwise(F.lit(0))

    return F.when(
        F.size(w) > width, let(F.transform(w, lambda x: F.xxhash64(x)), by_hash)
    ).otherwise(F.lit(0)).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the same text."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def ngrams(w: Column, buckets: int) -> Column:
    """Buckets of the words and of the adjacent word pairs."""
    def both(h: Column) -> Column:
        pairs = F.transform(
            F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.xxhash64(F.get(h, i), x)
        )
        return F.transform(F.concat(h, pairs), lambda x: F.pmod(x, F.lit(buckets)).cast("int"))

    return let(F.transform(w, lambda x: F.xxhash64(x)), both)


def ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row with ``ratio``: log of target over raw probability for every bucket (add-one smoothing).

    Without any trusted document the ratios are 0, so that the base rules alone decide.
    """
    grams = with_trust(docs, labels, ["doc_id", "text"]).select(
        "_trusted", F.explode(ngrams(words(F.col("text")), buckets)).alias("bucket")
    )
    counts = grams.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("raw"), F.sum(F.col("_trusted").cast("long")).alias("target")
    )
    empty = docs.sparkSession.range(buckets).select(
        F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("raw"),
        F.lit(0).cast("long").alias("target"),
    )
    whole = counts.unionByName(empty).groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")
    ).agg(
        F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("c"),
        F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"),
    )

    def ratio(x: Column) -> Column:
        target = (x["target"] + 1) / (F.col("n_target") + buckets)
        raw = (x["raw"] + 1) / (F.col("n_raw") + buckets)
        return F.when(F.col("n_target") > 0, F.log(target / raw)).otherwise(F.lit(0.0))

    return whole.select(F.transform("c", ratio).alias("ratio"))


def quality_rules(
    docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD,
) -> DataFrame:
    """Base counts, ``llr`` and verdict of every row of ``docs`` (doc_id, text).

    NULL and empty texts have no words: they fail the base rules, and their ``llr`` is NULL. Rows are
    judged one by one, so repeated rows give repeated results; NULL ids are never trusted. An empty
    table gives an empty result. Other columns of ``docs`` are ignored.
    """
    table = ratios(docs, labels, buckets)
    text = F.coalesce(F.col("text"), F.lit(""))

    def counts(w: Column) -> Column:
        def total(g: Column) -> Column:
            score = F.aggregate(g, F.lit(0.0), lambda a, x: a + F.get(F.col("_ratio"), x))
            return F.when(F.size(g) > 0, score / F.size(g))

        return F.struct(
            F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"),
            let(ngrams(w, buckets), total).alias("llr"),
        )

    def removed(chars: str) -> Column:
        return F.char_length(F.translate(text, chars, ""))

    spaces = "\x20\t\n\x0b\x0c\r"
    out = pick(docs, "doc_id", "text").withColumn("_ratio", table.scalar()).select(
        "doc_id", let(words(F.col("text")), counts).alias("c"),
        removed(spaces).cast("long").alias("word_chars"),
        (F.char_length(text) - removed("#*$%&|<>")).cast("long").alias("n_symbols"),
        duplicate_lines(text).alias("n_dup_lines"),
    ).select("doc_id", "c.n_words", "word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words", "c.llr")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & F.coalesce(F.round("llr", 9) >= threshold, F.lit(False))
    )
