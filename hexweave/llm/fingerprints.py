"""Document fingerprints: a homomorphic multiset hash of a text's paragraphs.

Every paragraph (line) is hashed to a wide vector, and a document's fingerprint is the sum of its
paragraphs' vectors, lane by lane, modulo a power of two. The order of paragraphs does not matter, and
paragraphs can be put in or taken out by adding or subtracting vectors (`combine`).

A vector has three parts:

* ``mass``: the number of runs of words of the paragraph, modulo 2**32. A run ends before a word whose
  hash is 0 modulo 8, so it has eight words on average, and a word put in changes the runs at its place only;
* ``whole``: 8 lanes modulo 2**32 hashed from the paragraph. Documents with the same paragraphs in any
  order have equal lanes, others differ but for a chance of about 2**-120;
* ``parts``: 24 strata of 16 lanes modulo 2**32. Each run adds 1 to the low 24 bits and a hashed value above
  them to one lane of one stratum; a stratum gets half as many runs as the one before, so the last gets
  one run in 8 million. Subtracting two fingerprints cancels the shared runs, each as often as both have it.
  The lanes that do not cancel tell how many different runs are left (linear counting on the strata that
  are not full), and their low bits how often those are found: likeness is 1 - differing / all runs, both
  counted with repeats, and never more than the difference in ``mass`` allows.

All of it is DataFrame code; a fingerprint is made inside the row in time linear in the text.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexweave.llm.common import let, pick

RUN = 8
WHOLE = 8
STRATA = 24
LANES = 16
LANE_BITS = 32
COUNT_BITS = 24
FULL = 0.75
BUCKET_ROWS = 20_000
CUTS = 256


def _mask(x: Column, bits: int) -> Column:
    return x.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _runs(paragraph: Column) -> Column:
    """Hashes of the runs of words (cut at single spaces) of a paragraph."""
    def cut(w: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(w) - 1)
        starts = F.filter(every, lambda i: (i == 0) | (_mask(F.xxhash64(F.lit(RUN), F.get(w, i)), int(math.log2(RUN))) == 0))

        def hashed(at: Column) -> Column:
            return F.transform(
                at, lambda start, k: F.xxhash64(F.slice(w, start + 1, F.coalesce(F.get(at, k + 1), F.size(w)) - start))
            )

        return let(starts, hashed)

    return let(F.split(paragraph, " ", -1), cut)


def fingerprint(text: Column) -> Column:
    """Struct of ``mass``, ``whole`` and ``parts``, arrays of longs; NULL text is the empty one."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x != "")

    def of_lines(paragraphs: Column) -> Column:
        hashes = F.transform(paragraphs, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b")))

        def whole(h: Column) -> Column:
            def lane(k: int) -> Column:
                values = F.transform(h, lambda x: _mask(F.xxhash64(x["a"], x["b"], F.lit(k)), 32))
                return _mask(F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x), 32)

            return F.array(*[lane(k) for k in range(WHOLE)])

        def parts(runs: Column) -> Column:
            # The low bits choose the stratum, further bits the lane and the value.
            def stratum(h: Column) -> Column:
                low = _mask(h, STRATA - 1)
                return F.when(low == 0, F.lit(STRATA - 1)).otherwise(
                    F.round(F.log2(low.bitwiseAND(-low)), 0).cast("int")
                )

            keyed = F.transform(
                runs, lambda h: F.struct(
                    stratum(h).alias("s"), _mask(F.shiftrightunsigned(h, STRATA), int(math.log2(LANES))).cast("int").alias("l"),
                    F.shiftleft(_mask(F.shiftrightunsigned(h, 32), LANE_BITS - COUNT_BITS), COUNT_BITS)
                    .bitwiseOR(F.lit((1 << COUNT_BITS) + 1).cast("long")).alias("v"),
                ),
            )

            def sums(k: Column) -> Column:
                def lanes(s: int) -> Column:
                    mine = F.filter(k, lambda x: x["s"] == s)
                    zero = F.array_repeat(F.lit(0).cast("long"), LANES)
                    return F.aggregate(
                        mine, zero,
                        lambda acc, x: F.transform(acc, lambda a, i: F.when(i == x["l"], a + x["v"]).otherwise(a)),
                        lambda acc: F.transform(acc, lambda a: _mask(a, LANE_BITS)),
                    )

                return F.struct(
                    _mask(F.size(k).cast("long"), 32).alias("mass"),
                    F.flatten(F.array(*[lanes(s) for s in range(STRATA)])).alias("parts"),
                )

            return let(keyed, sums)

        return F.struct(
            let(hashes, whole).alias("whole"), let(F.flatten(F.transform(paragraphs, _runs)), parts).alias("p")
        )

    return let(let(lines, of_lines), lambda x: F.struct(
        x["p"]["mass"].alias("mass"), x["whole"].alias("whole"), x["p"]["parts"].alias("parts")
    ))


def combine(a: Column, b: Column, remove: bool = False) -> Column:
    """Fingerprint of ``a`` with the paragraphs of ``b`` put in, or taken out."""
    def step(x: Column, y: Column) -> Column:
        return x - y if remove else x + y

    return F.struct(
        _mask(step(a["mass"], b["mass"]), 32).alias("mass"),
        F.zip_with(a["whole"], b["whole"], lambda x, y: _mask(step(x, y), 32)).alias("whole"),
        F.zip_with(a["parts"], b["parts"], lambda x, y: _mask(step(x, y), LANE_BITS)).alias("parts"),
    )


def likeness(a: Column, b: Column) -> Column:
    """Share of runs, with their repeats, that two fingerprints have in common, 0 to 1; two empty ones are alike.

    Where few runs differ each has a lane, and the counts are exact but for lanes in which runs of both sides meet:
    such a lane counts the difference of the two, or two runs if that is 0.
    """
    half, around = 1 << COUNT_BITS - 1, 1 << COUNT_BITS

    def times(x: Column) -> Column:
        low = _mask(x, COUNT_BITS)
        n = F.least(low, around - low)
        return F.when(x == 0, F.lit(0)).when(low == half, F.lit(half)).otherwise(F.when(n == 0, F.lit(2)).otherwise(n)).cast("double")

    def from_difference(d: Column) -> Column:
        def of_stratum(s: Column) -> Column:
            def counted(mine: Column) -> Column:
                return F.struct(
                    F.size(F.filter(mine, lambda x: x != 0)).alias("k"),
                    F.aggregate(mine, F.lit(0.0), lambda t, x: t + times(x)).alias("w"),
                )

            return let(F.slice(d, s * LANES + 1, F.lit(LANES)), counted)

        def estimate(strata: Column) -> Column:
            # From the first stratum that is not too full on, all strata are used.
            fullest = F.coalesce(
                F.array_max(F.transform(strata, lambda x, s: F.when(x["k"] > FULL * LANES, s).otherwise(F.lit(-1)))), F.lit(-1)
            )

            def total(first: Column) -> Column:
                used = F.filter(strata, lambda x, s: s >= first)
                different = F.aggregate(
                    used, F.lit(0.0), lambda t, x: t - LANES * F.log(1 - F.least(x["k"], F.lit(LANES - 1)) / LANES)
                )
                repeated = F.aggregate(used, F.lit(0.0), lambda t, x: t + x["w"])
                return F.greatest(different, repeated) * F.pow(F.lit(2.0), first)

            return let(F.least(fullest + 1, F.lit(STRATA - 1)), total)

        return let(F.transform(F.sequence(F.lit(0), F.lit(STRATA - 1)), of_stratum), estimate)

    differing = let(F.zip_with(a["parts"], b["parts"], lambda x, y: _mask(x - y, LANE_BITS)), from_difference)
    both = a["mass"] + b["mass"]
    differing = F.greatest(differing, F.abs(a["mass"] - b["mass"]).cast("double"))
    share = F.when(both > 0, 1 - differing / both).otherwise(1.0)
    same = (a["whole"] == b["whole"]) & (a["parts"] == b["parts"]) & (a["mass"] == b["mass"])
    return F.when(same, 1.0).otherwise(F.round(F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0)), 6))


def _trimmed(parts: Column) -> Column:
    """Without the zeros at the end: short texts reach the first strata only."""
    return F.slice(parts, F.lit(1), F.array_max(F.transform(parts, lambda x, i: F.when(x != 0, i + 1).otherwise(F.lit(0)))))


def packed(f: Column) -> Column:
    """A fingerprint with two lanes to a number, for the exchange; `unpacked` undoes it."""
    def pairs(t: Column) -> Column:
        def pair(i: Column) -> Column:
            return F.get(t, 2 * i).bitwiseOR(F.shiftleft(F.coalesce(F.get(t, 2 * i + 1), F.lit(0).cast("long")), 32))

        n = F.ceil(F.size(t) / 2).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), pair)).otherwise(F.array().cast("array<long>"))

    return F.struct(f["mass"].alias("mass"), f["whole"].alias("whole"), let(_trimmed(f["parts"]), pairs).alias("pairs"))


def unpacked(f: Column) -> Column:
    def lane(i: Column) -> Column:
        both = F.coalesce(F.get(f["pairs"], F.floor(i / 2).cast("int")), F.lit(0).cast("long"))
        return _mask(F.when(i % 2 == 0, both).otherwise(F.shiftrightunsigned(both, 32)), 32)

    parts = F.transform(F.sequence(F.lit(0), F.lit(STRATA * LANES - 1)), lane)
    return F.struct(f["mass"].alias("mass"), f["whole"].alias("whole"), parts.alias("parts"))


def spelled(f: Column) -> Column:
    """Text of a fingerprint: mass and whole in hexadecimal, the hashed sums of the parts, without their counts, in base 64."""
    def digits(lanes: Column, width: int) -> Column:
        return F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), width, "0")), "")

    sums = F.transform(f["parts"], lambda x: F.shiftrightunsigned(x, COUNT_BITS))
    exact = F.lower(F.concat(digits(F.array(f["mass"]), 8), digits(f["whole"], 8)))
    return F.concat(exact, F.translate(F.base64(F.unhex(digits(sums, (LANE_BITS - COUNT_BITS) // 4))), "\r\n", ""))


def _id_ranges(ids: DataFrame) -> Column:
    """Number of a row's range of ids, in the ids' order, with about `BUCKET_ROWS` rows in a range.

    Up to `CUTS` ranges end at approximate quantiles; more are got by cutting each of those evenly.
    NULL is in the lowest.
    """
    n, low, high = ids.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    wanted = n // BUCKET_ROWS
    if wanted < 2 or low is None:
        return F.lit(0).cast("long")
    quantiles = min(wanted, CUTS)
    each = -(-wanted // quantiles)
    found = ids.approxQuantile("doc_id", [k / quantiles for k in range(1, quantiles)], 0.25 / quantiles)
    ends = [*sorted({int(c) for c in found if low <= c < high}), int(high)]
    starts = [int(low) - 1, *ends[:-1]]
    end, start = (F.array(*[F.lit(v).cast("long") for v in x]) for x in (ends, starts))
    at = F.size(F.filter(end, lambda c: c < F.col("doc_id")))
    part = (F.col("doc_id") - F.get(start, at) - 1) / (F.get(end, at) - F.get(start, at))
    return F.coalesce(at.cast("long") * each + F.floor(part * each), F.lit(0).cast("long"))


def _with_next(docs: DataFrame, columns: list[str], made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``made(docs)`` with ``next``, a struct of ``columns`` of the next document in descending doc_id.

    A range of ids is one group of the window, and the one row a range lacks, the last of the range below,
    is joined to it. That list has an id for each range, some bytes for `BUCKET_ROWS` documents.
    """
    docs = docs.withColumn("_b", _id_ranges(docs.select("doc_id")))
    last = docs.groupBy("_b").agg(F.max("doc_id").alias("_last"))
    order = Window.partitionBy(F.lit(0)).orderBy("_b")
    everyone = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank, top = F.row_number().over(order), F.last(F.struct("_b", "_last")).over(everyone)
    before = F.when(rank == 1, top).otherwise(F.lag(F.struct("_b", "_last")).over(order))
    below = last.select(F.col("_b").alias("_nb"), before.alias("_p")).select("_nb", "_p.*")
    below = below.select("_nb", F.col("_b").alias("_pb"), F.col("_last").alias("_plast"))
    edge = docs.join(F.broadcast(below), (F.col("_b") == F.col("_pb")) & F.col("doc_id").eqNullSafe(F.col("_plast")))
    edge = made(edge).groupBy("_nb").agg(F.max(F.struct(*columns)).alias("_below"))
    inside = Window.partitionBy("_b").orderBy("doc_id", "text")
    out = made(docs).withColumn("_in", F.lag(F.struct(*columns)).over(inside))
    joined = out.join(edge, F.col("_b") == F.col("_nb"), "left")
    return joined.withColumn("next", F.coalesce("_in", "_below")).drop("_b", "_nb", "_in", "_below")


def with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited text, both fingerprints and the likeness to the edited and the next text.

    NULL and empty texts have the empty fingerprint. Rows are ordered by id, then text, so repeated ids
    have a place each; a NULL id is below all others. A single row is its own next one. An empty table
    gives an empty result. Other columns of ``docs`` are ignored.
    """
    docs = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    rows = _with_next(docs, ["text", "print"], lambda df: df.withColumn("print", let(fingerprint(F.col("text")), packed)))
    rows = rows.select("doc_id", "text", "next.text", "print", "next.print").toDF("doc_id", "text", "next_text", "print", "next_print")
    rows = rows.withColumns({c: let(F.col(c), unpacked) for c in ("print", "next_print")})
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.withColumn("edited", edited).withColumn("edited_print", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id", "text", "edited", "print", "edited_print", likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
