"""Toxicity: a factorization machine over hashed terms.

The score of a text is the logistic of a bias, a weight for each of its terms, and the products of the terms' vectors
for each pair of them. So a pair, such as an insult and the mention of a group, can count for more or less than its
two terms do. Terms are lower-cased words and the beginnings of longer ones, each at most once a text.

1. Documents with and without the label are counted per bucket of hashed terms, over the labelled rows that are not
   held out, combined in each task before they are shuffled.
2. The `TERMS` buckets whose counts depend most on the label are the machine's terms: a table of bounded size.
3. The machine is fitted to their occurrences in at most `LABELLED` documents, by AdaGrad, in one task.
4. All texts are scored where they are; the fitted machine goes to the tasks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexweave.llm.common import pick
from hexweave.llm.subwords import MEMO, slices
from hexweave.session import fresh_dir

BUCKETS = 1 << 22
TERMS = 4096
LABELLED = 100_000
LEAST = 12.0  # G² of a term with the label: chance gives this to five terms in ten thousand
DOCS = 3
FACTORS = 8
BEGINNING = 5
STEPS = 1000
# A fold that is never learned from.
FOLDS = 5

WORD = re.compile(r"[^\W\d_]+")


def bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS


def buckets(word: str) -> tuple[int, ...]:
    """Buckets of a word and, if it is longer, of its beginning."""
    return (bucket(word), bucket(word[:BEGINNING] + "~")) if len(word) > BEGINNING else (bucket(word),)


class Terms:
    """Terms of texts; those of a word are computed once as long as they are remembered."""

    def __init__(self, slots: dict[int, int] | None = None):
        self.slots, self.known = slots, {}

    def of_word(self, word: str) -> tuple[int, ...]:
        found = buckets(word)
        if self.slots is not None:
            found = tuple(self.slots[b] for b in found if b in self.slots)
        if len(self.known) > MEMO:
            self.known.clear()
        self.known[word] = found
        return found

    def of_text(self, text: str | None) -> list[int]:
        known, out = self.known, set()
        for word in set(WORD.findall((text or "").lower())):
            found = known.get(word)
            out.update(self.of_word(word) if found is None else found)
        return sorted(out)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def labelled(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """doc_id, text and y of the rows to learn from: labelled and not held out; the ids are about ``limit`` at most, by hash."""
    known = pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").where(~held_out())
    known = known.groupBy(F.col("doc_id").alias("_id")).agg((F.max("toxic") == 1).cast("int").alias("y"))
    total = known.count()
    if total > limit:
        known = known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * limit / total))
    return pick(docs, "doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id")).drop("_id")


def _occurrences(rows: DataFrame, slots: dict[int, int] | None) -> DataFrame:
    """``rows`` (doc_id, text, y) with ``terms`` in place of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(slots)
        for batch in slices(batches, "text"):
            found = [terms.of_text(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "y", "terms"]
            )

    return rows.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, terms array<int>")


def counts(rows: DataFrame) -> DataFrame:
    """bucket, n and n_toxic: labelled documents with a term of the bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in slices(batches, "text"):
            found = [np.array(terms.of_text(t), np.int64) for t in batch.column("text").to_pylist()]
            y = np.repeat(batch.column("y").to_numpy(), [len(f) for f in found])
            values, at = np.unique(np.concatenate(found), return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(values), pa.array(np.bincount(at, minlength=len(values))), pa.array(np.bincount(at, y, len(values)).astype(np.int64))],
                ["bucket", "n", "n_toxic"],
            )

    each = rows.select("text", "y").mapInArrow(run, "bucket long, n long, n_toxic long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))


def telling(table: DataFrame, n: int, toxic: int, terms: int) -> list[int]:
    """Buckets of the terms that tell most about the label: largest G², ties to the smallest bucket."""
    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    a, b, c = F.col("n_toxic"), F.col("n") - F.col("n_toxic"), F.col("n")
    share = F.lit(toxic / n)
    g2 = 2 * (
        part(a, c * share) + part(b, c * (1 - share)) + part(toxic - a, (n - c) * share) + part(n - toxic - b, (n - c) * (1 - share))
    )
    best = table.where(F.col("n") >= DOCS).withColumn("g2", F.round(g2, 6)).where(F.col("g2") >= LEAST)
    return [r["bucket"] for r in best.orderBy(F.desc("g2"), "bucket").limit(terms).collect()]


# --- the machine ---------------------------------------------------------------------


def raw_scores(flat: np.ndarray, ends: np.ndarray, bias: float, weight: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every text, whose terms are ``flat`` between ``ends``: its score before the logistic, and the sum of its vectors."""
    def total(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])
        return sums[ends[1:]] - sums[ends[:-1]]

    vectors = factor[flat]
    sums = total(vectors)
    pairs = 0.5 * (sums**2 - total(vectors**2)).sum(1)
    return bias + total(weight[flat][:, None])[:, 0] + pairs, sums


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(
    flat: np.ndarray, ends: np.ndarray, y: np.ndarray, terms: int, factors: int = FACTORS, epochs: int = 15,
    batch: int = 256, rate: float = 0.15, decay: float = 1e-4, seed: int = 5,
) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and vectors that fit the labels, by AdaGrad on the logistic loss; the order of rows is a fixed shuffle.

    There are at least ``epochs`` passes over the rows, and as many more as it takes for `STEPS` batches.
    """
    rng = np.random.default_rng(seed)
    weight, factor = np.zeros(terms), rng.normal(0, 0.05, (terms, factors))
    bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 1)))
    if not len(y) or y.min() == y.max():
        return bias, weight, np.zeros((terms, factors))
    slow_b, slow_w, slow_f = 1e-3, np.full(terms, 1e-3), np.full((terms, factors), 1e-3)
    size = np.diff(ends)
    for _ in range(max(epochs, STEPS * batch // len(y))):
        order = rng.permutation(len(y))
        for start in range(0, len(order), batch):
            rows = order[start : start + batch]
            to = np.concatenate([[0], np.cumsum(size[rows])])
            at = flat[np.arange(to[-1]) + np.repeat(ends[rows] - to[:-1], size[rows])]
            owner = np.repeat(np.arange(len(rows)), size[rows])
            score, sums = raw_scores(at, to, bias, weight, factor)
            wrong = (logistic(score) - y[rows]) / len(rows)
            bias_step = wrong.sum()
            weight_step = np.bincount(at, wrong[owner], terms) + decay * weight / terms
            pull = wrong[owner][:, None] * (sums[owner] - factor[at])
            factor_step = decay * factor / terms
            for k in range(factors):
                factor_step[:, k] += np.bincount(at, pull[:, k], terms)
            slow_b += bias_step**2
            slow_w += weight_step**2
            slow_f += factor_step**2
            bias -= rate * bias_step / np.sqrt(slow_b)
            weight -= rate * weight_step / np.sqrt(slow_w)
            factor -= rate * factor_step / np.sqrt(slow_f)
    return bias, weight, factor


def train(docs: DataFrame, labels: DataFrame, terms: int = TERMS, limit: int = LABELLED, factors: int = FACTORS) -> tuple[dict[int, int], np.ndarray]:
    """The places of the chosen buckets, and the machine: a row per term (weight, vector), then one with the bias."""
    folder = fresh_dir(docs.sparkSession, "toxicity")
    rows = labelled(docs, labels, limit)
    counts(rows).write.parquet(f"{folder}/counts")
    table = docs.sparkSession.read.schema("bucket long, n long, n_toxic long").parquet(f"{folder}/counts")
    n, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    slots = {b: i for i, b in enumerate(telling(table, n, toxic, terms))} if 0 < toxic < n else {}
    # One row stands for an id, so that the sample has its bound whatever repeats.
    sample = _occurrences(rows, slots).groupBy("doc_id", "y").agg(F.min("terms").alias("terms"))
    size = max(len(slots), 1)

    def learn(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending")]).combine_chunks()
        y = group.column("y").to_numpy().astype(float)
        lists = group.column("terms").combine_chunks()
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
        bias, weight, factor = fit(lists.flatten().to_numpy().astype(np.int64), ends, y, size, factors)
        whole = np.vstack([np.column_stack([weight, factor]), np.full((1, factors + 1), bias)])
        return pa.table([pa.array([whole.tobytes()], pa.binary())], names=["machine"])

    made = sample.groupBy(F.lit(0).alias("one")).applyInArrow(learn, "machine binary").collect()
    if made:
        return slots, np.frombuffer(made[0]["machine"]).reshape(size + 1, factors + 1)
    return slots, np.vstack([np.zeros((size, factors + 1)), np.full((1, factors + 1), np.log(0.5))])


def score(docs: DataFrame, slots: dict[int, int], machine: np.ndarray) -> DataFrame:
    """doc_id and ``score`` of every row of ``docs``."""
    bias, weight, factor = float(machine[-1, 0]), machine[:-1, 0], machine[:-1, 1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(slots)
        for batch in slices(batches, "text"):
            found = [terms.of_text(t) for t in batch.column("text").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
            flat = np.array([t for f in found for t in f], np.int64)
            raw, _ = raw_scores(flat, ends, bias, weight, factor)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(logistic(raw), 6))], ["doc_id", "score"])

    return pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, terms: int = TERMS, limit: int = LABELLED, factors: int = FACTORS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text).

    NULL and empty texts have no terms: they get the score of the bias. A NULL id is never learned from and counts as held
    out. Rows with one id are scored one by one and count one by one, and one of them is fitted. Of several labels
    of an id toxic wins; NULL labels are none. Without labels, or with labels of one kind only, there are no terms and
    every text gets one score, below 0.5 unless most labels are toxic. A very long text is scored whole. An empty table
    gives an empty result. Other columns are ignored.
    """
    typed = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    out = score(typed, *train(typed, labels, terms, limit, factors))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
