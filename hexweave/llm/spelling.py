"""Spelling variants: words one edit apart, found by a frontier of trie states.

A state is (word, position, node, edits). Nodes are prefixes, named by a hash of the prefix, its direction and the
length of the words below it, so there is one trie for each length. An edit lies in a word's second half,
or in that of the word read backwards; so words are walked in both directions, and each state without an edit starts
at the node of its word's first half, below which the trie is thin.

1. A replaced character: words of one length that meet at (node, any character, the `AHEAD` characters that
   follow it) are states with one edit wherever another character stands there too.
2. A deleted character: the state stays on its node, in the trie of the words one character shorter. An inserted
   one is the same link seen from the other word.
3. Level by level, the open states are joined with the edge table (node, next characters) of their level. A level
   reads `STEP` times as many characters as the one before, so even very long words take few rounds. A state that ends
   with a word is terminal, and its word and the one it reached are neighbours.

An edit in a run of equal characters has one place, the run's end. Nothing is a list of a node's words: a slot
holds the distinct characters found there, which the alphabet bounds, and a node that many words pass is split by AQE.

No join broadcasts: words and keys are few written bytes, and several times that in a driver that gathers them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexweave.llm.common import pick
from hexweave.llm.subwords import slices
from hexweave.operators.sizing import shuffled
from hexweave.session import fresh_dir

# What a run is, which characters are lower-cased, and the rule that edits some of the runs.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EVERY = 97
LETTERS = 5
TIMES = 3

AHEAD = 3
STEP = 4

_ODD = [np.uint64(k) for k in np.random.default_rng(41).integers(1, 2**62, 6) * 2 + 1]
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def count_words(docs: DataFrame, letters: int = LETTERS, times: int = TIMES) -> DataFrame:
    """word and n, its occurrences in all texts, of the words that are long and frequent enough."""
    text = F.coalesce("text", F.lit(""))
    runs = pick(docs, "doc_id", "text").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"),
    ).where(F.char_length("run") >= letters)  # an edit makes a word shorter, never longer
    # Only runs with a capital pay for the exact lower-casing.
    lowered = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", UPPER, LOWER))
    coded = runs.select(lowered.alias("run"), F.crc32(F.concat("id", F.lit(":"), lowered).cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("run"))
    return coded.groupBy(word.alias("word")).agg(F.count(F.lit(1)).alias("n")).where(
        (F.char_length("word") >= letters) & (F.col("n") >= times)
    )


# --- hashes of prefixes and of what follows them -------------------------------------


def _mixed(h: np.ndarray, turn: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[turn]
    return h ^ (h >> np.uint64(29))


class Letters:
    """Code points of some words, in one direction, and the hashes of their parts."""

    def __init__(self, texts: list[str], backwards: np.ndarray | bool):
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
        owner = np.repeat(np.arange(len(texts)), self.size)
        place = np.arange(len(points)) - self.start[owner]
        self.back = np.broadcast_to(np.asarray(backwards), len(texts))
        # The letter that is read at a place, from the front or from the back.
        read = np.where(self.back[owner], self.start[owner + 1] - 1 - place, np.arange(len(points)))
        self.owner, self.place, self.points = owner, place, points[read]
        longest = int(self.size.max(initial=0)) + 1
        self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(longest, _BASE, np.uint64)]))
        self.inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(longest, _BACK, np.uint64)]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.points + np.uint64(1)) * self.power[place])])

    def part(self, word: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the letters from a to b of some words, wherever they stand."""
        at = self.start[word]
        return (self.sums[at + b] - self.sums[at + a]) * self.inverse[a]

    def node(self, word: np.ndarray, depth: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The prefix of that depth, in the trie of the words of a length."""
        seed = (length * 2 + self.back[word]).astype(np.uint64) * _ODD[0] + depth.astype(np.uint64) * _ODD[1]
        return _mixed(self.part(word, np.zeros_like(depth), depth) + seed, 2)

    def edge(self, word: np.ndarray, depth: np.ndarray, length: np.ndarray, a: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Key of the edge that leaves a node with up to ``step`` letters from place a, and whether the word ends with it."""
        b = np.minimum(a + step, self.size[word])
        ends = b == self.size[word]
        key = self.node(word, depth, length) * _ODD[3] + self.part(word, a, b) * _ODD[4] + ends.astype(np.uint64) * _ODD[5]
        return _mixed(key, 5).view(np.int64), ends

    def half(self) -> np.ndarray:
        """Of every letter: is it in the half of its word that edits are looked for in."""
        size = self.size[self.owner]
        return self.place >= np.where(self.back[self.owner], size - size // 2, size // 2)


def _names(letters: Letters) -> np.ndarray:
    """A number for each word; two words with one number would only add candidates, which are verified."""
    every = np.arange(len(letters.size))
    return _mixed(letters.part(every, np.zeros_like(letters.size), letters.size) + letters.size.astype(np.uint64), 4).view(np.int64)


def named(words: DataFrame) -> DataFrame:
    """``words`` (word, n) with ``name``, their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "word"):
            letters = Letters(batch.column("word").to_pylist(), False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_names(letters))], [*batch.schema.names, "name"])

    return words.mapInArrow(run, "word string, n long, name long")


def _walk(words: DataFrame, emit: Callable[[Letters], list[np.ndarray]], schema: str) -> DataFrame:
    """Rows made from all words, read from the front and from the back."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "word"):
            texts = batch.column("word").to_pylist()
            for backwards in (False, True):
                columns = emit(Letters(texts, backwards))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return words.select("word").mapInArrow(run, schema)


def _own_names(letters: Letters, word: np.ndarray) -> np.ndarray:
    """Numbers by the words as they are written, whatever the direction."""
    if not letters.back.any():
        return _names(letters)[word]
    forward = letters.size[letters.owner] - 1 - letters.place
    points = letters.points[letters.start[letters.owner] + forward]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points + np.uint64(1)) * letters.power[letters.place])])
    whole = sums[letters.start[1:]] - sums[letters.start[:-1]]
    return _mixed(whole + letters.size.astype(np.uint64), 4).view(np.int64)[word]


def slots(words: DataFrame) -> DataFrame:
    """One row per word, direction and place of its second half: what surrounds the letter there, and the letter."""
    def emit(x: Letters) -> list[np.ndarray]:
        at = np.flatnonzero(x.half())
        word, place = x.owner[at], x.place[at]
        key, ends = x.edge(word, place, x.size[word], place + 1, AHEAD)
        return [key, x.points[at].astype(np.int32), _own_names(x, word), place.astype(np.int32), x.back[word], ends]

    return _walk(words, emit, "key long, letter int, name long, place int, back boolean, ends boolean")


def deletions(words: DataFrame) -> DataFrame:
    """States with one letter skipped, and the edge that each of them asks for."""
    def emit(x: Letters) -> list[np.ndarray]:
        following = np.concatenate([x.points[1:], np.zeros(1, np.uint64)])
        last = x.place == x.size[x.owner] - 1
        at = np.flatnonzero(x.half() & (last | (following != x.points)))
        word, place = x.owner[at], x.place[at]
        key, ends = x.edge(word, place, x.size[word] - 1, place + 1, STEP)
        return [key, _own_names(x, word), place.astype(np.int32), x.back[word], ends]

    return _walk(words, emit, "key long, name long, place int, back boolean, ends boolean")


def edges(words: DataFrame, step: int) -> DataFrame:
    """The distinct edges of ``step`` letters, or fewer at a word's end, that leave nodes past the middle of their words."""
    def emit(x: Letters) -> list[np.ndarray]:
        every = np.arange(len(x.size))
        low = x.size // 2
        # Also the node of the whole word, from which nothing is left to read.
        word = np.repeat(every, x.size - low + 1)
        place = np.arange(len(word)) - np.repeat(np.cumsum(x.size - low + 1) - (x.size - low + 1), x.size - low + 1) + low[word]
        key, _ = x.edge(word, place, x.size[word], place, step)
        return [key]

    return _walk(words, emit, "key long").distinct()


def asked(states: DataFrame, step: int) -> DataFrame:
    """The edge of ``step`` letters that each open state (word, target, back, place) asks for, and the place after it."""
    schema = "word string, target string, back boolean, place int, key long, ends boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "target"):
            x = Letters(batch.column("target").to_pylist(), batch.column("back").to_numpy(zero_copy_only=False))
            place = batch.column("place").to_numpy().astype(np.int64)
            every = np.arange(len(place))
            key, ends = x.edge(every, place, x.size, place, step)
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("target"), batch.column("back"),
                 pa.array(np.minimum(place + step, x.size).astype(np.int32)), pa.array(key), pa.array(ends)],
                ["word", "target", "back", "place", "key", "ends"],
            )

    return states.select("word", "target", "back", "place").mapInArrow(run, schema)


# --- the frontier --------------------------------------------------------------------


def neighbours(words: DataFrame, folder: str) -> DataFrame:
    """a, b and their counts n_a, n_b, both ways round, of all words (word, n, name) one edit apart."""
    spark: SparkSession = words.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    # The place of the edit in the word as it is written, counted from 0.
    size = F.char_length("word")
    at = F.when(F.col("back"), size - 1 - F.col("place")).otherwise(F.col("place"))
    before, after = F.substring("word", F.lit(1), at), F.substring("word", at + 2, size)

    met = slots(words)
    letters = met.groupBy("key").agg(F.sort_array(F.collect_set("letter")).alias("letters")).where(F.size("letters") > 1)
    replaced = met.join(shuffled(letters), "key").select(
        "name", "place", "back", "ends", F.explode(F.filter("letters", lambda c: c > F.col("letter"))).alias("other")
    ).join(shuffled(words.select("name", "word")), "name").select(
        "word", F.concat(before, F.char("other"), after).alias("target"), "back",
        (F.col("place") + 1 + AHEAD).alias("place"), "ends",
    )
    skipped = deletions(words).join(shuffled(edges(words, STEP)), "key", "left_semi").join(shuffled(words.select("name", "word")), "name").select(
        "word", F.concat(before, after).alias("target"), "back", (F.col("place") + STEP).alias("place"), "ends"
    )
    states = kept(replaced.unionByName(skipped), "states")
    found, step, turn = [states.where("ends")], STEP, 0
    states = states.where("not ends")
    while not states.isEmpty():
        turn, step = turn + 1, step * STEP
        met = kept(asked(states, step).join(shuffled(edges(words, step)), "key", "left_semi").drop("key"), f"states{turn}")
        found.append(met.where("ends"))
        states = met.where("not ends")
    reached = found[0].select("word", "target")
    for more in found[1:]:
        reached = reached.unionByName(more.select("word", "target"))
    # The words themselves confirm what the hashes say.
    pairs = kept(
        reached.distinct()
        .join(shuffled(words.select(F.col("word").alias("target"), F.col("n").alias("n_b"))), "target")
        .join(shuffled(words.select("word", F.col("n").alias("n_a"))), "word")
        .select(F.col("word").alias("a"), "n_a", F.col("target").alias("b"), "n_b"), "pairs",
    )
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """word and root, the end of the chain of forms (word, form), of every word that has a form.

    Each round doubles the length of what is followed; a form is at least twice as frequent as its word, so chains are
    short and have no cycles.
    """
    spark = forms.sparkSession
    forms.select("word", F.col("form").alias("root")).write.parquet(f"{folder}/roots0")
    turn = 0
    while True:
        now = spark.read.schema("word string, root string").parquet(f"{folder}/roots{turn}")
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(shuffled(further), "root", "left_semi").isEmpty():
            return now
        turn += 1
        now.join(shuffled(further), "root", "left").select("word", F.coalesce("next", "root").alias("root")).write.parquet(f"{folder}/roots{turn}")


def spelling_variants(docs: DataFrame, letters: int = LETTERS, times: int = TIMES) -> DataFrame:
    """word, n, form, root, n_near and form_n of every word of ``docs`` (doc_id, text).

    NULL and empty texts have no runs; a NULL id counts as an empty one where runs are edited. Repeated rows count again. A
    very long run is one word like any other. Of near words with one count the smallest in code-point order is the form. Words
    without a near word have ``n_near`` 0, no form, and are their own root. An empty table gives an empty
    result. Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    folder = fresh_dir(spark, "spelling")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named(count_words(docs, letters, times).repartition(parts, "word")).write.parquet(f"{folder}/words")
    words = spark.read.schema("word string, n long, name long").parquet(f"{folder}/words")
    near = neighbours(words, folder).groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("form"))).alias("best")
    )
    out = words.select("word", "n").join(shuffled(near), "word", "left").withColumn("form_n", -F.col("best.n"))
    has = F.col("form_n") >= 2 * F.col("n")
    out.select(
        "word", "n", F.when(has, F.col("best.form")).alias("form"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(has, F.col("form_n")).alias("form_n"),
    ).write.parquet(f"{folder}/forms")
    made = spark.read.schema("word string, n long, form string, n_near long, form_n long").parquet(f"{folder}/forms")
    ends = roots(made.where("form is not null"), folder)
    return made.join(shuffled(ends), "word", "left").select(
        "word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n"
    )


def spelling_sql(letters: int = LETTERS, times: int = TIMES) -> str:
    """The same over ``documents`` for DuckDB, with near words found by the patterns that they share."""
    return f"""
    WITH RECURSIVE crc AS (
        SELECT list(c ORDER BY i) AS t FROM (
            SELECT i, list_reduce([i] || [k::UBIGINT FOR k IN range(8)],
                                  lambda a, k: CASE WHEN a & 1 = 1 THEN xor(3988292384::UBIGINT, a >> 1) ELSE a >> 1 END) AS c
            FROM (SELECT unnest(range(256))::UBIGINT AS i))
    ), found AS (
        SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
               unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{RUN}')) AS run FROM documents
    ), runs AS (
        SELECT id, run, count(*) AS times FROM found WHERE length(run) >= {letters} GROUP BY 1, 2
    ), hashed AS (
        SELECT run, times, xor(4294967295::UBIGINT, list_reduce(
            [4294967295::UBIGINT] || flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)::UBIGINT]
                ELSE [(192 + unicode(c) // 64)::UBIGINT, (128 + unicode(c) % 64)::UBIGINT] END FOR c IN string_split(id || ':' || run, '')]),
            lambda a, b: xor(t[1 + (xor(a, b) & 255)::BIGINT], a >> 8))) AS h
        FROM runs, crc
    ), words AS (
        SELECT CASE WHEN h % {EVERY} = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word,
               CAST(sum(times) AS BIGINT) AS n
        FROM hashed GROUP BY 1 HAVING length(word) >= {letters} AND sum(times) >= {times}
    ), gaps AS (
        SELECT word, n, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)
    ), links AS (
        SELECT x.word, y.word AS near, y.n FROM gaps x JOIN gaps y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
        UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON w.word = g.a || g.b
        UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON w.word = g.a || g.b
    ), best AS (
        SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, encode(near)) AS form, max(n) AS form_n FROM links GROUP BY 1
    ), forms AS (
        SELECT w.word, w.n, CASE WHEN form_n >= 2 * w.n THEN form END AS form, coalesce(n_near, 0) AS n_near,
               CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n
        FROM words w LEFT JOIN best b ON w.word = b.word
    ), chain(word, root) AS (
        SELECT word, word FROM forms
        UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL
    )
    SELECT f.word, f.n, f.form, c.root, f.n_near, f.form_n
    FROM forms f JOIN chain c ON c.word = f.word JOIN forms e ON e.word = c.root AND e.form IS NULL"""
