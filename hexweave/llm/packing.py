"""Best-fit packing: length patterns fitted to the histogram by non-negative least squares.

The corpus is reduced to a histogram of piece lengths, which has at most ``capacity`` entries. On it,
patterns of up to three lengths that fill a sequence exactly are enumerated; their repeat counts are
fitted by non-negative least squares (projected gradient on the sparse pattern matrix), rounded, and
taken as far as the histogram goes; what remains is packed best fit, longest first, again by counts. The
plan's size depends on ``capacity`` alone.

Pieces then take their places: a piece's rank among those of its length says which repeat of which
pattern it belongs to. Ranks are counted in buckets of (length, hash), whose number follows the number
of pieces, so a length that a third of all pieces share is spread over many tasks.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hexweave.llm.common import pick
from hexweave.llm.subwords import Coder, chunked, ragged, raw, slices
from hexweave.session import fresh_dir

CAPACITY = 2048
BUCKET_ROWS = 20_000
STEPS = 300
END = np.array([0], "<u4").tobytes()


# --- pieces ------------------------------------------------------------------


# Words of these letters are lower case and composed already, and one pre-token each.
PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Marks that part from an ASCII letter before them, whatever follows; none is in a special token.
PARTING = np.zeros(256, bool)
PARTING[list(b".,;:!?$#*%&")] = True


@lru_cache(maxsize=1)
def _coder(path: str) -> Coder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    merge = tokenizer.model.tokenize
    spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    letters = {ord(c): spell(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if c != "÷"}

    def encode(chunks: list[str]) -> list[list[int]]:
        words = [c.strip(" ") for c in chunks]
        out: list[list[int]] = [[]] * len(words)
        rest = []
        for i, word in enumerate(words):
            if PLAIN(word):
                out[i] = [t.id for t in merge(word if word.isascii() else word.translate(letters))]
            else:
                rest.append(i)
        for i, coded in zip(rest, tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = coded.ids
        return out

    return Coder(encode)


def _encode(coder: Coder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and where each text's begin.

    The tokenizer drops white space and never joins over it, so texts are cut there. It lowers case, but
    for special tokens, which it looks for first: case is lowered here where none can be.
    """
    content, offsets = raw(texts)
    if not len(content):
        return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
    blank = (content == 32) | ((content >= 9) & (content <= 13))
    content = np.where(blank, np.uint8(32), content)
    if b"<|" not in content.tobytes():
        content = LOWER[content]
    low = content | 32
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    begins[1:] |= PARTING[content[1:]] & (low[:-1] >= 97) & (low[:-1] <= 122)
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begins)
    chunks, codes = chunked(content, starts)
    table, places, numbers = coder.table(chunks)
    flat, ends = ragged(table, places, numbers[codes])
    return flat, ends[np.searchsorted(starts, offsets)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ``ids`` (little-endian unsigned 32-bit) of every row's pieces.

    A document is its ids and a closing 0; only one longer than ``capacity`` is cut. NULL and empty
    texts are the single id 0.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in slices(batches, "text"):
            flat, offsets = _encode(coder, batch.column("text"))
            whole = flat.tobytes()
            rows, number, start, ids = [], [], [], []
            for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                document = whole[4 * a : 4 * b] + END
                for k, at in enumerate(range(0, len(document), 4 * capacity)):
                    rows.append(row)
                    number.append(k)
                    start.append(at // 4)
                    ids.append(document[at : at + 4 * capacity])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    docs = pick(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


# --- plan --------------------------------------------------------------------


def enumerate_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All triples of present lengths (0: none) in descending order that add up to ``capacity``."""
    present = np.zeros(capacity + 1, bool)
    present[lengths] = True
    present[0] = True
    out = [np.zeros((0, 3), np.int64)]
    for a in np.flatnonzero(present)[::-1]:
        if not a or 3 * a < capacity:
            break
        b = np.arange(min(a, capacity - a), -1, -1)
        c = capacity - a - b
        fits = (b >= c) & (c >= 0) & present[b] & present[np.clip(c, 0, capacity)]
        out.append(np.stack([np.full(fits.sum(), a), b[fits], c[fits]], 1))
    return np.concatenate(out)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|, A the number of each length in each pattern.

    Accelerated projected gradient; the step is one over a bound of A's squared norm (the largest row
    sum times the largest column sum).
    """
    size = len(histogram)
    used = patterns > 0

    def times(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(patterns[:, k], np.where(used[:, k], x, 0), size) for k in range(3))

    def transposed(r: np.ndarray) -> np.ndarray:
        return sum(np.where(used[:, k], r[patterns[:, k]], 0) for k in range(3))

    bound = 3 * max(times(np.ones(len(patterns))).max(initial=1), 1)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - transposed(times(y) - histogram) / bound)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and repeat counts that use up the histogram exactly."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    groups: list[tuple[tuple[int, ...], int]] = []
    patterns = enumerate_patterns(np.flatnonzero(left), capacity)
    if len(patterns):
        fitted = fit_counts(patterns, left.astype(float))
        for k in np.argsort(-fitted, kind="stable"):
            if fitted[k] < 0.5:
                break
            pattern = tuple(int(v) for v in patterns[k] if v)
            need = {v: pattern.count(v) for v in pattern}
            n = min(int(np.rint(fitted[k])), *(left[v] // m for v, m in need.items()))
            if n > 0:
                groups.append((pattern, int(n)))
                for v, m in need.items():
                    left[v] -= n * m
    # Residuals: open sequences are kept by the room they have left, as groups with equal contents.
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fit = next((r for r in range(length, capacity) if room.get(r)), None)
            if fit is None:
                # Repeats of one length that share a sequence are opened together.
                each = capacity // length
                if n >= each:
                    room[capacity - each * length].append(((length,) * each, n // each))
                    n %= each
                else:
                    room[capacity - n * length].append(((length,) * n, 1))
                    n = 0
                continue
            content, count = room[fit].pop()
            each = min(fit // length, n)
            take = min(count, max(n // each, 1))
            if take < count:
                room[fit].append((content, count - take))
            room[fit - each * length].append((content + (length,) * each, take))
            n -= take * each
    return groups + [g for r in room.values() for g in r]


def places(groups: list[tuple[tuple[int, ...], int]]) -> dict[int, dict[str, np.ndarray]]:
    """Per length, its runs of ranks: first rank, first sequence id and offset of each run."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, n in groups:
        at = 0
        for length in pattern:
            runs[length].append((ranks[length], sequence, at))
            ranks[length] += n
            at += length
        sequence += n
    return {
        length: {k: np.array(v, np.int64) for k, v in zip(("rank", "sequence", "offset"), zip(*r, strict=True), strict=True)}
        for length, r in runs.items()
    }


# --- assignment --------------------------------------------------------------


def assign(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (doc_id, piece, length, further columns) with ``sequence_id`` and ``offset``.

    ``cut`` is read three times and should be a written table. Ties (repeated ids) are broken by the row's
    hash; equal rows take different places.
    """
    histogram = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `capacity` rows
    total = sum(r["n"] for r in histogram)
    table = cut.sparkSession.sparkContext.broadcast(places(plan({r["length"]: r["n"] for r in histogram}, capacity)))
    buckets = max(1, -(-total // BUCKET_ROWS))
    rows = cut.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = rows.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_b").orderBy("doc_id", "piece")
    ranked = rows.withColumn("_rank", F.row_number().over(inside) - 1).join(sizes, ["length", "_b"]).withColumn(
        "_rank", F.col("_rank") + F.col("_before")
    ).drop("_b", "_before")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = table.value
        for x in batches:
            sequence, offset = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            length, rank = x["length"].to_numpy(), x["_rank"].to_numpy()
            for value in np.unique(length):
                here = np.flatnonzero(length == value)
                r = runs[int(value)]
                k = np.searchsorted(r["rank"], rank[here], "right") - 1
                sequence[here] = r["sequence"][k] + rank[here] - r["rank"][k]
                offset[here] = r["offset"][k]
            yield x.drop(columns="_rank").assign(sequence_id=sequence, offset=offset)

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.select(*cut.columns, "_rank").mapInPandas(place, f"{columns}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, sequence_id, offset, ids_crc32 and, if asked for, ``ids`` of every piece.

    Every row of ``docs`` is packed: NULL and empty texts as the single id 0, repeated rows each on their
    own; a text of any length is cut into pieces of ``capacity``. An empty table gives no pieces.
    Other columns are ignored. The pieces are written to the shared folder once.
    """
    cut = pieces(docs, path, capacity).withColumn("ids_crc32", F.crc32("ids"))
    cut = cut if ids else cut.drop("ids")
    folder = fresh_dir(docs.sparkSession, "pieces")
    cut.write.parquet(folder)
    return assign(docs.sparkSession.read.schema(cut.schema).parquet(folder), capacity)
