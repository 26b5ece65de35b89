"""MinHash near-dedup: fast similarity sketches, banding, exact verification, connected components.

A sketch has `T` coordinates. In round i every shingle is hashed to one bin and to a value that grows with
the round; a bin keeps its smallest value, and rounds go on until each bin has one. The second `T` rounds
name the bin outright, so every coordinate fills, and the sketches keep the concentration of the
coordinate-wise MinHash at a cost of about one round for long texts.

Links are found on distinct shingle sets; copies join their class. Sets that agree in a band are a bucket.

1. In each bucket every set is compared with the bucket's smallest id, on the full sets.
2. What that leaves in several components is compared within its bucket: all sets outside the bucket's
   most frequent component against all sets of the bucket, in blocks, through an inverted list of shingles
   inside the task. Pairs are never rows, only the links found are.

So each pair that shares a bucket is either in one component already or compared exactly. Buckets of any
size are split into blocks of bounded size; nothing is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexweave.llm.common import pick
from hexweave.llm.subwords import chunked, ragged, raw, slices
from hexweave.session import fresh_dir

WIDTH = 5  # words in a shingle, and the least similarity in per cent, unless a caller says otherwise
PERCENT = 80
ROWS = 5
BANDS = 32
T = ROWS * BANDS
BLOCK = 2000  # sets compared at once, at most about that many,
BLOCK_SHINGLES = 4_000_000  # and about that many shingles in them
MAX = np.iinfo(np.uint64).max

_ODD = np.random.default_rng(7).integers(1, 2**62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32


def _mixed(h: np.ndarray, turn: int = 0) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[turn]
    h = (h ^ (h >> np.uint64(29))) * _ODD[turn + 1]
    return h ^ (h >> np.uint64(32))


# --- shingles and sketches -------------------------------------------------------


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; a text with fewer words is one shingle."""
    content, offsets = raw(texts)
    empty = np.zeros(0, np.uint64)
    if not len(content):
        return [empty] * len(texts)
    content = _LOWER[content]
    inside = content != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return [empty] * len(texts)
    chunks, codes = chunked(content[starts[0] :], starts - starts[0])
    known = pd.util.hash_array(np.array([c.rstrip(" ") for c in chunks], object), categorize=False)
    word = known[codes]
    bounds = np.searchsorted(starts, offsets)
    whole = word.copy()
    for k in range(1, width):
        whole = whole[:-1] * _ODD[2] + word[k:] if len(whole) > 1 else whole[:0]
    whole = _mixed(whole)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            one = np.array([b - a], np.uint64)
            for k in range(a, b):
                one = one * _ODD[3] + word[k : k + 1]
            out.append(_mixed(one))
        else:
            out.append(empty)
    return out


def sketch(flat: np.ndarray, offsets: np.ndarray, t: int = T) -> np.ndarray:
    """Sketch of every set between offsets, a row each; sets must not be empty."""
    n = len(offsets) - 1
    out = np.full(n * t, MAX, np.uint64)
    rows = np.arange(n)
    for turn in range(2 * t):
        lengths = np.diff(offsets)
        h = _mixed(flat + np.full(1, turn + 1, np.uint64) * _ODD[4], 5)
        value = (np.uint64(turn) << np.uint64(54)) | (h >> np.uint64(10))
        if turn < t:
            place = np.repeat(rows * t, lengths) + (_mixed(h, 1) % np.uint64(t)).astype(np.int64)
            np.minimum.at(out, place, value)
        else:
            least = np.minimum.reduceat(value, offsets[:-1])
            at = rows * t + (turn - t)
            out[at] = np.minimum(out[at], least)
        open_ = np.flatnonzero((out.reshape(n, t)[rows] == MAX).any(1))
        if not len(open_):
            break
        if len(open_) < len(rows):
            flat, offsets = ragged(flat, offsets, open_)
            rows = rows[open_]
    return out.reshape(n, t)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """One number per band; the band's place is part of it."""
    n = len(sketches)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (n, BANDS)).copy()
    for k in range(ROWS):
        keys = _mixed(keys * _ODD[6] + sketches.reshape(n, BANDS, ROWS)[:, :, k])
    return keys.view(np.int64)


def features(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set and its band keys (none for an empty set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), width)
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            keys = np.zeros((0, BANDS), np.int64)
            if len(full):
                offsets = np.concatenate([[0], np.cumsum(sizes[full])])
                keys = band_keys(sketch(np.concatenate([sets[i] for i in full]), offsets))
            place = np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(sizes, pa.int64()),
                    pa.array([_digest(s) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(place), pa.array(keys.ravel())),
                ],
                ["doc_id", "n_shingles", "digest", "bands"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _packed(values: np.ndarray) -> bytes:
    """A sorted set at 48 bits a value, as differences, byte by byte."""
    steps = np.diff(np.unique(values >> np.uint64(16)), prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T[:6]).tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(6, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :6] = planes.T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def packed_sets(texts: DataFrame, width: int) -> DataFrame:
    """id, digest and ``set`` of every row (id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), width)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array([_digest(s) for s in sets], pa.binary()),
                    pa.array([_packed(s) for s in sets], pa.binary()),
                ],
                ["id", "digest", "set"],
            )

    return texts.mapInArrow(run, "id long, digest binary, set binary")


# --- comparing -------------------------------------------------------------------


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.repeat(np.arange(len(sets)), sizes), sizes


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(a: list[int], b: list[int]) -> pa.Table:
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=LINKS)


def _with_hub(group: pa.Table, percent: int) -> pa.Table:
    """Links of the rows of a group to its hub, the row whose id is the hub's."""
    hub = group.column("hub")[0].as_py()
    ids = group.column("id").to_pylist()
    sets = [_unpacked(s) for s in group.column("set").to_pylist()]
    own = next((s for i, s in zip(ids, sets, strict=True) if i == hub), None)
    if own is None:
        return _links([], [])
    flat, owner, sizes = _flat(sets)
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    both = np.bincount(owner[own[at] == flat], minlength=len(ids))
    near = 100 * both >= percent * (sizes + len(own) - both)
    found = sorted({ids[i] for i in np.flatnonzero(near)} - {hub})
    return _links(found, [hub] * len(found))


def _inside_bucket(group: pa.Table, percent: int) -> pa.Table:
    """For each asking set, a link to one similar set of every other component in the block."""
    ids = np.array(group.column("id").to_pylist(), np.int64)
    label = np.array(group.column("label").to_pylist(), np.int64)
    asks = np.array(group.column("asks").to_pylist(), bool)
    sets = [_unpacked(s) for s in group.column("set").to_pylist()]
    rest, asking = np.flatnonzero(~asks), np.flatnonzero(asks)
    flat, owner, sizes = _flat([sets[i] for i in rest])
    if not len(flat) or not len(asking):
        return _links([], [])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    values, first = np.unique(flat, return_index=True)
    postings = np.append(first, len(flat))
    a: list[int] = []
    b: list[int] = []
    for i in asking:
        own = sets[i]
        at = np.minimum(np.searchsorted(values, own), len(values) - 1)
        hits, _ = ragged(owner, postings, at[values[at] == own])
        both = np.bincount(hits, minlength=len(rest))
        near = np.flatnonzero((100 * both >= percent * (sizes + len(own) - both)) & (label[rest] != label[i]))
        if len(near):
            _, one = np.unique(label[rest[near]], return_index=True)
            b.extend(ids[rest[near[one]]].tolist())
            a.extend([int(ids[i])] * len(one))
    return _links(a, b)


# --- components ------------------------------------------------------------------


def components(links: DataFrame, folder: str) -> DataFrame:
    """id and label, the smallest id of its component, of every id in ``links`` (a, b).

    Rounds of large-star and small-star: edges are hung on the smallest neighbour until each id hangs on
    the smallest of its component. Each round is written, and only counts reach the driver.
    """
    spark = links.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema("u long, v long").parquet(f"{folder}/{name}")

    # u > v throughout
    edges = kept(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "0"
    )
    state = None
    for turn in count(1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(lowest, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(
            lowest.select("u", F.col("m").alias("v"))
        ).distinct()
        edges = kept(small, str(turn))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _blocks(n: Column, shingles: Column) -> Column:
    """How many blocks so many sets take, by their number and their sizes."""
    return F.ceil(F.greatest(n / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")


def near_dedup(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Rows with one id are one document: they share its component, for which the row with the smallest set
    digest stands. NULL and empty texts, and those without a word, have no shingles and link with nothing.
    NULL ids have no component and are kept. A very long text is one set like any other. An empty table
    gives an empty result. Other columns of ``docs`` are ignored.
    """
    spark: SparkSession = docs.sparkSession
    folder = fresh_dir(spark, "near")
    docs = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    made = _write(features(docs, width), f"{folder}/features")
    some = made.where("doc_id is not null and n_shingles > 0")
    ids = some.groupBy("doc_id").agg(F.min("digest").alias("digest"), F.count(F.lit(1)).alias("rows"))
    repeated = not ids.where("rows > 1").isEmpty()  # then rows with one id are reduced to one, below
    classes = _write(
        ids.groupBy("digest").agg(F.min("doc_id").alias("id")).select("id", "digest"), f"{folder}/classes"
    )
    # One row per class and band; buckets of one set are dropped.
    standing = some.join(classes, (some["doc_id"] == classes["id"]) & (some["digest"] == classes["digest"]), "left_semi")
    standing = standing.dropDuplicates(["doc_id"]) if repeated else standing
    bands = standing.select(F.col("doc_id").alias("id"), "n_shingles", F.explode("bands").alias("bucket"))
    hubs = bands.groupBy("bucket").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = _write(bands.join(hubs, "bucket"), f"{folder}/members")

    # 1. Every set against the smallest id of each of its buckets.
    pairs = members.where("id <> hub").select("hub", "id", "n_shingles").distinct()
    counts = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    everyone = members.select("id").distinct()
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(everyone, "id")
    sets = packed_sets(texts, width)
    if repeated:
        sets = sets.where(F.length("set") > 0).groupBy("id").agg(F.min(F.struct("digest", "set")).alias("s")).select("id", "s.*")
    sets = _write(sets.select("id", "set"), f"{folder}/sets")
    blocks = counts.select("hub", _blocks(F.col("n"), F.col("shingles")).alias("blocks"))
    asked = pairs.join(blocks, "hub").select(
        "hub", "id", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    ).unionByName(blocks.select(
        "hub", F.col("hub").alias("id"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    ))

    def with_hub(group: pa.Table) -> pa.Table:
        return _with_hub(group, percent)

    first = _write(
        asked.join(sets, "id").groupBy("hub", "block").applyInArrow(with_hub, "a long, b long"), f"{folder}/links1"
    )
    labels = components(first, f"{folder}/components1")

    # 2. Buckets that still hold several components.
    labelled = members.select("bucket", "id", "n_shingles").join(labels, "id", "left").select(
        "bucket", "id", F.coalesce("label", "id").alias("label"), "n_shingles"
    )
    each = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"))
    sizes = each.groupBy("bucket").agg(
        F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "label", "size")).alias("most"),
        F.count(F.lit(1)).alias("labels"),
    ).where("labels > 1").select(
        "bucket", F.col("most.label").alias("main"), _blocks(F.col("n"), F.col("size")).alias("yb"),
        _blocks(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("xb"),
    )
    open_ = labelled.join(sizes, "bucket")
    place = F.xxhash64("id")
    asking = open_.where("label <> main").select(
        "bucket", "id", "label", F.lit(True).alias("asks"), F.pmod(place, F.col("xb")).cast("int").alias("x"),
        F.explode(F.sequence(F.lit(0), F.col("yb") - 1)).alias("y"),
    )
    answering = open_.select(
        "bucket", "id", "label", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("xb") - 1)).alias("x"),
        F.pmod(place, F.col("yb")).cast("int").alias("y"),
    )

    def inside(group: pa.Table) -> pa.Table:
        return _inside_bucket(group, percent)

    second = asking.unionByName(answering).join(sets, "id").groupBy("bucket", "x", "y").applyInArrow(
        inside, "a long, b long"
    )
    second = _write(second, f"{folder}/links2")
    joined = labels.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(second)
    final = components(joined, f"{folder}/components2")

    # Back to documents: class, then component.
    by_id = ids.join(classes, "digest").select(F.col("doc_id").alias("_id"), F.col("id").alias("_class"))
    by_id = by_id.join(final.select(F.col("id").alias("_class"), "label"), "_class", "left").select(
        "_id", F.coalesce("label", "_class").alias("_component")
    )
    out = made.select("doc_id", "n_shingles").join(by_id, F.col("doc_id") == F.col("_id"), "left")
    component = F.coalesce("_component", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def near_dedup_sql(width: int = 2, percent: int = PERCENT) -> str:
    """The same over ``documents`` for DuckDB, by counting shared shingles of all pairs: for small tables."""
    shingle = " || ' ' || ".join(f"ws[i + {k}]" for k in range(width))
    return f"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
    ), sets AS (
        SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')]
            ELSE list_distinct([{shingle} for i in range(1, len(ws) - {width} + 2)]) END AS s FROM words
    ), each AS (
        SELECT doc_id, unnest(s) AS x FROM sets
    ), pairs AS (
        SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS k FROM each a JOIN each b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
    ), links AS (
        SELECT a, b FROM pairs JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b
        WHERE 100 * k >= {percent} * (len(p.s) + len(q.s) - k)
    ), reach(d, r) AS (
        SELECT doc_id, doc_id FROM documents
        UNION SELECT d, l.r FROM reach JOIN (SELECT a AS l, b AS r FROM links UNION ALL SELECT b, a FROM links) l ON reach.r = l.l
    )
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept
    FROM sets JOIN (SELECT d, MIN(r) AS c FROM reach GROUP BY d) ON d = doc_id"""
