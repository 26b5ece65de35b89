"""The prefix trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from hexweave.llm import prefix_trie as pt
from hexweave.llm import queries as q

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    nodes = defaultdict(list)
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(convs.get(c - c % 20, [])[:h] + own[h:])
        for d in range(len(whole[c]) + 1):
            nodes[whole[c][:d]].append(c)
    children = defaultdict(list)
    for n in nodes:
        if n:
            children[n[:-1]].append(n)
    below = {}
    for n in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        below[n] = (
            sum(below[c][0] for c in children[n]) or 1, own + sum(below[c][1] for c in children[n])
        )
    out = []
    for n, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(whole[c]) == len(n))
        out.append((
            min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(children[n]), *below[n],
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def got(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


def talks(seed, n=130):
    """Conversations that share turns, end early, tie, repeat rows, miss their head, or have NULLs."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 400), n):
        for t in range(rng.choice([1, 2, 3, 4, 5, 9])):
            rows.append((c, rng.choice([t, t, t, None, 0]), rng.choice(["user", "assistant", None, ""]), rng.choice(["hello  there", "a b c\td", "", None, "x"])))
    rows += rows[:7] + [(None, 0, "user", "lost"), (None, None, None, None), (-7, 0, "user", "below zero"), (-20, 0, "user", "head")]
    rows += [(1000 + k, t, "user", f"turn {t}") for k in range(25) for t in range(6)]
    return rows


@pytest.mark.parametrize("block", [4096, 3])
def test_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pt, "BLOCK", block)
    rows = talks(5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({c: F.lit("clash") for c in ("key", "depth", "pos", "_part", "a", "leaf", "x.y")})
    assert got(pt.prefix_trie(df)) == brute(rows)


def test_one_long_conversation(spark):
    """A conversation of thousands of turns, others that are prefixes of it, and one with equal rows only."""
    turns = [("user", f"word {k % 7}") for k in range(6000)]
    rows = [(1, k, *t) for k, t in enumerate(turns)]
    rows += [(c, k, *turns[k]) for c in (2, 3) for k in range(40)]
    rows += [(9, None, "user", "same")] * 2500
    assert got(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_nothing_and_turnless(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pt.prefix_trie(empty).collect() == []
    assert pt.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []
    rows = [(c, 0, "user", "only") for c in range(1, 20)]  # no head: those with h > 0 have nothing left
    out = got(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA)))
    assert out == brute(rows) and len(out) == 2


def test_long_lists_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(pt, "BLOCK", 16)
    ends = [("a", c) for c in range(-40, 400)] + [("b", 5), ("c", -1), ("c", 20)]
    df = spark.createDataFrame(ends, "key string, conv_id long").select(F.col("key").cast("binary").alias("key"), "conv_id").repartition(5)
    found = {bytes(r["key"]).decode(): r["ends_sha256"] for r in pt.end_lists(df).collect()}
    for key in "abc":
        ids = ",".join(str(c) for k, c in sorted(ends) if k == key)
        assert found[key] == hashlib.sha256(ids.encode()).hexdigest()


def test_query_and_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    rows = con.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    found = con.sql(f"SELECT {', '.join(names)} FROM ({q.SQL['op12_prefix_trie']})").fetchall()
    assert got(q.op12_prefix_trie(spark, sf)) == brute(rows) == sorted(found, key=repr)
