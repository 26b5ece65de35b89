"""Spelling variants against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import pytest

from hexweave.llm import queries as q
from hexweave.llm.spelling import neighbours, spelling_variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, letters=5, times=3):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= letters and k >= times}


def links(vocabulary):
    """Near words by patterns: one letter left out, or any letter in one place."""
    near, gaps = defaultdict(set), defaultdict(set)
    for w in vocabulary:
        for i in range(len(w)):
            gaps[w[:i], w[i + 1 :]].add(w)
            if (shorter := w[:i] + w[i + 1 :]) in vocabulary:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in gaps.values():
        for w in group:
            near[w] |= group - {w}
    return near


def brute(rows, letters=5, times=3):
    n = counted(rows, letters, times)
    near = links(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, n[w], form.get(w), root, len(near[w]), n.get(form.get(w))))
    return sorted(out)


def got(df):
    return sorted((r["word"], r["n"], r["form"], r["root"], r["n_near"], r["form_n"]) for r in df.collect())


def test_corpus(docs, rows, nothing):
    assert got(spelling_variants(docs)) == brute([(r[0], r[1]) for r in rows])
    assert spelling_variants(nothing).collect() == []


@pytest.mark.parametrize("letters", [1, 2, 4])
def test_short_words_of_few_letters(spark, letters):
    """All words over few letters: runs of equal letters, edits at both ends, ties of every kind."""
    texts, words = [], ["a", "b"]
    for _ in range(4):
        words += [w + c for w in words if len(w) == len(words[-1]) for c in "abé"]
    words = [w for w in words if hash_of(w) % 3]
    for k, w in enumerate(words):
        texts.append((k, " ".join([w] * (1 + hash_of(w + "n") % 7))))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert got(spelling_variants(df, letters, 1)) == brute(texts, letters, 1)


def hash_of(w):
    return zlib.crc32(w.encode())


def test_long_words_and_hot_nodes(spark):
    """Edits anywhere in words of up to 3,000 letters, a prefix that most words share, chains of forms, repeated rows."""
    base = ["abc" * 1000, "z" * 3000, "préfixe" + "longueur" * 5, "x" * 40]
    texts = []
    for b in base:
        for k in (0, 1, len(b) // 2 - 1, len(b) // 2, len(b) // 2 + 1, len(b) - 2, len(b) - 1, len(b)):
            texts += [b[:k] + "q" + b[k:], b[:k] + "q" + b[k + 1 :], b[:k] + b[k + 1 :], b]
    shared = [f"commonprefix{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{'yz' * (i % 3)}" for i in range(300)]
    data = [(None, " ".join(texts + shared)), (1, " ".join(texts)), (1, " ".join(texts)), (2, " ".join(shared + shared[:9])), (2, None), (3, "")]
    data += [(7, "chain " * 40 + "chainn " * 15 + "chainnn " * 5 + "CHAINnnn " * 2)] * 2
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = brute(data, 5, 2)
    assert got(spelling_variants(df, 5, 2)) == want
    assert {w: r for w, _, _, r, _, _ in want}["chainnnn"] == "chain"


def test_no_join_broadcasts(spark, monkeypatch):
    """Words take many times their written bytes in a driver that gathers them."""
    from pyspark.sql.classic.dataframe import DataFrame
    from pyspark.sql.readwriter import DataFrameWriter

    plans, write, is_empty = [], DataFrameWriter.parquet, DataFrame.isEmpty

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (noted(self._df), write(self, *a, **k))[1])
    monkeypatch.setattr(DataFrame, "isEmpty", lambda self: (noted(self), is_empty(self))[1])
    data = [(1, "chain " * 40 + "chainn " * 15 + "chainnn " * 5 + "CHAINnnn " * 2 + "abcdefghijklmnop " * 3 + "abcdefghijklnnop " * 7)]
    out = spelling_variants(spark.createDataFrame(data, "doc_id long, text string"), 5, 2)
    noted(out)
    assert got(out) == brute(data, 5, 2)
    assert sum("Join" in p for p in plans) >= 6 and not any("Broadcast" in p for p in plans)


def test_query(spark, sf):
    import duckdb

    con = duckdb.connect()
    rows = con.execute(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    assert got(q.op11_spelling(spark, sf)) == brute(rows)
