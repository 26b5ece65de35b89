"""The factorization machine: its formula, pairs of terms, held-out accuracy."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from hexweave.llm import queries as q
from hexweave.llm import toxicity as tx


def brute_score(ids, bias, weight, factor):
    pairs = sum(factor[i] @ factor[j] for k, i in enumerate(ids) for j in ids[k + 1 :])
    return bias + sum(weight[i] for i in ids) + pairs


def test_scores_are_sums_over_pairs():
    rng = np.random.default_rng(3)
    lists = [[], [2], [0, 1, 5], list(range(9)), [], [7, 8]]
    weight, factor = rng.normal(size=9), rng.normal(size=(9, 4))
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    got, _ = tx.raw_scores(np.array(sum(lists, []), np.int64), ends, 0.3, weight, factor)
    assert np.allclose(got, [brute_score(x, 0.3, weight, factor) for x in lists])


def test_pairs_that_sums_of_weights_miss():
    """Only both together are toxic: one of each alone, which a sum of weights cannot tell from them, is not."""
    rng = random.Random(1)
    lists, y = [], []
    for _ in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        lists.append(sorted([0] * a + [1] * b + rng.sample(range(2, 30), 5)))
        y.append(float(a == b))  # equal or different: no weights can sum to that
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    flat, y = np.array(sum(lists, []), np.int64), np.array(y)
    right = {}
    for factors in (0, 4):
        bias, weight, factor = tx.fit(flat[: ends[3000]], ends[:3001], y[:3000], 30, factors=factors, epochs=30)
        score, _ = tx.raw_scores(flat, ends, bias, weight, factor)
        right[factors] = np.mean((score[3000:] > 0) == (y[3000:] > 0.5))
    assert right[4] > 0.97 and right[0] < 0.7


def corpus(seed=4, n=900):
    """Texts over common words; toxic where an insult meets a group; both occur alone in clean ones."""
    rng = random.Random(seed)
    common = [f"word{chr(97 + i)}" for i in range(26)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(common) for _ in range(rng.randint(5, 60))]
        kind = rng.random()
        if kind < 0.25:
            text += ["Foulish", "groupies"]
        elif kind < 0.40:
            text.append("foulish")
        elif kind < 0.55:
            text.append("groupies")
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(kind < 0.25)))
    return rows, labels


def test_held_out_and_odd_rows(spark, nothing):
    rows, labels = corpus()
    odd = [(None, None), (None, "foulish groupies"), (5001, ""), (5002, None), (5003, "worda " * 60_000 + "foulish groupies"), rows[0], rows[0]]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").repartition(4)
    marks = spark.createDataFrame(labels + [(None, 1), (7, None), (99_999, 1), labels[0]], "doc_id long, toxic int")
    out = tx.toxicity(docs, marks).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in rows + odd)
    truth = dict(labels)
    for r in out:
        fold = 0 if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode()) % 5
        assert r["held_out"] == (fold == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    of = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert of[5003]["predicted"] == 1 and of[5001]["score"] == of[5002]["score"] and of[5001]["predicted"] == 0
    # What is held out changes no score.
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels], "doc_id long, toxic int")
    again = {r["doc_id"]: r["score"] for r in tx.toxicity(docs, flipped).collect()}
    assert again[1] == of[1]["score"] and again[17] == of[17]["score"]
    empty = docs.limit(0)
    assert tx.toxicity(empty, marks).collect() == []
    assert {r["predicted"] for r in tx.toxicity(docs, marks.limit(0)).collect()} == {0}


@pytest.mark.parametrize("limit", [100_000, 150])
def test_query(spark, sf, limit, monkeypatch):
    monkeypatch.setattr(tx, "LABELLED", limit)
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = {r["doc_id"]: r for r in tx.toxicity(docs, labels, limit=limit).collect()}
    assert len(out) == docs.count()
    if limit > 1000:
        assert {r["doc_id"]: tuple(r) for r in q.op13_toxicity(spark, sf).collect()} == {k: tuple(r) for k, r in out.items()}
