import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use inside.
CLASHES = ["_id", "_key", "_host", "_drop", "_b", "part", "key", "kept", "label", "bands", "spans", "piece", "_text"]

SYLLABLES = ["ka", "lo", "mi", "ne", "pu", "ra", "so", "té", "vi", "ña"]


def words(rng, n):
    return [rng.choice(SYLLABLES) + rng.choice(SYLLABLES) for _ in range(n)]


def corpus(seed=11):
    """(id, text, lang, source, n_chars) rows with copies, near copies, shared passages, ties and odd texts."""
    rng = random.Random(seed)
    rows = []

    def add(i, text, lang="en", source="a"):
        rows.append((i, text, lang, source, None if text is None else len(text)))

    passage = " ".join(words(rng, 60))
    base = [" ".join(words(rng, rng.randint(40, 90))) for _ in range(5)]
    for i in range(60):
        text = ". ".join(" ".join(words(rng, rng.randint(3, 12))).capitalize() for _ in range(rng.randint(1, 9)))
        add(i, f"Home | About\n{text}\nAll rights", ["en", "fr"][i % 2], "ab"[i % 2])
    for i in range(60, 110):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = "x" + rng.choice(SYLLABLES)
        add(i, " ".join(w))
    for i in range(110, 125):
        add(i, " ".join(words(rng, 4)) + " " + passage[: rng.randint(60, 300)] + " " + " ".join(words(rng, 4)), source=None)
    add(125, "Write to ana@mail.example.com or +49 (30) 1234-5678, 4111 1111 1111 1111, host 10.0.0.255, 1.2.3.256.")
    add(126, "a@b.c_d@e.f 4111 1111 1111 1112 007.1.2.3.4 +1 2 ab@c x@y.z." * 3)
    add(127, "$$$ ### %%% " * 30)
    add(128, "ALL CAPS!! " * 40)
    add(129, " ".join(words(rng, 9)) + " " + " ".join(["one two three four five six seven eight"] * 12))
    add(130, None, None, None)
    add(131, "")
    add(132, " \n\t \n")
    add(133, "One")
    add(134, "one")
    add(135, "é" * 70 + " ▁▁ x  y\x00<|endoftext|> 中文 👍🏽")
    add(136, "z" * 40_000)
    add(137, " ".join(words(rng, 12_000)))
    add(None, base[0])
    add(None, None)
    rows += [rows[3], rows[3], rows[61]]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """The corpus with further columns whose names clash with those used inside."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3, "text")
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    good = [(i, 1, 0) for i in range(0, 60, 2)] + [(127, 0, 0), (128, 0, 1), (None, 1, 0), (3, None, None), (131, 1, 0)]
    return spark.createDataFrame(good, "doc_id long, quality int, toxic int")


def ordered(rows):
    return sorted(rows, key=repr)
