import numpy as np
import pytest
from pyspark.sql import functions as F

from hexweave.functions import cells as c
from hexweave.functions import icosahedron as ico

# Integer and text forms of the same base cells, in the same order.
H0_INT = [
    576531121047601151, 576707042908045311, 576742227280134143, 576812596024311807, 576882964768489471,
    576953333512667135, 576988517884755967, 577094071001022463, 577164439745200127, 577199624117288959,
    577234808489377791, 577692205326532607, 577727389698621439, 577762574070710271, 578114417791598591,
    578149602163687423, 578290339652042751, 578395892768309247, 578747736489197567, 578923658349641727,
    578994027093819391, 579381055186796543, 579451423930974207, 579592161419329535, 579627345791418367,
    579908820768129023, 580119927000662015, 580401401977372671,
]
H0_HEX = [
    "8003fffffffffff", "800dfffffffffff", "800ffffffffffff", "8013fffffffffff", "8017fffffffffff",
    "801bfffffffffff", "801dfffffffffff", "8023fffffffffff", "8027fffffffffff", "8029fffffffffff",
    "802bfffffffffff", "8045fffffffffff", "8047fffffffffff", "8049fffffffffff", "805dfffffffffff",
    "805ffffffffffff", "8067fffffffffff", "806dfffffffffff", "8081fffffffffff", "808bfffffffffff",
    "808ffffffffffff", "80a5fffffffffff", "80a9fffffffffff", "80b1fffffffffff", "80b3fffffffffff",
    "80c3fffffffffff", "80cffffffffffff", "80dffffffffffff",
]


def test_string_forms(spark):
    df = spark.createDataFrame(list(zip(H0_INT, H0_HEX)), "h bigint, s string")
    bad = df.where((c.cell_from_string("s") != F.col("h")) | (c.cell_to_string("h") != F.col("s")))
    assert bad.count() == 0
    assert df.where(c.cell_resolution("h") != 0).count() == 0


def test_parent(spark):
    df = spark.createDataFrame([(613762179077668863,)], "h bigint")
    row = df.select(c.cell_parent("h", 0).alias("p"), c.cell_parent("h", 9).alias("finer"), c.cell_resolution("h").alias("r")).first()
    assert (row.p, row.finer, row.r) == (577762574070710271, None, 8)
    with pytest.raises(ValueError):
        c.cell_parent("h", 16)


def test_children_of_every_base_cell(spark):
    base = spark.range(122).select(c.res0_cell("id").alias("h"))
    counts = {}
    for res in (1, 2):
        kids = c.explode_children(base, "h", 0, res, "k").select("h", "k")
        assert kids.count() == kids.select("k").distinct().count() == 2 + 120 * 7**res
        assert kids.where(c.cell_parent("k", 0) != F.col("h")).count() == 0
        counts[res] = {r["k"] for r in kids.select("k").collect()}
    arrays = base.select(F.explode(c.cell_children("h", 0, 2)).alias("k"))
    assert {r["k"] for r in arrays.collect()} == counts[2]
    # every child is the cell of its own centre
    for res, cells in counts.items():
        h = np.array(sorted(cells))
        assert (ico.index(ico.center(h), res) == h).all()


def test_great_circle(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 90.0)], "a double, b double, c double, d double")
    row = df.select(*[c.great_circle("a", "b", "c", "d", u).alias(n) for u, n in (("km", "km"), ("m", "m"), ("rads", "r"), ("mi", "x"))]).first()
    assert row.km == pytest.approx(6371.007180918475 * np.pi / 2)
    assert row.m == pytest.approx(row.km * 1000) and row.r == pytest.approx(np.pi / 2)
    assert np.isnan(row.x)
