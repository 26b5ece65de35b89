"""Size-checked broadcast and exact handling of hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hexweave.session import materialize

def small_side(df: DataFrame) -> DataFrame:
    """``df`` as a written table, whose bytes Spark knows when it plans the join.

    Below ``spark.sql.autoBroadcastJoinThreshold`` it is broadcast; a larger table meets the other side in
    a shuffle join, whose skewed partitions AQE splits. Writing also keeps its lineage from running twice.
    """
    return materialize(df, "side")


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a shuffle join, for one that grows with the data and compresses well.

    Spark broadcasts by written bytes, which for addresses and cell ids are a small part of what a broadcast takes in memory.
    """
    return df.hint("merge")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(df: DataFrame, on: Sequence[str], share: float = 0.001) -> DataFrame:
    """Keys that hold more than ``share`` of the rows: at most ``1 / share`` of them.

    The counts are combined before the shuffle, so the hot keys cost one row per
    task. NULL keys match nothing and are left out.
    """
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).dropna(subset=list(on))
    floor = df.agg(F.count(F.lit(1)) * share)
    return counts.where(F.col("_n") > floor.scalar()).select(*on)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    salts: int = 32,
    share: float = 0.001,
) -> DataFrame:
    """Equi-join whose hot left keys are spread over ``salts`` tasks.

    Equal rows of a hot key are first counted together, since they would share one salt; each of the
    rows that are left gets a salt from its hash, and only the matching right rows are copied per salt, so
    the result is exactly the plain join's. The list of hot keys is made once, is bounded by
    ``1 / share`` and is broadcast.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError("salted_join spreads the left side: inner, left or left_semi")
    on = list(on)
    hot = F.broadcast(materialize(hot_keys(left, on, share).withColumn("_hot", F.lit(True)), "hot"))
    plain = [
        f.name for f in left.schema.fields
        if f.dataType.typeName() not in ("map", "variant")
    ]
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(salts)).cast("int")
    columns = left.columns
    if len(plain) == len(columns):
        left = left.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).cast("int").alias("_copies"))
    else:  # maps cannot be grouped by
        left = left.withColumn("_copies", F.lit(1))
    left = (
        left.join(hot, on, "left")
        .withColumn("_salt", F.coalesce(F.when(F.col("_hot"), spread), F.lit(0)))
        .drop("_hot")
    )
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = right.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    joined = left.join(right, [*on, "_salt"], how).drop("_salt")
    once = F.sequence(F.lit(1), F.col("_copies"))
    return joined.withColumn("_copy", F.explode(once)).drop("_copies", "_copy")


def global_rank(df: DataFrame, col: str, out: str, buckets: int = 32) -> DataFrame:
    """Average rank of every row of ``df`` by ``col``, without a single-task sort.

    Equal values are counted together first, so a hot value is one row. Values
    fall into ranges cut at approximate quantiles; a row's rank is the number of
    rows in lower ranges plus its position inside its own.
    """
    values = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    cuts = sorted(set(values.approxQuantile(col, [i / buckets for i in range(1, buckets)], 0.005)))
    bucket = F.lit(0)
    for cut in cuts:
        bucket = bucket + F.when(F.col(col) > F.lit(cut), 1).otherwise(0)
    values = values.withColumn("_b", bucket)
    sizes = values.groupBy("_b").agg(F.sum("_n").alias("_size"))
    below = (
        sizes.withColumn("_lower", F.explode(F.sequence(F.col("_b"), F.lit(len(cuts)))))
        .where(F.col("_lower") > F.col("_b"))
        .groupBy(F.col("_lower").alias("_b")).agg(F.sum("_size").alias("_below"))
    )
    inside = Window.partitionBy("_b").orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.col("_below"), F.lit(0)) + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    ranks = (
        values.join(F.broadcast(below), "_b", "left")
        .select(col, (before + (F.col("_n") + 1) / 2).alias(out))
    )
    return df.join(ranks, col, "left")
