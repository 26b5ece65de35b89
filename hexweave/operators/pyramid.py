"""Resolution pyramids: aggregate at the finest level, roll up to coarse ones."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexweave.functions.cells import cell_parent, cell_resolution
from hexweave.operators.filters import value_columns

AGGS = ("AVG", "SUM", "MIN", "MAX", "COUNT", "COUNT_DISTINCT")
WEIGHT = "__pyramid_weight"
LAYOUT = "rebalanced-1"
DEFAULT_MIN_RES = 2
ROLLUP_NOTE = (
    "COUNT_DISTINCT is exact at the finest resolution; coarser levels hold the "
    "largest child's count, a lower bound."
)


def _check(agg: str, values: Sequence[str]) -> str:
    agg = agg.upper()
    if agg not in AGGS:
        raise ValueError(f"agg must be one of {AGGS}, got {agg!r}")
    if agg != "COUNT" and not values:
        raise ValueError("give at least one value column after the cell column (or use COUNT)")
    return agg


def _first_level(agg: str, values: Sequence[str]) -> list[Column]:
    if agg == "COUNT":
        return [F.count(F.lit(1)).alias("count")]
    f = {"SUM": F.sum, "MIN": F.min, "MAX": F.max, "AVG": F.avg, "COUNT_DISTINCT": F.count_distinct}[agg]
    out = [f(c).alias(c) for c in values]
    if agg == "AVG":  # the row count is the layout's weight; each column's mean has its own
        out += [F.count(F.lit(1)).alias(WEIGHT), *[F.count(c).alias(own_weight(c)) for c in values]]
    return out


def own_weight(column: str) -> str:
    """Name of the column that counts the rows with a value."""
    return f"__n_{column}"


def _next_level(agg: str, values: Sequence[str]) -> list[Column]:
    if agg == "COUNT":
        return [F.sum("count").alias("count")]
    if agg == "AVG":
        def mean(c: str) -> Column:
            n = F.col(own_weight(c))
            return F.try_divide(F.sum(F.col(c) * n), F.sum(n)).alias(c)

        own = [F.sum(own_weight(c)).alias(own_weight(c)) for c in values]
        return [mean(c) for c in values] + [F.sum(WEIGHT).alias(WEIGHT), *own]
    f = {"SUM": F.sum, "MIN": F.min, "MAX": F.max, "COUNT_DISTINCT": F.max}[agg]
    return [f(c).alias(c) for c in values]


def detect_resolution(df: DataFrame, h: str) -> int:
    """The one resolution of the cells of ``df``; a mix of resolutions is refused."""
    r = cell_resolution(h)
    low, high = df.agg(F.min(r), F.max(r)).first()
    if low is None:
        raise ValueError(f"cannot detect a resolution: no rows, or {h!r} is not a cell column")
    if low != high:
        raise ValueError(f"{h!r} holds cells of resolutions {low} to {high}")
    return low


def finest_level(df: DataFrame, agg: str, values: Sequence[str] = (), h: str | None = None) -> DataFrame:
    """``(h, h0, values)`` with one row per cell at the data's own resolution."""
    agg = _check(agg, values)
    h = h or df.columns[0]
    source = df.select(F.col(h).alias("h"), cell_parent(h, 0).alias("h0"), *dict.fromkeys(values))
    return source.groupBy("h", "h0").agg(*_first_level(agg, values))


def parent_level(level: DataFrame, res: int, agg: str, values: Sequence[str] = ()) -> DataFrame:
    """One level up. Counts and sums add, means stay weighted, distinct counts
    take the largest child."""
    agg = _check(agg, values)
    return (
        level.withColumn("h", cell_parent("h", res, res + 1)).groupBy("h", "h0").agg(*_next_level(agg, values))
    )


def distinct_levels(df: DataFrame, h: str, key: str, finest: int, min_res: int, out: str = "n_distinct") -> DataFrame:
    """Exact distinct counts at every level, recounted from distinct (cell, key).

    Each level starts from the pairs of the level below, already deduplicated.
    """
    pairs = df.select(F.col(h).alias("h"), F.col(key).alias("_key")).distinct()
    levels = []
    for res in range(finest, min_res - 1, -1):
        pairs = pairs.select(cell_parent("h", res, finest).alias("h"), "_key").distinct()
        levels.append(
            pairs.groupBy("h").agg(F.count("_key").alias(out)).withColumn("res", F.lit(res))
        )
    union = levels[0]
    for level in levels[1:]:
        union = union.unionByName(level)
    return union


def sketch_levels(df: DataFrame, h: str, key: str, finest: int, min_res: int, out: str = "n_distinct") -> DataFrame:
    """Approximate distinct counts at every level from mergeable sketches, one scan."""
    sketches = df.groupBy(F.col(h).alias("h")).agg(F.hll_sketch_agg(key).alias("_s"))
    parents = F.array(*[
        F.struct(F.lit(r).alias("res"), cell_parent("h", r, finest).alias("h")) for r in range(min_res, finest + 1)
    ])
    return (
        sketches.select(F.explode(parents).alias("p"), "_s")
        .groupBy(F.col("p.res").alias("res"), F.col("p.h").alias("h"))
        .agg(F.hll_sketch_estimate(F.hll_union_agg("_s")).alias(out))
    )


def value_stats(levels: DataFrame, values: Sequence[str]) -> DataFrame:
    """min, max and mean of every value column at every level, in one pass."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in values
    ])
    return (
        levels.select("res", F.explode(pairs).alias("p"))
        .groupBy("res", F.col("p.column").alias("column"))
        .agg(F.min("p.v").alias("min"), F.max("p.v").alias("max"), F.avg("p.v").alias("mean"))
    )


def suggest_scale(maximum, mean) -> Column:
    """``log`` for right-skewed values, whose maximum is over ten times the mean."""
    maximum, mean = F.col(maximum), F.col(mean)
    skewed = (mean > 0) & (F.try_divide(maximum, mean) > 10)
    return F.when(F.coalesce(skewed, F.lit(False)), "log").otherwise("linear")


def build_name(source: str, finest: int, min_res: int, agg: str, zoom_offset: int) -> str:
    """Directory name of a build: sixteen hex digits that depend on all inputs."""
    text = json.dumps([LAYOUT, source, finest, min_res, agg.upper(), zoom_offset])
    return hashlib.sha1(text.encode()).hexdigest()[:16]


def _manifest_path(root: str) -> str:
    return f"{root}/manifest"


def read_manifest(spark: SparkSession, root: str) -> dict | None:
    """The manifest of a finished build, or None if absent or incomplete."""
    try:
        rows = spark.read.text(_manifest_path(root), wholetext=True).limit(1).collect()
    except AnalysisException:  # no such path
        return None
    try:
        found = json.loads(rows[0]["value"])
    except (IndexError, ValueError):
        return None
    return found if {"bounds", "feature_count_finest"} <= found.keys() else None


def write_level(level: DataFrame, root: str, res: int, finest: bool) -> None:
    """Write one level. Only the finest is split by h0, which high zooms prune on.

    Rebalancing lets AQE cut a hot h0 into several files and merge tiny ones.
    """
    if finest:
        level.hint("rebalance", F.col("h0")).write.mode("overwrite").partitionBy("h0").parquet(f"{root}/res={res}")
    else:
        level.hint("rebalance").write.mode("overwrite").parquet(f"{root}/res={res}")


def read_level(spark: SparkSession, root: str, res: int) -> DataFrame:
    """One level with h0 as a bigint, from either layout."""
    return spark.read.parquet(f"{root}/res={res}").withColumn("h0", F.col("h0").cast("bigint"))


def read_levels(spark: SparkSession, root: str, min_res: int, finest: int) -> DataFrame:
    out = None
    for res in range(min_res, finest + 1):
        level = read_level(spark, root, res).withColumn("res", F.lit(res))
        out = level if out is None else out.unionByName(level)
    return out


def build_pyramid(
    df: DataFrame, root: str, source: str, agg: str = "AVG", finest: int | None = None,
    min_res: int = DEFAULT_MIN_RES, zoom_offset: int = 2, centers=None,
) -> dict:
    """Write every level of a pyramid and its manifest; return the manifest.

    The first column of ``df`` is the cell, the others are values. Each coarse
    level reads the written level below it, about a seventh of its size, which
    also keeps lineage short. A finished build of the same inputs is returned as
    it is. ``centers(df, h)`` adds ``lat``/``lng`` and enables the bounds.
    """
    spark = df.sparkSession
    h = df.columns[0]
    finest = detect_resolution(df, h) if finest is None else finest
    if finest < min_res:
        raise ValueError(f"finest resolution {finest} is coarser than {min_res}")
    values = [] if agg.upper() == "COUNT" else [c for c in value_columns(df) if c != h]
    agg = _check(agg, values)
    name = build_name(source, finest, min_res, agg, zoom_offset)
    target = f"{root}/{name}"
    done = read_manifest(spark, target)
    if done is not None:
        return {**done, "name": name, "path": target, "cached": True}

    write_level(finest_level(df, agg, values, h), target, finest, True)
    for res in range(finest - 1, min_res - 1, -1):
        write_level(parent_level(read_level(spark, target, res + 1), res, agg, values), target, res, False)

    shown = ["count"] if agg == "COUNT" else values
    stats = value_stats(read_levels(spark, target, min_res, finest), shown)
    stats = stats.withColumn("scale", suggest_scale("max", "mean")).collect()
    base = read_level(spark, target, finest)
    box, count = None, None
    if centers is not None:
        b = pyramid_bounds(centers(base, "h")).collect()[0]
        box, count = [b["west"], b["south"], b["east"], b["north"]], b["feature_count"]
    else:
        count = base.count()
    manifest = {
        "finest_res": finest, "min_res": min_res, "agg": agg, "zoom_offset": zoom_offset,
        "value_columns": shown, "layer_name": "layer", "bounds": box, "feature_count_finest": count,
        "value_stats": {
            c: {
                "by_res": {
                    str(r["res"]): {"min": r["min"], "max": r["max"], "mean": r["mean"]}
                    for r in sorted(stats, key=lambda r: r["res"]) if r["column"] == c
                },
                "suggested_scale": next(
                    (r["scale"] for r in stats if r["column"] == c and r["res"] == finest), "linear"
                ),
            }
            for c in shown
        },
    }
    if agg == "COUNT_DISTINCT":
        manifest["rollup_note"] = ROLLUP_NOTE
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(_manifest_path(target))
    return {**manifest, "name": name, "path": target, "cached": False}


def pyramid_bounds(level: DataFrame) -> DataFrame:
    """Extent of the cell centres (``lat``, ``lng``) and the number of cells."""
    return level.agg(
        F.min("lng").alias("west"), F.min("lat").alias("south"),
        F.max("lng").alias("east"), F.max("lat").alias("north"),
        F.count(F.lit(1)).alias("feature_count"),
    )


# Six evenly spaced colours of the viridis ramp.
RAMP = [
    (0.0, "#440154"), (0.2, "#414487"), (0.4, "#2a788e"),
    (0.6, "#22a884"), (0.8, "#7ad151"), (1.0, "#fde725"),
]

# A logarithmic ramp without a positive minimum starts at this part of the maximum, and
# one without a range ends at this multiple of its start.
LOG_DEPTH, LOG_SPAN = 1000.0, 10.0


def _ramp_domain(low: Column, high: Column, log: bool) -> tuple[Column, Column]:
    low = F.coalesce(low, F.lit(0.0))
    high = F.coalesce(high, low)
    high = F.when(high == low, low + 1).otherwise(high)
    if not log:
        return low, high
    floor = F.when(low > 0, low).when(high > 0, high / LOG_DEPTH).otherwise(F.lit(1.0))
    return floor, F.when(high > floor, high).otherwise(floor * LOG_SPAN)


def ramp_stops(stats: DataFrame, low: str, high: str, scale: str = "linear") -> DataFrame:
    """Six rows per input row: the value and colour of each ramp stop."""
    log = scale == "log"
    lo, hi = _ramp_domain(F.col(low).cast("double"), F.col(high).cast("double"), log)
    stops = F.array(*[
        F.struct(F.lit(f).alias("fraction"), F.lit(c).alias("color")) for f, c in RAMP
    ])
    at = F.col("_s.fraction")
    value = F.col("_lo") * F.pow(F.col("_hi") / F.col("_lo"), at) if log else F.col("_lo") + at * (F.col("_hi") - F.col("_lo"))
    return (
        stats.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_s", F.explode(stops))
        .withColumn("fraction", at).withColumn("color", F.col("_s.color")).withColumn("value", value)
        .drop("_lo", "_hi", "_s")
    )


def ramp_bin(value, low, high, scale: str = "linear") -> Column:
    """Index (0..5) of the last ramp stop at or below a value."""
    lo, hi = _ramp_domain(low, high, scale == "log")
    part = F.ln(F.greatest(value, lo) / lo) / F.ln(hi / lo) if scale == "log" else (value - lo) / (hi - lo)
    at = F.floor(part * (len(RAMP) - 1))
    return F.greatest(F.lit(0), F.least(F.lit(len(RAMP) - 1), at)).cast("int")
