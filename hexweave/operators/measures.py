"""Totals, shares and checks that stay right on replicated or partial hex data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexweave.functions.cells import cell_parent, column_name
from hexweave.operators.filters import is_valid
from hexweave.operators.joins import clip_to_mask, hex_join, keys, unique_cells, with_h0, with_parent
from hexweave.operators.sizing import global_rank, shuffled
from hexweave.session import materialize

# Rough mean cell area in square kilometres per resolution.
ROUGH_KM2 = {5: 252.9, 6: 36.13, 7: 5.161, 8: 0.7373, 9: 0.1053, 10: 0.01505}
ACRES_PER_KM2 = 247.105


def _cols(by: str | Sequence[str] | None) -> list[str]:
    return [] if by is None else [by] if isinstance(by, str) else list(by)


# --- cells -------------------------------------------------------------------


def aggregate_cells(df: DataFrame, res: int, *aggs: Column) -> DataFrame:
    """One row per cell of a raster layer that has many rows per cell."""
    return with_h0(df, res).groupBy(*keys(res)).agg(*aggs)


def dominant_class(df: DataFrame, res: int, class_col: str, out: str = "dominant") -> DataFrame:
    """Most frequent class per cell; the smallest class wins a tie.

    Counting per (cell, class) first leaves a hot cell with one row per class.
    """
    counts = (
        with_h0(df, res).where(F.col(class_col).isNotNull())
        .groupBy(*keys(res), class_col).agg(F.count(F.lit(1)).alias("_n"))
    )
    top = F.max("_n")
    best = counts.groupBy(*keys(res)).agg(
        F.min_by(class_col, F.struct(-F.col("_n"), F.col(class_col))).alias(out), top.alias("n_rows")
    )
    return best


def mask_then_dominant(df, mask, res, class_col, where=None) -> DataFrame:
    return dominant_class(clip_to_mask(df, mask, res, where), res, class_col)


def cell_owner(df: DataFrame, res: int, owner: str) -> DataFrame:
    """One owner per cell; the smallest owner wins a cell on a boundary."""
    return aggregate_cells(df, res, F.min(owner).alias(owner))


def richness(df: DataFrame, res: int, key: str, out: str = "richness") -> DataFrame:
    return aggregate_cells(df, res, F.count_distinct(key).alias(out))


def rows_per_cell(df: DataFrame, res: int, by: str | Sequence[str] | None = None) -> DataFrame:
    """Rows per distinct cell and what that ratio says about the layer."""
    by = _cols(by)
    cells = with_h0(df, res).groupBy(*dict.fromkeys([*by, *keys(res)])).agg(F.count(F.lit(1)).alias("_n"))
    ratio = F.col("total_rows") / F.col("unique_cells")
    kind = (
        F.when(ratio < 1.05, "one_per_cell")
        .when((F.abs(ratio - F.round(ratio)) < 0.05) | (ratio < 2), "overlap")
        .otherwise("raster")
    )
    return (
        cells.groupBy(*by)
        .agg(F.sum("_n").alias("total_rows"), F.count(F.lit(1)).alias("unique_cells"))
        .withColumn("avg_rows_per_cell", ratio).withColumn("kind", kind)
    )


# --- features ----------------------------------------------------------------


def sum_features(df: DataFrame, feature_id: str, col: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """Sum of a feature attribute that is repeated on every cell of the feature."""
    by = _cols(by)
    return df.select(feature_id, *by, col).distinct().groupBy(*by).agg(F.sum(col).alias(col))


def unique_cells_sum(features, regions, values, res: int, by: str, col: str) -> DataFrame:
    """Sum of ``col`` per region over cells that features cover, each counted once.

    Values are summed per cell and regions reduced to (cell, region) before the
    join, so no hot cell meets another one row by row.
    """
    per_cell = aggregate_cells(clip_to_mask(values, features, res), res, F.sum(col).alias(col))
    owned = with_h0(regions, res).select(by, *keys(res)).distinct()
    return hex_join(owned, per_cell, res).groupBy(by).agg(F.sum(col).alias(col))


def weighted_mean(df: DataFrame, value: str, weight: str, by: str | Sequence[str] | None, out: str) -> DataFrame:
    """Weighted mean; a row with no value leaves both halves of the ratio."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    ratio = F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(w))
    return df.groupBy(*_cols(by)).agg(ratio.alias(out))


# --- areas -------------------------------------------------------------------


def area_rough(df: DataFrame, res: int, by=None, unit: str = "km2", exact: bool = True, rsd: float = 0.01) -> DataFrame:
    """Distinct cells times the mean cell area of the resolution.

    Exact counts suit groups; the sketch (about ``rsd`` error) suits one global
    figure over very many cells.
    """
    per_cell = ROUGH_KM2[res] * (ACRES_PER_KM2 if unit == "acres" else 1.0)
    h = column_name(res)
    n = F.count_distinct(h) if exact else F.approx_count_distinct(h, rsd)
    return df.groupBy(*_cols(by)).agg(n.alias("n_cells")).withColumn("area", F.col("n_cells") * F.lit(per_cell))


def class_area(fractions: DataFrame, res: int, class_col: str, area: Column, nodata=None, frac: str = "frac") -> DataFrame:
    """Area per class of a fractions layer; ``area`` is an expression on the cell."""
    if nodata is not None:
        fractions = fractions.where(F.col(class_col) != F.lit(nodata))
    per_cell = fractions.groupBy(class_col, column_name(res)).agg(F.sum(frac).alias(frac))
    return per_cell.groupBy(class_col).agg(F.sum(F.col(frac) * area).alias("area"))


def overlay_share(
    feature: DataFrame, weights: DataFrame, land: DataFrame, res: int, weight: Column,
    area: Column, by: str | None = None, frac: str | None = None, out: str = "pct",
) -> DataFrame:
    """Share of a layer, in percent, that a partial-coverage layer covers.

    A cell that the land grid has more than once counts once, with the largest of its values. Both
    fractions and the area stay inside one sum: ``sum(frac * weight * area) /
    sum(frac * area)`` over the cells of the land grid. ``land`` may carry the area
    as a column; ``area`` may use any column of it or of the cell.
    """
    group = _cols(by)
    part = F.sum(frac) if frac else F.max(F.lit(1.0))
    cells = with_h0(feature, res).groupBy(*group, *keys(res)).agg(part.alias("_frac"))
    land = with_h0(land, res)
    rest = [c for c in land.columns if c not in keys(res)]
    land = land.groupBy(*keys(res)).agg(*[F.max(c).alias(c) for c in rest]) if rest else land.select(*keys(res)).distinct()
    bounded = hex_join(cells, land, res)
    covered = hex_join(bounded, with_h0(weights, res).withColumn("_w", weight).select(*keys(res), "_w"), res, "left")
    base = F.col("_frac") * area
    total = F.sum(base * F.coalesce(F.col("_w"), F.lit(0.0)))
    return covered.groupBy(*group).agg((F.lit(100.0) * F.try_divide(total, F.sum(base))).alias(out))


def presence_share(
    feature: DataFrame, presence: DataFrame, land: DataFrame, coarse: int, fine: int,
    by: str | None = None, out: str = "pct",
) -> DataFrame:
    """Mean presence, in percent, over the land children of a coarser feature's cells.

    Children are counted per coarser cell before groups meet them, so no child is copied for each group. All sides grow with
    the tables and cell ids compress to a fraction of their size in memory, so no join broadcasts one (`sizing.shuffled`).
    """
    group = _cols(by)
    cells = with_h0(feature, coarse).select(*dict.fromkeys([*group, *keys(coarse)])).distinct()
    grid = with_h0(with_parent(land, fine, coarse), fine).select(*dict.fromkeys([column_name(coarse), *keys(fine)])).distinct()
    here = unique_cells(presence, fine).withColumn("_here", F.lit(1.0))
    children = hex_join(grid, shuffled(here), fine, "left").groupBy(*keys(coarse)).agg(
        F.count(F.lit(1)).alias("_all"), F.sum(F.coalesce(F.col("_here"), F.lit(0.0))).alias("_present")
    )
    share = F.try_divide(F.sum("_present"), F.sum("_all"))
    return hex_join(cells, shuffled(children), coarse).groupBy(*group).agg((F.lit(100.0) * share).alias(out))


def collapse_units(df: DataFrame, res: int, value: str, how: str = "max") -> DataFrame:
    """Reduce several units that overlap one fine cell: MAX, or a sum capped at one."""
    if how not in ("max", "sum_capped"):
        raise ValueError("how is 'max' or 'sum_capped'")
    agg = F.max(value) if how == "max" else F.least(F.sum(value), F.lit(1.0))
    return aggregate_cells(df, res, agg.alias(value))


def rollup_fraction(
    fractions: DataFrame, fine: int, coarse: int, value: str, land: DataFrame | None = None
) -> DataFrame:
    """Mean over a parent's children of a coverage fraction given per fine cell.

    With a land grid the denominator is the parent's land children, which is right
    at coasts; without one it is the full ``7 ** steps``.
    """
    parent, child = column_name(coarse), column_name(fine)
    cells = with_h0(fractions, fine).select(*keys(fine), value)
    if land is None:
        return (
            cells.withColumn(parent, cell_parent(child, coarse, fine))
            .groupBy(parent, "h0").agg((F.sum(value) / F.lit(7.0 ** (fine - coarse))).alias(value))
        )
    grid = unique_cells(land, fine).withColumn(parent, cell_parent(child, coarse, fine))
    joined = hex_join(grid, cells, fine, "left")
    return joined.groupBy(parent, "h0").agg(F.avg(F.coalesce(F.col(value), F.lit(0.0))).alias(value))


def share_of_region(
    region: DataFrame, layer: DataFrame, res: int, by: str, weight: Column | None = None, out: str = "share"
) -> DataFrame:
    """Fraction of each region's cells (or of their weight) that a layer covers."""
    w = F.lit(1.0) if weight is None else weight
    cells = with_h0(region, res).withColumn("_w", w).select(by, *keys(res), "_w").distinct()
    covered = unique_cells(layer, res).withColumn("_in", F.lit(1.0))
    both = hex_join(cells, covered, res, "left")
    top = F.sum(F.coalesce(F.col("_in"), F.lit(0.0)) * F.col("_w"))
    return both.groupBy(by).agg(F.try_divide(top, F.sum("_w")).alias(out))


# --- lines -------------------------------------------------------------------


def line_share(
    lines: DataFrame, weights: DataFrame, land: DataFrame, res: int, feature_id: str,
    length: str, weight: Column, by: str | None = None, out: str = "pct",
) -> DataFrame:
    """Share of a line network's length under a per-cell coverage, in percent.

    Per feature the mean fraction of its cells, then weighted by the feature's own
    length, which is repeated on every cell it crosses and is taken once.
    """
    group = _cols(by)
    rows = (
        with_h0(lines, res)
        .groupBy(feature_id, *group, *keys(res)).agg(F.count(F.lit(1)).alias("_n"), F.min(length).alias("_len"))
    )
    seg = hex_join(rows, unique_cells(land, res), res, "left_semi")
    cover = hex_join(seg, with_h0(weights, res).withColumn("_w", weight).select(*keys(res), "_w"), res, "left")
    frac = F.sum(F.coalesce(F.col("_w"), F.lit(0.0)) * F.col("_n")) / F.sum("_n")
    per = cover.groupBy(feature_id, *group).agg(F.min("_len").alias("_len"), frac.alias("_f"))
    total = F.lit(100.0) * F.try_divide(F.sum(F.col("_len") * F.col("_f")), F.sum("_len"))
    return per.groupBy(*group).agg(total.alias(out))


# --- checks ------------------------------------------------------------------


def check_shares(df: DataFrame, share: str, limit: float = 1.0, by: Sequence[str] | None = None) -> DataFrame:
    """Groups whose shares add up to more than ``limit``; empty when all is well."""
    if by:
        df = df.groupBy(*by).agg(F.sum(share).alias(share))
    return df.where(F.col(share) > limit + 1e-9)


def check_invariance(f, first: int, second: int, on: Sequence[str], value: str) -> DataFrame:
    """A measure at one resolution and its difference from another; zero when the
    coarsening is right. ``f(res)`` returns the measure per ``on``."""
    other = f(second).withColumnRenamed(value, "_other")
    both = f(first).join(other, list(on))
    return both.withColumn("difference", F.col(value) - F.col("_other")).drop("_other")


def check_partition_key(df: DataFrame, h: str, h0: str = "h0", by: Sequence[str] = ()) -> DataFrame:
    """Rows whose stored partition key is not the base cell of their cell."""
    bad = ~F.col(h0).eqNullSafe(cell_parent(h, 0))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(bad.cast("bigint")).alias("n_mismatched")
    )


def coverage_report(
    df: DataFrame, col: str, measure: str, by: str, sentinels: Sequence = (), floating: bool = False
) -> DataFrame:
    """Share of rows and of a measure that survive the no-data filter on ``col``.

    One pass gives every group of ``by`` and, with a NULL group flagged by
    ``overall``, the whole table.
    """
    ok = is_valid(col, sentinels, floating)
    kept = F.when(ok, F.col(measure)).otherwise(F.lit(0.0))
    groups = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(ok.cast("bigint")).alias("k"),
        F.sum(measure).alias("m"), F.sum(kept).alias("mk"),
    )
    return groups.rollup(by).agg(
        F.grouping(by).cast("int").alias("overall"),
        F.sum("n").alias("n_rows"), F.sum("k").alias("n_valid"),
        (F.sum("k") / F.sum("n")).alias("row_share"),
        F.try_divide(F.sum("mk"), F.sum("m")).alias("measure_share"),
    )


def correlate(df: DataFrame, count: str, value: str) -> DataFrame:
    """Pearson correlation of log counts with a value, and Spearman's on ranks.

    The per-region table is written once, as ranking reads it several times.
    """
    df = df.select(F.col(count).cast("double").alias("_c"), F.col(value).cast("double").alias("_v"))
    df = materialize(df.where(F.col("_v").isNotNull() & (F.col("_c") > 0)))
    ranked = global_rank(global_rank(df, "_c", "_rc"), "_v", "_rv")
    return ranked.agg(
        F.corr(F.log10("_c"), F.col("_v")).alias("pearson_log"),
        F.corr("_rc", "_rv").alias("spearman"),
    )
