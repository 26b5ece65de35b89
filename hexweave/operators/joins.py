"""Joins between hex tables: always on the cell and its h0 partition key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexweave.functions.cells import BASE_CELL_COUNT, cell_from_string, cell_parent, column_name
from hexweave.operators.sizing import salted_join, shuffled
from hexweave.session import materialize


def keys(res: int) -> list[str]:
    return [column_name(res), "h0"] if res else ["h0"]


def with_h0(df: DataFrame, res: int) -> DataFrame:
    """``df`` with its partition key, derived from the cell where it is missing."""
    return df if "h0" in df.columns else df.withColumn("h0", cell_parent(column_name(res), 0))


def with_parent(df: DataFrame, from_res: int, to_res: int) -> DataFrame:
    """``df`` with a filled ``h<to_res>`` column.

    A stored parent column is used as it is; where it is absent or NULL (very
    large features) the parent is computed from the finer cell.
    """
    name = column_name(to_res)
    computed = cell_parent(column_name(from_res), to_res, from_res)
    value = F.coalesce(F.col(name), computed) if name in df.columns else computed
    return df.withColumn(name, value)


def hex_join(
    left: DataFrame, right: DataFrame, res: int, how: str = "inner", salts: int = 0
) -> DataFrame:
    """Equi-join on ``(h<res>, h0)``.

    h0 is implied by the cell, but only a join on the partition column lets Spark
    prune the other side's directories. ``salts`` spreads hot left cells in the
    plan itself; without it AQE splits skewed partitions at run time.
    """
    left, right = with_h0(left, res), with_h0(right, res)
    if salts:
        return salted_join(left, right, keys(res), how, salts)
    return left.join(right, keys(res), how)


def hex_join_all(layers: Sequence[DataFrame], res: int, how: str = "inner") -> DataFrame:
    return reduce(lambda a, b: hex_join(a, b, res, how), layers)


def mask_cells(mask: DataFrame, res: int, where: Column | None = None) -> DataFrame:
    """Distinct ``(h<res>, h0)`` of a region mask, filtered on its own attributes."""
    if where is not None:
        mask = mask.where(where)
    return with_h0(mask, res).select(*keys(res)).distinct()


def clip_to_mask(
    df: DataFrame, mask: DataFrame, res: int, where: Column | None = None
) -> DataFrame:
    """Rows of ``df`` inside the mask, before any aggregation.

    One aggregate finds the mask's base cells, at most 122, which become a literal filter that prunes the
    directories of ``df`` at planning time. The cells themselves are the boundary, in a semi join on the
    mask as it is: Spark broadcasts them if it knows that they are few. Give a mask that is costly to
    compute as a written table (`hexweave.session.materialize`).

    The base cell alone is a storage key as large as a continent, so a mask at
    resolution 0 is refused.
    """
    if res == 0:
        raise ValueError("h0 is a storage key, not a boundary: clip at a finer resolution")
    cells = mask_cells(mask, res, where).dropna()
    near = with_h0(df, res).where(F.col("h0").isin(static_partitions(cells)))
    return near.join(cells, keys(res), "left_semi")


def join_resolutions(
    fine: DataFrame, coarse: DataFrame, fine_res: int, coarse_res: int, aggs: Sequence[Column]
) -> DataFrame:
    """Join layers of different resolutions by rolling the finer one up first."""
    if fine_res < coarse_res:
        raise ValueError("the first layer must be the finer one")
    fine = with_h0(with_parent(fine, fine_res, coarse_res), fine_res)
    rolled = fine.groupBy(*keys(coarse_res)).agg(*aggs)
    return hex_join(coarse, rolled, coarse_res)


def unique_cells(df: DataFrame, res: int) -> DataFrame:
    """One row per cell, so overlapping features cannot count twice downstream."""
    return mask_cells(df, res)


def driver_chain(
    scope: DataFrame, layer: DataFrame, values: DataFrame, res: int, aggs: Sequence[Column]
) -> DataFrame:
    """Totals of ``values`` on the cells of ``layer`` that lie in a small ``scope``.

    The scope clips the layer, and only what is left becomes the mask of the values. That mask is
    written once, since its base cells are needed before the values are read.
    """
    return clip_to_mask(values, materialize(mask_cells(clip_to_mask(layer, scope, res), res), "chain"), res).agg(*aggs)


def assign_features(
    features: DataFrame, regions: DataFrame, res: int, feature_id: str, region_id: str
) -> DataFrame:
    """Distinct (feature, region) pairs that share a cell.

    Both sides are reduced to their distinct (cell, id) pairs before they meet, in a shuffle join: both grow with the tables.
    """
    left = with_h0(features, res).select(feature_id, *keys(res)).distinct()
    right = with_h0(regions, res).select(region_id, *keys(res)).distinct()
    return hex_join(left, shuffled(right), res).select(feature_id, region_id).distinct()


def assign_then_sum(
    features: DataFrame, regions: DataFrame, flat: DataFrame, res: int,
    feature_id: str, region_id: str, measure: str,
) -> DataFrame:
    """Sum of a flat table's measure per region; the flat table is joined last."""
    pairs = assign_features(features, regions, res, feature_id, region_id)
    return (
        pairs.join(shuffled(flat.select(feature_id, measure)), feature_id)
        .groupBy(region_id).agg(F.sum(measure).alias(measure))
    )


def normalize_string_cells(df: DataFrame, *names: str) -> DataFrame:
    """Turn hex-string cell columns into bigint ids.

    Literal filters belong before this call, in the file's own key type, since a
    predicate on a converted column cannot be pushed to the scan.
    """
    for name in names:
        df = df.withColumn(name, cell_from_string(name))
    return df


def features_in_mask(df: DataFrame, mask: DataFrame, res: int, feature_id: str, by: str) -> DataFrame:
    """Number of distinct features per ``by`` with at least one cell in the mask."""
    inside = clip_to_mask(df, mask, res)
    return inside.groupBy(by).agg(F.count_distinct(feature_id).alias("n_features"))


def static_partitions(mask: DataFrame) -> list[int]:
    """The mask's base cells, sorted, as literals for a static partition filter: 122 at most."""
    rows = mask.where("h0 is not null").select("h0").distinct().limit(BASE_CELL_COUNT + 1).collect()
    if len(rows) > BASE_CELL_COUNT:
        raise ValueError("more distinct h0 values than base cells")
    return sorted(r["h0"] for r in rows)
