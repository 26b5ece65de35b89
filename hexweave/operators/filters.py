"""No-data filters, text predicates and column selection."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexweave.functions.cells import as_column
from hexweave.functions.text import geometry_columns
from hexweave.functions.tilemath import pad_lat, pad_lng

_HEX_COLUMN = re.compile(r"^h\d+$")


def is_valid(c: Column | str, sentinels: Sequence = (), floating: bool = True) -> Column:
    """Present, not NaN and not one of the dataset's no-data codes."""
    c = as_column(c)
    ok = c.isNotNull()
    if floating:
        ok = ok & ~F.isnan(c)
    if sentinels:
        ok = ok & ~c.isin(list(sentinels))
    return F.coalesce(ok, F.lit(False))


def valid_values(df: DataFrame, col: str, sentinels: Sequence = ()) -> DataFrame:
    floating = dict(df.dtypes)[col] in ("double", "float")
    return df.where(is_valid(col, sentinels, floating))


def contains_text(c: Column | str, needle: str) -> Column:
    """Case-insensitive substring test for free text."""
    return F.lower(as_column(c)).contains(needle.lower())


def in_bbox(lat, lng, west: float, south: float, east: float, north: float, res: int | None = None) -> Column:
    """Centre inside a box, widened by one cell radius when ``res`` is given."""
    lat, lng = as_column(lat), as_column(lng)
    if res is None:
        return lat.between(south, north) & lng.between(west, east)
    dy = pad_lat(F.lit(res))
    dx = pad_lng(F.lit(res), F.lit(max(abs(south), abs(north))))
    return lat.between(F.lit(south) - dy, F.lit(north) + dy) & lng.between(
        F.lit(west) - dx, F.lit(east) + dx
    )


def hex_columns(df: DataFrame) -> list[str]:
    """Cell columns present, finest first; read from the schema, no job runs."""
    return sorted((c for c in df.columns if _HEX_COLUMN.match(c)), key=lambda c: -int(c[1:]))


def value_columns(df: DataFrame) -> list[str]:
    """Columns that carry values: neither cell keys nor geometry."""
    hidden = set(geometry_columns(df))
    return [c for c in df.columns if not _HEX_COLUMN.match(c) and c not in hidden]


def slice_cube(df: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """Cut a long-form array table on its coordinates, both ends included."""
    for dim, (low, high) in ranges.items():
        df = df.where(F.col(dim).between(low, high))
    return df


def guard_pixels(header: DataFrame, limit: int = 10_000_000) -> DataFrame:
    """Pixel count per raster and whether it is small enough to read pixel by pixel."""
    n = F.col("cols").cast("bigint") * F.col("rows").cast("bigint")
    return header.withColumn("n_pixels", n).withColumn("allowed", n <= limit)
