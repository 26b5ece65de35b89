"""Coordinate reference systems as column metadata, which selections, filters and joins carry along.

A column without a tag is taken as it is. Two tagged columns must mean the same system where an operator compares their
coordinates; tagging never moves a coordinate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from hexweave.functions.geometry import vertex
from hexweave.functions.tilemath import mercator_x, mercator_y

KEY = "crs"
LONLAT, MERCATOR = "OGC:CRS84", "EPSG:3857"


def normal(crs: str) -> str:
    return crs.strip().upper()


def set_crs(df: DataFrame, column: str, crs: str | None) -> DataFrame:
    """``df`` with the column's system set, or taken away; its values stay."""
    kept = {k: v for k, v in df.schema[column].metadata.items() if k != KEY}
    return df.withMetadata(column, kept | ({KEY: normal(crs)} if crs else {}))


def crs_of(df: DataFrame, column: str) -> str | None:
    return df.schema[column].metadata.get(KEY)


def agree(*columns: tuple[DataFrame, str]) -> str | None:
    """The one system of all tagged columns, NULL for none; an error if two differ.

    EPSG:4326 and OGC:CRS84 differ too, as they name their axes in another order: re-tag the column that holds lon/lat.
    """
    tags = {crs_of(df, c): c for df, c in columns if crs_of(df, c)}
    if len(tags) > 1:
        raise ValueError("columns of different coordinate reference systems: " + ", ".join(f"{c!r} is {t}" for t, c in sorted(tags.items())))
    return next(iter(tags), None)


def require_lonlat(*columns: tuple[DataFrame, str]) -> None:
    """An error if a tagged column holds anything but lon/lat."""
    for df, c in columns:
        if crs_of(df, c) not in (None, LONLAT, "EPSG:4326"):
            raise ValueError(f"{c!r} is {crs_of(df, c)}, and lon/lat is needed")


def to_mercator(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the lon/lat shape of a column (a line, polygon or multipolygon) in web-mercator metres, and tagged so."""
    require_lonlat((df, column))

    def moved(shape, kind):
        if isinstance(kind.elementType, ArrayType):
            return F.transform(shape, lambda part: moved(part, kind.elementType))
        return F.transform(shape, lambda v: vertex(mercator_x(v["x"]), mercator_y(v["y"])))

    return set_crs(df.withColumn(column, moved(F.col(column), df.schema[column].dataType)), column, MERCATOR)
