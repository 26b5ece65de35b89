"""Map-tile tables from pyramid levels."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexweave.functions import tilemath as tm
from hexweave.functions.geometry import unwrap_dateline, vertex
from hexweave.operators.pyramid import read_level, read_manifest


def in_padded_tile(lat, lng, res, z, x, y) -> Column:
    """Centre inside the tile's box widened by one cell radius.

    A cell across a tile edge thus belongs to every tile its body touches. The
    longitude pad is taken at the tile's edge nearest to a pole.
    """
    box = tm.tile_bounds(z, x, y)
    north, south = box["north"], box["south"]
    dy = tm.pad_lat(res)
    dx = tm.pad_lng(res, F.greatest(F.abs(north), F.abs(south)))
    return lat.between(south - dy, north + dy) & lng.between(box["west"] - dx, box["east"] + dx)


def tile_cells(level: DataFrame, res: int, z: int, x: int, y: int, base_cells: Iterable[int] | None = None) -> DataFrame:
    """Cells of one tile from a level that carries ``lat`` and ``lng``.

    ``base_cells`` are the h0 values near the tile; as literals they prune the
    finest level's directories before any row is read.
    """
    if base_cells is not None:
        level = level.where(F.col("h0").isin(list(base_cells)))
    inside = in_padded_tile(F.col("lat"), F.col("lng"), F.lit(res), F.lit(z), F.lit(x), F.lit(y))
    return level.where(inside)


def build_tiles(level: DataFrame, res: int, zooms: Iterable[int]) -> DataFrame:
    """All tiles of some zooms at once: one row per (z, x, y, cell).

    Each cell lists the tiles around its centre that its padded box can reach and
    keeps those that pass the exact test, so no tile gathers its cells in one task.
    """
    lat, lng = F.col("lat"), F.col("lng")
    dy = tm.pad_lat(F.lit(res))
    rows = level.withColumn("z", F.explode(F.array(*[F.lit(int(z)) for z in zooms])))
    z = F.col("z")
    first_y = tm.tile_y(F.least(F.lit(90.0), lat + dy), z)
    last_y = tm.tile_y(F.greatest(F.lit(-90.0), lat - dy), z)
    top = (F.pow(F.lit(2.0), z) - 1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    rows = rows.withColumn(
        "y", F.explode(F.sequence(F.greatest(zero, first_y - 1), F.least(top, last_y + 1)))
    )
    box = tm.tile_bounds(z, F.lit(0), F.col("y"))
    dx = tm.pad_lng(F.lit(res), F.greatest(F.abs(box["north"]), F.abs(box["south"])))
    first_x = F.greatest(zero, tm.tile_x(F.greatest(F.lit(-180.0), lng - dx), z) - 1)
    last_x = F.least(top, tm.tile_x(F.least(F.lit(180.0), lng + dx), z) + 1)
    rows = rows.withColumn("x", F.explode(F.sequence(first_x, last_x)))
    return rows.where(in_padded_tile(lat, lng, F.lit(res), z, F.col("x"), F.col("y")))


def tiles_of(
    spark: SparkSession, path: str, zooms: Iterable[int], centers: Callable[[DataFrame, str], DataFrame],
    adaptive: bool = False,
) -> DataFrame:
    """Tiles of a built pyramid: one row per (z, x, y, cell), from the level that each zoom shows.

    The manifest gives the levels that exist; a zoom shows resolution ``z - zoom_offset`` within them, or,
    ``adaptive`` and with bounds in the manifest, the finest one whose cells per tile stay below the
    target. Levels have a common set of columns; ``res`` tells which one a row is from.
    ``centers(df, h)`` adds ``lat`` and ``lng``.
    """
    manifest = read_manifest(spark, path)
    if manifest is None:
        raise ValueError(f"no finished pyramid at {path}")
    zooms = sorted({int(z) for z in zooms})
    level_of = _levels_shown(spark, manifest, zooms, adaptive)
    out = None
    for res in sorted(set(level_of.values())):
        level = centers(read_level(spark, path, res), "h")
        tiles = build_tiles(level, res, [z for z in zooms if level_of[z] == res]).withColumn("res", F.lit(res))
        out = tiles if out is None else out.unionByName(tiles, allowMissingColumns=True)
    return out


def _levels_shown(spark: SparkSession, manifest: dict, zooms: list[int], adaptive: bool) -> dict[int, int]:
    """Resolution shown at each zoom."""
    z = F.col("z")
    count = tiles = None
    if adaptive and manifest["bounds"]:
        west, south, east, north = (F.lit(v) for v in manifest["bounds"])
        count, tiles = F.lit(manifest["feature_count_finest"]), tm.tiles_covering(z, west, south, east, north)
    res = tm.zoom_resolution(
        z, F.lit(manifest["min_res"]), F.lit(manifest["finest_res"]), F.lit(manifest["zoom_offset"]), count, tiles
    )
    rows = spark.range(max(zooms) + 1).select(F.col("id").cast("int").alias("z")).where(z.isin(zooms)).select("z", res.alias("r"))
    return {r["z"]: r["r"] for r in rows.collect()}


def mercator_ring(ring, center_lng) -> Column:
    """Cell boundary in mercator metres, kept in one piece across the dateline."""
    return F.transform(
        unwrap_dateline(ring, center_lng), lambda v: vertex(tm.mercator_x(v["x"]), tm.mercator_y(v["y"]))
    )


def tile_features(tiles: DataFrame, x_merc: str, y_merc: str) -> DataFrame:
    """Pixel position of a mercator point in its tile (4096 units, y downwards).

    Features stay one row each; ``in_buffer`` tells whether the point lies within
    the 256-unit margin that the viewer clips to.
    """
    box = tm.tile_bounds("z", "x", "y")
    px = tm.tile_pixel(F.col(x_merc), tm.mercator_x(box["west"]), tm.mercator_x(box["east"]))
    py = tm.tile_pixel(F.col(y_merc), tm.mercator_y(box["north"]), tm.mercator_y(box["south"]))
    low, high = -tm.TILE_BUFFER, tm.TILE_EXTENT + tm.TILE_BUFFER
    return (
        tiles.withColumn("px", px).withColumn("py", py)
        .withColumn("in_buffer", F.col("px").between(low, high) & F.col("py").between(low, high))
    )


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Write a tile table as ``z=/x=`` partitions of balanced files."""
    tiles.hint("rebalance", F.col("z"), F.col("x")).write.mode("overwrite").partitionBy("z", "x").parquet(path)
