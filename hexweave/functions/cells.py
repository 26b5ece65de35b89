"""H3 cell ids as native column expressions.

A cell id is, from the high bit down: 1 reserved bit, 4 mode bits (1 = cell),
3 reserved, 4 resolution bits, 7 base-cell bits and fifteen 3-bit digits, unused
digits being 7. Everything here is bit arithmetic on a bigint column, so it stays
inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the grid: the base cells that are pentagons.
PENTAGON_BASE_CELLS = [4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117]
BASE_CELL_COUNT = 122
MAX_RES = 15
EARTH_RADIUS_KM = 6371.007180918475

_RES_MASK = 15 << 52
_MODE = 1 << 59


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def column_name(res: int) -> str:
    return f"h{res}"


def cell_resolution(h: Column | str) -> Column:
    return F.shiftright(as_column(h), 52).bitwiseAND(F.lit(15)).cast("int")


def base_cell(h: Column | str) -> Column:
    return F.shiftright(as_column(h), 45).bitwiseAND(F.lit(127)).cast("int")


def cell_parent(h: Column | str, res: int, from_res: int | None = None) -> Column:
    """Ancestor of ``h`` at ``res``; NULL when ``h`` is coarser than ``res``.

    Where the column's resolution is known, ``from_res`` saves the test per row and
    keeps the expression free of NULLs, so joins infer no filter from it.
    """
    if not 0 <= res <= MAX_RES:
        raise ValueError(f"resolution must be 0..{MAX_RES}, got {res}")
    if from_res is not None and from_res < res:
        raise ValueError(f"resolution {from_res} has no ancestor at {res}")
    h = as_column(h)
    tail = (res << 52) | ((1 << (3 * (MAX_RES - res))) - 1)
    up = h.bitwiseAND(F.lit(~_RES_MASK)).bitwiseOR(F.lit(tail))
    return up if res == 0 or from_res is not None else F.when(cell_resolution(h) >= res, up)


def is_pentagon(h: Column | str) -> Column:
    """True for a pentagon base cell and its all-zero-digit descendants."""
    h = as_column(h)
    unused_bits = (F.lit(3) * (F.lit(MAX_RES) - cell_resolution(h))).cast("int")
    unused = F.call_function("shiftleft", F.lit(1).cast("bigint"), unused_bits) - F.lit(1)
    digits = h.bitwiseAND(F.lit((1 << 45) - 1))
    return base_cell(h).isin(PENTAGON_BASE_CELLS) & (digits == unused)


def direct_children(h: Column) -> Column:
    """Array of the children one resolution finer (6 below a pentagon, else 7).

    Unused digits are all ones, so child ``d`` is the id with the resolution
    raised by one and ``7 - d`` taken off the digit being opened.
    """
    one = F.lit(1).cast("bigint")
    shift = (F.lit(3) * (F.lit(MAX_RES - 1) - cell_resolution(h))).cast("int")
    unit = F.call_function("shiftleft", one, shift)
    digits = F.when(
        is_pentagon(h), F.array(*[F.lit(d) for d in (0, 2, 3, 4, 5, 6)])
    ).otherwise(F.array(*[F.lit(d) for d in range(7)]))
    return F.transform(
        digits, lambda d: h + F.lit(1 << 52) - (F.lit(7) - d).cast("bigint") * unit
    )


def _check_descent(from_res: int, to_res: int) -> None:
    if not 0 <= from_res <= to_res <= MAX_RES:
        raise ValueError(f"no descent from resolution {from_res} to {to_res}")


def cell_children(h: Column | str, from_res: int, to_res: int) -> Column:
    """Array of descendants at ``to_res`` of a column of ``from_res`` cells."""
    _check_descent(from_res, to_res)
    cells = F.array(as_column(h))
    for _ in range(to_res - from_res):
        cells = F.flatten(F.transform(cells, direct_children))
    return cells


def explode_children(df: DataFrame, h: str, from_res: int, to_res: int, out: str) -> DataFrame:
    """One row per descendant; one generator per level keeps each array at seven."""
    _check_descent(from_res, to_res)
    df = df.withColumn(out, F.col(h))
    for _ in range(to_res - from_res):
        df = df.withColumn(out, F.explode(direct_children(F.col(out))))
    return df


def cell_from_string(s: Column | str) -> Column:
    return F.conv(as_column(s), 16, 10).cast("bigint")


def cell_to_string(h: Column | str) -> Column:
    return F.lower(F.hex(as_column(h)))


_RES0_FIXED = _MODE | ((1 << 45) - 1)


def res0_cell(base: Column | str) -> Column:
    """Id of a resolution-0 cell from its base-cell number (0..121)."""
    return as_column(base).cast("bigint") * F.lit(1 << 45) + F.lit(_RES0_FIXED)


def res0_id(base: int) -> int:
    """The same for a number in Python."""
    return base * (1 << 45) + _RES0_FIXED


def great_circle(lat1, lng1, lat2, lng2, unit: str = "km") -> Column:
    """Haversine distance on the sphere H3 uses; an unknown unit gives NaN."""
    lat1, lng1, lat2, lng2 = (F.radians(as_column(c)) for c in (lat1, lng1, lat2, lng2))
    a = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(
        F.sin((lng2 - lng1) / 2), 2
    )
    rads = 2 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))
    scale = {"km": EARTH_RADIUS_KM, "m": EARTH_RADIUS_KM * 1000, "rads": 1.0}
    return rads * F.lit(scale.get(unit, float("nan")))
