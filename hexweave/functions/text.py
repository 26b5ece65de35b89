"""Exact text forms of typed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexweave.functions.cells import as_column

SIGNIFICANT_DIGITS = 10


def _drop_zeros(text: Column) -> Column:
    return F.rtrim(F.regexp_replace(text, r"(\.[0-9]*?)0*$", "$1"), F.lit("."))


def _scientific(c: Column | str) -> Column:
    return F.format_string(f"%.{SIGNIFICANT_DIGITS - 1}e", F.abs(as_column(c).cast("double")))


def _parts(sci: Column) -> tuple[Column, Column]:
    return F.split_part(sci, F.lit("e"), F.lit(1)), F.split_part(sci, F.lit("e"), F.lit(2)).try_cast("int")


def _general(c: Column | str, mantissa: Column, exponent: Column, digits: Column) -> Column:
    v = as_column(c).cast("double")
    split = F.concat(
        F.substring(digits, F.lit(1), exponent + 1), F.lit("."),
        F.substring(digits, exponent + 2, F.lit(SIGNIFICANT_DIGITS)),
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    fixed = _drop_zeros(F.when(exponent >= 0, split).otherwise(small))
    power = F.concat(
        F.lit("e"), F.when(exponent < 0, "-").otherwise("+"),
        F.lpad(F.abs(exponent).cast("string"), 2, "0"),
    )
    body = F.when((exponent < -4) | (exponent >= SIGNIFICANT_DIGITS), F.concat(_drop_zeros(mantissa), power)).otherwise(fixed)
    sign = F.when((v < 0) | (v.cast("string") == "-0.0"), F.lit("-")).otherwise(F.lit(""))
    infinite = F.when(v > 0, F.lit("inf")).otherwise(F.lit("-inf"))
    return (
        F.when(F.isnan(v), F.lit("nan"))
        .when(F.abs(v) == F.lit(float("inf")), infinite)
        .otherwise(F.concat(sign, body))
    )


def general_double(c: Column | str) -> Column:
    """A double at ten significant digits, trailing zeros dropped, C ``%.10g`` style."""
    mantissa, exponent = _parts(_scientific(c))
    return _general(c, mantissa, exponent, F.replace(mantissa, F.lit("."), F.lit("")))


def _with_doubles(df: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with helper columns, and the text of each of its doubles from them.

    Every step is a projection of its own, so that a number is formatted once and not for each place its digits are used at.
    """
    at = {name: f"_double{i}" for i, name in enumerate(names)}
    df = df.select("*", *[_scientific(f"`{name}`").alias(x) for name, x in at.items()])
    df = df.select("*", *[c.alias(f"{x}_{k}") for x in at.values() for k, c in zip("me", _parts(F.col(x)))])
    df = df.select("*", *[F.replace(F.col(f"{x}_m"), F.lit("."), F.lit("")).alias(f"{x}_d") for x in at.values()])
    return df, {name: _general(f"`{name}`", *[F.col(f"{x}_{k}") for k in "med"]) for name, x in at.items()}


def _is_vertices(t: T.DataType) -> bool:
    return (
        isinstance(t, T.ArrayType)
        and isinstance(t.elementType, T.StructType)
        and t.elementType.fieldNames() == ["x", "y"]
    )


GEOMETRY_NAMES = {"geom", "geometry", "shape"}


def geometry_columns(df: DataFrame) -> list[str]:
    """Columns that hold geometry: vertex arrays, and WKB under the usual names."""
    out = []
    for f in df.schema.fields:
        wkb = isinstance(f.dataType, T.BinaryType) and f.name.lower() in GEOMETRY_NAMES
        if _is_vertices(f.dataType) or wkb or f.dataType.typeName().startswith("geo"):
            out.append(f.name)
    return out


def render_columns(df: DataFrame) -> DataFrame:
    """Every value as the text a reader should see; geometry is dropped.

    NULL becomes the empty string while a real NaN stays ``nan``; 64-bit integers
    and decimals keep all their digits.
    """
    out = []
    hidden, fields = set(geometry_columns(df)), df.schema.fields
    df, doubles = _with_doubles(df, [f.name for f in fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))])
    for f in fields:
        if f.name in hidden:
            continue
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, T.DateType):
            shown = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            shown = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(t, (T.DoubleType, T.FloatType)):
            shown = doubles[f.name]
        elif isinstance(t, (T.LongType, T.DecimalType)):
            shown = c.cast("string")
        else:
            out.append(c)
            continue
        out.append(F.coalesce(shown, F.lit("")).alias(f.name))
    return df.select(*out)


def preview(df: DataFrame, n: int = 50) -> DataFrame:
    """First ``n`` rows with a flag telling whether more rows exist.

    Reads one row beyond ``n`` instead of counting; the window sees ``n + 1`` rows
    at most.
    """
    probe = df.limit(n + 1)
    seen = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    return probe.withColumn("truncated", seen > n).limit(n)
