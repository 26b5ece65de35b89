"""Physical layouts: hex tables bucketed by cell for joins without an exchange, and files clustered by key for pruned scans."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hexweave.functions.cells import column_name
from hexweave.operators.sizing import shuffle_width

GROUP_BYTES = 1 << 20


# --- buckets -------------------------------------------------------------------------


def _table(path: str) -> str:
    return f"hexweave_{hashlib.md5(path.encode()).hexdigest()}"


def save_colocated(df: DataFrame, path: str, res: int, buckets: int | None = None) -> DataFrame:
    """Write ``df`` bucketed and sorted by its cell at ``res``, and open it.

    Tables of one number of buckets (or of multiples of it) join on the cell and group by it without moving a row. The
    cell implies h0, which stays a plain column. A bucket is one file that holds all rows of its cells: lay out layers with few
    rows a cell so, and others after they are aggregated. The layout is recorded beside the files, for other sessions.
    """
    spark, name = df.sparkSession, column_name(res)
    buckets = buckets or shuffle_width(spark)
    rows = df.repartition(buckets, name)  # dealt as the buckets are, so each is written once
    rows.write.mode("overwrite").bucketBy(buckets, name).sortBy(name).option("path", path).format("parquet").saveAsTable(_table(path))
    note = json.dumps({"cell": name, "buckets": buckets, "schema": df.schema.json()})
    spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.layout")
    return spark.table(_table(path))


def open_colocated(spark: SparkSession, path: str) -> DataFrame:
    """A table of `save_colocated`, also one that another session wrote."""
    name = _table(path)
    if not spark.catalog.tableExists(name):
        note = json.loads(spark.read.text(f"{path}.layout").first()[0])
        kinds = json.loads(note["schema"])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(kinds).fields)
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (path '{path}') "
            f"CLUSTERED BY ({note['cell']}) SORTED BY ({note['cell']}) INTO {note['buckets']} BUCKETS"
        )
    return spark.table(name)


def colocated_join(layers: Sequence[DataFrame], res: int, how: str = "inner") -> DataFrame:
    """Equi-join of co-located layers on the cell alone; h0 comes from the first.

    The base cell is part of the cell, so it adds nothing to the key, and a key of the bucket column only needs no exchange.
    """
    name = column_name(res)
    out = layers[0]
    for layer in layers[1:]:
        out = out.join(layer.drop("h0"), name, how)
    return out


# --- clustering ----------------------------------------------------------------------


def write_clustered(
    df: DataFrame, root: str, by: str | Sequence[str], bloom: Sequence[str] = (), partition_by: Sequence[str] = (),
    files: int | None = None, group_bytes: int = GROUP_BYTES,
) -> None:
    """Write files sorted by key, in small row groups whose statistics are narrow.

    Ranges of the key go to files, so a hot partition is split by key and not at random. A predicate on a key then reads the
    row groups whose range holds it; one on a ``bloom`` column reads those whose filter may hold it.
    """
    by = [by] if isinstance(by, str) else list(by)
    keys = [F.col(c) for c in [*partition_by, *by]]
    ranged = df.repartitionByRange(files or shuffle_width(df.sparkSession), *keys).sortWithinPartitions(*keys)
    writer = ranged.write.mode("overwrite").option("parquet.block.size", group_bytes).option("parquet.page.size", max(1024, group_bytes // 16))
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(root)


def cell_range(parent: int, res: int) -> tuple[int, int]:
    """Least and greatest id that the descendants of a cell at ``res`` can have; they are all ids of it in between.

    Ids of one resolution sort by base cell and then digit by digit, so a subtree is one range.
    """
    own = parent >> 52 & 15
    if res < own:
        raise ValueError("descendants are of the same or a finer resolution")
    low = parent & ~(15 << 52) | res << 52
    high = low
    for r in range(own + 1, res + 1):
        shift = 3 * (15 - r)
        low &= ~(7 << shift)
        high = high & ~(7 << shift) | 6 << shift
    return low, high


def within_cell(res: int, parent: int) -> Column:
    """Predicate: the cell at ``res`` lies in the parent, as a range that scans prune row groups by."""
    return F.col(column_name(res)).between(*(F.lit(v) for v in cell_range(parent, res)))

