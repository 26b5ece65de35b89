"""Reading, writing and describing hex datasets on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexweave.functions.cells import cell_from_string


def read_hex(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """A dataset partitioned by h0, with h0 as a bigint column.

    Folders may name the base cell as a number or in its text form. With a glob the base path must be given, or Spark would drop the partition
    column without notice.
    """
    reader = spark.read.option("basePath", root)
    df = reader.parquet(f"{root}/{glob}" if glob else root)
    kind = dict(df.dtypes).get("h0")
    if kind in (None, "bigint"):
        return df
    return df.withColumn("h0", cell_from_string("h0") if kind == "string" else F.col("h0").cast("bigint"))


def write_hex(df: DataFrame, root: str, max_records: int = 0) -> None:
    """Write a dataset partitioned by h0 with file sizes balanced by AQE.

    ``max_records`` additionally bounds the rows of one file.
    """
    writer = df.hint("rebalance", F.col("h0")).write.mode("overwrite").partitionBy("h0")
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    writer.parquet(root)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def register_view(spark: SparkSession, name: str, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(name)
    return df


def describe(df: DataFrame) -> DataFrame:
    """Column names and types as rows, from the schema alone."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, column_type string")


def dataset_profile(df: DataFrame) -> DataFrame:
    """Rows, files and bytes of a file-based DataFrame, from file metadata."""
    files = df.groupBy(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")
    ).agg(F.count(F.lit(1)).alias("n"))
    return files.agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes")
    )
