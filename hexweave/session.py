"""Session settings and the shared working folder."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators are planned for. AQE splits a hot cell's
# shuffle partition by map output, which is exact, and `forceOptimizeSkewedJoin`
# lets it do so even where a later aggregate then needs its own shuffle.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows may be whole documents: batches are kept small on both sides.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply `SETTINGS` to the session (all of them can change at run time)."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application.

    Functions that run in tasks refer to their module by name, so a worker that was not started in
    this folder could not import them otherwise.
    """
    context, package = spark.sparkContext, Path(__file__).resolve().parent
    name = f"{package.name}-{context.applicationId}.zip"
    if any(str(path).endswith(name) for path in context._python_includes):
        return spark
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent))
    target = Path(tempfile.mkdtemp(prefix="hexweave-ship-")) / name
    target.write_bytes(content.getvalue())
    context.addPyFile(str(target))  # the driver serves it to every executor
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    A folder given to ``setCheckpointDir`` also counts. Only a session whose tasks run in this very process
    gets a folder of its own; on a cluster, ``local-cluster`` included, the setting is required, since
    a machine-local folder would be lost with its machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="hexweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read back.

    Parquet rather than an RDD checkpoint: later steps read only the columns they need, and Spark
    knows the table's size when it plans a join with it.
    """
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
