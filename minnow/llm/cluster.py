"""Session helpers shared by the operators: code shipping, shared scratch tables."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parents[1]

#: Rows in one Arrow batch: a few MB of ordinary documents, so that workers stay small.
ARROW_ROWS = 1000
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers and keep their Arrow batches small.

    Two settings of the session change for good: spark.sql.execution.arrow.maxRecordsPerBatch, and how workers that start
    from now on allocate memory.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            for f in sorted(PACKAGE.rglob("*.py")):
                z.writestr(zipfile.ZipInfo(str(f.relative_to(PACKAGE.parent))), f.read_bytes())
        # Spark's own file server hands the archive to the executors; only the driver reads this copy.
        path = Path(tempfile.mkdtemp()) / "minnow.zip"
        path.write_bytes(packed.getvalue())
        sc.addPyFile(str(path))
        # Workers give large arrays back to the system at once, and do not keep an arena for each thread.
        sc.environment.update({"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(8 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20)})
        _shipped.add(sc.applicationId)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def folder(spark: SparkSession) -> str:
    """This application's part of the shared folder that spark.checkpoint.dir names.

    Where the session has no such folder, one is set beside the warehouse, but only in local mode: elsewhere executors
    would not share it.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        base = (warehouse if ":" in warehouse else f"file://{Path(warehouse).absolute()}").rstrip("/") + "-shared"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/minnow-{sc.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove all tables that this application has stored; results that were not yet written are lost with them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
