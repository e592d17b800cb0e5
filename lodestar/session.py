"""Session set-up."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, unless their PYTHONPATH has it already."""
    root, app = Path(__file__).resolve().parent.parent, spark.sparkContext.applicationId
    if app in _SHIPPED or str(root) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    target = Path(tempfile.mkdtemp()) / "lodestar_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.glob("lodestar/**/*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def dealt(df: DataFrame, key: str, size: int = 4 << 20) -> DataFrame:
    """df dealt by `key` once, in parts of about `size` bytes of its files, so that what is grouped or ranked by the key and further
    columns moves no rows again."""
    spark = df.sparkSession
    total = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-total // size)), key)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a temporary one only where it is unset and the executors
    are threads of this process, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp())
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage of loops and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/frame-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
