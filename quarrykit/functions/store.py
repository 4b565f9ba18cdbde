"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This session's folder below ``spark.checkpoint.dir``; it goes when the driver ends.

    Where no shared folder is set a temporary one serves, but only a driver
    that runs its tasks itself (tests, bench).
    """
    found = getattr(spark, "_quarrykit_dir", None)
    if found is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = tempfile.mkdtemp(prefix="quarrykit-")
        found = spark._quarrykit_dir = f"{root}/quarrykit/{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(found)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return found


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` spread over all cores by ``key``: a small table in one part may hold many rows of long work, and a part is one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` and read it again: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
