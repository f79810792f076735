"""Tables in the shared folder: they cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder ``spark.checkpoint.dir``, which cuts its lineage."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tables-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/tables-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def publish(df: DataFrame, path: str, name: str) -> str:
    """Write a new version of a table and only then name it current.

    A version is a folder of its own, complete once Spark has committed it;
    the name is a one-row table written after it, so a reader sees the old
    version or the new one, never a part. Returns the version's path.
    """
    version = f"{path.rstrip('/')}/{name}/{uuid.uuid4().hex}"
    df.write.parquet(version)
    df.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}.current")
    return version


def current(spark, path: str, name: str) -> DataFrame:
    """The version that ``publish`` named last."""
    return spark.read.parquet(spark.read.parquet(f"{path.rstrip('/')}/{name}.current").first()["version"])
