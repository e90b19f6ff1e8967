"""The folder that the driver and all executors can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import check


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where that is unset, a local session takes a temporary folder; on a
    cluster it is an error, for executors would not see the driver's disk.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if where is None:
        check(sc.master.startswith("local"), "Set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="moraine")
        sc.setCheckpointDir(where)
    return where


def written(df: DataFrame) -> DataFrame:
    """The rows as they are now, written to the shared folder and read back: later plans see the same rows and partitions' numbers."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
