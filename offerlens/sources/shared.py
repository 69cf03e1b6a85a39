"""Tables that a job writes on its way and reads again."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of our own only on a single machine that names none."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/checkpoints"


def stored(df: DataFrame) -> DataFrame:
    """The rows written and read again, so that they are computed once and outlive executors; gone with the driver."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/offerlens-core-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt by a key over as many tasks as a shuffle has, however few their bytes: for what takes long by the row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone by then
        pass
