"""Tables written between the stages of a long plan, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder of the session; a new local one where neither is set (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    context = spark.sparkContext
    if not root:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="trajspark-"))
        root = context._jsc.sc().getCheckpointDir().get()
    return root


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # stopped; the folder is the cluster's scratch space
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back; the files go when the driver's Python ends."""
    path = f"{shared_folder(df.sparkSession)}/trajspark/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
