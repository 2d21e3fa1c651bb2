"""Tables that are written once and read many times, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: (application, name) of what has been written, and where.
_written: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset and all tasks run in this process, one of our own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="treeline-"))
        folder = context.getCheckpointDir()
    return folder


def once(name: str, df: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of df as Parquet, dealt by the key and sorted within files; written when they are first asked for, until the application ends."""
    spark = df.sparkSession
    known = (spark.sparkContext.applicationId, name)
    if known not in _written:
        top = f"{shared_folder(spark).rstrip('/')}/treeline-{known[0]}"
        target = spark._jvm.org.apache.hadoop.fs.Path(top)
        files = target.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(target)
        files.deleteOnExit(target)
        path = f"{top}/{uuid.uuid4().hex}"
        df.repartition(spark.sparkContext.defaultParallelism, key).sortWithinPartitions(key, order).write.parquet(path)
        _written[known] = path
    return spark.read.schema(df.schema).parquet(_written[known])
