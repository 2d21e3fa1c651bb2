"""New source files as a stream of nodes: the same plans, over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.sources.trees import language_of, read_sources


def stream_nodes(spark: SparkSession, folder: str, language: str = "python", max_files: int = 1000) -> DataFrame:
    """Nodes of the files that arrive in a folder. Each file is read once; no state is kept."""
    files = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", max_files).load(folder).withColumn("doc_id", F.input_file_name())
    return read_sources(files.filter(language_of(F.col("doc_id")) == language).select("doc_id", F.col("value").alias("source")), language)
