"""What the training-data operators share: the word definition, durable tables and input columns."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these six ASCII white-space characters.
WHITE_SPACE = " \t\n\u000b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset and all tasks run in this process, as in tests, one of our own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="treeline-"))
        folder = context.getCheckpointDir()
    return folder


#: Bytes that a task writing a durable table gathers in memory before it closes a row group.
ROW_GROUP = 32 << 20
#: The paths of durable tables, one list for each scratch() that is open.
_open: list[list[str]] = []


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The same rows, written as Parquet to the shared folder and read back, and the path; the table lasts until the application ends."""
    spark = df.sparkSession
    top = f"{shared_folder(spark).rstrip('/')}/treeline-{spark.sparkContext.applicationId}"
    path = f"{top}/{uuid.uuid4().hex}"
    files, folder = _file_system(spark, top)
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def durable(df: DataFrame) -> DataFrame:
    """The same rows from a table of their own, which goes with the scratch() around it, if there is one.

    This cuts the lineage: a lost executor costs the reread of a file, not the work before it.
    """
    table, path = written(df)
    if _open:
        _open[-1].append(path)
    return table


def drop(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        files, folder = _file_system(spark, path)
        files.delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Durable tables that are made inside, and paths added to the list, go when it ends; what is needed further is written() before."""
    _open.append([])
    try:
        yield _open[-1]
    finally:
        drop(spark, _open.pop())


#: Rows are whole documents, some of them long: batches between Spark and Python are limited by bytes, whatever the length of a row.
BATCH_BYTES = 2 << 20
UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}


def with_small_batches(df: DataFrame) -> DataFrame:
    """The same rows, after the session has been told to hand at most about BATCH_BYTES to Python at once; a smaller setting stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)\s*([bkmg]?)b?", (conf.get(key, None) or "-1").lower()).groups()
    if not 0 < int(number) * UNITS[unit] <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def released(spark: SparkSession) -> None:
    """Lets go of plans that are done: what Python and the driver's JVM no longer refer to is collected, and Spark removes its shuffle files."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces_for(rows: int, per_piece: int, most_bits: int = 24) -> int:
    """How many leading hash bits split so many rows into pieces of about per_piece rows."""
    return min(most_bits, max(0, (max(rows, 1) // per_piece).bit_length()))


def words(text: Column) -> Column:
    """The words of a text, in order; none for a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    """The number of words without building them: blanks are unified and squeezed, then counted."""
    blanks = F.translate(text, WHITE_SPACE, " " * len(WHITE_SPACE))
    parts = F.split(F.trim(blanks), " +")
    return F.when(F.coalesce(F.length(F.trim(blanks)), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(parts)).cast("long")


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Adds columns; an input column of the same name, in any case, gives way."""
    taken = {name.lower() for name in new}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken], *[e.alias(n) for n, e in new.items()])
