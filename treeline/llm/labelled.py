"""What the two learned scores share: which labelled rows may be learned from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(id_col: str) -> Column:
    """True for the rows that nothing is learned from: crc32 of the id as text is divisible by FOLDS."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, *, label_col: str, id_col: str, text_col: str, most: int) -> DataFrame:
    """(id, key, text, label) of at most `most` labelled texts outside the held-out fold, those with the least hash of their id.

    Rows without a label or a text are left out, and an id's label is the largest that the table of labels has for it. Rows that agree in id
    and text count once; an id with several texts has a row for each, and the bound holds for these rows: key, a hash of the text, tells
    them apart and orders them.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(most)
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    # Both tables that are broadcast have `most` rows of numbers at most; texts are never ordered or gathered.
    pairs = rows.join(F.broadcast(known), F.col("__doc") == F.col("__id")).select("__id", F.xxhash64("text").alias("__key"), "label").distinct()
    taken = pairs.orderBy(F.xxhash64("__id"), "__id", "__key").limit(most)
    found = rows.withColumn("key", F.xxhash64("text")).join(F.broadcast(taken), (F.col("__doc") == F.col("__id")) & (F.col("key") == F.col("__key")))
    return found.groupBy(F.col("__doc").alias("id"), "key").agg(F.first("text").alias("text"), F.first("label").alias("label"))
