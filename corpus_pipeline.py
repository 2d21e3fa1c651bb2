"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

What operators do with odd rows holds here, too. Null, empty and blank texts: the classifier scores them like any other text; those that it
keeps are copies of each other, so that one stays; substring dedup passes them; the mix never takes them, as they have no words. Rows that
repeat an id and a text become one in near-dedup; null ids come last wherever ids decide. A text that substring dedup empties goes. Very
long texts are treated whole. Ties are decided by ids and hashes, so that reruns agree. Columns beside doc_id, text and source pass through all
stages but the last, whatever their names; an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.common import released, scratch, table, written
from treeline.llm.mixing import mix_sources
from treeline.llm.near_copies import keep_one
from treeline.llm.quality_net import quality_scores
from treeline.llm.sentence_spans import dedup_substrings
from treeline.llm.sentencepiece_wfst import encode_documents


PLAIN = ("doc_id", "text", "source", "lang", "n_chars")


def safe(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """The rows with names that no operator adds for all but the known columns, and the columns that give them their names again."""
    names = {c: c if c in PLAIN else f"__column_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    rows, own = safe(docs)
    return quality_scores(rows, table(spark, sf_dir, "labels"), keep=tuple(rows.columns)).filter("predicted = 1").select(*own)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 80 % of their five-word shingles stays, the one with the smallest id: candidates by SimHash and BK-trees, and by least hashes where 64 bits can't tell; an exact check follows."""
    released(spark)
    return keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated spans go from the texts; a document of which nothing is left goes with them."""
    released(spark)
    rows, own = safe(docs)
    cut = dedup_substrings(rows).filter((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(*own)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    released(spark)
    rows, own = safe(docs)
    mixed = mix_sources(rows).filter("copies > 0")
    return mixed.select(*own, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("__pass")).drop("__pass")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token ids."""
    released(spark)
    return encode_documents(docs.select("doc_id", "source", "text")).select("doc_id", "source", "n_tokens", "ids", "round_trip")


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources", mixing),
    ("SentencePiece", tokens),
]

#: A trained network and merged pieces can't be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        with scratch(spark) as gone:
            docs, path = written(stage(spark, docs, sf_dir))
            gone += before  # the input of this stage and its own tables are not read again
            before = [path]
    return docs
