"""Trees and results as text and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col


def tree_text(nodes: DataFrame) -> DataFrame:
    """(doc_id, text): one indented line for each node."""
    label = F.concat_ws(" ", "type", F.coalesce("name", F.lit(None)), "operator", "value")
    rows = F.array_sort(F.collect_list(F.struct("pre", F.concat(F.repeat(F.lit("  "), C("depth")), label).alias("line"))))
    return nodes.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))


def tree_plain(nodes: DataFrame) -> DataFrame:
    """(doc_id, text): the types of the nodes in order of place, in one line."""
    rows = F.array_sort(F.collect_list(F.struct("pre", "type")))
    return nodes.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["type"]), " ").alias("text"))


def tree_format(nodes: DataFrame, style: str = "tree") -> DataFrame:
    made = {"tree": tree_text, "json": tree_json, "plain": tree_plain}
    if style not in made:
        raise ValueError(f"unknown style {style}")
    return made[style](nodes)


def tree_json(nodes: DataFrame) -> DataFrame:
    """(doc_id, json): the nodes in order of place, as an array of objects without empty fields."""
    node = F.struct("pre", "parent_pre", "type", "role", "subtype", "value", "category", "operator", "name")
    return nodes.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(node))).alias("json"))


def results_json(results: DataFrame, key: str = "doc_id") -> DataFrame:
    return results.select(key, F.to_json(F.struct(*[c for c in results.columns if c != key])).alias("json"))
