"""Axes of the node relation. Every join has doc_id as its equality key; what can be a window or a grouping is no join at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def walked(last: int) -> WindowSpec:
    """The nodes of the same document up to `last` places from the current one: -1 for all earlier ones, 0 with the node itself."""
    return Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, last)


def children(nodes: DataFrame, *columns: str, where: str | None = None, prefix: str = "c_") -> DataFrame:
    """(doc_id, up, columns with a prefix): each node below its parent's place."""
    rows = nodes.filter(where) if where else nodes
    return rows.select("doc_id", F.col("parent_pre").alias("up"), *[F.col(c).alias(prefix + c) for c in columns])


def with_child(nodes: DataFrame, where: str, *columns: str, prefix: str = "c_") -> DataFrame:
    """Adds columns of the one child for which where holds, null without it."""
    below = children(nodes, *columns, where=where, prefix=prefix).withColumnRenamed("doc_id", "d").withColumnRenamed("up", "u")
    return nodes.join(below, (F.col("doc_id") == F.col("d")) & (F.col("pre") == F.col("u")), "left").drop("d", "u")


def beside_parent(nodes: DataFrame, parents: Column, among: Column | None = None, *columns: str, prefix: str = "p_") -> DataFrame:
    """The nodes (of those in `among`, all by default) with the columns of their parents, where `parents` holds for these, and has_parent.

    Each parent goes to its children's place as one more row, and a window by document and place reads it there, so that rows which are dealt by
    document are not moved and no side of a join is gathered anywhere. Documents without an id have no parents.
    """
    mine = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    as_parent, as_child = F.struct(F.lit(True).alias("above"), F.col("pre").alias("place")), F.struct(F.lit(False).alias("above"), F.col("parent_pre").alias("place"))
    is_parent = F.coalesce(parents, F.lit(False)) & F.col("doc_id").isNotNull()
    both = F.when(is_parent & mine, F.array(as_parent, as_child)).when(is_parent, F.array(as_parent)).otherwise(F.array(as_child))
    rows = nodes.filter(is_parent | mine).withColumn("__at", F.explode(both)).withColumns({"__above": F.col("__at.above"), "__place": F.col("__at.place")}).drop("__at")
    first = lambda c: F.first(c).over(Window.partitionBy("doc_id", "__place").orderBy(F.desc("__above")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    has = first("__above")
    return rows.withColumns({"has_parent": has, **{prefix + c: F.when(has, first(c)) for c in columns}}).filter("NOT __above").drop("__above", "__place")


def descendants(tops: DataFrame, nodes: DataFrame, *columns: str, prefix: str = "b_") -> DataFrame:
    """Each row of tops with each node of its subtree, itself left out: an interval join within a document."""
    below = nodes.select(F.col("doc_id").alias("__d"), F.col("pre").alias("__p"), *[F.col(c).alias(prefix + c) for c in columns])
    return tops.join(below, (F.col("doc_id") == F.col("__d")) & (F.col("__p") > F.col("pre")) & (F.col("__p") < F.col("pre") + F.col("size"))).drop("__d", "__p")


def with_context(nodes: DataFrame) -> DataFrame:
    """Adds function_name and module_name: the last definition that the walk has entered, which stays on after its end."""
    latest = lambda kind: F.last(F.when(F.col("type") == kind, F.col("name")), ignorenulls=True).over(walked(0))
    return nodes.withColumn("function_name", latest("function_def")).withColumn("module_name", latest("container"))


def seen_before(condition: Column) -> Column:
    """True if an earlier node of the document satisfies the condition."""
    return F.coalesce(F.max(F.when(condition, 1)).over(walked(-1)), F.lit(0)) == 1


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """The lower-cased text contains one of the words; one pass of a regular expression, not a column for each word."""
    import re

    return F.coalesce(F.lower(text).rlike("|".join(re.escape(w.lower()) for w in words)), F.lit(False))
