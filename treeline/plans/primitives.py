"""Reading and changing parts of trees as filters and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.plans.axes import beside_parent, walked

C = F.col
#: Columns that hold a node's metadata.
META = ("subtype", "category", "operator", "name", "op_type", "loop_type", "container_type", "visibility", "kind", "language", "line")


def of_type(nodes: DataFrame, *kinds: str) -> DataFrame:
    return nodes.filter(C("type").isin(*kinds))


def get_meta(key: str, default: Column | None = None) -> Column:
    return C(key) if default is None else F.coalesce(C(key), default)


def put_meta(nodes: DataFrame, where: Column, **values: str) -> DataFrame:
    """The nodes with metadata set where the condition holds."""
    unknown = set(values) - set(META)
    if unknown:
        raise KeyError(f"no metadata columns: {', '.join(sorted(unknown))}")
    return nodes.withColumns({k: F.when(where, F.lit(v)).otherwise(C(k)) for k, v in values.items()})


def update_meta(nodes: DataFrame, where: Column, **values: Column) -> DataFrame:
    """The nodes with metadata computed from their columns where the condition holds."""
    unknown = set(values) - set(META)
    if unknown:
        raise KeyError(f"no metadata columns: {', '.join(sorted(unknown))}")
    return nodes.withColumns({k: F.when(where, v).otherwise(C(k)) for k, v in values.items()})


def update_children(nodes: DataFrame, parents: str, keep: Column) -> DataFrame:
    """The nodes without the children (and what is below them) of certain parents for which keep doesn't hold; places keep their numbers."""
    rows = beside_parent(nodes, F.expr(parents))
    goes = C("has_parent") & ~F.coalesce(keep, F.lit(False))
    # Subtrees don't overlap, so that a node is inside one that goes if the farthest end met so far lies behind it.
    end = F.max(F.when(goes, C("pre") + C("size"))).over(walked(0))
    return rows.withColumn("__end", end).filter(C("__end").isNull() | (C("__end") <= C("pre"))).select(*nodes.columns)


def traverse(nodes: DataFrame, enter: Column, leave: Column | None = None) -> DataFrame:
    """Adds acc: a number that a walk carries from node to node, as each node is entered.

    It is the sum of `enter` over the nodes entered so far, this one included, and of `leave` over those whose subtrees have ended before. One
    window by document over a row for each entry and each end.
    """
    ins = nodes.select("doc_id", C("pre").alias("at"), F.lit(1).alias("kind"), "pre", enter.cast("double").alias("v"))
    outs = nodes.select("doc_id", (C("pre") + C("size")).alias("at"), F.lit(0).alias("kind"), "pre", (F.lit(0) if leave is None else leave).cast("double").alias("v"))
    order = Window.partitionBy("doc_id").orderBy("at", "kind", F.desc("pre")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = ins.union(outs).withColumn("acc", F.sum("v").over(order)).filter("kind = 1").select(C("doc_id").alias("d"), C("pre").alias("p"), "acc")
    return nodes.join(walked, (C("doc_id") == C("d")) & (C("pre") == C("p"))).drop("d", "p")


def location(file: str | None = None) -> Column:
    """Where a node stands, as a struct."""
    return F.struct(C("line").alias("line"), F.lit(file).cast("string").alias("file"))


def metadata() -> Column:
    """A node's metadata without empty entries, as a map."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), C(k).cast("string").alias("value")) for k in META])
    return F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull()))


def described(nodes: DataFrame) -> DataFrame:
    """Adds what a node says of itself: arity of definitions and calls, container_name, function_visibility and has_state."""
    params = nodes.filter(C("type") == "param").groupBy(C("doc_id").alias("d"), C("parent_pre").alias("u")).agg(F.count(F.lit(1)).alias("n"))
    out = nodes.join(params, (C("doc_id") == C("d")) & (C("pre") == C("u")), "left").drop("d", "u")
    arity = F.when(C("type").isin("function_def", "lambda"), F.coalesce("n", F.lit(0))).when(C("type") == "function_call", C("n_children").cast("long"))
    is_container = C("type") == "container"
    return out.withColumns({
        "arity": arity, "container_name": F.when(is_container, C("name")), "function_visibility": F.when(C("type") == "function_def", F.coalesce("visibility", F.lit("public"))),
        "has_state": F.when(is_container, C("container_type") == "class"),
    }).drop("n")


def prewalk(nodes: DataFrame) -> DataFrame:
    """Parents before children: documents are kept together and sorted where they lie; documents have no order among them."""
    return nodes.repartition("doc_id").sortWithinPartitions("doc_id", "pre")


def postwalk(nodes: DataFrame) -> DataFrame:
    """Children before parents: by the end of the subtree, inner ones first."""
    return nodes.repartition("doc_id").sortWithinPartitions("doc_id", C("pre") + C("size"), C("depth").desc())


def without_children(nodes: DataFrame, where: str) -> DataFrame:
    """The nodes with the subtrees below those that satisfy the condition cut off; places keep their numbers."""
    tops = nodes.filter(where).select(C("doc_id").alias("d"), C("pre").alias("p"), C("size").alias("s"))
    inside = (C("doc_id") == C("d")) & (C("pre") > C("p")) & (C("pre") < C("p") + C("s"))
    return nodes.join(tops, inside, "left_anti")


def inspect(nodes: DataFrame) -> DataFrame:
    """(doc_id, language, nodes, depth, types, variables) of every document."""
    return nodes.groupBy("doc_id").agg(
        F.max("language").alias("language"), F.count(F.lit(1)).alias("nodes"), (F.max("depth") + 1).alias("depth"), F.count_distinct("type").alias("types"),
        F.array_join(F.array_sort(F.collect_set(F.when(C("type") == "variable", C("value")))), ",").alias("variables"),
    )


def equivalent(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, equivalent): documents of both relations whose trees are equal but for lines."""
    from treeline.operators.clones import fingerprints

    masked = lambda n: fingerprints(n.withColumn("line", F.lit(0)))
    a, b = masked(left).select("doc_id", C("exact").alias("a")), masked(right).select("doc_id", C("exact").alias("b"))
    return a.join(b, "doc_id", "full").select("doc_id", F.coalesce(C("a") == C("b"), F.lit(False)).alias("equivalent"))
