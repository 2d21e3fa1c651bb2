"""Clones: equal fingerprints find exact and renamed copies by grouping; near misses by token sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
EXACT = ("depth", "role", "type", "subtype", "value", "category", "operator", "name", "op_type", "loop_type", "container_type", "visibility", "kind", "line")
#: With names and values masked.
SHAPE = ("depth", "role", "type", "subtype", "category", "operator", "op_type", "loop_type", "container_type", "kind")


def _print(columns: tuple[str, ...]) -> Column:
    """Sums, over a document's nodes, of hashes of places and columns: 128 bits and more in four counters, as the sum doesn't depend on the order.

    No tree is gathered or sorted, so that a group holds four numbers however large the document is. Halves are summed, which overflow for
    no document under two billion nodes; hashes are of the columns one by one, so that no separator can be mistaken.
    """
    node = [C("pre"), *[F.coalesce(C(c).cast("string"), F.lit("-")) for c in columns]]
    hashes = [F.xxhash64(F.lit(seed), *node) for seed in (0, 1)]
    return F.concat_ws("-", *[F.hex(F.sum(half)) for h in hashes for half in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))])


def fingerprints(nodes: DataFrame) -> DataFrame:
    """(doc_id, exact, shape, size): one grouping by document of fixed-size sums."""
    return nodes.groupBy("doc_id").agg(_print(EXACT).alias("exact"), _print(SHAPE).alias("shape"), F.count(F.lit(1)).alias("size"))


def clone_groups(nodes: DataFrame) -> DataFrame:
    """(doc_id, group_id, clone_type, group_size): groups of two documents or more; pairs are never listed."""
    prints = fingerprints(nodes)
    # Partial groups leave each task, so that a shape of very many documents is a row a task; of exact prints only whether there are two.
    groups = prints.groupBy(C("shape").alias("s")).agg(F.count(F.lit(1)).alias("group_size"), F.min("doc_id").alias("group_id"), (F.min("exact") == F.max("exact")).alias("same")).filter("group_size > 1")
    kind = F.when(C("same"), "type_i").otherwise("type_ii")
    return prints.join(groups, C("shape") == C("s")).select("doc_id", "group_id", kind.alias("clone_type"), "group_size")


def token_stream(nodes: DataFrame) -> DataFrame:
    """(doc_id, tokens): the types of the nodes in order of place."""
    rows = F.array_sort(F.collect_list(F.struct("pre", "type")))
    return nodes.groupBy("doc_id").agg(F.transform(rows, lambda r: r["type"]).alias("tokens"))


def token_sets(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("doc_id").agg(F.array_sort(F.collect_set("type")).alias("tokens"))


def pairs_of(nodes: DataFrame, asked: Column) -> DataFrame:
    """(left, right): each document of the stated query set with every other; the set is broadcast if it is small."""
    docs = nodes.filter("parent_pre = -1").select("doc_id")
    left = docs.filter(asked).select(C("doc_id").alias("left"))
    return left.join(docs.select(C("doc_id").alias("right")), C("left") != C("right"))


def token_similarity(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Jaccard similarity of the token sets of given pairs (left, right)."""
    t = token_sets(nodes)
    a, b = t.select(C("doc_id").alias("left"), C("tokens").alias("x")), t.select(C("doc_id").alias("right"), C("tokens").alias("y"))
    joined = pairs.join(a, "left").join(b, "right")
    return joined.select("left", "right", F.round(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")), 6).alias("similarity"))


def _matching(a: list, b: list) -> int:
    """Nodes of two trees, as pre-ordered (type, label, size, children), that stand at the same places with the same type and operator."""
    total, todo = 0, [(0, 0)]
    while todo:
        i, j = todo.pop()
        x, y = a[i], b[j]
        if x["type"] != y["type"] or (x["type"] == "function_call" and x["n_children"] != y["n_children"]):
            continue
        total += x["type"] not in ("binary_op", "unary_op") or x["operator"] == y["operator"]
        i, j = i + 1, j + 1
        for _ in range(min(x["n_children"], y["n_children"])):
            todo.append((i, j))
            i, j = i + a[i]["size"], j + b[j]["size"]
    return total


def structural_similarity(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(left, right, structural): 1 for equal shapes, else matching nodes over the mean size. Only the given pairs are compared."""
    rows = F.array_sort(F.collect_list(F.struct("pre", "type", F.coalesce("operator", F.lit("")).alias("operator"), "size", "n_children")))
    trees = nodes.groupBy("doc_id").agg(rows.alias("rows"), _print(SHAPE).alias("shape"))
    a = trees.select(F.col("doc_id").alias("left"), F.col("rows").alias("x"), F.col("shape").alias("sx"))
    b = trees.select(F.col("doc_id").alias("right"), F.col("rows").alias("y"), F.col("shape").alias("sy"))

    def run(frames):
        import pandas as pd

        for f in frames:
            s = [1.0 if p == q else round(2 * _matching(list(x), list(y)) / (len(x) + len(y)), 6) for x, y, p, q in zip(f["x"], f["y"], f["sx"], f["sy"], strict=True)]
            yield pd.DataFrame({"left": f["left"], "right": f["right"], "structural": s})

    return pairs.join(a, "left").join(b, "right").select("left", "right", "x", "y", "sx", "sy").mapInPandas(run, "left string, right string, structural double")


def detect(pairs: DataFrame, nodes: DataFrame, threshold: float = 0.8, weights: tuple[float, float] = (0.6, 0.4), min_nodes: int = 0, types: tuple[str, ...] = ("type_i", "type_ii", "type_iii")) -> DataFrame:
    """(left, right, similarity, clone_type): exact, renamed and near-miss clones among the given pairs; null for none.

    Documents that don't conform, or have fewer than min_nodes nodes, are no clones of anything; types says which kinds are looked for.
    """
    from treeline.operators.metrics import conformance

    sound = conformance(nodes).filter("conforms").select("doc_id")
    if min_nodes:
        sound = sound.join(nodes.groupBy("doc_id").count().filter(C("count") >= min_nodes), "doc_id", "left_semi")
    nodes = nodes.join(sound, "doc_id", "left_semi")
    prints = fingerprints(nodes)
    both = structural_similarity(pairs, nodes).join(token_similarity(pairs, nodes), ["left", "right"])
    both = both.join(prints.select(C("doc_id").alias("left"), C("exact").alias("e1"), C("shape").alias("s1")), "left").join(prints.select(C("doc_id").alias("right"), C("exact").alias("e2"), C("shape").alias("s2")), "right")
    score = F.round(weights[0] * C("structural") + weights[1] * C("similarity"), 6)
    kind = F.when(C("e1") == C("e2"), "type_i").when(C("s1") == C("s2"), "type_ii").when(score >= threshold, "type_iii")
    return both.select("left", "right", score.alias("similarity"), F.when(kind.isin(*types), kind).alias("clone_type"))


def similar(pairs: DataFrame, nodes: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(left, right, similar): whether the weighted similarity reaches the threshold."""
    return detect(pairs, nodes, threshold).select("left", "right", (C("similarity") >= threshold).alias("similar"))
