"""Metrics: one grouping by document for each family, so that a union of them costs one shuffle each and no join of trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.model import layer

C = F.col


def is_a(*kinds: str) -> Column:
    return C("type").isin(*kinds)


def logical() -> Column:
    return is_a("binary_op") & (C("category") == "boolean") & C("operator").isin("and", "or")


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def validation(nodes: DataFrame, deep: int = 100, large: int = 1000) -> DataFrame:
    """Level, depth, number of nodes, native constructs, distinct variables and warnings of each document."""
    kind = layer(C("type"))
    g = nodes.groupBy("doc_id").agg(
        (F.max("depth") + 1).cast("long").alias("tree_depth"), F.count(F.lit(1)).alias("node_count"), count_if(kind == "native").alias("native_constructs"),
        count_if(kind.isin("extended", "structural")).alias("extended_constructs"), F.count_distinct(F.when(is_a("variable"), C("value"))).alias("variable_count"),
    )
    g = g.withColumn("level", F.when(C("native_constructs") > 0, "native").when(C("extended_constructs") > 0, "extended").otherwise("core"))
    warnings = F.array(F.when(C("native_constructs") > 0, "native_constructs"), F.when(C("tree_depth") > deep, "deep_nesting"), F.when(C("node_count") > large, "large_tree"))
    return g.withColumn("warnings", F.array_join(F.array_compact(warnings), ","))


def constraints(nodes: DataFrame, strict: bool = False, max_depth: int = 1000, max_variables: int = 10_000) -> DataFrame:
    """(doc_id, error): the first constraint that a document breaks, null for none. Only strict documents may hold no native construct."""
    broken = (
        F.when(F.lit(strict) & (C("native_constructs") > 0), "native_constructs_not_allowed")
        .when(C("tree_depth") > max_depth, F.format_string("max_depth_exceeded %d > %d", C("tree_depth"), F.lit(max_depth)))
        .when(C("variable_count") > max_variables, F.format_string("too_many_variables %d > %d", C("variable_count"), F.lit(max_variables)))
    )
    return validation(nodes).select("doc_id", broken.alias("error"))


def conformance(nodes: DataFrame) -> DataFrame:
    """(doc_id, conforms, n_bad): each node against the contract of its type; a document conforms if all of its nodes do."""
    n = C("n_children")
    number = C("value").rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$")
    ok = (
        F.when(is_a("literal"), C("subtype").isin("integer", "float", "string", "boolean", "null", "symbol", "regex") & (~C("subtype").isin("integer", "float") | number) & ((C("subtype") != "boolean") | C("value").isin("true", "false")))
        .when(is_a("variable", "param"), C("value").isNotNull())
        .when(is_a("pair", "assignment", "inline_match", "augmented_assignment"), n == 2)
        .when(is_a("binary_op"), (n == 2) & C("category").isin("arithmetic", "comparison", "boolean") & C("operator").isNotNull())
        .when(is_a("unary_op"), (n == 1) & C("category").isin("arithmetic", "comparison", "boolean") & C("operator").isNotNull())
        .when(is_a("function_call", "property", "function_def"), C("name").isNotNull())
        .when(is_a("attribute_access"), (n == 1) & C("name").isNotNull())
        .when(is_a("conditional"), n.between(2, 3))
        .when(is_a("early_return"), n <= 1)
        .when(is_a("loop"), F.when(C("loop_type") == "while", n.between(2, 3)).otherwise(C("loop_type").isin("for", "for_each") & n.between(3, 4)))
        .when(is_a("collection_op"), F.when(C("op_type").isin("map", "filter"), n == 2).otherwise((C("op_type") == "reduce") & (n == 3)))
        .when(is_a("pattern_match", "exception_handling"), n >= 1)
        .when(is_a("async_operation"), C("op_type").isin("await", "async") & (n == 1))
        .when(is_a("container"), C("container_type").isin("module", "class", "namespace") & C("name").isNotNull())
        .when(is_a("language_specific"), C("language").isNotNull())
        .otherwise(layer(C("type")) != "unknown")
    )
    bad = ~F.coalesce(ok, F.lit(False))
    return nodes.groupBy("doc_id").agg(count_if(bad).alias("n_bad")).select("doc_id", (C("n_bad") == 0).alias("conforms"), "n_bad")


def visible(nodes: DataFrame) -> DataFrame:
    """The nodes that a walker sees which goes into definitions, lambdas and containers only where their body is one node.

    Only tops that hide something take part in the interval join, as its small side.
    """
    bodies = nodes.filter(C("role") == "body").groupBy(C("doc_id").alias("bd"), C("parent_pre").alias("bp")).agg(F.count(F.lit(1)).alias("n"))
    tops = nodes.filter(is_a("function_def", "lambda", "container")).select("doc_id", "pre", "size")
    hiding = tops.join(bodies, (C("doc_id") == C("bd")) & (C("pre") == C("bp")), "left").filter(F.coalesce("n", F.lit(0)) != 1)
    hiding = hiding.select(C("doc_id").alias("hd"), C("pre").alias("hp"), C("size").alias("hs"))
    return nodes.join(hiding, (C("doc_id") == C("hd")) & (C("pre") > C("hp")) & (C("pre") < C("hp") + C("hs")), "left_anti")


def unwrapped(nodes: DataFrame) -> DataFrame:
    """The nodes without a root that only wraps the code, a container or a definition, and without the root's parameters."""
    wraps = is_a("container", "function_def")
    roots = nodes.filter((C("parent_pre") == -1) & wraps).select(C("doc_id").alias("rd"), C("pre").alias("rp"))
    of_root = (C("doc_id") == C("rd")) & ((C("pre") == C("rp")) | ((C("parent_pre") == C("rp")) & is_a("param")))
    return nodes.join(roots, of_root, "left_anti")


def cyclomatic(nodes: DataFrame, compat: str | None = None) -> DataFrame:
    """1 + decision points: conditionals, loops, boolean and/or, handlers of exceptions and arms of matches.

    With compat="reference" only nodes that are visible() count; a document of which none is has 1.
    """
    if compat == "reference":
        nodes = visible(nodes)
    arm = C("role").isin("handler", "arm")
    return nodes.groupBy("doc_id").agg((1 + F.sum(F.when(is_a("conditional", "loop") | logical(), 1).when(arm, 1).otherwise(0))).cast("long").alias("cyclomatic"))


def cognitive(nodes: DataFrame) -> DataFrame:
    """Conditionals, loops, exceptions and arms cost 1 and their nesting, boolean operators 1."""
    own = F.when(is_a("conditional", "loop", "exception_handling", "match_arm"), 1 + C("nest")).when(logical(), 1).otherwise(0)
    return nodes.groupBy("doc_id").agg(F.sum(own).cast("long").alias("cognitive"))


def nesting(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("doc_id").agg(F.max("nest").cast("long").alias("max_nesting"))


def nesting_issues(nodes: DataFrame, warn: int = 4, most: int = 5) -> DataFrame:
    """(doc_id, pre, type, nesting, severity): nodes below which the nesting reaches warn, from the node on; a warning from most on.

    Only nodes that are nested deeply enough themselves look for the nodes above them, so that shallow documents join nothing.
    """
    deep = nodes.filter(C("nest") >= warn).select(C("doc_id").alias("d"), C("pre").alias("p"), C("nest").alias("n"))
    inside = (C("doc_id") == C("d")) & (C("p") >= C("pre")) & (C("p") < C("pre") + C("size")) & (C("n") >= C("nest") + warn)
    found = nodes.join(deep, inside).groupBy("doc_id", "pre", "type").agg(F.max(C("n") - C("nest")).cast("long").alias("nesting"))
    return found.withColumn("severity", F.when(C("nesting") >= most, "warning").otherwise("info"))


def halstead_tokens() -> tuple[Column, Column, Column]:
    """The operator, the operand and the second operator that a node emits; null where it emits none."""
    quoted = F.when(C("subtype") == "string", F.concat(F.lit('"'), C("value"), F.lit('"'))).otherwise(F.coalesce(C("value"), F.lit("null")))
    fixed = {
        "conditional": "if", "assignment": "=", "inline_match": "=", "function_call": "()", "exception_handling": "try", "pattern_match": "case", "early_return": "return", "lambda": "lambda", "function_def": "def",
        "attribute_access": ".", "property": "property", "collection_op": "map", "list": "list", "map": "map", "async_operation": "async", "language_specific": "native",
    }
    own = F.when(is_a("binary_op", "unary_op", "augmented_assignment"), C("operator")).when(is_a("loop"), C("loop_type")).when(is_a("container"), C("container_type"))
    for kind, token in fixed.items():
        own = own.when(is_a(kind), token)
    operand = F.when(is_a("literal"), quoted).when(is_a("variable", "param"), C("value")).when(is_a("function_call", "container", "function_def", "attribute_access"), C("name"))
    return own, operand, F.when(is_a("function_def"), C("visibility"))


def halstead(nodes: DataFrame, compat: str | None = None) -> DataFrame:
    """One grouping by document: counts add up, and a document's distinct tokens are sets that its size bounds. compat as in cyclomatic()."""
    if compat == "reference":
        nodes = visible(nodes)
    first, operand, second = halstead_tokens()
    g = nodes.select("doc_id", first.alias("a"), operand.alias("b"), second.alias("c")).groupBy("doc_id").agg(
        F.size(F.array_union(F.collect_set("a"), F.collect_set("c"))).cast("long").alias("n1"), F.size(F.collect_set("b")).cast("long").alias("n2"), (F.count("a") + F.count("c")).alias("total1"), F.count("b").alias("total2")
    )
    vocabulary, length = C("n1") + C("n2"), C("total1") + C("total2")
    g = g.withColumn("volume", F.when(vocabulary > 0, length * F.log2(vocabulary.cast("double"))).otherwise(0.0))
    g = g.withColumn("difficulty", F.when(C("n2") > 0, C("n1") / 2.0 * C("total2") / C("n2")).otherwise(0.0))
    return g.select("doc_id", "n1", "n2", "total1", "total2", F.round("volume", 6).alias("volume"), F.round("difficulty", 6).alias("difficulty"), F.round(C("volume") * C("difficulty"), 4).alias("effort"))


def statement() -> Column:
    return is_a("assignment", "inline_match", "augmented_assignment", "conditional", "loop", "early_return", "exception_handling", "pattern_match", "function_call", "collection_op", "async_operation")


def lines_of_code(nodes: DataFrame, compat: str | None = None) -> DataFrame:
    """Logical lines (statements that stand in a block or a body), physical lines (distinct line numbers, else the logical ones) and blank lines. compat as in cyclomatic()."""
    if compat == "reference":
        nodes = visible(nodes)
    g = nodes.groupBy("doc_id").agg(count_if(statement()).alias("logical"), F.count_distinct(F.when(C("line") > 0, C("line"))).alias("lines"))
    physical = F.when(C("lines") > 0, C("lines")).otherwise(C("logical"))
    return g.select("doc_id", "logical", physical.alias("physical"), F.greatest(F.lit(0).cast("long"), physical - C("logical")).alias("blank"))


def function_metrics(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("doc_id").agg(count_if(statement()).alias("statement_count"), count_if(is_a("early_return")).alias("return_points"), F.count_distinct(F.when(is_a("variable"), C("value"))).alias("variable_count"), count_if(is_a("param")).alias("parameter_count"))


def per_function(nodes: DataFrame) -> DataFrame:
    """Cyclomatic complexity, statements and greatest relative nesting of every function definition, nested ones included."""
    from treeline.plans.axes import descendants

    tops = nodes.filter(is_a("function_def")).select("doc_id", "pre", "size", "name", C("nest").alias("own"))
    rows = descendants(tops, nodes.select("doc_id", "pre", "type", "category", "operator", "role", "nest"), "type", "category", "operator", "role", "nest", prefix="")
    g = rows.groupBy("doc_id", "pre", "name").agg(
        (1 + F.sum(F.when(is_a("conditional", "loop") | logical(), 1).when(C("role").isin("handler", "arm"), 1).otherwise(0))).cast("long").alias("cyclomatic"), count_if(statement()).alias("statements"), (F.max(C("nest") - C("own"))).cast("long").alias("max_nesting")
    )
    return g.select("doc_id", C("name").alias("function_name"), "cyclomatic", "statements", "max_nesting")


#: Fixed values: (metric, warning from, error from).
THRESHOLDS = (("cyclomatic", 10, 20), ("cognitive", 15, 30), ("max_nesting", 3, 5), ("logical", 50, 100))


def complexity(nodes: DataFrame) -> DataFrame:
    """All complexity metrics of a document in one row, from one shuffle, with warnings and a summary."""
    own = F.when(is_a("conditional", "loop", "exception_handling", "match_arm"), 1 + C("nest")).when(logical(), 1).otherwise(0)
    point = F.when(is_a("conditional", "loop") | logical(), 1).when(C("role").isin("handler", "arm"), 1).otherwise(0)
    g = nodes.groupBy("doc_id").agg((1 + F.sum(point)).cast("long").alias("cyclomatic"), F.sum(own).cast("long").alias("cognitive"), F.max("nest").cast("long").alias("max_nesting"), count_if(statement()).alias("logical"))
    g = g.withColumn("warnings", F.array_join(F.array_compact(F.array(*[F.when(C(m) >= e, f"{m} error").when(C(m) >= w, f"{m} warning") for m, w, e in THRESHOLDS])), ","))
    n = F.size(F.filter(F.split("warnings", ","), lambda x: x != ""))
    ladder = lambda a, b, c: (C("cyclomatic") <= a) & (C("cognitive") <= b) & (C("max_nesting") <= c)
    summary = F.when(n == 1, "moderate").when(n > 1, "high").when(ladder(5, 7, 2), "low").when(ladder(10, 15, 3), "moderate").when(ladder(20, 30, 5), "high").otherwise("very high")
    return g.withColumn("summary", summary)


def merge(results: DataFrame, *keys: str) -> DataFrame:
    """Complexity rows of several documents as one: greatest complexity, summed lines, each warning once."""
    said = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(F.split("warnings", ","), lambda x: x != "")))))
    return results.groupBy(*keys).agg(F.max("cyclomatic").alias("cyclomatic"), F.max("cognitive").alias("cognitive"), F.max("max_nesting").alias("max_nesting"), F.sum("logical").alias("logical"), F.array_join(said, ",").alias("warnings"), F.count(F.lit(1)).alias("documents"))


def type_frequencies(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(layer(C("type")).alias("layer"), "type").agg(F.count(F.lit(1)).alias("n"))


def variables(nodes: DataFrame) -> DataFrame:
    return nodes.filter(is_a("variable")).select("doc_id", C("value").alias("variable")).distinct()
