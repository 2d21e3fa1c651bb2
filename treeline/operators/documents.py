"""Analyzers of whole documents: dead code, unused variables, purity, security, smells, taint, and the class metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.functions import rules as R
from treeline.operators.metrics import count_if, is_a, per_function, statement
from treeline.plans.axes import beside_parent, descendants, with_child

C = F.col


def table_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A rule table of constant size, safe to broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def dead_code(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, finding): statements of a block after its first early return, and conditionals whose condition is a constant; an always true one
    counts only if it has an else branch.

    One pass: what a finding needs of a node's parent is read beside it, and what came before it among its siblings by a window. Places outside
    of those below which a document has returns or constant conditions are left out first, as nothing is found there.
    """
    constant, returns = F.coalesce((C("role") == "cond") & is_a("literal"), F.lit(False)), is_a("early_return")
    bounds = {"__r0": F.min(F.when(returns, C("parent_pre"))), "__r1": F.max(F.when(returns, C("parent_pre"))), "__c0": F.min(F.when(constant, C("parent_pre"))), "__c1": F.max(F.when(constant, C("parent_pre")))}
    rows = nodes.select("doc_id", "pre", "parent_pre", "ix", "type", "role", "subtype", "value", "n_children").filter((C("ix") > 0) | returns | constant | is_a("block", "conditional"))
    rows = rows.withColumns({name: value.over(Window.partitionBy("doc_id")) for name, value in bounds.items()})
    parent = (is_a("block") & C("pre").between(C("__r0"), C("__r1"))) | (is_a("conditional") & C("pre").between(C("__c0"), C("__c1")))
    rows = beside_parent(rows, parent, constant | (((C("ix") > 0) | returns) & C("parent_pre").between(C("__r0"), C("__r1"))), "type", "n_children")
    earlier = Window.partitionBy("doc_id", "parent_pre").orderBy("ix").rowsBetween(Window.unboundedPreceding, -1)
    after = F.max(F.when(returns, 1)).over(earlier)
    v, s = C("value"), C("subtype")
    truth = F.when(s == "boolean", v == "true").when(s == "integer", v.cast("long") != 0).when(s == "null", F.lit(False)).when(s == "string", v != "")
    always = F.when(truth & (C("p_n_children") == 3), "always_true").when(~truth, "always_false")
    finding = F.when((C("p_type") == "block") & (C("after") == 1), "unreachable_after_return").when((C("p_type") == "conditional") & constant, always)
    found = rows.withColumn("after", after).withColumn("finding", finding).filter("finding IS NOT NULL")
    return found.select("doc_id", F.when(C("p_type") == "conditional", C("parent_pre")).otherwise(C("pre")).alias("pre"), "finding")


def unused_variables(nodes: DataFrame, ignore_underscore: bool = True, compat: str | None = None) -> DataFrame:
    """(doc_id, variable): names that are assigned or bound as parameters and never read in a scope around the binding.

    Lambdas, definitions, containers and loops are scopes; a read counts for every scope that is open where it stands, so that a binding
    is unused if its scope (the subtree of the innermost scope around it) has no read of the name. With compat="reference" only bindings outside
    of all scopes are reported.
    """
    target = F.coalesce(C("role").isin("target", "param", "iter", "pattern"), F.lit(False))
    named, scope = is_a("variable", "param") & C("value").isNotNull(), is_a("lambda", "function_def", "container", "loop")
    rows = nodes.filter(named | scope).select("doc_id", "pre", C("value").alias("variable"), named.alias("named"), target.alias("written"), F.when(scope, F.struct(C("pre").alias("s"), (C("pre") + C("size")).alias("e"))).alias("scope"))
    # The innermost scope is the last that begins before the binding. Everything is read within the document's own rows, which move once.
    around = F.filter(F.collect_list("scope").over(Window.partitionBy("doc_id")), lambda x: (C("pre") > x["s"]) & (C("pre") < x["e"]))
    whole = F.struct(F.lit(-1).cast("long").alias("s"), F.lit(2**62).alias("e"))
    held = rows.withColumn("held", F.when(C("written"), F.coalesce(F.array_max(around), whole))).filter("named")
    if compat == "reference":
        held = held.withColumn("held", F.when(C("held.s") == -1, C("held")))
    by_name = held.groupBy("doc_id", "variable").agg(F.collect_set("held").alias("held"), F.collect_list(F.when(~C("written"), C("pre"))).alias("reads"))
    unused = by_name.filter(F.exists("held", lambda x: ~F.exists("reads", lambda p: (p >= x["s"]) & (p < x["e"]))))
    if ignore_underscore:
        unused = unused.filter(~C("variable").startswith("_"))
    return unused.select("doc_id", "variable")


def effect_of(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for effect, exact, starts in reversed(R.EFFECTS):
        out = F.when(name.isin(*exact) | reduce(lambda a, b: a | b, [name.startswith(p) for p in starts], F.lit(False)), effect).otherwise(out)
    return out


def purity(nodes: DataFrame) -> DataFrame:
    """Effects of each document, and pure, impure or unknown (calls that no rule knows)."""
    call = is_a("function_call")
    effect = F.when(call, effect_of(C("name"))).when(is_a("assignment"), "mutation").when(is_a("exception_handling"), "exception")
    g = nodes.withColumn("effect", effect).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("effect")), ",").alias("effects"), count_if(call & C("effect").isNull()).alias("unknown_calls"))
    return g.withColumn("purity", F.when(C("effects") != "", "impure").when(C("unknown_calls") > 0, "unknown").otherwise("pure")).withColumn("confidence", F.when(C("purity") == "unknown", "low").otherwise("high"))


def security(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, category, severity, cwe): dangerous calls, secrets, weak cryptography and insecure protocols."""
    spark = nodes.sparkSession
    calls = nodes.filter(is_a("function_call"))
    texts = nodes.filter(is_a("literal") & (C("subtype") == "string"))
    dangerous = table_of(spark, R.DANGEROUS_CALLS, "r_language string, r_name string, r_category string, severity string, cwe int")
    a = calls.join(dangerous, (C("language") == C("r_language")) & (C("name") == C("r_name"))).select("doc_id", "pre", C("r_category").alias("category"), "severity", "cwe")
    found = F.array_compact(F.array(*[F.when(C("value").rlike(p), F.lit(k)) for k, p in R.SECRETS]))
    b = texts.select("doc_id", "pre", F.explode(found).alias("x")).select("doc_id", "pre", F.lit("hardcoded_secret").alias("category"), F.lit("high").alias("severity"), F.lit(798).alias("cwe"))
    weak = lambda text: text.rlike("|".join(R.WEAK_CRYPTO))
    c = calls.filter(weak(C("name"))).unionByName(texts.filter(weak(C("value")))).select("doc_id", "pre", F.lit("weak_cryptography").alias("category"), F.lit("medium").alias("severity"), F.lit(327).alias("cwe"))
    d = texts.filter(C("value").startswith("http://")).select("doc_id", "pre", F.lit("insecure_protocol").alias("category"), F.lit("medium").alias("severity"), F.lit(319).alias("cwe"))
    return a.union(b).union(c).union(d)


def rollup(findings: DataFrame, *columns: str) -> DataFrame:
    """Totals by each column and over all, from one pass: grouping sets."""
    sets = ", ".join([f"({c})" for c in columns] + ["()"])
    return findings.sparkSession.sql(f"SELECT {', '.join(columns)}, count(*) AS n FROM {{findings}} GROUP BY GROUPING SETS ({sets})", findings=findings)


def magic_numbers(nodes: DataFrame) -> DataFrame:
    """Numbers other than 0, 1 and -1, and all floats, directly below an operator."""
    number = is_a("literal") & ((C("subtype") == "float") | ((C("subtype") == "integer") & ~C("value").isin("0", "1", "-1")))
    return beside_parent(nodes.select("doc_id", "pre", "parent_pre", "type", "subtype", "value"), is_a("binary_op", "unary_op"), number).filter("has_parent").select("doc_id", "pre", "value")


def complex_conditionals(nodes: DataFrame, most: int = 2) -> DataFrame:
    """Conditions in which boolean operators are nested more than `most` deep: (doc_id, pre, operators, severity), operators being that depth."""
    boolean = is_a("binary_op", "unary_op") & (C("category") == "boolean")
    cond = nodes.filter("role = 'cond'").select(C("doc_id").alias("d"), C("pre").alias("c"), (C("pre") + C("size")).alias("end"))
    tops = nodes.filter(boolean).select("doc_id", "pre", "size")
    inside = tops.join(cond, (C("doc_id") == C("d")) & (C("pre") >= C("c")) & (C("pre") < C("end"))).select("doc_id", "c", "pre", "size")
    over = inside.select(C("doc_id").alias("od"), C("c").alias("oc"), C("pre").alias("op"), (C("pre") + C("size")).alias("oe"))
    depth = inside.join(over, (C("doc_id") == C("od")) & (C("c") == C("oc")) & (C("op") <= C("pre")) & (C("pre") < C("oe"))).groupBy("doc_id", "c", "pre").count()
    g = depth.groupBy("doc_id", C("c").alias("pre")).agg(F.max("count").alias("operators")).filter(C("operators") > most)
    return g.select("doc_id", "pre", "operators", F.when(C("operators") > 3, "high").otherwise("medium").alias("severity"))


def severity_of(ratio: Column) -> Column:
    return F.when(ratio >= 3, "critical").when(ratio >= 2, "high").when(ratio >= 1.5, "medium").otherwise("low")


def smells(nodes: DataFrame, max_statements: int = 50, max_nesting: int = 4) -> DataFrame:
    """Long functions (documents, where they hold none) and deep nesting, with a severity from how far they pass the limit. Documents are grouped once for both."""
    g = nodes.groupBy("doc_id").agg(count_if(statement()).alias("statements"), F.max("nest").cast("long").alias("nesting"), count_if(is_a("function_def")).alias("functions"))
    smell = lambda holds, name, ratio: F.when(holds, F.struct(F.lit(name).alias("smell"), severity_of(ratio).alias("severity")))
    too_long, ratio = C("statements") > max_statements, C("statements") / max_statements
    own = F.array_compact(F.array(smell((C("functions") == 0) & too_long, "long_function", ratio), smell(C("nesting") > max_nesting, "deep_nesting", C("nesting") / max_nesting)))
    inner = per_function(nodes).filter(too_long).select("doc_id", F.lit("long_function").alias("smell"), severity_of(ratio).alias("severity"))
    return g.select("doc_id", F.inline(own)).union(inner)


def all_smells(nodes: DataFrame, max_statements: int = 50, max_nesting: int = 4) -> DataFrame:
    """(doc_id, smell, severity): long functions, deep nesting, magic numbers and complex conditions."""
    magic = magic_numbers(nodes).select("doc_id", F.lit("magic_number").alias("smell"), F.lit("low").alias("severity"))
    complex_ = complex_conditionals(nodes).select("doc_id", F.lit("complex_conditional").alias("smell"), "severity")
    return smells(nodes, max_statements, max_nesting).union(magic).union(complex_)


def taint(nodes: DataFrame) -> DataFrame:
    """Sinks with an argument, at any depth, that is a source of the same language."""
    spark = nodes.sparkSession
    sources = table_of(spark, R.TAINT_SOURCES, "s_language string, s_name string")
    sinks = table_of(spark, R.TAINT_SINKS, "k_language string, k_name string, risk string")
    top = nodes.filter(is_a("function_call")).join(sinks, (C("language") == C("k_language")) & (C("name") == C("k_name"))).select("doc_id", "pre", "size", "name", "risk")
    named = nodes.withColumn("said", F.coalesce("name", "value")).filter(is_a("function_call", "variable")).join(sources, (C("language") == C("s_language")) & (C("said") == C("s_name")), "left_semi")
    return descendants(top, named, "said").select("doc_id", "pre", C("name").alias("sink"), C("b_said").alias("source"), "risk")


def coupling(nodes: DataFrame) -> DataFrame:
    """Distinct modules that dotted calls name, and how stable that leaves a document."""
    module = F.split("name", r"\.")[0]
    dotted = is_a("function_call") & C("name").contains(".")
    g = nodes.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set(F.when(dotted, module))), ",").alias("dependencies"), F.count_distinct(F.when(dotted, module)).alias("efferent"))
    return g.withColumn("instability", F.when(C("efferent") > 0, 1.0).otherwise(0.0)).withColumn("assessment", F.when(C("efferent") < 5, "excellent").when(C("efferent") < 10, "good").when(C("efferent") < 20, "fair").otherwise("poor"))


def method_attributes(nodes: DataFrame) -> DataFrame:
    """(doc_id, method, name, attribute): attributes of self, this or @ that each method touches."""
    own = with_child(nodes.filter(is_a("attribute_access")).unionByName(nodes.filter(is_a("variable"))), "type = 'variable'", "value").filter(is_a("attribute_access") & C("c_value").isin("self", "this", "@"))
    methods = nodes.filter(is_a("function_def")).select("doc_id", "pre", "size", C("name").alias("method"))
    return descendants(methods, own, "name").select("doc_id", C("pre").alias("place"), "method", C("b_name").alias("attribute")).distinct()


def cohesion(nodes: DataFrame) -> DataFrame:
    """LCOM (components of methods that share attributes, less one), TCC and LCC of each class.

    A method is at most in one component; components are found by passing the smallest method along shared attributes inside the document's
    own rows, as attributes and methods of one class are few.
    """
    uses = method_attributes(nodes)
    methods = nodes.filter(is_a("function_def")).select("doc_id", C("pre").alias("place"))
    a, b = uses.select("doc_id", C("place").alias("x"), "attribute"), uses.select("doc_id", C("place").alias("y"), "attribute")
    pairs = a.join(b, ["doc_id", "attribute"]).filter("x < y").select("doc_id", "x", "y").distinct()
    edges = pairs.groupBy("doc_id").agg(F.collect_list(F.array("x", "y")).alias("edges"), F.count(F.lit(1)).alias("connected"))
    per = methods.groupBy("doc_id").agg(F.array_sort(F.collect_list("place")).alias("places")).join(edges, "doc_id", "left")
    per = per.withColumn("edges", F.coalesce("edges", F.array().cast("array<array<bigint>>"))).withColumn("connected", F.coalesce("connected", F.lit(0)))
    # label[i] is the least method known to hang together with places[i]; each edge merges two labels.
    labels = F.aggregate("edges", C("places"), lambda label, e: F.transform(label, lambda x: F.when((x == _label(label, e, 0)) | (x == _label(label, e, 1)), F.least(_label(label, e, 0), _label(label, e, 1))).otherwise(x)))
    per = per.withColumn("labels", labels).withColumn("m", F.size("places").cast("long"))
    sizes = F.transform(F.array_distinct("labels"), lambda x: F.size(F.filter("labels", lambda y: y == x)).cast("long"))
    per = per.withColumn("components", F.size(F.array_distinct("labels")).cast("long")).withColumn("reachable", F.aggregate(sizes, F.lit(0).cast("long"), lambda t, s: t + (s * (s - 1) / 2).cast("long")))
    total = (C("m") * (C("m") - 1) / 2).cast("long")
    per = per.withColumn("pairs", total).withColumn("lcom", F.greatest(F.lit(0).cast("long"), C("components") - 1))
    share = lambda n: F.round(F.when(C("pairs") > 0, n / C("pairs")).otherwise(1.0), 6)
    per = per.withColumn("tcc", share(C("connected"))).withColumn("lcc", share(C("reachable")))
    ladder = F.when((C("lcom") == 0) & (C("tcc") >= 0.8), "excellent").when((C("lcom") <= 1) & (C("tcc") >= 0.6), "good").when((C("lcom") <= 3) & (C("tcc") >= 0.4), "fair").when((C("lcom") <= 5) & (C("tcc") >= 0.2), "poor").otherwise("very_poor")
    return per.select("doc_id", C("m").alias("methods"), "pairs", "lcom", "tcc", "lcc", ladder.alias("assessment"))


def _label(label: Column, edge: Column, end: int) -> Column:
    return F.element_at(label, F.array_position(C("places"), edge[end]).cast("int"))


def simplify_conditional(nodes: DataFrame) -> DataFrame:
    """Conditionals that give true/false, false/true or a constant in one branch."""
    rows = nodes.filter(is_a("conditional")).unionByName(nodes.filter("role IN ('then', 'else')"))
    rows = with_child(with_child(rows, "role = 'then'", "subtype", "value", prefix="t_"), "role = 'else'", "subtype", "value", prefix="e_").filter(is_a("conditional"))
    boolean = lambda p, v: F.coalesce((C(f"{p}_subtype") == "boolean") & (C(f"{p}_value") == v), F.lit(False))
    kind = F.when(boolean("t", "true") & boolean("e", "false"), "use_condition").when(boolean("t", "false") & boolean("e", "true"), "negate_condition").when(boolean("e", "false"), "use_and").when(boolean("t", "true"), "use_or")
    return rows.withColumn("simplification", kind).filter("simplification IS NOT NULL").select("doc_id", "pre", "simplification")


def control_flow_counts(nodes: DataFrame) -> DataFrame:
    """Numbers of nodes and edges of each document's control-flow graph, in closed form.

    nodes = 2 + statements + returns + 2 conditionals + 2 while + for; edges = 1 + statements + returns + 4 conditionals (5 with an else) + 3 while + 2 for.
    """
    plain = is_a("assignment", "function_call", "inline_match", "augmented_assignment") & ~F.coalesce(C("role").isin("cond", "value", "arg"), F.lit(False))
    g = nodes.groupBy("doc_id").agg(
        count_if(plain).alias("s"), count_if(is_a("early_return")).alias("r"), count_if(is_a("conditional")).alias("c"), count_if(is_a("conditional") & (C("n_children") == 3)).alias("ce"),
        count_if(is_a("loop") & (C("loop_type") == "while")).alias("w"), count_if(is_a("loop") & (C("loop_type") != "while")).alias("f"),
    )
    return g.select("doc_id", (2 + C("s") + C("r") + 2 * C("c") + 2 * C("w") + C("f")).alias("cfg_nodes"), (1 + C("s") + C("r") + 4 * C("c") + C("ce") + 3 * C("w") + 2 * C("f")).alias("cfg_edges"))
