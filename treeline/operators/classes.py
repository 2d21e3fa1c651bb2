"""Class metrics: encapsulation, state and interface of each container, from the places of its methods and of what they touch.

Each class is a row of its own: methods are the definitions directly below a container, and everything else is grouped by the container's place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.operators.metrics import count_if, is_a
from treeline.plans.axes import descendants, with_child

C = F.col
#: Names of the own object, of methods that initialise, and what violations cost.
OWN = ("self", "this", "@")
INITIALISERS = ("__init__", "initialize", "constructor", "init")
COSTS = {"critical": 20, "high": 10, "medium": 5, "low": 2}


def containers(nodes: DataFrame) -> DataFrame:
    return nodes.filter(is_a("container")).select("doc_id", C("pre").alias("place"), C("name").alias("container"), "container_type")


def methods(nodes: DataFrame) -> DataFrame:
    """(doc_id, place, pre, size, method, public, n_params, body): definitions directly below a container; body is the type of a body of one statement."""
    defs = nodes.filter(is_a("function_def")).select("doc_id", C("parent_pre").alias("place"), "pre", "size", C("name").alias("method"), (F.coalesce("visibility", F.lit("public")) == "public").alias("public"))
    parts = nodes.filter(is_a("param") | (C("role") == "body")).groupBy(C("doc_id").alias("d"), C("parent_pre").alias("u")).agg(
        count_if(is_a("param")).alias("n_params"), count_if(is_a("param") & ~C("value").isin(*OWN, "cls")).alias("n_given"), count_if(C("role") == "body").alias("n_body"),
        F.max(F.when(C("role") == "body", C("type"))).alias("body_type"), F.max(F.when(C("role") == "body", C("pre"))).alias("body_pre"),
    )
    defs = defs.join(parts, (C("doc_id") == C("d")) & (C("pre") == C("u")), "left").drop("d", "u")
    return defs.join(containers(nodes), ["doc_id", "place"]).fillna(0, ["n_params", "n_given", "n_body"])


def own_attributes(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, name, written, kept_in): attributes of the own object; written where they are assigned to, kept_in the place of a list or tuple."""
    own = with_child(nodes.filter(is_a("attribute_access")).unionByName(nodes.filter(is_a("variable"))), "type = 'variable'", "value").filter(is_a("attribute_access") & C("c_value").isin(*OWN))
    up = nodes.select(C("doc_id").alias("d"), C("pre").alias("p"), C("type").alias("up_type"))
    own = own.join(up, (C("doc_id") == C("d")) & (C("parent_pre") == C("p")), "left").drop("d", "p")
    written = (C("up_type").isin("assignment", "augmented_assignment")) & (C("ix") == 0)
    return own.select("doc_id", "pre", "name", F.coalesce(written, F.lit(False)).alias("written"), F.when(C("up_type").isin("list", "tuple"), C("parent_pre")).alias("kept_in"))


def uses(nodes: DataFrame) -> DataFrame:
    """(doc_id, place, pre, method, attribute, written, kept_in): each use of an own attribute in a method."""
    found = descendants(methods(nodes), own_attributes(nodes), "name", "written", "kept_in")
    return found.select("doc_id", "place", "pre", "method", "public", C("b_name").alias("attribute"), C("b_written").alias("written"), C("b_kept_in").alias("kept_in"))


def accessor() -> Column:
    """A public method that only reads or only sets one attribute and whose name doesn't tell otherwise."""
    getter = (C("n_given") == 0) & (C("n_body") == 1) & ((C("body_type") == "attribute_access") | ((C("body_type") == "early_return") & (C("returned") == "attribute_access")))
    setter = (C("n_given") == 1) & (C("n_body") == 1) & (C("body_type") == "assignment") & (C("set_type") == "attribute_access")
    named = C("method").rlike("^(get_|set_)") | ~C("method").contains("_")
    return C("public") & F.coalesce(getter | setter, F.lit(False)) & named


def with_accessors(nodes: DataFrame) -> DataFrame:
    found = methods(nodes)
    first = nodes.filter("ix = 0").select(C("doc_id").alias("d"), C("parent_pre").alias("u"), C("type").alias("first_type"))
    found = found.join(first, (C("doc_id") == C("d")) & (C("body_pre") == C("u")), "left").drop("d", "u")
    found = found.withColumn("returned", F.when(C("body_type") == "early_return", C("first_type"))).withColumn("set_type", F.when(C("body_type") == "assignment", C("first_type")))
    return found.withColumn("accessor", accessor())


def encapsulation_violations(nodes: DataFrame) -> DataFrame:
    """(doc_id, place, violation, severity, method): state changed directly by public methods that aren't accessors, too many accessors, own state given out in a list."""
    found = with_accessors(nodes).select("doc_id", "place", "pre", "method", "public", "accessor")
    touched = uses(nodes)
    changing = touched.filter("written").select("doc_id", "place", "pre").distinct()
    missing = found.filter("public AND NOT accessor").join(changing, ["doc_id", "place", "pre"], "left_semi").select("doc_id", "place", F.lit("missing_accessor").alias("violation"), F.lit("high").alias("severity"), "method")
    totals = found.groupBy("doc_id", "place").agg(count_if(C("accessor")).alias("accessors"), count_if(C("public")).alias("publics"))
    many = totals.filter((C("accessors") > 5) & (C("accessors") > 0.7 * C("publics")))
    many = many.select("doc_id", "place", F.lit("excessive_accessors").alias("violation"), F.lit("medium").alias("severity"), F.lit(None).cast("string").alias("method"))
    # A list or tuple of own attributes that is returned, or is the last statement of the method.
    family = Window.partitionBy("doc_id", "parent_pre").orderBy("ix").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = nodes.withColumn("last", F.max("ix").over(family) == C("ix")).filter(is_a("list", "tuple")).select(C("doc_id").alias("d"), C("pre").alias("p"), C("parent_pre").alias("u"), "role", "last")
    up = nodes.filter(is_a("early_return", "function_def", "block")).select(C("doc_id").alias("ud"), C("pre").alias("up"), C("type").alias("up_type"))
    given = last.join(up, (C("d") == C("ud")) & (C("u") == C("up"))).filter((C("up_type") == "early_return") | C("last")).select("d", "p")
    leaks = touched.filter("public").join(given, (C("doc_id") == C("d")) & (C("kept_in") == C("p")), "left_semi").select("doc_id", "place", F.lit("leaky_abstraction").alias("violation"), F.lit("medium").alias("severity"), "method").distinct()
    return missing.union(many).union(leaks)


def encapsulation(nodes: DataFrame) -> DataFrame:
    """Per class: methods, public and private ones, accessors, violations, a score of 100 less what they cost, and an assessment."""
    cost = F.element_at(F.create_map(*[F.lit(x) for kv in COSTS.items() for x in kv]), C("severity"))
    found = encapsulation_violations(nodes).groupBy("doc_id", "place").agg(F.count(F.lit(1)).cast("int").alias("violations"), F.sum(cost).cast("int").alias("cost"))
    g = with_accessors(nodes).groupBy("doc_id", "place", "container").agg(
        F.count(F.lit(1)).alias("methods"), count_if(C("public")).alias("public_methods"), count_if(~C("public")).alias("private_methods"), count_if(C("accessor")).alias("accessors")
    )
    g = g.join(found, ["doc_id", "place"], "left").fillna(0, ["violations", "cost"]).withColumn("score", F.greatest(F.lit(0), 100 - C("cost")))
    ladder = F.when(C("score") >= 90, "excellent").when(C("score") >= 75, "good").when(C("score") >= 60, "fair").when(C("score") >= 40, "poor").otherwise("very_poor")
    return g.select("doc_id", "container", "methods", "public_methods", "private_methods", "accessors", "violations", "score", ladder.alias("assessment"))


def state_management(nodes: DataFrame) -> DataFrame:
    """Per class: state variables, those that are initialised, changed or only read, the pattern that this makes and an assessment."""
    touched = uses(nodes)
    names = lambda when: F.array_sort(F.collect_set(F.when(when, C("attribute"))))
    g = touched.groupBy("doc_id", "place").agg(
        names(F.lit(True)).alias("state"), names(C("written")).alias("mutable"), names(C("written") & C("method").isin(*INITIALISERS)).alias("initialized"), count_if(C("written")).alias("mutation_count")
    )
    g = containers(nodes).join(g, ["doc_id", "place"], "left").fillna(0, ["mutation_count"])
    g = g.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("state", "mutable", "initialized")}).withColumn("state_count", F.size("state").cast("long"))
    g = g.withColumn("uninitialized", F.array_except("state", "initialized")).withColumn("read_only", F.array_except("state", "mutable"))
    pattern = F.when(C("state_count") == 0, "stateless").when(C("mutation_count") == 0, "immutable_state").when(F.size("mutable") > 0, "controlled_mutation").otherwise("uncontrolled_mutation")
    warned = F.when(C("mutation_count") > 10, 1).otherwise(0) + F.when(F.size("uninitialized") > 0, 1).otherwise(0)
    base = F.when(pattern == "stateless", 100).when(pattern == "immutable_state", 95).when(pattern == "controlled_mutation", 80).otherwise(50)
    score = base - F.least(F.lit(30).cast("long"), 2 * C("mutation_count") + 5 * warned)
    text = lambda c: F.array_join(c, ",").alias(c)
    ladder = F.when(score >= 90, "excellent").when(score >= 75, "good").when(score >= 60, "fair").otherwise("poor")
    return g.select("doc_id", "container", "state_count", "mutation_count", text("initialized"), text("uninitialized"), text("read_only"), text("mutable"), pattern.alias("pattern"), ladder.alias("assessment"))


def api_surface(nodes: DataFrame) -> DataFrame:
    """Per class with public methods: how many there are, their parameters, an assessment and warnings."""
    g = methods(nodes).filter("public").groupBy("doc_id", "place", "container").agg(F.count(F.lit(1)).alias("public_methods"), F.round(F.avg("n_params"), 6).alias("avg_params"), F.max("n_params").alias("max_params"))
    size, avg, most = C("public_methods"), C("avg_params"), C("max_params")
    ladder = F.when((size <= 10) & (avg <= 3) & (most <= 5), "excellent").when((size <= 15) & (avg <= 4) & (most <= 6), "good").when((size <= 25) & (avg <= 5), "fair").otherwise("poor")
    warnings = F.array(F.when(size > 20, "large_surface"), F.when(avg > 4, "many_parameters_on_average"), F.when(most > 6, "too_many_parameters"))
    return g.select("doc_id", "container", "public_methods", "avg_params", "max_params", ladder.alias("assessment"), F.array_join(F.array_compact(warnings), ",").alias("warnings"))


def cohesion_warnings(cohesion: DataFrame) -> DataFrame:
    """Adds warnings to rows of documents.cohesion: little cohesion, little shared state, too few methods to tell."""
    found = F.array(F.when(C("lcom") > 5, "high_lcom"), F.when(C("tcc") < 0.3, "low_tcc"), F.when(C("methods") < 3, "few_methods"))
    return cohesion.withColumn("warnings", F.array_join(F.array_compact(found), ","))
