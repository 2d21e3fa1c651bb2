"""Registered queries over programs with known findings; their SQL is the list of the findings, once for each nation."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline import runner, supplementals
from treeline.functions import semantic
from treeline.operators import business, classes, clones, documents, metrics, results
from treeline.queries import KNOWN
from treeline.sources.cases import BUSINESS, answers, name, over_nations, sources_over_nations, tree
from treeline.sources.unparse import translate, valid_source

C = F.col
#: Sources that are written as they were read.
WRITTEN = {
    "loop": "for x in xs:\n    f(x)\nelse:\n    g()", "class": "@a.b(1)\nclass K(B):\n    def f(self, x):\n        return x", "call": "f(x, y=1)", "method": "a().b(c)", "try": "try:\n    f()\nexcept E:\n    g()\nelse:\n    h()\nfinally:\n    i()",
    "async": "async def f(x):\n    await g(x)", "values": "x = [1, 'a', None, True]", "if": "if a:\n    f()\nelse:\n    g()",
}
#: Rules that can't hold on uniform nodes, and that compat="reference" therefore leaves silent.
SILENT = ("missing_error_handling", "missing_handle_async", "missing_telemetry_in_auth_plug", "missing_throttle", "silent_error_case", "unmanaged_task")


def case() -> Column:
    return F.element_at(F.split("doc_id", "/"), -1)


def over_cases(name: str, cases: dict[str, Any], plan: Callable[[DataFrame], DataFrame], rows: list[tuple], columns: str) -> None:
    """Registers a plan over the cases of one set; rows begin with the case's name."""
    KNOWN[name] = (lambda spark, sf_dir: plan(over_nations(spark, sf_dir, {name: cases})), answers([(f"{name}/{r[0]}", *r[1:]) for r in rows], columns))


def _own_rule(issues: DataFrame) -> DataFrame:
    """Of each program's issues those of the rule that it is a case of."""
    return issues.filter(C("analyzer") == F.element_at(F.split("doc_id", "/"), 2)).select("doc_id", "analyzer").distinct()


def _fires(silent: tuple[str, ...] = ()) -> list[tuple]:
    return [(f"{rule}/{c}", rule) for rule, cases in BUSINESS.items() if rule not in silent for c in cases if c.startswith("fires")]


KNOWN["business_cases"] = (lambda spark, sf_dir: _own_rule(business.analyze(over_nations(spark, sf_dir, BUSINESS))), answers(_fires(), "document, analyzer"))
KNOWN["business_cases_reference"] = (
    lambda spark, sf_dir: _own_rule(business.analyze(over_nations(spark, sf_dir, {r: BUSINESS[r] for r in SILENT + ("hardcoded_value",)}), compat="reference")),
    answers([x for x in _fires(SILENT) if x[1] == "hardcoded_value"], "document, analyzer"),
)
_GRADES = {
    "missing_authentication": {"fires_definition": "error,warning", "fires_container": "warning"},  # the class of the definition is found, too
    "path_traversal": {"fires_call": "error", "fires_concat": "error", "fires_path": "warning"},
    "ssrf_vulnerability": {"fires_call": "error", "fires_builder": "warning", "fires_concat": "error"},
    "unrestricted_file_upload": {"fires_call": "warning", "fires_definition": "error"},
    "xss_vulnerability": {"fires_call": "error", "fires_plain": "warning", "fires_assignment": "error", "fires_tuple": "error"},
}
KNOWN["business_severities"] = (
    lambda spark, sf_dir: business.analyze(over_nations(spark, sf_dir, {r: {c: BUSINESS[r][c] for c in g} for r, g in _GRADES.items()}), tuple(_GRADES))
    .filter(C("analyzer") == F.element_at(F.split("doc_id", "/"), 2)).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("severity")), ",").alias("severities")),
    answers([(f"{r}/{c}", x) for r, g in _GRADES.items() for c, x in g.items()], "document, severities"),
)

UNUSED = {"top": "x = 1\ny = 2\nf(y)", "lambda": "f(lambda a, b: a)", "scope": "def f(x):\n    y = x\n    return 1\nprint(y)", "underscore": "_x = 1\nf()", "loop": "for i in xs:\n    f()", "read": "x = 1\nf(lambda a: x + a)"}
over_cases("unused_scopes", UNUSED, documents.unused_variables, [("top", "x"), ("lambda", "b"), ("scope", "y"), ("loop", "i")], "document, variable")
over_cases("unused_scopes_reference", UNUSED, lambda n: documents.unused_variables(n, compat="reference"), [("top", "x")], "document, variable")

_DEEP = "\n".join("    " * i + "if a:" for i in range(6)) + "\n" + "    " * 6 + "f()"
over_cases(
    "all_smells",
    {"magic": "x = y * 42", "condition": "if a and b and c and d:\n    f()", "worse": "while a or (b or (c or (d or (e or f)))):\n    g()", "deep": _DEEP, "long": "\n".join(["f()"] * 80), "function": "def g():\n" + "\n".join(["    f()"] * 101), "fine": "if a and b:\n    f(x + 1)"},
    documents.all_smells,
    [("magic", "magic_number", "low"), ("condition", "complex_conditional", "medium"), ("worse", "complex_conditional", "high"), ("deep", "deep_nesting", "medium"), ("long", "long_function", "medium"), ("function", "long_function", "high")],
    "document, smell, severity",
)
over_cases("complex_conditionals", {"three": "if a and (b or (c and d)):\n    f()", "two": "if a and b or c:\n    f()", "not": "if not (a and not b):\n    f()"}, lambda n: documents.complex_conditionals(n).select("doc_id", "operators", "severity"), [("three", 3, "medium"), ("not", 3, "medium")], "document, operators, severity")
over_cases(
    "simplify_conditional", {"same": "x = True if a else False", "negated": "x = False if a else True", "and": "x = b if a else False", "or": "x = True if a else b", "neither": "x = b if a else c"},
    lambda n: documents.simplify_conditional(n).select("doc_id", "simplification"), [("same", "use_condition"), ("negated", "negate_condition"), ("and", "use_and"), ("or", "use_or")], "document, simplification",
)
over_cases(
    "taint",
    {"direct": "eval(input())", "deep": "os.system('ls ' + input())", "block": "with a as b:\n    exec(input())", "keyword": "subprocess.run(args=input())", "loop_else": "for x in y:\n    f()\nelse:\n    eval(raw_input())", "match": "match x:\n    case 1:\n        eval(input())", "decorator": "@eval(input())\ndef f():\n    g()", "clean": "eval(x)", "other": "print(input())"},
    lambda n: documents.taint(n).select("doc_id", "sink", "source", "risk"),
    [("direct", "eval", "input", "critical"), ("deep", "os.system", "input", "critical"), ("block", "exec", "input", "critical"), ("keyword", "subprocess.run", "input", "high"), ("loop_else", "eval", "raw_input", "critical"), ("match", "eval", "input", "critical"), ("decorator", "eval", "input", "critical")],
    "document, sink, source, risk",
)
over_cases(
    "security_calls_all",
    {"pickle": "pickle.loads(x)", "yaml": "yaml.load(x)", "shell": "subprocess.Popen(x)", "shelve": "with shelve.open(p) as s:\n    f(s)", "weak": "hashlib.md5(x)", "secret": "x = 'password = \"abc\"'", "http": "x = 'http://a.example'", "fine": "json.loads(x)"},
    lambda n: documents.security(n).select("doc_id", "category", "severity", "cwe"),
    [("pickle", "unsafe_deserialization", "critical", 502), ("yaml", "unsafe_deserialization", "high", 502), ("shell", "injection", "high", 78), ("shelve", "unsafe_deserialization", "high", 502), ("weak", "weak_cryptography", "medium", 327), ("secret", "hardcoded_secret", "high", 798), ("http", "insecure_protocol", "medium", 319)],
    "document, category, severity, cwe",
)
PURITY = {"pure": "x + 1", "io": "print(x)", "writes": "y = 1", "unknown": "mystery(x)", "raises": "try:\n    f()\nexcept E:\n    g()"}
KNOWN["purity_merged"] = (
    lambda spark, sf_dir: results.merged_purity(documents.purity(over_nations(spark, sf_dir, {"all": PURITY, "some": {k: PURITY[k] for k in ("pure", "io", "writes")}, "none": {"pure": PURITY["pure"]}})).withColumn("doc_id", F.substring_index("doc_id", "/", 2)), "doc_id"),
    answers([("all", False, "exception,io,mutation", 3, 5, "low"), ("some", False, "io,mutation", 0, 3, "medium"), ("none", True, "", 0, 1, "high")], "document, pure, effects, unknown_calls, documents, confidence"),
)

_ACCOUNT = "class A:\n    def __init__(self):\n        self.a = 1\n    def get_a(self):\n        return self.a\n    def work(self, x):\n        self.a = x + 1\n        return x\n    def _hide(self):\n        return 1"
_GETTERS = "class G:\n" + "\n".join(f"    def get_{c}(self):\n        return self.{c}" for c in "abcdef")
CLASSES = {"account": _ACCOUNT, "leak": "class B:\n    def both(self):\n        return [self.a, self.b]", "data": _GETTERS, "plain": "class D:\n    def f(self):\n        return 1", "wide": "class E:\n    def f(self, a, b, c, d, e, g):\n        return a"}
over_cases(
    "encapsulation_cases", CLASSES, classes.encapsulation,
    [("account", "A", 4, 3, 1, 1, 2, 80, "good"), ("leak", "B", 1, 1, 0, 0, 1, 95, "excellent"), ("data", "G", 6, 6, 0, 6, 1, 95, "excellent"), ("plain", "D", 1, 1, 0, 0, 0, 100, "excellent"), ("wide", "E", 1, 1, 0, 0, 0, 100, "excellent")],
    "document, container, methods, public_methods, private_methods, accessors, violations, score, assessment",
)
over_cases(
    "encapsulation_violations", CLASSES, lambda n: classes.encapsulation_violations(n).select("doc_id", "violation", "severity", "method"),
    [("account", "missing_accessor", "high", "__init__"), ("account", "missing_accessor", "high", "work"), ("leak", "leaky_abstraction", "medium", "both"), ("data", "excessive_accessors", "medium", None)], "document, violation, severity, method",
)
over_cases(
    "state_management_cases", CLASSES, classes.state_management,
    [("account", "A", 1, 2, "a", "", "", "a", "controlled_mutation", "good"), ("leak", "B", 2, 0, "", "a,b", "a,b", "", "immutable_state", "excellent"), ("data", "G", 6, 0, "", "a,b,c,d,e,f", "a,b,c,d,e,f", "", "immutable_state", "excellent"), ("plain", "D", 0, 0, "", "", "", "", "stateless", "excellent"), ("wide", "E", 0, 0, "", "", "", "", "stateless", "excellent")],
    "document, container, state_count, mutation_count, initialized, uninitialized, read_only, mutable, pattern, assessment",
)
over_cases(
    "api_surface_cases", CLASSES, lambda n: classes.api_surface(n).select("doc_id", "public_methods", "max_params", "assessment", "warnings"),
    [("account", 3, 2, "excellent", ""), ("leak", 1, 1, "excellent", ""), ("data", 6, 1, "excellent", ""), ("plain", 1, 1, "excellent", ""), ("wide", 1, 7, "poor", "many_parameters_on_average,too_many_parameters")], "document, public_methods, max_params, assessment, warnings",
)
over_cases("cohesion_warnings", CLASSES, lambda n: classes.cohesion_warnings(documents.cohesion(n)).select("doc_id", "lcom", "warnings"), [("account", 1, ""), ("leak", 0, "few_methods"), ("data", 5, "low_tcc"), ("plain", 0, "few_methods"), ("wide", 0, "few_methods")], "document, lcom, warnings")

over_cases(
    "runner_issues", {"three": "eval(input())\nx = y * 42", "one": "x = y * 42", "dead": "def f(x):\n    return x\n    g(x)", "none": "f(x)"}, lambda n: runner.run(n, max_issues=1).select("doc_id", "analyzer", "category", "severity"),
    [("three", "improper_input_validation", "security", "warning"), ("one", "magic_numbers", "readability", "info")], "document, analyzer, category, severity",
)
over_cases(
    "runner_halted", {"three": "eval(input())\nx = y * 42", "one": "x = y * 42"}, lambda n: runner.run(n, ("security", "taint", "magic_numbers"), halt_on_error=True).select("doc_id", "analyzer"), [("three", "security"), ("one", "magic_numbers")], "document, analyzer",
)

over_cases(
    "conformance_cases",
    {
        "good": tree("binary_op", name("a"), name("b"), category="arithmetic", operator="+"), "one_child": tree("binary_op", name("a"), category="arithmetic", operator="+"), "category": tree("unary_op", name("a"), category="odd", operator="-"),
        "number": tree("literal", value="1x", subtype="integer"), "unknown": tree("teapot"), "nested": tree("block", tree("loop", name("a"), loop_type="while"), tree("function_call")), "null": tree("literal", subtype="null"),
    },
    metrics.conformance,
    [("good", True, 0), ("one_child", False, 1), ("category", False, 1), ("number", False, 1), ("unknown", False, 1), ("nested", False, 2), ("null", True, 0)],
    "document, conforms, n_bad",
)
KNOWN["valid_sources"] = (
    lambda spark, sf_dir: valid_source(sources_over_nations(spark, sf_dir, {"good": "x = 1", "open": "x = (", "words": "not python at all", "empty": "", "indent": " x = 1"})),
    answers([("good", True), ("open", False), ("words", False), ("empty", True), ("indent", False)], "document, valid"),
)
KNOWN["written_sources"] = (
    lambda spark, sf_dir: translate(sources_over_nations(spark, sf_dir, WRITTEN), "python"),
    answers([(k, v + "\n") for k, v in WRITTEN.items()], "document, source"),
)

BODIES = {"one": "def f(x):\n    if x:\n        g(x)", "two": "def f(x):\n    if x:\n        g(x)\n    h(x)", "nested": "class A:\n    def f(x):\n        if x and y:\n            g(x)", "plain": "if x:\n    g(x)\nh(x)"}
over_cases("cyclomatic_bodies", BODIES, metrics.cyclomatic, [("one", 2), ("two", 2), ("nested", 3), ("plain", 2)], "document, cyclomatic")
over_cases("cyclomatic_reference", BODIES, lambda n: metrics.cyclomatic(n, "reference"), [("one", 2), ("two", 1), ("nested", 3), ("plain", 2)], "document, cyclomatic")
over_cases("halstead_reference", BODIES, lambda n: metrics.halstead(n, "reference").select("doc_id", "n1", "n2"), [("one", 4, 3), ("two", 2, 1), ("nested", 6, 5), ("plain", 2, 3)], "document, n1, n2")
over_cases(
    "halstead_unwrapped", {"def": "def f(x):\n    return x", "class": "class A:\n    x = 1", "plain": "f(x)"}, lambda n: metrics.halstead(metrics.unwrapped(n)).select("doc_id", "n1", "n2"), [("def", 1, 1), ("class", 1, 2), ("plain", 1, 2)], "document, n1, n2",
)

over_cases(
    "supplementals_missing", {"teapot": tree("block", tree("teapot"), name("x")), "given": tree("block", tree("actor_call", name("x")))},
    lambda n: supplementals.default().missing(n, "python"), [("teapot", "teapot")], "document, construct",
)
over_cases(
    "supplementals_transformed", {"ask": tree("block", tree("actor_call", name("x"), name("y"))), "gather": tree("gather", name("x")), "plain": "f(x)"},
    lambda n: supplementals.default().transform_nodes(n, "python").filter("type IN ('function_call', 'actor_call', 'gather')").select("doc_id", "name", C("n_children").cast("long").alias("n")), [("ask", "x.ask", 1), ("gather", "asyncio.gather", 1), ("plain", "f", 1)], "document, name, n",
)


def _with_base(n: DataFrame) -> DataFrame:
    """Each nation's base program against the nation's others."""
    pairs = clones.pairs_of(n, case() == "base").filter(F.substring_index("left", "/", 1) == F.substring_index("right", "/", 1))
    found = results.described_clones(clones.detect(pairs, n))
    return found.select(C("right").alias("doc_id"), "clone_type", "duplicate", "description")


over_cases(
    "clone_pairs", {"base": "x = 1\nprint(x)", "exact": "x = 1\nprint(x)", "renamed": "y = 2\nshow(y)", "near": "x = 1\nprint(x)\nprint(x)", "other": "if a:\n    f()"}, _with_base,
    [("exact", "type_i", True, results.CLONE_TYPES["type_i"]), ("renamed", "type_ii", True, results.CLONE_TYPES["type_ii"]), ("near", "type_iii", True, results.CLONE_TYPES["type_iii"]), ("other", None, False, None)], "document, clone_type, duplicate, description",
)
over_cases(
    "python_constructs",
    {"with": "with open(p) as g:\n    f(g)", "decorated": "@route('/x')\ndef f(a, *b, c=1, **d):\n    return a", "async": "async def f(x):\n    await g(x)", "generator": "def f(x):\n    yield x", "keyword": "f(a, b=c)", "method": "a().b(c)", "class": "class K(B):\n    def f(self):\n        return 1"},
    lambda n: n.filter("role IN ('decorator', 'keyword', 'receiver', 'base', 'param') OR kind IN ('with', 'async', 'generator')").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.coalesce("role", "kind"))), ",").alias("found"), F.count(F.lit(1)).alias("n")),
    [("with", "with", 1), ("decorated", "decorator,param,param,param,param", 5), ("async", "async,param", 2), ("generator", "generator,param", 2), ("keyword", "keyword", 1), ("method", "receiver", 1), ("class", "base,param", 2)],
    "document, found, n",
)
over_cases(
    "semantic_domains",
    {
        "db": "session.query(User)", "http": "httpx.get('/a')", "auth": "login_user(user)", "cache": "redis.get('k')", "queue": "celery.send_task('t')", "file": "os.remove('p')", "external_api": "stripe.Charge.create(x)", "regex": "User.objects.create(x)",
        "receiver": "Mailer.delay(x)", "none": "mystery(x)",
    },
    lambda n: semantic.enrich(n).filter("op_domain IS NOT NULL").select("doc_id", "op_domain", "op_operation", "op_framework", "op_entity"),
    [
        ("db", "db", "query", "sqlalchemy", "User"), ("http", "http", "get", "httpx", "/a"), ("auth", "auth", "login", "flask_login", None), ("cache", "cache", "get", "redis_py", "k"), ("queue", "queue", "enqueue", "celery", "t"), ("file", "file", "delete", "python_os", "p"),
        ("external_api", "external_api", "charge", "stripe", None), ("regex", "db", "create", "django", "User.objects"), ("receiver", "queue", "enqueue", "celery", "Mailer"),
    ],
    "document, op_domain, op_operation, op_framework, op_entity",
)
KNOWN["semantic_db_compat"] = (
    lambda spark, sf_dir: semantic.enrich(over_nations(spark, sf_dir, {"compat": {"db": "session.query(User)", "http": "httpx.get('/a')"}}), ("db",)).filter("op_domain IS NOT NULL").select("doc_id", "op_domain"),
    answers([("compat/db", "db")], "document, op_domain"),
)
