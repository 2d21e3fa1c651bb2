import pytest
from pyspark.sql import functions as F

from treeline import format as fmt
from treeline import runner
from treeline.functions import semantic
from treeline.operators import business, classes, clones, documents, graph, results
from treeline.sources.trees import assignment, attribute_access, binary_op, block, call, collection_op, conditional, container, early_return, exception_handling, function_def, lambda_, literal, loop, match_arm, nodes_of, read_sources, variable


def text(s):
    return literal("string", s)


def findings(df):
    return sorted(tuple(r) for r in df.collect())


def test_dead_code(spark):
    after = block(early_return(variable("x")), call("f"), call("g"))
    always = conditional(literal("boolean", True), call("f"), call("g"))
    n = nodes_of(spark, {"after": after, "always": always, "no_else": conditional(literal("boolean", True), call("f")), "zero": conditional(literal("integer", 0), call("f"))})
    assert findings(documents.dead_code(n).select("doc_id", "finding")) == [("after", "unreachable_after_return"), ("after", "unreachable_after_return"), ("always", "always_true"), ("zero", "always_false")]


def test_unused_variables(spark):
    n = nodes_of(spark, {"d": block(assignment(variable("used"), literal("integer", 1)), assignment(variable("lost"), variable("used")))})
    assert findings(documents.unused_variables(n)) == [("d", "lost")]


def test_purity(spark):
    n = nodes_of(spark, {"pure": literal("integer", 1), "io": call("print"), "unknown": call("mystery"), "writes": assignment(variable("x"), literal("integer", 1)), "db": call("Repo.get")})
    assert {r.doc_id: (r.purity, r.effects) for r in documents.purity(n).collect()} == {"pure": ("pure", ""), "io": ("impure", "io"), "unknown": ("unknown", ""), "writes": ("impure", "mutation"), "db": ("impure", "database")}


def test_security(spark):
    n = nodes_of(spark, {"eval": call("eval"), "secret": text('password = "abc"'), "weak": call("hashlib.md5"), "http": text("http://example.org"), "fine": text("hello")})
    assert findings(documents.security(n).select("doc_id", "category")) == [("eval", "unsafe_deserialization"), ("http", "insecure_protocol"), ("secret", "hardcoded_secret"), ("weak", "weak_cryptography")]


def test_taint_reaches_through_any_depth(spark):
    n = nodes_of(spark, {"bad": call("eval", binary_op("arithmetic", "+", text("x"), call("input"))), "good": call("eval", text("1"))})
    assert [(r.doc_id, r.sink, r.source, r.risk) for r in documents.taint(n).collect()] == [("bad", "eval", "input", "critical")]


def test_magic_numbers_and_complex_conditions(spark):
    deep = binary_op("boolean", "and", variable("a"), binary_op("boolean", "or", variable("b"), binary_op("boolean", "and", variable("c"), variable("d"))))
    n = nodes_of(spark, {"magic": binary_op("arithmetic", "*", variable("x"), literal("integer", 42)), "one": binary_op("arithmetic", "*", variable("x"), literal("integer", 1)), "deep": conditional(deep, call("f"))})
    assert findings(documents.magic_numbers(n).select("doc_id", "value")) == [("magic", "42")]
    assert findings(documents.complex_conditionals(n).select("doc_id", "operators")) == [("deep", 3)]


def method(name, *attributes):
    return function_def(name, ["self"], *[attribute_access(a, variable("self")) for a in attributes])


def test_class_metrics(spark):
    account = container("class", "Account", *[method(m, "balance") for m in ("deposit", "withdraw", "total")])
    apart = container("class", "Apart", method("a", "x"), method("b", "y"), method("c", "x", "z"), method("d", "z"))
    n = nodes_of(spark, {"account": account, "apart": apart})
    got = {r.doc_id: (r.methods, r.pairs, r.lcom, r.tcc, r.lcc) for r in documents.cohesion(n).collect()}
    assert got == {"account": (3, 3, 0, 1.0, 1.0), "apart": (4, 6, 1, round(2 / 6, 6), 0.5)}
    assert {r.doc_id: (r.public_methods, r.max_params, r.assessment) for r in classes.api_surface(n).collect()} == {"account": (3, 1, "excellent"), "apart": (4, 1, "excellent")}
    assert {r.doc_id: (r.pattern, r.state_count) for r in classes.state_management(n).collect()} == {"account": ("immutable_state", 1), "apart": ("immutable_state", 3)}


def test_simplify_conditional(spark):
    t, f = lambda: literal("boolean", True), lambda: literal("boolean", False)
    n = nodes_of(spark, {"same": conditional(variable("c"), t(), f()), "not": conditional(variable("c"), f(), t()), "none": conditional(variable("c"), call("f"), call("g"))})
    assert findings(documents.simplify_conditional(n).select("doc_id", "simplification")) == [("not", "negate_condition"), ("same", "use_condition")]


def test_business_rules(spark):
    trees = {
        "url": text("https://example.org/x"), "local": text("http://localhost:80"), "ip": text("8.8.8.8"), "private": text("192.168.0.1"),
        "callback": conditional(variable("a"), conditional(variable("b"), conditional(variable("c"), call("f")))),
        "plus_one": collection_op("map", lambda_(["x"], call("Repo.get", variable("x"))), variable("xs")),
        "swallowed": exception_handling(call("f"), [match_arm(None, call("noop"))]), "handled": exception_handling(call("f"), [match_arm(None, call("logger.error"))]),
        "sql": binary_op("arithmetic", "+", text("SELECT * FROM t WHERE id = "), variable("x")), "race": block(call("os.path.exists", variable("p")), call("open", variable("p"))),
        "leak": call("print", variable("password")), "script": text("<script>alert(1)</script>"),
    }
    got = {}
    for r in business.analyze(nodes_of(spark, trees)).collect():
        got.setdefault(r.doc_id, set()).add(r.analyzer)
    assert "hardcoded_value" in got["url"] and "hardcoded_value" in got["ip"]
    assert "local" not in got and "private" not in got and "handled" not in got
    assert "callback_hell" in got["callback"] and "n_plus_one_query" in got["plus_one"] and "swallowing_exception" in got["swallowed"]
    assert "sql_injection" in got["sql"] and "toctou" in got["race"] and "sensitive_data_exposure" in got["leak"] and "inline_javascript" in got["script"]


def test_context_rules_stay_on_after_a_definition(spark):
    tree = container("module", "AuthPlug", function_def("call", [], call("requests.get", variable("url"))), call("requests.get", variable("url")))
    rows = business.analyze(nodes_of(spark, {"d": tree}), ("blocking_in_plug",)).collect()
    assert [r.function_name for r in rows] == ["call", "call"]


def test_enrichment_prefers_exact_names(spark):
    n = nodes_of(spark, {"d": block(call("Repo.get", variable("User")), call("My.Repo.get", variable("x")), call("other"))})
    rows = {r.name: (r.op_domain, r.op_operation, r.op_target) for r in semantic.enrich(n).filter("type = 'function_call'").collect()}
    assert rows == {"Repo.get": ("db", "retrieve", "User"), "My.Repo.get": ("db", "retrieve", "x"), "other": (None, None, None)}


def test_clones(spark):
    prog = lambda v, x: block(assignment(variable(v), literal("integer", x)), early_return(variable(v)))
    n = nodes_of(spark, {"a": prog("x", 1), "b": prog("x", 1), "c": prog("y", 2), "d": call("f")})
    assert {r.doc_id: (r.group_id, r.clone_type, r.group_size) for r in clones.clone_groups(n).collect()} == {k: ("a", "type_ii", 3) for k in "abc"}
    pairs = spark.createDataFrame([("a", "c"), ("a", "d")], "left string, right string")
    assert {r.right: r.similarity for r in clones.token_similarity(pairs, n).collect()} == {"c": 1.0, "d": 0.0}


def test_control_flow_graph(spark):
    n = nodes_of(spark, {"line": block(call("f"), call("g")), "loop": block(loop("while", variable("c"), call("f")), call("g"))})
    got = {r.doc_id: (r.nodes, r.edges, r.cyclic) for r in graph.graph_summary(graph.control_flow(n)).collect()}
    assert got == {"line": (4, 3, False), "loop": (5, 5, True)}
    deep = call("f")
    for _ in range(3000):
        deep = conditional(variable("c"), deep)
    summary = graph.graph_summary(graph.control_flow(nodes_of(spark, {"deep": deep}))).first()
    assert summary.all_reached and summary.nodes == 3003
    assert graph.as_d3(graph.control_flow(n)).filter("doc_id = 'line'").first().json.startswith('{"nodes":[{"id":0}')
    assert "digraph" in graph.as_dot(graph.control_flow(n)).first().dot


def test_python_sources(spark):
    rows = [("ok", "class A:\n    def f(self, x):\n        try:\n            return [y for y in x]\n        except ValueError:\n            pass\n"), ("bad", "x = ("), ("empty", ""), ("null", None)]
    n = read_sources(spark.createDataFrame(rows, "doc_id string, source string"))
    kinds = {k: [r.type for r in n.filter(F.col("doc_id") == k).orderBy("pre").collect()] for k, _ in rows}
    assert kinds["ok"][:3] == ["container", "function_def", "param"] and "exception_handling" in kinds["ok"] and "collection_op" in kinds["ok"]
    assert kinds["bad"] == ["language_specific"] and kinds["empty"] == ["block"] == kinds["null"]


def test_runner_registry_and_formats(spark):
    n = nodes_of(spark, {"d": block(call("eval", call("input")), early_return(), call("f"))})
    issues = runner.run(n)
    assert {"security", "taint", "dead_code"} <= {r.analyzer for r in issues.collect()}
    assert runner.run(n, max_issues=1).count() == 1
    total = runner.summary(issues).filter("severity IS NULL AND category IS NULL AND analyzer IS NULL").first().n
    assert total == issues.count()
    r = runner.default_registry()
    r.configure("business_logic", only=("toctou",))
    assert runner.run(n, ("business_logic",), r).count() == 0
    try:
        r.register(r.known["taint"])
    except ValueError:
        pass
    else:
        raise AssertionError("a name was registered twice")
    with pytest.raises(KeyError):
        runner.run(n, ("no_such_analyzer",))
    assert fmt.tree_text(n).first().text.startswith("block\n  function_call eval")
    assert fmt.tree_json(n).first().json.startswith("[{")


def test_runner_goes_on_and_halts(spark):
    n = nodes_of(spark, {"d": block(call("eval", call("input")), early_return(), call("f"), call("exec"))})
    r = runner.default_registry()
    r.register(runner.Analyzer("broken", "x", lambda nodes, config: nodes.select("no_such_column")))
    r.register(runner.Analyzer("gated", "x", lambda nodes, config: nodes, gate=lambda config: False))
    issues, errors = runner.run_with_errors(n, registry=r)
    assert set(errors) == {"broken"} and {"security", "dead_code"} <= {x.analyzer for x in issues.collect()}
    halted = runner.run(n, ("security", "dead_code"), halt_on_error=True).orderBy("pre", "analyzer").collect()
    assert [x.severity for x in halted] == ["error"]
    assert not runner.valid("x") and r.register_all([r.known["taint"], runner.Analyzer("own", "y", lambda n, c: n), runner.Analyzer("off", "y", lambda n, c: n)], ("off",)) == ["taint", "off"]
    spark.conf.set(runner.DISABLED, "security,taint")
    try:
        assert "security" not in {x.analyzer for x in runner.run(n).collect()}
    finally:
        spark.conf.unset(runner.DISABLED)
    text, ms = runner.timed(n, names=("dead_code",))
    assert "dead_code" in text and ms > 0


def test_reports_and_filters(spark):
    n = nodes_of(spark, {"d": block(call("eval"), text("http://a.example")), "e": call("f")})
    found = documents.security(n)
    assert results.at_least(found, "high").count() == 1 and results.of_categories(found, ("insecure_protocol",)).count() == 1
    with pytest.raises(ValueError):
        results.at_least(found, "enormous")
    assert results.at_least(results.with_confidence(found, "medium"), "high", "confidence", results.CONFIDENCE).count() == 0
    rolled = {r.doc_id: (r.has_findings, r.total, r.by_severity, r.summary) for r in results.rolled_up(found, n, "severity").collect()}
    assert rolled == {"d": (True, 2, {"critical": 1, "medium": 1}, "critical: 1, medium: 1"), "e": (False, 0, None, "none")}
    rows = n.groupBy("doc_id").count()
    made = {s: {r.doc_id: r.report for r in results.report(rows, style=s).collect()} for s in ("text", "json", "detailed")}
    assert made["text"]["e"] == "e - count: 1" and made["json"]["e"] == '{"doc_id":"e","count":1}' and made["detailed"]["e"].endswith("count: 1")
    one = n.filter("pre = 1").select(results.issue("a", "c", "error", "m", k="v").alias("i"), results.suggestion("replace", "x").alias("s")).first()
    assert (one.i.analyzer, one.i.metadata, one.s.type) == ("a", {"k": "v"}, "replace")
    with pytest.raises(ValueError):
        results.issue("a", "c", "grave")


def test_languages_files_and_command_line(spark, tmp_path, capsys):
    from treeline import cli
    from treeline.sources.trees import from_file, quote, supported_languages
    from treeline.sources.unparse import to_files, unquote

    (tmp_path / "a.py").write_text("if a:\n    eval(input())\n")
    (tmp_path / "b.py").write_text("x = 1\n")
    (tmp_path / "notes.txt").write_text("no source")
    n = from_file(spark, str(tmp_path))
    assert n.select("doc_id").distinct().count() == 2
    assert {r.language for r in supported_languages(spark).filter("readable").collect()} == {"python", "ruby", "elixir", "erlang", "haskell"}
    assert unquote(quote("x = [1, 2]")) == "x = [1, 2]\n"
    with pytest.raises(ValueError):
        quote("x", "cobol")
    out = str(tmp_path / "out")
    to_files(n.withColumn("doc_id", F.element_at(F.split("doc_id", "/"), -1)), out)
    assert "eval(input())" in "".join(r.value for r in spark.read.text(out).collect())
    for command in (*cli.COMMANDS, "languages"):
        cli.rows(spark, [command, *([str(tmp_path)] if command != "languages" else [])])[0].count()
    cli.main(["security_scan", str(tmp_path / "a.py"), "--format", "json", "--least", "critical"])
    assert "unsafe_deserialization" in capsys.readouterr().out
    assert cli.rows(spark, ["validate_equivalence", str(tmp_path / "a.py"), str(tmp_path / "a.py")])[0].first().equivalent
    assert cli.detect_language(spark, "x/y.rb") == "ruby" and cli.detect_language(spark, "x") is None


def test_supplementals(spark):
    from treeline import supplementals as s
    from treeline.sources.trees import Node

    known = s.default()
    assert known.available("gather", "python") and not known.available("gather", "ruby")
    for language, error in (("python", s.Missing), ("ruby", s.Unsupported)):
        with pytest.raises(error):
            known.transform(Node("teapot"), language)
    known.register(s.Supplemental("odd", "python", ("odd",), lambda n: "text"))
    with pytest.raises(s.Incompatible):
        known.transform(Node("odd"), "python")
    with pytest.raises(s.Conflict):
        known.register(s.Supplemental("again", "python", ("odd",)))
    assert known.matrix_text(spark, markdown=True).startswith("| construct | python |") and "asyncio" in known.matrix_text(spark)
    assert known.transform(Node("async_context", [variable("x")]), "python").children[0].value == "x"
