import json

import pytest
from pyspark.sql import functions as F

from treeline.operators import clones, metrics
from treeline.plans import primitives
from treeline.sources import native  # noqa: F401  (registers the readers)
from treeline.sources.trees import READERS, Node, assignment, binary_op, block, call, conditional, early_return, flatten, function_def, language_of, literal, nodes_of, read_directory, read_sources, variable
from treeline.sources.unparse import round_trip, to_source, translate, valid_source
from treeline.streaming.files import stream_nodes
from treeline.supplementals import PYKKA, Conflict, Missing, default


def kinds(language, tree):
    return [(r["type"], r["name"] or r["operator"] or r["value"] or r["kind"]) for r in flatten("d", READERS[language](json.dumps(tree)))]


def test_ruby():
    r = lambda t, *c: {"type": t, "children": list(c)}
    assert kinds("ruby", r("send", r("int", 1), "+", r("lvar", "x"))) == [("binary_op", "+"), ("literal", "1"), ("variable", "x")]
    assert kinds("ruby", r("until", r("true"), r("send", None, "puts")))[:2] == [("loop", None), ("unary_op", "not")]
    each = r("block", r("send", r("lvar", "xs"), "inject", r("int", 0)), r("args", r("arg", "a")), r("lvar", "a"))
    assert [k for k, _ in kinds("ruby", each)] == ["collection_op", "lambda", "param", "variable", "variable", "literal"]
    cls = r("class", r("const", None, "A"), None, r("def", "f", r("args"), r("return", r("ivar", "@x"))))
    assert kinds("ruby", cls)[:3] == [("container", "A"), ("function_def", "f"), ("early_return", "return")]
    assert kinds("ruby", r("alias", "a", "b")) == [("language_specific", "alias")]


def test_haskell_erlang_elixir():
    app = {"type": "app", "function": {"type": "app", "function": {"type": "var", "name": "f"}, "argument": {"type": "literal", "value": 1}}, "argument": {"type": "var", "name": "y"}}
    assert kinds("haskell", app) == [("function_call", "f"), ("literal", "1"), ("variable", "y")]
    assert kinds("erlang", ["op", 1, "andalso", ["atom", 1, "true"], ["call", 1, ["remote", 1, ["atom", 1, "io"], ["atom", 1, "format"]], []]]) == [("binary_op", "and"), ("literal", "true"), ("function_call", "io:format")]
    unless = ["unless", [], [["x", [], None], [["do", 1], ["else", 2]]]]
    assert [k for k, _ in kinds("elixir", unless)] == ["conditional", "unary_op", "variable", "literal", "literal"]
    assert kinds("elixir", [[".", [], [["__aliases__", [], ["Repo"]], "get"]], [], [["id", [], None]]]) == [("function_call", "Repo.get"), ("variable", "id")]


def test_source_is_written_back(spark):
    source = "def f(x):\n    if (x > 1):\n        y = (x + 2)\n    else:\n        return g(x)\n    for i in [1, 2]:\n        print(i)\n    return y\n"
    df = spark.createDataFrame([("a", source), ("b", "try:\n    f()\nexcept ValueError:\n    pass\n")], "doc_id string, source string")
    assert {r.doc_id: r.source for r in translate(df, "python").collect()}["a"] == source
    assert all(r.stable for r in round_trip(df).collect())
    made = to_source(nodes_of(spark, {"t": function_def("f", ["x"], conditional(variable("x"), early_return(literal("string", "a'b"))))})).first().source
    assert made == "def f(x):\n    if x:\n        return \"a'b\"\n"
    assert {r.doc_id: r.valid for r in valid_source(spark.createDataFrame([("a", source), ("b", "x = (")], "doc_id string, source string")).collect()} == {"a": True, "b": False}


def test_ruby_to_python(spark):
    tree = {"type": "if", "children": [{"type": "lvar", "children": ["x"]}, {"type": "send", "children": [None, "puts", {"type": "str", "children": ["hi"]}]}, None]}
    assert translate(spark.createDataFrame([("a", json.dumps(tree))], "doc_id string, source string"), "ruby").first().source == "if x:\n    puts('hi')\n"


def test_directories_languages_and_streams(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "b.txt").write_text("no")
    rows = read_directory(spark, str(tmp_path)).collect()
    assert [(r.language, r.source) for r in rows] == [("python", "x = 1\n")]
    assert spark.createDataFrame([("q.HS",)], "p string").select(language_of(F.col("p")).alias("l")).first().l == "haskell"
    q = stream_nodes(spark, str(tmp_path)).writeStream.format("memory").queryName("arrived").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.type for r in spark.table("arrived").collect()) == ["assignment", "literal", "variable"]


def test_primitives(spark):
    n = nodes_of(spark, {"a": block(assignment(variable("x"), literal("integer", 1)), call("f"))})
    assert [r.type for r in primitives.postwalk(n).collect()] == ["variable", "literal", "assignment", "function_call", "block"]
    assert primitives.put_meta(n, F.col("type") == "function_call", name="g").filter("name = 'g'").count() == 1
    assert [r.type for r in primitives.prewalk(primitives.without_children(n, "type = 'assignment'")).collect()] == ["block", "assignment", "function_call"]
    assert primitives.inspect(n).first().variables == "x"
    other = nodes_of(spark, {"a": block(assignment(variable("y"), literal("integer", 1)), call("f"))})
    assert primitives.equivalent(n, n).first().equivalent and not primitives.equivalent(n, other).first().equivalent
    with pytest.raises(KeyError):
        primitives.put_meta(n, F.lit(True), nothing="x")


def test_clone_types(spark):
    base = lambda v, op="+": block(assignment(variable(v), binary_op("arithmetic", op, variable("a"), literal("integer", 1))), early_return(variable(v)))
    n = nodes_of(spark, {"a": base("x"), "b": base("x"), "c": base("y"), "d": base("y", "-"), "e": call("f")})
    pairs = spark.createDataFrame([("a", x) for x in "bcde"], "left string, right string")
    got = {r.right: (r.clone_type, r.similarity) for r in clones.detect(pairs, n).collect()}
    assert got["b"] == ("type_i", 1.0) and got["c"] == ("type_ii", 1.0) and got["d"][0] in ("type_iii", None) and got["d"][1] < 1 and got["e"][0] is None


def test_supplementals(spark):
    s = default()
    assert s.transform(Node("actor_call", [variable("ref"), literal("integer", 1)]), "python").meta["name"] == "ref.ask"
    with pytest.raises(Conflict):
        s.register(PYKKA)
    with pytest.raises(Missing):
        s.transform(variable("x"), "python")
    n = nodes_of(spark, {"a": block(Node("actor_call", [variable("r")]), Node("strange"))})
    assert [(r.doc_id, r.construct) for r in s.missing(n, "python").collect()] == [("a", "strange")]
    assert {r.construct: r.python for r in s.matrix(spark).collect()}["gather"] == "asyncio"
    assert metrics.validation(n).count() == 1


def test_json_nodes(spark):
    tree = {"type": "conditional", "children": [{"type": "variable", "value": "x", "role": "cond"}, {"type": "literal", "value": 1, "meta": {"subtype": "integer"}, "role": "then"}]}
    n = read_sources(spark.createDataFrame([("a", json.dumps(tree)), ("b", "[1")], "doc_id string, source string"), "json")
    assert {r.doc_id: r.cyclomatic for r in metrics.cyclomatic(n).collect()} == {"a": 2, "b": 1}
