import random

import pytest

from treeline.operators import metrics
from treeline.sources.trees import assignment, binary_op, block, call, conditional, early_return, exception_handling, flatten, lambda_, literal, loop, match_arm, native, nodes_of, pattern_match, variable


def one(x=1):
    return literal("integer", x)


def test_flatten_numbers_nodes_in_pre_order():
    rows = flatten("d", block(assignment(variable("x"), one()), early_return(variable("x"))))
    assert [r["type"] for r in rows] == ["block", "assignment", "variable", "literal", "early_return", "variable"]
    assert [r["size"] for r in rows] == [6, 3, 1, 1, 2, 1]
    assert [r["parent_pre"] for r in rows] == [-1, 0, 1, 1, 0, 4]


def test_known_complexities(spark):
    cond = lambda inner: conditional(variable("c"), inner, None)
    logic = binary_op("boolean", "and", variable("a"), variable("b"))
    trees = {
        "literal": one(), "one": cond(one()), "two": cond(cond(one())), "three": cond(cond(cond(one()))), "logic": conditional(logic, one(), one()),
        "loops": block(loop("while", variable("c"), one()), loop("for_each", variable("x"), variable("xs"), one())),
        "match": pattern_match(variable("x"), match_arm(one(), one()), match_arm(None, one())), "tries": exception_handling(call("f"), [match_arm(None, call("g"))]),
    }
    n = nodes_of(spark, trees)
    got = {r.doc_id: r.cyclomatic for r in metrics.cyclomatic(n).collect()}
    assert got == {"literal": 1, "one": 2, "two": 3, "three": 4, "logic": 3, "loops": 3, "match": 3, "tries": 2}
    got = {r.doc_id: r.cognitive for r in metrics.cognitive(n).collect()}
    assert (got["literal"], got["one"], got["two"], got["three"]) == (0, 1, 3, 6)
    got = {r.doc_id: r.max_nesting for r in metrics.nesting(n).collect()}
    assert (got["literal"], got["one"], got["two"], got["loops"]) == (0, 1, 2, 1)


def test_halstead_tells_a_string_from_a_variable(spark):
    tree = block(assignment(variable("x"), literal("string", "x")), binary_op("arithmetic", "+", variable("x"), one()))
    r = metrics.halstead(nodes_of(spark, {"d": tree})).first()
    assert (r.n1, r.n2, r.total1, r.total2) == (2, 3, 2, 4)
    assert r.volume == pytest.approx(6 * 2.321928, abs=1e-4)


def test_validation_and_conformance(spark):
    n = nodes_of(spark, {"core": one(), "native": block(native("python", "with")), "extended": lambda_(["x"], variable("x")), "bad": literal("integer", "abc")})
    assert {r.doc_id: r.level for r in metrics.validation(n).collect()} == {"core": "core", "native": "native", "extended": "extended", "bad": "core"}
    assert {r.doc_id: r.conforms for r in metrics.conformance(n).collect()} == {"core": True, "native": True, "extended": True, "bad": False}


def test_thresholds_and_summary(spark):
    big = block(*[conditional(variable("c"), one()) for _ in range(25)])
    rows = {r.doc_id: r for r in metrics.complexity(nodes_of(spark, {"small": one(), "big": big})).collect()}
    assert (rows["small"].warnings, rows["small"].summary) == ("", "low")
    assert rows["big"].warnings == "cyclomatic error,cognitive warning" and rows["big"].summary == "high"


def grow(rng, depth=0):
    if depth > 4 or rng.random() < 0.3:
        return one() if rng.random() < 0.5 else variable("v")
    kind = rng.choice(["block", "conditional", "loop", "binary_op", "call"])
    sub = lambda: grow(rng, depth + 1)
    if kind == "block":
        return block(*[sub() for _ in range(rng.randint(0, 3))])
    if kind == "conditional":
        return conditional(sub(), sub(), sub() if rng.random() < 0.5 else None)
    if kind == "loop":
        return loop("while", sub(), sub())
    if kind == "binary_op":
        return binary_op("boolean", rng.choice(["and", "or"]), sub(), sub())
    return call("f", sub())


def walk(n, nest=0):
    """(cyclomatic points, cognitive points, greatest nesting) by recursion."""
    points = int(n.type in ("conditional", "loop", "binary_op"))
    cost = 1 + nest if n.type in ("conditional", "loop") else points
    deepest = nest
    for c in n.children:
        p, k, d = walk(c, nest + ((n.type, c.role) in {("conditional", "then"), ("conditional", "else"), ("loop", "body")}))
        points, cost, deepest = points + p, cost + k, max(deepest, d)
    return points, cost, deepest


def test_random_trees_against_recursion(spark):
    rng = random.Random(5)
    trees = {f"t{i}": grow(rng) for i in range(60)}
    got = {r.doc_id: (r.cyclomatic, r.cognitive, r.max_nesting) for r in metrics.complexity(nodes_of(spark, trees)).collect()}
    assert got == {k: (1 + p, c, d) for k, t in trees.items() for p, c, d in [walk(t)]}
