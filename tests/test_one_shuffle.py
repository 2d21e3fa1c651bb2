"""Analyzers that look beside or above a node read it within the document's rows: nodes move once at most, and no side that grows with them is broadcast."""

import pytest
from pyspark.sql import functions as F

from treeline import queries
from treeline.operators import business, documents
from treeline.plans import primitives
from treeline.sources.trees import assignment, block, call, conditional, early_return, lambda_, literal, loop, nodes_of, variable

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["magic_numbers", "unreachable_code", "updated_children", "unused_variables", "parts_unused_variables", "control_flow_graph", "control_flow_dot"])
def test_nodes_move_once(spark, name):
    text = plan(queries.queries()[name](spark, SF))
    assert text.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" not in text and "SortMergeJoin" not in text


@pytest.mark.parametrize("name", ["runner_summary", "dead_code_results"])
def test_no_side_is_broadcast(spark, name):
    assert "BroadcastHashJoin" not in plan(queries.queries()[name](spark, SF))


def test_rules_broadcast_nothing_that_grows(spark, tmp_path):
    nodes_of(spark, {"d": block(call("eval", variable("params")))}).write.parquet(str(tmp_path / "nodes"))
    text = plan(business.analyze(spark.read.parquet(str(tmp_path / "nodes"))))
    broadcasts = [x for x in text.split("\n") if "BroadcastHashJoin" in x]
    assert all("r_" in x or "op_" in x or "language" in x for x in broadcasts), broadcasts


def test_dead_code_beside_and_below(spark):
    inner = block(early_return(), conditional(literal("boolean", True), call("f"), call("g")), call("h"))
    tree = block(conditional(literal("integer", 0), inner), early_return(), early_return(), conditional(variable("x"), block(call("a"), call("b"))))
    n = nodes_of(spark, {"d": tree, "plain": block(call("a"), call("b"))})
    rows = {r.pre: r.type for r in n.filter("doc_id = 'd'").collect()}
    found = sorted((rows[r.pre], r.finding) for r in documents.dead_code(n).collect() if r.doc_id == "d")
    late = "unreachable_after_return"
    # The inner conditional is both always true and unreachable.
    assert found == [("conditional", "always_false"), ("conditional", "always_true"), ("conditional", late), ("conditional", late), ("early_return", late), ("function_call", late)]
    assert documents.dead_code(n.filter("doc_id = 'plain'")).count() == 0


def test_unused_in_scopes(spark):
    tree = block(
        assignment(variable("a"), literal("integer", 1)), assignment(variable("b"), literal("integer", 1)), lambda_(["b", "c"], call("f", variable("a"))),
        loop("while", variable("b"), block(assignment(variable("z"), literal("integer", 2)))), call("g", variable("z")),
    )
    n = nodes_of(spark, {"d": tree})
    assert {r.variable for r in documents.unused_variables(n, ignore_underscore=False).collect()} == {"b", "c", "z"}
    assert documents.unused_variables(n, compat="reference").count() == 0


def test_children_of_children_go(spark):
    n = nodes_of(spark, {"d": block(call("f", call("g", variable("x"))), conditional(variable("c"), block(call("h"))))})
    kept = primitives.update_children(n, "parent_pre = -1", F.col("type") == "conditional")
    assert sorted(r.type for r in kept.collect()) == ["block", "block", "conditional", "function_call", "variable"] and kept.columns == n.columns
