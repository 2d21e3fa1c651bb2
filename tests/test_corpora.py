"""Derived corpora: the relation of orders is the one that SQL states, and groupings by document move lines once and nodes never."""

import pytest

from treeline import queries
from treeline.operators import documents
from treeline.sources import corpora
from treeline.sources.trees import block, call, conditional, function_def, literal, nodes_of, variable

SF = "/root/testdata/sf0.001"



def stated(spark, lines):
    return spark.sql(f"WITH {corpora.ORDERS} SELECT {corpora._COLS} FROM nodes".replace("FROM lineitem", "FROM {lineitem}"), lineitem=lines)


def test_orders_are_the_nodes_that_sql_states(spark):
    got, want = corpora.corpus(spark, SF, "orders"), stated(spark, spark.read.parquet(f"{SF}/lineitem.parquet"))
    assert got.schema == want.schema
    assert got.count() == want.count() and not got.exceptAll(want).take(1)


def test_orders_with_ties_and_nulls(spark, tmp_path):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").limit(40)
    odd = lines.selectExpr("CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_orderkey % 7 END AS l_orderkey", "l_partkey % 3 AS l_partkey", "l_suppkey", "l_linenumber % 2 AS l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "CASE WHEN l_suppkey % 4 > 0 THEN l_returnflag END AS l_returnflag", "l_linestatus", "l_shipdate")
    odd.union(odd).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got, want = corpora.corpus(spark, str(tmp_path), "orders"), stated(spark, spark.read.parquet(str(tmp_path / "lineitem.parquet")))
    assert got.count() == want.count() and not got.exceptAll(want).take(1)


@pytest.mark.parametrize("name", ["cyclomatic", "cognitive", "max_nesting", "complexity", "conformance_orders", "control_flow_counts", "format_results", "function_metrics", "halstead", "lines_of_code", "metric_selection", "variables"])
def test_nodes_of_orders_are_not_shuffled(spark, name):
    df = queries.queries()[name](spark, SF)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert "lineitem" in df.inputFiles()[0]


@pytest.mark.parametrize("name", ["complexity", "control_flow_counts", "conformance_orders", "function_metrics", "smells"])
def test_plans_without_places_move_three_columns(spark, name):
    """Columns that only decide between equal line numbers are not read where no place is asked for, and no node meets another."""
    text = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_linenumber" in text and "l_partkey" not in text and "SortMergeJoin" not in text


def test_fingerprints_gather_no_tree(spark):
    text = queries.queries()["clone_groups"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in text and "collect_list" not in text


def test_smells_group_documents_once(spark):
    """Both smells of a document come from one grouping, and lines move once without leaning on a reused exchange."""
    df = queries.queries()["smells"](spark, SF)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and text.count("functions=[partial_") == 1
    assert all("lineitem" in x for x in df.inputFiles())


def test_smells_of_one_document_and_of_functions(spark):
    deep = literal("integer", 1)
    for _ in range(9):
        deep = conditional(variable("x"), block(deep))
    plain = block(*[call("f") for _ in range(3)], deep)
    holds = block(*[call("g") for _ in range(9)], function_def("h", [], *[call("f") for _ in range(7)]), function_def("k", [], call("f")))
    n = nodes_of(spark, {"plain": plain, "holds": holds, "fine": block(call("f")), "none": block()})
    got = sorted(tuple(r) for r in documents.smells(n, 4, 4).collect())
    assert got == [("holds", "long_function", "medium"), ("plain", "deep_nesting", "high"), ("plain", "long_function", "critical")]
