"""Control-flow graphs: nodes and edges of each document, what the entry reaches, cycles, and exports.

A graph never leaves its document: the document's rows are gathered in one value, which its own size bounds, and workers go through batches of
documents. Trees are walked with a stack of their own, so that deep ones don't matter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Generator
from itertools import accumulate
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.operators.metrics import is_a
from treeline.plans.axes import beside_parent

C = F.col
Ends = list[tuple[int, str | None]]
Row = dict[str, Any]


def edges_of(rows: list[Row]) -> list[tuple[int, int, str | None, bool, bool]]:
    """(source, target, label, reached, back) of one document's rows; node 0 is the entry, the largest the exit. A return does not end the flow."""
    below: dict[int, list[Row]] = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["parent_pre"], r["ix"])):
        below[r["parent_pre"]].append(r)
    edges: list[tuple[int, int, str | None]] = []
    made = 1

    def statement(r: Row, ends: Ends) -> Generator[tuple[Row, Ends], Ends, Ends]:
        """Adds a statement after the open ends; gives the ends that it leaves open. What it yields is done before it goes on."""
        nonlocal made
        if r["type"] in ("block", "container", "function_def"):
            for c in below[r["pre"]]:
                if not c["in_meta"]:
                    ends = yield c, ends
            return ends
        at, made = made, made + 1
        edges.extend((e, at, label) for e, label in ends)
        if r["type"] == "conditional":
            out: Ends = []
            parts = {c["role"]: c for c in below[r["pre"]]}
            for role in ("then", "else"):
                if role in parts:
                    out += yield parts[role], [(at, role)]
                else:
                    out.append((at, role))
            return out
        if r["type"] == "loop":
            for c in below[r["pre"]]:
                if c["role"] == "body":
                    last = yield c, [(at, None)]
                    edges.extend((e, at, "loop_back") for e, _ in last)
            return [(at, "exit")]
        return [(at, None)]

    stack = [statement(below[-1][0], [(0, None)])]
    given: Ends | None = None
    while stack:
        try:
            stack.append(statement(*stack[-1].send(given)))
            given = None
        except StopIteration as done:
            given = done.value
            stack.pop()
    edges.extend((e, made, label) for e, label in given or [])
    after: dict[int, list[int]] = defaultdict(list)
    for a, b, _ in edges:
        after[a].append(b)
    reached, todo = {0}, [0]
    while todo:
        for b in after[todo.pop()]:
            if b not in reached:
                reached.add(b)
                todo.append(b)
    return [(a, b, label, a in reached, label == "loop_back") for a, b, label in edges]


def _edges(trees: pa.Array) -> pa.Array:
    """The edges of each list of rows, as lists."""
    found = [edges_of(rows) for rows in trees.to_pylist()]
    offsets = pa.array(accumulate(map(len, found), initial=0), pa.int32())
    flat = [pa.array([e[i] for edges in found for e in edges], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()))]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(flat, names=["source", "target", "label", "reached", "back"]))


def graphs(nodes: DataFrame) -> DataFrame:
    """(doc_id, graph): one row a document with the list of its edges.

    Only what stands in a block, a branch or a body is handed to the workers.
    """
    placed = beside_parent(nodes.select("doc_id", "pre", "parent_pre", "ix", "type", "role", "in_meta"), is_a("block", "container", "function_def", "conditional", "loop"), None, "type")
    walked = (C("parent_pre") == -1) | C("p_type").isin("block", "container", "function_def") | (C("has_parent") & C("role").isin("then", "else", "body"))
    rows = F.collect_list(F.struct("pre", "parent_pre", "ix", "type", "role", "in_meta")).alias("rows")
    edges = F.arrow_udf(_edges, "array<struct<source:int,target:int,label:string,reached:boolean,back:boolean>>")
    return placed.filter(walked).groupBy("doc_id").agg(rows).select("doc_id", edges("rows").alias("graph"))


def control_flow(nodes: DataFrame) -> DataFrame:
    """(doc_id, source, target, label, reached, back): the edges of each document's graph; node 0 is the entry, the largest the exit."""
    return graphs(nodes).select("doc_id", F.explode("graph").alias("e")).select("doc_id", "e.*")


def gathered(edges: DataFrame) -> DataFrame:
    """(doc_id, graph) of edges; what graphs() gives is gathered already and moves no edge."""
    return edges if "graph" in edges.columns else edges.groupBy("doc_id").agg(F.collect_list(F.struct("source", "target", "label", "reached", "back")).alias("graph"))


def graph_summary(edges: DataFrame) -> DataFrame:
    found = gathered(edges).filter(F.size("graph") > 0)
    return found.select("doc_id", F.size("graph").cast("long").alias("edges"), (F.array_max("graph.target") + 1).cast("long").alias("nodes"), F.exists("graph", lambda e: e["back"]).alias("cyclic"), F.forall("graph", lambda e: e["reached"]).alias("all_reached"))


def as_dot(edges: DataFrame) -> DataFrame:
    line = lambda e: F.concat(F.lit("  "), e["source"], F.lit(" -> "), e["target"], F.when(e["label"].isNotNull(), F.concat(F.lit(' [label="'), e["label"], F.lit('"]'))).otherwise(""))
    lines = F.array_join(F.array_sort(F.transform("graph", line)), "\n")
    return gathered(edges).filter(F.size("graph") > 0).select("doc_id", F.concat(F.lit("digraph {\n"), lines, F.lit("\n}")).alias("dot"))


def as_json(edges: DataFrame) -> DataFrame:
    return edges.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("source", "target", "label")))).alias("json"))


def as_d3(edges: DataFrame) -> DataFrame:
    """(doc_id, json): nodes with an id and links between them, as force layouts take them."""
    nodes = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("source", "target")))))
    g = edges.groupBy("doc_id").agg(F.transform(nodes, lambda x: F.struct(x.alias("id"))).alias("nodes"), F.array_sort(F.collect_list(F.struct("source", "target", "label"))).alias("links"))
    return g.select("doc_id", F.to_json(F.struct("nodes", "links")).alias("json"))
