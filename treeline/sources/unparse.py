"""Nodes back to source: Python text from the node relation, one document at a time."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.model import COLUMNS, SCHEMA
from treeline.sources.trees import Node, read_sources, rows_of


def tree_of(rows: list[dict[str, Any]]) -> Node:
    """The tree of one document's rows in order of place."""
    made: dict[int, Node] = {}
    for r in rows:
        meta = {k: r[k] for k in ("subtype", "category", "operator", "name", "op_type", "loop_type", "container_type", "visibility", "kind", "line") if r.get(k) is not None}
        n = made[r["pre"]] = Node(r["type"], [], r["value"], meta, r["role"], bool(r["in_meta"]))
        if r["parent_pre"] >= 0:
            made[r["parent_pre"]].children.append(n)
    return made[0]


class Python:
    """Source text of a tree; a construct that has no Python form becomes a comment and a pass."""

    indent = "    "

    def block(self, n: Node, depth: int) -> list[str]:
        lines = [x for c in ([*n.children] if n.type == "block" else [n]) for x in self.statement(c, depth)]
        return lines or [self.indent * depth + "pass"]

    def statement(self, n: Node, depth: int) -> list[str]:
        pad, part = self.indent * depth, {c.role: c for c in n.children}
        if n.type == "block":
            return self.block(n, depth)
        if n.type == "conditional":
            out = [f"{pad}if {self.expr(part['cond'])}:", *self.block(part["then"], depth + 1)]
            return out + ([f"{pad}else:", *self.block(part["else"], depth + 1)] if "else" in part else [])
        if n.type == "loop":
            head = f"while {self.expr(part['cond'])}" if n.meta.get("loop_type") == "while" else f"for {self.expr(part['iter'])} in {self.expr(part['coll'])}"
            return [f"{pad}{head}:", *self.block(part["body"], depth + 1), *self.otherwise(part, depth)]
        if n.type in ("assignment", "inline_match"):
            target, value = n.children
            return [f"{pad}{self.expr(target)} = {self.expr(value)}"]
        if n.type == "augmented_assignment":
            return [f"{pad}{self.expr(n.children[0])} {n.meta['operator']}= {self.expr(n.children[1])}"]
        if n.type == "early_return":
            return [f"{pad}{n.meta.get('kind', 'return')}" + (f" {self.expr(n.children[0])}" if n.children else "")]
        if n.type == "function_def":
            params = ", ".join(str(c.value) for c in n.children if c.type == "param")
            start = "async def" if n.meta.get("kind") == "async" else "def"
            body = Node("block", [c for c in n.children if c.type != "param" and c.role != "decorator"])
            return [*self.decorators(n, pad), f"{pad}{start} {n.meta['name']}({params}):", *self.block(body, depth + 1)]
        if n.type == "container":
            bases = ", ".join(self.expr(c) for c in n.children if c.role == "base")
            body = Node("block", [c for c in n.children if c.role not in ("decorator", "base")])
            return [*self.decorators(n, pad), f"{pad}class {n.meta['name']}{f'({bases})' if bases else ''}:", *self.block(body, depth + 1)]
        if n.type == "exception_handling":
            out = [f"{pad}try:", *self.block(part["try"], depth + 1)]
            for h in (c for c in n.children if c.role == "handler"):
                kind = next((c for c in h.children if c.role in ("pattern", "exception_type")), None)
                out += [f"{pad}except{' ' + self.expr(kind) if kind else ''}:", *self.block(Node("block", [c for c in h.children if c.role not in ("pattern", "exception_type")]), depth + 1)]
            return out + self.otherwise(part, depth) + ([f"{pad}finally:", *self.block(part["finally"], depth + 1)] if "finally" in part else [])
        if n.type == "language_specific":
            return [f"{pad}pass  # {n.meta.get('kind', 'native')}"]
        return [pad + self.expr(n)]

    def otherwise(self, part: dict[str, Node], depth: int) -> list[str]:
        return [f"{self.indent * depth}else:", *self.block(part["else"], depth + 1)] if "else" in part else []

    def decorators(self, n: Node, pad: str) -> list[str]:
        return [f"{pad}@{self.expr(c)}" for c in n.children if c.role == "decorator"]

    def argument(self, n: Node) -> str:
        return f"{n.children[0].value}={self.expr(n.children[1])}" if n.type == "pair" and n.role == "keyword" else self.expr(n)

    def expr(self, n: Node) -> str:
        c = n.children
        if n.type == "literal":
            kind, v = n.meta.get("subtype"), n.value
            return {"string": repr(v), "symbol": repr(v), "boolean": "True" if v in ("true", True) else "False", "null": "None"}.get(kind, str(v))
        if n.type in ("variable", "param"):
            return str(n.value)
        if n.type == "binary_op":
            return f"({self.expr(c[0])} {n.meta['operator']} {self.expr(c[1])})"
        if n.type == "unary_op":
            op = n.meta["operator"]
            return f"({op}{' ' if op.isalpha() else ''}{self.expr(c[0])})"
        if n.type == "function_call":
            name, args = n.meta["name"].replace(":", ".").replace("!", "").replace("?", ""), [x for x in c if x.role != "receiver"]
            on = "".join(f"{self.expr(x)}." for x in c if x.role == "receiver")
            return f"{on}{name}({', '.join(map(self.argument, args))})"
        if n.type == "attribute_access":
            return f"{self.expr(c[0])}.{n.meta['name']}"
        if n.type in ("list", "tuple"):
            inner = ", ".join(map(self.expr, c))
            return f"[{inner}]" if n.type == "list" else f"({inner}{',' if len(c) == 1 else ''})"
        if n.type == "map":
            return "{" + ", ".join(f"{self.expr(p.children[0])}: {self.expr(p.children[1])}" for p in c) + "}"
        if n.type == "conditional":
            part = {x.role: x for x in c}
            return f"({self.expr(part['then'])} if {self.expr(part['cond'])} else {self.expr(part['else']) if 'else' in part else 'None'})"
        if n.type == "lambda":
            body = [x for x in c if x.type != "param"]
            return f"(lambda {', '.join(str(x.value) for x in c if x.type == 'param')}: {self.expr(body[0]) if len(body) == 1 else 'None'})"
        if n.type == "collection_op":
            return f"{n.meta['op_type']}({', '.join(map(self.expr, c))})"
        if n.type == "async_operation":
            return f"await {self.expr(c[0])}"
        return "None"

    def source(self, n: Node) -> str:
        return "\n".join(self.block(n, 0)) + "\n"


WRITERS = {"python": Python}


def to_source(nodes: DataFrame, language: str = "python") -> DataFrame:
    """(doc_id, source): the text of each tree; the rows of a document are gathered, which its own size bounds."""
    fields = ["pre", "parent_pre", "type", "value", "role", "in_meta", "subtype", "category", "operator", "name", "op_type", "loop_type", "container_type", "visibility", "kind"]
    trees = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = WRITERS[language]()
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "source": [w.source(tree_of([r.asDict() if hasattr(r, "asDict") else dict(r) for r in rows])) for rows in f["rows"]]})

    return trees.mapInPandas(run, "doc_id string, source string")


def rebuilt(nodes: DataFrame, change: Callable[[Node], Node], language: str) -> DataFrame:
    """The relation with each document's tree put through a function, in the workers."""
    trees = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pre", *[c for c in COLUMNS if c not in ("doc_id", "pre")]))).alias("rows"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for k, t in zip(f["doc_id"], f["rows"], strict=True) for r in rows_of(k, change(tree_of([x.asDict() if hasattr(x, "asDict") else dict(x) for x in t])), language)]
            yield pd.DataFrame(rows, columns=list(COLUMNS)).astype({"line": "Int32"})

    return trees.mapInPandas(run, SCHEMA)


def unquote(tree: Node, language: str = "python") -> str:
    """The source text of one tree."""
    if language not in WRITERS:
        raise ValueError(f"no writer for {language}")
    return WRITERS[language]().source(tree)


def to_files(nodes: DataFrame, path: str, language: str = "python") -> None:
    """Writes each document's source as a row of text files below a path, with its id as a folder."""
    to_source(nodes, language).select("doc_id", F.col("source").alias("value")).write.partitionBy("doc_id").text(path)


def translate(sources: DataFrame, language: str, target: str = "python") -> DataFrame:
    """Source in one language to source in another, by way of nodes."""
    return to_source(read_sources(sources, language), target)


def round_trip(sources: DataFrame, language: str = "python") -> DataFrame:
    """(doc_id, stable): writing and reading a source again leaves its text as it is."""
    once = translate(sources, language)
    twice = translate(once, "python").withColumnRenamed("source", "again")
    return once.join(twice, "doc_id").select("doc_id", (F.col("source") == F.col("again")).alias("stable"))


def valid_source(sources: DataFrame) -> DataFrame:
    """(doc_id, valid): whether Python can parse the text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ok(s: Any) -> bool:
            try:
                ast.parse(s or "")
            except (SyntaxError, ValueError):
                return False
            return True

        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "valid": [ok(s) for s in f["source"]]})

    return sources.select(F.col("doc_id").cast("string").alias("doc_id"), "source").mapInPandas(run, "doc_id string, valid boolean")
