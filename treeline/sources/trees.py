"""Trees into rows: builders for hand-made trees, a Python source adapter and a JSON adapter, all flattened in the worker."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.model import COLUMNS, SCHEMA

#: The languages of file extensions.
EXTENSIONS = {".py": "python", ".pyw": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".ex": "elixir", ".exs": "elixir", ".rb": "ruby", ".go": "go", ".rs": "rust", ".erl": "erlang", ".hrl": "erlang", ".hs": "haskell", ".lhs": "haskell"}


@dataclass
class Node:
    type: str
    children: list[Node] = field(default_factory=list)
    value: Any = None
    meta: dict[str, Any] = field(default_factory=dict)
    role: str | None = None
    in_meta: bool = False


def literal(subtype: str, value: Any, **meta: Any) -> Node:
    return Node("literal", value=value, meta={"subtype": subtype, **meta})


def variable(name: str, **meta: Any) -> Node:
    return Node("variable", value=name, meta=meta)


def binary_op(category: str, operator: str, left: Node, right: Node) -> Node:
    return Node("binary_op", [left, right], meta={"category": category, "operator": operator})


def unary_op(category: str, operator: str, operand: Node) -> Node:
    return Node("unary_op", [operand], meta={"category": category, "operator": operator})


def call(name: str, *args: Node, **meta: Any) -> Node:
    return Node("function_call", list(args), meta={"name": name, **meta})


def block(*statements: Node) -> Node:
    return Node("block", list(statements))


def conditional(cond: Node, then: Node, otherwise: Node | None = None) -> Node:
    return Node("conditional", _with_roles([cond, then, otherwise], ("cond", "then", "else")))


def assignment(target: Node, value: Node) -> Node:
    return Node("assignment", _with_roles([target, value], ("target", "value")))


def early_return(value: Node | None = None, kind: str = "return") -> Node:
    return Node("early_return", [value] if value else [], meta={"kind": kind})


def loop(loop_type: str, *parts: Node) -> Node:
    return Node("loop", _with_roles(parts, ("cond", "body") if loop_type == "while" else ("iter", "coll", "body")), meta={"loop_type": loop_type})


def lambda_(params: list[str], *body: Node) -> Node:
    return Node("lambda", [*(_param(p) for p in params), *_with_roles(body, ("body",) * len(body))])


def collection_op(op_type: str, function: Node, *parts: Node) -> Node:
    return Node("collection_op", _with_roles([function, *parts], ("function", "coll", "init")), meta={"op_type": op_type})


def container(container_type: str, name: str, *body: Node) -> Node:
    return Node("container", _with_roles(body, ("body",) * len(body)), meta={"container_type": container_type, "name": name})


def function_def(name: str, params: list[str], *body: Node, visibility: str = "public") -> Node:
    return Node("function_def", [*(_param(p) for p in params), *_with_roles(body, ("body",) * len(body))], meta={"name": name, "visibility": visibility})


def attribute_access(attribute: str, receiver: Node) -> Node:
    return Node("attribute_access", [receiver], meta={"name": attribute})


def exception_handling(body: Node, handlers: list[Node], final: Node | None = None) -> Node:
    return Node("exception_handling", [*_with_roles([body], ("try",)), *_with_roles(handlers, ("handler",) * len(handlers)), *_with_roles([final], ("finally",))])


def pattern_match(scrutinee: Node, *arms: Node) -> Node:
    return Node("pattern_match", [*_with_roles([scrutinee], ("scrutinee",)), *_with_roles(arms, ("arm",) * len(arms))])


def match_arm(pattern: Node | None, *body: Node) -> Node:
    if pattern:
        pattern.role, pattern.in_meta = "pattern", True
    return Node("match_arm", [*([pattern] if pattern else []), *_with_roles(body, ("body",) * len(body))])


def native(language: str, hint: str) -> Node:
    return Node("language_specific", meta={"language": language, "kind": hint})


def _param(name: str) -> Node:
    return Node("param", value=name, role="param", in_meta=True)


def _with_roles(nodes: Any, roles: Any) -> list[Node]:
    out = []
    for n, r in zip(nodes, roles, strict=False):
        if n is not None:
            n.role = r
            out.append(n)
    return out


#: (parent type, role of the child) whose subtree is one level deeper for nesting.
DEEPER = {("conditional", "then"), ("conditional", "else"), ("loop", "body"), ("exception_handling", "try"), ("exception_handling", "handler"), ("match_arm", "body"), ("lambda", "body")}


def text_of(value: Any) -> str | None:
    return None if value is None else ("true" if value else "false") if isinstance(value, bool) else str(value)


SIZE, PARENT = COLUMNS.index("size"), COLUMNS.index("parent_pre")


def rows_of(doc_id: str, root: Node, language: str | None = None) -> list[list[Any]]:
    """The rows of one tree in pre-order, in order of COLUMNS; without recursion, so that deep trees don't matter."""
    rows: list[list[Any]] = []
    todo: list[tuple[Node, int, int, int, int]] = [(root, -1, 0, 0, 0)]
    while todo:
        n, parent, ix, depth, nest = todo.pop()
        m = n.meta.get
        at, c = len(rows), n.children
        rows.append(
            [doc_id, at, parent, ix, depth, 1, len(c), n.role, n.type, m("subtype"), text_of(n.value), m("category"), m("operator"), m("name"), m("op_type"), m("loop_type"), m("container_type"), m("visibility"), m("kind"), m("language", language), m("line"), nest, n.in_meta]
        )
        for i in range(len(c) - 1, -1, -1):
            x = c[i]
            todo.append((x, at, i, depth + 1, nest + 1 if (n.type, x.role) in DEEPER else nest))
    for r in reversed(rows):
        if r[PARENT] >= 0:
            rows[r[PARENT]][SIZE] += r[SIZE]
    return rows


def flatten(doc_id: str, root: Node, language: str | None = None) -> list[dict[str, Any]]:
    return [dict(zip(COLUMNS, r, strict=True)) for r in rows_of(doc_id, root, language)]


def nodes_of(spark: SparkSession, trees: dict[str, Node], language: str = "python") -> DataFrame:
    """The node relation of hand-made trees."""
    rows = [tuple(r) for k, t in trees.items() for r in rows_of(k, t, language)]
    return spark.createDataFrame(rows, SCHEMA)


# Python source

ARITHMETIC = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.FloorDiv: "//", ast.Mod: "%", ast.Pow: "**", ast.MatMult: "@", ast.LShift: "<<", ast.RShift: ">>", ast.BitOr: "|", ast.BitXor: "^", ast.BitAnd: "&"}
COMPARISON = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Is: "is", ast.IsNot: "is not", ast.In: "in", ast.NotIn: "not in"}
UNARY = {ast.Not: ("boolean", "not"), ast.USub: ("arithmetic", "-"), ast.UAdd: ("arithmetic", "+"), ast.Invert: ("arithmetic", "~")}


def own_nodes(n: ast.AST) -> Iterator[ast.AST]:
    """What a function's body holds, without the bodies of functions in it."""
    todo = list(ast.iter_child_nodes(n))
    while todo:
        x = todo.pop()
        yield x
        if not isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.ClassDef)):
            todo += ast.iter_child_nodes(x)


class PythonReader:
    """Python's own syntax tree as nodes. Plain, decorated and asynchronous functions and classes become structural nodes."""

    def body(self, statements: list[ast.stmt]) -> Node:
        found = [self.read(s) for s in statements]
        return found[0] if len(found) == 1 else block(*found)

    def read(self, n: ast.AST) -> Node:
        out = getattr(self, f"read_{type(n).__name__}", self.other)(n)
        if getattr(n, "lineno", None):
            out.meta.setdefault("line", n.lineno)
        return out

    def other(self, n: ast.AST) -> Node:
        """A construct without a type of its own keeps what it holds: its expressions, and statements of a body as one block."""
        out = native("python", type(n).__name__.lower())
        out.children = list(self.held(n))
        return out

    def held(self, n: ast.AST) -> Iterator[Node]:
        for name, part in ast.iter_fields(n):
            parts = part if isinstance(part, list) else [part]
            if parts and all(isinstance(x, ast.stmt) for x in parts):
                yield from _with_roles([self.body(parts)], (name,))
                continue
            for x in parts:
                if isinstance(x, (ast.expr, ast.pattern)):
                    yield self.read(x)
                elif isinstance(x, ast.AST) and not isinstance(x, (ast.expr_context, ast.operator, ast.cmpop, ast.boolop, ast.unaryop)):
                    yield from self.held(x)

    def read_JoinedStr(self, n: ast.JoinedStr) -> Node:
        """An interpolated string: its literal parts and its expressions joined by an operator."""
        parts = [self.read(v.value if isinstance(v, ast.FormattedValue) else v) for v in n.values]
        out = parts[0] if parts else literal("string", "")
        for x in parts[1:]:
            out = binary_op("arithmetic", "+", out, x)
        return out

    def read_Module(self, n: ast.Module) -> Node:
        return self.body(n.body)

    def read_Expr(self, n: ast.Expr) -> Node:
        return self.read(n.value)

    def read_Constant(self, n: ast.Constant) -> Node:
        kind = {bool: "boolean", int: "integer", float: "float", str: "string", type(None): "null"}.get(type(n.value), "symbol")
        return literal(kind, n.value)

    def read_Name(self, n: ast.Name) -> Node:
        return variable(n.id)

    def read_BinOp(self, n: ast.BinOp) -> Node:
        return binary_op("arithmetic", ARITHMETIC[type(n.op)], self.read(n.left), self.read(n.right))

    def read_Compare(self, n: ast.Compare) -> Node:
        if len(n.ops) > 1:
            out = native("python", "chained_comparison")
            out.children = list(self.held(n))
            return out
        return binary_op("comparison", COMPARISON[type(n.ops[0])], self.read(n.left), self.read(n.comparators[0]))

    def read_BoolOp(self, n: ast.BoolOp) -> Node:
        op = "and" if isinstance(n.op, ast.And) else "or"
        out = self.read(n.values[0])
        for v in n.values[1:]:
            out = binary_op("boolean", op, out, self.read(v))
        return out

    def read_UnaryOp(self, n: ast.UnaryOp) -> Node:
        return unary_op(*UNARY[type(n.op)], self.read(n.operand))

    def dotted(self, n: ast.AST) -> str | None:
        if isinstance(n, ast.Name):
            return n.id
        if isinstance(n, ast.Attribute):
            left = self.dotted(n.value)
            return f"{left}.{n.attr}" if left else None
        return None

    def read_Call(self, n: ast.Call) -> Node:
        """Keywords are pairs after the arguments; a method of something other than a name has that as its first child."""
        args = [self.read(a) for a in n.args]
        for k in n.keywords:
            args += _with_roles([Node("pair", [literal("symbol", k.arg), self.read(k.value)]) if k.arg else self.read(k.value)], ("keyword",))
        name = self.dotted(n.func)
        if name:
            return call(name, *args)
        if isinstance(n.func, ast.Attribute):
            return call(n.func.attr, *_with_roles([self.read(n.func.value)], ("receiver",)), *args)
        out = native("python", "call")
        out.children = [self.read(n.func), *args]
        return out

    def read_Attribute(self, n: ast.Attribute) -> Node:
        return attribute_access(n.attr, self.read(n.value))

    def read_If(self, n: ast.If) -> Node:
        return conditional(self.read(n.test), self.body(n.body), self.body(n.orelse) if n.orelse else None)

    def read_IfExp(self, n: ast.IfExp) -> Node:
        return conditional(self.read(n.test), self.read(n.body), self.read(n.orelse))

    def read_Return(self, n: ast.Return) -> Node:
        return early_return(self.read(n.value) if n.value else None)

    def read_Break(self, n: ast.Break) -> Node:
        return early_return(kind="break")

    def read_Continue(self, n: ast.Continue) -> Node:
        return early_return(kind="continue")

    def read_Assign(self, n: ast.Assign) -> Node:
        out = self.read(n.value)
        for t in reversed(n.targets):
            out = assignment(self.read(t), out)
        return out

    def read_AugAssign(self, n: ast.AugAssign) -> Node:
        return assignment(self.read(n.target), binary_op("arithmetic", ARITHMETIC[type(n.op)], self.read(n.target), self.read(n.value)))

    def read_AnnAssign(self, n: ast.AnnAssign) -> Node:
        if n.value:
            return assignment(self.read(n.target), self.read(n.value))
        out = native("python", "type_annotation")
        out.children = [self.read(n.target)]
        return out

    def read_List(self, n: ast.List) -> Node:
        return Node("list", [self.read(x) for x in n.elts])

    def read_Tuple(self, n: ast.Tuple) -> Node:
        return Node("tuple", [self.read(x) for x in n.elts])

    def read_Dict(self, n: ast.Dict) -> Node:
        return Node("map", [Node("pair", [self.read(k), self.read(v)]) for k, v in zip(n.keys, n.values, strict=True) if k])

    def read_While(self, n: ast.While) -> Node:
        return self.with_else(loop("while", self.read(n.test), self.body(n.body)), n.orelse)

    def read_For(self, n: ast.For) -> Node:
        return self.with_else(loop("for_each", self.read(n.target), self.read(n.iter), self.body(n.body)), n.orelse)

    def read_AsyncFor(self, n: ast.AsyncFor) -> Node:
        return Node("async_operation", [self.read_For(n)], meta={"op_type": "async"})

    def with_else(self, out: Node, statements: list[ast.stmt]) -> Node:
        """What runs after a loop or a try without a break or an exception."""
        if statements:
            out.children += _with_roles([self.body(statements)], ("else",))
        return out

    def params(self, a: ast.arguments) -> list[str]:
        return [*(x.arg for x in (*a.posonlyargs, *a.args)), *(f"*{a.vararg.arg}" for _ in "x" if a.vararg), *(x.arg for x in a.kwonlyargs), *(f"**{a.kwarg.arg}" for _ in "x" if a.kwarg)]

    def read_Lambda(self, n: ast.Lambda) -> Node:
        return lambda_(self.params(n.args), self.read(n.body))

    def read_ListComp(self, n: ast.ListComp) -> Node:
        g = n.generators[0]
        if len(n.generators) > 1 or len(g.ifs) > 1 or not isinstance(g.target, ast.Name):
            return self.other(n)
        source = self.read(g.iter)
        if g.ifs:
            source = collection_op("filter", lambda_([g.target.id], self.read(g.ifs[0])), source)
            if isinstance(n.elt, ast.Name) and n.elt.id == g.target.id:
                return source
        return collection_op("map", lambda_([g.target.id], self.read(n.elt)), source)

    def read_Try(self, n: ast.Try) -> Node:
        arms = []
        for h in n.handlers:
            kind = variable(self.dotted(h.type) or "_") if h.type else None
            arms.append(match_arm(kind, self.body(h.body)))
            if kind:
                kind.role = "exception_type"  # a read, not a binding
        return self.with_else(exception_handling(self.body(n.body), arms, self.body(n.finalbody) if n.finalbody else None), n.orelse)

    def decorated(self, out: Node, n: ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef, more: list[ast.expr]) -> Node:
        """Decorators come first, and the bases of a class after them."""
        out.children = [*_with_roles([self.read(d) for d in n.decorator_list], ["decorator"] * len(n.decorator_list)), *_with_roles([self.read(b) for b in more], ["base"] * len(more)), *out.children]
        return out

    def read_FunctionDef(self, n: ast.FunctionDef | ast.AsyncFunctionDef) -> Node:
        private = n.name.startswith("_") and not n.name.startswith("__")
        out = function_def(n.name, self.params(n.args), *(self.read(s) for s in n.body), visibility="private" if private else "public")
        if isinstance(n, ast.AsyncFunctionDef):
            out.meta["kind"] = "async"
        elif any(isinstance(x, (ast.Yield, ast.YieldFrom)) for x in own_nodes(n)):
            out.meta["kind"] = "generator"
        return self.decorated(out, n, [])

    def read_AsyncFunctionDef(self, n: ast.AsyncFunctionDef) -> Node:
        return self.read_FunctionDef(n)

    def read_ClassDef(self, n: ast.ClassDef) -> Node:
        return self.decorated(container("class", n.name, *(self.read(s) for s in n.body)), n, n.bases)

    def read_Await(self, n: ast.Await) -> Node:
        return Node("async_operation", [self.read(n.value)], meta={"op_type": "await"})


def from_json(data: Any) -> Node:
    """A node from {type, meta, children or value}; a shape that isn't one becomes language_specific."""
    if not isinstance(data, dict) or "type" not in data:
        return native("json", "unknown")
    return Node(str(data["type"]), [from_json(c) for c in data.get("children", [])], data.get("value"), dict(data.get("meta", {})), data.get("role"))


READERS = {"python": lambda source: PythonReader().read(ast.parse(source)), "json": lambda source: from_json(json.loads(source))}


def read_sources(sources: DataFrame, language: str = "python") -> DataFrame:
    """The node relation of (doc_id, source). A source that can't be parsed gives one language_specific row with kind parse_error."""

    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SCHEMA.split(", ")])

    def batch(rows: list[list[Any]]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = READERS[language]
        for b in batches:
            rows: list[list[Any]] = []
            for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    tree = read(s or "")
                except (SyntaxError, ValueError, RecursionError, KeyError, TypeError, IndexError):
                    tree = native(language, "parse_error")
                rows += rows_of(k, tree, language)
                if len(rows) > 50_000:
                    yield batch(rows)
                    rows = []
            yield batch(rows)

    return sources.select(F.col("doc_id").cast("string").alias("doc_id"), "source").mapInArrow(run, SCHEMA)


def quote(code: str, language: str = "python") -> Node:
    """The tree of one source text."""
    if language not in READERS:
        raise ValueError(f"no reader for {language}")
    return READERS[language](code)


def supported_languages(spark: SparkSession) -> DataFrame:
    """(language, extensions, readable): the languages that a file extension names, and whether their source or native trees can be read."""
    from treeline.sources import native as _  # noqa: F401  registers the readers of native trees

    ends: dict[str, list[str]] = {}
    for ext, language in EXTENSIONS.items():
        ends.setdefault(language, []).append(ext)
    return spark.createDataFrame([(k, sorted(v), k in READERS) for k, v in sorted(ends.items())], "language string, extensions array<string>, readable boolean")


def from_file(spark: SparkSession, path: str, language: str | None = None) -> DataFrame:
    """The node relation of one file or of all known files below a directory, each read by the language that its extension names."""
    files = read_directory(spark, path)
    if language is not None:
        files = files.withColumn("language", F.lit(language))
    parts = [read_sources(files.filter(F.col("language") == k), k) for k in sorted(READERS) if k in set(EXTENSIONS.values()) or k == language]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def language_of(path: Column) -> Column:
    """The language that a path's extension names, else null."""
    out = F.lit(None).cast("string")
    for ext, language in EXTENSIONS.items():
        out = F.when(F.lower(path).endswith(ext), language).otherwise(out)
    return out


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, language, source) of every known source file below a directory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("doc_id"), language_of(F.col("path")).alias("language"), F.col("content").cast("string").alias("source")).filter("language IS NOT NULL")
