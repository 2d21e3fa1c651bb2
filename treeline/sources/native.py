"""Readers of native trees that other parsers have written as JSON.

ruby: {"type", "children"}; haskell: {"type", named fields}; erlang: [tag, line, ...]; elixir: [form, meta, args]. A construct without a
counterpart becomes language_specific with its native name as the kind.
"""

from __future__ import annotations

import json
from typing import Any

from treeline.sources.trees import READERS, Node, assignment, attribute_access, binary_op, block, call, collection_op, conditional, container, early_return, exception_handling, function_def, lambda_, literal, loop, match_arm, native, pattern_match, unary_op, variable

# Operators by category.
ARITHMETIC = frozenset("+ - * / % ** div rem mod ++ <>".split())
COMPARISON = frozenset("== != /= < > <= >= =< === !== =:= =/=".split())
BOOLEAN = {"and": "and", "or": "or", "&&": "and", "||": "or", "andalso": "and", "orelse": "or"}


def operation(op: str, left: Node, right: Node) -> Node:
    if op in BOOLEAN:
        return binary_op("boolean", BOOLEAN[op], left, right)
    if op in ARITHMETIC:
        return binary_op("arithmetic", op, left, right)
    if op in COMPARISON:
        return binary_op("comparison", {"=<": "<=", "/=": "!=", "=:=": "==", "=/=": "!="}.get(op, op), left, right)
    return call(op, left, right)


def scalar(value: Any) -> Node:
    kind = "boolean" if isinstance(value, bool) else "integer" if isinstance(value, int) else "float" if isinstance(value, float) else "null" if value is None else "string"
    return literal(kind, value)


def several(nodes: list[Node]) -> Node:
    return nodes[0] if len(nodes) == 1 else block(*nodes)


class Ruby:
    ITERATORS = frozenset("each map select filter reject flat_map each_with_index each_with_object tap times upto downto find detect sort_by group_by partition take_while drop_while all? any? none? one? count sum min_by max_by reduce inject".split())
    SAME = {"inject": "reduce", "detect": "find"}

    def read(self, n: Any) -> Node:
        if not isinstance(n, dict):
            return scalar(n)
        kind, c = n["type"], n.get("children", [])
        return getattr(self, f"read_{kind}", lambda c: native("ruby", kind))(c)

    def body(self, n: Any) -> Node:
        return block() if n is None else self.read(n)

    def leaf(kind: str):  # noqa: N805
        return lambda self, c: literal(kind, c[0] if c else {"true": True, "false": False}.get(kind))

    read_int, read_float, read_str, read_sym = leaf("integer"), leaf("float"), leaf("string"), leaf("symbol")
    read_true = lambda self, c: literal("boolean", True)
    read_false = lambda self, c: literal("boolean", False)
    read_nil = lambda self, c: literal("null", None)
    read_self = lambda self, c: variable("self")
    read_lvar = read_ivar = read_gvar = read_cvar = lambda self, c: variable(c[0])
    read_array = lambda self, c: Node("list", [self.read(x) for x in c])
    read_hash = lambda self, c: Node("map", [self.read(x) for x in c])
    read_pair = lambda self, c: Node("pair", [self.read(x) for x in c])
    read_begin = read_kwbegin = lambda self, c: several([self.read(x) for x in c])
    read_and = lambda self, c: binary_op("boolean", "and", self.read(c[0]), self.read(c[1]))
    read_or = lambda self, c: binary_op("boolean", "or", self.read(c[0]), self.read(c[1]))
    read_return = lambda self, c: early_return(self.read(c[0]) if c else None)
    read_break = lambda self, c: early_return(kind="break")
    read_next = lambda self, c: early_return(kind="continue")
    read_while = lambda self, c: loop("while", self.read(c[0]), self.body(c[1]))
    read_until = lambda self, c: loop("while", unary_op("boolean", "not", self.read(c[0])), self.body(c[1]))
    read_for = lambda self, c: loop("for_each", self.read(c[0]), self.read(c[1]), self.body(c[2]))

    def read_const(self, c: list) -> Node:
        scope = self.read(c[0]).value if c[0] else None
        return variable(f"{scope}::{c[1]}" if scope else c[1])

    def read_lvasgn(self, c: list) -> Node:
        return assignment(variable(c[0]), self.read(c[1])) if len(c) > 1 else variable(c[0])

    read_ivasgn = read_gvasgn = read_cvasgn = read_lvasgn

    def read_op_asgn(self, c: list) -> Node:
        return Node("augmented_assignment", [self.read(c[0]), self.read(c[2])], meta={"operator": c[1]})

    def read_if(self, c: list) -> Node:
        if c[1] is None:
            return conditional(unary_op("boolean", "not", self.read(c[0])), self.body(c[2]))
        return conditional(self.read(c[0]), self.body(c[1]), self.read(c[2]) if c[2] else None)

    def read_send(self, c: list) -> Node:
        on, name, args = c[0], c[1], [self.read(x) for x in c[2:]]
        if on is not None and len(args) == 1 and (name in ARITHMETIC or name in COMPARISON):
            return operation(name, self.read(on), args[0])
        if name == "!":
            return unary_op("boolean", "not", self.read(on))
        if name in ("-@", "+@"):
            return unary_op("arithmetic", name[0], self.read(on))
        if on is None:
            return call(name, *args)
        left = self.read(on)
        if left.type == "variable":
            return attribute_access(name, left) if left.value == "self" and not args else call(f"{left.value}.{name}", *args)
        return call(name, left, *args)

    def read_block(self, c: list) -> Node:
        sent, params, body = c
        names = [p["children"][0] for p in (params or {}).get("children", []) if isinstance(p, dict) and p.get("children") and isinstance(p["children"][0], str)]
        function = lambda_(names, self.body(body))
        on, name, *args = sent["children"]
        if name in self.ITERATORS and on is not None:
            return collection_op(self.SAME.get(name, name), function, self.read(on), *(self.read(a) for a in args[:1]))
        return call(name, *(self.read(a) for a in args), function)

    def read_def(self, c: list) -> Node:
        names = [p["children"][0] for p in (c[1] or {}).get("children", []) if p.get("children")]
        inner = self.body(c[2])
        return function_def(c[0], names, *(inner.children if inner.type == "block" else [inner]))

    def read_defs(self, c: list) -> Node:
        return self.read_def(c[1:])

    def group(kind: str):  # noqa: N805
        def read(self, c: list) -> Node:
            inner = self.body(c[-1])
            return container(kind, self.read(c[0]).value, *(inner.children if inner.type == "block" else [inner]))

        return read

    read_class, read_module = group("class"), group("module")

    def read_case(self, c: list) -> Node:
        arms = [match_arm(self.read(w["children"][0]), self.body(w["children"][-1])) for w in c[1:] if w and w["type"] == "when"]
        last = c[-1]
        return pattern_match(self.read(c[0]), *arms, *([match_arm(None, self.read(last))] if last and last["type"] != "when" else []))

    def read_rescue(self, c: list) -> Node:
        arms = [match_arm(self.read(r["children"][0]) if r["children"][0] else None, self.body(r["children"][2])) for r in c[1:] if r and r["type"] == "resbody"]
        return exception_handling(self.body(c[0]), arms)


class Haskell:
    def read(self, n: Any) -> Node:
        if not isinstance(n, dict):
            return scalar(n)
        return getattr(self, f"read_{n['type']}", lambda n: native("haskell", n["type"]))(n)

    read_literal = lambda self, n: self.literal(n["value"])
    read_var = read_con = read_var_pat = lambda self, n: variable(n["name"])
    read_lit_pat = lambda self, n: self.read(n["literal"])
    read_wildcard = lambda self, n: variable("_")
    read_infix = lambda self, n: operation(self.name(n["operator"]), self.read(n["left"]), self.read(n["right"]))
    read_if = lambda self, n: conditional(self.read(n["condition"]), self.read(n["then"]), self.read(n["else"]))
    read_list = lambda self, n: Node("list", [self.read(x) for x in n["elements"]])
    read_tuple = lambda self, n: Node("tuple", [self.read(x) for x in n["elements"]])
    read_do = lambda self, n: block(*(self.read(x) for x in n["statements"]))
    read_module = lambda self, n: block(*(self.read(x) for x in n["declarations"]))
    read_let = lambda self, n: block(*(self.read(x) for x in n["bindings"]), self.read(n["body"]))
    read_pat_bind = lambda self, n: assignment(self.read(n["pattern"]), self.read(n["rhs"]))
    read_generator = lambda self, n: assignment(self.read(n["pattern"]), self.read(n["expression"]))
    read_qualifier = lambda self, n: self.read(n["expression"])
    read_lambda = lambda self, n: lambda_([str(self.read(p).value) for p in n["patterns"]], self.read(n["body"]))

    @staticmethod
    def name(x: Any) -> str:
        return x if isinstance(x, str) else str(x.get("name"))

    def literal(self, v: Any) -> Node:
        return scalar(v.get("value")) if isinstance(v, dict) else scalar(v)

    def read_app(self, n: dict) -> Node:
        args = []
        while isinstance(n, dict) and n.get("type") == "app":
            args.append(self.read(n["argument"]))
            n = n["function"]
        head = self.read(n)
        return call(str(head.value), *args[::-1]) if head.type == "variable" else native("haskell", "app")

    def read_case(self, n: dict) -> Node:
        return pattern_match(self.read(n["scrutinee"]), *(match_arm(self.read(a["pattern"]), self.read(a["rhs"] if "rhs" in a else a.get("body"))) for a in n["alternatives"]))

    def read_fun_bind(self, n: dict) -> Node:
        m = n["matches"][0]
        body = self.read(m.get("rhs", m.get("body")))
        params = [str(self.read(p).value) for p in m.get("patterns", [])]
        return assignment(variable(m["name"]), lambda_(params, body) if params else body)


class Erlang:
    def read(self, n: Any) -> Node:
        if not isinstance(n, list) or not n:
            return scalar(n)
        tag = n[0]
        if tag in ("integer", "float", "string"):
            return literal(tag, n[2])
        if tag == "atom":
            return literal("boolean", n[2] == "true") if n[2] in ("true", "false") else literal("null", None) if n[2] in ("undefined", "nil") else literal("symbol", n[2])
        if tag == "var":
            return variable(n[2])
        if tag == "op":
            return operation(n[2], self.read(n[3]), self.read(n[4])) if len(n) > 4 else unary_op("boolean" if n[2] == "not" else "arithmetic", n[2], self.read(n[3]))
        if tag == "call":
            f = n[2]
            name = f"{f[2][2]}:{f[3][2]}" if f[0] == "remote" else str(f[2])
            return call(name, *(self.read(a) for a in n[3]))
        if tag == "match":
            return Node("inline_match", [self.read(n[2]), self.read(n[3])])
        if tag == "tuple":
            return Node("tuple", [self.read(x) for x in n[2]])
        if tag == "cons":
            rest = self.read(n[3])
            return Node("list", [self.read(n[2]), *(rest.children if rest.type == "list" else [rest])])
        if tag == "nil":
            return Node("list")
        if tag == "block":
            return block(*(self.read(x) for x in n[2]))
        if tag in ("case", "if"):
            clauses = n[3] if tag == "case" else n[2]
            arms = [match_arm(self.read(c[2][0]) if c[2] else None, *(self.read(x) for x in c[4])) for c in clauses]
            return pattern_match(self.read(n[2]) if tag == "case" else literal("boolean", True), *arms)
        return native("erlang", str(tag))


class Elixir:
    ENUM = {"Enum.map": "map", "Enum.filter": "filter", "Enum.reduce": "reduce"}

    def read(self, n: Any) -> Node:
        if not isinstance(n, list) or len(n) != 3 or not (isinstance(n[0], (str, list))):
            return Node("list", [self.read(x) for x in n]) if isinstance(n, list) else scalar(n)
        form, meta, args = n
        name = self.dotted(form)
        if args is None:
            return variable(name)
        if name in BOOLEAN or name in ARITHMETIC or name in COMPARISON:
            if len(args) == 2:
                return operation(name, self.read(args[0]), self.read(args[1]))
            return unary_op("arithmetic", name, self.read(args[0]))
        if name in ("not", "!"):
            return unary_op("boolean", "not", self.read(args[0]))
        if name == "=":
            return Node("inline_match", [self.read(args[0]), self.read(args[1])])
        if name == "__block__":
            return several([self.read(a) for a in args])
        if name in ("if", "unless"):
            parts = dict(args[1])
            cond = self.read(args[0])
            return conditional(unary_op("boolean", "not", cond) if name == "unless" else cond, self.read(parts.get("do")), self.read(parts["else"]) if "else" in parts else None)
        if name == "case":
            return pattern_match(self.read(args[0]), *(match_arm(self.read(a[2][0][0]), self.read(a[2][1])) for a in dict(args[1])["do"]))
        if name == "fn":
            return lambda_([str(self.read(p).value) for p in args[0][2][0]], self.read(args[0][2][1]))
        if name == "defmodule":
            inner = self.read(dict(args[1])["do"])
            return container("module", str(self.read(args[0]).value), *(inner.children if inner.type == "block" else [inner]))
        if name in ("def", "defp"):
            inner = self.read(dict(args[1])["do"])
            return function_def(self.dotted(args[0][0]), [str(self.read(p).value) for p in args[0][2] or []], *(inner.children if inner.type == "block" else [inner]), visibility="public" if name == "def" else "private")
        if name == "__aliases__":
            return variable(".".join(map(str, args)))
        if name == "{}":
            return Node("tuple", [self.read(a) for a in args])
        if name in self.ENUM:
            rest = [self.read(a) for a in args]
            return collection_op(self.ENUM[name], rest[-1], *rest[:-1])
        if name in ("|>", "with", "for", "try", "receive", "quote", "unquote"):
            return native("elixir", {"|>": "pipe"}.get(name, name))
        return call(name, *(self.read(a) for a in args))

    def dotted(self, form: Any) -> str:
        if isinstance(form, str):
            return form
        if form[0] == ".":
            left = self.read(form[2][0])
            return ".".join(str(x) for x in (left.value, *form[2][1:]))
        return str(form[0])


READERS |= {k: (lambda source, c=c: c().read(json.loads(source))) for k, c in {"ruby": Ruby, "haskell": Haskell, "erlang": Erlang, "elixir": Elixir}.items()}
