"""Supplementals: constructs that a language lacks, given by a library; a registry, a check of documents and a matrix."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.model import CORE, EXTENDED, NATIVE, STRUCTURAL
from treeline.sources.trees import Node, call


class Conflict(ValueError):
    """Two supplementals claim one construct of a language."""


class Incompatible(ValueError):
    """A supplemental's transform gives something that is no node."""


class Unsupported(LookupError):
    """No supplemental is known for a language at all."""


class Missing(LookupError):
    """No supplemental gives a construct that a document needs."""


@dataclass(frozen=True)
class Supplemental:
    name: str
    language: str
    constructs: tuple[str, ...]
    transform: Callable[[Node], Node] = lambda n: n
    requires: tuple[str, ...] = field(default=())
    description: str = ""


class Supplementals:
    def __init__(self, *known: Supplemental):
        self.by: dict[tuple[str, str], Supplemental] = {}
        for s in known:
            self.register(s)

    def register(self, s: Supplemental) -> None:
        taken = [c for c in s.constructs if (s.language, c) in self.by]
        if taken:
            raise Conflict(f"{s.name}: {', '.join(taken)} of {s.language} are taken")
        self.by |= {(s.language, c): s for c in s.constructs}

    def transform(self, n: Node, language: str) -> Node:
        found = self.by.get((language, n.type))
        if found is None:
            raise (Missing if any(lang == language for lang, _ in self.by) else Unsupported)(f"{n.type} of {language}")
        out = found.transform(n)
        if not isinstance(out, Node):
            raise Incompatible(f"{found.name} gives {type(out).__name__} for {n.type}")
        return out

    def available(self, construct: str, language: str) -> bool:
        return (language, construct) in self.by

    def transformed(self, n: Node, language: str) -> Node:
        """The whole tree with every construct that a supplemental gives in place of it."""
        out = self.transform(n, language) if self.available(n.type, language) else n
        out.children = [self.transformed(c, language) for c in out.children]
        return out

    def transform_nodes(self, nodes: DataFrame, language: str) -> DataFrame:
        """The relation with the constructs replaced: documents that hold one are rebuilt in the workers, the others stay as they are."""
        from treeline.sources.unparse import rebuilt

        mine = sorted(c for lang, c in self.by if lang == language)
        held = nodes.filter(F.col("type").isin(*mine)).select("doc_id").distinct()
        return nodes.join(held, "doc_id", "left_anti").unionByName(rebuilt(nodes.join(held, "doc_id", "left_semi"), lambda n: self.transformed(n, language), language))

    def matrix_text(self, spark: SparkSession, markdown: bool = False) -> str:
        """The matrix as text, or as a Markdown table; of the size of the registry."""
        table = self.matrix(spark).orderBy("construct")
        rows = [table.columns, *([x or "-" for x in r] for r in table.collect())]
        if markdown:
            rows.insert(1, ["---"] * len(table.columns))
            return "\n".join("| " + " | ".join(r) + " |" for r in rows)
        width = [max(len(r[i]) for r in rows) for i in range(len(table.columns))]
        return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, width, strict=True)).rstrip() for r in rows)

    def rows(self, spark: SparkSession) -> DataFrame:
        """(language, construct, supplemental); of the size of the registry."""
        return spark.createDataFrame([(lang, c, s.name) for (lang, c), s in self.by.items()], "language string, construct string, supplemental string")

    def matrix(self, spark: SparkSession) -> DataFrame:
        """A row for each construct, a column for each language."""
        return self.rows(spark).groupBy("construct").pivot("language", sorted({lang for lang, _ in self.by})).agg(F.first("supplemental"))

    def missing(self, nodes: DataFrame, language: str) -> DataFrame:
        """(doc_id, construct): what documents need beyond the common node types and no supplemental of the language gives."""
        needed = nodes.filter(~F.col("type").isin(*CORE, *EXTENDED, *STRUCTURAL, *NATIVE)).select("doc_id", F.col("type").alias("construct")).distinct()
        given = self.rows(nodes.sparkSession).filter(F.col("language") == language)
        return needed.join(F.broadcast(given), "construct", "left_anti")


def _actor(n: Node) -> Node:
    on, *args = n.children
    if n.type == "spawn_actor":
        return call(f"{on.value}.start", *args)
    proxy = {"actor_call": "ask", "actor_cast": "tell"}[n.type]
    return call(f"{on.value}.{proxy}", *args)


def _asyncio(n: Node) -> Node:
    if n.type == "gather":
        return call("asyncio.gather", *n.children)
    if n.type == "async_await":
        return Node("async_operation", n.children[:1], meta={"op_type": "await"})
    return call("asyncio.Runner", *n.children)


PYKKA = Supplemental("pykka", "python", ("actor_call", "actor_cast", "spawn_actor"), _actor, ("pykka >= 3.0",), "actors")
ASYNCIO = Supplemental("asyncio", "python", ("async_await", "async_context", "gather"), _asyncio, (), "asynchronous calls")


def default() -> Supplementals:
    return Supplementals(PYKKA, ASYNCIO)
