"""Semantic enrichment: what kind of operation a call is, from its name."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions import rules as R

READS = ("retrieve", "retrieve_all", "query")
WRITES = ("create", "update", "delete")


LANGUAGES = tuple(dict.fromkeys(r[4] for r in R.SEMANTICS))


def as_regex(pattern: str) -> str:
    """Prefix.* and *.suffix and *middle* as an anchored regular expression; what follows ~ is one already."""
    return pattern[1:] if pattern.startswith("~") else "^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"


def is_open(pattern: str) -> bool:
    return pattern.startswith("~") or "*" in pattern


def qualified(pattern: str) -> bool:
    """*.Repo.get and boto3.*, which name a module."""
    return not pattern.startswith("~") and "." in pattern.strip("*.") or pattern.endswith(".*")


def matcher(found: list[tuple]):
    """A function of a call's name and language that gives the pattern that fits best."""
    exact: dict[str, list[tuple]] = {}
    for r in found:
        if not is_open(r[2]):
            exact.setdefault(r[2], []).append(r)
    opened = [(r, re.compile(as_regex(r[2]))) for r in found if is_open(r[2])]
    named, free = ([x for x in opened if qualified(x[0][2]) == q] for q in (True, False))

    def best(name: str, language: str | None) -> tuple | None:
        own = lambda r: r[4] is None or r[4] == language
        if name in exact:
            return next((r for r in exact[name] if own(r)), exact[name][0])
        for rows in (named, free):
            hits = [r for r, x in rows if (own(r) or language not in LANGUAGES or not r[2].startswith("~")) and x.search(name)]
            if hits:
                return next((r for r in hits if own(r)), hits[0])
        return None

    return best


def _matcher(found: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = matcher(found)
        for b in batches:
            rows = [(n, of, r[0], r[3], r[1], r[5]) for n, of in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if n is not None and (r := best(n, of))]
            names = ["call", "of", "op_domain", "op_operation", "op_framework", "how"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))], names=names)

    return run


def enrich(nodes: DataFrame, domains: tuple[str, ...] | None = None, extra: list[tuple[str, str, str, str]] | None = None) -> DataFrame:
    """Adds op_domain, op_operation, op_framework, op_target (the first argument) and op_entity to the calls that a pattern fits.

    Distinct names of a language, not calls, meet the patterns. Exact names come
    first, then open ones that name a module, then other open ones; of each, the language's own come before those of others, and
    the first by rule order wins. Regular expressions hold for their own language only, or where none of LANGUAGES is known.
    domains leaves only calls whose best pattern over all domains is of these, so that requests.get is never a query.

    op_entity follows the pattern's target: of the first argument a capitalised variable, a string, a symbol or the name of a call; of a
    receiver what stands before the last dot of the call's name.
    """
    found = [*R.SEMANTICS, *((*x, None, "first_arg") for x in extra or [])]
    names = nodes.filter("type = 'function_call'").select(F.col("name").alias("call"), F.col("language").alias("of")).distinct()
    kinds = names.mapInArrow(_matcher(found), "call string, of string, op_domain string, op_operation string, op_framework string, how string")
    kinds = kinds if domains is None else kinds.filter(F.col("op_domain").isin(*domains))
    said = F.coalesce("value", "name")
    entity = F.when((F.col("type") == "variable") & said.rlike("^[A-Z]"), said).when((F.col("type") == "literal") & F.col("subtype").isin("symbol", "string"), F.col("value")).when(F.col("type") == "function_call", F.col("name"))
    first = nodes.filter("ix = 0").select(F.col("doc_id").alias("d"), F.col("parent_pre").alias("u"), said.alias("op_target"), entity.alias("entity"))
    out = nodes.join(kinds, (F.col("type") == "function_call") & (F.col("name") == F.col("call")) & F.col("language").eqNullSafe(F.col("of")), "left").drop("call", "of")
    out = out.join(first, (F.col("doc_id") == F.col("d")) & (F.col("pre") == F.col("u")) & F.col("op_domain").isNotNull(), "left")
    receiver = F.when(F.instr("name", ".") > 0, F.regexp_replace("name", r"\.[^.]*$", ""))
    receiver = F.when(receiver.rlike(r"^[A-Z]|\."), receiver)
    return out.withColumn("op_entity", F.when(F.col("how") == "first_arg", F.col("entity")).when(F.col("how") == "receiver", receiver)).drop("d", "u", "how", "entity")


def reads(operation: Column) -> Column:
    return operation.isin(*READS)


def writes(operation: Column) -> Column:
    return operation.isin(*WRITES)


