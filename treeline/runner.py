"""Running analyzers: a registry of named plans, a configuration for each, one union of their issues and a summary.

An analyzer whose plan can't be built, or whose gate or hook fails, is left out and named in the run's errors; the others run on.
"""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeline.operators import business, documents, metrics

ISSUES = ("doc_id", "pre", "analyzer", "category", "severity")
SCHEMA = "doc_id string, pre long, analyzer string, category string, severity string"
#: The session's setting that lists analyzers to leave out, separated by commas.
DISABLED = "treeline.analyzers.disabled"
log = logging.getLogger(__name__)


@dataclass
class Analyzer:
    """A named plan from nodes and its configuration to issues; the gate may leave it out, after may change its issues."""

    name: str
    category: str
    plan: Callable[[DataFrame, dict[str, Any]], DataFrame]
    config: dict[str, Any] = field(default_factory=dict)
    gate: Callable[[dict[str, Any]], bool] = lambda config: True
    after: Callable[[DataFrame], DataFrame] = lambda issues: issues
    description: str = ""
    severity: str = "warning"

    @property
    def info(self) -> dict[str, Any]:
        return {"name": self.name, "category": self.category, "description": self.description or self.name.replace("_", " "), "severity": self.severity, "explanation": self.plan.__doc__ or "", "configurable": bool(self.config)}


def valid(a: Any) -> bool:
    """Whether something can be registered: it has a name, a category and a plan, and hooks that can be called."""
    return isinstance(a, Analyzer) and bool(a.name) and bool(a.category) and all(map(callable, (a.plan, a.gate, a.after)))


class Registry:
    def __init__(self) -> None:
        self.known: dict[str, Analyzer] = {}

    def register(self, a: Analyzer) -> None:
        if not valid(a):
            raise ValueError("not an analyzer")
        if a.name in self.known:
            raise ValueError(f"analyzer {a.name} is registered already")
        self.known[a.name] = a

    def unregister(self, name: str) -> None:
        self.known.pop(name, None)

    def configure(self, name: str, **config: Any) -> None:
        self.known[name].config |= config

    def get_config(self, name: str) -> dict[str, Any]:
        return dict(self.known[name].config)

    def by_name(self, name: str) -> Analyzer | None:
        return self.known.get(name)

    def clear(self) -> None:
        self.known.clear()

    def names(self) -> list[str]:
        return list(self.known)

    def register_all(self, analyzers: list[Analyzer], disabled: tuple[str, ...] = ()) -> list[str]:
        """Registers those that are valid, new and not disabled; the names of the others."""
        left = []
        for a in analyzers:
            if valid(a) and a.name not in self.known and a.name not in disabled:
                self.register(a)
            else:
                left.append(getattr(a, "name", str(a)))
        return left

    def by_category(self, category: str) -> list[Analyzer]:
        return [a for a in self.known.values() if a.category == category]


def _document(plan: Callable[[DataFrame], DataFrame], name: str, category: str, severity: str) -> Callable[[DataFrame, dict[str, Any]], DataFrame]:
    return lambda nodes, config: plan(nodes, **config).select("doc_id", "pre", F.lit(name).alias("analyzer"), F.lit(category).alias("category"), F.lit(severity).alias("severity"))


def default_registry() -> Registry:
    r = Registry()
    r.register(Analyzer("business_logic", "security", lambda nodes, config: business.analyze(nodes, **config).select(*ISSUES)))
    r.register(Analyzer("dead_code", "maintainability", _document(documents.dead_code, "dead_code", "maintainability", "warning")))
    r.register(Analyzer("magic_numbers", "readability", _document(documents.magic_numbers, "magic_numbers", "readability", "info")))
    r.register(Analyzer("security", "security", _document(documents.security, "security", "security", "error")))
    r.register(Analyzer("simplify_conditional", "refactoring", _document(documents.simplify_conditional, "simplify_conditional", "refactoring", "refactoring_opportunity")))
    r.register(Analyzer("taint", "security", _document(documents.taint, "taint", "security", "error")))
    r.register(Analyzer("nesting_depth", "maintainability", _nesting, {"warn": 4, "most": 5}))
    return r


def _nesting(nodes: DataFrame, config: dict[str, Any]) -> DataFrame:
    found = metrics.nesting_issues(nodes, config["warn"], config["most"])
    return found.select("doc_id", "pre", F.lit("nesting_depth").alias("analyzer"), F.lit("maintainability").alias("category"), "severity")


def chosen(nodes: DataFrame, names: tuple[str, ...] | None, registry: Registry) -> list[Analyzer]:
    disabled = (nodes.sparkSession.conf.get(DISABLED, None) or "").split(",")
    unknown = [n for n in names or () if n not in registry.known]
    if unknown:
        raise KeyError(f"unknown analyzers: {', '.join(unknown)}")
    return [a for n, a in registry.known.items() if (names is None or n in names) and n not in disabled]


def run_with_errors(nodes: DataFrame, names: tuple[str, ...] | None = None, registry: Registry | None = None, max_issues: int | None = None, halt_on_error: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """The issues of the named analyzers (all by default), and the errors of those that failed.

    max_issues leaves so many of a document, and halt_on_error those up to its first error, in order of place and analyzer.
    """
    out, errors = nodes.sparkSession.createDataFrame([], SCHEMA), {}
    for a in chosen(nodes, names, registry or default_registry()):
        try:
            if a.gate(a.config):
                found = a.after(a.plan(nodes, a.config)).select(*ISSUES)
                found.schema  # analysed here, so that a plan that can't be is found
                out = out.unionByName(found)
        except Exception as e:  # noqa: BLE001  whatever an analyzer does, the others run
            log.warning("analyzer %s failed: %s", a.name, e)
            errors[a.name] = str(e)
    order = Window.partitionBy("doc_id").orderBy("pre", "analyzer")
    if halt_on_error:
        before = F.max(F.when(F.col("severity") == "error", 1)).over(order.rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumn("halted", before).filter("halted IS NULL").drop("halted")
    if max_issues is not None:
        out = out.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= max_issues).drop("n")
    return out, errors


def run(nodes: DataFrame, names: tuple[str, ...] | None = None, registry: Registry | None = None, max_issues: int | None = None, halt_on_error: bool = False) -> DataFrame:
    return run_with_errors(nodes, names, registry, max_issues, halt_on_error)[0]


def summary(issues: DataFrame) -> DataFrame:
    """Totals by severity, category and analyzer, from one grouping-sets pass over the issues."""
    return documents.rollup(issues, "severity", "category", "analyzer")


def timed(nodes: DataFrame, **options: Any) -> tuple[str, float]:
    """The summary of a run as JSON, and the milliseconds that running it took."""
    start = time.perf_counter()
    rows = summary(run(nodes, **options)).collect()  # a row for each severity, category and analyzer
    return json.dumps([r.asDict() for r in rows]), (time.perf_counter() - start) * 1000
