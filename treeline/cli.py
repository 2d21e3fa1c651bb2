"""Command line: `python -m treeline.cli COMMAND PATH [PATH]` reads the sources at a path, runs one plan over them and prints a report for each row."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline import format as fmt
from treeline import supplementals
from treeline.operators import clones, documents, graph, metrics, results
from treeline.plans import primitives
from treeline.sources.trees import from_file, language_of
from treeline.sources.unparse import to_source

Options = argparse.Namespace


def _complexity(nodes: DataFrame, o: Options) -> DataFrame:
    if o.function:
        return metrics.per_function(nodes).filter(F.col("function_name") == o.function)
    found = metrics.complexity(nodes.filter(F.col("line").isNull() | F.col("line").between(*o.lines)) if o.lines else nodes)
    return found.filter(F.col("cyclomatic") >= o.threshold) if o.threshold else found


def _duplicates(nodes: DataFrame, o: Options) -> DataFrame:
    groups = clones.clone_groups(nodes)
    if o.cross_language:
        return groups
    of = nodes.filter("parent_pre = -1").select("doc_id", "language")
    return groups.join(of, "doc_id").withColumn("languages", F.size(F.collect_set("language").over(Window.partitionBy("group_id")))).filter("languages = 1").drop("languages", "language")


COMMANDS: dict[str, Callable[[DataFrame, Options], DataFrame]] = {
    "analyze": lambda n, o: metrics.validation(n),
    "inspect": lambda n, o: fmt.tree_format(n, o.tree) if o.tree else primitives.inspect(n),
    "translate": lambda n, o: to_source(n, o.target),
    "complexity": _complexity,
    "purity_check": lambda n, o: documents.purity(n),
    "dead_code": lambda n, o: results.at_least(results.with_confidence(documents.dead_code(n)), o.least or "low", "confidence", results.CONFIDENCE),
    "unused_vars": lambda n, o: documents.unused_variables(n),
    "code_smells": lambda n, o: results.at_least(documents.all_smells(n), o.least or "low"),
    "security_scan": lambda n, o: results.of_categories(results.at_least(documents.security(n), o.least or "low"), tuple(o.category) or None),
    "taint_check": lambda n, o: documents.taint(n),
    "control_flow": lambda n, o: {"dot": graph.as_dot, "json": graph.as_json, "d3": graph.as_d3}[o.graph](graph.control_flow(n)),
    "detect_duplicates": _duplicates,
    "supplemental_check": lambda n, o: supplementals.default().missing(n, o.language or "python"),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="treeline")
    p.add_argument("command", choices=[*COMMANDS, "validate_equivalence", "languages"])
    p.add_argument("paths", nargs="*")
    p.add_argument("--language", help="of all sources; by default each file's extension tells")
    p.add_argument("--format", choices=("text", "json", "detailed"), default="text")
    p.add_argument("--target", default="python", help="of translate")
    p.add_argument("--tree", choices=("tree", "json", "plain"), help="of inspect")
    p.add_argument("--graph", choices=("dot", "json", "d3"), default="dot")
    p.add_argument("--least", help="least severity or confidence")
    p.add_argument("--category", action="append", default=[])
    p.add_argument("--threshold", type=int, help="least cyclomatic complexity")
    p.add_argument("--lines", type=int, nargs=2, help="first and last line")
    p.add_argument("--function")
    p.add_argument("--cross-language", action="store_true")
    p.add_argument("--output", help="a path to write the rows to as JSON, rather than printing them")
    return p


def detect_language(spark: SparkSession, path: str) -> str | None:
    """The language that a path's extension names."""
    return spark.range(1).select(language_of(F.lit(path))).first()[0]


def rows(spark: SparkSession, args: list[str]) -> tuple[DataFrame, Options]:
    """The rows that a command gives."""
    o = parser().parse_args(args)
    if o.command == "languages":
        from treeline.sources.trees import supported_languages

        return supported_languages(spark).withColumnRenamed("language", "doc_id"), o
    need = 2 if o.command == "validate_equivalence" else 1
    if len(o.paths) != need:
        raise SystemExit(f"{o.command} takes {need} paths")
    nodes = [from_file(spark, p, o.language) for p in o.paths]
    if o.command == "validate_equivalence":
        named = [n.withColumn("doc_id", F.lit("sources")) for n in nodes]
        return primitives.equivalent(*named), o
    return COMMANDS[o.command](nodes[0], o), o


def main(args: list[str] | None = None) -> None:
    spark = SparkSession.builder.appName("treeline").getOrCreate()
    found, o = rows(spark, args)
    if o.output:
        found.write.json(o.output)
        return
    for r in results.report(found, style=o.format).toLocalIterator():
        print(r.report)


if __name__ == "__main__":
    main()
