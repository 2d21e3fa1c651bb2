"""What is done with findings: filters by severity and confidence, roll-ups, merges, selections and reports, all as columns and groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
#: Ranks of severities and confidences, and what clone types mean.
SEVERITY = {"critical": 4, "error": 4, "high": 3, "warning": 3, "medium": 2, "info": 1, "low": 1, "refactoring_opportunity": 0}
CONFIDENCE = {"high": 3, "medium": 2, "low": 1}
CLONE_TYPES = {
    "type_i": "Exact clone (identical code)",
    "type_ii": "Renamed clone (identical structure, different identifiers)",
    "type_iii": "Near-miss clone (similar structure with modifications)",
    "type_iv": "Semantic clone (different syntax, same behavior)",
}


def rank(column: Column, ranks: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), column)


def at_least(findings: DataFrame, least: str, column: str = "severity", ranks: dict[str, int] = SEVERITY) -> DataFrame:
    """Findings of a severity, or with another column and table of ranks a confidence, of at least the given one."""
    if least not in ranks:
        raise ValueError(f"unknown {column} {least}")
    return findings.filter(rank(C(column), ranks) >= ranks[least])


def of_categories(findings: DataFrame, categories: tuple[str, ...] | None) -> DataFrame:
    return findings if categories is None else findings.filter(C("category").isin(*categories))


def with_confidence(findings: DataFrame, confidence: str = "high") -> DataFrame:
    """Dead code is certain where it is found at all."""
    return findings.withColumn("confidence", F.lit(confidence))


def rolled_up(findings: DataFrame, documents: DataFrame, by: str) -> DataFrame:
    """Per document (all of `documents`): has_findings, total, by_<column> as a map, and a summary in order of the column's number of findings.

    One grouping by document and value, and one by document over what that leaves.
    """
    counted = findings.groupBy("doc_id", by).agg(F.count(F.lit(1)).alias("n"))
    parts = F.array_sort(F.collect_list(F.struct((-C("n")).alias("o"), C(by).alias("k"), C("n").alias("n"))))
    g = counted.groupBy("doc_id").agg(F.sum("n").alias("total"), parts.alias("parts"))
    out = documents.select("doc_id").distinct().join(g, "doc_id", "left").withColumn("total", F.coalesce("total", F.lit(0)).cast("long"))
    text = F.array_join(F.transform("parts", lambda x: F.concat(x["k"], F.lit(": "), x["n"])), ", ")
    pairs = F.map_from_entries(F.transform("parts", lambda x: F.struct(x["k"], x["n"])))
    return out.select("doc_id", (C("total") > 0).alias("has_findings"), "total", pairs.alias(f"by_{by}"), F.coalesce(text, F.lit("none")).alias("summary"))


def merged_purity(purity: DataFrame, *keys: str) -> DataFrame:
    """Purity rows (with effects and unknown_calls) of several documents as one for each key: pure if all are, all effects, and how sure that is."""
    effects = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(F.split("effects", ","), lambda x: x != "")))))
    g = purity.groupBy(*keys).agg(F.bool_and(C("purity") == "pure").alias("pure"), F.array_join(effects, ",").alias("effects"), F.sum("unknown_calls").alias("unknown_calls"), F.count(F.lit(1)).alias("documents"))
    sure = F.when(C("pure") & (C("unknown_calls") == 0), "high").when(C("unknown_calls") > 0, "low").otherwise("medium")
    return g.withColumn("confidence", sure)


def selected(metrics: DataFrame, names: tuple[str, ...] | None) -> DataFrame:
    """Metric rows in which those that aren't asked for are 0 or empty; they are never computed, as their columns are dropped from the plan."""
    if names is None:
        return metrics
    blank = lambda f: F.lit("" if f.dataType.simpleString() == "string" else 0).cast(f.dataType).alias(f.name)
    return metrics.select(*[C(f.name) if f.name in (*names, "doc_id") else blank(f) for f in metrics.schema.fields])


def described_clones(clones: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Rows of clones.detect with duplicate, the type's description and a summary."""
    words = F.element_at(F.create_map(*[F.lit(x) for kv in CLONE_TYPES.items() for x in kv]), C("clone_type"))
    share = F.format_string("%.1f%%", 100 * C("similarity"))
    summary = F.when(C("clone_type").isNull(), "No duplicate detected").otherwise(F.concat(words, F.lit(", similarity "), share))
    return clones.withColumns({"duplicate": C("clone_type").isNotNull(), "description": words, "summary": summary})


def report(rows: DataFrame, key: str = "doc_id", style: str = "text") -> DataFrame:
    """(key, report) of result rows: `text` one line, `json` an object, `detailed` a line for each field."""
    fields = [c for c in rows.columns if c != key]
    text = {f.name: F.coalesce(F.to_json(C(f.name)) if f.dataType.typeName() in ("array", "map", "struct") else C(f.name).cast("string"), F.lit("-")) for f in rows.schema.fields}
    pairs = [F.concat(F.lit(f"{c.replace('_', ' ')}: "), text[c]) for c in fields]
    made = {
        "text": F.concat(text[key], F.lit(" - "), F.concat_ws(", ", *pairs)),
        "json": F.to_json(F.struct(key, *fields)),
        "detailed": F.concat_ws("\n", text[key], F.repeat(F.lit("="), 50), *[F.concat(F.lit("  "), p) for p in pairs]),
    }
    if style not in made:
        raise ValueError(f"unknown style {style}")
    return rows.select(key, made[style].alias("report"))


def issue(analyzer: str, category: str, severity: str, message: str = "", **metadata: str) -> Column:
    """An issue of the current node as a struct."""
    if severity not in ("error", "warning", "info", "refactoring_opportunity"):
        raise ValueError(f"unknown severity {severity}")
    extra = F.create_map(*[F.lit(x) for kv in metadata.items() for x in kv]) if metadata else F.create_map().cast("map<string,string>")
    where = F.struct(C("line").alias("line"), C("pre").alias("pre"))
    return F.struct(*[F.lit(v).alias(k) for k, v in (("analyzer", analyzer), ("category", category), ("severity", severity), ("message", message))], where.alias("location"), extra.alias("metadata"))


def suggestion(kind: str, replacement: str | None = None, message: str = "") -> Column:
    """A suggestion as a struct: replace, remove or insert something, by what, and why."""
    if kind not in ("replace", "remove", "insert_before", "insert_after"):
        raise ValueError(f"unknown suggestion {kind}")
    return F.struct(F.lit(kind).alias("type"), F.lit(replacement).cast("string").alias("replacement"), F.lit(message).alias("message"))
