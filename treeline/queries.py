"""The registered queries of the engine's own operators, with SQL over the same tables for each that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline import format as fmt
from treeline import runner, supplementals
from treeline.functions import rules as R
from treeline.functions import semantic
from treeline.operators import business, classes, clones, documents, graph, metrics, results
from treeline.plans import primitives
from treeline.sources import corpora
from treeline.sources.trees import read_sources
from treeline.sources.unparse import round_trip, to_source, translate, valid_source

Query = Callable[[SparkSession, str], DataFrame]
KNOWN: dict[str, tuple[Query, str | None]] = {}


def over(name: str, corpus: str, plan: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """Registers a plan over a derived corpus; sql is a query over its relation `nodes`."""
    KNOWN[name] = (lambda spark, sf_dir: plan(corpora.corpus(spark, sf_dir, corpus)), corpora.oracle(corpus, sql) if sql else None)


def _listed(words: tuple[str, ...]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _any(column: str, words: tuple[str, ...]) -> str:
    """One of the words is part of the lower-cased column; written as single tests, not as the engine's regular expression."""
    return "coalesce(" + " OR ".join(f"contains(lower({column}), '{w.lower()}')" for w in words) + ", false)"


POINT = "CASE WHEN type IN ('conditional', 'loop') OR (type = 'binary_op' AND category = 'boolean' AND operator IN ('and', 'or')) THEN 1 WHEN role IN ('handler', 'arm') THEN 1 ELSE 0 END"
OWN = "CASE WHEN type IN ('conditional', 'loop', 'exception_handling', 'match_arm') THEN 1 + nest WHEN type = 'binary_op' AND category = 'boolean' AND operator IN ('and', 'or') THEN 1 ELSE 0 END"
STATEMENTS = "('assignment', 'inline_match', 'augmented_assignment', 'conditional', 'loop', 'early_return', 'exception_handling', 'pattern_match', 'function_call', 'collection_op', 'async_operation')"
LAYER = "CASE WHEN type IN ('literal','variable','list','map','pair','tuple','binary_op','unary_op','function_call','conditional','early_return','block','assignment','inline_match') THEN 'core' WHEN type IN ('loop','lambda','collection_op','pattern_match','match_arm','exception_handling','async_operation') THEN 'extended' WHEN type IN ('container','function_def','param','attribute_access','augmented_assignment','property') THEN 'structural' WHEN type = 'language_specific' THEN 'native' ELSE 'unknown' END"

over("cyclomatic", "orders", metrics.cyclomatic, f"SELECT doc_id, CAST(1 + sum({POINT}) AS BIGINT) AS cyclomatic FROM nodes GROUP BY doc_id")
over("cognitive", "orders", metrics.cognitive, f"SELECT doc_id, CAST(sum({OWN}) AS BIGINT) AS cognitive FROM nodes GROUP BY doc_id")
over("max_nesting", "orders", metrics.nesting, "SELECT doc_id, CAST(max(nest) AS BIGINT) AS max_nesting FROM nodes GROUP BY doc_id")
for _c in ("orders", "events", "nations"):
    over(
        f"validation_{_c}", _c, metrics.validation,
        f"""SELECT *, concat_ws(',', CASE WHEN native_constructs > 0 THEN 'native_constructs' END, CASE WHEN tree_depth > 100 THEN 'deep_nesting' END, CASE WHEN node_count > 1000 THEN 'large_tree' END) AS warnings FROM (
        SELECT doc_id, CAST(max(depth) + 1 AS BIGINT) AS tree_depth, count(*) AS node_count, CAST(sum(CASE WHEN type = 'language_specific' THEN 1 ELSE 0 END) AS BIGINT) AS native_constructs,
        CAST(sum(CASE WHEN {LAYER} IN ('extended', 'structural') THEN 1 ELSE 0 END) AS BIGINT) AS extended_constructs, count(DISTINCT CASE WHEN type = 'variable' THEN value END) AS variable_count,
        CASE WHEN sum(CASE WHEN type = 'language_specific' THEN 1 ELSE 0 END) > 0 THEN 'native' WHEN sum(CASE WHEN {LAYER} IN ('extended', 'structural') THEN 1 ELSE 0 END) > 0 THEN 'extended' ELSE 'core' END AS level FROM nodes GROUP BY doc_id)""",
    )
    over(f"type_frequencies_{_c}", _c, metrics.type_frequencies, f"SELECT {LAYER} AS layer, type, count(*) AS n FROM nodes GROUP BY 1, 2")
    over(f"conformance_{_c}", _c, metrics.conformance, "SELECT DISTINCT doc_id, true AS conforms, CAST(0 AS BIGINT) AS n_bad FROM nodes")
over("variables", "orders", metrics.variables, "SELECT DISTINCT doc_id, value AS variable FROM nodes WHERE type = 'variable'")
_TOKENS = """t AS (
  SELECT doc_id, false AS operand, CASE type WHEN 'binary_op' THEN operator WHEN 'conditional' THEN 'if' WHEN 'assignment' THEN '=' WHEN 'function_call' THEN '()' WHEN 'early_return' THEN 'return' END AS token FROM nodes
  UNION ALL SELECT doc_id, true, CASE WHEN type IN ('literal', 'variable') THEN value WHEN type = 'function_call' THEN name END FROM nodes),
p AS (SELECT doc_id, operand, token, count(*) AS c FROM t WHERE token IS NOT NULL GROUP BY 1, 2, 3),
g AS (SELECT doc_id, count(*) FILTER (NOT operand) AS n1, count(*) FILTER (operand) AS n2, CAST(coalesce(sum(c) FILTER (NOT operand), 0) AS BIGINT) AS total1, CAST(coalesce(sum(c) FILTER (operand), 0) AS BIGINT) AS total2 FROM p GROUP BY doc_id)"""
KNOWN["halstead"] = (
    lambda spark, sf_dir: metrics.halstead(corpora.corpus(spark, sf_dir, "orders")),
    f"WITH {corpora.ORDERS}, {_TOKENS} SELECT doc_id, n1, n2, total1, total2, round((total1 + total2) * log2(CAST(n1 + n2 AS DOUBLE)), 6) AS volume, round(n1 / 2.0::DOUBLE * total2 / n2, 6) AS difficulty, round((total1 + total2) * log2(CAST(n1 + n2 AS DOUBLE)) * (n1 / 2.0::DOUBLE * total2 / n2), 4) AS effort FROM g",
)
over("lines_of_code", "orders", metrics.lines_of_code, f"SELECT doc_id, logical, lines AS physical, greatest(0, lines - logical) AS blank FROM (SELECT doc_id, count(*) FILTER (type IN {STATEMENTS}) AS logical, count(DISTINCT CASE WHEN line > 0 THEN line END) AS lines FROM nodes GROUP BY doc_id)")
over("function_metrics", "orders", metrics.function_metrics, f"SELECT doc_id, count(*) FILTER (type IN {STATEMENTS}) AS statement_count, count(*) FILTER (type = 'early_return') AS return_points, count(DISTINCT CASE WHEN type = 'variable' THEN value END) AS variable_count, CAST(0 AS BIGINT) AS parameter_count FROM nodes GROUP BY doc_id")
over("per_function", "nations", metrics.per_function, "SELECT doc_id, name AS function_name, CAST(1 AS BIGINT) AS cyclomatic, CAST(0 AS BIGINT) AS statements, CAST(0 AS BIGINT) AS max_nesting FROM nodes WHERE type = 'function_def'")
_COMPLEX = f"""SELECT doc_id, CAST(1 + sum({POINT}) AS BIGINT) AS cyclomatic, CAST(sum({OWN}) AS BIGINT) AS cognitive, CAST(max(nest) AS BIGINT) AS max_nesting, count(*) FILTER (type IN {STATEMENTS}) AS logical FROM nodes GROUP BY doc_id"""
_WARN = "concat_ws(',', " + ", ".join(f"CASE WHEN {m} >= {e} THEN '{m} error' WHEN {m} >= {w} THEN '{m} warning' END" for m, w, e in metrics.THRESHOLDS) + ")"
_LADDER = f"""SELECT *, CASE WHEN warnings <> '' AND NOT contains(warnings, ',') THEN 'moderate' WHEN warnings <> '' THEN 'high' WHEN cyclomatic <= 5 AND cognitive <= 7 AND max_nesting <= 2 THEN 'low' WHEN cyclomatic <= 10 AND cognitive <= 15 AND max_nesting <= 3 THEN 'moderate'
    WHEN cyclomatic <= 20 AND cognitive <= 30 AND max_nesting <= 5 THEN 'high' ELSE 'very high' END AS summary FROM (SELECT *, {_WARN} AS warnings FROM ({_COMPLEX}))"""
over("complexity", "orders", metrics.complexity, _LADDER)
over(
    "complexity_merged", "orders", lambda n: metrics.merge(metrics.complexity(n), "summary").select("summary", "cyclomatic", "cognitive", "max_nesting", "logical", "documents"),
    f"SELECT summary, max(cyclomatic) AS cyclomatic, max(cognitive) AS cognitive, max(max_nesting) AS max_nesting, CAST(sum(logical) AS BIGINT) AS logical, count(*) AS documents FROM ({_LADDER}) GROUP BY summary",
)
over(
    "unreachable_code", "orders", documents.dead_code,
    "SELECT n.doc_id, n.pre, 'unreachable_after_return' AS finding FROM nodes n JOIN (SELECT doc_id, parent_pre, min(ix) AS first_return FROM nodes WHERE type = 'early_return' GROUP BY 1, 2) r ON n.doc_id = r.doc_id AND n.parent_pre = r.parent_pre AND n.ix > first_return",
)
over("magic_numbers", "orders", documents.magic_numbers, "SELECT doc_id, pre, value FROM nodes WHERE type = 'literal' AND (subtype = 'float' OR (subtype = 'integer' AND value NOT IN ('0', '1', '-1')))")
over("smells", "orders", documents.smells, f"SELECT doc_id, 'long_function' AS smell, CASE WHEN n / 50.0 >= 3 THEN 'critical' WHEN n / 50.0 >= 2 THEN 'high' WHEN n / 50.0 >= 1.5 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT doc_id, count(*) AS n FROM nodes WHERE type IN {STATEMENTS} GROUP BY doc_id) WHERE n > 50")
over("unused_variables", "orders", documents.unused_variables, "SELECT doc_id, value AS variable FROM nodes WHERE type = 'variable' GROUP BY 1, 2 HAVING count(*) FILTER (role = 'target') > 0 AND count(*) FILTER (role IS DISTINCT FROM 'target') = 0")
over(
    "control_flow_counts", "orders", documents.control_flow_counts,
    """SELECT doc_id, 2 + s + r + 2 * c AS cfg_nodes, 1 + s + r + 4 * c + ce AS cfg_edges FROM (
    SELECT doc_id, count(*) FILTER (type IN ('assignment', 'function_call')) AS s, count(*) FILTER (type = 'early_return') AS r, count(*) FILTER (type = 'conditional') AS c, count(*) FILTER (type = 'conditional' AND n_children = 3) AS ce FROM nodes GROUP BY doc_id)""",
)
over(
    "purity", "events", documents.purity,
    """SELECT doc_id, coalesce(string_agg(DISTINCT effect, ',' ORDER BY effect), '') AS effects, count(*) FILTER (type = 'function_call' AND effect IS NULL) AS unknown_calls,
    CASE WHEN count(effect) > 0 THEN 'impure' WHEN count(*) FILTER (type = 'function_call' AND effect IS NULL) > 0 THEN 'unknown' ELSE 'pure' END AS purity,
    CASE WHEN count(effect) = 0 AND count(*) FILTER (type = 'function_call' AND effect IS NULL) > 0 THEN 'low' ELSE 'high' END AS confidence
    FROM (SELECT *, CASE WHEN type = 'function_call' AND starts_with(name, 'Repo.') THEN 'database' WHEN type = 'function_call' AND starts_with(name, 'request') THEN 'network' END AS effect FROM nodes) GROUP BY doc_id""",
)
over("security_calls", "events", documents.security, "SELECT doc_id, pre, 'unsafe_deserialization' AS category, 'critical' AS severity, 95 AS cwe FROM nodes WHERE type = 'function_call' AND name = 'eval'")
over(
    "security_literals", "pages", documents.security,
    "SELECT doc_id, pre, category, severity, cwe FROM (" + " UNION ALL ".join(
        [f"SELECT doc_id, pre, 'hardcoded_secret' AS category, 'high' AS severity, 798 AS cwe FROM nodes WHERE type = 'literal' AND regexp_matches(value, '{p.replace(chr(39), chr(39) * 2)}')" for _, p in R.SECRETS]
        + [f"SELECT doc_id, pre, 'weak_cryptography', 'medium', 327 FROM nodes WHERE type = 'literal' AND ({' OR '.join(f'contains(value, {chr(39)}{w}{chr(39)})' for w in R.WEAK_CRYPTO)})", "SELECT doc_id, pre, 'insecure_protocol', 'medium', 319 FROM nodes WHERE type = 'literal' AND starts_with(value, 'http://')"]
    ) + ")",
)
over("security_rollup", "events", lambda n: documents.rollup(documents.security(n), "severity", "category"), "SELECT severity, category, count(*) AS n FROM (SELECT 'critical' AS severity, 'unsafe_deserialization' AS category FROM nodes WHERE type = 'function_call' AND name = 'eval') GROUP BY GROUPING SETS ((severity), (category), ())")
over(
    "coupling", "events", documents.coupling,
    """SELECT doc_id, coalesce(string_agg(DISTINCT m, ',' ORDER BY m), '') AS dependencies, count(DISTINCT m) AS efferent, CASE WHEN count(m) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS instability, 'excellent' AS assessment
    FROM (SELECT doc_id, CASE WHEN type = 'function_call' AND contains(name, '.') THEN split_part(name, '.', 1) END AS m FROM nodes) GROUP BY doc_id""",
)
over("api_surface", "nations", classes.api_surface, "SELECT doc_id, concat('N', substr(doc_id, 2)) AS container, count(*) AS public_methods, CAST(0 AS DOUBLE) AS avg_params, CAST(0 AS BIGINT) AS max_params, 'excellent' AS assessment, '' AS warnings FROM nodes WHERE type = 'function_def' AND visibility = 'public' GROUP BY doc_id")
over(
    "encapsulation", "nations", classes.encapsulation,
    """SELECT doc_id, concat('N', substr(doc_id, 2)) AS container, count(*) AS methods, count(*) FILTER (visibility = 'public') AS public_methods, count(*) FILTER (visibility = 'private') AS private_methods,
    count(*) FILTER (visibility = 'public' AND n_children = 1) AS accessors, 0 AS violations, 100 AS score, 'excellent' AS assessment FROM nodes WHERE type = 'function_def' GROUP BY doc_id""",
)
_USES = "u AS (SELECT DISTINCT m.doc_id, m.pre AS place, a.name AS attribute FROM nodes m JOIN nodes a ON m.doc_id = a.doc_id AND a.type = 'attribute_access' AND a.parent_pre = m.pre WHERE m.type = 'function_def')"
KNOWN["state_management"] = (
    lambda spark, sf_dir: classes.state_management(corpora.corpus(spark, sf_dir, "nations")),
    f"WITH {corpora.NATIONS}, {_USES} SELECT doc_id, concat('N', substr(doc_id, 2)) AS container, count(DISTINCT attribute) AS state_count, CAST(0 AS BIGINT) AS mutation_count, '' AS initialized, string_agg(DISTINCT attribute, ',' ORDER BY attribute) AS uninitialized, string_agg(DISTINCT attribute, ',' ORDER BY attribute) AS read_only, '' AS mutable, 'immutable_state' AS pattern, 'excellent' AS assessment FROM u GROUP BY doc_id",
)
KNOWN["cohesion"] = (
    lambda spark, sf_dir: documents.cohesion(corpora.corpus(spark, sf_dir, "nations")),
    f"""WITH RECURSIVE {corpora.NATIONS}, {_USES},
    ms AS (SELECT doc_id, pre AS place FROM nodes WHERE type = 'function_def'),
    e AS (SELECT DISTINCT a.doc_id, a.place AS x, b.place AS y FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.attribute = b.attribute AND a.place <> b.place),
    r AS (SELECT doc_id, place AS x, place AS y FROM ms UNION SELECT r.doc_id, r.x, e.y FROM r JOIN e ON r.doc_id = e.doc_id AND r.y = e.x),
    l AS (SELECT doc_id, x, min(y) AS root FROM r GROUP BY 1, 2),
    c AS (SELECT doc_id, count(*) AS methods, count(DISTINCT root) AS components FROM l GROUP BY 1),
    k AS (SELECT m.doc_id, (SELECT count(*) FROM e WHERE e.doc_id = m.doc_id AND x < y) AS connected, (SELECT count(*) FROM r WHERE r.doc_id = m.doc_id AND x < y) AS reachable FROM (SELECT DISTINCT doc_id FROM ms) m),
    f AS (SELECT doc_id, methods, methods * (methods - 1) // 2 AS pairs, greatest(0, components - 1) AS lcom,
      round(CASE WHEN methods > 1 THEN connected::DOUBLE / (methods * (methods - 1) // 2) ELSE 1.0 END, 6) AS tcc, round(CASE WHEN methods > 1 THEN reachable::DOUBLE / (methods * (methods - 1) // 2) ELSE 1.0 END, 6) AS lcc FROM c JOIN k USING (doc_id))
    SELECT *, CASE WHEN lcom = 0 AND tcc >= 0.8 THEN 'excellent' WHEN lcom <= 1 AND tcc >= 0.6 THEN 'good' WHEN lcom <= 3 AND tcc >= 0.4 THEN 'fair' WHEN lcom <= 5 AND tcc >= 0.2 THEN 'poor' ELSE 'very_poor' END AS assessment FROM f""",
)
over(
    "semantic_enrichment", "events", lambda n: semantic.enrich(n).filter("op_domain IS NOT NULL").select("doc_id", "pre", "op_domain", "op_operation", "op_framework", "op_target"),
    """SELECT c.doc_id, c.pre, CASE WHEN c.name = 'requests.get' THEN 'http' ELSE 'db' END AS op_domain, CASE c.name WHEN 'Repo.get' THEN 'retrieve' WHEN 'requests.get' THEN 'get' ELSE 'create' END AS op_operation,
    CASE c.name WHEN 'requests.get' THEN 'requests' WHEN 'User.create' THEN 'activerecord' ELSE 'ecto' END AS op_framework, a.value AS op_target
    FROM nodes c JOIN nodes a ON c.doc_id = a.doc_id AND a.parent_pre = c.pre WHERE c.type = 'function_call' AND c.name <> 'eval'""",
)
over("semantic_db_only", "events", lambda n: semantic.enrich(n, ("db",)).groupBy("op_operation").agg(F.count(F.lit(1)).alias("n")), "SELECT CASE name WHEN 'Repo.get' THEN 'retrieve' WHEN 'Repo.insert' THEN 'create' WHEN 'User.create' THEN 'create' END AS op_operation, count(*) AS n FROM nodes GROUP BY 1")
_PLACE = "SELECT doc_id, pre, line, analyzer, category, severity, CAST(NULL AS STRING) AS function_name FROM "
over(
    "business_logic_events", "events", business.analyze,
    f"""{_PLACE} (
    WITH c AS (SELECT n.*, a.value AS arg, a.type AS arg_type, lower(n.name) AS l, split_part(n.name, '.', -1) AS last FROM nodes n JOIN nodes a ON n.doc_id = a.doc_id AND a.parent_pre = n.pre WHERE n.type = 'function_call'),
    e AS (SELECT c.*, (SELECT count(*) FROM nodes b WHERE b.doc_id = c.doc_id AND b.pre < c.pre AND {_any("coalesce(b.name, b.value)", R.OWNERSHIP)}) AS owned,
      (SELECT count(*) FROM nodes b WHERE b.doc_id = c.doc_id AND b.pre < c.pre AND {_any("coalesce(b.name, b.value)", R.AUTHORIZATION)}) AS authorized FROM c)
    SELECT doc_id, pre, line, 'improper_input_validation' AS analyzer, 'security' AS category, 'warning' AS severity FROM e WHERE {_any("name", R.SENSITIVE_ON_INPUT)} AND {_any("arg", R.USER_INPUT)}
    UNION ALL SELECT doc_id, pre, line, 'insecure_direct_object_reference', 'security', 'warning' FROM e WHERE (name IN {_listed(R.FETCHES)} OR last IN {_listed(R.FETCHES)}) AND arg IN ('params', 'user_id') AND owned = 0
    UNION ALL SELECT doc_id, pre, line, 'missing_authorization', 'security', 'error' FROM e WHERE last IN {_listed(R.SENSITIVE_CALLS)} AND arg IN ('params', 'user_id') AND authorized = 0
    UNION ALL SELECT doc_id, pre, line, 'missing_telemetry_for_external_http', 'maintainability', 'info' FROM e WHERE name = 'requests.get'
    UNION ALL SELECT doc_id, pre, line, 'ssrf_vulnerability', 'security', 'error' FROM e WHERE (name IN {_listed(R.HTTP_CLIENTS)} OR last IN {_listed(R.HTTP_CLIENTS)}) AND {_any("arg", R.URL_INPUT)} AND arg_type = 'variable')""",
)
_OCTET = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
over(
    "business_logic_pages", "pages", business.analyze,
    f"""{_PLACE} (
    SELECT doc_id, pre, line, 'hardcoded_value' AS analyzer, 'security' AS category, 'warning' AS severity FROM nodes WHERE type = 'literal' AND regexp_matches(value, '^https?://[^\\s]+$') AND NOT regexp_matches(value, '^https?://(localhost|127\\.0\\.0\\.1|0\\.0\\.0\\.0)')
    UNION ALL SELECT doc_id, pre, line, 'inline_javascript', 'security', 'error' FROM nodes WHERE type = 'literal' AND {_any("value", R.INLINE_SCRIPT)})""",
)
over("runner_summary", "orders", lambda n: runner.summary(runner.run(n, ("dead_code", "magic_numbers"))),
     """SELECT severity, category, analyzer, count(*) AS n FROM (
     SELECT 'info' AS severity, 'readability' AS category, 'magic_numbers' AS analyzer FROM nodes n JOIN nodes p ON n.doc_id = p.doc_id AND n.parent_pre = p.pre AND p.type IN ('binary_op', 'unary_op') WHERE n.type = 'literal' AND (n.subtype = 'float' OR (n.subtype = 'integer' AND n.value NOT IN ('0', '1', '-1')))
     UNION ALL SELECT 'warning', 'maintainability', 'dead_code' FROM nodes n JOIN (SELECT doc_id, parent_pre, min(ix) AS f FROM nodes WHERE type = 'early_return' GROUP BY 1, 2) r ON n.doc_id = r.doc_id AND n.parent_pre = r.parent_pre AND n.ix > f)
     GROUP BY GROUPING SETS ((severity), (category), (analyzer), ())""")  # fmt: skip
over("clone_groups", "orders", lambda n: clones.clone_groups(n.drop("line").withColumn("line", F.lit(0))),
     """, s AS (SELECT doc_id, string_agg(concat_ws('|', depth, coalesce(role, '-'), type, coalesce(subtype, '-'), coalesce(category, '-'), coalesce(operator, '-'), coalesce(kind, '-')), chr(10) ORDER BY pre) AS shape,
       string_agg(concat_ws('|', depth, coalesce(role, '-'), type, coalesce(subtype, '-'), coalesce(value, '-'), coalesce(category, '-'), coalesce(operator, '-'), coalesce(name, '-'), coalesce(kind, '-')), chr(10) ORDER BY pre) AS exact FROM nodes GROUP BY doc_id),
     g AS (SELECT shape, count(*) AS group_size, min(doc_id) AS group_id, count(DISTINCT exact) AS kinds FROM s GROUP BY shape HAVING count(*) > 1)
     SELECT doc_id, group_id, CASE WHEN kinds = 1 THEN 'type_i' ELSE 'type_ii' END AS clone_type, group_size FROM s JOIN g USING (shape)""")  # fmt: skip
over("control_flow_graph", "orders", lambda n: graph.graph_summary(graph.graphs(n)),
     "SELECT doc_id, 1 + count(*) FILTER (type = 'conditional') * 5 AS edges, CAST(2 + count(*) FILTER (type IN ('conditional', 'assignment', 'function_call', 'early_return')) AS BIGINT) AS nodes, false AS cyclic, true AS all_reached FROM nodes GROUP BY doc_id")
over("control_flow_dot", "orders", lambda n: graph.as_dot(graph.graphs(n)))
over(
    "token_similarity", "events", lambda n: clones.token_similarity(clones.pairs_of(n, F.substring("doc_id", 2, 20).cast("long") % 100 == 0), n),
    """, t AS (SELECT doc_id, list(DISTINCT type) AS x FROM nodes GROUP BY doc_id)
    SELECT a.doc_id AS left, b.doc_id AS right, round(len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x))), 6) AS similarity FROM t a JOIN t b ON a.doc_id <> b.doc_id AND CAST(substr(a.doc_id, 2) AS BIGINT) % 100 = 0""",
)
over("format_tree", "nations", fmt.tree_text, "SELECT doc_id, string_agg(concat(repeat('  ', depth), concat_ws(' ', type, name, operator, value)), chr(10) ORDER BY pre) AS text FROM nodes GROUP BY doc_id")
over("format_plain", "nations", lambda n: fmt.tree_format(n, "plain"), "SELECT doc_id, string_agg(type, ' ' ORDER BY pre) AS text FROM nodes GROUP BY doc_id")
over("traverse", "nations", lambda n: primitives.traverse(n, F.lit(1), F.lit(-1)).select("doc_id", "pre", "acc"), "SELECT doc_id, pre, CAST(depth + 1 AS DOUBLE) AS acc FROM nodes")
over("token_stream", "nations", lambda n: clones.token_stream(n).select("doc_id", F.array_join("tokens", ",").alias("tokens")), "SELECT doc_id, string_agg(type, ',' ORDER BY pre) AS tokens FROM nodes GROUP BY doc_id")
over(
    "described", "nations", lambda n: primitives.described(n).filter("type IN ('container', 'function_def')").select("doc_id", "pre", "arity", "container_name", "function_visibility", "has_state"),
    """SELECT doc_id, pre, CASE WHEN type = 'function_def' THEN 0 END AS arity, CASE WHEN type = 'container' THEN name END AS container_name, CASE WHEN type = 'function_def' THEN visibility END AS function_visibility,
    CASE WHEN type = 'container' THEN true END AS has_state FROM nodes WHERE type IN ('container', 'function_def')""",
)
over(
    "updated_meta", "orders", lambda n: primitives.update_meta(n, F.col("type") == "variable", name=F.upper("value"), kind=F.lit("v")).filter("kind = 'v'").select("doc_id", "pre", "name"),
    "SELECT doc_id, pre, upper(value) AS name FROM nodes WHERE type = 'variable'",
)
over("updated_children", "orders", lambda n: primitives.update_children(n, "parent_pre = -1", F.col("type") == "conditional").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "SELECT doc_id, 1 + 14 * count(*) FILTER (type = 'conditional') AS n FROM nodes GROUP BY doc_id")
over("security_high", "events", lambda n: results.of_categories(results.at_least(documents.security(n), "high"), ("unsafe_deserialization",)).groupBy("severity").agg(F.count(F.lit(1)).alias("n")), "SELECT 'critical' AS severity, count(*) AS n FROM nodes WHERE name = 'eval' HAVING count(*) > 0")
over(
    "security_results", "events", lambda n: results.rolled_up(documents.security(n), n, "severity").select("doc_id", "has_findings", "total", "summary"),
    "SELECT doc_id, count(*) FILTER (name = 'eval') > 0 AS has_findings, count(*) FILTER (name = 'eval') AS total, CASE WHEN count(*) FILTER (name = 'eval') > 0 THEN concat('critical: ', count(*) FILTER (name = 'eval')) ELSE 'none' END AS summary FROM nodes GROUP BY doc_id",
)
over("dead_code_results", "orders", lambda n: results.rolled_up(documents.dead_code(n), n, "finding").select("doc_id", "has_findings", "total"),
     "SELECT n.doc_id, count(*) FILTER (n.parent_pre = r.parent_pre AND n.ix > first_return) > 0 AS has_findings, count(*) FILTER (n.parent_pre = r.parent_pre AND n.ix > first_return) AS total FROM nodes n LEFT JOIN (SELECT doc_id, parent_pre, min(ix) AS first_return FROM nodes WHERE type = 'early_return' GROUP BY 1, 2) r ON n.doc_id = r.doc_id GROUP BY n.doc_id")
over("metric_selection", "orders", lambda n: results.selected(metrics.complexity(n), ("cyclomatic",)).select("doc_id", "cyclomatic", "cognitive", "summary"), f"SELECT doc_id, CAST(1 + sum({POINT}) AS BIGINT) AS cyclomatic, CAST(0 AS BIGINT) AS cognitive, '' AS summary FROM nodes GROUP BY doc_id")
over("format_json", "nations", fmt.tree_json)
over("format_results", "orders", lambda n: fmt.results_json(metrics.complexity(n)))


def python_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python functions generated from orders, parsed in the workers, and measured."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    source = F.concat(F.lit("def order(total, limit):\n    if total > limit and total != "), F.col("o_custkey").cast("string"), F.lit(":\n        for x in range("), (F.col("o_orderkey") % 7).cast("string"), F.lit("):\n            total = total + x\n        return total\n    return limit\n"))
    # Parsing is bound by the CPU, so that a table of few files is spread first.
    spread = orders.select(F.col("o_orderkey").alias("doc_id"), source.alias("source")).repartition(spark.sparkContext.defaultParallelism)
    nodes = read_sources(spread)
    return metrics.complexity(nodes)


KNOWN["python_sources"] = (
    python_sources,
    "SELECT CAST(o_orderkey AS STRING) AS doc_id, CAST(4 AS BIGINT) AS cyclomatic, CAST(4 AS BIGINT) AS cognitive, CAST(2 AS BIGINT) AS max_nesting, CAST(6 AS BIGINT) AS logical, '' AS warnings, 'low' AS summary FROM orders",
)


def parts_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source): a Python program for each part, whose shape follows from the part's size."""
    size = F.col("p_size")
    pick = lambda n, *texts: F.element_at(F.array(*[F.lit(t) for t in texts]), size % n + 1)
    lines = [
        pick(3, "flag = True if c else False", "flag = False if c else True", "flag = d if c else False"),
        pick(4, "if a:", "if a and b:", "if a and b and c:", "if a and b and c and d:"),
        F.lit("    f(flag)"),
        F.when(size % 5 == 0, "eval(input())").otherwise("eval('1')"),
        F.lit("try:\n    g()\nexcept ValueError:"),
        pick(2, "    logger.error(e)", "    h()"),
        F.lit("ys = [Repo.get(y) for y in zs]"),
        F.when(size % 7 == 0, "if True:\n    f()\nelse:\n    g()").otherwise("print(ys)"),
    ]
    # Parsing is bound by the CPU, so that a table of few files is spread first.
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("doc_id"), F.concat_ws("\n", *lines).alias("source")).repartition(spark.sparkContext.defaultParallelism)


def over_parts(name: str, plan: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    KNOWN[name] = (lambda spark, sf_dir: plan(read_sources(parts_sources(spark, sf_dir))), sql)


_PART = "CAST(p_partkey AS STRING) AS doc_id"
over_parts("parts_cyclomatic", metrics.cyclomatic, f"SELECT {_PART}, CAST(4 + p_size % 4 + CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS cyclomatic FROM part")
over_parts("parts_simplify_conditional", lambda n: documents.simplify_conditional(n).select("doc_id", "simplification"), f"SELECT {_PART}, ['use_condition', 'negate_condition', 'use_and'][p_size % 3 + 1] AS simplification FROM part")
over_parts("parts_complex_conditionals", lambda n: documents.complex_conditionals(n).select("doc_id", "operators", "severity"), f"SELECT {_PART}, CAST(3 AS BIGINT) AS operators, 'medium' AS severity FROM part WHERE p_size % 4 = 3")
over_parts("parts_taint", lambda n: documents.taint(n).select("doc_id", "sink", "source", "risk"), f"SELECT {_PART}, 'eval' AS sink, 'input' AS source, 'critical' AS risk FROM part WHERE p_size % 5 = 0")
over_parts("parts_dead_code", lambda n: documents.dead_code(n).select("doc_id", "finding"), f"SELECT {_PART}, 'always_true' AS finding FROM part WHERE p_size % 7 = 0")
over_parts("parts_unused_variables", documents.unused_variables, f"SELECT {_PART}, 'ys' AS variable FROM part WHERE p_size % 7 = 0")
over_parts(
    "parts_business_logic", lambda n: business.analyze(n, ("swallowing_exception", "n_plus_one_query", "hardcoded_value")).select("doc_id", "analyzer", "severity"),
    f"SELECT {_PART}, 'n_plus_one_query' AS analyzer, 'warning' AS severity FROM part UNION ALL SELECT {_PART}, 'swallowing_exception', 'warning' FROM part WHERE p_size % 2 = 1",
)
over_parts("parts_purity", lambda n: documents.purity(n).select("doc_id", "effects", "purity"), f"SELECT {_PART}, CASE WHEN p_size % 5 = 0 OR p_size % 7 <> 0 THEN 'database,exception,io,mutation' ELSE 'database,exception,mutation' END AS effects, 'impure' AS purity FROM part")
over_parts(
    "parts_inspect", lambda n: primitives.inspect(n).select("doc_id", "language", "variables"),
    f"""SELECT {_PART}, 'python' AS language, concat_ws(',', 'ValueError', 'a', CASE WHEN p_size % 4 >= 1 THEN 'b' END, 'c', CASE WHEN p_size % 3 = 2 OR p_size % 4 = 3 THEN 'd' END, CASE WHEN p_size % 2 = 0 THEN 'e' END,
    'flag', 'y', 'ys', 'zs') AS variables FROM part""",
)
KNOWN["parts_round_trip"] = (lambda spark, sf_dir: round_trip(parts_sources(spark, sf_dir)), f"SELECT {_PART}, true AS stable FROM part")
KNOWN["parts_valid_source"] = (lambda spark, sf_dir: valid_source(to_source(read_sources(parts_sources(spark, sf_dir)))), f"SELECT {_PART}, true AS valid FROM part")


def translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ruby trees, one for each supplier, as Python source."""
    tree = F.concat(F.lit('{"type": "send", "children": [{"type": "lvar", "children": ["x"]}, "+", {"type": "int", "children": ['), F.col("s_suppkey").cast("string"), F.lit("]}]}"))
    return translate(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("doc_id"), tree.alias("source")), "ruby")


KNOWN["translate_ruby"] = (translated, "SELECT CAST(s_suppkey AS STRING) AS doc_id, concat('(x + ', CAST(s_suppkey AS STRING), ')', chr(10)) AS source FROM supplier")
over("equivalence", "nations", lambda n: primitives.equivalent(n, n.withColumn("line", F.col("line") + 1)), "SELECT DISTINCT doc_id, true AS equivalent FROM nodes")
_KEY = "CAST(substr(doc_id, 2) AS BIGINT)"
over(
    "equivalence_changed", "nations", lambda n: primitives.equivalent(n, n.withColumn("name", F.when(F.expr(_KEY) % 2 == 0, F.upper("name")).otherwise(F.col("name")))),
    f"SELECT DISTINCT doc_id, {_KEY} % 2 <> 0 AS equivalent FROM nodes",
)
KNOWN["supplemental_matrix"] = (
    lambda spark, sf_dir: supplementals.default().matrix(spark),
    "SELECT * FROM (VALUES ('actor_call', 'pykka'), ('actor_cast', 'pykka'), ('spawn_actor', 'pykka'), ('async_await', 'asyncio'), ('async_context', 'asyncio'), ('gather', 'asyncio')) AS t(construct, python)",
)


over(
    "validation_constraints", "orders", lambda n: metrics.constraints(n, strict=True, max_depth=3, max_variables=1),
    """SELECT doc_id, CASE WHEN native > 0 THEN 'native_constructs_not_allowed' WHEN deep > 3 THEN concat('max_depth_exceeded ', deep, ' > 3') WHEN names > 1 THEN concat('too_many_variables ', names, ' > 1') END AS error
    FROM (SELECT doc_id, count(*) FILTER (type = 'language_specific') AS native, max(depth) + 1 AS deep, count(DISTINCT CASE WHEN type = 'variable' THEN value END) AS names FROM nodes GROUP BY doc_id)""",
)


def nested_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python program for each part, of conditions nested up to six times by the part's size, and its deeply nested conditions."""
    levels = F.col("p_size") % 7
    lines = [F.when(levels > i, F.lit("    " * i + "if a:\n")).otherwise("") for i in range(6)]
    source = F.concat(*lines, F.expr("repeat('    ', p_size % 7)"), F.lit("f()\n"))
    nodes = read_sources(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("doc_id"), source.alias("source")))
    return metrics.nesting_issues(nodes).filter("type = 'conditional'").select("doc_id", "nesting", "severity")


KNOWN["nesting_depth"] = (
    nested_sources,
    f"SELECT {_PART}, CAST(n AS BIGINT) AS nesting, CASE WHEN n >= 5 THEN 'warning' ELSE 'info' END AS severity FROM part, (SELECT unnest([4, 5, 6]) AS n) WHERE n <= p_size % 7",
)


def queries() -> dict[str, Query]:
    from treeline import case_queries as _  # noqa: F401  registers its own

    return {k: q for k, (q, _) in KNOWN.items()}


def oracle_sql() -> dict[str, str]:
    from treeline import case_queries as _  # noqa: F401

    return {k: s for k, (_, s) in KNOWN.items() if s}
