"""Business-logic analyzers: predicates over a node, what its subtree holds, what came before it and which definition is open.

They read one table, `facts`: the nodes with the groups of columns that the chosen rules need (context, earlier, args, below, siblings, op),
each made by a window or a grouping by document and place. Every rule is then a filter, and running all of them is one pass that explodes an
array of the rules whose predicate holds, not a union of scans. Two rules that look for pairs of nodes are plans of their own.

Sides of joins that grow with the nodes are merged, never broadcast by what the size of compressed files promises.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.functions import rules as R
from treeline.functions.semantic import enrich
from treeline.operators.metrics import is_a
from treeline.plans.axes import has_any, walked, with_context

C = F.col
MOVING = ("variable", "function_call", "attribute_access")
HOLDING = ("attribute_access", "binary_op", "unary_op", "map", "pair", "tuple")


def _joined(text: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_list(F.coalesce(text, F.lit("")))), " ")


def earlier(nodes: DataFrame) -> DataFrame:
    """Flags of what earlier nodes of the document have shown."""
    calls = F.when(is_a("function_call"), C("name"))
    seen = (
        ("validated", calls, R.VALIDATION), ("owned", C("said"), R.OWNERSHIP), ("authorized", C("said"), R.AUTHORIZATION), ("csrf", C("said"), R.CSRF), ("queried", calls, R.QUERY_CALLS),
        ("upload_checked", calls, R.UPLOAD_CHECKS),
    )
    return nodes.withColumns({name: F.coalesce(F.max(F.when(has_any(text, words), 1)).over(walked(-1)), F.lit(0)) == 1 for name, text, words in seen})


def args(nodes: DataFrame) -> DataFrame:
    """Texts of a node's children; `moving` holds the names that reach it as variables, calls and attributes, also through an operator or a map."""
    own = F.when(is_a(*MOVING), C("said"))
    kids = nodes.select("doc_id", "pre", C("parent_pre").alias("up"), "ix", "type", "subtype", "said", "role", "operator", own.alias("own"))
    inner = kids.groupBy(C("doc_id").alias("d"), C("up").alias("u")).agg(_joined(C("own")).alias("inner"), _joined(C("said")).alias("inner_said"))
    kids = kids.join(inner.hint("merge"), (C("doc_id") == C("d")) & (C("pre") == C("u")), "left").drop("d", "u")
    through = F.concat_ws(" ", "own", F.when(is_a(*HOLDING), C("inner")))
    string = is_a("literal") & (C("subtype") == "string")
    text = lambda when: F.max(F.when(when, C("said")))
    concat = is_a("binary_op") & C("operator").isin("concat", "<>", "+", "||")
    g = kids.groupBy(C("doc_id").alias("d"), "up").agg(
        _joined(C("said")).alias("args"), _joined(through).alias("moving"), F.max(F.when(C("ix") == 0, through)).alias("first_moving"), text(C("ix") == 0).alias("first_arg"),
        F.max(F.when(C("ix") == 0, C("type"))).alias("first_type"), F.max(F.when(C("ix") == 0, C("inner"))).alias("first_inner"), F.max(F.when(C("ix") == 0, C("inner_said"))).alias("first_said"), text(string).alias("literal_arg"), F.max(F.when(string, C("ix"))).alias("literal_ix"),
        F.max(F.when(concat, 1)).alias("concat_arg"), F.max(F.when(is_a(*MOVING), 1)).alias("moving_arg"), text(C("type") == "param").alias("a_param"), _joined(F.when(is_a("param"), C("said"))).alias("params"),
        _joined(F.when(is_a("function_def"), C("said"))).alias("definitions"), _joined(F.when(is_a("function_call"), C("said"))).alias("calls"), text(C("role") == "target").alias("target"),
        text((C("role") == "value") & is_a("function_call")).alias("fetched"), text((C("role") == "coll") & is_a("variable")).alias("coll_variable"), text((C("role") == "coll") & is_a("function_call")).alias("coll_call"),
        F.max(F.when((C("ix") == 0) & (C("type") == "literal") & (C("subtype") == "symbol"), C("said"))).alias("first_symbol"), F.max(F.when(C("role") == "coll", C("pre"))).alias("coll_pre"),
    )
    return nodes.join(g.hint("merge"), (C("doc_id") == C("d")) & (C("pre") == C("up")), "left").drop("d", "up")


def below(nodes: DataFrame) -> DataFrame:
    """Texts of the subtrees of definitions, handlers, conditionals and of the functions of collection operations."""
    top = is_a("function_def", "match_arm", "conditional", "lambda")
    tops = nodes.filter(top).select(C("doc_id").alias("d"), C("pre").alias("p"), C("size").alias("s"), C("type").alias("t"), C("parent_pre").alias("up"))
    said = nodes.filter(is_a(*MOVING) | (C("type") == "language_specific")).select(C("doc_id").alias("d2"), C("pre").alias("p2"), C("type").alias("t2"), F.coalesce("said", "kind").alias("said"))
    found = tops.join(said.hint("merge"), (C("d") == C("d2")) & (C("p2") > C("p")) & (C("p2") < C("p") + C("s"))).groupBy("d", "p", "t", "up").agg(
        F.array_join(F.array_sort(F.collect_set("said")), " ").alias("below"), F.array_join(F.array_sort(F.collect_set(F.when(C("t2") != "variable", C("said")))), " ").alias("calls_below")
    )
    out = nodes.join(found.select("d", "p", "below", "calls_below").hint("merge"), (C("doc_id") == C("d")) & (C("pre") == C("p")), "left").drop("d", "p")
    inside = found.filter("t = 'lambda'").groupBy("d", "up").agg(F.max("calls_below").alias("function_calls"))
    return out.join(inside.hint("merge"), (C("doc_id") == C("d")) & (C("pre") == C("up")), "left").drop("d", "up")


def siblings(nodes: DataFrame) -> DataFrame:
    """What stands beside a node: the next sibling, and which of sensitive operations and authorisations comes first."""
    family = Window.partitionBy("doc_id", "parent_pre").orderBy("ix")
    whole = family.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    call = is_a("function_call")
    checks = (call & has_any(C("name"), R.AUTHORIZES)) | (is_a("conditional") & has_any(C("first_moving"), R.AUTHORIZES))
    nodes = nodes.withColumns({"checks": F.coalesce(checks, F.lit(False)), "acts": F.coalesce(call & has_any(C("name"), R.SENSITIVE), F.lit(False))})
    first = lambda when: F.min(F.when(when, C("ix"))).over(whole)
    after = {name: F.lead(column).over(family) for name, column in (("next_type", "type"), ("next_op", "op_type"), ("next_coll", "coll_variable"))}
    return nodes.withColumns({"first_check": first(C("checks") & ~C("acts")), "first_act": first(C("acts")), **after})


GROUPS: dict[str, Callable[[DataFrame], DataFrame]] = {"op": lambda n: enrich(n).drop("op_framework", "op_target", "op_entity"), "context": with_context, "earlier": earlier, "args": args, "below": below, "siblings": siblings}


def facts(nodes: DataFrame, needs: set[str] | None = None) -> DataFrame:
    """The nodes with `said` and the groups of columns that are asked for, all by default."""
    out = nodes.withColumn("said", F.coalesce("name", "value"))
    for name, add in GROUPS.items():
        if needs is None or name in needs:
            out = add(out)
    return out


@dataclass(frozen=True)
class Rule:
    """A rule holds where `when` does; reading `needs` groups of facts. `reference` says what holds instead with compat="reference"."""

    name: str
    category: str
    severity: str
    when: Column | None = None
    needs: tuple[str, ...] = ()
    graver: tuple[Column, str] | None = None
    plan: Callable[[DataFrame], DataFrame] | None = None
    reference: Column | None = field(default=None)


def _name(words: tuple[str, ...]) -> Column:
    return is_a("function_call") & has_any(C("name"), words)


def _exact(words: tuple[str, ...]) -> Column:
    last = F.element_at(F.split(C("name"), r"\."), -1)
    return is_a("function_call") & (C("name").isin(*words) | last.isin(*[w for w in words if "." not in w]))


def _in(words: tuple[str, ...]) -> Column:
    return has_any(C("function_name"), words) | has_any(C("module_name"), words)


def callback_hell(nodes: DataFrame, most: int = 2) -> DataFrame:
    """(doc_id, pre): conditionals with more than `most` levels of conditionals, themselves included, in branches or blocks of branches.

    Only conditionals that are nested deeply enough look for what stands above them; a node of another kind on the way ends a chain.
    """
    above = nodes.filter(~is_a("block")).select("doc_id", "pre", "size", "type")
    deep = nodes.filter(is_a("conditional") & (C("nest") >= most)).select(C("doc_id").alias("d"), C("pre").alias("p"))
    met = deep.join(above.hint("merge"), (C("d") == C("doc_id")) & (C("p") > C("pre")) & (C("p") < C("pre") + C("size"))).groupBy("d", "p")
    chain = met.agg(F.coalesce(F.max(F.when(C("type") != "conditional", C("pre"))), F.lit(-1)).alias("barrier"), F.sort_array(F.collect_list(F.when(is_a("conditional"), C("pre"))), asc=False).alias("over"))
    # over[i] has i + 2 levels down to the deep one.
    chain = chain.select(C("d").alias("doc_id"), F.explode(F.slice(F.filter("over", lambda x: x > C("barrier")), most, 1_000_000)).alias("pre"))
    return chain.distinct()


def toctou(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre): checks with a use of the same resource in a branch, or in one of the five statements after them."""
    last = F.element_at(F.split(C("name"), r"\."), -1)
    kind = lambda table: F.coalesce(*[F.when(C("name").isin(*words) | last.isin(*words), k) for k, words in table.items()])
    kinds = F.filter(F.array(*[F.when(C("name").isin(*words) | last.isin(*words), F.lit(k)) for k, words in R.USES.items()]), lambda x: x.isNotNull())
    # Few calls check or use anything: they are picked first, so that all joins have a small side, which adaptive execution broadcasts.
    calls = nodes.filter(is_a("function_call")).withColumn("checked", kind(R.CHECKS)).withColumn("used", kinds).filter(C("checked").isNotNull() | (F.size("used") > 0))
    calls = calls.select("doc_id", "pre", "size", "role", "ix", "parent_pre", "checked", "used")
    named = nodes.filter(is_a("variable", "literal")).select(C("doc_id").alias("d"), C("parent_pre").alias("u"), "value")
    named = calls.select("doc_id", "pre").join(named.hint("merge"), (C("doc_id") == C("d")) & (C("pre") == C("u"))).groupBy("d", "u").agg(F.collect_set("value").alias("resources"))
    calls = calls.join(named.hint("merge"), (C("doc_id") == C("d")) & (C("pre") == C("u")), "left").drop("d", "u")
    parents = nodes.select(C("doc_id").alias("d"), C("pre").alias("p"), C("type").alias("p_type"), C("parent_pre").alias("p_up"), C("ix").alias("p_ix"), C("role").alias("p_role"), (C("pre") + C("size")).alias("p_end"))
    calls = calls.join(parents.hint("merge"), (C("doc_id") == C("d")) & (C("parent_pre") == C("p"))).drop("d", "p")
    # The statement that a call is, or is the value of.
    value = C("p_type").isin("assignment", "inline_match") & (C("role") == "value")
    calls = calls.withColumn("block", F.when(value, C("p_up")).otherwise(C("parent_pre"))).withColumn("at", F.when(value, C("p_ix")).otherwise(C("ix")))
    calls = calls.withColumn("statement", F.when(value, C("parent_pre")).otherwise(C("pre")))
    uses = calls.filter(F.size("used") > 0).select(C("doc_id").alias("d"), C("pre").alias("u_pre"), C("block").alias("u_block"), C("at").alias("u_at"), "used", C("resources").alias("u_resources"))
    checks = calls.filter("checked IS NOT NULL").select("doc_id", "pre", "size", "role", "checked", "resources", "block", "at", "statement", "parent_pre", "p_type", "p_role", "p_up", "p_end")
    same = F.array_contains("used", C("checked")) & (C("resources").isNull() | F.arrays_overlap("resources", "u_resources"))
    after = checks.join(uses.hint("merge"), (C("doc_id") == C("d")) & (C("block") == C("u_block")) & (C("u_at") > C("at")) & (C("u_at") <= C("at") + 5) & same)
    negated = (C("p_type") == "unary_op") & (C("p_role") == "cond")
    conds = checks.filter((C("role") == "cond") | negated).withColumn("top", F.when(C("role") == "cond", C("parent_pre")).otherwise(C("p_up")))
    ends = nodes.filter(is_a("conditional")).select(C("doc_id").alias("e_d"), C("pre").alias("e_p"), (C("pre") + C("size")).alias("end"))
    conds = conds.join(ends.hint("merge"), (C("doc_id") == C("e_d")) & (C("top") == C("e_p")))
    inside = conds.join(uses.hint("merge"), (C("doc_id") == C("d")) & (C("u_pre") >= C("pre") + C("size")) & (C("u_pre") < C("end")) & same)
    return after.select("doc_id", C("statement").alias("pre")).union(inside.select("doc_id", C("top").alias("pre"))).distinct()


def rules(max_nesting: int = 2) -> list[Rule]:
    text = is_a("literal") & (C("subtype") == "string")
    call, define, cond = is_a("function_call"), is_a("function_def"), is_a("conditional")
    moving = lambda words: has_any(C("moving"), words)
    under = lambda words: has_any(C("below"), words)
    calls = lambda words: has_any(C("calls_below"), words)
    known, domain = C("op_domain").isNotNull(), C("op_domain")
    octet = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
    ip = C("value").rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$") & ~C("value").rlike(r"^(10\.|127\.|0\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.)")
    url = C("value").rlike(r"^https?://[^\s]+$") & ~C("value").rlike(r"^https?://(localhost|127\.0\.0\.1|0\.0\.0\.0)")
    concat = is_a("binary_op") & C("operator").isin("concat", "<>", "+", "||")
    sql = lambda c: has_any(c, R.SQL_WORDS)
    interpolated = lambda c: c.rlike(r"""\$\{|#\{|\{|' \+|" \+|' \|\||" \|\|""")
    path = has_any(C("literal_arg"), ("/", "\\")) | C("literal_arg").rlike(r"^\.|(" + "|".join(re.escape(e) for e in R.PATH_ENDS) + ")$")
    address = C("literal_arg").rlike(r"(?i)https?://|^//|^www\.|://")
    id_like = C("moving").rlike(r"(?i)(\bid\b|_id\b|params)")
    controller = has_any(C("module_name"), R.CONTROLLERS)
    roles = (C("first_type") == "function_call") & C("first_arg").rlike("(?i)role|admin|is_") | C("first_type").isin("binary_op", "attribute_access") & F.concat_ws(" ", "first_arg", "first_inner").rlike("(?i)role|admin")
    owner = F.concat_ws(" ", "first_arg", "first_inner").rlike("(?i)owner|belongs|policy|user_id")
    records = (C("coll_call").isNotNull() & F.when(C("coll_domain").isNotNull(), (C("coll_domain") == "db") & C("coll_operation").isin("retrieve_all", "query")).otherwise(has_any(C("coll_call"), R.QUERIES))) | has_any(C("coll_variable"), R.RECORDS)
    markup = (call & has_any(C("name"), R.UNSAFE_HTML)) | (is_a("assignment") & C("target").rlike("(?i)^(inner|outer)html$")) | (is_a("tuple") & (C("first_symbol") == "safe") & moving(R.HTML_INPUT))
    rendered = call & has_any(C("name"), ("render", "html", "template")) & has_any(C("calls"), R.UNSAFE_HTML)
    saves_upload = define & (has_any(C("name"), ("upload", "import", "attach")) | has_any(C("params"), R.UPLOADS)) & calls(R.FILE_SAVES) & ~calls(R.UPLOAD_CHECKS)
    never = F.lit(False)
    a, o, e = "args", "op", "earlier"
    return [
        Rule("blocking_in_plug", "performance", "warning", call & F.when(known, domain.isin("db", "http", "file", "cache", "external_api", "queue")).otherwise(has_any(C("name"), R.BLOCKING) & ~has_any(C("name"), ("keyword.", "map."))) & _in(R.MIDDLEWARE), (o, "context")),
        Rule("callback_hell", "readability", "warning", plan=lambda n: callback_hell(n, max_nesting)),
        Rule("direct_struct_update", "correctness", "info", is_a("map")),
        Rule("hardcoded_value", "security", "warning", text & (url | ip)),
        Rule("improper_input_validation", "security", "warning", (_name(R.SENSITIVE_ON_INPUT) & moving(R.USER_INPUT) & ~C("validated")) | (define & has_any(C("params"), R.USER_INPUT) & calls(R.SENSITIVE_ON_INPUT) & under(R.USER_INPUT) & ~calls(R.VALIDATION)), (a, e, "below")),
        Rule("incorrect_authorization", "security", "warning", (C("checks") & ~C("acts") & (C("first_act") < C("first_check"))) | (cond & roles & ~owner & has_any(C("function_name"), R.SENSITIVE)), (a, "context", "siblings")),
        Rule("inefficient_filter", "performance", "warning", is_a("assignment", "inline_match") & F.element_at(F.split("fetched", r"\."), -1).isin(*R.FETCH_ALL) & (C("next_type") == "collection_op") & (C("next_op") == "filter") & (C("next_coll") == C("target")), (a, "siblings")),
        Rule("inline_javascript", "security", "error", (text & has_any(C("value"), R.INLINE_SCRIPT)) | _name(R.INJECTORS) | (call & has_any(C("literal_arg"), ("<script>",))), (a,), (call & ~has_any(C("name"), R.INJECTORS), "warning")),
        Rule("insecure_direct_object_reference", "security", "warning", _exact(R.FETCHES) & id_like & ~C("owned"), (a, e)),
        Rule("missing_authentication", "security", "error", (define & has_any(C("name"), R.CRITICAL_ACTIONS) & controller & ~under(R.AUTHENTICATES)) | (is_a("container") & has_any(C("name"), R.CONTROLLERS) & has_any(C("definitions"), R.CRITICAL_ACTIONS) & ~has_any(C("calls"), (*R.AUTHENTICATES, "use"))), (a, "context", "below"), (is_a("container"), "warning")),
        Rule("missing_authorization", "security", "error", (define & has_any(C("name"), R.ACTIONS) & calls(R.SENSITIVE_CALLS) & ~under(R.AUTHORIZATION)) | (_exact(R.SENSITIVE_CALLS) & id_like & ~C("authorized")), (a, e, "below")),
        Rule("missing_csrf_protection", "security", "warning", (call & C("name").isin(*R.CHANGES) & ~C("csrf")) | (define & has_any(C("name"), R.CHANGING_ACTIONS) & has_any(C("module_name"), ("controller", "web", "view")) & ~under(R.CSRF)), (e, "context", "below")),
        Rule("missing_error_handling", "correctness", "warning", is_a("inline_match") & (has_any(C("first_arg"), R.SUCCESS) | has_any(C("first_said"), R.SUCCESS)), (a,), reference=never),
        Rule("missing_handle_async", "reliability", "warning", _exact(R.SPAWNS) & ~has_any(C("function_name"), ("supervis", "await")), ("context",), reference=never),
        Rule("missing_preload", "performance", "warning", ((is_a("collection_op") & (C("op_type") == "map")) | (is_a("loop") & C("loop_type").isin("for", "for_each"))) & records, (a, o, "coll")),
        Rule("missing_telemetry_for_external_http", "maintainability", "info", call & F.when(known, domain == "http").otherwise(has_any(C("name"), ("http", *R.HTTP_WORDS))), (o,)),
        Rule("missing_telemetry_in_auth_plug", "security", "warning", cond & _in(R.AUTH_WORDS) & ~under(R.TELEMETRY), ("context", "below"), reference=never),
        Rule("missing_telemetry_in_liveview_mount", "observability", "info", define & has_any(C("name"), R.LIFECYCLE) & ~under(R.TELEMETRY), ("context", "below"), reference=has_any(C("function_name"), R.LIFECYCLE)),
        Rule("missing_telemetry_in_oban_worker", "observability", "info", define & (has_any(C("name"), R.JOBS) | has_any(C("module_name"), R.JOBS)) & ~under(R.TELEMETRY), ("context", "below"), reference=_in(R.JOBS)),
        Rule("missing_throttle", "security", "warning", _name(R.EXPENSIVE) & _in(R.ENDPOINTS) & ~_in(R.THROTTLES), ("context",), reference=never),
        Rule("n_plus_one_query", "performance", "warning", is_a("collection_op") & C("op_type").isin("map", "each", "flat_map", "reduce") & has_any(C("function_calls"), R.DATABASE_WORDS), ("below",)),
        Rule("path_traversal", "security", "error", ((_name(R.FILE_CALLS) | _name(R.PATH_CALLS)) & moving(R.PATH_INPUT)) | (is_a("binary_op") & C("operator").isin("concat", "<>", "+", "/") & path & moving(R.PATH_INPUT)), (a,), (_name(R.PATH_CALLS) & ~_name(R.FILE_CALLS), "warning")),
        Rule("sensitive_data_exposure", "security", "warning", (_exact(R.LOGS) & moving(R.SECRET_FIELDS)) | (call & C("name").isin("inspect", "Kernel.inspect", "toString", "to_string", "__str__", "str", "repr") & (C("n_children") == 1) & has_any(C("first_arg"), R.SECRET_OBJECTS) & C("first_type").isin("variable", "attribute_access")), (a,)),
        Rule("silent_error_case", "correctness", "warning", cond & (C("n_children") == 2) & has_any(C("first_arg"), R.SUCCESS), (a,), reference=never),
        Rule("sql_injection", "security", "error", (concat & sql(C("literal_arg")) & (C("moving_arg") == 1)) | (_name(R.QUERY_CALLS) & ((C("concat_arg") == 1) | (sql(C("literal_arg")) & interpolated(C("literal_arg"))))) | (text & sql(C("value")) & interpolated(C("value")) & C("queried")), (a, e)),
        Rule("ssrf_vulnerability", "security", "error", (call & (F.when(known, domain == "http").otherwise(never) | _exact(R.HTTP_CLIENTS)) & has_any(C("first_moving"), R.URL_INPUT)) | (_exact(R.URL_BUILDERS) & moving(R.URL_INPUT)) | (concat & address & moving(R.URL_INPUT)), (a, o), (_exact(R.URL_BUILDERS), "warning")),
        Rule("swallowing_exception", "correctness", "warning", is_a("match_arm") & (C("role") == "handler") & ~calls(R.LOGS_OR_RAISES), ("below",)),
        Rule("sync_over_async", "performance", "warning", _name(R.BLOCKS) & has_any(C("function_name"), R.ASYNC_WORDS), ("context",)),
        Rule("telemetry_in_recursive_function", "performance", "warning", define & F.array_contains(F.split(F.coalesce("calls_below", F.lit("")), " "), C("name")) & calls(R.TELEMETRY_CALLS), ("below",)),
        Rule("toctou", "security", "warning", plan=toctou),
        Rule("unmanaged_task", "correctness", "warning", _exact(R.TASKS), reference=never),
        Rule("unrestricted_file_upload", "security", "error", (_name(R.FILE_SAVES) & moving(R.UPLOADS) & ~C("upload_checked")) | saves_upload, (a, e, "below"), (call, "warning")),
        Rule("xss_vulnerability", "security", "error", markup | rendered, (a,), (call & ~rendered & ~moving(R.HTML_INPUT), "warning")),
    ]


def _collections(nodes: DataFrame) -> DataFrame:
    """coll_domain and coll_operation: what kind of operation the collection of a loop or a collection operation is."""
    kinds = nodes.filter("op_domain IS NOT NULL").select(C("doc_id").alias("d"), C("pre").alias("p"), C("op_domain").alias("coll_domain"), C("op_operation").alias("coll_operation"))
    return nodes.join(kinds.hint("merge"), (C("doc_id") == C("d")) & (C("coll_pre") == C("p")), "left").drop("d", "p")


GROUPS["coll"] = _collections


def analyze(nodes: DataFrame, only: tuple[str, ...] | None = None, max_issues: int | None = None, max_nesting: int = 2, compat: str | None = None) -> DataFrame:
    """(doc_id, pre, line, analyzer, category, severity, function_name) of every rule that holds, at most max_issues for each document in order of place.

    With compat="reference" rules that can't hold on uniform nodes never do, and those that hold on every node of a definition do so.
    """
    chosen = [r for r in rules(max_nesting) if only is None or r.name in only]
    when = lambda r: r.when if compat != "reference" or r.reference is None else r.reference
    grade = lambda r: F.when(F.coalesce(r.graver[0], F.lit(False)), r.graver[1]).otherwise(r.severity) if r.graver else F.lit(r.severity)
    columns = ["doc_id", "pre", "line", "analyzer", "category", "severity", "function_name"]
    parts = []
    filters = [r for r in chosen if r.plan is None]
    if filters:
        hit = lambda r: F.struct(F.lit(r.name).alias("analyzer"), F.lit(r.category).alias("category"), grade(r).alias("severity"))
        hits = F.array_compact(F.array(*[F.when(F.coalesce(when(r), F.lit(False)), hit(r)) for r in filters]))
        found = facts(nodes, {"context"} | {g for r in filters for g in r.needs}).select("doc_id", "pre", "line", "function_name", F.explode(hits).alias("i"))
        parts.append(found.select("doc_id", "pre", "line", "i.analyzer", "i.category", "i.severity", "function_name"))
    for r in chosen:
        if r.plan is not None:
            places = r.plan(nodes).select(C("doc_id").alias("d"), C("pre").alias("p"))
            held = with_context(nodes).join(places.hint("merge"), (C("doc_id") == C("d")) & (C("pre") == C("p")))
            parts.append(held.select("doc_id", "pre", "line", F.lit(r.name).alias("analyzer"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), "function_name"))
    if not parts:
        return with_context(nodes.limit(0)).select("doc_id", "pre", "line", *[F.lit("").alias(c) for c in columns[3:6]], "function_name")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    if max_issues is not None:
        order = Window.partitionBy("doc_id").orderBy("pre", "analyzer")
        out = out.withColumn("n", F.row_number().over(order)).filter(C("n") <= max_issues).drop("n")
    return out
