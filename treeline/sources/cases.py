"""Small programs with known findings, one set for each row of a table: sources for queries whose answers can be stated one by one."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.sources.trees import read_sources


def tree(type_: str, *children: Any, value: Any = None, role: str | None = None, **meta: Any) -> dict[str, Any]:
    """A node of a JSON tree."""
    return {"type": type_, "children": list(children), "value": value, "role": role, "meta": meta}


def name(x: str, role: str | None = None) -> dict[str, Any]:
    return tree("variable", value=x, role=role)


_MATCH_OK = tree("inline_match", tree("tuple", tree("literal", value="ok", subtype="symbol"), name("x")), tree("function_call", name="load"))
_OK_CONDITION = tree("conditional", tree("literal", value="ok", subtype="symbol", role="cond"), name("x", "then"))
_SAFE = tree("tuple", tree("literal", value="safe", subtype="symbol"), name("params"))
_UNSAFE = tree("tuple", tree("literal", value="safe", subtype="symbol"), name("title"))

#: {rule: {case: program}}: a text is Python, a dict a tree. Cases whose name begins with "fires" have the finding of their rule.
BUSINESS: dict[str, dict[str, str | dict[str, Any]]] = {
    "blocking_in_plug": {
        "fires_by_kind": "class AuthPlug:\n    def call(conn):\n        requests.get(conn)",
        "fires_by_name": "def my_middleware(x):\n    time.sleep(1)",
        "quiet_elsewhere": "def page(x):\n    time.sleep(1)",
        "quiet_by_kind": "def my_middleware(x):\n    stats.add(1)",
    },
    "callback_hell": {
        "fires_three": "if a:\n    if b:\n        if c:\n            f()",
        "fires_in_blocks": "if a:\n    g()\n    if b:\n        g()\n        if c:\n            f()",
        "quiet_two": "if a:\n    if b:\n        f()",
        "quiet_through_loop": "if a:\n    for x in y:\n        if b:\n            if c:\n                f()",
    },
    "direct_struct_update": {"fires": "x = {'a': 1}", "quiet": "x = ['a', 1]"},
    "hardcoded_value": {"fires_url": "x = 'https://example.com/a'", "fires_ip": "x = '8.8.8.8'", "quiet_local": "x = 'http://localhost:4000'", "quiet_private": "x = '192.168.1.1'", "quiet_text": "x = 'see https://example.com for more'"},
    "improper_input_validation": {
        "fires_call": "insert(params)",
        "fires_definition": "def store(user_input):\n    x = user_input\n    insert(x, user_input.name)",
        "quiet_validated": "validate(params)\ninsert(params)",
        "quiet_definition": "def store(user_input):\n    validate(user_input)\n    insert(user_input)",
    },
    "incorrect_authorization": {
        "fires_after": "def f(x):\n    delete_all(x)\n    authorize(x)",
        "fires_role_only": "def delete_page(x):\n    if is_admin(x):\n        f(x)",
        "quiet_before": "def f(x):\n    authorize(x)\n    delete_all(x)",
        "quiet_owner": "def delete_page(x):\n    if is_owner(x):\n        f(x)",
        "quiet_first": "def f(x):\n    g(x)\n    authorize(x)",
    },
    "inefficient_filter": {
        "fires": "xs = Repo.all(q)\n[x for x in xs if x.a]",
        "quiet_other_variable": "xs = Repo.all(q)\n[x for x in ys if x.a]",
        "quiet_apart": "xs = Repo.all(q)\nf(xs)\n[x for x in xs if x.a]",
        "quiet_map": "xs = Repo.all(q)\n[x.a for x in xs]",
    },
    "inline_javascript": {"fires_literal": "x = '<script>a()</script>'", "fires_injector": "javascript_tag(x)", "fires_argument": "f('a <SCRIPT> b')", "quiet": "x = 'no script'"},
    "insecure_direct_object_reference": {"fires": "Post.find(params)", "quiet_owned": "x = current_user\nPost.find(params)", "quiet_constant": "Post.find('all')"},
    "missing_authentication": {
        "fires_definition": "class PageController:\n    def delete(x):\n        f(x)",
        "fires_container": "class OrdersApi:\n    def export(x):\n        authenticate(x)",
        "quiet_module_auth": "class OrdersApi:\n    require_login()\n    def export(x):\n        authenticate(x)",
        "quiet_elsewhere": "class Page:\n    def delete(x):\n        f(x)",
    },
    "missing_authorization": {"fires_definition": "def update(x):\n    Repo.update(x)", "fires_call": "Repo.delete(post_id)", "quiet_definition": "def update(x):\n    authorize(x)\n    Repo.update(x)", "quiet_call": "check_role(r)\nrole(x)\nRepo.delete(post_id)"},
    "missing_csrf_protection": {"fires_call": "post(x)", "fires_definition": "class PageController:\n    def create(x):\n        f(x)", "quiet_call": "csrf_token(x)\npost(x)", "quiet_definition": "class PageController:\n    def create(x):\n        verify_authenticity_token(x)", "quiet_name": "http.post(x)"},
    "missing_error_handling": {"fires": _MATCH_OK, "quiet": tree("inline_match", name("y"), tree("function_call", name="load"))},
    "missing_handle_async": {"fires": "asyncio.create_task(x)", "quiet": "def supervise(x):\n    asyncio.create_task(x)"},
    "missing_preload": {
        "fires_call": "[p.author for p in Post.where(x)]",
        "fires_loop": "for p in Repo.all(q):\n    f(p)",
        "fires_variable": "for p in users:\n    f(p)",
        "quiet_by_kind": "for p in Repo.get(q):\n    f(p)",
        "quiet_variable": "for p in things:\n    f(p)",
    },
    "missing_telemetry_for_external_http": {"fires_by_kind": "requests.get(x)", "fires_by_name": "client.fetch_page(x)", "quiet_by_kind": "Repo.get(x)", "quiet": "f(x)"},
    "missing_telemetry_in_auth_plug": {"fires": "def check_login(x):\n    if x:\n        f(x)", "quiet_telemetry": "def check_login(x):\n    if x:\n        telemetry(x)", "quiet_elsewhere": "def page(x):\n    if x:\n        f(x)"},
    "missing_telemetry_in_liveview_mount": {"fires": "def mount(x):\n    f(x)", "quiet_telemetry": "def mount(x):\n    emit(x)", "quiet_elsewhere": "def page(x):\n    f(x)"},
    "missing_telemetry_in_oban_worker": {"fires": "def perform(x):\n    f(x)", "fires_module": "class MailWorker:\n    def go(x):\n        f(x)", "quiet_telemetry": "def perform(x):\n    metric(x)", "quiet_elsewhere": "def page(x):\n    f(x)"},
    "missing_throttle": {"fires": "def export_action(x):\n    generate(x)", "quiet_throttled": "def throttle_action(x):\n    generate(x)", "quiet_elsewhere": "def page(x):\n    generate(x)"},
    "n_plus_one_query": {"fires": "[Repo.get(x) for x in xs]", "quiet_collection": "[f(x) for x in Repo.get(xs)]", "quiet": "[f(x) for x in xs]"},
    "path_traversal": {
        "fires_call": "open(filename)",
        "fires_nested": "open(base + params)",
        "fires_concat": "x = '/var/data/' + user",
        "fires_path": "os.path.abspath(params)",
        "quiet_constant": "open('a')",
        "quiet_concat": "x = 'abc' + user",
        "quiet_other": "x = '/var/data/' + part",
    },
    "sensitive_data_exposure": {"fires_log": "logger.info(password)", "fires_attribute": "print(x.token)", "fires_object": "str(user)", "quiet_log": "logger.info(title)", "quiet_object": "str(title)", "quiet_call": "save(password)"},
    "silent_error_case": {"fires": _OK_CONDITION, "quiet": tree("conditional", name("ready", "cond"), name("x", "then"))},
    "sql_injection": {
        "fires_concat": "x = 'SELECT * FROM t WHERE a = ' + b",
        "fires_query": "db.query(a + b)",
        "fires_interpolated": "f('a')\nexecute(x)\ny = 'DELETE FROM t WHERE a = ${b}'",
        "fires_f_string": "cursor.execute(f'SELECT {a}')",
        "quiet_constant": "x = 'SELECT 1'",
        "quiet_words": "x = 'hello ' + b",
        "quiet_query": "db.query('SELECT 1', b)",
    },
    "ssrf_vulnerability": {
        "fires_call": "requests.get(params)",
        "fires_attribute": "requests.get(request.args)",
        "fires_builder": "build_url(host)",
        "fires_concat": "x = 'https://example.com/' + target",
        "quiet_second": "requests.get(a, params)",
        "quiet_constant": "requests.get('https://example.com')",
        "quiet_concat": "x = 'https://example.com/' + part",
    },
    "swallowing_exception": {"fires": "try:\n    f()\nexcept E:\n    g()", "quiet_log": "try:\n    f()\nexcept E:\n    logger.error(x)", "quiet_raise": "try:\n    f()\nexcept E:\n    raise"},
    "sync_over_async": {"fires": "def handle_it(x):\n    time.sleep(1)", "quiet": "def page(x):\n    time.sleep(1)"},
    "telemetry_in_recursive_function": {"fires": "def walk(x):\n    emit(x)\n    walk(x)", "quiet_flat": "def walk(x):\n    emit(x)", "quiet_silent": "def walk(x):\n    f(x)\n    walk(x)"},
    "toctou": {
        "fires_branch": "if os.path.exists(p):\n    open(p)",
        "fires_negated": "if not os.path.exists(p):\n    f()\nelse:\n    open(p)",
        "fires_sequence": "ok = os.path.exists(p)\nf()\ng()\nx = open(p)",
        "quiet_resource": "if os.path.exists(p):\n    open(q)",
        "quiet_far": "ok = os.path.exists(p)\na()\nb()\nc()\nd()\ne()\nopen(p)",
        "quiet_kind": "if is_connected(p):\n    open(p)",
        "quiet_before": "open(p)\nok = os.path.exists(p)",
    },
    "unmanaged_task": {"fires": "loop.run_in_executor(x)", "quiet": "loop.run(x)"},
    "unrestricted_file_upload": {
        "fires_call": "save(upload)",
        "fires_definition": "def handle_upload(x):\n    store(x)",
        "quiet_call": "check_file(upload)\nsave(upload)",
        "quiet_definition": "def handle_upload(x):\n    content_type(x)\n    store(x)",
        "quiet_other": "save(title)",
    },
    "xss_vulnerability": {
        "fires_call": "mark_safe(params)",
        "fires_plain": "mark_safe(title)",
        "fires_render": "render_page(Markup(title))",
        "fires_assignment": "element.innerHTML = title",
        "fires_tuple": _SAFE,
        "quiet_tuple": _UNSAFE,
        "quiet_render": "render_page(title)",
        "quiet_assignment": "element.text = title",
    },
}


def programs(cases: dict[str, dict[str, str | dict[str, Any]]]) -> list[tuple[str, str, str]]:
    """(set/case, language, source) of every program."""
    return [(f"{s}/{c}", "python" if isinstance(x, str) else "json", x if isinstance(x, str) else json.dumps(x)) for s, found in cases.items() for c, x in found.items()]


def sources_over_nations(spark: SparkSession, sf_dir: str, sources: dict[str, str]) -> DataFrame:
    """(doc_id, source) of every source text for each nation; documents are named key/case."""
    known = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in sources.items()])
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.explode(known).alias("p"))
    return rows.select(F.concat_ws("/", F.col("n_nationkey").cast("string"), "p.k").alias("doc_id"), F.col("p.v").alias("source"))


def over_nations(spark: SparkSession, sf_dir: str, cases: dict[str, dict[str, str | dict[str, Any]]]) -> DataFrame:
    """The nodes of every program for each nation: the documents are named key/set/case."""
    known = [F.struct(*[F.lit(x).alias(k) for k, x in zip(("case", "language", "source"), p, strict=True)]) for p in programs(cases)]
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.explode(F.array(*known)).alias("p"))
    rows = rows.select(F.concat_ws("/", F.col("n_nationkey").cast("string"), "p.case").alias("doc_id"), "p.language", "p.source")
    return read_sources(rows.filter("language = 'python'"), "python").union(read_sources(rows.filter("language = 'json'"), "json"))


def answers(rows: list[tuple], columns: str) -> str:
    """SQL: the rows, each for every nation, with doc_id made of the nation's key and the first value."""
    said = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"
    values = ", ".join("(" + ", ".join(map(said, r)) + ")" for r in rows)
    names = columns.split(", ")
    more = "".join(f", {c}" for c in names[1:])
    return f"SELECT concat(CAST(n_nationkey AS VARCHAR), '/', {names[0]}) AS doc_id{more} FROM nation, (VALUES {values}) AS v({columns})"
