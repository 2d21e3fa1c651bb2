"""The pattern tables of semantic enrichment, by names taken from the reference's domain files."""

from treeline.functions import semantic
from treeline.functions.semantics import REFERENCE
from treeline.sources.trees import block, call, literal, nodes_of, variable

# (language, name): domain, operation, framework
NAMES = {
    ("python", "User.objects.filter"): ("db", "query", "django"),
    ("python", "users.filter_by"): ("db", "query", "sqlalchemy"),
    ("javascript", "User.findByPk"): ("db", "retrieve", "sequelize"),
    ("javascript", "prisma.user.findUnique"): ("db", "retrieve", "prisma"),
    ("python", "httpx.get"): ("http", "get", "httpx"),
    ("javascript", "superagent.get"): ("http", "get", "superagent"),
    ("ruby", "Faraday.get"): ("http", "get", "faraday"),
    ("javascript", "passport.authenticate"): ("auth", "authenticate", "passport"),
    ("ruby", "authenticate_user!"): ("auth", "authenticate", "devise"),
    ("elixir", "Cachex.get"): ("cache", "get", "cachex"),
    ("elixir", "MyApp.Cache.delete"): ("cache", "delete", "nebulex"),
    ("elixir", "Oban.insert"): ("queue", "enqueue", "oban"),
    ("ruby", "HardWorker.perform_async"): ("queue", "enqueue", "sidekiq"),
    ("python", "path.to.read_text"): ("file", "read", "pathlib"),
    ("javascript", "fs.readFile"): ("file", "read", "nodejs_fs"),
    ("python", "a.b.is_dir"): ("file", "exists", "pathlib"),
}


def test_tables_are_whole():
    counts = {}
    for r in REFERENCE:
        counts[r[0]] = counts.get(r[0], 0) + 1
    assert counts == {"db": 145, "http": 172, "auth": 110, "cache": 146, "queue": 110, "file": 159, "external_api": 95}
    assert {"stripe", "twilio", "sendgrid"} <= {r[1] for r in REFERENCE}


def test_names_of_every_domain(spark):
    got = {}
    for language in ("python", "javascript", "ruby", "elixir"):
        n = nodes_of(spark, {"d": block(*[call(name) for of, name in NAMES if of == language])}, language)
        got |= {(language, r.name): (r.op_domain, r.op_operation, r.op_framework) for r in semantic.enrich(n).filter("type = 'function_call'").collect()}
    assert got == NAMES


def test_every_name_without_a_wildcard_is_found():
    """An exact name gives the first row of its language that has it."""
    best = semantic.matcher(list(REFERENCE))
    want = {}
    for r in REFERENCE:
        if not semantic.is_open(r[2]):
            want.setdefault((r[2], r[4]), r)
    assert {k: best(*k) for k in want} == want and len(want) > 700


def test_entities(spark):
    n = nodes_of(spark, {"d": block(call("Repo.get", variable("User")), call("Repo.all", variable("x")), call("Repo.insert", variable("User")), call("File.read", literal("string", "a.txt")))}, "elixir")
    assert [(r.name, r.op_entity) for r in semantic.enrich(n).filter("op_domain IS NOT NULL").orderBy("pre").collect()] == [("Repo.get", "User"), ("Repo.all", None), ("Repo.insert", None), ("File.read", "a.txt")]
    n = nodes_of(spark, {"d": block(call("User.find", literal("integer", 1)))}, "ruby")
    assert semantic.enrich(n).filter("op_domain IS NOT NULL").first().op_entity == "User"
