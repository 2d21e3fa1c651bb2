"""Programs derived from the test tables in closed form: a row joined to a constant template, in SQL that any engine can run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeline.storage import once

_COLS = "doc_id, pre, parent_pre, ix, depth, size, n_children, role, type, subtype, value, category, operator, name, op_type, loop_type, container_type, visibility, kind, language, line, nest, in_meta"


def _template(rows: str) -> str:
    """rows: k | parent k or - | ix | depth | size | children | role | type | subtype | value | category | operator | name | nest, one line each."""
    out = []
    for line in rows.strip().splitlines():
        c = [x.strip() for x in line.split("|")]
        text = lambda x: "NULL" if x == "-" else f"'{x}'"
        out.append("(" + ", ".join([c[0], "-1" if c[1] == "-" else c[1], *c[2:6], *map(text, c[6:13]), c[13]]) + ")")
    return "(VALUES " + ", ".join(out) + ") AS t(k, pk, ix, depth, size, n_children, role, type, subtype, value, category, operator, name, nest)"


ORDER_STEP = 16
ORDER_TEMPLATE = _template("""
0 | - | 0 | 1 | 14 | 3 | - | conditional | - | - | - | - | - | 0
1 | 0 | 0 | 2 | 3 | 2 | cond | binary_op | - | - | comparison | > | - | 0
2 | 1 | 0 | 3 | 1 | 0 | - | variable | - | discount | - | - | - | 0
3 | 1 | 1 | 3 | 1 | 0 | - | literal | float | 0.05 | - | - | - | 0
4 | 0 | 1 | 2 | 7 | 2 | then | assignment | - | - | - | - | - | 1
5 | 4 | 0 | 3 | 1 | 0 | target | variable | - | total | - | - | - | 1
6 | 4 | 1 | 3 | 5 | 2 | value | binary_op | - | - | arithmetic | * | - | 1
7 | 6 | 0 | 4 | 1 | 0 | - | variable | - | price | - | - | - | 1
8 | 6 | 1 | 4 | 3 | 2 | - | binary_op | - | - | arithmetic | - | - | 1
9 | 8 | 0 | 5 | 1 | 0 | - | literal | integer | ? | - | - | - | 1
10 | 8 | 1 | 5 | 1 | 0 | - | variable | - | discount | - | - | - | 1
11 | 0 | 2 | 2 | 3 | 2 | else | assignment | - | - | - | - | - | 1
12 | 11 | 0 | 3 | 1 | 0 | target | variable | - | total | - | - | - | 1
13 | 11 | 1 | 3 | 1 | 0 | value | variable | - | price | - | - | - | 1
14 | - | 1 | 1 | 2 | 1 | - | ? | - | - | - | - | - | 0
15 | 14 | 0 | 2 | 1 | 0 | - | variable | - | total | - | - | - | 0
""").replace("'arithmetic', NULL, NULL, 1)", "'arithmetic', '-', NULL, 1)")

#: An order is a block; each of its lines adds a conditional assignment and a call, or a return for returned lines.
ORDERS = f"""
g_line AS (
  SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS r
  FROM lineitem),
g_t AS (SELECT * FROM {ORDER_TEMPLATE}),
nodes AS (
  SELECT concat('o', CAST(l_orderkey AS STRING)) AS doc_id, CAST(0 AS BIGINT) AS pre, CAST(-1 AS BIGINT) AS parent_pre, 0 AS ix, 0 AS depth, CAST(1 + {ORDER_STEP} * count(*) AS INT) AS size, CAST(2 * count(*) AS INT) AS n_children,
    CAST(NULL AS STRING) AS role, 'block' AS type, CAST(NULL AS STRING) AS subtype, CAST(NULL AS STRING) AS value, CAST(NULL AS STRING) AS category, CAST(NULL AS STRING) AS operator, CAST(NULL AS STRING) AS name,
    CAST(NULL AS STRING) AS op_type, CAST(NULL AS STRING) AS loop_type, CAST(NULL AS STRING) AS container_type, CAST(NULL AS STRING) AS visibility, CAST(NULL AS STRING) AS kind, 'python' AS language, 0 AS line, 0 AS nest, false AS in_meta
  FROM g_line GROUP BY l_orderkey
  UNION ALL
  SELECT concat('o', CAST(l_orderkey AS STRING)), CAST(1 + {ORDER_STEP} * r + k AS BIGINT), CAST(CASE WHEN pk < 0 THEN 0 ELSE 1 + {ORDER_STEP} * r + pk END AS BIGINT), CAST(CASE WHEN pk < 0 THEN 2 * r + ix ELSE ix END AS INT), depth, size, n_children,
    role, CASE WHEN k = 14 THEN CASE WHEN l_returnflag = 'R' THEN 'early_return' ELSE 'function_call' END ELSE type END, subtype, CASE WHEN k = 9 THEN CAST(l_linenumber AS STRING) ELSE value END, category, operator,
    CASE WHEN k = 14 AND l_returnflag <> 'R' THEN 'print' ELSE name END, NULL, NULL, NULL, NULL, CASE WHEN k = 14 AND l_returnflag = 'R' THEN 'return' END, 'python', CAST(r + 1 AS INT), nest, false
  FROM g_line CROSS JOIN g_t)"""

#: The template with the block as its first row and the call as three rows: w says for which flags a row stands (1: returned, 0: others, 2: none;
#: -1: all), so that types and names are columns of a constant table and what a plan doesn't look for is left out of it.
_ORDER_PARTS = f"""
SELECT -1 AS k, -1 AS pk, 0 AS ix, 0 AS depth, 1 AS size, 0 AS n_children, CAST(NULL AS STRING) AS role, 'block' AS type, CAST(NULL AS STRING) AS subtype, CAST(NULL AS STRING) AS value, CAST(NULL AS STRING) AS category, CAST(NULL AS STRING) AS operator, CAST(NULL AS STRING) AS name, 0 AS nest, -1 AS w, CAST(NULL AS STRING) AS kind
UNION ALL SELECT *, -1, NULL FROM {ORDER_TEMPLATE} WHERE k <> 14
UNION ALL SELECT k, pk, ix, depth, size, n_children, role, call, subtype, value, category, operator, called, nest, f, ended FROM {ORDER_TEMPLATE}
  CROSS JOIN (VALUES (1, 'early_return', CAST(NULL AS STRING), 'return'), (0, 'function_call', 'print', NULL), (2, 'function_call', NULL, NULL)) AS c(f, call, called, ended) WHERE k = 14"""

#: The same nodes from windows over lines and one join with the template, so that they stay dealt by document: groupings and windows by doc_id
#: that follow move no row again. One line of an order makes its block. Only r, the order of lines, needs the columns that decide between equal
#: line numbers: a plan that asks for no place shuffles the document, the line number and the kind of flag alone. The inner window's order begins
#: with the outer one's, so that both need one sort.
ORDER_NODES = f"""
SELECT /*+ BROADCAST(g_t) */ doc_id, CAST(CASE WHEN k < 0 THEN 0 ELSE 1 + {ORDER_STEP} * r + k END AS BIGINT) AS pre, CAST(CASE WHEN k < 0 THEN -1 WHEN pk < 0 THEN 0 ELSE 1 + {ORDER_STEP} * r + pk END AS BIGINT) AS parent_pre,
  CAST(CASE WHEN k >= 0 AND pk < 0 THEN 2 * r + ix ELSE ix END AS INT) AS ix, depth, CAST(CASE WHEN k < 0 THEN 1 + {ORDER_STEP} * n ELSE size END AS INT) AS size, CAST(CASE WHEN k < 0 THEN 2 * n ELSE n_children END AS INT) AS n_children,
  role, type, subtype, CASE WHEN k = 9 THEN CAST(l_linenumber AS STRING) ELSE value END AS value, category, operator, name,
  CAST(NULL AS STRING) AS op_type, CAST(NULL AS STRING) AS loop_type, CAST(NULL AS STRING) AS container_type, CAST(NULL AS STRING) AS visibility,
  kind, 'python' AS language, CAST(CASE WHEN k < 0 THEN 0 ELSE r + 1 END AS INT) AS line, nest, false AS in_meta
FROM (
  SELECT doc_id, l_linenumber, flag, r, row_number() OVER (PARTITION BY doc_id ORDER BY l_linenumber) = 1 AS one, count(*) OVER (PARTITION BY doc_id) AS n
  FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS r
    FROM (SELECT concat('o', CAST(l_orderkey AS STRING)) AS doc_id, CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag IS NULL THEN 2 ELSE 0 END AS flag, * FROM {{lineitem}}))) g_line
JOIN ({_ORDER_PARTS}) g_t ON (k >= 0 OR one) AND (w < 0 OR w = flag)"""

#: A user is a block of calls in order of time, each with one argument.
EVENTS = """
g_call AS (
  SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'Repo.get' WHEN 'click' THEN 'requests.get' WHEN 'purchase' THEN 'Repo.insert' WHEN 'signup' THEN 'User.create' ELSE 'eval' END AS api,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r
  FROM events),
nodes AS (
  SELECT concat('u', CAST(user_id AS STRING)) AS doc_id, CAST(0 AS BIGINT) AS pre, CAST(-1 AS BIGINT) AS parent_pre, 0 AS ix, 0 AS depth, CAST(1 + 2 * count(*) AS INT) AS size, CAST(count(*) AS INT) AS n_children,
    CAST(NULL AS STRING) AS role, 'block' AS type, CAST(NULL AS STRING) AS subtype, CAST(NULL AS STRING) AS value, CAST(NULL AS STRING) AS category, CAST(NULL AS STRING) AS operator, CAST(NULL AS STRING) AS name,
    CAST(NULL AS STRING) AS op_type, CAST(NULL AS STRING) AS loop_type, CAST(NULL AS STRING) AS container_type, CAST(NULL AS STRING) AS visibility, CAST(NULL AS STRING) AS kind, 'python' AS language, 0 AS line, 0 AS nest, false AS in_meta
  FROM g_call GROUP BY user_id
  UNION ALL
  SELECT concat('u', CAST(user_id AS STRING)), CAST(1 + 2 * r AS BIGINT), CAST(0 AS BIGINT), CAST(r AS INT), 1, 2, 1, NULL, 'function_call', NULL, NULL, NULL, NULL, api, NULL, NULL, NULL, NULL, NULL, 'python', CAST(r + 1 AS INT), 0, false FROM g_call
  UNION ALL
  SELECT concat('u', CAST(user_id AS STRING)), CAST(2 + 2 * r AS BIGINT), CAST(1 + 2 * r AS BIGINT), 0, 2, 1, 0, 'arg', CASE WHEN event_id % 2 = 0 THEN 'literal' ELSE 'variable' END,
    CASE WHEN event_id % 2 = 0 THEN 'string' END, CASE WHEN event_id % 2 = 0 THEN 'key' WHEN event_id % 3 = 0 THEN 'params' ELSE 'user_id' END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'python', CAST(r + 1 AS INT), 0, false FROM g_call)"""

#: A page is a block of two string literals, its address and its markup.
PAGES = """
nodes AS (
  SELECT concat('p', CAST(page_id AS STRING)) AS doc_id, CAST(k AS BIGINT) AS pre, CAST(CASE WHEN k = 0 THEN -1 ELSE 0 END AS BIGINT) AS parent_pre, CASE WHEN k = 0 THEN 0 ELSE k - 1 END AS ix, CASE WHEN k = 0 THEN 0 ELSE 1 END AS depth,
    CASE WHEN k = 0 THEN 3 ELSE 1 END AS size, CASE WHEN k = 0 THEN 2 ELSE 0 END AS n_children, CAST(NULL AS STRING) AS role, CASE WHEN k = 0 THEN 'block' ELSE 'literal' END AS type, CASE WHEN k > 0 THEN 'string' END AS subtype,
    CASE k WHEN 1 THEN url WHEN 2 THEN html END AS value, CAST(NULL AS STRING) AS category, CAST(NULL AS STRING) AS operator, CAST(NULL AS STRING) AS name, CAST(NULL AS STRING) AS op_type, CAST(NULL AS STRING) AS loop_type,
    CAST(NULL AS STRING) AS container_type, CAST(NULL AS STRING) AS visibility, CAST(NULL AS STRING) AS kind, 'python' AS language, 0 AS line, 0 AS nest, false AS in_meta
  FROM pages CROSS JOIN (VALUES (0), (1), (2)) AS t(k))"""

#: A nation is a class; a market segment of its customers is a method that touches one attribute for each customer.
NATIONS = """
g_use AS (SELECT DISTINCT c_nationkey, c_mktsegment, CAST(c_custkey % 4 AS STRING) AS a FROM customer),
g_m AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM g_use GROUP BY c_nationkey, c_mktsegment),
g_mm AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) - 1 AS r, coalesce(sum(1 + 2 * n) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM g_m),
g_a AS (SELECT u.c_nationkey, u.c_mktsegment, a, base, row_number() OVER (PARTITION BY u.c_nationkey, u.c_mktsegment ORDER BY a) - 1 AS i FROM g_use u JOIN g_mm m ON u.c_nationkey = m.c_nationkey AND u.c_mktsegment = m.c_mktsegment),
nodes AS (
  SELECT concat('n', CAST(c_nationkey AS STRING)) AS doc_id, CAST(0 AS BIGINT) AS pre, CAST(-1 AS BIGINT) AS parent_pre, 0 AS ix, 0 AS depth, CAST(1 + sum(1 + 2 * n) AS INT) AS size, CAST(count(*) AS INT) AS n_children,
    CAST(NULL AS STRING) AS role, 'container' AS type, CAST(NULL AS STRING) AS subtype, CAST(NULL AS STRING) AS value, CAST(NULL AS STRING) AS category, CAST(NULL AS STRING) AS operator, concat('N', CAST(c_nationkey AS STRING)) AS name,
    CAST(NULL AS STRING) AS op_type, CAST(NULL AS STRING) AS loop_type, 'class' AS container_type, CAST(NULL AS STRING) AS visibility, CAST(NULL AS STRING) AS kind, 'python' AS language, 0 AS line, 0 AS nest, false AS in_meta
  FROM g_m GROUP BY c_nationkey
  UNION ALL
  SELECT concat('n', CAST(c_nationkey AS STRING)), CAST(1 + base AS BIGINT), CAST(0 AS BIGINT), CAST(r AS INT), 1, CAST(1 + 2 * n AS INT), CAST(n AS INT), 'body', 'function_def', NULL, NULL, NULL, NULL, lower(c_mktsegment), NULL, NULL, NULL,
    CASE WHEN r % 2 = 0 THEN 'public' ELSE 'private' END, NULL, 'python', CAST(r + 1 AS INT), 0, false FROM g_mm
  UNION ALL
  SELECT concat('n', CAST(c_nationkey AS STRING)), CAST(2 + base + 2 * i AS BIGINT), CAST(1 + base AS BIGINT), CAST(i AS INT), 2, 2, 1, 'body', 'attribute_access', NULL, NULL, NULL, NULL, concat('a', a), NULL, NULL, NULL, NULL, NULL, 'python', 0, 0, false FROM g_a
  UNION ALL
  SELECT concat('n', CAST(c_nationkey AS STRING)), CAST(3 + base + 2 * i AS BIGINT), CAST(2 + base + 2 * i AS BIGINT), 0, 3, 1, 0, NULL, 'variable', NULL, 'self', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'python', 0, 0, false FROM g_a)"""

TABLES = {"orders": ("lineitem", ORDERS), "events": ("events", EVENTS), "pages": ("pages", PAGES), "nations": ("customer", NATIONS)}


def corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The node relation of a derived corpus. Orders have 16 nodes a line and are made anew by each query, dealt by document; the others are built once for each folder of tables and read by all queries over them."""
    source, sql = TABLES[name]
    if name == "orders":
        return spark.sql(ORDER_NODES, lineitem=spark.read.parquet(f"{sf_dir}/{source}.parquet"))
    nodes = spark.sql(f"WITH {sql} SELECT {_COLS} FROM nodes".replace(f"FROM {source}", f"FROM {{{source}}}"), **{source: spark.read.parquet(f"{sf_dir}/{source}.parquet")})
    return once(f"{name} of {sf_dir}", nodes, "doc_id", "pre")


def oracle(name: str, query: str) -> str:
    """A query over the relation `nodes` of a corpus, as SQL over the test tables."""
    return f"WITH {TABLES[name][1]}{'' if query.startswith(',') else ' '}{query}"
