"""The driver's tables as units of code, so that the operators have something to run on.

A customer calls the parts that it has bought, a part its suppliers; suppliers and
nations call nothing, so their texts are scanned for names. All rows of the tables
take part. ``UNITS_SQL`` is the same in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.tags import tags
from ..operators.callgraph import dealt, tasks_for
from ..schemas import UNIT_COLUMNS

#: Words that the bodies do have; the built-in rules are of code.
RULES = (
    ("fastener", ("bolt", "rod", "ring")), ("machine", ("widget", "gizmo", "gear")), ("iron", ("anvil", "plate")), ("colour", ("blue", "red")), ("heat", ("hot", "cold")), ("age", ("new", "old")), ("size", ("large", "small")),
    ("party", ("Customer#", "Supplier#")),
)
#: Where each kind's ``ord`` begins; parts' is their key, which vectors have too.
SUPPLIERS, CUSTOMERS, NATIONS = 10_000_000_000, 20_000_000_000, 30_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _unit(df: DataFrame, ord_: Column, name: Column, file: str, body: Column, package: Column, doc: Column, exported: Column, receiver: Column, callees: Column) -> DataFrame:
    text = F.lit("")
    values = {
        "ord": ord_.cast("long"), "name": name, "file": F.lit(file), "start_line": (F.pmod(ord_, F.lit(1000)) + 1).cast("int"), "body": body, "signature": F.concat(F.lit("("), name, F.lit(" | error)")),
        "package": package, "patterns": tags(body, RULES), "doc_comment": F.coalesce(doc, text), "exported": exported, "receiver_type": receiver, "callees": F.coalesce(callees, F.array().cast("array<string>")),
    }
    return df.select(*[values[c].alias(c) for c in UNIT_COLUMNS])


def _lists(rows: DataFrame, key: str, value: str, letter: str, tasks: int | None) -> DataFrame:
    """For each ``key`` its distinct values, named by ``letter`` and number, sorted."""
    names = F.collect_list(F.concat(F.lit(letter), F.col(value).cast("string")))
    return dealt(rows.select(key, value), tasks, key).distinct().groupBy(key).agg(F.sort_array(names).alias("callees"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supplier, customer, orders, nation, region = (table(spark, sf_dir, t) for t in ("part", "supplier", "customer", "orders", "nation", "region"))
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    # distinct keys before lists, in partitions by rows: keys compress to a few bytes each, so partitions by bytes would hold too many to sort in memory
    tasks = tasks_for(lineitem.count(), spark)
    supplied = _lists(lineitem, "l_partkey", "l_suppkey", "s", tasks)
    bought = dealt(lineitem, tasks, "l_orderkey").join(dealt(orders.select("o_orderkey", "o_custkey"), tasks, "o_orderkey").hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
    bought = _lists(bought, "o_custkey", "l_partkey", "p", tasks)
    part, customer = dealt(part, tasks, "p_partkey"), dealt(customer, tasks, "c_custkey")
    c, none = F.col, F.array().cast("array<string>")
    home = nation.select(c("n_nationkey"), c("n_name"))
    a = part.join(supplied, c("p_partkey") == c("l_partkey"), "left")
    a = _unit(a, c("p_partkey"), F.concat(F.lit("p"), c("p_partkey").cast("string")), "shop/parts.go", c("p_name"), c("p_brand"), c("p_type"), c("p_size") > 25, c("p_type"), c("callees"))
    b = supplier.join(home, c("s_nationkey") == c("n_nationkey"), "left")
    b = _unit(b, c("s_suppkey") + SUPPLIERS, F.concat(F.lit("s"), c("s_suppkey").cast("string")), "shop/suppliers.go", F.concat_ws(" of ", "s_name", "n_name"), c("n_name"), F.lit(""), c("s_acctbal") > 0, F.lit(""), none)
    d = customer.join(bought, c("c_custkey") == c("o_custkey"), "left")
    d = _unit(d, c("c_custkey") + CUSTOMERS, F.concat(F.lit("c"), c("c_custkey").cast("string")), "shop/customers.go", c("c_name"), c("c_mktsegment"), F.lit(""), c("c_acctbal") > 0, F.lit("*Customer"), c("callees"))
    e = nation.join(region, c("n_regionkey") == c("r_regionkey"), "left")
    e = _unit(e, c("n_nationkey") + NATIONS, c("n_name"), "shop/nations.go", c("n_name"), c("r_name"), F.lit(""), F.lit(True), F.lit(""), none)
    return a.unionByName(b).unionByName(d).unionByName(e)


def tags_sql(body: str, rules=RULES) -> str:
    def quote(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    cases = [f"CASE WHEN {' OR '.join(f'contains({body}, {quote(w)})' for w in words)} THEN {quote(tag)} END" for tag, words in rules]
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


def _sql(ord_: str, name: str, file: str, body: str, package: str, doc: str, exported: str, receiver: str, callees: str, source: str) -> str:
    return f"""SELECT ({ord_})::BIGINT AS ord, {name} AS name, '{file}' AS file, (({ord_}) % 1000 + 1)::INT AS start_line, {body} AS body, '(' || {name} || ' | error)' AS signature, {package} AS package,
    {tags_sql(body)} AS patterns, {doc} AS doc_comment, {exported} AS exported, {receiver} AS receiver_type, {callees} AS callees FROM {source}"""


#: Common table expressions that end in ``units``; to be followed by a comma or a query.
UNITS_SQL = f"""WITH supplied AS (SELECT l_partkey, list_sort(list(DISTINCT 's' || l_suppkey)) AS cs FROM lineitem GROUP BY 1),
bought AS (SELECT o_custkey, list_sort(list(DISTINCT 'p' || l_partkey)) AS cs FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
units AS ({_sql("p_partkey", "'p' || p_partkey", "shop/parts.go", "p_name", "p_brand", "coalesce(p_type, '')", "p_size > 25", "p_type", "coalesce(cs, [])", "part LEFT JOIN supplied ON p_partkey = l_partkey")}
UNION ALL {_sql(f"s_suppkey + {SUPPLIERS}", "'s' || s_suppkey", "shop/suppliers.go", "concat_ws(' of ', s_name, n_name)", "n_name", "''", "s_acctbal > 0", "''", "[]::VARCHAR[]", "supplier LEFT JOIN nation ON s_nationkey = n_nationkey")}
UNION ALL {_sql(f"c_custkey + {CUSTOMERS}", "'c' || c_custkey", "shop/customers.go", "c_name", "c_mktsegment", "''", "c_acctbal > 0", "'*Customer'", "coalesce(cs, [])", "customer LEFT JOIN bought ON c_custkey = o_custkey")}
UNION ALL {_sql(f"n_nationkey + {NATIONS}", "n_name", "shop/nations.go", "n_name", "r_name", "''", "true", "''", "[]::VARCHAR[]", "nation LEFT JOIN region ON n_regionkey = r_regionkey")})"""
#: After UNITS_SQL: edges, callers, and concept documents.
GRAPH_SQL = """names AS (SELECT DISTINCT name FROM units),
calls AS (SELECT name AS caller, ord AS caller_ord, unnest(callees) AS callee FROM units),
exact AS (SELECT callee, caller, caller_ord FROM calls WHERE callee IN (SELECT name FROM names)),
scanned AS (SELECT n.name AS callee, u.name AS caller, u.ord AS caller_ord FROM units u JOIN names n ON len(u.callees) = 0 AND strlen(n.name) >= 4 AND u.name <> n.name AND contains(u.body, n.name)),
edges AS (SELECT * FROM exact UNION ALL SELECT * FROM scanned),
firsts AS (SELECT callee, caller, min(caller_ord) AS o FROM edges GROUP BY 1, 2),
called AS (SELECT callee AS name, list(caller ORDER BY o, caller) AS callers FROM firsts GROUP BY 1),
graph AS (SELECT name, coalesce(callers, []) AS callers FROM names LEFT JOIN called USING (name))"""
DOCS_SQL = (
    GRAPH_SQL
    + """,
info AS (SELECT name, arg_max({'package': package, 'patterns': patterns}, ord) AS i FROM units GROUP BY 1),
up AS (SELECT g.name, list_sort(list_distinct(flatten(list(i.patterns)))) AS caller_patterns, list_sort(coalesce(list(DISTINCT i.package) FILTER (i.package <> ''), [])) AS caller_packages
    FROM (SELECT name, unnest(callers) AS near FROM graph) g JOIN info ON near = info.name GROUP BY 1),
down AS (SELECT c.ord, list_sort(list_distinct(flatten(list(i.patterns)))) AS callee_patterns, list_sort(coalesce(list(DISTINCT i.package) FILTER (i.package <> ''), [])) AS callee_packages
    FROM (SELECT ord, unnest(callees) AS near FROM units) c JOIN info ON near = info.name GROUP BY 1),
docs AS (SELECT u.ord, u.name, package, doc_comment, exported, receiver_type,
    CASE WHEN len(callers) >= 2 AND len(callees) >= 2 THEN 'passthrough' WHEN len(callers) >= 2 THEN 'utility' WHEN len(callees) >= 2 THEN 'orchestrator' ELSE 'leaf' END AS role,
    callers, callees, patterns, coalesce(caller_patterns, []) AS caller_patterns, coalesce(callee_patterns, []) AS callee_patterns, coalesce(caller_packages, []) AS caller_packages, coalesce(callee_packages, []) AS callee_packages
    FROM units u JOIN graph g ON u.name = g.name LEFT JOIN up ON up.name = u.name LEFT JOIN down ON down.ord = u.ord)"""
)
