"""Keys and constraints over orders, lines and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import relational as rel
from tabwright.plans.registry import query, sql_digest, sql_index, sql_marginal, table

LINKS = [
    {"parent_table": "customer", "parent_column": "c_custkey", "child_table": "orders", "child_column": "o_custkey"},
    {"parent_table": "orders", "parent_column": "o_orderkey", "child_table": "lineitem", "child_column": "l_orderkey"},
    {"parent_table": "part", "parent_column": "p_partkey", "child_table": "lineitem", "child_column": "l_partkey"},
]


def tables(spark, folder):
    """Lines with damage: some orders unknown, some quantities negative or missing, some texts that are no numbers."""
    out = {t: table(spark, folder, t) for t in ("customer", "orders", "part", "lineitem")}
    key = F.col("l_orderkey")
    out["lineitem"] = out["lineitem"].select(
        F.when(key % 101 == 7, key + 100_000_000).otherwise(key).alias("l_orderkey"),
        "l_linenumber",
        "l_partkey",
        F.when(key % 53 == 1, -F.col("l_quantity")).when(key % 53 != 2, F.col("l_quantity")).alias("l_quantity"),
        F.when(key % 97 == 5, F.lit("n/a")).otherwise(F.col("l_discount").cast("string")).alias("l_discount"),
    )
    return out


LINES = """(SELECT CASE WHEN l_orderkey % 101 = 7 THEN l_orderkey + 100000000 ELSE l_orderkey END AS l_orderkey, l_linenumber, l_partkey,
    CASE WHEN l_orderkey % 53 = 1 THEN -l_quantity WHEN l_orderkey % 53 <> 2 THEN l_quantity END AS l_quantity,
    CASE WHEN l_orderkey % 97 = 5 THEN 'n/a' ELSE l_discount::VARCHAR END AS l_discount FROM lineitem)"""


@query(
    "foreign_key_report",
    f"""SELECT 'orders.o_custkey->customer.c_custkey' AS relationship, count(*) AS rows, count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orphans FROM orders
        UNION ALL SELECT 'lineitem.l_orderkey->orders.o_orderkey', count(*), count(*) FILTER (WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) FROM {LINES}
        UNION ALL SELECT 'lineitem.l_partkey->part.p_partkey', count(*), count(*) FILTER (WHERE l_partkey NOT IN (SELECT p_partkey FROM part)) FROM {LINES}""",
)
def foreign_key_report(spark, folder):
    return rel.foreign_key_report(tables(spark, folder), LINKS)


@query("orphan_rows", f"SELECT l_orderkey, l_linenumber, l_partkey FROM {LINES} WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def orphan_rows(spark, folder):
    t = tables(spark, folder)
    return rel.orphans(t["lineitem"], "l_orderkey", t["orders"], "o_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_keys(spark, folder):
    return rel.duplicate_keys(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


CONSTRAINTS = [
    {"kind": "not_null", "columns": ["l_quantity"]},
    {"kind": "check", "expression": "l_quantity > 0"},
    {"kind": "data_type", "column": "l_discount", "type": "double"},
    {"kind": "primary_key", "columns": ["l_orderkey", "l_linenumber"]},
    {"kind": "foreign_key", "column": "l_orderkey", "parent_table": "orders", "parent_column": "o_orderkey"},
]
ROW_ID = ["l_orderkey", "l_linenumber", "l_partkey"]
_FOUND = f"""(WITH l AS (SELECT *, concat_ws('|', l_orderkey, l_linenumber, l_partkey) AS row_id FROM {LINES})
    SELECT row_id, 'not_null:l_quantity' AS "constraint", 'not_null' AS kind FROM l WHERE l_quantity IS NULL
    UNION ALL SELECT row_id, 'check:l_quantity > 0', 'check' FROM l WHERE NOT (l_quantity > 0)
    UNION ALL SELECT row_id, 'data_type:l_discount', 'data_type' FROM l WHERE TRY_CAST(l_discount AS DOUBLE) IS NULL
    UNION ALL SELECT row_id, 'primary_key:l_orderkey,l_linenumber', 'primary_key' FROM l WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM l GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    UNION ALL SELECT row_id, 'foreign_key:l_orderkey', 'foreign_key' FROM l WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))"""


@query("constraint_violations", f'SELECT row_id, "constraint", kind FROM {_FOUND}')
def constraint_violations(spark, folder):
    t = tables(spark, folder)
    return rel.violations(t["lineitem"], CONSTRAINTS, ROW_ID, t)


@query(
    "validation_score",
    f"SELECT count(*) AS rows, (SELECT count(DISTINCT row_id) FROM {_FOUND}) AS bad_rows, (SELECT count(*) FROM {_FOUND}) AS violations, round((count(*) - (SELECT count(DISTINCT row_id) FROM {_FOUND})) / count(*), 4) AS score FROM lineitem",
)
def validation_score(spark, folder):
    t = tables(spark, folder)
    return rel.validation_score(t["lineitem"], rel.violations(t["lineitem"], CONSTRAINTS, ROW_ID, t))


@query("first_errors", f'SELECT row_id, "constraint", kind FROM {_FOUND}')
def first_errors(spark, folder):
    t = tables(spark, folder)
    return rel.first_errors(rel.violations(t["lineitem"], CONSTRAINTS, ROW_ID, t))


def _broken(i, name, status="o_orderstatus", customer="o_custkey", price="o_totalprice", text="o_orderkey::VARCHAR"):
    return f"""(SELECT o_orderkey, {status} AS o_orderstatus, {customer} AS o_custkey, {price} AS o_totalprice, {text} AS o_rank_text, '{name}' AS violation
        FROM orders ORDER BY {sql_digest('sample', 'o_orderkey', seed=42 + i)}, o_orderkey LIMIT 5)"""


@query(
    "violation_test_rows",
    " UNION ALL ".join(
        f"SELECT * FROM {q}"
        for q in (
            _broken(0, "not_null", status="NULL::VARCHAR"),
            _broken(1, "duplicate_key"),
            _broken(2, "foreign_key", customer="-1 - abs(o_custkey)"),
            _broken(3, "check", price="-abs(o_totalprice) - 1"),
            _broken(4, "data_type", text="'not a number'"),
        )
    ),
)
def violation_test_rows(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice", F.col("o_orderkey").cast("string").alias("o_rank_text"))
    return rel.break_rows(rows, ["o_orderkey"], "o_orderstatus", "o_custkey", "o_totalprice", "o_rank_text")


@query(
    "insert_statements",
    """SELECT 0 AS layer, 'customer' AS table_name, lpad(c_custkey::VARCHAR, 20, '0') AS row_key, 'INSERT INTO customer (c_custkey, c_name) VALUES (' || c_custkey || ', ''' || c_name || ''');' AS statement FROM customer
       UNION ALL SELECT 1, 'orders', lpad(o_orderkey::VARCHAR, 20, '0'), 'INSERT INTO orders (o_orderkey, o_custkey, o_totalprice) VALUES (' || o_orderkey || ', ' || o_custkey || ', ' || o_totalprice || ');' FROM orders""",
)
def insert_statements(spark, folder):
    t = {"customer": table(spark, folder, "customer").select("c_custkey", "c_name"), "orders": table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")}
    order = rel.dependency_order(["orders", "customer"], LINKS[:1])
    return rel.insert_statements(t, order, {"customer": ["c_custkey"], "orders": ["o_orderkey"]})


@query(
    "children_histogram",
    "SELECT coalesce(n, 0) AS children, count(*) AS parents FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1",
)
def children_histogram(spark, folder):
    return rel.children_histogram(table(spark, folder, "customer"), "c_custkey", table(spark, folder, "orders"), "o_custkey")


RELATIONS = [
    {"parent_table": "customer", "parent_column": "c_custkey", "child_table": "orders", "child_column": "o_custkey"},
    {"parent_table": "orders", "parent_column": "o_orderkey", "child_table": "lineitem", "child_column": "l_orderkey"},
    {"parent_table": "part", "parent_column": "p_partkey", "child_table": "lineitem", "child_column": "l_partkey"},
]


@query("related_table_set")
def related_table_set(spark, folder):
    """New order lines with new orders, customers and parts above them."""
    columns = {
        "customer": ["c_custkey", "c_nationkey", "c_mktsegment"],
        "part": ["p_partkey", "p_brand", "p_retailprice"],
        "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"],
        "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag"],
    }
    keys = {"customer": ["c_custkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"]}
    made = rel.synthesize_tables({t: table(spark, folder, t).select(*c) for t, c in columns.items()}, RELATIONS, keys)
    return made["lineitem"]


def _children_sql() -> str:
    drawn = " JOIN ".join(f"{sql_marginal(c, 'orders', 'm')} USING (id)" for c in ("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))
    return f"""WITH o AS (SELECT c_custkey AS k, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey),
      i AS (SELECT n, row_number() OVER (ORDER BY substr(sha256(k::VARCHAR), 1, 3), k) - 1 AS spot FROM o),
      p AS (SELECT c, {sql_index('(SELECT count(*) FROM customer)', 'children', 'c')} AS spot FROM (SELECT unnest(range((SELECT count(*) FROM customer))) AS c)),
      s AS (SELECT c, unnest(range(1, n + 1)) AS j FROM p JOIN i USING (spot)),
      m AS (SELECT c, j, row_number() OVER (ORDER BY substr(sha256(concat_ws('|', c, j)), 1, 3), c, j) - 1 AS id FROM s)
      SELECT id AS o_orderkey, c AS o_custkey, o_orderstatus, o_totalprice::DOUBLE AS o_totalprice, o_orderdate::TIMESTAMP AS o_orderdate, o_orderpriority
      FROM m JOIN {drawn}"""


@query("related_tables_synthesis", _children_sql())
def related_tables_synthesis(spark, folder):
    customer = table(spark, folder, "customer")
    orders = table(spark, folder, "orders")
    made = rel.synthesize_parents(customer, "c_custkey")
    return rel.synthesize_children(made, "c_custkey", customer, orders, "o_custkey", ["o_orderkey"])
