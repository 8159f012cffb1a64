"""The guard's decision on a fixed list of statements, accepted ones and one or more for every rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gneiss.guard import Rejected, validate_sql

_TABLES = {"orders": ("order_no", "status", "quantity", "phone", "ordered_at")}
_MINE = "WHERE order_no = 'K'"
#: (statement, what the dialect's rules say about it), each written out by hand.
CASES = (
    ("SELECT * FROM orders WHERE order_no = 'K'", "accepted"),
    ("SELECT order_no FROM public.orders WHERE 'K' = order_no;", "accepted"),
    ("SELECT order_no FROM orders WHERE (status = 'a' OR status = 'b') AND (order_no = 'K')", "accepted"),
    (f"SELECT status AS s, count(*) AS n FROM orders {_MINE} GROUP BY s ORDER BY n DESC, s", "accepted"),
    (f"WITH m AS (SELECT status FROM orders {_MINE}) SELECT status FROM m", "accepted"),
    (f"SELECT order_no FROM orders {_MINE} AND quantity > - -1", "accepted"),
    (f"SELECT extract(year FROM ordered_at) AS y FROM orders {_MINE}", "accepted"),
    ("", "empty"),
    (" ; ", "empty"),
    (f"SELECT order_no FROM orders {_MINE} -- x", "comment"),
    (f"/* x */ SELECT order_no FROM orders {_MINE}", "comment"),
    (f"SELECT order_no FROM orders {_MINE}; SELECT 1", "multiple_statements"),
    ("DROP TABLE orders", "not_select"),
    ("DELETE FROM orders", "not_select"),
    (f"SELECT order_no FROM orders {_MINE} UNION SELECT order_no FROM orders {_MINE}", "not_select"),
    (f"SELECT * INTO t FROM orders {_MINE}", "forbidden_statement"),
    (f"WITH x AS (DELETE FROM orders) SELECT order_no FROM orders {_MINE}", "forbidden_statement"),
    (f"SELECT order_no FROM orders {_MINE} FOR UPDATE", "locking_clause"),
    (f"SELECT order_no FROM orders {_MINE} FOR KEY SHARE", "locking_clause"),
    ("SELECT a.order_no FROM orders a LEFT JOIN orders b ON a.order_no = 'K' AND b.order_no = 'K'", "unsupported_join"),
    ("SELECT a.order_no FROM orders a NATURAL JOIN orders b WHERE a.order_no = 'K'", "unsupported_join"),
    (f"WITH RECURSIVE x AS (SELECT order_no FROM orders {_MINE}) SELECT order_no FROM x", "unsupported_source"),
    ("SELECT a FROM orders AS o(a) WHERE a = 'K'", "unsupported_source"),
    ("SELECT * FROM secrets", "unknown_table"),
    ("SELECT * FROM pg_catalog.pg_user", "unknown_table"),
    ("SELECT * FROM generate_series(1, 10)", "unknown_table"),
    (f"SELECT order_no FROM orders {_MINE} AND quantity IN (SELECT x FROM secrets)", "unknown_table"),
    (f"SELECT ctid FROM orders {_MINE}", "unknown_column"),
    (f"SELECT count(*) AS n FROM orders {_MINE} GROUP BY status HAVING n > 1", "unknown_column"),
    ("SELECT 1 AS x FROM orders, orders WHERE orders.order_no = 'K'", "duplicate_source"),
    ("SELECT 1", "no_whitelisted_table"),
    (f"SELECT pg_sleep(1) AS v FROM orders {_MINE}", "forbidden_function"),
    (f"SELECT order_no FROM orders {_MINE} ORDER BY random()", "forbidden_function"),
    (f"SELECT 'x' FROM orders {_MINE}", "unsupported_projection"),
    (f"SELECT status, quantity AS status FROM orders {_MINE}", "unsupported_projection"),
    ("SELECT order_no FROM orders", "order_scope"),
    ("SELECT order_no FROM orders WHERE order_no = 'K2'", "order_scope"),
    (f"SELECT order_no FROM orders {_MINE} OR 1 = 1", "order_scope"),
    ("SELECT order_no FROM orders WHERE order_no IN ('K', 'K2')", "order_scope"),
    ("SELECT order_no FROM orders WHERE NOT (order_no <> 'K')", "order_scope"),
    (f"WITH x AS (SELECT * FROM orders) SELECT order_no FROM x {_MINE}", "order_scope"),
    ("SELECT a.order_no FROM orders a JOIN orders b ON a.quantity = b.quantity WHERE a.order_no = 'K'", "order_scope"),
    (f"SELECT order_no FROM orders {_MINE} LIMIT 0", "unsupported_limit"),
    (f"SELECT order_no FROM orders {_MINE} FETCH FIRST 5 ROWS WITH TIES", "unsupported_limit"),
    (f"SELECT to_char(ordered_at, 'YYYY'') AS y FROM x') AS y FROM orders {_MINE}", "parse_error"),
    (f"SELECT extract('year FROM ordered_at) AS y FROM x' FROM ordered_at) AS z FROM orders {_MINE}", "parse_error"),
    ("SELEC x", "parse_error"),
)


def outcome(sql: str) -> str:
    """"accepted", or the rule that the statement breaks."""
    try:
        validate_sql(sql, order_no="K", max_rows=50, whitelist=_TABLES)
    except Rejected as e:
        return e.rule
    return "accepted"


def guard_rules(spark: SparkSession, folder: str) -> DataFrame:
    """(no, statement, outcome): what the guard decides on each statement of the list."""
    return spark.createDataFrame([(i, sql, outcome(sql)) for i, (sql, _) in enumerate(CASES)], "no int, statement string, outcome string")


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


QUERIES = {"guard_rules": guard_rules}
ORACLE = {"guard_rules": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {_literal(sql)}, {_literal(name)})" for i, (sql, name) in enumerate(CASES)) + ") AS t(no, statement, outcome)"}
