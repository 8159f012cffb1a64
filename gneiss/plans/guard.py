"""Guarded user SQL over the order table: one query per accepted kind of statement.

The row limit is the guard's feature. Every statement is bound to one order, so results are small by
nature; the scan itself is pruned and filtered by Spark.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.guard import execute
from gneiss.tables import one_per_key, table

COLUMNS = ["order_no", "customer_name", "product_name", "product_option", "quantity", "unit_price_krw", "total_price_krw", "status", "ordered_at", "shipped_at", "courier"]
MOST = 50


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    o = one_per_key(table(spark, folder, "shop_orders").select(*COLUMNS, "loaded_at"), ["order_no"], "loaded_at", ["loaded_at", *COLUMNS[1:]])
    return o.select(*COLUMNS)


def _key(spark: SparkSession, folder: str) -> str:
    """The order that most inquiries name and that exists: one value."""
    named = table(spark, folder, "inquiries").filter(F.col("order_no").isNotNull()).groupBy("order_no").agg(F.count(F.lit(1)).alias("n"))
    best = named.join(table(spark, folder, "shop_orders").select("order_no"), "order_no", "left_semi").orderBy(F.desc("n"), "order_no").limit(1).collect()
    return best[0][0] if best else "ORD-20240103-0001"


STATEMENTS = {
    "guard_select": "SELECT order_no, product_name AS product, quantity FROM orders WHERE order_no = '{k}'",
    "guard_cte": "WITH mine AS (SELECT order_no, quantity, status FROM orders WHERE order_no = '{k}') SELECT m.status, m.quantity FROM mine AS m",
    "guard_subquery": "SELECT o.order_no, o.status FROM orders o WHERE o.order_no = '{k}' AND o.quantity IN (SELECT i.quantity FROM public.orders i WHERE '{k}' = i.order_no)",
    "guard_self_join": "SELECT a.order_no, b.status AS other_status FROM orders a JOIN orders b ON a.order_no = b.order_no AND b.order_no = '{k}' WHERE a.order_no IN ('{k}')",
    "guard_aggregate": "SELECT status, count(*) AS n, sum(quantity) AS pieces FROM orders WHERE order_no = '{k}' GROUP BY status HAVING count(*) >= 1 ORDER BY n DESC",
    "guard_functions": "SELECT upper(order_no) AS key, to_char(ordered_at, 'YYYY-MM-DD') AS day, coalesce(product_option, '-') AS option, CASE WHEN quantity > 1 THEN 'many' ELSE 'one' END AS amount, concat(status, NULL, '/', courier) AS way, quantity::text AS pieces FROM orders WHERE (order_no = '{k}')",
    "guard_limit": "SELECT order_no, total_price_krw FROM orders WHERE order_no = '{k}' ORDER BY total_price_krw FETCH FIRST 500 ROWS ONLY",
}


def _query(name: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        k = _key(spark, folder)
        tag = f"guard_{zlib.crc32(folder.encode()):08x}"
        return execute({"orders": _orders(spark, folder)}, STATEMENTS[name].format(k=k), order_no=k, max_rows=MOST, tag=tag)

    run.__name__ = name
    return run


QUERIES = {n: _query(n) for n in STATEMENTS}

_O = "WITH key AS (SELECT order_no AS k FROM inquiries WHERE order_no IN (SELECT order_no FROM shop_orders) GROUP BY order_no ORDER BY count(*) DESC, order_no LIMIT 1), o AS (SELECT DISTINCT ON (order_no) * FROM (SELECT * FROM shop_orders ORDER BY order_no, loaded_at) WHERE order_no = (SELECT k FROM key)) "
ORACLE = {
    "guard_select": _O + "SELECT order_no, product_name AS product, quantity FROM o",
    "guard_cte": _O + "SELECT status, quantity FROM o",
    "guard_subquery": _O + "SELECT order_no, status FROM o WHERE quantity IS NOT NULL",
    "guard_self_join": _O + "SELECT order_no, status AS other_status FROM o",
    "guard_aggregate": _O + "SELECT status, count(*) AS n, sum(quantity)::BIGINT AS pieces FROM o GROUP BY status",
    "guard_functions": _O + "SELECT upper(order_no) AS key, strftime(ordered_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, coalesce(product_option, '-') AS option, CASE WHEN quantity > 1 THEN 'many' ELSE 'one' END AS amount, concat(status, NULL, '/', courier) AS way, quantity::VARCHAR AS pieces FROM o",
    "guard_limit": _O + "SELECT order_no, total_price_krw FROM o",
}
