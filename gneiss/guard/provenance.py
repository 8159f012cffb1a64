"""Which output columns of stored statements are a table's own columns, by the guard's proof."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gneiss.guard.rules import validate_sql
from gneiss.guard.syntax import Rejected

#: The table of orders that statements may read.
ORDERS = {"orders": ("order_no", "customer_name", "customer_phone", "customer_email", "shipping_address", "product_name", "product_option", "quantity", "unit_price_krw", "total_price_krw", "status", "ordered_at", "shipped_at", "delivered_at", "courier", "tracking_no")}
_KEY = re.compile(r"order_no\s*=\s*'((?:[^']|'')+)'")


@lru_cache(maxsize=10_000)
def _proven(sql: str, tables: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[str, ...]:
    try:
        return validate_sql(sql, order_no="K", max_rows=1, whitelist=dict(tables)).provenance
    except Rejected:
        return ()


def proven(sql: str | None, tables: dict[str, tuple[str, ...]]) -> list[str]:
    """The output names that are plain columns of a table; none for null and for statements that the guard rejects.

    The key that the statement is bound to is taken from the statement; statements that differ in it alone are checked once.
    """
    key = _KEY.search(sql or "")
    return list(_proven(sql.replace(f"'{key.group(1)}'", "'K'"), tuple(tables.items()))) if key else []


def proven_columns(sql: Column, tables: dict[str, tuple[str, ...]]) -> Column:
    """``proven`` as a column: array<string>."""

    @F.pandas_udf("array<string>")
    def names(statements: pd.Series) -> pd.Series:
        return statements.map(lambda x: proven(x, tables))

    return names(sql)
