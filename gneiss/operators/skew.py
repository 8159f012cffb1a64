"""Looking up one row per key for rows whose keys may be very unevenly spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when more than this share of all rows has it; so at most 200 keys are hot, whatever the data.
HOT_SHARE = 0.005


def hot_keys(rows: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """Keys that more than ``share`` of the rows have: at most 1/share, which bounds the driver's list.

    The count is combined on the map side, so a hot key costs one row per task.
    """
    counts = rows.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg((F.count(F.lit(1)) * F.lit(share)).alias("least"))
    heavy = counts.join(F.broadcast(total), F.col("n") > F.col("least")).filter(F.col("k").isNotNull())
    return [r[0] for r in heavy.select("k").collect()]


def lookup(rows: DataFrame, unique: DataFrame, key: str, unique_key: str, how: str = "left", share: float = HOT_SHARE) -> DataFrame:
    """``rows`` joined with at most one row each of ``unique``, without a hot task.

    Rows of hot keys stay where they are and meet the few matching rows of ``unique`` as a broadcast of
    at most 1/share rows; the others, each key below the share, are hash-partitioned, sorted and merged.
    """
    on = F.col(key) == F.col(unique_key)
    hot = hot_keys(rows, key, share)
    if not hot:
        return rows.join(unique.hint("merge"), on, how)
    cold = rows.filter(F.col(key).isNull() | ~F.col(key).isin(hot)).join(unique.hint("merge"), on, how)
    few = F.broadcast(unique.filter(F.col(unique_key).isin(hot)))
    return cold.unionByName(rows.filter(F.col(key).isin(hot)).join(few, on, how))
