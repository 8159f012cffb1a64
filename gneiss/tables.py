"""Reading the project's tables from a folder of Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table, lazily, so Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def one_per_key(df: DataFrame, keys: list[str], arrival: str | None, columns: list[str]) -> DataFrame:
    """One row per key out of rows that may be loaded several times.

    The row of the earliest ``arrival`` gives the columns (ties: the smallest struct of values, so the
    result is the same on every run); without ``arrival`` the smallest struct does. ``min`` over a
    struct is combined on the map side, so only one row per key and task is shuffled. Rows whose key
    is null are kept as one row per distinct key like any other.
    """
    order = ([arrival] if arrival else []) + [c for c in columns if c != arrival]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in columns])


def records_of(spark: SparkSession, folder: str, name: str, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key of a table: that of the earliest load, or, in a table without load times, the smallest."""
    t = table(spark, folder, name)
    arrival = "loaded_at" if "loaded_at" in t.columns else None
    read = [*keys, *[c for c in columns if c not in keys]]
    return one_per_key(t.select(*read, *([arrival] if arrival and arrival not in read else [])), keys, arrival, [c for c in columns if c not in keys])
