"""References to records that are missing, deleted or arrive later.

References and parent keys are hash-partitioned on the key, sorted and merged in one linear pass (a
sort-merge join, one parent row per key on the right). A parent carries its validity interval
[arrived, deleted); comparing a reference's own times with the interval tells the kinds apart.

A key that a large part of the references name would land in one task. Keys named by more than
``hot_share`` of the references are at most 1/hot_share in number, whatever the data; their parents
are broadcast and their references never shuffled. The other keys, each below the share, are merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators.skew import HOT_SHARE, lookup

def parent_intervals(df: DataFrame, key: str, arrived: str, deleted: str | None) -> DataFrame:
    """(ref_key, arrived, deleted): one row per key.

    A record is a key, not a row: it arrived with its earliest row, and what the last loaded row says of
    its deletion holds: a null there means that it is there again. Of rows loaded at one time the latest
    deletion counts. Null keys are no parents.
    """
    gone = F.max_by(F.struct(F.col(deleted).alias("d")), F.struct(F.col(arrived), F.col(deleted)))["d"] if deleted else F.lit(None).cast("timestamp")
    return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("ref_key")).agg(F.min(arrived).alias("arrived"), gone.alias("deleted"))


def _kind() -> F.Column:
    return (
        F.when(F.col("p_key").isNull(), "missing")
        .when(F.col("deleted") <= F.col("ref_created"), "deleted")
        .when(F.col("p_arrived") > F.col("ref_arrived"), "late")
    )


def orphans(refs: DataFrame, parents: DataFrame, share: float = HOT_SHARE) -> DataFrame:
    """Orphan references with their kind and period.

    refs: inquiry_id, ref_key, ref_created, ref_arrived, one row per reference; parents: as
    ``parent_intervals`` gives them. kind is missing, deleted or late, the first that holds; period is
    the month of ref_created, null where that is null. Null keys are no references. A null time makes
    its comparison unknown, so that kind doesn't hold.
    """
    refs = refs.filter(F.col("ref_key").isNotNull())
    parents = parents.select(F.col("ref_key").alias("p_key"), F.col("arrived").alias("p_arrived"), "deleted")
    merged = lookup(refs, parents, "ref_key", "p_key", "left", share)
    kind = merged.withColumn("kind", _kind()).filter(F.col("kind").isNotNull())
    return kind.select("inquiry_id", "ref_key", "kind", F.date_format("ref_created", "yyyy-MM").alias("period"))


def per_period(found: DataFrame, by: str = "src") -> DataFrame:
    """The report: number of orphan references per source, period and kind."""
    return found.groupBy(by, "period", "kind").agg(F.count(F.lit(1)).alias("orphans"))
