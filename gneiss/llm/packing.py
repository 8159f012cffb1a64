"""Filling containers of fixed capacity with items, planned on the histogram of lengths.

Best-fit decreasing runs over counts, not over items: containers with the same free space form a class,
and a whole count of items moves into the best class at once. The plan's size depends on the capacity
alone. Items then take the planned slots by their rank within their length. The rank is counted in two
steps, within (length, bucket) and over the buckets of a length, so items of one common length don't
meet in one task.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gneiss.session import cut_lineage, default_parallelism


@dataclass(frozen=True)
class Slots:
    """Items of ``length`` with ranks from ``rank_from`` on, ``each`` to a container, from ``container`` on."""

    length: int
    rank_from: int
    rank_to: int
    container: int
    each: int


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Slots], int]:
    """Slots for every item of a histogram {length: count}, and the number of containers.

    Lengths lie in 1..capacity. Among the open classes the one with least free space that still takes
    the item is filled first; ties can't arise, as a class is its free space. At most a few steps per
    pair of length and class are needed, whatever the counts.
    """
    if any(not 1 <= n <= capacity for n in histogram):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    free: list[int] = []  # sorted: the free spaces that some open container has
    ranges: dict[int, list[tuple[int, int]]] = {}  # free space -> ranges of containers [from, to)
    slots: list[Slots] = []
    containers = 0

    def keep(space: int, start: int, end: int) -> None:
        if space and start < end:
            if space not in ranges:
                bisect.insort(free, space)
                ranges[space] = []
            ranges[space].append((start, end))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(free, length)
            if at < len(free):
                space = free[at]
                start, end = ranges[space].pop()
                if not ranges[space]:
                    del ranges[space], free[at]
            else:
                space, start = capacity, containers
                each = capacity // length
                end = start + max(1, left // each)
                containers = end
            # Best fit keeps filling the container it has just used while that stays the tightest that fits.
            each = min(space // length, left)
            n = min(end - start, left // each)
            slots.append(Slots(length, rank, rank + n * each, start, each))
            rank += n * each
            left -= n * each
            keep(space - each * length, start, start + n)
            keep(space if space < capacity else 0, start + n, end)
    return slots, containers


def pieces(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece_no, first_unit, n_units): one piece per item that fits, several of one that doesn't.

    Only an item larger than the capacity is divided, into full pieces and a rest. An item of size 0
    or null is one piece of 0 units.
    """
    n = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    count = F.greatest(F.lit(1).cast("bigint"), F.ceil(n / F.lit(capacity)).cast("bigint"))
    each = items.select(F.col(key), n.alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("piece_no"))
    first = F.col("piece_no") * capacity
    return each.select(key, F.col("piece_no").cast("int"), first.alias("first_unit"), F.least(F.col("n") - first, F.lit(capacity).cast("bigint")).cast("int").alias("n_units"))


def ranked_within_length(parts: DataFrame, key: str, buckets: int) -> DataFrame:
    """``parts`` with its rank (from 0) among the parts of the same n_units, without a task per length."""
    spread = parts.withColumn("bucket", F.pmod(F.xxhash64(F.col(key), F.col("piece_no")), F.lit(buckets)).cast("int"))
    counts = spread.groupBy("n_units", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("n_units").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("n_units", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("n_units", "bucket").orderBy(key, "piece_no")
    within = spread.withColumn("own_rank", F.row_number().over(own) - 1)
    return within.join(offsets, ["n_units", "bucket"]).withColumn("rank", F.col("offset") + F.col("own_rank")).drop("bucket", "offset", "own_rank")


def pack(items: DataFrame, key: str, size: str, capacity: int, buckets: int | None = None) -> DataFrame:
    """(key, piece_no, first_unit, n_units, container_id): every item in a container, none over capacity.

    ``items`` has one row per key. Items of no units take no room and are spread evenly over the
    containers (container 0 when there are no others). An empty table gives an empty result. The plan
    holds at most a few slots per length up to the capacity, which bounds what is collected and
    broadcast.
    """
    spark = items.sparkSession
    parts = cut_lineage(pieces(items, key, size, capacity))  # read three times; computing sizes is the costly part
    histogram = {int(r[0]): int(r[1]) for r in parts.filter("n_units > 0").groupBy("n_units").count().collect()}  # at most capacity rows
    slots, containers = plan(histogram, capacity)
    schema = T.StructType([T.StructField(n, t) for n, t in (("length", T.IntegerType()), ("rank_from", T.LongType()), ("rank_to", T.LongType()), ("container", T.LongType()), ("each", T.IntegerType()))])
    planned = spark.createDataFrame([(s.length, s.rank_from, s.rank_to, s.container, s.each) for s in slots], schema)
    ranked = ranked_within_length(parts, key, buckets or default_parallelism(spark))
    fits = (F.col("n_units") == F.col("length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    sized = ranked.filter("n_units > 0").join(F.broadcast(planned), fits)
    sized = sized.select(key, "piece_no", "first_unit", "n_units", (F.col("container") + F.floor((F.col("rank") - F.col("rank_from")) / F.col("each"))).cast("bigint").alias("container_id"))
    empty = ranked.filter("n_units = 0").select(key, "piece_no", "first_unit", "n_units", F.pmod(F.col("rank"), F.lit(max(1, containers))).cast("bigint").alias("container_id"))
    return sized.unionByName(empty)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """How full the containers are: their number, the units in them, and the share left over."""
    per = packed.groupBy("container_id").agg(F.sum("n_units").cast("bigint").alias("used"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("used").alias("units"),
        F.max("used").alias("fullest"),
        F.sum(F.when(F.col("used") == capacity, 1).otherwise(0)).cast("bigint").alias("full"),
        (1 - F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("unused_share"),
    )
