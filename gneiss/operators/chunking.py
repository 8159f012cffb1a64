"""Fixed-size windows over texts, clause spans in a document, and what overlaps what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fixed_windows(df: DataFrame, key: str, length: str, size: int, overlap: int) -> DataFrame:
    """(key, window_no, start_pos, end_pos): windows of ``size`` that share ``overlap``; the last ends at the
    text's end, and no window follows it. Empty and null lengths have none."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    stride = size - overlap
    n = F.when(F.col(length) <= size, 1).otherwise(1 + F.ceil((F.col(length) - size) / stride)).cast("int")
    w = df.filter(F.col(length) > 0).select(key, F.col(length).alias("len"), F.explode(F.sequence(F.lit(0), n - 1)).alias("window_no"))
    return w.select(key, "window_no", (F.col("window_no") * stride).cast("bigint").alias("start_pos"), F.least(F.col("window_no") * stride + size, F.col("len")).cast("bigint").alias("end_pos"))


def spans(clauses: DataFrame, document: str, order: str, clause: str, length: str, gap: int = 1) -> DataFrame:
    """(document, clause, position, start_pos, end_pos): where clauses lie in their document when they follow
    each other with ``gap`` characters between. Windows are per document."""
    w = Window.partitionBy(document).orderBy(order)
    before = F.coalesce(F.sum(F.col(length) + gap).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = clauses.select(document, clause, (F.row_number().over(w) - 1).alias("position"), before.cast("bigint").alias("start_pos"), F.col(length).alias("len"))
    return s.select(document, clause, "position", "start_pos", (F.col("start_pos") + F.col("len")).cast("bigint").alias("end_pos"))


#: Characters of a stretch by which windows and clauses find each other.
STRETCH = 1_024


def overlaps(units: DataFrame, clauses: DataFrame, document: str, containment: float, stretch: int = STRETCH) -> DataFrame:
    """(document, unit, clause, shared, ratio): clauses of which a unit holds at least the share ``containment``.

    An equi-join on the document and the stretch of it: each side is listed in the stretches it touches, and a
    pair counts in the first that both touch. So a window only meets clauses near it.
    """
    in_ = lambda d, a, b: d.withColumn("__s", F.explode(F.sequence(F.floor(F.col(a) / stretch), F.greatest(F.floor(F.col(a) / stretch), F.floor((F.col(b) - 1) / stretch)))))
    u = in_(units.select(document, F.col("unit"), F.col("start_pos").alias("us"), F.col("end_pos").alias("ue")), "us", "ue")
    c = in_(clauses.select(document, F.col("clause"), F.col("start_pos").alias("cs"), F.col("end_pos").alias("ce")), "cs", "ce")
    met = u.join(c, [document, "__s"]).filter(F.col("__s") == F.greatest(F.floor(F.col("us") / stretch), F.floor(F.col("cs") / stretch)))
    both = met.withColumn("shared", F.least("ue", "ce") - F.greatest("us", "cs")).filter(F.col("shared") > 0)
    share = F.col("shared") / F.nullif(F.col("ce") - F.col("cs"), F.lit(0))
    return both.withColumn("ratio", share).filter(F.col("ratio") >= containment - 1e-9).select(document, "unit", "clause", "shared", "ratio")


def corpus_statistics(units: DataFrame, held: DataFrame, clauses: DataFrame, document: str) -> DataFrame:
    """One row: units, characters, mean length, mean and largest number of clauses held, clauses no unit holds."""
    per = units.join(held.groupBy(document, "unit").agg(F.count(F.lit(1)).alias("n")), [document, "unit"], "left")
    a = per.agg(F.count(F.lit(1)).alias("units"), F.sum(F.col("end_pos") - F.col("start_pos")).cast("bigint").alias("characters"), F.avg(F.col("end_pos") - F.col("start_pos")).alias("mean_length"), F.avg(F.coalesce("n", F.lit(0))).alias("mean_clauses"), F.max(F.coalesce("n", F.lit(0))).cast("bigint").alias("most_clauses")).withColumn("one", F.lit(1))
    b = clauses.select(document, "clause").distinct().join(held.select(document, "clause").distinct(), [document, "clause"], "left_anti").agg(F.count(F.lit(1)).alias("unreachable")).withColumn("one", F.lit(1))
    return a.join(b, "one").drop("one")


def adjacent(wanted: DataFrame, positions: DataFrame, document: str) -> DataFrame:
    """(case_id, adjacent): do the clauses a case wants lie side by side in one document?"""
    w = wanted.join(positions, [document, "clause"])
    lag = F.lag("position").over(Window.partitionBy("case_id", document).orderBy("position"))
    step = w.withColumn("step", F.col("position") - lag)
    return step.groupBy("case_id").agg(((F.countDistinct(document) == 1) & F.coalesce(F.bool_and(F.col("step") == 1), F.lit(True))).alias("adjacent"))


def covered_by_one(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """(case_id, covered, extra): does a single unit hold all that a case wants, and the fewest other clauses in one that does.

    wanted: case_id, clause; held: unit, clause (units named across documents). A case wants few clauses.
    """
    sizes = held.groupBy("unit").agg(F.countDistinct("clause").alias("size"))
    need = wanted.distinct().groupBy("case_id").agg(F.count(F.lit(1)).alias("need"))
    have = wanted.distinct().join(held.select("unit", "clause").distinct(), "clause").groupBy("case_id", "unit").agg(F.count(F.lit(1)).alias("have"))
    full = have.join(need, "case_id").filter(F.col("have") == F.col("need")).join(sizes, "unit")
    best = full.groupBy("case_id").agg(F.min(F.col("size") - F.col("need")).alias("extra"))
    return need.join(best, "case_id", "left").select("case_id", F.col("extra").isNotNull().alias("covered"), "extra")


def score_units(ranking: DataFrame, held: DataFrame, relevant: DataFrame, cases: DataFrame, k: int, cut: float) -> DataFrame:
    """One row per case: what its ranked units bring of the clauses that are relevant to it.

    ranking: case_id, unit, rank, score; held: unit, clause, position (of the clause in its unit); relevant: case_id,
    clause; cases: case_id. Clauses come in the order of the units, each once, where it comes first. recall_at_n counts
    the clauses of the first n units, recall_at_budget the first k clauses; accepted are the clauses of the first k units
    whose score reaches the cut. Recall is null without relevant clauses; precision with nothing accepted is 1 if
    nothing is relevant, else null.
    """
    brought = ranking.join(held, "unit")
    first = brought.groupBy("case_id", "clause").agg(F.min(F.struct("rank", "position")).alias("at"), F.min(F.when((F.col("rank") <= k) & (F.col("score") >= cut), F.col("rank"))).alias("taken"))
    order = Window.partitionBy("case_id").orderBy("at", "clause")
    marked = first.withColumn("place", F.row_number().over(order)).join(relevant.distinct().withColumn("rel", F.lit(1)), ["case_id", "clause"], "left")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    rel = F.col("rel").isNotNull()
    per = marked.groupBy("case_id").agg(*[n(rel & (F.col("at.rank") <= m)).alias(f"t{m}") for m in (1, 3, 5)], n(rel & (F.col("place") <= k)).alias("budget"), n(F.col("taken").isNotNull()).alias("accepted"), n(rel & F.col("taken").isNotNull()).alias("good"))
    units = ranking.filter((F.col("rank") <= k) & (F.col("score") >= cut)).groupBy("case_id").agg(F.count(F.lit(1)).alias("units"))
    need = relevant.distinct().groupBy("case_id").agg(F.count(F.lit(1)).alias("need"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = lambda a: z(a) / F.nullif(F.col("need").cast("double"), F.lit(0.0))
    all_ = cases.select("case_id").distinct().join(per, "case_id", "left").join(units, "case_id", "left").join(need, "case_id", "left")
    precision = F.when(z("accepted") > 0, z("good") / F.nullif(z("accepted").cast("double"), F.lit(0.0))).when(z("need") == 0, 1.0)
    return all_.select("case_id", *[share(f"t{m}").alias(f"recall_at_{m}") for m in (1, 3, 5)], share("budget").alias("recall_at_budget"), precision.alias("precision"), share("good").alias("recall"), z("units").alias("accepted_units"), z("accepted").alias("accepted_clauses"))
