"""Retrieval metrics with null-aware denominators, sweeps, grids and margins.

A measure that has nothing to be divided by is null, never 0, and leaves the mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null when b is 0 or null."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def case_metrics(hits: DataFrame, cases: DataFrame, cut: float, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """(case_id, recall_at_*, precision, recall, accepted) per case.

    hits: case_id, rank, score, relevant; cases: case_id, n_relevant (all cases, also without hits).
    Recall is null without relevant items. Precision with nothing accepted is 1 if nothing is relevant
    and null otherwise.
    """
    ok = F.coalesce(F.col("score") >= cut, F.lit(False))
    per = hits.groupBy("case_id").agg(
        *[F.sum((F.col("relevant") & (F.col("rank") <= k)).cast("int")).alias(f"top_{k}") for k in ks],
        F.sum(ok.cast("int")).alias("accepted"),
        F.sum((ok & F.col("relevant")).cast("int")).alias("good"),
    )
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = cases.join(per, "case_id", "left")
    n = F.col("n_relevant")
    precision = F.when(z("accepted") > 0, ratio(z("good"), z("accepted"))).when(n == 0, 1.0)
    return joined.select("case_id", *[ratio(z(f"top_{k}"), n).alias(f"recall_at_{k}") for k in ks], precision.alias("precision"), ratio(z("good"), n).alias("recall"), z("accepted").alias("accepted"))


def macro(per_case: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Means over the cases that have a value, and how many those are."""
    agg = [x for c in columns for x in (F.avg(c).alias(c), F.count(c).alias(f"n_{c}"))]
    return per_case.groupBy(*(by or [])).agg(*agg)


def f1(p: Column, r: Column) -> Column:
    """Harmonic mean of two means; null if either is null, 0 if both are 0."""
    return F.when(p.isNull() | r.isNull(), None).when(p + r == 0, 0.0).otherwise(2 * p * r / F.nullif(p + r, F.lit(0.0)))


def axis(start: str, stop: str, step: str) -> list[float]:
    """Evenly spaced decimals from start to stop, both included; the step must divide the range."""
    from decimal import Decimal

    a, b, s = Decimal(start), Decimal(stop), Decimal(step)
    if s <= 0 or (b - a) % s != 0:
        raise ValueError("the step must divide the range")
    return [float(a + s * i) for i in range(int((b - a) / s) + 1)]


def sweep(hits: DataFrame, cases: DataFrame, cuts: list[float]) -> DataFrame:
    """(cut, precision, recall, f1, n_precision, n_recall) for every cutoff, from one pass over the hits.

    The short axis of cutoffs is exploded inside each case's row, after each case has been reduced.
    """
    per = hits.filter(F.col("score").isNotNull()).select("case_id", F.col("relevant").cast("int").alias("rel"), F.explode(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col("score") >= c)).alias("cut"))
    counted = per.groupBy("case_id", "cut").agg(F.count(F.lit(1)).alias("accepted"), F.sum("rel").alias("good"))
    every = cases.select("case_id", "n_relevant", F.explode(F.array(*map(F.lit, cuts))).alias("cut"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = every.join(counted, ["case_id", "cut"], "left")
    p = F.when(z("accepted") > 0, ratio(z("good"), z("accepted"))).when(F.col("n_relevant") == 0, 1.0)
    m = joined.select("cut", p.alias("precision"), ratio(z("good"), F.col("n_relevant")).alias("recall")).groupBy("cut").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.count("precision").alias("n_precision"), F.count("recall").alias("n_recall"))
    return m.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def best_cut(swept: DataFrame) -> DataFrame:
    """The row of highest F1, then precision, then recall, then cutoff; none if no F1 is defined."""
    key = F.struct(*[F.round(c, 9) for c in ("f1", "precision", "recall")], "cut")
    return swept.filter(F.col("f1").isNotNull()).agg(F.max_by(F.struct("cut", "precision", "recall", "f1"), key).alias("r")).filter(F.col("r").isNotNull()).select("r.*")


def separation(stats: DataFrame, statistic: str, abstains: Column) -> DataFrame:
    """One row: the largest value among cases that should abstain, the smallest among the others, the
    threshold halfway and the margin between; who is tightest on each side (ties: smaller id)."""
    v = F.col(statistic)
    high = F.max(F.when(abstains & v.isNotNull(), F.struct(v.alias("v"), (-F.col("case_id")).alias("i"))))
    low = F.min(F.when(~abstains & v.isNotNull(), F.struct(v.alias("v"), F.col("case_id").alias("i"))))
    r = stats.agg(high.alias("high"), low.alias("low"))
    return r.select(
        F.lit(statistic).alias("statistic"), F.col("high.v").alias("abstain_max"), (-F.col("high.i")).alias("abstain_case"), F.col("low.v").alias("answer_min"), F.col("low.i").alias("answer_case"),
        ((F.col("high.v") + F.col("low.v")) / 2).alias("threshold"), (F.col("low.v") - F.col("high.v")).alias("margin"),
    )


def adoption_grid(hits: DataFrame, cases: DataFrame, floors: list[float], ratios: list[float], margins: list[float]) -> DataFrame:
    """(floor, ratio, margin, kept_cases, kept_relevant, kept_other): what every setting adopts.

    A hit is adopted if its score is at least the floor, at least ``ratio`` times its case's best, and
    at most ``margin`` below it. The settings are exploded per hit that could pass the loosest of them.
    """
    best = hits.groupBy("case_id").agg(F.max("score").alias("best"))
    loosest = hits.join(best, "case_id").filter((F.col("score") >= min(floors)) & (F.col("score") >= F.col("best") * min(ratios)) & (F.col("score") >= F.col("best") - max(margins)))
    grid = F.array(*[F.struct(F.lit(a).alias("floor"), F.lit(b).alias("ratio"), F.lit(c).alias("margin")) for a in floors for b in ratios for c in margins])
    per = loosest.select("case_id", "relevant", F.explode(F.filter(grid, lambda g: (F.col("score") >= g["floor"]) & (F.col("score") >= F.col("best") * g["ratio"]) & (F.col("score") >= F.col("best") - g["margin"]))).alias("g"))
    case_level = per.groupBy("g", "case_id").agg(F.sum(F.col("relevant").cast("int")).alias("rel"), F.sum((~F.col("relevant")).cast("int")).alias("other"))
    kept = case_level.groupBy("g").agg(F.count(F.lit(1)).alias("kept_cases"), F.sum("rel").alias("kept_relevant"), F.sum("other").alias("kept_other"))
    every = hits.sparkSession.createDataFrame([(a, b, c) for a in floors for b in ratios for c in margins], "floor double, ratio double, margin double")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return every.join(kept.select("g.*", "kept_cases", "kept_relevant", "kept_other"), ["floor", "ratio", "margin"], "left").select("floor", "ratio", "margin", z("kept_cases"), z("kept_relevant"), z("kept_other"))


def floor_bounds(hits: DataFrame, abstains: Column) -> DataFrame:
    """One row: how high a floor may be (the least best relevant score of any case that has one) and must
    be (the largest best score of a case that should abstain)."""
    per = hits.groupBy("case_id").agg(F.max(F.when(F.col("relevant"), F.col("score"))).alias("best_relevant"), F.max("score").alias("best"), F.first(abstains).alias("abstains"))
    return per.agg(F.min(F.when(~F.col("abstains"), F.col("best_relevant"))).alias("ceiling"), F.max(F.when(F.col("abstains"), F.col("best"))).alias("threshold"))


def percentile_rank(values: DataFrame, column: str, by: list[str], points: tuple[float, ...]) -> DataFrame:
    """Nearest-rank percentiles (no interpolation), exact; null for groups without values."""
    return values.groupBy(*by).agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})").alias(f"p{round(p * 100)}") for p in points])


def majority(votes: DataFrame, keys: list[str], voter: str, runs: Column) -> DataFrame:
    """Keys that more than half of the runs name: at least floor(runs / 2) + 1."""
    return votes.groupBy(*keys).agg(F.countDistinct(voter).alias("votes"), F.first(runs).alias("runs")).filter(F.col("votes") >= F.floor(F.col("runs") / 2) + 1)


def common_or_unknown(c: Column) -> Column:
    """An aggregate: the one value of a group; null if values differ or any is null."""
    return F.when((F.count(F.lit(1)) == F.count(c)) & (F.min(c) == F.max(c)), F.min(c))


def previous(df: DataFrame, by: list[str], order: str, column: str) -> DataFrame:
    """The value before, in each group."""
    return df.withColumn(f"previous_{column}", F.lag(column).over(Window.partitionBy(*by).orderBy(order)))
