"""Grids of settings judged against constraints: abstention thresholds, adoption rules, conflicting pairs.

Every case is reduced to a few numbers before the settings are laid over it, so a grid costs one row per
case and setting at most, combined on the map side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators.metrics import f1, ratio

#: Differences below this are none.
EPSILON = 1e-9
#: The constraints of the abstention grid, in the order in which the first broken one is named.
CONSTRAINTS = ("case_floor", "conflict_pair", "abstention", "degraded")


def case_summary(hits: DataFrame, cases: DataFrame, cut: float) -> DataFrame:
    """(case_id, n_relevant, abstain, pair, accepted, good, pair_kept) per case at one cutoff.

    hits: case_id, rank, score, relevant; cases: case_id, n_relevant, abstain (nothing should be adopted), pair
    (its two best relevant hits belong together). A pair is kept if both are accepted; null for other cases.
    """
    ok = F.coalesce(F.col("score") >= cut, F.lit(False))
    per = hits.groupBy("case_id").agg(F.sum(ok.cast("int")).alias("accepted"), F.sum((ok & F.col("relevant")).cast("int")).alias("good"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    both = cases.join(per, "case_id", "left").select(*cases.columns, z("accepted"), z("good"))
    return both.withColumn("pair_kept", F.when(F.col("pair"), F.col("good") >= 2))


def precheck(cases: DataFrame) -> DataFrame:
    """(reason, n): why a grid can't be judged: cases that should abstain though something is relevant to them, pairs
    of fewer than two, or no case of a kind. No row if it can."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    c = cases.agg(n(F.col("abstain") & (F.col("n_relevant") > 0)).alias("contradictory"), n(F.col("pair") & (F.col("n_relevant") < 2)).alias("thin"), n(F.col("abstain")).alias("a"), n(F.col("pair")).alias("p"))
    none = (F.coalesce("a", F.lit(0)) == 0).cast("int") + (F.coalesce("p", F.lit(0)) == 0).cast("int")
    rows = F.array(*[F.struct(F.lit(k).alias("reason"), v.cast("bigint").alias("n")) for k, v in (("contradictory", F.coalesce("contradictory", F.lit(0))), ("thin", F.coalesce("thin", F.lit(0))), ("missing", none))])
    return c.select(F.explode(rows).alias("x")).select("x.*").filter("n > 0")


def abstention_grid(summary: DataFrame, stats: DataFrame, statistics: list[str], taus: list[float]) -> DataFrame:
    """One row per statistic and threshold, with what it keeps, what it breaks, and the first constraint broken.

    summary as ``case_summary`` gives it; stats: case_id and the statistics. A case abstains if its statistic is
    below the threshold; an undefined one leaves the gate open. degraded counts the means (precision, recall, f1)
    that are worse than without a gate, or lost. accept_margin is the smallest distance above the threshold
    among cases with relevant items, abstain_margin the largest among those that should abstain.
    """
    long = stats.select("case_id", F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).alias("value")) for s in statistics])).alias("x")).select("case_id", "x.*")
    every = summary.join(long, "case_id", "left")
    every = every.withColumn("statistic", F.explode(F.when(F.col("statistic").isNull(), F.array(*map(F.lit, statistics))).otherwise(F.array("statistic"))))  # cases without any score stay in every row
    settings = every.withColumn("tau", F.explode(F.array(F.lit(None).cast("double"), *map(F.lit, taus))))
    fired = F.coalesce(F.col("value") < F.col("tau"), F.lit(False))
    accepted, good = F.when(fired, 0).otherwise(F.col("accepted")), F.when(fired, 0).otherwise(F.col("good"))
    p = F.when(accepted > 0, ratio(good, accepted)).when(F.col("n_relevant") == 0, 1.0)
    labelled = F.col("n_relevant") > 0
    margin = F.col("value") - F.col("tau")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int")).cast("bigint")
    points = settings.groupBy("statistic", "tau").agg(
        F.avg(p).alias("precision"), F.avg(ratio(good, F.col("n_relevant"))).alias("recall"), n(labelled & (good == 0)).alias("floor_violations"), n(F.col("pair") & (fired | ~F.col("pair_kept"))).alias("pairs_lost"),
        F.sum(F.when(F.col("abstain"), accepted).otherwise(0)).cast("bigint").alias("abstain_accepted"), F.min(F.when(labelled, margin)).alias("accept_margin"), F.max(F.when(F.col("abstain"), margin)).alias("abstain_margin"),
    ).withColumn("f1", f1(F.col("precision"), F.col("recall")))
    base = points.filter("tau is null").select("statistic", *[F.col(c).alias(f"base_{c}") for c in ("precision", "recall", "f1")])  # one row a statistic
    judged = points.filter("tau is not null").join(F.broadcast(base), "statistic")
    worse = [(F.col(f"base_{c}").isNotNull() & (F.col(c).isNull() | (F.col(c) < F.col(f"base_{c}") - EPSILON))).cast("int") for c in ("precision", "recall", "f1")]
    judged = judged.withColumn("degraded", reduce(lambda a, b: a + b, worse))
    broken = dict(zip(CONSTRAINTS, (F.col("floor_violations") > 0, F.col("pairs_lost") > 0, F.col("abstain_accepted") > 0, F.col("degraded") > 0)))
    first = F.coalesce(*[F.when(c, F.lit(k)) for k, c in broken.items()])
    return judged.select("statistic", "tau", "precision", "recall", "f1", "floor_violations", "pairs_lost", "abstain_accepted", "degraded", "accept_margin", "abstain_margin", first.alias("eliminated_by"))


def directions(hits: DataFrame, cases: DataFrame, floors: list[float], ratios: list[float], margins: list[float]) -> DataFrame:
    """(floor, ratio, margin, preserved, abstains, pairs): which of three aims every setting reaches.

    A hit is adopted if its score is at least the floor, at least ``ratio`` times its case's best and at most
    ``margin`` below it. preserved: every case with relevant items adopts one; abstains: those that should adopt
    nothing; pairs: pair cases adopt their two best relevant hits. Adoption only depends on the score, so
    three scores of a case decide. hits and cases as in ``case_summary``.
    """
    relevant = F.sort_array(F.collect_list(F.when(F.col("relevant"), F.col("score"))), asc=False)  # of the hits of one case
    per = hits.filter(F.col("score").isNotNull()).groupBy("case_id").agg(F.max("score").alias("best"), relevant.alias("r"))
    c = cases.join(per, "case_id", "left").select("n_relevant", "abstain", "pair", "best", F.get("r", F.lit(0)).alias("first"), F.get("r", F.lit(1)).alias("second"))
    grid = F.array(*[F.struct(F.lit(a).alias("floor"), F.lit(b).alias("ratio"), F.lit(m).alias("margin")) for a in floors for b in ratios for m in margins])
    s = c.select("*", F.explode(grid).alias("g"))
    passes = lambda x: F.coalesce((F.col(x) >= F.col("g.floor")) & (F.col(x) >= F.col("g.ratio") * F.col("best")) & (F.col("best") - F.col(x) <= F.col("g.margin")), F.lit(False))
    all_ = lambda of, ok: F.coalesce(F.bool_and(F.when(of, ok)), F.lit(True))
    out = s.groupBy("g").agg(all_(F.col("n_relevant") > 0, passes("first")).alias("preserved"), all_(F.col("abstain"), ~passes("best")).alias("abstains"), all_(F.col("pair"), passes("second")).alias("pairs"))
    return out.select("g.floor", "g.ratio", "g.margin", "preserved", "abstains", "pairs")


def direction_counts(met: DataFrame) -> DataFrame:
    """(aims, n): how many settings reach each aim, each two and all three."""
    names = ("preserved", "abstains", "pairs")
    sets = [(a,) for a in names] + [(names[i], names[j]) for i in range(3) for j in range(i + 1, 3)] + [names]
    sums = [F.sum(reduce(lambda x, y: x & y, [F.col(c) for c in s]).cast("int")).alias("+".join(s)) for s in sets]
    one = met.agg(*sums)
    return one.select(F.explode(F.array(*[F.struct(F.lit("+".join(s)).alias("aims"), F.col(f"`{'+'.join(s)}`").cast("bigint").alias("n")) for s in sets])).alias("x")).select("x.*")


def lifted_partners(accepted: DataFrame, ranking: DataFrame, partners: DataFrame) -> DataFrame:
    """(case_id, evidence_id, partner, partner_rank, partner_score): conflict partners that a case ranks but doesn't
    accept beside an accepted item. accepted: case_id, evidence_id; ranking: case_id, evidence_id, rank, score;
    partners: evidence_id, partner."""
    wanted = accepted.join(partners, "evidence_id").select("case_id", "evidence_id", "partner")
    missing = wanted.join(accepted.select("case_id", F.col("evidence_id").alias("partner")), ["case_id", "partner"], "left_anti")
    ranked = ranking.select("case_id", F.col("evidence_id").alias("partner"), F.col("rank").alias("partner_rank"), F.col("score").alias("partner_score"))
    return missing.join(ranked, ["case_id", "partner"]).select("case_id", "evidence_id", "partner", "partner_rank", "partner_score")
