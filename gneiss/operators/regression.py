"""Comparing sets of runs: shortfalls per case, lost evidence, conditions that differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.functions.text import effort, model_id, rewrite_flag


def newest(runs: DataFrame, by: list[str], order: str, tie: str, most: int) -> DataFrame:
    """The newest runs of each condition, ``most`` of them, with their place."""
    w = Window.partitionBy(*by).orderBy(F.desc(order), F.desc(tie))
    return runs.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def majority(n: Column) -> Column:
    """The least number of ``n`` runs that is more than half of them."""
    return F.floor(n / 2) + 1


def compare_cases(baseline: DataFrame, candidate: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, baseline_passes, candidate_passes, change) per case; both inputs: case, passes, runs.

    unknown: only one side has the case; shortfall: every run before, less than a majority now; collapse:
    some before, none now; decrease: fewer than before; same otherwise. The first that holds.
    """
    b = baseline.select(case, F.col("passes").alias("baseline_passes"), F.col("runs").alias("baseline_runs"))
    c = candidate.select(case, F.col("passes").alias("candidate_passes"), F.col("runs").alias("candidate_runs"))
    both = b.join(c, case, "full_outer")
    before, now = F.col("baseline_passes"), F.col("candidate_passes")
    change = (
        F.when(before.isNull() | now.isNull(), "unknown")
        .when((before == F.col("baseline_runs")) & (now < majority(F.col("candidate_runs"))), "shortfall")
        .when((before > 0) & (now == 0), "collapse")
        .when(now < before, "decrease")
        .otherwise("same")
    )
    return both.select(case, "baseline_passes", "candidate_passes", change.alias("change"))


def lost(baseline: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """What the baseline's majority had and the candidate's majority lacks."""
    return baseline.select(*keys).distinct().join(candidate.select(*keys).distinct(), keys, "left_anti")


def _accepted(runs: DataFrame, observed: DataFrame, reference: DataFrame) -> DataFrame:
    """(case_id, evidence_id): what more than half of a set's runs accepted of the relevant evidence.

    A run that has a case but no observation of it accepted all: only what was missed is observed.
    """
    total = runs.groupBy("case_id").agg(F.countDistinct("run_id").alias("n"))
    silent = runs.select("case_id", "run_id").distinct().join(observed.select("case_id", "run_id").distinct(), ["case_id", "run_id"], "left_anti")
    full = silent.join(reference, "case_id").select("case_id", "run_id", "evidence_id")
    seen = observed.filter("accepted").select("case_id", "run_id", "evidence_id").unionByName(full).join(reference, ["case_id", "evidence_id"], "left_semi")
    votes = seen.groupBy("case_id", "evidence_id").agg(F.countDistinct("run_id").alias("votes"))
    return votes.join(total, "case_id").filter(F.col("votes") >= majority(F.col("n"))).select("case_id", "evidence_id")


def evidence_lost(baseline: DataFrame, candidate: DataFrame, baseline_seen: DataFrame, candidate_seen: DataFrame, same_labels: bool = True) -> DataFrame:
    """(case_id, evidence_id, outcome): relevant evidence that a majority accepted before and none does now.

    baseline, candidate: case_id, run_id, every run of a case; ..._seen: case_id, run_id, evidence_id,
    accepted, a row per relevant evidence of a case that a run reports (runs leave out cases of which they
    accepted everything). outcome is lost; or, with a null evidence_id and nothing judged, labels_differ
    (both sides report a case, with different evidence), not_borrowed (one side reports it and the labels
    aren't known to be the same) or unobserved (neither side does). Cases of one side alone have no row.
    """
    cases = baseline.select("case_id").distinct().join(candidate.select("case_id").distinct(), "case_id")
    ids = lambda d, name: d.select("case_id", "evidence_id").distinct().groupBy("case_id").agg(F.array_sort(F.collect_set("evidence_id")).alias(name))  # noqa: E731  # a case's labels are few
    known = cases.join(ids(baseline_seen, "b"), "case_id", "left").join(ids(candidate_seen, "c"), "case_id", "left")
    state = (
        F.when(F.col("b").isNull() & F.col("c").isNull(), "unobserved")
        .when(F.col("b") != F.col("c"), "labels_differ")
        .when((F.col("b").isNull() | F.col("c").isNull()) & ~F.lit(same_labels), "not_borrowed")
    )
    known = known.withColumn("outcome", state)
    reference = known.filter("outcome is null").select("case_id", F.explode(F.coalesce("b", "c")).alias("evidence_id"))
    gone = lost(_accepted(baseline, baseline_seen, reference), _accepted(candidate, candidate_seen, reference), ["case_id", "evidence_id"])
    return gone.withColumn("outcome", F.lit("lost")).unionByName(known.filter("outcome is not null").select("case_id", F.lit(None).cast(dict(reference.dtypes)["evidence_id"]).alias("evidence_id"), "outcome"))


def fingerprint_diff(a: DataFrame, b: DataFrame, declared: list[str] = (), paired: dict[str, str] | None = None) -> DataFrame:
    """(name, a_value, b_value, relation): conditions of two runs, each given as rows (name, value).

    same; unknown where a side has no value or a null one; declared or differs where the values differ,
    by whether ``declared`` lists the name. A name that ``paired`` gives a partner is compared together
    with the partner's value: unknown if that is, differing if either does, declared if either is.
    """
    both = a.select("name", F.col("value").alias("a_value")).join(b.select("name", F.col("value").alias("b_value")), "name", "full_outer")
    pairs = F.map_from_arrays(F.array(*[F.lit(k) for k in paired]), F.array(*[F.lit(v) for v in paired.values()])) if paired else F.lit(None).cast("map<string,string>")
    partner = F.try_element_at(pairs, F.col("name")) if paired else F.lit(None).cast("string")
    both = both.withColumn("partner", partner)
    others = both.select(F.col("name").alias("partner"), F.col("a_value").alias("a_other"), F.col("b_value").alias("b_other"))
    both = both.join(others, "partner", "left")
    listed = F.array(*[F.lit(x) for x in declared]) if declared else F.array().cast("array<string>")
    has = F.col("partner").isNotNull()
    relation = (
        F.when(F.col("a_value").isNull() | F.col("b_value").isNull() | has & (F.col("a_other").isNull() | F.col("b_other").isNull()), "unknown")
        .when((F.col("a_value") == F.col("b_value")) & (~has | (F.col("a_other") == F.col("b_other"))), "same")
        .when(F.array_contains(listed, F.col("name")) | has & F.coalesce(F.array_contains(listed, F.col("partner")), F.lit(False)), "declared")
        .otherwise("differs")
    )
    return both.select("name", "a_value", "b_value", relation.alias("relation"))


def verdict(changes: DataFrame, conditions: DataFrame, losses: DataFrame | None = None, runs: int = 3, wanted: int = 3, evidence_known: bool = True, moved: int = 0) -> DataFrame:
    """One row (differing, worse, compared, verdict): incomparable, fail, held or pass, the first that holds.

    incomparable: an undeclared condition differs; fail: a shortfall, a collapse, lost evidence or one of
    ``moved`` rates that should stand still; held: fewer than ``wanted`` runs, evidence not known, or no
    case on both sides. A decrease, an unknown case and an unknown condition are reported, not judged.
    From compare_cases, fingerprint_diff and evidence_lost.
    """
    c = conditions.agg(F.coalesce(F.sum((F.col("relation") == "differs").cast("int")), F.lit(0)).alias("differing")).withColumn("one", F.lit(1))
    n = lambda x: F.coalesce(F.sum(x.cast("int")), F.lit(0))
    s = changes.agg(n(F.col("change").isin("collapse", "shortfall")).alias("worse"), n(F.col("change") != "unknown").alias("compared")).withColumn("one", F.lit(1))
    gone = losses.agg(n(F.col("outcome") == "lost").alias("gone")).withColumn("one", F.lit(1)) if losses is not None else s.select(F.lit(0).alias("gone"), "one")
    held = (F.col("compared") == 0) | F.lit(runs < wanted or not evidence_known)
    v = F.when(F.col("differing") > 0, "incomparable").when((F.col("worse") + F.col("gone") + F.lit(moved)) > 0, "fail").when(held, "held").otherwise("pass")
    return s.join(F.broadcast(c), "one").join(F.broadcast(gone), "one").select("differing", (F.col("worse") + F.col("gone")).alias("worse"), "compared", v.alias("verdict"))


def derive_conditions(runs: DataFrame) -> DataFrame:
    """(run_id, name, value): the conditions of runs, from what their reports state and from descriptions of their parts.

    runs: run_id, generation, embedding, judge (descriptions), strategy, explicit (map of names to values, may be
    null). A description names a model between backticks and may give an effort; what is stated explicitly wins,
    and what neither tells has no row.
    """
    derived = F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in (
        ("generation_model", model_id(F.col("generation"))), ("generation_effort", effort(F.col("generation"))), ("embedding_model", model_id(F.col("embedding"))), ("judge_model", model_id(F.col("judge"))), ("judge_effort", effort(F.col("judge"))), ("query_rewrite", rewrite_flag(F.col("strategy"))),
    )]))
    known = F.map_filter(derived, lambda k, v: v.isNotNull())
    explicit = F.coalesce(F.col("explicit"), F.expr("cast(map() as map<string,string>)"))
    kept = F.map_filter(known, lambda k, v: ~F.map_contains_key(explicit, k))
    return runs.select("run_id", F.explode(F.map_concat(kept, F.map_filter(explicit, lambda k, v: v.isNotNull()))).alias("name", "value"))


def same_conditions(conditions: DataFrame, current: DataFrame, fields: list[str] = ()) -> DataFrame:
    """(run_id, differing, unknown): how many conditions of each run differ from the current run's, and how many aren't
    known on both sides.

    conditions: run_id, name, value; current: name, value. ``fields`` are names that count even if neither side
    has them. Runs are grouped under one condition only if both counts are 0: what isn't known isn't the same.
    """
    runs = conditions.select("run_id").distinct()
    mine = current.select("name", F.col("value").alias("now"))
    names = mine.select("name")
    if fields:
        names = names.unionByName(conditions.sparkSession.createDataFrame([(f,) for f in fields], "name string")).distinct()
    asked = runs.withColumn("one", F.lit(1)).join(F.broadcast(names.withColumn("one", F.lit(1))), "one").drop("one")  # the names of one run's conditions
    every = asked.unionByName(conditions.select("run_id", "name")).distinct()
    both = every.join(conditions.select("run_id", "name", "value"), ["run_id", "name"], "left").join(mine, "name", "left")
    n = lambda c: F.sum(c.cast("int"))
    missing = F.col("value").isNull() | F.col("now").isNull()
    return both.groupBy("run_id").agg(n(~missing & (F.col("value") != F.col("now"))).alias("differing"), n(missing).alias("unknown"))


def assemble(runs: DataFrame, conditions: DataFrame, current: str, size: int = 3, exclude: list[str] = (), fields: list[str] = ()) -> DataFrame:
    """(run_id, place, reason): the set of the current run and the newest runs of its confirmed conditions, ``size`` in all.

    runs: run_id, started_at. Place 1 is the current run. Runs that were passed over before the set was full have
    no place but a reason: differs, or unknown. A set that isn't full stays so.
    """
    mine = conditions.filter(F.col("run_id") == current).select("name", "value")
    others = runs.filter((F.col("run_id") != current) & ~F.col("run_id").isin(list(exclude)))
    state = same_conditions(conditions, mine, fields)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    judged = others.join(state, "run_id", "left").withColumn("reason", F.when(zero("differing") > 0, "differs").when(F.col("differing").isNull() | (zero("unknown") > 0), "unknown"))
    same = judged.filter("reason is null")
    first = Window.partitionBy(F.lit(1)).orderBy(F.desc("started_at"), F.desc("run_id"))
    taken = same.orderBy(F.desc("started_at"), F.desc("run_id")).limit(size - 1).withColumn("place", F.row_number().over(first) + 1)  # at most size - 1 rows
    # Once the set is full, older runs weren't looked at.
    last = taken.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("started_at", "run_id")).alias("last"))
    passed = judged.filter("reason is not null").join(F.broadcast(last), (F.col("n") < size - 1) | (F.struct("started_at", "run_id") > F.col("last")))
    none = F.lit(None).cast("string")
    head = runs.filter(F.col("run_id") == current).select("run_id", F.lit(1).alias("place"), none.alias("reason"))
    return head.unionByName(taken.select("run_id", "place", none.alias("reason"))).unionByName(passed.select("run_id", F.lit(None).cast("int").alias("place"), "reason"))


def promotion_drift(promoted: DataFrame, conditions: DataFrame, head: str) -> DataFrame:
    """(run_id, name, registered, found): where registered runs don't have one condition, or what was registered isn't theirs.

    promoted: name, value, as registered; conditions: run_id, name, value of the registered runs. Rows with the
    head's run_id compare it with what was registered, others compare their run with the head. What a side
    doesn't state is no drift.
    """
    mine = conditions.filter(F.col("run_id") == head).select("name", F.col("value").alias("registered"))
    among = conditions.filter(F.col("run_id") != head).join(mine, "name")
    stated = conditions.filter(F.col("run_id") == head).join(promoted.select("name", F.col("value").alias("registered")), "name")
    return among.unionByName(stated).filter(F.col("value") != F.col("registered")).select("run_id", "name", "registered", F.col("value").alias("found"))
