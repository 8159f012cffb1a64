"""Outcomes of recorded runs: layers combined, attempts folded, judgments checked, failures attributed, targets met.

Nothing here calls a model: what models said is a column. Rows of one case are few and are gathered per case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators.gate import REASONS
from gneiss.operators.metrics import ratio

#: The second layer's reasons, and all reasons in the order of the contract.
JUDGE_REASONS = ("unsupported_claim", "contradictory_evidence")
ALL_REASONS = (*REASONS, *JUDGE_REASONS)
#: Reasons of the order stage, which end an inquiry before anything is drafted.
ORDER_STAGE = ("missing_order_ref", "order_not_found", "sql_failed")


def _strings(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def ordered_reasons(*lists: Column) -> Column:
    """The reasons that any of the lists holds, each once, in the contract's order; others are left out."""
    every = F.flatten(F.array(*map(_strings, lists)))
    return F.filter(F.array(*map(F.lit, ALL_REASONS)), lambda r: F.array_contains(every, r))


def combine_layers(attempts: DataFrame) -> DataFrame:
    """``attempts`` with verdict and reasons of both layers together.

    attempts: l1_verdict, l1_reasons, l2_expected (should the second layer have judged?), l2_verdict,
    l2_reasons. A pass needs the first layer's and, where the second judged, its too. A second layer that
    should have judged and didn't gives no verdict (null): silence is no pass.
    """
    passed = (F.col("l1_verdict") == "pass") & (F.col("l2_verdict").isNull() | (F.col("l2_verdict") == "pass"))
    silent = F.col("l2_expected") & F.col("l2_verdict").isNull()
    return attempts.withColumns({"verdict": F.when(~silent, F.when(passed, "pass").otherwise("reject")), "reasons": ordered_reasons(F.col("l1_reasons"), F.col("l2_reasons"))})


def fold_attempts(attempts: DataFrame) -> DataFrame:
    """(case_id, status, escalation_reason, failed_stage, attempts): what at most two attempts come to.

    attempts: case_id, attempt_no, verdict as ``combine_layers`` gives it. The first pass answers; an attempt
    without a verdict ends the case, for a failed judge isn't asked again; two rejections escalate; a single
    rejection is unfinished (null status). Attempts after the end don't count.
    """
    outcome = F.struct("attempt_no", F.coalesce("verdict", F.lit("failed")).alias("o"))
    per = attempts.filter(F.col("attempt_no") <= 2).groupBy("case_id").agg(F.array_sort(F.collect_set(outcome)).alias("a"))
    one, two = F.get("a", F.lit(0))["o"], F.get("a", F.lit(1))["o"]
    last = F.when((one == "reject") & two.isNotNull(), two).otherwise(one)
    reason = F.when(last == "failed", "llm_call_failed").when((one == "reject") & (two == "reject"), "rejected_twice")
    status = F.when(last == "pass", "answered").when(reason.isNotNull(), "escalated")
    return per.select("case_id", status.alias("status"), reason.alias("escalation_reason"), F.when(last == "failed", "judge").alias("failed_stage"), F.when((one == "reject") & two.isNotNull(), 2).otherwise(1).alias("attempts"))


def collection_outcome(intent: Column, order_reason: Column, failed_stage: Column, evidence: Column) -> Column:
    """Why a case ends before a draft, the first that holds: a failed call (also an unknown intent), a reason of the
    order stage where orders were asked for, no evidence; null where drafting may begin."""
    orders = intent.isin("order", "both")
    return F.when(failed_stage.isNotNull() | intent.isNull(), "llm_call_failed").when(orders & order_reason.isNotNull(), order_reason).when(F.coalesce(evidence, F.lit(0)) == 0, "no_evidence")


def judgment_problems(j: DataFrame) -> DataFrame:
    """(id, problem): judgments that can't be used, with every rule they break; a usable one has no row.

    j: id, verdict, reject_reasons, claim_judgments, contradictions, claims (texts), evidence_ids. Claims must be
    judged once each, by their text; ids of contradictions must be collected ones and differ.
    """
    reasons, judged = _strings(F.col("reject_reasons")), F.col("claim_judgments")
    texts = F.array_sort(F.transform(judged, lambda c: c["claim_text"]))
    rejected = F.exists(judged, lambda c: F.coalesce(c["verdict"] == "reject", F.lit(False)))
    pairs = F.coalesce(F.col("contradictions"), F.expr("cast(array() as array<struct<evidence_id_a:string,evidence_id_b:string>>)"))
    bad_pair = F.exists(pairs, lambda p: p["evidence_id_a"].isNull() | p["evidence_id_b"].isNull() | (p["evidence_id_a"] == p["evidence_id_b"]) | ~F.array_contains("evidence_ids", p["evidence_id_a"]) | ~F.array_contains("evidence_ids", p["evidence_id_b"]))
    t = lambda c: F.coalesce(c, F.lit(False))
    rules = {
        "verdict": ~t(F.col("verdict").isin("pass", "reject")),
        "reasons": t(F.size(F.array_except(reasons, F.array(*map(F.lit, JUDGE_REASONS)))) > 0),
        "claims": ~t(texts.eqNullSafe(F.array_sort("claims")) & judged.isNotNull()),
        "claim_verdicts": t(F.exists(judged, lambda c: ~t(c["verdict"].isin("supported", "pass", "reject")))),
        "pairs": t(bad_pair),
        "verdict_has_reasons": t(F.col("verdict") == "reject") != (F.size(reasons) > 0),
        "unsupported_has_claim": F.array_contains(reasons, "unsupported_claim") != t(rejected),
        "contradiction_has_pair": F.array_contains(reasons, "contradictory_evidence") & (F.size(pairs) == 0),
    }
    return j.select("id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("problem"))


def judge_accuracy(judged: DataFrame) -> DataFrame:
    """One row of a judge's accuracy.

    judged: expected_verdict, verdict (null where judging failed), expected_reasons, reasons, claims,
    claims_matched, pairs_expected, pairs_matched, pairs_extra, tokens. Failures leave every denominator, but
    their tokens count.
    """
    ran = F.col("verdict").isNotNull()
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    total = lambda c: F.sum(F.when(ran, F.col(c)).otherwise(0))
    bad, good = ran & (F.col("expected_verdict") == "reject"), ran & (F.col("expected_verdict") == "pass")
    same = F.array_sort(_strings(F.col("reasons"))).eqNullSafe(F.array_sort(_strings(F.col("expected_reasons"))))
    return judged.agg(
        F.count(F.lit(1)).alias("total"), n(~ran).alias("errors"),
        ratio(n(bad & (F.col("verdict") == "reject")), n(bad)).alias("detection"), ratio(n(good & (F.col("verdict") == "reject")), n(good)).alias("false_alarm"),
        ratio(n(ran & same), n(ran)).alias("exact_reasons"), ratio(total("claims_matched"), total("claims")).alias("claim_match"),
        ratio(total("pairs_matched"), total("pairs_expected")).alias("pair_recall"), total("pairs_extra").cast("bigint").alias("pairs_extra"), F.sum("tokens").cast("bigint").alias("tokens"),
    )


def golden_mismatches(outcome: DataFrame) -> DataFrame:
    """``outcome`` with an array of everything in which it departs from what is allowed.

    outcome: status, escalation_reason, failed_stage, reasons (all attempts'), rejected, and expected as
    struct<statuses, escalation_reasons, expect_reject, forbidden_reject_reasons>. The reason is compared
    only where the status is allowed; a rejection that a failed judge made impossible is called so.
    """
    e = F.col("expected")
    allowed = F.array_contains(_strings(e["statuses"]), F.col("status"))
    reason_ok = F.coalesce(F.array_contains(_strings(e["escalation_reasons"]), F.col("escalation_reason")), F.lit(False))
    unjudged = (F.col("escalation_reason") == "llm_call_failed") & (F.col("failed_stage") == "judge")
    no_reject = F.coalesce(e["expect_reject"], F.lit(False)) & ~F.coalesce("rejected", F.lit(False))
    forbidden = F.size(F.array_intersect(_strings(F.col("reasons")), _strings(e["forbidden_reject_reasons"]))) > 0
    kinds = {"status": ~F.coalesce(allowed, F.lit(False)), "escalation_reason": allowed & (F.col("status") == "escalated") & ~reason_ok, "not_judged": no_reject & F.coalesce(unjudged, F.lit(False)), "not_rejected": no_reject & ~F.coalesce(unjudged, F.lit(False)), "forbidden_reason": forbidden}
    return outcome.withColumn("mismatches", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in kinds.items()])))


def attribute_failures(outcomes: DataFrame, labels: DataFrame, adopted: DataFrame) -> DataFrame:
    """(case_id, classification, path, missing, policy_ran): why a case failed; cases served in full have no row.

    outcomes: case_id, status, escalation_reason, intent, rejected, l2_rejected, attempts; labels: case_id,
    evidence_id, the relevant ones (a case with a null one has none); adopted: case_id, evidence_id. Cases
    without a label row are unlabelled. ``path`` tells of a case without relevant evidence which normal way it
    ended, or what is anomalous; missing counts relevant evidence that wasn't adopted; policy_ran is null
    where the intent isn't known.
    """
    gather = lambda d, name: d.groupBy("case_id").agg(F.collect_set("evidence_id").alias(name))
    c = outcomes.join(gather(labels, "relevant"), "case_id", "left").join(gather(adopted, "adopted"), "case_id", "left").withColumn("adopted", _strings(F.col("adopted")))
    relevant, has = F.col("relevant"), F.size("adopted") > 0
    missing = F.size(F.array_except(_strings(relevant), "adopted"))
    escalated = F.coalesce(F.col("status") == "escalated", F.lit(False))
    reason = lambda *r: escalated & F.coalesce(F.col("escalation_reason").isin(*r), F.lit(False))
    failed = F.coalesce("rejected", F.lit(False)) | escalated
    l2 = F.coalesce("l2_rejected", F.lit(False))
    path = (
        F.when(reason(*ORDER_STAGE), "order_stage_pre_handoff")
        .when(reason("no_evidence") & ~has & (F.coalesce("attempts", F.lit(0)) == 0), "retrieval_zero_evidence")
        .when(reason("rejected_twice") & has & l2, "l2_rejected_with_evidence")
        .when(~has, "anomaly: nothing adopted").when(~l2, "anomaly: no rejection").otherwise("anomaly: not escalated")
    )
    none = F.size(_strings(relevant)) == 0
    kind = (
        F.when(relevant.isNull(), "unlabelled").when(none, "expected_no_answer").when(~failed & (missing == 0), None)
        .when(~failed, "answered_without_relevant_evidence").when(missing == 0, "generation_issue").when(missing < F.size(relevant), "partial_retrieval_failure").otherwise("retrieval_failure")
    )
    ran = F.when(F.col("intent").isin("policy", "both"), True).when(F.col("intent") == "order", False)
    return c.select("case_id", kind.alias("classification"), F.when(relevant.isNotNull() & none, path).alias("path"), F.when(relevant.isNotNull(), missing).cast("bigint").alias("missing"), ran.alias("policy_ran")).filter("classification is not null")


def assess(values: DataFrame, targets: DataFrame, real: bool = True) -> DataFrame:
    """(metric, value, verdict): each target's verdict: met, missed, alert (a missed alert line), not measured, or
    no verdict (a probabilistic metric of a run that wasn't real).

    values: metric, value; targets: metric, bound, at_most, probabilistic, alert_only.
    """
    v, b = F.col("value"), F.col("bound")
    met = F.when(F.col("at_most"), v <= b).otherwise(v >= b)
    verdict = F.when(v.isNull(), "not measured").when(F.col("probabilistic") & ~F.lit(real), "no verdict").when(met, "met").when(F.col("alert_only"), "alert").otherwise("missed")
    return targets.join(values, "metric", "left").select("metric", "value", verdict.alias("verdict"))


def unsupported_numbers(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, claim_no, numbers): numbers of a claim that none of the evidence it cites holds.

    claims: id, claim_no, text, citation_ids; evidence: id, evidence_id, text. Numbers are runs of digits, with
    separators between them and zeros at the front left out.
    """
    cited = claims.select("id", "claim_no", F.explode("citation_ids").alias("evidence_id")).distinct().join(evidence.select("id", "evidence_id", numbers(F.col("text")).alias("known")), ["id", "evidence_id"])
    known = cited.groupBy("id", "claim_no").agg(F.array_distinct(F.flatten(F.collect_list("known"))).alias("known"))
    both = claims.select("id", "claim_no", numbers(F.col("text")).alias("said")).join(known, ["id", "claim_no"], "left")
    left = F.array_sort(F.array_except("said", _strings(F.col("known"))))
    return both.select("id", "claim_no", left.alias("numbers")).filter(F.size("numbers") > 0)


def numbers(text: Column) -> Column:
    """array<string>: the different numbers of a text; none for null."""
    runs = F.regexp_extract_all(text, F.lit(r"[0-9][0-9,.\-]*"), F.lit(0))
    plain = F.transform(runs, lambda x: F.regexp_replace(F.regexp_replace(x, r"[^0-9]", ""), "^0+(?=[0-9])", ""))
    return F.array_distinct(_strings(plain))
