"""Queries of evaluation: layers, attempts, judgments, agreement, attribution and targets.

Recorded attempts are the drafts of the gate fixtures, two to a case in the order of their numbers, judged by
the judge fixture of the same number; outcomes and adopted evidence are those of the inquiries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.text import order_key
from gneiss.operators import constraints, evaluation, records, skew
from gneiss.plans import gate
from gneiss.tables import records_of, table


def _number(c: str):
    return F.regexp_extract(c, r"(\d+)", 1).cast("bigint")


def _attempts(spark, folder) -> DataFrame:
    """Both layers of every attempt; the second judges what the first lets pass, and fails where no fixture has its number."""
    _, l1 = gate._verdicts(spark, folder)
    j = records_of(spark, folder, "judge_fixtures", ["id"], ["expected"]).select(_number("id").alias("n"), F.col("expected.verdict").alias("l2_verdict"), F.col("expected.reject_reasons").alias("l2_reasons"))
    l1 = l1.select(_number("record_id").alias("n"), F.col("verdict").alias("l1_verdict"), F.col("reasons").alias("l1_reasons"), (F.col("verdict") == "pass").alias("l2_expected"))
    both = l1.join(j, "n", "left")
    judged = lambda c: F.when(F.col("l2_expected"), F.col(c)).alias(c)
    return both.select((F.col("n") / 2).cast("bigint").alias("case_id"), (F.col("n") % 2 + 1).cast("int").alias("attempt_no"), "l1_verdict", "l1_reasons", "l2_expected", judged("l2_verdict"), judged("l2_reasons"))


def layer_combine(spark, folder):
    """Every attempt with the verdict and the reasons of both layers."""
    c = evaluation.combine_layers(_attempts(spark, folder))
    return c.select("case_id", "attempt_no", "l1_verdict", "l2_verdict", "verdict", F.array_join("reasons", ",").alias("reasons"))


def attempt_constraints(spark, folder):
    """Attempts that break a structural rule of their table."""
    a = evaluation.combine_layers(_attempts(spark, folder)).withColumnsRenamed({"l1_reasons": "l1_reject_reasons", "l2_reasons": "l2_reject_reasons", "reasons": "reject_reasons"})
    a = a.withColumns({"claim_verdicts": F.lit(None).cast("string"), "evidence_contradictions": F.lit(None).cast("string"), "key": F.concat_ws(":", "case_id", "attempt_no")})
    return records.violations(a, "key", constraints.attempts())


def attempt_outcomes(spark, folder):
    """What the attempts of every case come to."""
    return evaluation.fold_attempts(evaluation.combine_layers(_attempts(spark, folder)))


def collection_outcomes(spark, folder):
    """Per inquiry: why it must end before a draft, from its intent, its order and its evidence."""
    i = records_of(spark, folder, "inquiries", ["id"], ["order_no", "intent_source", "failed_stage"]).select("id", order_key(F.col("order_no")).alias("k"), "intent_source", "failed_stage")
    known = table(spark, folder, "shop_orders").select(F.col("order_no").alias("known")).distinct()
    n = records_of(spark, folder, "inquiry_evidence", ["inquiry_id", "evidence_id"], ["source"]).groupBy(F.col("inquiry_id").alias("id")).agg(F.count(F.lit(1)).alias("evidence"))
    both = skew.lookup(i, known, "k", "known", "left").join(n, "id", "left")
    order = F.when(F.col("k").isNull(), "missing_order_ref").when(F.col("known").isNull(), "order_not_found")
    early = F.when(F.col("failed_stage").isin("intent", "text_to_sql"), F.col("failed_stage"))
    return both.select(F.col("id").alias("inquiry_id"), evaluation.collection_outcome(F.col("intent_source"), order, early, F.col("evidence")).alias("reason"))


def _judgments(spark, folder) -> DataFrame:
    j = records_of(spark, folder, "judge_fixtures", ["id"], ["claims", "evidences", "expected"])
    e = F.col("expected")
    return j.select("id", e["verdict"].alias("verdict"), e["reject_reasons"].alias("reject_reasons"), e["claim_judgments"].alias("claim_judgments"), e["contradictions"].alias("contradictions"), F.transform("claims", lambda c: c["text"]).alias("claims"), F.transform("evidences", lambda x: x["id"]).alias("evidence_ids"))


def judgment_problems(spark, folder):
    """Recorded judgments that can't be used, with the rules they break."""
    return evaluation.judgment_problems(_judgments(spark, folder))


def judge_accuracy(spark, folder):
    """A judge that compares numbers only, measured against the recorded judgments."""
    j = records_of(spark, folder, "judge_fixtures", ["id"], ["claims", "evidences", "expected"])
    claims = j.select("id", F.posexplode("claims").alias("claim_no", "c")).select("id", "claim_no", F.col("c.text").alias("text"), F.col("c.citation_ids").alias("citation_ids"))
    evidence = j.select("id", F.explode("evidences").alias("e")).select("id", F.col("e.id").alias("evidence_id"), F.coalesce("e.evidence_text", "e.content").alias("text"))
    said = evaluation.unsupported_numbers(claims, evidence).select("id", "claim_no", F.lit(True).alias("bad"))
    expected = j.select("id", F.posexplode("expected.claim_judgments").alias("claim_no", "x")).select("id", "claim_no", F.coalesce(F.col("x.verdict") == "reject", F.lit(False)).alias("should"))
    per = claims.select("id", "claim_no").join(said, ["id", "claim_no"], "left").join(expected, ["id", "claim_no"], "left").groupBy("id").agg(F.count(F.lit(1)).alias("claims"), F.sum((F.coalesce("bad", F.lit(False)) == F.col("should")).cast("int")).alias("claims_matched"), F.max(F.coalesce("bad", F.lit(False))).alias("bad"))
    pairs = F.size(F.array_distinct(F.transform(F.coalesce("expected.contradictions", F.expr("cast(array() as array<struct<evidence_id_a:string,evidence_id_b:string>>)")), lambda p: F.array_sort(F.array(p["evidence_id_a"], p["evidence_id_b"])))))
    rows = j.join(per, "id", "left").select(
        F.col("expected.verdict").alias("expected_verdict"), F.when(F.col("bad").isNotNull(), F.when(F.col("bad"), "reject").otherwise("pass")).alias("verdict"),
        F.col("expected.reject_reasons").alias("expected_reasons"), F.when(F.col("bad"), F.array(F.lit("unsupported_claim"))).otherwise(F.array().cast("array<string>")).alias("reasons"), per["claims"].alias("claims"), F.coalesce("claims_matched", F.lit(0)).alias("claims_matched"),
        pairs.alias("pairs_expected"), F.lit(0).alias("pairs_matched"), F.lit(0).alias("pairs_extra"), F.length("id").alias("tokens"),
    )
    a = evaluation.judge_accuracy(rows)
    return a.select("total", "errors", *[F.round(c, 6).alias(c) for c in ("detection", "false_alarm", "exact_reasons", "claim_match", "pair_recall")], "pairs_extra", "tokens")


def unsupported_numbers(spark, folder):
    """Numbers in the claims of judge fixtures that the cited evidence doesn't hold."""
    j = records_of(spark, folder, "judge_fixtures", ["id"], ["claims", "evidences"])
    claims = j.select("id", F.posexplode("claims").alias("claim_no", "c")).select("id", F.col("claim_no").cast("bigint"), F.col("c.text").alias("text"), F.col("c.citation_ids").alias("citation_ids"))
    evidence = j.select("id", F.explode("evidences").alias("e")).select("id", F.col("e.id").alias("evidence_id"), F.coalesce("e.evidence_text", "e.content").alias("text"))
    return evaluation.unsupported_numbers(claims, evidence).select("id", "claim_no", F.array_join("numbers", ",").alias("numbers"))


def _golden(spark, folder) -> DataFrame:
    """Golden questions with the inquiry of the same number as their outcome (none where there is none)."""
    g = records_of(spark, folder, "golden_set", ["id"], ["category", "expected"]).withColumn("n", _number("id"))
    a = evaluation.combine_layers(_attempts(spark, folder))
    per = a.groupBy(F.col("case_id").alias("n")).agg(F.flatten(F.collect_list("reasons")).alias("reasons"), F.max(F.coalesce(F.col("verdict") == "reject", F.lit(False))).alias("rejected"))
    o = evaluation.fold_attempts(a).withColumnRenamed("case_id", "n")
    return g.join(o, "n", "left").join(per, "n", "left")


def golden_mismatches(spark, folder):
    """Golden questions beside the attempts of their number: every departure from the allowed outcomes."""
    return evaluation.golden_mismatches(_golden(spark, folder)).select("id", F.array_join("mismatches", ",").alias("mismatches"))


def agreement_rollup(spark, folder):
    """Per category: cases, matches, and baits: how many were judged, and of those rejected."""
    m = evaluation.golden_mismatches(_golden(spark, folder))
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int")).cast("bigint")
    never = F.coalesce(F.col("failed_stage") == "judge", F.lit(False)) & ~F.coalesce("rejected", F.lit(False))
    bait = F.coalesce("expected.expect_reject", F.lit(False))
    return m.groupBy("category").agg(F.count(F.lit(1)).alias("cases"), n(F.size("mismatches") == 0).alias("matched"), n(bait & ~never).alias("baits"), n(bait & ~never & F.col("rejected")).alias("rejected"), n(bait & never).alias("not_judged"))


def _attributed(spark, folder) -> DataFrame:
    i = records_of(spark, folder, "inquiries", ["id"], ["status", "escalation_reason", "intent_source", "claims", "judge_output_tokens", "output_tokens"])
    rejected = F.coalesce(F.col("escalation_reason") == "rejected_twice", F.lit(False))
    outcomes = i.select(F.col("id").alias("case_id"), "status", "escalation_reason", F.col("intent_source").alias("intent"), rejected.alias("rejected"), (rejected & (F.coalesce("judge_output_tokens", F.lit(0)) > 0)).alias("l2_rejected"), F.when(F.coalesce("output_tokens", F.lit(0)) > 0, 1).otherwise(0).alias("attempts"))
    cited = F.filter(F.flatten(F.transform(F.coalesce("claims", F.expr("cast(array() as array<struct<text:string,citation_ids:array<string>>>)")), lambda c: F.coalesce(c["citation_ids"], F.array().cast("array<string>")))), lambda x: x.startswith("policy:"))
    labels = i.select(F.col("id").alias("case_id"), F.explode_outer(cited).alias("evidence_id"))
    adopted = records_of(spark, folder, "inquiry_evidence", ["inquiry_id", "evidence_id"], ["source"]).select(F.col("inquiry_id").alias("case_id"), "evidence_id")
    return evaluation.attribute_failures(outcomes, labels, adopted)


def failure_attribution(spark, folder):
    """Why inquiries failed: their class, and for those that nothing could answer how they ended."""
    return _attributed(spark, folder)


def attribution_counts(spark, folder):
    """How many cases each class has, and how many of them without policy search."""
    return _attributed(spark, folder).groupBy("classification", "path").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("policy_ran")).cast("int")).cast("bigint").alias("no_policy"))


#: Metric, bound, is it an upper one, is it probabilistic, is it an alert line only.
TARGETS = (("detection_rate", 1.0, False, False, False), ("false_positive_rate", 0.0, True, False, False), ("match_rate", 0.75, False, True, True), ("judge_detection", 0.9, False, True, False))


def metric_targets(spark, folder):
    """The gate's accuracy and the agreement against their targets."""
    a = gate.gate_accuracy(spark, folder)
    m = agreement_rollup(spark, folder).agg((F.sum("matched") / F.nullif(F.sum("cases"), F.lit(0))).alias("v"))
    values = a.select(F.lit("detection_rate").alias("metric"), F.col("detection").alias("value")).unionByName(a.select(F.lit("false_positive_rate").alias("metric"), F.col("false_alarm").alias("value"))).unionByName(m.select(F.lit("match_rate").alias("metric"), F.round("v", 6).alias("value")))
    return evaluation.assess(values, spark.createDataFrame(TARGETS, "metric string, bound double, at_most boolean, probabilistic boolean, alert_only boolean"))


def token_ratios(spark, folder):
    """Tokens of each family and of all, in all and per inquiry; a family that was never measured stays null."""
    i = records_of(spark, folder, "inquiries", ["id"], ["input_tokens", "output_tokens", "embedding_tokens", "judge_input_tokens", "judge_output_tokens", "retrieval_input_tokens", "retrieval_output_tokens"])
    families = {"generation": ("input_tokens", "output_tokens"), "embedding": ("embedding_tokens",), "judge": ("judge_input_tokens", "judge_output_tokens"), "retrieval": ("retrieval_input_tokens", "retrieval_output_tokens")}
    sums = [F.array_compact(F.array(*[F.sum(c) for c in cs])).alias(n) for n, cs in families.items()]
    total = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x))
    one = i.agg(F.count(F.lit(1)).alias("inquiries"), *sums).select("inquiries", *[total(n).alias(n) for n in families])
    every = F.array(*[F.struct(F.lit(n).alias("family"), F.col(n).alias("tokens")) for n in families], F.struct(F.lit("all").alias("family"), total(F.array_compact(F.array(*families))).alias("tokens")))
    rows = one.select("inquiries", F.explode(every).alias("x")).select("x.family", "x.tokens", "inquiries")
    return rows.select("family", "tokens", F.round(F.col("tokens") / F.nullif(F.col("inquiries"), F.lit(0)), 6).alias("per_inquiry"))


QUERIES = {f.__name__: f for f in (layer_combine, attempt_constraints, attempt_outcomes, collection_outcomes, judgment_problems, judge_accuracy, unsupported_numbers, golden_mismatches, agreement_rollup, failure_attribution, attribution_counts, metric_targets, token_ratios)}

# --- SQL twins -------------------------------------------------------------------------------------

_NUM = "regexp_extract({0}, '([0-9]+)', 1)::BIGINT"
_ATT = gate._GP + f""",
jx AS (SELECT DISTINCT ON (id) {_NUM.format('id')} AS n, expected.verdict AS l2v, coalesce(expected.reject_reasons, []) AS l2r FROM judge_fixtures),
att AS (SELECT {_NUM.format('vd.id')} AS n, CASE WHEN len(reasons) = 0 THEN 'pass' ELSE 'reject' END AS l1v, reasons AS l1r FROM vd),
co AS (
  SELECT n // 2 AS case_id, (n % 2 + 1)::INT AS attempt_no, l1v AS l1_verdict, CASE WHEN l1v = 'pass' THEN l2v END AS l2_verdict,
    CASE WHEN l1v = 'reject' THEN 'reject' ELSE l2v END AS verdict,
    list_filter(['schema_violation', 'missing_citation', 'invalid_citation', 'pii_detected', 'unsupported_claim', 'contradictory_evidence'], lambda r: list_contains(l1r, r) OR (l1v = 'pass' AND list_contains(coalesce(l2r, []), r))) AS reasons
  FROM att LEFT JOIN jx USING (n)),
fo AS (
  SELECT case_id, CASE WHEN l = 'pass' THEN 'answered' WHEN l = 'failed' OR (a = 'reject' AND b = 'reject') THEN 'escalated' END AS status, CASE WHEN l = 'failed' THEN 'llm_call_failed' WHEN a = 'reject' AND b = 'reject' THEN 'rejected_twice' END AS escalation_reason, CASE WHEN l = 'failed' THEN 'judge' END AS failed_stage, CASE WHEN a = 'reject' AND b IS NOT NULL THEN 2 ELSE 1 END AS attempts
  FROM (SELECT *, CASE WHEN a = 'reject' AND b IS NOT NULL THEN b ELSE a END AS l FROM (
    SELECT case_id, (list(coalesce(verdict, 'failed') ORDER BY attempt_no))[1] AS a, (list(coalesce(verdict, 'failed') ORDER BY attempt_no))[2] AS b FROM co GROUP BY case_id)))"""
_GM = _ATT + f""",
gx AS (SELECT DISTINCT ON (id) id, category, expected AS e, {_NUM.format('id')} AS n FROM golden_set),
pr AS (SELECT case_id AS n, list_distinct(flatten(list(reasons))) AS reasons, bool_or(coalesce(verdict = 'reject', false)) AS rejected FROM co GROUP BY 1),
gm AS (
  SELECT id, category, failed_stage, coalesce(rejected, false) AS rejected, coalesce(e.expect_reject, false) AS bait, list_filter([
      CASE WHEN NOT coalesce(list_contains(e.statuses, status), false) THEN 'status' END,
      CASE WHEN coalesce(list_contains(e.statuses, status), false) AND status = 'escalated' AND NOT coalesce(list_contains(e.escalation_reasons, escalation_reason), false) THEN 'escalation_reason' END,
      CASE WHEN coalesce(e.expect_reject, false) AND NOT coalesce(rejected, false) AND failed_stage = 'judge' THEN 'not_judged' END,
      CASE WHEN coalesce(e.expect_reject, false) AND NOT coalesce(rejected, false) AND failed_stage IS DISTINCT FROM 'judge' THEN 'not_rejected' END,
      CASE WHEN len(list_intersect(coalesce(reasons, []), coalesce(e.forbidden_reject_reasons, []))) > 0 THEN 'forbidden_reason' END], lambda x: x IS NOT NULL) AS mm
  FROM gx LEFT JOIN fo ON fo.case_id = gx.n LEFT JOIN pr ON pr.n = gx.n)"""
_ROLL = "SELECT category, count(*) AS cases, count(*) FILTER (len(mm) = 0) AS matched, count(*) FILTER (bait AND NOT never) AS baits, count(*) FILTER (bait AND NOT never AND rejected) AS rejected, count(*) FILTER (bait AND never) AS not_judged FROM (SELECT *, coalesce(failed_stage = 'judge', false) AND NOT rejected AS never FROM gm) GROUP BY category"
_NUMS = "list_distinct(list_transform(regexp_extract_all({0}, '[0-9][0-9,.-]*'), lambda x: regexp_replace(regexp_replace(x, '[^0-9]', '', 'g'), '^0+([0-9])', '\\1')))"
_UN = f"""WITH j AS (SELECT DISTINCT ON (id) * FROM judge_fixtures),
cl AS (SELECT id, i - 1 AS claim_no, c.text AS text, c.citation_ids AS cited FROM (SELECT id, unnest(claims) AS c, generate_subscripts(claims, 1) AS i FROM j)),
ev AS (SELECT id, e.id AS evidence_id, {_NUMS.format('coalesce(e.evidence_text, e.content)')} AS known FROM (SELECT id, unnest(evidences) AS e FROM j)),
kn AS (SELECT cl.id, claim_no, flatten(list(known)) AS known FROM cl JOIN ev ON ev.id = cl.id AND list_contains(cl.cited, ev.evidence_id) GROUP BY ALL),
un AS (SELECT id, claim_no, list_sort(list_filter(said, lambda x: NOT list_contains(known, x))) AS nums FROM (SELECT cl.id, cl.claim_no, {_NUMS.format('text')} AS said, coalesce(known, []) AS known FROM cl LEFT JOIN kn USING (id, claim_no)))"""
_AT = f"""WITH o AS (SELECT id AS case_id, status, escalation_reason AS r, intent_source AS intent, coalesce(escalation_reason = 'rejected_twice', false) AS rejected, coalesce(judge_output_tokens, 0) > 0 AS jt, coalesce(output_tokens, 0) > 0 AS drafted,
    list_distinct(list_filter(flatten(list_transform(coalesce(claims, []), lambda c: coalesce(c.citation_ids, []))), lambda x: starts_with(x, 'policy:'))) AS rel FROM {gate._INQ}),
a AS (SELECT inquiry_id AS case_id, list(DISTINCT evidence_id) AS ad FROM {gate._EVI} GROUP BY 1),
x AS (SELECT o.*, coalesce(ad, []) AS ad, len(list_filter(rel, lambda e: NOT list_contains(coalesce(ad, []), e))) AS missing, rejected OR status = 'escalated' AS failed FROM o LEFT JOIN a USING (case_id)),
k AS (SELECT case_id, missing, CASE WHEN intent IN ('policy', 'both') THEN true WHEN intent = 'order' THEN false END AS policy_ran,
  CASE WHEN len(rel) = 0 THEN 'expected_no_answer' WHEN NOT failed AND missing = 0 THEN NULL WHEN NOT failed THEN 'answered_without_relevant_evidence' WHEN missing = 0 THEN 'generation_issue' WHEN missing < len(rel) THEN 'partial_retrieval_failure' ELSE 'retrieval_failure' END AS classification,
  CASE WHEN len(rel) = 0 THEN CASE WHEN status = 'escalated' AND r IN ('missing_order_ref', 'order_not_found', 'sql_failed') THEN 'order_stage_pre_handoff' WHEN status = 'escalated' AND r = 'no_evidence' AND len(ad) = 0 AND NOT drafted THEN 'retrieval_zero_evidence' WHEN rejected AND status = 'escalated' AND len(ad) > 0 AND jt THEN 'l2_rejected_with_evidence'
    WHEN len(ad) = 0 THEN 'anomaly: nothing adopted' WHEN NOT (rejected AND jt) THEN 'anomaly: no rejection' ELSE 'anomaly: not escalated' END END AS path FROM x)"""
_FAMILIES = {"generation": ("input_tokens", "output_tokens"), "embedding": ("embedding_tokens",), "judge": ("judge_input_tokens", "judge_output_tokens"), "retrieval": ("retrieval_input_tokens", "retrieval_output_tokens")}

ORACLE = {
    "layer_combine": _ATT + " SELECT case_id, attempt_no, l1_verdict, l2_verdict, verdict, array_to_string(reasons, ',') AS reasons FROM co",
    "attempt_constraints": _ATT + ", ac AS (SELECT n // 2 || ':' || (n % 2 + 1) AS key, l1v, l1r, CASE WHEN l1v = 'pass' THEN l2v END AS v2, CASE WHEN l1v = 'pass' AND jx.n IS NOT NULL THEN l2raw END AS r2, CASE WHEN l1v = 'reject' THEN 'reject' ELSE l2v END AS v, (SELECT reasons FROM co WHERE co.case_id = att.n // 2 AND co.attempt_no = att.n % 2 + 1) AS r FROM att LEFT JOIN (SELECT jx.*, (SELECT any_value(expected.reject_reasons) FROM judge_fixtures f WHERE regexp_extract(f.id, '([0-9]+)', 1)::BIGINT = jx.n) AS l2raw FROM jx) jx USING (n)) " + gate._VIOLATION("ac", "key", {
        "attempts_verdict_enum": "v IN ('pass', 'reject')", "attempts_reasons_match_verdict": "(v = 'pass' AND len(r) = 0) OR (v = 'reject' AND len(r) > 0)", "attempts_l1_reasons_match_verdict": "(l1v = 'pass' AND len(l1r) = 0) OR (l1v = 'reject' AND len(l1r) > 0)",
        "attempts_l2_reject_reasons_enum": "len(list_filter(r2, lambda x: x NOT IN ('unsupported_claim', 'contradictory_evidence'))) = 0", "attempts_l2_reasons_match_verdict": "CASE WHEN v2 IS NULL THEN r2 IS NULL ELSE r2 IS NOT NULL AND ((v2 = 'pass' AND len(r2) = 0) OR (v2 = 'reject' AND len(r2) > 0)) END",
        "attempts_l2_null_means_no_artifacts": "v2 IS NOT NULL OR r2 IS NULL", "attempts_pass_needs_no_layer_reject": "v <> 'pass' OR (l1v IS DISTINCT FROM 'reject' AND v2 IS DISTINCT FROM 'reject')", "attempts_reasons_compose_layers": "r = l1r || coalesce(r2, [])"}),
    "attempt_outcomes": _ATT + " SELECT * FROM fo",
    "collection_outcomes": f"""SELECT id AS inquiry_id, CASE WHEN failed_stage IN ('intent', 'text_to_sql') OR intent_source IS NULL THEN 'llm_call_failed' WHEN intent_source IN ('order', 'both') AND k IS NULL THEN 'missing_order_ref' WHEN intent_source IN ('order', 'both') AND k NOT IN (SELECT order_no FROM shop_orders) THEN 'order_not_found'
      WHEN NOT EXISTS (SELECT 1 FROM inquiry_evidence e WHERE e.inquiry_id = i.id) THEN 'no_evidence' END AS reason FROM (SELECT id, {gate._key('order_no')} AS k, intent_source, failed_stage FROM {gate._INQ}) i""",
    "judgment_problems": """WITH j AS (SELECT DISTINCT ON (id) id, expected.verdict AS v, coalesce(expected.reject_reasons, []) AS r, expected.claim_judgments AS cj, coalesce(expected.contradictions, []) AS p, list_transform(claims, lambda c: c.text) AS t, list_transform(evidences, lambda x: x.id) AS ids FROM judge_fixtures)
      SELECT id, problem FROM (SELECT id, unnest(list_filter([
        CASE WHEN NOT coalesce(v IN ('pass', 'reject'), false) THEN 'verdict' END, CASE WHEN len(list_filter(r, lambda x: x NOT IN ('unsupported_claim', 'contradictory_evidence'))) > 0 THEN 'reasons' END,
        CASE WHEN cj IS NULL OR NOT coalesce(list_sort(list_transform(cj, lambda c: c.claim_text)) = list_sort(t), false) THEN 'claims' END, CASE WHEN len(list_filter(cj, lambda c: NOT coalesce(c.verdict IN ('supported', 'pass', 'reject'), false))) > 0 THEN 'claim_verdicts' END,
        CASE WHEN len(list_filter(p, lambda x: x.evidence_id_a IS NULL OR x.evidence_id_b IS NULL OR x.evidence_id_a = x.evidence_id_b OR NOT list_contains(ids, x.evidence_id_a) OR NOT list_contains(ids, x.evidence_id_b))) > 0 THEN 'pairs' END,
        CASE WHEN coalesce(v = 'reject', false) <> (len(r) > 0) THEN 'verdict_has_reasons' END, CASE WHEN list_contains(r, 'unsupported_claim') <> (coalesce(len(list_filter(cj, lambda c: coalesce(c.verdict = 'reject', false))), 0) > 0) THEN 'unsupported_has_claim' END,
        CASE WHEN list_contains(r, 'contradictory_evidence') AND len(p) = 0 THEN 'contradiction_has_pair' END], lambda x: x IS NOT NULL)) AS problem FROM j)""",
    "unsupported_numbers": _UN + " SELECT id, claim_no, array_to_string(nums, ',') AS numbers FROM un WHERE len(nums) > 0",
    "judge_accuracy": _UN + """, ex AS (SELECT id, i - 1 AS claim_no, coalesce(x.verdict = 'reject', false) AS should FROM (SELECT id, unnest(expected.claim_judgments) AS x, generate_subscripts(expected.claim_judgments, 1) AS i FROM j)),
      pc AS (SELECT un.id, count(*) AS claims, count(*) FILTER ((len(nums) > 0) = should) AS matched, bool_or(len(nums) > 0) AS bad FROM un LEFT JOIN ex USING (id, claim_no) GROUP BY un.id),
      w AS (SELECT j.id, expected.verdict AS ev, coalesce(expected.reject_reasons, []) AS er, bad, claims_, matched, len(list_distinct(list_transform(coalesce(expected.contradictions, []), lambda p: list_sort([p.evidence_id_a, p.evidence_id_b])))) AS pe FROM j LEFT JOIN (SELECT id, claims AS claims_, matched, bad FROM pc) USING (id))
      SELECT count(*) AS total, count(*) FILTER (bad IS NULL) AS errors, round(count(*) FILTER (bad AND ev = 'reject') / nullif(count(*) FILTER (bad IS NOT NULL AND ev = 'reject'), 0)::DOUBLE, 6) AS detection, round(count(*) FILTER (bad AND ev = 'pass') / nullif(count(*) FILTER (bad IS NOT NULL AND ev = 'pass'), 0)::DOUBLE, 6) AS false_alarm,
        round(count(*) FILTER (bad IS NOT NULL AND list_sort(er) = CASE WHEN bad THEN ['unsupported_claim'] ELSE [] END) / nullif(count(bad), 0)::DOUBLE, 6) AS exact_reasons, round(sum(matched) FILTER (bad IS NOT NULL) / nullif(sum(claims_) FILTER (bad IS NOT NULL), 0)::DOUBLE, 6) AS claim_match,
        round(0 / nullif(sum(pe) FILTER (bad IS NOT NULL), 0)::DOUBLE, 6) AS pair_recall, 0 AS pairs_extra, sum(length(id))::BIGINT AS tokens FROM w""",
    "golden_mismatches": _GM + " SELECT id, array_to_string(mm, ',') AS mismatches FROM gm",
    "agreement_rollup": _GM + " " + _ROLL,
    "failure_attribution": _AT + " SELECT case_id, classification, path, missing, policy_ran FROM k WHERE classification IS NOT NULL",
    "attribution_counts": _AT + " SELECT classification, path, count(*) AS n, sum((NOT policy_ran)::INT)::BIGINT AS no_policy FROM k WHERE classification IS NOT NULL GROUP BY ALL",
    "metric_targets": _GM + f""", ac AS (SELECT round(count(*) FILTER (e.verdict = 'reject' AND len(reasons) > 0) / nullif(count(*) FILTER (e.verdict = 'reject'), 0)::DOUBLE, 6) AS d, round(count(*) FILTER (e.verdict = 'pass' AND len(reasons) > 0) / nullif(count(*) FILTER (e.verdict = 'pass'), 0)::DOUBLE, 6) AS f FROM (SELECT vd.*, fx.expected AS e FROM vd JOIN fx USING (id))), ro AS ({_ROLL}), mr AS (SELECT round(sum(matched) / nullif(sum(cases), 0)::DOUBLE, 6) AS m FROM ro)
      SELECT 'detection_rate' AS metric, d AS value, CASE WHEN d IS NULL THEN 'not measured' WHEN d >= 1 THEN 'met' ELSE 'missed' END AS verdict FROM ac UNION ALL SELECT 'false_positive_rate', f, CASE WHEN f IS NULL THEN 'not measured' WHEN f <= 0 THEN 'met' ELSE 'missed' END FROM ac
      UNION ALL SELECT 'match_rate', m, CASE WHEN m IS NULL THEN 'not measured' WHEN m >= 0.75 THEN 'met' ELSE 'alert' END FROM mr UNION ALL SELECT 'judge_detection', NULL, 'not measured'""",
    "token_ratios": "WITH i AS (SELECT * FROM " + gate._INQ + "), s AS (" + " UNION ALL ".join(f"SELECT '{n}' AS family, CASE WHEN {' AND '.join(f'sum({c}) IS NULL' for c in cs)} THEN NULL ELSE {' + '.join(f'coalesce(sum({c}), 0)' for c in cs)} END::BIGINT AS tokens FROM i" for n, cs in _FAMILIES.items()) + ") SELECT family, tokens, round(tokens / nullif((SELECT count(*) FROM i), 0)::DOUBLE, 6) AS per_inquiry FROM (SELECT * FROM s UNION ALL SELECT 'all', sum(tokens)::BIGINT FROM s)",
}
