"""Layers, attempts, judgments, attribution, targets, grids, chunk scores: hand cases."""

import json

import pytest
from pyspark.sql import functions as F

from gneiss.functions import hashing, text
from gneiss.operators import chunking, constraints, evaluation, grids, records, retrieval
from gneiss.operators import regression
from gneiss.sources import fixtures, reports


def test_layers_and_attempts(spark):
    schema = "case_id string, attempt_no int, l1_verdict string, l1_reasons array<string>, l2_expected boolean, l2_verdict string, l2_reasons array<string>"
    rows = [
        ("pass", 1, "pass", [], True, "pass", []), ("second", 1, "reject", ["pii_detected", "schema_violation"], False, None, None), ("second", 2, "pass", [], True, "pass", []), ("twice", 1, "pass", [], True, "reject", ["contradictory_evidence", "unsupported_claim"]), ("twice", 2, "reject", ["missing_citation"], False, None, None),
        ("silent", 1, "pass", [], True, None, None), ("silent", 2, "pass", [], True, "pass", []), ("late", 1, "reject", ["pii_detected"], False, None, None), ("late", 2, "pass", [], True, None, None), ("off", 1, "pass", [], False, None, None), ("open", 1, "reject", ["pii_detected"], False, None, None), ("third", 3, "pass", [], True, "pass", []),
    ]
    combined = evaluation.combine_layers(spark.createDataFrame(rows, schema))
    got = {(r.case_id, r.attempt_no): (r.verdict, r.reasons) for r in combined.collect()}
    assert got["second", 1] == ("reject", ["schema_violation", "pii_detected"]) and got["twice", 1] == ("reject", ["unsupported_claim", "contradictory_evidence"])
    assert got["silent", 1][0] is None and got["off", 1] == ("pass", [])
    out = {r.case_id: (r.status, r.escalation_reason, r.failed_stage, r.attempts) for r in evaluation.fold_attempts(combined).collect()}
    assert out == {
        "pass": ("answered", None, None, 1), "second": ("answered", None, None, 2), "twice": ("escalated", "rejected_twice", None, 2), "silent": ("escalated", "llm_call_failed", "judge", 1), "late": ("escalated", "llm_call_failed", "judge", 2), "off": ("answered", None, None, 1), "open": (None, None, None, 1),
    }
    assert evaluation.fold_attempts(combined.limit(0)).count() == 0


@pytest.mark.parametrize("intent, order, stage, n, want", [("both", "order_not_found", None, 3, "order_not_found"), ("policy", "order_not_found", None, 3, None), ("order", None, None, 0, "no_evidence"), ("policy", None, None, None, "no_evidence"), (None, None, None, 3, "llm_call_failed"), ("order", "missing_order_ref", "text_to_sql", 3, "llm_call_failed"), ("both", None, None, 1, None)])
def test_collection(spark, intent, order, stage, n, want):
    df = spark.createDataFrame([(intent, order, stage, n)], "i string, o string, s string, n int")
    assert df.select(evaluation.collection_outcome(F.col("i"), F.col("o"), F.col("s"), F.col("n")).alias("r")).first().r == want


def test_judgments_that_cannot_be_used(spark):
    schema = "id string, verdict string, reject_reasons array<string>, claim_judgments array<struct<claim_text:string,verdict:string>>, contradictions array<struct<evidence_id_a:string,evidence_id_b:string>>, claims array<string>, evidence_ids array<string>"
    ok = ["pass", [], [("a", "pass"), ("b", "pass")], [], ["b", "a"], ["e", "f"]]
    edits = {
        "ok": {}, "verdict": {0: "maybe"}, "none": {0: None}, "claims": {2: [("a", "pass"), ("a", "pass")]}, "nothing": {2: None}, "reasons": {0: "reject", 1: ["pii_detected"]}, "pair": {3: [("e", "e")]}, "unknown": {3: [("e", "x")]}, "unsupported": {0: "reject", 1: ["unsupported_claim"]}, "rejected": {2: [("a", "reject"), ("b", "pass")]}, "contradiction": {0: "reject", 1: ["contradictory_evidence"]}, "fine": {0: "reject", 1: ["contradictory_evidence"], 3: [("f", "e")]},
    }
    rows = [(k, *[e.get(i, v) for i, v in enumerate(ok)]) for k, e in edits.items()]
    got = {}
    for r in evaluation.judgment_problems(spark.createDataFrame(rows, schema)).collect():
        got.setdefault(r.id, set()).add(r.problem)
    assert got == {"verdict": {"verdict"}, "none": {"verdict"}, "claims": {"claims"}, "nothing": {"claims"}, "reasons": {"reasons"}, "pair": {"pairs"}, "unknown": {"pairs"}, "unsupported": {"unsupported_has_claim"}, "rejected": {"unsupported_has_claim"}, "contradiction": {"contradiction_has_pair"}}


def test_judge_accuracy_leaves_failures_out(spark):
    schema = "expected_verdict string, verdict string, expected_reasons array<string>, reasons array<string>, claims int, claims_matched int, pairs_expected int, pairs_matched int, pairs_extra int, tokens int"
    rows = [("reject", "reject", ["unsupported_claim"], ["unsupported_claim"], 4, 3, 2, 1, 1, 10), ("reject", None, ["unsupported_claim"], None, 9, 0, 9, 0, 0, 5), ("pass", "reject", [], ["unsupported_claim"], 1, 0, 0, 0, 0, 1), ("pass", "pass", None, [], 1, 1, 0, 0, 0, 1)]
    r = evaluation.judge_accuracy(spark.createDataFrame(rows, schema)).first()
    assert (r.total, r.errors, r.detection, r.false_alarm, r.claim_match, r.pair_recall, r.pairs_extra, r.tokens) == (4, 1, 1.0, 0.5, 4 / 6, 0.5, 1, 17) and abs(r.exact_reasons - 2 / 3) < 1e-9


def test_mismatches(spark):
    schema = "id string, status string, escalation_reason string, failed_stage string, reasons array<string>, rejected boolean, expected struct<statuses:array<string>,escalation_reasons:array<string>,expect_reject:boolean,forbidden_reject_reasons:array<string>>"
    rows = [
        ("ok", "answered", None, None, [], False, (["answered"], [], False, None)), ("status", "escalated", "no_evidence", None, None, False, (["answered"], [], False, None)), ("reason", "escalated", "no_evidence", None, None, False, (["escalated"], ["rejected_twice"], False, None)), ("bait", "answered", None, None, [], False, (["answered"], [], True, None)),
        ("unjudged", "escalated", "llm_call_failed", "judge", [], False, (["escalated"], ["llm_call_failed"], True, None)), ("forbidden", "answered", None, None, ["pii_detected"], True, (["answered"], None, False, ["pii_detected"])), ("none", None, None, None, None, None, (None, None, None, None)),
    ]
    got = {r.id: r.mismatches for r in evaluation.golden_mismatches(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"ok": [], "status": ["status"], "reason": ["escalation_reason"], "bait": ["not_rejected"], "unjudged": ["not_judged"], "forbidden": ["forbidden_reason"], "none": ["status"]}


def test_attribution(spark):
    o = [
        ("served", "answered", None, "policy", False, False, 1), ("unserved", "answered", None, "both", False, False, 1), ("generation", "escalated", "rejected_twice", "policy", True, True, 2), ("partial", "escalated", "rejected_twice", "order", True, False, 2), ("retrieval", "escalated", "no_evidence", None, False, False, 0),
        ("zero", "escalated", "no_evidence", "policy", False, False, 0), ("l2", "escalated", "rejected_twice", "policy", True, True, 2), ("order", "escalated", "order_not_found", "both", False, False, 0), ("odd", "answered", None, "policy", False, False, 1), ("odd2", "answered", None, "policy", False, False, 1), ("odd3", "answered", None, "policy", True, True, 2), ("new", "answered", None, "policy", False, False, 1),
    ]
    outcomes = spark.createDataFrame(o, "case_id string, status string, escalation_reason string, intent string, rejected boolean, l2_rejected boolean, attempts int")
    labels = spark.createDataFrame([(c, e) for c in ("served", "unserved", "generation", "partial", "retrieval") for e in ("p1", "p2")] + [(c, None) for c in ("zero", "l2", "order", "odd", "odd2", "odd3")], "case_id string, evidence_id string")
    adopted = spark.createDataFrame([("served", "p1"), ("served", "p2"), ("served", "x"), ("unserved", "p1"), ("generation", "p1"), ("generation", "p2"), ("partial", "p2"), ("l2", "x"), ("odd2", "x"), ("odd3", "x")], "case_id string, evidence_id string")
    got = {r.case_id: (r.classification, r.path, r.missing, r.policy_ran) for r in evaluation.attribute_failures(outcomes, labels, adopted).collect()}
    assert got == {
        "unserved": ("answered_without_relevant_evidence", None, 1, True), "generation": ("generation_issue", None, 0, True), "partial": ("partial_retrieval_failure", None, 1, False), "retrieval": ("retrieval_failure", None, 2, None), "zero": ("expected_no_answer", "retrieval_zero_evidence", 0, True), "l2": ("expected_no_answer", "l2_rejected_with_evidence", 0, True),
        "order": ("expected_no_answer", "order_stage_pre_handoff", 0, True), "odd": ("expected_no_answer", "anomaly: nothing adopted", 0, True), "odd2": ("expected_no_answer", "anomaly: no rejection", 0, True), "odd3": ("expected_no_answer", "anomaly: not escalated", 0, True), "new": ("unlabelled", None, None, True),
    }


def test_targets(spark):
    t = spark.createDataFrame([("a", 1.0, False, False, False), ("b", 0.0, True, False, False), ("c", 0.75, False, True, True), ("d", 0.5, False, False, False)], "metric string, bound double, at_most boolean, probabilistic boolean, alert_only boolean")
    v = spark.createDataFrame([("a", 1.0), ("b", 0.1), ("c", 0.7)], "metric string, value double")
    assert {r.metric: r.verdict for r in evaluation.assess(v, t).collect()} == {"a": "met", "b": "missed", "c": "alert", "d": "not measured"}
    assert {r.metric: r.verdict for r in evaluation.assess(v, t, real=False).collect()}["c"] == "no verdict"


def test_numbers_without_evidence(spark):
    claims = spark.createDataFrame([("a", 0, "7일 안에 30,000원, ORD-0007", ["e"]), ("a", 1, "3일", ["f"]), ("a", 2, None, None), ("a", 3, "10일", ["e", "f"])], "id string, claim_no int, text string, citation_ids array<string>")
    evidence = spark.createDataFrame([("a", "e", "30000원 10일"), ("a", "f", None), ("b", "f", "3일")], "id string, evidence_id string, text string")
    assert {r.claim_no: r.numbers for r in evaluation.unsupported_numbers(claims, evidence).collect()} == {0: ["7"], 1: ["3"]}


HITS = [("a", 1, 0.9, True), ("a", 2, 0.5, False), ("b", 1, 0.4, False), ("b", 2, 0.3, False), ("p", 1, 0.9, True), ("p", 2, 0.7, True), ("p", 3, 0.1, False)]
CASES = [("a", 1, False, False), ("b", 0, True, False), ("p", 2, False, True), ("void", 1, False, False)]


def _grid(spark):
    hits = spark.createDataFrame(HITS, "case_id string, rank int, score double, relevant boolean")
    return hits, spark.createDataFrame(CASES, "case_id string, n_relevant int, abstain boolean, pair boolean")


def test_abstention_grid(spark):
    hits, cases = _grid(spark)
    cases = cases.filter("case_id <> 'void'")
    g = grids.abstention_grid(grids.case_summary(hits, cases, 0.2), retrieval.statistics(hits, "score", 5), ["spread"], [0.0, 0.2, 0.5, 0.9])
    rows = {r.tau: r for r in g.collect()}
    assert [rows[t].eliminated_by for t in (0.0, 0.2, 0.5, 0.9)] == ["abstention", None, "case_floor", "case_floor"]
    assert rows[0.0].abstain_accepted == 2 and rows[0.2].abstain_accepted == 0 and rows[0.9].pairs_lost == 1 and rows[0.9].degraded > 0
    assert abs(rows[0.2].accept_margin - 0.2) < 1e-9 and abs(rows[0.2].abstain_margin + 0.1) < 1e-9
    assert grids.precheck(cases).count() == 0 and {r.reason for r in grids.precheck(cases.filter("not pair").withColumn("n_relevant", F.lit(1))).collect()} == {"contradictory", "missing"}


def test_directions(spark):
    hits, cases = _grid(spark)
    d = grids.directions(hits, cases.filter("case_id <> 'void'"), [0.2, 0.5, 0.8], [0.5], [0.1, 0.5])
    got = {(r.floor, r.margin): (r.preserved, r.abstains, r.pairs) for r in d.collect()}
    assert got == {(0.2, 0.1): (True, False, False), (0.2, 0.5): (True, False, True), (0.5, 0.1): (True, True, False), (0.5, 0.5): (True, True, True), (0.8, 0.1): (True, True, False), (0.8, 0.5): (True, True, False)}
    counts = {r.aims: r.n for r in grids.direction_counts(d).collect()}
    assert counts["preserved"] == 6 and counts["abstains+pairs"] == 1 and counts["preserved+abstains+pairs"] == 1
    assert all(not r.preserved for r in grids.directions(hits, cases, [0.2], [0.5], [0.5]).collect())  # a case without hits adopts nothing


def test_partners_and_pools(spark):
    acc = spark.createDataFrame([("c", 1), ("c", 4), ("d", 1), ("d", 2)], "case_id string, evidence_id int")
    ranking = spark.createDataFrame([("c", 1, 1, 0.9), ("c", 2, 7, 0.2), ("d", 2, 2, 0.8)], "case_id string, evidence_id int, rank int, score double")
    partners = spark.createDataFrame([(1, 2), (2, 1), (4, 9)], "evidence_id int, partner int")
    assert [tuple(r) for r in grids.lifted_partners(acc, ranking, partners).collect()] == [("c", 1, 2, 7, 0.2)]
    fused = spark.createDataFrame([("c", 1, 0.03, 1), ("c", 2, 0.02, 2), ("c", 3, 0.01, 3)], "case_id string, evidence_id int, rrf double, rank int")
    assert retrieval.fusion_pool(fused, 2, 1, 0.025, 100).count() == 1
    for pool, taken, cut in ((2, 2, 0.0), (3, 1, 2 / 160)):
        with pytest.raises(ValueError):
            retrieval.fusion_pool(fused, pool, taken, cut, 100)


def test_unit_scores(spark):
    ranking = spark.createDataFrame([("q", "u1", 1, 0.9), ("q", "u2", 2, 0.5), ("q", "u3", 3, 0.1), ("r", "u3", 1, 0.1), ("s", "u1", 1, 0.9)], "case_id string, unit string, rank int, score double")
    held = spark.createDataFrame([("u1", "c1", 0), ("u1", "c2", 1), ("u2", "c2", 0), ("u2", "c3", 1), ("u3", "c4", 0)], "unit string, clause string, position int")
    relevant = spark.createDataFrame([("q", "c3"), ("q", "c4"), ("r", "c4")], "case_id string, clause string")
    cases = spark.createDataFrame([(c,) for c in "qrst"], "case_id string")
    rows = {r.case_id: r for r in chunking.score_units(ranking, held, relevant, cases, 3, 0.3).collect()}
    q = rows["q"]
    assert (q.recall_at_1, q.recall_at_3, q.recall_at_budget, q.precision, q.recall, q.accepted_units, q.accepted_clauses) == (0.0, 1.0, 0.5, 1 / 3, 0.5, 2, 3)
    assert (rows["r"].precision, rows["r"].recall, rows["s"].recall_at_1, rows["s"].precision, rows["t"].precision) == (None, 0.0, None, 0.0, 1.0)
    cover = {r.case_id: (r.covered, r.extra) for r in chunking.covered_by_one(spark.createDataFrame([("x", "c1"), ("x", "c2"), ("y", "c1"), ("y", "c3"), ("z", "c2")], "case_id string, clause string"), held).collect()}
    assert cover == {"x": (True, 0), "y": (False, None), "z": (True, 1)}


@pytest.mark.parametrize("stretch", [1, 7, 50, 10_000])
def test_overlaps_by_stretches_equal_all_pairs(spark, stretch):
    u = spark.createDataFrame([("d", i, i * 18, i * 18 + 24) for i in range(12)] + [("e", 0, 0, 5)], "doc string, unit int, start_pos int, end_pos int")
    c = spark.createDataFrame([("d", i, i * 13, i * 13 + 11 + i * 9) for i in range(15)] + [("e", 0, 2, 4)], "doc string, clause int, start_pos int, end_pos int")
    got = {(r.doc, r.unit, r.clause, r.shared) for r in chunking.overlaps(u, c, "doc", 0.4, stretch).collect()}
    want = {(a.doc, a.unit, b.clause, s) for a in u.collect() for b in c.collect() if a.doc == b.doc and (s := min(a.end_pos, b.end_pos) - max(a.start_pos, b.start_pos)) > 0 and s / (b.end_pos - b.start_pos) >= 0.4 - 1e-9}
    assert got == want and chunking.overlaps(u, c, "doc", 0.4, stretch).count() == len(want)


def test_attempt_rules(spark):
    schema = "key string, attempt_no int, verdict string, reject_reasons array<string>, l1_verdict string, l1_reject_reasons array<string>, l2_verdict string, l2_reject_reasons array<string>, claim_verdicts string, evidence_contradictions string"
    rows = [("ok", 1, "pass", [], "pass", [], "pass", [], None, None), ("unrecorded", 2, "reject", ["pii_detected"], None, None, None, None, None, None), ("third", 3, "pass", [], None, None, None, None, None, None), ("l2", 1, "reject", ["pii_detected"], "reject", ["pii_detected"], "pass", [], None, None), ("cross", 1, "reject", ["unsupported_claim"], "reject", ["unsupported_claim"], None, None, None, None), ("art", 1, "pass", [], "pass", [], None, None, "x", None), ("sum", 1, "reject", ["pii_detected"], "pass", [], "pass", [], None, None), ("lay", 1, "pass", [], "pass", [], "reject", ["unsupported_claim"], None, None)]
    got = {}
    for r in records.violations(spark.createDataFrame(rows, schema), "key", constraints.attempts()).collect():
        got.setdefault(r.key, set()).add(r.constraint.removeprefix("attempts_"))
    assert got == {"third": {"attempt_no_range"}, "l2": {"l2_requires_l1_pass"}, "cross": {"l1_reject_reasons_enum"}, "art": {"l2_null_means_no_artifacts"}, "sum": {"reasons_compose_layers"}, "lay": {"pass_needs_no_layer_reject", "reasons_compose_layers"}}
    f = spark.createDataFrame([("a", 1, "guard_rejected", None), ("b", 2, "generation_failed", None), ("c", 0, "other", "q")], "key string, attempt_no int, failure_kind string, query_sql string")
    assert {(r.key, r.constraint) for r in records.violations(f, "key", constraints.sql_failures()).collect()} == {("a", "sql_failures_query_present"), ("c", "sql_failures_attempt_no_range"), ("c", "sql_failures_kind_enum")}


def test_loaders_check_both_ways(spark, tmp_path):
    def lines(*rows):
        p = tmp_path / "f.jsonl"
        p.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
        return str(p)

    cases = spark.createDataFrame([("a", "one"), ("b", "two")], "id string, content string")
    evidence = spark.createDataFrame([("p:1",), ("p:2",)], "evidence_id string")
    label = lambda i, *e: {"id": i, "relevant_evidence_ids": list(e), "note": ""}
    assert fixtures.read_labels(spark, lines(label("a", "p:1"), label("b")), cases, evidence).count() == 2
    for rows, what in (((label("a"),), "without labels: b"), ((label("a"), label("b"), label("c")), "unknown cases: c"), ((label("a"), label("a"), label("b")), "more than once: a"), ((label("a", "p:9"), label("b")), "doesn't exist: p:9"), ((label("a", "p:1", "p:1"), label("b")), "repeated"), ((label("a", " "), label("b")), "blank")):
        with pytest.raises(ValueError, match=what):
            fixtures.read_labels(spark, lines(*rows), cases, evidence)
    rewrite = lambda i, o, r="new": {"id": i, "original": o, "rewritten": r, "note": ""}
    assert fixtures.read_rewrites(spark, lines(rewrite("a", "one"), rewrite("b", "two")), cases).count() == 2
    for rows, what in (((rewrite("a", "one"),), "without rewrites: b"), ((rewrite("a", "other"), rewrite("b", "two")), "another text: a"), ((rewrite("a", "one", " "), rewrite("b", "two")), "without text: a")):
        with pytest.raises(ValueError, match=what):
            fixtures.read_rewrites(spark, lines(*rows), cases)
    golden = lambda i, s, e: {"id": i, "category": "x", "content": "t", "expected": {"statuses": s, "escalation_reasons": e, "expect_reject": False}}
    assert fixtures.read_golden(spark, lines(golden("a", ["answered"], []))).count() == 1
    with pytest.raises(ValueError, match="don't fit"):
        fixtures.read_golden(spark, lines(golden("a", ["escalated"], [])))
    with pytest.raises(ValueError, match="contradict"):
        fixtures.read_gate_fixtures(spark, lines({"id": "a", "raw_draft": [1, {"x": None}], "expected": {"verdict": "pass", "reject_reasons": ["x"]}}))
    assert fixtures.read_gate_fixtures(spark, lines({"id": "a", "raw_draft": "text", "expected": {"verdict": "reject", "reject_reasons": ["x"]}})).count() == 1
    judge = {"id": "a", "evidences": [{"id": "e"}], "claims": [{"text": "c", "citation_ids": ["e"]}], "expected": {"verdict": "pass", "reject_reasons": [], "claim_judgments": [{"claim_text": "c", "verdict": "pass"}], "contradictions": []}}
    assert fixtures.read_judge_fixtures(spark, lines(judge)).count() == 1
    with pytest.raises(ValueError, match="a claims"):
        fixtures.read_judge_fixtures(spark, lines(judge | {"claims": []}))
    with pytest.raises(ValueError, match="wrong number: ORD-1"):
        fixtures.read_orders(spark, lines({"order_no": "ORD-1"}))


def test_generated_orders(spark):
    a, b = (fixtures.generate_orders(spark, 500, "2024-02-28", 3, 7) for _ in range(2))
    rows = a.collect()
    assert rows == b.collect() and len({r.order_no for r in rows}) == 500 and {r.order_no[4:12] for r in rows} == {"20240228", "20240229", "20240301"}
    assert a.filter(~records.validate_order_no(F.col("order_no"))).count() == 0 and records.violations(a.withColumns({"shipped_at": F.lit(None).cast("timestamp"), "delivered_at": F.lit(None).cast("timestamp")}), "order_no", constraints.orders()).count() == 0
    with pytest.raises(ValueError):
        fixtures.generate_orders(spark, 20_000, "2024-01-01", 2)


def test_records_written_and_read(spark, tmp_path):
    folder = str(tmp_path)
    i = spark.createDataFrame([("a", "answered"), ("b", "escalated")], "id string, status string")
    e = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x")], "inquiry_id string, sequence int, evidence_id string")
    records.write_records(folder, "one", i, evidence=e)
    records.write_records(folder, "one", i, evidence=e)  # again
    e.withColumn("evidence_id", F.lit("lost")).write.parquet(f"{folder}/evidence/batch=two")  # its inquiries were never written
    rows = {r.id: [x.evidence_id for x in r.evidence] for r in records.read_records(spark, folder, evidence=("sequence", ["evidence_id"])).collect()}
    assert rows == {"a": ["x", "y"], "b": []}


def test_received(spark):
    df = spark.createDataFrame([(" t ", " ord-20240229-0001 "), ("　", None), ("t", " "), ("t", "x"), (None, "x"), ("t", "ORD-20230229-0001")], "content string, order_no string")
    assert [tuple(r)[2:] for r in records.receive(df).collect()] == [("t", "ORD-20240229-0001", None), (None, None, "no_content"), ("t", None, None), (None, None, "bad_order_no"), (None, None, "no_content"), (None, None, "bad_order_no")]


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.shortened(F.lit("a  b\n" + "c" * 300))) == ("a b " + "c" * 196 + "…") and one(text.shortened(F.lit(" a "))) == "a"
    assert one(text.digest(F.lit("x"), "p-")) == "p-2d711642b726" and one(text.order_no(F.lit("2024-02-29").cast("date"), F.lit(7))) == "ORD-20240229-0007"
    with pytest.raises(Exception, match="no sequence"):
        one(text.order_no(F.lit("2024-02-29").cast("date"), F.lit(10_000)))
    assert one(text.setting_id(F.lit("vector"), F.lit(0.3), F.lit("spread"), F.lit(0.06))) == "vector/cut=0.300/stat=spread/tau=0.0600" and one(text.setting_id(F.lit("v"), F.lit(0.5), F.lit(None).cast("string"), F.lit(None).cast("double"))) == "v/cut=0.500/gate=off"
    label = F.lit("Maker `m-5` (effort=low )")
    assert (one(text.model_id(label)), one(text.effort(label)), one(text.model_id(F.lit("m"))), one(text.effort(F.lit("m"))), one(text.rewrite_flag(F.lit("vector_rewrite"))), one(text.rewrite_flag(F.lit("vector"))), one(text.rewrite_flag(F.lit("")))) == ("m-5", "low", None, None, "on", "off", None)
    assert one(text.policy_evidence(F.lit("T"), F.lit("1-1"), F.lit(None).cast("string"), F.lit("c"))) == "[T 1-1] c"
    v = one(hashing.hash_embedding(F.lit("환불 규정"), 16))
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and v == one(hashing.hash_embedding(F.lit("환불규정"), 16)) and hashing.hash_vector("", 4) != [0.0] * 4


def test_report_names_fit_their_runs(tmp_path):
    name = lambda paid, judged, requested=None: reports.report_name(str(tmp_path), paid, judged, requested)
    assert (name(False, False), name(True, False), name(True, True), name(True, True, "evaluation-live-l2-9"), name(False, True, "mine")) == ("evaluation", "evaluation-live", "evaluation-live-l2-1", "evaluation-live-l2-9", "mine")
    (tmp_path / "evaluation-live-l2-1.md").write_text("x")
    assert name(True, True) == "evaluation-live-l2-2"
    for args in ((False, False, "evaluation-live-2"), (False, False, "Evaluation-LIVE"), (True, False, "mine"), (True, True, "evaluation-live-2"), (True, False, "evaluation-live-l2-3"), (True, True, "evaluation-live-l2-1"), (False, False, "../x"), (False, False, ""), (False, False, ".x")):
        with pytest.raises(ValueError):
            name(*args)


def test_reports_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([("b|c", 2.0), ("a", None)], "k string, v double")
    md, js = reports.write_report(str(tmp_path), "r", "Title", {"rows": df})
    assert open(md, encoding="utf-8").read() == "# Title\n\n## rows\n\n| k | v |\n|---|---|\n| a |  |\n| b\\|c | 2.0 |\n" and json.load(open(js, encoding="utf-8"))["rows"][0] == {"k": "a", "v": None}
    with pytest.raises(FileExistsError):
        reports.write_report(str(tmp_path), "r", "Title", {"rows": df})


def test_reports_read_as_runs(spark, tmp_path):
    case = lambda i, ok: {"case_id": i, "matched": ok}
    full = lambda missing: {"conditions": {"started_at": "2", "billed": True, "l2_enabled": True, "generation": "X `g-1`", "condition_fingerprint": {"top_k": "5"}}, "measurement_2_pipeline_agreement": {"match_rate": 0.5, "outcomes": [case("a", True), case("b", False)]}, "failure_attribution": {"computed": True, "cases": [{"case_id": "b", "relevant_evidence_ids": ["p1", "p2"], "missing_relevant_evidence_ids": missing}]}}
    for n, r in (("one", full(["p2"])), ("two", full(None)), ("old", {"conditions": {"measurement2_is_real": True}})):
        (tmp_path / f"{n}.json").write_text(json.dumps(r, indent=1))
    df = reports.read_reports(spark, str(tmp_path))
    assert {r.run_id: (r.paid, r.judged, r.attributed, r.match_rate) for r in df.collect()} == {"one": (True, True, True, 0.5), "two": (True, True, True, 0.5), "old": (True, False, False, None)}
    assert {tuple(r) for r in reports.run_cases(df).collect()} == {(c, r, c == "a") for c in "ab" for r in ("one", "two")}
    assert {tuple(r) for r in reports.run_evidence(df).collect()} == {("b", "one", "p1", True), ("b", "one", "p2", False)}
    derived = regression.derive_conditions(df.select("run_id", "conditions.*"))
    assert {(r.name, r.value) for r in derived.filter("run_id = 'one'").collect()} == {("generation_model", "g-1"), ("top_k", "5")}


def test_rankings_are_checked(spark):
    ok = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.9), ("b", 1, None)], "case_id string, rank int, score double")
    retrieval.require_ranking(ok, "score")
    for rows in ([("a", 1, 0.1), ("a", 2, 0.9)], [("a", 2, 0.1)], [("a", 1, 0.3), ("a", 1, 0.2)]):
        with pytest.raises(ValueError, match="a"):
            retrieval.require_ranking(spark.createDataFrame(rows, "case_id string, rank int, score double"), "score")
