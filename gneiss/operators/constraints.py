"""The structural rules of the record tables, by table: name to a condition that is broken only where it is false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gneiss.operators.evaluation import ALL_REASONS, JUDGE_REASONS
from gneiss.operators.gate import REASONS

_ORDER_NO = r"\AORD-[0-9]{8}-[0-9]{4}\z"


def contained(array: Column, allowed: tuple[str, ...]) -> Column:
    """Does an array hold nothing but the allowed values? Null for null."""
    return F.size(F.array_except(array, F.array(*map(F.lit, allowed)))) == 0


def _matches(verdict: str, reasons: str) -> Column:
    """No verdict has no reasons; a pass has none of them, a rejection has some."""
    v, r = F.col(verdict), F.col(reasons)
    recorded = r.isNotNull() & (((v == "pass") & (F.size(r) == 0)) | ((v == "reject") & (F.size(r) > 0)))
    return F.when(v.isNull(), r.isNull()).otherwise(recorded)


def orders() -> dict[str, Column]:
    c = F.col
    return {
        "orders_order_no_format": c("order_no").rlike(_ORDER_NO),
        "orders_quantity_positive": c("quantity") > 0,
        "orders_unit_price_nonneg": c("unit_price_krw") >= 0,
        "orders_total_price_nonneg": c("total_price_krw") >= 0,
        "orders_shipped_after_ordered": c("shipped_at").isNull() | (c("shipped_at") >= c("ordered_at")),
        "orders_delivered_after_shipped": c("delivered_at").isNull() | (c("shipped_at").isNotNull() & (c("delivered_at") >= c("shipped_at"))),
    }


def policy_chunks() -> dict[str, Column]:
    return {
        "policy_chunks_embedding_model_nonempty": F.col("embedding_model") != "",
        "policy_chunks_embedding_dimensions_positive": F.col("embedding_dimensions") > 0,
        "policy_chunks_evidence_id_shape": F.col("evidence_id") == F.concat_ws(":", F.lit("policy"), "document_slug", "article"),
    }


def inquiries() -> dict[str, Column]:
    c = F.col
    reason = c("escalation_reason")
    nonneg = lambda *names: F.forall(F.array_compact(F.array(*names)), lambda x: x >= 0)
    return {
        "inquiries_order_no_format": c("order_no").isNull() | c("order_no").rlike(_ORDER_NO),
        "inquiries_intent_source_enum": c("intent_source").isNull() | c("intent_source").isin("policy", "order", "both"),
        "inquiries_status_enum": c("status").isin("answered", "escalated"),
        "inquiries_escalation_reason_enum": reason.isNull() | reason.isin("no_evidence", "missing_order_ref", "order_not_found", "sql_failed", "llm_call_failed", "rejected_twice"),
        "inquiries_terminal_shape": ((c("status") == "answered") & c("answer").isNotNull() & reason.isNull()) | ((c("status") == "escalated") & c("answer").isNull() & reason.isNotNull()),
        "inquiries_latency_nonneg": c("latency_ms") >= 0,
        "inquiries_tokens_nonneg": nonneg("input_tokens", "output_tokens", "embedding_tokens"),
        "inquiries_judge_tokens_nonneg": nonneg("judge_input_tokens", "judge_output_tokens"),
        "inquiries_retrieval_tokens_nonneg": nonneg("retrieval_input_tokens", "retrieval_output_tokens"),
    }


def attempts() -> dict[str, Column]:
    """Of attempts with the verdict and reasons of both layers and of the two together."""
    c = F.col
    empty = F.array().cast("array<string>")
    return {
        "attempts_attempt_no_range": c("attempt_no").between(1, 2),
        "attempts_verdict_enum": c("verdict").isin("pass", "reject"),
        "attempts_reject_reasons_enum": contained(c("reject_reasons"), ALL_REASONS),
        "attempts_reasons_match_verdict": ((c("verdict") == "pass") & (F.size("reject_reasons") == 0)) | ((c("verdict") == "reject") & (F.size("reject_reasons") > 0)),
        "attempts_l1_verdict_enum": c("l1_verdict").isNull() | c("l1_verdict").isin("pass", "reject"),
        "attempts_l2_verdict_enum": c("l2_verdict").isNull() | c("l2_verdict").isin("pass", "reject"),
        "attempts_l1_reject_reasons_enum": contained(c("l1_reject_reasons"), REASONS),
        "attempts_l2_reject_reasons_enum": contained(c("l2_reject_reasons"), JUDGE_REASONS),
        "attempts_l1_reasons_match_verdict": _matches("l1_verdict", "l1_reject_reasons"),
        "attempts_l2_reasons_match_verdict": _matches("l2_verdict", "l2_reject_reasons"),
        "attempts_l2_requires_l1_pass": c("l2_verdict").isNull() | F.coalesce(c("l1_verdict") == "pass", F.lit(False)),
        "attempts_l2_null_means_no_artifacts": c("l2_verdict").isNotNull() | (c("l2_reject_reasons").isNull() & c("claim_verdicts").isNull() & c("evidence_contradictions").isNull()),
        "attempts_pass_needs_no_layer_reject": (c("verdict") != "pass") | (~c("l1_verdict").eqNullSafe("reject") & ~c("l2_verdict").eqNullSafe("reject")),
        "attempts_reasons_compose_layers": c("l1_reject_reasons").isNull() | (c("reject_reasons") == F.concat("l1_reject_reasons", F.coalesce("l2_reject_reasons", empty))),
    }


def evidence() -> dict[str, Column]:
    c = F.col
    sql = (c("source") == "sql") & c("sequence").isNotNull() & c("query_sql").isNotNull() & c("result_rows").isNotNull() & (c("evidence_id") == F.concat_ws(":", F.lit("sql"), "inquiry_id", c("sequence").cast("string")))
    policy = (c("source") == "policy") & c("sequence").isNull() & c("query_sql").isNull() & c("result_rows").isNull() & c("evidence_id").like("policy:%:%")
    return {"evidence_source_enum": c("source").isin("policy", "sql"), "evidence_snapshot_shape": F.coalesce(sql, F.lit(False)) | F.coalesce(policy, F.lit(False))}


def sql_failures() -> dict[str, Column]:
    c = F.col
    return {
        "sql_failures_attempt_no_range": c("attempt_no").between(1, 2),
        "sql_failures_kind_enum": c("failure_kind").isin("guard_rejected", "execution_error", "generation_failed"),
        "sql_failures_query_present": (c("failure_kind") == "generation_failed") | c("query_sql").isNotNull(),
    }
