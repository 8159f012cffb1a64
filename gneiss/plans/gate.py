"""Queries of the gate, the judge's tables, records, rollups and run comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.functions import pii
from gneiss.functions.text import collapse_white, digest, order_key, order_no, policy_evidence, shortened
from gneiss.guard import provenance
from gneiss.operators import constraints, gate, metrics, nested, records, regression, skew
from gneiss.session import cut_lineage
from gneiss.tables import records_of, table

EVIDENCE_SIZES = "cast(array() as array<struct<id:string,source:string,content:string,evidence_text:string>>)"


def _fixtures(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drafts, their triples and their evidence, one row per fixture."""
    f = records_of(spark, folder, "l1_fixtures", ["id"], ["evidences", "raw_draft", "expected"])
    drafts = f.select(F.col("id").alias("record_id"), "raw_draft", "expected")
    e = f.select(F.col("id").alias("record_id"), F.explode("evidences").alias("e")).filter(F.col("e").isNotNull())
    evidence = e.select("record_id", F.col("e.id").alias("evidence_id"), F.coalesce("e.evidence_text", "e.content").alias("text"))
    # Kept: structure, citations and personal data each read the triples, which Python parses.
    return drafts, cut_lineage(nested.json_triples(drafts, "record_id", "raw_draft")), evidence


def gate_schema(spark, folder):
    """Is the draft of each fixture of the right structure?"""
    drafts, triples, _ = _fixtures(spark, folder)
    return gate.structure(triples, drafts)


def gate_citations(spark, folder):
    """Do claims cite nothing, or evidence that wasn't collected?"""
    _, triples, evidence = _fixtures(spark, folder)
    return gate.citations(triples, evidence)


def pii_unsourced(spark, folder):
    """Personal data in a draft that no evidence holds: (record_id, value)."""
    _, triples, evidence = _fixtures(spark, folder)
    return gate.unsourced(triples, evidence.select("record_id", "text")).select("record_id", F.explode("values").alias("value"))


def _verdicts(spark, folder):
    drafts, triples, evidence = _fixtures(spark, folder)
    return drafts, gate.verdicts(drafts, triples, evidence)


def gate_verdict(spark, folder):
    """The gate's verdict on every fixture, with all reasons in order."""
    return _verdicts(spark, folder)[1].select("record_id", "verdict", F.array_join("reasons", ",").alias("reasons"))


def gate_accuracy(spark, folder):
    """The verdicts against the expected ones."""
    drafts, v = _verdicts(spark, folder)
    e = drafts.select("record_id", F.col("expected.verdict").alias("expected_verdict"), F.coalesce("expected.reject_reasons", F.array().cast("array<string>")).alias("expected_reasons"))
    a = gate.accuracy(v.join(e, "record_id"))
    return a.select("measured", "errors", *[F.round(c, 6).alias(c) for c in ("detection", "false_alarm", "exact_reasons")])


def gate_reason_counts(spark, folder):
    """Per reason: how often it was expected, found of those, and found beside them."""
    drafts, v = _verdicts(spark, folder)
    e = drafts.select("record_id", F.explode("expected.reject_reasons").alias("reason")).withColumn("expected", F.lit(1)).distinct()
    g = v.select("record_id", F.explode("reasons").alias("reason")).withColumn("got", F.lit(1))
    b = e.join(g, ["record_id", "reason"], "full_outer")
    n = lambda c: F.sum(c.cast("int")).cast("bigint")
    return b.groupBy("reason").agg(n(F.col("expected").isNotNull()).alias("expected"), n(F.col("expected").isNotNull() & F.col("got").isNotNull()).alias("detected"), n(F.col("expected").isNull()).alias("spurious"))


def _judge(spark, folder):
    return records_of(spark, folder, "judge_fixtures", ["id"], ["claims", "expected"])


def claim_multiset(spark, folder):
    """Where the claims of a fixture and its judgments differ as multisets of texts."""
    j = _judge(spark, folder)
    a = j.select("id", F.explode("claims").alias("c")).select("id", F.col("c.text").alias("text")).filter("text is not null")
    b = j.select("id", F.explode("expected.claim_judgments").alias("c")).select("id", F.col("c.claim_text").alias("text")).filter("text is not null")
    return gate.multiset_difference(a, b, ["id", "text"])


def contradiction_pairs(spark, folder):
    """Contradicting evidence as unordered pairs, once each; pairs of one id or with a null are none."""
    c = _judge(spark, folder).select("id", F.explode("expected.contradictions").alias("c"))
    a, b = F.col("c.evidence_id_a"), F.col("c.evidence_id_b")
    return c.filter(a != b).select("id", F.least(a, b).alias("evidence_a"), F.greatest(a, b).alias("evidence_b")).distinct()


def judge_consistency(spark, folder):
    """Fixtures whose labels contradict themselves: (constraint, key)."""
    e = F.col("expected")
    reasons = F.coalesce(e["reject_reasons"], F.array().cast("array<string>"))
    judged = F.coalesce(e["claim_judgments"], F.expr("cast(array() as array<struct<claim_text:string,verdict:string>>)"))
    texts = F.filter(F.transform("claims", lambda c: c["text"]), lambda x: x.isNotNull())
    return records.violations(_judge(spark, folder), "id", {
        "verdict_has_reasons": (e["verdict"] == "reject") == (F.size(reasons) > 0),
        "unsupported_has_claim": F.array_contains(reasons, "unsupported_claim") == F.exists(judged, lambda c: F.coalesce(c["verdict"] != "supported", F.lit(False))),
        "claim_texts_unique": F.size(F.array_distinct(texts)) == F.size(texts),
    })


def outcome_mismatches(spark, folder):
    """Golden questions beside the inquiries of the same order: outcomes outside the allowed ones, per kind."""
    g = records_of(spark, folder, "golden_set", ["id"], ["order_no", "expected"])
    i = records_of(spark, folder, "inquiries", ["id"], ["order_no", "status", "escalation_reason"])
    # Counted per outcome first: a tenth of the inquiries name one order, and only its few outcomes meet the questions.
    per = i.groupBy(order_key(F.col("order_no")).alias("k"), "status", "escalation_reason").agg(F.count(F.lit(1)).alias("inquiries"))
    both = g.withColumn("k", order_key(F.col("order_no"))).join(per, "k")
    wrong = F.array_compact(F.array(
        F.when(~F.array_contains("expected.statuses", F.col("status")), "status"),
        F.when((F.col("status") == "escalated") & ~F.array_contains("expected.escalation_reasons", F.col("escalation_reason")), "reason"),
    ))
    return both.select("id", "inquiries", F.explode(wrong).alias("mismatch")).groupBy("id", "mismatch").agg(F.sum("inquiries").alias("n"))


# --- records and rollups ---------------------------------------------------------------------------


def constraint_violations(spark, folder):
    """Records of orders, clauses, inquiries and snapshots that break a structural rule; a record counts once however often it was loaded."""
    read = lambda name, keys, cols: records_of(spark, folder, name, keys, cols)
    counters = ["latency_ms", "input_tokens", "output_tokens", "embedding_tokens", "judge_input_tokens", "judge_output_tokens", "retrieval_input_tokens", "retrieval_output_tokens"]
    parts = [
        records.violations(read("shop_orders", ["order_no"], ["quantity", "unit_price_krw", "total_price_krw", "ordered_at", "shipped_at", "delivered_at"]), "order_no", constraints.orders() | {"orders_total_is_product": F.col("total_price_krw").cast("bigint") == F.col("quantity").cast("bigint") * F.col("unit_price_krw")}),
        records.violations(read("policy_chunks", ["id"], ["evidence_id", "document_slug", "article", "embedding_model", "embedding_dimensions"]), "id", constraints.policy_chunks()),
        records.violations(read("inquiries", ["id"], ["order_no", "intent_source", "status", "answer", "escalation_reason", *counters]), "id", constraints.inquiries()),
        records.violations(read("inquiry_evidence", ["inquiry_id", "evidence_id"], ["source", "sequence", "query_sql", "result_rows"]), "evidence_id", constraints.evidence()),
    ]
    return reduce(DataFrame.unionByName, parts)


def receipt_validation(spark, folder):
    """What of every inquiry is taken in, or why it isn't."""
    i = records_of(spark, folder, "inquiries", ["id"], ["content", "order_no"])
    return records.receive(i).select("id", F.length("accepted_content").alias("letters"), F.col("accepted_order_no").alias("order_no"), "error")


def day_sequence(spark, folder):
    """Orders numbered anew within each day, in the order of their times."""
    o = records_of(spark, folder, "shop_orders", ["order_no"], ["ordered_at"]).filter("ordered_at is not null")
    day = F.to_date("ordered_at")
    return o.withColumn("n", F.row_number().over(Window.partitionBy(day).orderBy("ordered_at", "order_no"))).select(F.col("order_no").alias("old"), order_no(day, F.col("n")).alias("new"))


def policy_evidence_text(spark, folder):
    """Clauses as evidence: their digest, the length of the text, and its shortened form."""
    p = records_of(spark, folder, "policy_chunks", ["id"], ["document_title", "article", "article_title", "content"])
    t = policy_evidence(F.col("document_title"), F.col("article"), F.col("article_title"), F.col("content"))
    return p.select("id", digest(t, "p:").alias("digest"), F.length(t).alias("letters"), shortened(t).alias("short"))


def response_objects(spark, folder):
    """Every inquiry as the object that is answered with: all keys are there, lists are never null."""
    i = records_of(spark, folder, "inquiries", ["id"], ["status", "escalation_reason", "failed_stage", "claims", "latency_ms"])
    none = F.expr("cast(array() as array<struct<text:string,citation_ids:array<string>>>)")
    return i.select("id", records.response_json({"id": F.col("id"), "status": F.col("status"), "escalation_reason": F.col("escalation_reason"), "failed_stage": F.col("failed_stage"), "claims": F.coalesce("claims", none), "latency_ms": F.col("latency_ms")}).alias("body"))


def order_no_validate(spark, folder):
    """Every order number that inquiries name, as compared, and whether it has the right form."""
    k = table(spark, folder, "inquiries").select(order_key(F.col("order_no")).alias("order_no")).filter("order_no is not null").distinct()
    return k.select("order_no", records.validate_order_no(F.col("order_no")).alias("valid"))


def order_exists(spark, folder):
    """Inquiries that name an order which exists (whatever became of it)."""
    i = records_of(spark, folder, "inquiries", ["id"], ["order_no"]).select(F.col("id").alias("inquiry_id"), order_key(F.col("order_no")).alias("k")).filter("k is not null")
    known = table(spark, folder, "shop_orders").select("order_no").distinct()
    return skew.lookup(i, known, "k", "order_no", "inner").select("inquiry_id", "order_no")


def phone_normalise(spark, folder):
    """Customers' phone numbers as they are compared."""
    return table(spark, folder, "shop_orders").filter("customer_phone is not null").select("customer_phone", pii.phone(F.col("customer_phone")).alias("phone")).distinct()


def pii_email_extract(spark, folder):
    """E-mail addresses in documents: (doc_id, email, n)."""
    d = table(spark, folder, "documents").filter(F.col("text").contains("@"))
    m = d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pii.PATTERNS["email"]), F.lit(0))).alias("m"))
    return m.groupBy("doc_id", F.lower("m").alias("email")).agg(F.count(F.lit(1)).alias("n"))


def row_render(spark, folder):
    """Orders as the lines that evidence shows: ten per day and product, the rest counted; a group is one day's orders of a product."""
    o = records_of(spark, folder, "shop_orders", ["order_no"], ["ordered_at", "product_name", "product_option", "quantity", "courier"])
    day = o.withColumn("day", F.date_format("ordered_at", "yyyy-MM-dd"))
    first = Window.partitionBy("product_name", "day").orderBy("order_no")
    numbered = day.withColumns({"i": F.row_number().over(first), "n": F.count(F.lit(1)).over(Window.partitionBy("product_name", "day"))})
    shown = numbered.filter(F.col("i") <= records.SHOWN).select("product_name", "day", "n", "i", records.render_row(["order_no", "product_option", "quantity", "courier"], F.col("i")).alias("line"))
    lines = shown.groupBy("product_name", "day", "n").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("l"))  # at most ten a group
    rest = F.col("n") - records.SHOWN
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return lines.select("product_name", "day", F.when(rest > 0, F.concat(text, F.lit("\n... (이하 "), rest.cast("string"), F.lit("건 생략)"))).otherwise(text).alias("lines"))


def sql_evidence_filter(spark, folder):
    """Snapshot rows as flat values (inquiry, evidence, row, column, value), without columns whose name is shaped like
    personal data, and without values shaped like it unless the guard proves their column to be one of the table's own."""
    e = records_of(spark, folder, "inquiry_evidence", ["inquiry_id", "evidence_id"], ["source", "query_sql", "result_rows"]).filter("source = 'sql'").withColumn("k", F.to_json(F.array("inquiry_id", "evidence_id")))
    t = nested.json_triples(e, "k", "result_rows")
    leaf = t.filter(F.col("path").rlike(r"^\[\]\.[^.\[]+$") & ~F.col("kind").isin("object", "array")).withColumn("column_name", F.expr("substring(path, 4)"))
    safe = e.select("k", "inquiry_id", "evidence_id", provenance.proven_columns(F.col("query_sql"), provenance.ORDERS).alias("safe"))
    both = leaf.join(safe, leaf["record_id"] == safe["k"])
    shown = F.coalesce(F.col("value"), F.lit("(없음)"))
    odd = pii.shaped(pii.folded(F.col("column_name"))) | ~F.array_contains("safe", F.col("column_name")) & pii.shaped(pii.folded(shown))
    return both.filter(~odd).select("inquiry_id", "evidence_id", (F.get("ordinals", F.lit(0)) + 1).cast("bigint").alias("row_no"), "column_name", "value")


def sync_plan(spark, folder):
    """A full refresh of the clause table from the clauses that aren't withdrawn."""
    p = records_of(spark, folder, "policy_chunks", ["id"], ["evidence_id", "deleted_at"])
    return records.sync_plan(p.filter("deleted_at is null").select("evidence_id"), p.select("evidence_id"), "evidence_id")


def cache_plan(spark, folder):
    """Which document texts a cache filled from even ids already holds."""
    d = table(spark, folder, "documents")
    return records.cache_plan(d, "text", d.filter("doc_id % 2 = 0 and text is not null").select(F.sha2("text", 256).alias("digest")), "digest")


def index_provenance(spark, folder):
    """The models and dimensions that the clause index was made with."""
    return records.provenance(records_of(spark, folder, "policy_chunks", ["id"], ["embedding_model", "embedding_dimensions"]), ["embedding_model", "embedding_dimensions"])


def nested_children(spark, folder):
    """Inquiries with their snapshots in order, flattened again: the round trip of nesting."""
    i = records_of(spark, folder, "inquiries", ["id"], ["status"]).select(F.col("id").alias("inquiry_id"), "status")
    e = records_of(spark, folder, "inquiry_evidence", ["inquiry_id", "evidence_id"], ["sequence", "source"])
    n = records.nest(i, e, "inquiry_id", "sequence", ["evidence_id", "source"], "evidence")
    return n.select("inquiry_id", "status", F.size("evidence").alias("n"), F.array_join(F.transform("evidence", lambda x: x["evidence_id"]), ",").alias("evidence_ids"))


def record_roundtrip(spark, folder):
    """Claims taken apart into flat tables and put together again: (id, claims, same), ``same`` telling whether every
    claim, text and citation is back in its place."""
    i = records_of(spark, folder, "inquiries", ["id"], ["claims"])
    back = nested.rebuild_claims(nested.typed_triples(i, "id", "claims"))
    both = i.join(back.withColumnRenamed("record_id", "id"), "id", "left")
    return both.select("id", F.when(F.col("claims").isNotNull(), F.size("claims")).alias("claims"), F.col("claims").eqNullSafe(F.col("rebuilt")).alias("same"))


def outcome_histogram(spark, folder):
    """Inquiries per status, reason and stage."""
    i = records_of(spark, folder, "inquiries", ["id"], ["status", "escalation_reason", "failed_stage"])
    return i.groupBy("status", "escalation_reason", "failed_stage").agg(F.count(F.lit(1)).alias("n"))


def latency_percentiles(spark, folder):
    """Nearest-rank p50 and p95 of the latency per status."""
    i = records_of(spark, folder, "inquiries", ["id"], ["status", "latency_ms"])
    return metrics.percentile_rank(i, "latency_ms", ["status"], (0.5, 0.95))


def token_totals(spark, folder):
    """Tokens per family, in all and per inquiry; null where nothing was measured."""
    i = records_of(spark, folder, "inquiries", ["id"], ["intent_source", "input_tokens", "output_tokens", "embedding_tokens", "judge_input_tokens", "judge_output_tokens"])
    s = lambda *cs: reduce(lambda x, y: x + y, [F.sum(c) for c in cs])
    a = i.groupBy("intent_source").agg(F.count(F.lit(1)).alias("inquiries"), s("input_tokens", "output_tokens").alias("generation"), s("embedding_tokens").alias("embedding"), s("judge_input_tokens", "judge_output_tokens").alias("judge"))
    return a.select("intent_source", "inquiries", "generation", "embedding", "judge", F.round((F.col("generation") + F.col("embedding") + F.col("judge")) / F.nullif(F.col("inquiries"), F.lit(0)), 6).alias("per_inquiry"))


def claim_overview(spark, folder):
    """Answers rebuilt from claims: how many claims, whether the answer holds every claim's text."""
    i = records_of(spark, folder, "inquiries", ["id"], ["status", "answer", "claims"]).filter("status = 'answered' and answer is not null")
    return i.select("id", F.coalesce(F.size("claims"), F.lit(0)).alias("claims"), F.forall("claims", lambda c: F.coalesce(F.contains(F.col("answer"), c["text"]), F.lit(False))).alias("holds_all"), F.length(F.left(collapse_white(F.col("answer")), F.lit(200))).alias("preview_length")).withColumn("claims", F.when(F.col("claims") < 0, 0).otherwise(F.col("claims")))


# --- run comparison --------------------------------------------------------------------------------


def _runs(spark, folder, first: bool):
    e = table(spark, folder, "events").withColumn("first_half", F.col("ts") < F.lit("2024-01-16").cast("timestamp")).filter(F.col("first_half") if first else ~F.col("first_half"))
    return e.select(F.col("user_id").alias("run_id"), F.concat_ws(":", "event_type", F.get_json_object("props", "$.k")).alias("case_id"), (F.col("value") >= 30).alias("passed"))


def regression_cases(spark, folder):
    """Cases of two sets of runs: how many runs passed before and after."""
    tally = lambda d: d.groupBy("case_id", "run_id").agg(F.bool_and("passed").alias("passed")).groupBy("case_id").agg(F.sum(F.col("passed").cast("int")).alias("passes"), F.count(F.lit(1)).alias("runs"))
    return regression.compare_cases(tally(_runs(spark, folder, True)), tally(_runs(spark, folder, False)))


def _seen(spark, folder, first: bool) -> tuple[DataFrame, DataFrame]:
    """Runs of cases (event types; a run is a day and user group) and the evidence (keys of props) that each accepted or not."""
    e = table(spark, folder, "events").withColumn("first_half", F.col("ts") < F.lit("2024-01-16").cast("timestamp")).filter(F.col("first_half") if first else ~F.col("first_half"))
    rows = e.select(F.col("event_type").alias("case_id"), (F.col("user_id") % 7).alias("run_id"), F.get_json_object("props", "$.k").alias("evidence_id"), (F.col("value") >= 30).alias("accepted"))
    seen = rows.filter("evidence_id is not null").groupBy("case_id", "run_id", "evidence_id").agg((F.sum(F.col("accepted").cast("int")) * 2 >= F.count(F.lit(1))).alias("accepted"))
    return rows.select("case_id", "run_id").distinct(), seen


def evidence_loss(spark, folder):
    """Evidence that most runs of the first half accepted and most of the second didn't, per case."""
    (b, bs), (c, cs) = _seen(spark, folder, True), _seen(spark, folder, False)
    return regression.evidence_lost(b, c, bs, cs)


def guard_verdict(spark, folder):
    """The verdict on two sets of runs from their cases, their evidence and their conditions."""
    (b, bs), (c, cs) = _seen(spark, folder, True), _seen(spark, folder, False)
    tally = lambda d: d.groupBy("case_id", "run_id").agg(F.bool_and("accepted").alias("ok")).groupBy("case_id").agg(F.sum(F.col("ok").cast("int")).alias("passes"), F.count(F.lit(1)).alias("runs"))
    same = spark.createDataFrame([("label_version", "a"), ("top_k", "5")], "name string, value string")
    return regression.verdict(regression.compare_cases(tally(bs), tally(cs)), regression.fingerprint_diff(same, same), regression.evidence_lost(b, c, bs, cs))


def runset_pick(spark, folder):
    """The three newest events of every user and type."""
    e = table(spark, folder, "events").select("user_id", "event_type", "event_id", "ts")
    return regression.newest(e, ["user_id", "event_type"], "ts", "event_id", 3).select("user_id", "event_type", "event_id", "place")


def _conditions(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Runs (every fortieth user) with the time of their last event, and per event type whether most of their events passed."""
    e = table(spark, folder, "events").withColumn("run_id", (F.col("user_id") % 40).cast("string"))
    share = F.avg((F.col("value") >= 30).cast("int"))
    c = e.groupBy("run_id", F.col("event_type").alias("name")).agg(F.when(share >= 0.6, "most").when(share >= 0.5, "half").when(share >= 0.4, "few").alias("value")).filter("value is not null")
    return e.groupBy("run_id").agg(F.max("ts").alias("started_at")), c


def runset_assembly(spark, folder):
    """The set of runs under the conditions of run 7, and what was passed over."""
    runs, c = _conditions(spark, folder)
    return regression.assemble(runs, c, "7", 3, ["9"])


def promotion_drift(spark, folder):
    """Where runs 1 to 5 aren't under one condition, and where run 1 isn't what was registered."""
    _, c = _conditions(spark, folder)
    promoted = spark.createDataFrame([("view", "most"), ("click", "few"), ("other", "x")], "name string, value string")
    return regression.promotion_drift(promoted, c.filter(F.col("run_id").isin("1", "2", "3", "4", "5")), "1")


#: A condition that is compared together with another one.
PAIRED = {"purchase:3": "purchase:5"}
DECLARED = ["click:1", "view:2"]


def fingerprint_diff(spark, folder):
    """The conditions of two sets of runs: whether most events of a type and key passed, unknown where all or none did."""

    def cond(first):
        r = _runs(spark, folder, first)
        share = F.avg(F.col("passed").cast("int"))
        return r.groupBy(F.col("case_id").alias("name")).agg(F.when((share > 0) & (share < 1), F.when(share > 0.5, "on").otherwise("off")).alias("value"))

    return regression.fingerprint_diff(cond(True), cond(False), DECLARED, PAIRED)


QUERIES = {f.__name__: f for f in (gate_schema, gate_citations, pii_unsourced, gate_verdict, gate_accuracy, gate_reason_counts, claim_multiset, contradiction_pairs, judge_consistency, outcome_mismatches, constraint_violations, receipt_validation, day_sequence, policy_evidence_text, response_objects, order_no_validate, order_exists, phone_normalise, pii_email_extract, row_render, sql_evidence_filter, sync_plan, cache_plan, index_provenance, nested_children, record_roundtrip, outcome_histogram, latency_percentiles, token_totals, claim_overview, regression_cases, evidence_loss, guard_verdict, runset_pick, runset_assembly, promotion_drift, fingerprint_diff)}

# --- SQL twins -------------------------------------------------------------------------------------

_WHITE = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _key(c: str) -> str:
    return f"nullif(upper(regexp_replace({c}, '^{_WHITE}+|{_WHITE}+$', '', 'g')), '')"


_FIX = """
fx AS (SELECT DISTINCT ON (id) id, evidences, CASE WHEN json_valid(raw_draft) THEN json(raw_draft) END AS root, expected FROM l1_fixtures),
cl AS (SELECT id, i - 1 AS claim_no, json_extract(root, '$.claims[' || (i - 1) || ']') AS claim FROM (SELECT id, root, unnest(range(1, json_array_length(root, '$.claims')::BIGINT + 1)) AS i FROM fx WHERE json_type(root) = 'OBJECT' AND json_type(root, '$.claims') = 'ARRAY')),
ci AS (SELECT id, claim_no, j, json_extract(claim, '$.citation_ids[' || (j - 1) || ']') AS c FROM (SELECT id, claim_no, claim, unnest(range(1, json_array_length(claim, '$.citation_ids')::BIGINT + 1)) AS j FROM cl WHERE json_type(claim) = 'OBJECT' AND json_type(claim, '$.citation_ids') = 'ARRAY')),
ev AS (SELECT id, e.id AS evidence_id, coalesce(e.evidence_text, e.content) AS text FROM (SELECT id, unnest(evidences) AS e FROM fx) WHERE e IS NOT NULL),
st AS (
  SELECT fx.id, coalesce(json_type(root) = 'OBJECT' AND json_type(root, '$.claims') = 'ARRAY' AND json_array_length(root, '$.claims') > 0
    AND NOT EXISTS (SELECT 1 FROM cl WHERE cl.id = fx.id AND NOT coalesce(json_type(claim) = 'OBJECT' AND json_type(claim, '$.text') = 'VARCHAR' AND trim(json_extract_string(claim, '$.text')) <> '' AND json_type(claim, '$.citation_ids') = 'ARRAY', false))
    AND NOT EXISTS (SELECT 1 FROM ci WHERE ci.id = fx.id AND json_type(c) <> 'VARCHAR'), false) AS valid FROM fx),
cs AS (
  SELECT id, bool_or(n = 0) AS missing, bool_or(bad > 0) AS invalid FROM (
    SELECT cl.id, cl.claim_no, count(c.c) FILTER (json_type(c.c) = 'VARCHAR') AS n, count(c.c) FILTER (json_type(c.c) = 'VARCHAR' AND (c.c ->> '$') NOT IN (SELECT evidence_id FROM ev WHERE ev.id = cl.id)) AS bad
    FROM cl LEFT JOIN ci c ON c.id = cl.id AND c.claim_no = cl.claim_no WHERE json_type(claim) = 'OBJECT' AND json_type(claim, '$.citation_ids') = 'ARRAY' GROUP BY cl.id, cl.claim_no) GROUP BY id)"""


def _found(t: str) -> str:
    """The five patterns without look-around: a character before and after is consumed. Written from the gate's rules:
    phones lose all but digits and 0082 or 82 before them becomes 0, mail addresses are compared in lower case."""
    digit = lambda p: f"list_transform(regexp_extract_all(' ' || {t} || ' ', '[^0-9](' || '{p}' || ')[^0-9]', 1), lambda x: regexp_replace(x, '[^0-9]', '', 'g'))"
    phone = lambda p: f"list_transform({digit(p)}, lambda d: CASE WHEN starts_with(d, '0082') THEN '0' || d[5:] WHEN starts_with(d, '82') THEN '0' || d[3:] ELSE d END)"
    gap = "[-. ()]*"
    return (
        "list_concat("
        + ", ".join([
            phone(f"(?:(?:\\+82|0082){gap}10|01[016789]){gap}[0-9]{{3,4}}{gap}[0-9]{{4}}"),
            phone(f"(?:(?:\\+82|0082){gap}(?:2|[3-9][0-9]?)|0[2-9][0-9]?){gap}[0-9]{{3,4}}{gap}[0-9]{{4}}"),
            digit("1[5-8][0-9]{2}[-. ]?[0-9]{4}"),
            digit("[0-9]{6}[-. ]?[1-4][0-9]{6}"),
            f"list_transform(regexp_extract_all({t}, '{_MAIL}'), lambda x: lower(x))",
        ])
        + ")"
    )


_MAIL = "[A-Za-z0-9._%+-]+@[\\p{L}\\p{N}-]+(?:\\.[\\p{L}\\p{N}-]+)+"


_PII = f"""
tx AS (SELECT id, json_extract_string(claim, '$.text') AS t FROM cl WHERE json_type(claim) = 'OBJECT' AND json_type(claim, '$.text') = 'VARCHAR'),
fb AS (SELECT fx.id, x.atom ->> '$' AS t FROM fx, json_tree(fx.root) AS x WHERE x.type = 'VARCHAR' AND NOT regexp_matches(x.fullkey, '[.]citation_ids($|[.]|[[])') AND fx.id NOT IN (SELECT id FROM tx)
  UNION ALL SELECT id, raw_draft FROM l1_fixtures WHERE NOT json_valid(raw_draft)),
pd AS (SELECT DISTINCT id, unnest({_found("t")}) AS v FROM (SELECT * FROM tx UNION ALL SELECT * FROM fb)),
pe AS (SELECT DISTINCT id, unnest({_found("text")}) AS v FROM ev),
pu AS (SELECT pd.id, pd.v FROM pd LEFT JOIN pe ON pe.id = pd.id AND pe.v = pd.v WHERE pe.id IS NULL),
vd AS (
  SELECT st.id, list_filter([CASE WHEN NOT valid THEN 'schema_violation' END, CASE WHEN coalesce(missing, false) THEN 'missing_citation' END, CASE WHEN coalesce(invalid, false) THEN 'invalid_citation' END, CASE WHEN EXISTS (SELECT 1 FROM pu WHERE pu.id = st.id) THEN 'pii_detected' END], lambda x: x IS NOT NULL) AS reasons
  FROM st LEFT JOIN cs USING (id))"""
_G = "WITH " + _FIX
_GP = _G + "," + _PII
_J = "WITH j AS (SELECT DISTINCT ON (id) * FROM judge_fixtures)"
_INQ = "(SELECT DISTINCT ON (id) * FROM (SELECT * FROM inquiries ORDER BY id, loaded_at))"
_ORD = "(SELECT DISTINCT ON (order_no) * FROM (SELECT * FROM shop_orders ORDER BY order_no, loaded_at))"
_EVI = "(SELECT DISTINCT ON (inquiry_id, evidence_id) * FROM (SELECT * FROM inquiry_evidence ORDER BY inquiry_id, evidence_id, loaded_at))"
_CHU = "(SELECT DISTINCT ON (id) * FROM (SELECT * FROM policy_chunks ORDER BY id, loaded_at))"
_HALF = "SELECT user_id AS run_id, event_type || ':' || json_extract_string(props, '$.k') AS case_id, value >= 30 AS passed, ts < TIMESTAMP '2024-01-16' AS first FROM events"
_VALID = "regexp_full_match({0}, 'ORD-[0-9]{{8}}-[0-9]{{4}}') AND try_strptime(substring({0}, 5, 8), '%Y%m%d') IS NOT NULL AND strftime(try_strptime(substring({0}, 5, 8), '%Y%m%d'), '%Y%m%d') = substring({0}, 5, 8) AND substring({0}, 14, 4) <> '0000'"
_VIOLATION = lambda t, key, rules: " UNION ALL ".join(f"SELECT '{n}' AS \"constraint\", {key} AS key FROM {t} WHERE NOT coalesce({c}, true)" for n, c in rules.items())
_COUNTERS = " AND ".join(f"coalesce({c} >= 0, true)" for c in ("latency_ms", "input_tokens", "output_tokens", "embedding_tokens", "judge_input_tokens", "judge_output_tokens", "retrieval_input_tokens", "retrieval_output_tokens"))

#: Runs, what they saw, the labels of each side, and evidence that only the first side's majority accepted.
_SEEN = """WITH raw AS (SELECT event_type AS case_id, user_id % 7 AS run_id, json_extract_string(props, '$.k') AS evidence_id, value >= 30 AS ok, ts < TIMESTAMP '2024-01-16' AS first FROM events),
runs AS (SELECT DISTINCT first, case_id, run_id FROM raw), seen AS (SELECT first, case_id, run_id, evidence_id, sum(ok::INT) * 2 >= count(*) AS accepted FROM raw WHERE evidence_id IS NOT NULL GROUP BY ALL),
ids AS (SELECT case_id, (SELECT list_sort(list(DISTINCT evidence_id)) FROM seen s WHERE s.case_id = k.case_id AND first) AS b, (SELECT list_sort(list(DISTINCT evidence_id)) FROM seen s WHERE s.case_id = k.case_id AND NOT first) AS c FROM (SELECT case_id FROM runs WHERE first INTERSECT SELECT case_id FROM runs WHERE NOT first) k),
ref AS (SELECT case_id, unnest(coalesce(b, c)) AS evidence_id FROM ids WHERE (b IS NOT NULL OR c IS NOT NULL) AND NOT coalesce(b <> c, false)),
full_ AS (SELECT r.first, r.case_id, r.run_id, ref.evidence_id FROM runs r JOIN ref USING (case_id) WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.first = r.first AND s.case_id = r.case_id AND s.run_id = r.run_id)),
tot AS (SELECT first, case_id, count(*) AS n FROM runs GROUP BY 1, 2),
vot AS (SELECT first, case_id, evidence_id, count(DISTINCT run_id) AS v FROM (SELECT first, case_id, run_id, evidence_id FROM seen WHERE accepted AND (case_id, evidence_id) IN (SELECT (case_id, evidence_id) FROM ref) UNION SELECT * FROM full_) GROUP BY 1, 2, 3),
acc AS (SELECT first, case_id, evidence_id FROM vot JOIN tot USING (first, case_id) WHERE v >= n // 2 + 1),
lost AS (SELECT case_id, evidence_id, 'lost' AS outcome FROM acc WHERE first AND (case_id, evidence_id) NOT IN (SELECT (case_id, evidence_id) FROM acc WHERE NOT first))"""

_COND = """WITH ev AS (SELECT (user_id % 40)::VARCHAR AS run_id, event_type AS name, ts, (value >= 30)::INT AS ok FROM events), runs AS (SELECT run_id, max(ts) AS started_at FROM ev GROUP BY 1),
cond AS (SELECT * FROM (SELECT run_id, name, CASE WHEN avg(ok) >= 0.6 THEN 'most' WHEN avg(ok) >= 0.5 THEN 'half' WHEN avg(ok) >= 0.4 THEN 'few' END AS value FROM ev GROUP BY 1, 2) WHERE value IS NOT NULL)"""

ORACLE = {
    "gate_schema": _G + " SELECT id AS record_id, valid FROM st",
    "gate_citations": _G + " SELECT id AS record_id, missing, invalid FROM cs",
    "pii_unsourced": _GP + " SELECT id AS record_id, v AS value FROM pu",
    "gate_verdict": _GP + " SELECT id AS record_id, CASE WHEN len(reasons) = 0 THEN 'pass' ELSE 'reject' END AS verdict, array_to_string(reasons, ',') AS reasons FROM vd",
    "gate_accuracy": _GP + """ SELECT count(*) AS measured, 0 AS errors, round(count(*) FILTER (e.verdict = 'reject' AND len(reasons) > 0) / nullif(count(*) FILTER (e.verdict = 'reject'), 0)::DOUBLE, 6) AS detection,
      round(count(*) FILTER (e.verdict = 'pass' AND len(reasons) > 0) / nullif(count(*) FILTER (e.verdict = 'pass'), 0)::DOUBLE, 6) AS false_alarm,
      round(count(*) FILTER (list_sort(reasons) = list_sort(coalesce(e.reject_reasons, []))) / nullif(count(*), 0)::DOUBLE, 6) AS exact_reasons FROM (SELECT vd.*, fx.expected AS e FROM vd JOIN fx USING (id))""",
    "gate_reason_counts": _GP + """, ex AS (SELECT DISTINCT id, unnest(expected.reject_reasons) AS reason FROM fx), gt AS (SELECT id, unnest(reasons) AS reason FROM vd)
      SELECT coalesce(ex.reason, gt.reason) AS reason, count(ex.id) AS expected, count(*) FILTER (ex.id IS NOT NULL AND gt.id IS NOT NULL) AS detected, count(*) FILTER (ex.id IS NULL) AS spurious FROM ex FULL JOIN gt ON ex.id = gt.id AND ex.reason = gt.reason GROUP BY 1""",
    "claim_multiset": _J + """, a AS (SELECT id, c.text AS text, count(*) AS n FROM (SELECT id, unnest(claims) AS c FROM j) WHERE c.text IS NOT NULL GROUP BY ALL), b AS (SELECT id, c.claim_text AS text, count(*) AS n FROM (SELECT id, unnest(expected.claim_judgments) AS c FROM j) WHERE c.claim_text IS NOT NULL GROUP BY ALL)
      SELECT id, text, coalesce(a.n, 0) AS left_n, coalesce(b.n, 0) AS right_n FROM a FULL JOIN b USING (id, text) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
    "contradiction_pairs": _J + " SELECT DISTINCT id, least(c.evidence_id_a, c.evidence_id_b) AS evidence_a, greatest(c.evidence_id_a, c.evidence_id_b) AS evidence_b FROM (SELECT id, unnest(expected.contradictions) AS c FROM j) WHERE c.evidence_id_a <> c.evidence_id_b",
    "judge_consistency": _J + ", k AS (SELECT id, expected.verdict AS v, coalesce(expected.reject_reasons, []) AS r, coalesce(expected.claim_judgments, []) AS cj, list_filter(list_transform(claims, lambda c: c.text), lambda x: x IS NOT NULL) AS t FROM j) "
    + _VIOLATION("k", "id", {"verdict_has_reasons": "(v = 'reject') = (len(r) > 0)", "unsupported_has_claim": "list_contains(r, 'unsupported_claim') = (len(list_filter(cj, lambda c: coalesce(c.verdict <> 'supported', false))) > 0)", "claim_texts_unique": "len(list_distinct(t)) = len(t)"}),
    "outcome_mismatches": f"""WITH g AS (SELECT DISTINCT ON (id) id, {_key('order_no')} AS k, expected FROM golden_set), i AS (SELECT {_key('order_no')} AS k, status, escalation_reason FROM {_INQ}), b AS (SELECT g.id, expected, status, escalation_reason FROM g JOIN i USING (k))
      SELECT id, 'status' AS mismatch, count(*) AS n FROM b WHERE NOT list_contains(expected.statuses, status) GROUP BY id
      UNION ALL SELECT id, 'reason', count(*) FROM b WHERE status = 'escalated' AND NOT list_contains(expected.escalation_reasons, escalation_reason) GROUP BY id""",
    "constraint_violations": _VIOLATION(_ORD, "order_no", {"orders_order_no_format": "regexp_full_match(order_no, 'ORD-[0-9]{8}-[0-9]{4}')", "orders_quantity_positive": "quantity > 0", "orders_unit_price_nonneg": "unit_price_krw >= 0", "orders_total_price_nonneg": "total_price_krw >= 0", "orders_shipped_after_ordered": "shipped_at IS NULL OR shipped_at >= ordered_at", "orders_delivered_after_shipped": "delivered_at IS NULL OR (shipped_at IS NOT NULL AND delivered_at >= shipped_at)", "orders_total_is_product": "total_price_krw::BIGINT = quantity::BIGINT * unit_price_krw"})
    + " UNION ALL " + _VIOLATION(_CHU, "id::VARCHAR", {"policy_chunks_embedding_model_nonempty": "embedding_model <> ''", "policy_chunks_embedding_dimensions_positive": "embedding_dimensions > 0", "policy_chunks_evidence_id_shape": "evidence_id = 'policy:' || document_slug || ':' || article"})
    + " UNION ALL " + _VIOLATION(_INQ, "id", {"inquiries_order_no_format": "order_no IS NULL OR regexp_full_match(order_no, 'ORD-[0-9]{8}-[0-9]{4}')", "inquiries_intent_source_enum": "intent_source IS NULL OR intent_source IN ('policy', 'order', 'both')", "inquiries_status_enum": "status IN ('answered', 'escalated')", "inquiries_escalation_reason_enum": "escalation_reason IS NULL OR escalation_reason IN ('no_evidence', 'missing_order_ref', 'order_not_found', 'sql_failed', 'llm_call_failed', 'rejected_twice')", "inquiries_terminal_shape": "(status = 'answered' AND answer IS NOT NULL AND escalation_reason IS NULL) OR (status = 'escalated' AND answer IS NULL AND escalation_reason IS NOT NULL)", "inquiries_latency_nonneg": "latency_ms >= 0", "inquiries_tokens_nonneg": "input_tokens >= 0 AND output_tokens >= 0 AND embedding_tokens >= 0", "inquiries_judge_tokens_nonneg": "judge_input_tokens >= 0 AND judge_output_tokens >= 0", "inquiries_retrieval_tokens_nonneg": "retrieval_input_tokens >= 0 AND retrieval_output_tokens >= 0"})
    + " UNION ALL " + _VIOLATION(_EVI, "evidence_id", {"evidence_source_enum": "source IN ('policy', 'sql')", "evidence_snapshot_shape": "coalesce(source = 'sql' AND sequence IS NOT NULL AND query_sql IS NOT NULL AND result_rows IS NOT NULL AND evidence_id = 'sql:' || inquiry_id || ':' || sequence, false) OR coalesce(source = 'policy' AND sequence IS NULL AND query_sql IS NULL AND result_rows IS NULL AND evidence_id LIKE 'policy:%:%', false)"}),
    "receipt_validation": f"SELECT id, CASE WHEN e IS NULL THEN length(c) END AS letters, CASE WHEN e IS NULL THEN k END AS order_no, e AS error FROM (SELECT *, CASE WHEN c IS NULL THEN 'no_content' WHEN k IS NOT NULL AND NOT coalesce({_VALID.format('k')}, false) THEN 'bad_order_no' END AS e FROM (SELECT id, nullif(regexp_replace(content, '^{_WHITE}+|{_WHITE}+$', '', 'g'), '') AS c, {_key('order_no')} AS k FROM {_INQ}))",
    "day_sequence": f"SELECT order_no AS old, 'ORD-' || strftime(d, '%Y%m%d') || '-' || lpad((row_number() OVER (PARTITION BY d ORDER BY ordered_at, order_no))::VARCHAR, 4, '0') AS new FROM (SELECT *, (ordered_at AT TIME ZONE 'UTC')::DATE AS d FROM {_ORD} WHERE ordered_at IS NOT NULL)",
    "policy_evidence_text": f"SELECT id, 'p:' || substring(sha256(t), 1, 12) AS digest, length(t)::INT AS letters, CASE WHEN length(s) > 200 THEN left(s, 200) || '…' ELSE s END AS short FROM (SELECT id, t, regexp_replace(regexp_replace(t, '{_WHITE}+', ' ', 'g'), '^ | $', '', 'g') AS s FROM (SELECT id, '[' || concat_ws(' ', document_title, article, article_title) || '] ' || coalesce(content, '') AS t FROM {_CHU}))",
    "response_objects": f"SELECT id, to_json(struct_pack(id := id, status := status, escalation_reason := escalation_reason, failed_stage := failed_stage, claims := coalesce(claims, []), latency_ms := latency_ms))::VARCHAR AS body FROM {_INQ}",
    "order_no_validate": f"SELECT order_no, coalesce({_VALID.format('order_no')}, false) AS valid FROM (SELECT DISTINCT {_key('order_no')} AS order_no FROM inquiries) WHERE order_no IS NOT NULL",
    "order_exists": f"SELECT * FROM (SELECT id AS inquiry_id, {_key('order_no')} AS order_no FROM {_INQ}) WHERE order_no IN (SELECT order_no FROM shop_orders)",
    "phone_normalise": "SELECT DISTINCT customer_phone, CASE WHEN starts_with(d, '0082') THEN '0' || d[5:] WHEN starts_with(d, '82') THEN '0' || d[3:] ELSE d END AS phone FROM (SELECT customer_phone, regexp_replace(customer_phone, '[^0-9]', '', 'g') AS d FROM shop_orders WHERE customer_phone IS NOT NULL)",
    "pii_email_extract": f"SELECT doc_id, lower(m) AS email, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_MAIL}')) AS m FROM documents) GROUP BY ALL",
    "row_render": f"""WITH o AS (SELECT product_name, strftime(ordered_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, row_number() OVER w AS i, 'order_no=' || order_no || ', product_option=' || coalesce(product_option, '(없음)') || ', quantity=' || coalesce(quantity::VARCHAR, '(없음)') || ', courier=' || coalesce(courier, '(없음)') AS line FROM {_ORD} WINDOW w AS (PARTITION BY product_name, strftime(ordered_at AT TIME ZONE 'UTC', '%Y-%m-%d') ORDER BY order_no))
      SELECT product_name, day, string_agg(i || ') ' || line, chr(10) ORDER BY i) FILTER (i <= 10) || CASE WHEN count(*) > 10 THEN chr(10) || '... (이하 ' || (count(*) - 10) || '건 생략)' ELSE '' END AS lines FROM o GROUP BY ALL""",
    "sql_evidence_filter": f"""WITH s AS (SELECT inquiry_id, evidence_id, json(result_rows) AS j, list_transform(string_split(regexp_extract(query_sql, '^SELECT (.*) FROM orders WHERE order_no = ', 1), ','), lambda x: trim(x)) AS safe FROM {_EVI} WHERE source = 'sql' AND json_valid(result_rows)),
      c AS (SELECT inquiry_id, evidence_id, safe, i + 1 AS row_no, json_extract(j, '$[' || i || ']') AS o FROM (SELECT *, unnest(range(0, json_array_length(j)::BIGINT)) AS i FROM s WHERE json_type(j) = 'ARRAY')),
      k AS (SELECT *, json_extract_string(o, '$."' || column_name || '"') AS value, json_type(o, '$."' || column_name || '"') AS t FROM (SELECT *, unnest(json_keys(o)) AS column_name FROM c WHERE json_type(o) = 'OBJECT'))
      SELECT inquiry_id, evidence_id, row_no, column_name, value FROM k WHERE t NOT IN ('OBJECT', 'ARRAY') AND coalesce(len({_found('column_name')}), 0) = 0 AND (coalesce(list_contains(safe, column_name), false) OR coalesce(len({_found('value')}), 0) = 0)""",
    "sync_plan": f"WITH p AS (SELECT evidence_id, deleted_at FROM {_CHU}) SELECT 'upsert' AS action, count(*) AS n FROM p WHERE deleted_at IS NULL UNION ALL SELECT 'delete', count(DISTINCT evidence_id) FROM p WHERE evidence_id NOT IN (SELECT evidence_id FROM p WHERE deleted_at IS NULL)",
    "cache_plan": "WITH c AS (SELECT DISTINCT sha256(text) AS d FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL), t AS (SELECT sha256(text) AS d FROM documents WHERE text IS NOT NULL) SELECT count(*) FILTER (d IN (SELECT d FROM c)) AS hits, count(DISTINCT d) FILTER (d NOT IN (SELECT d FROM c)) AS misses FROM t",
    "index_provenance": f"SELECT embedding_model, embedding_dimensions, count(*) AS n FROM {_CHU} GROUP BY ALL",
    "nested_children": f"""WITH e AS (SELECT inquiry_id, evidence_id, sequence FROM {_EVI}), i AS (SELECT id AS inquiry_id, status FROM {_INQ})
      SELECT i.inquiry_id, status, count(e.evidence_id) AS n, coalesce(string_agg(e.evidence_id, ',' ORDER BY e.sequence NULLS FIRST, e.evidence_id), '') AS evidence_ids FROM i LEFT JOIN e USING (inquiry_id) GROUP BY ALL""",
    "record_roundtrip": f"SELECT id, len(claims)::INT AS claims, true AS same FROM {_INQ}",
    "outcome_histogram": f"SELECT status, escalation_reason, failed_stage, count(*) AS n FROM {_INQ} GROUP BY ALL",
    "latency_percentiles": f"SELECT status, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95 FROM {_INQ} GROUP BY status",
    "token_totals": f"SELECT intent_source, inquiries, g AS generation, e AS embedding, j AS judge, round((g + e + j) / inquiries::DOUBLE, 6) AS per_inquiry FROM (SELECT intent_source, count(*) AS inquiries, sum(input_tokens) + sum(output_tokens) AS g, sum(embedding_tokens) AS e, sum(judge_input_tokens) + sum(judge_output_tokens) AS j FROM {_INQ} GROUP BY intent_source)",
    # From the rules: a case that passed every run must pass most of the new ones, one that passed any must not fall to none.
    "regression_cases": f"""WITH r AS (SELECT first, case_id, run_id, bool_and(passed) AS ok FROM ({_HALF}) GROUP BY ALL), b AS (SELECT case_id, count(*) FILTER (ok) AS p, count(*) AS n FROM r WHERE first GROUP BY 1), c AS (SELECT case_id, count(*) FILTER (ok) AS p, count(*) AS n FROM r WHERE NOT first GROUP BY 1)
      SELECT case_id, b.p AS baseline_passes, c.p AS candidate_passes, CASE WHEN b.n IS NULL OR c.n IS NULL THEN 'unknown' WHEN b.p = b.n AND c.p < c.n // 2 + 1 THEN 'shortfall' WHEN b.p > 0 AND c.p = 0 THEN 'collapse' WHEN c.p < b.p THEN 'decrease' ELSE 'same' END AS change FROM b FULL JOIN c USING (case_id)""",
    "evidence_loss": _SEEN + " SELECT * FROM lost UNION ALL SELECT case_id, NULL, 'labels_differ' FROM ids WHERE b IS NOT NULL AND c IS NOT NULL AND b <> c UNION ALL SELECT case_id, NULL, 'unobserved' FROM ids WHERE b IS NULL AND c IS NULL",
    "guard_verdict": _SEEN + """, t AS (SELECT first, case_id, count(*) FILTER (ok) AS p, count(*) AS n FROM (SELECT first, case_id, run_id, bool_and(accepted) AS ok FROM seen GROUP BY ALL) GROUP BY ALL), k AS (SELECT b.p AS bp, b.n AS bn, c.p AS cp, c.n AS cn FROM (SELECT * FROM t WHERE first) b JOIN (SELECT * FROM t WHERE NOT first) c USING (case_id))
      SELECT 0 AS differing, w + l AS worse, n AS compared, CASE WHEN w + l > 0 THEN 'fail' WHEN n = 0 THEN 'held' ELSE 'pass' END AS verdict
      FROM (SELECT count(*) AS n, count(*) FILTER (bp = bn AND cp < cn // 2 + 1 OR bp > 0 AND cp = 0) AS w FROM k), (SELECT count(*) AS l FROM lost)""",
    "runset_pick": "SELECT * FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 3",
    "runset_assembly": _COND + """, st AS (SELECT r.run_id, started_at, CASE WHEN sum((v.value IS NOT NULL AND m.value IS NOT NULL AND v.value <> m.value)::INT) > 0 THEN 'differs' WHEN sum((v.value IS NULL OR m.value IS NULL)::INT) > 0 THEN 'unknown' END AS reason
        FROM runs r, (SELECT DISTINCT name FROM cond) n LEFT JOIN cond v ON v.run_id = r.run_id AND v.name = n.name LEFT JOIN cond m ON m.run_id = '7' AND m.name = n.name WHERE r.run_id NOT IN ('7', '9') AND (v.value IS NOT NULL OR m.value IS NOT NULL) GROUP BY ALL),
      tk AS (SELECT run_id, started_at, row_number() OVER (ORDER BY started_at DESC, run_id DESC) AS p FROM st WHERE reason IS NULL), ls AS (SELECT count(*) AS n, max(p) AS p FROM tk WHERE p <= 2)
      SELECT '7' AS run_id, 1 AS place, NULL AS reason UNION ALL SELECT run_id, (p + 1)::INT, NULL FROM tk WHERE p <= 2 UNION ALL SELECT run_id, NULL, reason FROM st WHERE reason IS NOT NULL AND ((SELECT n FROM ls) < 2 OR (started_at, run_id) > (SELECT (started_at, run_id) FROM tk WHERE p = (SELECT p FROM ls)))""",
    "promotion_drift": _COND + """, five AS (SELECT * FROM cond WHERE run_id IN ('1', '2', '3', '4', '5'))
      SELECT v.run_id, v.name, h.value AS registered, v.value AS found FROM five v JOIN five h ON h.run_id = '1' AND h.name = v.name WHERE v.run_id <> '1' AND v.value <> h.value
      UNION ALL SELECT run_id, name, p.value, five.value FROM five JOIN (VALUES ('view', 'most'), ('click', 'few'), ('other', 'x')) p(name, value) USING (name) WHERE run_id = '1' AND five.value <> p.value""",
    "fingerprint_diff": f"""WITH r AS ({_HALF}), c AS (SELECT first, case_id AS name, avg(passed::INT) AS s FROM r GROUP BY 1, 2), v AS (SELECT first, name, CASE WHEN s > 0 AND s < 1 THEN CASE WHEN s > 0.5 THEN 'on' ELSE 'off' END END AS value FROM c),
      x AS (SELECT name, a.value AS a, b.value AS b FROM (SELECT * FROM v WHERE first) a FULL JOIN (SELECT * FROM v WHERE NOT first) b USING (name)), y AS (SELECT x.*, x.name = 'purchase:3' AS has, o.a AS oa, o.b AS ob FROM x LEFT JOIN x o ON x.name = 'purchase:3' AND o.name = 'purchase:5')
      SELECT name, a AS a_value, b AS b_value, CASE WHEN a IS NULL OR b IS NULL OR has AND (oa IS NULL OR ob IS NULL) THEN 'unknown' WHEN a = b AND (NOT has OR oa = ob) THEN 'same' WHEN name IN ('click:1', 'view:2') THEN 'declared' ELSE 'differs' END AS relation FROM y""",
    "claim_overview": f"SELECT id, coalesce(len(claims), 0) AS claims, CASE WHEN claims IS NOT NULL THEN len(list_filter(claims, lambda c: NOT coalesce(contains(answer, c.text), false))) = 0 END AS holds_all, length(left(regexp_replace(regexp_replace(answer, '{_WHITE}+', ' ', 'g'), '^ | $', '', 'g'), 200)) AS preview_length FROM {_INQ} WHERE status = 'answered' AND answer IS NOT NULL",
}
