"""Loading labels, rewrites, test cases and orders from JSON lines, checked before they are used.

A file that breaks its contract raises ValueError naming the first ids that break it; nothing is repaired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators.evaluation import judgment_problems
from gneiss.operators.records import validate_order_no
from gneiss.sources.policies import read_jsonl

LABELS = "id string, relevant_evidence_ids array<string>, note string"
REWRITES = "id string, original string, rewritten string, note string"
GOLDEN = "id string, category string, order_no string, content string, expected struct<statuses:array<string>,escalation_reasons:array<string>,expect_reject:boolean,forbidden_reject_reasons:array<string>>, note string"
_EVIDENCES = "evidences array<struct<id:string,source:string,content:string,evidence_text:string>>"
GATE = f"id string, category string, note string, {_EVIDENCES}, raw_draft variant, expected struct<verdict:string,reject_reasons:array<string>>"
JUDGE = f"id string, category string, note string, {_EVIDENCES}, claims array<struct<text:string,citation_ids:array<string>>>, expected struct<verdict:string,reject_reasons:array<string>,claim_judgments:array<struct<claim_text:string,verdict:string>>,contradictions:array<struct<evidence_id_a:string,evidence_id_b:string>>>"
ORDERS = "order_no string, customer_name string, customer_phone string, customer_email string, shipping_address string, product_name string, product_option string, quantity int, unit_price_krw int, total_price_krw int, status string, ordered_at timestamp, shipped_at timestamp, delivered_at timestamp, courier string, tracking_no string"
#: Ids that an error names.
NAMED = 5


def _require(bad: DataFrame, key: str, what: str) -> None:
    rows = bad.select(F.col(key).cast("string")).limit(NAMED).collect()
    if rows:
        raise ValueError(f"{what}: {', '.join(str(r[0]) for r in rows)}")


def _unique(df: DataFrame, key: str, what: str) -> None:
    _require(df.filter(F.coalesce(F.trim(key), F.lit("")) == ""), key, f"{what} without an id")
    _require(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), key, f"{what} more than once")


def _same_ids(a: DataFrame, b: DataFrame, key: str, what: str) -> None:
    _require(a.join(b, key, "left_anti"), key, f"{what} of unknown cases")
    _require(b.join(a, key, "left_anti"), key, f"cases without {what}")


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def read_labels(spark: SparkSession, path: str, cases: DataFrame, evidence: DataFrame) -> DataFrame:
    """Relevance labels, one row per case of ``cases`` (id) and none besides; every id they name is one of ``evidence``
    (evidence_id), names aren't blank and don't repeat within a case."""
    labels = read_jsonl(spark, path, LABELS)
    _unique(labels, "id", "labels")
    ids = F.col("relevant_evidence_ids")
    _require(labels.filter(ids.isNull() | F.col("note").isNull() | F.exists(ids, _blank) | (F.size(F.array_distinct(ids)) < F.size(ids))), "id", "labels with blank or repeated evidence")
    _same_ids(labels, cases, "id", "labels")
    named = labels.select(F.explode("relevant_evidence_ids").alias("evidence_id")).distinct()
    _require(named.join(evidence.select("evidence_id"), "evidence_id", "left_anti"), "evidence_id", "evidence that doesn't exist")
    return labels


def read_rewrites(spark: SparkSession, path: str, cases: DataFrame) -> DataFrame:
    """Rewritten queries, one per case of ``cases`` (id, content), whose original is the case's content."""
    rows = read_jsonl(spark, path, REWRITES)
    _unique(rows, "id", "rewrites")
    _require(rows.filter(_blank(F.col("rewritten")) | F.col("original").isNull() | F.col("note").isNull()), "id", "rewrites without text")
    _same_ids(rows, cases, "id", "rewrites")
    _require(rows.join(cases.select("id", "content"), "id").filter(~F.col("original").eqNullSafe(F.col("content"))), "id", "rewrites of another text")
    return rows


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions; escalation reasons are given exactly where escalation is allowed."""
    g = read_jsonl(spark, path, GOLDEN)
    _unique(g, "id", "golden questions")
    e = F.col("expected")
    _require(g.filter(_blank(F.col("content")) | e["statuses"].isNull() | (F.size(e["statuses"]) == 0)), "id", "golden questions without text or outcome")
    _require(g.filter(F.array_contains(e["statuses"], "escalated") != (F.size(F.coalesce(e["escalation_reasons"], F.array().cast("array<string>"))) > 0)), "id", "golden questions whose reasons don't fit their outcomes")
    return g


def read_gate_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Gate fixtures; the draft is any JSON value. A rejection has reasons and a pass none."""
    f = read_jsonl(spark, path, GATE)
    _unique(f, "id", "gate fixtures")
    e = F.col("expected")
    _require(f.filter(~F.coalesce(e["verdict"].isin("pass", "reject"), F.lit(False)) | ((e["verdict"] == "reject") != (F.size(F.coalesce(e["reject_reasons"], F.array().cast("array<string>"))) > 0))), "id", "gate fixtures that contradict themselves")
    return f


def read_judge_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Judge fixtures that a judge could have given: see ``judgment_problems``."""
    f = read_jsonl(spark, path, JUDGE)
    _unique(f, "id", "judge fixtures")
    e = F.col("expected")
    j = f.select("id", e["verdict"].alias("verdict"), e["reject_reasons"].alias("reject_reasons"), e["claim_judgments"].alias("claim_judgments"), e["contradictions"].alias("contradictions"), F.transform("claims", lambda c: c["text"]).alias("claims"), F.transform("evidences", lambda x: x["id"]).alias("evidence_ids"))
    _require(judgment_problems(j).select(F.concat_ws(" ", "id", "problem").alias("id")), "id", "judge fixtures that contradict themselves")
    return f


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    """Orders with typed times, each number once and of the right form."""
    o = read_jsonl(spark, path, ORDERS)
    _unique(o, "order_no", "orders")
    _require(o.filter(~validate_order_no(F.col("order_no"))), "order_no", "orders of a wrong number")
    return o


def generate_orders(spark: SparkSession, n: int, start: str, days: int, seed: int = 0) -> DataFrame:
    """``n`` orders with numbers that follow each other within each day; the same arguments give the same orders.

    Every column is a hash of the row's number, so rows are made where they are needed. A day has at most 9,999.
    """
    h = lambda salt: F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt)), F.lit(1_000_000))
    per = -(-n // days)
    if per > 9_999:
        raise ValueError("a day has at most 9,999 orders")
    day = F.date_add(F.lit(start).cast("date"), (F.col("id") / per).cast("int"))
    quantity, price = (1 + h("q") % 9).cast("int"), (1_000 * (1 + h("p") % 300)).cast("int")
    ordered = F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + h("t") % 86_400)
    number = lambda s, w: F.lpad(h(s).cast("string"), w, "0")
    return spark.range(n).select(
        F.concat(F.lit("ORD-"), F.date_format(day, "yyyyMMdd"), F.lit("-"), F.lpad((F.col("id") % per + 1).cast("string"), 4, "0")).alias("order_no"), F.concat(F.lit("customer "), number("n", 6)).alias("customer_name"), F.concat(F.lit("010-0000-"), F.lpad((h("f") % 10_000).cast("string"), 4, "0")).alias("customer_phone"),
        F.concat(F.lit("c"), number("e", 6), F.lit("@example.com")).alias("customer_email"), F.concat(F.lit("street "), h("a") % 500).alias("shipping_address"), F.concat(F.lit("product "), h("r") % 100).alias("product_name"), quantity.alias("quantity"), price.alias("unit_price_krw"), (quantity * price).alias("total_price_krw"), ordered.alias("ordered_at"),
    )
