"""Queries over the nested and referring record tables (problems 2 and 5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.text import null_if_blank, order_key
from gneiss.operators import nested, references
from gneiss.session import cut_lineage
from gneiss.tables import one_per_key, table

#: Leaf paths of the three nested columns, and the columns of the tables that they are turned into.
CLAIM_TABLES = {
    "inquiries": ("id", "claims", ["[].text", "[].citation_ids[]"]),
    "l1_fixtures": ("id", "raw_draft", ["claims[].text", "claims[].citation_ids[]"]),
    "judge_fixtures": ("id", "expected", ["verdict", "reject_reasons[]", "claim_judgments[].claim_text", "claim_judgments[].verdict", "contradictions[].evidence_id_a", "contradictions[].evidence_id_b"]),
}


def _triples(spark: SparkSession, folder: str, name: str, paths: list[str]) -> DataFrame:
    rid, column, _ = CLAIM_TABLES[name]
    src = table(spark, folder, name)
    if dict(src.dtypes)[column] == "string":
        # Ancestors too: they keep elements none of whose leaves occurs.
        return nested.json_triples(src, rid, column, unwrap_text=True, wanted=[*paths, *{nested.repeated_ancestor(p) for p in paths}])
    return nested.typed_triples(src, rid, column, wanted=paths)


def _flat(spark: SparkSession, folder: str, name: str) -> dict[str, DataFrame]:
    paths = CLAIM_TABLES[name][2]
    return nested.flatten(_triples(spark, folder, name, paths), paths)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Citations and verdicts as rows: (src, record_id, claim_no, item_no, item)."""
    zero = F.lit(0).cast("bigint")
    # Only the path asked for is followed, so claim texts are neither read nor exploded.
    cited = nested.flatten(_strings(_triples(spark, folder, "inquiries", ["[].citation_ids[]"])), ["[].citation_ids[]"])["[].citation_ids[]"]
    drafted = nested.flatten(_strings(_triples(spark, folder, "l1_fixtures", ["claims[].citation_ids[]"])), ["claims[].citation_ids[]"])["claims[].citation_ids[]"]
    judged = nested.flatten(_strings(_triples(spark, folder, "judge_fixtures", ["claim_judgments[].verdict"])), ["claim_judgments[].verdict"])["claim_judgments[]"]
    return reduce(
        DataFrame.unionByName,
        [
            cited.select(F.lit("inquiries.claims").alias("src"), "record_id", F.col("pos_1").alias("claim_no"), F.col("pos_2").alias("item_no"), F.col("value").alias("item")),
            drafted.select(F.lit("l1_fixtures.raw_draft").alias("src"), "record_id", F.col("pos_1").alias("claim_no"), F.col("pos_2").alias("item_no"), F.col("value").alias("item")),
            judged.select(F.lit("judge_fixtures.expected").alias("src"), "record_id", F.col("pos_1").alias("claim_no"), zero.alias("item_no"), F.col("verdict").alias("item")),
        ],
    )


def _strings(triples: DataFrame) -> DataFrame:
    return triples.filter(F.col("kind") == nested.STRING)


def p2_claims(spark: SparkSession, folder: str) -> DataFrame:
    """The table of claims: one row per claim of an inquiry or a draft, with its text."""
    a = _flat(spark, folder, "inquiries")["[]"].select(F.lit("inquiries.claims").alias("src"), "record_id", F.col("pos_1").alias("claim_no"), F.col("text").alias("claim_text"))
    b = _flat(spark, folder, "l1_fixtures")["claims[]"].select(F.lit("l1_fixtures.raw_draft").alias("src"), "record_id", F.col("pos_1").alias("claim_no"), F.col("text").alias("claim_text"))
    return a.unionByName(b)


def p2_judgments(spark: SparkSession, folder: str) -> DataFrame:
    """The table of judgments of judge_fixtures.expected."""
    t = _flat(spark, folder, "judge_fixtures")["claim_judgments[]"]
    return t.select("record_id", F.col("pos_1").alias("claim_no"), "claim_text", "verdict")


def p2_contradictions(spark: SparkSession, folder: str) -> DataFrame:
    """The table of contradicting evidence of judge_fixtures.expected."""
    t = _flat(spark, folder, "judge_fixtures")["contradictions[]"]
    return t.select("record_id", F.col("pos_1").alias("pair_no"), "evidence_id_a", "evidence_id_b")


def _inquiry_refs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    raw = table(spark, folder, "inquiries").select(
        F.col("id").alias("inquiry_id"),
        order_key(F.col("order_no")).alias("order_key"),
        F.array_distinct(F.filter(F.flatten(F.transform("claims", lambda c: F.coalesce(c["citation_ids"], F.expr("cast(array() as array<string>)")))), lambda x: null_if_blank(x).isNotNull())).alias("cited"),
        F.col("created_at").alias("ref_created"),
        F.col("loaded_at").alias("ref_arrived"),
    )
    # One row per inquiry before the explode: fewer, narrower rows to shuffle than per reference.
    # Kept: counting hot keys and both merges read it, and the scan, the parsing and the dedup happen once.
    one = cut_lineage(one_per_key(raw, ["inquiry_id"], "ref_arrived", ["ref_arrived", "ref_created", "order_key", "cited"]))
    orders = one.select("inquiry_id", F.col("order_key").alias("ref_key"), "ref_created", "ref_arrived")
    cited = one.select("inquiry_id", F.explode("cited").alias("ref_key"), "ref_created", "ref_arrived")
    return orders, cited


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references: (src, inquiry_id, ref_key, kind, period)."""
    orders, cited = _inquiry_refs(spark, folder)
    shop = references.parent_intervals(table(spark, folder, "shop_orders"), "order_no", "loaded_at", "deleted_at")
    clauses = table(spark, folder, "policy_chunks").select(F.col("evidence_id").alias("key"), "loaded_at", "deleted_at")
    snapshots = table(spark, folder, "inquiry_evidence").filter(F.col("source") == "sql").select(F.col("evidence_id").alias("key"), "loaded_at", F.lit(None).cast("timestamp").alias("deleted_at"))
    evidence = references.parent_intervals(clauses.unionByName(snapshots), "key", "loaded_at", "deleted_at")
    a = references.orphans(orders, shop).withColumn("src", F.lit("inquiries.order_no"))
    b = references.orphans(cited, evidence).withColumn("src", F.lit("inquiries.claims"))
    return a.unionByName(b).select("src", "inquiry_id", "ref_key", "kind", "period")


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references counted per source, month and kind."""
    return references.per_period(p5_found(spark, folder))


QUERIES = {
    "p2_found": p2_found,
    "p2_claims": p2_claims,
    "p2_judgments": p2_judgments,
    "p2_contradictions": p2_contradictions,
    "p5_found": p5_found,
    "p5_report": p5_report,
}

_DRAFTS = """
drafts AS (
  SELECT DISTINCT id, CASE WHEN json_type(root) = 'VARCHAR' AND json_valid(root ->> '$') AND json_type(json(root ->> '$')) = 'OBJECT' THEN json(root ->> '$') ELSE root END AS root
  FROM (SELECT id, CASE WHEN json_valid(raw_draft) THEN json(raw_draft) END AS root FROM l1_fixtures)
),
draft_claims AS (
  SELECT id, i - 1 AS claim_no, json_extract(root, '$.claims[' || (i - 1) || ']') AS claim
  FROM (SELECT id, root, unnest(range(1, json_array_length(root, '$.claims')::BIGINT + 1)) AS i FROM drafts
        WHERE json_type(root) = 'OBJECT' AND json_type(root, '$.claims') = 'ARRAY')
)"""

_P5 = """
WITH inq AS (
  SELECT id AS inquiry_id, arg_min(order_no, loaded_at) AS order_no, arg_min(claims, loaded_at) AS claims, arg_min(created_at, loaded_at) AS created_at, min(loaded_at) AS loaded_at
  FROM inquiries GROUP BY id
),
refs AS (
  SELECT 'inquiries.order_no' AS src, inquiry_id, upper(regexp_replace(order_no, '^[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+|[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+$', '', 'g')) AS ref_key, created_at, loaded_at FROM inq
  UNION ALL
  SELECT DISTINCT 'inquiries.claims', inquiry_id, unnest(claim.citation_ids), created_at, loaded_at FROM (SELECT *, unnest(claims) AS claim FROM inq)
),
parents AS (
  SELECT DISTINCT ON (src, ref_key) src, ref_key, min(loaded_at) OVER (PARTITION BY src, ref_key) AS arrived, deleted_at AS deleted FROM (
    SELECT 'inquiries.order_no' AS src, order_no AS ref_key, loaded_at, deleted_at FROM shop_orders
    UNION ALL SELECT 'inquiries.claims', evidence_id, loaded_at, deleted_at FROM policy_chunks
    UNION ALL SELECT 'inquiries.claims', evidence_id, loaded_at, NULL FROM inquiry_evidence WHERE source = 'sql')
  ORDER BY src, ref_key, loaded_at DESC NULLS LAST, deleted_at DESC NULLS LAST
),
found AS (
  SELECT r.src, inquiry_id, r.ref_key,
    CASE WHEN p.ref_key IS NULL THEN 'missing' WHEN p.deleted <= r.created_at THEN 'deleted' WHEN p.arrived > r.loaded_at THEN 'late' END AS kind,
    strftime(r.created_at AT TIME ZONE 'UTC', '%Y-%m') AS period
  FROM refs r LEFT JOIN parents p USING (src, ref_key)
  WHERE r.ref_key IS NOT NULL AND regexp_replace(r.ref_key, '[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{3000}]+', '', 'g') <> ''
)"""

ORACLE = {
    "p2_found": f"""
WITH {_DRAFTS}
SELECT DISTINCT 'inquiries.claims' AS src, id AS record_id, (i - 1)::BIGINT AS claim_no, (j - 1)::BIGINT AS item_no, item FROM (
  SELECT id, i, unnest(c.citation_ids) AS item, generate_subscripts(c.citation_ids, 1) AS j FROM (
    SELECT id, unnest(claims) AS c, generate_subscripts(claims, 1) AS i FROM inquiries)) WHERE item IS NOT NULL
UNION ALL
SELECT 'l1_fixtures.raw_draft', id, claim_no::BIGINT, j - 1, json_extract_string(claim, '$.citation_ids[' || (j - 1) || ']') FROM (
  SELECT id, claim_no, claim, unnest(range(1, json_array_length(claim, '$.citation_ids')::BIGINT + 1)) AS j FROM draft_claims
  WHERE json_type(claim) = 'OBJECT' AND json_type(claim, '$.citation_ids') = 'ARRAY') WHERE json_type(claim, '$.citation_ids[' || (j - 1) || ']') = 'VARCHAR'
UNION ALL
SELECT DISTINCT 'judge_fixtures.expected', id, (i - 1)::BIGINT, 0::BIGINT, c.verdict FROM (
  SELECT id, unnest(expected.claim_judgments) AS c, generate_subscripts(expected.claim_judgments, 1) AS i FROM judge_fixtures) WHERE c.verdict IS NOT NULL""",
    "p2_claims": f"""
WITH {_DRAFTS}
SELECT DISTINCT 'inquiries.claims' AS src, id AS record_id, (i - 1)::BIGINT AS claim_no, c.text AS claim_text FROM (SELECT id, unnest(claims) AS c, generate_subscripts(claims, 1) AS i FROM inquiries)
UNION ALL
SELECT 'l1_fixtures.raw_draft', id, claim_no::BIGINT, CASE WHEN json_type(claim) = 'OBJECT' AND json_type(claim, '$.text') NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string(claim, '$.text') END FROM draft_claims""",
    "p2_judgments": """
SELECT DISTINCT id AS record_id, (i - 1)::BIGINT AS claim_no, c.claim_text AS claim_text, c.verdict AS verdict FROM (SELECT id, unnest(expected.claim_judgments) AS c, generate_subscripts(expected.claim_judgments, 1) AS i FROM judge_fixtures)""",
    "p2_contradictions": """
SELECT DISTINCT id AS record_id, (i - 1)::BIGINT AS pair_no, c.evidence_id_a AS evidence_id_a, c.evidence_id_b AS evidence_id_b FROM (SELECT id, unnest(expected.contradictions) AS c, generate_subscripts(expected.contradictions, 1) AS i FROM judge_fixtures)""",
    "p5_found": _P5 + "SELECT * FROM found WHERE kind IS NOT NULL",
    "p5_report": _P5 + "SELECT src, period, kind, count(*) AS orphans FROM found WHERE kind IS NOT NULL GROUP BY ALL",
}
