from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gneiss.functions.pii import folded, found
from gneiss.guard import provenance
from gneiss.operators import gate, nested, records, regression
from gneiss.sources.policies import read_jsonl, read_policies
from gneiss.streaming.inquiries import arriving, counted, write_batches


def test_constraints_are_three_valued(spark):
    df = spark.createDataFrame([("a", 1), ("b", -1), ("c", None)], "k string, n int")
    assert [tuple(r) for r in records.violations(df, "k", {"positive": F.col("n") > 0}).collect()] == [("positive", "b")]


@pytest.mark.parametrize("value, ok", [("ORD-20240229-0001", True), ("ORD-20230229-0001", False), ("ORD-20240101-0000", False), ("ord-20240101-0001", False), ("ORD-20240101-0001\n", False), ("ORD-２０２４0101-0001", False), ("", False), (None, None)])
def test_order_no(spark, value, ok):
    df = spark.createDataFrame([(value,)], "o string")
    assert df.select(records.validate_order_no(F.col("o")).alias("v")).first().v is ok


def test_nest_round_trip(spark):
    parents = spark.createDataFrame([("p",), ("q",)], "id string")
    kids = spark.createDataFrame([("p", 2, "b"), ("p", 1, "a")], "id string, n int, v string")
    n = records.nest(parents, kids, "id", "n", ["v"], "kids")
    assert {r.id: len(r.kids) for r in n.collect()} == {"p": 2, "q": 0}
    assert [tuple(r) for r in records.unnest(n, "id", "kids").collect()] == [("p", 1, "a"), ("p", 2, "b")]


def test_sync(spark, tmp_path):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    path = str(tmp_path / "t")
    records.sync(a, path, "k")
    b = spark.createDataFrame([("y", 3), ("z", 4), ("z", 4)], "k string, v int")
    assert {r.action: r.n for r in records.sync_plan(b.distinct(), spark.read.parquet(path), "k").collect()} == {"upsert": 2, "delete": 1}
    records.sync(b, path, "k")
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("y", 3), ("z", 4)]


def test_provenance(spark):
    df = spark.createDataFrame([("m", 4)], "model string, dims int")
    records.require_provenance(df, {"model": "m", "dims": 4})
    records.require_provenance(df.limit(0), {"model": "other", "dims": 1})
    with pytest.raises(ValueError):
        records.require_provenance(df, {"model": "m", "dims": 5})


def test_missing_both_ways(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k string") for xs in ("ab", "bc"))
    assert sorted(tuple(r) for r in records.missing_both_ways(a, b, "k").collect()) == [("left", "a"), ("right", "c")]


CASES = "case_id string, passes int, runs int"


@pytest.mark.parametrize("before, now, change", [
    ((3, 3), (2, 3), "decrease"), ((3, 3), (1, 3), "shortfall"), ((3, 3), (0, 3), "shortfall"), ((2, 3), (0, 3), "collapse"), ((1, 3), (0, 3), "collapse"), ((2, 3), (1, 3), "decrease"),
    ((3, 3), (3, 3), "same"), ((1, 3), (2, 3), "same"), ((0, 3), (0, 3), "same"), ((2, 2), (1, 2), "shortfall"), ((1, 1), (1, 1), "same"), ((3, 3), (1, 1), "decrease"), ((3, 3), None, "unknown"), (None, (1, 1), "unknown"),
])
def test_changes_of_a_case(spark, before, now, change):
    """All runs before need most runs now; what passed at all must not fall to none; less is reported."""
    rows = [spark.createDataFrame([("a", *x)] if x else [], CASES) for x in (before, now)]
    assert regression.compare_cases(*rows).first().change == change


def test_verdict_precedence(spark):
    f = spark.createDataFrame([("model", "x"), ("k", None)], "name string, value string")
    case = lambda b, c: regression.compare_cases(spark.createDataFrame([("a", b, 3)], CASES), spark.createDataFrame([("a", c, 3)], CASES))
    same = regression.fingerprint_diff(f, f)
    gone = spark.createDataFrame([("a", "p:1", "lost")], "case_id string, evidence_id string, outcome string")
    v = lambda *a, **k: regression.verdict(*a, **k).first().verdict
    assert v(case(3, 3), same) == "pass" and v(case(3, 2), same) == "pass" and v(case(3, 1), same) == "fail" and v(case(2, 0), same) == "fail"
    assert v(case(3, 3), same, gone) == "fail" and v(case(3, 3), same, gone.withColumn("outcome", F.lit("unobserved"))) == "pass"
    assert v(case(3, 3), same, runs=2) == "held" and v(case(3, 1), same, runs=2) == "fail" and v(case(3, 3), same, evidence_known=False) == "held" and v(case(3, 3).limit(0), same) == "held" and v(case(3, 3), same, moved=1) == "fail"
    g = f.withColumn("value", F.lit("y"))
    assert v(case(3, 1), regression.fingerprint_diff(f, g)) == "incomparable" and v(case(3, 3), regression.fingerprint_diff(f, g, ["model"])) == "pass"


def test_conditions_compared_in_pairs(spark):
    rows = lambda **k: spark.createDataFrame(list(k.items()), "name string, value string")
    rel = lambda a, b, declared=(): {r.name: r.relation for r in regression.fingerprint_diff(a, b, list(declared), {"tau": "model"}).collect()}
    assert rel(rows(tau="0.06", model="s"), rows(tau="0.06", model="s")) == {"tau": "same", "model": "same"}
    assert rel(rows(tau="0.06", model="s"), rows(tau="0.06", model="l")) == {"tau": "differs", "model": "differs"}
    assert rel(rows(tau="0.06", model="s"), rows(tau="0.06", model="l"), ["model"]) == {"tau": "declared", "model": "declared"}
    assert rel(rows(tau="0.06", model="s"), rows(tau="0.07", model="s"), ["tau"]) == {"tau": "declared", "model": "same"}
    assert rel(rows(tau="0.06", model="s"), rows(tau="0.06")) == {"tau": "unknown", "model": "unknown"}


def test_evidence_lost(spark):
    runs = lambda *cs: spark.createDataFrame([(c, r) for c in cs for r in range(3)], "case_id string, run_id int")
    seen = lambda *rows: spark.createDataFrame(list(rows), "case_id string, run_id int, evidence_id string, accepted boolean")
    both = lambda c, r, a, b: [(c, r, "p1", a), (c, r, "p2", b)]
    b = seen(*both("a", 0, True, True), *both("a", 1, True, True), *both("a", 2, False, True), ("x", 0, "p9", True))
    c = seen(*both("a", 0, True, True), *both("a", 1, False, True), *both("a", 2, False, True), *both("silent", 0, False, True), *both("silent", 1, False, True), ("x", 0, "p8", True))
    rows = regression.evidence_lost(runs("a", "silent", "none", "x", "gone"), runs("a", "silent", "none", "x", "new"), b, c)
    assert sorted((r.case_id, r.evidence_id or "", r.outcome) for r in rows.collect()) == [("a", "p1", "lost"), ("none", "", "unobserved"), ("silent", "p1", "lost"), ("x", "", "labels_differ")]
    other = regression.evidence_lost(runs("silent"), runs("silent"), b.limit(0), c, same_labels=False)
    assert [(r.case_id, r.outcome) for r in other.collect()] == [("silent", "not_borrowed")]


PII = [
    ("010-1234-5678", "01012345678"), ("01012345678", "01012345678"), ("010 - 1234 - 5678", "01012345678"), ("010-(1234)-5678", "01012345678"), ("(02) 123-4567", "021234567"), ("080-123-4567", "0801234567"), ("+82 2-123-4567", "021234567"), ("+82 10-1234-5678", "01012345678"), ("0082 (10) 1234 5678", "01012345678"),
    ("900101.1234567", "9001011234567"), ("900101 1234567", "9001011234567"), ("1588-1234", "15881234"), ("a@쇼핑.한국", "a@쇼핑.한국"), ("Help@Shop.CO.kr", "help@shop.co.kr"), ("support@쇼핑몰.kr", "support@쇼핑몰.kr"), ("help＠shop.co.kr", "help@shop.co.kr"), ("０１０－１２３４－５６７８", "01012345678"), ("010-1234\u200b-5678", "01012345678"),
]


def test_values_of_the_gate(spark):
    df = spark.createDataFrame([(i, f"값은 {t} 입니다.") for i, (t, _) in enumerate(PII)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", found(folded(F.col("t"))).alias("v")).collect()}
    assert {PII[i][0]: v[:1] for i, v in got.items()} == {t: [v] for t, v in PII}
    no = ["900101-7234567", "9901012345678123", "12010-1234-56789", "주문 20250101-0001", "a@b", None]
    df = spark.createDataFrame([(t,) for t in no], "t string")
    assert all(not r.v for r in df.select(found(folded(F.col("t"))).alias("v")).collect())


def test_gate_compares_exactly(spark):
    claim = lambda t: '{"claims": [{"text": "%s", "citation_ids": ["s"]}]}' % t
    rows = [("same", "연락처는 +82 10-1234-5678입니다.", "0082 (10) 1234 5678"), ("other", "연락처는 +82 10-1234-5678입니다.", "0082 (10) 1234 5679"), ("inside", "010-1234-5678", "9901012345678123"), ("resident", "9001011234567", "900101-1234567"), ("made", "900101-2345678", "900101-1234567")]
    drafts = spark.createDataFrame([(i, claim(t)) for i, t, _ in rows], "record_id string, raw_draft string")
    evidence = spark.createDataFrame([(i, e) for i, _, e in rows], "record_id string, text string")
    assert {r.record_id for r in gate.unsourced(nested.json_triples(drafts, "record_id", "raw_draft"), evidence).collect()} == {"other", "inside", "made"}


def test_blank_texts_of_any_white_space_are_no_texts(spark):
    drafts = spark.createDataFrame([("a", '{"claims": [{"text": "\u3000\u00a0", "citation_ids": []}]}'), ("b", '{"claims": [{"text": "x", "citation_ids": []}]}')], "record_id string, raw_draft string")
    assert {r.record_id: r.valid for r in gate.structure(nested.json_triples(drafts, "record_id", "raw_draft"), drafts).collect()} == {"a": False, "b": True}


def test_sync_replaces_and_recovers(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("l", 1, None)], "key string, n int, s string")
    records.sync(a, path, "key")
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("k", 1, "a"), ("l", 1, None)]
    records.sync(a.filter("key = 'l'"), path, "key")
    assert spark.read.parquet(path).count() == 1
    (tmp_path / "t").rename(tmp_path / "t.previous")  # lost between the two moves
    records.sync(a, path, "key")
    assert spark.read.parquet(path).count() == 2 and not (tmp_path / "t.previous").exists()


def test_proven_columns():
    p = lambda sql: provenance.proven(sql, provenance.ORDERS)
    assert p("SELECT order_no, quantity AS q FROM orders WHERE order_no = 'ORD-1' LIMIT 5") == ["order_no", "q"]
    assert p("SELECT '010-1234-5678' || status AS v, status FROM orders WHERE order_no = 'A'") == ["status"]
    assert p("SELECT order_no FROM orders") == [] and p(None) == [] and p("SELECT x FROM orders WHERE order_no = 'A'") == []


def test_claims_rebuilt(spark):
    kind = "array<struct<text:string,citation_ids:array<string>>>"
    values = [None, [], [None], [("a", None)], [(None, [])], [("a", ["x", None, "x"]), None, ("b", [])]]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], f"id string, claims {kind}")
    got = {r.record_id: r.rebuilt for r in nested.rebuild_claims(nested.typed_triples(df, "id", "claims")).collect()}
    assert {k: None if v is None else [x and tuple(x) for x in v] for k, v in got.items()} == {str(i): v for i, v in enumerate(values)}


def test_rendered_rows_are_counted_beyond_the_limit(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: i.cast("string")).alias("l"))
    text = df.select(records.render_rows(F.col("l")).alias("t")).first().t
    assert text.split("\n")[-2:] == ["10", "... (이하 2건 생략)"] and len(text.split("\n")) == 11
    assert df.select(records.render_rows(F.col("l"), None).alias("t")).first().t.split("\n")[-1] == "12"


def test_policies(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nslug: refund\ntitle: Refunds\n---\n\n<!-- planted: conflicting; note: see 2-2 -->\n## 2-1 First days\n\nSeven days.\n\nMore.\n## 2-2 Later\r\nTwo weeks.\n", encoding="utf-8")
    rows = [tuple(r) for r in read_policies(spark, str(tmp_path)).orderBy("article").collect()]
    assert rows == [("policy:refund:2-1", "refund", "Refunds", "2-1", "First days", "Seven days.\n\nMore.", "conflicting", "see 2-2"), ("policy:refund:2-2", "refund", "Refunds", "2-2", "Later", "Two weeks.", "none", None)]
    (tmp_path / "b.md").write_text("---\nslug: x\n---\n## 1-1 T\nText\n", encoding="utf-8")
    with pytest.raises(Exception, match="no title"):
        read_policies(spark, str(tmp_path)).collect()


def test_jsonl(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id":"a"}\n\n{"id":"b"}\n')
    assert read_jsonl(spark, str(p), "id string").count() == 2
    p.write_text('{"id":"a"}\nnope\n')
    with pytest.raises(Exception):
        read_jsonl(spark, str(p), "id string").collect()


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("a", datetime(2024, 1, 1), "x"), ("a", datetime(2024, 1, 1), "x"), ("b", datetime(2024, 1, 2), "y")]
    spark.createDataFrame(rows, "id string, loaded timestamp, status string").write.parquet(src)
    stream = arriving(spark, src, "id string, loaded timestamp, status string", "id", "loaded")
    write_batches(stream, lambda d: d.groupBy("status").count(), out, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.status, r["count"]) for r in spark.read.parquet(out).collect()) == [("x", 1), ("y", 1)]
    assert counted(stream, "loaded", "1 day", ["status"]).isStreaming


def test_gate_folds_texts_and_searches_drafts_without_claims(spark):
    claim = lambda t: '{"claims": [{"text": "%s", "citation_ids": ["010-9999-8888"]}], "note": "010-7777-6666"}' % t
    rows = [("wide", claim("０１０－１２３４－５６７８")), ("hidden", claim("010-12\u200b34-5678")), ("echo", claim("０１０－１２３４－５６７８")), ("bare", '"010-1234-5678"'), ("plain", "call 010-1234-5678"), ("other", '{"answer": {"body": ["010-1234-5678"], "citation_ids": ["010-9999-8888"]}}'), ("clean", claim("none")), ("null", None)]
    drafts = spark.createDataFrame(rows, "record_id string, raw_draft string")
    evidence = spark.createDataFrame([("echo", "010\u200b-1234-5678")], "record_id string, text string")
    got = {r.record_id: r["values"] for r in gate.unsourced(nested.json_triples(drafts, "record_id", "raw_draft"), evidence).collect()}
    assert got == dict.fromkeys(("wide", "hidden", "bare", "plain", "other"), ["01012345678"])


def test_sets_of_runs_are_assembled_from_confirmed_conditions(spark):
    runs = spark.createDataFrame([(r, i) for i, r in enumerate(["e", "d", "old", "c", "u", "b", "x", "a"])], "run_id string, started_at int")
    rows = [(r, n, "1") for r in ("a", "c", "d", "e", "old") for n in ("k", "m")] + [("b", "k", "1"), ("b", "m", "2"), ("u", "k", "1"), ("x", "k", "1"), ("x", "m", "1")]
    c = spark.createDataFrame(rows, "run_id string, name string, value string")
    got = lambda **k: {r.run_id: (r.place, r.reason) for r in regression.assemble(runs, c, "a", 3, ["x"], **k).collect()}
    assert got() == {"a": (1, None), "b": (None, "differs"), "u": (None, "unknown"), "c": (2, None), "old": (3, None)}
    assert got(fields=["never"])["c"] == (None, "unknown")
    drift = regression.promotion_drift(spark.createDataFrame([("k", "9"), ("z", "0")], "name string, value string"), c.filter("run_id in ('a', 'b', 'u')"), "a")
    assert sorted(tuple(r) for r in drift.collect()) == [("a", "k", "9", "1"), ("b", "m", "1", "2")]


def test_conditions_derived(spark):
    rows = [("r", "X `g-1` (effort=low)", "`e-1`", None, "vector_rewrite", {"embedding_model": "e-2", "top_k": "5", "none": None}), ("old", None, None, None, "vector", None)]
    df = spark.createDataFrame(rows, "run_id string, generation string, embedding string, judge string, strategy string, explicit map<string,string>")
    got = {(r.run_id, r.name): r.value for r in regression.derive_conditions(df).collect()}
    assert got == {("r", "generation_model"): "g-1", ("r", "generation_effort"): "low", ("r", "query_rewrite"): "on", ("r", "embedding_model"): "e-2", ("r", "top_k"): "5", ("old", "query_rewrite"): "off"}


def test_cache_makes_each_text_once(spark, tmp_path):
    folder = str(tmp_path / "cache")
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "i int, t string")
    made = lambda d: {r.i: r.made for r in records.cached(d, "t", folder, F.length, "int").collect()}
    assert made(df) == {1: 1, 2: 1, 3: None, 4: 1} and spark.read.parquet(folder).count() == 2
    assert made(df.unionByName(spark.createDataFrame([(5, "ccc")], "i int, t string")))[5] == 3 and spark.read.parquet(folder).count() == 3
    assert records.cache_misses(df, "t", spark.read.parquet(folder), "digest").count() == 0


def test_values_lowered_for_json(spark):
    df = spark.sql("SELECT TIMESTAMP '2024-01-02 03:04:05.5' AS t, DATE '2024-01-02' AS d, CAST(1.50 AS DECIMAL(5, 2)) AS n, 1 AS i, CAST(NULL AS DATE) AS z")
    assert tuple(records.lowered(df).first()) == ("2024-01-02T03:04:05.500000Z", "2024-01-02", "1.50", 1, None)
