import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.operators import chunking, metrics, retrieval


def test_topk_equals_brute_force_in_any_blocks(spark):
    rng = np.random.default_rng(1)
    m = rng.integers(-2, 3, (60, 6)).astype(float)
    m[7] = 0
    rows = [(i, m[i].tolist()) for i in range(60)] + [(60, None), (61, [1.0, 2.0]), (62, [None, 1.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    q = df.filter("id % 20 = 0").select(F.col("id").alias("case_id"), F.col("v").alias("vector"))
    c = df.select(F.col("id").alias("evidence_id"), F.col("v").alias("vector"))
    n = np.where((x := np.linalg.norm(m, axis=1)) == 0, 1, x)
    sims = (m @ m.T) / n[:, None] / n[None, :]
    want = {(i, j, k + 1) for i in (0, 20, 40) for k, j in enumerate(sorted((j for j in range(60) if j != i), key=lambda j: (-round(sims[i, j], 12), j))[:5])}
    for most, qb, cb in ((1 << 20, 1, 1), (0, 2048, 16384), (0, 2, 7)):
        got = {(r.case_id, r.evidence_id, r.rank) for r in retrieval.exact_topk(q, c, 5, exclude_same=True, query_block=qb, corpus_block=cb, most_bytes=most).collect()}
        assert got == want


def test_topk_of_text_ids_in_many_small_batches(spark):
    """Ties across batches of one partition are broken by id as everywhere."""
    rng = np.random.default_rng(3)
    m = rng.integers(-1, 2, (90, 3)).astype(float)
    df = spark.createDataFrame([(f"v{i % 7}{i:03}", m[i].tolist()) for i in range(90)], "id string, v array<double>").coalesce(2)
    q = df.filter("id like '%5'").select(F.col("id").alias("case_id"), F.col("v").alias("vector"))
    c = df.select(F.col("id").alias("evidence_id"), F.col("v").alias("vector"))
    rows = lambda **k: {(r.case_id, r.evidence_id, r.rank, round(r.similarity, 9)) for r in retrieval.exact_topk(q, c, 4, **k).collect()}
    want = rows(most_bytes=0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        assert rows() == want and len(want) == 4 * q.count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert retrieval.exact_topk(q.limit(0), c, 4).count() == 0 and retrieval.exact_topk(q, c.limit(0), 4).count() == 0


def test_fusion_and_rerank(spark):
    a = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "case_id int, evidence_id string, rank int")
    b = spark.createDataFrame([(1, "b", 1), (1, "d", 2)], "case_id int, evidence_id string, rank int")
    fused = retrieval.fuse(a, b)
    assert [(r.evidence_id, r.rank) for r in fused.orderBy("rank").collect()] == [("b", 1), ("a", 2), ("d", 3), ("c", 4)]
    order = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "case_id int, evidence_id string, position int")
    assert [r.evidence_id for r in retrieval.rerank(fused, order, 2).orderBy("final_rank").collect()] == ["a", "b", "d", "c"]
    bad = order.withColumn("evidence_id", F.lit("a"))
    assert [r.evidence_id for r in retrieval.rerank(fused, bad.limit(1), 2).orderBy("final_rank").collect()] == ["b", "a", "d", "c"]


def test_bm25_by_hand(spark):
    docs = {"d1": "abc", "d2": "abab", "d3": "", "d4": "xyz"}
    c = spark.createDataFrame(list(docs.items()), "evidence_id string, text string")
    q = spark.createDataFrame([("q", "ab ab"), ("none", "??")], "case_id string, text string")
    grams = {k: [v[i : i + 2] for i in range(len(v) - 1)] for k, v in docs.items()}
    avg = sum(map(len, grams.values())) / 4

    def score(d):
        total = 0
        for t in {"ab", "ba"}:
            df = sum(t in g for g in grams.values())
            tf = grams[d].count(t)
            if tf:
                total += math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(grams[d]) / avg))
        return round(total, 9)

    want = sorted(docs, key=lambda d: (-score(d), d))[:3]
    got = {(r.case_id, r.rank): (r.evidence_id, r.score) for r in retrieval.bm25(q, c, 3).collect()}
    assert [got["q", i + 1] for i in range(3)] == [(d, pytest.approx(score(d))) for d in want]
    assert [got["none", i + 1] for i in range(3)] == [("d1", 0.0), ("d2", 0.0), ("d3", 0.0)]


def test_bm25_moves_no_pairs(spark):
    """Scores of pairs are not shuffled, and terms in parts give the same."""
    c = spark.createDataFrame([(i, f"refund of order {i % 37}") for i in range(400)], "evidence_id long, text string")
    q = spark.createDataFrame([(i, f"order {i % 3}") for i in range(60)], "case_id long, text string")
    found = retrieval.bm25(q, c, 4)
    assert not re.search(r"hashpartitioning\(case_id#\d+L?, evidence_id#", found._jdf.queryExecution().toString())
    whole = sorted(map(tuple, found.collect()))
    assert len(whole) == 240
    assert sorted(map(tuple, retrieval.bm25(q, c, 4, most_bytes=700).collect())) == whole


def test_bounded_join_salted_equals_broadcast(spark):
    a = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    b = spark.createDataFrame([(0, "x"), (1, "y"), (1, "z")], "k long, v string")
    rows = lambda d: sorted(tuple(r) for r in d.select("k", "id", "v").collect())
    assert rows(retrieval.bounded_join(a, b, ["k"], "id")) == rows(retrieval.bounded_join(a, b, ["k"], "id", most=1))


def test_null_aware_metrics(spark):
    hits = spark.createDataFrame([(1, 1, 0.9, True), (1, 2, None, True), (2, 1, 0.1, False)], "case_id int, rank int, score double, relevant boolean")
    cases = spark.createDataFrame([(1, 2), (2, 0), (3, 1), (4, 0)], "case_id int, n_relevant int")
    got = {r.case_id: (r.recall_at_5, r.precision, r.recall) for r in metrics.case_metrics(hits, cases, 0.5).collect()}
    assert got == {1: (1.0, 1.0, 0.5), 2: (None, 1.0, None), 3: (0.0, None, 0.0), 4: (None, 1.0, None)}


def test_axis_must_divide():
    assert metrics.axis("0", "0.3", "0.1") == [0.0, 0.1, 0.2, 0.3]
    with pytest.raises(ValueError):
        metrics.axis("0", "1", "0.3")


def test_windows(spark):
    df = spark.createDataFrame([("a", 0), ("b", 10), ("c", 11), ("d", 25), ("e", None)], "k string, n int")
    got = [(r.k, r.window_no, r.start_pos, r.end_pos) for r in chunking.fixed_windows(df, "k", "n", 10, 3).orderBy("k", "window_no").collect()]
    assert got == [("b", 0, 0, 10), ("c", 0, 0, 10), ("c", 1, 7, 11), ("d", 0, 0, 10), ("d", 1, 7, 17), ("d", 2, 14, 24), ("d", 3, 21, 25)]


def test_same_result_for_any_number_of_partitions(spark, small):
    from gneiss.plans.retrieval import rrf_fusion

    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(tuple(r) for r in rrf_fusion(spark, small).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
