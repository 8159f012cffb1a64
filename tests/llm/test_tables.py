"""Operators over tables: brute force, nulls, ties, repeated and empty tables, clashing columns, hot groups."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gneiss.llm import dedup, neighbours, packing, pairs, pii, queries, sentences, splitting, tokenize


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 16))
    m[20:24] = m[5]  # copies
    m[40] = m[41] * 3  # the same direction
    rows = [(i, "a" if i % 3 else "b", m[i].tolist(), 16) for i in range(300)]
    rows += [(7, "a", m[7].tolist(), 16), (900, "a", None, 16), (901, "a", [0.0] * 16, 16), (902, "a", [float("nan")] * 16, 16), (903, "a", [1.0] * 15, 16), (904, "a", m[0].tolist(), 15), (905, "a", [None] + [1.0] * 15, 16), (906, "a", [float("inf")] * 16, 16), (907, None, m[1].tolist(), 16)]
    df = spark.createDataFrame(rows, "id long, grp string, v array<double>, q int").withColumn("other", F.lit(1))
    v = neighbours.usable_vectors(df, "id", "v", "grp", 16, "q")
    assert v.count() == 301
    got = {(r.id, r.other) for r in neighbours.neighbours(v, 5, files=16).collect()}
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    good = 0
    for g in (0, 1):
        ids = np.array([i for i in range(300) if bool(i % 3) == bool(g)])
        s = np.round(unit[ids] @ unit[ids].T, 6)
        for a, i in enumerate(ids):
            order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-s[a, b], ids[b]))[:5]
            good += sum((int(i), int(ids[b])) in got for b in order)
    assert good / 1500 > 0.97
    assert all(a != b for a, b in got) and len(got) == 1500


def test_neighbours_of_many_copies_and_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "a", [1.0] * 8) for i in range(40)] + [(i, "a", rng.normal(size=8).tolist()) for i in range(40, 100)]
    v = neighbours.usable_vectors(spark.createDataFrame(rows, "id long, grp string, v array<double>"), "id", "v", "grp", 8)
    small = {(r.id, r.other) for r in neighbours.neighbours(v, 3, block=8, files=40, length=40, reranked=99).collect()}
    large = {(r.id, r.other) for r in neighbours.neighbours(v, 3, files=40, length=40, reranked=99).collect()}
    assert len(large) == 300 and len(small & large) > 250
    assert {x for x in small if x[0] < 40} == {x for x in large if x[0] < 40}
    assert {o for i, o in large if i == 30} == {0, 1, 2}
    assert neighbours.neighbours(v.limit(0), 3).count() == 0


def test_neighbours_do_not_depend_on_the_size_of_a_block(spark):
    """Files many times a block, ranked by footrule: the same pairs as with whole files."""
    rng = np.random.default_rng(8)
    m = np.repeat(rng.normal(size=(100, 12)), 15, axis=0) + 0.25 * rng.normal(size=(1500, 12))
    v = neighbours.usable_vectors(spark.createDataFrame([(i, "a" if i % 7 else None, x.tolist()) for i, x in enumerate(m)], "id long, grp string, v array<double>"), "id", "v", "grp", 12)
    whole = {(r.id, r.other, round(r.sim, 5)) for r in neighbours.neighbours(v, 5, reranked=12).collect()}
    assert len(whole) == 7500
    for block in (16, 100):
        assert {(r.id, r.other, round(r.sim, 5)) for r in neighbours.neighbours(v, 5, reranked=12, block=block).collect()} == whole


def test_ties_of_neighbours_are_decided_by_ids_alone(spark):
    """Vectors that are equal once stored in 16 bits but aren't copies: neither blocks nor batches nor the order of the rows choose among them."""
    rng = np.random.default_rng(9)
    m = np.repeat(rng.normal(size=(40, 24)), 30, axis=0)
    m += np.abs(m).max(axis=1)[:, None] * 1e-6 * rng.uniform(-1, 1, size=m.shape)
    q = np.rint(m / np.abs(m).max(axis=1)[:, None] * 32767)
    unit = q / np.linalg.norm(q, axis=1)[:, None]
    s = np.round(unit @ unit.T, 9)
    s[np.arange(1200), np.arange(1200)] = -2
    want = {(i, int(o)) for i in range(1200) for o in np.argsort(-s[i], kind="stable")[:5]}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for block, batch, order in ((32_768, "10000", 1), (50, "10000", -1), (50, "7", 1), (9, "64", -1)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            df = spark.createDataFrame([(i, "a", m[i].tolist()) for i in range(1200)[::order]], "id long, grp string, v array<double>")
            found = neighbours.neighbours(neighbours.usable_vectors(df, "id", "v", "grp", 24), 5, block=block)
            assert {(r.id, r.other) for r in found.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_blocks_in_which_nobody_asks(spark):
    rng = np.random.default_rng(13)
    v = neighbours.usable_vectors(spark.createDataFrame([(i, "a", rng.normal(size=6).tolist()) for i in range(12)], "id long, grp string, v array<double>"), "id", "v", "grp", 6)
    assert set(neighbours.neighbours(v, 3, block=1).collect()) == set(neighbours.neighbours(v, 3).collect())


def test_copies_come_before_near_copies_in_classes_of_any_size(spark):
    near = [1.0, 0.5, 0.25]
    rows = [(i, "a", [1.0, 0.5, 0.25 + 1e-6 * (i + 1)]) for i in range(5)]
    for copies in (2, 3, 4, 5):
        df = spark.createDataFrame(rows + [(10 + i, "a", near) for i in range(copies)], "id long, grp string, v array<double>")
        found = neighbours.neighbours(neighbours.usable_vectors(df, "id", "v", "grp", 3), 3).filter("id = 10").collect()
        assert {r.other for r in found} == {11, *range(12, 9 + min(copies, 4) + 1), *range(4 - min(copies, 4))}


def test_nearest_pivots_are_exact():
    """Pivots that single precision can't tell apart: all are compared, and of equal ones the first count."""
    rng = np.random.default_rng(10)
    q = np.rint(rng.normal(size=(70, 24)) * 8000).astype("<i2")
    p = np.concatenate([np.repeat(q[:20], 10, axis=0), np.rint(rng.normal(size=(300, 24)) * 8000).astype("<i2")])
    p[:200:3, 0] += 1
    got = neighbours._nearest_pivots(q, p, neighbours._unit(p), 6)
    sims = (q.astype(object) @ p.T.astype(object)).astype(float) / np.linalg.norm(p.astype(float), axis=1)
    assert (got == np.argsort(-sims, axis=1, kind="stable")[:, :6]).all()
    assert (got[13:29] == np.concatenate([neighbours._nearest_pivots(q[i : i + 1], p, neighbours._unit(p), 6) for i in range(13, 29)])).all()


def test_classes_of_copies_in_parts(spark, monkeypatch):
    """Classes larger than a task's part, hot ones, and ones of at most k members."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 8))
    rows = [(i, "a", base[0 if i < 200 else 1 if i < 203 else i % 28 + 2].tolist()) for i in range(231)]
    v = neighbours.usable_vectors(spark.createDataFrame(rows, "id long, grp string, v array<double>"), "id", "v", "grp", 8)
    plain = {(r.id, r.other, round(r.sim, 5)) for r in neighbours.neighbours(v, 4, files=8, reranked=99).collect()}
    monkeypatch.setattr(neighbours, "MEMBERS", 7)
    assert {(r.id, r.other, round(r.sim, 5)) for r in neighbours.neighbours(v, 4, files=8, reranked=99).collect()} == plain
    assert {o for i, o, _ in plain if i == 150} == {0, 1, 2, 3} and {o for i, o, s in plain if i == 2} == {0, 1, 3, 4}
    assert {200, 201} <= {o for i, o, _ in plain if i == 202} and sum(i == 202 for i, _, _ in plain) == 4


def test_directions_that_differ_by_less_than_the_stored_bits_are_no_copies(spark):
    near = [1.0, 0.5, 0.25]
    rows = [(1, "a", near), (2, "a", [1.0, 0.5, 0.2500001]), (3, "a", near), (4, "a", [2.0, 1.0, 0.5])]
    v = neighbours.usable_vectors(spark.createDataFrame(rows, "id long, grp string, v array<double>"), "id", "v", "grp", 3)
    same = {r.id: bytes(r.same) for r in v.collect()}
    assert same[1] == same[3] == same[4] != same[2]


def test_footrule_is_its_definition():
    rng = np.random.default_rng(1)
    lists = np.stack([rng.permutation(30)[:6] for _ in range(40)]).astype("<i2")
    got = neighbours._footrule(lists[:10], lists, 30)
    place = lambda row, p: int(np.flatnonzero(row == p)[0]) if p in row else 6  # noqa: E731  # right after the end where it is missing
    want = np.array([[sum(abs(place(a, p) - place(b, p)) for p in set(a) | set(b)) for b in lists] for a in lists[:10]])
    assert len(set((got - want).ravel().tolist())) == 1


def test_recall_with_default_parameters(spark):
    """100,000 vectors in clusters of all sizes; files are larger than what is reranked, so ranking by footrule decides."""
    rng = np.random.default_rng(11)
    n, d = 100_000, 24
    centres = rng.normal(size=(400, d))
    around = rng.normal(size=(400, 5, d))  # a cluster spreads in five directions of its own
    which = rng.zipf(1.3, n) % 400
    m = (centres[which] + 0.3 * np.einsum("nk,nkd->nd", rng.normal(size=(n, 5)), around[which])).astype(np.float32)
    table = pa.table({"id": pa.array(np.arange(n)), "grp": pa.array(["a"] * n), "v": pa.array(list(m), pa.list_(pa.float32()))})
    df = spark.createDataFrame(table)
    got = neighbours.neighbours(neighbours.usable_vectors(df, "id", "v", "grp", d), 5).filter("id % 500 = 0")
    rows = {}
    for r in got.collect():
        rows.setdefault(r.id, set()).add(r.other)
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    asked = np.arange(0, n, 500)
    s = unit[asked] @ unit.T
    s[np.arange(len(asked)), asked] = -2
    best = np.argpartition(-s, 5, axis=1)[:, :5]
    assert all(len(rows[int(i)]) == 5 for i in asked)
    assert np.mean([int(b) in rows[int(i)] for i, row in zip(asked, best) for b in row]) > 0.9


def test_recall_in_files_of_thousands(spark):
    """So few pivots that files hold as many vectors as those of millions: neighbours whose second pivots differ still meet."""
    rng = np.random.default_rng(12)
    m = np.repeat(rng.normal(size=(500, 48)), 20, axis=0) + 0.3 * rng.normal(size=(10_000, 48))
    df = spark.createDataFrame(pa.table({"id": pa.array(np.arange(len(m))), "grp": pa.array(["a"] * len(m)), "v": pa.array(list(m.astype(np.float32)), pa.list_(pa.float32()))}))
    got = {(r.id, r.other) for r in neighbours.neighbours(neighbours.usable_vectors(df, "id", "v", "grp", 48), 5, per_root=0.16, reranked=400).filter("id % 20 = 0").collect()}
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    asked = np.arange(0, len(m), 20)
    s = unit[asked] @ unit.T
    s[np.arange(len(asked)), asked] = -2
    best = np.argpartition(-s, 5, axis=1)[:, :5]
    assert np.mean([(int(i), int(b)) in got for i, row in zip(asked, best) for b in row]) > 0.98


def test_pieces_table(spark):
    rows = [(1, "1-1", "x" * 601, "p"), (2, None, "짧음", "p"), (3, None, None, "p"), (4, None, "가. " * 400, "p"), (5, "5-1", "\n" * 700, "p")]
    df = spark.createDataFrame(rows, "id long, article string, content string, piece string")
    got = splitting.split_rows(df, "id", "content", "article").collect()
    assert {r.id for r in got} == {1, 4, 5} and all(len(r.piece) <= 600 for r in got)
    assert {r.article for r in got if r.id == 4} == {None}
    assert splitting.split_rows(df.limit(0), "id", "content", "article").count() == 0


def test_articles_of_the_earliest_load(spark):
    long = "가. " * 300 + "\n6-15. 제목\n" + "나. " * 10
    rows = [(1, "1-1", long, 2, "x"), (1, "1-1", "짧음", 3, "x"), (2, "2-1", "짧음", 1, "x"), (2, "2-1", long, 2, "x"), (3, None, long, 1, "x"), (4, "4-1", None, None, "x"), (5, "5-1", long, 1, "x"), (5, "5-1", long, 1, "x")]
    df = spark.createDataFrame(rows, "id long, article string, content string, v int, articles string")
    got = sorted((r.id, r.article or "") for r in splitting.articles_of(df, "id", "content", "article", "v").collect())
    assert got == [(1, "1-1"), (1, "6-15"), (3, ""), (3, "6-15"), (5, "5-1"), (5, "6-15")]
    assert splitting.articles_of(df.limit(0), "id", "content", "article", "v").count() == 0


def test_token_table(spark):
    if not __import__("os").path.isdir(tokenize.VOCABULARIES):
        pytest.skip("no vocabularies here")
    df = spark.createDataFrame([(1, "a b", 9), (1, "a b", 9), (2, None, 9), (3, "", 9)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, len(r.ids)) for r in tokenize.encode(df, "doc_id", "text").collect())
    assert got == [(1, 2), (1, 2), (2, 0), (3, 0)]
    assert sorted(tuple(r) for r in tokenize.count_tokens(df, "doc_id", "text").collect()) == [(1, 2), (1, 2), (2, 0), (3, 0)]


def test_packing(spark):
    rows = [(i, n, 1) for i, n in enumerate([5, 5, 5, 3, 3, 2, 0, 0, None, 10, 23, 7, 1, 1, 1] + [4] * 300)]
    df = spark.createDataFrame(rows, "id long, n int, container_id int")
    got = packing.pack(df, "id", "n", 10).collect()
    used, by = defaultdict(int), defaultdict(list)
    for r in got:
        used[r.container_id] += r.n_units
        by[r.id].append(r)
    assert max(used.values()) <= 10 and set(by) == set(range(len(rows)))
    for i, n, _ in rows:
        parts = sorted(by[i], key=lambda r: r.piece_no)
        assert sum(p.n_units for p in parts) == (n or 0)
        assert len(parts) == max(1, -(-(n or 0) // 10))
        assert [p.first_unit for p in parts] == [10 * k for k in range(len(parts))]
    assert packing.pack(df.limit(0), "id", "n", 10).count() == 0
    report = packing.fill_report(packing.pack(df, "id", "n", 10), 10).first()
    assert report.units == sum(n or 0 for _, n, _ in rows) and report.fullest <= 10


@pytest.mark.parametrize("seed", range(5))
def test_plan_covers_every_rank_once(seed):
    import random

    random.seed(seed)
    cap = random.choice([5, 10, 37])
    h = {random.randint(1, cap): random.randint(1, 400) for _ in range(20)}
    slots, n = packing.plan(h, cap)
    used, seen = [0] * n, defaultdict(set)
    for s in slots:
        for r in range(s.rank_from, s.rank_to):
            used[s.container + (r - s.rank_from) // s.each] += s.length
            assert r not in seen[s.length]
            seen[s.length].add(r)
    assert {k: len(v) for k, v in seen.items()} == h and all(0 < u <= cap for u in used)


COPIES = [
    ("a1", "주문번호: ORD-1\n모델: KA-003\n내용: 배송이 언제 되나요?"), ("a2", "모델=KA003 | 내용=배송이   언제 되나요 | 주문번호=ord-1"), ("a3", "내용 배송이 언제되나요 모델 KA 003 주문번호 ORD1"),
    ("b1", "Hello, World!"), ("b2", "hello world"), ("b3", "**HELLO** — world…"), ("b2", "hello world"), ("c1", "world hello"), ("d1", None), ("d2", ""), ("d3", "  !! "), ("d4", "??"), ("e1", "모델: X\n내용: Y"), ("e2", "모델: X\n내용: Z"), (None, "hello world"),
]


def test_copies(spark):
    df = spark.createDataFrame(COPIES, "id string, content string").withColumn("key", F.lit(1)).withColumn("copies", F.lit(2))
    labels = dedup.known_labels(df, "content", 0.01)
    assert {"모델", "내용", "주문번호"} <= set(labels)
    keys = dedup.keyed(df, "id", "content", labels)
    got = {tuple(r) for r in dedup.copies(keys, dedup.ledger_of(keys)).collect()}
    assert got == {("a1", "a2"), ("a1", "a3"), ("b1", "b2"), ("b1", "b3")}
    assert dedup.copies(keys.limit(0), dedup.ledger_of(keys.limit(0))).count() == 0
    counts = {r.record_id: r.copies for r in dedup.representatives(df, "id", "content").collect()}
    assert counts["a1"] == 3 and counts["b1"] == 3 and counts["c1"] == 1


def _keys(spark, rows):
    return dedup.keyed(spark.createDataFrame(rows, "id string, content string, at timestamp"), "id", "content", [], "at")


def test_ledger_in_batches_equals_one(spark):
    from datetime import datetime

    rows = [(f"{i:03}", f"text {i % 7}", datetime(2020 + i * 3 % 4, 1 + i % 12, 1) if i % 11 else None) for i in range(200)]
    keys = _keys(spark, rows + rows[:20])
    show = lambda ledger: {tuple(r) for r in ledger.select(F.hex("key"), "copies", "first_id", "earliest.record_id").collect()}
    assert len(dedup.batches(keys)) == 5
    assert show(dedup.merged_ledger(keys)) == show(dedup.ledger_of(keys))
    firsts = {min((a is not None, a, i) for i, t, a in rows if t == f"text {k}")[2] for k in range(7)}
    assert {r[3] for r in show(dedup.merged_ledger(keys))} == firsts
    assert dedup.merged_ledger(keys.limit(0)).count() == 0


def test_stored_ledger_is_merged_in_its_buckets(spark):
    from datetime import datetime

    keys = _keys(spark, [(str(i), f"t{i}", datetime(2020 + i % 2, 1, 1)) for i in range(40)])
    plan = dedup.merged_ledger(keys)._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" in plan and plan.count("Exchange hashpartitioning") == 1  # only the batch moves


def test_copies_with_rare_labels(spark):
    """Labels that hardly any form uses are found among the texts of the same letters."""
    many = [(f"m{i}", f"모델: A{i}\n내용: B{i}") for i in range(2000)]
    rare = [("r1", "희귀한 라벨: 가나 12 / 다른 이름표: 다라"), ("r2", "다른 이름표 다라 희귀한라벨 가나12"), ("r3", "다른이름표=다라 | 희귀한 라벨=가나12"), ("r4", "희귀한 라벨 다라 다른 이름표 가나12"), ("r5", "가나12다라희귀한라벨다른이름표")]
    df = spark.createDataFrame(many + rare, "id string, content string")
    labels = dedup.known_labels(df, "content")
    assert labels == ["내용", "모델"]
    keys = dedup.keyed(df, "id", "content", labels)
    assert {tuple(r) for r in dedup.copies(keys, dedup.ledger_of(keys)).collect()} == {("r1", "r2"), ("r1", "r3")}


def test_labels_of_any_length_behind_any_marks(spark):
    dashes = "-" * 40
    rows = [("a", f"{dashes}\n고객님 께서 이번에 주문 하신 상품 이름: 우산\n내용: 환불"), ("b", "내용 환불 고객님께서 이번에 주문하신 상품이름 우산"), ("c", "내용: 환불 | 고객님 께서 이번에 주문 하신 상품 이름   = 우산")]
    df = spark.createDataFrame(rows, "id string, content string")
    keys = dedup.keyed(df, "id", "content", dedup.known_labels(df, "content"))
    assert {tuple(r) for r in dedup.copies(keys, dedup.ledger_of(keys)).collect()} == {("a", "b"), ("a", "c")}


def test_pair_defects(spark, small):
    rows = spark.read.parquet(f"{small}/inquiries.parquet").filter("status = 'answered'").select("id", "content", "answer", "loaded_at")
    extra = [("x1", "배송비는 얼마인가요? 궁금합니다.", None), ("x2", "배송비는 얼마인가요? 궁금합니다.", " n/a "), ("x3", "배송비는 얼마인가요? 궁금합니다.", "“배송비는 얼마인가요?  궁금합니다”"), ("x4", "배송비는 얼마인가요?", "죄송하지만 그 건은 도와드리기 어렵습니다."), ("x5", "배송비는 얼마인가요?", "Ihre Bestellung wurde am 9. Mai versandt."), ("x6", None, "배송비는 무료입니다."), ("x7", "배송비는 얼마인가요?", "배송비는 3,000원 이상 구매하시면 무")]
    more = spark.createDataFrame(extra, "id string, content string, answer string").withColumn("loaded_at", F.lit("2024-01-01").cast("timestamp"))
    got = {r.id: r.defect for r in pairs.pair_defects(rows.unionByName(more).unionByName(more), "id", "content", "answer", "loaded_at").collect()}
    assert {k: got.get(k) for k, _, _ in extra} == {"x1": "empty", "x2": "empty", "x3": "copy", "x4": "refusal", "x5": "other_language", "x6": None, "x7": "truncated"}
    assert pairs.pair_defects(rows.limit(0), "id", "content", "answer", "loaded_at").count() == 0


SHAPES = [
    ("메일은 a.b+c1@mail.example.net 입니다", [("email", 4)]), ("moss1 (at) example.com으로", [("email", 0)]), ("tel 010 0593 2158입니다", [("phone", 4)]), ("전화(010-0274-2760)가", [("phone", 3)]), ("번호 (010) 0643-1936", [("phone", 3)]),
    ("휴대폰 +8210-0433-7715", [("phone", 4)]), ("1552-0674에서", [("phone", 0)]), ("공일공-일이육사-이오공오입니다", [("phone", 0)]), ("０１０－００３１－９８７１", [("phone", 0)]), ("주민번호 990223 5557708 맞나요", [("id_number", 5)]), ("M93164579", [("id_number", 0)]), ("27-76-934928-51", [("id_number", 0)]),
    ("주문 ORD-20240613-0004, 송장 642259641426, 승인 99144807, 010-****-2587", []), ("지금은 마루도 해오름구 구름다리길 119에 살아요", [("address", 4)]), ("가람특별시에만 있나요? 101동 앞", []), ("Ship it to 178 Solhyang-gil, Haeoreum-gu, Noeul-si.", [("address", 11)]), ("露野県朝凪市若草4丁目32番8号に", [("address", 0)]), ("電話は０１０－１３１４－９７２４です", [("phone", 3)]), ("電話は+82 10-1216-3440です", [("phone", 3)]), ("身分証番号は810510 - 6919740です", [("id_number", 6)]), ("주민번호는990223-5557708", [("id_number", 5)]),
]


@pytest.mark.parametrize("text, want", SHAPES)
def test_shapes(text, want):
    assert [(k, a) for a, _, k in pii.shaped(text)] == want


HINTED = [
    ("Ship to 12 Green Street, Dover, it’s urgent", [("address", 8)]), ("東京都港区芝公園4-2-8です", [("address", 0)]), ("배송지는 솔내시 느티나무길 87, 다래오피스텔 129동", [("address", 5)]), ("느티나무길 87 푸른숲아파트", [("address", 0)]),
    ("住所は露野県朝凪市若草1-2-3です", [("address", 3)]), ("朝凪市若草12-3", [("address", 0)]), ("市内は通常3-5日で届きます", []), ("Ship to 12 Green Street, please 🙂", [("address", 8)]), ("I’m at 12 Green Street", [("address", 7)]), ("주소 178 SOLHYANG-GIL 입니다", [("address", 3)]), ("moss1 [at) example.com", [("email", 0)]),
]


@pytest.mark.parametrize("text, want", HINTED)
def test_hints_drop_no_match(text, want):
    assert [(k, a) for a, _, k in pii.shaped(text)] == want


GIVEN = [a + b for a in "리채람소미별" for b in "온현솔해담"]
PEOPLE = [f + g for f in "김표육맹" for g in GIVEN]


def _persons(spark):
    rows = [(n[0] + " " + n[1:] if i % 9 == 0 else n, f"010-1234-{5000 + i}", f"user{i}@example.com", f"마루도 해오름구 구름다리길 {i + 1}") for i, n in enumerate(PEOPLE[:20])]
    return spark.createDataFrame([*rows, (None, None, None, None), ("", " ", "x", "y")], "who string, phone string, mail string, address string")


def _bootstrapped(spark, df, texts=("content", "answer")):
    persons = _persons(spark)
    contexts, seeds = pii.Contexts(pii.family_names(persons, "who")), pii.seed_table(persons, "who", "phone", "mail", "address")
    return contexts, seeds, pii.finder(df, "id", list(texts), contexts, seeds)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(str(i), f"제 이름은 {n}입니다. 확인 부탁드려요.", None) for i, n in enumerate(PEOPLE[:60])]
    rows += [(f"n{i}", "접이식 캠핑 웨건 주문입니다.", f"어제 오신 {n} 씨께 전했습니다.") for i, n in enumerate(PEOPLE[50:90])]
    rows += [(f"p{i}", f"제 연락처는 010-2222-{1000 + i}입니다.", f"등록된 010-3333-{1000 + i}(으)로 연락드립니다.") for i in range(30)]
    rows += [(f"s{i}", None, f"등록된 1588-{1000 + i}(으)로 연락드립니다.") for i in range(6)]
    rows += [(f"r{i}", f"주민번호 9101{i:02}-1{i:02}4567 맞나요?", None) for i in range(10, 30)]
    rows += [("t", "고객님 이름으로 된 쿠폰이라고 떠요.", ""), ("u", None, None), ("v", "메일은 New.User@Other.example 입니다", "누리도 초롱시 참나무로 12 앞에")]
    return spark.createDataFrame(rows, "id string, content string, answer string").withColumns({"start_pos": F.lit(1), "k": F.lit("x"), "pii_type": F.lit("y")})


def test_all_types_by_bootstrap(spark, corpus):
    contexts, seeds, who = _bootstrapped(spark, corpus)
    learned = lambda kind, slot, text: pii.pattern_id(slot, kind, text) in who.trusted
    assert learned("name", pii.SHORT, "|씨께") and learned("phone", pii.LEFT, "등록된")  # learned, not given
    assert learned("phone", pii.FORM, "mobile") and learned("phone", pii.FORM, "service")  # the second by what it shares places with
    rows = {tuple(r) for r in pii.found_rows(corpus, "id", ["content", "answer"], contexts, seeds).collect()}
    found = {r[:3] for r in rows}
    assert {(f"n{i}", "answer", "name") for i in range(40)} | {(f"p{i}", f, "phone") for i in range(30) for f in ("content", "answer")} | {(f"s{i}", "answer", "phone") for i in range(6)} | {(f"r{i}", "content", "id_number") for i in range(10, 30)} <= found
    assert {("0", "content", "name"), ("v", "content", "email"), ("v", "answer", "address")} <= found and not any(i in ("t", "u") for i, *_ in found)
    alone = {(r.id, f, k, a, b) for r in corpus.collect() for f in ("content", "answer") for a, b, k in who.find(r[f])}
    assert alone == rows  # one text at a time or all by joins
    out = {r.id: (r.content, r.answer) for r in pii.redacted(corpus, "id", ["content", "answer"], who).collect()}
    assert out["0"][0] == "제 이름은 [name]입니다. 확인 부탁드려요." and out["u"] == (None, None) and out["v"] == ("메일은 [email] 입니다", "[address] 앞에")


def test_empty_tables_have_no_personal_data(spark, corpus):
    persons = _persons(spark).limit(0)
    contexts, seeds = pii.Contexts(pii.family_names(persons, "who")), pii.seed_table(persons, "who", "phone", "mail", "address")
    assert pii.found_rows(corpus.limit(0), "id", ["content", "answer"], contexts, seeds).count() == 0


def test_patterns_are_learned_whatever_the_size(spark):
    rows = [f"제 이름은 {n}입니다. 확인 부탁드려요." for n in PEOPLE[:60]] + [f"어제 오신 {n} 씨께 전했습니다." for n in PEOPLE[50:90]]
    df = spark.createDataFrame([(f"{k}-{i}", t) for k in range(12) for i, t in enumerate(rows)], "id string, content string")
    once, often = (_bootstrapped(spark, d, ["content"])[2] for d in (df.filter(F.col("id").startswith("0-")), df))
    assert pii.pattern_id(pii.SHORT, "name", "|씨께") in often.trusted and once.trusted == often.trusted


def test_shapes_alone_are_not_enough(spark):
    """A value of a form that no seed has, in a place that nothing trusted shares, isn't found."""
    df = spark.createDataFrame([("a", "부품 코드 1588-1234 참고")], "id string, content string")
    assert _bootstrapped(spark, df, ["content"])[2].find("부품 코드 1588-1234 참고") == []


NAMES = [
    ("제 이름은 김구입니다.", ["김구"]), ("제 이름은 남궁민수입니다.", ["남궁민수"]), ("제 이름은 김민수입니다.", ["김민수"]), ("성함:김민수", ["김민수"]), ("수령인 허준 님", ["허준"]), ("김민수고객님께서 오셨어요", ["김민수"]), ("임 주은님께서 문의하신 건", ["임 주은"]), ("(신청인 신 새새)", ["신 새새"]),
    ("My name is Mary Ann Smith.", ["Mary Ann Smith"]), ("Dear Madonna, hello", ["Madonna"]), ("Regards, John F. Kennedy", ["John F. Kennedy"]), ("Dear Brannock Vaskell, We have it", ["Brannock Vaskell"]), ("名前は露木蒼太朗です。", ["露木蒼太朗"]), ("고객님 이름으로 된 쿠폰", []), ("주문은 됩니다", []),
]


@pytest.mark.parametrize("text, want", NAMES)
def test_names_of_any_length_are_whole(text, want):
    contexts = pii.Contexts(set(pii.FAMILY_NAMES) | {x[0] for x in pii.LONG_FAMILY_NAMES})
    seeds = {pii.pattern_id(pii.SEED, "name", str(i)) for i in range(len(pii.SEED_NAMES))}
    assert [text[a:b] for a, b, k in pii.Finder(contexts, seeds).find(text)] == want


def test_sentence_table(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet").withColumn("start_pos", F.lit(1))
    starts = sentences.sentence_starts(d, "doc_id", "text")
    texts = {r.doc_id: r.text for r in d.select("doc_id", "text").collect()}
    full = {k for k, t in texts.items() if t and t.strip()}
    rows = starts.collect()
    assert {r.doc_id for r in rows} == full
    assert all(not texts[r.doc_id][r.start_pos].isspace() for r in rows)
    parts = sentences.sentence_starts(d, "doc_id", "text", with_text=True).collect()
    assert all(texts[r.doc_id][r.start_pos : r.end_pos] == r.sentence for r in parts) and len(parts) == len(rows)
    assert sentences.sentence_starts(d.limit(0), "doc_id", "text").count() == 0


def test_start_counts_cover_documents_that_are_not_drawn(spark):
    rows = [(i, f"Tomorrow the shop opens at {i}. It is near Zeller street.") for i in range(40)] + [(100, "ร้านเปิดเวลา 9 น. ของทุกวัน"), (101, "दुकान सुबह खुलती है। धन्यवाद")] + [(102, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    drawn = sentences.training_sample(df, "doc_id", "text", 3)
    assert len(drawn) == 3 and {sentences._script(t) for t in drawn} == {"latin", "thai", "deva"}
    asked = sentences.asked_keys(drawn)
    counts = sentences.corpus_counts(df, "text", asked)
    whole = sentences.StartCounts([t for _, t in rows if t], asked)
    assert counts.open_places["latin:It"] == 40
    assert (counts.opens, counts.open_places, counts.middle) == (whole.opens, whole.open_places, whole.middle)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(name, spark, small):
    assert queries.QUERIES[name](spark, small).count() >= 0


def test_rest_of_the_library_does_not_need_this_package():
    import pathlib

    root = pathlib.Path(queries.__file__).resolve().parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "gneiss.llm" not in p.read_text(encoding="utf-8")


def test_ids_stand_for_the_bytes_of_the_text(spark):
    if not __import__("os").path.isdir(tokenize.VOCABULARIES):
        pytest.skip("no vocabularies here")
    texts = ["plain", "한국어 🙂", "", None, "é" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_bytes for r in tokenize.byte_lengths(tokenize.encode(df, "doc_id", "text"), "doc_id").collect()}
    assert got == {i: len((t or "").encode()) for i, t in enumerate(texts)}


def test_twins_name_queries():
    assert set(queries.ORACLE) <= set(queries.QUERIES)
