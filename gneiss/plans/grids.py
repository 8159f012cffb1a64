"""Queries of grids, fusion with BM25, the strategy ladder and chunk scoring.

Over the embeddings: label 9 stands for cases to which nothing is relevant and which should abstain, label 7 for
those whose two best relevant hits belong together. Over the clauses: queries are those of an id divisible by 20.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.operators import chunking, grids, metrics, retrieval
from gneiss.plans import retrieval as base
from gneiss.session import cut_lineage
from gneiss.tables import records_of

STATISTICS = ["spread", "deviation", "relative", "gap", "tail"]
TAUS = metrics.axis("0.00", "0.30", "0.05")
FLOORS, RATIOS, MARGINS = metrics.axis("0.10", "0.50", "0.05"), metrics.axis("0.30", "1.00", "0.10"), metrics.axis("0.05", "0.40", "0.05")
WIDE, POOL, TAKEN = 20, 10, 5


def _cases(spark, folder):
    hits, cases = base._labelled(spark, folder)
    return cut_lineage(hits), cases.select("case_id", "n_relevant", (F.col("case_label") == 9).alias("abstain"), (F.col("case_label") == 7).alias("pair"))


def abstention_grid(spark, folder):
    """Every statistic at every threshold: what it keeps, breaks, and the first constraint it breaks."""
    hits, cases = _cases(spark, folder)
    stats = retrieval.statistics(hits, "score", base.K)
    g = grids.abstention_grid(grids.case_summary(hits, cases, base.CUT), stats, STATISTICS, TAUS)
    return base._round(g, "precision", "recall", "f1", "accept_margin", "abstain_margin")


def grid_precheck(spark, folder):
    """Why the grid couldn't be judged; no row if it can."""
    return grids.precheck(_cases(spark, folder)[1])


def adoption_directions(spark, folder):
    """Which of three aims each of 576 settings of floor, ratio and margin reaches."""
    hits, cases = _cases(spark, folder)
    return grids.directions(hits, cases, FLOORS, RATIOS, MARGINS)


def direction_counts(spark, folder):
    """How many settings reach each aim, each two and all three."""
    return grids.direction_counts(adoption_directions(spark, folder))


def conflict_lift(spark, folder):
    """Partners (ids 2i and 2i + 1) of accepted vectors that their query ranks but doesn't accept."""
    hits = cut_lineage(base._hits(spark, folder, WIDE).withColumnRenamed("similarity", "score"))
    accepted = hits.filter((F.col("rank") <= base.K) & (F.col("score") >= base.CUT)).select("case_id", "evidence_id")
    partners = hits.select("evidence_id").distinct().select("evidence_id", F.col("evidence_id").bitwiseXOR(F.lit(1).cast("bigint")).alias("partner"))
    return base._round(grids.lifted_partners(accepted, hits, partners), "partner_score")


# --- fusion over clauses -----------------------------------------------------------------------------


def _legs(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rankings of clauses for every clause of an id divisible by 20: by vector, by the vector's first 32 values, and by
    BM25 of its title over titles and contents."""
    p = records_of(spark, folder, "policy_chunks", ["id"], ["article_title", "content", "embedding", "document_slug"])
    ok = p.filter((F.size("embedding") == 96) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e30)) & F.exists("embedding", lambda x: x != 0))
    ok = cut_lineage(ok.select("id", "article_title", "content", "embedding"))  # read by each ranking, for its queries and its corpus
    q = ok.filter(F.col("id") % 20 == 0)
    vector = lambda d=None: retrieval.exact_topk(q.select(F.col("id").alias("case_id"), F.col("embedding").alias("vector")), ok.select(F.col("id").alias("evidence_id"), F.col("embedding").alias("vector")), WIDE, dimensions=d, exclude_same=True)
    asked = q.select(F.col("id").alias("case_id"), F.col("article_title").alias("text")).filter(F.col("text").isNotNull())
    corpus = ok.select(F.col("id").alias("evidence_id"), F.concat_ws("\n", "article_title", "content").alias("text"))
    return cut_lineage(vector()), cut_lineage(vector(32)), cut_lineage(retrieval.bm25(asked, corpus, WIDE))


def _hybrid(first: DataFrame, words: DataFrame) -> DataFrame:
    return cut_lineage(retrieval.fuse(first, words))


def hybrid_fusion(spark, folder):
    """The vector ranking and the BM25 ranking fused by reciprocal ranks: the pool."""
    vector, _, words = _legs(spark, folder)
    pool = retrieval.fusion_pool(_hybrid(vector, words), POOL, TAKEN, 0.0, 1)
    return base._round(pool, "rrf").select("case_id", "evidence_id", "rank", "rrf")


def strategy_ladder(spark, folder):
    """Recall of four strategies, each adding a stage: vector, a second wording merged, BM25 fused, reranked (by id, falling).
    Relevant to a clause are the other clauses of its document."""
    vector, second, words = _legs(spark, folder)
    merged = retrieval.merge_max(vector, second)
    fused = _hybrid(merged.filter(F.col("rank") <= WIDE), words)
    pool = retrieval.fusion_pool(fused, POOL, TAKEN, 0.0, 1)
    order = pool.select("case_id", "evidence_id", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("evidence_id"))).alias("position"))
    reranked = retrieval.rerank(fused, order, POOL).select("case_id", "evidence_id", F.col("final_rank").alias("rank"))
    docs = cut_lineage(records_of(spark, folder, "policy_chunks", ["id"], ["document_slug"]))
    own = docs.select(F.col("id").alias("case_id"), F.col("document_slug").alias("own"))
    other = docs.select(F.col("id").alias("evidence_id"), F.col("document_slug").alias("slug"))
    sizes = docs.groupBy(F.col("document_slug").alias("own")).agg((F.count(F.lit(1)) - 1).alias("n_relevant"))
    cases = vector.select("case_id").distinct().join(own, "case_id").join(sizes, "own").select("case_id", "n_relevant")
    rows = []
    for name, ranking in (("vector", vector), ("vector_rewrite", merged), ("vector_rewrite_hybrid", fused), ("vector_rewrite_hybrid_rerank", reranked)):
        hits = ranking.filter(F.col("rank") <= base.K).select("case_id", "evidence_id", "rank").join(own, "case_id").join(other, "evidence_id").select("case_id", "rank", F.lit(1.0).alias("score"), (F.col("own") == F.col("slug")).alias("relevant"))
        m = metrics.macro(metrics.case_metrics(hits, cases, 0.0), ["recall_at_1", "recall_at_3", "recall_at_5", "precision"])
        rows.append(base._round(m, "recall_at_1", "recall_at_3", "recall_at_5", "precision").select(F.lit(name).alias("strategy"), "recall_at_1", "recall_at_3", "recall_at_5", "precision", F.col("n_precision").alias("cases")))
    return reduce(DataFrame.unionByName, rows)


# --- chunks ------------------------------------------------------------------------------------------


def _wanted(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Cases (every twentieth clause) with the clauses beside them, and what the windows hold."""
    pos = cut_lineage(base._spans(spark, folder))
    held = chunking.overlaps(base._units(spark, folder), pos, "slug", 0.5).join(pos.select("slug", "clause", "position"), ["slug", "clause"]).select(F.concat_ws("#", "slug", "unit").alias("unit"), "clause", "position")
    beside = F.explode(F.array(F.col("position") - 1, F.col("position"), F.col("position") + 1))
    want = pos.filter(F.col("clause") % 20 == 0).select(F.col("clause").alias("case_id"), "slug", beside.alias("position")).join(pos.select("slug", "position", "clause"), ["slug", "position"]).select("case_id", "clause")
    return want, cut_lineage(held)


def clause_coverage(spark, folder):
    """Does one window hold a clause and its neighbours, and how many others at least does it hold?"""
    want, held = _wanted(spark, folder)
    return chunking.covered_by_one(want, held)


def chunk_scores(spark, folder):
    """Windows ranked by how near the middle of their clauses' ids is to the case's, scored by the clauses they bring."""
    want, held = _wanted(spark, folder)
    near = want.withColumnRenamed("clause", "near").join(held.withColumnRenamed("clause", "near").select("near", "unit"), "near").select("case_id", "unit").distinct()
    middle = held.groupBy("unit").agg((F.sum("clause") / F.count(F.lit(1))).alias("m"))
    scored = near.join(middle, "unit").select("case_id", "unit", F.round(1.0 / (1.0 + F.abs(F.col("m") - F.col("case_id"))), 9).alias("score"))
    ranking = scored.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "unit")))
    cases = want.select("case_id").distinct()
    names = ["recall_at_1", "recall_at_3", "recall_at_5", "recall_at_budget", "precision", "recall"]
    return base._round(chunking.score_units(ranking, held, want, cases, 3, 0.01), *names)


QUERIES = {f.__name__: f for f in (abstention_grid, grid_precheck, adoption_directions, direction_counts, conflict_lift, hybrid_fusion, strategy_ladder, clause_coverage, chunk_scores)}

# --- SQL twins -------------------------------------------------------------------------------------

_C = base._H + "," + base._LABELS + ", cs AS (SELECT case_id, n_relevant, case_label = 9 AS abstain, case_label = 7 AS pair FROM cases)"
_GRID = _C + f""",
{base._STATS}, sm AS (SELECT c.case_id, any_value(n_relevant) AS n, any_value(abstain) AS abstain, any_value(pair) AS pair, count(*) FILTER (score >= {base.CUT}) AS accepted, count(*) FILTER (score >= {base.CUT} AND relevant) AS good FROM cs c LEFT JOIN lab USING (case_id) GROUP BY c.case_id),
lg AS ({' UNION ALL '.join(f"SELECT sm.*, '{s}' AS statistic, {s} AS value FROM sm LEFT JOIN stats USING (case_id)" for s in STATISTICS)}),
st AS (SELECT *, CASE WHEN fired THEN 0 ELSE accepted END AS acc, CASE WHEN fired THEN 0 ELSE good END AS gd FROM (SELECT lg.*, tau, coalesce(value < tau, false) AS fired FROM lg, (SELECT unnest([NULL, {', '.join(map(str, TAUS))}]::DOUBLE[]) AS tau))),
pt AS (SELECT statistic, tau, avg(CASE WHEN acc > 0 THEN gd / acc::DOUBLE WHEN n = 0 THEN 1.0 END) AS p, avg(gd / nullif(n, 0)::DOUBLE) AS r, count(*) FILTER (n > 0 AND gd = 0) AS fv, count(*) FILTER (pair AND gd < 2) AS pl, coalesce(sum(acc) FILTER (abstain), 0)::BIGINT AS aa, min(value - tau) FILTER (n > 0) AS am, max(value - tau) FILTER (abstain) AS bm FROM st GROUP BY statistic, tau),
ff AS (SELECT *, CASE WHEN p IS NULL OR r IS NULL THEN NULL WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM pt),
dg AS (SELECT a.*, (b.p IS NOT NULL AND (a.p IS NULL OR a.p < b.p - 1e-9))::INT + (b.r IS NOT NULL AND (a.r IS NULL OR a.r < b.r - 1e-9))::INT + (b.f IS NOT NULL AND (a.f IS NULL OR a.f < b.f - 1e-9))::INT AS d FROM ff a JOIN ff b ON a.statistic = b.statistic AND b.tau IS NULL AND a.tau IS NOT NULL)
"""
_DIR = _C + f""",
g AS (SELECT f AS floor, r AS ratio, m AS margin FROM (SELECT unnest({FLOORS}::DOUBLE[]) AS f), (SELECT unnest({RATIOS}::DOUBLE[]) AS r), (SELECT unnest({MARGINS}::DOUBLE[]) AS m)),
tp AS (SELECT c.case_id, any_value(n_relevant) AS n, any_value(abstain) AS abstain, any_value(pair) AS pair, max(score) AS best, list(score ORDER BY score DESC) FILTER (relevant) AS rs FROM cs c LEFT JOIN lab USING (case_id) GROUP BY c.case_id),
x AS (SELECT g.*, n, abstain, pair, coalesce(rs[1] >= floor AND rs[1] >= ratio * best AND best - rs[1] <= margin, false) AS a1, coalesce(rs[2] >= floor AND rs[2] >= ratio * best AND best - rs[2] <= margin, false) AS a2, coalesce(best >= floor AND best >= ratio * best AND 0 <= margin, false) AS ab FROM tp, g),
dr AS (SELECT floor, ratio, margin, coalesce(bool_and(a1) FILTER (n > 0), true) AS preserved, coalesce(bool_and(NOT ab) FILTER (abstain), true) AS abstains, coalesce(bool_and(a2) FILTER (pair), true) AS pairs FROM x GROUP BY ALL)"""
_CH = "(SELECT DISTINCT ON (id) * FROM (SELECT * FROM policy_chunks ORDER BY id, loaded_at))"


def _vector(name: str, dims: str = "") -> str:
    v = f"list_transform({{}}.embedding, lambda x: x::DOUBLE){dims}"
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(similarity, 12) DESC, evidence_id) AS rank FROM (
  SELECT q.id AS case_id, c.id AS evidence_id, list_cosine_similarity({v.format('q')}, {v.format('c')}) AS similarity FROM ok q, ok c WHERE q.id % 20 = 0 AND q.id <> c.id)) WHERE rank <= {WIDE})"""


_LEGS = f"""WITH ok AS (SELECT * FROM {_CH} WHERE len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR abs(x) >= 1e30)) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
{_vector('v')}, {_vector('w', '[1:32]')},
q AS (SELECT id AS case_id, {base._grams('article_title')} AS terms FROM ok WHERE id % 20 = 0 AND article_title IS NOT NULL), d AS (SELECT id AS evidence_id, {base._grams("concat_ws(chr(10), article_title, content)")} AS terms FROM ok),
qt AS (SELECT DISTINCT case_id, unnest(terms) AS term FROM q), dt AS (SELECT evidence_id, len(terms) AS dl, unnest(terms) AS term FROM d), tf AS (SELECT evidence_id, dl, term, count(*) AS tf FROM dt GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), bs AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM d),
sc AS (SELECT case_id, evidence_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM qt JOIN tf USING (term) JOIN df USING (term), bs GROUP BY ALL),
bm AS (SELECT * FROM (SELECT case_id, evidence_id, row_number() OVER (PARTITION BY case_id ORDER BY coalesce(score, 0) DESC, evidence_id) AS rank FROM (SELECT case_id, evidence_id FROM q, d) LEFT JOIN sc USING (case_id, evidence_id)) WHERE rank <= {WIDE})"""


def _fuse(name: str, leg: str) -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(rrf, 12) DESC, evidence_id) AS rank FROM (SELECT case_id, evidence_id, coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0) AS rrf FROM {leg} a FULL JOIN bm b USING (case_id, evidence_id)))"


def _recall(name: str, ranking: str) -> str:
    return f"""SELECT '{name}' AS strategy, round(avg(t1 / nullif(n, 0)::DOUBLE), 6) AS recall_at_1, round(avg(t3 / nullif(n, 0)::DOUBLE), 6) AS recall_at_3, round(avg(t5 / nullif(n, 0)::DOUBLE), 6) AS recall_at_5, round(avg(CASE WHEN t > 0 THEN t5 / t::DOUBLE WHEN n = 0 THEN 1.0 END), 6) AS precision, count(CASE WHEN t > 0 OR n = 0 THEN 1 END) AS cases
  FROM (SELECT c.case_id, any_value(n) AS n, count(r.evidence_id) AS t, count(*) FILTER (rel AND rank <= 1) AS t1, count(*) FILTER (rel AND rank <= 3) AS t3, count(*) FILTER (rel) AS t5 FROM cz c LEFT JOIN (SELECT x.case_id, x.evidence_id, x.rank, coalesce(a.document_slug = b.document_slug, false) AS rel FROM {ranking} x JOIN ok a ON a.id = x.case_id JOIN ok b ON b.id = x.evidence_id WHERE x.rank <= {base.K}) r USING (case_id) GROUP BY c.case_id)"""


_W = base._UNITS + """,
hd AS (SELECT h.slug || '#' || h.unit AS unit, h.clause, sp.position FROM held h JOIN sp USING (slug, clause)),
wt AS (SELECT DISTINCT a.clause AS case_id, b.clause FROM sp a JOIN sp b ON a.slug = b.slug AND abs(a.position - b.position) <= 1 WHERE a.clause % 20 = 0)"""
ORACLE = {
    "abstention_grid": _GRID + " SELECT statistic, tau, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, fv AS floor_violations, pl AS pairs_lost, aa AS abstain_accepted, d AS degraded, round(am, 6) AS accept_margin, round(bm, 6) AS abstain_margin, CASE WHEN fv > 0 THEN 'case_floor' WHEN pl > 0 THEN 'conflict_pair' WHEN aa > 0 THEN 'abstention' WHEN d > 0 THEN 'degraded' END AS eliminated_by FROM dg",
    "grid_precheck": _C + " SELECT * FROM (SELECT 'contradictory' AS reason, count(*) AS n FROM cs WHERE abstain AND n_relevant > 0 UNION ALL SELECT 'thin', count(*) FROM cs WHERE pair AND n_relevant < 2 UNION ALL SELECT 'missing', (count(*) FILTER (abstain) = 0)::INT + (count(*) FILTER (pair) = 0)::INT FROM cs) WHERE n > 0",
    "adoption_directions": _DIR + " SELECT * FROM dr",
    "direction_counts": _DIR + "".join(f" {'UNION ALL ' if i else ''}SELECT '{'+'.join(s)}' AS aims, count(*) FILTER ({' AND '.join(s)}) AS n FROM dr" for i, s in enumerate([("preserved",), ("abstains",), ("pairs",), ("preserved", "abstains"), ("preserved", "pairs"), ("abstains", "pairs"), ("preserved", "abstains", "pairs")])),
    "conflict_lift": f"WITH {base._leg('hits', WIDE)}, ac AS (SELECT case_id, evidence_id FROM hits WHERE rank <= {base.K} AND similarity >= {base.CUT}) SELECT a.case_id, a.evidence_id, h.evidence_id AS partner, h.rank AS partner_rank, round(h.similarity, 6) AS partner_score FROM ac a JOIN hits h ON h.case_id = a.case_id AND h.evidence_id = xor(a.evidence_id, 1) WHERE NOT EXISTS (SELECT 1 FROM ac b WHERE b.case_id = a.case_id AND b.evidence_id = h.evidence_id)",
    "hybrid_fusion": _LEGS + ", " + _fuse("fs", "v") + f" SELECT case_id, evidence_id, rank, round(rrf, 6) AS rrf FROM fs WHERE rank <= {POOL}",
    "strategy_ladder": _LEGS + f""", mg AS (SELECT case_id, evidence_id, row_number() OVER (PARTITION BY case_id ORDER BY round(s, 12) DESC, evidence_id) AS rank FROM (SELECT case_id, evidence_id, max(similarity) AS s FROM (SELECT * FROM v UNION ALL SELECT * FROM w) GROUP BY ALL)),
      m2 AS (SELECT * FROM mg WHERE rank <= {WIDE}), {_fuse('fs', 'm2')}, rr AS (SELECT case_id, evidence_id, CASE WHEN rank <= {POOL} THEN row_number() OVER (PARTITION BY case_id, rank <= {POOL} ORDER BY evidence_id DESC) ELSE rank END AS rank FROM fs),
      cz AS (SELECT DISTINCT v.case_id, (SELECT count(*) - 1 FROM {_CH} x WHERE x.document_slug = o.document_slug) AS n FROM v JOIN ok o ON o.id = v.case_id)
      """ + " UNION ALL ".join(_recall(n, r) for n, r in (("vector", "v"), ("vector_rewrite", "mg"), ("vector_rewrite_hybrid", "fs"), ("vector_rewrite_hybrid_rerank", "rr"))),
    "clause_coverage": _W + """, nd AS (SELECT case_id, count(*) AS need FROM wt GROUP BY 1), sz AS (SELECT unit, count(DISTINCT clause) AS size FROM hd GROUP BY 1), hv AS (SELECT case_id, unit, count(DISTINCT clause) AS have FROM wt JOIN hd USING (clause) GROUP BY ALL)
      SELECT nd.case_id, e IS NOT NULL AS covered, e AS extra FROM nd LEFT JOIN (SELECT case_id, min(size - need) AS e FROM hv JOIN nd USING (case_id) JOIN sz USING (unit) WHERE have = need GROUP BY 1) USING (case_id)""",
    "chunk_scores": _W + """, nr AS (SELECT DISTINCT case_id, unit FROM wt JOIN hd USING (clause)), md AS (SELECT unit, sum(clause) / count(*)::DOUBLE AS m FROM hd GROUP BY 1),
      rk AS (SELECT case_id, unit, s, row_number() OVER (PARTITION BY case_id ORDER BY s DESC, unit) AS rank FROM (SELECT case_id, unit, round(1.0 / (1.0 + abs(m - case_id)), 9) AS s FROM nr JOIN md USING (unit))),
      fi AS (SELECT case_id, clause, min(struct_pack(rank := rank, position := position)) AS att, min(rank) FILTER (rank <= 3 AND s >= 0.01) AS taken FROM rk JOIN hd USING (unit) GROUP BY ALL),
      mk AS (SELECT fi.*, row_number() OVER (PARTITION BY fi.case_id ORDER BY att, fi.clause) AS place, wt.clause IS NOT NULL AS rel FROM fi LEFT JOIN wt USING (case_id, clause)),
      pr AS (SELECT case_id, count(*) FILTER (rel AND att.rank <= 1) AS t1, count(*) FILTER (rel AND att.rank <= 3) AS t3, count(*) FILTER (rel AND att.rank <= 5) AS t5, count(*) FILTER (rel AND place <= 3) AS b, count(taken) AS a, count(taken) FILTER (rel) AS g FROM mk GROUP BY 1),
      un AS (SELECT case_id, count(*) AS u FROM rk WHERE rank <= 3 AND s >= 0.01 GROUP BY 1), nd AS (SELECT case_id, count(*) AS need FROM wt GROUP BY 1)
      SELECT nd.case_id, round(coalesce(t1, 0) / need::DOUBLE, 6) AS recall_at_1, round(coalesce(t3, 0) / need::DOUBLE, 6) AS recall_at_3, round(coalesce(t5, 0) / need::DOUBLE, 6) AS recall_at_5, round(coalesce(b, 0) / need::DOUBLE, 6) AS recall_at_budget, CASE WHEN coalesce(a, 0) > 0 THEN round(g / a::DOUBLE, 6) END AS precision, round(coalesce(g, 0) / need::DOUBLE, 6) AS recall, coalesce(u, 0) AS accepted_units, coalesce(a, 0) AS accepted_clauses
      FROM nd LEFT JOIN pr USING (case_id) LEFT JOIN un USING (case_id)""",
}
