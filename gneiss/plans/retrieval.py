"""Queries of ranking, abstention, metrics and chunking.

The query set of a search is every row whose id is divisible by 20, against all rows. Relevant to a
vector is what has its label; labels 8 and 9 stand for the cases that should abstain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.text import strip_white
from gneiss.operators import chunking, metrics, retrieval, skew
from gneiss.session import cut_lineage
from gneiss.tables import records_of, table

K, CUT, TAU = 5, 0.2, 0.08
CUTS = metrics.axis("0.00", "0.60", "0.05")
FLOORS, RATIOS, MARGINS = [0.1, 0.2, 0.3], [0.5, 0.7, 0.9], [0.05, 0.1, 0.2]
POOL = 10


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, folder, "embeddings")
    q = e.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("case_id"), F.col("embedding").alias("vector"))
    return q, e.select(F.col("vec_id").alias("evidence_id"), F.col("embedding").alias("vector"))


def _hits(spark: SparkSession, folder: str, k: int = K, dimensions: int | None = None) -> DataFrame:
    q, c = _vectors(spark, folder)
    return retrieval.exact_topk(q, c, k, dimensions=dimensions, exclude_same=True)


def _labelled(spark: SparkSession, folder: str, k: int = K) -> tuple[DataFrame, DataFrame]:
    """Hits with score and relevance, and the cases with their number of relevant rows."""
    e = table(spark, folder, "embeddings").select("vec_id", "label")
    case = e.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("case_id"), F.col("label").alias("case_label"))
    sizes = e.groupBy(F.col("label").alias("case_label")).agg((F.count(F.lit(1)) - 1).alias("n"))
    # A case of label 9 has nothing relevant: the null-aware denominators are part of the query.
    cases = case.join(F.broadcast(sizes), "case_label").select("case_id", "case_label", F.when(F.col("case_label") == 9, 0).otherwise(F.col("n")).alias("n_relevant"))
    hits = _hits(spark, folder, k).join(case, "case_id").join(e.select(F.col("vec_id").alias("evidence_id"), "label"), "evidence_id")
    return hits.select("case_id", "evidence_id", "rank", F.col("similarity").alias("score"), ((F.col("label") == F.col("case_label")) & (F.col("case_label") != 9)).alias("relevant"), "case_label"), cases


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def vector_topk(spark, folder):
    """The 5 most similar vectors of every query, exactly."""
    return _round(_hits(spark, folder), "similarity").select("case_id", "evidence_id", "rank", "similarity")


def vector_topk_cutoff(spark, folder):
    """Those of at least the cutoff."""
    return _round(retrieval.adopted(_hits(spark, folder), "similarity", CUT), "similarity").select("case_id", "evidence_id", "rank", "similarity")


def abstention_statistics(spark, folder):
    """Five statistics of every query's first 5 scores."""
    names = ("spread", "deviation", "relative", "gap", "tail")
    return _round(retrieval.statistics(_hits(spark, folder), "similarity", K), *names).select("case_id", *names)


def abstention_gate(spark, folder):
    """What is adopted once queries of too small a spread abstain."""
    hits = cut_lineage(_hits(spark, folder))  # read twice: the gate and what passes it
    kept = retrieval.adopted(hits, "similarity", CUT, retrieval.statistics(hits, "similarity", K), "spread", TAU)
    return kept.select("case_id", "evidence_id", "rank")


def merge_max_ranking(spark, folder):
    """Two rankings of each query (all values, the first 32) merged by the better score."""
    return _round(retrieval.merge_max(_hits(spark, folder), _hits(spark, folder, dimensions=32)).filter(F.col("rank") <= K), "similarity").select("case_id", "evidence_id", "rank", "similarity")


def _fused(spark, folder):
    return cut_lineage(retrieval.fuse(_hits(spark, folder, 20), _hits(spark, folder, 20, dimensions=32)))


def rrf_fusion(spark, folder):
    """Two vector rankings fused by reciprocal ranks (``hybrid_fusion`` fuses one with BM25)."""
    return _round(_fused(spark, folder).filter(F.col("rank") <= POOL), "rrf").select("case_id", "evidence_id", "rank", "rrf")


def rerank_tail(spark, folder):
    """The pool of the fused ranking in another order (by id, falling), the tail after it."""
    fused = _fused(spark, folder)
    order = fused.filter(F.col("rank") <= POOL).select("case_id", "evidence_id", F.expr("row_number() over (partition by case_id order by evidence_id desc)").alias("position"))
    return retrieval.rerank(fused, order, POOL)


def bm25_rank(spark, folder):
    """The 5 best clauses by BM25 over character bigrams for every golden question of a number divisible by 20."""
    g = records_of(spark, folder, "golden_set", ["id"], ["content"])
    q = g.filter(F.regexp_extract("id", r"(\d+)", 1).cast("bigint") % 20 == 0).select(F.col("id").alias("case_id"), F.col("content").alias("text"))
    p = records_of(spark, folder, "policy_chunks", ["id"], ["article_title", "content"])
    c = p.select(F.col("id").alias("evidence_id"), F.concat_ws("\n", "article_title", "content").alias("text"))
    return _round(retrieval.bm25(q, c, K), "score").select("case_id", "evidence_id", "rank", "score")


def retrieval_metrics(spark, folder):
    """Macro recall, precision and accepted counts, with the number of cases that have a value."""
    hits, cases = _labelled(spark, folder)
    names = ["recall_at_1", "recall_at_3", "recall_at_5", "precision", "recall"]
    return _round(metrics.macro(metrics.case_metrics(hits, cases, CUT), names), *names)


def case_scores(spark, folder):
    """The measures of every case."""
    hits, cases = _labelled(spark, folder)
    return _round(metrics.case_metrics(hits, cases, CUT), "recall_at_1", "recall_at_3", "recall_at_5", "precision", "recall")


def cutoff_sweep(spark, folder):
    """Precision, recall and F1 at every cutoff."""
    hits, cases = _labelled(spark, folder)
    return _round(metrics.sweep(hits, cases, CUTS), "precision", "recall", "f1").select("cut", "precision", "recall", "f1", "n_precision", "n_recall")


def best_cutoff(spark, folder):
    """The cutoff of the best F1."""
    hits, cases = _labelled(spark, folder)
    return _round(metrics.best_cut(metrics.sweep(hits, cases, CUTS)), "precision", "recall", "f1")


def separation_margin(spark, folder):
    """How well the spread parts cases that should abstain from the others."""
    hits, cases = _labelled(spark, folder)
    stats = retrieval.statistics(hits.withColumnRenamed("score", "similarity"), "similarity", K).join(cases.select("case_id", "case_label"), "case_id")
    return _round(metrics.separation(stats, "spread", F.col("case_label") >= 8), "abstain_max", "answer_min", "threshold", "margin")


def adoption_grid(spark, folder):
    """What each setting of floor, ratio and margin adopts."""
    hits = cut_lineage(_labelled(spark, folder)[0])
    return metrics.adoption_grid(hits, hits, FLOORS, RATIOS, MARGINS)


def floor_bounds(spark, folder):
    """Between which values a floor must lie."""
    hits, _ = _labelled(spark, folder)
    return _round(metrics.floor_bounds(hits, F.col("case_label") >= 8), "ceiling", "threshold")


# --- chunking --------------------------------------------------------------------------------------


def _clauses(spark, folder):
    p = records_of(spark, folder, "policy_chunks", ["id"], ["document_slug", "article", "content"])
    return p.filter(F.length("content") > 0).select(F.col("document_slug").alias("slug"), F.col("id").alias("clause"), F.length("content").alias("len"))


def _spans(spark, folder):
    return chunking.spans(_clauses(spark, folder), "slug", "clause", "clause", "len")


def _units(spark, folder):
    docs = _spans(spark, folder).groupBy("slug").agg(F.max("end_pos").alias("len"))
    return chunking.fixed_windows(docs, "slug", "len", 240, 60).withColumnRenamed("window_no", "unit")


def fixed_chunks(spark, folder):
    """Windows of 240 characters that share 60, over every document."""
    d = table(spark, folder, "documents").select("doc_id", F.length(strip_white(F.col("text"))).alias("len"))
    return chunking.fixed_windows(d, "doc_id", "len", 240, 60)


def clause_spans(spark, folder):
    """Where the clauses of each policy lie when they are strung together."""
    return _spans(spark, folder)


def unit_clause_overlap(spark, folder):
    """Clauses of which a window holds at least half."""
    return _round(chunking.overlaps(_units(spark, folder), _spans(spark, folder), "slug", 0.5), "ratio")


def chunk_corpus_stats(spark, folder):
    """Units, their sizes, and clauses that no unit holds."""
    units, sp = _units(spark, folder), _spans(spark, folder)
    return _round(chunking.corpus_statistics(units, chunking.overlaps(units, sp, "slug", 0.5), sp, "slug"), "mean_length", "mean_clauses")


def clause_adjacency(spark, folder):
    """Do the policy clauses that an inquiry cites lie side by side in one policy?"""
    p = records_of(spark, folder, "policy_chunks", ["id"], ["evidence_id", "document_slug"])
    pos = _spans(spark, folder).select("slug", "clause", "position")
    cited = records_of(spark, folder, "inquiries", ["id"], ["claims"]).select(F.col("id").alias("case_id"), F.explode(F.flatten(F.transform("claims", lambda c: F.coalesce(c["citation_ids"], F.expr("cast(array() as array<string>)"))))).alias("evidence_id")).distinct()
    # A clause may be cited by a large part of the inquiries.
    wanted = skew.lookup(cited, p.groupBy(F.col("evidence_id").alias("known")).agg(F.min(F.struct("id", "document_slug")).alias("r")), "evidence_id", "known", "inner").select("case_id", F.col("r.document_slug").alias("slug"), F.col("r.id").alias("clause"))
    return chunking.adjacent(wanted, pos, "slug")


QUERIES = {f.__name__: f for f in (vector_topk, vector_topk_cutoff, abstention_statistics, abstention_gate, merge_max_ranking, rrf_fusion, rerank_tail, bm25_rank, retrieval_metrics, case_scores, cutoff_sweep, best_cutoff, separation_margin, adoption_grid, floor_bounds, fixed_chunks, clause_spans, unit_clause_overlap, chunk_corpus_stats, clause_adjacency)}

# --- SQL twins -------------------------------------------------------------------------------------


def _leg(name: str, k: int, dims: int | None = None) -> str:
    v = f"list_transform({{}}.embedding, lambda x: x::DOUBLE){f'[1:{dims}]' if dims else ''}"
    return f"""
{name} AS (
  SELECT case_id, evidence_id, similarity, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(similarity, 12) DESC, evidence_id) AS rank FROM (
      SELECT q.vec_id AS case_id, c.vec_id AS evidence_id, list_cosine_similarity({v.format('q')}, {v.format('c')}) AS similarity
      FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)) WHERE rank <= {k})"""


_STATS = """
stats AS (
  SELECT case_id, CASE WHEN n >= 2 THEN top - low END AS spread, CASE WHEN n >= 2 THEN sd END AS deviation, CASE WHEN n >= 2 AND top > 0 THEN (top - low) / top END AS relative,
    CASE WHEN n >= 2 THEN top - second END AS gap, CASE WHEN n >= 2 AND top > 0 THEN low / top END AS tail
  FROM (SELECT case_id, count(*) AS n, max(similarity) FILTER (rank = 1) AS top, arg_max(similarity, rank) AS low, stddev_pop(similarity) AS sd, max(similarity) FILTER (rank = 2) AS second FROM hits GROUP BY case_id))"""
_LABELS = """
lab AS (
  SELECT h.case_id, h.evidence_id, h.rank, h.similarity AS score, q.label AS case_label, (c.label = q.label AND q.label <> 9) AS relevant
  FROM hits h JOIN embeddings q ON q.vec_id = h.case_id JOIN embeddings c ON c.vec_id = h.evidence_id),
cases AS (
  SELECT vec_id AS case_id, label AS case_label, CASE WHEN label = 9 THEN 0 ELSE (SELECT count(*) - 1 FROM embeddings x WHERE x.label = e.label) END AS n_relevant FROM embeddings e WHERE vec_id % 20 = 0)"""


def _scores(cut: str) -> str:
    return f"""
    SELECT c.case_id, any_value(n_relevant) AS n_relevant, count(*) FILTER (relevant AND rank <= 1) AS t1, count(*) FILTER (relevant AND rank <= 3) AS t3, count(*) FILTER (relevant AND rank <= 5) AS t5,
      count(*) FILTER (score >= {cut}) AS accepted, count(*) FILTER (score >= {cut} AND relevant) AS good
    FROM cases c LEFT JOIN lab USING (case_id) GROUP BY c.case_id"""


_CASE = f"""
per AS (
  SELECT case_id, t1 / nullif(n_relevant, 0)::DOUBLE AS recall_at_1, t3 / nullif(n_relevant, 0)::DOUBLE AS recall_at_3, t5 / nullif(n_relevant, 0)::DOUBLE AS recall_at_5,
    CASE WHEN accepted > 0 THEN good / accepted::DOUBLE WHEN n_relevant = 0 THEN 1.0 END AS precision, good / nullif(n_relevant, 0)::DOUBLE AS recall, accepted
  FROM ({_scores(str(CUT))}))"""
_SWEEP = f"""
swept AS (
  SELECT cut, avg(p) AS precision, avg(r) AS recall, count(p) AS n_precision, count(r) AS n_recall,
    CASE WHEN avg(p) IS NULL OR avg(r) IS NULL THEN NULL WHEN avg(p) + avg(r) = 0 THEN 0 ELSE 2 * avg(p) * avg(r) / (avg(p) + avg(r)) END AS f1
  FROM (
    SELECT cut, CASE WHEN accepted > 0 THEN good / accepted::DOUBLE WHEN n_relevant = 0 THEN 1.0 END AS p, good / nullif(n_relevant, 0)::DOUBLE AS r
    FROM (SELECT a.cut, c.case_id, any_value(n_relevant) AS n_relevant, count(*) FILTER (score >= a.cut) AS accepted, count(*) FILTER (score >= a.cut AND relevant) AS good
          FROM cases c, (SELECT unnest({CUTS}::DOUBLE[]) AS cut) a LEFT JOIN lab ON lab.case_id = c.case_id GROUP BY a.cut, c.case_id))
  GROUP BY cut)"""
_FUSED = f"""
WITH {_leg('a', 20)}, {_leg('b', 20, 32)},
fused AS (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(rrf, 12) DESC, evidence_id) AS rank FROM (
    SELECT case_id, evidence_id, coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0) AS rrf FROM a FULL JOIN b USING (case_id, evidence_id)))"""
_CLAUSES = """
WITH clauses AS (SELECT document_slug AS slug, id AS clause, length(content) AS len FROM (SELECT DISTINCT ON (id) * FROM (SELECT * FROM policy_chunks ORDER BY id, loaded_at)) WHERE length(content) > 0),
spans AS (
  SELECT slug, clause, row_number() OVER w - 1 AS position, (coalesce(sum(len + 1) OVER (PARTITION BY slug ORDER BY clause ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start_pos, len
  FROM clauses WINDOW w AS (PARTITION BY slug ORDER BY clause)),
sp AS (SELECT slug, clause, position, start_pos, start_pos + len AS end_pos FROM spans)"""


def _windows(source: str, key: str) -> str:
    return f"""SELECT {key}, i AS window_no, i * 180 AS start_pos, least(i * 180 + 240, len) AS end_pos FROM (SELECT {key}, len, unnest(range(0, CASE WHEN len <= 240 THEN 1 ELSE 1 + ceil((len - 240) / 180.0)::BIGINT END)) AS i FROM {source} WHERE len > 0)"""


_UNITS = _CLAUSES + f""",
docs AS (SELECT slug, max(end_pos) AS len FROM sp GROUP BY slug),
units AS (SELECT slug, window_no AS unit, start_pos, end_pos FROM ({_windows('docs', 'slug')})),
held AS (
  SELECT slug, unit, clause, shared, shared / (ce - cs)::DOUBLE AS ratio FROM (
    SELECT u.slug, unit, clause, least(u.end_pos, s.end_pos) - greatest(u.start_pos, s.start_pos) AS shared, s.start_pos AS cs, s.end_pos AS ce FROM units u JOIN sp s USING (slug))
  WHERE shared > 0 AND shared / (ce - cs)::DOUBLE >= 0.5 - 1e-9)"""


def _grams(c: str) -> str:
    s = f"regexp_replace(lower(replace(replace({c}, 'ß', 'ss'), 'ẞ', 'ss')), '[^0-9a-z가-힣]', '', 'g')"
    return f"(CASE WHEN coalesce({s}, '') = '' THEN [] WHEN length({s}) < 2 THEN [{s}] ELSE list_transform(range(1, length({s})), lambda i: substring({s}, i, 2)) END)"


_H = f"WITH {_leg('hits', K)}"
ORACLE = {
    "vector_topk": _H + " SELECT case_id, evidence_id, rank, round(similarity, 6) AS similarity FROM hits",
    "vector_topk_cutoff": _H + f" SELECT case_id, evidence_id, rank, round(similarity, 6) AS similarity FROM hits WHERE similarity >= {CUT}",
    "abstention_statistics": _H + "," + _STATS + " SELECT case_id, round(spread, 6) AS spread, round(deviation, 6) AS deviation, round(relative, 6) AS relative, round(gap, 6) AS gap, round(tail, 6) AS tail FROM stats",
    "abstention_gate": _H + "," + _STATS + f" SELECT case_id, evidence_id, rank FROM hits JOIN stats USING (case_id) WHERE similarity >= {CUT} AND (spread IS NULL OR spread >= {TAU})",
    "merge_max_ranking": f"WITH {_leg('a', K)}, {_leg('b', K, 32)} SELECT * FROM (SELECT case_id, evidence_id, row_number() OVER (PARTITION BY case_id ORDER BY round(s, 12) DESC, evidence_id) AS rank, round(s, 6) AS similarity FROM (SELECT case_id, evidence_id, max(similarity) AS s FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)) WHERE rank <= {K}",
    "rrf_fusion": _FUSED + f" SELECT case_id, evidence_id, rank, round(rrf, 6) AS rrf FROM fused WHERE rank <= {POOL}",
    "rerank_tail": _FUSED + f" SELECT case_id, evidence_id, rank, CASE WHEN rank <= {POOL} THEN row_number() OVER (PARTITION BY case_id, rank <= {POOL} ORDER BY evidence_id DESC) ELSE rank END AS final_rank FROM fused",
    "bm25_rank": f"""
WITH q AS (SELECT DISTINCT id AS case_id, {_grams('content')} AS terms FROM golden_set WHERE regexp_extract(id, '([0-9]+)', 1)::BIGINT % 20 = 0),
d AS (SELECT evidence_id, {_grams('text')} AS terms FROM (SELECT DISTINCT ON (id) id AS evidence_id, concat_ws(chr(10), article_title, content) AS text FROM (SELECT * FROM policy_chunks ORDER BY id, loaded_at))),
qt AS (SELECT DISTINCT case_id, unnest(terms) AS term FROM q), dt AS (SELECT evidence_id, len(terms) AS dl, unnest(terms) AS term FROM d),
tf AS (SELECT evidence_id, dl, term, count(*) AS tf FROM dt GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
st AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM d),
s AS (SELECT case_id, evidence_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM qt JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL),
every AS (SELECT case_id, evidence_id, coalesce(score, 0) AS score FROM (SELECT case_id, evidence_id FROM q, d) LEFT JOIN s USING (case_id, evidence_id))
SELECT * FROM (SELECT case_id, evidence_id, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, evidence_id) AS rank, round(score, 6) AS score FROM every) WHERE rank <= {K}""",
    "case_scores": _H + "," + _LABELS + "," + _CASE + " SELECT case_id, round(recall_at_1, 6) AS recall_at_1, round(recall_at_3, 6) AS recall_at_3, round(recall_at_5, 6) AS recall_at_5, round(precision, 6) AS precision, round(recall, 6) AS recall, accepted FROM per",
    "retrieval_metrics": _H + "," + _LABELS + "," + _CASE + " SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}, count({c}) AS n_{c}" for c in ("recall_at_1", "recall_at_3", "recall_at_5", "precision", "recall")) + " FROM per",
    "cutoff_sweep": _H + "," + _LABELS + "," + _SWEEP + " SELECT cut, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, n_precision, n_recall FROM swept",
    "best_cutoff": _H + "," + _LABELS + "," + _SWEEP + " SELECT cut, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM swept WHERE f1 IS NOT NULL ORDER BY round(swept.f1, 9) DESC, round(swept.precision, 9) DESC, round(swept.recall, 9) DESC, cut DESC LIMIT 1",
    "separation_margin": _H + "," + _STATS + "," + """
s AS (SELECT stats.case_id, spread, label >= 8 AS abst FROM stats JOIN embeddings ON vec_id = stats.case_id WHERE spread IS NOT NULL),
h AS (SELECT spread, case_id FROM s WHERE abst ORDER BY spread DESC, case_id LIMIT 1), l AS (SELECT spread, case_id FROM s WHERE NOT abst ORDER BY spread, case_id LIMIT 1)
SELECT 'spread' AS statistic, round(h.spread, 6) AS abstain_max, h.case_id AS abstain_case, round(l.spread, 6) AS answer_min, l.case_id AS answer_case, round((h.spread + l.spread) / 2, 6) AS threshold, round(l.spread - h.spread, 6) AS margin FROM h, l""",
    "adoption_grid": _H + "," + _LABELS + f""",
g AS (SELECT f AS floor, r AS ratio, m AS margin FROM (SELECT unnest({FLOORS}::DOUBLE[]) AS f), (SELECT unnest({RATIOS}::DOUBLE[]) AS r), (SELECT unnest({MARGINS}::DOUBLE[]) AS m)),
b AS (SELECT *, max(score) OVER (PARTITION BY case_id) AS best FROM lab)
SELECT floor, ratio, margin, count(DISTINCT case_id) AS kept_cases, count(*) FILTER (relevant) AS kept_relevant, count(*) FILTER (NOT relevant) AS kept_other
FROM g LEFT JOIN b ON score >= floor AND score >= best * ratio AND score >= best - margin GROUP BY ALL""",
    "floor_bounds": _H + "," + _LABELS + " SELECT round(min(CASE WHEN NOT a THEN br END), 6) AS ceiling, round(max(CASE WHEN a THEN b END), 6) AS threshold FROM (SELECT case_id, any_value(case_label >= 8) AS a, max(CASE WHEN relevant THEN score END) AS br, max(score) AS b FROM lab GROUP BY case_id)",
    "fixed_chunks": "WITH d AS (SELECT doc_id, length(regexp_replace(text, '^[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+|[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+$', '', 'g')) AS len FROM documents) " + _windows("d", "doc_id"),
    "clause_spans": _CLAUSES + " SELECT * FROM sp",
    "unit_clause_overlap": _UNITS + " SELECT slug, unit, clause, shared, round(ratio, 6) AS ratio FROM held",
    "chunk_corpus_stats": _UNITS + """,
n AS (SELECT u.slug, u.unit, any_value(u.end_pos - u.start_pos) AS len, count(h.clause) AS n FROM units u LEFT JOIN held h USING (slug, unit) GROUP BY u.slug, u.unit)
SELECT count(*) AS units, sum(len)::BIGINT AS characters, round(avg(len), 6) AS mean_length, round(avg(n), 6) AS mean_clauses, max(n) AS most_clauses, (SELECT count(*) FROM sp WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.slug = sp.slug AND h.clause = sp.clause)) AS unreachable FROM n""",
    "clause_adjacency": _CLAUSES + """,
p AS (SELECT DISTINCT ON (evidence_id) id, evidence_id, document_slug AS slug FROM (SELECT * FROM (SELECT DISTINCT ON (id) * FROM (SELECT * FROM policy_chunks ORDER BY id, loaded_at)) ORDER BY evidence_id, id, document_slug)),
cited AS (SELECT DISTINCT case_id, unnest(c.citation_ids) AS evidence_id FROM (SELECT id AS case_id, unnest(claims) AS c FROM (SELECT DISTINCT ON (id) * FROM (SELECT * FROM inquiries ORDER BY id, loaded_at)))),
w AS (SELECT case_id, sp.slug, sp.position, sp.position - lag(sp.position) OVER (PARTITION BY case_id, sp.slug ORDER BY sp.position) AS step FROM cited JOIN p USING (evidence_id) JOIN sp ON sp.slug = p.slug AND sp.clause = p.id)
SELECT case_id, count(DISTINCT slug) = 1 AND coalesce(bool_and(step = 1), true) AS adjacent FROM w GROUP BY case_id""",
}
