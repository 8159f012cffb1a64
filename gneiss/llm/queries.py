"""The registered queries of problems 1, 3, 4 and 6 to 10, and their SQL twins where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.text import WHITE
from gneiss.llm import dedup, neighbours, packing, pairs, pii, sentences, splitting, tokenize
from gneiss.session import cut_lineage
from gneiss.tables import one_per_key, table

CAPACITY = 2048


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of clauses of which one is among the other's 5 most similar: (id_a, id_b)."""
    vectors = neighbours.usable_vectors(table(spark, folder, "policy_chunks"), "id", "embedding", "embedding_model", 96, "embedding_dimensions")
    return neighbours.pairs(neighbours.neighbours(vectors, 5))


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return one_per_key(table(spark, folder, "policy_chunks").select("id", "article", "content", "loaded_at"), ["id"], "loaded_at", ["loaded_at", "article", "content"])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Articles of every chunk that is cut: (id, article)."""
    return splitting.articles_of(table(spark, folder, "policy_chunks"), "id", "content", "article", "loaded_at")


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every chunk of more than 600 characters."""
    return splitting.split_rows(_chunks(spark, folder), "id", "content", "article")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Defective pairs among answered inquiries: (id, defect)."""
    answered = table(spark, folder, "inquiries").filter(F.col("status") == "answered")
    return pairs.pair_defects(answered, "id", "content", "answer", version="loaded_at")


def _pii(spark: SparkSession, folder: str) -> tuple[DataFrame, pii.Contexts, DataFrame]:
    """Inquiries, how candidates are found in them, and the entities of the order table."""
    src, orders = table(spark, folder, "inquiries").select("id", "content", "answer"), table(spark, folder, "shop_orders")
    return src, pii.Contexts(pii.family_names(orders, "customer_name")), pii.seed_table(orders, "customer_name", "customer_phone", "customer_email", "shipping_address")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in both texts of an inquiry: (id, field, pii_type, start_pos)."""
    src, contexts, seeds = _pii(spark, folder)
    return pii.found_rows(src, "id", ["content", "answer"], contexts, seeds).select("id", "field", "pii_type", "start_pos")


def p6_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Both texts of every inquiry with personal data replaced by its type: (id, content, answer)."""
    src, contexts, seeds = _pii(spark, folder)
    return pii.redacted(src, "id", ["content", "answer"], pii.finder(src, "id", ["content", "answer"], contexts, seeds)).distinct()


#: The tables of problem 7, and the column that tells when a row was loaded.
_MESSAGES = (("inquiries", "loaded_at"), ("golden_set", None))


def _messages(spark: SparkSession, folder: str, name: str, arrived: str | None) -> DataFrame:
    return table(spark, folder, name).select("id", "content", *([arrived] if arrived else []))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of a message within one table: (src, first_id, copy_id)."""
    found = None
    for name, arrived in _MESSAGES:
        src = _messages(spark, folder, name, arrived)
        keys = dedup.keyed(src, "id", "content", dedup.known_labels(src, "content"), arrived)
        part = dedup.copies(keys, dedup.merged_ledger(keys)).select(F.lit(name).alias("src"), "first_id", "copy_id")
        found = part if found is None else found.unionByName(part)
    return found


def p7_messages(spark: SparkSession, folder: str) -> DataFrame:
    """One record per message, the earliest, with its number of copies, each table by itself: (src, record_id, copies)."""
    parts = [dedup.representatives(_messages(spark, folder, n, a), "id", "content", a).select(F.lit(n).alias("src"), "record_id", "copies") for n, a in _MESSAGES]
    return parts[0].unionByName(parts[1])


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document: (doc_id, ids)."""
    return tokenize.encode(table(spark, folder, "documents"), "doc_id", "text")


def p8_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """How many bytes each document's ids stand for: (doc_id, n_bytes)."""
    return tokenize.byte_lengths(p8_ids(spark, folder), "doc_id")


def p9_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in containers of 2,048 tokens: (doc_id, piece_no, first_unit, n_units, container_id)."""
    sizes = tokenize.count_tokens(table(spark, folder, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p9_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of p9_packing are."""
    return packing.fill_report(p9_packing(spark, folder), CAPACITY)


def p9_rules(spark: SparkSession, folder: str) -> DataFrame:
    """What p9_packing must keep: (rule, n): the documents placed, and how often each rule is broken; ``loose`` is 1 if
    more than a hundredth of the room of more than two containers is left over."""
    sizes = cut_lineage(tokenize.count_tokens(table(spark, folder, "documents"), "doc_id", "text"))
    packed = cut_lineage(packing.pack(sizes, "doc_id", "n_tokens", CAPACITY))
    per = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_units").alias("placed"))
    n = lambda c: F.sum(F.coalesce(c, F.lit(True)).cast("int")).cast("bigint")
    by_document = sizes.join(per, "doc_id", "left").agg(F.count("pieces").alias("documents"), n(F.col("placed") != F.col("n_tokens")).alias("wrong_size"), n((F.col("pieces") > 1) & (F.col("n_tokens") <= CAPACITY)).alias("divided"))
    report = packing.fill_report(packed, CAPACITY).select((F.coalesce("fullest", F.lit(0)) > CAPACITY).cast("bigint").alias("over"), ((F.col("containers") > 2) & (F.coalesce("unused_share", F.lit(0.0)) > 0.01)).cast("bigint").alias("loose"))
    one = by_document.withColumn("one", F.lit(1)).join(F.broadcast(report.withColumn("one", F.lit(1))), "one")
    names = ("documents", "wrong_size", "divided", "over", "loose")
    return one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("rule"), F.coalesce(x, F.lit(0)).alias("n")) for x in names])).alias("x")).select("x.*")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Where the sentences of every document start: (doc_id, start_pos)."""
    return sentences.sentence_starts(table(spark, folder, "documents"), "doc_id", "text")


def p10_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences themselves, numbered within their document."""
    return sentences.sentence_starts(table(spark, folder, "documents"), "doc_id", "text", with_text=True)


def p10_letters(spark: SparkSession, folder: str) -> DataFrame:
    """The characters in each document's sentences that aren't white space: (doc_id, letters); no sentence loses any."""
    found = sentences.sentence_starts(table(spark, folder, "documents"), "doc_id", "text", with_text=True)
    return found.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("sentence", WHITE, ""))).cast("bigint").alias("letters"))


QUERIES = {
    "p1_found": p1_found,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p4_found": p4_found,
    "p6_found": p6_found,
    "p6_redacted": p6_redacted,
    "p7_found": p7_found,
    "p7_messages": p7_messages,
    "p8_ids": p8_ids,
    "p8_bytes": p8_bytes,
    "p9_packing": p9_packing,
    "p9_rules": p9_rules,
    "p9_fill": p9_fill,
    "p10_found": p10_found,
    "p10_sentences": p10_sentences,
    "p10_letters": p10_letters,
}

_BREAK = "[\\n\\r\\x0b\\x0c\\x{85}\\x{2028}\\x{2029}]"
_NO = "[0-9]+(?:[-–.][0-9]+)+"
_BRACKETED = f"^[ \\t　]*(?:#{{1,6}}[ \\t]*)?(?:제 ?({_NO}) ?조|第 ?({_NO}) ?[条條])[ \\t]*[(（\\[【][^()（）\\n\\r]*[)）\\]】]"
#: A title is the rest of the line, begins with neither a digit nor white space, and doesn't end like a sentence.
_TITLED = f"^[ \\t　]*(?:(?:#{{1,6}}[ \\t]*)?(?:[\\[【]({_NO})[\\]】][ \\t]*|({_NO})[.)][ \\t]+|(?:Article|Section|Clause|§)[ \\t]*({_NO})[.:)]?[ \\t]+)|#{{1,6}}[ \\t]*({_NO})[ \\t]+)[^\\s0-9].*$"
_LAST = "[.!?。！？…,;:、，][ \\t]*$"
_P3 = f"""
WITH c AS (SELECT DISTINCT ON (id) id, article, content FROM (SELECT * FROM policy_chunks ORDER BY id, loaded_at)),
l AS (SELECT id, article, line, no FROM (SELECT id, article, unnest(lines) AS line, generate_subscripts(lines, 1) AS no FROM (SELECT id, article, regexp_split_to_array(content, '{_BREAK}') AS lines FROM c WHERE length(content) > 600))),
h AS (
  SELECT id, no, replace(coalesce(nullif(regexp_extract(line, '{_BRACKETED}', 1), ''), nullif(regexp_extract(line, '{_BRACKETED}', 2), ''),
    CASE WHEN NOT regexp_matches(line, '{_LAST}') THEN coalesce(nullif(regexp_extract(line, '{_TITLED}', 1), ''), nullif(regexp_extract(line, '{_TITLED}', 2), ''), nullif(regexp_extract(line, '{_TITLED}', 3), ''), nullif(regexp_extract(line, '{_TITLED}', 4), '')) END), '–', '-') AS article FROM l)
SELECT DISTINCT id, article FROM (SELECT id, article FROM h WHERE article IS NOT NULL UNION ALL SELECT DISTINCT l.id, l.article FROM l WHERE l.no = 1 AND NOT EXISTS (SELECT 1 FROM h WHERE h.id = l.id AND h.no = 1 AND h.article IS NOT NULL))"""

#: The labels of the forms in the tables, longest first.
_LABELS = "message|model|order|item|type|문의유형|주문번호|내용|모델|상품"


def _messages_sql(name: str, arrived: str) -> str:
    """(src, id, came, key): each record's canonical text, written from the statement: letters and digits in lower case; of
    texts that begin with a label and hold another, the sorted fields."""
    plain = "regexp_replace(lower(content), '[^\\p{L}\\p{N}\\p{M}]|[\\x{FE00}-\\x{FE0F}\\x{20E3}]', '', 'g')"
    return f"""SELECT '{name}' AS src, id, came, CASE WHEN len(f) > 1 AND regexp_matches(t, '^({_LABELS})') THEN array_to_string(list_sort(f), '|') ELSE t END AS key
  FROM (SELECT id, came, t, list_filter(string_split(regexp_replace(t, '({_LABELS})', chr(1) || '\\1', 'g'), chr(1)), lambda x: x <> '') AS f FROM (SELECT DISTINCT ON (id) id, {arrived} AS came, {plain} AS t FROM (SELECT * FROM {name} ORDER BY id{', ' + arrived if arrived == 'loaded_at' else ''}))) WHERE t <> ''"""


_P7 = f"WITH m AS ({_messages_sql('inquiries', 'loaded_at')} UNION ALL {_messages_sql('golden_set', 'NULL::TIMESTAMPTZ')})"
ORACLE = {
    "p3_found": _P3,
    "p7_found": _P7 + " SELECT src, first_id, id AS copy_id FROM (SELECT *, min(id) OVER (PARTITION BY src, key) AS first_id FROM m) WHERE id <> first_id",
    "p7_messages": _P7 + " SELECT src, first(id ORDER BY came NULLS FIRST, id) AS record_id, count(*) AS copies FROM m GROUP BY src, key",
    "p8_bytes": "SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM documents",
    "p9_rules": "SELECT 'documents' AS rule, count(*) AS n FROM documents UNION ALL SELECT unnest(['wrong_size', 'divided', 'over', 'loose']), 0",
    "p10_letters": "SELECT doc_id, length(regexp_replace(text, '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]', '', 'g')) AS letters FROM documents WHERE regexp_replace(text, '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]', '', 'g') <> ''",
}
