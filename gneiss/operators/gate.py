"""The deterministic gate over drafted answers: structure, citations, unsourced personal data.

All reasons are collected, in a fixed order; a draft passes if it has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.pii import folded, found
from gneiss.functions.text import strip_white
from gneiss.operators import nested

#: The reasons in the order of the report.
REASONS = ("schema_violation", "missing_citation", "invalid_citation", "pii_detected")


def structure(triples: DataFrame, drafts: DataFrame) -> DataFrame:
    """(record_id, valid): is a draft an object whose ``claims`` is a non-empty list of objects, each with a
    text that isn't blank and a list of strings ``citation_ids``? Further fields are allowed.

    ``triples`` as ``nested.json_triples`` gives them without unwrapping; drafts without triples (null or
    no JSON) are invalid.
    """
    p, k, v = F.col("path"), F.col("kind"), F.col("value")
    elements = F.sum((p == "claims[]").cast("int"))
    count = lambda path, *kinds: F.sum(((p == path) & k.isin(*kinds)).cast("int"))
    ok = triples.groupBy("record_id").agg(
        (count("", nested.OBJECT) == 1).alias("root"),
        (count("claims", nested.ARRAY) == 1).alias("list"),
        elements.alias("claims"),
        count("claims[]", nested.OBJECT).alias("objects"),
        F.sum(((p == "claims[].text") & (k == nested.STRING) & (strip_white(v) != "")).cast("int")).alias("texts"),
        count("claims[].citation_ids", nested.ARRAY).alias("lists"),
        F.sum(((p == "claims[].citation_ids[]") & (k != nested.STRING)).cast("int")).alias("odd"),
    )
    valid = F.col("root") & F.col("list") & (F.col("claims") > 0) & (F.col("objects") == F.col("claims")) & (F.col("texts") == F.col("claims")) & (F.col("lists") == F.col("claims")) & (F.col("odd") == 0)
    return drafts.select(F.col("record_id")).distinct().join(ok.select("record_id", valid.alias("valid")), "record_id", "left").select("record_id", F.coalesce("valid", F.lit(False)).alias("valid"))


def citations(triples: DataFrame, evidence: DataFrame) -> DataFrame:
    """(record_id, missing, invalid): does a claim with a list cite nothing, or something that wasn't collected?

    evidence: record_id, evidence_id. A claim of broken shape is left to ``structure``.
    """
    claim = F.get("ordinals", F.lit(0)).alias("claim_no")
    lists = triples.filter((F.col("path") == "claims[].citation_ids") & (F.col("kind") == nested.ARRAY)).select("record_id", claim).distinct()
    cited = triples.filter((F.col("path") == "claims[].citation_ids[]") & (F.col("kind") == nested.STRING)).select("record_id", claim, F.col("value").alias("evidence_id"))
    counts = lists.join(cited.groupBy("record_id", "claim_no").agg(F.count(F.lit(1)).alias("n")), ["record_id", "claim_no"], "left")
    missing = counts.groupBy("record_id").agg(F.max(F.col("n").isNull()).alias("missing"))
    unknown = cited.join(evidence.select("record_id", "evidence_id").distinct(), ["record_id", "evidence_id"], "left_anti").select("record_id").distinct().withColumn("invalid", F.lit(True))
    both = missing.join(unknown, "record_id", "full_outer")
    return both.select("record_id", F.coalesce("missing", F.lit(False)).alias("missing"), F.coalesce("invalid", F.lit(False)).alias("invalid"))


def draft_texts(triples: DataFrame) -> DataFrame:
    """(record_id, text): the claim texts of a draft; of one without any, all its strings but ``citation_ids``,
    and text that is no JSON as it stands."""
    p, k, v = F.col("path"), F.col("kind"), F.col("value")
    claim = (p == "claims[].text") & (k == nested.STRING)
    strings = triples.filter(k.isin(nested.STRING, nested.INVALID) & v.isNotNull() & ~p.rlike(r"(^|\.)citation_ids($|[.\[])"))
    rows = strings.select("record_id", v.alias("text"), claim.alias("claim"))
    claimed = rows.filter("claim").select("record_id").distinct()
    return rows.filter("claim").select("record_id", "text").unionByName(rows.join(claimed, "record_id", "left_anti").select("record_id", "text"))


def unsourced(triples: DataFrame, sources: DataFrame) -> DataFrame:
    """(record_id, values): personal data in a draft's texts that no evidence of it holds, compared exactly
    after both are folded and their values normalised. sources: record_id, text."""
    texts = draft_texts(triples).select("record_id", F.explode(found(folded(F.col("text")))).alias("v")).distinct()
    known = sources.select("record_id", F.explode(found(folded(F.col("text")))).alias("v")).distinct()
    return texts.join(known, ["record_id", "v"], "left_anti").groupBy("record_id").agg(F.array_sort(F.collect_set("v")).alias("values"))


def reasons(*flags: tuple[str, Column]) -> Column:
    """The names whose condition holds, in the given order."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in flags]), lambda x: x.isNotNull())


def verdicts(drafts: DataFrame, triples: DataFrame, evidence: DataFrame) -> DataFrame:
    """(record_id, verdict, reasons): pass, or reject with every reason. evidence: record_id, evidence_id, text."""
    s, c = structure(triples, drafts), citations(triples, evidence)
    u = unsourced(triples, evidence.select("record_id", "text")).select("record_id", F.lit(True).alias("pii"))
    all_ = s.join(c, "record_id", "left").join(u, "record_id", "left")
    why = reasons(("schema_violation", ~F.col("valid")), ("missing_citation", F.coalesce("missing", F.lit(False))), ("invalid_citation", F.coalesce("invalid", F.lit(False))), ("pii_detected", F.coalesce("pii", F.lit(False))))
    return all_.select("record_id", why.alias("reasons")).select("record_id", F.when(F.size("reasons") == 0, "pass").otherwise("reject").alias("verdict"), "reasons")


def accuracy(judged: DataFrame) -> DataFrame:
    """One row of detection, false alarms and exact reason sets; judged: verdict, reasons, expected_verdict, expected_reasons.

    Rows without a verdict (an error) leave every denominator and are counted apart.
    """
    ran = F.col("verdict").isNotNull()
    bad, good = ran & (F.col("expected_verdict") == "reject"), ran & (F.col("expected_verdict") == "pass")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    div = lambda a, b: (a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)))
    same = F.array_sort("reasons").eqNullSafe(F.array_sort("expected_reasons"))
    return judged.agg(
        n(ran).alias("measured"), n(~ran).alias("errors"),
        div(n(bad & (F.col("verdict") == "reject")), n(bad)).alias("detection"),
        div(n(good & (F.col("verdict") == "reject")), n(good)).alias("false_alarm"),
        div(n(ran & same), n(ran)).alias("exact_reasons"),
    )


def multiset_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, left_n, right_n): where two multisets differ, with both counts."""
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("left_n"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("right_n"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return a.join(b, keys, "full_outer").select(*keys, z("left_n"), z("right_n")).filter(F.col("left_n") != F.col("right_n"))
