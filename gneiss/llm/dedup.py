"""Records that differ only in formatting, kept in an incremental ledger of canonical keys.

The canonical text keeps letters, digits and marks, in lower case. In a form made of labelled fields
it is the sorted list of the fields, so neither their order nor what separates them counts. Labels are
what stands before a colon or equals sign at the start of a field. Those that many forms use are looked
for in every text, for a form may have lost its separators; the rarer ones in the texts that have the
same letters as a form with them, whatever their order.

The ledger holds, per canonical key, the copies counted so far, the smallest id and the earliest record.
A batch is aggregated first and then merged into the matching buckets by a full outer join.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators.skew import lookup
from gneiss.session import cut_lineage, default_parallelism, ensure_checkpoint_dir

#: A label that at least this share of all forms uses is looked for in every text (so there are at most fields/share
#: of them); rarer ones only where the letters match.
LABEL_SHARE = 0.002
MARK = "\u0001"
_SIGN = r"[:：=＝]"
_LABEL = r"\p{L}[\p{L}\p{N}]*+(?:[ 　][\p{L}\p{N}]++)*+"
#: The start of a field: the start of the text, a line's start, or a separator with white space beside it.
_FIELD = rf"(^|[\n\r]|\s[|/;,·•]|[|/;](?=\s))([^\p{{L}}\p{{N}}]*+)(?={_LABEL}\s*+{_SIGN}(?!\s*[()]))"


def squeezed(text: Column, keep: str = "") -> Column:
    """Letters, digits and marks in lower case; variation selectors and the keycap sign are symbols' parts."""
    return F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}\p{{M}}{keep}]|[\x{{FE00}}-\x{{FE0F}}\x{{20E3}}]", "")


def marked_fields(text: Column) -> Column:
    """The text with a mark before each label that opens a field."""
    return F.regexp_replace(text, _FIELD, f"$1$2{MARK}")


def opens_labelled(text: Column) -> Column:
    """Does the text begin with a label and its sign? A cheap test: most texts don't and need no marking."""
    return text.rlike(rf"^[^\p{{L}}\p{{N}}]*+{_LABEL}\s*+{_SIGN}")


def is_form(marked: Column) -> Column:
    """Does the text begin with a labelled field and have another?"""
    return marked.rlike(rf"^[^\p{{L}}\p{{N}}{MARK}]*{MARK}[^{MARK}]+{MARK}")


def own_labels(text: Column) -> Column:
    """The squeezed labels of a form, by its signs alone; null for other texts."""
    marked = marked_fields(text)
    labels = F.array_distinct(F.transform(F.regexp_extract_all(marked, F.lit(rf"{MARK}({_LABEL})"), F.lit(1)), squeezed))
    return F.when(opens_labelled(text), F.when(is_form(marked), labels))


def known_labels(df: DataFrame, text: str, share: float = LABEL_SHARE) -> list[str]:
    """The squeezed labels that at least ``share`` of all forms use: at most (fields per form) / share.

    Counts cover all rows; only the labels themselves come to the driver.
    """
    forms = df.filter(opens_labelled(F.col(text))).select(own_labels(F.col(text)).alias("labels"))
    # One row counts the forms: every form holds the empty label once, and other texts, whose list is null, give no row.
    counted = forms.select(F.explode(F.array_union(F.array(F.lit("")), "labels")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = counted.filter("label = ''").select((F.col("n") * F.lit(share)).alias("least"))
    return sorted((r[0] for r in counted.filter("label <> ''").join(F.broadcast(total), F.col("n") >= F.col("least")).select("label").collect()), key=lambda x: (-len(x), x))


def canonical(text: Column, labels: list[str]) -> Column:
    """The canonical text; empty for a text without letters and digits, null for null.

    A form, also one that has lost its separators, begins with a label and holds another: its fields,
    each with its label, are sorted. Everything else is the squeezed text.
    """
    flat = squeezed(F.when(opens_labelled(text), marked_fields(text)).otherwise(text), MARK)
    if labels:
        alternatives = "|".join(re.escape(x) for x in labels)
        flat = F.regexp_replace(flat, f"{MARK}?({alternatives})", f"{MARK}$1")
    fields = F.array_sort(F.filter(F.split(flat, MARK), lambda x: x != ""))
    form = flat.rlike(f"^{MARK}[^{MARK}]+{MARK}")
    return F.when(form, F.array_join(fields, MARK)).otherwise(F.regexp_replace(flat, MARK, ""))


def keyed(df: DataFrame, record_id: str, text: str, labels: list[str], arrived: str | None = None) -> DataFrame:
    """(record_id, key, arrived): one row per record, the key 128 bits of its canonical text.

    A record is an id, not a row: of rows loaded again the earliest counts (without ``arrived`` the
    smallest key). Texts that are null, empty or without letters and digits have nothing to compare and
    are left out.
    """
    came = F.col(arrived) if arrived else F.lit(None).cast("timestamp")
    t = F.col(text)
    listed = F.array(*[F.lit(x) for x in labels]) if labels else F.array().cast("array<string>")
    canon = df.filter(F.col(record_id).isNotNull()).select(F.col(record_id).cast("string").alias("record_id"), came.alias("arrived"), canonical(t, labels).alias("c"), F.when(opens_labelled(t), F.size(F.array_except(own_labels(t), listed)) > 0).alias("rare"))
    row = F.min(F.struct("arrived", F.unhex(F.md5("c")).alias("key"), F.coalesce("rare", F.lit(False)).alias("rare"), F.length(F.replace("c", F.lit(MARK), F.lit(""))).alias("letters")))
    # Checkpointed: the canonical text is the costly part, and counting hot keys, the ledger and the copies all read it.
    # What is empty is left out after the aggregation: a filter before it would be computed from the text once more.
    keys = cut_lineage(canon.groupBy("record_id").agg(row.alias("r")).select("record_id", "r.*").filter("letters > 0"))
    lengths = keys.filter("rare").select("letters").distinct()
    if lengths.isEmpty():
        return keys.select("record_id", "key", "arrived")
    plain = df.filter(F.col(record_id).isNotNull()).select(F.col(record_id).cast("string").alias("record_id"), came.alias("arrived"), squeezed(t).alias("plain"), own_labels(t).alias("own"))
    again = by_own_labels(plain.withColumn("letters", F.length("plain")).join(F.broadcast(lengths), "letters", "left_semi"), listed)  # a row per length of a text
    again = again.groupBy("record_id").agg(F.min(F.struct("arrived", "key")).alias("r")).select("record_id", F.col("r.key").alias("new"))
    return keys.join(again, "record_id", "left").select("record_id", F.coalesce("new", "key").alias("key"), "arrived")


def by_own_labels(plain: DataFrame, listed: Column) -> DataFrame:
    """(record_id, arrived, key) of the texts that have the same letters as a form with a label that isn't listed.

    All such texts are divided at the labels of all these forms, so a form and its copies without
    separators get one key. plain: record_id, arrived, plain (squeezed text), own (a form's labels).
    """
    letters = F.unhex(F.md5(F.array_join(F.array_sort(F.split("plain", "")), "")))
    same = plain.withColumn("letters", letters)
    rare = same.filter(F.size(F.array_except("own", listed)) > 0)
    labels = rare.select("letters", F.explode("own").alias("label")).distinct().groupBy("letters").agg(F.collect_set("label").alias("labels"))  # labels made of one set of letters
    first_long = F.array_sort("labels", lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    found = lookup(same, labels.select(F.col("letters").alias("of"), F.concat(F.lit("("), F.array_join(first_long, "|"), F.lit(")")).alias("pattern")), "letters", "of", "inner")
    fields = F.array_sort(F.filter(F.split(F.regexp_replace("plain", F.col("pattern"), F.lit(f"{MARK}$1")), MARK), lambda x: x != ""))
    return found.select("record_id", "arrived", F.unhex(F.md5(F.array_join(fields, MARK))).alias("key"))


# --- the ledger --------------------------------------------------------------------------------


def ledger_of(keys: DataFrame) -> DataFrame:
    """(key, copies, first_id, earliest): the aggregate of one batch."""
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("record_id").alias("first_id"), F.min(F.struct("arrived", "record_id")).alias("earliest"))


def update_ledger(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """The ledger with a batch's aggregate merged in: counts added, the earliest representative kept.

    Both sides have one row per key, so the full outer join has no hot key, and a ledger stored in as many
    buckets as the batch has partitions isn't shuffled. Batches hold records that the ledger hasn't
    counted yet, keyed with the labels that the ledger was made with.
    """
    b = batch.select("key", F.col("copies").alias("more"), F.col("first_id").alias("other_id"), F.col("earliest").alias("other"))
    merged = ledger.join(b, "key", "full_outer")
    sooner = F.when(F.col("earliest").isNull() | (F.col("other") < F.col("earliest")), F.col("other")).otherwise(F.col("earliest"))
    return merged.select("key", (F.coalesce("copies", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("copies"), F.least("first_id", "other_id").alias("first_id"), sooner.alias("earliest"))


def store_ledger(ledger: DataFrame, buckets: int | None = None) -> DataFrame:
    """The ledger as it is read from a new table, bucketed and sorted by key, in the shared folder for intermediate results."""
    spark = ledger.sparkSession
    buckets = buckets or default_parallelism(spark)
    name = f"gneiss_ledger_{uuid.uuid4().hex[:12]}"
    ledger.repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key").option("path", f"{ensure_checkpoint_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def batches(keys: DataFrame) -> list[DataFrame]:
    """The keys by the year their record arrived in, in that order; those without a time come first."""
    year = F.year("arrived")
    years = sorted((r[0] for r in keys.select(year.alias("y")).distinct().collect()), key=lambda y: (y is not None, y))  # a row per calendar year
    return [keys.filter(year.eqNullSafe(F.lit(y))) for y in years]


def merged_ledger(keys: DataFrame) -> DataFrame:
    """The ledger of all keys, batch after batch: each is aggregated and merged into the stored ledger; the last merge isn't stored."""
    parts = batches(keys)
    if not parts:
        return ledger_of(keys)
    ledger = store_ledger(ledger_of(parts[0])) if len(parts) > 1 else ledger_of(parts[0])
    for i, part in enumerate(parts[1:], start=2):
        ledger = update_ledger(ledger, ledger_of(part))
        if i < len(parts):
            ledger = store_ledger(ledger)
    return ledger


def copies(keys: DataFrame, ledger: DataFrame) -> DataFrame:
    """(first_id, copy_id): for each key with several records, a row per record other than the first."""
    several = ledger.filter("copies > 1").select(F.col("key").alias("ledger_key"), "first_id")
    found = lookup(keys, several, "key", "ledger_key", how="inner")
    return found.filter("record_id <> first_id").select("first_id", F.col("record_id").alias("copy_id"))


def representatives(df: DataFrame, record_id: str, text: str, arrived: str | None = None) -> DataFrame:
    """One record per message, the one that arrived first, with its number of copies: (record_id, copies)."""
    return merged_ledger(keyed(df, record_id, text, known_labels(df, text), arrived)).select(F.col("earliest.record_id").alias("record_id"), "copies")
