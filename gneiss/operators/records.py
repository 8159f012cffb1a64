"""Record tables: constraints, nesting of children, synchronisation and caches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.text import null_if_blank, order_key


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(constraint, key): rows that break a named rule. A rule that is unknown (null) holds, as in SQL checks.

    All rules are tested in one pass; broken ones come out of one array.
    """
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]))
    return df.select(F.explode(broken).alias("constraint"), F.col(key).cast("string").alias("key"))


def nest(parents: DataFrame, children: DataFrame, key: str, order: str, fields: list[str], name: str) -> DataFrame:
    """Parents with their children as an ordered array; an empty one where there are none.

    A parent's children are expected to be few (one record); they are sorted by ``order``.
    """
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order]))).alias(name))
    kind = dict(lists.dtypes)[name]
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(F.col(name), F.expr(f"cast(array() as {kind})")))


def unnest(nested: DataFrame, key: str, name: str) -> DataFrame:
    """The children of ``nest`` as rows again."""
    return nested.select(key, F.inline(name))


def sync_plan(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """(action, n): what a full refresh does: rows to upsert, and target rows without a source row to delete."""
    gone = target.select(key).distinct().join(source.select(key).distinct(), key, "left_anti")
    return source.agg(F.lit("upsert").alias("action"), F.count(F.lit(1)).alias("n")).unionByName(gone.agg(F.lit("delete").alias("action"), F.count(F.lit(1)).alias("n")))


def sync(source: DataFrame, path: str, key: str) -> None:
    """Replace the table at ``path`` with the source: upsert by key, drop what has no source row.

    With the whole source at hand the result is the source itself, one row per key (the smallest struct of
    its values). It is written beside and the old table moved away before the new one takes its place; if
    the second move fails the first is undone, and a job lost between the two leaves ``path.previous``,
    which the next call puts back. A reader sees the old table, the new one, or for a moment none.
    """
    spark = source.sparkSession
    rest = [c for c in source.columns if c != key]
    one = source.groupBy(key).agg(F.min(F.struct(*rest)).alias("__row")).select(key, "__row.*").select(*source.columns) if rest else source.distinct()
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    now, fresh, previous = hadoop(path), hadoop(f"{path}.next"), hadoop(f"{path}.previous")
    fs = now.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(now) and fs.exists(previous) and not fs.rename(previous, now):
        raise OSError(f"{path}.previous can't be put back")
    one.write.mode("overwrite").parquet(f"{path}.next")
    if fs.exists(previous):
        fs.delete(previous, True)
    if fs.exists(now) and not fs.rename(now, previous):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(fresh, now):
        if fs.exists(previous):
            fs.rename(previous, now)
        raise OSError(f"{path}.next can't take its place")
    fs.delete(previous, True)


def cache_plan(texts: DataFrame, text: str, cached: DataFrame, digest: str) -> DataFrame:
    """(outcome, n): hits count occurrences, misses count different texts, keyed by the text's SHA-256."""
    keyed = texts.filter(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("digest"))
    marked = keyed.join(cached.select(F.col(digest).alias("digest")).distinct().withColumn("known", F.lit(True)), "digest", "left")
    return marked.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.first("known").alias("known")).agg(
        F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("hits"), F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)).alias("misses")
    )


def missing_both_ways(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(side, key): keys that only one side has."""
    only = lambda x, y, side: x.select(key).distinct().join(y.select(key).distinct(), key, "left_anti").select(F.lit(side).alias("side"), F.col(key).cast("string").alias("key"))
    return only(a, b, "left").unionByName(only(b, a, "right"))


def provenance(df: DataFrame, columns: list[str]) -> DataFrame:
    """The combinations of provenance that occur, and how often: more than one means a mixed index."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def require_provenance(df: DataFrame, expected: dict[str, object]) -> None:
    """Fail closed if any row's provenance differs from what is expected; an empty index is fine."""
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.lit(v)) for c, v in expected.items()])
    wrong = df.filter(~same).select(*expected).limit(1).collect()
    if wrong:
        raise ValueError(f"the index was made with {wrong[0].asDict()}, not {expected}")


#: Rows that a rendering shows before it says how many more there are.
SHOWN = 10


def render_row(columns: list[str], number: Column, null: str = "(없음)") -> Column:
    """One line of a row: ``i) k=v, k=v``; nulls are written out."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(null))) for c in columns]
    return F.concat(number.cast("string"), F.lit(") "), F.concat_ws(", ", *parts))


def render_rows(lines: Column, most: int | None = SHOWN) -> Column:
    """The lines of a result one below the other; beyond ``most`` a last line counts what isn't shown."""
    if most is None:
        return F.array_join(lines, "\n")
    rest = F.size(lines) - most
    return F.when(rest > 0, F.concat(F.array_join(F.slice(lines, 1, most), "\n"), F.lit("\n... (이하 "), rest.cast("string"), F.lit("건 생략)"))).otherwise(F.array_join(lines, "\n"))


def validate_order_no(c: Column) -> Column:
    """Is it ORD-, a calendar date of 8 digits, and a number from 0001 to 9999? ASCII digits only; null for null."""
    shape = c.rlike(r"\AORD-[0-9]{8}-[0-9]{4}\z")
    day = F.try_to_date(F.when(shape, F.substring(c, 5, 8)), "yyyyMMdd")
    return F.when(c.isNull(), None).otherwise(F.coalesce(shape & day.isNotNull() & (F.date_format(day, "yyyyMMdd") == F.substring(c, 5, 8)) & (F.substring(c, 14, 4) != "0000"), F.lit(False)))


def receive(inquiries: DataFrame, content: str = "content", order_no: str = "order_no") -> DataFrame:
    """``inquiries`` with accepted_content, accepted_order_no and error: what is taken in, or why not.

    Blank content is an error (no_content); a blank order number counts as none, another is compared in its
    normal form and must be a right one (bad_order_no).
    """
    text, key = null_if_blank(F.col(content)), order_key(F.col(order_no))
    error = F.when(text.isNull(), "no_content").when(key.isNotNull() & ~validate_order_no(key), "bad_order_no")
    ok = error.isNull()
    return inquiries.withColumns({"accepted_content": F.when(ok, text), "accepted_order_no": F.when(ok, key), "error": error})


def write_records(folder: str, batch: str, inquiries: DataFrame, **children: DataFrame) -> None:
    """Append inquiries and their child tables (each with inquiry_id) to one folder per table, under one batch id.

    The children are written first and the inquiries last: a batch whose inquiries aren't there isn't finished,
    and ``read_records`` leaves it out. Writing a batch again replaces it.
    """
    for name, df in [*children.items(), ("inquiries", inquiries)]:
        df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")


def read_records(spark, folder: str, **children: tuple[str, list[str]]) -> DataFrame:
    """Inquiries with their children nested, in order; children: name to (order column, fields). Children of batches
    whose inquiries were never written are left out, and so are those of other batches' inquiries."""
    out = spark.read.parquet(f"{folder}/inquiries")
    for name, (order, fields) in children.items():
        child = spark.read.parquet(f"{folder}/{name}")
        mine = child.join(out.select(F.col("id").alias("inquiry_id"), "batch"), ["inquiry_id", "batch"], "left_semi").withColumnRenamed("inquiry_id", "id")
        out = nest(out, mine.select("id", order, *[f for f in fields if f != order]), "id", order, fields, name)
    return out


def response_json(columns: dict[str, Column]) -> Column:
    """One JSON text with all keys always there; null lists are empty ones, other nulls are null."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]), {"ignoreNullFields": "false"})


def cache_misses(texts: DataFrame, text: str, cached: DataFrame, digest: str) -> DataFrame:
    """(digest, text): each different text that the cache doesn't hold, once; nulls are left out."""
    keyed = texts.filter(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("digest"), F.col(text).alias("text"))
    return keyed.join(cached.select(F.col(digest).alias("digest")).distinct(), "digest", "left_anti").groupBy("digest").agg(F.first("text").alias("text"))


def cached(texts: DataFrame, text: str, folder: str, make, kind: str) -> DataFrame:
    """``texts`` with a column ``made``: what ``make`` (a column of the text to a column of ``kind``) gives, computed once
    per different text and kept in a folder of Parquet, keyed by the text's SHA-256.

    New entries are added under a name of their own, so a lost job leaves what was there; an entry that two jobs
    made is taken once. Null texts have null.
    """
    spark = texts.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    schema = f"digest string, made {kind}"
    known = spark.read.schema(schema).parquet(folder) if there else spark.createDataFrame([], schema)
    new = cache_misses(texts, text, known, "digest")
    new.select("digest", make(F.col("text")).cast(kind).alias("made")).write.mode("append").parquet(folder)
    every = spark.read.schema(schema).parquet(folder).groupBy("digest").agg(F.first("made", ignorenulls=True).alias("made"))
    return texts.withColumn("__digest", F.sha2(text, 256)).join(every.withColumnRenamed("digest", "__digest"), "__digest", "left").drop("__digest")


def lowered(df: DataFrame) -> DataFrame:
    """``df`` with values as JSON can hold them: times and dates as ISO text, decimals as text; others stay."""
    def low(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("timestamp", "timestamp_ntz"):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX" if kind == "timestamp" else "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(name)
        return c.cast("string").alias(name) if kind == "date" or kind.startswith("decimal") else c.alias(name)

    return df.select(*[low(n, k) for n, k in df.dtypes])
