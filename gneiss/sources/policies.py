"""Reading policy documents and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def read_policies(spark: SparkSession, folder: str) -> DataFrame:
    """(evidence_id, document_slug, document_title, article, article_title, content, planted, planted_note): a row
    per clause of every ``*.md`` file in the folder.

    A document begins with front matter (``slug``, ``title``); a clause with ``## <article> <title>``; a
    comment ``<!-- planted: kind; note: text -->`` before a heading belongs to the clause it heads. A
    document without slug or title, or a clause without text, raises an error when rows are read.
    """
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").withColumn("file", F.input_file_name())
    text = F.regexp_replace("value", "\r\n?", "\n")
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    field = lambda n: F.regexp_extract(head, rf"(?m)^{n}:[ \t]*(.+?)[ \t]*$", 1)
    body = F.regexp_replace(text, r"(?s)\A---\n.*?\n---[ \t]*\n", "")
    docs = raw.select("file", field("slug").alias("slug"), field("title").alias("title"), F.split(body, r"(?m)^(?=(?:<!--[ \t]*planted:|##[ \t]))").alias("parts"))
    docs = docs.withColumn("slug", F.when(F.col("slug") == "", F.raise_error(F.concat(F.lit("no slug in "), F.col("file")))).otherwise(F.col("slug"))).withColumn("title", F.when(F.col("title") == "", F.raise_error(F.concat(F.lit("no title in "), F.col("file")))).otherwise(F.col("title")))
    parts = docs.select("slug", "title", "file", F.posexplode("parts").alias("at", "part"))
    note = F.regexp_extract("part", r"(?s)\A<!--[ \t]*planted:[ \t]*([^;>]*?)[ \t]*(?:;|-->)", 1)
    why = F.regexp_extract("part", r"(?s)\A<!--[ \t]*planted:[^>]*?note:[ \t]*(.*?)[ \t]*-->", 1)
    w = Window.partitionBy("file").orderBy("at")
    marked = parts.withColumns({"planted_before": F.lag(note).over(w), "note_before": F.lag(why).over(w)})
    clauses = marked.filter(F.col("part").startswith("##"))
    article = F.regexp_extract("part", r"\A##[ \t]+(\S+)", 1)
    content = F.trim(F.regexp_replace(F.regexp_replace("part", r"\A[^\n]*", ""), r"\A\s+|\s+\z", ""))
    content = F.when(content == "", F.raise_error(F.concat(F.lit("no text in clause "), article, F.lit(" of "), F.col("file")))).otherwise(content)
    none = lambda c: F.when(c != "", c)
    return clauses.select(
        F.concat_ws(":", F.lit("policy"), "slug", article).alias("evidence_id"), F.col("slug").alias("document_slug"), F.col("title").alias("document_title"), article.alias("article"),
        F.regexp_extract("part", r"\A##[ \t]+\S+[ \t]+([^\n]*?)[ \t]*(?:\n|\z)", 1).alias("article_title"), content.alias("content"), F.coalesce(none(F.col("planted_before")), F.lit("none")).alias("planted"), none(F.col("note_before")).alias("planted_note"),
    )


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines of a fixed schema; blank lines are skipped, anything that doesn't fit raises an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
