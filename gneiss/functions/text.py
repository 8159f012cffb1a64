"""Text expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that Unicode counts as white space, and the four separators U+001C to U+001F.
WHITE = r"[\s\x0b\x1c-\x1f\x85\xa0  -     　]"


def strip_white(c: Column) -> Column:
    """The text without Unicode white space at both ends; null stays null."""
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def collapse_white(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip_white(F.regexp_replace(c, f"{WHITE}+", " "))


def null_if_blank(c: Column) -> Column:
    s = strip_white(c)
    return F.when(s != "", s)


def order_key(c: Column) -> Column:
    """An order number as it is compared: no white space around it, upper case; blank is null."""
    return F.upper(null_if_blank(c))


def shortened(c: Column, most: int = 200) -> Column:
    """White space collapsed; beyond ``most`` characters cut and marked with an ellipsis."""
    s = collapse_white(c)
    return F.when(F.length(s) > most, F.concat(F.left(s, F.lit(most)), F.lit("…"))).otherwise(s)


def digest(c: Column, prefix: str = "") -> Column:
    """The first 12 hex digits of the text's SHA-256, behind a prefix."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(c, 256), 1, 12))


def order_no(day: Column, sequence: Column) -> Column:
    """The number of the ``sequence``-th order of a day; an error for a sequence outside 1 to 9,999."""
    ok = sequence.between(1, 9_999)
    return F.when(ok, F.concat(F.lit("ORD-"), F.date_format(day, "yyyyMMdd"), F.lit("-"), F.lpad(sequence.cast("string"), 4, "0"))).when(~ok, F.raise_error(F.concat(F.lit("no sequence: "), sequence.cast("string"))))


def policy_evidence(title: Column, article: Column, article_title: Column, content: Column) -> Column:
    """The text of a clause as evidence: ``[title article article_title] content``; nulls are left out."""
    return F.concat(F.lit("["), F.concat_ws(" ", title, article, article_title), F.lit("] "), F.coalesce(content, F.lit("")))


def setting_id(strategy: Column, cut: Column, statistic: Column, tau: Column) -> Column:
    """The name of a setting: strategy/cut=0.300/stat=spread/tau=0.0600, or gate=off without a statistic."""
    head = F.concat(strategy, F.lit("/cut="), F.format_string("%.3f", cut))
    return F.when(statistic.isNull(), F.concat(head, F.lit("/gate=off"))).otherwise(F.concat(head, F.lit("/stat="), statistic, F.lit("/tau="), F.format_string("%.4f", tau)))


def model_id(label: Column) -> Column:
    """The model that a description names between backticks; null where it names none."""
    m = F.regexp_extract(label, "`([^`]+)`", 1)
    return F.when(m != "", m)


def effort(label: Column) -> Column:
    """The effort that a description gives in brackets as ``effort=…``; null where it gives none."""
    m = F.regexp_extract(label, r"effort=([^)]*)", 1)
    return F.when(label.contains("effort="), F.trim(m))


def rewrite_flag(strategy: Column) -> Column:
    """on if the strategy rewrites queries, else off; null without a strategy."""
    return F.when(strategy != "", F.when(strategy.contains("rewrite"), "on").otherwise("off"))
