"""Patterns of the deterministic gate, and how their values are compared."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name to pattern. Digits around a match keep it out of longer numbers; the last is for letters
#: and digits of every script.
PATTERNS = {
    "mobile": r"(?<![0-9])(?:(?:\+82|0082)[-. ()]*10|01[016789])[-. ()]*[0-9]{3,4}[-. ()]*[0-9]{4}(?![0-9])",
    "landline": r"(?<![0-9])(?:(?:\+82|0082)[-. ()]*(?:2|[3-9][0-9]?)|0[2-9][0-9]?)[-. ()]*[0-9]{3,4}[-. ()]*[0-9]{4}(?![0-9])",
    "service": r"(?<![0-9])1[5-8][0-9]{2}[-. ]?[0-9]{4}(?![0-9])",
    "resident": r"(?<![0-9])[0-9]{6}[-. ]?[1-4][0-9]{6}(?![0-9])",
    "email": r"[A-Za-z0-9._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
}


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def phone(c: Column) -> Column:
    """Digits only; the country code (0082 or 82 at the start) becomes a 0, and what follows it stays."""
    d = digits(c)
    return F.when(d.startswith("0082"), F.concat(F.lit("0"), F.substring(d, 5, 1_000))).when(d.startswith("82"), F.concat(F.lit("0"), F.substring(d, 3, 1_000))).otherwise(d)


def folded(text: Column) -> Column:
    """The text as it looks: compatibility characters folded (NFKC), format characters (category Cf) removed."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFKC", t) if unicodedata.category(c) != "Cf"))

    return fold(text)


def found(text: Column) -> Column:
    """array<string>: every value the patterns find, normalised, each once; empty for null."""
    lists = []
    for name, pattern in PATTERNS.items():
        norm = phone if name in ("mobile", "landline") else digits if name in ("service", "resident") else F.lower
        lists.append(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), norm))
    return F.coalesce(F.array_distinct(F.flatten(F.array(*lists))), F.array().cast("array<string>"))


def shaped(text: Column) -> Column:
    """Does the (folded) text hold anything the patterns find? Null for null."""
    return text.rlike("|".join(f"(?:{p})" for p in PATTERNS.values()))
