"""A lexical embedding without a model: bigrams hashed into a vector of unit length."""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_vector(text: str, dimensions: int) -> list[float]:
    """Counts of the text's character bigrams (lower case, no white space) by an 8-byte BLAKE2b modulo the dimensions,
    scaled to length 1. A text of one character is its own gram."""
    plain = "".join(text.split()).lower()
    counts = [0.0] * dimensions
    for gram in [plain[i : i + 2] for i in range(len(plain) - 1)] or [plain]:
        counts[int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "big") % dimensions] += 1.0
    length = math.sqrt(sum(x * x for x in counts))
    return [x / length for x in counts]


def hash_embedding(text: Column, dimensions: int) -> Column:
    """``hash_vector`` as a column; null for null."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else hash_vector(t, dimensions))

    return embed(text)
