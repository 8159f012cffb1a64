"""Encoding a corpus with a public byte-level BPE vocabulary by forced-boundary splitting.

A merge can only join two bytes if some token of the vocabulary holds them side by side. A pair of
bytes that no token holds is therefore a certain cut: what lies on its two sides is encoded
independently and concatenated. Cutting in the raw text must also leave the pre-tokenizer's splits as
they are, so a cut is taken only between two characters of which the left isn't white space (runs of
white space look ahead) and the right isn't an apostrophe (contractions). Cuts are found for a whole
Arrow batch at once with numpy; fragments repeat a lot, so each is encoded once per process.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie; a parameter of every function below.
VOCABULARIES = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the public pre-tokenizer pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The characters that count as white space for \s.
WHITE = [*range(9, 14), 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Fragments remembered per process; beyond, the memory starts anew. It changes speed only.
REMEMBERED = 400_000


def read_ranks(folder: str = VOCABULARIES, name: str = VOCABULARY) -> dict[bytes, int]:
    """token bytes -> id, from a ``.tiktoken`` file."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def joinable_pairs(tokens) -> np.ndarray:
    """A 256 x 256 table: does any token hold these two bytes side by side?"""
    table = np.zeros((256, 256), dtype=bool)
    blob = np.frombuffer(b"".join(tokens), dtype=np.uint8)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64))
    inside = np.ones(len(blob), dtype=bool)
    inside[ends - 1] = False  # the pair after a token's last byte belongs to no token
    at = np.flatnonzero(inside[:-1])
    table[blob[at], blob[at + 1]] = True
    return table


def _first_byte(c: np.ndarray) -> np.ndarray:
    return np.select([c < 0x80, c < 0x800, c < 0x10000], [c, 0xC0 | c >> 6, 0xE0 | c >> 12], 0xF0 | c >> 18).astype(np.uint8)


def _last_byte(c: np.ndarray) -> np.ndarray:
    return np.where(c < 0x80, c, 0x80 | c & 0x3F).astype(np.uint8)


class ForcedBoundaryEncoder:
    """Encodes texts; one per process and vocabulary (``encoder``)."""

    def __init__(self, folder: str, name: str):
        import tiktoken

        ranks = read_ranks(folder, name)
        self.pairs = joinable_pairs(list(ranks))
        self.ranks = ranks
        self.bpe = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, list[int]] = {}
        self.white = np.array(WHITE, dtype=np.uint32)

    def cuts(self, joined: str) -> np.ndarray:
        """Positions (in code points) at which ``joined`` may be cut for certain."""
        c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if len(c) < 2:
            return np.zeros(0, dtype=np.int64)
        left, right = c[:-1], c[1:]
        sure = ~self.pairs[_last_byte(left), _first_byte(right)] & (right != 0x27)
        at = np.flatnonzero(sure)
        return at[~np.isin(left[at], self.white)] + 1

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The token ids of every text; null and empty texts have none."""
        filled = [t or "" for t in texts]
        joined = "".join(filled)
        ends = np.cumsum(np.fromiter(map(len, filled), dtype=np.int64, count=len(filled)))
        marks = np.union1d(self.cuts(joined), ends)
        marks = marks[marks > 0]
        starts = np.concatenate([[0], marks[:-1]]) if len(marks) else marks
        fragments = [joined[a:b] for a, b in zip(starts.tolist(), marks.tolist())]
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        new = [f for f in dict.fromkeys(fragments) if f not in known]
        if new:
            known.update(zip(new, map(self.bpe.encode_ordinary, new)))
        out, k = [], 0
        upto = np.searchsorted(marks, ends, side="right").tolist()
        for text, last in zip(filled, upto):
            ids: list[int] = []
            if text:
                for f in fragments[k:last]:
                    ids += known[f]
                k = last
            out.append(ids)
        return out


    def sizes(self) -> np.ndarray:
        """The number of bytes of every token, by its id."""
        out = np.zeros(max(self.ranks.values()) + 1, dtype=np.int64)
        for token, i in self.ranks.items():
            out[i] = len(token)
        return out


@lru_cache(maxsize=4)
def encoder(folder: str = VOCABULARIES, name: str = VOCABULARY) -> ForcedBoundaryEncoder:
    return ForcedBoundaryEncoder(folder, name)


def _shipped(df: DataFrame, folder: str, name: str) -> Callable[[], ForcedBoundaryEncoder]:
    """An encoder as tasks get it: the vocabulary is read where the driver runs and shipped to every executor once."""
    file = f"{name}.tiktoken"
    df.sparkSession.sparkContext.addFile(os.path.join(folder, file))

    def opened() -> ForcedBoundaryEncoder:
        return encoder(os.path.dirname(SparkFiles.get(file)), name)

    return opened


def _slices(batch: pa.RecordBatch, column: int, most_chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in slices of bounded text, so very long texts don't add up in memory."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + most_chars, side="right")))
        yield batch.slice(start, end - start)
        start = end


def encode(df: DataFrame, key: str, text: str, folder: str = VOCABULARIES, name: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>): one row per row of ``df``; null and empty texts give an empty list."""
    kind = dict(df.dtypes)[key]
    schema = f"`{key}` {kind}, ids array<int>"

    opened = _shipped(df, folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = opened()
        for whole in batches:
            for b in _slices(whole, 1):
                ids = e.encode(b.column(1).to_pylist())
                flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=sum(map(len, ids)))
                offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, schema)


def count_tokens(df: DataFrame, key: str, text: str, folder: str = VOCABULARIES, name: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens): the number of tokens per row, without shipping the ids back to the JVM."""
    schema = f"`{key}` {dict(df.dtypes)[key]}, n_tokens int"

    opened = _shipped(df, folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = opened()
        for whole in batches:
            for b in _slices(whole, 1):
                n = pa.array([len(x) for x in e.encode(b.column(1).to_pylist())], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), n], names=[key, "n_tokens"])

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, schema)


def byte_lengths(encoded: DataFrame, key: str, folder: str = VOCABULARIES, name: str = VOCABULARY) -> DataFrame:
    """(key, n_bytes): how many bytes the ids of ``encode`` stand for, which are those of the text in UTF-8."""
    opened = _shipped(encoded, folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = opened().sizes()
        for b in batches:
            ids = b.column(1)
            upto = np.concatenate([[0], np.cumsum(sizes[ids.flatten().to_numpy()])])
            at = ids.offsets.to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(upto[at[1:] - at[0]] - upto[at[:-1] - at[0]], pa.int64())], names=[key, "n_bytes"])

    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {dict(encoded.dtypes)[key]}, n_bytes bigint")
