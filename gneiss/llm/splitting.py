"""Cutting long texts into pieces under a limit, at natural boundaries, with an overlap.

A text is first cut where a further article's heading opens a line: no piece may reach over such a
place. Each part is then bisected: it is cut at the strongest boundary near its middle, and halves
that still exceed the limit minus the overlap are cut again. At last every piece but the first is
extended to the left by the overlap.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 600
OVERLAP = 60

_NUMBER = r"\d+(?:[-–.]\d+)+"
#: Headings: a numbered mark that opens a line. A title in brackets may be followed by text; otherwise
#: the title is the whole line and ends like one, not like a sentence.
_HEADING = regex.compile(
    rf"""(?:^|(?<=[\n\r\x0b\x0c\x85  ]))[ \t　]*(?:
        (?:\#{{1,6}}[ \t]*)?(?:제[ ]?(?P<a>{_NUMBER})[ ]?조|第[ ]?(?P<b>{_NUMBER})[ ]?[条條])[ \t]*[(（\[【][^()（）\n\r]*[)）\]】]
      | (?:\#{{1,6}}[ \t]*)?(?:
            [\[【](?P<c>{_NUMBER})[\]】][ \t]*
          | (?P<d>{_NUMBER})[.)][ \t]+
          | (?<=\#[ \t]{{0,9}})(?P<e>{_NUMBER})[ \t]+
          | (?:Article|Section|Clause|§)[ \t]*(?P<f>{_NUMBER})[.:)]?[ \t]+
        )(?=[^\s\d])[^\n\r\x0b\x0c\x85  ]*?(?<![.!?。！？…,;:、，])[ \t]*(?=[\n\r\x0b\x0c\x85  ]|$)
    )""",
    regex.X,
)
#: Boundaries by falling strength: the cut lies after the match.
_BOUNDARIES = (
    (6, regex.compile(r"(?:\r\n|[\n\r  ])[ \t]*(?:\r\n|[\n\r  ])\s*")),
    (5, regex.compile(r"(?:\r\n|[\n\r\x0b\x0c\x85  ])+")),
    (4, regex.compile(r"(?:(?<![\d\s][^\s])[.!?…]+[\"'”’»)\]]*(?=\s)\s+|[。！？｡]+[」』”’）]*\s*)")),
    (3, regex.compile(r"[;:—]\s+|[；：、，]\s*|,\s+")),
    (2, regex.compile(r"\s+")),
    (1, regex.compile(r"[,;/|]+(?=\S)")),
)
_CLUSTER = regex.compile(r"\X")


def headings(text: str) -> list[tuple[int, str]]:
    """(position of the heading's line, article number) of every heading in the text."""
    found = []
    for m in _HEADING.finditer(text):
        number = next(v for v in m.groupdict().values() if v)
        at = m.start()
        found.append((at, number.replace("–", "-")))
    return found


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Positions of natural boundaries, rising, and the strength of each."""
    strength: dict[int, int] = {}
    for level, pattern in _BOUNDARIES:
        for m in pattern.finditer(text):
            strength.setdefault(m.end(), level)
    at = sorted(p for p in strength if 0 < p < len(text))
    return at, [strength[p] for p in at]


def _hard_cut(text: str, lo: int, hi: int) -> int:
    """The middle, moved to the next place that doesn't divide a character as seen (nor CR LF)."""
    mid = (lo + hi) // 2
    a, b = max(lo, mid - 64), min(hi, mid + 64)
    ends = [a + m.end() for m in _CLUSTER.finditer(text[a:b])]
    inner = [p for p in ends if lo < p < hi and p < b]
    return min(inner, key=lambda p: (abs(p - mid), p)) if inner else mid


def _cut(text: str, lo: int, hi: int, at: list[int], strength: list[int]) -> int:
    """Where to divide text[lo:hi]: the strongest boundary in the middle half, nearest to the middle;
    else the nearest boundary at all; else a hard cut."""
    mid, quarter = (lo + hi) / 2, (hi - lo) // 4
    i, j = max(bisect_left(at, lo + quarter), bisect_right(at, lo)), min(bisect_right(at, hi - quarter), bisect_left(at, hi))
    if i < j:
        return at[min(range(i, j), key=lambda k: (-strength[k], abs(at[k] - mid), at[k]))]
    i, j = bisect_right(at, lo), bisect_left(at, hi)
    if i < j:
        k = bisect_left(at, mid, i, j)
        return min((at[x] for x in (k - 1, k) if i <= x < j), key=lambda p: (abs(p - mid), p))
    return _hard_cut(text, lo, hi)


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str | None]]:
    """(start, core_start, end, article) of each piece, in order; article None is the text's own.

    text[start:end] has at most ``limit`` code points; the cores text[core_start:end] follow each other
    and make up the whole text. Neighbours share exactly ``overlap`` code points, less only where the
    piece before is shorter. A text of at most ``limit`` is one piece, unless headings divide it.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    marks = [(p, a) for p, a in headings(text)]
    sections = [(0, None)] if not marks or marks[0][0] > 0 else []
    sections += marks
    if len(text) <= limit and len(sections) == 1:
        return [(0, 0, len(text), sections[0][1])] if text else []
    at, strength = boundaries(text)
    core = limit - overlap
    cuts: list[tuple[int, int, str | None]] = []
    for k, (lo, article) in enumerate(sections):
        stack = [(lo, sections[k + 1][0] if k + 1 < len(sections) else len(text))]
        while stack:
            a, b = stack.pop()
            if b - a <= core:
                if a < b:
                    cuts.append((a, b, article))
                continue
            c = _cut(text, a, b, at, strength)
            stack += [(c, b), (a, c)]
    out = []
    for k, (a, b, article) in enumerate(cuts):
        start = a if not k else max(a - overlap, out[-1][0])
        out.append((start, a, b, article))
    return out


def split_rows(df: DataFrame, key: str, text: str, own: str, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """Pieces of every text longer than ``limit``: (key, article, piece_no, start_pos, core_start, end_pos[, piece]).

    ``own`` names the column with the article of the text itself. Null and short texts have no pieces;
    the length is tested in the JVM, so short texts never reach Python. Repeated keys must be merged before.
    """
    types = dict(df.dtypes)
    schema = f"`{key}` {types[key]}, article string, piece_no int, start_pos int, core_start int, end_pos int" + (", piece string" if with_text else "")
    names = [key, "article", "piece_no", "start_pos", "core_start", "end_pos"] + ["piece"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, take = [], []
            for i, (article, content) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for no, (start, core, end, a) in enumerate(split_text(content, limit, overlap)):
                    take.append(i)
                    rows.append((article if a is None else a, no, start, core, end, *([content[start:end]] if with_text else [])))
            cols = list(zip(*rows)) if rows else [()] * (len(names) - 1)
            kinds = [pa.string(), *[pa.int32()] * 4, *[pa.string()] * with_text]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=names)

    long = df.filter(F.length(text) > limit).select(F.col(key), F.col(own).cast("string").alias("own"), F.col(text).alias("content"))
    return long.mapInArrow(run, schema)


def articles_of(df: DataFrame, key: str, text: str, own: str, version: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, article): the articles of every text longer than ``limit``, each once.

    Of a key loaded several times the row of the smallest ``version`` counts (ties: the smallest list of
    articles). The rows of a key meet as lists of articles, so texts are never shuffled.
    """
    types = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for article, content in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                found.append(None if content is None else list(dict.fromkeys(article if a is None else a for *_, a in split_text(content, limit, overlap))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.string()))], names=["k", "v", "articles"])

    rows = df.select(F.col(key).alias("k"), F.col(version).alias("v"), F.col(own).cast("string").alias("own"), F.when(F.length(text) > limit, F.col(text)).alias("content"))
    lists = rows.mapInArrow(run, f"k {types[key]}, v {types[version]}, articles array<string>")
    one = lists.groupBy("k").agg(F.min(F.struct("v", "articles"))["articles"].alias("articles"))
    return one.select(F.col("k").alias(key), F.explode("articles").alias("article"))
