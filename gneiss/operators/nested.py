"""Nested records into flat related tables.

Every record is parsed into a stream of triples (path, ordinals, value). A path names the fields from
the root, ``[]`` standing for "any element of this list"; the ordinals are the positions, from 0, in
the lists passed on the way. Paths are grouped by their deepest list (their repeated ancestor) and each
group is pivoted into one table, keyed by record id and ordinals. A child's ordinals begin with its
parent's, which is the parent-child link.

Typed columns are parsed by one generated Catalyst expression (higher-order functions, one pass, no
Python). JSON text, whose shape isn't known, is parsed by an iterative parser in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIPLE = "struct<path:string,ordinals:array<int>,kind:string,value:string>"
STRING, NUMBER, BOOLEAN, NULL, OBJECT, ARRAY, INVALID = "string", "number", "boolean", "null", "object", "array", "invalid"


def escape_name(name: str) -> str:
    """A field name as part of a path: the characters with a meaning in paths get a backslash, and the
    empty name is written as one before an ``e``."""
    return re.sub(r"([\\.\[\]])", r"\\\1", name) if name else "\\e"


def child_path(path: str, name: str) -> str:
    return f"{path}.{escape_name(name)}" if path else escape_name(name)


def element_path(path: str) -> str:
    return f"{path}[]"


def repeated_ancestor(path: str) -> str:
    """The path up to its last list level; empty for fields of the record itself."""
    at = max((m.end() for m in re.finditer(r"(?<!\\)\[\]", path)), default=0)
    return path[:at]


# --- typed columns -----------------------------------------------------------------------------


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    return NUMBER if isinstance(dtype, T.NumericType) else STRING


def _triple(path: str, ordinals: Column, kind: Column, value: Column) -> Column:
    return F.struct(F.lit(path).alias("path"), ordinals.alias("ordinals"), kind.alias("kind"), value.cast("string").alias("value"))


def _walk(value: Column, dtype: T.DataType, path: str, ordinals: Column, depth: int) -> Column:
    """An array<triple> expression for ``value`` and everything below it."""
    empty = F.expr(f"cast(array() as array<{TRIPLE}>)")
    if isinstance(dtype, T.StructType):
        own = F.array(_triple(path, ordinals, F.when(value.isNull(), NULL).otherwise(OBJECT), F.lit(None)))
        below = [_walk(value.getField(f.name), f.dataType, child_path(path, f.name), ordinals, depth) for f in dtype.fields]
        return F.concat(own, F.when(value.isNull(), empty).otherwise(F.concat(*below))) if below else own
    if isinstance(dtype, T.ArrayType):
        own = F.array(_triple(path, ordinals, F.when(value.isNull(), NULL).otherwise(ARRAY), F.lit(None)))
        each = F.transform(value, lambda x, i: _walk(x, dtype.elementType, element_path(path), F.concat(ordinals, F.array(i.cast("int"))), depth + 1))
        return F.concat(own, F.coalesce(F.flatten(each), empty))
    if isinstance(dtype, T.MapType):
        entries = T.ArrayType(T.StructType([T.StructField("key", dtype.keyType), T.StructField("value", dtype.valueType)]))
        return _walk(F.when(value.isNotNull(), F.map_entries(value)), entries, path, ordinals, depth)
    if isinstance(dtype, T.VariantType):
        raise TypeError("turn variants into JSON text with to_json and use json_triples")
    if isinstance(dtype, T.BinaryType):
        value = F.base64(value)
    return F.array(_triple(path, ordinals, F.when(value.isNull(), NULL).otherwise(_kind(dtype)), value))


def _needed(path: str, wanted: list[str] | None) -> bool:
    return wanted is None or any(w == path or w.startswith(path + ".") or w.startswith(path + "[") or not path for w in wanted)


def _prune(dtype: T.DataType, path: str, wanted: list[str] | None) -> T.DataType:
    """``dtype`` without the fields no wanted path goes through; keeps the scan and the stream narrow."""
    if isinstance(dtype, T.StructType):
        keep = [f for f in dtype.fields if _needed(child_path(path, f.name), wanted) or wanted and path in wanted]
        return T.StructType([T.StructField(f.name, _prune(f.dataType, child_path(path, f.name), wanted)) for f in keep])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_prune(dtype.elementType, element_path(path), wanted))
    return dtype


def typed_triples(df: DataFrame, record_id: str, column: str, wanted: list[str] | None = None) -> DataFrame:
    """(record_id, path, ordinals, kind, value) of every value in a nested typed column.

    Lists and structs, also empty ones, and nulls give a triple of their own (kind array, object,
    null), so nothing that was stored is lost; null ids are kept as null. ``wanted`` limits the paths
    followed. Repeated rows give repeated triples; ``pivot_group`` merges them.
    """
    field = df.schema[column]
    dtype = _prune(field.dataType, "", wanted)
    triples = _walk(F.col(f"`{column}`"), dtype, "", F.expr("cast(array() as array<int>)"), 0)
    return df.select(F.col(f"`{record_id}`").cast("string").alias("record_id"), F.explode(triples).alias("t")).select("record_id", "t.*")


# --- JSON text ---------------------------------------------------------------------------------

_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{}:,])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null))', re.ASCII)


def events(text: str) -> Iterator[tuple[str, object]]:
    """The parts of a JSON text in order: open and close with their bracket, key, string, number, boolean and null
    with their value. ValueError where it isn't JSON (also for NaN and Infinity); depth isn't limited, and
    nothing is kept but the open brackets."""
    at, stack, state, key = 0, [], "item", False
    # States: "first" (an item or the end), "item" (an item), "next" (a comma or the end).
    while True:
        m = _TOKEN.match(text, at)
        if not m:
            break
        at = m.end()
        mark, string, number, word = m.groups()
        if state == "done":
            raise ValueError("more after the value")
        if mark in ("]", "}"):
            if not stack or stack.pop() != mark or state == "item" or key:
                raise ValueError("unbalanced")
            yield "close", mark
            state = "next" if stack else "done"
        elif mark == ",":
            if state != "next":
                raise ValueError("comma")
            state = "item"
        elif state == "next" or mark == ":":
            raise ValueError("order")
        elif stack and stack[-1] == "}" and not key:
            if string is None:
                raise ValueError("key")
            colon = _TOKEN.match(text, at)
            if not colon or colon.group(1) != ":":
                raise ValueError("colon")
            at, key, state = colon.end(), True, "item"
            yield "key", json.loads(string)
        elif mark:
            stack.append("]" if mark == "[" else "}")
            yield "open", mark
            state, key = "first", False
        else:
            if string is not None:
                yield STRING, json.loads(string)
            elif number is not None:
                yield NUMBER, json.dumps(json.loads(number))
            else:
                yield (NULL, None) if word == "null" else (BOOLEAN, word)
            state, key = "next" if stack else "done", False
    if state != "done" or text[at:].strip(" \t\n\r"):
        raise ValueError("no JSON")


def _overridden(text: str) -> set[int]:
    """Numbers of the keys, counted through the text, that the same object has again later. Reads all of the text,
    so ValueError comes before anything is made of it."""
    hidden: set[int] = set()
    keys: list[dict[str, int] | None] = []
    n = 0
    for event, value in events(text):
        if event == "open":
            keys.append({} if value == "{" else None)
        elif event == "close":
            keys.pop()
        elif event == "key":
            if value in keys[-1]:
                hidden.add(keys[-1][value])
            keys[-1][value] = n
            n += 1
    return hidden


def stream_triples(text: str, keep: set[str] | None = None) -> Iterator[tuple[str, list[int], str, str | None]]:
    """(path, ordinals, kind, value) of every value of a JSON text in stored order, without building it; ValueError
    where it isn't JSON. Of repeated keys of an object the last counts. ``keep`` limits the paths given."""
    hidden = _overridden(text)
    paths, ordinals, counters = [""], [], []  # one path, and for lists one counter, per open bracket
    n, skip = 0, 0
    pending = ""
    for event, value in events(text):
        if event == "key":
            if n in hidden and not skip:
                skip = 1
                depth = len(counters)
            pending = value
            n += 1
            if skip and len(counters) > depth:
                pending = ""
            continue
        if event == "close":
            counters.pop()
            if skip and len(counters) == depth:
                skip = 0
                continue
            if not skip:
                paths.pop()
                if value == "]":
                    ordinals.pop()
            continue
        if skip:
            if event == "open":
                counters.append(value)
            elif len(counters) == depth:
                skip = 0
            continue
        inside = counters[-1] if counters else None
        if inside == "[":
            ordinals[-1] += 1
            path = element_path(paths[-1])
        else:
            path = child_path(paths[-1], pending) if inside else ""
        if keep is None or path in keep:
            yield path, list(ordinals), (OBJECT if value == "{" else ARRAY) if event == "open" else event, None if event == "open" else value
        if event == "open":
            counters.append(value)
            paths.append(path)
            if value == "[":
                ordinals.append(-1)


def text_object(text: str) -> str:
    """If the text is a JSON string that itself holds a JSON object, the text of that object; else the text."""
    if text.lstrip(" \t\n\r")[:1] != '"':
        return text
    try:
        (event, inner), *more = events(text)
        if next(events(inner)) == ("open", "{"):
            _overridden(inner)
            return inner
    except (ValueError, StopIteration):
        pass
    return text


def _valid(text: str) -> str:
    """JSON can escape halves of surrogate pairs, which no UTF-8 column can hold."""
    return text.encode("utf-8", "replace").decode("utf-8")


def _triples_or_invalid(text: str, keep: set[str] | None) -> Iterator[tuple[str, list[int], str, str | None]]:
    try:
        yield from stream_triples(text, keep)
    except ValueError:  # comes before the first triple
        if keep is None or "" in keep:
            yield "", [], INVALID, text


def json_triples(df: DataFrame, record_id: str, column: str, unwrap_text: bool = False, wanted: list[str] | None = None) -> DataFrame:
    """Triples of a column of JSON text of any shape and depth.

    A null column gives no triples; text that isn't JSON gives one triple of kind ``invalid`` at the
    root with the text as value. With ``unwrap_text`` a string that holds a JSON object is taken as
    that object. Of repeated object keys the last counts, as in JSONB. ``wanted`` keeps only triples of
    these paths.
    """
    keep = None if wanted is None else set(wanted)
    schema = "record_id string, path string, ordinals array<int>, kind string, value string"
    arrow = pa.schema([("record_id", pa.string()), ("path", pa.string()), ("ordinals", pa.list_(pa.int32())), ("kind", pa.string()), ("value", pa.string())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None:
                    continue
                for path, ords, kind, value in _triples_or_invalid(text_object(text) if unwrap_text else text, keep):
                    for to, x in zip(out, (rid, path, ords, kind, value if value is None else _valid(value))):
                        to.append(x)
                    if len(out[0]) > 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, arrow)], schema=arrow)
                        out = ([], [], [], [], [])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, arrow)], schema=arrow)

    src = df.select(F.col(f"`{record_id}`").cast("string").alias("record_id"), F.col(f"`{column}`").cast("string").alias("text"))
    return src.mapInArrow(parse, schema)


# --- tables ------------------------------------------------------------------------------------


def pivot_group(triples: DataFrame, ancestor: str, leaves: dict[str, str]) -> DataFrame:
    """One flat table: the values of ``leaves`` (path to column name) below one repeated ancestor.

    Rows are keyed by record_id and pos_1..pos_n, one position per list level of ``ancestor``. The
    aggregation merges the triples of an element and those of repeated records alike; all triples of a
    record come from one task, so map-side combining leaves one row per element to shuffle.
    An element whose wanted leaves are all absent or null is kept when it has a triple of its own.
    """
    depth = len(re.findall(r"(?<!\\)\[\]", ancestor))
    wrong = [p for p in leaves if repeated_ancestor(p) != ancestor]
    if wrong:
        raise ValueError(f"not below {ancestor!r}: {wrong}")
    mine = triples.filter(F.col("path").isin([ancestor, *leaves]))
    named = [F.max(F.when(F.col("path") == p, F.col("value"))).alias(c) for p, c in leaves.items()]
    keys = ["record_id", *[f"pos_{i + 1}" for i in range(depth)]]
    flat = mine.select("record_id", *[F.get("ordinals", F.lit(i)).cast("bigint").alias(f"pos_{i + 1}") for i in range(depth)], "path", "value")
    return flat.groupBy(*keys).agg(*named)


def flatten(triples: DataFrame, paths: list[str]) -> dict[str, DataFrame]:
    """All tables for a list of leaf paths: repeated ancestor to table; columns are named by the
    part of the path below the ancestor (``value`` for the elements of a list of scalars)."""
    groups: dict[str, dict[str, str]] = {}
    for p in paths:
        a = repeated_ancestor(p)
        groups.setdefault(a, {})[p] = p[len(a):].lstrip(".") or "value"
    return {a: pivot_group(triples, a, leaves) for a, leaves in groups.items()}


def observed_paths(triples: DataFrame) -> list[str]:
    """The leaf paths that occur; their number is that of the schema, not of the data."""
    leaf = triples.filter(~F.col("kind").isin(OBJECT, ARRAY, INVALID))
    return sorted(r[0] for r in leaf.select("path").distinct().collect())


def rebuild_claims(triples: DataFrame) -> DataFrame:
    """(record_id, rebuilt): the list of claims that the triples of one were made of, null where it was null.

    The inverse of ``typed_triples`` for array<struct<text, citation_ids array>>: null elements, null
    texts, null and empty lists and null citations come back where they were. Lists of one record are
    gathered, never those of several. Repeated triples of a record are merged.
    """
    p, one, two = F.col("path"), F.get("ordinals", F.lit(0)), F.get("ordinals", F.lit(1))
    rows = triples.select("record_id", "path", one.alias("c"), two.alias("i"), "kind", "value").distinct()
    at = lambda path, what: F.max(F.when(p == path, what))
    item = F.when(p == "[].citation_ids[]", F.struct("i", "value"))
    claims = rows.filter("c is not null").groupBy("record_id", "c").agg(
        at("[]", F.col("kind")).alias("kind"), at("[].text", F.col("value")).alias("text"), at("[].citation_ids", F.col("kind")).alias("list"), F.array_sort(F.collect_list(item)).alias("items")
    )
    cited = F.when(F.col("list") == ARRAY, F.transform("items", lambda x: x["value"]))
    one_claim = F.when(F.col("kind") == OBJECT, F.struct(F.col("text"), cited.alias("citation_ids")))
    lists = claims.select("record_id", "c", one_claim.alias("claim")).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("c", "claim"))).alias("l"))
    roots = rows.filter(p == "").groupBy("record_id").agg(F.max("kind").alias("root"))
    both = roots.join(lists, "record_id", "left")
    empty = F.expr("cast(array() as array<struct<text:string,citation_ids:array<string>>>)")
    return both.select("record_id", F.when(F.col("root") == ARRAY, F.coalesce(F.transform("l", lambda x: x["claim"]), empty)).alias("rebuilt"))
