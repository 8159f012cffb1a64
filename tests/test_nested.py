import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gneiss.operators import nested

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-1000, 1000) | st.text(max_size=6), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=5), c, max_size=4), max_leaves=20)


def tree_triples(v, path="", ords=()):
    """Triples by recursion over a parsed value: what the stream must equal."""
    if isinstance(v, dict):
        yield path, list(ords), nested.OBJECT, None
        for k, x in v.items():
            yield from tree_triples(x, nested.child_path(path, k), ords)
    elif isinstance(v, list):
        yield path, list(ords), nested.ARRAY, None
        for i, x in enumerate(v):
            yield from tree_triples(x, nested.element_path(path), (*ords, i))
    else:
        kind = nested.NULL if v is None else nested.BOOLEAN if isinstance(v, bool) else nested.STRING if isinstance(v, str) else nested.NUMBER
        yield path, list(ords), kind, None if v is None else v if isinstance(v, str) else json.dumps(v)


@given(VALUES)
@settings(max_examples=300, deadline=None)
def test_stream_equals_the_parsed_tree(value):
    for text in (json.dumps(value), json.dumps(value, indent=2, ensure_ascii=False)):
        assert list(nested.stream_triples(text)) == list(tree_triples(value))


@given(st.lists(st.tuples(st.sampled_from("abc"), VALUES), max_size=6))
@settings(max_examples=200, deadline=None)
def test_of_repeated_keys_the_last_counts(pairs):
    text = '{"o": {' + ", ".join(f'"{k}": {json.dumps(v)}' for k, v in pairs) + '}, "x": [1, {"a": 2, "a": [3]}]}'
    order = lambda ts: sorted(map(repr, ts))
    assert order(nested.stream_triples(text)) == order(tree_triples(json.loads(text)))


@pytest.mark.parametrize("text", ["", "{", "[1,]", "[1 2]", '{"a" 1}', '{"a":1,}', "nul", "1 2", '"a', "{1:2}", "[,1]", "01", "]", '{"a":}', "NaN", '{"a": Infinity}', "[-Infinity]", '{"a":1 "b":2}', "{:1}", '{"a":1]', '{"a"}', "[}"])
def test_stream_rejects(text):
    with pytest.raises(ValueError):
        list(nested.stream_triples(text))


def test_very_deep_text():
    deep = "[" * 50_000 + "]" * 50_000
    assert sum(1 for _ in nested.stream_triples(deep, {"", "[]"})) == 2
    with pytest.raises(ValueError):
        next(nested.stream_triples("[" * 50_000 + "NaN" + "]" * 50_000))


def test_text_objects():
    inner = json.dumps({"a": [1]})
    assert nested.text_object(json.dumps(inner)) == inner and nested.text_object(inner) == inner
    for text in ('"x"', '"[1]"', json.dumps("{broken"), "7", '"', json.dumps(json.dumps(inner))):
        assert nested.text_object(text) == text


def test_json_tables(spark):
    rows = [
        ("a", '{"claims":[{"text":"x","citation_ids":["p",null,3,"q",""]},7,{"citation_ids":"no"},{"citation_ids":[]}]}'),
        ("a", '{"claims":[{"text":"x","citation_ids":["p",null,3,"q",""]},7,{"citation_ids":"no"},{"citation_ids":[]}]}'),
        ("b", json.dumps(json.dumps({"claims": [{"citation_ids": ["z"]}]}))),
        ("c", '[{"claims":[{"citation_ids":["no"]}]}]'), ("d", None), ("e", "not json"), ("f", ""), ("g", '{"claims":{"citation_ids":["no"]}}'), ("h", '{"claims":[{"citation_ids":["\\ud800"]}]}'),
        (None, '{"claims":[{"citation_ids":["n"]}]}'),
    ]
    df = spark.createDataFrame(rows, "id string, raw string").selectExpr("id", "raw", "1 as path", "2 as record_id")  # clashing names
    t = nested.json_triples(df, "id", "raw", unwrap_text=True)
    strings = t.filter("kind = 'string'")
    got = {(r.record_id, r.pos_1, r.pos_2, r.value) for r in nested.flatten(strings, ["claims[].citation_ids[]"])["claims[].citation_ids[]"].collect()}
    assert got == {("a", 0, 0, "p"), ("a", 0, 3, "q"), ("a", 0, 4, ""), ("b", 0, 0, "z"), ("h", 0, 0, "?"), (None, 0, 0, "n")}
    assert [r.value for r in t.filter("kind = 'invalid'").orderBy("value").collect()] == ["", "not json"]


def test_typed_tables_link_children_to_parents(spark):
    rows = [("r", [{"t": "one", "c": ["x", None, "y"]}, None, {"t": None, "c": None}, {"t": "four", "c": []}]), ("s", None), ("t", [])]
    df = spark.createDataFrame(rows, "id string, claims array<struct<t:string,c:array<string>>>")
    tables = nested.flatten(nested.typed_triples(df, "id", "claims"), ["[].t", "[].c[]"])
    parents = {(r.record_id, r.pos_1, r.t) for r in tables["[]"].collect()}
    assert parents == {("r", 0, "one"), ("r", 1, None), ("r", 2, None), ("r", 3, "four")}
    children = {(r.record_id, r.pos_1, r.pos_2, r.value) for r in tables["[].c[]"].collect()}
    assert children == {("r", 0, 0, "x"), ("r", 0, 1, None), ("r", 0, 2, "y")}
    assert all((c[0], c[1]) in {p[:2] for p in parents} for c in children)


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, raw string")
    assert nested.json_triples(df, "id", "raw").count() == 0


def test_paths_with_signs(spark):
    df = spark.createDataFrame([("a", '{"x.y":[{"[]":"v"}]}')], "id string, raw string")
    paths = nested.observed_paths(nested.json_triples(df, "id", "raw"))
    assert paths == ["x\\.y[].\\[\\]"]
    assert nested.repeated_ancestor(paths[0]) == "x\\.y[]"
