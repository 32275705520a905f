import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltworks.functions.jsonstream import Incomplete, events
from siltworks.operators.shred import FlatTable, NestedColumn, NestedDoc, column_triples, seen_paths, shred, tables_of, to_triples

values = st.recursive(st.none() | st.booleans() | st.integers(-9, 99) | st.text(max_size=4), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=3), c, max_size=3), max_leaves=12)


def walk(v, path="", pos=()):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(v), "number")
    yield path, pos, kind
    if isinstance(v, list):
        for i, x in enumerate(v):
            yield from walk(x, path + "[]", (*pos, i))
    if isinstance(v, dict):
        for k, x in v.items():
            yield from walk(x, f"{path}.{k}" if path else k, pos)


@settings(max_examples=150, deadline=None)
@given(values.filter(lambda v: not isinstance(v, str)))
def test_events_are_those_of_a_whole_parse(v):
    assert [(p, o, k) for p, o, _, k, _ in events(json.dumps(v))] == list(walk(v))


@pytest.mark.parametrize("bad", ["", "{", '{"a": 1,}', "[1 2]", "{} {}", '{"a" 1}', "[1,]", '{"a": tru}', "01", '"\x01"', "[}", '{"a": [1}'])
def test_incomplete_texts(bad):
    with pytest.raises(Incomplete):
        events(bad)


def test_last_of_repeated_names_counts_and_a_held_text_is_opened_once():
    assert [(p, v) for p, _, _, _, v in events('{"a": [1], "b": 2, "a": 3}')] == [("", None), ("b", "2"), ("a", "3")]
    inner = json.dumps({"a": 1})
    assert events(json.dumps(inner)) == events(inner)
    assert events(json.dumps(json.dumps(inner)))[0][3] == "string"


def test_tables_of_deep_records(spark):
    deep = {"q": {"m": {"x.y": [{"ids": ["1", "2"]}, None, {}], "": 3, "z": None}}, "l": [{"n": "a", "c": ["u", None, ""]}, None, {"n": None, "c": []}]}
    rows = [(1, json.dumps(deep)), (2, None), (3, '{"l": [{"n": "b"'), (4, "{}"), (5, json.dumps(json.dumps({"l": [{"n": "é"}]})))]
    df = spark.createDataFrame(rows, "id bigint, body string")
    t = shred(df, F.col("id"), [NestedDoc("d", F.col("body"), maps=("q.m",))], {
        "l": FlatTable("d", "l[]", {"n": "n"}), "c": FlatTable("d", "l[].c[]", {"c": ""}),
        "m": FlatTable("d", "q.m{}", nulls=True), "h": FlatTable("d", "q.m{}[]", lists={"ids": "ids"}),
    })
    got = lambda n, *c: sorted(tuple(r) for r in t[n].select("record", "pos", *c).collect())
    assert got("l", "n") == [(1, [0], "a"), (1, [2], None), (5, [0], "é")]
    assert got("c", "c") == [(1, [0, 0], "u"), (1, [0, 2], "")]
    assert got("m", "name") == [(1, [0], "x.y"), (1, [1], ""), (1, [2], "z")]
    assert got("h", "ids") == [(1, [0, 0], ["1", "2"]), (1, [0, 2], [])]


def test_empty_input(spark):
    df = spark.createDataFrame([], "id bigint, body string")
    t = shred(df, F.col("id"), [NestedDoc("d", F.col("body"))], {"l": FlatTable("d", "l[]", {"n": "n"})})
    assert t["l"].count() == 0


@settings(max_examples=100, deadline=None)
@given(values.filter(lambda v: not isinstance(v, str)), st.data())
def test_wanted_paths_are_those_of_all_events(v, data):
    every = events(json.dumps(v, indent=1))
    wanted = frozenset(data.draw(st.sets(st.sampled_from([e[0] for e in every]))))
    assert events(json.dumps(v, indent=1), wanted=wanted) == [e for e in every if e[0] in wanted]


@settings(max_examples=100, deadline=None)
@given(values.filter(lambda v: not isinstance(v, str)), st.integers(0, 40))
def test_a_cut_text_is_incomplete_also_where_nobody_looks(v, n):
    text = json.dumps({"a": v, "b": [1]})
    with pytest.raises(Incomplete):
        events(text[: -1 - n % (len(text) - 1)], wanted=frozenset(["b[]"]))


NESTED = "id bigint, body struct<l: array<struct<n: string, c: array<string>, k: double, e: struct<f: array<boolean>>>>, m: map<string, array<int>>>"


def test_columns_and_their_json_give_the_same_triples(spark):
    rows = [(1, {"l": [{"n": "a", "c": ["u", None, ""], "k": 2.5, "e": {"f": [True, None]}}, None, {"n": None, "c": None, "k": None, "e": None}], "m": {"x.y": [1, None], "": [], "z": None}}), (2, None), (3, {"l": [], "m": None}), (1, {"l": None, "m": {}})]
    df = spark.createDataFrame(rows, NESTED)
    key = lambda r: json.dumps(r.asDict())
    text = F.to_json(F.struct("body"), {"ignoreNullFields": "false"})
    by_text = to_triples(df, F.col("id"), [NestedDoc("d", text, maps=("body.m",))]).where("path <> ''").drop("part")
    by_column = column_triples(df, F.col("id"), [NestedColumn("d", "body")]).drop("part")
    assert sorted(map(key, by_column.collect())) == sorted(map(key, by_text.collect()))
    wanted = {"body.l[].e.f[]", "body.m{}"}
    some = column_triples(df, F.col("id"), [NestedColumn("d", "body")], {"d": {p: [p] for p in wanted}}).drop("part")
    assert sorted(map(key, some.collect())) == sorted(key(r) for r in by_text.collect() if r["path"] in wanted)
    assert seen_paths(by_column) == [("d", p) for p in ("body", "body.l", "body.l[]", "body.l[].c", "body.l[].c[]", "body.l[].e", "body.l[].e.f[]", "body.l[].k", "body.l[].n", "body.m", "body.m{}", "body.m{}[]")]


def test_paths_fall_into_tables_by_repeated_ancestor():
    t = tables_of([("d", "a[].n"), ("d", "a[].e.f"), ("d", "a[].c[]"), ("d", "m{}"), ("d", "m{}[].ids[]"), ("d", "plain")], fold=["m{}[].ids[]"], nulls=["m{}"])
    assert t == {
        "d:a[]": FlatTable("d", "a[]", {"n": "n", "e.f": "e.f"}), "d:a[].c[]": FlatTable("d", "a[].c[]", {"value": ""}),
        "d:m{}": FlatTable("d", "m{}", {"value": ""}, nulls=True), "d:m{}[]": FlatTable("d", "m{}[]", lists={"ids": "ids"}),
    }
