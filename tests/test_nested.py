import json

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from scholion.operators.nested import flatten_child, flatten_topics, nested_keys, topic_lists, walk

SCHEMA = "rec_id long, authors array<struct<name:string,institutions:array<struct<id:string,type:string>>>>, openalex_data string, s2_fields_of_study array<struct<category:string,source:string>>"

author = st.one_of(st.none(), st.fixed_dictionaries({"name": st.one_of(st.none(), st.text(max_size=3)), "institutions": st.one_of(st.none(), st.lists(st.one_of(st.none(), st.fixed_dictionaries({"id": st.one_of(st.none(), st.text(max_size=3))})), max_size=3))}))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(author, max_size=3)), max_size=5))
def test_walk_equals_loops(rows):
    kind = pa.list_(pa.struct([("name", pa.string()), ("institutions", pa.list_(pa.struct([("id", pa.string())])))]))
    flat, row, (p0, p1) = walk(pa.array(rows, kind), ["institutions"])
    want = [(r, i, j, x) for r, authors in enumerate(rows) for i, a in enumerate(authors or []) for j, x in enumerate((a or {}).get("institutions") or [])]
    assert [(int(r), int(i), int(j), x) for r, i, j, x in zip(row, p0, p1, flat.to_pylist())] == want


def test_walk_of_a_slice():
    a = pa.array([[{"v": [1]}], [{"v": [2, 3]}, {"v": None}], None], pa.list_(pa.struct([("v", pa.list_(pa.int64()))])))[1:]
    flat, row, (p0, p1) = walk(a, ["v"])
    assert flat.to_pylist() == [2, 3] and list(row) == [0, 0] and list(p0) == [0, 0] and list(p1) == [0, 1]


def test_topic_shapes():
    t = {"id": "T1", "display_name": "x", "score": "0.5", "field": {"display_name": "f", "domain": {"display_name": "d"}}}
    docs = [
        json.dumps({"topics": [None, t]}), json.dumps({"topics": t}), json.dumps({"Topics": {"count": 1, "results": [t]}}), json.dumps({"topics": {"0": None, "1": t}}), json.dumps({"data": {"topics": json.dumps([t])}}),
        "﻿" + json.dumps({"topics": [t]}), str({"topics": [t, None]}), json.dumps({"topics": {}}), json.dumps({"topics": None}), "{'topics': [", "", None, "[]", "7",
    ]
    got = [[x and x["id"] for x in r] for r in topic_lists(pa.array(docs, pa.string())).to_pylist()]
    assert got == [[None, "T1"], ["T1"], ["T1"], [None, "T1"], ["T1"], ["T1"], ["T1", None], [], [], [], [], [], [], []]


def test_nested_keys(spark):
    rows = [
        (1, [("a", [("https://x.example/i12/", "e"), None, ("I12", "e")]), None, ("b", None), ("c", [("openalex: I9", "e"), (" I8", "e"), ("n/a", "e")])], json.dumps({"topics": {"id": "t5"}}), [("Physics", None), None, ("", "x")]),
        (1, [("a", [("I12", "e")])], None, None), (2, None, "broken", []), (3, [], "", None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("rec_id", "rec_id")
    got = sorted(tuple(r) for r in nested_keys(df).collect())
    assert got == [(1, "institution", 0, "I12"), (1, "institution", 3, "I8"), (1, "institution", 3, "I9"), (1, "s2_field", 0, "Physics"), (1, "topic", 0, "T5")]


def test_empty_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nested_keys(empty).count() == 0 and flatten_topics(empty, ["rec_id"]).count() == 0
    df = spark.createDataFrame([(1, [("a", None)], None, None)], SCHEMA).selectExpr("*", "1 as pos_0", "2 as entity", "'x' as id", "3 as child_key")
    assert nested_keys(df).count() == 0
    assert [tuple(r) for r in flatten_child(df, ["rec_id"], "authors", [], {"name": "string"}).collect()] == [(1, 0, "a")]


def test_places_and_depths_without_bounds(spark):
    """Places far apart, many wrapping objects and encodings within encodings are all read."""
    import json

    far = json.dumps({"topics": {"20000": {"id": "T1"}, "3": {"id": "T2"}}})
    deep = {"topics": [{"id": "T3"}]}
    for i in range(7):
        deep = {("data", "result", "record", "work")[i % 4]: deep}
    coded = json.dumps([{"id": "T4"}])
    for _ in range(6):
        coded = json.dumps(coded)
    rows = [(1, far), (2, json.dumps(deep)), (3, json.dumps({"topics": coded})), (4, json.dumps({"data": {"x": 1}})), (5, "[" * 50_000 + '"topics"')]
    got = sorted((r["k"], r["pos_0"], r["id"]) for r in flatten_topics(spark.createDataFrame(rows, "k int, openalex_data string"), ["k"]).collect())
    assert got == [(1, 3, "T2"), (1, 20000, "T1"), (2, 0, "T3"), (3, 0, "T4")]
