import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholion.operators import answers as A
from scholion.operators import chunking as H
from scholion.operators import doctree as D

blocks = st.lists(st.sampled_from(["one two three.", "Four five. Six seven eight.", "$$ a b c d e f $$", "x", "", "word " * 9]), max_size=14).map("\n\n".join)


@settings(max_examples=200, deadline=None)
@given(blocks, st.integers(3, 12))
def test_pack_spans(text, most):
    spans = D.pack_spans(text, most, 0.3)
    if H.word_count(text) <= most:
        assert spans == [(0, len(text), H.word_count(text))]
        return
    # every word is in a piece, pieces go forward, and only a block or sentence over the limit makes a piece over it
    covered = set()
    for (s, e, n), nxt in zip(spans, [*spans[1:], (len(text) + 1, len(text) + 1, 0)]):
        assert s < nxt[0] and e < nxt[1] or nxt[2] == 0
        assert n >= H.word_count(text[s:e]) or n == H.word_count(text[s:e])
        covered.update(range(s, e))
        if n > most:
            assert "\n\n" not in text[s:e].strip()
    assert all(set(range(m.start(), m.end())) <= covered for m in re.finditer(r"\w+|[^\w\s]+", text))


ITEMS = "doc string, pos int, label string, layer string, text string, orig string, level int, page int"
CELLS = "doc string, number int, page int, row int, col int, text string"
CAPTIONS = "doc string, kind string, number int, pos int, page int, text string"


@pytest.fixture(scope="module")
def tree(spark):
    items = [
        ("d", 1, "text", None, "Before any header.", None, None, 1), ("d", 2, "Section-Header", None, "1 Abstract", None, 1, 1), ("d", 3, "text", None, " First\n part. ", None, None, 1), ("d", 4, "page_footer", "furniture", "Journal 12", None, None, 1),
        ("d", 5, "text", None, "", "From the original.", None, 2), ("d", 6, "section_header", None, "Methods", None, 1, 2), ("d", 7, "section_header", None, "Results", None, 1, 3), ("d", 8, "formula", None, "x = {a + b}^2 / [c] = y * {d + e}_3 = z^2", None, None, 3), ("d", 9, "text", None, None, None, None, 3), ("e", 1, "text", None, "Alone.", None, None, None),
    ]
    cells = [("d", 7, 2, 1, 1, "b2"), ("d", 7, 2, 1, 0, "b1"), ("d", 7, 2, 0, 0, " a "), ("d", 7, 2, 0, 1, " "), ("d", 8, 3, 0, 0, None), ("e", 1, None, 0, 0, "no page")]
    captions = [("d", "table", 7, 0, 2, "Table  1"), ("d", "figure", 3, 1, 3, "second"), ("d", "figure", 3, 0, 3, "first"), ("d", "figure", 4, 0, 3, " ")]
    return spark.createDataFrame(items, ITEMS), spark.createDataFrame(cells, CELLS), spark.createDataFrame(captions, CAPTIONS)


def test_tree_sections(tree):
    items, cells, captions = tree
    assert [tuple(r) for r in D.table_blocks(cells, captions).collect()] == [("d", 2, "[TABLE]\nTable 1\na\nb1 | b2")]
    got = {(r["doc"], r["section"]): (r["title"], r["page"], r["text"]) for r in D.tree_sections(items, D.table_blocks(cells, captions)).collect()}
    assert got == {
        ("d", 0): (None, 1, "Before any header."), ("d", 1): ("1 Abstract", 2, "First part.\n\nFrom the original.\n\n[TABLE]\nTable 1\na\nb1 | b2"),
        ("d", 3): ("Results", 3, "x = {a + b}^2 / [c] = y * {d + e}_3 = z^2"), ("e", 0): (None, None, "Alone."),
    }


def test_tree_chunks(spark):
    sections = spark.createDataFrame([("d", 0, "A", 1, 1, "text", "short one."), ("d", 1, "B", 1, 2, "text", "Word one. " * 500), ("d", 2, "C", None, None, None, "  "), ("e", 0, None, None, None, None, "other.")], "doc string, section long, title string, level int, page int, label string, text string")
    got = D.chunk_sections(sections).orderBy("doc", "chunk_index").collect()
    assert [r["chunk_id"] for r in got if r["doc"] == "e"] == ["e::C0"] and all(r["token_count"] <= 600 for r in got) and [r["chunk_index"] for r in got if r["doc"] == "d"] == list(range(len(got) - 1))
    assert got[1]["char_start"] == len("short one.") + 2 and got[0]["title"] == "A" and {r["title"] for r in got[1:-1]} == {"B"} and all(("Word one. " * 500)[r["char_start"] - 12 : r["char_end"] - 12] == r["text"] for r in got[1:-1])


def test_evidence(tree):
    items, cells, captions = tree
    got = {(r["kind"], r["number"]): (r["title"], r["text"].split("\n\n")[1]) for r in D.evidence_chunks(items, cells, captions, ("table", "figure", "formula")).where("doc = 'd'").collect()}
    assert got == {("table", 7): ("1 Abstract / Table Evidence", "Table 1\na\nb1 | b2"), ("figure", 3): ("Results / Figure Evidence", "first second"), ("formula", 8): ("Results / Formula Evidence", "x = {a + b}^2 / [c] = y * {d + e}_3 = z^2")}


def test_key_sections(tree):
    got = {(r["doc"], r["part"]): r["text"] for r in D.key_sections(tree[0].withColumn("label", F.lower(F.regexp_replace("label", "-", "_")))).collect()}
    assert got == {("d", "abstract"): " First\n part. ", ("d", "full_text"): "Before any header.\n\n First\n part. ", ("e", "full_text"): "Alone."}


def test_packed_paragraphs(spark):
    rows = [("d", 1, "Intro", 1, "a b c"), ("d", 2, None, None, "d e"), ("d", 3, "INTRO ", 1, "f g h i"), ("d", 4, "Next", 1, "j"), ("d", 5, "Next", 2, "k"), ("d", 6, "Next", 2, "Corresponding author: X"), ("d", 7, "Next", 2, "One two three. Four five six. Seven eight nine ten."), ("e", 1, None, None, None)]
    df = spark.createDataFrame(rows, "doc string, pos int, title string, page int, text string")
    got = [tuple(r)[2:5] for r in D.packed_paragraphs(df, 6).orderBy("doc", "number").collect()]
    assert got == [("Intro", 1, "a b c\n\nd e"), ("Intro", 1, "f g h i"), ("Next", 1, "j"), ("Next", 2, "k"), ("Next", 2, "One two three."), ("Next", 2, "Four five six."), ("Next", 2, "Seven eight nine ten.")]


def test_tei_sections(spark):
    df = spark.createDataFrame([(1, " Sum. ", [("One", "body"), ("Two", " ")]), (2, None, None)], "id int, abstract string, sections array<struct<title:string,content:string>>")
    assert [tuple(r) for r in D.tei_sections(df, "id").select("doc", "section", "title", "label", "text").orderBy("section").collect()] == [(1, 0, "Abstract", "abstract", "Sum."), (1, 1, "One", "section", "body")]


def test_evidence_links(spark):
    schema = "doc string, id int, page int, section string"
    e = spark.createDataFrame([("d", 1, 3, "Results / Table Evidence"), ("d", 2, None, "Nothing"), ("d", 3, None, None)], schema)
    t = spark.createDataFrame([("d", 10, 3, "Methods"), ("d", 11, 4, "RESULTS"), ("d", 12, 9, "Results and discussion"), ("d", 13, 5, None), ("d", 14, None, "results"), ("x", 15, 3, "Results")], schema)
    assert [tuple(r) for r in H.evidence_links(e, t).orderBy("rank").collect()] == [("d", 1, 11, 5.0, 1), ("d", 1, 14, 4.0, 2), ("d", 1, 10, 3.0, 3)]


def test_contexts_read_back(spark):
    papers = spark.createDataFrame([(1, 1, "p", "T | x", 2001, None, None), (1, 2, "q", None, None, "10.1/x", "C")], "query_id int, rank int, paper string, title string, year int, doi string, citation string")
    chunks = spark.createDataFrame([(1, 1, "q", "q::C0", "", "One SOURCE."), (1, 2, "z", "z::C9", "Body", None)], "query_id int, rank int, paper string, chunk_id string, section string, text string")
    c = A.assembled_context(papers, chunks)
    r = c.select("context", "papers", "chunks", A.context_papers("context").alias("p"), A.context_chunks("context").alias("c"), A.context_legend("context").alias("l"), A.context_passages("context").alias("t"), A.context_sources("context").alias("s")).first()
    assert r["context"] == "--- REFERENCE LEGEND ---\nPAPER ID: 0 | Title: T | x (2001) | DOI: N/A | APA: N/A\nPAPER ID: 1 | Title:  (N/A) | DOI: 10.1/x | APA: C\n\n--- RESEARCH CONTENT ---\nSOURCE_ID: 1\nCHUNK_ID: q::C0\nSECTION: Main text\nCONTENT: One SOURCE.\n\nSOURCE_ID: UNKNOWN\nCHUNK_ID: z::C9\nSECTION: Body\nCONTENT: "
    assert r["c"] == ["q::C0", "z::C9"] and [x["number"] for x in r["l"]] == [0, 1] and r["l"][1]["doi"] == "10.1/x" and len(r["t"]) == 2 and r["s"] == [1] and "1" in r["p"] and "UNKNOWN" in r["p"]
    none = spark.createDataFrame([("plain",), (None,)], "x string").select(A.context_legend("x").alias("l"), A.context_passages("x").alias("t"), A.context_sources("x").alias("s")).collect()
    assert all(r["l"] == [] and r["t"] == [] and r["s"] == [] for r in none)


def test_claims(spark):
    a = spark.createDataFrame([(1, "First said. Cats purr (cite:p) and purr (cite:p|c1|2|9)! Dogs (cite:p)."), (2, "none"), (3, None)], "id int, answer string")
    got = {(r["id"], r["source"]): (r["claims"], r["first"], r["longest"], r["confidence"]) for r in A.claims_by_source(a).collect()}
    assert got[1, "p"][:3] == (2, 22, "Cats purr (cite:p) and purr (cite:p|c1|2|9)! Dogs") or got[1, "p"][0] == 2 and got[1, "p"][1] == 22
    assert got[1, "p"][3] == pytest.approx(0.8 - 0.1 + 0.05) or got[1, "p"][3] == pytest.approx(0.85)
    refs = a.select(F.explode(A_scoped("answer")).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in refs] == [("p", "c1", 2, 9, 40, "(cite:p|c1|2|9)")]


def A_scoped(c):
    from scholion.functions.text import scoped_citations

    return scoped_citations(c)


def test_query_plans(spark):
    rows = [('{"clarified_question": " Q ", "hybrid_queries": ["a", " ", "b"], "intent": "Comparison", "skip": ["X"], "has_doi": true, "filters": {"y": 1}}',), ("not json",), ('{"hybrid_queries": "x", "intent": 5, "skip": "A, b", "has_doi": "no"}',), (None,), ("[]",)]
    got = [r["p"] for r in spark.createDataFrame(rows, "a string").select(A.query_plan("a", F.lit("asked")).alias("p")).collect()]
    assert (got[0]["question"], got[0]["queries"], got[0]["intent"], got[0]["skip"], got[0]["has_doi"], got[0]["filters"]) == ("Q", ["a", "b"], "comparison", ["x"], True, '{"y":1}')
    assert all((p["question"], p["queries"], p["intent"]) == ("asked", [], "comprehensive_search") for p in got[1:]) and got[2]["skip"] == ["a", "b"] and not got[2]["has_doi"]


def test_gibberish(spark):
    words = spark.createDataFrame([("lakes",), ("are",), ("deep",), ("cat",)], "word string")
    rows = {1: None, 2: "hi", 3: "Thanks", 4: "USER123", 5: "asd", 6: "cat", 7: "jfbdskjbfkbskf qwrtp", 8: "deep lakes are deep", 9: "aaaaaaa zzzzz", 10: "  "}
    got = {r["id"]: r["gibberish"] for r in A.gibberish(spark.createDataFrame(list(rows.items()), "id int, t string"), "id", "t", words).collect()}
    assert got == {1: True, 2: True, 3: True, 4: True, 5: True, 6: False, 7: True, 8: False, 9: True, 10: True}
