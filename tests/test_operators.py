import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholion.functions import score as S
from scholion.functions import text as X
from scholion.functions.scorers import best_tags, embedding, rerank_score, tag_scores
from scholion.operators import chunking as H
from scholion.operators import context as C
from scholion.operators import evaluate as E
from scholion.operators import graph as G
from scholion.operators import ingest as I
from scholion.operators.filters import Filters, apply_filters
from scholion.operators.pipelines import sufficient, virtual_chunks


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("f", "x", "y"),
    [
        (X.normalize_doi, "https://doi.org/10.1234/AbC/", "10.1234/abc"), (X.normalize_doi, "doi:10.1234/x", "10.1234/x"), (X.normalize_doi, "10.12/x", None), (X.normalize_doi, None, None), (X.extract_arxiv, "see arXiv:2101.00001v2", "2101.00001v2"), (X.extract_arxiv, "10.48550/arXiv.1706.03762.pdf", "1706.03762"), (X.extract_arxiv, "1706.03762v3", "1706.03762v3"), (X.extract_arxiv, "hep-th/9901001", "hep-th/9901001"), (X.extract_arxiv, "none", None), (X.extract_arxiv, "https://arxiv.org/pdf/1706.03762v1.pdf?x=1", "1706.03762v1"), (X.extract_arxiv, "https://arxiv.org/abs/hep-th/9901001", "hep-th/9901001"),
        (X.normalize_issn, "1234-567x", "1234567X"), (X.normalize_issn, "12", None), (X.normalize_title, "Zürich,  É!", "zürich é"), (X.surname, " Ada  Lovelace ", "lovelace"), (X.surname, "", None), (X.sentences, "A b. C d?  E", ["A b.", "C d?", "E"]),
        (X.vowel_ratio, "aeiou", 1.0), (X.vowel_ratio, "", 0.0), (X.vowel_ratio, "xy", 1.0), (X.shannon_entropy, "aabb", 1.0), (X.shannon_entropy, "", 0.0), (X.looks_like_identifier, "USER123", True), (X.looks_like_identifier, "hello", False),
        (X.citation_markers, "a (cite:3) b (cite: P1)", ["3", "P1"]), (X.numeric_citations, "x [2] [12]", [2, 12]), (X.repaired_encoding, "ﬁeld x​", "field x"), (X.normalize_target, "10.1/x", "https://doi.org/10.1/x"), (X.normalize_target, "a.org", "https://a.org"),
        (X.extract_dois, "See 10.1234/Ab.C, and (10.1234/ab.c).", ["10.1234/ab.c"]), (X.denied_reason, "Please log in", "Unknown (inspect headers/body snippet)"), (X.denied_reason, "reCAPTCHA, then subscribe", "CAPTCHA or human verification required"), (X.denied_reason, "Checked by Cloudflare: captcha", "Cloudflare bot/challenge protection"), (X.is_section_header, "2.1 Methods", True), (X.is_section_header, "We then went home.", False), (X.is_section_header, "Results: A, B (C)", True), (X.is_section_header, "ab", False), (X.is_section_header, "A" * 121, False), (X.is_formula, "$$x$$", False), (X.is_formula, "x = {a + b}^2 / [c] = y " * 2, True), (X.is_formula, "x = y" + " plain words" * 10, False), (X.clean_noise, " a\0b \n c Please cite this article as: ", "ab c"), (X.is_boilerplate, "Corresponding author: X", True), (X.is_boilerplate, " — * ", True), (X.is_boilerplate, None, True), (X.is_boilerplate, "Tel +49 1", True), (X.is_boilerplate, "Text", False), (X.plain_string, " A.B,  C: d; ", "ab c d"), (X.section_key, "Results / Table Evidence", "results"), (X.marker_numbers, "(cite:12) (cite:2) (cite:2) (cite:x)", [2, 12]),
    ],
)
def test_text_functions(spark, f, x, y):
    got = one(spark, x, f)
    assert got == pytest.approx(y) if isinstance(y, float) else got == y


def test_first_wins_and_ids(spark):
    df = spark.createDataFrame([(["A", "a", None, "B"], {"DOI": "https://doi.org/10.1234/X", "doi": "10.1/y", "CorpusId": "7"})], "v array<string>, m map<string,string>")
    r = df.select(X.first_wins(F.col("v")).alias("v"), X.canonical_ids(F.col("m")).alias("m")).first()
    assert r["v"] == ["A", "B"] and r["m"] == {"doi": "10.1234/x", "corpus_id": "7"}


def test_scores_of_nulls(spark):
    df = spark.createDataFrame([(None, None, None, None)], "c int, y int, f double, q string")
    r = df.select(S.citation_quality(F.col("c"), F.col("y"), F.col("f"), F.lit(0), F.lit(None).cast("boolean"), 2025).alias("a"), S.paper_rank(F.col("f"), F.col("c"), F.col("q")).alias("b"), S.author_reputation(F.col("c"), F.col("c"), F.col("c")).alias("d"), S.conflict(F.col("c"), F.col("c")).alias("e"), S.institution_score(*[F.col("c")] * 7).alias("g")).first()
    assert (r["a"], r["b"], r["d"], r["e"], r["g"]) == (0.0, 0.0, 20.0, False, 0.0)


def test_low_relevance_damps_authority(spark):
    df = spark.range(1)
    got = df.select(S.paper_rank(F.lit(0.15), F.lit(9999), F.lit("q1")).alias("s")).first()["s"]
    assert got == pytest.approx(0.7 * 15 + 0.3 * (70 + 30) * 15 / 30)


def test_filters_parse():
    f = Filters.parse({"minCitations": 0, "min_citation_count": None, "author": " ", "field_of_study": "Physics", "yearFrom": "2001"})
    assert f.min_citations == 0 and f.author is None and f.fields == ("Physics",) and f.year_from == 2001 and Filters.parse(None) == Filters()


def test_filters_apply(spark):
    p = spark.createDataFrame([(1, 2000, "A 100%", 3, ["Physics"]), (2, 2010, "B", None, None), (3, None, None, 0, ["Bio"])], "rec_id int, year int, venue string, citation_count int, fields_of_study array<string>")
    ids = lambda **k: sorted(r["rec_id"] for r in apply_filters(p, Filters(**k)).collect())
    assert ids() == [1, 2, 3] and ids(min_citations=0) == [1, 3] and ids(venue="100%") == [1] and ids(fields=("phys", "bio")) == [1, 3] and ids(year_from=2005) == [2]


def test_ir_metrics_by_hand(spark):
    run = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 5), (1, "c", 3), (3, "z", 1)], "query_id int, key string, rank int")
    qrels = spark.createDataFrame([(1, "b", 1), (1, "d", 1), (2, "x", 1)], "query_id int, key string, rel int")
    got = {r["query_id"]: r.asDict() for r in E.ir_metrics(run, qrels).collect()}
    assert set(got) == {1, 2} and got[1]["precision_10"] == pytest.approx(1 / 3) and got[1]["recall_10"] == 0.5 and got[1]["mrr"] == 0.5
    assert got[1]["ndcg_10"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3))) and all(v == 0 for k, v in got[2].items() if k != "query_id")


def test_answer_checks(spark):
    a = spark.createDataFrame([(1, "x [1] [9] [1]", 3), (2, "none", 2)], "id int, answer string, papers int")
    got = {r["id"]: r for r in E.numeric_citation_check(a).collect()}
    assert (got[1]["total"], got[1]["correct"], got[1]["hallucinated"], got[1]["missing"], got[1]["accuracy"]) == (2, 1, 1, 1, 0.5) and got[2]["accuracy"] == 0.0
    m = spark.createDataFrame([(1, "(cite:1) (cite:P9|c1) (cite:5) (cite:Z)", ["x (cite:Z)", " "], ["Q"], ["P9"]), (2, "none", None, None, None), (3, "(cite:2)", [], ["a", "b"], None)], "id int, answer string, contexts array<string>, paper_ids array<string>, truth_ids array<string>")
    assert {r["id"]: r["validity"] for r in E.citation_validity(m).collect()} == {1: 0.75, 2: 0.0, 3: 1.0}
    v = spark.createDataFrame([(1, "(cite:1) (cite:9) (cite:1)", "SOURCE_ID: 0\nCHUNK_ID: a\nSOURCE_ID: 1\nCHUNK_ID: b"), (2, None, None)], "id int, answer string, context string")
    got = {r["id"]: r.asDict() for r in E.validated(v).collect()}
    assert got[1] == {"id": 1, "total": 2, "correct": 1, "hallucinated": 1, "missing": 0, "accuracy": 0.5, "overall": 0.5} and got[2]["overall"] == 0.0
    t = spark.createDataFrame([(1, "Alpha beta gamma delta. Short one.", "ALPHA text")], "id int, answer string, context string")
    r = E.text_match(t).first()
    assert (r["terms"], r["matched"], r["suspicious"]) == (5, 1, 1)


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "k int, v string, w int")
    new = spark.createDataFrame([(2, None, 5, 1), (2, "c", None, 2), (3, "d", 1, 1)], "k int, v string, w int, o int")
    assert sorted(tuple(r) for r in I.upsert_filled(old, new, ["k"], "o").collect()) == [(1, "a", 1), (2, "c", 5), (3, "d", 1)]
    assert sorted(tuple(r) for r in I.upsert_latest(old, new, ["k"], "o").collect()) == [(1, "a", 1), (2, "c", None), (3, "d", 1)]
    assert sorted((r["k"], r["v"]) for r in I.insert_new(old, new, ["k"], "o").collect()) == [(3, "d")]


def test_aligned_authors(spark):
    a = spark.createDataFrame([(1, 0, "A Smith"), (1, 1, "B Jones"), (1, 2, None), (1, 3, "C Far")], "paper int, pos int, name string")
    b = spark.createDataFrame([(1, 0, "B. Jones"), (1, 1, "A. Smith"), (1, 6, "C Far")], "paper int, pos int, name string")
    assert sorted(tuple(r) for r in I.align_authors(a, b).collect()) == [(1, 0, 1), (1, 1, 0)]


def test_context_window(spark):
    m = spark.createDataFrame([(1, i, "x" * 40) for i in range(5)] + [(2, 0, "y" * 4000)], "c int, o int, t string")
    got = {(r["c"], r["o"]) for r in C.context_window(m, "c", ["o"], C.token_estimate("t"), 30).collect()}
    assert got == {(1, 4), (1, 3), (2, 0)}


def test_next_answer(spark):
    m = spark.createDataFrame([(1, 1, "a"), (1, 2, "u"), (1, 3, "u"), (1, 4, "a"), (1, 5, "a"), (1, 6, "u")], "c int, o int, r string")
    got = {r["question"]: r["answer"] for r in C.next_answer(m, "c", ["o"], "r", "u", "a", "o").collect()}
    assert got == {2: None, 3: 4, 6: None}


def test_pack_blocks():
    blocks = ["a " * 100, "b " * 50, "c " * 560, "d " * 700]
    out = H.pack_blocks([b.strip() for b in blocks], 600)
    assert all(H.word_count(p) <= 600 or p.startswith("d") for p in out) and out[0].startswith("a") and out[1].startswith("c") is False or out[1].startswith("c")
    assert H.pack_blocks(["x"], 600) == ["x"] and H.pack_blocks([], 600) == [] and H.pack_blocks([" "], 600) == []
    small = H.pack_blocks(["a " * 590, "b " * 8, "c " * 300], 600)
    assert small[0].startswith("a") and small[1].startswith("b") and "c" in small[1], "a whole block within a tenth is carried over"


def test_chunk_documents(spark):
    d = spark.createDataFrame([(1, "# One\n\nText.\n\n## Two\n\n" + "word. " * 700), (2, None), (3, "  ")], "id int, t string")
    got = H.chunk_documents(d, "id", "t").orderBy("chunk_index").collect()
    assert [r["section_title"] for r in got][:2] == ["One", "Two"] and all(r["token_count"] <= 600 and r["id"] == 1 for r in got) and got[1]["char_start"] == got[0]["char_end"] + 2


def test_table_rows_and_majority(spark):
    cells = spark.createDataFrame([(1, 1, 1, "b"), (1, 1, 0, "a"), (1, 0, 0, None)], "t int, row int, col int, text string")
    assert H.table_rows(cells, "t").first()["text"] == "\na | b"
    assert H.majority(spark.createDataFrame([(1, "b"), (1, "a"), (1, None)], "g int, l string"), "g", "l").first()["l"] == "a"


def test_graph_small(spark):
    e = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (None, "c")], "paper int, author string")
    assert {(r["author"], r["coauthor"], r["papers"]) for r in G.coauthors(e).collect()} == {("a", "b", 2), ("b", "a", 2)}
    p = spark.createDataFrame([(1, 2000), (2, 2005)], "paper int, year int")
    r = spark.createDataFrame([(2, 1), (2, 1), (2, 9), (1, 1)], "citing int, cited int")
    assert [tuple(x) for x in G.citation_edges(r, p).collect()] == [(2, 1, 2005, 5)]
    works = spark.createDataFrame([("a", 1, 2000, "2000-01-01", None, "I1", 0, True), ("a", 2, 2001, "2001-01-01", 2.0, None, 2, False)], "author string, paper int, year int, date string, impact double, institution string, position int, corresponding boolean")
    m = G.career_metrics(works).first()
    assert (m["first_year"], m["last_institution"], m["mean_position"], m["mean_impact"], m["mostly_corresponding"]) == (2000, "I1", 2.0, 2.0, False)


def test_scorers(spark):
    df = spark.createDataFrame([("a b", "b c"), (None, None)], "q string, t string")
    r = df.select(embedding("q").alias("e"), rerank_score("q", "t").alias("s"), rerank_score("q", "t", lambda: lambda q, t: np.array([len(x or "") for x in t], float)).alias("m")).collect()
    assert len(r[0]["e"]) == 64 and r[0]["s"] == 0.5 and r[0]["m"] == 3.0
    tags = spark.range(1).select(best_tags(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(s).alias("score")) for n, s in (("a", 60.0), ("b", 40.0), ("c", 90.0))))).alias("t"), tag_scores(F.array(F.array(F.lit(0.0), F.lit(0.0)))).alias("z")).first()
    assert [x["name"] for x in tags["t"]] == ["c", "a"] and tags["z"] == 50.0


def test_pipeline_parts(spark):
    p = spark.createDataFrame([(1, "x"), (2, "abs"), (3, None)], "paper int, abstract string")
    c = spark.createDataFrame([(1, "c1", "text")], "paper int, chunk_id string, text string")
    assert {r["chunk_id"] for r in virtual_chunks(p, c).collect()} == {"c1", "2_abstract"}
    r = spark.createDataFrame([(1, 0.9, 1), (1, 0.8, 2), (1, 0.6, 3), (2, 0.5, 1)], "query_id int, score double, rank int")
    assert {x["query_id"]: x["sufficient"] for x in sufficient(r).collect()} == {1: True, 2: False}
