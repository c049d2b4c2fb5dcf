import json

import numpy as np
from pyspark.sql import functions as F

from scholion.operators import evaluate as E
from scholion.operators import listings as L
from scholion.operators import pipelines as P
from scholion.operators import profiles as R
from scholion.sources import files as S


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_pages(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(5)], "id int, v int")
    got = L.page(df, [F.col("v").desc(), F.col("id")], 0, 2).collect()
    assert [(r["id"], r["total"], r["next_offset"]) for r in got] == [(2, 5, 2), (1, 5, 2)]
    assert [(r["id"], r["next_offset"]) for r in L.page(df, [F.col("id")], 4, 2).collect()] == [(4, None)] and L.page(df.limit(0), [F.col("id")]).count() == 0


def test_lookups_and_lacks(spark):
    df = spark.createDataFrame([(1, "a"), (2, "7"), (7, None)], "id long, key string")
    wanted = spark.createDataFrame([("7",), ("a",), ("a ",), (" ",), (None,), ("zz",)], "value string")
    assert rows(L.point_lookup(df, wanted, "id", "key").select("value", "id")) == [("7", 7), ("a", 1)]
    got = L.lacking(df, {"key": F.col("key").isNull(), "big": F.col("id") > 1}, [F.col("id")], 1)
    assert rows(got.select("kind", "id")) == [("big", 2), ("key", 7)]


def test_conversations(spark):
    c = spark.createDataFrame([(1, "Deep Lakes", "chat", 5), (2, None, None, 9), (3, "deep", "single_paper", 7), (4, "x", "chat", None)], "id int, title string, kind string, updated int")
    m = spark.createDataFrame([(2, "so DEEP", True), (4, "deep", False), (4, None, True)], "conversation int, text string, active boolean")
    assert [(r["id"], r["rank"]) for r in L.conversation_search(c, m, "deep").orderBy("rank").collect()] == [(2, 1), (1, 2)]
    heads = spark.createDataFrame([(1, 10), (2, 20)], "conversation int, user int")
    msgs = spark.createDataFrame([(5, 1, 10), (4, 1, 11)], "id int, conversation int, user int")
    want = spark.createDataFrame([(1, 99, 100), (2, 20, 200), (1, 10, 300)], "conversation int, user int, new_id int")
    h, copies = L.cloned(heads, msgs, want)
    assert rows(h) == [(100, 99, 1, 2)] and rows(copies) == [(100, 99, 1, 4), (100, 99, 2, 5)]
    df = spark.createDataFrame([(1, True), (2, True), (3, None)], "id int, active boolean")
    gone = L.soft_deleted(df, spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(1, 2), (3, 9)], "question int, answer int"))
    assert rows(gone) == [(1, False), (2, False), (3, None)]


def test_bookmarks(spark):
    marks = spark.createDataFrame([(1, "p", "good notes", True), (2, "q", " ", True), (3, "p", None, False), (4, "none", None, True)], "id int, paper string, notes string, active boolean")
    papers = spark.createDataFrame([("p", "Deep lakes", "J", 2001, 5, True), ("q", "Stars", None, None, None, False)], "paper string, title string, venue string, year int, citations int, open_access boolean")
    authors = spark.createDataFrame([("q", "Ada Deep"), (None, None)], "paper string, name string")
    ids = lambda **k: [r["id"] for r in L.bookmarks(marks, papers, authors, **k).collect()]
    assert ids() == [4, 2, 1] and ids(text="deep") == [1, 2] and ids(has_notes=True) == [1] and ids(has_notes=False) == [4, 2] and ids(open_access=True) == [1] and ids(by="year", descending=False) == [1, 2, 4] and ids(text="deep notes") == [1]


def test_maps_and_times(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": None}), (None, {"x": "y"}), (None, None)], "o map<string,string>, n map<string,string>")
    assert [r["m"] for r in df.select(L.merged_maps(F.col("o"), F.col("n")).alias("m")).collect()] == [{"a": "1", "b": "3", "c": None}, {"x": "y"}, {}]
    t = spark.createDataFrame([("2024-01-01",), ("2024-02-20",), (None,)], "t string").select(L.stale(F.to_timestamp("t"), F.lit("2024-03-01").cast("timestamp")).alias("s"))
    assert [r["s"] for r in t.collect()] == [True, False, True]
    old, new = spark.createDataFrame([(1, "a", 5)], "k int, v string, at int"), spark.createDataFrame([(1, "b", 9, 1), (2, "c", 3, 2), (2, "d", 4, 1)], "k int, v string, at int, o int")
    assert rows(L.insert_or_touch(old, new, "k", "at", "o")) == [(1, "a", 9), (2, "d", 4)]


def test_author_and_institution_rows(spark):
    a = spark.createDataFrame(
        [("A1", " Ada ", "https://orcid.org/0000-0002-1825-0097", "https://openalex.org/A1", None, 5, None, None, 2), ("A1", "Ada L", None, None, "u", 9, 1, 1, 3), ("", "x", None, None, None, None, None, None, 1), ("B", " ", None, None, None, None, None, None, 1), ("S", "Bob", "", None, "u", None, None, None, 1)],
        "author_id string, name string, orcid string, openalex_id string, url string, citations int, papers int, h_index int, seen int",
    )
    got = {r["author_id"]: r for r in R.author_rows(a).collect()}
    assert set(got) == {"A1", "S"} and got["A1"]["orcid"] == "0000-0002-1825-0097" and got["A1"]["verified"] and got["A1"]["external_ids"] == {"orcid": "https://orcid.org/0000-0002-1825-0097", "openalex": "https://openalex.org/A1"} and got["S"]["external_ids"] == {"semantic_scholar": "u"} and not got["S"]["verified"]
    i = spark.createDataFrame([("https://o.org/I1/", None, "https://ror.org/02", "DE", "x", 1), ("I1", "Uni", None, "DE", "y", 2), (None, "no", None, None, None, 3)], "id string, display_name string, ror string, country_code string, type string, seen int")
    assert rows(R.institution_rows(i)) == [("I1", "Uni", None, "DE", "y")]


def test_issn_and_references(spark):
    loc = "array<struct<issn:array<string>,issn_l:string>>"
    df = spark.createDataFrame([([(None, "12"), (["1234-567x", "bad", None], None), (["0000-0001"], "1111-2222")],), (None,), ([],)], f"l {loc}")
    assert [tuple(r["x"]) for r in df.select(R.located_issn(F.col("l")).alias("x")).collect()] == [(["1234567X"], "11112222"), (None, None), (None, None)]
    answers = [json.dumps({"data": [{"citedPaper": {"paperId": "a"}}, {"cited_paper": {"paper_id": "b"}}, {"paperId": "c"}, {"citedPaper": {"paperId": ""}, "paperId": "d"}, {"x": 1}]}), "no json", None, "[]"]
    assert [r["i"] for r in spark.createDataFrame([(x,) for x in answers], "j string").select(R.linked_ids(F.col("j")).alias("i")).collect()] == [["a", "b", "c", "d"], [], [], []]


def test_trust(spark):
    authors = spark.createDataFrame([("a", "x", 100, 10, 5, None), ("b", None, 1, 1, 1, True), ("c", "y", 0, None, 4, False)], "author string, external_id string, citations int, papers int, h_index int, is_conflict boolean")
    other = spark.createDataFrame([("x", 10, 1, 5), ("y", 0, 9, 4)], "external_id string, citations int, papers int, h_index int")
    works = spark.createDataFrame([("a", 12, True), ("a", 3, None)], "author string, citations int, retracted boolean")
    got = {r["author"]: r for r in R.author_trust(authors, other, works).collect()}
    assert (got["a"]["works"], got["a"]["retracted"], got["a"]["retracted_rate"], got["a"]["i10"], got["a"]["is_conflict"]) == (2, 1, 0.5, 1, True)
    assert got["b"]["is_conflict"] and not got["b"]["compared"] and not got["c"]["is_conflict"] and got["c"]["retracted_rate"] is None
    assert tuple(R.trust_counters(R.author_trust(authors, other, works)).first()) == (3, 2, 2)


def test_variants_and_runs(spark):
    q = spark.createDataFrame([(1, "deep lakes")], "query_id int, text string")
    papers = spark.createDataFrame([("beir_a", "nothing"), ("beir_b", "deep lakes here"), ("beir_c", None)], "key string, abstract string")
    run = spark.createDataFrame([(1, "beir_a", 3.0, 1), (1, "beir_b", 2.0, 2), (1, "beir_c", 1.0, 3)], "query_id int, key string, score double, rank int")
    qrels = spark.createDataFrame([(1, "b", 1)], "query_id int, key string, rel int")
    got = {r["variant"]: r["mrr"] for r in E.variants(run, run, q, papers, qrels).collect()}
    assert got == {"original_before_rerank": 0.5, "original_after_rerank": 1.0, "decomposed_before_rerank": 0.5, "decomposed_after_rerank": 1.0}
    assert rows(E.compared_runs(run, run.where("rank < 3"), 2)) == [(1, 2, -1)]
    assert rows(E.chunks_else_papers(run.withColumn("query_id", F.lit(2)), run.where("rank = 1")).select("query_id", "key")) == [(1, "beir_a"), (2, "beir_a"), (2, "beir_b"), (2, "beir_c")]
    hits = spark.createDataFrame([(1, ["a "], ["a"]), (2, ["a"], [" "]), (3, None, ["a"])], "id int, paper_ids array<string>, truth_ids array<string>")
    assert rows(E.id_hits(hits)) == [(1, 1.0), (2, 0.0), (3, 0.0)]


def test_written_back(spark):
    stored = spark.createDataFrame([(1, None, 5), (2, 7, 8)], "id long, rel int, acc int")
    res = spark.createDataFrame([("1", 1, 3, None), ("1", 2, None, 4), ("9", 3, 1, 1), ("0", 4, 1, 1), ("x", 5, 1, 1), (None, 6, 1, 1)], "validation_id string, pos int, f int, r int")
    out, counters = E.written_back(stored, res, {"f": "acc", "r": "rel"})
    assert rows(out) == [(1, 4, 3), (2, 7, 8)] and tuple(counters.first()) == (3, 2, 1, 1, 2)


def test_agreement_and_sufficiency(spark):
    df = spark.createDataFrame([(1, "a b", "a b"), (2, "a", "zz"), (3, None, "a"), (4, " ", "a")], "id int, q string, a string")
    same = {r["id"]: r["agreement"] for r in E.embedded_agreement(df, "q", "a", prefixes=("", "")).collect()}
    assert abs(same[1] - 1) < 1e-6 and 0 <= same[2] < 1 and same[3] == same[4] == 0.0
    one = lambda: lambda texts: np.ones((len(texts), 2))
    assert abs(E.embedded_agreement(df, "q", "a", one).where("id = 2").first()["agreement"] - 1) < 1e-9
    req = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "c", 3)], "query_id int, key string, pos int")
    assert {r["query_id"]: r["sufficient"] for r in P.sufficient_external(P.placed_scores(req)).collect()} == {1: True, 2: False}


def test_fielded_match(spark):
    docs = spark.createDataFrame([(1, "deep lakes and deep seas", None), (2, "lakes", "deep"), (3, "deep limits of lakes", None), (4, None, None)], "id int, text string, title string")
    q = spark.createDataFrame([(1, "Deep lakes -limits"), (2, "nowhere"), (3, "-deep"), (4, None)], "query_id int, text string")
    assert rows(P.fielded_match(q, docs, "id", {"text": 1.0, "title": 0.5}, 5)) == [(1, 1, 3.0, 1), (1, 2, 1.5, 2)]


def test_conference_lines(spark, tmp_path):
    (tmp_path / "c.csv").write_text('1,A,B,S\n2,"Long, name",LN,S,\n3,,,,\nx,A,B,S,A\n\n4,T,AC,S,A*,Yes,1,,3\n5,T\n')
    got = {r["core_id"]: r for r in S.read_conference_ranking(spark, str(tmp_path)).collect()}
    assert set(got) == {2, 3, 4} and got[2]["title"] == "Long, name" and got[2]["rank"] == "Unranked" and got[3]["title"] == "" and got[4]["is_primary"] and got[4]["for_codes"] == "1,3"


def test_decomposed_queries(spark, tmp_path):
    assert S.read_decomposed(spark, str(tmp_path)) is None
    body = {"q1": {"original_text": "whole", "decomposed": {"hybrid_queries": ["a", " ", "b"]}}, "q2": {"text": "t"}}
    (tmp_path / "decomposed_queries.json").write_text(json.dumps(body, indent=1))
    assert rows(S.read_decomposed(spark, str(tmp_path))) == [("q1", 0, "a"), ("q1", 1, "b"), ("q2", 0, "t")]
    (tmp_path / "queries_decomposed.jsonl").write_text("\n".join(json.dumps({"_id": k} | v) for k, v in body.items()) + "\n\n")
    assert len(rows(S.read_decomposed(spark, str(tmp_path)))) == 3
    (tmp_path / "queries_decomposed.json").write_text(json.dumps([{"id": "z", "text": "only"}]))
    assert rows(S.read_decomposed(spark, str(tmp_path))) == [("z", 0, "only")]


def test_exports(spark, tmp_path):
    ev = spark.createDataFrame([("1 ", 0.5), ("2", None)], "id string, score double")
    src = spark.createDataFrame([(1, "q1", 9.0), (3, "q3", 1.0)], "id long, question string, score double")
    assert rows(S.joined_export(ev, src, "id")) == [("1 ", 0.5, "q1"), ("2", None, None)]
    per = spark.createDataFrame([(1, "x", 0.5), (2, "x", 1.0), (1, "y", 0.0)], "query_id int, variant string, mrr double")
    S.write_benchmark(str(tmp_path / "b"), per, spark.createDataFrame([("x", 2.0)], "variant string, ms double"), ["mrr"])
    assert "0.750000" in "".join(p.read_text() for p in (tmp_path / "b/summary").glob("*.csv")) and spark.read.json(str(tmp_path / "b/results")).count() == 3
    assert [r["value"].split()[0] for r in spark.read.text(str(tmp_path / "b/comparison")).collect()] == ["x", "y"]
    log = spark.createDataFrame([("e1", "scoped", 5)], "execution_id string, pipeline_type string, ms int")
    for _ in range(2):
        S.write_run_log(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1
    r = spark.createDataFrame([("s", "u", True), ("s", " ", None)], "query string, pdf_url string, is_open_access boolean")
    S.write_retrieval_log(r, str(tmp_path / "ret"), ["query"])
    assert tuple(spark.read.json(str(tmp_path / "ret/metadata")).select("total_results", "results_with_pdf_url", "results_open_access").first()) == (2, 1, 1)


def test_cells_with_objects(spark, tmp_path):
    (tmp_path / "c.csv").write_text('id,l,o\n1,"[""a""]","{""k"": 1}"\n2,x,{broken\n')
    got = S.read_csv_with_json(spark, str(tmp_path), ["id", "l", "o"], ["l"], {"o": "struct<k:int>"}).orderBy("id").collect()
    assert got[0]["l"] == ["a"] and got[0]["o_decoded"]["k"] == 1 and got[1]["o"] == "{broken" and (got[1]["o_decoded"] is None or got[1]["o_decoded"]["k"] is None)


def test_checkpoints_need_a_shared_folder(spark):
    """Off this machine a folder of its own is refused."""
    from types import SimpleNamespace

    import pytest

    from scholion.tables import shared_dir

    conf = SimpleNamespace(get=lambda *_: None)
    for master, good in (("local[4]", True), ("local", True), ("local-cluster[2,1,1024]", False), ("spark://host:7077", False), ("yarn", False)):
        fake = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))
        if good:
            assert shared_dir(fake).startswith("file:///tmp/")
        else:
            with pytest.raises(ValueError, match="checkpoint"):
                shared_dir(fake)
