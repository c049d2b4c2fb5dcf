import json

from pyspark.sql import functions as F

from scholion.sources import files as S
from scholion.sources.markup import parse_tei, pdf_links, read_tei, resolve_pdfs, search_results
from scholion.sources.provider import ProviderSource
from scholion.streaming import events as E
from scholion.tables import cut, release


def test_journal_ranking(spark, tmp_path):
    names = [n.format(year=2023) for n in S._RANKING]
    cells = ["1", "77", '"A; ""B"""', "journal", '"12345678, 8765432X"', "P", "Yes", "No", "1.234,5", "Q1", "x", "1", "2", "3", "4", "5", "2,5", "6", "7", "0", "0", "CH", "E", "1999", '"Bio (Q1); Chem"', "Sci"]
    (tmp_path / "scimagojr_2023.csv").write_text(";".join(names) + "\n" + ";".join(cells) + "\n", encoding="utf-8")
    r = S.read_journal_ranking(spark, f"{tmp_path}/scimagojr_2023.csv").first()
    assert (r["source_id"], r["sjr_score"], r["h_index"], r["issn"], r["categories"], r["is_open_access"], r["is_open_access_diamond"], r["data_year"], r["cites_per_doc_2years"]) == ("77", 1234.5, None, ["12345678", "8765432X"], ["Bio (Q1)", "Chem"], True, False, 2023, 2.5)


def test_conference_ranking(spark, tmp_path):
    (tmp_path / "c.csv").write_text("1,Conf,C,CORE,A*,yes,1,,3\n2,Other,O,CORE,,no,,,\n3,x\n")
    got = {r["core_id"]: r for r in S.read_conference_ranking(spark, f"{tmp_path}/c.csv").collect()}
    assert set(got) == {1, 2} and got[1]["for_codes"] == "1,3" and got[1]["is_primary"] and got[2]["rank"] == "Unranked"


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"_id": "1", "title": "t", "text": "x"}\n\n{"_id": "2"}\n')
    assert S.read_corpus(spark, f"{tmp_path}/a.jsonl").count() == 2
    (tmp_path / "q.jsonl").write_text(json.dumps({"_id": "1", "text": "whole"}) + "\n" + json.dumps({"id": "2", "original_text": "o", "decomposed": {"hybrid_queries": ["a", "b"]}}) + "\n")
    assert sorted((r["query_id"], r["part"], r["text"]) for r in S.read_queries(spark, f"{tmp_path}/q.jsonl").collect()) == [("1", 0, "whole"), ("2", 0, "a"), ("2", 1, "b")]
    (tmp_path / "b.csv").write_text('id,ctx\n1,"[""a"", ""b""]"\n2,plain\n3,"[broken"\n')
    assert [r["ctx"] for r in S.read_csv_with_json(spark, f"{tmp_path}/b.csv", ["id", "ctx"], ["ctx"]).orderBy("id").collect()] == [["a", "b"], ["plain"], ["[broken"]]
    (tmp_path / "r.tsv").write_text("query-id\tcorpus-id\tscore\n1\ta\t1\n1\tb\t0\n")
    assert [tuple(r) for r in S.read_qrels(spark, f"{tmp_path}/r.tsv").collect()] == [("1", "a", 1)]


def test_question_selection(spark):
    q = spark.createDataFrame([("1", "What  is?", "D1", True), ("2", "what is?", "D1", True), ("3", "B", "D2", True), ("4", "C", "D3", True), ("5", "D", "D4", False)], "id string, question string, doi string, is_opensource boolean")
    ex = spark.createDataFrame([("d2", None), ("d3", "d9")], "doi string, ver_doi string")
    known = spark.createDataFrame([("D1",), ("d9",)], "doi string")
    assert sorted((r["id"], r["doi"]) for r in S.select_questions(q, ex, known).collect()) == [("1", "d1"), ("4", "d9")]


def test_sinks(spark, tmp_path):
    c = spark.createDataFrame([("p", "c0", "a\0b"), (None, "c1", None)], "paper_id string, chunk_id string, text string")
    S.write_chunks(c, f"{tmp_path}/chunks")
    assert {r["text"] for r in spark.read.parquet(f"{tmp_path}/chunks").collect()} == {"ab", None}
    rows = spark.createDataFrame([(1, ["x"], None)], "id int, l array<string>, s string")
    S.write_export(rows, f"{tmp_path}/out")
    assert spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/out").first()["l"] == '["x"]'
    for _ in range(2):
        S.append_new(rows, f"{tmp_path}/log", "id")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 1


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>A  title</title></titleStmt><sourceDesc><author><persName><forename>Ada</forename> <surname>L</surname></persName></author></sourceDesc></fileDesc>
<profileDesc><abstract><p>Short.</p></abstract></profileDesc></teiHeader><text><body><div><head>Intro</head><p>One <hi>two</hi>.</p><p>Three.</p></div><div><p>Loose.</p></div></body><back><listBibl><biblStruct><analytic><title>Ref</title></analytic></biblStruct></listBibl></back></text></TEI>"""


def test_tei(spark):
    p = parse_tei(TEI)
    assert p == {"title": "A title", "authors": ["Ada L"], "abstract": "Short.", "sections": [("Intro", "One two.\n\nThree."), ("Unknown Section", "Loose.")], "references": ["Ref"]}
    assert parse_tei("<broken") is None
    df = spark.createDataFrame([(1, TEI), (2, None), (3, "x")], "id int, t string")
    assert [r["id"] for r in read_tei(df, "id", "t").collect()] == [1]


def test_pdf_links(spark):
    page = '<meta name="citation_pdf_url" content="/m.pdf"><a href="x/y.pdf?d=1">PDF</a><a href="/other">no</a><link type="application/pdf" href="l.bin"><script>var a="/s.pdf"</script>'
    assert pdf_links(page, "https://h.org/d/") == ["https://h.org/m.pdf", "https://h.org/d/x/y.pdf?d=1", "https://h.org/d/l.bin", "https://h.org/s.pdf"]
    assert resolve_pdfs(spark.createDataFrame([(1, "https://h.org/", page), (2, None, None)], "id int, url string, body string"), "id", "url", "body").count() == 4


def test_search_results():
    page = '<div class="gs_r"><h3><span>[PDF]</span> <a href="u">Title A</a></h3><div class="gs_a">A Bee</div><div class="gs_rs">snip</div><a>Cited by 12</a></div><div class="gs_r"><h3>B</h3></div>'
    assert search_results(page) == [("Title A", "A Bee", "snip", "u", 12), ("B", "", "", None, 0)]


def test_provider_source(spark, tmp_path):
    (tmp_path / "page_00000.jsonl").write_text(json.dumps({"paperId": "p", "title": "T", "year": 2001, "externalIds": {"DOI": "10.1/X"}}) + "\n\n")
    (tmp_path / "page_00001.jsonl").write_text(json.dumps({"id": "https://o.example/W1", "display_name": "U", "publication_year": 2002, "abstract_inverted_index": {"b": [1], "a": [0]}}) + "\n")
    spark.dataSource.register(ProviderSource)
    got = {r["paper_id"]: r for r in spark.read.format("scholarly_provider").load(str(tmp_path)).collect()}
    assert got["p"]["publication_date"] == "2001-01-01" and got["p"]["doi"] == "10.1/x" and got["W1"]["abstract"] == "a b"


EVENTS = [(1, "2024-01-01 00:00:00", 7, "view", 1.0, "{}"), (2, "2024-01-01 00:10:00", 7, "click", 2.0, "{}"), (3, "2024-01-01 00:05:00", 8, "view", 1.0, "{}"), (4, "2024-01-01 02:00:00", 7, "done", 3.0, "{}")]


def _files(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    for part in ("event_id <= 2", "event_id > 2"):
        df.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return df


def test_streamed_numbers_and_windows(spark, tmp_path):
    df = _files(spark, tmp_path)
    E.run_available(E.numbered(E.read_log(spark, f"{tmp_path}/in", 1)), f"{tmp_path}/seq", f"{tmp_path}/c1")
    assert sorted((r["user_id"], r["sequence"]) for r in spark.read.parquet(f"{tmp_path}/seq").collect()) == [(7, 1), (7, 2), (7, 3), (8, 1)]
    E.run_available(E.tumbling(E.read_log(spark, f"{tmp_path}/in"), "1 hour", late="10 minutes"), f"{tmp_path}/win", f"{tmp_path}/c2")
    batch = {(r["start"], r["event_type"], r["n"]) for r in E.tumbling(df, "1 hour").collect()}
    streamed = {(r["start"], r["event_type"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/win").collect()}
    assert streamed <= batch and len(streamed) >= 2
    E.run_available(E.deduplicated(E.read_log(spark, f"{tmp_path}/in"), "1 hour"), f"{tmp_path}/ded", f"{tmp_path}/c3")
    assert spark.read.parquet(f"{tmp_path}/ded").count() == 4


def test_bounded_replay(spark, tmp_path):
    _files(spark, tmp_path)
    q = E.bounded_replay(E.read_log(spark, f"{tmp_path}/in"), keep=2, terminal="done").writeStream.format("memory").queryName("ring").outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c4").start()
    q.awaitTermination()
    got = {r["user_id"]: r for r in spark.table("ring").collect()}
    assert got[7]["kept"] == 2 and got[7]["done"] and got[8]["first_id"] == 3


def test_progress_replay_sessions(spark, tmp_path):
    df = _files(spark, tmp_path)
    p = {r["user_id"]: r for r in E.latest_progress(df).collect()}
    assert p[7]["phase"] == "done" and p[7]["progress"] == 3.0
    assert [r["event_id"] for r in E.replay(df, "user_id", ["ts"], 2, 1).collect()] == [2]
    assert sorted((r["user_id"], r["n"]) for r in E.sessions(df, "30 minutes").collect()) == [(7, 1), (7, 2), (8, 1)]


def test_cut_and_release(spark):
    t = cut(spark.range(3))
    assert t.count() == 3
    release(t)
    assert cut(spark.range(0)).count() == 0
