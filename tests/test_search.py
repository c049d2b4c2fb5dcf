import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholion.operators import pipelines
from scholion.operators.search import bm25, cosine_topk, first_seen, hybrid, ivf_fit, ivf_index, ivf_topk, normalized_weights, ranked, rrf, sanitized_query, weighted_rrf
from scholion.tables import cut


def brute_bm25(queries, docs):
    toks = {k: re.findall("[a-z0-9]+", (t or "").lower()) for k, t in docs}
    toks = {k: t for k, t in toks.items() if t}
    avg = sum(map(len, toks.values())) / max(len(toks), 1)
    counts = {k: Counter(t) for k, t in toks.items()}
    dfs = Counter(w for c in counts.values() for w in c)
    out = {}
    for q, text in queries:
        for k, t in toks.items():
            c = counts[k]
            s = 0.0
            for w in set(re.findall("[a-z0-9]+", (text or "").lower())):
                if c[w]:
                    df = dfs[w]
                    s += math.log(1 + (len(toks) - df + 0.5) / (df + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(t) / avg))
            if s:
                out[q, k] = s
    return out


def test_bm25_against_brute_force(spark):
    docs = [(1, "the cat sat"), (2, "The dog! the dog"), (3, ""), (4, None), (5, "cat " * 50), (6, "dog cat"), (6, "dog cat")]
    queries = [(1, "cat dog cat"), (2, None), (3, "zebra"), (4, "THE")]
    got = {(r["query_id"], r["key"]): r["score"] for r in bm25(spark.createDataFrame(queries, "query_id int, text string"), spark.createDataFrame(docs[:6], "key int, text string"), "key", {"text": 1.0}).collect()}
    want = brute_bm25(queries, docs[:6])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_bm25_prunes_without_loss(spark):
    """Many common words, few rare ones: the best rows equal brute force, ties and all, at any number of tasks."""
    rnd = np.random.default_rng(3)
    words = [f"w{int(x)}" for x in rnd.zipf(1.3, 60_000) % 3000]
    docs = [(i, "the of and " + " ".join(words[i * 20 : i * 20 + 20])) for i in range(3000)] + [(3000 + i, "the of and w1 w2") for i in range(200)]
    queries = [(i, docs[i * 7][1]) for i in range(30)] + [(99, "the of and"), (98, "w1 w2")]
    df, q = spark.createDataFrame(docs, "key int, text string").repartition(3), spark.createDataFrame(queries, "query_id int, text string")
    want = brute_bm25(queries, docs)
    for k in (1, 10):
        got = [(r["query_id"], r["key"], r["rank"]) for r in bm25(q, df, "key", {"text": 1.0}, k).collect()]
        best = [(i, key, n + 1) for i, _ in queries for n, (_, key) in enumerate(sorted((-round(s, 9), key) for (x, key), s in want.items() if x == i)[:k])]
        assert sorted(got) == sorted(best)
    within, margin = df.where("key % 2 = 0"), 0.8
    got = {(r["query_id"], r["key"]) for r in bm25(q, df, "key", {"text": 1.0}, 5, within=within, margin=margin).collect()}
    for i, _ in queries:
        own = sorted((s for (x, key), s in want.items() if x == i and key % 2 == 0), reverse=True)
        assert {key for (x, key), s in want.items() if x == i and key % 2 == 0 and s >= own[4] - margin + 1e-6} <= {key for x, key in got if x == i}


def test_bm25_leaves_few_rows(spark):
    """Words that all texts have make no rows: each task hands on its best only."""
    docs = spark.range(20_000).selectExpr("id as key", "concat('the of and a ', id % 97) as text").repartition(4)
    q = spark.range(50).selectExpr("id as query_id", "concat('the of and a ', id) as text")
    out = bm25(q, docs, "key", {"text": 1.0}, 5)
    assert out.count() == 250
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


def test_bm25_empty(spark):
    none = spark.createDataFrame([], "key int, text string")
    q = spark.createDataFrame([(1, "a")], "query_id int, text string")
    assert bm25(q, none, "key", {"text": 1.0}, 3).count() == 0
    assert bm25(spark.createDataFrame([], "query_id int, text string"), spark.createDataFrame([(1, "a")], "key int, text string"), "key", {"text": 1.0}, 3).count() == 0


def test_cosine_topk_ties_and_bad_vectors(spark):
    v = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0]), (7, [0.0, 1.0]), (8, [3.0, 0.0])]
    vec = spark.createDataFrame(v, "id int, e array<float>").repartition(3)
    q = spark.createDataFrame([(9, [5.0, 0.0]), (10, None)], "query_id int, vector array<float>")
    assert [(r["key"], r["rank"]) for r in cosine_topk(q, vec, "id", "e", 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_index_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = {(r["query_id"], r["key"]) for r in cosine_topk(q, e, "vec_id", "embedding", 10).collect()}
    centres, probes = ivf_fit(e, "embedding", 10)
    near = {(r["query_id"], r["key"]) for r in ivf_topk(q, ivf_index(e, "vec_id", "embedding", centres), centres, 10, probes).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def _ranking(spark, rows):
    return spark.createDataFrame(rows, "query_id int, key string, score double, rank int")


def test_fusion_by_hand(spark):
    a, b = _ranking(spark, [(1, "x", 4.0, 1), (1, "y", 2.0, 2)]), _ranking(spark, [(1, "y", 0.5, 1), (1, "z", 0.0, 2)])
    got = {r["key"]: r["score"] for r in rrf(a.unionByName(b)).collect()}
    assert got == pytest.approx({"x": 1 / 61, "y": 1 / 62 + 1 / 61, "z": 1 / 62})
    got = {r["key"]: r["score"] for r in hybrid(a, b).collect()}
    assert got == pytest.approx({"x": 1 / 61 + 0.3, "y": 1 / 62 + 1 / 61 + 0.3 * 0.5 + 0.7, "z": 1 / 62})
    got = {r["key"]: r["score"] for r in weighted_rrf(a, b).collect()}
    assert got == pytest.approx({"x": 0.4 / 61, "y": 0.4 / 62 + 0.6 / 61, "z": 0.6 / 62})


def test_fusion_of_empty_and_zero(spark):
    none, zero = _ranking(spark, []), _ranking(spark, [(1, "x", 0.0, 1)])
    assert hybrid(none, none).count() == 0
    assert hybrid(zero, none).first()["score"] == pytest.approx(1 / 61)


def test_ties_go_to_the_smaller_key(spark):
    r = ranked(spark.createDataFrame([(1, "b", 1.0), (1, "a", 1.0), (1, "c", 2.0)], "query_id int, key string, score double"), 2)
    assert [(x["key"], x["rank"]) for x in r.orderBy("rank").collect()] == [("c", 1), ("a", 2)]


def test_small_helpers(spark):
    assert normalized_weights(0, 0) == (0.1, 0.9) and normalized_weights(1, 3) == (0.25, 0.75)
    assert sanitized_query("it's (a) test*", ["t", "b"]) == "t:(its a test) OR b:(its a test)" and sanitized_query("t:x", ["t"]) == "t:x" and sanitized_query("()", ["t"]) == ""
    assert [r["v"] for r in first_seen(spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k int, o int, v string"), ["k"], "o").collect()] == ["a"]


def test_filter_reaches_the_scan(spark, sf):
    plan = spark.read.parquet(f"{sf}/paper_records.parquet").where("year >= 2005").select("rec_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(year,2005)" in plan and "authors" not in plan


def test_many_queries(spark, monkeypatch):
    """Texts are tokenised once for several blocks, queries of the same terms or vector are searched once, and blocks rank as one would."""
    from scholion.operators import search

    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} common {'rare' if i == 3 else ''}", [float(i % 3 + 1), float(i % 4)]) for i in range(40)], "id long, text string, v array<float>")
    asked = spark.createDataFrame([(i, f"w{i % 6} common" if i % 2 else f"common w{i % 6}", [float(i % 4 + 1), 1.0]) for i in range(24)], "query_id long, text string, vector array<float>")
    rows = lambda df: sorted((r["query_id"], r["key"], round(r["score"], 9), r["rank"]) for r in df.collect())
    want = rows(search.bm25(asked, docs, "id", {"text": 1.0}, 3)), rows(search.cosine_topk(asked, docs, "id", "v", 3))
    lists, searched = search._term_lists, search._searched
    made, sizes = [], []
    monkeypatch.setattr(search, "_term_lists", lambda *a: made.append(1) or lists(*a))
    monkeypatch.setattr(search, "_searched", lambda rows, block, *a: sizes.append(block.num_rows) or searched(rows, block, *a))
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    assert rows(search.bm25(asked, docs, "id", {"text": 1.0}, 3)) == want[0] and len(want[0]) == 24 * 3
    assert len(made) == 1 and sizes == [2, 2, 2]
    assert rows(search.cosine_topk(asked, docs, "id", "v", 3)) == want[1] and len(want[1]) == 24 * 3
    twice = asked.where("query_id < 2").withColumn("query_id", F.lit(0).cast("long"))  # rows of one id are ranked together
    assert [r[3] for r in rows(search.cosine_topk(twice, docs, "id", "v", 3))] and max(r[3] for r in rows(search.cosine_topk(twice, docs, "id", "v", 3))) == 3
    assert rows(search.bm25(asked.limit(0), docs, "id", {"text": 1.0}, 3)) == rows(search.cosine_topk(asked.limit(0), docs, "id", "v", 3)) == []


def test_fielded_match_looks_up_equal_queries_once(spark, monkeypatch):
    from scholion.operators import pipelines

    docs = spark.createDataFrame([(i, f"the study of w{i % 3}", "limits" if i == 4 else None) for i in range(9)], "id long, text string, section string")
    asked = spark.createDataFrame([(i, "The study -limits" if i % 2 else "study the -limits") for i in range(20)], "query_id long, text string")
    scored, plain = [], pipelines.ranked
    monkeypatch.setattr(pipelines, "ranked", lambda scores, k=None: scored.append(scores.count()) or plain(scores, k))
    got = pipelines.fielded_match(asked, docs, "id", {"text": 1.0, "section": 0.4}, 5).collect()
    assert scored == [8]  # of nine rows one mentions a limit; not eight a query
    assert len(got) == 100 and {(r["key"], r["score"], r["rank"]) for r in got if r["query_id"] == 7} == {(0, 2.0, 1), (1, 2.0, 2), (2, 2.0, 3), (3, 2.0, 4), (5, 2.0, 5)}


def test_rankings_by_query_and_paper_are_not_broadcast(spark, monkeypatch):
    plans = []
    planned = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(pipelines, "cut", lambda df: planned(df) or cut(df))
    queries = spark.createDataFrame([(1, "cat dog", [1.0, 0.0]), (2, "dog", [0.0, 1.0])], "query_id int, text string, vector array<float>")
    parts = queries.select("query_id", F.lit(0).alias("part"), "text", "vector")
    papers = spark.createDataFrame([("a", "cat", "a cat", [1.0, 0.1], 3, "Q1"), ("b", "dog", "no dog", [0.1, 1.0], 0, None)], "paper string, title string, abstract string, vector array<float>, citations int, quartile string")
    chunks = spark.createDataFrame([("a", "a1", "intro", "cat and dog", [1.0, 0.0])], "paper string, chunk_id string, section string, text string, vector array<float>")
    best, found = pipelines.database_pipeline(queries, parts, papers, chunks)
    planned(found)
    assert len(plans) == 5 and not any("BroadcastHashJoin" in p for p in plans[2:])  # reranking, papers, chunks; hits and their chunks come before
    assert {(r["query_id"], r["paper"]) for r in best.collect()} == {(q, p) for q in (1, 2) for p in "ab"}
    assert {(r["query_id"], r["chunk_id"], r["score"]) for r in found.collect()} == {(1, "a1", 1.0), (1, "b_abstract", 0.5), (2, "a1", 1.0), (2, "b_abstract", 1.0)}
