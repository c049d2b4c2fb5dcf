"""Retrieval pipelines: search, chunks of the papers found, reranking, and the final order of papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions.score import paper_rank
from scholion.functions.scorers import rerank_score
from scholion.functions.text import token_set, tokens
from scholion.operators.search import bm25, bm25_pairs, cosine, cosine_topk, hybrid, like, ranked, rrf, shared, weighted_rrf
from scholion.tables import cut, merged


def virtual_chunks(papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks, and for papers without one the abstract as a chunk of its own: ``(paper, chunk_id, text)``."""
    own = papers.join(chunks.select("paper"), "paper", "left_anti").where("abstract is not null and trim(abstract) <> ''")
    return chunks.select("paper", "chunk_id", "text").unionByName(own.select("paper", F.concat(F.col("paper").cast("string"), F.lit("_abstract")).alias("chunk_id"), F.col("abstract").alias("text")))


def rerank(queries: DataFrame, pairs: DataFrame, texts: DataFrame, k: int | None = None, load=None) -> DataFrame:
    """Candidates ``(query_id, key)`` ranked anew by a model's score of their text ``(key, text)`` for their query.

    Without a model the score is the share of the query's tokens in the text; each query and each text is then tokenised once, not each pair.
    """
    asked = queries.select("query_id", F.col("text").alias("query_text"))
    if load is None:
        own = asked.select("query_id", token_set("query_text").alias("a"))
        there = texts.join(pairs.select("key").distinct(), "key", "left_semi").select("key", token_set("text").alias("b"))
        score = F.when(F.size("a") > 0, F.size(F.array_intersect("a", F.coalesce("b", F.array().cast("array<string>")))) / F.size("a")).otherwise(0.0)
        return ranked(merged(pairs.join(there, "key")).join(own, "query_id").select("query_id", "key", score.alias("score")), k)
    scored = merged(pairs.join(texts, "key")).join(asked, "query_id")
    return ranked(scored.select("query_id", "key", rerank_score("query_text", "text", load).alias("score")), k)


def paper_evidence(chunk_ranking: DataFrame, owner: DataFrame) -> DataFrame:
    """Per query and paper: best, sum, and rank-discounted sum of its chunks' scores; ``owner`` is (key, paper)."""
    own = chunk_ranking.join(owner, "key")
    w = Window.partitionBy("query_id", "paper").orderBy(F.col("score").desc(), "key")
    discounted = F.sum(F.col("score") / F.col("place"))
    g = own.withColumn("place", F.row_number().over(w)).groupBy("query_id", "paper").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("best"), F.sum("score").alias("total"), discounted.alias("d"))
    return g.select("query_id", "paper", "best", "total", F.when(F.col("d") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.3), F.col("d")))).otherwise(0.0).alias("discounted"))


def candidates(k: int) -> int:
    """Rows that a leg hands to a fusion of which ``k`` are wanted."""
    return max(3 * k, 200)


def hybrid_papers(queries: DataFrame, papers: DataFrame, k: int, w_lexical: float = 0.3, w_semantic: float = 0.7) -> DataFrame:
    """Ranking of papers by title and abstract, and by their vectors. ``queries`` is (query_id, text, vector), ``papers`` (paper, title, abstract, vector)."""
    lexical = bm25(queries, papers, "paper", {"title": 1.0, "abstract": 1.0}, candidates(k))
    semantic = cosine_topk(queries, papers, "paper", "vector", candidates(k))
    return hybrid(lexical, semantic, w_lexical, w_semantic, k)


def lexical_papers(queries: DataFrame, papers: DataFrame, authors: DataFrame, k: int) -> DataFrame:
    """Ranking of papers by their words or their authors' names, whichever scores higher. ``authors`` is (author_row, paper, name, other_name).

    The candidates of either search are three times ``k``; names are searched before the papers of a name are brought together.
    """
    own = bm25(queries, papers, "paper", {"title": 1.0, "abstract": 1.0}, 3 * k).select("query_id", "key", "score")
    named = bm25(queries, authors, "author_row", {"name": 1.0, "other_name": 0.4}, 3 * k)
    by_name = named.join(authors.select(F.col("author_row").alias("key"), "paper"), "key").groupBy("query_id", F.col("paper").alias("key")).agg(F.max("score").alias("score"))
    return ranked(own.unionByName(by_name).groupBy("query_id", "key").agg(F.max("score").alias("score")), k)


def scoped_chunks(queries: DataFrame, scope: DataFrame, chunks: DataFrame, k: int, w_lexical: float = 0.4, w_semantic: float = 0.6) -> DataFrame:
    """Ranking of the chunks of each query's own papers ``(query_id, paper)`` by weighted reciprocal ranks of words and vectors.

    ``chunks`` is (paper, chunk_id, section, text, vector). Only the pairs of a query and a chunk in its scope are scored; statistics
    are those of all chunks.
    """
    pairs = scope.select("query_id", "paper").distinct().join(chunks.select("paper", F.col("chunk_id").alias("key"), "vector"), "paper")
    lexical = ranked(bm25_pairs(queries, chunks, "chunk_id", {"text": 1.0, "section": 1.0}, pairs.select("query_id", "key")), candidates(k))
    asked = queries.select("query_id", F.col("vector").alias("q"))
    close = pairs.join(asked, "query_id").select("query_id", "key", cosine("vector", "q").alias("score")).where("score is not null")
    return weighted_rrf(lexical, ranked(close, candidates(k)), w_lexical, w_semantic, k)


def with_abstracts(found: DataFrame, papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(query_id, paper, key, text)``: chunks found ``(query_id, paper, key)`` and, for a query's papers without one, their abstract as a chunk."""
    own = papers.where("abstract is not null and trim(abstract) <> ''").select("paper", "abstract")
    texts = found.where("key is not null").join(chunks.select(F.col("chunk_id").alias("key"), "text"), "key").select("query_id", "paper", "key", "text")
    bare = found.where("key is null").join(own, "paper")
    return texts.unionByName(bare.select("query_id", "paper", F.concat(F.col("paper").cast("string"), F.lit("_abstract")).alias("key"), F.col("abstract").alias("text")))


def database_pipeline(queries: DataFrame, parts: DataFrame, papers: DataFrame, chunks: DataFrame, top_papers: int = 10, top_chunks: int = 20, load=None) -> tuple[DataFrame, DataFrame]:
    """(papers, chunks): hybrid search of every sub-query, fusion, chunks of the papers found or their abstracts, reranking, final order.

    ``queries`` is (query_id, text, vector); ``parts`` are its sub-queries (query_id, part, text, vector); ``papers`` has paper, title,
    abstract, vector, citations, quartile; ``chunks`` paper, chunk_id, section, text, vector. All queries and parts run in one plan. The
    papers come out as (query_id, paper, score, rank), the chunks of these papers as (query_id, paper, chunk_id, score, rank). Tables with
    rows for each query and paper are never broadcast, however small they are on disk.
    """
    subs = parts.select(F.struct("query_id", "part").alias("query_id"), "text", "vector")
    each = hybrid_papers(subs, papers, 2 * top_papers).select(F.col("query_id.query_id").alias("query_id"), "key", "score", "rank")
    hits = merged(cut(rrf(each, 2 * top_papers).select("query_id", F.col("key").alias("paper"))))
    near = scoped_chunks(queries, hits, chunks, top_chunks).select("query_id", "key").join(chunks.select(F.col("chunk_id").alias("key"), "paper"), "key")
    pool = merged(cut(with_abstracts(hits.join(near, ["query_id", "paper"], "left"), papers, chunks)))
    again = merged(cut(rerank(queries, pool.select("query_id", "key"), pool.select("key", "text").dropDuplicates(["key"]), None, load)))
    owner = pool.select("key", "paper").distinct()
    evidence = paper_evidence(again, owner)
    full = merged(hits.join(evidence, ["query_id", "paper"], "left")).join(papers.select("paper", "citations", "quartile"), "paper")
    best = cut(ranked(full.select("query_id", F.col("paper").alias("key"), paper_rank(F.coalesce("best", F.lit(0.0)), F.col("citations"), F.col("quartile")).alias("score")), top_papers).withColumnRenamed("key", "paper"))
    kept = again.join(owner, "key").join(merged(best.select("query_id", "paper")), ["query_id", "paper"], "left_semi")
    final = ranked(kept.select("query_id", "key", "score"), top_chunks).join(owner, "key")
    return best, final.select("query_id", "paper", F.col("key").alias("chunk_id"), "score", "rank")


def scoped_pipeline(queries: DataFrame, scope: DataFrame, papers: DataFrame, chunks: DataFrame, k: int = 10, top_chunks: int = 20, load=None) -> DataFrame:
    """``(query_id, paper, score, rank)``: hybrid search among the chunks of each query's own papers ``(query_id, paper)``, or their abstracts, reranked and added up by paper."""
    near = scoped_chunks(queries, scope, chunks, top_chunks).select("query_id", "key").join(chunks.select(F.col("chunk_id").alias("key"), "paper"), "key")
    pool = cut(with_abstracts(scope.select("query_id", "paper").distinct().join(near, ["query_id", "paper"], "left"), papers, chunks))
    again = rerank(queries, pool.select("query_id", "key"), pool.select("key", "text").dropDuplicates(["key"]), None, load)
    evidence = paper_evidence(again, pool.select("key", "paper").distinct())
    every = scope.join(evidence.select("query_id", "paper", "total"), ["query_id", "paper"], "left")
    return ranked(every.select("query_id", F.col("paper").alias("key"), F.coalesce("total", F.lit(0.0)).alias("score")), k).withColumnRenamed("key", "paper")


def fielded_match(queries: DataFrame, docs: DataFrame, key: str, fields: dict[str, float], k: int) -> DataFrame:
    """Ranking by weighted counts of the query's words, all of which a row must have in any field, and none of those marked with ``-``.

    Stands in for full-text search where there is no lexical index. Rows are looked up by the rarest word of a query only, and once for all
    queries of the same words. Only the queries' distinct words are broadcast.
    """
    signed = queries.select("query_id", F.lower("text").alias("t"))
    out = F.regexp_extract_all("t", F.lit(r"(?:^|\s)-([a-z0-9]+)"), F.lit(1))
    wanted = tokens(F.regexp_replace("t", r"(^|\s)-[a-z0-9]+", " "))
    named = signed.select("query_id", F.array_sort(F.array_distinct(wanted)).alias("all"), F.array_sort(F.array_distinct(out)).alias("none")).where("size(all) > 0")
    named = cut(named.withColumn("like", like("all", "none")))
    asked = named.select(F.col("like").alias("query_id"), "all", "none").dropDuplicates(["query_id"])
    words = docs.select(F.col(key).alias("key"), *(tokens(f).alias(f"f{i}") for i, f in enumerate(fields)))
    words = words.withColumn("any", F.array_distinct(F.concat(*(F.coalesce(f"f{i}", F.array().cast("array<string>")) for i in range(len(fields))))))
    words = cut(words.where("size(any) > 0 and key is not null"))
    each = words.select("key", F.explode("any").alias("w"))
    df = each.join(F.broadcast(asked.select(F.explode("all").alias("w")).distinct()), "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    rarest = asked.select("query_id", "all", "none", F.explode("all").alias("w")).join(df, "w", "left").groupBy("query_id").agg(F.min_by("w", F.struct(F.coalesce("df", F.lit(0)), "w")).alias("w"), F.first("all").alias("all"), F.first("none").alias("none"))
    rarest = cut(rarest)
    # the words of a row are fetched last, so that they are never sent with its pairs
    met = each.join(F.broadcast(rarest.select("w").distinct()), "w", "left_semi").join(rarest, "w").select("query_id", "key", "all", "none")
    found = met.join(words, "key").where((F.size(F.array_except("all", "any")) == 0) & (F.size(F.array_intersect("any", "none")) == 0))
    count = lambda c, ws: F.size(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.array_contains(ws, x)))
    score = sum((w * count(F.col(f"f{i}"), F.col("all")) for i, w in enumerate(fields.values())), F.lit(0.0))
    best = shared(ranked(found.select("query_id", "key", score.alias("score")), k), named.select("query_id", "like"))
    every, ids = named.agg(F.count(F.lit(1)), F.count_distinct("query_id")).first()
    return best if every == ids else ranked(best, k)


def lookup_pipeline(queries: DataFrame, ids: DataFrame, titles: DataFrame, papers: DataFrame, chunks: DataFrame, least: float = 0.3, load=None) -> tuple[DataFrame, DataFrame]:
    """(papers, chunks): papers by identifier, score 1, else the best title match of what isn't found yet; their chunks ranked anew from ``least`` on.

    ``ids`` is (query_id, value), ``titles`` (query_id, text), ``papers`` has paper, title, values (array of ids), ``chunks`` paper, chunk_id, text.
    """
    flat = papers.select(F.col("paper").alias("key"), F.explode("values").alias("value"))
    by_id = ids.join(flat, "value").groupBy("query_id").agg(F.min("key").alias("key")).select("query_id", "key", F.lit(1.0).alias("score"), F.lit("id").alias("way"))
    rest = titles.join(by_id.select("query_id"), "query_id", "left_anti")
    best = bm25(rest, papers, "paper", {"title": 1.0}, 1)
    found = cut(by_id.unionByName(best.select("query_id", "key", "score", F.lit("title").alias("way"))).withColumnRenamed("key", "paper"))
    pairs = found.select("query_id", "paper").join(chunks.select("paper", F.col("chunk_id").alias("key")), "paper")
    again = rerank(queries, pairs.select("query_id", "key"), chunks.select(F.col("chunk_id").alias("key"), "text"), None, load).where(F.col("score") >= least)
    return found, again


def sufficient(ranking: DataFrame, top: float = 0.72, enough: float = 0.55, count: int = 3, of: int = 5, margin: float = 0.05) -> DataFrame:
    """Whether each query's ranking is good enough: its best score, how many of the first ``of`` reach ``enough``, and the lead of the first."""
    g = ranking.where(F.col("rank") <= of).groupBy("query_id").agg(F.max("score").alias("best"), F.count_if(F.col("score") >= enough).alias("good"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    return g.select("query_id", "best", "good", ((F.col("best") >= top) & (F.col("good") >= count) & ((F.col("best") - F.coalesce("second", F.lit(0.0))) >= margin)).alias("sufficient"))


def sufficient_external(ranking: DataFrame, top: float = 0.60, count: int = 2) -> DataFrame:
    """Whether what was found outside is good enough: the best score, and the number of rows."""
    g = ranking.groupBy("query_id").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("rows"))
    return g.select("query_id", "best", "rows", ((F.col("best") >= top) & (F.col("rows") >= count)).alias("sufficient"))


def placed_scores(requested: DataFrame) -> DataFrame:
    """Scores of rows by their place alone, 1 / (pos + 1): ``(query_id, key, pos)`` with places from 0."""
    return requested.withColumn("score", 1.0 / (F.col("pos") + 1))
