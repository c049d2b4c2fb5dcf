"""Queries of lexical, vector and fused search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.operators.search import bm25, cosine_reach, cosine_topk, hybrid, ivf_fit, ivf_index, ivf_topk, lexical_then_cosine, rrf, weighted_rrf
from scholion.tables import table

K = 10


def title_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated query set: titles of the records whose id is divisible by 50."""
    return table(spark, sf_dir, "paper_records").where("rec_id % 50 = 0 and title is not null").select(F.col("rec_id").alias("query_id"), F.col("title").alias("text"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated query set: vectors whose id is divisible by 50."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def document_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of the documents whose id is divisible by 50 and that have a vector."""
    docs = table(spark, sf_dir, "documents").where("doc_id % 50 = 0 and text is not null").select(F.col("doc_id").alias("query_id"), "text")
    return docs.join(vector_queries(spark, sf_dir).select("query_id"), "query_id", "left_semi")


def _out(df: DataFrame) -> DataFrame:
    return df.select("query_id", "key", F.round("score", 6).alias("score"), "rank")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(bm25(title_queries(spark, sf_dir), table(spark, sf_dir, "documents"), "doc_id", {"text": 1.0}, K))


def bm25_chunks_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fields: text and section title."""
    return _out(bm25(title_queries(spark, sf_dir), table(spark, sf_dir, "paper_chunks"), "id", {"text": 1.0, "section_title": 1.0}, K))


def filtered_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters come before the top-k, and statistics are those of the rows searched."""
    docs = table(spark, sf_dir, "documents").where("lang in ('en', 'EN', 'eng', 'English') and n_chars >= 500")
    return _out(bm25(title_queries(spark, sf_dir), docs, "doc_id", {"text": 1.0}, K))


def author_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of authors as queries against names and their alternatives, weighted by field."""
    profiles = table(spark, sf_dir, "author_profiles").withColumn("alternatives", F.array_join("display_name_alternatives", " "))
    queries = table(spark, sf_dir, "author_records").where("row_id % 50 = 0 and name is not null").select(F.col("row_id").alias("query_id"), F.col("name").alias("text"))
    return _out(bm25(queries, profiles, "profile_id", {"display_name": 1.0, "alternatives": 0.4}, K))


def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(cosine_topk(vector_queries(spark, sf_dir), table(spark, sf_dir, "embeddings"), "vec_id", "embedding", K))


def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverted-file index; recall is measured against the exact ranking in the tests."""
    vectors = table(spark, sf_dir, "embeddings")
    centres, probes = ivf_fit(vectors, "embedding", K)
    return _out(ivf_topk(vector_queries(spark, sf_dir), ivf_index(vectors, "vec_id", "embedding", centres), centres, K, probes))


def _legs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    queries = document_queries(spark, sf_dir)
    lexical = bm25(queries, table(spark, sf_dir, "documents"), "doc_id", {"text": 1.0}, 3 * K)
    semantic = cosine_topk(vector_queries(spark, sf_dir).join(queries.select("query_id"), "query_id", "left_semi"), table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 3 * K)
    return lexical, semantic


def rrf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical, semantic = _legs(spark, sf_dir)
    return _out(rrf(lexical.unionByName(semantic), K))


def weighted_rrf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(weighted_rrf(*_legs(spark, sf_dir), k=K))


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(hybrid(*_legs(spark, sf_dir), k=K))


def hybrid_rrf_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(hybrid(*_legs(spark, sf_dir), k=K, rrf_only=True))


def lexical_cosine_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical matches that have a vector, raw scores blended."""
    queries = document_queries(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings")
    lexical = bm25(queries, table(spark, sf_dir, "documents"), "doc_id", {"text": 1.0}, K, within=vectors.select(F.col("vec_id").alias("doc_id")), margin=cosine_reach())
    asked = vector_queries(spark, sf_dir)
    return _out(lexical_then_cosine(lexical, asked, vectors, "vec_id", "embedding", k=K))


def multi_query_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's sub-queries (its title, and its venue) are searched in one plan and fused."""
    records = table(spark, sf_dir, "paper_records").where("rec_id % 50 = 0")
    parts = records.select(F.col("rec_id"), F.explode(F.array(F.struct(F.lit(0).alias("part"), F.col("title").alias("text")), F.struct(F.lit(1).alias("part"), F.col("venue").alias("text")))).alias("s"))
    subs = parts.where("s.text is not null").select(F.struct("rec_id", "s.part").alias("query_id"), "s.text")
    found = bm25(subs, table(spark, sf_dir, "paper_chunks"), "id", {"text": 1.0}, 3 * K)
    return _out(rrf(found.select(F.col("query_id.rec_id").alias("query_id"), "key", "score", "rank"), 2 * K))


QUERIES = {f.__name__: f for f in (hybrid_topk, bm25_topk, bm25_chunks_topk, filtered_bm25, author_lexical, semantic_topk, ann_topk, rrf_topk, weighted_rrf_topk, hybrid_rrf_only, lexical_cosine_blend, multi_query_rrf)}

TITLES = "SELECT rec_id AS query_id, title AS text FROM paper_records WHERE rec_id % 50 = 0 AND title IS NOT NULL"
DOCS = "SELECT doc_id AS query_id, text FROM documents WHERE doc_id % 50 = 0 AND text IS NOT NULL AND doc_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0)"
RANKED = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, key)"


def bm25_sql(name: str, queries: str, docs: str, key: str, fields: dict[str, float], k: int | None) -> str:
    """CTEs ending in ``name`` (query_id, key, score, rank)."""
    parts, gains = [f"{name}_q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM ({queries}))"], []
    for i, (f, w) in enumerate(fields.items()):
        n = f"{name}_{i}"
        parts += [
            f"{n}_w AS (SELECT {key} AS key, regexp_extract_all(lower({f}), '[a-z0-9]+') AS w FROM {docs})",
            f"{n}_s AS (SELECT count(*) AS n, avg(len(w)) AS av FROM {n}_w WHERE len(w) > 0)",
            f"{n}_p AS (SELECT key, term, count(*) AS tf, any_value(l) AS l FROM (SELECT key, len(w) AS l, unnest(w) AS term FROM {n}_w WHERE len(w) > 0) GROUP BY key, term)",
            f"{n}_d AS (SELECT term, count(*) AS df FROM {n}_p GROUP BY term)",
        ]
        gains.append(f"SELECT q.query_id, p.key, {w} * ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.l / s.av)) AS g FROM {name}_q q JOIN {n}_p p ON p.term = q.term JOIN {n}_d d ON d.term = q.term, {n}_s s")
    parts += [
        f"{name}_a AS (SELECT query_id, key, sum(g) AS score FROM ({' UNION ALL '.join(gains)}) GROUP BY query_id, key)",
        f"{name} AS (SELECT query_id, key, score, rank FROM (SELECT *, CAST({RANKED} AS INT) AS rank FROM {name}_a)" + (f" WHERE rank <= {k})" if k else ")"),
    ]
    return ", ".join(parts)


def cosine_sql(name: str, queries: str, k: int) -> str:
    return (
        f"{name}_a AS (SELECT q.vec_id AS query_id, e.vec_id AS key, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings e WHERE {queries}), "
        f"{name} AS (SELECT query_id, key, score, rank FROM (SELECT *, CAST({RANKED} AS INT) AS rank FROM {name}_a) WHERE rank <= {k})"
    )


OUT = "SELECT query_id, key, round(score, 6) AS score, rank FROM"
_LEGS = bm25_sql("l", DOCS, "documents", "doc_id", {"text": 1.0}, 3 * K) + ", " + cosine_sql("v", f"q.vec_id IN (SELECT query_id FROM ({DOCS}))", 3 * K)
_BOTH = "f AS (SELECT coalesce(l.query_id, v.query_id) AS query_id, coalesce(l.key, v.key) AS key, l.score AS sl, l.rank AS rl, v.score AS sv, v.rank AS rv FROM l FULL JOIN v ON l.query_id = v.query_id AND l.key = v.key)"


def _fused(score: str, k: int = K) -> str:
    return f"WITH {_LEGS}, {_BOTH}, g AS (SELECT *, max(sl) OVER (PARTITION BY query_id) AS ml, max(sv) OVER (PARTITION BY query_id) AS mv FROM f), h AS (SELECT query_id, key, {score} AS score FROM g) {OUT} (SELECT *, CAST({RANKED} AS INT) AS rank FROM h) WHERE rank <= {k}"


_RRF = "coalesce(1.0 / (60 + rl), 0) + coalesce(1.0 / (60 + rv), 0)"
_PARTS = "SELECT rec_id, 0 AS part, title AS text FROM paper_records WHERE rec_id % 50 = 0 AND title IS NOT NULL UNION ALL SELECT rec_id, 1, venue FROM paper_records WHERE rec_id % 50 = 0 AND venue IS NOT NULL"
SQL = {
    "bm25_topk": f"WITH {bm25_sql('b', TITLES, 'documents', 'doc_id', {'text': 1.0}, K)} {OUT} b",
    "bm25_chunks_topk": f"WITH {bm25_sql('b', TITLES, 'paper_chunks', 'id', {'text': 1.0, 'section_title': 1.0}, K)} {OUT} b",
    "filtered_bm25": "WITH " + bm25_sql("b", TITLES, "(SELECT * FROM documents WHERE lang IN ('en', 'EN', 'eng', 'English') AND n_chars >= 500)", "doc_id", {"text": 1.0}, K) + f" {OUT} b",
    "author_lexical": "WITH " + bm25_sql("b", "SELECT row_id AS query_id, name AS text FROM author_records WHERE row_id % 50 = 0 AND name IS NOT NULL", "(SELECT *, array_to_string(display_name_alternatives, ' ') AS alternatives FROM author_profiles)", "profile_id", {"display_name": 1.0, "alternatives": 0.4}, K) + f" {OUT} b",
    "semantic_topk": f"WITH {cosine_sql('v', 'q.vec_id % 50 = 0', K)} {OUT} v",
    "rrf_topk": _fused(_RRF),
    "hybrid_rrf_only": _fused(_RRF),
    "weighted_rrf_topk": _fused("coalesce(0.4 / (60 + rl), 0) + coalesce(0.6 / (60 + rv), 0)"),
    "hybrid_topk": _fused(_RRF + " + coalesce(CASE WHEN ml > 0 THEN 0.3 * sl / ml END, 0) + coalesce(CASE WHEN mv > 0 THEN 0.7 * sv / mv END, 0)"),
    "lexical_cosine_blend": f"WITH {bm25_sql('l', DOCS, 'documents', 'doc_id', {'text': 1.0}, None)}, h AS (SELECT l.query_id, l.key, 0.7 * l.score + 0.3 * coalesce(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 0) AS score FROM l JOIN embeddings q ON q.vec_id = l.query_id JOIN embeddings e ON e.vec_id = l.key) {OUT} (SELECT *, CAST({RANKED} AS INT) AS rank FROM h) WHERE rank <= {K}",
    "multi_query_rrf": "WITH " + bm25_sql("b", f"SELECT rec_id * 2 + part AS query_id, text FROM ({_PARTS})", "paper_chunks", "id", {"text": 1.0}, 3 * K)
    + f", h AS (SELECT query_id // 2 AS query_id, key, sum(1.0 / (60 + rank)) AS score FROM b GROUP BY 1, 2) {OUT} (SELECT *, CAST({RANKED} AS INT) AS rank FROM h) WHERE rank <= {2 * K}",
}
