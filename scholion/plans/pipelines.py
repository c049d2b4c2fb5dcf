"""Queries of chunking, scores and retrieval pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholion.functions import score as S
from scholion.functions.scorers import best_tags, chunk_text, embedding, paper_text, tag_scores
from scholion.functions.text import overlap_ratio
from scholion.operators import chunking as H
from scholion.operators import pipelines as P
from scholion.operators.answers import route
from scholion.operators.search import cosine, cosine_topk
from scholion.plans import corpus as C
from scholion.plans.corpus import best_journal
from scholion.plans.search import bm25_sql
from scholion.tables import cut, table

AS_OF = 2025


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.chunk_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


def chunk_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = H.token_stats(table(spark, sf_dir, "paper_chunks").where("token_count >= 0"), "token_count")
    return s.withColumn("mean", F.round("mean", 6))


def majority_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.majority(table(spark, sf_dir, "paper_chunks").where("section_title is not null"), "section_title", "label")


def evidence_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List items as evidence for the plain texts of their paper."""
    c = table(spark, sf_dir, "paper_chunks").where("paper_id is not null").select(F.col("paper_id").alias("doc"), "id", F.col("page_number").alias("page"), F.col("section_title").alias("section"), "label")
    return H.evidence_links(c.where("label = 'list_item'"), c.where("label = 'text'"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec_id"), "text")


def rank_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by the share of their title's words in the text of the same number, citations and quartile."""
    r = table(spark, sf_dir, "paper_records").join(best_journal(spark, sf_dir), "venue", "left").join(_texts(spark, sf_dir), "rec_id", "left")
    rel = overlap_ratio("title", "text")
    return r.select("rec_id", F.round(S.paper_rank(rel, F.col("citation_count"), F.col("quartile")), 6).alias("score"))


def rank_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "paper_records").join(best_journal(spark, sf_dir), "venue", "left").join(_texts(spark, sf_dir), "rec_id", "left")
    ev = F.coalesce(overlap_ratio("title", "text"), F.lit(0.0))
    return r.select("rec_id", F.round(S.paper_rank_decayed(ev, F.col("citation_count"), F.col("year"), F.col("quartile"), AS_OF), 6).alias("score"))


def citation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "paper_records")
    fwci = F.when(F.col("reference_count").isNotNull(), F.col("reference_count") / 50.0)
    return r.select("rec_id", F.round(S.citation_quality(F.col("citation_count"), F.col("year"), fwci, F.pmod("rec_id", F.lit(101)), F.col("is_open_access"), AS_OF), 6).alias("score"))


def venue_prestige(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed venues by the journal list, others by name."""
    r = table(spark, sf_dir, "paper_records").join(best_journal(spark, sf_dir).withColumn("listed", F.lit(True)), "venue", "left")
    listed = S.listed_venue_prestige(F.coalesce("quartile", F.lit("")), F.col("h_index"), F.col("sjr_score") * 4, F.col("sjr_score"), F.col("is_open_access"))
    return r.select("rec_id", F.round(F.when(F.col("listed"), listed).otherwise(S.unlisted_venue_prestige(F.col("venue"), F.lit("journal"), F.col("is_open_access"))), 6).alias("score"))


def author_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "author_records")
    return a.select("row_id", F.round(S.author_reputation(F.col("h_index"), F.col("citation_count"), F.col("paper_count")), 6).alias("score"))


def institution_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per record: the best institution of its authors, its countries and institutions."""
    r = table(spark, sf_dir, "paper_records")
    flat = r.select("rec_id", F.explode("authors").alias("a")).select("rec_id", F.explode("a.institutions").alias("i")).where("i is not null")
    g = flat.groupBy("rec_id").agg(F.max(S.institution_base(F.col("i.type"), F.lit(0))).alias("best"), F.countDistinct("i.country_code").alias("countries"), F.countDistinct("i.id").alias("n"))
    return g.select("rec_id", F.round(S.institution_reputation(F.col("best"), F.col("countries"), F.col("n")), 6).alias("score"))


def diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "paper_records")
    topics = F.coalesce(F.array_distinct("fields_of_study"), F.array().cast("array<string>"))
    return r.select("rec_id", F.round(S.diversity(F.col("year"), topics, F.array(F.lit("Medicine"), F.lit("Biology")), F.col("is_open_access"), AS_OF), 6).alias("score"))


def conflict_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest counts that one provider gives of a cluster against the largest that the others give."""
    first = F.col("source") == "openalex"
    side = lambda c, own: F.max(F.when(own, F.col(c)))
    a = table(spark, sf_dir, "author_records").groupBy("cluster_id").agg(side("citation_count", first).alias("c1"), side("citation_count", ~first).alias("c2"), side("h_index", first).alias("h1"), side("h_index", ~first).alias("h2"))
    return a.select("cluster_id", S.conflict(F.col("c1"), F.col("c2")).alias("citations"), S.conflict(F.col("h1"), F.col("h2"), 0.5, False).alias("h_index"))


def _out(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def _database(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return P.database_pipeline(C.questions(spark, sf_dir), C.parts(spark, sf_dir), cut(C.papers(spark, sf_dir)), cut(C.chunks(spark, sf_dir)))


def database_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of the hybrid pipeline over the sub-queries of each stated query."""
    return _out(_database(spark, sf_dir)[0])


def database_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that the pipeline returns with its papers."""
    return _out(_database(spark, sf_dir)[1])


def hybrid_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(P.hybrid_papers(C.questions(spark, sf_dir), cut(C.papers(spark, sf_dir)), 10))


def hybrid_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search of chunks in an explicit list of papers."""
    return _out(P.scoped_chunks(C.questions(spark, sf_dir), C.scope(spark, sf_dir), cut(C.chunks(spark, sf_dir)), 10))


def chunk_vectors_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest chunks by vector; those without one are left out."""
    return _out(cosine_topk(C.questions(spark, sf_dir), C.chunks(spark, sf_dir), "chunk_id", "vector", 10))


def similar_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers nearest by vector to the paper of each stated query."""
    p = C.papers(spark, sf_dir)
    asked = p.where("rec_id % 50 = 0").select(F.col("paper").alias("query_id"), "vector")
    return _out(cosine_topk(asked, p, "paper", "vector", 5))


def papers_or_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers by their words or by their authors' names, the better score holding; the queries are titles and names."""
    r = table(spark, sf_dir, "paper_records").where("paper_id is not null")
    names = r.select("rec_id", F.col("paper_id").alias("paper"), F.posexplode("authors").alias("pos", "a")).select(F.concat_ws("#", "rec_id", "pos").alias("author_row"), "paper", F.col("a.name").alias("name"), F.col("a.orcid").alias("other_name"))
    asked = r.where("rec_id % 50 = 0").select(F.col("rec_id").alias("query_id"), F.coalesce(F.try_element_at("authors", F.lit(1))["name"], F.col("title")).alias("text"))
    return _out(P.lexical_papers(asked, cut(C.papers(spark, sf_dir)), cut(names), 10))


def fielded_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section titles and single words of chunks, without those that mention a limit."""
    asked = table(spark, sf_dir, "paper_records").where("rec_id % 50 = 0 and title is not null").select(F.col("rec_id").alias("query_id"), F.concat(F.regexp_extract("title", r"(\w+)\W*$", 1), F.lit(" the -limits")).alias("text"))
    return P.fielded_match(asked, table(spark, sf_dir, "paper_chunks"), "id", {"text": 1.0, "section_title": 0.4}, 10)


def scoped_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles asked of the chunks of an explicit list of papers."""
    return _out(P.scoped_pipeline(C.questions(spark, sf_dir), C.scope(spark, sf_dir), C.papers(spark, sf_dir), cut(C.chunks(spark, sf_dir))))


def _lookup(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    q = C.questions(spark, sf_dir)
    asked = table(spark, sf_dir, "paper_records").where("rec_id % 50 = 0")
    ids = asked.select(F.col("rec_id").alias("query_id"), F.explode(F.map_values("external_ids")).alias("value"))
    p = cut(C.papers(spark, sf_dir).select("paper", "title", F.map_values("ids").alias("values")))
    return P.lookup_pipeline(q, ids, q.select("query_id", "text"), p, C.chunks(spark, sf_dir))


def lookup_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_lookup(spark, sf_dir)[0])


def lookup_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the papers looked up, those of little relevance left out."""
    return _out(_lookup(spark, sf_dir)[1])


def virtual_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = P.virtual_chunks(C.papers(spark, sf_dir), C.chunks(spark, sf_dir))
    return v.select("paper", "chunk_id", F.length("text").alias("n"))


def paper_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best, summed and rank-discounted scores of the papers whose chunks are nearest by vector."""
    c = C.chunks(spark, sf_dir)
    e = P.paper_evidence(cosine_topk(C.questions(spark, sf_dir), c, "chunk_id", "vector", 50), c.select(F.col("chunk_id").alias("key"), "paper"))
    return e.select("query_id", "paper", *(F.round(x, 9).alias(x) for x in ("best", "total", "discounted")))


def external_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate of what was found outside, scored by place alone."""
    rows = P.placed_scores(C.scope(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("paper")) - 1))
    return P.sufficient_external(rows)


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each record's question would go: its fields of study stand for a list of papers."""
    return table(spark, sf_dir, "paper_records").select("rec_id", route(F.col("fields_of_study")).alias("route"))


def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to be embedded, of papers and of chunks, by their hash."""
    p = C.papers(spark, sf_dir).select(F.col("paper").alias("id"), F.md5(paper_text(F.col("title"), F.col("abstract"))).alias("text"))
    return p.unionByName(C.chunks(spark, sf_dir).select(F.col("chunk_id").alias("id"), F.md5(chunk_text(F.col("section"), F.col("text"))).alias("text")))


def sufficiency_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings of embeddings by the cosine to those of the stated queries."""
    from scholion.plans.search import semantic_topk

    return P.sufficient(semantic_topk(spark, sf_dir), 0.9, 0.4).withColumn("best", F.round("best", 6))


def hashed_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and venues of records embedded by feature hashing; their cosine."""
    r = table(spark, sf_dir, "paper_records").where("title is not null and venue is not null")
    e = r.select("rec_id", embedding("title").alias("a"), embedding("venue").alias("b"))
    return e.select("rec_id", F.round(cosine("a", "b"), 4).alias("cosine"))


def zero_shot_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags from logits that stand for a model's: two templates a topic of each author."""
    a = table(spark, sf_dir, "author_profiles").where("topics is not null")
    score = tag_scores(F.array(F.array(F.lit(0.0), F.col("t.score")), F.array(F.lit(0.1), F.col("t.score"))))
    t = a.select("profile_id", F.explode("topics").alias("t")).where("t.score is not null and t.display_name is not null").select("profile_id", F.struct(F.col("t.display_name").alias("name"), score.alias("score")).alias("x"))
    g = t.groupBy("profile_id").agg(F.collect_list("x").alias("xs"))
    return g.select("profile_id", F.array_join(F.transform(best_tags(F.col("xs")), lambda x: x["name"]), "|").alias("tags"))


QUERIES = {
    f.__name__: f
    for f in (chunk_documents, chunk_token_stats, majority_label, evidence_links, rank_v1, rank_v2, citation_quality, venue_prestige, author_reputation, institution_reputation, diversity, conflict_flags, database_pipeline, database_chunks, hybrid_papers, hybrid_chunks, chunk_vectors_topk, similar_papers, papers_or_authors, fielded_match, scoped_pipeline, lookup_pipeline, lookup_chunks, virtual_chunks, paper_evidence, external_sufficiency, routed, embedding_texts, sufficiency_gate, hashed_embedding, zero_shot_tags)
}

_J = C.JOURNAL
_OV = "CASE WHEN len({a}) > 0 THEN len(list_intersect({a}, {b})) / len({a}) ELSE 0 END"
_TOKS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"
_REL = "(" + _OV.format(a=_TOKS.format("coalesce(r.title, '')"), b=_TOKS.format("coalesce(d.text, '')")) + ")"
_VIRTUAL = "vv AS (SELECT paper, chunk_id, text FROM cc UNION ALL SELECT paper, paper || '_abstract', abstract FROM pp WHERE paper NOT IN (SELECT paper FROM cc) AND trim(abstract, ' ') <> '')"
_RANK = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, {0}) AS INT) AS rank"
_COS = "list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"


def _top(source: str, k: int, key: str = "key") -> str:
    return f"SELECT * FROM (SELECT *, {_RANK.format(key)} FROM {source}) WHERE rank <= {k}"


def _hybrid_sql(name: str, asked: str, query: str, k: int) -> str:
    """CTEs ending in ``name`` (query_id, key, score, rank): hybrid search of papers by the queries of CTE ``asked``, whose id column is ``query``."""
    return f"""{bm25_sql(name + "_l", f"SELECT {query} AS query_id, text FROM {asked}", "pp", "paper", {"title": 1.0, "abstract": 1.0}, 200)},
      {name}_va AS (SELECT s.{query} AS query_id, p.paper AS key, {_COS.format("s.vector", "p.vector")} AS score FROM {asked} s, pp p WHERE s.vector IS NOT NULL AND p.vector IS NOT NULL), {name}_v AS ({_top(name + "_va", 200)}),
      {name}_f AS (SELECT coalesce(l.query_id, v.query_id) AS query_id, coalesce(l.key, v.key) AS key, l.score AS sl, l.rank AS rl, v.score AS sv, v.rank AS rv FROM {name}_l l FULL JOIN {name}_v v ON l.query_id = v.query_id AND l.key = v.key),
      {name}_g AS (SELECT *, max(sl) OVER (PARTITION BY query_id) AS ml, max(sv) OVER (PARTITION BY query_id) AS mv FROM {name}_f),
      {name}_h AS (SELECT query_id, key, coalesce(1.0 / (60 + rl), 0) + coalesce(1.0 / (60 + rv), 0) + coalesce(CASE WHEN ml > 0 THEN 0.3 * sl / ml END, 0) + coalesce(CASE WHEN mv > 0 THEN 0.7 * sv / mv END, 0) AS score FROM {name}_g), {name} AS ({_top(name + "_h", k)})"""


def _scoped_sql(name: str, scope: str, k: int) -> str:
    """CTEs ending in ``name`` (query_id, key, score, rank): hybrid search of the chunks of the papers in CTE ``scope``."""
    return f"""{name}_p AS (SELECT s.query_id, cc.chunk_id AS key, {_COS.format("q.vector", "cc.vector")} AS cos FROM (SELECT DISTINCT query_id, paper FROM {scope}) s JOIN cc ON cc.paper = s.paper JOIN qq q ON q.query_id = s.query_id),
      {bm25_sql(name + "_b", "SELECT query_id, text FROM qq", "cc", "chunk_id", {"text": 1.0, "section": 1.0}, None)},
      {name}_la AS (SELECT b.query_id, b.key, b.score FROM {name}_b b JOIN {name}_p p ON p.query_id = b.query_id AND p.key = b.key), {name}_l AS ({_top(name + "_la", 200)}),
      {name}_va AS (SELECT query_id, key, cos AS score FROM {name}_p WHERE cos IS NOT NULL), {name}_v AS ({_top(name + "_va", 200)}),
      {name}_h AS (SELECT coalesce(l.query_id, v.query_id) AS query_id, coalesce(l.key, v.key) AS key, coalesce(0.4 / (60 + l.rank), 0) + coalesce(0.6 / (60 + v.rank), 0) AS score FROM {name}_l l FULL JOIN {name}_v v ON l.query_id = v.query_id AND l.key = v.key), {name} AS ({_top(name + "_h", k)})"""


def _pool_sql(scope: str, near: str) -> str:
    """CTEs ``pool`` (query_id, paper, key, text) and ``again`` (query_id, paper, key, score): chunks near a query or abstracts, reranked by overlap."""
    overlap = _OV.format(a="a", b="t")
    return f"""pool AS (SELECT n.query_id, cc.paper, cc.chunk_id AS key, cc.text FROM {near} n JOIN cc ON cc.chunk_id = n.key
        UNION ALL SELECT s.query_id, s.paper, s.paper || '_abstract', pp.abstract FROM (SELECT DISTINCT query_id, paper FROM {scope}) s JOIN pp ON pp.paper = s.paper WHERE trim(pp.abstract, ' ') <> '' AND NOT EXISTS (SELECT 1 FROM {near} n JOIN cc ON cc.chunk_id = n.key WHERE n.query_id = s.query_id AND cc.paper = s.paper)),
      toks AS (SELECT p.query_id, p.paper, p.key, {_TOKS.format("q.text")} AS a, {_TOKS.format("p.text")} AS t FROM pool p JOIN qq q ON q.query_id = p.query_id), again AS (SELECT query_id, paper, key, {overlap} AS score FROM toks)"""


_DATABASE = f"""WITH {C.PAPERS}, {C.CHUNKS}, {C.QUESTIONS}, {C.PARTS}, {_hybrid_sql("x", "sq", "sid", 20)},
      rr AS (SELECT query_id // 2 AS query_id, key AS paper, sum(1.0 / (60 + rank)) AS score FROM x GROUP BY 1, 2), hits AS ({_top("rr", 20, "paper")}),
      {_scoped_sql("near", "hits", 20)}, {_pool_sql("hits", "near")},
      ev AS (SELECT query_id, paper, greatest(max(score), 0) AS best FROM again GROUP BY 1, 2),
      full_ AS (SELECT h.query_id, h.paper, 100 * coalesce(ev.best, 0) AS rel, least(70, 20 * log10(coalesce(pp.citations, 0) + 1)) + CASE pp.quartile WHEN 'Q1' THEN 30 WHEN 'Q2' THEN 15 WHEN 'Q3' THEN 5 ELSE 0 END AS auth FROM hits h JOIN pp ON pp.paper = h.paper LEFT JOIN ev ON ev.query_id = h.query_id AND ev.paper = h.paper),
      scored AS (SELECT query_id, paper, 0.7 * rel + 0.3 * CASE WHEN rel < 30 THEN auth * rel / 30 ELSE auth END AS score FROM full_), best AS ({_top("scored", 10, "paper")})"""
_LOOKUP = f"WITH {C.PAPERS}, {C.CHUNKS}, {C.QUESTIONS}, fl AS (SELECT paper, unnest(map_values(ids)) AS v FROM pp), al AS (SELECT rec_id AS query_id, unnest(map_values(external_ids)) AS v FROM paper_records WHERE rec_id % 50 = 0), i AS (SELECT al.query_id, min(fl.paper) AS paper FROM al JOIN fl ON fl.v = al.v GROUP BY 1), {bm25_sql('b', 'SELECT query_id, text FROM qq WHERE query_id NOT IN (SELECT query_id FROM i)', 'pp', 'paper', {'title': 1.0}, 1)}, found AS (SELECT query_id, paper, 1.0 AS score, 'id' AS way FROM i UNION ALL SELECT query_id, key, score, 'title' FROM b)"
SQL = {
    "chunk_token_stats": "SELECT count(*) AS chunks, round(avg(token_count), 6) AS mean, min(token_count) AS least, max(token_count) AS most FROM paper_chunks WHERE token_count >= 0",
    "majority_label": "SELECT section_title, label FROM (SELECT section_title, label, row_number() OVER (PARTITION BY section_title ORDER BY count(*) DESC, label) AS n FROM paper_chunks WHERE section_title IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2) WHERE n = 1",
    "evidence_links": """WITH c AS (SELECT paper_id AS doc, id, page_number AS page, lower(trim(regexp_replace(regexp_replace(coalesce(section_title, ''), '(?i)\\s*/\\s*(Figure|Table|Formula)\\s+Evidence\\s*$', ''), '\\s+', ' ', 'g'))) AS key, label FROM paper_chunks WHERE paper_id IS NOT NULL),
      h AS (SELECT e.doc, e.id AS evidence, t.id AS text_id, coalesce(abs(e.page - t.page), 99) AS far, CASE abs(e.page - t.page) WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0 END + CASE WHEN e.key = '' OR t.key = '' THEN 0 WHEN e.key = t.key THEN 4.0 WHEN contains(e.key, t.key) OR contains(t.key, e.key) THEN 2.0 ELSE 0 END AS score
            FROM c e JOIN c t ON t.doc = e.doc AND t.label = 'text' WHERE e.label = 'list_item')
      SELECT doc, evidence, text_id, CAST(score AS DOUBLE) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc, evidence ORDER BY score DESC, far, text_id) AS INT) AS rank FROM h WHERE score > 0) WHERE rank <= 3""",
    "rank_v1": f"WITH p AS (SELECT rec_id, 100 * {_REL} AS rel, least(70, 20 * log10(coalesce(citation_count, 0) + 1)) + CASE quartile WHEN 'Q1' THEN 30 WHEN 'Q2' THEN 15 WHEN 'Q3' THEN 5 ELSE 0 END AS auth FROM paper_records r LEFT JOIN {_J} j ON j.venue = r.venue LEFT JOIN documents d ON d.doc_id = r.rec_id) SELECT rec_id, round(0.7 * rel + 0.3 * CASE WHEN rel < 30 THEN auth * rel / 30 ELSE auth END, 6) AS score FROM p",
    "rank_v2": f"SELECT rec_id, round({_REL} * least(1.3, 1 + 0.1 * log10(1 + coalesce(citation_count, 0))) * CASE WHEN year IS NULL THEN 1 ELSE exp(-0.15 * greatest(0, 2025 - year)) END * CASE quartile WHEN 'Q1' THEN 1.15 WHEN 'Q2' THEN 1 ELSE 0.9 END, 6) AS score FROM paper_records r LEFT JOIN {_J} j ON j.venue = r.venue LEFT JOIN documents d ON d.doc_id = r.rec_id",
    "citation_quality": "SELECT rec_id, round(least(100, CASE WHEN coalesce(citation_count, 0) > 0 THEN least(40, 10 * log10(citation_count + 1)) ELSE 0 END + CASE WHEN reference_count IS NULL THEN 0 ELSE least(30, 10 * (reference_count / 50.0)) END + CASE WHEN year IS NOT NULL AND coalesce(citation_count, 0) > 0 THEN least(15, 5 * log10(citation_count / greatest(1, 2025 - year) + 1)) ELSE 0 END + CASE WHEN rec_id % 101 >= 99 THEN 10 WHEN rec_id % 101 >= 95 THEN 7 WHEN rec_id % 101 >= 90 THEN 5 ELSE 0 END + CASE WHEN coalesce(is_open_access, false) THEN 5 ELSE 0 END), 6) AS score FROM paper_records",
    "venue_prestige": f"""SELECT rec_id, round(CASE WHEN j.venue IS NOT NULL THEN least(100, 20 + CASE quartile WHEN 'Q1' THEN 50 WHEN 'Q2' THEN 35 WHEN 'Q3' THEN 20 WHEN 'Q4' THEN 10 ELSE 0 END + CASE WHEN h_index > 200 THEN 20 WHEN h_index > 100 THEN 15 WHEN h_index > 50 THEN 10 WHEN h_index > 20 THEN 5 ELSE 0 END
      + CASE WHEN sjr_score * 4 > 10 THEN 15 WHEN sjr_score * 4 > 5 THEN 10 WHEN sjr_score * 4 > 2 THEN 5 ELSE 0 END + CASE WHEN sjr_score > 2 THEN 10 WHEN sjr_score > 1 THEN 5 ELSE 0 END + CASE WHEN coalesce(is_open_access, false) THEN 5 ELSE 0 END)
      ELSE least(100, 25 + CASE WHEN regexp_matches(lower(r.venue), 'nature|science|cell|lancet|nejm|pnas|jama') THEN 40 WHEN regexp_matches(lower(r.venue), 'ieee|acm') THEN 25 WHEN regexp_matches(lower(r.venue), 'conference|proceedings') THEN 15 ELSE 0 END + 10 + CASE WHEN coalesce(is_open_access, false) THEN 5 ELSE 0 END) END, 6) AS score
      FROM paper_records r LEFT JOIN {_J} j ON j.venue = r.venue""",
    "author_reputation": "SELECT row_id, round(least(100, 20 + least(30, 2 * coalesce(h_index, 0)) + CASE WHEN citation_count > 0 THEN 4 * log10(citation_count + 1) ELSE 0 END + CASE WHEN paper_count > 0 THEN least(15, 3 * log10(paper_count + 1)) ELSE 0 END), 6) AS score FROM author_records",
    "institution_reputation": "WITH a AS (SELECT rec_id, unnest(authors) AS a FROM paper_records), i AS (SELECT rec_id, unnest(a.institutions) AS i FROM a) SELECT rec_id, round(least(100, max(40.0 + CASE WHEN i.type = 'education' THEN 10 ELSE 0 END) + least(10, count(DISTINCT i.country_code) * 2) + least(5, count(DISTINCT i.id))), 6) AS score FROM i WHERE i IS NOT NULL GROUP BY rec_id",
    "diversity": "SELECT rec_id, round(least(100.0, 50.0 + CASE WHEN 2025 - year <= 2 THEN 20 WHEN 2025 - year <= 5 THEN 10 WHEN 2025 - year <= 10 THEN 5 ELSE 0 END + CASE WHEN len(t) > 0 THEN least(20, 5 * len(list_filter(t, lambda x: x NOT IN ('Medicine', 'Biology')))) ELSE 0 END + CASE WHEN coalesce(is_open_access, false) THEN 10 ELSE 0 END), 6) AS score FROM (SELECT *, coalesce(list_distinct(fields_of_study), []) AS t FROM paper_records)",
    "conflict_flags": "WITH v AS (SELECT cluster_id, max(citation_count) FILTER (source = 'openalex') AS c1, max(citation_count) FILTER (source <> 'openalex') AS c2, max(h_index) FILTER (source = 'openalex') AS h1, max(h_index) FILTER (source <> 'openalex') AS h2 FROM author_records GROUP BY 1) SELECT cluster_id, CASE WHEN c1 IS NULL AND c2 IS NULL THEN false WHEN c1 IS NULL OR c2 IS NULL THEN true WHEN greatest(c1, c2) = 0 THEN false ELSE abs(c1 - c2) / greatest(c1, c2) >= 0.6 END AS citations, CASE WHEN h1 IS NULL OR h2 IS NULL THEN false WHEN greatest(h1, h2) = 0 THEN false ELSE abs(h1 - h2) / greatest(h1, h2) >= 0.5 END AS h_index FROM v",
    "virtual_chunks": f"WITH {C.PAPERS}, {C.CHUNKS}, {_VIRTUAL} SELECT paper, chunk_id, CAST(length(text) AS INT) AS n FROM vv",
    "database_pipeline": f"{_DATABASE} SELECT query_id, paper, round(score, 6) AS score, rank FROM best",
    "database_chunks": f"{_DATABASE}, kept AS (SELECT a.* FROM again a JOIN best b ON b.query_id = a.query_id AND b.paper = a.paper) SELECT query_id, paper, key AS chunk_id, round(score, 6) AS score, rank FROM ({_top('kept', 20)})",
    "hybrid_papers": f"WITH {C.PAPERS}, {C.QUESTIONS}, {_hybrid_sql('x', 'qq', 'query_id', 10)} SELECT query_id, key, round(score, 6) AS score, rank FROM x",
    "hybrid_chunks": f"WITH {C.CHUNKS}, {C.QUESTIONS}, {C.SCOPE}, {_scoped_sql('near', 'sc', 10)} SELECT query_id, key, round(score, 6) AS score, rank FROM near",
    "chunk_vectors_topk": f"WITH {C.CHUNKS}, {C.QUESTIONS}, a AS (SELECT q.query_id, cc.chunk_id AS key, {_COS.format('q.vector', 'cc.vector')} AS score FROM qq q, cc WHERE q.vector IS NOT NULL AND cc.vector IS NOT NULL) SELECT query_id, key, round(score, 6) AS score, rank FROM ({_top('a', 10)})",
    "similar_papers": f"WITH {C.PAPERS}, a AS (SELECT q.paper AS query_id, p.paper AS key, {_COS.format('q.vector', 'p.vector')} AS score FROM pp q, pp p WHERE q.rec_id % 50 = 0) SELECT query_id, key, round(score, 6) AS score, rank FROM ({_top('a', 5)})",
    "papers_or_authors": f"WITH {C.PAPERS}, an AS (SELECT rec_id || '#' || pos AS author_row, paper, a.name AS name, a.orcid AS other_name FROM (SELECT rec_id, paper_id AS paper, generate_subscripts(authors, 1) - 1 AS pos, unnest(authors) AS a FROM paper_records WHERE paper_id IS NOT NULL)), ask AS (SELECT rec_id AS query_id, coalesce(authors[1].name, title) AS text FROM paper_records WHERE paper_id IS NOT NULL AND rec_id % 50 = 0), {bm25_sql('w', 'SELECT * FROM ask', 'pp', 'paper', {'title': 1.0, 'abstract': 1.0}, 30)}, {bm25_sql('n', 'SELECT * FROM ask', 'an', 'author_row', {'name': 1.0, 'other_name': 0.4}, 30)}, u AS (SELECT query_id, key, score FROM w UNION ALL SELECT n.query_id, an.paper, n.score FROM n JOIN an ON an.author_row = n.key), g AS (SELECT query_id, key, max(score) AS score FROM u GROUP BY 1, 2) SELECT query_id, key, round(score, 6) AS score, rank FROM ({_top('g', 10)})",
    "fielded_match": f"WITH q AS (SELECT rec_id AS query_id, list_distinct(regexp_extract_all(lower(regexp_extract(title, '([0-9A-Za-z_]+)[^0-9A-Za-z_]*$', 1) || ' the'), '[a-z0-9]+')) AS ws FROM paper_records WHERE rec_id % 50 = 0 AND title IS NOT NULL), c AS (SELECT id AS key, coalesce(regexp_extract_all(lower(text), '[a-z0-9]+'), []) AS x, coalesce(regexp_extract_all(lower(section_title), '[a-z0-9]+'), []) AS y FROM paper_chunks), h AS (SELECT q.query_id, c.key, CAST(len(list_filter(x, lambda w: list_contains(ws, w))) + 0.4 * len(list_filter(y, lambda w: list_contains(ws, w))) AS DOUBLE) AS score FROM q, c WHERE list_has_all(list_concat(x, y), ws) AND NOT list_contains(x, 'limits') AND NOT list_contains(y, 'limits')) SELECT query_id, key, score, rank FROM ({_top('h', 10)})",
    "paper_evidence": f"WITH {C.CHUNKS}, {C.QUESTIONS}, a AS (SELECT q.query_id, cc.paper, cc.chunk_id AS key, {_COS.format('q.vector', 'cc.vector')} AS score FROM qq q, cc WHERE q.vector IS NOT NULL AND cc.vector IS NOT NULL), t AS ({_top('a', 50)}), n AS (SELECT *, row_number() OVER (PARTITION BY query_id, paper ORDER BY score DESC, key) AS place FROM t), g AS (SELECT query_id, paper, greatest(max(score), 0) AS best, sum(score) AS total, sum(score / place) AS d FROM n GROUP BY 1, 2) SELECT query_id, paper, round(best, 9) AS best, round(total, 9) AS total, round(CASE WHEN d > 0 THEN least(1, greatest(0.3, d)) ELSE 0 END, 9) AS discounted FROM g",
    "external_sufficiency": f"WITH {C.SCOPE} SELECT query_id, 1.0 AS best, count(*) AS rows, count(*) >= 2 AS sufficient FROM sc GROUP BY query_id",
    "routed": "SELECT rec_id, CASE WHEN len(list_filter(fields_of_study, lambda x: trim(x, ' ') <> '')) > 0 THEN 'scoped' ELSE 'database' END AS route FROM paper_records",
    "embedding_texts": f"WITH {C.PAPERS}, {C.CHUNKS} SELECT paper AS id, md5(substr(trim('Title: ' || trim(coalesce(title, ''), ' ') || chr(10) || chr(10) || 'Abstract: ' || trim(coalesce(abstract, ''), ' '), ' '), 1, 6000)) AS text FROM pp UNION ALL SELECT chunk_id, md5(CASE WHEN coalesce(section, '') <> '' THEN 'Section: ' || section || chr(10) || chr(10) || text ELSE text END) FROM cc",
    "scoped_pipeline": f"WITH {C.PAPERS}, {C.CHUNKS}, {C.QUESTIONS}, {C.SCOPE}, {_scoped_sql('near', 'sc', 20)}, {_pool_sql('sc', 'near')}, e AS (SELECT query_id, paper, sum(score) AS total FROM again GROUP BY 1, 2), g AS (SELECT sc.query_id, sc.paper, coalesce(total, 0) AS score FROM sc LEFT JOIN e ON e.query_id = sc.query_id AND e.paper = sc.paper) SELECT query_id, paper, round(score, 6) AS score, rank FROM ({_top('g', 10, 'paper')})",
    "lookup_pipeline": f"{_LOOKUP} SELECT query_id, paper, round(score, 6) AS score, way FROM found",
    "lookup_chunks": f"{_LOOKUP}, t AS (SELECT f.query_id, cc.chunk_id AS key, {_TOKS.format('q.text')} AS a, {_TOKS.format('cc.text')} AS t FROM found f JOIN cc ON cc.paper = f.paper JOIN qq q ON q.query_id = f.query_id), s AS (SELECT query_id, key, {_OV.format(a='a', b='t')} AS score FROM t) SELECT query_id, key, round(score, 6) AS score, rank FROM (SELECT *, {_RANK.format('key')} FROM s) WHERE score >= 0.3",
    "sufficiency_gate": "WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS key, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0), g AS (SELECT query_id, max(score) AS best, count(*) FILTER (score >= 0.4) AS good, max(score) FILTER (rank = 2) AS second FROM s WHERE rank <= 5 GROUP BY 1) SELECT query_id, round(best, 6) AS best, good, best >= 0.9 AND good >= 3 AND best - coalesce(second, 0) >= 0.05 AS sufficient FROM g",
    "zero_shot_tags": "WITH t AS (SELECT profile_id, unnest(topics) AS t FROM author_profiles WHERE topics IS NOT NULL), s AS (SELECT profile_id, t.display_name AS name, 100 * (exp(t.score) / (1 + exp(t.score)) + exp(t.score) / (exp(0.1) + exp(t.score))) / 2 AS raw FROM t WHERE t.score IS NOT NULL AND t.display_name IS NOT NULL), r AS (SELECT profile_id, name, round(raw, 2) AS score FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, name) AS n FROM r WHERE score >= 50), g AS (SELECT profile_id, string_agg(name, '|' ORDER BY score DESC, name) AS tags FROM k WHERE n <= 3 GROUP BY 1) SELECT p.profile_id, coalesce(g.tags, '') AS tags FROM (SELECT DISTINCT profile_id FROM r) p LEFT JOIN g ON g.profile_id = p.profile_id",
}
