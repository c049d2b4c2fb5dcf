"""Queries of provider rows, links, trust metrics and profiles. Line items stand for authorships, suppliers for authors, parts for quartiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.operators import evaluate as E
from scholion.operators import graph as G
from scholion.operators import ingest as I
from scholion.operators import profiles as P
from scholion.operators.search import bm25
from scholion.plans import corpus as C
from scholion.plans.graph import _CITE, _EDGE, _edges, _works, citation_edges
from scholion.plans.search import bm25_sql
from scholion.tables import cut, table


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = table(spark, sf_dir, "paper_records").select("rec_id", "citation_count", F.posexplode("authors").alias("pos", "a"))
    return flat.select(
        "a.author_id", "a.name", "a.orcid", F.when(F.col("a.author_id").startswith("A"), F.concat(F.lit("https://openalex.org/"), "a.author_id")).alias("openalex_id"), F.lit(None).cast("string").alias("url"), F.col("citation_count").alias("citations"), F.lit(None).cast("int").alias("papers"),
        F.lit(None).cast("int").alias("h_index"), (F.col("rec_id") * 10_000 + F.col("pos")).alias("seen"), "rec_id", "pos", "a.institutions",
    )


def author_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = P.author_rows(_mentions(spark, sf_dir))
    return a.select("author_id", "name", "orcid", "openalex_id", "verified", F.size("external_ids").alias("ids"), "citations")


def institution_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mentions(spark, sf_dir).select("seen", F.posexplode("institutions").alias("p", "i")).select((F.col("seen") * 100 + F.col("p")).alias("seen"), "i.id", "i.display_name", F.concat(F.lit("https://ror.org/0"), F.length("i.display_name")).alias("ror"), "i.country_code", "i.type")
    return P.institution_rows(m)


def located_issn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The yearly entries of a journal, newest first, as locations of one paper."""
    j = table(spark, sf_dir, "journals").groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("data_year")).alias("y"), "id", "issn", F.try_element_at("issn", F.lit(2)).alias("issn_l")))).alias("l"))  # a row a year
    return j.select("source_id", P.located_issn(F.col("l")).alias("x")).select("source_id", F.coalesce(F.array_join("x.issn", ","), F.lit("")).alias("issn"), "x.issn_l")


def stored_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.with_defaults(table(spark, sf_dir, "paper_records").where("external_ids is not null"), ["citation_count", "reference_count"], "external_ids")
    return p.select("rec_id", "citation_count", "reference_count", F.array_join(F.array_sort(F.map_keys("external_ids")), ",").alias("ids"))


def author_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authorships of papers; first authors are linked already."""
    a = I.authorship_rows(table(spark, sf_dir, "paper_records")).withColumnRenamed("rec_id", "paper")
    return P.author_links(a, a.where("position = 1 and author_id is not null"))


def relationship_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.relationship_rows(_edges(spark, sf_dir), citation_edges(spark, sf_dir), 5)


def linked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in answers of three shapes, built from records; ids that are missing leave their place."""
    r = table(spark, sf_dir, "paper_records")
    shapes = (F.struct(F.struct(F.col("paper_id").alias("paperId")).alias("citedPaper")), F.struct(F.struct(F.col("paper_id").alias("paper_id")).alias("cited_paper")), F.struct(F.col("paper_id").alias("paperId")))
    body = F.when(F.col("rec_id") % 3 == 0, F.to_json(shapes[0])).when(F.col("rec_id") % 3 == 1, F.to_json(shapes[1])).otherwise(F.to_json(shapes[2]))
    answer = F.concat(F.lit('{"data": ['), body, F.lit(', {"paperId": ""}, {"paperId": "X'), F.col("rec_id"), F.lit('"}]}'))
    return r.select("rec_id", F.posexplode(P.linked_ids(answer)).alias("pos", "cited"))


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    r = table(spark, sf_dir, "paper_records").select(F.col("paper_id").alias("paper"), "rec_id", "title", F.col("fields_of_study").alias("references"))
    return P.index_step(r, table(spark, sf_dir, "paper_chunks").select(F.col("paper_id").alias("paper")), "rec_id")


def indexed_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)[0].select("paper", "rec_id", "title")


def indexed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)[1]


def index_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)[2]


def provider_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of one provider with the counts of the other's of the same ORCID."""
    p = table(spark, sf_dir, "author_profiles").select("profile_id", "source", "orcid", "works_count", "cited_by_count")
    return P.provider_merge(p.where("source = 'semantic_scholar'").drop("source"), p.where("source = 'openalex'").select("orcid", "works_count", "cited_by_count", F.col("profile_id").alias("seq")), "orcid", "seq")


def merged_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors of the first delivery of a paper with what the last one says of them."""
    r = table(spark, sf_dir, "paper_records").where("paper_id is not null")
    ends = r.groupBy("paper_id").agg(F.min("rec_id").alias("a"), F.max("rec_id").alias("b")).where("a < b")
    people = r.select("rec_id", F.posexplode("authors").alias("pos", "x")).select("rec_id", "pos", "x.name", "x.orcid", F.try_element_at(F.filter("x.institutions", lambda i: i["id"].isNotNull()), F.lit(1))["id"].alias("institution"))
    side = lambda c: ends.select(F.col("paper_id").alias("paper"), F.col(c).alias("rec_id")).join(people, "rec_id").select("paper", "pos", "name", "orcid", "institution")
    return P.merged_authors(side("a"), side("b"))


def _trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "author_profiles").where("orcid is not null")
    counts = (F.col("cited_by_count").alias("citations"), F.col("works_count").alias("papers"), F.col("summary_stats.h_index").alias("h_index"))
    authors = p.where("source = 'semantic_scholar'").select(F.col("profile_id").alias("author"), F.col("orcid").alias("external_id"), *counts, F.lit(None).cast("boolean").alias("is_conflict"))
    other = p.where("source = 'openalex'").groupBy(F.col("orcid").alias("external_id")).agg(F.min_by(F.struct(*counts), "profile_id").alias("c")).select("external_id", "c.*")
    return P.author_trust(authors, other, _works(spark, sf_dir).select("author", "citations", "retracted"))


def author_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trust(spark, sf_dir).withColumn("retracted_rate", F.round("retracted_rate", 9))


def trust_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.trust_counters(_trust(spark, sf_dir))


def author_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    works = l.join(o, l.l_orderkey == o.o_orderkey).select(F.col("l_suppkey").alias("author"), F.col("l_orderkey").alias("paper"), F.year("o_orderdate").alias("year"), F.concat(F.lit("Q"), F.pmod("l_orderkey", F.lit(6))).alias("quartile"), "o_orderdate")
    authors = works.groupBy("author").agg(F.max("o_orderdate").alias("indexed_at"))
    out = P.author_profiles(authors, works.drop("o_orderdate"), _edges(spark, sf_dir), F.lit("1998-08-20").cast("timestamp"))
    return out.withColumn("papers", F.array_join("papers", ",")).withColumn("coauthors", F.array_join("coauthors", ","))


def author_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of the venues that an author published in, unlisted ones too."""
    r = table(spark, sf_dir, "paper_records").select("venue", F.explode("authors").alias("a")).where("a.author_id is not null").select("venue", F.col("a.author_id").alias("author"))
    return G.quartile_breakdown(r.join(C.best_journal(spark, sf_dir).select("venue", "quartile"), "venue", "left"), "author", "quartile")


def compared_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles asked of titles and of abstracts."""
    q, p = C.questions(spark, sf_dir), cut(C.papers(spark, sf_dir).select("paper", "title", "abstract"))
    return E.compared_runs(bm25(q, p, "paper", {"title": 1.0}, 10), bm25(q, p, "paper", {"title": 1.0, "abstract": 1.0}, 20))


def search_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean metrics of whole and split queries, before and after reranking; a paper is relevant to a title equal to its own but for case."""
    q, p = C.questions(spark, sf_dir), cut(C.papers(spark, sf_dir).select(F.col("paper").alias("key"), "title", "abstract"))
    whole = cut(bm25(q, p, "key", {"title": 1.0}, 100))
    subs = C.parts(spark, sf_dir).select(F.struct("query_id", "part").alias("query_id"), "text")
    from scholion.operators.search import rrf

    split = cut(rrf(bm25(subs, p, "key", {"title": 1.0}, 100).select(F.col("query_id.query_id").alias("query_id"), "key", "score", "rank"), 100))
    qrels = q.select("query_id", F.lower("text").alias("t")).join(p.select("key", F.lower("title").alias("t")), "t").select("query_id", "key", F.lit(1).alias("rel"))
    m = E.mean_metrics(E.variants(whole, split, q, p, qrels), ("variant",))
    return m.select("variant", "queries", *(F.round(c, 9).alias(c) for c in m.columns[2:]))


def id_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "paper_records")
    return E.id_hits(r.select(F.col("rec_id").alias("id"), F.col("fields_of_study").alias("paper_ids"), F.expr("transform(s2_fields_of_study, x -> x.category)").alias("truth_ids")))


def embedded_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clamped cosine of titles and venues by feature hashing, with the prefixes of questions and documents."""
    a = E.embedded_agreement(table(spark, sf_dir, "paper_records").select(F.col("rec_id").alias("id"), "title", "venue"), "title", "venue")
    return a.withColumn("agreement", F.round("agreement", 6))


def answer_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as answers with numbers as citations, against contexts that name papers."""
    c = table(spark, sf_dir, "paper_chunks")
    answer = F.concat(F.coalesce("text", F.lit("")), F.lit(" (cite:1) (cite:"), F.coalesce("token_count", F.lit(0)), F.lit(") (cite:2)"))
    context = F.when(F.col("id") % 2 == 0, F.concat(F.lit("SOURCE_ID: a\nCHUNK_ID: x\nSOURCE_ID: b\nPAPER ID: "), F.coalesce("paper_id", F.lit("none")))).otherwise(F.lit("(cite:a) (cite:b)"))
    v = E.validated(c.select("id", answer.alias("answer"), context.alias("context")))
    return v.withColumn("accuracy", F.round("accuracy", 9)).withColumn("overall", F.round("overall", 9))


def _written(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = table(spark, sf_dir, "author_records")
    stored = a.select(F.col("cluster_id").alias("id"), "h_index").where("id is not null").groupBy("id").agg(F.min("h_index").alias("relevance"), F.max("h_index").alias("accuracy"))
    results = table(spark, sf_dir, "events").select(F.expr("CASE event_type WHEN 'error' THEN 'x' WHEN 'signup' THEN '0' ELSE cast(user_id as string) END").alias("validation_id"), F.col("event_id").alias("pos"), F.col("value").cast("int").alias("faithfulness"), F.when(F.col("value") > 50, F.col("value").cast("int")).alias("relevancy"))
    return E.written_back(stored, results, {"faithfulness": "accuracy", "relevancy": "relevance"})


def written_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir)[0]


def write_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir)[1]


def progress_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with a label as rows done, token counts as their score."""
    c = table(spark, sf_dir, "paper_chunks")
    done = c.where("label is not null").select("id", F.col("token_count").alias("score"), (F.col("label") == "list_item").alias("no_evidence"))
    return E.progress_summary(c, done, "id", ["score"]).withColumn("score", F.round("score", 9))


QUERIES = {
    f.__name__: f
    for f in (author_rows, institution_rows, located_issn, stored_papers, author_links, relationship_rows, linked_ids, indexed_papers, indexed_edges, index_counters, provider_merge, merged_authors, author_trust, trust_counters, author_profiles, author_quartiles, compared_runs, search_variants, id_hits, embedded_agreement, answer_validation, written_back, write_counters, progress_summary)
}

_M = "(SELECT rec_id, citation_count, pos, a FROM (SELECT rec_id, citation_count, generate_subscripts(authors, 1) - 1 AS pos, unnest(authors) AS a FROM paper_records))"
_TAIL = "nullif(trim(regexp_extract(regexp_replace(trim({0}, ' '), '/+$', ''), '([^/]*)$', 1), ' '), '')"
_REL = f"SELECT author, other, kind, count FROM (SELECT *, row_number() OVER (PARTITION BY author, kind ORDER BY count DESC, other) AS n FROM (SELECT a.author, b.author AS other, 'collaboration' AS kind, count(*) AS count FROM ({_EDGE}) a JOIN ({_EDGE}) b ON a.paper = b.paper AND a.author <> b.author GROUP BY 1, 2 UNION ALL SELECT author, other, 'referenced', n FROM rf UNION ALL SELECT other, author, 'citing', n FROM rf)) WHERE n <= 5"
_COUNTS = "cited_by_count AS c, works_count AS p, summary_stats.h_index AS h"
_FAR = "CAST(coalesce(CASE WHEN a.{0} IS NULL OR o.{0} IS NULL THEN false WHEN greatest(a.{0}, o.{0}) = 0 THEN false ELSE abs(a.{0} - o.{0}) / greatest(a.{0}, o.{0}) >= 0.5 END, false) AS INT)"
_TRUST = f"""WITH s AS (SELECT profile_id AS author, orcid, {_COUNTS} FROM author_profiles WHERE orcid IS NOT NULL AND source = 'semantic_scholar'), oa AS (SELECT orcid, {_COUNTS} FROM (SELECT *, row_number() OVER (PARTITION BY orcid ORDER BY profile_id) AS n FROM author_profiles WHERE orcid IS NOT NULL AND source = 'openalex') WHERE n = 1),
      w AS (SELECT l_suppkey AS author, count(*) AS works, count(*) FILTER (l_linestatus = 'O') AS retracted, count(*) FILTER (CAST(l_quantity AS BIGINT) >= 10) AS i10 FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1),
      t AS (SELECT a.author, coalesce(w.works, 0) AS works, coalesce(w.retracted, 0) AS retracted, round(w.retracted / w.works, 9) AS retracted_rate, coalesce(w.i10, 0) AS i10, CASE WHEN o.orcid IS NULL THEN false ELSE {_FAR.format("c")} + {_FAR.format("p")} + {_FAR.format("h")} >= 2 END AS is_conflict, o.orcid IS NOT NULL AS compared FROM s a LEFT JOIN oa o ON o.orcid = a.orcid LEFT JOIN w ON w.author = a.author)"""
_TOKS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"


def _variants_sql() -> str:
    runs = [("decomposed_before_rerank", "sp"), ("decomposed_after_rerank", "sr"), ("original_before_rerank", "wh"), ("original_after_rerank", "wr")]
    again = lambda name, src: f"{name} AS (SELECT query_id, key, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, key) AS INT) AS rank FROM (SELECT r.query_id, r.key, CASE WHEN len({_TOKS.format('q.text')}) > 0 THEN len(list_intersect({_TOKS.format('q.text')}, {_TOKS.format(chr(39) + chr(39) + ' || coalesce(pp.abstract, ' + chr(39) + chr(39) + ')')})) / len({_TOKS.format('q.text')}) ELSE 0 END AS score FROM {src} r JOIN qq q ON q.query_id = r.query_id JOIN pp ON pp.paper = r.key))"
    union = " UNION ALL ".join(f"SELECT '{v}' AS variant, query_id, key, rank FROM {t} WHERE rank <= 20" for v, t in runs)
    ks = (10, 20)
    g = ", ".join(f"CAST(count(*) FILTER (rank <= {k}) AS DOUBLE) AS n{k}, CAST(count(*) FILTER (rank <= {k} AND rel > 0) AS DOUBLE) AS h{k}, sum(rel / log2(rank + 1)) FILTER (rank <= {k}) AS d{k}" for k in ks)
    idcg = ", ".join(f"sum(1 / log2(i + 1)) FILTER (i <= least({k}, n{k})) AS i{k}" for k in ks)
    cols = ", ".join(f"coalesce(h{k} / n{k}, 0) AS precision_{k}, coalesce(h{k}, 0) / relevant AS recall_{k}, CASE WHEN h{k} > 0 THEN 2 * (h{k} / n{k}) * (h{k} / relevant) / (h{k} / n{k} + h{k} / relevant) ELSE 0 END AS f1_{k}, coalesce(d{k} / nullif(i{k}, 0), 0) AS ndcg_{k}" for k in ks)
    names = [f"{m}_{k}" for k in ks for m in ("precision", "recall", "f1", "ndcg")] + ["mrr"]
    return f"""WITH {C.PAPERS}, {C.QUESTIONS}, {C.PARTS}, {bm25_sql("wh", "SELECT query_id, text FROM qq", "pp", "paper", {"title": 1.0}, 100)}, {bm25_sql("su", "SELECT sid AS query_id, text FROM sq", "pp", "paper", {"title": 1.0}, 100)},
      rr AS (SELECT query_id // 2 AS query_id, key, sum(1.0 / (60 + rank)) AS score FROM su GROUP BY 1, 2), sp AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, key) AS INT) AS rank FROM rr) WHERE rank <= 100),
      {again("wr", "wh")}, {again("sr", "sp")}, u AS ({union}), qr AS (SELECT q.query_id, pp.paper AS key FROM qq q JOIN pp ON lower(pp.title) = lower(q.text)),
      j AS (SELECT u.*, CASE WHEN qr.key IS NULL THEN 0 ELSE 1 END AS rel FROM u LEFT JOIN qr ON qr.query_id = u.query_id AND qr.key = u.key), g AS (SELECT variant, query_id, {g}, min(rank) FILTER (rel > 0) AS f FROM j GROUP BY 1, 2),
      v AS (SELECT query_id, CAST(count(*) AS DOUBLE) AS relevant FROM qr GROUP BY 1), a AS (SELECT variant, query_id, relevant FROM v, (SELECT DISTINCT variant FROM u)), x AS (SELECT a.variant, a.query_id, a.relevant, g.* EXCLUDE (variant, query_id) FROM a LEFT JOIN g ON g.variant = a.variant AND g.query_id = a.query_id),
      o AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY key) AS i FROM qr), d AS (SELECT x.variant, x.query_id, {idcg} FROM x JOIN o ON o.query_id = x.query_id GROUP BY 1, 2),
      m AS (SELECT x.variant, {cols}, coalesce(1.0 / f, 0) AS mrr FROM x LEFT JOIN d ON d.variant = x.variant AND d.query_id = x.query_id)
      SELECT variant, count(*) AS queries, {", ".join(f"round(avg({n}), 9) AS {n}" for n in names)} FROM m GROUP BY variant"""


SQL = {
    "author_rows": f"WITH f AS (SELECT a.author_id AS author_id, trim(a.name, ' ') AS name, {_TAIL.format('a.orcid')} AS orcid, CASE WHEN a.author_id LIKE 'A%' THEN a.author_id END AS openalex_id, citation_count AS citations, row_number() OVER (PARTITION BY a.author_id ORDER BY rec_id, pos) AS n FROM {_M} WHERE trim(a.name, ' ') <> '' AND trim(a.author_id, ' ') <> '') SELECT author_id, name, orcid, openalex_id, orcid IS NOT NULL AS verified, CAST(CASE WHEN orcid IS NULL THEN 0 ELSE 1 END + CASE WHEN openalex_id IS NULL THEN 0 ELSE 1 END AS INT) AS ids, citations FROM f WHERE n = 1",
    "institution_rows": f"WITH m AS (SELECT rec_id, pos, generate_subscripts(a.institutions, 1) AS p, unnest(a.institutions) AS i FROM {_M} WHERE a IS NOT NULL), f AS (SELECT regexp_extract(regexp_replace(trim(i.id, ' '), '/+$', ''), '([^/]*)$', 1) AS institution_id, i.display_name AS name, i.country_code AS country_code, i.type AS type, rec_id, pos, p FROM m WHERE trim(i.id, ' ') <> '') SELECT institution_id, coalesce(name, 'Unknown Institution') AS name, '0' || length(name) AS ror_id, country_code, type FROM (SELECT *, row_number() OVER (PARTITION BY institution_id ORDER BY rec_id DESC, pos DESC, p DESC) AS n FROM f) WHERE n = 1",
    "located_issn": "WITH v AS (SELECT source_id, data_year, id, list_sort(list_distinct(list_filter(list_transform(issn, lambda x: upper(replace(trim(x, ' '), '-', ''))), lambda x: length(x) = 8))) AS a, upper(replace(trim(issn[2], ' '), '-', '')) AS l FROM journals) SELECT s.source_id, coalesce(array_to_string(a.a, ','), '') AS issn, b.l AS issn_l FROM (SELECT DISTINCT source_id FROM journals) s LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY data_year DESC, id) AS n FROM v WHERE len(a) > 0) WHERE n = 1) a ON a.source_id = s.source_id LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY data_year DESC, id) AS n FROM v WHERE length(l) = 8) WHERE n = 1) b ON b.source_id = s.source_id",
    "stored_papers": "WITH e AS (SELECT rec_id, unnest(map_entries(external_ids)) AS e FROM paper_records WHERE external_ids IS NOT NULL), k AS (SELECT rec_id, string_agg(DISTINCT CASE lower(e.key) WHEN 'corpusid' THEN 'corpus_id' WHEN 'pubmed' THEN 'pmid' WHEN 'pubmedcentral' THEN 'pmcid' ELSE lower(e.key) END, ',' ORDER BY CASE lower(e.key) WHEN 'corpusid' THEN 'corpus_id' WHEN 'pubmed' THEN 'pmid' WHEN 'pubmedcentral' THEN 'pmcid' ELSE lower(e.key) END) AS ids FROM e WHERE e.value IS NOT NULL GROUP BY 1) SELECT r.rec_id, coalesce(citation_count, 0) AS citation_count, coalesce(reference_count, 0) AS reference_count, coalesce(k.ids, '') AS ids FROM paper_records r LEFT JOIN k ON k.rec_id = r.rec_id WHERE r.external_ids IS NOT NULL",
    "author_links": f"WITH a AS (SELECT rec_id AS paper, a.author_id AS author_id, CAST(pos + 1 AS INT) AS position, list_filter(a.institutions, lambda i: i.id IS NOT NULL)[1].id AS institution FROM {_M} WHERE a.name IS NOT NULL AND a.author_id IS NOT NULL), f AS (SELECT *, row_number() OVER (PARTITION BY paper, author_id ORDER BY position) AS n FROM a) SELECT paper, author_id, position, institution FROM f WHERE n = 1 AND position > 1",
    "relationship_rows": f"WITH rf AS (SELECT a.author, b.author AS other, count(*) AS n FROM ({_CITE}) x JOIN ({_EDGE}) a ON a.paper = x.citing JOIN ({_EDGE}) b ON b.paper = x.cited WHERE a.author <> b.author GROUP BY 1, 2) {_REL}",
    "linked_ids": "WITH l AS (SELECT rec_id, list_filter([nullif(paper_id, ''), 'X' || rec_id], lambda x: x IS NOT NULL) AS c FROM paper_records) SELECT rec_id, CAST(generate_subscripts(c, 1) - 1 AS INT) AS pos, unnest(c) AS cited FROM l",
    "indexed_papers": "SELECT paper_id AS paper, rec_id, title FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY rec_id) AS n FROM paper_records WHERE paper_id IS NOT NULL) WHERE n = 1 AND paper_id NOT IN (SELECT paper_id FROM paper_chunks WHERE paper_id IS NOT NULL)",
    "indexed_edges": "SELECT DISTINCT citing, cited FROM (SELECT paper_id AS citing, unnest(fields_of_study) AS cited FROM paper_records WHERE paper_id IS NOT NULL) WHERE cited IS NOT NULL",
    "index_counters": "SELECT count(*) AS records, count(*) FILTER (paper_id IN (SELECT paper_id FROM paper_chunks WHERE paper_id IS NOT NULL)) AS skipped, count(*) FILTER (paper_id IS NULL) AS errors FROM paper_records",
    "provider_merge": "WITH o AS (SELECT orcid, arg_max(works_count, profile_id) FILTER (works_count IS NOT NULL) AS w, arg_max(cited_by_count, profile_id) FILTER (cited_by_count IS NOT NULL) AS c FROM author_profiles WHERE source = 'openalex' AND orcid IS NOT NULL GROUP BY 1) SELECT p.profile_id, p.orcid, coalesce(o.w, works_count) AS works_count, coalesce(o.c, cited_by_count) AS cited_by_count FROM author_profiles p LEFT JOIN o ON o.orcid = p.orcid WHERE p.source = 'semantic_scholar'",
    "merged_authors": f"""WITH n AS (SELECT paper_id, min(rec_id) AS a, max(rec_id) AS b FROM paper_records WHERE paper_id IS NOT NULL GROUP BY 1 HAVING min(rec_id) < max(rec_id)),
      s AS (SELECT rec_id, pos, a.name AS name, a.orcid AS orcid, list_filter(a.institutions, lambda i: i.id IS NOT NULL)[1].id AS institution, nullif(lower(list_extract(string_split_regex(trim(a.name, ' '), '\\s+'), -1)), '') AS s FROM {_M}),
      h AS (SELECT n.paper_id AS paper, x.pos, y.orcid, y.institution, row_number() OVER (PARTITION BY n.paper_id, x.pos ORDER BY CASE y.pos - x.pos WHEN 0 THEN 0 WHEN -1 THEN 1 ELSE 2 END) AS t FROM n JOIN s x ON x.rec_id = n.a JOIN s y ON y.rec_id = n.b AND y.s = x.s AND abs(y.pos - x.pos) <= 1)
      SELECT n.paper_id AS paper, CAST(x.pos AS INT) AS pos, x.name, coalesce(h.orcid, x.orcid) AS orcid, coalesce(h.institution, x.institution) AS institution FROM n JOIN s x ON x.rec_id = n.a LEFT JOIN h ON h.paper = n.paper_id AND h.pos = x.pos AND h.t = 1""",
    "author_trust": f"{_TRUST} SELECT * FROM t",
    "trust_counters": f"{_TRUST} SELECT count(*) AS total, count(*) FILTER (compared) AS processed, count(*) FILTER (is_conflict) AS conflicts FROM t",
    "author_profiles": f"""WITH w AS (SELECT DISTINCT l_suppkey AS author, l_orderkey AS paper, year(o_orderdate) AS year FROM lineitem JOIN orders ON o_orderkey = l_orderkey), p AS (SELECT author, string_agg(CAST(paper AS VARCHAR), ',' ORDER BY n) AS papers FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY year DESC NULLS LAST, paper) AS n FROM w) WHERE n <= 20 GROUP BY 1),
      c AS (SELECT author, string_agg(CAST(co AS VARCHAR), ',' ORDER BY n) AS coauthors FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY k DESC, co) AS n FROM (SELECT a.author, b.author AS co, count(*) AS k FROM ({_EDGE}) a JOIN ({_EDGE}) b ON a.paper = b.paper AND a.author <> b.author GROUP BY 1, 2)) WHERE n <= 10 GROUP BY 1),
      q AS (SELECT author, count(*) FILTER (paper % 6 = 1) AS q1, count(*) FILTER (paper % 6 = 2) AS q2, count(*) FILTER (paper % 6 = 3) AS q3, count(*) FILTER (paper % 6 = 4) AS q4, count(*) FILTER (paper % 6 IN (0, 5)) AS unknown FROM w GROUP BY 1),
      s AS (SELECT l_suppkey AS author, max(o_orderdate) AS at FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
      SELECT s.author, papers, coauthors, q1, q2, q3, q4, unknown, CAST(s.at AS TIMESTAMP) < TIMESTAMP '1998-08-20' - INTERVAL 30 DAY AS needs_enrichment FROM s LEFT JOIN p ON p.author = s.author LEFT JOIN c ON c.author = s.author LEFT JOIN q ON q.author = s.author""",
    "author_quartiles": f"WITH a AS (SELECT venue, unnest(authors).author_id AS author FROM paper_records), j AS (SELECT a.author, upper(trim(j.quartile)) AS q FROM a LEFT JOIN {C.JOURNAL} j ON j.venue = a.venue WHERE a.author IS NOT NULL) SELECT author, count(*) FILTER (q = 'Q1') AS q1, count(*) FILTER (q = 'Q2') AS q2, count(*) FILTER (q = 'Q3') AS q3, count(*) FILTER (q = 'Q4') AS q4, count(*) FILTER (coalesce(q, '') NOT IN ('Q1', 'Q2', 'Q3', 'Q4')) AS unknown FROM j GROUP BY author",
    "compared_runs": f"WITH {C.PAPERS}, {C.QUESTIONS}, {bm25_sql('a', 'SELECT query_id, text FROM qq', 'pp', 'paper', {'title': 1.0}, 10)}, {bm25_sql('b', 'SELECT query_id, text FROM qq', 'pp', 'paper', {'title': 1.0, 'abstract': 1.0}, 20)}, n AS (SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(y.n, 0) - coalesce(x.n, 0) AS more FROM (SELECT query_id, count(*) AS n FROM a GROUP BY 1) x FULL JOIN (SELECT query_id, count(*) AS n FROM b GROUP BY 1) y ON x.query_id = y.query_id), s AS (SELECT a.query_id, count(*) AS shared FROM a JOIN b ON a.query_id = b.query_id AND a.key = b.key AND b.rank <= 10 GROUP BY 1) SELECT n.query_id, coalesce(s.shared, 0) AS shared, n.more FROM n LEFT JOIN s ON s.query_id = n.query_id",
    "search_variants": _variants_sql(),
    "id_hits": "WITH c AS (SELECT rec_id AS id, list_filter(list_transform(coalesce(fields_of_study, []), lambda x: trim(x, ' ')), lambda x: x <> '') AS a, list_filter(list_transform(coalesce(s2_fields_of_study, []), lambda x: trim(x.category, ' ')), lambda x: x <> '') AS b FROM paper_records) SELECT id, CAST(CASE WHEN list_has_any(a, b) THEN 1 ELSE 0 END AS DOUBLE) AS hit FROM c",
    "answer_validation": "WITH c AS (SELECT id, list_sort(list_distinct(list_concat([1, 2, coalesce(token_count, 0)], list_transform(regexp_extract_all(coalesce(text, ''), '\\(cite:(\\d+)\\)', 1), lambda x: CAST(x AS INT))))) AS c, id % 2 = 0 AS named, coalesce(paper_id, 'none') AS p FROM paper_chunks), f AS (SELECT id, list_filter(c, lambda x: x >= 0) AS c, CASE WHEN named THEN CASE WHEN p IN ('a', 'b') THEN 2 ELSE 3 END ELSE 2 END AS most, CASE WHEN named THEN 3 ELSE 0 END AS papers FROM c), g AS (SELECT id, CAST(len(c) AS INT) AS total, CAST(len(list_filter(c, lambda x: x BETWEEN 1 AND most)) AS INT) AS correct, papers FROM f) SELECT id, total, correct, total - correct AS hallucinated, CAST(greatest(0, papers - total) AS INT) AS missing, round(correct / total, 9) AS accuracy, round(least(1, correct / total), 9) AS overall FROM g",
    "written_back": "WITH s AS (SELECT cluster_id AS id, min(h_index) AS relevance, max(h_index) AS accuracy FROM author_records WHERE cluster_id IS NOT NULL GROUP BY 1), r AS (SELECT user_id AS id, arg_max(CAST(trunc(value) AS INT), event_id) AS f, arg_max(CAST(trunc(value) AS INT), event_id) FILTER (value > 50) AS v FROM events WHERE event_type NOT IN ('error', 'signup') AND user_id > 0 GROUP BY 1) SELECT s.id, coalesce(r.v, s.relevance) AS relevance, coalesce(r.f, s.accuracy) AS accuracy FROM s LEFT JOIN r ON r.id = s.id",
    "write_counters": "WITH v AS (SELECT CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN 0 ELSE user_id END AS v FROM events), k AS (SELECT DISTINCT cluster_id FROM author_records WHERE cluster_id IS NOT NULL) SELECT count(*) FILTER (v > 0) AS attempted, count(*) FILTER (v > 0 AND v IN (SELECT cluster_id FROM k)) AS updated, count(*) FILTER (v > 0 AND v NOT IN (SELECT cluster_id FROM k)) AS missing, count(*) FILTER (v <= 0) AS invalid, count(*) FILTER (v IS NULL) AS skipped_no_id FROM v",
    "progress_summary": "SELECT count(*) FILTER (label IS NOT NULL) AS done, count(*) FILTER (label = 'list_item') AS no_evidence, round(avg(token_count) FILTER (label IS NOT NULL), 9) AS score, count(*) FILTER (id NOT IN (SELECT id FROM paper_chunks WHERE label IS NOT NULL)) AS left FROM paper_chunks",
}
