"""Queries of the bibliometric operators. Orders stand for papers, line items for authorships, suppliers for authors, parts for topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.functions import score as S
from scholion.operators import graph as G
from scholion.tables import table

AS_OF = 2025


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_suppkey").alias("author"))


def _works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authorships with their paper's date and the author's nation as institution."""
    l, o, s = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier"))
    w = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return w.select(
        F.col("l_suppkey").alias("author"), F.col("l_orderkey").alias("paper"), F.year("o_orderdate").alias("year"), F.col("o_orderdate").alias("date"), F.col("l_quantity").alias("impact"),
        F.when(F.col("l_discount") > 0.02, F.col("s_nationkey")).alias("institution"), F.col("l_linenumber").alias("position"), (F.col("l_returnflag") == "R").alias("corresponding"),
        F.col("l_quantity").cast("long").alias("citations"), (F.col("l_linestatus") == "O").alias("retracted"), (F.col("l_tax") > 0.04).alias("open_access"),
    )


def coauthors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.top_by(G.coauthors(_edges(spark, sf_dir)), "author", "papers", "coauthor", 10).select("author", "coauthor", "papers", "rank")


def quartile_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.quartile_breakdown(table(spark, sf_dir, "journals"), "country", "sjr_best_quartile")


def counts_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "paper_records").select(F.coalesce("year", F.substring("publication_date", 1, 4).try_cast("int")).alias("year"))
    c = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"))
    return G.counts_by_year(p, c)


def citation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line's paper cites the paper whose id is its part's."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper"), F.year("o_orderdate").alias("year"))
    return G.citation_edges(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited")), o)


def referencing_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = citation_edges(spark, sf_dir)
    return G.top_by(G.referencing_authors(cited, _edges(spark, sf_dir).distinct()), "author", "citations", "other", 5).select("author", "other", "citations", "rank")


def citing_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every cited paper, its number of citing papers and the newest year of one."""
    return citation_edges(spark, sf_dir).groupBy("cited").agg(F.count(F.lit(1)).alias("citations"), F.max("citation_year").alias("newest"))


def author_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "author_records")
    return G.author_statistics(a, "h_index", {"verified": F.coalesce("verified", F.lit(False)), "with_orcid": F.col("orcid").isNotNull(), "with_papers": F.col("paper_count") > 0}).withColumn("average", F.round("average", 9))


def institution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and mean papers by country, by type, and over all: one pass by grouping sets."""
    i = table(spark, sf_dir, "institutions")
    g = i.groupingSets([["country_code"], ["type"], []], "country_code", "type").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.avg("total_papers"), 9).alias("mean_papers"))
    return g


def career_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = G.career_metrics(_works(spark, sf_dir))
    return m.withColumn("mean_impact", F.round("mean_impact", 9)).withColumn("mean_position", F.round("mean_position", 9))


def trust_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.trust_metrics(_works(spark, sf_dir)).withColumn("retracted_rate", F.round("retracted_rate", 9))


def duplicate_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shared_identity(table(spark, sf_dir, "author_profiles"), "profile_id", "orcid").select("profile_id", "orcid", "rows")


def affiliations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.affiliations(_works(spark, sf_dir), 1998)


def institution_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = G.institution_profile(_works(spark, sf_dir), 40)
    score = S.institution_score(F.col("papers"), F.col("citations"), S.h_index_estimate(F.col("citations"), F.col("papers")), F.col("highly_cited"), F.col("mean_impact") / 25, F.lit(0), F.col("authors"))
    return p.select("institution", "papers", "citations", "highly_cited", F.round("mean_impact", 9).alias("mean_impact"), F.round("open_access_ratio", 9).alias("open_access_ratio"), "authors", F.round(score, 9).alias("score"))


def field_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent of the first three fields of study of each venue's records, with the venue's strength in them."""
    r = table(spark, sf_dir, "paper_records").where("venue is not null")
    t = r.select("venue", F.explode(F.slice("fields_of_study", 1, 3)).alias("field"))
    n = r.groupBy("venue").agg(F.count(F.lit(1)).alias("papers"))
    top = G.field_distribution(t, "venue", "field").join(n, "venue")
    return top.select("venue", "field", "n", "rank", F.round(S.field_strength(F.col("n"), F.col("papers")), 9).alias("strength"))


def top_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "paper_chunks").select("paper_id", "section_title", "id")
    return G.top_references(m, "paper_id", "section_title", "id", 20)


def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose paper id is listed more than once by their source, with their number and place; no group is gathered."""
    r = table(spark, sf_dir, "paper_records").where("source is not null and paper_id is not null")
    many = r.groupBy("source", "paper_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return r.select("source", "paper_id", "rec_id").join(many, ["source", "paper_id"])


QUERIES = {
    f.__name__: f
    for f in (coauthors, quartile_breakdown, counts_by_year, citation_edges, referencing_authors, citing_papers, author_stats, institution_stats, career_metrics, trust_metrics, duplicate_identity, affiliations, institution_profile, field_distribution, top_references, repeated_ids)
}

_EDGE = "SELECT DISTINCT l_orderkey AS paper, l_suppkey AS author FROM lineitem"
_CITE = "SELECT DISTINCT l.l_orderkey AS citing, l.l_partkey AS cited, CAST(year(a.o_orderdate) AS INT) AS citation_year, CAST(year(a.o_orderdate) - year(b.o_orderdate) AS INT) AS years_since FROM lineitem l JOIN orders a ON a.o_orderkey = l.l_orderkey JOIN orders b ON b.o_orderkey = l.l_partkey WHERE l.l_orderkey <> l.l_partkey"
_WORK = """SELECT l_suppkey AS author, l_orderkey AS paper, year(o_orderdate) AS year, o_orderdate AS date, l_quantity AS impact, CASE WHEN l_discount > 0.02 THEN s_nationkey END AS institution, l_linenumber AS position,
 l_returnflag = 'R' AS corresponding, CAST(l_quantity AS BIGINT) AS citations, l_linestatus = 'O' AS retracted, l_tax > 0.04 AS open_access FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey"""
SQL = {
    "coauthors": f"WITH e AS ({_EDGE}), c AS (SELECT a.author, b.author AS coauthor, count(*) AS papers FROM e a JOIN e b ON a.paper = b.paper AND a.author <> b.author GROUP BY 1, 2) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY author ORDER BY papers DESC, coauthor) AS INT) AS rank FROM c) WHERE rank <= 10",
    "quartile_breakdown": "SELECT country, count(*) FILTER (upper(trim(sjr_best_quartile)) = 'Q1') AS q1, count(*) FILTER (upper(trim(sjr_best_quartile)) = 'Q2') AS q2, count(*) FILTER (upper(trim(sjr_best_quartile)) = 'Q3') AS q3, count(*) FILTER (upper(trim(sjr_best_quartile)) = 'Q4') AS q4, count(*) FILTER (coalesce(upper(trim(sjr_best_quartile)), '') NOT IN ('Q1', 'Q2', 'Q3', 'Q4')) AS unknown FROM journals GROUP BY country",
    "counts_by_year": "WITH p AS (SELECT year, count(*) AS papers FROM (SELECT coalesce(year, TRY_CAST(substr(publication_date, 1, 4) AS INT)) AS year FROM paper_records) WHERE year IS NOT NULL GROUP BY 1), c AS (SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS citations FROM orders GROUP BY 1) SELECT coalesce(p.year, c.year) AS year, coalesce(papers, 0) AS papers, coalesce(citations, 0) AS citations FROM p FULL JOIN c ON p.year = c.year",
    "citation_edges": _CITE,
    "citing_papers": f"SELECT cited, count(*) AS citations, max(citation_year) AS newest FROM ({_CITE}) GROUP BY cited",
    "referencing_authors": f"WITH e AS ({_EDGE}), c AS (SELECT a.author, b.author AS other, count(*) AS citations FROM ({_CITE}) x JOIN e a ON a.paper = x.citing JOIN e b ON b.paper = x.cited WHERE a.author <> b.author GROUP BY 1, 2) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY author ORDER BY citations DESC, other) AS INT) AS rank FROM c) WHERE rank <= 5",
    "author_stats": "SELECT count(*) AS total, count(*) FILTER (coalesce(verified, false)) AS verified, count(*) FILTER (orcid IS NOT NULL) AS with_orcid, count(*) FILTER (paper_count > 0) AS with_papers, round(nullif(avg(h_index), 0), 9) AS average FROM author_records",
    "institution_stats": "SELECT country_code, type, CAST(grouping(country_code, type) AS INT) AS level, count(*) AS n, round(avg(total_papers), 9) AS mean_papers FROM institutions GROUP BY GROUPING SETS ((country_code), (type), ())",
    "career_metrics": f"SELECT author, CAST(min(year) AS INT) AS first_year, count(DISTINCT paper) AS papers, round(avg(impact), 9) AS mean_impact, arg_max(institution, (date, paper)) FILTER (institution IS NOT NULL AND date IS NOT NULL) AS last_institution, round(avg(position) FILTER (position > 0), 9) AS mean_position, avg(CAST(corresponding AS INT)) > 0.5 AS mostly_corresponding FROM ({_WORK}) GROUP BY author",
    "trust_metrics": f"SELECT author, count(*) AS papers, count(*) FILTER (retracted) AS retracted, count(*) FILTER (citations >= 10) AS i10, round(count(*) FILTER (retracted) / count(*), 9) AS retracted_rate FROM ({_WORK}) GROUP BY author",
    "duplicate_identity": "SELECT profile_id, orcid, count(*) OVER (PARTITION BY orcid) AS rows FROM author_profiles WHERE orcid IS NOT NULL QUALIFY count(*) OVER (PARTITION BY orcid) > 1",
    "affiliations": f"SELECT author, institution, count(DISTINCT paper) AS papers, CAST(min(year) AS INT) AS start_year, CAST(max(year) AS INT) AS end_year, max(year) >= 1997 AS is_current FROM ({_WORK}) WHERE institution IS NOT NULL GROUP BY 1, 2",
    "institution_profile": f"""WITH w AS ({_WORK}), p AS (SELECT institution, paper, max(citations) AS citations, max(impact) AS impact, max(CAST(open_access AS INT)) AS oa FROM w WHERE institution IS NOT NULL GROUP BY 1, 2),
      g AS (SELECT institution, count(*) AS papers, CAST(sum(citations) AS BIGINT) AS citations, count(*) FILTER (citations >= 40) AS highly_cited, avg(impact) AS mean_impact, avg(oa) AS open_access_ratio FROM p GROUP BY 1),
      a AS (SELECT institution, count(DISTINCT author) AS authors FROM w WHERE institution IS NOT NULL GROUP BY 1)
      SELECT g.institution, papers, citations, highly_cited, round(mean_impact, 9) AS mean_impact, round(open_access_ratio, 9) AS open_access_ratio, authors,
        round(least(100, least(20, 5 * log10(papers + 1)) + least(25, 3 * log10(citations + 1)) + least(20, least(floor(sqrt(citations)), papers) / 5.0) + 15.0 * highly_cited / papers + least(10, 5 * mean_impact / 25) + least(5, 0.5 * authors)), 9) AS score FROM g JOIN a ON a.institution = g.institution""",
    "field_distribution": "WITH t AS (SELECT venue, unnest(fields_of_study[1:3]) AS field FROM paper_records WHERE venue IS NOT NULL), c AS (SELECT venue, field, count(*) AS n FROM t WHERE field IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY venue ORDER BY n DESC, field) AS INT) AS rank FROM c), v AS (SELECT venue, count(*) AS papers FROM paper_records GROUP BY 1) SELECT r.venue, field, n, rank, round(least(50, 15 * log10(n + 1)) + 50.0 * n / papers, 9) AS strength FROM r JOIN v ON v.venue = r.venue WHERE rank <= 5",
    "top_references": "SELECT paper_id, count(*) AS mentions, arg_min(section_title, id) AS title FROM paper_chunks GROUP BY paper_id ORDER BY count(*) DESC, min(id), paper_id LIMIT 20",
    "repeated_ids": "SELECT source, paper_id, rec_id, count(*) OVER (PARTITION BY source, paper_id) AS rows FROM paper_records WHERE source IS NOT NULL AND paper_id IS NOT NULL QUALIFY count(*) OVER (PARTITION BY source, paper_id) > 1",
}
