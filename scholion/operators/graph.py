"""Bibliometric analytics over authorship, citation and affiliation edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coauthors(edges: DataFrame) -> DataFrame:
    """``(author, coauthor, papers)`` from distinct (paper, author) edges; nobody is their own co-author.

    A paper's authors are paired within the paper only. Null ids have no part.
    """
    e = edges.select("paper", "author").where("paper is not null and author is not null").distinct()
    both = e.alias("a").join(e.alias("b"), F.expr("a.paper = b.paper and a.author <> b.author"))
    return both.groupBy(F.col("a.author").alias("author"), F.col("b.author").alias("coauthor")).agg(F.count(F.lit(1)).alias("papers"))


def top_by(df: DataFrame, group: str, score: str, key: str, k: int) -> DataFrame:
    """The ``k`` rows of largest ``score`` in each group, ties to the smaller key."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc_nulls_last(), F.col(key))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def quartile_breakdown(rows: DataFrame, group: str, quartile: str) -> DataFrame:
    """Counts q1..q4 of each group, all else as ``unknown``; zeros are kept."""
    q = F.upper(F.trim(quartile))
    named = [F.count_if(q == f"Q{i}").alias(f"q{i}") for i in range(1, 5)]
    return rows.groupBy(group).agg(*named, F.count_if(q.isNull() | ~q.isin("Q1", "Q2", "Q3", "Q4")).alias("unknown"))


def counts_by_year(papers: DataFrame, citations: DataFrame) -> DataFrame:
    """``(year, papers, citations)`` of two tables with a ``year``; null years are left out, a missing side counts 0."""
    p = papers.where("year is not null").groupBy("year").agg(F.count(F.lit(1)).alias("papers"))
    c = citations.where("year is not null").groupBy("year").agg(F.count(F.lit(1)).alias("citations"))
    return p.join(c, "year", "full").select("year", F.coalesce("papers", F.lit(0)).alias("papers"), F.coalesce("citations", F.lit(0)).alias("citations"))


def citation_edges(references: DataFrame, papers: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Edges (citing, cited, citation_year, years_since) whose ends are both known papers; edges already there and repeats are left out."""
    known = papers.select("paper", "year")
    e = references.select("citing", "cited").where("citing <> cited").distinct()
    e = e.join(known.select(F.col("paper").alias("citing"), F.col("year").alias("citing_year")), "citing").join(known.select(F.col("paper").alias("cited"), F.col("year").alias("cited_year")), "cited")
    if existing is not None:
        e = e.join(existing.select("citing", "cited"), ["citing", "cited"], "left_anti")
    return e.select("citing", "cited", F.col("citing_year").alias("citation_year"), (F.col("citing_year") - F.col("cited_year")).alias("years_since"))


def referencing_authors(citations: DataFrame, edges: DataFrame) -> DataFrame:
    """``(author, other, citations)``: how often an author's papers cite another's; self-citations are left out."""
    a = edges.select(F.col("paper").alias("citing"), F.col("author"))
    b = edges.select(F.col("paper").alias("cited"), F.col("author").alias("other"))
    return citations.select("citing", "cited").join(a, "citing").join(b, "cited").where("author <> other").groupBy("author", "other").agg(F.count(F.lit(1)).alias("citations"))


def author_statistics(authors: DataFrame, average_of: str, flags: dict[str, Column]) -> DataFrame:
    """Total, counts by condition, and the average of a column over its non-null values; an average of 0 is null."""
    return authors.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(c).alias(n) for n, c in flags.items()), F.nullif(F.avg(average_of), F.lit(0.0)).alias("average"))


def career_metrics(works: DataFrame) -> DataFrame:
    """Per author: first year, papers, mean impact, last institution, mean position and whether mostly corresponding.

    ``works`` has author, paper, year, date, impact, institution, position and corresponding. The last institution is that of the newest
    dated work that names one, ties to the larger paper id; positions of null or 0 are left out of the mean.
    """
    position = F.when(F.col("position") > 0, F.col("position"))
    dated = F.when(F.col("institution").isNotNull() & F.col("date").isNotNull(), F.struct("date", "paper"))
    return works.groupBy("author").agg(
        F.min("year").alias("first_year"), F.countDistinct("paper").alias("papers"), F.avg("impact").alias("mean_impact"), F.max_by("institution", dated).alias("last_institution"),
        F.avg(position).alias("mean_position"), (F.avg(F.col("corresponding").cast("int")) > 0.5).alias("mostly_corresponding"),
    )


def trust_metrics(works: DataFrame, least_cited: int = 10) -> DataFrame:
    """Per author: papers, retracted papers and their rate (null without papers), and papers cited at least ``least_cited`` times."""
    g = works.groupBy("author").agg(F.count(F.lit(1)).alias("papers"), F.count_if(F.coalesce("retracted", F.lit(False))).alias("retracted"), F.count_if(F.col("citations") >= least_cited).alias("i10"))
    return g.withColumn("retracted_rate", F.col("retracted") / F.nullif(F.col("papers"), F.lit(0)))


def shared_identity(rows: DataFrame, key: str, identity: str) -> DataFrame:
    """Rows whose identity, not null, occurs in more than one row; counted by key first, so that no group is gathered."""
    many = rows.where(F.col(identity).isNotNull()).groupBy(identity).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return rows.select(key, identity).join(many, identity)


def affiliations(works: DataFrame, as_of_year: int) -> DataFrame:
    """Per author and institution: papers, first and last year, and whether the last is of this year or the one before."""
    g = works.where("institution is not null").groupBy("author", "institution").agg(F.countDistinct("paper").alias("papers"), F.min("year").alias("start_year"), F.max("year").alias("end_year"))
    return g.withColumn("is_current", F.coalesce(F.col("end_year") >= as_of_year - 1, F.lit(False)))


def institution_profile(works: DataFrame, highly_cited: int = 100) -> DataFrame:
    """Per institution: distinct papers and authors, citations, highly cited papers, true means of impact and open access."""
    papers = works.where("institution is not null").groupBy("institution", "paper").agg(F.max("citations").alias("citations"), F.max("impact").alias("impact"), F.max(F.col("open_access").cast("int")).alias("oa"))
    own = papers.groupBy("institution").agg(F.count(F.lit(1)).alias("papers"), F.sum(F.coalesce("citations", F.lit(0))).alias("citations"), F.count_if(F.col("citations") >= highly_cited).alias("highly_cited"), F.avg("impact").alias("mean_impact"), F.avg("oa").alias("open_access_ratio"))
    people = works.where("institution is not null").groupBy("institution").agg(F.countDistinct("author").alias("authors"))
    return own.join(people, "institution")


def field_distribution(topics: DataFrame, group: str, topic: str, k: int = 5) -> DataFrame:
    """The ``k`` most frequent topics of each group, ties to the smaller name."""
    counts = topics.where(F.col(topic).isNotNull()).groupBy(group, topic).agg(F.count(F.lit(1)).alias("n"))
    return top_by(counts, group, "n", topic, k)


def top_references(mentions: DataFrame, key: str, title: str, order: str, k: int) -> DataFrame:
    """The ``k`` keys mentioned most, ties to the earliest mention, with the first title given."""
    g = mentions.groupBy(key).agg(F.count(F.lit(1)).alias("mentions"), F.min(order).alias("first"), F.min_by(title, F.when(F.col(title).isNotNull(), F.col(order))).alias("title"))
    return g.orderBy(F.col("mentions").desc(), "first", key).limit(k).select(key, "mentions", "title")
