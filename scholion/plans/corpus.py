"""What the retrieval queries search: papers with titles, abstracts and vectors, their chunks, and stated query sets.

Records give the papers, documents of the same number their abstracts, and the embeddings, gone through in turn, all vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.tables import table

#: Vectors there are at every scale factor.
VECTORS = 500


def best_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest entry of each journal title: (venue, quartile, h_index, sjr_score)."""
    j = table(spark, sf_dir, "journals").groupBy(F.col("title").alias("venue")).agg(F.max_by(F.struct(F.col("sjr_best_quartile").alias("quartile"), "h_index", "sjr_score"), F.struct("data_year", "id")).alias("j"))
    return j.select("venue", "j.*")


def vector_of(rows: DataFrame, spark: SparkSession, sf_dir: str, number) -> DataFrame:
    """Rows with the ``vector`` whose id is ``number`` modulo the vectors there are."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("vector"))
    return rows.withColumn("vec_id", F.pmod(number, F.lit(VECTORS))).join(e, "vec_id", "left").drop("vec_id")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper, rec_id, title, abstract, year, citations, quartile, doi, ids, vector), a row a paper id."""
    first = table(spark, sf_dir, "paper_records").where("paper_id is not null").groupBy(F.col("paper_id").alias("paper")).agg(F.min_by(F.struct("rec_id", "title", "venue", "year", "citation_count", "external_ids"), "rec_id").alias("r")).select("paper", "r.*")
    abstracts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec_id"), F.col("text").alias("abstract"))
    rows = first.join(abstracts, "rec_id", "left").join(best_journal(spark, sf_dir).select("venue", "quartile"), "venue", "left")
    rows = rows.select("paper", "rec_id", "title", "abstract", "year", F.col("citation_count").alias("citations"), "quartile", F.col("external_ids")["DOI"].alias("doi"), F.col("external_ids").alias("ids"))
    return vector_of(rows, spark, sf_dir, F.col("rec_id"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper, chunk_id, section, text, vector) of the chunks with a paper and a text."""
    c = table(spark, sf_dir, "paper_chunks").where("paper_id is not null and text is not null")
    return vector_of(c.select(F.col("paper_id").alias("paper"), F.col("id").cast("string").alias("chunk_id"), F.col("section_title").alias("section"), "text", "id"), spark, sf_dir, F.col("id")).drop("id")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated query set (query_id, text, vector): titles of the records whose id is divisible by 50."""
    r = table(spark, sf_dir, "paper_records").where("rec_id % 50 = 0 and title is not null").select(F.col("rec_id").alias("query_id"), F.col("title").alias("text"))
    return vector_of(r, spark, sf_dir, F.col("query_id"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-queries (query_id, part, text, vector) of the stated queries: the title and the venue."""
    r = table(spark, sf_dir, "paper_records").where("rec_id % 50 = 0 and title is not null")
    p = r.select(F.col("rec_id").alias("query_id"), F.posexplode(F.array("title", "venue")).alias("part", "text")).where("text is not null")
    return vector_of(p, spark, sf_dir, F.col("query_id") + F.col("part"))


def scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit lists of papers (query_id, paper) of the stated queries: those of the ten records from the query's on."""
    r = table(spark, sf_dir, "paper_records")
    listed = r.where("rec_id % 50 = 0 and title is not null").select(F.col("rec_id").alias("query_id"), F.explode(F.expr("sequence(rec_id, rec_id + 9)")).alias("rec_id"))
    return listed.join(r.where("paper_id is not null").select("rec_id", F.col("paper_id").alias("paper")), "rec_id").select("query_id", "paper").distinct()


JOURNAL = "(SELECT title AS venue, sjr_best_quartile AS quartile, h_index, sjr_score FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY data_year DESC, id DESC) AS n FROM journals) WHERE n = 1)"
PAPERS = f"pp AS (SELECT r.paper_id AS paper, r.rec_id, r.title, d.text AS abstract, r.year, r.citation_count AS citations, j.quartile, r.external_ids['DOI'] AS doi, r.external_ids AS ids, e.embedding AS vector FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY rec_id) AS n FROM paper_records WHERE paper_id IS NOT NULL) r LEFT JOIN documents d ON d.doc_id = r.rec_id LEFT JOIN {JOURNAL} j ON j.venue = r.venue LEFT JOIN embeddings e ON e.vec_id = r.rec_id % {VECTORS} WHERE r.n = 1)"
CHUNKS = f"cc AS (SELECT c.paper_id AS paper, CAST(c.id AS VARCHAR) AS chunk_id, c.section_title AS section, c.text, e.embedding AS vector FROM paper_chunks c LEFT JOIN embeddings e ON e.vec_id = c.id % {VECTORS} WHERE c.paper_id IS NOT NULL AND c.text IS NOT NULL)"
QUESTIONS = f"qq AS (SELECT r.rec_id AS query_id, r.title AS text, e.embedding AS vector FROM paper_records r LEFT JOIN embeddings e ON e.vec_id = r.rec_id % {VECTORS} WHERE r.rec_id % 50 = 0 AND r.title IS NOT NULL)"
PARTS = f"sq AS (SELECT p.query_id * 2 + p.part AS sid, p.*, e.embedding AS vector FROM (SELECT rec_id AS query_id, 0 AS part, title AS text FROM paper_records WHERE rec_id % 50 = 0 AND title IS NOT NULL UNION ALL SELECT rec_id, 1, venue FROM paper_records WHERE rec_id % 50 = 0 AND title IS NOT NULL AND venue IS NOT NULL) p LEFT JOIN embeddings e ON e.vec_id = (p.query_id + p.part) % {VECTORS})"
SCOPE = "sc AS (SELECT DISTINCT q.rec_id AS query_id, r.paper_id AS paper FROM paper_records q JOIN paper_records r ON r.rec_id BETWEEN q.rec_id AND q.rec_id + 9 AND r.paper_id IS NOT NULL WHERE q.rec_id % 50 = 0 AND q.title IS NOT NULL)"
