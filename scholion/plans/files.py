"""Round trips of the sources and sinks: tables are written in the form of a source and read back by it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.operators.search import normalized_weights
from scholion.sources import files as S
from scholion.tables import scratch, table


def journal_ranking_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest entries of the journal list as a ranking file with semicolons and decimal commas."""
    j = table(spark, sf_dir, "journals").where("data_year = 2023")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if isinstance(c, str) else F.coalesce(c.cast("string"), F.lit(""))
    values = {"Sourceid": text("source_id"), "Title": text("title"), "Type": text("type"), "Issn": text(F.array_join("issn", ", ")), "Publisher": text("publisher"), "Country": text("country"), "SJR": F.regexp_replace(text("sjr_score"), r"\.", ","), "SJR Best Quartile": F.coalesce("sjr_best_quartile", F.lit("-")), "H index": text("h_index"), "Categories": text(F.array_join("categories", ";")), "Open Access": F.when(F.col("is_open_access"), "Yes").otherwise("No")}
    rows = j.select(*(values.get(n, F.lit("")).alias(n.format(year=2023)) for n in S._RANKING))
    path = scratch(spark, "scimagojr_2023.csv")
    rows.coalesce(1).write.option("header", True).option("sep", ";").option("escape", '"').option("quoteAll", True).csv(path)  # a file with one header, as the source has it
    r = S.read_journal_ranking(spark, path)
    return r.select("source_id", F.array_join("issn", ",").alias("issn"), "sjr_score", "sjr_best_quartile", "h_index", F.size("categories").alias("categories"), "is_open_access", "data_year")


def conference_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journals as lines of a conference list, some of them too short and some without a number."""
    j = table(spark, sf_dir, "journals")
    cells = F.concat_ws(",", F.when(F.col("id") % 7 == 0, "x").otherwise(F.col("id").cast("string")), F.concat(F.lit('"'), F.regexp_replace("title", '"', '""'), F.lit('"')), F.lit("AB"), F.lit("core"), F.coalesce("sjr_best_quartile", F.lit("")), F.when(F.col("is_open_access"), "Yes").otherwise("no"), F.lit("46"), F.lit(""), F.lit("08"))
    path = scratch(spark, "core")
    j.select(F.when(F.col("id") % 5 == 0, F.substring_index(cells, ",", 2)).otherwise(cells).alias("value")).write.text(path)
    return S.read_conference_ranking(spark, path).select("core_id", "acronym", "rank", "is_primary", "for_codes")


def qrels_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "paper_records").where("paper_id is not null and citation_count is not null")
    path = scratch(spark, "qrels.tsv")
    r.select(F.col("rec_id").alias("query-id"), F.col("paper_id").alias("corpus-id"), (F.col("citation_count") % 3).alias("score")).write.option("sep", "\t").option("header", True).csv(path)
    return S.read_qrels(spark, path)


def corpus_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lines of JSON with blank lines between."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    path = scratch(spark, "corpus.jsonl")
    d.select(F.concat(F.to_json(F.struct(F.col("doc_id").cast("string").alias("_id"), F.col("section_title").alias("title"), "text")), F.lit("\n")).alias("value")).write.text(path)
    return S.read_corpus(spark, path).select("key", "title", F.md5("text").alias("text"))


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with NUL characters written by paper and read back."""
    path = scratch(spark, "chunks")
    c = table(spark, sf_dir, "paper_chunks").select("id", "paper_id", F.concat(F.lit("a\0"), "text").alias("text"))
    S.write_chunks(c, path, 8)
    return spark.read.parquet(path).select("id", "paper_id", F.md5("text").alias("text"))


def export_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with lists exported as CSV and read back with their lists."""
    path = scratch(spark, "export")
    S.write_export(table(spark, sf_dir, "paper_records").select("rec_id", "title", "fields_of_study"), path)
    r = S.read_csv_with_json(spark, path, ["rec_id", "title", "fields_of_study"], ["fields_of_study"])
    return r.select(F.col("rec_id").cast("long"), F.md5(F.coalesce("title", F.lit(""))).alias("title"), F.array_join(F.coalesce("fields_of_study", F.array().cast("array<string>")), "|").alias("fields"))


def appended_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one source, then of both, appended: each id once."""
    path = scratch(spark, "log")
    r = table(spark, sf_dir, "paper_records").select("rec_id", "source")
    for part in (r.where("source = 'openalex'"), r, r):
        S.append_new(part, path, "rec_id")
    return spark.read.parquet(path)


def selected_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as questions with their paper's id as DOI; listed exceptions replace or drop it, and only ids of chunks are known."""
    r = table(spark, sf_dir, "paper_records").where("title is not null and paper_id is not null")
    q = r.select(F.col("rec_id").alias("id"), F.col("title").alias("question"), F.upper("paper_id").alias("doi"), F.coalesce("is_open_access", F.lit(False)).alias("is_opensource"))
    ids = r.select("paper_id").distinct()
    ex = ids.where(F.length("paper_id") == 12).select(F.col("paper_id").alias("doi"), F.when(F.substring("paper_id", -1, 1) < "5", F.concat(F.substring("paper_id", 1, 11), F.lit("9"))).alias("ver_doi")).where(F.substring("doi", -1, 1) < "7")
    known = table(spark, sf_dir, "paper_records").where("paper_id is not null and year > 2000").select(F.col("paper_id").alias("doi"))
    return S.select_questions(q, ex, known).select("id", "doi")


def fusion_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised weights of a fusion for given ones."""
    given = [(0.0, 0.0), (1.0, 3.0), (-1.0, 0.5), (2.0, 0.0)]
    return spark.createDataFrame([(a, b, *normalized_weights(a, b)) for a, b in given], "a double, b double, lexical double, semantic double")


QUERIES = {f.__name__: f for f in (journal_ranking_file, conference_file, qrels_file, corpus_file, chunk_table, export_file, appended_rows, selected_questions, fusion_weights)}

SQL = {
    "journal_ranking_file": "SELECT source_id, coalesce(array_to_string(list_filter(list_transform(issn, lambda x: trim(x, ' ')), lambda x: x <> ''), ','), '') AS issn, sjr_score, nullif(upper(trim(sjr_best_quartile, ' ')), '-') AS sjr_best_quartile, h_index, CAST(coalesce(len(list_filter(categories, lambda x: trim(x, ' ') <> '')), 0) AS INT) AS categories, coalesce(is_open_access, false) AS is_open_access, CAST(2023 AS INT) AS data_year FROM journals WHERE data_year = 2023",
    "conference_file": "SELECT CAST(id AS INT) AS core_id, 'AB' AS acronym, coalesce(nullif(trim(sjr_best_quartile, ' '), ''), 'Unranked') AS rank, coalesce(is_open_access, false) AS is_primary, '46,08' AS for_codes FROM journals WHERE id % 5 <> 0 AND id % 7 <> 0",
    "qrels_file": "SELECT CAST(rec_id AS VARCHAR) AS query_id, paper_id AS key, CAST(citation_count % 3 AS INT) AS rel FROM paper_records WHERE paper_id IS NOT NULL AND citation_count % 3 <> 0",
    "corpus_file": "SELECT CAST(doc_id AS VARCHAR) AS key, section_title AS title, md5(text) AS text FROM documents WHERE text IS NOT NULL",
    "chunk_table": "SELECT id, paper_id, md5('a' || text) AS text FROM paper_chunks",
    "export_file": "SELECT rec_id, md5(coalesce(title, '')) AS title, coalesce(array_to_string(fields_of_study, '|'), '') AS fields FROM paper_records",
    "appended_rows": "SELECT rec_id, source FROM paper_records",
    "selected_questions": """WITH q AS (SELECT rec_id, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'), ' ')) AS k, lower(paper_id) AS d FROM paper_records WHERE title IS NOT NULL AND paper_id IS NOT NULL AND is_open_access),
      e AS (SELECT rec_id, k, CASE WHEN length(d) = 12 AND substr(d, 12, 1) < '5' THEN substr(d, 1, 11) || '9' ELSE d END AS d FROM q WHERE NOT (length(d) = 12 AND substr(d, 12, 1) >= '5' AND substr(d, 12, 1) < '7')),
      f AS (SELECT * FROM e WHERE d IN (SELECT lower(paper_id) FROM paper_records WHERE paper_id IS NOT NULL AND year > 2000)) SELECT min(rec_id) AS id, arg_min(d, rec_id) AS doi FROM f GROUP BY k""",
    "fusion_weights": "SELECT a, b, lexical, semantic FROM (VALUES (CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0.1 AS DOUBLE), CAST(0.9 AS DOUBLE)), (1, 3, 0.25, 0.75), (-1, 0.5, 0.1, 0.9), (2, 0, 1, 0)) t(a, b, lexical, semantic)",
}
