"""Queries of the nested-record operators (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.operators.nested import bare_id, flatten_child, flatten_topics, nested_keys
from scholion.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_keys(table(spark, sf_dir, "paper_records"))


def p3_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every author place of every record."""
    out = flatten_child(table(spark, sf_dir, "paper_records"), ["rec_id"], "authors", [], {"name": "string", "author_id": "string", "orcid": "string"})
    return out.withColumnRenamed("pos_0", "author_pos")


def p3_institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every institution of every author place, linked to both."""
    out = flatten_child(table(spark, sf_dir, "paper_records"), ["rec_id"], "authors", ["institutions"], {"id": "string", "display_name": "string", "country_code": "string", "type": "string"})
    return out.select("rec_id", F.col("pos_0").alias("author_pos"), F.col("pos_1").alias("institution_pos"), bare_id(F.col("id"), "I").alias("institution_id"), "display_name", "country_code", "type")


def p3_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every topic of every nested document."""
    out = flatten_topics(table(spark, sf_dir, "paper_records"), ["rec_id"])
    return out.select("rec_id", F.col("pos_0").alias("topic_pos"), bare_id(F.col("id"), "T").alias("topic_id"), "display_name", "score", "subfield", "field", "domain")


def p3_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineage ids, three levels down, as their own table would need arrays of plain values: kept with their institution."""
    records = table(spark, sf_dir, "paper_records")
    flat = records.select("rec_id", F.posexplode("authors").alias("author_pos", "a")).select("rec_id", "author_pos", F.posexplode("a.institutions").alias("institution_pos", "i"))
    return flat.select("rec_id", "author_pos", "institution_pos", F.posexplode("i.lineage").alias("lineage_pos", "lineage_id"))


QUERIES = {"p3_found": p3_found, "p3_authors": p3_authors, "p3_institutions": p3_institutions, "p3_topics": p3_topics, "p3_lineage": p3_lineage}

_AUTHORS = "SELECT rec_id, generate_subscripts(authors, 1) - 1 AS author_pos, unnest(authors) AS a FROM paper_records"
_INSTITUTIONS = f"SELECT rec_id, author_pos, generate_subscripts(a.institutions, 1) - 1 AS institution_pos, unnest(a.institutions) AS i FROM ({_AUTHORS}) WHERE a IS NOT NULL"

SQL = {
    "p3_authors": f"SELECT rec_id, CAST(author_pos AS INT) AS author_pos, a.name AS name, a.author_id AS author_id, a.orcid AS orcid FROM ({_AUTHORS})",
    "p3_institutions": f"""
        SELECT rec_id, CAST(author_pos AS INT) AS author_pos, CAST(institution_pos AS INT) AS institution_pos,
               nullif(regexp_extract(upper(trim(i.id)), '(?:^|[/:\\s])(I\\d+)/*$', 1), '') AS institution_id,
               i.display_name AS display_name, i.country_code AS country_code, i.type AS type
        FROM ({_INSTITUTIONS})""",
    "p3_lineage": f"""
        SELECT rec_id, CAST(author_pos AS INT) AS author_pos, CAST(institution_pos AS INT) AS institution_pos,
               CAST(generate_subscripts(i.lineage, 1) - 1 AS INT) AS lineage_pos, unnest(i.lineage) AS lineage_id
        FROM ({_INSTITUTIONS}) WHERE i IS NOT NULL""",
}
