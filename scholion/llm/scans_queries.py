"""Queries of problem 5: noise in text from scanned pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.llm.scans import repair_chunks, repair_scans
from scholion.tables import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of noise in each chunk."""
    return repair_scans(table(spark, sf_dir, "paper_chunks"), "id", "text", "paper_id", "chunk_id", "page_number", "section_title").select("id", F.explode("kinds").alias("kind"))


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's text after repair."""
    return repair_chunks(table(spark, sf_dir, "paper_chunks"))


QUERIES = {"p5_found": p5_found, "p5_repaired": p5_repaired}
SQL: dict[str, str] = {}
