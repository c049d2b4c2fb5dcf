"""Queries of problem 6: splitting oversized chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scholion.llm.splitting import split_chunks
from scholion.tables import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that came out in more than one piece."""
    return split_chunks(table(spark, sf_dir, "paper_chunks")).where("pieces > 1 and piece = 0").select("id").distinct()


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every chunk."""
    return split_chunks(table(spark, sf_dir, "paper_chunks"))


QUERIES = {"p6_found": p6_found, "p6_pieces": p6_pieces}
SQL = {"p6_found": r"SELECT DISTINCT id FROM paper_chunks WHERE len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]+')) > 600"}
