"""Queries of problem 7: spellings of one person's name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scholion.llm.people import person_pairs, resolve
from scholion.tables import table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of rows of one person."""
    return person_pairs(table(spark, sf_dir, "author_profiles"))


def p7_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The person of every row."""
    return resolve(table(spark, sf_dir, "author_profiles"))


QUERIES = {"p7_found": p7_found, "p7_people": p7_people}
SQL: dict[str, str] = {}
