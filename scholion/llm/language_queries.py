"""Queries of problem 10: languages of documents and passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scholion.llm.language import fit, mislabelled, passages
from scholion.tables import table


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the documents whose label is missing or wrong."""
    documents = table(spark, sf_dir, "documents")
    return mislabelled(documents, fit(documents))


def p10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage with its language and confidence."""
    documents = table(spark, sf_dir, "documents")
    return passages(documents, fit(documents))


QUERIES = {"p10_found": p10_found, "p10_passages": p10_passages}
SQL: dict[str, str] = {}
