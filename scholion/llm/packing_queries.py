"""Queries of problem 8: filling containers with texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scholion.llm.packing import fill_containers, filling_report
from scholion.tables import table


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text and the container it is in."""
    return fill_containers(table(spark, sf_dir, "documents"))


def p8_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return filling_report(fill_containers(table(spark, sf_dir, "documents")))


QUERIES = {"p8_containers": p8_containers, "p8_filling": p8_filling}
SQL: dict[str, str] = {}
