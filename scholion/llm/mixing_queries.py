"""Queries of problem 9: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scholion.llm.mixing import mix, shares
from scholion.tables import table


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the mix in their order."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    targets = table(spark, sf_dir, "mix_targets")
    return shares(mix(table(spark, sf_dir, "documents"), targets), targets)


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
