"""Queries of problem 1: venues as typed to the reference list of journals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.llm.canonical import map_values, map_venues
from scholion.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal that each record's venue denotes."""
    found = map_venues(table(spark, sf_dir, "paper_records"), table(spark, sf_dir, "journals"))
    return found.where("source_id is not null").select("rec_id", "source_id").distinct()


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of the venues that denote no journal listed, with their number of records."""
    records = table(spark, sf_dir, "paper_records")
    found = map_values(records, "venue", table(spark, sf_dir, "journals"), "source_id", ["title", "title_normalized"], "publisher")
    counts = records.where("venue is not null").groupBy("venue").agg(F.count(F.lit(1)).alias("records"))
    return counts.join(found.where("source_id is null").select("venue", "score"), "venue")


QUERIES = {"p1_found": p1_found, "p1_unmatched": p1_unmatched}
SQL: dict[str, str] = {}
