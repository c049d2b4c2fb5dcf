"""Queries over the event log, in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.streaming import events as E
from scholion.tables import table


def event_type_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.type_summary(table(spark, sf_dir, "events"))


def replay_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.replay(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 5, 10).select("user_id", "event_id", "sequence")


def latest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.latest_progress(table(spark, sf_dir, "events"))


def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tumbling(table(spark, sf_dir, "events"), "1 hour").withColumn("total", F.round("total", 4))


def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tumbling(table(spark, sf_dir, "events"), "2 hours", "1 hour").select("start", "event_type", "n")


def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sessions(table(spark, sf_dir, "events"), "30 minutes")


QUERIES = {f.__name__: f for f in (event_type_summary, replay_from, latest_progress, tumbling_counts, sliding_counts, session_counts)}
SQL = {
    "event_type_summary": "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "replay_from": "SELECT user_id, event_id, sequence FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS sequence FROM events) WHERE sequence BETWEEN 5 AND 14",
    "latest_progress": "SELECT user_id, event_type AS phase, value AS progress, started, changed, events FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, min(ts) OVER w AS started, max(ts) OVER w AS changed, count(*) OVER w AS events FROM events WINDOW w AS (PARTITION BY user_id)) WHERE n = 1",
    "tumbling_counts": "SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3",
    "sliding_counts": "SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2",
    "session_counts": "WITH a AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE > ts THEN 0 ELSE 1 END AS fresh FROM events), b AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS n FROM b GROUP BY user_id, s",
}
