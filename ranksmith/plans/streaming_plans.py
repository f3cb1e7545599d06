"""Window queries over the event table; the same functions run on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksmith.session import table
from ranksmith.streaming import windows as S

from .catalogue import query


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_event_time(table(spark, sf_dir, "events"))


def _plain(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, CAST(floor(sum(CAST(value AS DECIMAL(18,2)))) AS BIGINT) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("value", F.col("value").cast("decimal(18,2)"))
    return S.tumbling(e, "ts", "1 hour", "event_type").select(_plain("start"), "event_type", "n", F.floor("total").cast("long").alias("total"))


@query(
    """WITH k AS (SELECT time_bucket(INTERVAL 1 hour, ts) - INTERVAL 1 hour * unnest([0, 1]) AS start, event_type FROM events)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM k GROUP BY ALL"""
)
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sliding(_events(spark, sf_dir), "ts", "2 hours", "1 hour", "event_type").select(_plain("start"), "event_type", "n")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 hour THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(date_trunc('second', min(ts)), '%Y-%m-%d %H:%M:%S') AS start, strftime(date_trunc('second', max(ts) + INTERVAL 6 hour), '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sessions(_events(spark, sf_dir), "ts", "6 hours", "user_id").select("user_id", _plain("start"), _plain("end"), "n")


@query(
    """WITH u AS (SELECT event_id, sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 second PRECEDING AND CURRENT ROW) AS used FROM events)
SELECT event_id, CAST(used AS BIGINT) AS used, used <= 90 AS admitted FROM u"""
)
def token_budget_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("cost", F.floor("value").cast("long"))
    return S.token_budget(e, "user_id", "ts", "cost", "event_id", 100, 0.1, 3600).select("event_id", "used", "admitted")
