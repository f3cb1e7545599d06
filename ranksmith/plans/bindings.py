"""Driver tables seen as the engine's inputs.

A market segment is a project, a customer a candidate; scores are whole hundredths made from order
totals, so that every engine computes the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksmith.session import dealt, table


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts for work that takes long on each: a table of some megabytes would be read by one task."""
    return dealt(table(spark, sf_dir, "part"), "p_partkey")


def candidate_scores(spark: SparkSession, sf_dir: str, before: str | None = None) -> DataFrame:
    """One score row for each customer; ``before`` keeps only orders up to that date."""
    orders = table(spark, sf_dir, "orders")
    if before:
        orders = orders.where(F.col("o_orderdate") < F.lit(before).cast("timestamp_ntz"))
    money = orders.groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"), F.count("*").alias("n"), F.min("o_orderdate").alias("created_at"))
    joined = table(spark, sf_dir, "customer").join(money, F.col("c_custkey") == F.col("o_custkey"), "left")
    cents = F.coalesce((F.col("total") * 100).cast("long"), F.lit(0))
    n = F.coalesce("n", F.lit(0))
    final = F.least(F.lit(10000), F.floor(cents / 30000)).cast("double") / 100
    return joined.select(
        F.col("c_mktsegment").alias("project_id"),
        F.col("c_custkey").alias("document_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com")).alias("email"),
        (F.col("c_acctbal") < 0).alias("is_knocked_out"),
        F.when(final >= 80, "SHORTLIST").when(final >= 40, "REVIEW").otherwise("REJECT").alias("recommendation"),
        final.alias("final_score"),
        F.least(F.lit(100), n * 7).cast("double").alias("skills_score"),
        F.least(F.lit(100), n * n).cast("double").alias("experience_score"),
        (F.lit(60) + F.col("c_custkey") % 40).cast("double").alias("confidence"),
        "created_at",
        F.col("c_nationkey").alias("nation_key"),
    )


def scores_sql(before: str | None = None) -> str:
    """The same rows for DuckDB, as a WITH list that defines ``scores``."""
    cond = f"WHERE o_orderdate < TIMESTAMP '{before} 00:00:00'" if before else ""
    return f"""
money AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total, count(*) AS n, min(o_orderdate) AS created_at FROM orders {cond} GROUP BY 1),
base AS (SELECT c.*, coalesce(CAST(m.total * 100 AS BIGINT), 0) AS cents, coalesce(m.n, 0) AS n, m.created_at FROM customer c LEFT JOIN money m ON c.c_custkey = m.o_custkey),
scores AS (SELECT c_mktsegment AS project_id, c_custkey AS document_id, c_name AS name,
  lower(replace(c_name, '#', '.')) || '@example.com' AS email, c_acctbal < 0 AS is_knocked_out,
  CAST(least(10000, cents // 30000) AS DOUBLE) / 100 AS final_score, CAST(least(100, n * 7) AS DOUBLE) AS skills_score,
  CAST(least(100, n * n) AS DOUBLE) AS experience_score, CAST(60 + c_custkey % 40 AS DOUBLE) AS confidence, created_at, c_nationkey AS nation_key FROM base)"""


LEVEL_SQL = "CASE WHEN final_score >= 80 THEN 'SHORTLIST' WHEN final_score >= 40 THEN 'REVIEW' ELSE 'REJECT' END"


def ranked_sql(before: str | None = None, name: str = "ranked") -> str:
    return f"""{scores_sql(before)},
leveled AS (SELECT *, {LEVEL_SQL} AS recommendation FROM scores),
{name} AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY is_knocked_out,
  CASE recommendation WHEN 'SHORTLIST' THEN 0 WHEN 'REVIEW' THEN 1 WHEN 'CONSIDER' THEN 2 ELSE 3 END,
  final_score DESC, skills_score DESC, experience_score DESC, confidence DESC, created_at ASC NULLS LAST, CAST(document_id AS VARCHAR)) AS rank_position,
  count(*) OVER (PARTITION BY project_id) AS n_project FROM leveled)"""
