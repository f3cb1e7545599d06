"""Ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksmith.operators import ranking as R
from ranksmith.session import table

from .bindings import candidate_scores, ranked_sql
from .catalogue import query


def ranked(spark: SparkSession, sf_dir: str, before: str | None = None) -> DataFrame:
    """Ranked by ranges, so a project with a large share of all candidates is spread as well."""
    return R.rank_spread(candidate_scores(spark, sf_dir, before))


@query(f"WITH {ranked_sql()} SELECT project_id, document_id, name, final_score, recommendation, CAST(rank_position AS INTEGER) AS rank_position, round((n_project - rank_position + 1) / n_project * 100, 2) AS percentile FROM ranked WHERE rank_position <= 10")
def leaderboard_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.leaderboard(candidate_scores(spark, sf_dir), 10).select("project_id", "document_id", "name", "final_score", "recommendation", "rank_position", "percentile")


@query(f"WITH {ranked_sql()} SELECT document_id, project_id, CAST(rank_position AS INTEGER) AS rank_position, round((n_project - rank_position + 1) / n_project * 100, 2) AS percentile FROM ranked")
def spread_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rank_spread(candidate_scores(spark, sf_dir), parts=16).select("document_id", "project_id", "rank_position", "percentile")


@query(f"WITH {ranked_sql()} SELECT document_id, project_id, CAST(rank_position AS INTEGER) AS rank_position, round((n_project - rank_position + 1) / n_project * 100, 2) AS percentile FROM ranked")
def full_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).select("document_id", "project_id", "rank_position", "percentile")


@query(
    f"""WITH now_ AS (WITH {ranked_sql()} SELECT * FROM ranked), then_ AS (WITH {ranked_sql("1996-01-01")} SELECT * FROM ranked WHERE created_at IS NOT NULL)
SELECT n.project_id, n.document_id, CAST(n.rank_position AS INTEGER) AS rank_position, CAST(coalesce(t.rank_position, 0) AS INTEGER) AS previous_rank, CAST(coalesce(t.rank_position - n.rank_position, 0) AS INTEGER) AS rank_change
FROM now_ n LEFT JOIN then_ t USING (project_id, document_id)"""
)
def rank_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    earlier = ranked(spark, sf_dir, "1996-01-01").where(F.col("created_at").isNotNull())
    out = R.rank_delta(ranked(spark, sf_dir), earlier, ["project_id", "document_id"])
    return out.select("project_id", "document_id", "rank_position", F.coalesce("previous_rank", F.lit(0)).alias("previous_rank"), "rank_change")


@query(
    f"""WITH {ranked_sql()}, hits AS (SELECT * FROM ranked WHERE final_score BETWEEN 20 AND 90 AND NOT is_knocked_out AND (contains(lower(name), '11') OR contains(lower(email), '11'))),
total AS (SELECT count(*) AS total FROM hits)
SELECT document_id, project_id, final_score, CAST(rank_position AS INTEGER) AS rank_position, total, CAST(ceil(total / 15.0) AS BIGINT) AS total_pages FROM hits, total
ORDER BY final_score DESC NULLS FIRST, rank_position, project_id LIMIT 15 OFFSET 15"""
)
def rankings_page_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.filter_rankings(ranked(spark, sf_dir), low=20, high=90, knocked_out=False, search="11")
    size = 15
    total = hits.agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size))
    # one row of totals
    return R.page(hits, "final_score", True, 2, size, ["rank_position", "project_id"]).join(F.broadcast(total)).select("document_id", "project_id", "final_score", "rank_position", "total", "total_pages")


@query("WITH t AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS r FROM events WHERE event_type <> 'error') SELECT user_id, event_type, event_id FROM t WHERE r = 1")
def latest_active_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    active = events.where(F.col("event_type") != "error")
    return R.latest_per_group(active, ["user_id"], [F.col("ts").desc_nulls_last(), F.col("event_id").desc()]).select("user_id", "event_type", "event_id")


@query(
    f"""WITH {ranked_sql()} SELECT document_id, project_id, final_score FROM ranked ORDER BY final_score DESC, document_id LIMIT 10"""
)
def global_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_n(candidate_scores(spark, sf_dir).select("document_id", "project_id", "final_score"), 10, F.col("final_score").desc(), F.col("document_id"))
