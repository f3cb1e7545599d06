"""Insights, hand-off and assessment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksmith.functions import text as X
from ranksmith.operators import insights as I
from ranksmith.session import table
from ranksmith.sources.files import status_payload

from .bindings import LEVEL_SQL, candidate_scores, scores_sql
from .catalogue import query


@query(
    f"""WITH {scores_sql()}, w AS (SELECT *, {LEVEL_SQL} AS level, list_filter([{{'k': 'skills', 'v': skills_score}}, {{'k': 'work_history', 'v': experience_score}}, {{'k': 'projects', 'v': final_score}}], lambda p: p.v < 60) AS weak,
list_filter([{{'k': 'skills', 'v': skills_score}}, {{'k': 'work_history', 'v': experience_score}}, {{'k': 'projects', 'v': final_score}}], lambda p: p.v >= 80) AS strong FROM scores)
SELECT document_id, name || ': ' || level || '; ' || len(strong) || ' matched, ' || len(weak) || ' missing.' AS summary, array_to_string(list_transform(strong, lambda p: p.k), ',') AS strengths,
CASE WHEN len(weak) = 0 THEN 'Keep the profile up to date' ELSE array_to_string(list_transform(weak, lambda p: 'Add evidence for ' || replace(p.k, '_', ' ')), '; ') END AS suggestions FROM w"""
)
def candidate_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"skills": F.col("skills_score"), "work_history": F.col("experience_score"), "projects": F.col("final_score")}
    s = candidate_scores(spark, sf_dir).withColumn("strong", I.strengths(parts)).withColumn("weak", I.weaknesses(parts))
    text = I.summary(F.col("name"), F.col("recommendation"), F.col("final_score"), F.size("strong"), F.size("weak"))
    plain = F.regexp_replace(text, r" with [0-9.]+ points", "")
    return s.select("document_id", plain.alias("summary"), F.array_join("strong", ",").alias("strengths"), F.array_join(I.suggestions(F.col("weak")), "; ").alias("suggestions"))


@query(
    """WITH m AS (SELECT c_custkey AS document_id, c_mktsegment || '-' || c_nationkey AS project_id, c_custkey % 160 AS months FROM customer)
SELECT document_id, project_id, CASE WHEN months < 24 THEN '0-1' WHEN months < 72 THEN '2-5' WHEN months < 132 THEN '6-10' ELSE '11-15' END AS tier,
CASE WHEN max(months) OVER (PARTITION BY project_id) >= 24 THEN 'EXPERIENCED' ELSE 'FRESHER' END AS batch_category FROM m"""
)
def assessment_handoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("project_id"), (F.col("c_custkey") % 160).alias("months"))
    return I.handoff(c, "project_id", "months").select("document_id", "project_id", "tier", "batch_category")


@query(
    """WITH w AS (SELECT doc_id, text, regexp_split_to_array(lower(text), '[\\s.,;:!?]+') AS a FROM documents),
v AS (SELECT doc_id, text, len(a) AS n, len(list_filter(a, lambda x: x IN ('the', 'and', 'of', 'to'))) AS en, len(list_filter(a, lambda x: x IN ('der', 'die', 'und', 'den'))) AS de, len(list_filter(a, lambda x: x IN ('le', 'la', 'les', 'des'))) AS fr, len(list_filter(a, lambda x: x IN ('el', 'los', 'que', 'del'))) AS es FROM w)
SELECT doc_id, CASE WHEN length(text) < 20 OR n < 3 OR greatest(en, de, fr, es) = 0 OR en = greatest(en, de, fr, es) THEN 'en' WHEN de = greatest(en, de, fr, es) THEN 'de' WHEN fr = greatest(en, de, fr, es) THEN 'fr' ELSE 'es' END AS language FROM v"""
)
def language_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", I.language_vote(F.col("text")).alias("language"))


@query(
    """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9+#.]+') AS r FROM documents), f AS (SELECT doc_id, list_filter(r, lambda x: length(x) > 1) AS a FROM w),
p AS (SELECT doc_id, coalesce(list_position(a, 'the'), 0) AS x, coalesce(list_position(a, 'and'), 0) AS y FROM f) SELECT doc_id, x > 0 AND y > 0 AND abs(x - y) <= 10 AS near FROM p"""
)
def concept_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", I.concept_near(X.tokens(F.col("text")), ["the", "and"]).alias("near"))


@query(
    """WITH r AS (SELECT p_partkey AS id, unnest([1, 2]) AS req_id, unnest([3, 4]) AS level, unnest([p_brand, p_type]) AS field FROM part), h AS (SELECT p_partkey AS id, p_partkey % 6 AS level, CASE WHEN p_partkey % 2 = 0 THEN lower(p_brand) ELSE 'none' END AS field FROM part WHERE p_partkey % 10 <> 0),
b AS (SELECT r.id, req_id, max(CASE WHEN h.level >= r.level AND h.field = lower(r.field) THEN 100.0 WHEN h.level >= r.level OR h.field = lower(r.field) THEN 50.0 ELSE 0.0 END) AS points FROM r LEFT JOIN h ON r.id = h.id GROUP BY 1, 2)
SELECT id, round(CAST(avg(points) AS DOUBLE), 2) AS education_score FROM b GROUP BY 1"""
)
def education_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    req = part.select(F.col("p_partkey").alias("id"), F.explode(F.array(F.struct(F.lit(1).alias("req_id"), F.lit(3).alias("level"), F.col("p_brand").alias("field")), F.struct(F.lit(2).alias("req_id"), F.lit(4).alias("level"), F.col("p_type").alias("field")))).alias("r")).select("id", "r.*")
    held = part.where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 6).alias("level"), F.when(F.col("p_partkey") % 2 == 0, F.lower("p_brand")).otherwise("none").alias("field"))
    return I.education_score(req, held, "id")


@query(
    """WITH s AS (SELECT c_nationkey AS batch, c_custkey AS position, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS ref, CASE WHEN c_custkey % 3 = 1 THEN c_name END AS email FROM customer),
a AS (SELECT batch, position, ref, lower(email) AS email, position * 10 AS link FROM s), p AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY position) AS n FROM s WHERE position % 5 <> 0),
q AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY position) AS n FROM a)
SELECT p.batch, p.position, coalesce(r.link, m.link, q.link, -1) AS link FROM p LEFT JOIN a r ON p.batch = r.batch AND p.ref = r.ref LEFT JOIN a m ON p.batch = m.batch AND lower(p.email) = m.email LEFT JOIN q ON p.batch = q.batch AND p.n = q.n"""
)
def handoff_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    sent = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("batch"), key.alias("position"), F.when(key % 3 == 0, key).alias("ref"), F.when(key % 3 == 1, F.col("c_name")).alias("email"))
    answered = sent.select("batch", "position", "ref", F.upper("email").alias("email"), (F.col("position") * 10).alias("link"))
    return I.handoff_response(sent.where("position % 5 <> 0"), answered, "batch").select("batch", "position", F.coalesce("link", F.lit(-1)).alias("link"))


@query(
    """SELECT user_id % 5 AS batch, count(*) FILTER (event_type IN ('click', 'purchase')) AS submitted, count(*) FILTER (event_type = 'purchase') AS graded, count(*) FILTER (value > 50) AS verified,
round(coalesce(avg(CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) END), 0.0), 1) AS mean_score FROM events GROUP BY 1"""
)
def assessment_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "GRADED").when(F.col("event_type") == "click", "SUBMITTED").otherwise("OPEN")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("batch"), status.alias("status"), (F.col("value") > 50).alias("verified"), F.floor("value").alias("score"))
    return I.assessment_kpis(rows, "batch")


@query(
    """WITH e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 100 AS DOUBLE) / 100 ELSE CAST(event_id % 100 AS DOUBLE) END AS v, event_type FROM events)
SELECT event_id, CASE WHEN v > 0 AND v <= 1 THEN round(v * 100, 1) ELSE round(v, 1) END AS composite_score, event_type IN ('click', 'purchase') AS is_submitted, event_type = 'purchase' AS is_graded FROM e"""
)
def partner_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 100) / 100).otherwise((F.col("event_id") % 100).cast("double"))
    state = F.when(F.col("event_type") == "purchase", "graded").when(F.col("event_type") == "click", "submitted").otherwise("open")
    name = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(score.alias("compositeScore"), state.alias("status")))).otherwise(F.to_json(F.struct(score.alias("score"), state.alias("status"))))
    raw = table(spark, sf_dir, "events").select("event_id", name.alias("payload"))
    return status_payload(raw).select("event_id", "composite_score", "is_submitted", "is_graded")
