"""Statistics, funnels, dashboards and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ranksmith.operators import analytics as A
from ranksmith.session import table

from .bindings import LEVEL_SQL, candidate_scores, ranked_sql, scores_sql
from .catalogue import query
from .ranking_plans import ranked

@query(
    f"""WITH {scores_sql()} SELECT project_id, count(*) AS n_candidates, round(avg(CAST(final_score * 100 AS BIGINT)) / 100, 2) AS avg_score,
max(final_score) AS max_score, min(final_score) AS min_score, count(*) FILTER (is_knocked_out) AS n_knocked_out FROM scores GROUP BY 1"""
)
def project_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.project_statistics(candidate_scores(spark, sf_dir))


@query(
    f"""WITH {scores_sql()}, l AS (SELECT project_id, {LEVEL_SQL} AS r FROM scores)
SELECT project_id, count(*) FILTER (r = 'SHORTLIST') AS shortlist, count(*) FILTER (r = 'REVIEW') AS review, count(*) FILTER (r = 'CONSIDER') AS consider, count(*) FILTER (r = 'REJECT') AS reject FROM l GROUP BY 1"""
)
def recommendation_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.level_distribution(candidate_scores(spark, sf_dir), ("SHORTLIST", "REVIEW", "CONSIDER", "REJECT"))


def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that reached each stage, by the day's tenth; events stand for stage transitions."""
    events = table(spark, sf_dir, "events")
    cohort = (F.col("user_id") % 10).alias("project_id")
    reached = events.groupBy(cohort, "user_id").agg(*[F.max(F.when(F.col("value") > 10 * (i + 2), 1).otherwise(0)).alias(s) for i, s in enumerate(A.STAGES)])
    return reached.groupBy("project_id").agg(F.count("*").alias("total"), *[F.sum(s).alias(s) for s in A.STAGES])


_STAGE_SQL = (
    "reached AS (SELECT user_id % 10 AS project_id, user_id, "
    + ", ".join(f"max(CASE WHEN value > {10 * (i + 2)} THEN 1 ELSE 0 END) AS {s}" for i, s in enumerate(A.STAGES))
    + " FROM events GROUP BY 1, 2), counts AS (SELECT project_id, count(*) AS total, "
    + ", ".join(f"CAST(sum({s}) AS BIGINT) AS {s}" for s in A.STAGES)
    + " FROM reached GROUP BY 1)"
)


@query(f"WITH {_STAGE_SQL} SELECT * FROM counts")
def pipeline_stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_counts(spark, sf_dir)


@query(
    f"""WITH {_STAGE_SQL} SELECT project_id, total, CASE WHEN total = 0 THEN 0.0 ELSE round(({" + ".join(A.STAGES)}) * 100 / (total * 6), 2) END AS completion,
coalesce({", ".join(f"CASE WHEN {s} < total THEN '{s}' END" for s in A.STAGES)}, 'complete') AS current_stage,
array_to_string(list_filter([{", ".join(f"CASE WHEN {s} >= total THEN '{s}' END" for s in A.STAGES)}], lambda x: x IS NOT NULL), ',') AS completed_stages FROM counts"""
)
def pipeline_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pipeline_status(stage_counts(spark, sf_dir)).select("project_id", "total", "completion", "current_stage", "completed_stages")


@query(
    """WITH o AS (SELECT o_custkey, max(o_orderdate) AS lo, min(o_orderdate) AS fo FROM orders GROUP BY 1),
l AS (SELECT o_custkey, max(l_shipdate) AS ls FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o.o_custkey AS project_id, greatest(lo, ls) AS last_activity, round(greatest(0.0, epoch_us(greatest(lo, ls)) / 1000000.0 - epoch_us(fo) / 1000000.0), 2) AS elapsed FROM o JOIN l USING (o_custkey)"""
)
def project_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    o = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("lo"), F.min("o_orderdate").alias("fo"))
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("ls"))
    s = shipped.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.max("ls").alias("ls"))
    last = F.greatest("lo", "ls")
    return o.join(s, "o_custkey").select(F.col("o_custkey").alias("project_id"), last.alias("last_activity"), A.elapsed_seconds(F.col("fo"), last).alias("elapsed"))


@query(
    """WITH s AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS skill FROM part), n AS (SELECT count(DISTINCT p_partkey) AS n_owners FROM s)
SELECT skill, count(*) AS n, any_value(n_owners) AS n_owners, round(count(*) * 100 / any_value(n_owners), 2) AS share FROM s, n GROUP BY skill ORDER BY n DESC, skill LIMIT 20"""
)
def skill_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("skill"))
    return A.item_frequency(items, "skill", "p_partkey", 20).select("skill", "n", "n_owners", "share")


@query(
    """WITH req AS (SELECT p_type, list_sort(list_distinct(flatten(list(string_split(p_name, ' '))))) AS required FROM part GROUP BY 1),
has AS (SELECT p_partkey, p_type, string_split(p_name, ' ') AS skills FROM part)
SELECT p_partkey, array_to_string(list_sort(list_filter(required, lambda x: list_contains(skills, x))), ',') AS matched,
array_to_string(list_sort(list_filter(required, lambda x: NOT list_contains(skills, x))), ',') AS missing FROM has JOIN req USING (p_type)"""
)
def matched_missing_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("skills", F.split("p_name", " "))
    required = part.select("p_type", F.explode("skills").alias("s")).groupBy("p_type").agg(F.array_sort(F.collect_set("s")).alias("required"))
    joined = part.join(required, "p_type")
    return joined.select("p_partkey", F.array_join(F.array_sort(F.array_intersect("required", "skills")), ",").alias("matched"), F.array_join(F.array_sort(F.array_except("required", "skills")), ",").alias("missing"))


@query(
    f"""WITH {ranked_sql()} SELECT r.project_id, CAST(rank_position AS INTEGER) AS rank_position, coalesce(nullif(CASE WHEN document_id % 9 = 0 THEN '' ELSE name END, ''), 'Anonymous Candidate') AS candidate, n_name AS location, final_score, recommendation,
CASE WHEN is_knocked_out THEN 'yes' ELSE 'no' END AS knocked_out FROM ranked r LEFT JOIN nation ON nation_key = n_nationkey"""
)
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked(spark, sf_dir).join(table(spark, sf_dir, "nation"), F.col("nation_key") == F.col("n_nationkey"), "left")
    name = F.when(F.col("document_id") % 9 == 0, "").otherwise(F.col("name"))
    return rows.select("project_id", "rank_position", F.coalesce(F.nullif(name, F.lit("")), F.lit("Anonymous Candidate")).alias("candidate"), F.col("n_name").alias("location"), "final_score", "recommendation", F.when(F.col("is_knocked_out"), "yes").otherwise("no").alias("knocked_out"))


@query("SELECT p_partkey, array_to_string(string_split(p_name, ' '), ', ') AS skills, p_brand || '; ' || p_type AS label FROM part")
def export_csv_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.split("p_name", " "), ", ").alias("skills"), F.concat_ws("; ", "p_brand", "p_type").alias("label"))


@query(f"""WITH {scores_sql()} SELECT document_id, '{{"id":' || document_id || ',"name":"' || name || '","score":' || CAST(CAST(final_score * 100 AS BIGINT) AS VARCHAR) || '}}' AS json FROM scores""")
def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(F.col("document_id").alias("id"), "name", F.round(F.col("final_score") * 100).cast("long").alias("score"))
    return candidate_scores(spark, sf_dir).select("document_id", F.to_json(item).alias("json"))


@query(
    """WITH a AS (SELECT user_id, bool_or(event_type = 'signup') AS joined, bool_or(event_type = 'purchase') AS submitted, CAST(floor(max(CASE WHEN event_type = 'purchase' THEN value END)) AS BIGINT) AS score FROM events GROUP BY 1),
s AS (SELECT *, CASE WHEN submitted AND score >= 60 THEN 'Shortlisted' WHEN submitted THEN 'Rejected' WHEN joined THEN 'In progress' ELSE 'Not attended' END AS status FROM a)
SELECT status, count(*) AS n, CAST(round(count(*) * 100.0 / (SELECT count(*) FROM s)) AS BIGINT) AS pct, CAST(coalesce(sum(score), 0) AS BIGINT) AS total_score FROM s GROUP BY 1"""
)
def funnel_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_ = lambda t: F.col("event_type") == t
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(is_("signup")).alias("joined"), F.bool_or(is_("purchase")).alias("submitted"), F.floor(F.max(F.when(is_("purchase"), F.col("value")))).cast("long").alias("score"))
    status = F.when(F.col("submitted") & (F.col("score") >= 60), "Shortlisted").when(F.col("submitted"), "Rejected").when(F.col("joined"), "In progress").otherwise("Not attended")
    counted = per.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.coalesce(F.sum("score"), F.lit(0)).alias("total_score"))
    return counted.select("status", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(F.lit(0)))).cast("long").alias("pct"), "total_score")


@query(
    """SELECT r_name AS department, count(s_suppkey) AS n, round(count(s_suppkey) * 100 / sum(count(s_suppkey)) OVER (), 2) AS share, round(count(*) FILTER (s_acctbal > 0) * 100 / count(*), 2) AS active_rate, max(s_suppkey) AS latest
FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"""
)
def department_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    rows = places.join(table(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    counted = rows.groupBy(F.col("r_name").alias("department")).agg(F.count("s_suppkey").alias("n"), A.percent(F.count_if(F.col("s_acctbal") > 0), F.count("*")).alias("active_rate"), F.max("s_suppkey").alias("latest"))
    return A.share_of_total(counted, "n", "share")


@query("SELECT c_nationkey AS department, count(DISTINCT c_mktsegment) AS n_roles, count(*) FILTER (c_acctbal >= 0) AS active, count(*) FILTER (c_acctbal < 0) AS completed, round(count(*) FILTER (c_acctbal < 0) * 100 / count(*)) AS progress FROM customer GROUP BY 1")
def department_role_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = F.col("c_acctbal") >= 0
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("department")).agg(F.count_distinct("c_mktsegment").alias("n_roles"), F.count_if(open_).alias("active"), F.count_if(~open_).alias("completed"), A.percent(F.count_if(~open_), F.count("*"), 0).alias("progress"))


@query("SELECT o_custkey AS project_id, bool_and(o_orderstatus = 'F') AS all_done, bool_or(o_orderstatus = 'F') AS any_done, count(*) FILTER (o_orderstatus = 'F') AS n_done FROM orders GROUP BY 1")
def completion_quantifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("project_id")).agg(F.bool_and(done).alias("all_done"), F.bool_or(done).alias("any_done"), F.count_if(done).alias("n_done"))


@query(
    f"""WITH {scores_sql()}, k AS (SELECT document_id, unnest(['skills', 'experience', 'final']) AS component, unnest([skills_score, experience_score, final_score]) AS score FROM scores)
SELECT document_id, component, score, CASE WHEN score >= 80 THEN 'strength' WHEN score < 60 THEN 'weakness' ELSE 'neutral' END AS kind FROM k"""
)
def breakdown_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = candidate_scores(spark, sf_dir).select("document_id", F.col("skills_score").alias("skills"), F.col("experience_score").alias("experience"), F.col("final_score").alias("final")).unpivot("document_id", ["skills", "experience", "final"], "component", "score")
    return long.withColumn("kind", F.when(F.col("score") >= 80, "strength").when(F.col("score") < 60, "weakness").otherwise("neutral"))


@query(
    """WITH k AS (SELECT doc_id, lower(text) AS t FROM documents), c AS (SELECT doc_id, len(regexp_extract_all(t, 'the')) AS a, len(regexp_extract_all(t, 'ung')) AS b, len(regexp_extract_all(t, 'eau')) AS c, len(regexp_extract_all(t, 'ción')) AS d FROM k)
SELECT doc_id, CASE WHEN greatest(a, b, c, d) = 0 THEN NULL WHEN a = greatest(a, b, c, d) THEN 'english' WHEN b = greatest(a, b, c, d) THEN 'german' WHEN c = greatest(a, b, c, d) THEN 'french' ELSE 'spanish' END AS domain FROM c"""
)
def domain_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lower("text")
    hits = lambda s: ((F.length(t) - F.length(F.replace(t, F.lit(s), F.lit("")))) / len(s)).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", A.argmax_label({"english": hits("the"), "german": hits("ung"), "french": hits("eau"), "spanish": hits("ción")}).alias("domain"))


@query("SELECT CAST(sum(round(w)) AS BIGINT) AS total, sum(round(w)) = 100 AS valid FROM (SELECT count(*) * 100.0 / (SELECT count(*) FROM customer) AS w FROM customer GROUP BY c_mktsegment)")
def weight_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return A.weights_total(c.select((F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(F.lit(0)))).alias("weight")))
