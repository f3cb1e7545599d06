"""Requirement, evidence and rule queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksmith.functions import dates as D
from ranksmith.functions import text as X
from ranksmith.operators import requirements as Q
from ranksmith.session import table

from .catalogue import query


@query(
    """WITH p AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS a, [p_brand, 'Requirements:', p_type, 'good communication'] AS b FROM part),
i AS (SELECT id, unnest(a) AS text, generate_subscripts(a, 1) AS pos, 'skill' AS kind, 0 AS f FROM p UNION ALL SELECT id, unnest(b), generate_subscripts(b, 1), 'responsibility', 1 FROM p),
k AS (SELECT id, text, pos, f, CASE WHEN contains(lower(text), 'communication') THEN 'candidate_attribute' ELSE kind END AS kind FROM i WHERE lower(text) <> 'requirements:' AND trim(text) <> ''),
d AS (SELECT *, row_number() OVER (PARTITION BY id, kind, lower(text) ORDER BY f, pos) AS r FROM k)
SELECT id, kind || ':' || row_number() OVER (PARTITION BY id, kind ORDER BY f, pos) AS requirement_id, kind, text FROM d WHERE r = 1"""
)
def requirement_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    jobs = part.select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("skills"), F.array("p_brand", F.lit("Requirements:"), "p_type", F.lit("good communication")).alias("duties"))
    return Q.build_requirements(jobs, "id", {"skills": "skill", "duties": "responsibility"})


@query(
    """WITH i AS (SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS text, generate_subscripts(string_split(p_name, ' '), 1) AS pos, 'skills' AS kind FROM part UNION ALL SELECT p_partkey, p_type, 1, 'summary' FROM part WHERE p_partkey % 3 <> 0)
SELECT id, kind || ':' || row_number() OVER (PARTITION BY id, kind ORDER BY pos) AS evidence_id, kind, text FROM i"""
)
def evidence_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("skills"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).alias("summary"))
    return Q.build_evidence(p, "id", {"skills": "skills", "summary": "summary"})


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'UNRESOLVED' WHEN p_size * 3 >= (p_partkey % 9 + 1) * 12 THEN 'MATCHED' ELSE 'NO_MATCH' END AS verdict FROM part")
def experience_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 4 == 0, "some experience").otherwise(F.concat(((F.col("p_partkey") % 9) + 1).cast("string"), F.lit("+ years")))
    return table(spark, sf_dir, "part").select("p_partkey", Q.experience_verdict(text, F.col("p_size") * 3).alias("verdict"))


@query(
    """WITH r AS (SELECT p_partkey, p_partkey % 5 AS need, p_size % 6 AS lvl, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE 'other' END AS fld, p_brand FROM part)
SELECT p_partkey, CASE WHEN lvl >= need THEN 'MATCHED' ELSE 'NO_MATCH' END AS status, CAST(CASE WHEN lvl >= need AND lower(fld) = lower(p_brand) THEN 1.0 WHEN lvl >= need THEN 0.85 ELSE 0.0 END AS DOUBLE) AS confidence FROM r"""
)
def degree_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise("other")
    v = Q.degree_verdict(F.col("p_partkey") % 5, F.col("p_brand"), F.col("p_size") % 6, held)
    return table(spark, sf_dir, "part").select("p_partkey", v.alias("v")).select("p_partkey", "v.status", "v.confidence")


@query("SELECT l_orderkey, l_linenumber, 'experience:' || l_linenumber AS evidence_id FROM lineitem")
def evidence_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("l_linenumber").cast("string"), F.col("l_orderkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("Experience #"), n)).when(k == 1, F.concat(F.lit(" experience 0"), n)).otherwise(F.concat(F.lit("experience:"), n))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", Q.evidence_reference(raw).alias("evidence_id"))


@query(
    """WITH c AS (SELECT c_custkey AS id, c_custkey % 50 AS months, CASE WHEN c_custkey % 2 = 0 THEN ['sql', 'python'] WHEN c_custkey % 3 = 0 THEN ['SQL'] ELSE [] END AS skills FROM customer)
SELECT id, CASE WHEN len(list_distinct(list_transform(skills, lambda x: lower(x)))) < 2 THEN 'missing mandatory skill' ELSE 'insufficient experience' END AS reason FROM c WHERE len(skills) < 2 OR months < 24"""
)
def knockout_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    months = c.withColumn("months", F.col("id") % 50)
    skills = c.where("id % 2 = 0").select("id", F.explode(F.array(F.lit("sql"), F.lit("python"))).alias("skill")).unionByName(c.where("id % 2 <> 0 AND id % 3 = 0").select("id", F.lit("SQL").alias("skill")))
    rules = spark.createDataFrame([("skill", "SQL"), ("skill", "Python"), ("experience", "24")], "kind string, value string")
    return Q.knocked_out(rules, skills, months, "id")


@query(
    """WITH s AS (SELECT p_partkey, p_name, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN 'and' WHEN 2 THEN '3+ years' WHEN 3 THEN 'C' WHEN 4 THEN 'a b c d e f' ELSE 'C++' END AS skill FROM part)
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN length(p_name) BETWEEN 2 AND 50 AND len(string_split(p_name, ' ')) <= 5 WHEN 5 THEN true ELSE false END AS valid FROM s"""
)
def skill_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    skill = F.when(k == 0, F.col("p_name")).when(k == 1, "and").when(k == 2, "3+ years").when(k == 3, "C").when(k == 4, "a b c d e f").otherwise("C++")
    return table(spark, sf_dir, "part").select("p_partkey", Q.valid_skill(skill).alias("valid"))


@query(
    """WITH s AS (SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m') AS a, strftime(max(o_orderdate), '%Y') AS b FROM orders GROUP BY 1),
m AS (SELECT o_custkey, CAST(b AS INTEGER) * 12 + 12 - CAST(a[1:4] AS INTEGER) * 12 - CAST(a[6:7] AS INTEGER) AS n FROM s)
SELECT o_custkey, CAST(n AS INTEGER) AS exclusive_months, CAST(n + 1 AS INTEGER) AS inclusive_months FROM m"""
)
def partial_date_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM").alias("a"), F.date_format(F.max("o_orderdate"), "yyyy").alias("b"))
    return s.select("o_custkey", D.months_between(F.col("a"), F.col("b"), inclusive=False).alias("exclusive_months"), D.months_between(F.col("a"), F.col("b")).alias("inclusive_months"))


@query(
    """WITH w AS (SELECT item_id, lower(text) AS t FROM benchmark), p AS (SELECT a.item_id AS left_id, b.item_id AS right_id, a.t AS x, b.t AS y FROM w a JOIN w b ON b.item_id = a.item_id + 2),
g AS (SELECT left_id, right_id, list_distinct(regexp_extract_all(x, '[a-z0-9+#.]{2,}')) AS q, list_distinct(regexp_extract_all(y, '[a-z0-9+#.]{2,}')) AS r FROM p) SELECT left_id, right_id, len(list_intersect(q, r)) > 0 AS shares_word FROM g"""
)
def fallback_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    nxt = b.select((F.col("item_id") - 2).alias("item_id"), F.col("item_id").alias("right_id"), F.col("text").alias("other"))
    words = lambda c: F.array_distinct(X.tokens(F.col(c)))
    pairs = b.join(nxt, "item_id").withColumn("similarity", Q.fallback_similarity(F.col("text"), F.col("other")))
    shares = (F.size(F.array_intersect(words("text"), words("other"))) > 0) & (F.col("similarity") > 0)
    return pairs.select(F.col("item_id").alias("left_id"), "right_id", shares.alias("shares_word"))


@query("SELECT s_suppkey, coalesce(CASE s_suppkey % 4 WHEN 0 THEN 'ENG' WHEN 1 THEN 'HR' WHEN 2 THEN 'FIN' END, '-') AS code FROM supplier")
def department_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    raw = F.when(k == 0, " Engineering ").when(k == 1, "Human  Resources").when(k == 2, "FINANCE").otherwise("Unknown")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.coalesce(Q.department_code(raw), F.lit("-")).alias("code"))


@query(
    """WITH l AS (SELECT n_nationkey, n_name FROM nation)
SELECT n_nationkey, array_to_string(list_concat(list_transform(range(5), lambda i: n_name || i), list_transform(range(5), lambda i: 'right' || i)), chr(10)) AS text FROM l"""
)
def two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.concat(F.col("n_name"), i.cast("string"), F.lit("     right"), i.cast("string")))
    return table(spark, sf_dir, "nation").select("n_nationkey", Q.one_column(F.array_join(lines, "\n")).alias("text"))
