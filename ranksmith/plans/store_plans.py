"""Stored rows: deletion marks, states, replacement, pages, labels and text edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksmith.functions import arrays as A
from ranksmith.functions import scoring as S
from ranksmith.functions import text as X
from ranksmith.operators import joins as J
from ranksmith.operators import mutations as U
from ranksmith.operators import ranking as R
from ranksmith.operators import resumes as P
from ranksmith.session import table

from .bindings import candidate_scores, scores_sql
from .catalogue import query


@query("SELECT o_orderkey, o_orderstatus <> 'O' AND o_orderkey % 4 <> 0 AS live FROM orders")
def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders and every fourth one are deleted; deleting the fourths again and restoring none changes nothing more."""
    orders = table(spark, sf_dir, "orders").withColumn("deleted_at", F.lit(None).cast("timestamp"))
    at = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    gone = U.soft_delete(U.soft_delete(orders, F.col("o_orderstatus") == "O", at), F.col("o_orderkey") % 4 == 0)
    return U.restore(gone, F.col("o_orderkey") < 0).select("o_orderkey", F.col("deleted_at").isNull().alias("live"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'DONE' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'F' THEN 3 ELSE 1 END AS stage FROM orders")
def state_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(1).alias("stage"))
    return U.transition(orders, F.col("stage") + F.when(F.col("status") == "F", 0).otherwise(1) == 1, stage=3).withColumn("status", F.when(F.col("stage") == 3, "DONE").otherwise(F.col("status")))


@query(
    """WITH n AS (SELECT l_orderkey AS k, l_linenumber AS line, 'new' AS v FROM lineitem WHERE l_orderkey % 3 = 0 AND l_linenumber % 2 = 1), o AS (SELECT l_orderkey AS k, l_linenumber AS line, 'old' AS v FROM lineitem)
SELECT * FROM o WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT * FROM n"""
)
def replace_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"))
    new = rows.where("k % 3 = 0 AND line % 2 = 1").withColumn("v", F.lit("new"))
    return U.replace_group(rows.withColumn("v", F.lit("old")), new, "k")


@query(f"WITH {scores_sql()} SELECT document_id, project_id, final_score FROM scores ORDER BY created_at DESC NULLS FIRST, document_id LIMIT 20 OFFSET 20")
def newest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.page(candidate_scores(spark, sf_dir), "created_at", True, 2, 20, ["document_id"]).select("document_id", "project_id", "final_score")


@query(f"WITH {scores_sql()} SELECT document_id, project_id, o.n FROM scores JOIN (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1) o ON c_custkey = document_id")
def score_of_every_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.col("c_custkey").alias("document_id")).agg(F.count("o_orderkey").alias("n"))
    return J.required_join(candidate_scores(spark, sf_dir).select("document_id", "project_id"), counts, "document_id")


@query("SELECT p_partkey, 'skill:' || i AS id, w[i] AS text FROM (SELECT p_partkey, string_split(p_name, ' ') AS w, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)")
def positional_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(J.positional_labels(F.split("p_name", " "), "skill")).alias("l")).select("p_partkey", "l.*")


@query("SELECT p_partkey, contains(p_name || CASE WHEN p_partkey % 3 = 0 THEN '50%' WHEN p_partkey % 3 = 1 THEN '50x' ELSE '5_%' END, '0%') AS percent, p_partkey % 3 = 2 AS underscore FROM part")
def escaped_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    text = F.concat("p_name", F.when(k == 0, "50%").when(k == 1, "50x").otherwise("5_%"))
    return table(spark, sf_dir, "part").select("p_partkey", text.like(f"%{R.escape_like('0%')}%").alias("percent"), text.like(f"%{R.escape_like('5_%')}%").alias("underscore"))


@query(
    """SELECT p_partkey, p_name || ' soft' AS clean, p_brand AS first, p_name LIKE '%red%' AS mentions, CASE p_partkey % 3 WHEN 0 THEN 100.0 WHEN 1 THEN 33.33 ELSE 0.0 END::DOUBLE AS share FROM part"""
)
def text_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    dirty = F.concat("p_name", F.lit(" so­f​t"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        X.clean_unicode(dirty).alias("clean"),
        X.first_match(F.concat(F.lit("see: "), "p_brand", F.lit(", ")), r" Brand#[0-9]+,").alias("first"),
        F.regexp_like(F.concat(F.lit("a_"), F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit(r"(\b|_)red(\b|_)")).alias("mentions"),
        S.share(F.when(k == 1, 1).otherwise(0), F.when(k == 0, 0).otherwise(3)).alias("share"),
    )


@query(
    """SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '-' END AS phone, CASE WHEN p_partkey % 2 = 0 THEN w[1] || ',' || w[2] || ',go' ELSE w[1] || ',' || w[2] END AS skills FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)"""
)
def recovery_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, words = table(spark, sf_dir, "part"), F.split("p_name", " ")
    found = part.select("p_partkey", F.col("p_name").alias("name"), F.lit(" ").alias("phone"), words.alias("skills"))
    other = part.where("p_partkey % 2 = 0").select("p_partkey", F.lit("other").alias("name"), F.col("p_brand").alias("phone"), F.array(F.upper(words[0]), F.lit("go")).alias("skills"))
    out = P.with_recovery(found, other, "p_partkey", ["name", "phone"], ["skills"])
    return out.select("p_partkey", "name", F.coalesce("phone", F.lit("-")).alias("phone"), F.array_join("skills", ",").alias("skills"))


@query(
    """WITH l AS (SELECT l_orderkey, list([l_returnflag, l_linestatus, l_linenumber::VARCHAR]) AS t, count(DISTINCT (l_returnflag, l_linestatus)) AS n_distinct FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_sort(list_distinct(flatten(t))), ',') AS technologies, n_distinct FROM l"""
)
def nested_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order: the distinct values of their lists, and the distinct pairs of two of their fields."""
    row = F.struct(F.array("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("t"), F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(row).alias("rows"))
    flat = A.sorted_unique(F.flatten(F.transform("rows", lambda x: x["t"])))
    return rows.select("l_orderkey", F.array_join(flat, ",").alias("technologies"), F.size(A.distinct_by(F.col("rows"), "a", "b")).cast("long").alias("n_distinct"))
