"""Joins, set operations and mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksmith.operators import joins as J
from ranksmith.operators import mutations as M
from ranksmith.session import table

from .catalogue import query


def _contacts(spark: SparkSession, sf_dir: str, name: str, prefix: str) -> DataFrame:
    return table(spark, sf_dir, name).select(*[F.col(f"{prefix}_{c}").alias(c) for c in ("name", "nationkey", "acctbal")], F.col(f"{prefix}_{'cust' if prefix == 'c' else 'supp'}key").alias("id"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(wanted, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query(
    """WITH old AS (SELECT c_mktsegment AS project_id, c_custkey AS document_id FROM customer), new AS (SELECT * FROM old WHERE document_id % 3 = 0 AND project_id IN ('BUILDING', 'MACHINERY'))
SELECT project_id, document_id FROM old WHERE project_id IN (SELECT project_id FROM new) AND document_id NOT IN (SELECT document_id FROM new)"""
)
def anti_join_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("project_id"), F.col("c_custkey").alias("document_id"))
    new = old.where((F.col("document_id") % 3 == 0) & F.col("project_id").isin("BUILDING", "MACHINERY"))
    return M.removed_by_replace(old, new, "project_id", ["document_id"])


@query(
    """WITH old AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS grp FROM customer), new AS (SELECT id + 5 AS id, 'new-' || name AS name, grp FROM old WHERE id % 4 = 0)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM new)"""
)
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("grp"))
    new = old.where("id % 4 = 0").select((F.col("id") + 5).alias("id"), F.concat(F.lit("new-"), "name").alias("name"), "grp")
    return M.upsert(old, new, ["id"])


@query(
    """WITH old AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS grp FROM customer), new AS (SELECT id + 5 AS id, CASE WHEN id % 8 = 0 THEN NULL ELSE 'new-' || name END AS name, CASE WHEN id % 3 = 0 THEN 'X' END AS grp FROM old WHERE id % 4 = 0)
SELECT coalesce(n.id, o.id) AS id, coalesce(n.name, o.name, '-') AS name, coalesce(n.grp, o.grp, '-') AS grp FROM old o FULL JOIN new n ON o.id = n.id"""
)
def partial_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("grp"))
    new = old.where("id % 4 = 0").select((F.col("id") + 5).alias("id"), F.when(F.col("id") % 8 != 0, F.concat(F.lit("new-"), "name")).alias("name"), F.when(F.col("id") % 3 == 0, "X").alias("grp"))
    return M.partial_upsert(old, new, ["id"]).fillna("-", ["name", "grp"])


@query("WITH o AS (SELECT o_orderkey AS id, o_custkey AS project_id FROM orders WHERE o_custkey % 10 <> 0) SELECT l_orderkey AS document_id, l_linenumber AS line FROM lineitem WHERE l_orderkey IN (SELECT id FROM o)")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("line"))
    gone = orders.where("o_custkey % 10 = 0").select("id")
    return M.cascade_delete(orders, {"lines": (lines, "document_id")}, "id", gone)["lines"]


@query("SELECT min(doc_id) AS id, source AS project_id, sha256(text) AS file_hash FROM documents GROUP BY source, sha256(text)")
def hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("project_id"), F.sha2("text", 256).alias("file_hash"), F.lit("resume").alias("document_type"), F.col("doc_id").alias("created_at"))
    return M.drop_duplicate_files(docs).select("id", "project_id", "file_hash")


@query(
    """WITH l AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 50 END AS ref, c_nationkey AS nk FROM customer),
r AS (SELECT s_suppkey AS sid, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS ref, s_nationkey AS nk FROM supplier),
a AS (SELECT ref, min(sid) AS sid FROM r WHERE ref IS NOT NULL GROUP BY 1), b AS (SELECT nk, min(sid) AS sid FROM r GROUP BY 1)
SELECT id, coalesce(a.sid, b.sid, -1) AS partner, CASE WHEN a.sid IS NOT NULL THEN 1 WHEN b.sid IS NOT NULL THEN 2 ELSE 0 END AS match_priority FROM l LEFT JOIN a ON l.ref = a.ref LEFT JOIN b ON l.nk = b.nk"""
)
def priority_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 50).alias("lref"), F.col("c_nationkey").alias("lnk"))
    right = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sid"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).alias("rref"), F.col("s_nationkey").alias("rnk"))
    out = J.priority_join(left, right, [(F.col("lref"), F.col("rref")), (F.col("lnk"), F.col("rnk"))], {"sid": "partner"})
    return out.select("id", F.coalesce("partner", F.lit(-1)).alias("partner"), "match_priority")


@query(
    """WITH a AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'REQ-' || o_custkey WHEN 1 THEN 'req-' || o_custkey || ' ' ELSE CAST(o_custkey AS VARCHAR) END AS ref FROM orders),
n AS (SELECT o_orderkey, upper(regexp_replace(trim(ref), '^(?i)REQ-', '')) AS k FROM a)
SELECT o_orderkey, k AS requisition, c_mktsegment AS department FROM n JOIN customer ON k = CAST(c_custkey AS VARCHAR)"""
)
def requisition_key_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_custkey").cast("string")
    ref = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("REQ-"), key)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("req-"), key, F.lit(" "))).otherwise(key)
    refs = table(spark, sf_dir, "orders").select("o_orderkey", J.normalise_reference(ref).alias("requisition"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("requisition"), F.col("c_mktsegment").alias("department"))
    return refs.join(c, "requisition").select("o_orderkey", "requisition", "department")


@query("SELECT c_custkey AS id, CASE WHEN l.doc_id IS NOT NULL THEN 'llm' ELSE 'deterministic' END AS method, CASE WHEN l.doc_id IS NOT NULL THEN coalesce(l.toxic, -1) ELSE c_nationkey END AS value FROM customer LEFT JOIN labels l ON c_custkey = l.doc_id")
def verdict_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("deterministic").alias("method"), F.col("c_nationkey").alias("value"))
    better = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("llm").alias("method"), F.coalesce("toxic", F.lit(-1)).alias("value"))
    return J.override(base, better, ["id"], ["method", "value"])


@query("SELECT d.doc_id, coalesce(l.quality, 9) AS quality, coalesce(l.toxic, 9) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def merge_polled(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "documents").select("doc_id", F.lit(9).alias("quality"), F.lit(9).alias("toxic"))
    return J.merge_keep_old(old, table(spark, sf_dir, "labels"), ["doc_id"], ["quality", "toxic"])


@query(
    """WITH w AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS a FROM benchmark), p AS (SELECT x.item_id AS left_id, y.item_id AS right_id, len(list_intersect(x.a, y.a)) AS shared, len(x.a) AS n FROM w x JOIN w y ON y.item_id = x.item_id + 1)
SELECT left_id, right_id, CAST(shared AS BIGINT) AS shared, round(shared / n, 4) AS overlap FROM p"""
)
def set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("a"))
    nxt = w.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("right_id"), F.col("a").alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    return w.join(nxt, "item_id").select(F.col("item_id").alias("left_id"), "right_id", shared.cast("long").alias("shared"), F.round(shared / F.size("a"), 4).alias("overlap"))
