"""Matching, scoring and verdict queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksmith.functions import scoring as S
from ranksmith.functions import text as X
from ranksmith.operators import matching as M
from ranksmith.session import table

from .bindings import candidate_scores, scores_sql
from .catalogue import query

_SUFFIX_RE = "|".join(X.SUFFIXES)


def _stems_sql(relation: str, keys: str, text: str = "text") -> str:
    return (
        f"SELECT DISTINCT {keys}, CASE {' '.join(f"WHEN tok = '{k}' THEN '{v}'" for k, v in X.IRREGULAR.items())} "
        f"ELSE CASE WHEN length(tok) > 3 THEN regexp_replace(tok, '^(.{{3,}}?)(?:{_SUFFIX_RE})$', '\\1') ELSE tok END END AS stem "
        f"FROM (SELECT {keys}, unnest(regexp_extract_all(lower({text}), '[a-z0-9+#.]+')) AS tok FROM {relation}) WHERE length(tok) > 1"
    )


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turns of conversations as requirements: document_id, requirement_id, kind, text."""
    turns = table(spark, sf_dir, "conversations").where("turn = 0")
    kind = F.when(F.col("conv_id") % 3 == 0, "responsibility").when(F.col("conv_id") % 3 == 1, "skill").otherwise("degree")
    return turns.select(F.col("conv_id").alias("document_id"), F.concat_ws(":", kind, F.lit("1")).alias("requirement_id"), kind.alias("kind"), "text")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later turns as evidence of four kinds."""
    turns = table(spark, sf_dir, "conversations").where("turn > 0")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("experience", "project", "summary", "skills")]), (F.col("turn") % 4 + 1).cast("int"))
    return turns.select(F.col("conv_id").alias("document_id"), F.concat_ws(":", kind, F.col("turn").cast("string")).alias("evidence_id"), kind.alias("kind"), "text")


_REQ = "req AS (SELECT conv_id AS document_id, CASE conv_id % 3 WHEN 0 THEN 'responsibility' WHEN 1 THEN 'skill' ELSE 'degree' END AS kind, text FROM conversations WHERE turn = 0)"
_EV = "ev AS (SELECT conv_id AS document_id, ['experience', 'project', 'summary', 'skills'][turn % 4 + 1] AS kind, turn, text FROM conversations WHERE turn > 0)"
_OVERLAP = f"""{_REQ}, {_EV}, rs AS ({_stems_sql("req", "document_id, kind")}), es AS ({_stems_sql("ev", "document_id, kind, turn")}),
n AS (SELECT document_id, count(*) AS n_stems FROM rs GROUP BY 1),
scored AS (SELECT r.document_id, r.kind || ':1' AS requirement_id, e.kind || ':' || e.turn AS evidence_id, e.kind, round(count(*) / any_value(n_stems), 4) AS overlap
FROM rs r JOIN es e ON r.document_id = e.document_id AND r.stem = e.stem JOIN n ON n.document_id = r.document_id
WHERE (r.kind = 'skill' AND e.kind IN ('skills', 'experience', 'project', 'summary')) OR (r.kind = 'responsibility' AND e.kind IN ('experience', 'project', 'summary')) GROUP BY ALL)"""


@query(f"WITH {_OVERLAP} SELECT * FROM scored")
def evidence_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.stem_overlap(requirements(spark, sf_dir), evidence(spark, sf_dir), ["document_id"])


@query(
    f"""WITH {_OVERLAP}, b AS (SELECT *, max(overlap) OVER (PARTITION BY document_id) AS best FROM scored),
s AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY overlap DESC, evidence_id) AS pos, CASE WHEN best >= 0.6 THEN 3 ELSE 5 END AS k FROM b WHERE best < 0.15 OR overlap >= 0.15),
f AS (SELECT *, min(pos) OVER (PARTITION BY document_id, kind) AS first_pos, row_number() OVER (PARTITION BY document_id, kind, pos = 1 ORDER BY pos) AS round FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY CASE WHEN pos = 1 THEN 0 ELSE 1 END, round, first_pos) AS pick FROM f)
SELECT document_id, requirement_id, evidence_id, kind, overlap, CAST(pick AS INTEGER) AS pick FROM p WHERE pick <= k"""
)
def evidence_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.select_evidence(evidence_overlap(spark, sf_dir), ["document_id"])


@query(
    """WITH c AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS concepts FROM benchmark),
d AS (SELECT doc_id, doc_id % 40 AS item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS words FROM documents),
h AS (SELECT doc_id, len(concepts) AS total, len(list_intersect(concepts, words)) AS hits FROM d JOIN c USING (item_id))
SELECT doc_id, CAST(hits AS INTEGER) AS hits, CAST(total AS INTEGER) AS total, CASE WHEN total = 0 THEN 0 ELSE round(hits / total, 2) END AS coverage,
CASE WHEN total = 0 THEN 'UNRESOLVED' WHEN total = 1 AND hits = 1 THEN 'MATCHED' WHEN hits >= 2 THEN 'MATCHED' WHEN hits = 1 THEN 'PARTIALLY_MATCHED' ELSE 'UNRESOLVED' END AS status FROM h"""
)
def responsibility_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against one duty: concepts stay arrays, so no word is shuffled."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))
    duties = table(spark, sf_dir, "benchmark").select("item_id", words.alias("concepts"))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 40).alias("item_id"), words.alias("words"))
    joined = docs.join(duties, "item_id").select("doc_id", F.size(F.array_intersect("concepts", "words")).alias("hits"), F.size("concepts").alias("total"))
    verdict = S.responsibility_verdict(F.col("hits"), F.col("total"))
    return joined.select("doc_id", "hits", "total", verdict["coverage"].alias("coverage"), verdict["status"].alias("status"))


@query(
    """WITH v AS (SELECT l.doc_id, CASE l.toxic WHEN 1 THEN 'PARTIALLY_MATCHED' ELSE 'MATCHED' END AS status, CASE WHEN l.doc_id % 5 = 0 THEN 0.7 ELSE 0.9 END AS confidence, 'experience:' || (l.doc_id % 4) AS cited FROM labels l),
ok AS (SELECT doc_id, CASE WHEN confidence >= 0.8 AND doc_id % 4 < 3 THEN status ELSE 'UNRESOLVED' END AS status FROM v),
j AS (SELECT doc_id, status, CASE status WHEN 'MATCHED' THEN 1.0 WHEN 'PARTIALLY_MATCHED' THEN 0.5 ELSE 0.0 END AS coverage FROM ok),
d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'MATCHED' ELSE 'UNRESOLVED' END AS status, CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.0 END AS coverage FROM documents)
SELECT d.doc_id, CASE WHEN d.status <> 'MATCHED' AND j.doc_id IS NOT NULL THEN j.status ELSE d.status END AS status,
CAST(CASE WHEN d.status <> 'MATCHED' AND j.doc_id IS NOT NULL THEN j.coverage ELSE d.coverage END AS DOUBLE) AS coverage,
CASE WHEN d.status <> 'MATCHED' AND j.doc_id IS NOT NULL THEN 'llm' ELSE 'deterministic' END AS method FROM d LEFT JOIN j USING (doc_id)"""
)
def verdict_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    cited = F.array(F.concat(F.lit("experience:"), (F.col("doc_id") % 4).cast("string")))
    judged = labels.select("doc_id", F.when(F.col("toxic") == 1, "PARTIALLY_MATCHED").otherwise("MATCHED").alias("status"), F.when(F.col("doc_id") % 5 == 0, 0.7).otherwise(0.9).alias("confidence"), cited.alias("evidence_ids"))
    supplied = labels.select("doc_id", F.explode(F.array(*[F.lit(f"experience:{i}") for i in range(3)])).alias("evidence_id"))
    sure = M.validate_verdicts(judged, supplied, ["doc_id"])
    done = F.col("doc_id") % 3 == 0
    base = table(spark, sf_dir, "documents").select("doc_id", F.when(done, "MATCHED").otherwise("UNRESOLVED").alias("status"), F.when(done, 1.0).otherwise(0.0).alias("coverage"))
    return M.fuse(base, sure, ["doc_id"])


_COMPONENTS = "c AS (SELECT document_id, is_knocked_out, skills_score AS sk, experience_score AS re, final_score AS pr, CASE WHEN document_id % 4 = 0 THEN 50.0 ELSE 0.0 END AS pf FROM scores)"


def _components() -> dict:
    return {"required_skills": F.col("skills_score"), "responsibilities": F.col("experience_score"), "projects": F.col("final_score"), "preferred_skills": F.when(F.col("document_id") % 4 == 0, 50.0).otherwise(0.0)}


@query(
    f"""WITH {scores_sql()}, {_COMPONENTS} SELECT document_id, CASE WHEN is_knocked_out THEN 'REJECT'
WHEN (sk >= 50 OR re >= 50 OR pr >= 50) AND (pf > 0 OR (sk > 0 AND sk < 50) OR (re > 0 AND re < 50) OR (pr > 0 AND pr < 50)) THEN 'SHORTLIST'
WHEN sk >= 25 OR re >= 25 OR pr >= 25 OR (sk >= 20 AND (re >= 20 OR pr >= 20)) THEN 'REVIEW' ELSE 'REJECT' END AS level FROM c"""
)
def recommendation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_scores(spark, sf_dir).select("document_id", S.recommendation(_components(), F.col("is_knocked_out")).alias("level"))


@query(
    f"""WITH {scores_sql()}, {_COMPONENTS} SELECT document_id, round((30 * sk + 25 * re + CASE WHEN document_id % 2 = 0 THEN 25 * pr ELSE 0 END + 15 * pf) / (30 + 25 + CASE WHEN document_id % 2 = 0 THEN 25 ELSE 0 END + 15), 4) AS weighted FROM c"""
)
def weight_renormalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = F.lit(True)
    applies = {"required_skills": every, "responsibilities": every, "projects": F.col("document_id") % 2 == 0, "preferred_skills": every}
    return candidate_scores(spark, sf_dir).select("document_id", F.round(S.weighted_total(_components(), applies), 4).alias("weighted"))


@query(
    f"""WITH {scores_sql()} SELECT document_id, least(15.0, (document_id % 12) * 2.0) AS bonus, round(least(100.0, greatest(0.0, final_score + least(15.0, (document_id % 12) * 2.0))), 2) AS total FROM scores"""
)
def bonus_and_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = S.bonus(F.col("document_id") % 12)
    return candidate_scores(spark, sf_dir).select("document_id", b.alias("bonus"), S.clamp(F.col("final_score") + b).alias("total"))


@query(
    """WITH x AS (SELECT c_custkey, nullif(c_name, '') IS NOT NULL AS a, c_custkey % 2 = 0 AS b, c_custkey % 3 = 0 AS c, true AS d FROM customer)
SELECT c_custkey, round((CAST(a AS INTEGER) + CAST(b AS INTEGER) + CAST(c AS INTEGER) + CAST(d AS INTEGER)) * 100 / 4, 2) AS confidence FROM x"""
)
def profile_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise("  "), F.col("c_mktsegment")]
    return table(spark, sf_dir, "customer").select("c_custkey", S.profile_confidence(fields).alias("confidence"))


@query(
    """WITH r AS (SELECT p_partkey, p_partkey % 2 = 0 AS is_or, string_split(lower(p_name), ' ') AS parts FROM part), s AS (SELECT p_partkey, lower(split_part(p_name, ' ', 1)) AS skill FROM part)
SELECT p_partkey AS document_id, is_or, CASE WHEN is_or THEN len(list_filter(parts, lambda x: x = skill)) > 0 ELSE len(list_filter(list_distinct(parts), lambda x: x <> skill)) = 0 END AS satisfied FROM r JOIN s USING (p_partkey)"""
)
def skill_group_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    text = F.when(F.col("p_partkey") % 2 == 0, F.array_join(words, " or ")).otherwise(F.array_join(words, " and "))
    req = part.select(F.col("p_partkey").alias("document_id"), F.lit("r").alias("requirement_id"), text.alias("text"))
    have = part.select(F.col("p_partkey").alias("document_id"), F.split("p_name", " ")[0].alias("skill"))
    return M.skill_groups(req, have, ["document_id"]).select("document_id", "is_or", "satisfied")


@query(
    """WITH v AS (SELECT source, CASE WHEN quality = 1 AND toxic = 0 THEN 'deterministic' WHEN quality = 1 THEN 'llm_confirmed' WHEN toxic = 1 THEN 'llm_rejected' ELSE 'no_evidence' END AS method FROM documents JOIN labels USING (doc_id))
SELECT source, count(*) FILTER (method = 'deterministic') AS deterministic, count(*) FILTER (method = 'llm_confirmed') AS llm_confirmed, count(*) FILTER (method = 'llm_rejected') AS llm_rejected, count(*) FILTER (method = 'no_evidence') AS no_evidence, count(*) AS total FROM v GROUP BY 1"""
)
def match_method_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    method = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "deterministic").when(F.col("quality") == 1, "llm_confirmed").when(F.col("toxic") == 1, "llm_rejected").otherwise("no_evidence")
    kinds = ("deterministic", "llm_confirmed", "llm_rejected", "no_evidence")
    return v.select("source", method.alias("method")).groupBy("source").agg(*[F.count_if(F.col("method") == k).alias(k) for k in kinds], F.count("*").alias("total"))


_DEGREES = ["PhD", "Doctorate", "Master", "MBA", "Bachelor", "Diploma", "Certificate", "Course"]


@query(
    f"""WITH p AS (SELECT p_partkey, {_DEGREES} AS d, {[5, 5, 4, 4, 3, 2, 1, 0]} AS v, p_size % 8 + 1 AS i, (p_size // 8 + p_partkey) % 8 + 1 AS j, p_partkey % 3 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN greatest(v[i], v[j]) WHEN 1 THEN v[j] ELSE 0 END AS level FROM p"""
)
def degree_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two degrees beside names of parts, of which the higher counts; words that only begin like a degree do not."""
    names, k = F.array(*map(F.lit, _DEGREES)), F.col("p_partkey") % 3
    name = lambda n: F.get(names, (n % 8).cast("int"))
    tail = F.when(k == 0, "s of ").when(k == 1, "ful, ").otherwise("like and ")
    text = F.concat(name(F.col("p_size")), tail, "p_name", F.lit("; "), name(F.floor(F.col("p_size") / 8) + F.col("p_partkey")), F.when(k == 2, "ly ").otherwise(" - "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", S.degree_rank(text).alias("level"))
