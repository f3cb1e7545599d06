"""Verdict queries: synonyms, fallback similarity, references, validation, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksmith.functions import concepts as C
from ranksmith.operators import matching as M
from ranksmith.operators import requirements as Q
from ranksmith.session import dealt, table

from .bindings import parts
from .catalogue import query
from .matching_plans import _EV, _REQ, _stems_sql, evidence, requirements

SYNONYMS = {"the in": ("of", "and the"), "die und": ("der", "in der")}
PART_SYNONYMS = {"widget": ("gizmo", "gear"), "bolt": ("rod",)}


def _pick(k, *values):
    """The k-th value as text (from 0)."""
    return F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))


@query(
    f"""WITH {_REQ}, {_EV},
q AS (SELECT *, list_concat(CASE WHEN contains(lower(text), 'the in') OR regexp_matches(lower(text), '(^|[^a-zà-ÿ0-9+#.])the($|[^a-zà-ÿ0-9+#.])') THEN ['the in', 'of', 'and the'] ELSE [] END,
  CASE WHEN contains(lower(text), 'die und') OR regexp_matches(lower(text), '(^|[^a-zà-ÿ0-9+#.])(die|und)($|[^a-zà-ÿ0-9+#.])') THEN ['die und', 'der', 'in der'] ELSE [] END) AS phrases FROM req),
qx AS (SELECT document_id, kind, text || ' ' || array_to_string(phrases, ' ') AS text, phrases FROM q),
rs AS ({_stems_sql("qx", "document_id, kind")}), es AS ({_stems_sql("ev", "document_id, kind, turn")}),
n AS (SELECT document_id, count(*) AS n_stems FROM rs GROUP BY 1),
hit AS (SELECT r.document_id, r.kind AS r_kind, e.kind, e.turn, count(*) AS shared FROM rs r JOIN es e ON r.document_id = e.document_id AND r.stem = e.stem
  WHERE (r.kind = 'skill' AND e.kind IN ('skills', 'experience', 'project', 'summary')) OR (r.kind = 'responsibility' AND e.kind IN ('experience', 'project', 'summary')) GROUP BY ALL)
SELECT h.document_id, h.r_kind || ':1' AS requirement_id, h.kind || ':' || h.turn AS evidence_id, h.kind,
round(shared / n_stems + CASE WHEN len(list_filter(qx.phrases, lambda p: contains(p, ' ') AND contains(lower(ev.text), p))) > 0 THEN 0.5 ELSE 0 END, 4) AS overlap
FROM hit h JOIN n USING (document_id) JOIN qx USING (document_id) JOIN ev ON ev.document_id = h.document_id AND ev.turn = h.turn"""
)
def evidence_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.stem_overlap(requirements(spark, sf_dir), evidence(spark, sf_dir), ["document_id"], synonyms=SYNONYMS)


_GRAMS = lambda w: f"list_distinct(list_transform(range(1, greatest(len({w}) - 1, 2)), lambda i: substr({w}, i, 3)))"


@query(
    f"""WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS q, string_split(replace(CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE reverse(p_name) END, 'e', 'a'), ' ') AS t FROM part),
w AS (SELECT *, len(list_intersect(q, t)) / len(q) AS o,
  (list_contains(q, 'widget') OR list_contains(q, 'gizmo') OR list_contains(q, 'gear')) AND (list_contains(t, 'gizmo') OR list_contains(t, 'gear')) OR (list_contains(q, 'bolt') OR list_contains(q, 'rod')) AND list_contains(t, 'rod') AS s FROM p),
x AS (SELECT p_partkey, min_by(j, (i, k)) AS first FROM (SELECT p_partkey, i, k, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS j FROM
  (SELECT p_partkey, i, k, {_GRAMS('qw')} AS a, {_GRAMS('tw')} AS b FROM (SELECT p_partkey, unnest(q) AS qw, generate_subscripts(q, 1) AS i, t FROM w) JOIN (SELECT p_partkey, unnest(t) AS tw, generate_subscripts(t, 1) AS k FROM w) USING (p_partkey) WHERE len(qw) >= 5 AND len(tw) >= 5)) WHERE j >= 0.35 GROUP BY 1)
SELECT p_partkey, round(CASE WHEN o > 0 THEN o WHEN s THEN 0.65 ELSE coalesce(first, 0) END, 3) AS similarity FROM w LEFT JOIN x USING (p_partkey)"""
)
def fallback_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.reverse("p_name")), F.lit("e"), F.lit("a"))
    return parts(spark, sf_dir).select("p_partkey", Q.fallback_similarity(F.col("p_name"), text, PART_SYNONYMS).alias("similarity"))


_KIND = "CASE l_returnflag WHEN 'N' THEN 'project' WHEN 'R' THEN 'experience' ELSE 'education' END"


def line_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as evidence: o_orderkey, evidence_id, kind, n and, as they are, some columns of the line."""
    kind = F.when(F.col("l_returnflag") == "N", "project").when(F.col("l_returnflag") == "R", "experience").otherwise("education")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), kind.alias("kind"), F.col("l_linenumber").cast("string").alias("n"), "l_linestatus", "l_quantity")
    return lines.withColumn("evidence_id", F.concat_ws(":", "kind", "n"))


@query(
    f"""WITH l AS (SELECT l_orderkey, {_KIND} AS kind, l_linenumber AS n, CAST(l_quantity AS INTEGER) % 4 AS k FROM lineitem), h AS (SELECT l_orderkey, list(DISTINCT kind || ':' || n) AS ids FROM l GROUP BY 1)
SELECT l_orderkey AS o_orderkey, kind, n, k, coalesce(CASE WHEN k < 2 THEN kind || ':' || n WHEN k = 2 AND len(list_filter(ids, lambda i: ends_with(i, ':' || n))) = 1 THEN kind || ':' || n
  WHEN k = 3 AND list_contains(ids, kind || ':' || (n + 1)) THEN kind || ':' || (n + 1) END, '-') AS evidence_id FROM l JOIN h USING (l_orderkey)"""
)
def supplied_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line refers to itself in two spellings, by its number alone, or to the next line of its kind, among the ids of its order."""
    lines = line_evidence(spark, sf_dir).withColumn("k", F.col("l_quantity").cast("int") % 4)
    ids = lines.groupBy("o_orderkey").agg(F.collect_set("evidence_id").alias("ids"))
    k, n = F.col("k"), F.col("n")
    raw = F.when(k == 0, F.concat(F.initcap("kind"), F.lit(" #"), n)).when(k == 1, F.concat(F.upper("kind"), F.lit("_"), n)).when(k == 2, n).otherwise(F.concat_ws(" - ", "kind", (n.cast("int") + 1).cast("string")))
    found = F.coalesce(Q.supplied_reference(raw, F.col("ids")), F.lit("-"))
    # apart from the cast of n: inside lambdas a name of the same select would stand for it
    told = lines.join(ids, "o_orderkey").withColumn("evidence_id", found)
    return told.select("o_orderkey", "kind", n.cast("int").alias("n"), "k", "evidence_id")


_NEXT = "SELECT p.*, string_split(p.p_name, ' ') AS w, string_split(o.p_name, ' ') AS ow, o.p_name AS o_name FROM part p LEFT JOIN part o ON o.p_partkey = p.p_partkey + 1"


def with_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with the name of the next one, null for the last."""
    part = table(spark, sf_dir, "part")
    return dealt(part.join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("o_name")), "p_partkey", "left"), "p_partkey")


@query(
    f"""WITH p AS ({_NEXT}), h AS (SELECT p_partkey, p_partkey % 6 AS k, w, ow, coalesce(w[1] IN (ow[1], ow[2]), false) AS a, coalesce(w[2] IN (ow[1], ow[2]), false) AS b FROM p),
m AS (SELECT p_partkey, k, ow, CASE k WHEN 0 THEN CASE WHEN a AND b THEN [w[1], w[2]] END WHEN 1 THEN CASE WHEN a THEN [w[1]] END WHEN 2 THEN NULL WHEN 5 THEN CASE WHEN a THEN [w[1]] END ELSE CASE WHEN a THEN [w[1]] WHEN b THEN [w[2]] END END AS skills FROM h)
SELECT p_partkey, CASE WHEN skills IS NULL THEN 'NO_MATCH' ELSE 'MATCHED' END AS status, CASE WHEN skills IS NULL THEN '-' ELSE 'EXACT' END AS method, coalesce(array_to_string(skills, ','), '') AS skills,
CASE WHEN list_contains(skills, ow[1]) THEN 'experience:1' ELSE '' END AS evidence_ids FROM m"""
)
def group_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a part, asked for in six forms, against those of the next part; its job tells of the first of them only."""
    k, w, o = F.col("p_partkey") % 6, F.split("p_name", " "), F.split("o_name", " ")
    ask = (
        F.when(k == 0, F.concat(w[0], F.lit(" and "), w[1]))
        .when(k == 1, F.concat(w[0], F.lit(" and JSON")))
        .when(k == 2, F.concat(F.lit("debugging & "), w[1]))
        .when(k == 3, F.concat(w[0], F.lit(" or "), w[1]))
        .when(k == 4, F.concat(F.lit("parts such as "), w[0], F.lit(", "), w[1]))
        .otherwise(F.concat(F.lit("Strong knowledge of "), w[0]))
    )
    job = F.array(F.struct(F.lit("experience:1").alias("evidence_id"), F.lit("experience").alias("kind"), F.concat(F.lit("Made the "), o[0], F.lit(" line")).alias("text")))
    v = M.group_verdict(ask, o, job, C.dictionaries())
    told = with_next(spark, sf_dir).select("p_partkey", v.alias("v"))
    return told.select("p_partkey", "v.status", F.coalesce("v.method", F.lit("-")).alias("method"), F.array_join("v.skills", ",").alias("skills"), F.array_join("v.evidence_ids", ",").alias("evidence_ids"))


_FINAL = f"""l AS (SELECT l_orderkey AS k, {_KIND} AS kind, l_linenumber AS n, l_linestatus AS s FROM lineitem), e AS (SELECT DISTINCT k, kind || ':' || n AS id, kind FROM l),
c AS (SELECT DISTINCT k, CASE WHEN s = 'O' THEN kind ELSE 'project' END || ':' || n AS id FROM l),
r AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'degree' WHEN 'O' THEN 'project_relevance' ELSE 'skill' END AS ask, lower(o_orderpriority) AS text FROM orders),
v AS (SELECT r.k, ask, text, list_sort(list(e.id) FILTER (e.id IS NOT NULL AND CASE ask WHEN 'degree' THEN e.kind = 'education' ELSE e.kind IN ('project', 'experience') END)) AS ids FROM r LEFT JOIN c USING (k) LEFT JOIN e ON e.k = c.k AND e.id = c.id GROUP BY 1, 2, 3)"""


def final_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matched verdict for each order, which cites its lines, some by a wrong kind, as re-validation leaves it."""
    evidence = line_evidence(spark, sf_dir)
    cited = evidence.groupBy("o_orderkey").agg(F.sort_array(F.collect_set(F.when(F.col("l_linestatus") == "O", F.col("evidence_id")).otherwise(F.concat(F.lit("project:"), "n")))).alias("evidence_ids"))
    orders = table(spark, sf_dir, "orders").withColumn("requirement_id", F.lit("r:1"))
    kind = F.when(F.col("o_orderstatus") == "F", "degree").when(F.col("o_orderstatus") == "O", "project_relevance").otherwise("skill")
    asked = orders.select("o_orderkey", "requirement_id", kind.alias("kind"), F.lower("o_orderpriority").alias("text"))
    verdicts = orders.select("o_orderkey", "requirement_id", F.lit("MATCHED").alias("status")).join(cited, "o_orderkey", "left")
    return M.revalidate(verdicts, asked, evidence, ["o_orderkey"])


@query(f"WITH {_FINAL} SELECT k AS o_orderkey, ask AS kind, CASE WHEN ask = 'degree' AND coalesce(len(ids), 0) = 0 THEN 'UNRESOLVED' ELSE 'MATCHED' END AS status, coalesce(array_to_string(ids, ','), '') AS evidence_ids FROM v")
def final_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return final_lines(spark, sf_dir).select("o_orderkey", "kind", "status", F.array_join(F.sort_array("evidence_ids"), ",").alias("evidence_ids"))


@query(
    f"""WITH {_FINAL}, p AS (SELECT DISTINCT k, id, CASE WHEN k % 2 = 0 THEN [o_orderpriority] ELSE ['line'] END AS had FROM e JOIN orders ON o_orderkey = k WHERE kind = 'project')
SELECT p.k AS o_orderkey, p.id AS evidence_id, array_to_string(had || CASE WHEN p.k % 2 = 1 AND ask = 'project_relevance' AND list_contains(ids, p.id) THEN [text] ELSE [] END, ',') AS technologies FROM p JOIN v USING (k)"""
)
def proven_technologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project lines, which name the order's priority already where its key is even."""
    lines = line_evidence(spark, sf_dir).where("kind = 'project'").select("o_orderkey", "evidence_id").distinct()
    had = F.when(F.col("o_orderkey") % 2 == 0, F.array("o_orderpriority")).otherwise(F.array(F.lit("line")))
    projects = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey").select("o_orderkey", "evidence_id", had.alias("technologies"))
    out = M.proven_technologies(projects, final_lines(spark, sf_dir), ["o_orderkey"])
    return out.select("o_orderkey", "evidence_id", F.array_join("technologies", ",").alias("technologies"))


@query(
    """WITH v AS (SELECT p_partkey AS id, p_partkey % 6 AS k, CASE WHEN p_size % 4 = 0 THEN 0.7 ELSE 0.9 END AS confidence FROM part)
SELECT id, CASE WHEN k = 4 THEN 'NO_MATCH' WHEN confidence < 0.8 OR k IN (1, 3) THEN 'UNRESOLVED' WHEN k = 5 THEN 'PARTIALLY_MATCHED' ELSE 'MATCHED' END AS status,
CAST(CASE WHEN k = 4 OR confidence < 0.8 OR k IN (1, 3) THEN 0 WHEN k = 5 THEN 0.5 ELSE 1 END AS DOUBLE) AS coverage,
CASE WHEN k = 4 OR confidence < 0.8 OR k IN (1, 3) THEN '' WHEN k = 0 THEN 'education:1' WHEN k = 2 THEN 'experience:1' ELSE 'project:1' END AS cited FROM v"""
)
def validated_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds: a degree may not rest on experience (1), nothing stands on evidence that was not supplied (3), an only evidence needs no citation (2)."""
    part, k = parts(spark, sf_dir).withColumnRenamed("p_partkey", "id"), F.col("id") % 6
    empty = F.array().cast("array<string>")
    cited = F.when(k == 0, F.array(F.lit("Education 1"))).when(k == 1, F.array(F.lit("experience:1"))).when(k == 2, empty).when(k == 3, F.array(F.lit("summary:9"))).otherwise(F.array(F.lit("PROJECT #1"), F.lit("project:1")))
    judged = part.select("id", F.when(k < 2, "degree").otherwise("skill").alias("kind"), _pick(k, "MATCHED", "MATCHED", "MATCH", "MATCHED", "REJECTED", "partial").alias("status"), F.when(F.col("p_size") % 4 == 0, 0.7).otherwise(0.9).alias("confidence"), cited.alias("evidence_ids"))
    held = lambda *ids: F.array(*[F.struct(F.lit(i).alias("evidence_id"), F.lit(i.split(":")[0]).alias("kind")) for i in ids])
    supplied = part.select("id", F.explode(F.when(k == 2, held("experience:1")).otherwise(held("experience:1", "education:1", "project:1"))).alias("h")).select("id", "h.*")
    out = M.validate_verdicts(judged, supplied, ["id"])
    return out.select("id", "status", "coverage", F.array_join("evidence_ids", ",").alias("cited"))


@query(
    """WITH p AS (SELECT p_partkey, p_partkey % 5 AS k, string_split(p_name, ' ') AS w FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN CASE WHEN list_contains(w, 'red') THEN 'red' ELSE '-' END WHEN 1 THEN 'JS' WHEN 2 THEN 'Python' WHEN 3 THEN CASE WHEN list_contains(w, 'hot') AND list_contains(w, 'rod') THEN 'rods hot' ELSE '-' END ELSE 'mysql' END AS skill,
CASE k WHEN 0 THEN CASE WHEN list_contains(w, 'red') THEN 'EXACT' ELSE '-' END WHEN 3 THEN CASE WHEN list_contains(w, 'hot') AND list_contains(w, 'rod') THEN 'ALIAS' ELSE '-' END ELSE 'ALIAS' END AS method,
CASE k WHEN 0 THEN CASE WHEN list_contains(w, 'red') THEN 'experience:1' ELSE '-' END WHEN 1 THEN '-' WHEN 2 THEN 'skills:1' WHEN 3 THEN CASE WHEN list_contains(w, 'hot') AND list_contains(w, 'rod') THEN 'experience:1' ELSE '-' END ELSE 'project:1' END AS evidence_id FROM p"""
)
def skill_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One term by itself (0), by alias (1), by a category among skills (2), by words near each other (3) and by a category in a text (4)."""
    e = lambda i, text: F.struct(F.lit(i).alias("evidence_id"), F.lit(i.split(":")[0]).alias("kind"), text.alias("text"))
    found = F.array(e("experience:1", F.concat(F.lit("Made the "), "p_name", F.lit(" line"))), e("skills:1", F.lit("Python, SQL")), e("project:1", F.lit("A MySQL store")))
    k = F.col("p_partkey") % 5
    term = _pick(k, "red", "JavaScript", "programming language", "rods hot", "relational database")
    skills = F.concat(F.split("p_name", " "), F.when(k == 1, F.array(F.lit("JS"))).otherwise(F.array(F.lit("Python"))))
    v = M.skill_match(term, skills, found, C.dictionaries())
    return parts(spark, sf_dir).select("p_partkey", *[F.coalesce(v[c], F.lit("-")).alias(c) for c in ("skill", "method", "evidence_id")])


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'red') OR (contains(p_name, 'hot') AND contains(p_name, 'rod')) THEN 'MATCHED' ELSE 'UNRESOLVED' END AS verdict FROM part")
def project_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = F.array(F.struct(F.lit("Plant").alias("name"), F.concat(F.lit("Made Any "), "p_name").alias("description")))
    ask = F.when(F.contains("p_name", F.lit("red")), "ANY RED").otherwise("rod and the hot")
    return parts(spark, sf_dir).select("p_partkey", M.project_relevance(ask, F.when(F.contains("p_name", F.lit("red")), F.array(F.struct(F.lit("Plant").alias("name"), F.lit("any red one").alias("description")))).otherwise(projects)).alias("verdict"))


@query(
    """WITH p AS (SELECT p_partkey, p_partkey % 4 AS k, p_size % 5 AS n, p_name FROM part), s AS (SELECT *, CASE k WHEN 0 THEN n >= 3 OR contains(p_name, 'new') WHEN 1 THEN contains(p_name, 'old') WHEN 2 THEN n >= 3 ELSE contains(p_name, 'small') OR contains(p_name, 'gizmo') END AS ok FROM p)
SELECT p_partkey, CASE WHEN ok THEN 'MATCHED' ELSE 'UNRESOLVED' END AS status, CASE WHEN ok THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence FROM s"""
)
def soft_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    ask = _pick(k, "Willingness to learn", "Good communication", "Analytical mind", "all small gizmo")
    said = F.replace(F.replace(F.col("p_name"), F.lit("new"), F.lit("a fast learner")), F.lit("old"), F.lit("Collaborated"))
    none = F.lit(0)
    v = M.soft_verdict(ask, F.when(k < 3, said).otherwise(F.col("p_name")), F.col("p_size") % 5, none, none)
    return parts(spark, sf_dir).select("p_partkey", v["status"].alias("status"), v["confidence"].alias("confidence"))


@query(
    f"""WITH p AS ({_NEXT}), m AS (SELECT p_partkey, p_partkey % 4 AS k, coalesce(p_name = o_name, false) AS same FROM p)
SELECT p_partkey, CASE WHEN k < 3 OR same THEN 'MATCHED' ELSE 'NO_MATCH' END AS status, CASE WHEN k = 0 OR k = 3 AND same THEN 'EXACT' WHEN k < 3 THEN 'ALIAS' ELSE '-' END AS method FROM m"""
)
def certificate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as certificates, their brands as other spellings: the same name, either side by brand, and the name of the next part."""
    k, key = F.col("p_partkey") % 4, lambda c: F.lower(F.col(c))
    ask = F.when(k == 0, F.replace(F.upper("p_name"), F.lit(" "), F.lit("  "))).when(k == 1, F.col("p_brand")).otherwise(F.col("p_name"))
    held = F.when(k == 2, F.upper("p_brand")).when(k == 3, F.col("o_name")).otherwise(F.col("p_name"))
    v = M.canonical_verdict(ask, F.array(F.lit("other"), held), F.create_map(key("p_brand"), key("p_name")))
    return with_next(spark, sf_dir).select("p_partkey", v["status"].alias("status"), F.coalesce(v["method"], F.lit("-")).alias("method"))


@query(
    """WITH e AS (SELECT l_orderkey, count(*) FILTER (l_quantity > 25) AS n FROM lineitem GROUP BY 1), v AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'MATCHED' ELSE 'UNRESOLVED' END AS status, coalesce(n, 0) AS n FROM orders LEFT JOIN e ON l_orderkey = o_orderkey)
SELECT id, CASE WHEN status <> 'MATCHED' AND n = 0 THEN 'NO_MATCH' ELSE status END AS status, status <> 'MATCHED' AND n > 0 AS submit, CASE WHEN status = 'MATCHED' THEN 0 ELSE n END AS n_evidence FROM v"""
)
def verdict_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "MATCHED").otherwise("UNRESOLVED").alias("status"))
    selected = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("id"))
    return M.route(verdicts, selected, ["id"])
