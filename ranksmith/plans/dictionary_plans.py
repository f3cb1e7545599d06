"""Dictionaries as tables: terms in whole texts, concepts of duties, canonical names by a join, and normal forms with their audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksmith.functions import arrays as A
from ranksmith.functions import dates as D
from ranksmith.functions import dictionary as W
from ranksmith.functions import scoring as S
from ranksmith.functions import text as X
from ranksmith.operators import audit as U
from ranksmith.operators import normalise as N
from ranksmith.session import table

from .bindings import parts
from .catalogue import query


def _plain_sql(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(' ' || regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}#+_.]+', ' ', 'g') || ' ', '\.+ ', ' ', 'g'), ' \.+', ' ', 'g'), ' +', ' ', 'g'))"


_PAIRS_SQL = f"""b AS (SELECT item_id, unnest(string_split({_plain_sql('text')}, ' ')) AS w, generate_subscripts(string_split({_plain_sql('text')}, ' '), 1) AS i FROM benchmark),
terms AS (SELECT DISTINCT w AS term FROM b WHERE length(w) >= 4 UNION SELECT DISTINCT w || ' ' || next FROM (SELECT w, lead(w) OVER (PARTITION BY item_id ORDER BY i) AS next FROM b) WHERE next IS NOT NULL)"""


def benchmark_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of four letters or more and pairs of neighbouring words of the benchmark: thousands of terms."""
    words = F.split(W.plain_words(F.col("text")), " ")
    items = table(spark, sf_dir, "benchmark").select(words.alias("w"))
    single = items.select(F.explode("w").alias("term")).where(F.length("term") >= 4)
    pairs = items.select(F.explode(F.transform(F.filter(F.transform("w", lambda x, i: F.struct(x.alias("a"), F.get("w", i + 1).alias("b"))), lambda p: p["b"].isNotNull()), lambda p: F.concat_ws(" ", p["a"], p["b"]))).alias("term"))
    return single.unionByName(pairs).where("term <> ''").distinct()


@query(
    f"""WITH {_PAIRS_SQL},
d AS (SELECT doc_id, unnest(string_split({_plain_sql('text')}, ' ')) AS w, generate_subscripts(string_split({_plain_sql('text')}, ' '), 1) AS i FROM documents),
r AS (SELECT doc_id, w, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM d),
h AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, w AS term FROM r UNION ALL SELECT doc_id, w || ' ' || next FROM r WHERE next IS NOT NULL) JOIN terms USING (term))
SELECT documents.doc_id, count(term) AS n_terms, md5(coalesce(string_agg(term, '|' ORDER BY term), '')) AS digest FROM documents LEFT JOIN h USING (doc_id) GROUP BY 1"""
)
def dictionary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = W.with_terms(table(spark, sf_dir, "documents").select("doc_id", "text"), benchmark_terms(spark, sf_dir), key="doc_id")
    return found.select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.md5(F.array_join("terms", "|")).alias("digest"))


_CONCEPTS = """w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_partkey % 3 > 0),
p AS (SELECT p_partkey, list_intersect(list_distinct(string_split(p_name, ' ')), (SELECT list(w) FROM w)) AS c FROM part)"""


@query(
    f"""WITH {_CONCEPTS}, j AS (SELECT a.p_partkey, len(a.c) AS n, len(list_intersect(a.c, b.c)) AS hits FROM p a LEFT JOIN p b ON b.p_partkey = a.p_partkey + 1)
SELECT p_partkey, CAST(n AS BIGINT) AS n_concepts, CAST(coalesce(hits, 0) AS BIGINT) AS n_hits, CASE WHEN n = 0 THEN 'UNRESOLVED' WHEN n = 1 AND hits = 1 OR hits >= 2 THEN 'MATCHED' WHEN hits = 1 THEN 'PARTIALLY_MATCHED' ELSE 'UNRESOLVED' END AS status,
CASE WHEN n = 0 THEN 0.0 ELSE round(coalesce(hits, 0) / n, 2) END::DOUBLE AS coverage FROM j"""
)
def duty_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts of each duty and of another row's evidence, both found by one dictionary table."""
    part = table(spark, sf_dir, "part")
    concepts = part.where("p_partkey % 3 > 0").select(F.explode(F.split("p_name", " ")).alias("term")).distinct().withColumn("concept", F.concat(F.lit("c:"), "term"))
    duties = part.select("p_partkey", F.concat(F.lit("Maintain "), F.replace(F.col("p_name"), F.lit(" "), F.lit(", ")), F.lit(".")).alias("text"))
    asked = W.with_terms(duties, concepts, canonical="concept", out="asked").drop("text")
    shown = W.with_terms(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.upper("p_name").alias("text")), concepts, canonical="concept", out="shown").drop("text")
    hits = F.size(F.array_intersect("asked", F.coalesce("shown", F.array().cast("array<string>"))))
    out = asked.join(shown, "p_partkey", "left").select("p_partkey", F.size("asked").cast("long").alias("n_concepts"), hits.cast("long").alias("n_hits"))
    return out.withColumn("v", S.responsibility_verdict(F.col("n_hits"), F.col("n_concepts"))).select("p_partkey", "n_concepts", "n_hits", "v.status", "v.coverage")


@query("SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'nation ' || n_nationkey ELSE n_name END AS canonical FROM customer JOIN nation ON c_nationkey = n_nationkey")
def canonical_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    items = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    aliases = nation.where("n_nationkey % 2 = 0").select(F.initcap("n_name").alias("alias"), F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("canonical"))
    return N.canonical_join(items, aliases, "n_name").select("c_custkey", "canonical")


_RED = {"red": "Crimson", "blue": "Azure", "green": "Emerald", "black": "Black"}
_AUDIT = """p AS (SELECT p_partkey AS k, string_split(p_name, ' ') AS w, p_brand, p_size FROM part),
r AS (
  SELECT k, 'skills' AS field, unnest(w) AS source, CASE unnest(w) WHEN 'red' THEN 'Crimson' WHEN 'blue' THEN 'Azure' WHEN 'green' THEN 'Emerald' WHEN 'black' THEN 'Black' ELSE unnest(w) END AS canonical, 1.0 AS confidence FROM p
  UNION ALL SELECT k, 'job_titles', 'sde', 'Software Engineer', 1.0 FROM p
  UNION ALL SELECT k, 'job_titles', p_brand, p_brand, 1.0 FROM p
  UNION ALL SELECT k, 'companies', p_brand || ' Ltd.', p_brand || ' Limited', 1.0 FROM p
  UNION ALL SELECT k, 'languages', unnest(['eng', 'Hindi', 'English', w[1]]), unnest(['English', 'Hindi', 'English', w[1]]), 1.0 FROM p
  UNION ALL SELECT k, 'certifications', CASE WHEN k % 2 = 0 THEN 'pmp' ELSE p_brand END, CASE WHEN k % 2 = 0 THEN 'Project Management Professional (PMP)' ELSE p_brand END, 1.0 FROM p
  UNION ALL SELECT k, 'email', 'P' || k || '@Example.com', 'p' || k || '@example.com', 1.0 FROM p
  UNION ALL SELECT k, 'phone', '98765' || lpad(CAST(k % 100000 AS VARCHAR), 5, '0'), '+9198765' || lpad(CAST(k % 100000 AS VARCHAR), 5, '0'), 1.0 FROM p
  UNION ALL SELECT k, 'education.graduation_date', CASE p_size % 4 WHEN 0 THEN 'present' WHEN 1 THEN '2010 - ' || (2011 + k % 9) WHEN 2 THEN CAST(2000 + k % 20 AS VARCHAR) ELSE 'long ago' END,
    CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(2011 + k % 9 AS VARCHAR) WHEN 2 THEN CAST(2000 + k % 20 AS VARCHAR) ELSE 'long ago' END, CASE p_size % 4 WHEN 0 THEN 0.95 WHEN 1 THEN 0.9 WHEN 2 THEN 1.0 ELSE 0.5 END FROM p)"""


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, words = F.col("p_partkey"), F.split("p_name", " ")
    size = F.col("p_size") % 4
    year = F.when(size == 0, "present").when(size == 1, F.concat(F.lit("2010 - "), (2011 + k % 9).cast("string"))).when(size == 2, (2000 + k % 20).cast("string")).otherwise("long  ago")
    rows = parts(spark, sf_dir).select(
        k.alias("k"),
        F.transform(words, lambda x: F.concat(F.lit(" Tools: "), x)).alias("skills"),
        F.array(F.lit("sde"), F.col("p_brand"), F.lit(" ")).alias("titles"),
        F.array(F.concat("p_brand", F.lit("  Ltd.")), F.lit("till date"), F.lit(None).cast("string")).alias("companies"),
        F.array(F.lit("eng"), F.lit("Hindi"), F.lit("English"), words[0]).alias("languages"),
        F.array(F.when(k % 2 == 0, "pmp").otherwise(F.col("p_brand"))).alias("certifications"),
        F.concat(F.lit("P"), k.cast("string"), F.lit("@Example.com")).alias("email"),
        F.concat(F.lit("98765"), F.lpad((k % 100000).cast("string"), 5, "0")).alias("phone"),
        F.array(year).alias("years"),
    )
    return U.normalised(rows, U.resume_fields(_RED))


@query(
    f"""WITH {_AUDIT}, d AS (SELECT k, field, count(canonical) - count(DISTINCT lower(canonical)) AS twice FROM r GROUP BY 1, 2)
SELECT k, count(*) FILTER (source IS DISTINCT FROM canonical) AS n_changes, string_agg(CASE WHEN source IS DISTINCT FROM canonical THEN field || ':' || source || '>' || coalesce(canonical, '-') END, '|' ORDER BY field, source) AS changes,
count(*) FILTER (source IS DISTINCT FROM canonical AND canonical IS NOT NULL) AS aliases_resolved, (SELECT CAST(sum(twice) AS BIGINT) FROM d WHERE d.k = r.k) AS duplicates_removed,
count(*) FILTER (field = 'languages' AND source = canonical AND source NOT IN ('Hindi', 'English') OR source = 'long ago') AS n_warnings FROM r GROUP BY k"""
)
def normalisation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.array_sort(F.transform("audit.changes", lambda c: F.struct(c["field"].alias("f"), c["source"].alias("s"), F.coalesce(c["canonical"], F.lit("-")).alias("c"))))
    changes = F.array_join(F.transform(told, lambda c: F.concat(c["f"], F.lit(":"), c["s"], F.lit(">"), c["c"])), "|")
    n = lambda c: c.cast("long")
    return audited(spark, sf_dir).select("k", n(F.size("audit.changes")).alias("n_changes"), changes.alias("changes"), n(F.col("audit.aliases_resolved")).alias("aliases_resolved"), n(F.col("audit.duplicates_removed")).alias("duplicates_removed"), n(F.size("audit.warnings")).alias("n_warnings"))


@query(f"WITH {_AUDIT}, f AS (SELECT k, field, round(avg(confidence), 2) AS c FROM r GROUP BY 1, 2) SELECT field, count(*) AS n, round(avg(c), 4)::DOUBLE AS mean_confidence FROM f GROUP BY 1")
def audit_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.field_confidence(audited(spark, sf_dir))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE p_name END AS title, 'type=' || p_type AS kept,
CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE epoch(TIMESTAMP '2020-01-01 00:00:00')::BIGINT + p_size * 3600 - CASE WHEN p_partkey % 3 = 1 THEN 0 ELSE 7200 END END AS seconds FROM (SELECT p_partkey, p_name, p_type, p_size % 24 AS p_size FROM part)"""
)
def value_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles in capitals, ISO times with Z or an offset, and maps without some keys."""
    k, hour = F.col("p_partkey"), F.lpad((F.col("p_size") % 24).cast("string"), 2, "0")
    name = F.when(k % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    time = F.when(k % 3 == 0, F.lit("yesterday")).when(k % 3 == 1, F.concat(F.lit("2020-01-01T"), hour, F.lit(":00:00Z"))).otherwise(F.concat(F.lit(" 2020-01-01T"), hour, F.lit(":00:00+02:00")))
    left = A.without_keys(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type")), "brand", "none")
    kept = F.array_join(F.transform(F.map_entries(left), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return parts(spark, sf_dir).select("p_partkey", X.title_if_upper(name).alias("title"), kept.alias("kept"), F.coalesce(F.unix_timestamp(D.parse_timestamp(time)), F.lit(-1)).cast("long").alias("seconds"))


@query(
    """WITH p AS (SELECT p_partkey AS k, p_partkey % 3 AS m, string_split(p_name, ' ') AS w, p_type, p_brand, p_size % 9 + 1 AS n FROM part)
SELECT k, p_type[1] || lower(p_type[2:]) AS title, CASE WHEN w[1] = 'red' THEN 'Crimson' WHEN w[1] = 'blue' THEN 'Azure' ELSE w[1] END || ',' || w[2] AS skills,
CASE m WHEN 0 THEN 'Bachelor of Science in ' || w[2] || ',Master of Engineering' WHEN 1 THEN 'Bachelor of Commerce' ELSE 'Some ' || p_brand END AS education,
CASE m WHEN 0 THEN 'experience_parse:months(min=' || n * 12 || ',max=' || (n + 2) * 12 || ')' WHEN 1 THEN 'experience_parse:months(min=' || n * 12 || ',max=-)' ELSE '' END AS bounds,
CAST(CASE WHEN w[1] IN ('red', 'blue') THEN 1 ELSE 0 END + CASE m WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END + CASE WHEN m < 2 THEN 1 ELSE 0 END AS BIGINT) AS n_changes, m = 2 AS warned, w[2] || ',' || p_brand AS keywords FROM p"""
)
def job_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs in capitals, with degrees apart by 'or' and phrases about years, in two of three."""
    m, w, n = F.col("p_partkey") % 3, F.split("p_name", " "), F.col("p_size") % 9 + 1
    rows = parts(spark, sf_dir).select(
        F.col("p_partkey").alias("k"),
        F.col("p_type").alias("title"),
        F.array(w[0], w[1], F.upper(w[1]), F.lit(" ")).alias("skills"),
        F.when(m == 0, F.array(F.concat(F.lit("B.Sc in "), w[1], F.lit(" or M.E. or related field")), F.lit("bachelor of science"))).when(m == 1, F.array(F.lit("a B.Com or equivalent"))).otherwise(F.array(F.concat(F.lit("Some "), "p_brand"))).alias("education"),
        F.when(m == 0, F.array(F.concat(n.cast("string"), F.lit("-"), (n + 2).cast("string"), F.lit(" years")))).when(m == 1, F.array(F.concat(n.cast("string"), F.lit("+ years")))).alias("experience"),
        F.array().cast("array<string>").alias("certifications"),
        F.array(w[1], F.col("p_brand"), F.upper(w[1])).alias("keywords"),
    )
    out = U.normalised_jobs(rows, _RED)
    bounds = F.filter("audit.changes", lambda c: c["field"] == "experience")
    join = lambda c: F.array_join(c, ",").alias(c)
    return out.select("k", "title", join("skills"), join("education"), F.array_join(F.transform(bounds, lambda c: c["rule"]), ",").alias("bounds"), F.size("audit.changes").cast("long").alias("n_changes"), F.array_contains("audit.warnings", U.NO_EXPERIENCE).alias("warned"), join("keywords"))
