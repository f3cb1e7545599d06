"""Text, date and extraction queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksmith.functions import arrays as A
from ranksmith.functions import dates as D
from ranksmith.functions import text as X
from ranksmith.operators import extraction as E
from ranksmith.operators import normalise as N
from ranksmith.session import table

from .catalogue import query

_SUFFIX_RE = "|".join(X.SUFFIXES)
TERMS = ["the", "for", "ing", "is", "and", "c++", "von"]


@query("SELECT doc_id, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END AS n_words, length(text) AS n_chars FROM documents")
def text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.word_count(F.col("text")).alias("n_words"), F.length("text").cast("long").alias("n_chars"))


@query(
    r"""WITH d AS (SELECT doc_id, replace(text, '. ', '.' || chr(13) || chr(10) || chr(10) || chr(10) || '  ') AS t FROM documents),
a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '[ \t]+', ' ', 'g') AS t FROM d)
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(t, '(?m)^ | $', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) AS digest FROM a"""
)
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.replace(F.col("text"), F.lit(". "), F.lit(".\r\n\n\n  "))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.normalise_lines(dirty), 256).alias("digest"))


def _phone_sql(raw: str) -> str:
    d = f"regexp_replace({raw}, '[^0-9]', '', 'g')"
    return f"CASE WHEN length({d}) BETWEEN 10 AND 15 AND len(list_distinct(regexp_extract_all({d}, '.'))) > 2 AND {d} <> '1234567890' THEN (CASE WHEN {raw} LIKE '+%' THEN '+' ELSE '' END) || {d} END"


@query(
    rf"""WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Mobile: 98' || (10000000 + doc_id) || chr(10) || text WHEN 1 THEN 'a' || doc_id || '@Mail.comwww.site.com' || chr(10) || text WHEN 2 THEN 'call 98765-' || (43210 + doc_id % 1000) || chr(10) || text WHEN 3 THEN 'Phone 1234567890' || chr(10) || text ELSE text END AS text FROM documents),
e AS (SELECT doc_id, nullif(regexp_replace(lower(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}}', 0)), '{E.GLUED}', '\1'), '') AS m,
regexp_extract(text, '{E.LABELLED}', 1) AS a, regexp_extract(text, '{E.WITH_CODE}', 1) AS b, regexp_extract(array_to_string(string_split(text, chr(10))[:{E.HEADER_LINES}], chr(10)), '{E.PLAIN}', 1) AS c FROM t)
SELECT doc_id, coalesce(m, '-') AS email, coalesce(regexp_replace(m, '^(.).*(@.*)$', '\1***\2'), '-') AS masked, coalesce({_phone_sql('a')}, {_phone_sql('b')}, {_phone_sql('c')}, '-') AS phone FROM e"""
)
def contact_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, key = F.col("doc_id") % 5, F.col("doc_id")
    line = (
        F.when(k == 0, F.concat(F.lit("Mobile: 98"), (10000000 + key).cast("string")))
        .when(k == 1, F.concat(F.lit("a"), key.cast("string"), F.lit("@Mail.comwww.site.com")))
        .when(k == 2, F.concat(F.lit("call 98765-"), (43210 + key % 1000).cast("string")))
        .when(k == 3, F.lit("Phone 1234567890"))
    )
    docs = table(spark, sf_dir, "documents").withColumn("text", F.concat_ws("\n", line, "text"))
    mail = E.email(F.col("text"))
    return docs.select("doc_id", F.coalesce(mail, F.lit("-")).alias("email"), F.coalesce(X.mask_email(mail), F.lit("-")).alias("masked"), F.coalesce(E.phone(F.col("text")), F.lit("-")).alias("phone"))


@query(
    "SELECT doc_id, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(' ' || lower(text) || ' ', '[^a-z0-9_#+]{X._quoted(t)}[^a-z0-9_#+]') THEN '{t}' END" for t in TERMS)
    + "], lambda x: x IS NOT NULL), ',') AS terms FROM documents"
)
def gazetteer_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.match_terms(F.col("text"), TERMS), ",").alias("terms"))


@query(
    f"""WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9+#.]+')) AS tok FROM benchmark),
s AS (SELECT item_id, CASE {' '.join(f"WHEN tok = '{k}' THEN '{v}'" for k, v in X.IRREGULAR.items())} WHEN length(tok) > 3 THEN regexp_replace(tok, '^(.{{3,}}?)(?:{_SUFFIX_RE})$', '\\1') ELSE tok END AS stem FROM t WHERE length(tok) > 1)
SELECT item_id, array_to_string(list_sort(list(DISTINCT stem)), ' ') AS stems FROM s GROUP BY 1"""
)
def stem_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(X.stems(F.col("text"))), " ").alias("stems"))


@query(
    """WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents)
SELECT word, count(*) AS n FROM w WHERE word NOT IN ('the', 'and', 'for', 'with', 'von') GROUP BY 1 ORDER BY n DESC, word LIMIT 30"""
)
def word_frequency_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    kept = words.where(~F.col("word").isin("the", "and", "for", "with", "von"))
    return kept.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(30)


@query(
    """WITH x AS (SELECT conv_id, lower(role) AS k, role, turn, row_number() OVER (PARTITION BY conv_id, lower(role) ORDER BY turn) AS r FROM conversations)
SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM x WHERE r = 1 GROUP BY 1"""
)
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return turns.select("conv_id", F.array_join(A.ordered_distinct(F.transform("t", lambda x: x["role"])), ",").alias("roles"))


@query(
    """WITH a AS (SELECT p_partkey, list_distinct(list_transform(range(1, greatest(length(lower(p_name)) - 2, 1) + 1), lambda i: substr(lower(p_name), i, 3))) AS g, p_type FROM part),
b AS (SELECT p_type, min(p_partkey) AS k FROM part GROUP BY 1)
SELECT a.p_partkey, round(len(list_intersect(a.g, r.g)) / len(list_distinct(list_concat(a.g, r.g))), 4) AS similarity FROM a JOIN b USING (p_type) JOIN a r ON r.p_partkey = b.k WHERE len(list_intersect(a.g, r.g)) / len(list_distinct(list_concat(a.g, r.g))) >= 0.35"""
)
def trigram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", X.ngrams(F.lower("p_name")).alias("g"))
    first = part.groupBy("p_type").agg(F.min_by("g", "p_partkey").alias("r"))
    j = X.jaccard(F.col("g"), F.col("r"))
    return part.join(first, "p_type").where(j >= 0.35).select("p_partkey", F.round(j, 4).alias("similarity"))


@query(
    """WITH b AS (SELECT o_orderkey, o_orderkey % 6 AS f, o_orderdate AS d FROM orders),
t AS (SELECT o_orderkey, CASE f WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%Y-%m') WHEN 2 THEN strftime(d, '%m/%Y') WHEN 3 THEN 'Present' WHEN 4 THEN strftime(d, '%Y') || ' - ' || (CAST(strftime(d, '%Y') AS INTEGER) + 2) ELSE strftime(d, '%b %Y') END AS raw, f, d FROM b)
SELECT o_orderkey, raw, coalesce(CASE f WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 3 THEN NULL WHEN 4 THEN CAST(CAST(strftime(d, '%Y') AS INTEGER) + 2 AS VARCHAR) ELSE strftime(d, '%Y-%m') END, '-') AS iso, f = 3 AS is_current FROM t"""
)
def date_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, f = F.col("o_orderdate"), F.col("o_orderkey") % 6
    year = F.date_format(d, "yyyy")
    raw = F.when(f == 0, F.date_format(d, "yyyy-MM-dd")).when(f == 1, F.date_format(d, "yyyy-MM")).when(f == 2, F.date_format(d, "MM/yyyy")).when(f == 3, "Present").when(f == 4, F.concat(year, F.lit(" - "), (year.cast("int") + 2).cast("string"))).otherwise(F.date_format(d, "MMM yyyy"))
    out = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).withColumn("n", D.normalise_date(F.col("raw")))
    return out.select("o_orderkey", "raw", F.coalesce("n.date", F.lit("-")).alias("iso"), F.col("n.is_current").alias("is_current"))


@query(
    """WITH s AS (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1),
m AS (SELECT o_custkey, (year(b) - year(a)) * 12 + month(b) - month(a) + 1 AS n FROM s)
SELECT o_custkey, CAST(n AS INTEGER) AS months, coalesce(nullif(trim((CASE WHEN n // 12 > 0 THEN (n // 12) || ' year' || (CASE WHEN n // 12 = 1 THEN '' ELSE 's' END) ELSE '' END) || ' ' || (CASE WHEN n % 12 > 0 THEN (n % 12) || ' month' || (CASE WHEN n % 12 = 1 THEN '' ELSE 's' END) ELSE '' END)), ''), '0 months') AS display,
CASE WHEN n < 24 THEN '0-1' WHEN n < 72 THEN '2-5' WHEN n < 132 THEN '6-10' ELSE '11-15' END AS tier, CASE WHEN n < 24 THEN 'FRESHER' ELSE 'EXPERIENCED' END AS category FROM m"""
)
def experience_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM").alias("a"), F.date_format(F.max("o_orderdate"), "yyyy-MM").alias("b"))
    n = span.withColumn("months", D.months_between(F.col("a"), F.col("b")))
    return n.select("o_custkey", "months", D.format_months(F.col("months")).alias("display"), D.experience_tier(F.col("months")).alias("tier"), D.experience_category(F.col("months")).alias("category"))


@query(
    """WITH t AS (SELECT p_partkey, p_size AS n, p_partkey % 3 AS f FROM part)
SELECT p_partkey, CAST(n * 12 AS INTEGER) AS minimum_months, CAST(coalesce(CASE WHEN f = 0 THEN (n + 2) * 12 END, -1) AS INTEGER) AS maximum_months, CASE f WHEN 0 THEN n || '-' || (n + 2) || ' years' WHEN 1 THEN n || '+ years' ELSE n || ' years' END AS display FROM t"""
)
def experience_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, f = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    raw = F.when(f == 0, F.concat(F.lit("Needs "), n, F.lit(" - "), (F.col("p_size") + 2).cast("string"), F.lit(" years of work"))).when(f == 1, F.concat(n, F.lit("+ Years"))).otherwise(F.concat(n, F.lit(" years")))
    out = table(spark, sf_dir, "part").select("p_partkey", D.parse_experience(raw).alias("e"))
    return out.select("p_partkey", "e.minimum_months", F.coalesce("e.maximum_months", F.lit(-1)).alias("maximum_months"), F.col("e.display_value").alias("display"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k'), '-') AS first_of FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k string").getField("k").alias("k"), F.coalesce(E.first_spelling(F.col("props"), ["$.missing", "$.k"]), F.lit("-")).alias("first_of"))


@query(
    """WITH x AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS skill FROM part), c AS (SELECT *, CASE lower(skill) WHEN 'red' THEN 'Crimson' WHEN 'blue' THEN 'Azure' WHEN 'green' THEN 'Emerald' ELSE skill END AS canonical FROM x)
SELECT skill AS source, canonical, count(*) AS n_changes FROM c WHERE skill <> canonical GROUP BY 1, 2"""
)
def normalise_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = {"red": "Crimson", "blue": "Azure", "green": "Emerald"}
    items = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("skill")).withColumn("canonical", N.canonical(F.col("skill"), words))
    changes = N.audit(items, "p_partkey", "skills", "skill", "canonical")
    return changes.groupBy("source", "canonical").agg(F.count("*").alias("n_changes"))


@query(
    r"""WITH d AS (SELECT page_id, coalesce(len(list_distinct(regexp_extract_all(html, 'https?://[A-Za-z0-9./?=&_%#-]+'))), 0) AS n_links, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS n FROM pages)
SELECT page_id, CAST(n_links AS BIGINT) AS n_links, n AS n_chars FROM d"""
)
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.size(E.links(F.col("html"))).cast("long").alias("n_links"), F.length(X.clean_spaces(bare)).cast("long").alias("n_chars"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN '+91' || d WHEN s_suppkey % 4 = 1 THEN '+91' || d WHEN s_suppkey % 4 = 2 THEN '+49' || d ELSE '-' END AS phone FROM (SELECT s_suppkey, CAST(9000000000 + s_suppkey AS VARCHAR) AS d FROM supplier)")
def phone_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = (F.lit(9000000000) + F.col("s_suppkey")).cast("string"), F.col("s_suppkey") % 4
    raw = F.when(k == 0, F.concat(F.substring(d, 1, 5), F.lit("-"), F.substring(d, 6, 5))).when(k == 1, F.concat(F.lit("91 "), d)).when(k == 2, F.concat(F.lit("+49 "), d)).otherwise("12345")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.coalesce(N.phone_e164(raw), F.lit("-")).alias("phone"))


@query(
    """WITH p AS (SELECT c_custkey, c_custkey % 6 AS k, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT c_custkey, CASE k WHEN 3 THEN 'Bengaluru' WHEN 4 THEN '-' ELSE n_name END AS city, CASE k WHEN 0 THEN r_name WHEN 1 THEN r_name WHEN 3 THEN 'Karnataka' ELSE '-' END AS region,
CASE k WHEN 1 THEN 'USA' WHEN 2 THEN 'uk' WHEN 3 THEN 'India' WHEN 4 THEN 'Canada' ELSE '-' END AS country, CASE k WHEN 1 THEN 'US' WHEN 2 THEN 'GB' WHEN 3 THEN 'IN' WHEN 4 THEN 'CA' ELSE '-' END AS code,
CASE k WHEN 0 THEN n_name || ' , ' || r_name WHEN 1 THEN n_name || ', ' || r_name || ', USA' WHEN 2 THEN n_name || ', uk' WHEN 3 THEN 'Bengaluru, Karnataka, India' WHEN 4 THEN 'Canada' ELSE n_name END AS name FROM p"""
)
def location_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    people = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    k, n, r = F.col("c_custkey") % 6, F.col("n_name"), F.col("r_name")
    text = F.when(k == 0, F.concat(n, F.lit(" , "), r)).when(k == 1, F.concat_ws(", ", n, r, F.lit("USA"))).when(k == 2, F.concat(n, F.lit(", uk"))).when(k == 3, "BANGALORE").when(k == 4, "Canada").otherwise(n)
    told = lambda c, name: F.coalesce(c, F.lit("-")).alias(name)
    out = people.select("c_custkey", N.location(text).alias("l"))
    return out.select("c_custkey", told("l.city", "city"), told("l.region", "region"), told("l.country", "country"), told("l.country_code", "code"), F.col("l.display_name").alias("name"))


@query("SELECT doc_id, round(0.85 + 0.03 * least(k, 4), 2) AS confidence, CAST(ceil(length(text) / 2.8 * 1.15 + 20 + 100 + 200) AS BIGINT) AS tokens FROM (SELECT doc_id, text, doc_id % 4 + 1 AS k FROM documents)")
def confidence_and_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ranksmith.functions import scoring as S

    items = F.sequence(F.lit(1), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", S.field_confidence(items).alias("confidence"), S.token_estimate(F.col("text"), F.lit(100)).alias("tokens"))
