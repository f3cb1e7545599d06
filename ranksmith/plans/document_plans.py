"""Resume and job fields from texts made of parts, normal forms, reports and small functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksmith.functions import arrays as A
from ranksmith.functions import dates as D
from ranksmith.functions import text as X
from ranksmith.operators import extraction as E
from ranksmith.operators import jobs as J
from ranksmith.operators import mutations as U
from ranksmith.operators import normalise as N
from ranksmith.operators import reports as R
from ranksmith.operators import resumes as P
from ranksmith.session import table

from .bindings import candidate_scores, parts, scores_sql
from .catalogue import query


def _pick(k, *values):
    return F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A resume for each part, with a section left out of every second and third one."""
    key, k2, k3 = F.col("p_partkey"), F.col("p_partkey") % 2, F.col("p_partkey") % 3
    name = F.initcap("p_name")
    text = F.concat_ws(
        "\n",
        name,
        F.concat(F.lit("mail part"), key.cast("string"), F.lit("@example.com | +91 98765 "), F.lpad((key % 100000).cast("string"), 5, "43210")),
        F.when(k3 == 0, "Location: Chennai").when(k3 == 1, "Lives in Bangalore today"),
        F.when(k2 == 0, F.concat(F.lit("Summary\nMakes "), "p_name", F.lit(" for a living"))).otherwise(F.concat(F.lit("A person of many years who has made "), "p_name")),
        F.concat(F.lit("Skills\nPython, "), F.split("p_name", " ")[1], F.lit(", python")),
        F.when(k2 == 0, F.concat(F.lit("Experience\nData Engineer, Acme Ltd, Jan 2020 - Present\n- Built the "), "p_name", F.lit(" platform\n- Kept records"))),
        F.concat(F.lit("Education\nB.Tech in "), "p_type"),
        F.when(k3 == 2, F.concat(F.lit("Projects\n"), "p_brand", F.lit(" line:\nTools: Docker, "), F.split("p_name", " ")[0])),
    )
    return parts(spark, sf_dir).select(key.alias("doc_id"), text.alias("text"))


_P = "p AS (SELECT *, p_partkey % 2 AS k2, p_partkey % 3 AS k3, string_split(p_name, ' ') AS w FROM part)"
_TITLE = "array_to_string(list_transform(w, lambda x: upper(x[1]) || x[2:]), ' ')"


@query(
    f"""WITH {_P}
SELECT p_partkey AS doc_id, {_TITLE} AS name, 'part' || p_partkey || '@example.com' AS email, '+9198765' || lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '43210') AS phone,
CASE WHEN k2 = 0 THEN 'Data Engineer' ELSE '-' END AS designation, CASE k3 WHEN 0 THEN 'Chennai' WHEN 1 THEN 'Bengaluru' ELSE '-' END AS location,
CASE WHEN k2 = 0 THEN 'Makes ' || p_name || ' for a living' ELSE 'A person of many years who has made ' || p_name END AS summary,
CASE WHEN k3 = 2 THEN 'Python,' || w[2] || ',Docker' ELSE 'Python,' || w[2] END AS skills, CASE WHEN k2 = 0 THEN 1 ELSE 0 END AS n_jobs, CASE WHEN k2 = 0 THEN 'Acme Limited' ELSE '-' END AS company, 'Bachelor of Technology in ' || p_type AS education,
CASE WHEN k2 = 0 AND k3 = 2 THEN p_brand || ' line,Data Engineer' WHEN k3 = 2 THEN p_brand || ' line' WHEN k2 = 0 THEN 'Data Engineer' ELSE '' END AS projects,
round((3 + CASE WHEN k2 = 0 THEN 1 ELSE 0 END + CASE WHEN k3 = 2 THEN 1 ELSE 0 END) / 6, 2)::DOUBLE AS section_score,
round((6 + CASE WHEN k2 = 0 THEN 2 ELSE 0 END + CASE WHEN k3 < 2 THEN 1 ELSE 0 END + CASE WHEN k2 = 0 OR k3 = 2 THEN 1 ELSE 0 END) / 11, 2)::DOUBLE AS entity_score FROM p"""
)
def resume_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.extract_resumes(resumes(spark, sf_dir))
    plain = found.withColumn("city", F.col("location"))
    out = P.normalise_resumes(plain)
    first = lambda c: F.coalesce(F.try_element_at(c, F.lit(1)), F.lit("-"))
    return out.select(
        "doc_id", "name", "email", "phone", F.coalesce("designation", F.lit("-")).alias("designation"), F.coalesce("city", F.lit("-")).alias("location"), "summary",
        F.array_join("skills", ",").alias("skills"), F.size("experience").alias("n_jobs"), first(F.transform("experience", lambda e: e["company"])).alias("company"), F.array_join("education", ",").alias("education"),
        F.array_join(F.transform("projects", lambda p: p["name"]), ",").alias("projects"), F.col("quality.section_score").alias("section_score"), F.col("quality.entity_score").alias("entity_score"),
    )


def job_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 2
    text = F.concat_ws(
        "\n",
        F.when(k == 0, F.concat(F.lit("Job title: "), F.initcap("p_name"), F.lit(" maker"))).otherwise(F.concat(F.initcap("p_type"), F.lit(" worker"))),
        F.lit("Requirements"),
        F.concat(F.lit("- Strong knowledge of "), F.split("p_name", " ")[1], F.lit(", py is a plus")),
        F.lit("- React, Angular or another frontend framework"),
        F.lit("- Build large systems for computer science"),
        F.lit("Responsibilities"),
        F.concat(F.lit("- Maintain every "), "p_name", F.lit(" in the store")),
        F.lit("- Bachelor of Engineering or related field"),
        F.concat(F.lit("- minimum of "), (F.col("p_size") % 9 + 1).cast("string"), F.lit(" years")),
        F.lit("- PMP and CISSP wanted"),
    )
    return parts(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


@query(
    f"""WITH {_P}
SELECT p_partkey AS doc_id, CASE WHEN k2 = 0 THEN {_TITLE} || ' maker' ELSE upper(p_type[1]) || lower(p_type[2:]) || ' worker' END AS title, w[2] || ',Python,React / Angular' AS skills,
'Build large systems for computer science|Maintain every ' || p_name || ' in the store' AS responsibilities, 'Bachelor of Engineering' AS education, (p_size % 9 + 1) * 12 AS minimum_months,
'cissp,pmp' AS certifications, 'Computer Science' AS disciplines, 'Retail' AS domain, 0.3::DOUBLE AS skills_confidence, 0.4::DOUBLE AS responsibilities_confidence, 0.67::DOUBLE AS certifications_confidence FROM p"""
)
def job_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = J.normalise_jobs(J.extract_jobs(job_texts(spark, sf_dir)))
    join = lambda c, sep=",": F.array_join(c, sep).alias(c)
    return out.select("doc_id", "title", join("skills"), join("responsibilities", "|"), join("education"), F.col("minimum_months").cast("long").alias("minimum_months"), join("certifications"), join("disciplines"), "domain", "skills_confidence", "responsibilities_confidence", "certifications_confidence")


@query(
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Acme Corporation' WHEN 1 THEN p_brand || ' Private Limited' WHEN 2 THEN '-' WHEN 3 THEN '-' WHEN 4 THEN '-' ELSE p_brand END AS company,
CASE p_partkey % 5 WHEN 0 THEN 'Master of Business Administration (MBA)' WHEN 1 THEN 'Bachelor of Science in Data' WHEN 2 THEN 'Doctor of Philosophy (PhD)' WHEN 3 THEN 'Some ' || p_type ELSE 'Bachelor of Commerce' END AS degree FROM part"""
)
def canonical_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, m = F.col("p_partkey") % 6, F.col("p_partkey") % 5
    company = F.when(k == 0, "Acme  corp.").when(k == 1, F.concat("p_brand", F.lit(" Pvt. Ltd."))).when(k == 2, "till date").when(k == 3, "March 2020").when(k == 4, "Work Experience").otherwise(F.col("p_brand"))
    degree = F.when(m == 0, "must have a MBA or equivalent").when(m == 1, "B.Sc in Data or related field").when(m == 2, "a Ph.D. degree in arts").when(m == 3, F.concat(F.lit("- Some "), "p_type", F.lit("."))).otherwise("bachelor's of commerce")
    return parts(spark, sf_dir).select("p_partkey", F.coalesce(N.company(company), F.lit("-")).alias("company"), N.degree(degree).alias("degree"))


@query(
    """WITH p AS (SELECT p_partkey, p_partkey % 5 AS k, p_size % 9 + 1 AS n FROM part)
SELECT p_partkey, CASE WHEN k = 4 THEN -1 ELSE n * 12 END AS minimum_months, CASE WHEN k = 0 THEN (n + 2) * 12 ELSE -1 END AS maximum_months FROM p"""
)
def experience_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("p_size") % 9 + 1, F.col("p_partkey") % 5
    s = n.cast("string")
    text = F.when(k == 0, F.concat(s, F.lit(" - "), (n + 2).cast("string"), F.lit(" years"))).when(k == 1, F.concat(s, F.lit("+ years"))).when(k == 2, F.concat(F.lit("at least "), s, F.lit(" years"))).when(k == 3, F.concat(s, F.lit(" year"))).otherwise("some years")
    v = D.experience_phrase(text)
    return parts(spark, sf_dir).select("p_partkey", *[F.coalesce(v[c], F.lit(-1)).cast("long").alias(c) for c in ("minimum_months", "maximum_months")])


@query(
    """WITH p AS (SELECT p_partkey, p_partkey % 6 AS k, p_brand, p_type, string_split(p_name, ' ') AS w FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN w[1] WHEN 1 THEN w[1] || ' / ' || w[2] WHEN 2 THEN p_brand WHEN 3 THEN w[1] || '|' || w[2] || '|' || p_type WHEN 4 THEN p_type ELSE w[2] || '|' || w[1] END AS skills, k = 5 AS action FROM p"""
)
def skill_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of parts as skills: after a label and a phrase that asks, as alternatives, before closing words, as lists, and as clauses."""
    k, w = F.col("p_partkey") % 6, F.split("p_name", " ")
    text = (
        F.when(k == 0, F.concat(F.lit("Tools: experience with "), w[0], F.lit(".")))
        .when(k == 1, F.concat(w[0], F.lit(", "), w[1], F.lit(" or another colour")))
        .when(k == 2, F.concat(F.lit("hands-on experience with "), "p_brand", F.lit(" is required")))
        .when(k == 3, F.concat(w[0], F.lit("; "), w[1], F.lit(", "), "p_type"))
        .when(k == 4, F.concat(F.lit("Database: "), "p_type", F.lit(" or similar")))
        .otherwise(F.concat(w[1], F.lit(". Knowledge of "), w[0], F.lit(" and")))
    )
    sentence = F.when(k == 5, F.concat(F.lit("Designing "), "p_name", F.lit(" stores"))).otherwise(text)
    return parts(spark, sf_dir).select("p_partkey", F.array_join(J.split_skills(text), "|").alias("skills"), J.is_action(sentence).alias("action"))


@query(
    """WITH p AS (SELECT *, string_split(p_name, ' ') AS w FROM part)
SELECT p_partkey, array_to_string([w[1], w[2]] || CASE WHEN list_contains(w, lower(p_type)) THEN [] ELSE [p_type] END || [p_brand] || CASE WHEN p_partkey % 2 = 0 THEN ['shade of ' || w[1], 'CI/' || w[2]] ELSE [] END, ',') AS skills FROM p"""
)
def skill_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A skills section with labels, bullets, levels, headings and a sentence."""
    w, even = F.split("p_name", " "), F.col("p_partkey") % 2 == 0
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("Colours: "), w[0], F.lit(", "), w[1], F.lit("; "), F.upper(w[0])),
        F.lit("Technical skills"),
        F.concat(F.lit("• "), "p_type", F.lit(" (Advanced) | "), "p_brand", F.lit(", tools")),
        F.concat(F.lit("Made many a "), "p_name", F.lit(" in a store that sells them.")),
        F.when(even, F.concat(F.lit("2. shade of "), w[0], F.lit(" / CI/"), w[1])),
    )
    return parts(spark, sf_dir).select("p_partkey", F.array_join(E.skill_items(block), ",").alias("skills"))


@query(
    """WITH p AS (SELECT *, string_split(p_name, ' ') AS w FROM part)
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Docker|' || p_brand || '|PostgreSQL' WHEN 1 THEN 'Rust|Python' ELSE 'React' END AS technologies FROM p"""
)
def project_technologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.lit("A store. Tools used: Docker, "), "p_brand", F.lit("; postgres, docker"))).when(k == 1, "Shop | Rust, py\nmore").otherwise("made with React only")
    return parts(spark, sf_dir).select("p_partkey", F.array_join(P.technologies(text), "|").alias("technologies"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand || ' - Udemy Academy' ELSE '' END AS certifications, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END AS n_education FROM part")
def courses_as_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = lambda d, i: F.struct(d.alias("degree"), i.alias("institution"))
    rows = F.array(row(F.col("p_brand"), F.when(F.col("p_partkey") % 3 == 0, "Udemy Academy")), row(F.lit("MBA"), F.lit("State University")))
    v = P.courses_as_certificates(rows)
    return parts(spark, sf_dir).select("p_partkey", F.array_join(v["certifications"], ",").alias("certifications"), F.size(v["education"]).alias("n_education"))


@query(
    f"""WITH {scores_sql()}, d AS (SELECT *, document_id % 7 AS k FROM scores),
s AS (SELECT document_id, is_knocked_out, k, CASE k WHEN 0 THEN 'Not Started' WHEN 1 THEN 'Shortlisted' WHEN 2 THEN 'Rejected' WHEN 3 THEN CASE WHEN final_score >= 60 THEN 'Shortlisted' ELSE 'Graded' END WHEN 4 THEN 'Submitted' WHEN 5 THEN 'In Progress' ELSE 'Not Started' END AS status, final_score FROM d)
SELECT document_id, status, CASE WHEN is_knocked_out THEN 'Final Rejected' WHEN k = 1 THEN 'Final Shortlisted' WHEN k = 2 THEN 'Final Rejected' WHEN k = 3 AND final_score < 60 THEN 'Final Rejected' WHEN k IN (4, 5) THEN 'Under Review' ELSE 'Not Attended' END AS final_status FROM s"""
)
def final_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = candidate_scores(spark, sf_dir), F.col("document_id") % 7
    attended, decision, session = k > 0, F.when(k == 1, "approve").when(k == 2, "FAIL"), F.when(k == 4, "Completed").when(k == 5, "started")
    score = F.when(k == 3, F.col("final_score"))
    out = c.withColumn("status", R.assessment_status(attended, decision, F.when(k == 3, "graded"), session, score))
    return out.select("document_id", "status", R.final_status(F.col("is_knocked_out"), attended, decision, F.col("status"), score).alias("final_status"))


@query(
    f"""WITH {scores_sql()}, l AS (SELECT *, CASE WHEN final_score >= 80 THEN 'SHORTLIST' WHEN final_score >= 40 THEN 'REVIEW' ELSE 'REJECT' END AS level, ['sql', 'python', 'go'][document_id % 3 + 1] AS skill FROM scores),
k AS (SELECT project_id, skill, row_number() OVER (PARTITION BY project_id ORDER BY count(*) DESC, skill) AS r FROM l GROUP BY 1, 2)
SELECT l.project_id, count(*) AS n_candidates, round(avg(final_score), 2) AS mean_score, min(final_score) AS least_score, max(final_score) AS greatest_score, count(*) FILTER (level = 'SHORTLIST') AS n_shortlist, count(*) FILTER (level = 'REVIEW') AS n_review,
count(*) FILTER (level = 'REJECT') AS n_reject, count(*) FILTER (is_knocked_out) AS n_knocked_out, (SELECT string_agg(skill, ', ' ORDER BY r) FROM k WHERE k.project_id = l.project_id AND r <= 2) AS missing_skills FROM l GROUP BY 1"""
)
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidate_scores(spark, sf_dir)
    return R.dashboard(c, c.select("project_id", _pick(F.col("document_id") % 3, "sql", "python", "go").alias("skill")), most=2)


@query(
    f"""WITH {scores_sql()}, o AS (SELECT * FROM scores WHERE project_id <> 'BUILDING'), a AS (SELECT project_id, count(*) AS n, round(avg(final_score), 2) AS mean_score, max(final_score) AS greatest_score, min(final_score) AS least_score FROM o GROUP BY 1)
SELECT * FROM a UNION ALL SELECT 'BUILDING', 7, 50.5, 80.0, 10.0"""
)
def recruiter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    server = spark.createDataFrame([("BUILDING", 7, 50.5, 80.0, 10.0)], "project_id string, n long, mean_score double, greatest_score double, least_score double")
    return R.recruiter_summary(candidate_scores(spark, sf_dir).where("project_id <> 'BUILDING'"), server)


@query(
    """WITH u AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus = 'F' AS failed FROM orders)
SELECT o_orderkey, NOT failed AND row_number() OVER (PARTITION BY o_custkey ORDER BY failed, o_orderdate DESC, o_orderkey DESC) = 1 AS is_active FROM u"""
)
def active_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", (F.col("o_orderstatus") == "F").alias("failed"))
    return R.active_uploads(u, "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "is_active")


@query(
    """WITH a AS (SELECT DISTINCT n_regionkey AS k FROM nation WHERE n_nationkey % 2 = 0), c AS (SELECT r_regionkey AS k, r_name AS verdict, CASE WHEN r_regionkey IN (SELECT k FROM a) THEN 100 ELSE r_regionkey END AS used_at FROM region)
SELECT verdict, CAST(used_at AS BIGINT) AS used_at FROM c ORDER BY used_at DESC, verdict LIMIT 100"""
)
def verdict_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda c: F.sha2(F.col(c).cast("string"), 256)
    cache = table(spark, sf_dir, "region").select(key("r_regionkey").alias("hash"), F.col("r_name").alias("verdict"), F.col("r_regionkey").cast("long").alias("used_at"))
    asked = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_regionkey").cast("string").alias("content"), F.lit(100).cast("long").alias("at"))
    return R.cached_verdicts(asked, cache, ["content"], 100)[1].select("verdict", "used_at")


@query(
    """WITH p AS (SELECT p_partkey, p_partkey % 4 AS k, string_split(p_name, ' ') AS w, p_name, p_brand, p_type FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(w)), ',') AS sorted, CASE WHEN w[1] < w[2] AND length(w[1]) = length(w[2]) OR length(w[1]) > length(w[2]) THEN w[1] ELSE w[2] END AS longest,
'big ' || p_name || ',' || p_brand AS unsubsumed, 2 AS n_words, '***' AS masked, p_brand || '|' || p_type AS merged, w[1] || ' b' AS lines, k < 2 AS member, '{a=1, b=9, c=3}' AS map, 'Anne-Marie O''Neil' AS name, 'strasse' AS folded FROM p"""
)
def small_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, words = F.col("p_partkey") % 4, F.split("p_name", " ")
    entry = lambda m: F.format_string("{a=%d, b=%d, c=%d}", F.try_element_at(m, F.lit("a")), F.try_element_at(m, F.lit("b")), F.try_element_at(m, F.lit("c")))
    merged = A.merged_map(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(9), F.lit("c"), F.lit(3)))
    structs = lambda *pairs: F.array(*[F.struct(a.alias("k"), b.alias("v")) for a, b in pairs])
    pair = A.merge_records(structs((F.lit("X"), F.lit(None).cast("string"))), structs((F.lit("x"), F.col("p_brand")), (F.lit("y"), F.col("p_type"))), "k", ["k", "v"])
    return parts(spark, sf_dir).select(
        "p_partkey",
        F.array_join(A.sorted_unique(words), ",").alias("sorted"),
        A.longest_first(words)[0].alias("longest"),
        F.array_join(A.drop_subsumed(F.array(F.col("p_name"), F.concat(F.lit("big "), "p_name"), F.col("p_brand"))), ",").alias("unsubsumed"),
        X.word_count(F.concat(F.lit("  "), words[0], F.lit(" \n "), words[1])).cast("int").alias("n_words"),
        F.substring(X.mask_email(F.concat("p_name", F.lit("@example.com"))), 2, 3).alias("masked"),
        F.array_join(F.transform(pair, lambda x: x["v"]), "|").alias("merged"),
        F.array_join(X.content_lines(F.concat(F.lit(" - "), words[0], F.lit("\n\n2. b"))), " ").alias("lines"),
        A.in_category(F.when(k < 2, "Go").otherwise("Basic"), {"languages": ("go", "rust")}, F.lit("Languages")).alias("member"),
        entry(merged).alias("map"),
        X.title_name(F.lit("anne-marie o'neil")).alias("name"),
        X.casefold(F.lit("STRAßE")).alias("folded"),
    )
