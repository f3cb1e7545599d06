"""Vendor payloads made of the tables, mapped to records, with gaps filled from another reading of the same resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksmith.operators import vendor as V

from .bindings import parts
from .catalogue import query


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, payload): one for each part; every third lacks its name, every fourth its jobs."""
    k = F.col("p_partkey")
    words = F.split("p_name", " ")
    name = F.when(k % 3 == 0, F.struct(F.lit(None).cast("string").alias("firstName"), F.lit(None).cast("string").alias("familyName"))).otherwise(F.struct(F.initcap(words[0]).alias("firstName"), F.concat(F.lit(" "), F.initcap(words[1])).alias("familyName")))
    job = F.struct(
        F.concat("p_brand", F.lit(" Ltd ")).alias("workExperienceOrganization"), F.when(k % 2 == 0, "Contract Engineer").otherwise("Engineer").alias("workExperienceJobTitle"), F.concat(F.lit("• Made "), "p_name", F.lit("\n- Sold it")).alias("workExperienceDescription"),
        F.struct(F.struct(F.concat((2000 + k % 10).cast("string"), F.lit("-03-01")).alias("date")).alias("start"), F.struct(F.concat((2011 + k % 5).cast("string"), F.lit("-01-15T00:00")).alias("date"), (k % 5 == 0).alias("isCurrent")).alias("end")).alias("workExperienceDates"),
        F.lit("dropped").alias("unknownKey"),
    )
    school = lambda d, o: F.struct(d.alias("educationAccreditation"), o.alias("educationOrganization"), F.array(F.col("p_type")).alias("educationMajor"))
    schools = F.array(school(F.lit("B.Tech, MBA"), F.concat("p_brand", F.lit(" College"))), school(F.concat("p_brand", F.lit(" course")), F.lit("Udemy Academy")))
    payload = F.to_json(F.struct(name.alias("candidateName"), F.array(F.lit(" "), F.concat(F.lit("P"), k.cast("string"), F.lit("@X.com"))).alias("email"), F.transform(words, lambda w: F.struct(w.alias("name"))).alias("skill"), F.when(k % 4 > 0, F.array(job)).alias("workExperience"), schools.alias("education")))
    return parts(spark, sf_dir).select(k.alias("doc_id"), F.when(k % 11 == 0, "no json").otherwise(payload).alias("payload"))


@query(
    """WITH p AS (SELECT p_partkey AS k, p_name, string_split(p_name, ' ') AS w, p_brand, p_type, p_partkey % 11 = 0 AS bad FROM part),
s AS (SELECT k, upper(w[1][1]) || w[1][2:] || ' ' || upper(w[2][1]) || w[2][2:] AS full_name, list_reduce(list_transform(w, lambda x: [x]), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE a || b END) AS skills FROM p)
SELECT p.k AS doc_id, CASE WHEN bad OR p.k % 3 = 0 THEN 'local ' || w[1] ELSE full_name END AS name, CASE WHEN bad THEN '-' ELSE 'p' || p.k || '@x.com' END AS email, CASE WHEN bad THEN 'local' ELSE array_to_string(skills, ',') END AS skills,
CASE WHEN bad OR p.k % 4 = 0 THEN 'Local Inc|Engineer|Full-time|-|-|-|false|kept' ELSE p_brand || ' Ltd|' || CASE WHEN p.k % 2 = 0 THEN 'Contract Engineer|Contract' ELSE 'Engineer|Full-time' END || '|' || (2000 + p.k % 10) || '-03-01|' ||
  CASE WHEN p.k % 5 = 0 THEN '-|' || ((20 - p.k % 10) * 12 + 3) || ' months|true' ELSE (2011 + p.k % 5) || '-01-15|' || ((2011 + p.k % 5 - 2000 - p.k % 10) * 12 - 2) || ' months|false' END || '|Made ' || p_name || '/Sold it' END AS jobs,
CASE WHEN bad THEN '' ELSE 'B.Tech/' || p_type || '/' || p_brand || ' College|MBA/' || p_type || '/' || p_brand || ' College' END AS education, CASE WHEN bad THEN '' ELSE p_brand || ' course - Udemy Academy' END AS certifications,
array_to_string(list_filter([CASE WHEN bad OR p.k % 3 = 0 THEN 'name' END, CASE WHEN bad THEN 'skills' END, CASE WHEN bad OR p.k % 4 = 0 THEN 'experience' END], lambda x: x IS NOT NULL), ',') AS filled FROM p JOIN s ON p.k = s.k"""
)
def vendor_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ranksmith.operators import records as R

    part, words = parts(spark, sf_dir), F.split("p_name", " ")
    local = part.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("local "), words[0]).alias("name"), F.array(F.lit("local")).alias("skills"), R.experience_records(F.lit("Local Inc\nEngineer\n- kept")).alias("experience"))
    out = V.filled(V.map_resume(payloads(spark, sf_dir), today=F.lit("2020-06-01").cast("date")), local, "doc_id")
    told = lambda c: F.coalesce(c, F.lit("-"))
    job = lambda j: F.concat_ws("|", told(j["company"]), told(j["title"]), j["employment_type"], told(j["start_date"]), told(j["end_date"]), told(j["duration"]), j["is_current"].cast("string"), F.array_join(j["responsibilities"], "/"))
    degree = lambda e: F.concat_ws("/", e["degree"], told(e["field_of_study"]), told(e["institution"]))
    return out.select("doc_id", "name", told(F.col("email")).alias("email"), F.array_join("skills", ",").alias("skills"), F.array_join(F.transform("experience", job), ";").alias("jobs"), F.array_join(F.transform("education", degree), "|").alias("education"), F.array_join("certifications", ",").alias("certifications"), F.array_join("filled_fields", ",").alias("filled"))
