"""Component scores of parts as candidates for three jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksmith.operators import components as K

from .bindings import parts
from .catalogue import query

_LISTS = ("required_skills", "preferred_skills", "responsibilities", "project_requirements", "keywords", "degree_requirements", "required_certifications", "required_languages", "mandatory_skills", "experience_requirements")
JOBS = [
    (0, ["red or blue", "widget and small", "state such as hot, cold"], ["new", "gizmo"], ["Deliver widget parts", "Keep anvil stock"], ["small / large"], [], ["Bachelor in Computer Science"], ["Brand#7"], ["English"], ["red"], ["3+ years"]),
    (1, ["JavaScript", "programming language", "Strong knowledge of gear", "js"], [], [], [], [], [], [], [], [], []),
    (2, ["old rods"], ["hot"], [], [], ["DNS", "plate"], [], [], [], [], ["2-4 years"]),
]


def jobs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(JOBS, "job_id long, " + ", ".join(f"{c} array<string>" for c in _LISTS))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as candidates: words of the name as skills, one job done, every second one with a project."""
    words, key = F.split("p_name", " "), F.col("p_partkey")
    extra = lambda n, skill: F.when(key % n == 0, F.array(F.lit(skill))).otherwise(F.array().cast("array<string>"))
    nothing = F.array().cast("array<string>")
    done = F.struct(
        F.col("p_brand").alias("title"),
        F.concat(F.lit("Developed the "), "p_name", F.lit(" platform")).alias("description"),
        F.array("p_type").alias("responsibilities"),
        F.array(words[1]).alias("technologies"),
        F.lit("2000-01").alias("start_date"),
        F.when(F.col("p_size") % 2 == 0, "2001-06").alias("end_date"),
        F.when(key % 2 == 0, F.col("p_size").cast("int")).alias("duration_months"),
    )
    project = F.struct(F.col("p_type").alias("name"), F.lit(None).cast("string").alias("description"), F.array(words[0]).alias("technologies"), nothing.alias("deliverables"))
    degrees = F.array(F.array(F.lit("Bachelor of Science in Computer Science")), F.array(F.lit("Master of Arts")), F.array(F.lit("Diploma in Information Technology")), nothing)
    return parts(spark, sf_dir).select(
        key.alias("document_id"),
        (key % 3).alias("job_id"),
        F.concat(words, extra(5, "js"), extra(7, "Python")).alias("skills"),
        F.lower("p_type").alias("summary"),
        F.array(done).alias("experience"),
        F.when(key % 2 == 0, F.array(project)).alias("projects"),
        F.element_at(degrees, (F.col("p_size") % 4 + 1).cast("int")).alias("education"),
        F.array("p_brand").alias("certifications"),
        F.when(key % 2 == 0, F.array(F.lit("english"))).alias("languages"),
    )


_W = "p AS (SELECT *, string_split(p_name, ' ') AS w, p_partkey % 3 AS job FROM part)"
_HAS = lambda x: f"CAST(list_contains(w, '{x}') AS INTEGER)"
_COMPONENTS = f"""{_W},
c AS (SELECT p_partkey AS document_id, job,
  CASE job WHEN 0 THEN round(({_HAS('red')} + greatest({_HAS('red')}, {_HAS('blue')}) + {_HAS('widget')} * greatest({_HAS('small')}, CAST(p_type = 'SMALL' AS INTEGER)) + greatest({_HAS('hot')}, {_HAS('cold')})) * 100 / 4, 2)
    WHEN 1 THEN round((CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END + {_HAS('gear')}) * 100 / 3, 2)
    ELSE {_HAS('old')} * {_HAS('rod')} * 100.0 END AS skills,
  CASE job WHEN 0 THEN ({_HAS('widget')} + {_HAS('anvil')}) * 100 / 2 ELSE 100.0 END AS responsibilities,
  CASE job WHEN 0 THEN greatest({_HAS('small')}, {_HAS('large')}, CAST(p_partkey % 2 = 0 AND p_type IN ('SMALL', 'LARGE') AS INTEGER), CAST(p_type IN ('SMALL', 'LARGE') AS INTEGER)) * 100.0 WHEN 1 THEN 100.0 ELSE {_HAS('plate')} * 100.0 END AS projects,
  CASE job WHEN 0 THEN ({_HAS('new')} + {_HAS('gizmo')}) * 100 / 2 WHEN 1 THEN 100.0 ELSE {_HAS('hot')} * 100.0 END AS preferred_skills,
  CASE job WHEN 0 THEN {_HAS('new')} + {_HAS('gizmo')} WHEN 1 THEN 0 ELSE {_HAS('hot')} END AS n_preferred,
  CASE WHEN p_partkey % 2 = 0 AND p_size > 0 THEN p_size WHEN p_size % 2 = 0 THEN 17 ELSE 12 END AS months,
  CASE WHEN job > 0 THEN 100.0 ELSE [100.0, 50.0, 50.0, 0.0][p_size % 4 + 1] END AS education,
  CASE WHEN job > 0 OR p_brand = 'Brand#7' THEN 100.0 ELSE 0.0 END AS certifications,
  CASE WHEN job > 0 OR p_partkey % 2 = 0 THEN 100.0 ELSE 0.0 END AS languages,
  job = 0 AND NOT list_contains(w, 'red') AS knocked_out FROM p),
e AS (SELECT *, CASE job WHEN 0 THEN round(least(100.0, months * 100 / 36), 2) WHEN 1 THEN 100.0 ELSE round(least(100.0, months * 100 / 24), 2) END AS experience FROM c)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.component_scores(candidates(spark, sf_dir).join(F.broadcast(jobs(spark)), "job_id"))


@query(f"WITH {_COMPONENTS} SELECT document_id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in K.COMPONENTS)} FROM e")
def component_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("document_id", *[F.col(f"scores.{c}.score").alias(c) for c in K.COMPONENTS])


@query(
    f"""WITH {_COMPONENTS},
t AS (SELECT *, CASE job WHEN 0 THEN (30 * skills + 25 * responsibilities + 25 * projects + 15 * preferred_skills + 5 * certifications) / 100 WHEN 1 THEN skills ELSE (30 * skills + 25 * projects + 15 * preferred_skills) / 70 END AS w,
  CASE job WHEN 0 THEN (skills + responsibilities + projects + preferred_skills + certifications + education) / 6 WHEN 1 THEN skills ELSE (skills + projects + preferred_skills) / 3 END AS r, 2.0 * n_preferred AS bonus,
  CASE WHEN job = 0 THEN responsibilities ELSE 0 END AS re, CASE WHEN job = 1 THEN 0 ELSE projects END AS pr, CASE WHEN job = 1 THEN 0 ELSE preferred_skills END AS pf, CASE WHEN job = 0 THEN certifications ELSE 0 END AS ce FROM e)
SELECT document_id, CAST(round(w, 2) AS DOUBLE) AS weighted_total, CAST(round(r, 2) AS DOUBLE) AS raw_total, CAST(bonus AS DOUBLE) AS bonus, CAST(0 AS DOUBLE) AS penalty, CAST(round(least(100.0, round(w, 2) + bonus), 2) AS DOUBLE) AS final_score, knocked_out,
CASE WHEN knocked_out THEN 'REJECT' WHEN (skills >= 50 OR re >= 50 OR pr >= 50) AND (pf > 0 OR ce > 0 OR (skills > 0 AND skills < 50) OR (re > 0 AND re < 50) OR (pr > 0 AND pr < 50)) THEN 'SHORTLIST'
  WHEN skills >= 25 OR re >= 25 OR pr >= 25 OR (skills >= 20 AND (re >= 20 OR pr >= 20)) THEN 'REVIEW' ELSE 'REJECT' END AS level FROM t"""
)
def component_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.totals(_scored(spark, sf_dir)).select("document_id", "weighted_total", "raw_total", "bonus", "penalty", "final_score", "knocked_out", "level")
