"""Group verdicts, final re-validation, skills sections and the audit of jobs, edge cases included."""

import pytest
from pyspark.sql import functions as F

from ranksmith.functions import concepts as C
from ranksmith.operators import audit as U
from ranksmith.operators import extraction as E
from ranksmith.operators import matching as M

GROUPS = [
    ("Python and SQL", "MATCHED", "EXACT", ["Python", "SQL"], ["skills:1", "skills:2"]),
    ("Knowledge of Python and experience with SQL", "MATCHED", "EXACT", ["Python", "SQL"], ["skills:1", "skills:2"]),
    ("Python, and teamwork", "MATCHED", "EXACT", ["Python"], ["skills:1"]),
    ("teamwork and Python", "NO_MATCH", None, [], []),
    ("Python and Rust", "NO_MATCH", None, [], []),
    ("Rust or SQL", "MATCHED", "EXACT", ["SQL"], ["skills:2"]),
    ("Rust / Scala", "NO_MATCH", None, [], []),
    ("stores such as Oracle, SQL", "MATCHED", "EXACT", ["SQL"], ["skills:2"]),
    ("Strong knowledge of py", "MATCHED", "ALIAS", ["Python"], ["skills:1"]),
    ("large stores", "MATCHED", "ALIAS", ["large stores"], ["project:1"]),
    ("", "NO_MATCH", None, [], []),
    (None, "NO_MATCH", None, [], []),
]


def test_group_verdicts(spark):
    held = [("skills:1", "skills", "Python"), ("skills:2", "skills", "SQL"), ("project:1", "project", "built large data stores")]
    df = spark.createDataFrame([(g[0], ["Python", "SQL"], held) for g in GROUPS], "t string, s array<string>, e array<struct<evidence_id:string,kind:string,text:string>>")
    got = [r.v for r in df.select(M.group_verdict(F.col("t"), F.col("s"), F.col("e"), C.dictionaries()).alias("v")).collect()]
    assert [(v.status, v.method, v.skills, v.evidence_ids) for v in got] == [g[1:] for g in GROUPS]
    nothing = df.select(M.group_verdict(F.col("t"), F.lit(None).cast("array<string>"), F.lit(None).cast("array<struct<evidence_id:string,kind:string,text:string>>"), C.dictionaries()).alias("v")).collect()
    assert {r.v.status for r in nothing} == {"NO_MATCH"}


@pytest.fixture
def final(spark):
    verdicts = spark.createDataFrame(
        [(1, "a", "MATCHED", ["experience:1"]), (1, "b", "MATCHED", ["project:1", "project:9", "education:1"]), (1, "c", "PARTIALLY_MATCHED", None), (1, "x", "MATCHED", ["summary:1"]), (2, "b", "NO_MATCH", ["project:1"])],
        "k int, requirement_id string, status string, evidence_ids array<string>",
    )
    asked = spark.createDataFrame([(1, "a", "degree", "MBA"), (1, "b", "project_relevance", " Kafka  streams"), (1, "c", "skill", "Go"), (2, "b", "project_relevance", "Kafka")], "k int, requirement_id string, kind string, text string")
    held = spark.createDataFrame([(1, "experience:1", "experience"), (1, "project:1", "project"), (1, "project:1", "project"), (1, "education:1", "education"), (2, "project:1", "project")], "k int, evidence_id string, kind string")
    return M.revalidate(verdicts, asked, held, ["k"])


def test_final_verdicts_keep_what_holds(final):
    got = {(r.k, r.requirement_id): (r.status, r.evidence_ids) for r in final.collect()}
    assert got == {(1, "a"): ("UNRESOLVED", []), (1, "b"): ("MATCHED", ["project:1"]), (1, "c"): ("PARTIALLY_MATCHED", []), (1, "x"): ("MATCHED", ["summary:1"]), (2, "b"): ("NO_MATCH", ["project:1"])}


def test_projects_gain_what_they_prove(spark, final):
    projects = spark.createDataFrame([(1, "project:1", ["Go"]), (1, "project:2", None), (2, "project:1", ["kafka"])], "k int, evidence_id string, technologies array<string>")
    got = {(r.k, r.evidence_id): r.technologies for r in M.proven_technologies(projects, final, ["k"]).collect()}
    assert got == {(1, "project:1"): ["Go", " Kafka  streams"], (1, "project:2"): [], (2, "project:1"): ["kafka"]}
    named = projects.withColumn("technologies", F.array(F.lit("kafka STREAMS")))
    assert {tuple(r.technologies) for r in M.proven_technologies(named, final, ["k"]).collect()} == {("kafka STREAMS",)}
    assert M.proven_technologies(projects.limit(0), final, ["k"]).count() == 0


def test_skill_items(spark):
    block = "Technical Skills\n• Languages: Python (Advanced), C/C++; go | GO\n2) 3D modelling / CI/CD\nFrameworks\nI have worked for ten years with very many kinds of tools.\nKeeps records.\n\tR\t*  S  T"
    df = spark.createDataFrame([(block,), ("",), (" \n•",), (None,)], "t string")
    assert [r.s for r in df.select(E.skill_items(F.col("t")).alias("s")).collect()] == [["Python", "C/C++", "go", "3D modelling", "CI/CD", "Keeps records.", "R", "S", "T"], [], [], None]


def test_job_audit(spark):
    schema = "title string, skills array<string>, education array<string>, experience array<string>, certifications array<string>, keywords array<string>"
    rows = [
        ("DATA ENGINEER", ["py", "Python", "", None], ["Bachelor's degree", "B.Tech in Physics or related field or MBA"], ["3-5 years", "3-5  years", "some time"], ["pmp"], ["a", "A"]),
        (None,) * 6,
        ("x", [], [""], [None, " "], [], []),
    ]
    got = U.normalised_jobs(spark.createDataFrame(rows, schema), {"py": "Python"}).collect()
    a = got[0]
    assert (a.title, a.skills, a.education) == ("Data Engineer", ["Python"], ["Bachelor of Technology in Physics", "Bachelor's Degree", "Master of Business Administration (MBA)"])
    assert (a.experience, a.certifications, a.keywords) == (["3-5 years", "some time"], ["Project Management Professional (PMP)"], ["a"])
    assert [c.rule for c in a.audit.changes if c.field == "experience"] == ["experience_parse:months(min=36,max=60)"] * 2 + ["experience_parse:months(min=-,max=-)"]
    assert a.audit.warnings == [] and [(r.skills, r.education, r.audit.warnings) for r in got[1:]] == [([], [], [U.NO_EXPERIENCE])] * 2
