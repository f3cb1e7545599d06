"""Rules of the functions on rows that the driver's tables do not hold: nulls, empty values, ties."""

import pytest
from pyspark.sql import functions as F

from ranksmith.functions import arrays as A
from ranksmith.functions import dates as D
from ranksmith.functions import scoring as S
from ranksmith.functions import text as X
from ranksmith.operators import extraction as E
from ranksmith.operators import joins as J
from ranksmith.operators import matching as M
from ranksmith.operators import mutations as U
from ranksmith.operators import normalise as N
from ranksmith.operators import ranking as R


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).cast("array<string>").alias(k) for k, v in cols.items()])
    return df.select(expr.alias("r")).first().r


@pytest.mark.parametrize(("word", "expected"), [("developing", "develop"), ("skills", "skill"), ("led", "lead"), ("api", "api"), ("testing", "test"), ("organization", "organ"), ("is", "is")])
def test_stem(spark, word, expected):
    assert one(spark, X.stem(F.col("t")), t=word) == expected


def test_dirty_text(spark):
    t = "a\tb  c\r\nd\x00\n\n\n\n e f "
    assert one(spark, X.normalise_lines(F.col("t")), t=t) == "a b c\nd\n\ne f"
    assert one(spark, X.word_count(F.col("t")), t="") == 0


def test_terms_keep_boundaries(spark):
    assert one(spark, X.match_terms(F.col("t"), ["C++", "C", "Java"]), t="I write C++ and JavaScript") == ["C++"]


def test_ordered_distinct(spark):
    assert one(spark, A.ordered_distinct(F.col("a")), a=["B", "a", "b", "A", "c"]) == ["B", "a", "c"]
    assert one(spark, A.ordered_distinct(F.col("a")), a=[]) == []


def test_subsumed_and_longest(spark):
    assert one(spark, A.drop_subsumed(F.col("a")), a=["MBA", "MBA Finance", "PhD"]) == ["MBA Finance", "PhD"]
    assert one(spark, A.longest_first(F.col("a")), a=["b", "aa", "a"]) == ["aa", "a", "b"]


@pytest.mark.parametrize(("raw", "date", "current"), [("Present", None, True), ("2019 - 2021", "2021", False), ("Mar 2020", "2020-03", False), ("13/2020", "13/2020", False), ("2020-05-06", "2020-05-06", False)])
def test_dates(spark, raw, date, current):
    r = one(spark, D.normalise_date(F.col("t")), t=raw)
    assert (r.date, r.is_current) == (date, current)


def test_durations(spark):
    assert one(spark, D.months_between(F.col("a"), F.col("b")), a="2019", b="2020") == 24
    assert one(spark, D.months_between(F.col("a"), F.col("b")), a="2020-05", b="2020-01") is None
    assert one(spark, D.format_months(F.col("n")), n=13) == "1 year 1 month"


def test_experience(spark):
    r = one(spark, D.parse_experience(F.col("t")), t="3+ years")
    assert (r.minimum_months, r.maximum_months, r.display_value) == (36, None, "3+ years")
    assert one(spark, D.parse_experience(F.col("t")), t="none").minimum_months is None


def test_degree_needs_whole_words(spark):
    assert one(spark, S.degree_rank(F.col("t")), t="Bachelor of Commerce") == 3


@pytest.mark.parametrize(("hits", "total", "status"), [(1, 5, "PARTIALLY_MATCHED"), (2, 5, "MATCHED"), (1, 1, "MATCHED"), (0, 3, "UNRESOLVED"), (0, 0, "UNRESOLVED")])
def test_responsibility(spark, hits, total, status):
    assert one(spark, S.responsibility_verdict(F.col("h"), F.col("t")), h=hits, t=total).status == status


def test_recommendation(spark):
    def level(sk, re, pr, pf, out=False):
        cols = {"required_skills": F.lit(sk), "responsibilities": F.lit(re), "projects": F.lit(pr), "preferred_skills": F.lit(pf)}
        return one(spark, S.recommendation(cols, F.lit(out)), x=1)

    assert level(60.0, 0.0, 0.0, 0.0) == "REVIEW"
    assert level(60.0, 10.0, 0.0, 0.0) == "SHORTLIST"
    assert level(60.0, 10.0, 0.0, 0.0, True) == "REJECT"
    assert level(20.0, 20.0, 0.0, 0.0) == "REVIEW"
    assert level(10.0, 20.0, 0.0, 0.0) == "REJECT"


def test_ranking_ties_and_nulls(spark):
    rows = [("p", "b", 90.0), ("p", "a", 90.0), ("p", "c", None), ("q", "d", 1.0)]
    df = spark.createDataFrame(rows, "project_id string, document_id string, final_score double").selectExpr("*", "false is_knocked_out", "'REVIEW' recommendation", "final_score skills_score", "final_score experience_score", "final_score confidence", "cast(null as timestamp) created_at")
    got = {r.document_id: (r.rank_position, r.percentile) for r in R.rank_candidates(df).collect()}
    assert got == {"a": (1, 100.0), "b": (2, 66.67), "c": (3, 33.33), "d": (1, 100.0)}


def test_bad_range_is_refused(spark):
    with pytest.raises(ValueError):
        R.filter_rankings(spark.range(1), low=2, high=1)


def test_partial_upsert_keeps_old_on_null(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(1, None), (3, "c")], "id int, v string")
    assert sorted(map(tuple, U.partial_upsert(old, new, ["id"]).collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_transitions(spark):
    df = spark.createDataFrame([("ARCHIVED", "DRAFT"), ("DRAFT", "ACTIVE"), ("DRAFT", "DRAFT")], "a string, b string")
    assert [r.ok for r in df.select(U.may_move(F.col("a"), F.col("b")).alias("ok")).collect()] == [False, True, True]


def test_priority_join_prefers_first_key(spark):
    left = spark.createDataFrame([(1, "x", "m"), (2, None, "m"), (3, None, None)], "id int, k string, e string")
    right = spark.createDataFrame([(10, "x", "z"), (20, "y", "m"), (30, "y", "m")], "rid int, rk string, re string")
    got = J.priority_join(left, right, [(F.col("k"), F.col("rk")), (F.col("e"), F.col("re"))], {"rid": "partner"})
    assert sorted((r.id, r.partner, r.match_priority) for r in got.collect()) == [(1, 10, 1), (2, 20, 2), (3, None, 0)]


def test_verdict_validation(spark):
    v = spark.createDataFrame([(1, "MATCHED", 0.9, ["e:1"]), (2, "MATCHED", 0.9, ["e:9"]), (3, "PARTIALLY_MATCHED", 0.9, []), (4, "MATCHED", 0.5, ["e:1"])], "id int, status string, confidence double, evidence_ids array<string>")
    s = spark.createDataFrame([(1, "e:1"), (2, "e:1"), (4, "e:1")], "id int, evidence_id string")
    got = {r.id: (r.status, r.coverage) for r in M.validate_verdicts(v, s, ["id"]).collect()}
    assert got == {1: ("MATCHED", 1.0), 2: ("UNRESOLVED", 0.0), 3: ("UNRESOLVED", 0.0), 4: ("UNRESOLVED", 0.0)}  # 3 had no evidence to stand on


def test_extraction(spark):
    t = "Jane Doe\nmail: Jane.Doe@Example.com\n+49 170 1234567\nSkills: Python, SQL\n- Led the migration of services\n- short"
    assert one(spark, E.name_line(F.col("t")), t=t) == "Jane Doe"
    assert one(spark, E.email(F.col("t")), t=t) == "jane.doe@example.com"
    assert one(spark, E.phone(F.col("t")), t=t) == "+491701234567"
    assert one(spark, E.skills(F.col("t"), ["SQL", "Rust"]), t=t) == ["Python", "SQL"]
    assert one(spark, E.responsibilities(F.col("t")), t=t) == ["Led the migration of services"]


def test_normalisers(spark):
    assert one(spark, N.canonical(F.col("t")), t="Language: JS") == "JavaScript"
    assert one(spark, N.degree(F.col("t")), t="B.Tech in computer science") == "Bachelor of Technology in computer science"
    assert one(spark, N.company(F.col("t")), t="Acme Pvt. Ltd.") == "Acme Private Limited"
    assert one(spark, N.company(F.col("t")), t="12 months") is None


def test_spread_ranks_equal_window_ranks(spark):
    rows = [("hot" if i % 3 else "cold", f"d{i:03d}", float(i % 7)) for i in range(300)] + [(None, "x", None)]
    df = spark.createDataFrame(rows, "project_id string, document_id string, final_score double").selectExpr("*", "false is_knocked_out", "'REVIEW' recommendation", "final_score skills_score", "final_score experience_score", "final_score confidence", "cast(null as timestamp) created_at")
    take = lambda d: sorted((r.document_id, r.rank_position, r.percentile) for r in d.collect())
    assert take(R.rank_spread(df, parts=7)) == take(R.rank_candidates(df))
    top = {r.document_id for r in R.leaderboard(df, 5).collect()}
    assert top == {r.document_id for r in R.rank_candidates(df).where("rank_position <= 5 AND project_id IS NOT NULL").collect()}


def test_two_columns_and_references(spark):
    from ranksmith.operators import requirements as Q

    assert one(spark, Q.one_column(F.col("t")), t="a   x\nb   y\nc\nd\ne") == "a\nb\nc\nd\ne\nx\ny"
    assert one(spark, Q.one_column(F.col("t")), t="a   x\nb") == "a   x\nb"
    assert one(spark, Q.evidence_reference(F.col("t")), t="Experience #01") == "experience:1"
    assert one(spark, Q.evidence_reference(F.col("t")), t="???") is None
    assert one(spark, Q.department_code(F.col("t")), t="nowhere") is None


def test_language_defaults(spark):
    from ranksmith.operators import insights as I

    assert one(spark, I.language_vote(F.col("t")), t="zu kurz") == "en"
    assert one(spark, I.language_vote(F.col("t")), t="Das ist der Text und die Frage von den Leuten") == "de"


def test_components_count_what_judges_confirm(spark):
    from ranksmith.operators import components as K
    from ranksmith.plans import component_plans as P

    verdict = "struct<requirement_id:string,requirement_text:string,status:string,coverage:double,reasoning:string>"
    profile = spark.createDataFrame([(7, 0, ["red"], None, None, None, [], None, [])], "document_id long, job_id long, skills array<string>, summary string, experience array<struct<title:string,description:string,responsibilities:array<string>,technologies:array<string>,start_date:string,end_date:string,duration_months:int>>, projects array<struct<name:string,description:string,technologies:array<string>,deliverables:array<string>>>, education array<string>, certifications array<string>, languages array<string>")
    said = [("skill:3", "", "MATCHED", 1.0, ""), ("responsibility:1", "Deliver", "MATCHED", 0.8, ""), ("responsibility:2", "Keep", "PARTIALLY_MATCHED", None, ""), ("degree:1", "", "CONFIRMED", 1.0, "")]
    verdicts = spark.createDataFrame([(7, said)], f"document_id long, verdicts array<{verdict}>")
    row = K.totals(K.component_scores(profile.join(verdicts, "document_id").join(P.jobs(spark), "job_id"))).first()
    s = row.scores
    assert s.skills.score == 75.0 and s.skills.missing == ["state such as hot, cold"]  # two by the skill, the third by its verdict
    assert s.responsibilities.score == 65.0 and s.responsibilities.missing == ["responsibility:2"]
    assert s.education.score == 100.0 and s.projects.score == 0.0 and s.experience.missing == ["36 months"] and s.languages.score == 0.0
    assert row.penalty == 0.0 and not row.knocked_out and row.level == "REVIEW"


def test_recovery_fills_gaps(spark):
    from ranksmith.operators import resumes as P

    found = spark.createDataFrame([(1, "Ann", "", ["SQL"])], "id int, name string, phone string, skills array<string>")
    other = spark.createDataFrame([(1, "Anna", "123", ["sql", "Go"])], "id int, name string, phone string, skills array<string>")
    r = P.with_recovery(found, other, "id", ["name", "phone"], ["skills"]).first()
    assert (r["name"], r.phone, r.skills) == ("Ann", "123", ["SQL", "Go"])
