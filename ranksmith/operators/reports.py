"""Final status, dashboard, recruiter summary, active uploads and the verdict cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

PASS_AT = 60.0
PASSED, FAILED = ("SHORTLIST", "PASS", "APPROVE", "ADVANCE"), ("REJECT", "FAIL")


def assessment_status(attended: Column, decision: Column, score_status: Column, session_status: Column, score: Column) -> Column:
    """State of an assessment: a decision counts first, then a grade, then how far the session has come."""
    d, s, w = F.upper(F.coalesce(decision, F.lit(""))), F.lower(F.coalesce(score_status, F.lit(""))), F.lower(F.coalesce(session_status, F.lit("")))
    graded = s.isin("graded", "scored") | score.isNotNull()
    return (
        F.when(~attended, "Not Started")
        .when(d.isin(*PASSED), "Shortlisted")
        .when(d.isin(*FAILED), "Rejected")
        .when(graded, F.when(score >= PASS_AT, "Shortlisted").otherwise("Graded"))
        .when(w.isin("submitted", "completed"), "Submitted")
        .when(w.isin("in_progress", "started"), "In Progress")
        .otherwise("Not Started")
    )


def final_status(rejected: Column, attended: Column, decision: Column, status: Column, score: Column) -> Column:
    """What becomes of a candidate: rejected on the resume, decided, failed by grade, under review, or never there.

    A pass by grade alone reads as Shortlisted in ``status`` and, without a decision, leaves the candidate Not Attended: the reports' own order of rules.
    """
    d = F.upper(F.coalesce(decision, F.lit("")))
    return (
        F.when(rejected, "Final Rejected")
        .when(~attended, "Not Attended")
        .when(d.isin(*FAILED), "Final Rejected")
        .when(d.isin(*PASSED), "Final Shortlisted")
        .when((status == "Graded") & (score >= PASS_AT), "Final Shortlisted")
        .when((status == "Graded") & (score < PASS_AT), "Final Rejected")
        .when(status.isin("Submitted", "In Progress"), "Under Review")
        .otherwise("Not Attended")
    )


def dashboard(scores: DataFrame, skills: DataFrame, project: str = "project_id", most: int = 5) -> DataFrame:
    """One row for each project: counts, mean, least and greatest score, counts by level and the ``most`` commonest missing skills.

    scores: project, final_score, recommendation, is_knocked_out; skills: project, skill (one row for each candidate that lacks it).
    """
    level = lambda name: F.count_if(F.col("recommendation") == name)
    totals = scores.groupBy(project).agg(
        F.count("*").alias("n_candidates"), F.round(F.avg("final_score"), 2).alias("mean_score"), F.min("final_score").alias("least_score"), F.max("final_score").alias("greatest_score"),
        level("SHORTLIST").alias("n_shortlist"), level("REVIEW").alias("n_review"), level("REJECT").alias("n_reject"), F.count_if("is_knocked_out").alias("n_knocked_out"),
    )
    counted = skills.groupBy(project, "skill").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy(project).orderBy(F.col("n").desc(), "skill"))
    top = counted.withColumn("r", rank).where(F.col("r") <= most).groupBy(project).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "skill"))), lambda x: x["skill"]), ", ").alias("missing_skills"))
    return totals.join(top, project, "left")


def recruiter_summary(rows: DataFrame, server: DataFrame, project: str = "project_id") -> DataFrame:
    """Counts and scores of a project's own rows or, where it has none, of the server's statistics (same columns)."""
    own = rows.groupBy(project).agg(F.count("*").alias("n"), F.round(F.avg("final_score"), 2).alias("mean_score"), F.max("final_score").alias("greatest_score"), F.min("final_score").alias("least_score"))
    columns = ("n", "mean_score", "greatest_score", "least_score")
    other = server.select(project, *[F.col(c).alias(f"_s_{c}") for c in columns])
    return own.join(other, project, "full").select(project, *[F.coalesce(c, f"_s_{c}").alias(c) for c in columns])


def active_uploads(uploads: DataFrame, owner: str, at: str, key: str) -> DataFrame:
    """``uploads`` with is_active: of an owner's successful uploads only the newest (ties: greatest key) is; failed ones never replace it."""
    ok = F.col("failed") == F.lit(False)
    newest = uploads.where(ok).groupBy(owner).agg(F.max(F.struct(at, key)).alias("_new"))
    return uploads.join(newest, owner, "left").withColumn("is_active", F.coalesce(ok & (F.struct(at, key) == F.col("_new")), F.lit(False))).drop("_new")


def cached_verdicts(asked: DataFrame, cache: DataFrame, content: list[str], capacity: int) -> tuple[DataFrame, DataFrame]:
    """(hits, cache after): verdicts of requests whose content hash is cached; the cache keeps its ``capacity`` last used entries.

    asked: content columns, at; cache: hash, verdict, used_at.
    """
    keyed = asked.withColumn("hash", F.sha2(F.concat_ws("\u0001", *content), 256))
    hits = keyed.join(cache.select("hash", "verdict"), "hash")
    used = hits.groupBy("hash").agg(F.max("at").alias("_at"))
    after = cache.join(used, "hash", "left").select("hash", "verdict", F.greatest("used_at", F.coalesce("_at", "used_at")).alias("used_at"))
    return hits, after.orderBy(F.col("used_at").desc(), "hash").limit(capacity)
