"""Insights, hand-off tiers, language votes and the scores that need a cross of two short lists per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ranksmith.functions import dates as D
from ranksmith.functions import text as X

STRONG_AT, WEAK_AT = 80.0, 60.0
#: Common words that vote for a language; the first language wins ties.
LANGUAGE_WORDS = {"en": ("the", "and", "of", "to"), "de": ("der", "die", "und", "den"), "fr": ("le", "la", "les", "des"), "es": ("el", "los", "que", "del")}


def summary(name: Column, level: Column, score: Column, matched: Column, missing: Column) -> Column:
    """One sentence of plain text."""
    return F.format_string("%s: %s with %.2f points; %d matched, %d missing.", F.coalesce(F.nullif(name, F.lit("")), F.lit("Anonymous Candidate")), level, score, matched, missing)


def strengths(scores: dict[str, Column]) -> Column:
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("double").alias("v")) for k, v in scores.items()])
    return F.transform(F.filter(pairs, lambda p: p["v"] >= STRONG_AT), lambda p: p["k"])


def weaknesses(scores: dict[str, Column]) -> Column:
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("double").alias("v")) for k, v in scores.items()])
    return F.transform(F.filter(pairs, lambda p: p["v"] < WEAK_AT), lambda p: p["k"])


def suggestions(weak: Column) -> Column:
    """One suggestion for each weakness, or a default one."""
    given = F.transform(weak, lambda k: F.concat(F.lit("Add evidence for "), F.replace(k, F.lit("_"), F.lit(" "))))
    return F.when(F.size(weak) == 0, F.array(F.lit("Keep the profile up to date"))).otherwise(given)


def handoff(candidates: DataFrame, project: str, months: str) -> DataFrame:
    """Tier and category of each candidate, and the batch's category: EXPERIENCED if any of its candidates is."""
    out = candidates.withColumn("tier", D.experience_tier(F.col(months))).withColumn("category", D.experience_category(F.col(months)))
    some = F.bool_or(F.col("category") == "EXPERIENCED").over(W.partitionBy(project))
    return out.withColumn("batch_category", F.when(some, "EXPERIENCED").otherwise("FRESHER"))


def language_vote(c: Column, default: str = "en") -> Column:
    """Language whose common words occur most; short texts and texts without votes give the default."""
    words = F.split(F.lower(c), r"[\s.,;:!?]+")

    def count(common: tuple[str, ...]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*common)))

    votes = {k: count(common) for k, common in LANGUAGE_WORDS.items()}
    best = F.greatest(*votes.values())
    picked = F.coalesce(*[F.when(v == best, F.lit(k)) for k, v in votes.items()])
    return F.when((F.length(c) < 20) | (F.size(words) < 3) | (best == 0), F.lit(default)).otherwise(picked)


def concept_near(words: Column, concept: list[str], slack: int = 8) -> Column:
    """Whether all words of a concept occur, first to last within its length plus ``slack`` places (first occurrences)."""
    at = [F.array_position(words, F.lit(w)) for w in concept]
    span = F.greatest(*at) - F.least(*at) if len(at) > 1 else F.lit(0)
    found = at[0] > 0
    for a in at[1:]:
        found = found & (a > 0)
    return found & (span <= len(concept) + slack)


def education_score(required: DataFrame, held: DataFrame, on: str) -> DataFrame:
    """Mean over required degrees of 100 (level and field), 50 (either) or 0 (none), each by its best held degree.

    required: on, req_id, level, field; held: on, level, field.  Both lists of a document are short.
    """
    h = held.select(on, F.col("level").alias("h_level"), F.lower("field").alias("h_field"))
    pair = required.join(h, on, "left")
    level = F.coalesce(F.col("h_level") >= F.col("level"), F.lit(False))
    field = F.coalesce(F.col("h_field") == F.lower("field"), F.lit(False))
    points = F.when(level & field, 100.0).when(level | field, 50.0).otherwise(0.0)
    best = pair.groupBy(on, "req_id").agg(F.max(points).alias("points"))
    return best.groupBy(on).agg(F.round(F.avg("points"), 2).alias("education_score"))


def handoff_response(sent: DataFrame, answered: DataFrame, batch: str) -> DataFrame:
    """Answers joined to candidates by reference, else e-mail, else place in the batch."""
    place = W.partitionBy(batch).orderBy("position")
    s = sent.withColumn("_n", F.row_number().over(place))
    a = answered.withColumn("_n", F.row_number().over(place))
    by_ref = a.where(F.col("ref").isNotNull()).groupBy(batch, "ref").agg(F.min("link").alias("link_ref"))
    by_mail = a.where(X.present(F.col("email"))).groupBy(batch, F.lower("email").alias("email_key")).agg(F.min("link").alias("link_mail"))
    by_place = a.select(batch, "_n", F.col("link").alias("link_place"))
    out = s.withColumn("email_key", F.lower("email")).join(by_ref, [batch, "ref"], "left").join(by_mail, [batch, "email_key"], "left").join(by_place, [batch, "_n"], "left")
    return out.withColumn("link", F.coalesce("link_ref", "link_mail", "link_place")).drop("_n", "email_key", "link_ref", "link_mail", "link_place")


def assessment_kpis(rows: DataFrame, *by: str) -> DataFrame:
    """Submitted, graded and verified counts and the mean graded score."""
    graded = F.col("status") == "GRADED"
    return rows.groupBy(*by).agg(F.count_if(F.col("status").isin("SUBMITTED", "GRADED")).alias("submitted"), F.count_if(graded).alias("graded"), F.count_if(F.col("verified")).alias("verified"), F.coalesce(F.round(F.avg(F.when(graded, F.col("score"))), 1), F.lit(0.0)).alias("mean_score"))
