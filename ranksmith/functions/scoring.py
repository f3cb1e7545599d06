"""Scoring rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import present

#: Weight of each category in percent.
WEIGHTS = {"required_skills": 30.0, "responsibilities": 25.0, "projects": 25.0, "preferred_skills": 15.0, "experience": 0.0, "certifications": 5.0, "education": 0.0}
BONUS_EACH, BONUS_CAP = 2.0, 15.0
CORE = ("required_skills", "responsibilities", "projects")
SHORTLIST_AT, REVIEW_AT, WEAK_AT = 50.0, 25.0, 20.0


def clamp(x: Column, digits: int = 2) -> Column:
    return F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), x)), digits)


def share(matched: Column, required: Column) -> Column:
    """Matched of required in percent; nothing required gives 100."""
    return F.when(required == 0, F.lit(100.0)).otherwise(F.round(matched * 100 / required, 2))


def weighted_total(scores: dict[str, Column], applies: dict[str, Column]) -> Column:
    """Sum of scores by weight, weights renormalised over the categories that apply."""
    total = sum((F.when(applies[k], F.lit(w)).otherwise(0.0) for k, w in WEIGHTS.items() if k in scores), F.lit(0.0))
    part = sum((F.when(applies[k], F.lit(w) * scores[k]).otherwise(0.0) for k, w in WEIGHTS.items() if k in scores), F.lit(0.0))
    return F.when(total == 0, F.lit(0.0)).otherwise(part / total)


def bonus(n_preferred: Column) -> Column:
    return F.least(F.lit(BONUS_CAP), n_preferred * BONUS_EACH)


def recommendation(scores: dict[str, Column], knocked_out: Column) -> Column:
    """SHORTLIST: a core score of 50 and evidence elsewhere; REVIEW: a core score of 25, or skills and another at 20; else REJECT."""
    core = [scores[c] for c in CORE]
    triggered = core[0] >= SHORTLIST_AT
    for c in core[1:]:
        triggered = triggered | (c >= SHORTLIST_AT)
    other = scores.get("preferred_skills", F.lit(0.0)) > 0
    other = other | (scores.get("certifications", F.lit(0.0)) > 0)
    for c in core:
        other = other | ((c > 0) & (c < SHORTLIST_AT))
    partial = core[0] >= REVIEW_AT
    for c in core[1:]:
        partial = partial | (c >= REVIEW_AT)
    partial = partial | ((core[0] >= WEAK_AT) & ((core[1] >= WEAK_AT) | (core[2] >= WEAK_AT)))
    return F.when(knocked_out, "REJECT").when(triggered & other, "SHORTLIST").when(partial, "REVIEW").otherwise("REJECT")


def profile_confidence(fields: list[Column]) -> Column:
    """Filled fields in percent of all."""
    return F.round(sum((present(c).cast("int") for c in fields), F.lit(0)) * 100 / len(fields), 2)


def field_confidence(items: Column) -> Column:
    """min(0.99, 0.85 + 0.03 n) of a list; an empty one 0."""
    n = F.size(items)
    return F.when(n > 0, F.least(F.lit(0.99), F.round(F.lit(0.85) + n * 0.03, 2))).otherwise(0.0)


def rescale_fraction(v: Column) -> Column:
    """Scores given as fractions become percent: 0 < v <= 1 counts hundredfold."""
    return F.when((v > 0) & (v <= 1), F.round(v * 100, 1)).otherwise(F.round(v, 1))


DEGREES = (("phd", 5), ("doctorate", 5), ("master", 4), ("mba", 4), ("bachelor", 3), ("diploma", 2), ("certificate", 1))


def degree_rank(c: Column) -> Column:
    """0 to 5 by whole words; the highest level named wins."""
    expr = F.lit(0)
    for word, level in reversed(DEGREES):
        expr = F.when(F.regexp_like(F.lower(c), F.lit(rf"(^|[^a-z]){word}s?([^a-z]|$)")), level).otherwise(expr)
    return expr


def token_estimate(text: Column, output: Column) -> Column:
    return F.ceil(F.length(text) / 2.8 * 1.15 + 20 + output + 200).cast("long")


def responsibility_verdict(hits: Column, total: Column) -> Column:
    """struct<status, coverage>: at least two hits, or the only concept, match; one of several is partial; none stays open."""
    coverage = F.when(total == 0, 0.0).otherwise(F.round(hits / total, 2))
    status = F.when(total == 0, "UNRESOLVED").when((total == 1) & (hits == 1), "MATCHED").when(hits >= 2, "MATCHED").when(hits == 1, "PARTIALLY_MATCHED").otherwise("UNRESOLVED")
    return F.struct(status.alias("status"), coverage.alias("coverage"))
