"""Requirements of a job and evidence of a candidate as long tables, and the verdicts that need no judge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ranksmith.functions import concepts as C
from ranksmith.functions import dates as D
from ranksmith.functions import text as X

#: Phrases that name a section or give an instruction rather than ask for something.
HEADERS = ("requirements", "qualifications", "required skills", "preferred skills", "responsibilities", "key responsibilities", "nice to have", "note", "notes")
#: Words of character rather than of skill.
SOFT = ("communication", "teamwork", "leadership", "ownership", "motivated", "adaptable", "collaboration", "attitude")
NO_SKILL = ("and", "or", "the", "with", "years", "year", "experience", "etc", "good", "strong")
DEPARTMENTS = {"engineering": "ENG", "eng": "ENG", "human resources": "HR", "hr": "HR", "finance": "FIN", "sales": "SAL", "marketing": "MKT", "operations": "OPS", "legal": "LEG", "support": "SUP"}


def is_header(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\s*:$", "").isin(*HEADERS)


def is_soft(c: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(w)) for w in SOFT])


def valid_skill(c: Column) -> Column:
    """Two to fifty characters, at most five words, a letter in it, no filler word alone, no duration."""
    t = F.lower(F.trim(c))
    return F.coalesce(F.length(t).between(2, 50) & (F.size(F.split(t, r"\s+")) <= 5) & F.regexp_like(t, F.lit("[a-z]")) & ~t.isin(*NO_SKILL) & ~F.regexp_like(t, F.lit(r"[0-9]+\+?\s*(years?|yrs?|months?)")), F.lit(False))


def build_requirements(jobs: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(key, requirement_id, kind, text): items of array columns by kind, without headers, soft ones apart, each (kind, text) once.

    fields: column -> kind, in order.
    """
    parts = []
    for order, (column, kind) in enumerate(fields.items()):
        item = jobs.select(key, F.posexplode(column).alias("_pos", "text")).withColumn("kind", F.lit(kind)).withColumn("_field", F.lit(order))
        parts.append(item)
    every = reduce(DataFrame.unionByName, parts)
    kept = every.where(X.present(F.col("text")) & ~is_header(F.col("text"))).withColumn("kind", F.when(is_soft(F.col("text")), "candidate_attribute").otherwise(F.col("kind")))
    kept = kept.withColumn("_k", X.comparison_key(F.col("text")))
    first = kept.groupBy(key, "kind", "_k").agg(F.min(F.struct("_field", "_pos", "text")).alias("_f"))
    n = F.row_number().over(W.partitionBy(key, "kind").orderBy("_f._field", "_f._pos"))
    return first.select(key, F.concat_ws(":", "kind", n.cast("string")).alias("requirement_id"), "kind", F.col("_f.text").alias("text"))


def build_evidence(profiles: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(key, evidence_id, kind, text) of string and array-of-string columns, ids numbered within each kind."""
    kinds = dict(profiles.dtypes)
    parts = []
    for column, kind in fields.items():
        items = F.col(column) if kinds[column].startswith("array") else F.array(column)
        parts.append(profiles.select(key, F.posexplode(items).alias("_pos", "text")).select(key, "_pos", F.lit(kind).alias("kind"), "text"))
    every = reduce(DataFrame.unionByName, parts).where(X.present(F.col("text")))
    n = F.row_number().over(W.partitionBy(key, "kind").orderBy("_pos"))
    return every.select(key, F.concat_ws(":", "kind", n.cast("string")).alias("evidence_id"), "kind", "text")


def experience_verdict(requirement: Column, total_months: Column) -> Column:
    """MATCHED when the months reach the requirement's minimum; a requirement without a number stays open."""
    need = D.parse_experience(requirement)["minimum_months"]
    return F.when(need.isNull(), "UNRESOLVED").when(total_months >= need, "MATCHED").otherwise("NO_MATCH")


def degree_verdict(need_level: Column, need_field: Column, level: Column, field: Column) -> Column:
    """struct<status, confidence>: level and field 1.0, the level alone 0.85."""
    same = F.lower(need_field) == F.lower(field)
    ok = level >= need_level
    status = F.when(ok, "MATCHED").otherwise("NO_MATCH")
    return F.struct(status.alias("status"), F.when(ok & (same | need_field.isNull()), 1.0).when(ok, 0.85).otherwise(0.0).alias("confidence"))


def evidence_reference(c: Column) -> Column:
    """``Experience #1``, ``experience 1`` and ``experience:1`` name the same evidence."""
    kind = F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]+)", 1)
    number = F.regexp_extract(c, r"([0-9]+)\s*$", 1)
    return F.when((kind != "") & (number != ""), F.concat(kind, F.lit(":"), F.regexp_replace(number, "^0+(?=[0-9])", "")))


def supplied_reference(c: Column, ids: Column) -> Column:
    """The one of the supplied ids that a reference means, or null: itself, itself but for case, with any separators, or by a number that only one id ends in."""
    clean = F.trim(c)
    form = F.regexp_replace(F.regexp_replace(F.lower(clean), r"[\s_#-]+", ":"), ":+", ":")
    first = lambda test: F.try_element_at(F.filter(ids, test), F.lit(1))
    ending = F.filter(ids, lambda i: F.endswith(i, F.concat(F.lit(":"), clean)))
    number = F.when(F.regexp_like(clean, F.lit("^[0-9]+$")) & (F.size(ending) == 1), F.try_element_at(ending, F.lit(1)))
    return F.coalesce(first(lambda i: i == clean), first(lambda i: F.lower(i) == F.lower(clean)), first(lambda i: F.lower(i) == form), number)


#: Words from this length on are compared by their trigrams.
LONG_WORD, WORD_JACCARD, SYNONYM_SCORE = 5, 0.35, 0.65


def fallback_similarity(query: Column, text: Column, synonyms: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Share of the query's stems in a text; where there is none, 0.65 if the text holds a synonym (of over two letters) of a term that shares a stem
    with the query, else the trigram Jaccard of the first pair of long words that reaches 0.35; else 0."""
    q, t = X.stems(query), X.stems(text)
    overlap = F.size(F.array_intersect(q, t)) / F.size(q)
    said = C.padded(text)
    by_synonym = F.lit(False)
    for term, others in (synonyms or {}).items():
        stems = F.array_distinct(F.flatten(F.transform(F.array(*map(F.lit, (term, *others))), X.stems)))
        named = F.exists(F.array(*[F.lit(o) for o in others if len(o) > 2]), lambda o: F.contains(said, F.concat(F.lit(" "), o, F.lit(" "))))
        by_synonym = by_synonym | (F.coalesce(F.arrays_overlap(q, stems), F.lit(False)) & named)
    long_words = lambda c: F.filter(X.tokens(c), lambda w: F.length(w) >= LONG_WORD)
    pairs = F.flatten(F.transform(long_words(query), lambda a: F.transform(long_words(text), lambda b: X.jaccard(X.ngrams(a), X.ngrams(b)))))
    best = F.coalesce(F.try_element_at(F.filter(pairs, lambda j: j >= WORD_JACCARD), F.lit(1)), F.lit(0.0))
    value = F.when((F.size(q) == 0) | (F.size(t) == 0), 0.0).when(overlap > 0, overlap).when(by_synonym, SYNONYM_SCORE).otherwise(best)
    return F.round(value, 3)


def retrieve(pairs: DataFrame, on: list[str], query: str, text: str, ev_id: str = "evidence_id", most: int = 5, synonyms: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The best ``most`` evidence rows for each query by fallback similarity, those over 0.05 only."""
    scored = pairs.withColumn("similarity", fallback_similarity(F.col(query), F.col(text), synonyms)).where("similarity > 0.05")
    rank = F.row_number().over(W.partitionBy(*on).orderBy(F.col("similarity").desc(), ev_id))
    return scored.withColumn("pick", rank).where(F.col("pick") <= most)


def knocked_out(rules: DataFrame, skills: DataFrame, months: DataFrame, key: str) -> DataFrame:
    """(key, reason) of candidates that break a rule.

    rules: kind ('skill' or 'experience'), value; skills: key, skill; months: key, months.  Rules are a short list.
    """
    need = rules.where("kind = 'skill'").select(F.lower("value").alias("skill")).distinct()
    n = need.agg(F.count("*").alias("n_need"))
    have = skills.select(key, F.lower("skill").alias("skill")).distinct().join(need, "skill", "left_semi").groupBy(key).agg(F.count("*").alias("n_have"))
    least = rules.where("kind = 'experience'").agg(F.max(F.expr("try_cast(value AS int)")).alias("least"))
    out = months.join(have, key, "left").join(F.broadcast(n)).join(F.broadcast(least))  # two single rows
    reason = F.when(F.coalesce("n_have", F.lit(0)) < F.col("n_need"), "missing mandatory skill").when(F.col("months") < F.col("least"), "insufficient experience")
    return out.select(key, reason.alias("reason")).where(F.col("reason").isNotNull())


def department_code(c: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for kv in DEPARTMENTS.items() for x in kv])
    return F.try_element_at(lookup, X.comparison_key(c))


def one_column(c: Column) -> Column:
    """Two-column text as one column: where a quarter of over four lines hold a wide gap, left halves come before right ones."""
    lines = F.split(c, "\n")
    gap = r"\s{3,}| \| "
    halves = F.transform(lines, lambda x: F.split(F.trim(x), gap, 2))
    both = F.size(F.filter(halves, lambda h: F.size(h) == 2))
    left = F.transform(halves, lambda h: F.trim(h[0]))
    right = F.filter(F.transform(halves, lambda h: F.trim(F.coalesce(F.get(h, F.lit(1)), F.lit("")))), lambda x: x != "")
    split = (F.size(lines) > 4) & (both >= 0.25 * F.size(lines))
    return F.when(split, F.array_join(F.concat(left, right), "\n")).otherwise(c)
