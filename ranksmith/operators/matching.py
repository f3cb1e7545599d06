"""Requirements against evidence, in long form: one row for each pair that kind and words allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ranksmith.functions import arrays as A
from ranksmith.functions import concepts as C
from ranksmith.functions import text as X

from . import normalise as N
from . import requirements as Q
from .ranking import diversify

#: Kinds of evidence that may answer a kind of requirement.
EVIDENCE_KINDS = {
    "degree": ("education",),
    "experience": ("experience",),
    "contextual_experience": ("experience",),
    "skill": ("skills", "experience", "project", "summary"),
    "required_skill": ("skills", "experience", "project", "summary"),
    "preferred_skill": ("skills", "experience", "project", "summary"),
    "responsibility": ("experience", "project", "summary"),
    "project_relevance": ("project", "experience", "summary"),
    "certification": ("certification",),
    "language": ("languages",),
    "candidate_attribute": ("skills", "experience", "project", "summary"),
}
THRESHOLD, LIMIT = 0.15, 5
MIN_CONFIDENCE = 0.80


def allowed_kinds(kind: Column) -> Column:
    lookup = F.create_map(*[x for k, v in EVIDENCE_KINDS.items() for x in (F.lit(k), F.array(*[F.lit(e) for e in v]))])
    return F.try_element_at(lookup, kind)


def numbered(items: DataFrame, owner: str, kind: str, position: str, out: str) -> DataFrame:
    """Ids ``kind:n``, n counting from 1 in each owner and kind."""
    n = F.row_number().over(W.partitionBy(owner, kind).orderBy(position))
    return items.withColumn(out, F.concat_ws(":", F.col(kind), n.cast("string")))


def synonym_phrases(text: Column, synonyms: dict[str, tuple[str, ...]]) -> Column:
    """Each term that a text holds, whole or by one of its words of over two letters, with its synonyms."""
    low = F.lower(text)
    found = []
    for term, others in synonyms.items():
        hit = F.contains(low, F.lit(term))
        for word in term.split():
            if len(word) > 2:
                hit = hit | F.contains(C.padded(text), F.lit(f" {word} "))
        found.append(F.when(hit, F.array(*map(F.lit, (term, *others)))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*found)) if found else F.array().cast("array<string>")


def stem_overlap(requirements: DataFrame, evidence: DataFrame, on: list[str], req_id: str = "requirement_id", ev_id: str = "evidence_id", synonyms: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(on, req_id, ev_id, kind, overlap): shared stems over the requirement's stems, for pairs of allowed kinds with some.

    A requirement's stems include those of its synonyms, and evidence that holds one of their phrases of several words gets
    one half more.  Both lists of a document are short and meet once, as arrays of stems, so no words are shuffled.
    """
    phrases = synonym_phrases(F.col("text"), synonyms or {})
    stems = F.array_distinct(F.concat(X.stems(F.col("text")), F.flatten(F.transform("r_phrases", X.stems))))
    r = requirements.select(*on, req_id, F.col("kind").alias("r_kind"), "text", phrases.alias("r_phrases"))
    r = r.select(*on, req_id, "r_kind", F.filter("r_phrases", lambda p: F.contains(p, F.lit(" "))).alias("r_phrases"), stems.alias("r_stems"))
    e = evidence.select(*on, ev_id, F.col("kind").alias("e_kind"), F.lower("text").alias("e_text"), X.stems(F.col("text")).alias("e_stems"))
    pair = r.join(e, on).where(F.array_contains(allowed_kinds(F.col("r_kind")), F.col("e_kind")))
    bonus = F.when(F.exists("r_phrases", lambda p: F.contains("e_text", p)), 0.5).otherwise(0.0)
    scored = pair.withColumn("shared", F.size(F.array_intersect("r_stems", "e_stems"))).where("shared > 0")
    return scored.select(*on, req_id, ev_id, F.col("e_kind").alias("kind"), F.round(F.col("shared") / F.size("r_stems") + bonus, 4).alias("overlap"))


def select_evidence(scored: DataFrame, on: list[str], req_id: str = "requirement_id", ev_id: str = "evidence_id", threshold: float = THRESHOLD, limit: int = LIMIT) -> DataFrame:
    """Rows at or over the threshold (all, if none is), cut to a number that falls as the best score rises, diverse in kind."""
    w = W.partitionBy(*on, req_id)
    best = F.max("overlap").over(w)
    seen = scored.withColumn("_best", best).where((F.col("_best") < threshold) | (F.col("overlap") >= threshold))
    k = F.when(F.col("_best") >= 0.60, min(3, limit)).when(F.col("_best") >= 0.15, min(5, limit)).otherwise(min(8, max(5, limit)))
    return diversify(seen.withColumn("_k", k), [*on, req_id], "kind", [F.col("overlap").desc(), F.col(ev_id)], F.col("_k")).drop("_best", "_k")


def validate_verdicts(verdicts: DataFrame, supplied: DataFrame, on: list[str]) -> DataFrame:
    """Judged verdicts as the cited evidence bears them out.

    verdicts: on, status, confidence, evidence_ids and, if kinds are to be checked, kind; supplied: on, evidence_id, kind.  Cited ids are
    looked up among the supplied ones, however they are written, and count if their kind may answer the requirement's.
    A verdict that cites nothing stands on the only evidence supplied.  Matched and partial verdicts need such evidence
    and enough confidence, else they are UNRESOLVED; rejections stand.  Partial ones cover one half.
    """
    checked = "kind" in verdicts.columns and "kind" in supplied.columns
    item = F.struct(F.col("evidence_id").alias("id"), (F.col("kind") if checked else F.lit(None).cast("string")).alias("kind"))
    held = supplied.groupBy(*on).agg(F.collect_set(item).alias("_held"))
    joined = verdicts.join(held, on, "left").withColumn("_held", F.coalesce("_held", F.array().cast("array<struct<id:string,kind:string>>")))
    joined = joined.withColumn("_ids", F.transform("_held", lambda h: h["id"]))
    raw = F.coalesce("evidence_ids", F.array().cast("array<string>"))
    found = F.filter(F.transform(raw, lambda x: Q.supplied_reference(x, F.col("_ids"))), lambda x: x.isNotNull())
    cited = F.when((F.size(raw) == 0) & (F.size("_ids") == 1), F.col("_ids")).otherwise(F.array_distinct(found))
    if checked:
        fits = lambda x: F.exists("_held", lambda h: (h["id"] == x) & F.array_contains(allowed_kinds(F.col("kind")), h["kind"]))
        cited = F.filter(cited, lambda x: F.coalesce(fits(x), F.lit(False)))
    joined = joined.withColumn("_cited", F.sort_array(cited))
    said = F.upper("status")
    partial, matched = said.isin("PARTIALLY_MATCHED", "PARTIAL"), said.isin("MATCHED", "MATCH")
    sure = (matched | partial) & (F.col("confidence") >= MIN_CONFIDENCE) & (F.size("_cited") > 0)
    status = F.when(sure & partial, "PARTIALLY_MATCHED").when(sure, "MATCHED").when(said.isin("NO_MATCH", "UNMATCHED", "REJECTED"), "NO_MATCH").otherwise("UNRESOLVED")
    out = joined.withColumn("evidence_ids", F.when(sure, F.col("_cited")).otherwise(F.array().cast("array<string>"))).withColumn("status", status)
    coverage = F.when(F.col("status") == "MATCHED", 1.0).when(F.col("status") == "PARTIALLY_MATCHED", 0.5).otherwise(0.0)
    return out.withColumn("coverage", coverage).drop("_held", "_ids", "_cited")


def fuse(deterministic: DataFrame, judged: DataFrame, on: list[str]) -> DataFrame:
    """Judged verdicts where the deterministic one is not MATCHED and a judged one exists."""
    j = judged.select(*on, F.struct("status", "coverage").alias("_j"))
    joined = deterministic.join(j, on, "left")
    use = (F.col("status") != "MATCHED") & F.col("_j").isNotNull()
    return joined.select(
        *on,
        F.when(use, F.col("_j.status")).otherwise(F.col("status")).alias("status"),
        F.when(use, F.col("_j.coverage")).otherwise(F.col("coverage")).alias("coverage"),
        F.when(use, "llm").otherwise("deterministic").alias("method"),
    )


def skill_groups(requirements: DataFrame, skills: DataFrame, on: list[str], req_id: str = "requirement_id") -> DataFrame:
    """AND groups need every part, OR groups any part: (on, req_id, is_or, satisfied)."""
    is_or = F.regexp_like(F.lower("text"), F.lit(r"\bor\b|/"))
    parts = requirements.select(*on, req_id, is_or.alias("is_or"), F.explode(F.array_distinct(F.transform(X.split_requirement(F.col("text")), F.lower))).alias("part"))
    have = skills.select(*on, F.lower("skill").alias("part"), F.lit(True).alias("_has")).distinct()
    joined = parts.join(have, [*on, "part"], "left").withColumn("_has", F.coalesce("_has", F.lit(False)))
    return joined.groupBy(*on, req_id, "is_or").agg(F.bool_or("_has").alias("_any"), F.bool_and("_has").alias("_all")).select(*on, req_id, "is_or", F.when(F.col("is_or"), F.col("_any")).otherwise(F.col("_all")).alias("satisfied"))


def skill_match(term: Column, skills: Column, evidence: Column, known: C.Dictionaries) -> Column:
    """struct<skill, method, evidence_id> of the first way in which a candidate shows a skill, or null.

    Ways, in order: a member of the category that the term names; the term itself (EXACT); another spelling with the same canonical
    name (ALIAS); all its words near each other in some text (ALIAS).  ``evidence`` is array<struct<evidence_id, kind, text>>; the id is
    that of the first one that names the skill.
    """
    key = lambda c: F.lower(X.clean_spaces(c))
    name = lambda c: F.coalesce(F.try_element_at(known.aliases, key(c)), key(c))
    texts = F.transform(evidence, lambda e: e["text"])
    members = F.try_element_at(known.categories, key(term))

    def shown(skill: Column, method: str) -> Column:
        at = F.try_element_at(F.filter(evidence, lambda e: F.contains(F.lower(e["text"]), F.lower(skill))), F.lit(1))
        return F.when(skill.isNotNull(), F.struct(skill.alias("skill"), F.lit(method).alias("method"), at["evidence_id"].alias("evidence_id")))

    first = lambda test: F.try_element_at(F.filter(skills, test), F.lit(1))
    mentioned = F.try_element_at(F.filter(members, lambda m: (F.length(m) >= 3) & F.exists(texts, lambda t: F.contains(C.padded(t), F.concat(F.lit(" "), m, F.lit(" "))))), F.lit(1))
    stems = F.transform(texts, lambda t: F.transform(X.tokens(t), X.stem))
    wanted = C.concept_stems(term)
    near = F.try_element_at(F.filter(evidence, lambda e: F.arrays_overlap(F.transform(X.tokens(e["text"]), X.stem), wanted)), F.lit(1))
    return F.coalesce(
        shown(first(lambda s: F.coalesce(F.array_contains(members, name(s)), F.lit(False))), "ALIAS"),
        shown(mentioned, "ALIAS"),
        shown(first(lambda s: key(s) == key(term)), "EXACT"),
        shown(first(lambda s: name(s) == name(term)), "ALIAS"),
        F.when(C.multiword_match(term, stems), F.struct(term.alias("skill"), F.lit("ALIAS").alias("method"), near["evidence_id"].alias("evidence_id"))),
    )


#: Parts of 'A and B' that say nothing of their own, and so need not be shown beside others.
GENERIC_PARTS = (
    "database concepts", "database", "debugging", "concepts", "fundamentals", "basics", "principles", "json", "problem-solving ability", "teamwork", "soft skills",
    "other columnar data formats", "other data formats", "columnar data formats", "columnar formats", "other tools", "other frameworks", "other technologies",
    "other databases", "similar tools", "similar technologies", "other related technologies",
)
#: Texts that a verdict on a group cites, at most.
CITED = 2


def group_verdict(requirement: Column, skills: Column, evidence: Column, known: C.Dictionaries) -> Column:
    """struct<status, method, skills, evidence_ids> of a skill requirement, which may be a group.

    A text is tried with and without the phrase that asks.  Shown as a whole, a requirement is MATCHED by that way.  Else 'A and B' needs its
    first part and each further one that is not generic (EXACT, at most two texts cited), and any other form needs one of its options.  All else, null
    included, is NO_MATCH.  ``skills`` and ``evidence`` are those of ``skill_match``.
    """
    every, parts, options = C.group_parts(X.strip_filler(requirement))
    forms = F.concat(F.array(requirement), F.when(every, parts).otherwise(options))
    variants = F.transform(forms, lambda x: F.array(x, X.strip_filler(x)))
    hit = lambda v: A.first_where(F.transform(v, lambda x: skill_match(x, skills, evidence, known)), lambda h: h.isNotNull())
    tried = F.transform(variants, lambda v: F.struct(hit(v).alias("hit"), F.exists(v, lambda x: F.lower(x).isin(*GENERIC_PARTS)).alias("generic")))
    none = F.array().cast("array<string>")

    def judged(t: Column) -> Column:
        hits = lambda a: F.filter(F.transform(a, lambda x: x["hit"]), lambda h: h.isNotNull())
        rest = F.slice(t["tried"], 2, F.greatest(F.size(t["tried"]) - 1, F.lit(0)))
        complete = F.get(rest, F.lit(0))["hit"].isNotNull() & F.forall(rest, lambda x: x["hit"].isNotNull() | x["generic"])
        whole, others = hits(F.slice(t["tried"], 1, 1)), F.when(t["every"], F.when(complete, hits(rest))).otherwise(F.slice(hits(rest), 1, 1))
        found = F.coalesce(F.when(F.size(whole) > 0, whole), others, whole)
        method = F.when((F.size(whole) == 0) & t["every"], "EXACT").otherwise(F.get(found, F.lit(0))["method"])
        ids = F.array_distinct(F.filter(F.transform(found, lambda h: h["evidence_id"]), lambda i: i.isNotNull()))
        return F.struct(F.when(F.size(found) > 0, "MATCHED").otherwise("NO_MATCH").alias("status"), F.when(F.size(found) > 0, method).alias("method"), F.transform(found, lambda h: h["skill"]).alias("skills"), F.slice(ids, 1, CITED).alias("evidence_ids"))

    # the forms are tried once, however much is told from them
    told = N.once(F.struct(every.alias("every"), tried.alias("tried")), judged)
    return F.when(requirement.isNull(), F.struct(F.lit("NO_MATCH").alias("status"), F.lit(None).cast("string").alias("method"), none.alias("skills"), none.alias("evidence_ids"))).otherwise(told)


def project_relevance(requirement: Column, projects: Column) -> Column:
    """MATCHED if a project's name and description hold the requirement, word for word or as words near each other; else UNRESOLVED.

    ``projects``: array<struct<name, description>>.
    """
    said = F.transform(F.coalesce(projects, F.array()), lambda p: F.lower(F.concat_ws(" ", p["name"], p["description"])))
    stems = F.transform(said, lambda t: F.transform(X.tokens(t), X.stem))
    hit = F.exists(said, lambda t: F.contains(t, F.lower(requirement))) | C.multiword_match(requirement, stems)
    return F.when(hit, "MATCHED").otherwise("UNRESOLVED")


#: Words of a requirement that name an attitude, and what shows it.
LEARNING = (("learn", "adapt", "train", "willingness"), ("quick learner", "eager to learn", "adaptable", "learned", "fast learner", "passionate about learning"))
TALKING = (("communication", "teamwork", "collaboration", "interpersonal"), ("communication", "teamwork", "collaboration", "collaborated", "cross-functional", "presented", "partnered"))
ANALYSIS = ("analytical", "problem-solving", "problem solving", "critical thinking")


def soft_verdict(requirement: Column, text: Column, n_skills: Column, n_jobs: Column, n_projects: Column) -> Column:
    """struct<status, confidence> of a requirement of character against all that a candidate says.

    Learning is shown by its words, or by three skills, a job or a project; talking by its words; analysis by three skills or a project;
    anything else by one of its words of over three letters.  What is not shown stays open.
    """
    ask, said = F.lower(requirement), F.lower(F.coalesce(text, F.lit("")))
    some = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))
    own = F.exists(F.filter(F.split(ask, r"\s+"), lambda w: F.length(w) > 3), lambda w: F.contains(said, w))
    ok = (
        F.when(some(ask, LEARNING[0]), some(said, LEARNING[1]) | (n_skills >= 3) | (n_jobs > 0) | (n_projects > 0))
        .when(some(ask, TALKING[0]), some(said, TALKING[1]))
        .when(some(ask, ANALYSIS), (n_skills >= 3) | (n_projects > 0))
        .otherwise(own)
    )
    return F.struct(F.when(ok, "MATCHED").otherwise("UNRESOLVED").alias("status"), F.when(ok, 1.0).otherwise(0.5).alias("confidence"))


def canonical_verdict(requirement: Column, held: Column, aliases: Column) -> Column:
    """struct<status, method> of a certificate or language: MATCHED if one that is held has the same canonical name; ALIAS where either was spelt otherwise."""
    key = lambda c: F.lower(X.clean_spaces(c))
    name = lambda c: F.coalesce(F.try_element_at(aliases, key(c)), key(c))
    hit = F.try_element_at(F.filter(F.coalesce(held, F.array().cast("array<string>")), lambda h: name(h) == name(requirement)), F.lit(1))
    alias = F.try_element_at(aliases, key(requirement)).isNotNull() | F.try_element_at(aliases, key(hit)).isNotNull()
    return F.struct(F.when(hit.isNotNull(), "MATCHED").otherwise("NO_MATCH").alias("status"), F.when(hit.isNotNull(), F.when(alias, "ALIAS").otherwise("EXACT")).alias("method"))


def route(verdicts: DataFrame, selected: DataFrame, on: list[str]) -> DataFrame:
    """(on, status, submit, n_evidence): matched verdicts stop; others go to the judge with their selected evidence, or are NO_MATCH without any."""
    counts = selected.groupBy(*on).agg(F.count("*").alias("n_evidence"))
    joined = verdicts.join(counts, on, "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))
    done = F.col("status") == "MATCHED"
    status = F.when(~done & (F.col("n_evidence") == 0), "NO_MATCH").otherwise(F.col("status"))
    return joined.select(*on, status.alias("status"), (~done & (F.col("n_evidence") > 0)).alias("submit"), F.when(done, 0).otherwise(F.col("n_evidence")).alias("n_evidence"))


#: Kinds of requirement whose verdict falls with its evidence.
NEEDS_PROOF = ("degree", "experience", "contextual_experience", "certification", "language")


def revalidate(verdicts: DataFrame, requirements: DataFrame, evidence: DataFrame, on: list[str], req_id: str = "requirement_id") -> DataFrame:
    """Fused verdicts (on, req_id, status, evidence_ids) with text and kind of their requirement and the cited ids that hold.

    requirements: on, req_id, kind, text (one row each); evidence: on, evidence_id, kind.  An id holds if it is there with a kind that may
    answer the requirement's.  A match of a kind in ``NEEDS_PROOF`` without such an id is UNRESOLVED.  Verdicts on no known requirement stay as
    they are, with null text and kind; null lists of ids are empty.
    """
    asked = requirements.select(*on, req_id, F.col("kind").alias("_kind"), F.col("text").alias("_text"))
    held = evidence.groupBy(*on).agg(F.collect_set(F.struct(F.col("evidence_id").alias("id"), F.col("kind").alias("kind"))).alias("_held"))
    joined = verdicts.join(asked, [*on, req_id], "left").join(held, on, "left")
    cited = F.coalesce("evidence_ids", F.array().cast("array<string>"))
    holds = lambda i: F.coalesce(F.exists("_held", lambda h: (h["id"] == i) & F.array_contains(allowed_kinds(F.col("_kind")), h["kind"])), F.lit(False))
    joined = joined.withColumn("evidence_ids", F.when(F.col("_kind").isNull(), cited).otherwise(F.filter(cited, holds)))
    fallen = F.col("status").isin("MATCHED", "PARTIALLY_MATCHED") & (F.size("evidence_ids") == 0) & F.col("_kind").isin(*NEEDS_PROOF)
    return joined.withColumn("status", F.when(fallen, "UNRESOLVED").otherwise(F.col("status"))).withColumnsRenamed({"_kind": "kind", "_text": "text"}).drop("_held")


def proven_technologies(projects: DataFrame, verdicts: DataFrame, on: list[str], req_id: str = "requirement_id") -> DataFrame:
    """``projects`` (on, evidence_id, technologies) with the texts of the project requirements that they prove.

    verdicts as ``revalidate`` returns them.  A matched requirement of kind project_relevance adds its text to each project that it cites,
    unless one of its technologies has that name, case and blanks aside; texts come in order of req_id.  Null lists are empty.
    """
    matched = verdicts.where((F.col("status") == "MATCHED") & (F.col("kind") == "project_relevance") & X.present(F.col("text")))
    cited = matched.select(*on, req_id, "text", F.explode(F.array_distinct("evidence_ids")).alias("evidence_id")).where(F.startswith("evidence_id", F.lit("project:")))
    proven = cited.groupBy(*on, "evidence_id").agg(F.array_sort(F.collect_set(F.struct(req_id, "text"))).alias("_proven"))
    none = F.array().cast("array<string>")
    joined = projects.join(proven, [*on, "evidence_id"], "left").withColumn("technologies", F.coalesce("technologies", none))
    fresh = F.filter(F.transform(F.coalesce("_proven", F.array().cast(proven.schema["_proven"].dataType)), lambda p: p["text"]), lambda t: ~F.exists("technologies", lambda x: X.comparison_key(x) == X.comparison_key(t)))
    return joined.withColumn("technologies", F.concat("technologies", A.ordered_distinct(fresh))).drop("_proven")
