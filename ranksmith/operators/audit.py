"""Normal forms that carry their audit: values, changes, warnings, confidences and counts come from one pass over a row's lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranksmith.functions import arrays as A
from ranksmith.functions import dates as D
from ranksmith.functions import text as X

from . import jobs as J
from . import normalise as N
from . import requirements as Q

#: Canonical titles, languages and certificates by their other spellings.
TITLES = {
    "software engineer": "Software Engineer", "c++ developer": "Software Engineer", "software developer": "Software Engineer", "sr. backend dev": "Senior Backend Engineer", "sr backend dev": "Senior Backend Engineer",
    "backend developer": "Backend Engineer", "python developer": "Python Developer", "full stack developer": "Full Stack Engineer", "frontend developer": "Frontend Engineer", "sde": "Software Engineer",
    "sde-1": "Software Engineer", "sde-2": "Software Engineer", "senior software engineer": "Senior Software Engineer", "lead engineer": "Lead Engineer", "tech lead": "Tech Lead", "technical lead": "Tech Lead",
    "intern": "Software Engineer Intern", "database intern": "Database Management Intern", "devops engineer": "DevOps Engineer", "data engineer": "Data Engineer", "data scientist": "Data Scientist",
}
LANGUAGES = {
    "eng": "English", "english": "English", "hin": "Hindi", "hindi": "Hindi", "spa": "Spanish", "spanish": "Spanish", "fre": "French", "french": "French", "deu": "German", "german": "German",
    "tam": "Tamil", "tamil": "Tamil", "tel": "Telugu", "telugu": "Telugu", "kan": "Kannada", "kannada": "Kannada", "mal": "Malayalam", "malayalam": "Malayalam", "mar": "Marathi", "marathi": "Marathi",
}
CERTIFICATES = {
    "aws solutions architect": "AWS Certified Solutions Architect", "aws certified solutions architect": "AWS Certified Solutions Architect", "pmp": "Project Management Professional (PMP)",
    "project management professional": "Project Management Professional (PMP)", "certified kubernetes administrator": "Certified Kubernetes Administrator (CKA)", "cka": "Certified Kubernetes Administrator (CKA)",
}
#: Fields whose unknown values are no matter for a warning, and rules that count as an alias resolved.
QUIET = ("companies", "phone", "certifications", "locations", "email", "skills", "job_titles", "keywords")
RESOLVING = ("exact_canonical", "email_lowercase", "e164_format", "company_legal_suffix", "date_format")
#: Fixed value: the rule of what is read as numbers, which is told even where the text stays; and the warning where nothing was read.
PARSED = "experience_parse"
NO_EXPERIENCE = "No experience requirements found in extracted data."


def record(field: str, source: Column, canonical: Column, rule: Column, confidence: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), source.alias("source"), canonical.alias("canonical"), rule.alias("rule"), confidence.cast("double").alias("confidence"))


def coded(items: Column, aliases: dict[str, str], field: str) -> Column:
    """array<record> of a list's values that are neither null nor empty, looked up without the label before a colon."""
    bare = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: X.clean_spaces(F.regexp_replace(X.clean_spaces(x), r"^[A-Za-z ]+:\s*", ""))), X.present)
    known = lambda x: F.try_element_at(N.as_map(aliases), F.lower(x))
    rule = lambda x, k: F.when(k.isNull(), "preserved_unknown").when(k == x, "exact_canonical").otherwise(f"{field}_alias")
    return F.transform(bare, lambda x: N.once(known(x), lambda k: record(field, x, F.coalesce(k, x), rule(x, k), F.lit(1.0))))


def coded_company(items: Column) -> Column:
    """array<record> of companies with their legal form written out; what is no company leaves."""
    found = F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.struct(X.clean_spaces(x).alias("source"), N.company(x).alias("canonical")))
    rule = lambda x: F.when(x["source"] == x["canonical"], "preserved_unknown").otherwise("company_legal_suffix")
    return F.transform(F.filter(found, lambda x: x["canonical"].isNotNull()), lambda x: record("companies", x["source"], x["canonical"], rule(x), F.lit(1.0)))


def coded_date(items: Column, field: str) -> Column:
    """array<record> of dates: open ends have no date and 0.95, known forms 1 or, if rewritten, 0.9, other texts 0.5."""
    bare = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: X.clean_spaces(x)), X.present)
    iso = lambda d: F.regexp_like(d["date"], F.lit(r"^[0-9]{4}(-[0-9]{2}){0,2}$"))
    rule = lambda d: F.when(d["is_current"], "current_date").when(iso(d), "date_format").otherwise("preserved_unknown")
    trust = lambda x, d: F.when(d["is_current"], 0.95).when(iso(d) & (d["date"] == x), 1.0).when(iso(d), 0.9).otherwise(0.5)
    return F.transform(bare, lambda x: N.once(D.normalise_date(x), lambda d: record(field, x, d["date"], rule(d), trust(x, d))))


def coded_value(field: str, source: Column, canonical: Column, rule: str) -> Column:
    """array<record> of one value, none where it has no normal form."""
    one = record(field, X.clean_spaces(source), canonical, F.lit(rule), F.lit(1.0))
    return F.filter(F.array(one), lambda r: r["canonical"].isNotNull())


def normalised(rows: DataFrame, fields: dict[str, Column], out: str = "audit") -> DataFrame:
    """``rows`` with each field's values, each once, and ``out`` = struct<changes, warnings, field_confidence, aliases_resolved, duplicates_removed, fields_normalized>.

    ``fields`` maps a column's new name to its array<record>.  Records are made once and stay a column until all is told from them.
    Null lists have no records; an empty row has an empty audit.
    """
    names = {k: f"_{k}_records" for k in fields}
    made = rows.withColumns({names[k]: v for k, v in fields.items()})
    values = {k: A.ordered_distinct(F.filter(F.transform(n, lambda r: r["canonical"]), lambda x: x.isNotNull())) for k, n in names.items()}
    every = F.concat(*names.values())
    changes = F.filter(every, lambda r: ~r["source"].eqNullSafe(r["canonical"]) | F.startswith(r["rule"], F.lit(PARSED)))
    warned = F.filter(every, lambda r: (r["rule"] == "preserved_unknown") & ~r["field"].isin(*QUIET))
    warnings = A.ordered_distinct(F.transform(warned, lambda r: F.concat(F.lit("No canonical alias for "), r["field"], F.lit(": "), r["source"])))
    mean = lambda n: F.round(F.aggregate(n, F.lit(0.0), lambda s, r: s + r["confidence"]) / F.size(n), 2)
    trust = F.filter(F.array(*[F.when(F.size(n) > 0, F.struct(F.get(n, F.lit(0))["field"].alias("field"), mean(n).alias("confidence"))) for n in names.values()]), lambda x: x.isNotNull())
    resolved = F.size(F.filter(changes, lambda r: r["rule"].contains("alias") | r["rule"].isin(*RESOLVING)))
    told = made.withColumns({k: v for k, v in values.items()})
    doubles = sum((F.size(F.filter(names[k], lambda r: r["canonical"].isNotNull())) - F.size(k) for k in names), F.lit(0))
    audit = F.struct(changes.alias("changes"), warnings.alias("warnings"), trust.alias("field_confidence"), resolved.alias("aliases_resolved"), doubles.alias("duplicates_removed"), F.array_sort(F.transform(trust, lambda x: x["field"])).alias("fields_normalized"))
    return told.withColumn(out, audit).drop(*names.values())


def resume_fields(skills: dict[str, str] = N.SKILLS) -> dict[str, Column]:
    """Fields of an extracted resume (skills, titles, companies, languages, certifications, email, phone, years) as records."""
    c = F.col
    return {
        "skills": coded(c("skills"), skills, "skills"),
        "job_titles": coded(c("titles"), TITLES, "job_titles"),
        "companies": coded_company(c("companies")),
        "languages": coded(c("languages"), LANGUAGES, "languages"),
        "certifications": coded(c("certifications"), CERTIFICATES, "certifications"),
        "email": coded_value("email", c("email"), F.nullif(F.lower(X.clean_spaces(c("email"))), F.lit("")), "email_lowercase"),
        "phone": coded_value("phone", c("phone"), N.phone_e164(c("phone")), "e164_format"),
        "years": coded_date(c("years"), "education.graduation_date"),
    }


def _items(c: Column) -> Column:
    """Values that are neither null nor empty, with single blanks."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), X.clean_spaces), X.present)


def coded_skills(items: Column, dictionary: dict[str, str]) -> Column:
    """array<record> of the valid skills of a list, cleaned and by dictionary; groups stay whole."""
    valid = F.filter(_items(items), Q.valid_skill)
    return F.transform(valid, lambda x: N.once(J.canonical_skill(x, dictionary), lambda name: record("skills", x, name, F.when(name == x, "exact_canonical").otherwise("skill_canonical_map"), F.lit(1.0))))


def coded_degrees(items: Column) -> Column:
    """array<record> of the degrees that a list names, those between 'or', slashes and bars apart; what is only related to one is none."""
    parts = F.flatten(F.transform(_items(items), lambda x: F.split(x, r"(?i)\s+or\s+|\s+[/|]\s+")))
    named = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: (x != "") & ~F.regexp_like(x, F.lit(rf"(?i)^(?:an?\s+)?(?:similar|{X.one_of(N.DEGREE_TAIL)})\b")))
    found = F.transform(named, lambda x: F.struct(x.alias("source"), N.degree(x).alias("canonical")))
    rule = lambda x: F.when(x["source"] == x["canonical"], "degree_map:passthrough").otherwise(F.concat(F.lit("degree_map:"), F.get(F.split(x["canonical"], " in ", 2), F.lit(0))))
    return F.transform(F.filter(found, lambda x: F.length(x["canonical"]) > 2), lambda x: record("education", x["source"], x["canonical"], rule(x), F.lit(1.0)))


def coded_experience(items: Column) -> Column:
    """array<record> of phrases about years; the rule tells the least and greatest months, '-' for none."""
    months = lambda v: F.coalesce(v.cast("string"), F.lit("-"))
    rule = lambda v: F.concat(F.lit(f"{PARSED}:months(min="), months(v["minimum_months"]), F.lit(",max="), months(v["maximum_months"]), F.lit(")"))
    return F.transform(_items(items), lambda x: record("experience", x, x, rule(D.experience_phrase(x)), F.lit(1.0)))


def normalised_jobs(rows: DataFrame, skills: dict[str, str] = N.SKILLS, out: str = "audit") -> DataFrame:
    """Extracted jobs (title, skills, education, experience, certifications, keywords) in canonical form, with ``out`` as ``normalised`` gives it.

    Titles in capitals become title case.  Of degrees only the most specific stay, in order of the alphabet; jobs without any phrase about
    years get a warning.  Null lists are empty.
    """
    c = F.col
    plain = lambda field: F.transform(_items(c(field)), lambda x: record(field, x, x, F.lit("preserved_unknown"), F.lit(1.0)))
    fields = {"skills": coded_skills(c("skills"), skills), "education": coded_degrees(c("education")), "experience": coded_experience(c("experience")), "certifications": coded(c("certifications"), CERTIFICATES, "certifications"), "keywords": plain("keywords")}
    done = normalised(rows, fields, out)
    warned = F.when(F.size("experience") == 0, F.array_append(F.col(f"{out}.warnings"), F.lit(NO_EXPERIENCE))).otherwise(F.col(f"{out}.warnings"))
    return done.withColumns({"title": X.title_if_upper(F.trim("title")), "education": F.sort_array(A.drop_subsumed(c("education"))), out: c(out).withField("warnings", warned)})


def audit_rows(audited: DataFrame, keys: Iterable[str], column: str = "audit") -> DataFrame:
    """The audit table: one row for each change."""
    return audited.select(*keys, F.inline_outer(f"{column}.changes")).where("field IS NOT NULL")


def field_confidence(audited: DataFrame, column: str = "audit") -> DataFrame:
    """(field, n, mean_confidence) over all rows that have the field."""
    # a plain inline makes Spark test the list for its size first, which works the whole audit out a second time where the rows are read
    each = audited.select(F.inline_outer(f"{column}.field_confidence")).where("field IS NOT NULL")
    return each.groupBy("field").agg(F.count("*").alias("n"), F.round(F.avg(F.col("confidence").cast("decimal(18,2)")), 4).cast("double").alias("mean_confidence"))
