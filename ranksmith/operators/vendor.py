"""A vendor's nested parse of a resume, mapped to this library's records; what it lacks is filled from records of another reading.

The payload is read by one explicit schema, so unknown keys are dropped and missing ones are null; all is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranksmith.functions import arrays as A
from ranksmith.functions import dates as D
from ranksmith.functions import text as X

from . import records as R
from . import resumes as P

#: The parts of the payload that are read.
PAYLOAD = """candidateName struct<firstName:string,middleName:string,familyName:string,raw:string>, email array<string>, phoneNumber array<struct<formattedNumber:string,rawText:string>>,
location struct<formatted:string,rawInput:string>, skill array<struct<name:string>>, language array<string>, certification array<string>,
education array<struct<educationAccreditation:string,educationOrganization:string,educationMajor:array<string>,educationGrade:string,educationDates:struct<end:struct<date:string>>>>,
workExperience array<struct<workExperienceOrganization:string,workExperienceJobTitle:string,workExperienceType:string,workExperienceDescription:string,workExperienceLocation:struct<formatted:string,rawInput:string>,
workExperienceDates:struct<start:struct<date:string>,end:struct<date:string,isCurrent:boolean>>>>,
project array<struct<projectTitle:string,projectDescription:string,projectSkills:array<string>>>"""
#: What a resume has once, and what it has several of.
SCALARS, LISTS = ("name", "email", "phone", "location"), ("skills", "languages", "certifications", "education", "experience", "projects")


def _said(c: Column) -> Column:
    """A text without blanks at its ends; null for none."""
    return F.nullif(F.trim(c), F.lit(""))


def _list(c: Column, f) -> Column:
    return F.filter(F.transform(F.coalesce(c, F.array()), f), lambda x: x.isNotNull())


def _kind(label: Column, context: Column) -> Column:
    words = F.split(F.replace(F.lower(F.concat_ws(" ", label, context)), F.lit("part time"), F.lit("part-time")), r"[^a-z-]+")
    hits = [F.when(F.arrays_overlap(words, F.array(*map(F.lit, names.split()))), F.lit(kind)) for kind, names in R.KINDS.items()]
    return F.coalesce(*hits, F.lit(R.FULL_TIME))


def _job(w: Column, today: Column) -> Column:
    dates = w["workExperienceDates"]
    title, company, told = _said(w["workExperienceJobTitle"]), _said(w["workExperienceOrganization"]), _said(w["workExperienceDescription"])
    start, raw_end = F.substring(_said(dates["start"]["date"]), 1, 10), F.substring(_said(dates["end"]["date"]), 1, 10)
    current = F.coalesce(dates["end"]["isCurrent"], F.lit(False)) | F.coalesce(F.lower(raw_end).isin(*R.OPEN_ENDS), F.lit(False))
    end = F.when(~current, raw_end)
    months = F.when(start.isNotNull(), D.months_between(start, F.coalesce(end, F.date_format(today, "yyyy-MM-dd")), inclusive=False))
    job = F.struct(
        company.alias("company"), title.alias("title"), _kind(w["workExperienceType"], F.concat_ws(" ", title, told)).alias("employment_type"), start.alias("start_date"), end.alias("end_date"),
        F.when(months.isNotNull(), F.concat(months.cast("string"), F.lit(" months"))).alias("duration"), F.coalesce(_said(w["workExperienceLocation"]["formatted"]), _said(w["workExperienceLocation"]["rawInput"])).alias("location"),
        current.alias("is_current"), F.coalesce(X.content_lines(told), F.array().cast("array<string>")).alias("responsibilities"), F.coalesce(told, F.lit("")).alias("description"),
    )
    return F.when(F.coalesce(company, title, told).isNotNull(), job)


def _degrees(e: Column) -> Column:
    """One record for each of several degrees that stand in one field, between commas."""
    names = F.filter(F.transform(F.split(F.coalesce(e["educationAccreditation"], F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    some = F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(None).cast("string")))
    year = F.nullif(F.substring(e["educationDates"]["end"]["date"], 1, 4), F.lit(""))
    return F.transform(some, lambda d: F.struct(d.alias("degree"), _said(F.get(e["educationMajor"], F.lit(0))).alias("field_of_study"), _said(e["educationOrganization"]).alias("institution"), year.alias("year"), _said(e["educationGrade"]).alias("grade")))


def map_resume(rows: DataFrame, payload: str = "payload", today: Column | None = None) -> DataFrame:
    """``rows`` with name, email, phone, location, skills, languages, certifications, education, experience and projects of a JSON payload.

    Jobs without an end last until ``today``, which is the current date unless given.  Rows of course providers under education become certificates.  A payload that is null or no JSON gives nulls and empty lists.
    """
    p, until = F.col("_p"), F.current_date() if today is None else today
    name = p["candidateName"]
    full = F.coalesce(F.nullif(F.concat_ws(" ", _said(name["firstName"]), _said(name["middleName"]), _said(name["familyName"])), F.lit("")), _said(name["raw"]))
    taught = F.flatten(_list(p["education"], _degrees))
    read = rows.withColumn("_p", F.from_json(payload, PAYLOAD)).withColumn("_split", P.courses_as_certificates(F.filter(taught, lambda e: F.coalesce(e["degree"], e["institution"], e["field_of_study"]).isNotNull())))
    phone = F.get(_list(p["phoneNumber"], lambda x: F.coalesce(_said(x["formattedNumber"]), _said(x["rawText"]))), F.lit(0))
    return read.withColumns(
        {
            "name": full, "email": F.lower(F.get(_list(p["email"], _said), F.lit(0))), "phone": phone, "location": F.coalesce(_said(p["location"]["formatted"]), _said(p["location"]["rawInput"])),
            "skills": A.ordered_distinct(_list(p["skill"], lambda x: _said(x["name"]))), "languages": A.ordered_distinct(_list(p["language"], _said)),
            "certifications": A.ordered_distinct(F.concat(_list(p["certification"], _said), F.col("_split.certifications"))), "education": F.col("_split.education"), "experience": _list(p["workExperience"], lambda w: _job(w, until)),
            "projects": _list(p["project"], lambda x: F.when(F.coalesce(_said(x["projectTitle"]), _said(x["projectDescription"])).isNotNull(), F.struct(_said(x["projectTitle"]).alias("name"), _list(x["projectSkills"], _said).alias("tools"), F.coalesce(_said(x["projectDescription"]), F.lit("")).alias("description")))),
        }
    ).drop("_p", "_split")


def filled(mapped: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """``mapped`` with the scalars and whole lists that it lacks taken from ``local``, and the names of those in ``filled_fields``."""
    names = [c for c in (*SCALARS, *LISTS) if c in local.columns]
    other = local.select(key, *[F.col(c).alias(f"_l_{c}") for c in names])
    joined = mapped.join(other, key, "left")
    lacks = {c: ~F.coalesce(X.present(F.col(c)), F.lit(False)) if c in SCALARS else F.coalesce(F.size(c), F.lit(0)) <= 0 for c in names}
    has = {c: F.coalesce(X.present(F.col(f"_l_{c}")), F.lit(False)) if c in SCALARS else F.coalesce(F.size(f"_l_{c}"), F.lit(0)) > 0 for c in names}
    told = F.filter(F.array(*[F.when(lacks[c] & has[c], F.lit(c)) for c in names]), lambda x: x.isNotNull())
    return joined.withColumn("filled_fields", told).withColumns({c: F.when(lacks[c] & has[c], F.col(f"_l_{c}")).otherwise(F.col(c)) for c in names}).drop(*[f"_l_{c}" for c in names])
