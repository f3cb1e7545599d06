"""Structured fields from free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranksmith.functions import arrays as A
from ranksmith.functions import text as X

from .headings import section_lines


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, section, line) of every line that is neither empty nor a heading; no text is shuffled."""
    return docs.select(key, F.explode(section_lines(F.col(text))).alias("_l")).select(key, "_l.*")


#: An address that reading by machine ran together with a link.
GLUED = r"(?i)^(.+@.+\.[a-z]{2,}?)(?:www|https?|linkedin|github)(?:\..*)?$"
#: Signs of a number: after a label, with a country's code, and plain in the first lines.
LABELLED = r"(?i)\b(?:phone|mobile|tel|cell|contact)\s*[:–—-]?\s*(\+?[0-9 ().-]{8,20}[0-9])"
WITH_CODE = r"(\+[0-9]{1,3}[ .-]?\(?[0-9]{1,5}\)?[ .-]?[0-9]{3,5}[ .-]?[0-9]{3,5})\b"
PLAIN = r"\b([6-9][0-9]{4}[ .-]?[0-9]{5})\b"
HEADER_LINES = 12


def email(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(F.regexp_extract(c, X.EMAIL, 0), GLUED, "$1")), F.lit(""))


def phone(c: Column) -> Column:
    """Digits, after the plus sign that stands there, of the first number that is plausible: labelled, with a country's code, or plain in the header.

    A number has 10 to 15 digits, over two different ones, and does not count up.
    """
    header = F.array_join(F.slice(F.split(c, "\n"), 1, HEADER_LINES), "\n")

    def plausible(raw: Column) -> Column:
        digits = F.regexp_replace(raw, "[^0-9]", "")
        fits = F.length(digits).between(10, 15) & (F.size(F.array_distinct(F.split(digits, ""))) > 2) & (digits != "1234567890")
        return F.when(fits, F.concat(F.when(F.startswith(raw, F.lit("+")), "+").otherwise(""), digits))

    found = [F.regexp_extract(c, LABELLED, 1), F.regexp_extract(c, WITH_CODE, 1), F.regexp_extract(header, PLAIN, 1)]
    return F.coalesce(*[plausible(x) for x in found])


def links(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit("(" + X.URL + ")"), F.lit(1)))


def name_line(c: Column) -> Column:
    """First of eight lines with two to four capitalised words and nothing else."""
    lines = F.slice(X.content_lines(c), 1, 8)
    return A.first_where(lines, lambda x: F.regexp_like(x, F.lit(r"^[A-Z][a-z'.-]+( [A-Z][a-z'.-]+){1,3}$")))


#: How well a skill is known, and headings that are no skills of their own.
LEVELS = "proficient intermediate beginner expert basic basics advanced familiar hands-on"
HEADINGS = (
    "skill", "skills", "technologies", "tool", "tools", "language", "languages", "programming language", "programming languages", "framework", "frameworks", "libraries", "core",
    "database", "databases", "query language", "query languages", "platform", "platforms", "cloud", "methodologies", "web technologies", "other",
)
SKILL_WORDS, SKILL_LENGTH = 7, 60


def skill_items(block: Column) -> Column:
    """Skills of a section: items of its lines after a label of up to 35 signs, between commas, semicolons, bars, bullets, tabs, wide gaps and
    slashes with blanks.  Levels in parentheses go, as do headings, items of over seven words or 60 signs, and sentences."""
    lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[•●○▪*–—-]+|[0-9]+[.)])\s*", ""))), lambda x: x != "")
    label = r"^[A-Za-z0-9\s/&+-]{1,35}?\s*[:：]\s*"
    listed = lambda x: F.regexp_like(x, F.lit(label)) | F.regexp_like(x, F.lit(r"[,;|•\t]| - "))
    n_words = lambda x: F.size(F.split(x, r"\s+"))
    told = F.filter(lines, lambda x: listed(x) | (n_words(x) <= 6) | ((n_words(x) <= 20) & ~F.regexp_like(x, F.lit(r"[.!?]$"))))
    items = F.flatten(F.transform(told, lambda x: F.split(F.regexp_replace(x, label, ""), r"[,;|•●○▪*\t]|\s{2,}|\s+/\s+")))
    clean = F.transform(items, lambda x: F.trim(F.regexp_replace(F.regexp_replace(X.clean_unicode(x), r"^[\s•●○▪*–—.),:;|/-]+|[\s,:;|/-]+$", ""), rf"(?i)\s*\({X.one_of(LEVELS)}\)$", "")))
    kept = F.filter(clean, lambda x: (x != "") & (n_words(x) <= SKILL_WORDS) & (F.length(x) <= SKILL_LENGTH) & ~F.regexp_replace(F.lower(x), r"^technical\s+", "").isin(*HEADINGS))
    return A.ordered_distinct(kept)


def skills(c: Column, vocabulary: list[str]) -> Column:
    """Items of 'Skills:' lines, then vocabulary terms of the whole text, each once."""
    listed = F.split(F.regexp_extract(c, r"(?im)^\s*(?:technical )?skills\s*:\s*(.+)$", 1), r"\s*[,;|]\s*")
    return A.ordered_distinct(F.concat(F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: x != ""), X.match_terms(c, vocabulary)))


def section_skills(block: Column, text: Column, vocabulary: list[str]) -> Column:
    """Items of the skills section, then vocabulary terms of the whole text, each once."""
    return A.ordered_distinct(F.concat(F.coalesce(skill_items(block), F.array().cast("array<string>")), X.match_terms(text, vocabulary)))


def education_lines(c: Column) -> Column:
    return F.filter(X.content_lines(c), lambda x: F.regexp_like(F.lower(x), F.lit(r"(^|[^a-z])(bachelors?|masters?|ph\.?d|mba|b\.?tech|m\.?tech|diploma)([^a-z]|$)")))


def responsibilities(c: Column, most: int = 30) -> Column:
    """Bullet lines of over 15 characters, each once."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.regexp_like(x, F.lit(r"^\s*[-*•]\s+")))
    items = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^\s*[-*•]\s+", ""))), lambda x: F.length(x) > 15)
    return F.slice(A.ordered_distinct(items), 1, most)


def vendor_payload(c: Column) -> Column:
    """struct of a vendor's nested JSON, unknown keys dropped."""
    return F.from_json(c, "name string, email string, skills array<string>, composite_score double, education array<struct<degree:string,institution:string,year:string>>")


def first_spelling(c: Column, paths: list[str]) -> Column:
    """Value of the first path that a JSON text has."""
    return F.coalesce(*[F.get_json_object(c, p) for p in paths])
