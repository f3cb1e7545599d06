"""Concepts against a candidate's texts: aliases, categories, stems and groups, all inside one row.

A pool is struct<keys, padded, stems> of an array of texts; ``pool_of`` makes it once for all concepts of a row.
Dictionaries are small literal maps, lower case: alias -> canonical name, category -> members.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrays as A
from . import text as X

#: Words that carry no concept.
STOP_WORDS = ("and", "with", "or", "using", "of", "in", "the", "for", "to", "a", "an", "on", "from", "by", "as", "at", "during", "across", "into", "through")
#: Places that a concept's words may lie apart beyond their own number.
SLACK = 8
ALIASES = {"js": "javascript", "py": "python", "python3": "python", "postgres": "postgresql", "k8s": "kubernetes", "ml": "machine learning", "reactjs": "react", "react.js": "react"}
CATEGORIES = {"programming language": ("python", "java", "javascript", "go", "rust", "scala"), "relational database": ("postgresql", "mysql", "oracle", "sqlite"), "cloud platforms": ("aws", "azure", "gcp")}


def _none() -> Column:
    return F.array().cast("array<string>")


def _map(d: dict) -> Column:
    """A dictionary as a map column; values may be tuples."""
    return F.create_map(*[c for k, v in d.items() for c in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v))])


def _inverse(aliases: dict[str, str]) -> dict[str, tuple[str, ...]]:
    out: dict[str, tuple[str, ...]] = {}
    for alias, name in aliases.items():
        out[name] = (*out.get(name, ()), alias)
    return out


def padded(c: Column) -> Column:
    """Lower case with single blanks between words and at both ends, so that a whole word is a substring."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}0-9+#.]+", " ")), F.lit(" "))


def pool_of(texts: Column) -> Column:
    t = F.filter(texts, X.present)
    return F.struct(
        F.transform(t, lambda x: F.lower(F.trim(x))).alias("keys"),
        F.transform(t, padded).alias("padded"),
        F.transform(t, lambda x: F.transform(X.tokens(x), X.stem)).alias("stems"),
    )


def near(stems: Column, concept: Column) -> Column:
    """All stems of a concept occur, their first places within its length and ``SLACK``."""
    at = F.transform(concept, lambda s: F.array_position(stems, s))
    return A.once(at, lambda p: (F.array_min(p) > 0) & (F.array_max(p) - F.array_min(p) <= F.size(p) + SLACK))


def concept_stems(c: Column) -> Column:
    return F.transform(F.filter(X.tokens(c), lambda t: ~t.isin(*STOP_WORDS)), X.stem)


def multiword_match(concept: Column, stems: Column) -> Column:
    """A concept of two words or more whose stems lie near each other in one of the texts (array of arrays of stems)."""
    # the concept's stems are made once, not for each text
    return A.once(concept_stems(concept), lambda s: (F.size(s) >= 2) & F.exists(stems, lambda t: near(t, s)))


class Dictionaries(NamedTuple):
    """Map columns: alias -> canonical name, canonical name -> aliases, category -> members."""

    aliases: Column
    names: Column
    categories: Column


def dictionaries(aliases: dict[str, str] = ALIASES, categories: dict[str, tuple[str, ...]] = CATEGORIES) -> Dictionaries:
    """Neither dictionary may be empty."""
    return Dictionaries(_map(aliases), _map(_inverse(aliases)), _map(categories))


def concept_match(concept: Column, pool: Column, known: Dictionaries) -> Column:
    """Whether the pool shows the concept: a member of the category it names, itself, its canonical name, one of that
    name's aliases (alone or, from three letters on, inside a text), or all its words near each other."""
    keys = pool["keys"]

    def test(a: Column) -> Column:
        def of(target: Column, others: Column) -> Column:
            members = F.coalesce(F.try_element_at(known.categories, a), _none())
            inside = F.exists(others, lambda o: (F.length(o) >= 3) & F.exists(pool["padded"], lambda t: F.contains(t, F.concat(F.lit(" "), o, F.lit(" ")))))
            return (a != "") & (F.coalesce(F.arrays_overlap(keys, F.concat(F.array(a, target), others, members)), F.lit(False)) | inside | multiword_match(a, pool["stems"]))

        target = F.coalesce(F.try_element_at(known.aliases, a), a)
        return A.once(target, lambda t: A.once(F.coalesce(F.try_element_at(known.names, t), _none()), lambda o: of(t, o)))

    # where no phrase asks, both forms are one
    return F.exists(F.array_distinct(F.array(F.lower(F.trim(concept)), F.lower(X.strip_filler(concept)))), test)


def group_parts(item: Column) -> tuple[Column, Column, Column]:
    """(every, parts, options) of a requirement: whether all parts are needed, the parts of 'A and B', and the options of 'A or B', 'A / B'
    and 'X such as A, B', the whole last."""
    either = F.regexp_like(item, F.lit(r"(?i)\bor\b|/|\||\bsuch as\b|\blike\b|\be\.g\."))
    parts = _pieces(item, r"(?i)\s*,\s*and\s+|\s+(?:and|&)\s+")
    tail = F.regexp_extract(item, r"(?i)\b(?:such\s+as|like|e\.g\.?|including)\s+(.+)$", 1)
    options = F.concat(_pieces(item, r"(?i)\s*[/|]\s*|\s*,\s*or\s+|\s+or\s+"), _pieces(tail, r"(?i)[,;/]|\s+or\s+"), F.array(item))
    return ~either & (F.size(parts) >= 2), parts, options


def group_match(item: Column, pool: Column, known: Dictionaries) -> Column:
    """'A and B' needs every part; 'A or B', 'A / B' and 'X such as A, B' need any part, or the whole."""
    every, parts, options = group_parts(item)
    shown = lambda x: concept_match(x, pool, known)
    # the first that decides ends the search
    return A.once(F.struct(every.alias("every"), F.when(every, parts).otherwise(F.array_distinct(options)).alias("forms")), lambda g: F.when(g["every"], F.forall(g["forms"], shown)).otherwise(F.exists(g["forms"], shown)))


def _pieces(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern), lambda x: F.trim(x)), lambda x: x != "")


def distinct_items(items: Column, known: Dictionaries) -> Column:
    """Items without blanks around them, each canonical name once, in order."""
    t = F.transform(F.filter(F.coalesce(items, _none()), X.present), lambda x: F.trim(x))
    return A.distinct_by_canonical(t, F.transform(t, lambda x: F.coalesce(F.try_element_at(known.aliases, F.lower(x)), F.lower(x))))


def marks(items: Column, test) -> Column:
    """array<struct<item, ok>> of items under a test."""
    return F.transform(items, lambda x: F.struct(x.alias("item"), F.coalesce(test(x), F.lit(False)).alias("ok")))


def picked(marked: Column, ok: bool) -> Column:
    return F.transform(F.filter(marked, lambda x: x["ok"] == F.lit(ok)), lambda x: x["item"])


def detail(marked: Column) -> Column:
    """struct<score, matched, missing> of marks: the share that passes in percent, 100 for none."""
    n = F.size(marked)
    score = F.when(n == 0, F.lit(100.0)).otherwise(F.round(F.size(picked(marked, True)) * 100 / n, 2))
    return F.struct(score.alias("score"), picked(marked, True).alias("matched"), picked(marked, False).alias("missing"))


def group_marks(items: Column, pool: Column, known: Dictionaries) -> Column:
    """Marks of requirement groups against a pool."""
    return marks(items, lambda x: group_match(x, pool, known))
