"""Sections of texts by headings that are exact, among other words, misspelt, or inside running text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksmith.operators import extraction as E
from ranksmith.operators import headings as H
from ranksmith.session import small_batches, table

from .bindings import parts
from .catalogue import query

_NAMES = ", ".join(f"('{name}', '{section}')" for section, names in H.HEADINGS.items() for name in names)
_INLINE = "|".join(sorted(H.INLINE, key=len, reverse=True)).replace(" ", r"\s+")


def sections_sql(docs: str) -> str:
    """Common table expressions that end in ``c`` (doc_id, pos, part, section, line) for the texts of ``docs`` (doc_id, t)."""
    return rf"""names(name, section) AS (VALUES {_NAMES}),
l0 AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS raw, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS pos FROM {docs}),
l AS (SELECT doc_id, pos, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line FROM l0 WHERE regexp_matches(raw, '\S')),
short AS (SELECT DISTINCT line, lower(trim(line, '#*•:_=- ' || chr(9))) AS k FROM l WHERE length(line) < 80),
w AS (SELECT line, k, regexp_extract_all(k, '[a-z0-9&]+') AS words FROM short),
f AS (SELECT line, names.name, section, CASE WHEN k = name THEN 0 WHEN contains(' ' || array_to_string(words, ' ') || ' ', ' ' || name || ' ') THEN 1 ELSE 2 END AS kind FROM w, names
      WHERE k = name OR (len(words) BETWEEN 1 AND {H.HEADING_WORDS} AND contains(' ' || array_to_string(words, ' ') || ' ', ' ' || name || ' ') AND (len(words) <= {H.MISSPELT_WORDS} OR len(string_split(name, ' ')) >= len(words) // 2 + 1))
      OR (len(words) BETWEEN 1 AND {H.MISSPELT_WORDS} AND length(name) >= {H.MISSPELT_LETTERS} AND damerau_levenshtein(array_to_string(words, ' '), name) <= 1)),
heads AS (SELECT line, first(section ORDER BY kind, -length(name), name) AS opens FROM f GROUP BY line),
h AS (SELECT l.*, opens, coalesce(last_value(opens IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'header') AS before FROM l LEFT JOIN heads USING (line)),
plain AS (SELECT doc_id, pos, before AS section, line FROM h WHERE opens IS NULL OR opens = before),
run AS (SELECT doc_id FROM {docs} WHERE length(t) > {H.RUNNING_TEXT} AND doc_id NOT IN (SELECT doc_id FROM h WHERE opens <> before)),
p0 AS (SELECT doc_id, pos, string_split(regexp_replace(line, '(?i)\b({_INLINE})\b', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS parts FROM h JOIN run USING (doc_id)),
p AS (SELECT doc_id, pos, unnest(parts) AS piece, generate_subscripts(parts, 1) AS part, len(parts) AS n FROM p0),
q AS (SELECT doc_id, pos, part, CASE WHEN contains(piece, chr(2)) THEN regexp_replace(lower(string_split(piece, chr(2))[1]), '\s+', ' ', 'g') END AS name,
      CASE WHEN part = n THEN regexp_replace(string_split(piece, chr(2))[-1], '^[ :]+|[ :]+$', '', 'g') ELSE regexp_replace(string_split(piece, chr(2))[-1], '^\s+|\s+$', '', 'g') END AS line FROM p),
r AS (SELECT q.doc_id, pos, part, coalesce(last_value(names.section IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos, part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'header') AS section, line FROM q LEFT JOIN names USING (name)),
c AS (SELECT doc_id, pos, 0 AS part, section, line FROM plain WHERE doc_id NOT IN (SELECT doc_id FROM run) UNION ALL SELECT doc_id, pos, part, section, line FROM r WHERE line <> '')"""


@query(
    f"""WITH d AS (SELECT doc_id, replace(replace(text, '. The', chr(10) || 'Skills:' || chr(10) || 'The'), '. An', chr(10) || 'experience' || chr(10) || 'An') AS t FROM documents),
{sections_sql('d')}
SELECT doc_id, section, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM c GROUP BY 1, 2"""
)
def section_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    marked = F.replace(F.replace(F.col("text"), F.lit(". The"), F.lit("\nSkills:\nThe")), F.lit(". An"), F.lit("\nexperience\nAn"))
    lines = E.sections(table(spark, sf_dir, "documents").select("doc_id", marked.alias("text")))
    return lines.groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


_FORMS = ("work experience", "certifications", "technical skills", "responsibilities", "achievements")


@query(
    f"""WITH d AS (SELECT p_partkey AS doc_id, {list(_FORMS)}[p_partkey % 5 + 1] AS name, p_partkey % 13 + 1 AS i, p_name, p_type FROM part),
e AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN name[:i - 1] || name[i + 1:] WHEN 1 THEN name[:i] || name[i:] WHEN 2 THEN name[:i] || '#' || name[i + 2:] ELSE 'my ' || name || ' so far' END AS head, p_name, p_type FROM d),
t AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN upper(p_name) || ' EDUCATION ' || p_type || repeat(' and more', 120) || ' Work  Experience: ' || p_name ELSE p_name || chr(10) || '** ' || head || ' --' || chr(10) || p_type END AS t FROM e),
{sections_sql('t')}
SELECT doc_id, pos, section, line FROM c"""
)
def heading_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings with a letter missing, doubled or changed, among other words, and inside running text."""
    key, at = F.col("p_partkey"), (F.col("p_partkey") % 13 + 1).cast("int")
    name = F.element_at(F.array(*map(F.lit, _FORMS)), (key % 5 + 1).cast("int"))
    left = lambda n: F.substring(name, F.lit(1), n)
    right = lambda a: F.substring(name, a, F.lit(99))
    head = F.when(key % 4 == 0, F.concat(left(at - 1), right(at + 1))).when(key % 4 == 1, F.concat(left(at), right(at))).when(key % 4 == 2, F.concat(left(at), F.lit("#"), right(at + 2))).otherwise(F.concat(F.lit("my "), name, F.lit(" so far")))
    running = F.concat(F.upper("p_name"), F.lit(" EDUCATION "), "p_type", F.lit(" and more" * 120), F.lit(" Work  Experience: "), "p_name")
    text = F.when(key % 7 == 0, running).otherwise(F.concat_ws("\n", "p_name", F.concat(F.lit("** "), head, F.lit(" --")), "p_type"))
    return E.sections(parts(spark, sf_dir).select(key.alias("doc_id"), text.alias("text")))
