"""Terms of a dictionary table in texts: one pass over a text for any number of terms.

Texts and terms are brought to one form in column expressions: lower case, every run of other signs than letters, digits, '#', '+', '_'
and inner dots as one blank.  A dictionary of at most ``MAX_TERMS`` terms becomes an automaton that each task builds once; a greater
one meets the texts' word runs in a join, which the planner deals out like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Terms, and bytes of terms, that travel to the tasks.
MAX_TERMS, MAX_BYTES = 200_000, 16 << 20


def plain_words(c: Column) -> Column:
    """A text as words between single blanks, without blanks at its ends."""
    x = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}#+_.]+", " ")
    x = F.regexp_replace(F.concat(F.lit(" "), x, F.lit(" ")), r"\.+ ", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r" \.+", " "), " +", " "))


def dictionary_terms(dictionary: DataFrame, term: str = "term", canonical: str | None = None) -> DataFrame:
    """(words, canonical) of a dictionary, each form once; of several canonical names the least stays, empty forms leave."""
    name = F.col(canonical or term)
    return dictionary.select(plain_words(F.col(term)).alias("words"), name.alias("canonical")).where("words <> '' AND canonical IS NOT NULL").groupBy("words").agg(F.min("canonical").alias("canonical"))


def with_terms(texts: DataFrame, dictionary: DataFrame, text: str = "text", term: str = "term", canonical: str | None = None, out: str = "terms", key: str | None = None, max_terms: int = MAX_TERMS) -> DataFrame:
    """``texts`` with ``out``: the canonical names of the terms that occur, each once, in order of letters.

    Null and empty texts, and an empty dictionary, give empty lists.  ``key`` names a column that tells rows apart; only a
    dictionary beyond ``max_terms`` needs it, as its terms are joined to word runs of the texts.
    """
    terms = dictionary_terms(dictionary, term, canonical)
    size = terms.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("words")), F.lit(0)).alias("chars"), F.coalesce(F.max(F.size(F.split("words", " "))), F.lit(0)).alias("longest")).first()
    if size.n <= max_terms and size.chars <= MAX_BYTES:
        return texts.withColumn(out, _scanned(plain_words(F.col(text)), [(r.words, r.canonical) for r in terms.collect()]))
    if key is None:
        raise ValueError(f"a dictionary of {size.n} terms needs a key to be joined by")
    words = F.split(plain_words(F.col(text)), " ")
    runs = texts.select(F.col(key).alias("_key"), words.alias("_w")).select("_key", F.posexplode("_w").alias("_i", "_first"), "_w")
    runs = runs.select("_key", F.explode(F.transform(F.sequence(F.lit(1), F.lit(size.longest)), lambda n: F.array_join(F.slice("_w", F.col("_i") + 1, n), " "))).alias("words")).distinct()
    hits = runs.join(terms, "words").groupBy("_key").agg(F.sort_array(F.collect_set("canonical")).alias(out))
    none = F.array().cast("array<string>")
    return texts.join(hits, F.col(key) == F.col("_key"), "left").withColumn(out, F.coalesce(out, none)).drop("_key")


def _scanned(words: Column, terms: list[tuple[str, str]]) -> Column:
    """Names of the terms in a text of words, by an automaton over all terms."""

    @F.arrow_udf(T.ArrayType(T.StringType()), F.ArrowUDFType.SCALAR_ITER)
    def run(batches):
        import ahocorasick
        import pyarrow as pa

        found = ahocorasick.Automaton()
        for form, name in terms:
            found.add_word(f" {form} ", name)
        if terms:
            found.make_automaton()
        for batch in batches:
            hits = [sorted({name for _, name in found.iter(f" {t} ")}) if t and terms else [] for t in batch.to_pylist()]
            yield pa.array(hits, pa.list_(pa.string()))

    return run(words)
