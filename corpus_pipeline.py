"""Corpus pipeline: quality filter, near-copy removal, repeated passages, source mix, packing.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranksmith.llm.common import free_name, shared_folder, small_batches, table
from ranksmith.llm.mixing import mixed
from ranksmith.llm.packing import pack, tokenizer_path
from ranksmith.llm.quality import score_quality
from ranksmith.llm.simhash import leave_first_of_groups
from ranksmith.llm.suffixes import remove_repeats


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more; its labels leave out the test fold.

    Null and empty texts have the score of no difference; null ids, repeated rows and texts of any length are scored like
    others; all columns stay, whatever their names; an empty table stays empty.
    """
    score = free_name(docs, "quality_score")
    return score_quality(docs, table(spark, sf_dir, "labels"), out=score).where(F.col(score) >= 0.5).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies; documents without words stay.

    Rows without an id are told apart by their texts and come last.  Of rows with one id and one text all stay or go, so
    repeated rows stay repeated; whole texts of any length are compared; all columns stay; an empty table stays empty.
    """
    small_batches(spark)
    return leave_first_of_groups(docs)


def text_of(kept: Column) -> Column:
    """Remaining bytes as text; a character cut in half at a seam goes."""

    @F.pandas_udf(T.StringType())
    def decode(parts):
        return parts.map(lambda b: b.decode("utf-8", "ignore"))

    return decode(kept)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes or more that also occur earlier; n_chars follows.

    Null and short texts stay as they are, texts of any length are read whole; null and repeated ids, ties and repeated
    rows are treated as ``remove_repeats`` says; all columns stay, whatever their names; an empty table stays empty.
    """
    small_batches(spark)
    cut = free_name(docs, "cut")
    out = remove_repeats(docs, out=cut)
    changed = F.col(f"{cut}.n_removed") > 0
    text = F.when(changed, text_of(F.col(f"{cut}.kept"))).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, 0 to 3 times; those without words leave.

    Null ids and sources keep their rows, repeated rows are separate documents, texts of any length are counted whole;
    all columns stay, whatever their names; an empty table stays empty.
    """
    small_batches(spark)
    return mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences; nulls, empty and long texts and repeats as ``pack`` says."""
    small_batches(spark)
    return pack(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [
    ("quality_classifier", keep_good),
    ("simhash_neardup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Compression scores, fingerprints and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
