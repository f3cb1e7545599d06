"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

A logging client often stores a conversation again after each turn.  Rolling hashes of turn
prefixes show which logged conversations begin longer ones; those and repeated ones leave,
and the rest are rendered in the public ChatML layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, at (1, 2, ...), key of the first ``at`` turns, and ``last``, the conversation's number of turns.

    Each turn's 256-bit digest, taken with its place, adds to a running sum of 32-bit limbs, so a
    prefix's key is made from the one before it and no list of turns is gathered.
    """
    content = F.sha2(_turn(F.col("role"), F.col("text")), 256)
    numbered = turns.select("conv_id", F.col("turn"), content.alias("c"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "c")
    placed = numbered.withColumn("at", F.row_number().over(order)).withColumn("h", F.sha2(F.concat_ws(":", F.col("at").cast("string"), "c"), 256))
    running = order.rowsBetween(W.unboundedPreceding, 0)
    limbs = [F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("long")).over(running).alias(f"l{i}") for i in range(4)]
    summed = placed.select("conv_id", "at", *limbs, F.count("*").over(W.partitionBy("conv_id")).alias("last"))
    return summed.select("conv_id", "at", "last", F.sha2(F.concat_ws(":", "at", *[f"l{i}" for i in range(4)]), 256).alias("key"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id of the conversations to keep: of equal ones the least id, and none that begins a longer one."""
    prefixes = turn_prefixes(turns.where(F.col("conv_id").isNotNull()))
    whole = prefixes.where(F.col("at") == F.col("last")).groupBy("key").agg(F.min("conv_id").alias("conv_id"))
    begun = prefixes.where(F.col("at") < F.col("last")).select("key").distinct()
    return whole.join(begun, "key", "left_anti").select("conv_id")


def render_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and rendered ChatML of each maximal conversation.

    Turns are in order of ``turn`` (null first), ties by a digest of their content; null roles and texts render as empty.
    Conversations without an id are left out.
    """
    kept = turns.join(maximal_conversations(turns), "conv_id", "left_semi")
    line = _turn(F.col("role"), F.col("text"))
    item = F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("t"), F.sha2(line, 256).alias("c"), line.alias("line"))
    lines = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return lines.select("conv_id", F.size("items").cast("long").alias("n_turns"), F.array_join(F.transform("items", lambda x: x["line"]), "\n").alias("rendered"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns and rendered text of the maximal conversations; nulls, ties, repeats and empty tables as ``render_chats`` says, texts of any length whole, other columns ignored."""
    return render_chats(table(spark, sf_dir, "conversations"))


OP7_SQL = """
WITH t AS (
  SELECT conv_id, turn, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' AS line
  FROM conversations WHERE conv_id IS NOT NULL
), whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(line, chr(10) ORDER BY turn NULLS FIRST, sha256(line)) AS rendered FROM t GROUP BY conv_id
), once AS (
  SELECT min(conv_id) AS conv_id, n_turns, rendered FROM whole GROUP BY n_turns, rendered
), prefixes AS (
  SELECT conv_id, row_number() OVER w AS at, string_agg(line, chr(10)) OVER (w ROWS UNBOUNDED PRECEDING) AS p
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(line))
), proper AS (
  SELECT DISTINCT p.at, p.p FROM prefixes p JOIN whole w USING (conv_id) WHERE p.at < w.n_turns
)
SELECT o.conv_id, o.n_turns, o.rendered FROM once o
WHERE NOT EXISTS (SELECT 1 FROM proper p WHERE p.at = o.n_turns AND p.p = o.rendered)
"""
