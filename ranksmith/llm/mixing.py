"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a target number of words; documents are counted by exact length, a
bounded-knapsack dynamic programme picks how many documents of each length to take so that
the lengths add up to the target, and seeded hashes decide which documents those are.
Only counts per (source, length) meet in one task, never documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, stored, table

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A document may be taken this often at most.
MAX_COPIES = 3
#: Words left to the dynamic programme after whole passes and an even share of each length.
WINDOW = 1 << 14
#: Hash ranges in which the documents of one length are counted before they are ranked.
RANGES = 1024


def word_count(text: Column) -> Column:
    """Number of runs of non-white-space (six ASCII characters); null counts 0.

    White space becomes single blanks first, so the words are the blanks between them plus one.
    """
    flat = F.trim(F.regexp_replace(F.translate(text, "\t\n\x0b\x0c\r", "     "), " {2,}", " "))
    return F.coalesce(F.when(flat == "", 0).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1), F.lit(0)).cast("long")


def water_fill(sizes: DataFrame, total: Column | None = None, weights: tuple[int, ...] = WEIGHTS, copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size -> with target: the total shared by weight, stopped at ``copies`` times the size, the excess reshared.

    Sources in order of cap / weight stop first; running sums over that order find the level at
    which the rest share what is left.  One row for each source goes through the window.
    """
    from pyspark.sql import Window as W

    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("k", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.lit(float(copies)) * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), "k")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(0))
    filled = (
        ranked.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("heavy", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("open", F.col("cap") / F.col("weight") > F.col("left") / F.col("heavy"))
    )
    first = W.orderBy(F.col("cap") / F.col("weight"), "k").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    filled = filled.withColumn("level", F.first(F.when(F.col("open"), F.col("left") / F.col("heavy")), ignorenulls=True).over(first))
    return filled.select("source", "source_size", F.when(F.col("open"), F.col("weight") * F.col("level")).otherwise(F.col("cap")).alias("target"))


def subset_sum(budget: int, lengths: list[int], counts: list[int]) -> list[int]:
    """How many of each length to take (at most ``counts``) so that the sum comes as near to ``budget`` as possible from below.

    Bit i of a Python integer says that sum i can be reached; a length that may be taken c
    times is added in blocks of 1, 2, 4 ... copies.  It stops as soon as the budget is reached.
    """
    mask = (1 << (budget + 1)) - 1
    reach, trail = 1, []
    for k, (n, c) in enumerate(zip(lengths, counts, strict=True)):
        if n <= 0 or n > budget or reach >> budget & 1:
            continue
        c, block = min(c, budget // n), 1
        while c > 0:
            take = min(block, c)
            trail.append((k, take, reach))
            reach |= reach << (n * take) & mask
            c, block = c - take, block * 2
    out, at = [0] * len(lengths), reach.bit_length() - 1
    for k, take, before in reversed(trail):
        if not before >> at & 1:
            out[k] += take
            at -= lengths[k] * take
    return out


def plan_source(target: float, lengths, counts, copies: int = MAX_COPIES, window: int = WINDOW):
    """Copies to take of the documents of each length, 0 to ``copies`` times their count, that add up to the target.

    All but the last ``window`` words are shared evenly; those are fitted exactly, if the lengths
    allow it, first with as few copies of a document as the target needs and then with all.
    """
    import numpy as np

    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    size = int((lengths * counts).sum())
    best = np.zeros(len(lengths), np.int64)
    want = min(int(round(target)), copies * size)
    if size == 0 or want <= 0:
        return best
    share = max(0, want - window) / size
    left = want + 1
    order = [int(k) for k in np.argsort(-lengths, kind="stable") if lengths[k] > 0]
    for most in sorted({min(copies, -(-want // size)), copies}):
        took = np.floor(counts * share).astype(np.int64)
        rest = want - int((took * lengths).sum())
        for k in order:
            if rest <= window:
                break
            n = int(min(counts[k] * most - took[k], (rest - window // 2) // lengths[k]))
            if n > 0:
                took[k] += n
                rest -= n * int(lengths[k])
        open_ = [k for k in order if counts[k] * most > took[k] and lengths[k] <= rest]
        for k, n in zip(open_, subset_sum(rest, [int(lengths[k]) for k in open_], [int(counts[k] * most - took[k]) for k in open_]), strict=True):
            took[k] += n
        miss = want - int((took * lengths).sum())
        if miss < left:
            best, left = took, miss
        if not miss:
            break
    return best


def _sized(docs: DataFrame, seed: int, *columns) -> DataFrame:
    """doc_id, source, size, draw and its hash range of each row; rows of one id draw apart if their texts differ."""
    draw = F.xxhash64(F.lit(seed), "doc_id", "text")
    rows = docs.select(*columns, "doc_id", "source", word_count(F.col("text")).alias("size"), draw.alias("draw"))
    return rows.withColumn("at", F.pmod(F.shiftrightunsigned("draw", 40), F.lit(RANGES)).cast("int"))


def mix_rules(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, copies: int = MAX_COPIES) -> DataFrame:
    """What the mix does with the documents of each source and size, as a stored table.

    source_size, target; whole (copies of every document); extra (how many get one more): those before (edge, limit) in
    order of range and draw, and ``room`` of the ``ties`` rows at that very draw.
    """
    from pyspark.sql import Window as W

    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = water_fill(totals, weights=weights, copies=copies)
    counted = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    joined = counted.join(targets, counted.source.eqNullSafe(targets.source)).select(counted.source, "size", "n", "source_size", "target")

    def plan(key, pdf):
        pdf = pdf.sort_values("size", kind="stable")
        took = plan_source(float(pdf["target"].iloc[0]), pdf["size"], pdf["n"], copies)
        return pdf.assign(whole=took // pdf["n"], extra=took % pdf["n"])[["source", "size", "n", "source_size", "target", "whole", "extra"]]

    plans = stored(joined.groupBy("source").applyInPandas(plan, "source string, size long, n long, source_size long, target double, whole long, extra long"))

    # Ranges of the draw are counted first, so only the range in which the limit falls is ever ranked.
    partly = plans.where("extra > 0").select("source", "size", "extra")
    spread = sized.where("size > 0").groupBy("source", "size", "at").agg(F.count("*").alias("c"))
    spread = spread.join(partly, spread.source.eqNullSafe(partly.source) & (spread["size"] == partly["size"])).select(spread.source, spread["size"], "at", "c", "extra")
    upto = W.partitionBy("source", "size").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    edge = stored(
        spread.withColumn("below", F.coalesce(F.sum("c").over(upto), F.lit(0)))
        .where((F.col("below") < F.col("extra")) & (F.col("extra") <= F.col("below") + F.col("c")))
        .select(F.col("source").alias("e_source"), F.col("size").alias("e_size"), F.col("at").alias("edge"), (F.col("extra") - F.col("below")).alias("left"))
    )
    same = F.col("source").eqNullSafe(F.col("e_source")) & (F.col("size") == F.col("e_size"))
    draws = sized.join(edge, same & (F.col("at") == F.col("edge"))).groupBy("e_source", "e_size", "edge", "left", "draw").agg(F.count("*").alias("ties"))
    before = F.coalesce(F.sum("ties").over(W.partitionBy("e_source", "e_size").orderBy("draw").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    limits = draws.withColumn("before", before).where((F.col("before") < F.col("left")) & (F.col("left") <= F.col("before") + F.col("ties")))
    limits = limits.select("e_source", "e_size", "edge", F.col("draw").alias("limit"), "ties", (F.col("left") - F.col("before")).alias("room"))
    rules = plans.join(limits, same, "left")
    return stored(rules.select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), "source_size", "target", "whole", "extra", "edge", "limit", "ties", "room"))


def _taken(sized: DataFrame, rules: DataFrame) -> DataFrame:
    """``sized`` with source_size, target and taken; the rules are few enough in general to be sent to the rows."""
    from pyspark.sql import Window as W

    at, draw, edge, limit = (F.col(c) for c in ("at", "draw", "edge", "limit"))
    joined = sized.join(rules, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")))
    tied = (F.col("extra") > 0) & (at == edge) & (draw == limit)
    first = F.when(F.col("extra") == 0, 0).when((at < edge) | (at == edge) & (draw <= limit), 1).otherwise(0)
    out = joined.withColumn("more", first)
    if rules.where("ties > room").limit(1).count():
        # rows equal in all that the draw is made of, of which only some are taken
        split = F.coalesce(tied & (F.col("ties") > F.col("room")), F.lit(False))
        rank = F.row_number().over(W.partitionBy("source", "size", "draw").orderBy("doc_id"))
        out = out.where(~split).unionByName(joined.where(split).withColumn("more", (rank <= F.col("room")).cast("int")))
    return out.withColumn("taken", (F.col("whole") + F.col("more")) * F.col("size")).drop("p_source", "p_size", "whole", "extra", "edge", "limit", "ties", "room", "more", "at", "draw")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, copies: int = MAX_COPIES, seed: int = 42) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words, repeats counted) for every row of ``docs``.

    Null sources form one source, last in order; null and empty texts have size 0 and take 0; texts of any length are
    counted whole; repeated rows are separate documents, any of which may be the ones taken; null ids keep their rows;
    other columns are ignored; an empty table gives an empty result.  One row for each source meets in one task.
    """
    sized = cut_lineage(_sized(docs, seed))
    return _taken(sized, mix_rules(sized, weights, copies)).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, copies: int = MAX_COPIES, seed: int = 42) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it; all columns, whatever their names, stay as they are."""
    sized = cut_lineage(_sized(docs, seed))
    rows = _taken(_sized(docs, seed, F.struct("*").alias("row")), mix_rules(sized, weights, copies)).where("taken > 0")
    return rows.select(F.explode(F.expr("array_repeat(row, cast(taken / size as int))")).alias("row")).select("row.*")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document; nulls, empty and long texts, ties, repeats and empty tables as ``mix`` says."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("source")
