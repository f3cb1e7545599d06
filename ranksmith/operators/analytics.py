"""Aggregates of projects, stages, skills and funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

STAGES = ("ingested", "parsed", "extracted", "normalized", "scored", "ranked")


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """part / whole in percent; an empty whole gives 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part * 100 / whole, digits))


def project_statistics(scores: DataFrame) -> DataFrame:
    """Counts and score statistics of each project; an empty project's statistics are 0."""
    score = F.col("final_score")
    return scores.groupBy("project_id").agg(
        F.count("*").alias("n_candidates"),
        F.coalesce(F.round(F.avg(F.round(score * 100).cast("long")) / 100, 2), F.lit(0.0)).alias("avg_score"),
        F.coalesce(F.max(score), F.lit(0.0)).alias("max_score"),
        F.coalesce(F.min(score), F.lit(0.0)).alias("min_score"),
        F.count_if(F.col("is_knocked_out")).alias("n_knocked_out"),
    )


def level_distribution(scores: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """One column for each level; levels without candidates count 0."""
    return scores.groupBy("project_id").agg(*[F.count_if(F.col("recommendation") == v).alias(v.lower()) for v in levels])


def pipeline_status(counts: DataFrame) -> DataFrame:
    """Completion in percent over six stages, the first incomplete stage and the completed ones."""
    total = F.col("total")
    done = sum((F.col(s) for s in STAGES), F.lit(0))
    first = F.coalesce(*[F.when(F.col(s) < total, F.lit(s)) for s in STAGES], F.lit("complete"))
    finished = F.array_join(F.filter(F.array(*[F.when((total > 0) & (F.col(s) >= total), F.lit(s)) for s in STAGES]), lambda x: x.isNotNull()), ",")
    return counts.withColumn("completion", percent(done, total * len(STAGES))).withColumn("current_stage", first).withColumn("completed_stages", finished)


def item_frequency(items: DataFrame, item: str, owner: str, limit: int) -> DataFrame:
    """Owners for each item, their share in percent of all owners, the commonest first, ties by name."""
    n = items.select(owner).distinct().agg(F.count("*").alias("n_owners"))
    counted = items.dropDuplicates([owner, item]).groupBy(item).agg(F.count("*").alias("n"))
    top = counted.orderBy(F.col("n").desc(), F.col(item)).limit(limit)
    return top.join(F.broadcast(n)).withColumn("share", percent(F.col("n"), F.col("n_owners")))  # one row


def argmax_label(counts: dict[str, Column]) -> Column:
    """Label of the greatest count, the first among equals; null when all are 0."""
    best = F.greatest(*counts.values()) if len(counts) > 1 else next(iter(counts.values()))
    return F.when(best > 0, F.coalesce(*[F.when(c == best, F.lit(k)) for k, c in counts.items()]))


def share_of_total(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    w = W.partitionBy(*(F.col(b) for b in by or [])) if by else W.partitionBy(F.lit(0))
    return df.withColumn(out, percent(F.col(value), F.sum(value).over(w)))


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds from ``start`` to ``end``, at least 0."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.round(F.greatest(F.lit(0.0), micros / 1000000), 2)


def weights_total(weights: DataFrame) -> DataFrame:
    """Sum of rounded weights and whether it is 100."""
    return weights.agg(F.sum(F.round("weight")).cast("long").alias("total")).withColumn("valid", F.col("total") == 100)
