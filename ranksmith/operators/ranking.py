"""Ranking, percentiles, rank history, paging and keep-latest, all as windows or joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ranksmith.session import checkpointed

#: Order of the recommendation levels; an unknown one counts as the last.
LEVELS = {"SHORTLIST": 0, "REVIEW": 1, "CONSIDER": 2, "REJECT": 3}


def level_order(level: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, level), F.lit(LEVELS["REJECT"]))


def rank_keys() -> list[Column]:
    """Not knocked out first, level, final, skills and experience scores and confidence falling, creation time and id rising."""
    return [
        F.col("is_knocked_out").asc_nulls_last(),
        level_order(F.col("recommendation")).asc(),
        *[F.col(c).desc_nulls_last() for c in ("final_score", "skills_score", "experience_score", "confidence")],
        F.col("created_at").asc_nulls_last(),
        F.col("document_id").cast("string").asc_nulls_last(),
    ]


def _percentile(rank: Column, n: Column) -> Column:
    """(N - rank + 1) / N in percent."""
    return F.round((n - rank + 1) / n * 100, 2)


def rank_candidates(scores: DataFrame, project: str = "project_id") -> DataFrame:
    """Adds rank_position and percentile for each project, one window for each; see ``rank_spread`` for huge projects."""
    ranked = scores.withColumn("rank_position", F.row_number().over(W.partitionBy(project).orderBy(*rank_keys())))
    return ranked.withColumn("percentile", _percentile(F.col("rank_position"), F.count("*").over(W.partitionBy(project))))


def leaderboard(scores: DataFrame, n: int, project: str = "project_id") -> DataFrame:
    """The first n of each project.  The rank filter sits right on its window, so every task keeps n rows of a
    project before the shuffle; project sizes come from a grouped count."""
    top = scores.withColumn("rank_position", F.row_number().over(W.partitionBy(project).orderBy(*rank_keys()))).where(F.col("rank_position") <= n)
    sizes = scores.groupBy(project).agg(F.count("*").alias("_n"))
    return top.join(sizes, project).withColumn("percentile", _percentile(F.col("rank_position"), F.col("_n"))).drop("_n")


def rank_spread(scores: DataFrame, project: str = "project_id", parts: int | None = None) -> DataFrame:
    """The columns of ``rank_candidates`` where one project may hold a large share of all rows.

    Rows are dealt by ranges of project and rank order, ranked inside each range, and moved by the number of the
    project's rows in the ranges before; only one count for each project and range meets in a window.
    """
    keys = [F.col(project).asc_nulls_last(), *rank_keys()]
    dealt = scores.repartitionByRange(parts, *keys) if parts else scores.repartitionByRange(*keys)
    dealt = checkpointed(dealt.withColumn("_part", F.spark_partition_id()))
    local = dealt.withColumn("_rank", F.row_number().over(W.partitionBy(project, "_part").orderBy(*rank_keys())))
    counts = dealt.groupBy(project, "_part").agg(F.count("*").alias("_c"))
    w = W.partitionBy(project)
    offsets = counts.select(F.col(project).alias("_project"), F.col("_part").alias("_p"), F.coalesce(F.sum("_c").over(w.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(w).alias("_n"))
    joined = local.join(offsets, F.col(project).eqNullSafe(F.col("_project")) & (F.col("_part") == F.col("_p")))
    rank = (F.col("_rank") + F.col("_before")).cast("int")
    return joined.withColumn("rank_position", rank).withColumn("percentile", _percentile(F.col("rank_position"), F.col("_n"))).drop("_part", "_p", "_rank", "_before", "_n", "_project")


def rank_delta(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """previous_rank and rank_change (previous - current; 0 without a previous rank)."""
    before = previous.select(*keys, F.col("rank_position").alias("previous_rank"))
    return current.join(before, keys, "left").withColumn("rank_change", F.coalesce(F.col("previous_rank") - F.col("rank_position"), F.lit(0)))


def latest_per_group(df: DataFrame, group: list[str], by: list[Column]) -> DataFrame:
    """The first row of each group in the given order, through a grouped maximum-free row number."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*group).orderBy(*by))).where("_rn = 1").drop("_rn")


def escape_like(term: str) -> str:
    """Backslash, percent and underscore stand for themselves."""
    return term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_ci(col: Column, term: str) -> Column:
    return F.contains(F.lower(col), F.lit(term.lower()))


def filter_rankings(df: DataFrame, *, level: str | None = None, low: float | None = None, high: float | None = None, knocked_out: bool | None = None, search: str | None = None, search_in: tuple[str, ...] = ("name", "email")) -> DataFrame:
    """Conjunction of the conditions whose argument is given; the search is a disjunction over columns."""
    if low is not None and high is not None and low > high:
        raise ValueError("the lower bound exceeds the upper one")
    conditions = []
    if level is not None:
        conditions.append(F.col("recommendation") == level)
    if low is not None:
        conditions.append(F.col("final_score") >= low)
    if high is not None:
        conditions.append(F.col("final_score") <= high)
    if knocked_out is not None:
        conditions.append(F.col("is_knocked_out") == knocked_out)
    if search:
        conditions.append(reduce(lambda a, b: a | b, [contains_ci(F.col(c), search) for c in search_in]))
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


#: The fields that a reader may sort by.
SORTABLE = frozenset({"rank_position", "final_score", "skills_score", "experience_score", "confidence", "created_at"})


def page(df: DataFrame, sort: str, descending: bool, number: int, size: int, tie: list[str]) -> DataFrame:
    """One page in a total order; nulls last when rising, first when falling."""
    if sort not in SORTABLE:
        raise ValueError(f"cannot sort by {sort}")
    first = F.col(sort).desc_nulls_first() if descending else F.col(sort).asc_nulls_last()
    return df.orderBy(first, *[F.col(t).asc() for t in tie]).offset((number - 1) * size).limit(size)


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def diversify(df: DataFrame, group: list[str], kind: str, order: list[Column], limit: Column | int) -> DataFrame:
    """Best row first, then rounds over the kinds in order of first appearance, up to ``limit`` rows of a group."""
    w = W.partitionBy(*group)
    ranked = df.withColumn("_pos", F.row_number().over(w.orderBy(*order)))
    ranked = ranked.withColumn("_first", F.min("_pos").over(W.partitionBy(*group, kind)))
    ranked = ranked.withColumn("_round", F.row_number().over(W.partitionBy(*group, kind, F.col("_pos") == 1).orderBy("_pos")))
    out = ranked.withColumn("pick", F.row_number().over(w.orderBy((F.col("_pos") == 1).desc(), "_round", "_first")))
    return out.where(F.col("pick") <= limit).drop("_pos", "_first", "_round")
