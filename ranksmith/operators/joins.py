"""Joins with priorities, positions and overrides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def priority_join(left: DataFrame, right: DataFrame, keys: list[tuple[Column, Column]], take: dict[str, str]) -> DataFrame:
    """Left rows with values of the first key that finds a partner, keys in order of priority.

    Each key's right side is made unique first (least values win), so no row multiplies; null keys find nobody.
    """
    out = left
    found = []
    for i, (lk, rk) in enumerate(keys):
        side = right.select(rk.alias(f"_k{i}"), F.struct(*[F.col(c).alias(n) for c, n in take.items()]).alias(f"_v{i}")).where(F.col(f"_k{i}").isNotNull())
        side = side.groupBy(f"_k{i}").agg(F.min(f"_v{i}").alias(f"_v{i}"))
        out = out.withColumn(f"_l{i}", lk).join(side, F.col(f"_l{i}") == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_v{i}"))
    out = out.withColumn("_v", F.coalesce(*found))
    level = reduce(lambda rest, i: F.when(F.col(f"_v{i}").isNotNull(), i + 1).otherwise(rest), range(len(keys) - 1, -1, -1), F.lit(0))
    names = list(take.values())
    return out.withColumn("match_priority", level).select(*left.columns, *[F.col(f"_v.{n}").alias(n) for n in names], "match_priority")


def normalise_reference(ref: Column) -> Column:
    """``REQ-x`` and ``x`` name the same requisition."""
    return F.upper(F.regexp_replace(F.trim(ref), "^(?i)REQ-", ""))


def override(base: DataFrame, better: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Values of ``better`` where it has a row of the key, as a whole; base values elsewhere."""
    b = better.select(*keys, F.struct(*columns).alias("_better"))
    joined = base.join(b, keys, "left")
    return joined.select(*[c for c in base.columns if c not in columns], *[F.when(F.col("_better").isNotNull(), F.col(f"_better.{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def merge_keep_old(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Polled rows merged into known ones; nulls of the poll keep the known value."""
    o, n = old.select(*keys, *columns).alias("o"), new.select(*keys, *columns).alias("n")
    return o.join(n, keys, "left").select(*keys, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in columns])


def positional_labels(items: Column, kind: str) -> Column:
    """Array of struct(id = kind:n, text) with n from 1."""
    return F.transform(items, lambda x, i: F.struct(F.concat(F.lit(kind + ":"), (i + 1).cast("string")).alias("id"), x.alias("text")))


def required_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join in which a row of ``left`` without a partner is an error when it is read, not a row that is lost."""
    marked = left.join(right.withColumn("_found", F.lit(True)), key, "left")
    message = F.concat(F.lit(f"no partner for {key} "), F.col(key).cast("string"))
    return marked.where(F.when(F.col("_found").isNull(), F.raise_error(message).cast("boolean")).otherwise(F.col("_found"))).drop("_found")
