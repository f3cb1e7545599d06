"""Mutations of plain tables as joins: each returns the table's next state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new, keys, "left_anti").unionByName(new)


def partial_upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """As upsert, but a null in a new row keeps the old value."""
    rest = [c for c in old.columns if c not in keys]
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, keys, "full_outer")
    return joined.select(*keys, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in rest])


def replace_group(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """Groups that occur in ``new`` are replaced as a whole."""
    return old.join(new.select(group).distinct(), group, "left_anti").unionByName(new)


def removed_by_replace(old: DataFrame, new: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """Rows of replaced groups whose key is absent from the new set."""
    return old.join(new.select(group).distinct(), group, "left_semi").join(new, [group, *keys], "left_anti")


def soft_delete(df: DataFrame, where, at=None) -> DataFrame:
    stamp = F.current_timestamp() if at is None else at
    return df.withColumn("deleted_at", F.when(where & F.col("deleted_at").isNull(), stamp).otherwise(F.col("deleted_at")))


def restore(df: DataFrame, where) -> DataFrame:
    return df.withColumn("deleted_at", F.when(where, F.lit(None)).otherwise(F.col("deleted_at")))


def cascade_delete(parents: DataFrame, children: dict[str, tuple[DataFrame, str]], key: str, gone: DataFrame) -> dict[str, DataFrame]:
    """Parents without the ``gone`` keys, and every child table without rows that point to them."""
    out = {"parents": parents.join(gone, key, "left_anti")}
    for name, (df, column) in children.items():
        out[name] = df.join(gone.withColumnRenamed(key, column), column, "left_anti")
    return out


def transition(df: DataFrame, where, **values) -> DataFrame:
    for column, value in values.items():
        df = df.withColumn(column, F.when(where, F.lit(value)).otherwise(F.col(column)))
    return df


#: An archived project stays archived or becomes active again.
ALLOWED_TRANSITIONS = {("DRAFT", "ACTIVE"), ("DRAFT", "ARCHIVED"), ("ACTIVE", "COMPLETED"), ("ACTIVE", "ARCHIVED"), ("ACTIVE", "DRAFT"), ("COMPLETED", "ACTIVE"), ("COMPLETED", "ARCHIVED"), ("ARCHIVED", "ACTIVE")}


def may_move(old, new):
    """Whether a project's status may change so; staying is allowed."""
    pairs = [(old == a) & (new == b) for a, b in sorted(ALLOWED_TRANSITIONS)]
    ok = old == new
    for p in pairs:
        ok = ok | p
    return ok


def drop_duplicate_files(df: DataFrame, keys: tuple[str, ...] = ("project_id", "file_hash", "document_type"), order: str = "created_at") -> DataFrame:
    """Keeps the earliest of rows that share project, content hash and type."""
    first = df.groupBy(*keys).agg(F.min(F.struct(order, "id")).alias("_first"))
    return df.join(first.select(F.col("_first.id").alias("id")), "id", "left_semi")
