"""Array functions that keep order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(c: Column, f) -> Column:
    """``f`` of a column that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def ordered_distinct(a: Column) -> Column:
    """First spelling of each value, compared without case, in order; nulls stay."""
    first = lambda v, k: F.filter(v, lambda x, i: x.isNull() | (F.array_position(k, F.get(k, i)) == i + 1))
    # the list, and each value's lower case, are made once
    return once(a.cast("array<string>"), lambda v: once(F.transform(v, F.lower), lambda k: first(v, k)))


def distinct_by_canonical(a: Column, canonical: Column) -> Column:
    """First surface form of each canonical key; both arrays run side by side."""
    pairs = F.zip_with(a, canonical, lambda s, k: F.struct(s.alias("s"), k.alias("k")))
    empty = F.array().cast("array<struct<s:string,k:string>>")
    kept = F.aggregate(pairs, empty, lambda acc, x: F.when(F.exists(acc, lambda y: y["k"] == x["k"]), acc).otherwise(F.array_append(acc, x)))
    return F.transform(kept, lambda x: x["s"])


def union_ordered(a: Column, b: Column) -> Column:
    return ordered_distinct(F.concat(a, b))


def drop_subsumed(a: Column) -> Column:
    """Without items that a longer item contains, case aside."""
    return F.filter(a, lambda d: ~F.exists(a, lambda o: F.contains(F.lower(o), F.lower(d)) & (o != d) & (F.length(o) > F.length(d))))


def sorted_unique(a: Column) -> Column:
    return F.sort_array(F.array_distinct(a))


def longest_first(a: Column) -> Column:
    return F.array_sort(a, lambda x, y: F.when(F.length(x) > F.length(y), -1).when(F.length(x) < F.length(y), 1).when(x < y, -1).when(x > y, 1).otherwise(0))


def first_where(a: Column, predicate) -> Column:
    return F.try_element_at(F.filter(a, predicate), F.lit(1))


def overlap_ratio(required: Column, found: Column) -> Column:
    return F.when(F.size(required) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(required, found)) / F.size(required))


def merge_records(primary: Column, recovery: Column, key: str, fields: list[str]) -> Column:
    """Structs of both arrays by ``key`` without case: primary first, its null fields filled from its namesake, then new ones."""
    same = lambda x, y: F.lower(x[key]) == F.lower(y[key])

    def fill(x):
        other = F.try_element_at(F.filter(recovery, lambda y: same(x, y)), F.lit(1))
        return F.struct(*[F.coalesce(x[f], other[f]).alias(f) for f in fields])

    fresh = F.filter(recovery, lambda y: ~F.exists(primary, lambda x: same(x, y)))
    return F.concat(F.transform(primary, fill), F.transform(fresh, lambda y: F.struct(*[y[f].alias(f) for f in fields])))


def distinct_by(a: Column, *fields: str) -> Column:
    """First struct of each combination of fields, in order."""
    same = lambda x, y: F.struct(*[x[f] for f in fields]) == F.struct(*[y[f] for f in fields])
    return F.filter(a, lambda x, i: ~F.exists(F.slice(a, 1, i), lambda y: same(x, y)))


def in_category(x: Column, categories: dict[str, tuple[str, ...]], name: Column) -> Column:
    """Whether a value is a member of the named category, case aside; unknown categories have none."""
    lookup = F.create_map(*[c for k, v in categories.items() for c in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.array_contains(F.try_element_at(lookup, F.lower(name)), F.lower(x)), F.lit(False))


def merged_map(base: Column, overrides: Column) -> Column:
    """Keys of both maps, values of ``overrides`` first."""
    kept = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(overrides), k))
    return F.map_concat(kept, overrides)


def without_keys(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, v: ~k.isin(*keys))
