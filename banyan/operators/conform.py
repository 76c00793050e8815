"""Conforming several sources: duplicates by rule, joins on deduplicated sides, precedence, incremental appends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pick(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the order; the window keeps one row a group while it sorts."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def ordinal(df: DataFrame, keys: list[str], order: str, name: str, block: int = 1 << 16) -> DataFrame:
    """df with the number of each row within its key, by a whole-number order: counted by block of order numbers first, so a hot key is many tasks."""
    d = df.withColumn("__block", F.floor(F.col(order) / block))
    n = d.groupBy(*keys, "__block").agg(F.count("*").alias("__n"))
    before = n.withColumn("__before", F.coalesce(F.sum("__n").over(W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    on = reduce(lambda a, b: a & b, (F.col(f"d.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, "__block")))
    j = d.alias("d").join(before.alias("b"), on).select("d.*", "__before")
    return j.withColumn(name, F.row_number().over(W.partitionBy(*keys, "__block").orderBy(order)) + F.col("__before")).drop("__block", "__before")


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return pick(df, keys, F.asc(order))


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return pick(df, keys, F.desc(order))


def argmin(df: DataFrame, keys: list[str], rank: Column, score: Column, distance: Column, order: str) -> DataFrame:
    """The row with the lowest (rank, -score, distance): nulls count as 9999, 0 and 999999; then the first."""
    return pick(df, keys, F.coalesce(rank, F.lit(9999)).asc(), F.coalesce(score, F.lit(0)).desc(), F.coalesce(distance, F.lit(999999)).asc(), F.asc(order))


def left_last_wins(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    return left.join(last_wins(right, keys, order).drop(order), keys, "left")


def append_unseen(history: DataFrame, new: DataFrame, signature: list[str]) -> DataFrame:
    """The rows of new whose signature is not in history, once each; nulls are equal."""
    n, h = new.dropDuplicates(signature).alias("n"), history.select(*signature).distinct().alias("h")
    on = reduce(lambda a, b: a & b, (F.col(f"n.{c}").eqNullSafe(F.col(f"h.{c}")) for c in signature))
    return n.join(h, on, "left_anti")


def by_priority(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The union of the sources, each key from the first source that has it."""
    tagged = [p.withColumn("__src", F.lit(i)) for i, p in enumerate(parts)]
    return pick(reduce(DataFrame.unionByName, tagged), keys, F.asc("__src")).drop("__src")


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with an `error` that names the first broken rule)."""
    error = F.coalesce(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()))
    tagged = df.withColumn("error", error)
    return tagged.filter("error is null").drop("error"), tagged.filter("error is not null")


def by_column(keys: list[str], sources: dict[str, DataFrame], chains: dict[str, list[tuple[str, str]]], defaults: dict[str, object] | None = None) -> DataFrame:
    """One row a key of any source: each column by its own chain of (source, column), the first value that is there, then its default.

    Each source has one row a key; blank text counts as missing.
    """
    every = reduce(DataFrame.union, (d.select(*keys) for d in sources.values())).distinct()
    for n, d in sources.items():
        used = sorted({c for chain in chains.values() for s, c in chain if s == n})
        every = every.join(d.select(*keys, *(F.col(c).alias(f"__{n}_{c}") for c in used)), keys, "left")
    types = {n: dict(d.dtypes) for n, d in sources.items()}

    def value(n: str, c: str) -> Column:
        v = F.col(f"__{n}_{c}")
        return F.when(F.trim(v) != "", v) if types[n][c] == "string" else v

    out = []
    for name, chain in chains.items():
        parts = [value(n, c) for n, c in chain]
        if defaults and name in defaults:
            parts.append(F.lit(defaults[name]))
        out.append(F.coalesce(*parts).alias(name))
    return every.select(*keys, *out)


def tagged_union(parts: list[tuple[DataFrame, str, str, Column]], key: str) -> DataFrame:
    """(key, type, value, source) of parts (table, type, source, list of values); of equal values of a type, without regard to case, the first part holds."""
    rows = [d.select(key, F.lit(kind).alias("type"), F.explode(values).alias("value"), F.lit(source).alias("source"), F.lit(i).alias("__part")) for i, (d, kind, source, values) in enumerate(parts)]
    u = reduce(DataFrame.unionByName, rows).withColumn("value", F.trim("value")).filter(F.col(key).isNotNull() & (F.col("value") != ""))
    best = u.groupBy(key, "type", F.lower("value").alias("__v")).agg(F.min(F.struct("__part", "value", "source")).alias("x"))
    return best.select(key, "type", "x.value", "x.source")


def join_suffixed(left: DataFrame, right: DataFrame, keys: list[str], order: str, suffix: str) -> DataFrame:
    """left with the first row of right for each key; columns that both have get the suffix on the right."""
    r = first_wins(right, keys, order).drop(order)
    r = r.select(*keys, *(F.col(c).alias(f"{c}{suffix}" if c in left.columns else c) for c in r.columns if c not in keys))
    return left.join(r, keys, "left")
