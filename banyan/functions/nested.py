"""Nested values: fallbacks over paths, pruning, maps to rows, ordered lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def at_path(df: DataFrame, *paths: str) -> Column:
    """The first value that is there, of the paths that the schema has."""

    def has(path: str) -> bool:
        kind: T.DataType = df.schema
        for part in path.split("."):
            if not isinstance(kind, T.StructType) or part not in kind.names:
                return False
            kind = kind[part].dataType
        return True

    found = [F.col(p) for p in paths if has(p)]
    return F.coalesce(*found) if found else F.lit(None)


def without_fields(struct: str, kind: T.StructType, words: tuple[str, ...]) -> Column:
    """The struct without fields whose name holds one of the words, at any depth."""

    def prune(c: Column, k: T.DataType) -> Column:
        if isinstance(k, T.StructType):
            keep = [f for f in k.fields if not any(w in f.name.lower() for w in words)]
            return F.struct(*(prune(c[f.name], f.dataType).alias(f.name) for f in keep))
        if isinstance(k, T.ArrayType) and isinstance(k.elementType, T.StructType):
            return F.transform(c, lambda x: prune(x, k.elementType))
        return c

    return prune(F.col(struct), kind)


def map_without(c: Column, words: tuple[str, ...]) -> Column:
    """The map without keys that hold one of the words."""
    return F.map_filter(c, lambda k, _: ~reduce(lambda a, b: a | b, (F.lower(k).contains(w) for w in words)))


def merge_maps(maps: Column) -> Column:
    """One map of an array of maps; of equal keys the last holds."""
    entries = F.flatten(F.transform(maps, F.map_entries))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"].alias("value"))))


def first_list(*lists: Column) -> Column:
    """The first of the arrays that has an entry."""
    return F.coalesce(*(F.when(F.size(x) > 0, x) for x in lists))


def flags(df: DataFrame, key: str, m: str) -> DataFrame:
    """(key, name, flag) of a map of booleans: 1 for true, 0 for false or null."""
    return df.select(key, F.explode(m).alias("name", "v")).select(key, "name", F.coalesce(F.col("v"), F.lit(False)).cast("int").alias("flag"))


def ordered_unique(a: Column, b: Column, n: int) -> Column:
    """The first n of both, each once, in order."""
    return F.array_distinct(F.concat(F.slice(a, 1, n), F.slice(b, 1, n)))


def labelled(points: Column, labels: dict[str, str]) -> list[Column]:
    """Columns of an array of (label, value) by their labels."""
    m = F.map_from_entries(points)
    return [F.try_element_at(m, F.lit(label)).alias(name) for name, label in labels.items()]


def templates(df: DataFrame, keep: list[str], rows: list[tuple[str, ...]], names: list[str]) -> DataFrame:
    """Each row once for each template."""
    t = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r))) for r in rows))
    return df.select(*keep, F.explode(t).alias("t")).select(*keep, "t.*")


def clamp_signal(signal: Column, up: Column, least: float, down: Column, most: float) -> Column:
    """At least `least` where up holds, else at most `most` where down holds."""
    return F.when(up, F.greatest(signal, F.lit(least))).when(down, F.least(signal, F.lit(most))).otherwise(signal)
