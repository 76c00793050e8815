"""Pattern filters, sub-graphs and neighbours, as semi-joins and joins of aggregated branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from banyan.graph.build import undirected


def having(nodes: DataFrame, key: str, edges: DataFrame, target: Column) -> DataFrame:
    """The nodes that have an edge (key, ...) which fulfils target: one semi-join for each constraint."""
    return nodes.join(edges.filter(target).select(key), key, "left_semi")


def top(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    return df.orderBy(F.col(score).desc_nulls_last(), F.col(key).asc()).limit(k)


def distinct_list(df: DataFrame, key: str, value: str, n: int | None = None, name: str | None = None) -> DataFrame:
    """The sorted distinct values of each key, the first n of them."""
    v = F.sort_array(F.collect_set(value))
    return df.groupBy(key).agg((F.slice(v, 1, n) if n else v).alias(name or value))


def star(centre: DataFrame, key: str, branches: list[DataFrame]) -> DataFrame:
    """The nodes with one column for each branch; branches are aggregated before the join, so rows do not multiply."""
    for b in branches:
        centre = centre.join(b, key, "left")
    return centre


def neighbours(seeds: DataFrame, edges: DataFrame, weight: str, k: int, a: str = "a", b: str = "b") -> DataFrame:
    """(node, weight): the k strongest neighbours of the seeds over edges in both directions; may hold seeds."""
    e = undirected(edges.select(a, b, weight), a, b).join(seeds.select(F.col(seeds.columns[0]).alias(a)).distinct(), a, "left_semi")
    n = e.groupBy(F.col(b).alias("node")).agg(F.max(weight).alias(weight))
    return n.orderBy(F.desc(weight), F.asc("node")).limit(k)


def first_n(df: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= n)
