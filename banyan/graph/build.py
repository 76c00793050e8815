"""Nodes, edges and triples from tables; upserts and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banyan.operators.conform import pick


def nodes_of(df: DataFrame, node_id: Column, label: str, name: Column, properties: Column) -> DataFrame:
    """Node rows of a table; rows without an id are left out."""
    return df.select(node_id.alias("node_id"), F.lit(label).alias("label"), name.cast("string").alias("name"), properties.alias("properties")).filter("node_id is not null")


def edges_of(df: DataFrame, source: Column, relation: str, target: Column, properties: Column | None = None, order: Column | None = None) -> DataFrame:
    """Edge rows of a table; `order` (a whole number) tells which of equal edges is the last."""
    p = F.lit("{}") if properties is None else properties
    n = F.lit(0) if order is None else order
    e = df.select(source.alias("source_id"), F.lit(relation).alias("relation"), target.alias("target_id"), p.alias("properties"), n.cast("bigint").alias("ord"))
    return e.filter("source_id is not null and target_id is not null")


def all_nodes(families: list[DataFrame]) -> DataFrame:
    """The union of node families; of equal ids the last family holds, within it the greatest properties."""
    tagged = [f.withColumn("__fam", F.lit(i)) for i, f in enumerate(families)]
    return pick(reduce(DataFrame.unionByName, tagged), ["node_id"], F.desc("__fam"), F.desc("properties"), F.desc("name")).drop("__fam")


def all_edges(families: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, families)


def last_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (source, relation, target), with the properties of the last."""
    if "ord" not in edges.columns:
        edges = edges.withColumn("ord", F.lit(0).cast("bigint"))
    return edges.groupBy("source_id", "relation", "target_id").agg(F.max_by("properties", F.struct("ord", "properties")).alias("properties"), F.max("ord").alias("ord"))


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges both of whose ends exist, one for each (source, relation, target), with the last properties."""
    ids = nodes.select("node_id")
    e = last_edges(edges).join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi")
    return e.join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi").select("source_id", "relation", "target_id", "properties")


def upsert_edges(existing: DataFrame, changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """The stored edges with the changes whose ends exist; a change replaces the properties of an equal edge."""
    both = existing.select("source_id", "relation", "target_id", "properties", F.lit(-1).cast("bigint").alias("ord")).unionByName(changes)
    return connected(both, nodes)


def triples(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source_id").alias("subject"), F.col("relation").alias("predicate"), F.col("target_id").alias("object"), "properties")


def undirected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Both directions of each edge."""
    rest = [c for c in edges.columns if c not in (a, b)]
    return edges.unionByName(edges.select(F.col(b).alias(a), F.col(a).alias(b), *rest))
