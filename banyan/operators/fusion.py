"""Fusion of ranked lists, and measures of retrieval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K = 60


def rrf(rank: Column, k: int = RRF_K) -> Column:
    return F.lit(1.0) / (F.lit(k) + rank)


def ranked(hits: DataFrame, score: str, key: str) -> DataFrame:
    """hits with a rank by score; hits are the short list of a search, so one window may hold them."""
    return hits.withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), F.asc(key))))


def evidence(texts: DataFrame, key: str, score: str, text: str, n: int = 3) -> DataFrame:
    """(key, best, evidence): the greatest score and the first n texts in the order of score."""
    top = texts.withColumn("__rn", F.row_number().over(W.partitionBy(key).orderBy(F.desc(score), F.asc(text))))
    return top.groupBy(key).agg(F.max(score).alias("best"), F.transform(F.sort_array(F.collect_list(F.when(F.col("__rn") <= n, F.struct("__rn", F.col(text).alias("t"))))), lambda x: x["t"]).alias("evidence"))


def fuse_rrf(key: str, lists: dict[str, DataFrame], text_best: DataFrame | None = None, ratings: DataFrame | None = None, k: int = RRF_K) -> DataFrame:
    """(key, score, flags): reciprocal ranks summed over the lists, a bonus of best text score / (k + 1) and of rating / 5 / (k + 1)."""
    parts = [d.select(key, rrf(F.col("rank"), k).alias("s"), F.lit(n).alias("flag")) for n, d in lists.items()]
    if text_best is not None:
        parts.append(text_best.select(key, (F.col("best") / (k + 1)).alias("s"), F.lit("text").alias("flag")))
    f = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.sum("s").alias("score"), F.array_join(F.sort_array(F.collect_set("flag")), "|").alias("flags"))
    if ratings is not None:
        f = f.join(ratings, key, "left").withColumn("score", F.col("score") + F.coalesce("rating", F.lit(0.0)) / 5.0 / (k + 1)).drop("rating")
    return f


#: The weights of the weighted fusion.
WEIGHTS = {"graph": 0.22, "neighbour": 0.12, "vector": 0.26, "text": 0.20, "attributes": 0.10, "rating": 0.10}


def fuse_weighted(key: str, parts: dict[str, DataFrame], ratings: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(key, score): weighted sum of the best score in each list and the rating scaled by the candidates' least and greatest."""
    long = reduce(DataFrame.unionByName, (d.select(key, F.lit(n).alias("part"), F.col("score").cast("double").alias("s")) for n, d in parts.items()))
    wide = long.groupBy(key).agg(*(F.coalesce(F.max(F.when(F.col("part") == n, F.col("s"))), F.lit(0.0)).alias(n) for n in parts))
    wide = wide.join(ratings, key, "left")
    bounds = wide.agg(F.min("rating").alias("lo"), F.max("rating").alias("hi"))
    wide = wide.crossJoin(F.broadcast(bounds))  # one row
    scaled = (F.coalesce("rating", F.lit(0.0)) - F.coalesce("lo", F.lit(0.0))) / (F.coalesce("hi", F.lit(5.0)) - F.coalesce("lo", F.lit(0.0)) + 1e-9)
    score = sum((F.lit(weights[n]) * F.col(n) for n in parts), F.lit(0.0)) + F.lit(weights["rating"]) * scaled
    return wide.select(key, score.alias("score"))


def attribute_match(attributes: DataFrame, key: str, required: tuple[str, ...]) -> DataFrame:
    """(key, score): the mean of (score + 1) / 2 over the required attributes, a missing one counts 0; 0.5 where none is required."""
    if not required:
        return attributes.select(key).distinct().withColumn("score", F.lit(0.5))
    s = attributes.groupBy(key).agg(*(F.max(F.when(F.col("attribute") == a, F.col("value"))).alias(f"__{i}") for i, a in enumerate(required)))
    return s.select(key, (sum((F.greatest(F.lit(0.0), (F.coalesce(F.col(f"__{i}"), F.lit(-1.0)) + 1) / 2) for i in range(len(required))), F.lit(0.0)) / len(required)).alias("score"))


def metrics_of_hits(good: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """(query, recall, mrr, ndcg) at k of the relevant hits (query, rank) and the number n of relevant items of each query."""
    g = good.filter(F.col("rank") <= k).groupBy("query").agg(F.count("*").alias("found"), F.min("rank").alias("first"), F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    m = totals.filter("n > 0").join(g, "query", "left")
    return m.select("query", F.coalesce(F.col("found") / F.col("n"), F.lit(0.0)).alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"))


def retrieval_metrics(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query, recall, mrr, ndcg) at k of hits (query, item, rank) and relevant (query, item); queries without a hit get zeros."""
    rel = relevant.distinct()
    return metrics_of_hits(hits.join(rel, ["query", "item"]), rel.groupBy("query").agg(F.count("*").alias("n")), k)
