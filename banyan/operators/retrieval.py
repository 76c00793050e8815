"""Hybrid retrieval for a table of questions: intent by rules, graph filter, vector search, neighbours, text evidence, rank fusion.

All steps take (query, ...) rows, so any number of questions is one job. Rankings are windows over a query's hits, and hits are few a query.

Defined results: questions without text have no intent, and without a vector no vector hits; an intent that asks for nothing filters nothing; a question whose
candidates are empty takes text hits of all stores; ties go to the smaller key; null ratings count 0 and rank last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from banyan.operators import fusion, vector
from banyan.session import durable


def _ranked(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)


def phrases(questions: DataFrame, most: int = 6) -> DataFrame:
    """(query, phrase, at) of all runs of up to `most` words of the normalised text `x`."""
    w = questions.select("query", F.filter(F.split("x", r"[^\p{L}\p{N}]+"), lambda v: v != "").alias("w"))
    size = F.size("w")
    runs = F.transform(F.sequence(F.lit(1), size), lambda at: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), size - at + 1)), lambda n: F.array_join(F.slice("w", at, n), " ")))
    # outer, since a filter on the size of the runs would make them twice
    return w.select("query", F.explode_outer(F.when(size > 0, F.flatten(runs))).alias("phrase")).filter("phrase is not null").distinct()


def mentioned(questions: DataFrame, vocabulary: DataFrame, name: str) -> DataFrame:
    """(query, name) of each vocabulary entry whose words stand in a question; an equality join, whatever the size of the vocabulary."""
    key = F.array_join(F.filter(F.split(F.lower(name), r"[^\p{L}\p{N}]+"), lambda v: v != ""), " ")
    v = vocabulary.select(name).filter(F.col(name).isNotNull()).distinct().withColumn("phrase", key).filter("phrase <> ''")
    return phrases(questions).join(v, "phrase").select("query", name).distinct()


def intents(questions: DataFrame, districts: DataFrame, categories: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """(query, kind, value): a question's constraints: the first district by name, all categories, and the attributes that its words stand for."""
    d = mentioned(questions, districts, "district").groupBy("query").agg(F.min("district").alias("value")).withColumn("kind", F.lit("district"))
    c = mentioned(questions, categories, "category").select("query", F.col("category").alias("value"), F.lit("category").alias("kind"))
    hits = F.array_distinct(F.array_compact(F.array(*(F.when(F.col("x").contains(w), F.lit(a)) for w, a in aliases.items()))))
    a = questions.select("query", F.explode(hits).alias("value"), F.lit("attribute").alias("kind"))
    return d.unionByName(c).unionByName(a).select("query", "kind", "value")


def override(rules: DataFrame, given: DataFrame) -> DataFrame:
    """The constraints of rules, where a given (query, kind, value) replaces all of its kind; blank values replace nothing."""
    g = given.filter(F.trim("value") != "")
    return rules.join(g.select("query", "kind").distinct(), ["query", "kind"], "left_anti").unionByName(g)


def graph_hits(questions: DataFrame, wanted: DataFrame, stores: DataFrame, categories: DataFrame, attributes: DataFrame, k: int, least: float = 0.15) -> DataFrame:
    """(query, store_id, rank): stores that meet all constraints, the best rated first.

    stores has (store_id, rating, district), categories (store_id, category), attributes (store_id, attribute, score). A store stands where it meets as many
    as its question has: the district, any of the categories, each attribute. Questions that ask for the same are one, and stores of the same district,
    categories and attributes stand or fall together, so the k best of each such profile meet the distinct demands, by equality joins.
    """
    order = [F.desc_nulls_last("rating"), F.asc("store_id")]
    kind = F.col("kind")
    asks = wanted.groupBy("query").agg(
        F.sort_array(F.collect_set(F.when(kind == "district", F.col("value")))).alias("ds"), F.sort_array(F.collect_set(F.when(kind == "category", F.col("value")))).alias("cs"), F.sort_array(F.collect_set(F.when(kind == "attribute", F.col("value")))).alias("at"),
        F.coalesce(F.bool_or(kind == "district"), F.lit(False)).alias("d"), F.coalesce(F.bool_or(kind == "category"), F.lit(False)).alias("c"), F.coalesce(F.bool_or(~kind.isin("district", "category", "attribute")), F.lit(False)).alias("o"),
    )
    asks = durable(asks.withColumn("sig", F.to_json(F.struct("ds", "cs", "at", "d", "c", "o"))))
    tag = lambda t, c: F.concat(F.lit(t), c)
    anchors = F.when(F.col("d"), F.transform("ds", lambda x: tag("d ", x))).when(F.col("c"), F.transform("cs", lambda x: tag("c ", x))).otherwise(F.transform(F.slice("at", 1, 1), lambda x: tag("a ", x)))
    sigs = asks.filter("not o").select("sig", "cs", "at", "c", anchors.alias("anchors")).dropDuplicates(["sig"]).withColumn("anchor", F.explode("anchors")).drop("anchors")
    none = F.array().cast("array<string>")
    traits = stores.select("store_id", "rating", "district").join(categories.groupBy("store_id").agg(F.sort_array(F.collect_set("category")).alias("pc")), "store_id", "left")
    traits = traits.join(attributes.filter(F.col("score") >= least).groupBy("store_id").agg(F.sort_array(F.collect_set("attribute")).alias("pa")), "store_id", "left")
    traits = durable(traits.withColumns({"pc": F.coalesce("pc", none), "pa": F.coalesce("pa", none)}))

    def profiles(d: DataFrame, by: list[str], anchor: Column) -> DataFrame:
        top = d.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= k)
        return top.select("store_id", "rating", "pc", "pa", F.explode(anchor).alias("anchor"))

    here = profiles(traits.filter("district is not null"), ["district", "pc", "pa"], F.array(tag("d ", F.col("district"))))
    any_ = profiles(traits, ["pc", "pa"], F.concat(F.transform("pc", lambda x: tag("c ", x)), F.transform("pa", lambda x: tag("a ", x))))
    met = sigs.join(here.unionByName(any_), "anchor").filter((~F.col("c") | F.arrays_overlap("cs", "pc")) & (F.size(F.array_except("at", "pa")) == 0))
    best = met.select("sig", "store_id", "rating").distinct().withColumn("rank", F.row_number().over(W.partitionBy("sig").orderBy(*order))).filter(F.col("rank") <= k)
    full = asks.select("query", "sig").join(best, "sig").select("query", "store_id", "rank")
    free = questions.select("query").join(asks, "query", "left_anti")
    top = stores.select("store_id", "rating").orderBy(*order).limit(k)  # the same for all questions that ask for nothing: at most k rows
    return full.unionByName(_ranked(free.crossJoin(F.broadcast(top)), k, *order).select("query", "store_id", "rank"))


def seeds(first: DataFrame, second: DataFrame, n: int = 3) -> DataFrame:
    """Distinct (query, store_id) of the first n of both rankings."""
    return first.unionByName(second).filter(F.col("rank") <= n).select("query", "store_id").distinct()


def expand(seed: DataFrame, edges: DataFrame, ratings: DataFrame, k: int) -> DataFrame:
    """(query, store_id, sim, rank): the neighbours of the seeds over edges (a, b, sim) in both directions, by similarity, then rating; may hold seeds."""
    both = edges.select("a", "b", "sim").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    n = seed.join(both, F.col("store_id") == F.col("a")).groupBy("query", F.col("b").alias("store_id")).agg(F.max("sim").alias("sim"))
    return _ranked(n.join(ratings, "store_id", "left"), k, F.desc("sim"), F.desc_nulls_last("rating"), F.asc("store_id")).select("query", "store_id", "sim", "rank")


def in_scope(hits: DataFrame, scope: DataFrame) -> DataFrame:
    """The hits (query, store_id, ...) whose store is in the question's scope; questions without a scope keep all. The scope holds after the limit."""
    some = scope.select("query").distinct().withColumn("__some", F.lit(True))
    ok = scope.select("query", "store_id").distinct().withColumn("__in", F.lit(True))
    return hits.join(some, "query", "left").join(ok, ["query", "store_id"], "left").filter("__some is null or __in").drop("__some", "__in")


def fuse(lists: dict[str, DataFrame], texts: DataFrame | None, ratings: DataFrame, k: int, rrf_k: int = fusion.RRF_K) -> DataFrame:
    """(query, store_id, score, flags, evidence, rank): reciprocal ranks summed over lists (query, store_id, rank), the best text score and the rating as bonus.

    texts has (query, store_id, unit, score); evidence holds the first three units of a store.
    """
    parts = [d.select("query", "store_id", fusion.rrf(F.col("rank"), rrf_k).alias("s"), F.lit(n).alias("flag"), F.array().cast("array<bigint>").alias("evidence")) for n, d in lists.items()]
    if texts is not None:
        w = W.partitionBy("query", "store_id").orderBy(F.desc("score"), F.asc("unit"))
        t = texts.withColumn("rn", F.row_number().over(w)).groupBy("query", "store_id").agg(F.max("score").alias("best"), F.sort_array(F.collect_list(F.when(F.col("rn") <= 3, F.struct("rn", "unit")))).alias("e"))
        parts.append(t.select("query", "store_id", (F.col("best") / (rrf_k + 1)).alias("s"), F.lit("text").alias("flag"), F.transform("e", lambda x: x["unit"]).alias("evidence")))
    f = reduce(DataFrame.unionByName, parts).groupBy("query", "store_id").agg(F.sum("s").alias("s"), F.array_join(F.sort_array(F.collect_set("flag")), "|").alias("flags"), F.max("evidence").alias("evidence"))
    f = f.join(ratings, "store_id", "left").withColumn("score", F.round(F.col("s") + F.coalesce("rating", F.lit(0.0)) / 5.0 / (rrf_k + 1), 8))
    return _ranked(f, k, F.desc("score"), F.asc("store_id")).select("query", "store_id", "score", "flags", "evidence", "rank")


def retrieve(questions: DataFrame, wanted: DataFrame, stores: DataFrame, categories: DataFrame, attributes: DataFrame, store_vectors: DataFrame, units: DataFrame, vectors: DataFrame, edges: DataFrame, k: int = 5) -> dict[str, DataFrame]:
    """The ranking of each way to retrieve: "graph", "vector", "text" and "hybrid".

    questions has (query, x, vec_id), store_vectors (store_id, vec_id), units (unit, store_id, vec_id), vectors (vec_id, embedding). Hits are few a question, and each list is made once.
    """
    wide = max(10, k)
    ratings = stores.select("store_id", "rating")
    g = durable(graph_hits(questions, wanted, stores, categories, attributes, wide))
    v = durable(vector.search_shared(questions, store_vectors, vectors, "query", "store_id", "vec_id", "embedding", wide))
    n = durable(expand(seeds(g, v.select("query", "store_id", "rank")), edges, ratings, 8))
    scope = reduce(DataFrame.unionByName, (d.select("query", "store_id") for d in (g, v, n)))
    t = durable(vector.search_shared(questions, units, vectors, "query", "unit", "vec_id", "embedding", 20).select("query", "unit", "score", "store_id"))
    lists = {"graph": g, "neighbour": n, "vector": v.select("query", "store_id", "rank")}
    return {
        "graph": fuse({"graph": g}, None, ratings, k),
        "vector": fuse({"vector": lists["vector"]}, None, ratings, k),
        "text": fuse({}, t, ratings, k),
        "hybrid": fuse(lists, in_scope(t, scope), ratings, k),
    }
