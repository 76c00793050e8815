"""Mixing sources to target shares by Pareto order sampling.

The total size is the largest at which every source that has documents can give its share with no document used more
often than the source allows. What a source must give is split into certain whole copies of all its documents and a rest.
The rest is a fixed-size sample with unequal probabilities: a document's inclusion odds follow its size, each gets the rank variable
(u / (1 - u)) / (p / (1 - p)) with u from a hash of its id, and documents are taken in that order until the rest is filled.
The order is never sorted in one place: sizes are summed by source and bin of the rank variable, the bin
where the rest is filled is found from those sums, and only that bin is cut in order, within finer bins if it is large.

Defined results: documents of size zero (null and empty texts) are never used; sources without documents and sources with no
target get nothing and are reported (share reached 0, or no target); repeated target rows of a source count once; null sources form no
source; empty tables give empty results. Ids must be unique; ties in rank are broken by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS = 1024


def allocate(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(source, target_share, max_repeat, n, size, wanted, whole, rest) of each target; one row a source.

    `sizes` has (source, n, size).
    """
    t = targets.groupBy("source").agg(F.first("target_share").alias("target_share"), F.greatest(F.first("max_repeat"), F.lit(0)).alias("max_repeat"))
    a = t.join(sizes, "source", "left").fillna({"n": 0, "size": 0})
    room = F.when((F.col("size") > 0) & (F.col("target_share") > 0) & (F.col("max_repeat") > 0), F.col("max_repeat") * F.col("size") / F.col("target_share"))
    a = a.crossJoin(F.broadcast(a.agg(F.min(room).alias("__most")))) if total is None else a.withColumn("__most", F.lit(float(total)))
    a = a.withColumn("wanted", F.when(room.isNotNull(), F.least(F.col("target_share") * F.col("__most"), (F.col("max_repeat") * F.col("size")).cast("double"))).otherwise(0.0))
    whole = F.when(F.col("size") > 0, F.floor(F.col("wanted") / F.col("size") + 1e-9)).otherwise(0)
    return a.withColumn("whole", whole.cast("int")).withColumn("rest", F.greatest(F.lit(0.0), F.col("wanted") - F.col("whole") * F.col("size"))).drop("__most")


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 7) -> DataFrame:
    """(doc_id, source, tokens, copies) of each document used; docs has (doc_id, source, tokens)."""
    docs = docs.filter((F.col("tokens") > 0) & F.col("source").isNotNull()).select("doc_id", "source", F.col("tokens").cast("bigint").alias("tokens"))
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("size"))
    plan = allocate(sizes, targets, total)
    # one row a target
    d = docs.join(F.broadcast(plan.filter("wanted > 0").select("source", "n", "size", "whole", "rest")), "source")
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    share = F.col("rest") / F.col("size")
    # inclusion odds grow with the size: p = share scaled by size over mean size, kept within (0, 1)
    p = F.least(F.lit(0.999), F.greatest(F.lit(1e-9), share * F.col("tokens") * F.col("n") / F.col("size")))
    q = (u / (1 - u)) / (p / (1 - p))
    d = d.withColumn("__q", q).withColumn("__bin", F.floor(F.col("__q") / (1 + F.col("__q")) * BINS).cast("int"))
    sums = d.filter("rest > 0").groupBy("source", "__bin").agg(F.sum("tokens").alias("__t"), F.first("rest").alias("__rest"))
    before = F.coalesce(F.sum("__t").over(W.partitionBy("source").orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # at most BINS rows a source
    bins = sums.withColumn("__before", before).select("source", "__bin", "__before", (F.col("__before") + F.col("__t") <= F.col("__rest")).alias("__all"), (F.col("__before") < F.col("__rest")).alias("__some"))
    d = d.join(F.broadcast(bins), ["source", "__bin"], "left")
    inner = d.filter("__some and not __all")
    fine = F.floor(F.pmod(F.col("__q") / (1 + F.col("__q")) * BINS, F.lit(1.0)) * BINS).cast("int")
    inner = inner.withColumn("__fine", fine)
    fsum = inner.groupBy("source", "__bin", "__fine").agg(F.sum("tokens").alias("__ft"))
    fbefore = F.coalesce(F.sum("__ft").over(W.partitionBy("source", "__bin").orderBy("__fine").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inner = inner.join(F.broadcast(fsum.withColumn("__fbefore", fbefore).drop("__ft")), ["source", "__bin", "__fine"])
    run = F.sum("tokens").over(W.partitionBy("source", "__bin", "__fine").orderBy("__q", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    # a document is taken where the sum comes nearer to the rest with it than without it
    inner = inner.withColumn("__upto", F.col("__before") + F.col("__fbefore") + run)
    inner = inner.withColumn("__in", F.col("__upto") - F.col("tokens") / 2 <= F.col("rest"))
    rest = d.filter("not coalesce(__some, false) or __all").withColumn("__in", F.coalesce(F.col("__all"), F.lit(False)))
    cols = ["doc_id", "source", "tokens", "whole", "__in"]
    out = rest.select(*cols).unionByName(inner.select(*cols))
    return out.select("doc_id", "source", "tokens", (F.col("whole") + F.col("__in").cast("int")).alias("copies")).filter("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """The shares reached: one row a target."""
    got = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum("copies").alias("uses"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    t = targets.groupBy("source").agg(F.first("target_share").alias("target_share"), F.first("max_repeat").alias("max_repeat"))
    a = t.join(got, "source", "left").fillna(0, ["documents", "uses", "tokens", "most_copies"])
    a = a.crossJoin(F.broadcast(got.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("__all"))))
    return a.select("source", "target_share", "max_repeat", "documents", "uses", "tokens", "most_copies", F.when(F.col("__all") > 0, F.col("tokens") / F.col("__all")).otherwise(0.0).alias("share"))
