"""Exact vector search and similarity edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from banyan.session import durable


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(1e-9))


def _best(group: np.ndarray, tie: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k greatest scores of each group, ties to the smaller."""
    order = np.lexsort((tie, -score, group))
    g = group[order]
    start = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    rank = np.arange(len(g)) - np.maximum.accumulate(np.where(start, np.arange(len(g)), 0)) if len(g) else np.zeros(0, int)
    return order[rank < k]


def knn(vectors: DataFrame, query: list[float], key: str, vector: str, k: int) -> DataFrame:
    """(key, score): the k nearest by cosine; a partial top-k in each task, then one merge."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(key, F.round(cosine(F.col(vector), q), 4).alias("score")).orderBy(F.desc("score"), F.asc(key)).limit(k)


def search(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, block: int = 4096, query_block: int = 1024, item_key: str | None = None) -> DataFrame:
    """(query, item, score, rank): the k nearest vectors of each query, exactly; without `item_key` both sides have the key, and no row is its own hit.

    A block of queries meets a block of vectors as one matrix product in one task, which gives the k best of each query; these are merged.
    Null vectors take no part.
    """
    own_hits = item_key is not None
    item = item_key or key
    queries, vectors = queries.filter(F.col(vector).isNotNull()), vectors.filter(F.col(vector).isNotNull())
    n, m = (max(1, -(-d.count() // b)) for d, b in ((vectors, block), (queries, query_block)))
    kinds = dict(queries.dtypes)[key], dict(vectors.dtypes)[item]

    def side(d: DataFrame, is_q: bool) -> DataFrame:
        k, other = (F.col(key), F.lit(None).cast(kinds[1])) if is_q else (F.lit(None).cast(kinds[0]), F.col(item))
        d = d.select(k.alias("k"), other.alias("i"), F.col(vector).cast("array<double>").alias("v"), F.lit(is_q).alias("is_q"))
        own = F.pmod(F.xxhash64("k" if is_q else "i"), F.lit(m if is_q else n)).cast("int")
        others = F.explode(F.sequence(F.lit(0), F.lit((n if is_q else m) - 1)))
        return d.select((own if is_q else others).alias("h"), "k", "i", "v", "is_q", (others if is_q else own).alias("g"))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
            q = t["is_q"].to_numpy(zero_copy_only=False)
            ids = np.where(q, np.array(t["k"].to_pylist(), dtype=object), np.array(t["i"].to_pylist(), dtype=object))
            if not q.any() or q.all():
                return
            x = np.array(t["v"].to_pylist(), dtype=np.float64)
            x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
            names, items, y = ids[q], ids[~q], x[~q]
            s = np.round(x[q] @ y.T, 4)
            if not own_hits:
                s[names[:, None] == items[None, :]] = -np.inf
            if len(items) > k:  # what cannot be among the k best goes; ties at the border stay until they are ranked
                border = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                a, b = np.nonzero((s >= border) & np.isfinite(s))
            else:
                a, b = np.nonzero(np.isfinite(s))
            keep = _best(a, np.argsort(np.argsort(items, kind="stable"), kind="stable")[b], s[a, b], k)
            yield pa.RecordBatch.from_arrays([pa.array(names[a[keep]].tolist()), pa.array(items[b[keep]].tolist()), pa.array(s[a, b][keep])], ["query", "item", "score"])

        held, at = [], None
        for b in batches:
            t = pa.Table.from_batches([b])
            hg = np.stack([t["h"].to_numpy(), t["g"].to_numpy()], 1)
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(hg, axis=0) != 0).any(1)) + 1, [len(hg)]])
            for i, j in zip(cuts[:-1], cuts[1:]):
                if i == j:
                    continue
                here = (int(hg[i][0]), int(hg[i][1]))
                if at is not None and here != at:
                    yield from run(pa.concat_tables(held))
                    held = []
                at = here
                held.append(t.slice(i, j - i))
        if held:
            yield from run(pa.concat_tables(held))

    both = side(queries, True).unionByName(side(vectors, False))
    hits = both.repartition("h", "g").sortWithinPartitions("h", "g").mapInArrow(products, f"query {kinds[0]}, item {kinds[1]}, score double")
    w = W.partitionBy("query").orderBy(F.desc("score"), F.asc("item"))
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _matrix(v: pa.ChunkedArray) -> np.ndarray:
    return v.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosines of all rows of x and y in ten-thousandths."""
    n, m = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    return np.rint(x @ y.T / (n[:, None] * m[None, :] + 1e-9) * 10_000).astype(np.int64)


def _first(s: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k greatest values of each row in their order, ties to the smaller column."""
    c = s * s.shape[1] - np.arange(s.shape[1])
    at = np.argpartition(-c, k - 1, axis=1)[:, :k] if s.shape[1] > k else np.broadcast_to(np.arange(s.shape[1]), s.shape)
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(c, at, 1), axis=1), 1)


def _runs(batches: Iterator[pa.RecordBatch], x: str, y: str) -> Iterator[tuple[pa.Table, int, int]]:
    """The rows of each pair (x, y) of batches that are sorted by it."""
    held, at = [], None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        xy = np.stack([t[x].to_numpy(), t[y].to_numpy()], 1)
        cuts = np.concatenate([[0], np.flatnonzero((np.diff(xy, axis=0) != 0).any(1)) + 1, [len(xy)]])
        for i, j in zip(cuts[:-1], cuts[1:]):
            here = (int(xy[i][0]), int(xy[i][1]))
            if at is not None and here != at:
                yield pa.concat_tables(held), *at
                held = []
            at = here
            held.append(t.slice(i, j - i))
    if held:
        yield pa.concat_tables(held), *at


def _in_blocks(d: DataFrame, key: str, block: int) -> tuple[DataFrame, int]:
    """d with `g`, the number of a block of about `block` rows, and the number of blocks; blocks are ranges of the key, in its order."""
    d = durable(d)
    n = max(1, -(-d.count() // block))
    return (d.withColumn("g", F.lit(0)) if n == 1 else durable(d.repartitionByRange(n, key).withColumn("g", F.spark_partition_id()))), n


def _pairs_of_blocks(v: DataFrame, kind: str, least: float, k: int | None) -> DataFrame:
    """(a, b, sim) of rows (p, q, g, k, v): each pair of a row of block p and a later one of block q."""
    floor = int(np.ceil(least * 10_000 - 1e-6))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, p, q in _runs(batches, "p", "q"):
            t = t.take(pa.compute.sort_indices(t, [("k", "ascending")]))
            g, m = t["g"].to_numpy(), _matrix(t["v"])
            names = t["k"].combine_chunks()
            rank = pa.compute.rank(names, tiebreaker="min").to_numpy()
            i, j = np.flatnonzero(g == p), np.flatnonzero(g == q)
            for at in range(0, len(i), 1024):
                x = i[at : at + 1024]
                s = _cosines(m[x], m[j])
                s[rank[x][:, None] >= rank[j][None, :]] = -100_000
                if k is None:
                    r, c = np.nonzero(s >= floor)
                else:
                    c = _first(s, k)
                    r, c = np.repeat(np.arange(len(x)), c.shape[1]), c.ravel()
                    ok = s[r, c] >= floor
                    r, c = r[ok], c[ok]
                if len(r):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(x[r])), names.take(pa.array(j[c])), pa.array(s[r, c] / 10_000)], ["a", "b", "sim"])

    return v.repartition("p", "q").sortWithinPartitions("p", "q").mapInArrow(products, f"a {kind}, b {kind}, sim double")


def similar_pairs(vectors: DataFrame, key: str, vector: str, least: float, block: int = 2048, k: int | None = None) -> DataFrame:
    """(a, b, sim) of all pairs a < b with a cosine of at least `least`, or of the k most similar b of each a in each pair of blocks.

    Vectors are packed into blocks of about `block` rows, ranges of the key, so that keys are compared by their place in a block; a pair of blocks is one
    matrix product in one task, so nothing is broadcast and no pair of rows is shuffled. Null vectors take no part.
    """
    kind = dict(vectors.dtypes)[key]
    d, n = _in_blocks(vectors.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).filter("k is not null and v is not null"), "k", block)
    # a vector goes to each pair of blocks that has its block, as the left or the right side
    d = d.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(F.least("g", "o").alias("p"), F.greatest("g", "o").alias("q"), "g", "k", "v")
    return _pairs_of_blocks(d, kind, least, k)


def similar_shared(items: DataFrame, vectors: DataFrame, key: str, number: str, vector: str, least: float, k: int, block: int = 2048, part: int = 4096) -> DataFrame:
    """(a, b, sim): pairs a < b of items (key, number) whose vectors are those of the number, among them the k most similar b of each a, ties to the smaller.

    Items that share a vector have the same cosines. Within a block, a range of keys, rows meet rows. Against the blocks after it, each distinct vector of a block
    meets each distinct vector of the later items, once, which stands for its items in the order of their keys; only those that can be among the k best are listed.
    """
    kind, ckind = dict(items.dtypes)[key], dict(items.dtypes)[number]
    vt = vectors.select(F.col(number).alias("c"), F.col(vector).cast("array<double>").alias("v")).filter("c is not null and v is not null")
    d = items.select(F.col(key).alias("k"), F.col(number).alias("c")).filter("k is not null").join(vt.select("c"), "c", "left_semi")
    d, n = _in_blocks(d, "k", block)
    inside = _pairs_of_blocks(d.join(vt, "c").select(F.col("g").alias("p"), F.col("g").alias("q"), "g", "k", "v"), kind, least, k)
    if n == 1:
        return inside
    w = W.partitionBy("c").orderBy("g")
    groups = d.groupBy("c", "g").agg(F.min("k").alias("k"), F.count("*").alias("n"))
    groups = durable(groups.select("c", "g", "k", F.lag("g").over(w).alias("before"), (F.sum("n").over(w) - F.col("n")).alias("r0"), F.sum("n").over(w.rowsBetween(0, W.unboundedFollowing)).alias("left")))
    m = max(1, -(-groups.select("c").distinct().count() // part))
    # for a block p, the items of a vector in later blocks begin with its group in the first of these
    later = groups.filter("coalesce(before, 0) < g").withColumn("p", F.explode(F.sequence(F.coalesce("before", F.lit(0)), F.col("g") - 1)))
    right = later.select("p", F.pmod(F.xxhash64("c"), F.lit(m)).cast("int").alias("s"), F.lit(False).alias("own"), "c", "k", "r0", "left")
    left = groups.select(F.col("g").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("s"), F.lit(True).alias("own"), "c", F.lit(None).cast(kind).alias("k"), F.lit(0).cast("bigint").alias("r0"), F.lit(0).cast("bigint").alias("left"))
    floor = int(np.ceil(least * 10_000 - 1e-6))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, p, _ in _runs(batches, "p", "s"):
            own = t["own"].to_numpy(zero_copy_only=False)
            x, y = t.filter(pa.array(own)), t.filter(pa.array(~own))
            if not len(x) or not len(y):
                continue
            y = y.take(pa.compute.sort_indices(y, [("k", "ascending")]))
            mx, my, more, xc, yc, r0 = _matrix(x["v"]), _matrix(y["v"]), y["left"].to_numpy(), x["c"].combine_chunks(), y["c"].combine_chunks(), y["r0"].to_numpy()
            for at in range(0, len(x), 1024):
                s = _cosines(mx[at : at + 1024], my)
                c = _first(s, k)
                v = np.take_along_axis(s, c, 1)
                before = np.cumsum(more[c], axis=1) - more[c]  # items of more similar vectors
                for j in range(1, c.shape[1]):
                    before[:, j] = np.where(v[:, j] == v[:, j - 1], before[:, j - 1], before[:, j])
                r, j = np.nonzero((v >= floor) & (before < k))
                if len(r):
                    c = c[r, j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), p, np.int32)), xc.take(pa.array(at + r)), yc.take(pa.array(c)), pa.array(r0[c]), pa.array(v[r, j] / 10_000)], ["g", "c", "d", "r0", "sim"])

    hits = left.unionByName(right).join(vt, "c").repartition("p", "s").sortWithinPartitions("p", "s").mapInArrow(products, f"g int, c {ckind}, d {ckind}, r0 bigint, sim double")
    place = d.join(groups.select("c", "g", "r0"), ["c", "g"]).select(F.col("c").alias("d"), (F.col("r0") + F.row_number().over(W.partitionBy("c", "g").orderBy("k")) - 1).alias("r"), F.col("k").alias("b"))
    best = hits.withColumn("r", F.explode(F.sequence("r0", F.col("r0") + (k - 1)))).join(place, ["d", "r"])
    best = best.withColumn("i", F.row_number().over(W.partitionBy("g", "c").orderBy(F.desc("sim"), F.asc("b")))).filter(F.col("i") <= k)
    return inside.unionByName(d.join(best.select("g", "c", "b", "sim"), ["g", "c"]).select(F.col("k").alias("a"), "b", "sim"))


def search_shared(queries: DataFrame, items: DataFrame, vectors: DataFrame, key: str, item_key: str, number: str, vector: str, k: int) -> DataFrame:
    """(key, all columns of items but the number, score, rank): `search` for queries (key, number) and items (item_key, number, ...) whose vectors are those of the number.

    Each distinct vector is sought and found once: a vector stands for its first item, and its k first items take part where it is found. A vector that is not
    among the k best so has k items before each of its own.
    """
    vt = vectors.select(number, vector).filter(F.col(vector).isNotNull())
    q = durable(queries.select(number).distinct().join(vt, number).withColumnRenamed(number, "__q"))
    firsts = durable(items.filter(F.col(item_key).isNotNull()).groupBy(number).agg(F.min(item_key).alias("__first")).join(vt, number))
    hits = search(q, firsts, "__q", vector, k, item_key="__first").select(F.col("query").alias("__q"), F.col("item").alias("__first"), "score")
    hits = hits.join(firsts.select("__first", number), "__first").drop("__first")
    some = items.filter(F.col(item_key).isNotNull()).withColumn("__n", F.row_number().over(W.partitionBy(number).orderBy(item_key))).filter(F.col("__n") <= k).drop("__n")
    best = hits.join(some, number).drop(number).withColumn("rank", F.row_number().over(W.partitionBy("__q").orderBy(F.desc("score"), F.asc(item_key)))).filter(F.col("rank") <= k)
    return queries.select(key, F.col(number).alias("__q")).join(best, "__q").drop("__q")


def dense(scores: DataFrame, key: str, feature: str, value: str, most: int = 4096) -> DataFrame:
    """(k, v): each key's values as a vector over the sorted features, of which there are at most `most`."""
    names = [r[0] for r in scores.select(feature).filter(F.col(feature).isNotNull()).distinct().orderBy(feature).limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} features: use sparse_similarity")
    v = F.array(*(F.coalesce(F.sum(F.when(F.col(feature) == n, F.col(value).cast("double"))), F.lit(0.0)) for n in names))
    return scores.groupBy(F.col(key).alias("k")).agg(v.alias("v"))


def top_edges(pairs: DataFrame, k: int) -> DataFrame:
    """At most k edges for each a, the most similar first."""
    return pairs.withColumn("__rn", F.row_number().over(W.partitionBy("a").orderBy(F.desc("sim"), F.asc("b")))).filter(F.col("__rn") <= k).drop("__rn")


def sparse_similarity(scores: DataFrame, key: str, feature: str, value: str, least: float) -> DataFrame:
    """(a, b, sim): cosine of sparse vectors, as a join on the feature and a sum of products."""
    s = scores.select(F.col(key).alias("k"), F.col(feature).alias("f"), F.col(value).cast("double").alias("v"))
    n = s.groupBy("k").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    x, y = s.alias("x"), s.alias("y")
    p = x.join(y, (F.col("x.f") == F.col("y.f")) & (F.col("x.k") < F.col("y.k"))).groupBy(F.col("x.k").alias("a"), F.col("y.k").alias("b")).agg(F.sum(F.col("x.v") * F.col("y.v")).alias("d"))
    p = p.join(n.select(F.col("k").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("k").alias("b"), F.col("n").alias("nb")), "b")
    return p.select("a", "b", F.round(F.col("d") / (F.col("na") * F.col("nb") + 1e-9), 4).alias("sim")).filter(F.col("sim") >= least)
