"""Communities: connected components and weighted label propagation, with reliable checkpoints between rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banyan.graph.build import undirected
from banyan.session import durable


def components(nodes: DataFrame, edges: DataFrame, node: str = "node", a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node id that can be reached, by minimum labels with pointer jumping."""
    e = durable(undirected(edges.select(a, b), a, b).distinct())
    cur = durable(nodes.select(F.col(node).alias("node"), F.col(node).alias("component")))
    while True:
        near = e.join(cur.select(F.col("node").alias(b), "component"), b).groupBy(F.col(a).alias("node")).agg(F.min("component").alias("__m"))
        step = cur.join(near, "node", "left").select("node", F.least("component", F.coalesce("__m", "component")).alias("component"), F.col("component").alias("__old"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("__j"))
        nxt = durable(step.join(jump, "component", "left").select("node", F.least("component", F.coalesce("__j", "component")).alias("component"), "__old"))
        moved = nxt.filter("component <> __old").limit(1).count()
        cur = nxt.drop("__old")
        if not moved:
            return cur


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int, node: str = "node", a: str = "a", b: str = "b", weight: str = "weight") -> DataFrame:
    """(node, community) after a fixed number of synchronous rounds: each node takes the label with the greatest weight among its neighbours, ties to the least label."""
    e = durable(undirected(edges.select(a, b, weight), a, b))
    cur = nodes.select(F.col(node).alias("node"), F.col(node).alias("community"))
    for _ in range(rounds):
        votes = e.join(cur.select(F.col("node").alias(b), "community"), b).groupBy(F.col(a).alias("node"), "community").agg(F.round(F.sum(weight), 6).alias("w"))
        best = votes.groupBy("node").agg(F.min_by("community", F.struct((-F.col("w")).alias("w"), "community")).alias("__c"))
        cur = durable(cur.join(best, "node", "left").select("node", F.coalesce("__c", "community").alias("community")))
    return cur


def sizes(communities: DataFrame, column: str = "community") -> DataFrame:
    return communities.groupBy(column).agg(F.count("*").alias("size"))


def modularity(assigned: DataFrame, edges: DataFrame, a: str = "a", b: str = "b", weight: str = "weight") -> DataFrame:
    """(modularity): one row, of (node, community) over undirected weighted edges."""
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(weight).cast("double").alias("w"))
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    x, y = assigned.select(F.col("node").alias("a"), F.col("community").alias("ca")), assigned.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    c = both.join(x, "a").join(y, "b").groupBy(F.col("ca").alias("c")).agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("k"))
    return c.agg(F.sum("inside").alias("i"), F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("s")).select((F.col("i") / F.col("m") - F.col("s") / (F.col("m") * F.col("m"))).alias("modularity"))


#: Rows of links, both directions counted, up to which one task takes all levels (about 120 bytes each at the peak); above it each round is a join.
ONE_TASK = 8_000_000


def _local_moves(a: np.ndarray, b: np.ndarray, w: np.ndarray, h: np.ndarray, total: float, rounds: int) -> tuple[np.ndarray, bool]:
    """The label of each node 0 to len(h) - 1 (hashes h) after the moves of one level over links (a, b, w) of both directions, and whether any node moved."""
    n = len(h)
    k = np.bincount(a, w, n)
    links = a != b
    a, b, w = a[links], b[links], w[links]
    c, moved_ever = np.arange(n), False
    for r in range(rounds * 2):
        tot = np.bincount(c, k, n)
        key = a * n + c[b]
        order = np.argsort(key, kind="stable")
        key = key[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        to = np.add.reduceat(w[order], start) if len(key) else np.zeros(0)
        at, to_c = key[start] // n, key[start] % n
        own = to_c == c[at]
        now = np.zeros(n)
        now[at[own]] = to[own]
        now = np.round(now - k * (tot[c] - k) / total, 9)
        at, to_c, to = at[~own], to_c[~own], to[~own]
        g = np.round(to - k[at] * tot[to_c] / total, 9)
        top, best = now.copy(), np.full(n, n)
        np.maximum.at(top, at, g)
        first = g == top[at]
        np.minimum.at(best, at[first], to_c[first])
        wants = top > now
        moved = wants & (((h + r) & 1) == 0)
        c = np.where(moved, best, c)
        moved_ever = moved_ever or bool(moved.any())
        if not wants.any():
            break
    return c, moved_ever


def _levels_in_task(e: DataFrame, total: float, most: int, rounds: int) -> DataFrame:
    """(level, node, label) of the nodes with links, by the moves of `_levels_by_joins` over arrays in one task."""
    kind = dict(e.dtypes)["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        held.clear()
        coded = t["a"].combine_chunks().dictionary_encode()
        names = coded.dictionary.take(pa.compute.array_sort_indices(coded.dictionary))
        a, b = (pa.compute.index_in(t[x], names).to_numpy().astype(np.int64) for x in "ab")
        w, h = t["w"].to_numpy(), np.zeros(len(names), np.int64)
        h[a] = t["h"].to_numpy()
        del t, coded
        node = np.arange(len(names))
        label, ids = node.copy(), node  # ids: the names of the codes of this level
        for level in range(most):
            c, moved = _local_moves(a, b, w, h[ids], total, rounds)
            if not moved:
                break
            least = np.full(len(ids), len(ids))
            np.minimum.at(least, c, np.arange(len(ids)))
            to = least[c]
            label = ids[to[np.searchsorted(ids, label)]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), level, np.int32)), names, names.take(pa.array(label))], ["level", "node", "label"])
            kept, to = np.unique(to, return_inverse=True)
            key, pos = np.unique(to[a] * len(kept) + to[b], return_inverse=True)
            w = np.bincount(pos, w, len(key))
            a, b, ids = key // len(kept), key % len(kept), ids[kept]

    return e.select("a", "b", "w", F.xxhash64("a").alias("h")).coalesce(1).mapInArrow(run, f"level int, node {kind}, label {kind}")


def levels(nodes: DataFrame, edges: DataFrame, most: int = 4, rounds: int = 12, node: str = "node", a: str = "a", b: str = "b", weight: str = "weight", one_task: int = ONE_TASK) -> DataFrame:
    """(node, level, community): communities by local moves that raise the modularity, then of the communities themselves, up to `most` levels.

    In a round half of the nodes, by hash, may move to the neighbouring community with the greatest gain, ties to the least label; a level ends when no node
    moves. A node without edges stays its own community. Up to `one_task` rows of links all rounds run over arrays in one task; above it each round is a join
    and two aggregations, and no neighbourhood is collected.
    """
    all_ = nodes.select(F.col(node).alias("node"))
    e = durable(undirected(edges.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(weight).cast("double").alias("w"))).groupBy("a", "b").agg(F.sum("w").alias("w")))
    total, n = e.agg(F.sum("w"), F.count("*")).first()
    if not total:
        return all_.select("node", F.lit(0).alias("level"), F.col("node").alias("community"))
    if n > one_task:
        return _levels_by_joins(all_, e, float(total), most, rounds)
    got = durable(_levels_in_task(e, float(total), most, rounds))
    last = got.agg(F.max("level")).first()[0]
    each = all_.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(last or 0))))
    return each.join(got, ["node", "level"], "left").select("node", "level", F.coalesce("label", "node").alias("community"))


def _levels_by_joins(nodes: DataFrame, e: DataFrame, total: float, most: int, rounds: int) -> DataFrame:
    cur, out = durable(nodes.select("node", F.col("node").alias("community"))), None
    for level in range(most):
        k = durable(e.groupBy(F.col("a").alias("n")).agg(F.sum("w").alias("k")))
        own = durable(k.select("n", F.col("n").alias("c"), "k"))
        links = durable(e.filter("a <> b"))
        moved_ever = False
        for r in range(rounds * 2):
            tot = own.groupBy("c").agg(F.sum("k").alias("tot"))
            to = links.join(own.select(F.col("n").alias("b"), F.col("c")), "b").groupBy(F.col("a").alias("n"), "c").agg(F.sum("w").alias("w"))
            mine = own.select("n", F.col("c").alias("own"), "k")
            stay = own.select("n", "c").withColumn("w", F.lit(0.0))
            options = to.unionByName(stay).groupBy("n", "c").agg(F.sum("w").alias("w")).join(mine, "n").join(tot, "c")
            gain = F.col("w") - F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / F.lit(total)
            best = options.withColumn("g", F.round(gain, 9)).groupBy("n").agg(F.min_by("c", F.struct((-F.col("g")).alias("g"), "c")).alias("best"), F.max("g").alias("top"), F.max(F.when(F.col("c") == F.col("own"), F.col("g"))).alias("now"), F.first("own").alias("c"), F.first("k").alias("k"))
            turn = F.pmod(F.xxhash64("n") + F.lit(r), F.lit(2)) == 0
            nxt = durable(best.select("n", F.when(turn & (F.col("top") > F.col("now")), F.col("best")).otherwise(F.col("c")).alias("c"), "k", (F.col("top") > F.col("now")).alias("wants"), (turn & (F.col("top") > F.col("now"))).alias("moved")))
            state = nxt.agg(F.count_if("wants"), F.count_if("moved")).first()
            own = nxt.select("n", "c", "k")
            moved_ever = moved_ever or state[1] > 0
            if not state[0]:
                break
        if not moved_ever:
            break
        names = own.groupBy("c").agg(F.min("n").alias("label"))
        into = durable(own.join(names, "c").select(F.col("n").alias("community"), "label"))
        cur = durable(cur.join(into, "community", "left").select("node", F.coalesce("label", "community").alias("community")))
        got = cur.withColumn("level", F.lit(level))
        out = got if out is None else out.unionByName(got)
        x, y = into.select(F.col("community").alias("a"), F.col("label").alias("la")), into.select(F.col("community").alias("b"), F.col("label").alias("lb"))
        e = durable(e.join(x, "a").join(y, "b").groupBy(F.col("la").alias("a"), F.col("lb").alias("b")).agg(F.sum("w").alias("w")))
    if out is None:
        out = cur.withColumn("level", F.lit(0))
    return out.select("node", "level", "community")
