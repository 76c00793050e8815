import numpy as np
import pytest
from pyspark.sql import functions as F

from banyan.graph import build, community, query as gq
from banyan.operators import conform, fusion, retrieval, vector
from banyan.operators.match import best_match, match_with_fallback
from banyan.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_picks(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "k string, o int, v string")
    assert rows(conform.first_wins(d, ["k"], "o")) == [("a", 1, "x"), ("b", 3, "z")]
    assert rows(conform.last_wins(d, ["k"], "o")) == [("a", 2, "y"), ("b", 3, "z")]


def test_append_unseen_with_nulls(spark):
    h = spark.createDataFrame([("a", None)], "x string, y string")
    n = spark.createDataFrame([("a", None), ("a", "1"), ("a", "1"), (None, None)], "x string, y string")
    assert rows(conform.append_unseen(h, n, ["x", "y"]).fillna("-")) == [("-", "-"), ("a", "1")]


def test_split_valid(spark):
    ok, bad = conform.split_valid(spark.createDataFrame([(1,), (None,), (-1,)], "x int"), {"given": F.col("x").isNotNull(), "positive": F.col("x") > 0})
    assert rows(ok) == [(1,)]
    assert sorted(r["error"] for r in bad.collect()) == ["given", "positive"]


def test_graph(spark):
    n = spark.createDataFrame([("a", "L", "1", "{}"), ("b", "L", "2", "{}")], "node_id string, label string, name string, properties string")
    again = n.limit(1).withColumn("name", F.lit("new"))
    assert rows(build.all_nodes([n, again]).select("node_id", "name"))[0][1] == "new"
    e = spark.createDataFrame([("a", "R", "b", "{}"), ("a", "R", "b", "{}"), ("a", "R", "zz", "{}")], "source_id string, relation string, target_id string, properties string")
    assert rows(build.connected(e, n)) == [("a", "R", "b", "{}")]
    w = spark.createDataFrame([(1, 2, 5.0), (3, 1, 7.0), (2, 3, 1.0)], "a int, b int, weight double")
    assert [tuple(r) for r in gq.neighbours(spark.createDataFrame([(1,)], "s int"), w, "weight", 5).collect()] == [(3, 7.0), (2, 5.0)]


def test_components_against_union_find(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2)) if a != b]
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = dict(rows(community.components(spark.range(60).withColumnRenamed("id", "node"), spark.createDataFrame(edges, "a long, b long"))))
    assert got == {x: root(x) for x in range(60)}


def test_similar_pairs_against_brute_force(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(50, 8))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "id long, v array<double>")
    u = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)
    want = {(i, j, round(float(u[i] @ u[j]), 4)) for i in range(50) for j in range(i + 1, 50) if round(float(u[i] @ u[j]), 4) >= 0.3}
    assert set(rows(vector.similar_pairs(df, "id", "v", 0.3, block=16))) == want


def test_fusion_and_metrics(spark):
    hits = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query string, item string, rank int")
    rel = spark.createDataFrame([("q", "b"), ("q", "z"), ("p", "a")], "query string, item string")
    m = {r["query"]: (r["recall"], r["mrr"], r["ndcg"]) for r in fusion.retrieval_metrics(hits, rel, 3).collect()}
    assert m["q"][:2] == (0.5, 0.5) and abs(m["q"][2] - (1 / np.log2(3)) / (1 + 1 / np.log2(3))) < 1e-12 and m["p"] == (0, 0, 0)
    f = fusion.fuse_rrf("item", {"g": hits.drop("query")}).collect()
    assert abs({r["item"]: r["score"] for r in f}["a"] - 1 / 61) < 1e-12


def test_best_match(spark):
    left = spark.createDataFrame([("s", "Phở Bò", "12 Bạch Mai, Hà Nội", 21.0, 105.8)], "id string, name string, address string, lat double, lng double")
    right = spark.createDataFrame([(1, "Pho Bo", "12 Bach Mai, Ha Noi", 21.0001, 105.8), (2, "Chè", "9 Bach Mai", 21.0001, 105.8), (3, "Phở Bò", "12 Bạch Mai", None, None)], "id int, name string, address string, lat double, lng double")
    r = best_match(left, right).collect()
    assert [(x["left_id"], x["right_id"], x["confidence"]) for x in r] == [("s", 1, "high")]


def test_files(spark, tmp_path):
    d = spark.createDataFrame([("1", 'a "q"\nb'), ("2", None)], "id string, t string")
    files.write_csv(d, str(tmp_path / "c"), ["id", "t", "missing"])
    back = files.read_csv(spark, str(tmp_path / "c"), "id string, t string, missing string")
    assert rows(back.fillna("-")) == [("1", 'a "q"\nb', "-"), ("2", "-", "-")]
    assert files.read_optional(spark, str(tmp_path / "none"), "id string").count() == 0
    files.write_partitioned(d, str(tmp_path / "p"), "id")
    assert (tmp_path / "p" / "id=1").exists()
    up = files.upsert(d, spark.createDataFrame([("2", "x", 1), ("2", "y", 2), ("3", "z", 1)], "id string, t string, o long"), ["id"], "o")
    assert rows(up) == [("1", 'a "q"\nb'), ("2", "y"), ("3", "z")]


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(60, 8))
    m[7] = m[8]  # a tie
    df = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "id long, v array<double>")
    u = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)
    s = np.round(u @ u.T, 4)
    want = {(q, r + 1): j for q in range(0, 60, 10) for r, j in enumerate(sorted((j for j in range(60) if j != q), key=lambda j: (-s[q, j], j))[:5])}
    got = {(r["query"], r["rank"]): r["item"] for r in vector.search(df.filter("id % 10 = 0"), df, "id", "v", 5, block=16, query_block=4).collect()}
    assert got == want


def test_best_match_against_all_pairs(spark):
    """The blocked matcher against a plain one over all pairs."""
    import math
    from difflib import SequenceMatcher

    rng = np.random.default_rng(4)
    names = ["pho bo", "bun cha", "che sen", "tra chanh", "com tam"]
    rec = lambda i: (int(i), names[rng.integers(5)], f"{rng.integers(1, 4)} bach mai", 21.0 + rng.uniform(0, 0.03), 105.8 + rng.uniform(0, 0.03))
    left = [(*rec(i), names[rng.integers(5)] if i % 2 else None) for i in range(40)]
    right = [rec(i) for i in range(60)]

    def metres(a, b):
        h = math.sin(math.radians(b[3] - a[3]) / 2) ** 2 + math.cos(math.radians(a[3])) * math.cos(math.radians(b[3])) * math.sin(math.radians(b[4] - a[4]) / 2) ** 2
        return 2 * 6_371_000 * math.asin(math.sqrt(h))

    def score(a, b):
        m = metres(a, b)
        geo = next((s for limit, s in ((40, 1.0), (80, 0.95), (150, 0.88), (300, 0.75), (500, 0.55), (800, 0.35), (1200, 0.18)) if m <= limit), 0.0)
        asked = [x for x in (a[1], a[5]) if x]
        name = max(SequenceMatcher(None, x, b[1]).ratio() for x in asked)
        tb = set(b[1].split())
        token = max(len(set(x.split()) & tb) / len(set(x.split()) | tb) for x in asked)
        same = a[2] == b[2]
        return 0.55 * geo + 0.20 * same + 0.17 * name + 0.05 * token + 0.03 - (0 if same else 0.30) - (0.45 if name < 0.35 and token < 0.10 else 0), m

    want = {}
    for a in left:
        best = min(((-round(score(a, b)[0], 6), score(a, b)[1], b[0]) for b in right if score(a, b)[1] <= 1200), default=None)
        if best and -best[0] >= 0.5:
            want[a[0]] = best[2]
    s = "id int, name string, address string, lat double, lng double"
    got = {r["left_id"]: r["right_id"] for r in best_match(spark.createDataFrame(left, s + ", query_name string"), spark.createDataFrame(right, s)).collect()}
    assert got == want and len(want) > 5
    direct = spark.createDataFrame([(0, 59), (0, 58), (1, 999), (None, 3)], "left_id int, right_id int")
    f = {r["left_id"]: (r["right_id"], r["method"]) for r in match_with_fallback(spark.createDataFrame(left, s + ", query_name string"), spark.createDataFrame(right, s), direct).collect()}
    assert f[0] == (58, "id") and all(m == "fuzzy" and j != 58 for i, (j, m) in f.items() if i)
    with pytest.raises(ValueError):
        best_match(spark.createDataFrame(left, s + ", query_name string"), spark.createDataFrame(right, s), 0.4)


def test_retrieval_steps(spark):
    q = spark.createDataFrame([(1, "quán trà sữa ở quận tân bình, giá rẻ"), (2, ""), (3, "trà")], "query long, x string")
    d = spark.createDataFrame([("Tân Bình",), ("Bình",), (None,)], "district string")
    c = spark.createDataFrame([("Trà sữa",), ("Trà",), ("Cơm",)], "category string")
    i = retrieval.intents(q, d, c, {"giá": "price", "rẻ": "price"})
    assert rows(i) == sorted([(1, "district", "Bình"), (1, "category", "Trà sữa"), (1, "category", "Trà"), (1, "attribute", "price"), (3, "category", "Trà")])
    given = spark.createDataFrame([(1, "category", "Cơm"), (3, "category", "  ")], "query long, kind string, value string")
    assert rows(retrieval.override(i, given)) == sorted([(1, "district", "Bình"), (1, "category", "Cơm"), (1, "attribute", "price"), (3, "category", "Trà")])
    stores = spark.createDataFrame([("a", 4.0, "Bình"), ("b", None, "Bình"), ("c", 5.0, "X")], "store_id string, rating double, district string")
    cats = spark.createDataFrame([("a", "Trà"), ("a", "Trà sữa"), ("b", "Trà"), ("c", "Trà")], "store_id string, category string")
    att = spark.createDataFrame([("a", "price", 0.2), ("b", "price", 0.1)], "store_id string, attribute string, score double")
    g = retrieval.graph_hits(q, i, stores, cats, att, 2)
    assert rows(g) == [(1, "a", 1), (2, "a", 2), (2, "c", 1), (3, "a", 2), (3, "c", 1)]
    hits = spark.createDataFrame([(1, "a", 7), (1, "b", 8), (2, "z", 9)], "query long, store_id string, unit long")
    assert rows(retrieval.in_scope(hits, g.filter("query = 1")).select("unit")) == [(7,), (9,)]
    e = spark.createDataFrame([("a", "b", 0.5), ("c", "a", 0.9)], "a string, b string, sim double")
    n = retrieval.expand(retrieval.seeds(g, g, 1), e, stores.select("store_id", "rating"), 5)
    assert rows(n.filter("query = 1").select("store_id", "rank")) == [("b", 2), ("c", 1)]
    t = spark.createDataFrame([(1, "a", u, 0.1 * u) for u in range(1, 6)], "query long, store_id string, unit long, score double")
    f = {(r["query"], r["store_id"]): r for r in retrieval.fuse({"graph": g}, t, stores.select("store_id", "rating"), 5).collect()}
    assert f[1, "a"]["flags"] == "graph|text" and f[1, "a"]["evidence"] == [5, 4, 3] and abs(f[1, "a"]["score"] - (1 / 61 + 0.5 / 61 + 0.8 / 61)) < 1e-6


def test_edges_keep_the_last_properties(spark):
    n = spark.createDataFrame([("a",), ("b",)], "node_id string")
    d = spark.createDataFrame([("a", "b", "z", 1), ("a", "b", "c", 2), ("a", "x", "q", 3)], "s string, t string, p string, o long")
    e = build.edges_of(d, F.col("s"), "R", F.col("t"), F.col("p"), F.col("o"))
    assert rows(build.connected(e, n)) == [("a", "R", "b", "c")]
    stored = spark.createDataFrame([("a", "R", "b", "old"), ("b", "R", "a", "kept")], "source_id string, relation string, target_id string, properties string")
    assert rows(build.upsert_edges(stored, e, n)) == [("a", "R", "b", "c"), ("b", "R", "a", "kept")]


def test_ordinals_in_blocks(spark):
    df = spark.createDataFrame([("hot" if i % 3 else None, i) for i in range(50)], "k string, o long")
    got = {r["o"]: r["n"] for r in conform.ordinal(df, ["k"], "o", "n", block=8).collect()}
    assert got == {i: sum((j % 3 == 0) == (i % 3 == 0) for j in range(i + 1)) for i in range(50)}


def test_levels_find_planted_communities(spark):
    """Five dense groups, joined in two pairs and one alone: the groups first, then modularity decides whether they merge; an isolated node stays alone."""
    rng = np.random.default_rng(3)
    edges = [(g * 10 + i, g * 10 + j, 1.0) for g in range(5) for i in range(8) for j in range(i + 1, 8) if rng.uniform() < 0.8]
    edges += [(0, 10, 0.5), (21, 32, 0.5), (3, 12, 0.5)]
    nodes = spark.createDataFrame([(g * 10 + i,) for g in range(5) for i in range(8)] + [(99,)], "node long")
    e = spark.createDataFrame(edges, "a long, b long, weight double")
    out = community.levels(nodes, e).collect()
    first = {r["node"]: r["community"] for r in out if r["level"] == 0}
    last = {r["node"]: r["community"] for r in out if r["level"] == max(x["level"] for x in out)}
    assert len(first) == 41 and first[99] == 99
    assert all(len({last[g * 10 + i] for i in range(8)}) == 1 for g in range(5)) and 5 <= len(set(last.values())) <= 6
    q = community.modularity(spark.createDataFrame(list(last.items()), "node long, community long"), e).first()[0]
    assert q > 0.7
    assert {r["community"] for r in community.levels(nodes.limit(2), e.filter("false")).collect()} == {r["node"] for r in nodes.limit(2).collect()}


def test_best_pairs_across_blocks(spark):
    """The k best later keys of each key, over any number of blocks, ties to the smaller; null vectors take no part."""
    rng = np.random.default_rng(1)
    m = rng.integers(0, 4, (60, 3)).astype(float)
    ids = [f"s{i:02d}" for i in range(60)]
    df = spark.createDataFrame([*zip(ids, m.tolist()), ("s00x", None)], "id string, v array<double>")
    s = np.round(m @ m.T / (np.outer(np.linalg.norm(m, axis=1), np.linalg.norm(m, axis=1)) + 1e-9), 4)
    want = {(ids[i], ids[j], float(s[i, j])) for i in range(60) for j in sorted((j for j in range(i + 1, 60) if s[i, j] >= 0.45), key=lambda j: (-s[i, j], j))[:5]}
    for block in (7, 100):
        assert set(rows(vector.top_edges(vector.similar_pairs(df, "id", "v", 0.45, block=block, k=5), 5))) == want


def test_shared_vectors_against_brute_force(spark):
    """Items that share vectors: the same edges and hits as row by row, with ties between vectors and within them."""
    rng = np.random.default_rng(11)
    m = rng.normal(size=(12, 3))
    m[5], m[9] = m[4], -m[4]
    ids = [f"k{i:03d}" for i in rng.permutation(200)]
    number = dict(zip(ids, rng.integers(0, 13, 200).tolist()))  # 12 has no vector
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "n long, v array<double>")
    items = spark.createDataFrame([(i, n, i[-1]) for i, n in number.items()], "id string, n long, more string")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u @ u.T, 4)
    have = sorted(i for i in ids if number[i] < 12)
    sim = lambda a, b: float(s[number[a], number[b]])
    want = {(a, b, sim(a, b)) for a in have for b in sorted((b for b in have if b > a and sim(a, b) >= 0.3), key=lambda b: (-sim(a, b), b))[:4]}
    for block, part in ((16, 5), (500, 500)):
        assert set(rows(vector.top_edges(vector.similar_shared(items, vectors, "id", "n", "v", 0.3, 4, block, part), 4))) == want
    q = spark.createDataFrame([(i, i % 13) for i in range(20)], "q long, n long")
    hits = {(i, b, sim_, r + 1) for i in range(20) if i % 13 < 12 for r, (sim_, b) in enumerate(sorted(((float(s[i % 13, number[b]]), b) for b in have), key=lambda x: (-x[0], x[1]))[:7])}
    assert set(rows(vector.search_shared(q, items, vectors, "q", "id", "n", "v", 7).select("q", "id", "score", "rank"))) == hits


def test_levels_in_one_task_as_by_joins(spark, monkeypatch):
    """Both ways give the same levels, and a graph of this size takes no job a round."""
    rng = np.random.default_rng(7)
    names = [f"s{i:03d}" for i in range(60)]
    pairs = {(i, j) for i in range(60) for j in range(i + 1, 60) if rng.uniform() < (0.6 if i // 12 == j // 12 else 0.03)}
    e = spark.createDataFrame([(names[i], names[j], float(rng.integers(1, 9)) / 8) for i, j in sorted(pairs)], "a string, b string, weight double")
    nodes = spark.createDataFrame([(x,) for x in [*names, "alone"]], "node string")
    want = rows(community.levels(nodes, e, most=2, rounds=2, one_task=0))
    assert len({r[1] for r in want}) > 1
    calls, durable = [], community.durable
    monkeypatch.setattr(community, "durable", lambda df: calls.append(1) or durable(df))
    assert rows(community.levels(nodes, e, most=2, rounds=2)) == want and len(calls) == 2


def test_search_is_by_distinct_vectors(spark, monkeypatch):
    met, search = [], vector.search
    monkeypatch.setattr(vector, "search", lambda q, v, *a, **b: met.append((q.count(), v.count())) or search(q, v, *a, **b))
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "n long, v array<double>")
    many = spark.range(300).selectExpr("id", "id % 3 as n")
    assert vector.search_shared(many.withColumnRenamed("id", "q"), many, vectors, "q", "id", "n", "v", 2).count() == 600 and met == [(3, 3)]


def test_graph_hits_of_equal_demands(spark):
    """Any of the categories, each attribute, the district; more stores of one profile than are wanted; a kind or value that nobody has meets nothing."""
    rng = np.random.default_rng(4)
    n, d, c, a = 120, ["Bình", "Đống"], ["Cơm", "Trà", "Phở"], ["price", "service", "speed"]
    st = [(f"s{i:03d}", None if rng.uniform() < 0.1 else float(rng.integers(0, 10)) / 2, d[i % 2] if i % 7 else None) for i in range(n)]
    ct = [(s, x) for s, _, _ in st for x in c if rng.uniform() < 0.4]
    at = [(s, x, float(rng.uniform(-1, 1))) for s, _, _ in st for x in a if rng.uniform() < 0.8]
    w = [(q, k, x) for q in range(40) for k, vs in (("district", d), ("category", c), ("attribute", a)) for x in vs if rng.uniform() < 0.25]
    w += [(50, "price", "low"), (51, "category", "Bún"), (52, "attribute", "none")]
    got = {}
    for q, s, r in rows(retrieval.graph_hits(spark.createDataFrame([(q,) for q in range(53)], "query long"), spark.createDataFrame(w, "query long, kind string, value string"), spark.createDataFrame(st, "store_id string, rating double, district string"), spark.createDataFrame(ct, "store_id string, category string"), spark.createDataFrame(at, "store_id string, attribute string, score double"), 5)):
        got.setdefault(q, {})[r] = s
    for q in range(53):
        asks = {k: {x for p, l, x in w if p == q and l == k} for k in ("district", "category", "attribute", "price")}
        ok = [s for s in st if (not asks["district"] or s[2] in asks["district"]) and (not asks["category"] or any((s[0], x) in ct for x in asks["category"])) and all(any(y[:2] == (s[0], x) and y[2] >= 0.15 for y in at) for x in asks["attribute"]) and not asks["price"]]
        assert [x[1] for x in sorted(got.get(q, {}).items())] == [s[0] for s in sorted(ok, key=lambda s: (s[1] is None, -(s[1] or 0), s[0]))[:5]]


def test_scores_of_texts_as_by_columns(spark):
    from banyan.functions import text
    from banyan.operators import aspects

    words = [w for x in aspects.POLARITY.values() for ws in x for w in ws]
    rng = np.random.default_rng(6)
    data = [(i, "  " + "\t ".join(rng.choice(words, rng.integers(0, 20))).upper() + "\u00a0") for i in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(data, "k long, t string")
    want = df.select("k", F.explode(aspects.polarity(text.normalize_text(F.col("t")))).alias("attribute", "score"))
    assert rows(aspects.polarity_scores(df, "k", "t")) == rows(want)


def test_best_match_writes_only_pairs_that_can_match(spark):
    """Equal rows are compared once, and pairs whose distance and house numbers rule them out are not made."""
    from banyan.operators.match import LEFT, RIGHT, best_match, compared, pairs_in_reach

    step = 0.001  # about 111 m of latitude
    left = [(i, "pho bo", f"{1 + i % 2} bach mai", 21.0, 105.8) for i in range(300)] + [(300, "pho bo", "bach mai", 21.0, 105.8)]
    right = [(1000 + 10 * k + i, "pho bo", ("1 bach mai", "bach mai", "9 bach mai")[k % 3], 21.0 + step * (k // 3), 105.8) for k in range(36) for i in range(10)]
    s = "id int, name string, address string, lat double, lng double"
    a, b = spark.createDataFrame(left, s), spark.createDataFrame(right, s)
    l, r = (compared(d, c).groupBy(*c).agg(F.min("id").alias(k)) for d, c, k in ((a, LEFT, "lid"), (b, RIGHT, "rid")))
    # house 1: all 11 within 1,200 m, 5 without a house within 500 m, none other beyond 40 m; house 2: the one of each other house at its door
    got = sorted((x["lid"], (x["rid"] - 1000) // 10) for x in pairs_in_reach(l, r, 0.5).collect())
    near, own = [3 * k + 1 for k in range(5)], [3 * k for k in range(11)]
    want = [(0, k) for k in sorted([*own, *near, 2])] + [(1, k) for k in sorted([0, *near, 2])] + [(300, k) for k in range(15)]
    assert got == want
    best = {x["left_id"]: x["right_id"] for x in best_match(a, b).collect()}
    assert best == {i: 1010 if i % 2 else 1000 for i in range(301)}
