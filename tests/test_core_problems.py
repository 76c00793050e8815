import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from banyan.operators.instants import _viterbi, by_rules, interpretations, resolve
from banyan.operators.near import haversine_np, points_within
from banyan.plans import core_problems


def brute(q, p):
    out = set()
    for _, a in q.iterrows():
        if not (a.reach >= 0):
            continue
        d = haversine_np(a.lat, a.lng, p.lat.to_numpy(), p.lng.to_numpy())
        out |= {(a.key, k) for k, ok in zip(p.key, d <= a.reach) if ok}
    return out


def near(spark, q, p, **kw):
    a = spark.createDataFrame(q.rename(columns={"key": "s", "lat": "y", "lng": "x", "reach": "r"}))
    b = spark.createDataFrame(p.rename(columns={"key": "l"}))
    return points_within(a, b, "s", "l", "y", "x", "r", **kw)


@pytest.mark.parametrize("strip_rows", [8, 4096])
def test_near_against_brute_force(spark, strip_rows):
    rng = np.random.default_rng(3)
    q = pd.DataFrame({"key": [f"q{i}" for i in range(120)], "lat": rng.uniform(20, 20.2, 120), "lng": rng.uniform(105, 105.2, 120), "reach": rng.uniform(0, 6000, 120)})
    p = pd.DataFrame({"key": [f"p{i}" for i in range(150)], "lat": np.where(np.arange(150) < 60, 20.1, rng.uniform(20, 20.2, 150)), "lng": rng.uniform(105, 105.2, 150)})  # a third on one latitude
    q.loc[0, "reach"] = 3_000_000.0
    got = [tuple(r)[:2] for r in near(spark, q, p, strip_rows=strip_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(q, p)


def test_near_over_the_date_line(spark):
    rng = np.random.default_rng(6)
    q = pd.DataFrame({"key": [f"q{i}" for i in range(80)], "lat": rng.uniform(-80, 80, 80), "lng": np.where(rng.uniform(size=80) < 0.5, 179.99, -179.99) + rng.uniform(-0.01, 0.01, 80), "reach": rng.uniform(0, 400_000, 80)})
    q.loc[0, ["lat", "reach"]] = [89.0, 500_000.0]
    p = pd.DataFrame({"key": [f"p{i}" for i in range(300)], "lat": rng.uniform(-82, 82, 300), "lng": (rng.uniform(-6, 6, 300) + 360) % 360 - 180})
    p.loc[0, ["lat", "lng"]] = [89.5, 0.0]
    got = [tuple(r)[:2] for r in near(spark, q, p).collect()]
    want = brute(q, p)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100 and ("q0", "p0") in want


def test_near_edge_cases(spark):
    q = pd.DataFrame({"key": ["a", "a", "b", "c", None], "lat": [20.0, 20.0, None, 95.0, 20.0], "lng": [105.0] * 5, "reach": [0.0, 0.0, 9.0, 9.0, 9.0]})
    p = pd.DataFrame({"key": ["p", "p"], "lat": [20.0, 20.0], "lng": [105.0, 105.0]})
    assert [tuple(r)[:2] for r in near(spark, q, p).collect()] == [("a", "p")]
    assert near(spark, q, p).filter("false").count() == 0
    empty = spark.createDataFrame([], "l string, lat double, lng double")
    full = spark.createDataFrame([("s", 20.0, 105.0, 5.0)], "s string, y double, x double, r double")
    assert points_within(full, empty, "s", "l", "y", "x", "r").count() == 0


UTC = dt.timezone.utc


def us(*a):
    return int(dt.datetime(*a, tzinfo=UTC).timestamp()) * 1_000_000


CASES = [
    ("2026-01-27T00:29", None, us(2026, 1, 26, 17, 29)),
    ("2025-01-28T08:30:30+02:00", None, us(2025, 1, 28, 6, 30, 30)),
    ("2025-11-05 15:19:54 Asia/Ho_Chi_Minh", "UTC", us(2025, 11, 5, 8, 19, 54)),
    ("18/01/2025 00:55 GMT+7", None, us(2025, 1, 17, 17, 55)),
    ("01:26 CH 13/03/2025", None, us(2025, 3, 13, 6, 26)),
    ("13-02-2026 12:36 AM", "UTC", us(2026, 2, 13, 0, 36)),
    ("ngày 30 tháng 1 năm 2026 lúc 03:48", None, us(2026, 1, 29, 20, 48)),
    ("13 thg 8, 2024, 04:27", "UTC", us(2024, 8, 13, 4, 27)),
    ("Sun, 02 Mar 2025 21:01:35 +0700", None, us(2025, 3, 2, 14, 1, 35)),
    ("1726555872", None, 1726555872000000),
    ("1724572489803", None, 1724572489803000),
    ("20250601T200909", "UTC", us(2025, 6, 1, 20, 9, 9)),
    ("25/08/25 08:26", "UTC", us(2025, 8, 25, 8, 26)),
    ("7/2/2026 1:15", "UTC", us(2026, 2, 7, 1, 15)),
    ("6/17/2025 11:59", "UTC", us(2025, 6, 17, 11, 59)),
    ("31/02/2026 10:00", None, None),
    ("Cách đây 21 ngày", None, us(2025, 5, 11, 1, 0)),
    ("a week ago", None, us(2025, 5, 25, 1, 0)),
    ("Hôm qua 05:50", None, us(2025, 5, 30, 22, 50)),
    ("Hôm nay 05:50", "America/New_York", us(2025, 5, 31, 9, 50)),
    ("2025-10-26 02:30:00", "Europe/Berlin", us(2025, 10, 26, 0, 30)),  # twice: the first
    ("2025-03-30 02:30:00", "Europe/Berlin", us(2025, 3, 30, 1, 30)),  # skipped: the offset before
    ("2025-01-01", "No/Zone", us(2024, 12, 31, 17, 0)),
    ("", None, None), ("---", None, None), ("0000-00-00 00:00:00", None, None), ("không rõ", None, None), (None, None, None),
]


def test_instants(spark):
    crawl = dt.datetime(2025, 6, 1, 1, 0)
    rows = [(i, "s", v, z, crawl) for i, (v, z, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "k int, source string, v string, z string, c timestamp")
    r = interpretations(df, "v", F.col("z"), F.col("c"))
    got = {x["k"]: x["instant_us"] for x in resolve(r, "source", "k", keep=("k",)).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(CASES) if w is not None}


def test_relative_without_crawl_and_empty(spark):
    df = spark.createDataFrame([(1, "s", "3 days ago", None, None)], "k int, source string, v string, z string, c timestamp")
    r = interpretations(df, "v", F.col("z"), F.col("c"))
    assert resolve(r, "source", "k", keep=("k",)).count() == 0
    assert resolve(r.filter("k > 5"), "source", "k", keep=("k",)).count() == 0


def path_cost(path, u, f, c, before=None, after=None):
    seq = [*([before] if before else []), *((u[k], f[k]) for k in path), *([after] if after else [])]
    return sum(c[k] for k in path) + sum(1.0 * ({a[1], b[1]} == {2, 3}) + 2.0 * (b[0] < a[0]) for a, b in zip(seq, seq[1:]))


def test_viterbi_against_all_paths():
    import itertools

    rng = np.random.default_rng(5)
    for _ in range(40):
        n = rng.integers(2, 4, 6)
        at = np.concatenate([[0], np.cumsum(n)]).tolist()
        u, f, c = rng.integers(0, 9, at[-1]).tolist(), rng.integers(1, 4, at[-1]).tolist(), rng.integers(0, 3, at[-1]).astype(float).tolist()
        before, after = (4, 2), (5, 3)
        got = _viterbi(u, f, c, at, before, after, 1.0, 2.0)
        best = min(path_cost(p, u, f, c, before, after) for p in itertools.product(*(range(a, b) for a, b in zip(at, at[1:]))))
        assert abs(path_cost(got, u, f, c, before, after) - best) < 1e-9


@pytest.mark.parametrize("block", [3, 7, 1 << 16])
def test_chains_cut_in_blocks_keep_their_path(spark, block):
    """The cost of the chosen path is that of the best path of the whole chain, wherever it is cut; without a row of one reading as well."""
    import itertools

    rng = np.random.default_rng(block)
    data, want = [], {}
    for s, singles in (("a", 0.4), ("b", 0.1), ("c", 0.0)):
        n = [1 if rng.uniform() < singles else 2 for _ in range(12)]
        rows = [[(int(rng.integers(0, 60)), int(rng.integers(2, 4)), float(rng.integers(0, 3))) for _ in range(k)] for k in n]
        data += [(s, i, r) for i, r in enumerate(rows)]
        u, f, c = ([x[j] for r in rows for x in r] for j in range(3))
        at = np.concatenate([[0], np.cumsum(n)]).tolist()
        want[s] = (rows, min(path_cost(p, u, f, c) for p in itertools.product(*(range(a, b) for a, b in zip(at, at[1:])))))
    df = spark.createDataFrame(data, "s string, i long, readings array<struct<us:bigint,form:int,cost:double>>")
    got = {(r["s"], r["i"]): r["instant_us"] for r in resolve(df, "s", "i", keep=("s", "i"), block=block).collect()}
    assert len(got) == len(data)
    for s, (rows, best) in want.items():
        options = [[x for x in r if x[0] == got[s, i]] for i, r in enumerate(rows)]
        cost = min(path_cost(range(len(p)), *([x[j] for x in p] for j in range(3))) for p in itertools.product(*options))
        assert abs(cost - best) < 1e-9


def test_neighbours_decide_without_rule(spark):
    crawl = dt.datetime(2025, 12, 1)
    v = ["14/03/2025", "04/03/2025", "15/03/2025", "03/16/2025", "03/05/2025", "03/17/2025"]
    df = spark.createDataFrame([(i, "s", x, "UTC", crawl) for i, x in enumerate(v)], "k int, source string, v string, z string, c timestamp")
    r = interpretations(df, "v", F.col("z"), F.col("c"), rule_cost=0.0)
    got = {x["k"]: x["instant_us"] for x in resolve(r, "source", "k", keep=("k",)).collect()}
    assert got[1] == us(2025, 3, 4) and got[4] == us(2025, 3, 5)


def test_the_path_decides_found_rows(spark, monkeypatch):
    """p5_found comes from the Viterbi: with the first reading in its place rows change."""
    d = "/root/testdata/sf0.001"
    rows = lambda: {(r["tab"], r["row_key"]): r["instant_us"] for r in core_problems.p5_found(spark, d).collect()}
    want = rows()
    free = {(r["tab"], r["row_key"]): r["instant_us"] for r in core_problems.p5_by_order(spark, d).collect()}
    assert set(free) == set(want) and any(free[k] != v for k, v in want.items())
    df = spark.createDataFrame([(i, "s", "05/03/2025", "UTC", None) for i in range(3)], "k int, source string, v string, z string, c timestamp")
    first = interpretations(df, "v", F.col("z"), F.col("c")).select("k", F.col("readings")[0]["us"].alias("us"), F.size("readings").alias("n")).first()
    assert first["n"] == 2 and first["us"] == us(2025, 3, 5)
    df = spark.createDataFrame([(i, "s", "03/05/2025", "UTC", None) for i in range(3)], "k int, source string, v string, z string, c timestamp")
    r = interpretations(df, "v", F.col("z"), F.col("c"))
    assert r.select(F.col("readings")[0]["us"].alias("us")).first()["us"] == us(2025, 3, 5)  # the earliest reading, which the path does not take
    assert {x["instant_us"] for x in resolve(r, "source", "k", keep=("k",)).collect()} == {us(2025, 5, 3)}


def test_rules_need_no_path(spark):
    """With rules each row's instant is the path's, whatever its neighbours, so p5_found has no walk in its plan."""
    d = "/root/testdata/sf0.001"
    rows = lambda df: sorted(map(tuple, df.select("tab", "row_key", "instant_us").collect()))
    times = core_problems._times(spark, d)
    walked = resolve(interpretations(times, "v", F.col("tz_name"), F.col("crawled_at")), "source", "ord", keep=("tab", "row_key"))
    found = core_problems.p5_found(spark, d)
    assert rows(found) == rows(walked)
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
    crawl = dt.datetime(2025, 6, 1, 1, 0)
    df = spark.createDataFrame([(i, v, z, crawl) for i, (v, z, _) in enumerate(CASES)], "k int, v string, z string, c timestamp")
    got = {x["k"]: x["instant_us"] for x in by_rules(df, "v", F.col("z"), F.col("c")).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(CASES) if w is not None}


def test_core_queries_run(spark):
    d = "/root/testdata/sf0.001"
    for q in core_problems.QUERIES.values():
        assert q(spark, d).count() > 0
