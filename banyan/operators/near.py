"""Points near other points: a range-partitioned latitude sweep.

Latitude is cut into strips that hold about equally many locations. A location belongs to one strip, its
owner; a query point goes to each strip its circle reaches, so each pair is made once. A strip with too many
rows of either side is split by salts, in a grid of location parts and query parts. Within a part the rows are sorted by
latitude, and a window of query points moves over the locations it can reach, which are kept in order of
longitude; a pair that passes both bounds is verified by the haversine distance.

Circles that cross the line where longitudes begin anew are sought on both sides of it.

Defined results: null or non-finite coordinates, coordinates outside `bounds`, and null, NaN or negative radii
have no pairs; identical rows count once, and a key with several positions has a row for each that fits;
empty tables give no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine_np(lat1, lng1, lat2, lng2):
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lng2 - lng1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def sweep(q: pd.DataFrame, p: pd.DataFrame, pairs_at_once: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions in q (lat, lng, reach) and in p (lat, lng), and the distance, of each pair within reach."""
    qo, po = np.argsort(q["lat"].to_numpy(), kind="stable"), np.argsort(p["lat"].to_numpy(), kind="stable")
    qlat, qlng, r = (q[c].to_numpy()[qo] for c in ("lat", "lng", "reach"))
    plat, plng = (p[c].to_numpy()[po] for c in ("lat", "lng"))
    dlat = np.degrees(r / EARTH_M) + 1e-9
    ratio = np.sin(np.minimum(r / EARTH_M, math.pi / 2)) / np.maximum(np.cos(np.radians(np.minimum(np.abs(qlat) + dlat, 90))), 1e-12)
    dlng = np.where(ratio >= 1, 360.0, np.degrees(np.arcsin(np.minimum(ratio, 1)))) + 1e-9
    for start in range(0, len(qo), 128):
        b = slice(start, start + 128)
        lo, hi = np.searchsorted(plat, (qlat[b] - dlat[b]).min()), np.searchsorted(plat, (qlat[b] + dlat[b]).max(), side="right")
        if lo >= hi:
            continue
        by_lng = lo + np.argsort(plng[lo:hi], kind="stable")  # the active set, in order of longitude
        lng = plng[by_lng]
        left, right = np.searchsorted(lng, qlng[b] - dlng[b]), np.searchsorted(lng, qlng[b] + dlng[b], side="right")
        n = right - left
        cum = np.cumsum(n)
        i = 0
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(cum, (cum[i - 1] if i else 0) + pairs_at_once, side="right")))
            k = n[i:j]
            qi = np.repeat(np.arange(start + i, start + j), k)
            pi = by_lng[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(left[i:j], k)]
            near = np.abs(plat[pi] - qlat[qi]) <= dlat[qi]
            qi, pi = qi[near], pi[near]
            d = haversine_np(qlat[qi], qlng[qi], plat[pi], plng[pi])
            ok = d <= r[qi]
            if ok.any():
                yield qo[qi[ok]], po[pi[ok]], d[ok]
            i = j


def sweep_tagged(q: pd.DataFrame, p: pd.DataFrame, reaches: tuple[float, float, float]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Like sweep, with the reach bounded by whether the tags are the same, one has none, or they differ."""
    code, _ = pd.factorize(pd.concat([q["tag"], p["tag"]]).replace("", None).to_numpy(dtype=object))
    a, b = code[: len(q)], code[len(q) :]

    def some(i: np.ndarray, j: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if len(i) and len(j) and reach >= 0:
            part = q.iloc[i]
            for x, y, d in sweep(part.assign(reach=part["reach"].clip(upper=reach)), p.iloc[j]):
                yield i[x], j[y], d

    same, either, differ = reaches
    known, other = np.flatnonzero(a >= 0), np.flatnonzero(b >= 0)
    yield from some(np.flatnonzero(a < 0), np.arange(len(p)), either)
    yield from some(known, np.flatnonzero(b < 0), either)
    for i, j, d in some(known, other, differ):
        apart = a[i] != b[j]
        yield i[apart], j[apart], d[apart]
    by_q, by_p = known[np.argsort(a[known], kind="stable")], other[np.argsort(b[other], kind="stable")]
    for c in np.intersect1d(a[known], b[other]):
        i, j = (x[slice(*np.searchsorted(k[x], [c, c + 1]))] for x, k in ((by_q, a), (by_p, b)))
        yield from some(i, j, same)


def points_within(
    queries: DataFrame,
    places: DataFrame,
    query_key: str,
    place_key: str,
    query_lat: str,
    query_lng: str,
    radius: str,
    place_lat: str = "lat",
    place_lng: str = "lng",
    bounds: tuple[float, float, float, float] = (-90.0, 90.0, -180.0, 180.0),
    strip_rows: int = 4096,
    max_strips: int = 4096,
    tag: str | None = None,
    reaches: tuple[float, float, float] = (0.0, 0.0, 0.0),
) -> DataFrame:
    """(query_key, place_key, distance_m) of each pair within the query's radius in metres.

    With `tag`, a text of both sides, `reaches` bound the radius further: of pairs with the same tag, of pairs of which one has none (null or empty), and
    of pairs with different tags; there are no pairs at a negative one.

    `max_strips` bounds the list of strip borders that the driver holds; strips then grow beyond `strip_rows` and
    are split by salts instead.
    """
    s0, s1, e0, e1 = bounds

    def good(lat: Column, lng: Column) -> Column:
        return lat.between(s0, s1) & lng.between(e0, e1) & ~F.isnan(lat) & ~F.isnan(lng)

    tagged_as = lambda: (F.col(tag) if tag else F.lit(None)).cast("string").alias("tag")
    qs = queries.select(F.col(query_key).cast("string").alias("key"), tagged_as(), *(F.col(c).cast("double").alias(n) for c, n in ((query_lat, "lat"), (query_lng, "lng"), (radius, "reach"))))
    qs = qs.filter(F.col("key").isNotNull() & good(F.col("lat"), F.col("lng")) & (F.col("reach") >= 0) & ~F.isnan("reach")).distinct()
    ps = places.select(F.col(place_key).cast("string").alias("key"), tagged_as(), F.col(place_lat).cast("double").alias("lat"), F.col(place_lng).cast("double").alias("lng"))
    ps = ps.filter(F.col("key").isNotNull() & good(F.col("lat"), F.col("lng"))).distinct()

    n = ps.count()
    strips = int(min(max_strips, max(1, math.ceil(n / strip_rows))))
    cuts = ps.agg(F.percentile_approx("lat", [i / strips for i in range(1, strips)] or [0.5], 20 * max_strips).alias("c")).first()["c"] if n else []
    edges = np.unique(np.array(cuts if strips > 1 else [], dtype=float))

    @F.pandas_udf("int")
    def strip_of(lat: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, lat.to_numpy(), side="right").astype("int32"))

    deg = 180 / math.pi / EARTH_M
    ps = ps.withColumn("strip", strip_of("lat"))
    qs = qs.withColumns({"lo": strip_of(F.col("lat") - F.col("reach") * deg - 1e-9), "hi": strip_of(F.col("lat") + F.col("reach") * deg + 1e-9)})
    qs = qs.withColumn("strip", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")
    if e1 - e0 >= 360:  # a circle over the line where longitudes begin anew is sought on both sides of it
        span = F.when(F.abs("lat") + F.col("reach") * deg >= 89.9, 360.0).otherwise(F.col("reach") * deg / F.cos(F.radians(F.least(F.lit(89.9), F.abs("lat") + F.col("reach") * deg))) + 1e-6)
        turns = F.array_compact(F.array(F.lit(0.0), F.when((F.col("lng") + span > 180) & (span < 180), F.lit(-360.0)), F.when((F.col("lng") - span < -180) & (span < 180), F.lit(360.0))))
        qs = qs.withColumn("turn", F.explode(turns)).withColumn("lng", F.col("lng") + F.col("turn")).drop("turn")
    # one row a strip, so at most max_strips rows
    counts = (
        ps.groupBy("strip").agg(F.count("*").alias("np"))
        .join(qs.groupBy("strip").agg(F.count("*").alias("nq")), "strip")
        .select("strip", F.ceil(F.col("np") / (2 * strip_rows)).cast("int").alias("pn"), F.ceil(F.col("nq") / (2 * strip_rows)).cast("int").alias("qn"))
    )
    counts = F.broadcast(counts)
    salt = lambda n: F.pmod(F.xxhash64("key", "lat", "lng"), F.col(n)).cast("int")
    tagged = (
        ps.join(counts, "strip").select("strip", salt("pn").alias("pp"), F.explode(F.sequence(F.lit(0), F.col("qn") - 1)).alias("qp"), F.lit(False).alias("is_q"), "key", "tag", "lat", "lng", F.lit(None).cast("double").alias("reach"))
        .unionByName(qs.join(counts, "strip").select("strip", F.explode(F.sequence(F.lit(0), F.col("pn") - 1)).alias("pp"), salt("qn").alias("qp"), F.lit(True).alias("is_q"), "key", "tag", "lat", "lng", "reach"))
    )
    kinds = dict(queries.dtypes)[query_key], dict(places.dtypes)[place_key]

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pairs(df: pd.DataFrame) -> Iterator[pd.DataFrame]:
            q, p = df[df["is_q"]], df[~df["is_q"]]
            if len(q) and len(p):
                qk, pk = q["key"].to_numpy(), p["key"].to_numpy()
                for a, b, d in sweep_tagged(q, p, reaches) if tag else sweep(q, p):
                    yield pd.DataFrame({query_key: qk[a], place_key: pk[b], "distance_m": d})

        held: list[pd.DataFrame] = []
        at = None
        for df in batches:
            for g, part in df.groupby(["strip", "pp", "qp"], sort=False):
                if g != at and held:
                    yield from pairs(pd.concat(held))
                    held = []
                at = g
                held.append(part)
        if held:
            yield from pairs(pd.concat(held))

    found = tagged.repartition("strip", "pp", "qp").sortWithinPartitions("strip", "pp", "qp").mapInPandas(parts, f"{query_key} string, {place_key} string, distance_m double")
    back = [F.col(c) if k == "string" else F.col(c).cast(k).alias(c) for c, k in zip((query_key, place_key), kinds)]
    return found.select(*back, "distance_m")
