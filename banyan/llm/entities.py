"""Matching of entities across two sources that share no key.

A shop name is reduced to its kind of food and its core: all words that are neither kind nor generic word, without a street of the gazetteer
(rightly or wrongly written) at the end. Candidates come from blocks that join a key of the name with a key of the place. Keys of the name: MinHash
bands over the core's character pairs, and the misspelt forms of the core among the places' cores (found exactly, by variants with letters
left out). Keys of the place: the district, MinHash bands over the words and numbers of the address, and cells of a grid around the point.
The pairs that the input itself proposes are candidates too. Blocks with many rows are split in a grid of salts. Pairs get features
(agreement of core, kind, house, street, distance, and whether missing); a logistic classifier is fitted on weak
labels given by rules to a bounded sample of the candidates that share a band or are proposed (`SAMPLE` rows, taken by hash); its scores are calibrated by isotonic
regression on another part of the sample, whose probability is the confidence. A one-to-one assignment keeps mutual best pairs, round after round, until none is left.

Defined results: entities without a usable name match nothing; missing addresses and coordinates are features, not errors; several rows of
one entity count by the most frequent value of each attribute (ties by order of value); swapped coordinates are turned back; pairs of equal
confidence are ranked by score, then the smaller key; with no candidates, or none of either label, a fixed prior model is used; empty
tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banyan.functions.geo import haversine_m
from banyan.llm import addresses
from banyan.llm.history import fold
from banyan.session import durable, real_place, real_text, stored

SAMPLE = 40_000
#: Kinds of food in the sources' languages (folded), and words that name no shop.
KINDS = {
    "bun cha": "bun cha", "grilled pork noodle": "bun cha", "pho": "pho", "noodle soup": "pho", "com tam": "com tam", "broken rice": "com tam",
    "com van phong": "com van phong", "rice lunch": "com van phong", "office rice": "com van phong", "tra chanh": "tra chanh", "lemon tea": "tra chanh", "tra sua": "tra sua",
    "milk tea": "tra sua", "bubble tea": "tra sua", "ca phe": "ca phe", "coffee": "ca phe", "cafe": "ca phe", "che": "che", "sweet soup": "che", "lau": "lau", "hotpot": "lau", "hot pot": "lau",
    "mi cay": "mi cay", "spicy noodle": "mi cay", "spicy noodles": "mi cay", "banh mi": "banh mi", "xoi": "xoi", "sticky rice": "xoi", "ga ran": "ga ran", "fried chicken": "ga ran", "sinh to": "sinh to", "smoothie": "sinh to", "smoothies": "sinh to",
}
GENERIC = {"quan", "nha", "hang", "tiem", "and", "more", "drinks", "nho", "do", "an", "vat", "food", "restaurant", "shop", "store", "the"}
TAIL = re.compile(r"&\s*(?:more|drinks|quan nho|do an vat|[a-z ]+)$")
_phrases = sorted(KINDS, key=lambda x: -len(x))


def _edit1(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y or x == y[1:] or x[1:] == y[1:] or (x[:2] == y[:2][::-1] and x[2:] == y[2:])


def name_parts(name: str | None) -> tuple[str, str]:
    """(core with generic words and a street, if it has them, kind) of a shop name; empty where unknown."""
    if not name:
        return "", ""
    t = TAIL.sub(" ", fold(name).strip())
    w = re.findall(r"[a-z0-9]+", t)
    kind, at, size = "", -1, 0
    for p in _phrases:
        q = p.split()
        for i in range(len(w) - len(q) + 1):
            if w[i : i + len(q)] == q:
                kind, at, size = KINDS[p], i, len(q)
                break
        if kind:
            break
    if not kind:
        for p in _phrases:
            q = p.split()
            n = len(q)
            if len(p) < 6:
                continue
            for i in range(len(w) - n + 1):
                if _edit1(" ".join(w[i : i + n]), p):
                    kind, at, size = KINDS[p], i, n
                    break
            if kind:
                break
    rest = w[:at] + w[at + size :] if kind else w
    if rest and rest[0] in ("quan", "nha", "tiem") and len(rest) > 2:
        rest = rest[1:]
    return " ".join(rest), kind


def _minhash(tokens: set[str], bands: int, rows: int) -> list[int]:
    grams = np.fromiter((zlib.crc32(x.encode()) for x in tokens), np.uint64)
    k = np.arange(1, bands * rows + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = (grams[:, None] * (k * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))[None, :]) >> np.uint64(20)
        m = h.min(0).reshape(bands, rows)
        x = np.arange(bands, dtype=np.uint64)
        for i in range(rows):
            x = x * np.uint64(0x7FB5D329728EA185) + m[:, i]
    return x.view(np.int64).tolist()


def _bands(core: str, bands: int = 8, rows: int = 2) -> list[int]:
    s = core.replace(" ", "")
    return _minhash({s[i : i + 2] for i in range(max(1, len(s) - 1))}, bands, rows)


def _address_bands(street: str | None, alleys: str | None, house: str | None, bands: int = 3, rows: int = 2) -> list[int]:
    """Of the words of the street, and the numbers of alleys and house."""
    if not street or not house:
        return []
    return _minhash({*street.split(), f"h {house}", *(f"a {x}" for x in (alleys or "").split("/") if x)}, bands, rows)


#: Characters of a core that its variants are made of at most.
HEAD = 14


def _variants(core: str) -> set[str]:
    """What is left of a core's head without up to as many letters as may be misspelt: misspelt cores have a variant in common."""
    k = 2 if len(core) >= 6 else int(len(core) >= 3)
    out = level = {core[: HEAD + k]}
    for _ in range(k):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return {w[:HEAD] for w in out}


def misspelt(a, b):
    """True where two cores differ by a letter or two, or by the order of the words."""
    d = F.levenshtein(a, b)
    near = (d <= F.when(F.length(a) >= 6, 2).otherwise(1)) & (d <= 0.25 * F.greatest(F.length(a), F.length(b)))
    return near | (F.concat_ws(" ", F.reverse(F.split(a, " "))) == b)


def part_of(a, b):
    """True where all words of one core, two or more, are words of the other."""
    x, y = F.split(a, " "), F.split(b, " ")
    return (F.least(F.size(x), F.size(y)) >= 2) & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))


def near_cores(stores: DataFrame, places: DataFrame) -> DataFrame:
    """Distinct (core, other): each core of the stores with all other cores of the places that are misspelt forms of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cores = b.column("core").to_pylist()
            keys = [_variants(x) | {" ".join(x.split(" ")[::-1])[:HEAD]} for x in cores]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, k in zip(cores, keys) for _ in k], pa.string()), pa.array([v for k in keys for v in k], pa.string())], ["core", "v"])

    a, b = (e.select("core").distinct().mapInArrow(run, "core string, v string") for e in (stores, places))
    pairs = a.join(b.withColumnRenamed("core", "other"), "v").filter(F.col("core") != F.col("other"))
    return pairs.filter(misspelt(F.col("core"), F.col("other"))).select("core", "other").distinct()


def named(df: DataFrame, name: str, key: str, streets: DataFrame) -> DataFrame:
    """df with the core, the kind, and the MinHash bands of name and address; `streets` (street) is the gazetteer."""
    types = df.dtypes

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [name_parts(x) for x in b.column(name).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], [*b.schema.names, "core", "kind"])

    e = durable(df.mapInArrow(parts, ", ".join([*(f"{c} {t}" for c, t in types), "core string, kind string"])))
    # ends of a core, of two words or more after the first, that are a street: the longest holds
    w = e.select(key, F.split("core", " ").alias("w")).filter(F.size("w") >= 3)
    ends = w.select(key, "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("at")).select(key, "at", F.concat_ws(" ", F.slice("w", F.col("at"), F.size("w"))).alias("end"))
    known = streets.select(F.col("street").alias("end")).distinct()
    exact = ends.join(known, "end").groupBy(key).agg(F.min("at").alias("at"))
    wrong = ends.filter("at > 2").join(exact.select(key), key, "left_anti").withColumn("k", F.explode(addresses._deletes(F.col("end"))))
    wrong = wrong.join(known.select(F.col("end").alias("street"), F.explode(addresses._deletes(F.col("end"))).alias("k")), "k").filter(F.levenshtein("end", "street", 2).between(1, 2) & (F.length("street") >= 8))
    found = exact.unionByName(wrong.groupBy(key).agg(F.min("at").alias("at")))
    e = e.join(found, key, "left").withColumn("core", F.concat_ws(" ", F.filter(F.slice(F.split("core", " "), F.lit(1), F.coalesce(F.col("at") - 1, F.lit(10**6))), lambda x, i: (i < 2) | ~x.isin(*GENERIC)))).drop("at")

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            name_bands = [_bands(x) if x else [] for x in b.column("core").to_pylist()]
            place_bands = [_address_bands(*x) for x in zip(*(b.column(c).to_pylist() for c in ("street", "alleys", "house")))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(name_bands, pa.list_(pa.int64())), pa.array(place_bands, pa.list_(pa.int64()))], [*b.schema.names, "bands", "address_bands"])

    return e.mapInArrow(bands, ", ".join([*(f"{c} {t}" for c, t in e.dtypes), "bands array<bigint>, address_bands array<bigint>"]))


def _mode(df: DataFrame, key: str, value, name: str) -> DataFrame:
    """The most frequent real value of each key, counted with partial aggregation."""
    n = df.select(key, value.alias(name)).filter(F.col(name).isNotNull()).groupBy(key, name).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.max_by(name, F.struct("n", name)).alias(name))


def entity(df: DataFrame, key: str, name: str, rec: str, lat: str, lng: str, located: DataFrame) -> DataFrame:
    """One row an entity: (key, name, lat, lng, district, street, alleys, house)."""
    a, o = F.col(lat).cast("double"), F.col(lng).cast("double")
    point = F.when(real_place(a, o), F.struct(a.alias("lat"), o.alias("lng"))).when(real_place(o, a), F.struct(o.alias("lat"), a.alias("lng")))
    keys = df.select(key).filter(F.col(key).isNotNull()).distinct()
    names = _mode(df, key, real_text(F.col(name)), "name")
    points = _mode(df, key, point, "point")
    where = df.select(key, F.col(rec).alias("rec")).join(located.drop("store_id"), "rec").withColumn("at", F.struct("district", "street", "alleys", "house"))
    where = _mode(where, key, F.col("at"), "at")
    return keys.join(names, key).join(points, key, "left").join(where, key, "left").select(key, "name", "point.lat", "point.lng", "at.district", "at.street", "at.alleys", "at.house")


#: Degrees of a grid cell; a store meets the four cells next to it, so all places within half a cell.
CELL = 0.02
#: Rows of a block on one side that one task takes.
BLOCK = 1000


def hot_blocks(d: DataFrame, name: str, rows: int) -> DataFrame:
    """(block, parts) of the blocks with more than `rows` rows, counted within tasks: only blocks that are frequent there are shuffled, so that rare rows of a block may be left out of its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []

        def frequent() -> pa.RecordBatch:
            got = pa.chunked_array(held).value_counts()
            many = got.filter(pa.array(got.field("counts").to_numpy() >= min(8, rows)))
            return pa.RecordBatch.from_arrays([many.field("values"), many.field("counts")], ["block", "n"])

        for b in batches:
            held.append(b.column(0))
            if sum(map(len, held)) >= 1 << 20:
                yield frequent()
                held = []
        if held:
            yield frequent()

    n = d.select("block").mapInArrow(run, f"block {dict(d.dtypes)['block']}, n bigint").groupBy("block").agg(F.sum("n").alias("n"))
    return n.filter(F.col("n") > rows).select("block", F.ceil(F.col("n") / rows).cast("int").alias(name))


def split_join(left: DataFrame, right: DataFrame, rows: int = BLOCK) -> DataFrame:
    """The join of both on `block`; a block with more than `rows` rows on a side is spread over a grid of parts, each pair in one of them.

    Each side is made twice, to find such blocks and to join, and shuffled once. The blocks to split are broadcast: at most one of `rows` rows.
    """
    hot = F.broadcast(stored(hot_blocks(left, "nl", rows).join(hot_blocks(right, "nr", rows), "block", "full").fillna(1, ["nl", "nr"]), "hot-blocks"))

    def spread(d: DataFrame, own: str, other: str, own_salt: str, other_salt: str) -> DataFrame:
        d = d.join(hot, "block", "left").fillna(1, ["nl", "nr"])
        mine = F.when(F.col(own) > 1, F.pmod(F.xxhash64(d.columns[1]), F.col(own)).cast("int")).otherwise(0)
        return d.withColumns({own_salt: mine, other_salt: F.explode(F.sequence(F.lit(0), F.col(other) - 1))}).drop("nl", "nr")

    return spread(left, "nl", "nr", "sl", "sr").join(spread(right, "nr", "nl", "sr", "sl"), ["block", "sl", "sr"]).drop("sl", "sr")


def candidates(stores: DataFrame, places: DataFrame, proposed: DataFrame) -> DataFrame:
    """Distinct (store_id, place_id): the pairs that share a block, and all that are proposed.

    Pairs of one district, address band or grid neighbourhood are candidates where their cores share a band or are misspelt forms of each other.
    """

    def blocks(e: DataFrame, key: str, around: bool) -> DataFrame:
        """(block, key) of entities with a column `band`."""
        i, j = F.col("lat") / CELL, F.col("lng") / CELL
        # the cell of the point, and for stores the three next to it on the nearer sides
        cells = [(F.floor(i + a), F.floor(j + o)) for a in (-0.5, 0.5) for o in (-0.5, 0.5)] if around else [(F.floor(i), F.floor(j))]
        keys = F.concat(
            F.when(F.col("district").isNotNull(), F.array(F.xxhash64(F.lit("d"), "band", "district"))).otherwise(F.array().cast("array<bigint>")),
            F.transform("address_bands", lambda x: F.xxhash64(F.lit("a"), "band", x)),
            F.when(F.col("lat").isNotNull(), F.array(*(F.xxhash64(F.lit("g"), "band", *c) for c in cells))).otherwise(F.array().cast("array<bigint>")),
        )
        return e.select(F.explode(keys).alias("block"), key)

    cols = ["district", "address_bands", "lat", "lng"]
    banded = lambda e, key: e.select(key, *cols, F.explode(F.transform("bands", lambda x: F.xxhash64(F.lit("m"), x))).alias("band"))
    whole = lambda e, key, core: e.select(key, *cols, F.xxhash64(F.lit("w"), core).alias("band"))
    alike = stored(stores.join(near_cores(stores, places), "core").select("store_id", *cols, "other"), "alike")
    left = blocks(banded(stores, "store_id").unionByName(whole(alike, "store_id", "other")), "store_id", True)
    right = blocks(banded(places, "place_id").unionByName(whole(places, "place_id", "core")), "place_id", False)
    return split_join(left, right).select("store_id", "place_id").unionByName(proposed).distinct()


FEATURES = ("exact", "near", "kind_same", "kind_differs", "house_same", "street_same", "street_differs", "far_unknown", "log_m", "within_150", "beyond_1000", "no_place", "proposed", "rare", "blind", "point_only")


def features(pairs: DataFrame, stores: DataFrame, places: DataFrame, proposed: DataFrame) -> DataFrame:
    """The pairs, whether they are banded (their cores share a band, or they are proposed), and their features as an array of doubles."""
    s = stores.select(*(F.col(c).alias(c if c == "store_id" else f"s_{c}") for c in stores.columns if c not in ("name", "address_bands")))
    p = places.select(*(F.col(c).alias(c if c == "place_id" else f"p_{c}") for c in places.columns if c not in ("name", "address_bands")))
    # how many stores share a core tells chains from single shops
    alone = stores.groupBy("core").agg(F.count("*").alias("same")).filter("same = 1").select(F.col("core").alias("s_core"), F.lit(1.0).alias("alone"))
    s = s.join(alone, "s_core", "left")
    f = pairs.join(s, "store_id").join(p, "place_id").join(proposed.withColumn("prop", F.lit(1.0)), ["store_id", "place_id"], "left")
    d = haversine_m(*(F.col(c) for c in ("s_lat", "s_lng", "p_lat", "p_lng")))
    f = f.withColumn("m", d)
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    written = (F.col("s_street") == F.col("p_street")) | (F.levenshtein("s_street", "p_street", 2).between(1, 2) & (F.length("s_street") >= 8))
    street = written & (F.col("s_district") == F.col("p_district"))
    a, b = F.col("s_core"), F.col("p_core")
    near = misspelt(a, b) | part_of(a, b)
    both = (F.col("s_kind") != "") & (F.col("p_kind") != "")
    house = street & (F.col("s_house") == F.col("p_house")) & (F.col("s_alleys") == F.col("p_alleys"))
    value = {
        "exact": yes((a == b) & (a != "")), "near": yes(near & (a != "")), "kind_same": yes(both & (F.col("s_kind") == F.col("p_kind"))), "kind_differs": yes(both & (F.col("s_kind") != F.col("p_kind"))),
        "house_same": yes(house), "street_same": yes(street & ~house), "street_differs": yes(~street & F.col("p_street").isNotNull()), "far_unknown": yes(F.col("m").isNull()),
        "log_m": F.coalesce(F.log1p("m") / 10, F.lit(0.6)), "within_150": yes(F.col("m") <= 150), "beyond_1000": yes(F.col("m") > 1000), "no_place": yes(F.col("m").isNull() & F.col("p_street").isNull()), "proposed": F.coalesce("prop", F.lit(0.0)), "rare": F.coalesce("alone", F.lit(0.0)),
        "blind": yes((a == b) & (F.col("prop") == 1) & F.col("m").isNull() & F.col("p_street").isNull()), "point_only": yes((F.col("m") <= 150) & (F.col("p_street").isNull() | F.col("s_street").isNull())),
    }
    banded = F.arrays_overlap("s_bands", "p_bands") | F.col("prop").isNotNull()
    return f.select("store_id", "place_id", banded.alias("banded"), F.array(*(value[x] for x in FEATURES)).alias("x"))


def weak_label(x: np.ndarray) -> np.ndarray:
    """1 same, 0 different, -1 no opinion, by rules that use strong agreements only."""
    c = {n: x[:, i] for i, n in enumerate(FEATURES)}
    name = (c["exact"] + c["near"]) > 0
    y = np.full(len(x), -1)
    y[(~name) | (c["kind_differs"] > 0)] = 0
    y[~name & (c["kind_differs"] == 0) & (c["house_same"] > 0) & (c["proposed"] > 0)] = -1  # a name that is written quite otherwise, or a neighbour
    y[name & (c["street_differs"] > 0) & (c["within_150"] == 0)] = 0
    y[name & (c["street_same"] > 0) & (c["within_150"] == 0)] = 0
    y[name & (c["kind_differs"] == 0) & (c["house_same"] > 0)] = 1
    y[(c["exact"] > 0) & (c["kind_differs"] == 0) & (c["within_150"] > 0) & (c["street_differs"] == 0) & (c["street_same"] == 0)] = 1
    y[name & (c["kind_differs"] == 0) & (c["point_only"] > 0) & (c["proposed"] > 0)] = 1
    y[(c["exact"] > 0) & (c["kind_differs"] == 0) & (c["no_place"] > 0) & (c["proposed"] > 0)] = -1
    y[(c["exact"] > 0) & (c["kind_differs"] == 0) & (c["no_place"] > 0) & (c["proposed"] > 0) & (c["rare"] > 0)] = 1
    return y


PRIOR = dict(exact=3.0, near=3.0, kind_same=0.8, kind_differs=-5.0, house_same=4.0, street_same=-2.0, street_differs=-4.0, far_unknown=-0.5, log_m=-3.0, within_150=1.5, beyond_1000=-3.0, no_place=0.0, proposed=2.5, rare=2.0, blind=0.5, point_only=0.5)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic weights and intercept by Newton steps, with a ridge towards the prior model that fades as labels grow in number."""
    w0 = np.array([*(PRIOR[n] for n in FEATURES), -3.0])
    if len(np.unique(y)) < 2:
        return w0[:-1], float(w0[-1])
    a = np.c_[x, np.ones(len(x))]
    w = w0.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * (w - w0)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """Points (score, probability) of an increasing line: both ends of each pooled block of scores; probabilities are kept off 0 and 1."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first score, last score
    for s, v in zip(score[order], y[order]):
        blocks.append([float(v), 1.0, float(s), float(s)])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2], b[3]]
    p = np.maximum.accumulate([(b[0] + 0.5) / (b[1] + 1) for b in blocks]).tolist()
    points = sorted({(x, q) for b, q in zip(blocks, p) for x in b[2:]})
    return [x for x, _ in points], [q for _, q in points]


@dataclass
class Model:
    """A fitted classifier with its calibration; z is a score, the confidence the probability on the isotonic line."""

    weights: np.ndarray
    intercept: float
    steps: list[float]
    p: list[float]

    def score(self, x: Column) -> Column:
        return F.lit(self.intercept) + sum((x[i] * F.lit(float(w)) for i, w in enumerate(self.weights)), F.lit(0.0))

    def confidence(self, z: Column) -> Column:
        if not self.steps:
            return 1 / (1 + F.exp(-z))
        if len(self.steps) == 1:
            return F.lit(float(self.p[0]))
        lit = lambda v, n: F.lit(float(v)).alias(n)
        parts = F.array(*(F.struct(lit(a, "a"), lit(p, "p"), lit(b, "b"), lit(q, "q")) for a, p, b, q in zip(self.steps, self.p, self.steps[1:], self.p[1:])))
        between = lambda s: s["p"] + (z - s["a"]) / (s["b"] - s["a"]) * (s["q"] - s["p"])
        return F.aggregate(parts, F.lit(float(self.p[0])), lambda acc, s: F.when(z >= s["b"], s["q"]).when(z > s["a"], between(s)).otherwise(acc))

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights + self.intercept
        return np.interp(z, self.steps, self.p) if self.steps else 1 / (1 + np.exp(-z))


def learn(sample: np.ndarray) -> tuple[Model, np.ndarray, np.ndarray]:
    """The model of a sample of features, and the features and weak labels of the part kept out of fit and calibration."""
    y = weak_label(sample)
    part = np.arange(len(y)) % 4  # two parts fit, one calibrates, one is kept
    known = y >= 0
    w, b = fit(sample[known & (part < 2)], y[known & (part < 2)])
    held = known & (part == 2)
    steps, p = isotonic(sample[held] @ w + b, y[held]) if held.sum() >= 50 else ([], [])
    kept = known & (part == 3)
    return Model(w, b, steps, p), sample[kept], y[kept]


def calibration_error(p: np.ndarray, y: np.ndarray, bins: int = 10) -> float:
    """The mean distance of probability and share of true pairs over bins of probability."""
    at = np.minimum((p * bins).astype(int), bins - 1)
    return float(sum(abs(p[at == i].sum() - y[at == i].sum()) for i in range(bins)) / max(1, len(y)))


def labelled_sample(f: DataFrame) -> np.ndarray:
    """The features of at most SAMPLE pairs that share a band or are proposed, taken by hash."""
    n = f.filter("banded").count()
    bound = max(1, int(2**31 * min(1.0, SAMPLE / max(1, n))))
    h = F.xxhash64("store_id", "place_id")
    sample = f.filter("banded").filter(F.pmod(h, F.lit(2**31)) < bound).select("x", h.alias("h")).orderBy("h").limit(SAMPLE).toPandas()
    return np.array(sample["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))


def match(stores: DataFrame, places: DataFrame, proposed: DataFrame, least: float = 0.5) -> DataFrame:
    """(store_id, place_id, confidence), one to one. Entities need name, core, kind, both bands, lat, lng, district, street, alleys, house."""
    # each step is stored, so that its shuffles are dropped before the next one's are written
    pairs = stored(candidates(stores, places, proposed), "pairs")
    f = stored(features(pairs, stores, places, proposed), "features")
    model, _, _ = learn(labelled_sample(f))
    z = model.score(F.col("x"))
    left = durable(f.select("store_id", "place_id", F.round(model.confidence(z), 6).alias("confidence"), F.round(z, 6).alias("z")).filter(F.col("confidence") >= least))
    done = None
    while True:
        # a pair is kept where it is the best of both its entities
        rank = lambda other: F.struct(-F.col("confidence"), -F.col("z"), other)
        by_store = left.groupBy("store_id").agg(F.min_by("place_id", rank("place_id")).alias("place_id"))
        by_place = left.groupBy("place_id").agg(F.min_by("store_id", rank("store_id")).alias("store_id"))
        got = durable(left.join(by_store, ["store_id", "place_id"]).join(by_place, ["store_id", "place_id"]))
        if got.isEmpty():
            break
        done = got if done is None else done.unionByName(got)
        left = durable(left.join(got.select("store_id"), "store_id", "left_anti").join(got.select("place_id"), "place_id", "left_anti"))
        if left.isEmpty():
            break
    done = left if done is None else done
    return done.select("store_id", "place_id", "confidence")


def shop_sides(master: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stores and the map places of a table of stores with map blocks, and the pairs that its rows propose."""
    own = real_text(F.col("district"))
    m = master.select("store_id", "row_id", "canonical_name", "address", "lat", "lng", "google_name", "google_address", "google_lat", "google_lng", real_text(F.col("google_place_id")).alias("place_id"), own.alias("own"))
    m = m.withColumns({"a": F.concat(F.lit("a"), "row_id"), "g": F.concat(F.lit("g"), "row_id")})
    recs = m.select(F.col("a").alias("rec"), "store_id", real_text(F.col("address")).alias("text"), "own").unionByName(m.select(F.col("g").alias("rec"), "store_id", real_text(F.col("google_address")).alias("text"), "own")).filter("text is not null")
    located = durable(addresses.locate(recs))
    streets = located.select("street").distinct()
    stores = named(entity(m, "store_id", "canonical_name", "a", "lat", "lng", located), "name", "store_id", streets).filter("core <> ''")
    places = named(entity(m, "place_id", "google_name", "g", "google_lat", "google_lng", located), "name", "place_id", streets).filter("core <> ''")
    proposed = m.select("store_id", "place_id").filter("store_id is not null and place_id is not null").distinct()
    return durable(stores), durable(places), proposed


def match_shops(master: DataFrame) -> DataFrame:
    """(store_id, place_id, confidence) of the stores and the map places in a table of stores with map blocks."""
    return match(*shop_sides(master))


def calibration(master: DataFrame) -> DataFrame:
    """(bin, pairs, confidence, share): by tenths of confidence, the mean confidence and the share of weak labels that are true, of pairs kept out of fit and calibration."""
    sides = shop_sides(master)
    model, x, y = learn(labelled_sample(features(candidates(*sides), *sides)))
    p = model.probability(x)
    at = np.minimum((p * 10).astype(int), 9)
    rows = [(int(i), int((at == i).sum()), float(p[at == i].mean()), float(y[at == i].mean())) for i in sorted(set(at.tolist()))]
    return master.sparkSession.createDataFrame(rows, "bin int, pairs bigint, confidence double, share double")
