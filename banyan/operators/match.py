"""Fuzzy matching of records by weighted signals, with the pairs within reach in place of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banyan.functions.geo import GEO_STEPS, geo_score
from banyan.functions.text import house_number, jaccard, norm_text, sequence_ratio, token_set, without_house
from banyan.operators.near import points_within
from banyan.session import stored


def cells(lat: Column, lng: Column, size: float, around: bool = False) -> Column:
    """The grid cell of a point, or it and its eight neighbours, as an array of cell numbers."""
    i, j = F.floor(lat / size), F.floor(lng / size)
    step = F.sequence(F.lit(-1), F.lit(1)) if around else F.array(F.lit(0))
    return F.flatten(F.transform(step, lambda a: F.transform(step, lambda b: (i + a) * F.lit(100_000_000) + (j + b))))


def pair_score(geo: Column, house_same: Column, house_differs: Column, name: Column, token: Column, street: Column) -> Column:
    """.55 geo + .20 house + .17 name + .05 tokens + .03 street, -.30 for other houses, -.45 where neither name nor tokens agree."""
    base = 0.55 * geo + 0.20 * house_same + 0.17 * name + 0.05 * token + 0.03 * street
    return base - F.when(house_differs > 0, 0.30).otherwise(0.0) - F.when((name < 0.35) & (token < 0.10), 0.45).otherwise(0.0)


#: What is compared of a row, besides its id; rows that agree in it are one.
LEFT, RIGHT = ("lat", "lng", "n", "qn", "h", "s", "qs"), ("lat", "lng", "n", "h", "s")


def compared(d: DataFrame, of: tuple[str, ...]) -> DataFrame:
    """(id, *of) of the rows that have an id and coordinates; texts are normalised, and empty where unknown."""
    has = lambda f, c: f(F.col(c)) if c in d.columns else F.lit(None).cast("string")
    value = {
        "n": has(norm_text, "name"), "qn": has(norm_text, "query_name"), "h": F.coalesce(has(house_number, "address"), has(house_number, "query_address")),
        "s": has(without_house, "address"), "qs": has(without_house, "query_address"),
    }
    places = d.select("id", *(F.col(c).cast("double").alias(c) for c in ("lat", "lng")), *(F.coalesce(value[c], F.lit("")).alias(c) for c in of if c in value))
    return places.filter("id is not null and lat is not null and lng is not null and not isnan(lat) and not isnan(lng)")


def pairs_in_reach(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(lid, rid, m) of the pairs whose distance and house numbers can reach the least score."""
    reach = lambda rest: max((float(m) for m, s in GEO_STEPS if 0.55 * s + rest >= least - 2e-9), default=-1.0)
    reaches = reach(0.20 + 0.25), reach(0.25), reach(0.25 - 0.30)
    q = left.select("lid", "lat", "lng", "h", F.lit(max(reaches)).alias("__r"))
    p = right.select("rid", F.col("lat").alias("__lat"), F.col("lng").alias("__lng"), "h")
    found = points_within(q, p, "lid", "rid", "lat", "lng", "__r", "__lat", "__lng", tag="h", reaches=reaches)
    return found.groupBy("lid", "rid").agg(F.min("distance_m").alias("m"))


def best_match(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """(left_id, right_id, score, distance_m, confidence): the best candidate of each left row, ties to the nearer one, then the smaller id.

    Both sides have (id, name, address, lat, lng), and the left one may have query_name and query_address, of which the better agreement counts. Names and
    streets are compared by the share of matched blocks. Beyond 1,200 m the distance scores nothing and all else .45 at most, so for a
    least score above that the pairs within 1,200 m, found by the sweep over latitude, are all that can match; pairs whose distance and house
    number cannot reach it are left out within the sweep, before a pair is written. Rows of a side that agree in all that is compared are one row
    in it: on the right the one of the smallest id, which wins among them; on the left the match is that of all of them. Rows without coordinates match nothing.
    """
    if least <= 0.45:
        raise ValueError("a least score of .45 or below needs pairs at any distance")
    rows = stored(compared(left, LEFT), "match-left")
    l = stored(rows.groupBy(*LEFT).agg(F.min("id").alias("lid")), "match-left-one")
    r = stored(compared(right, RIGHT).groupBy(*RIGHT).agg(F.min("id").alias("rid")), "match-right-one")
    side = lambda d, p: d.select(f"{p}id", *(F.col(c).alias(f"{p}{c}") for c in d.columns if c in LEFT[2:]))
    p = pairs_in_reach(l, r, least).join(side(l, "l"), "lid").join(side(r, "r"), "rid")
    both = (F.col("lh") != "") & (F.col("rh") != "")
    p = p.withColumns({"geo": geo_score(F.col("m")), "same": (both & (F.col("lh") == F.col("rh"))).cast("double"), "differs": (both & (F.col("lh") != F.col("rh"))).cast("double")})
    p = p.filter(0.55 * F.col("geo") + 0.20 * F.col("same") + 0.25 - 0.30 * F.col("differs") >= least - 1e-9)
    ratio = lambda a, b: F.when((F.col(a) != "") & (F.col(b) != ""), sequence_ratio(F.col(a), F.col(b))).otherwise(0.0)
    words = lambda c: token_set(F.col(c))
    p = p.withColumns({"name": F.greatest(ratio("ln", "rn"), ratio("lqn", "rn")), "street": F.greatest(ratio("ls", "rs"), ratio("lqs", "rs")), "token": F.greatest(jaccard(words("ln"), words("rn")), jaccard(words("lqn"), words("rn")))})
    p = p.withColumn("score", F.round(pair_score(F.col("geo"), F.col("same"), F.col("differs"), F.col("name"), F.col("token"), F.col("street")), 6)).filter(F.col("score") >= least)
    best = p.groupBy("lid").agg(F.min_by(F.struct("rid", "score", "m"), F.struct(-F.col("score"), F.col("m"), F.col("rid"))).alias("b"))
    best = rows.join(l.join(best, "lid"), list(LEFT)).select("id", "b")
    return best.select(F.col("id").alias("left_id"), F.col("b.rid").alias("right_id"), F.col("b.score").alias("score"), F.round("b.m", 1).alias("distance_m"), F.when(F.col("b.score") >= 0.75, "high").otherwise("medium").alias("confidence"))


def match_with_fallback(left: DataFrame, right: DataFrame, direct: DataFrame, least: float = 0.5) -> DataFrame:
    """(left_id, right_id, method): the pairs that are given (left_id, right_id), the smallest right id of each, and for all other left rows the best match among the rows that no given pair has."""
    d = direct.filter(F.col("left_id").isNotNull() & F.col("right_id").isNotNull()).groupBy("left_id").agg(F.min("right_id").alias("right_id"))
    d = d.join(left.select(F.col("id").alias("left_id")), "left_id", "left_semi").join(right.select(F.col("id").alias("right_id")), "right_id", "left_semi")
    rest = left.join(d.select(F.col("left_id").alias("id")), "id", "left_anti")
    free = right.join(d.select(F.col("right_id").alias("id")), "id", "left_anti")
    return d.select("left_id", "right_id", F.lit("id").alias("method")).unionByName(best_match(rest, free, least).select("left_id", "right_id", F.lit("fuzzy").alias("method")))
