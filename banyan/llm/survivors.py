"""The best representative of each group of duplicate records.

One latent two-sided quality model is used twice. Observers state things about a group; each observer has a sensitivity (it states what is true)
and a specificity (it does not state what is false), and both are inferred together with the probability that each stated thing is true, by
expectation-maximisation run to convergence over the counts of statement patterns.

1. Which row stands for its group: the observers are trust, fullness and time, each states the rows that are first in it. `representatives` takes the row
   with the greatest posterior, and then checks exactly whether it `dominates`: first in all three, and the only such row of two or more.
2. Which values are true: the observers are the sources (a source at a trust level), with a prior that follows trust, and a field may have several
   true values. `fused` builds one record a group, field by field, from the most probable values (ties to the more trusted, then the later);
   `values` returns every value judged true. Rows with equal posterior are ranked by the sum of their values' probabilities.

No observer counts as worse than chance, so naming a row or value never makes it less likely. Groups are only ever aggregated, and what is collected
are counts of patterns of at most `MOST_SOURCES` observers, so a group may hold any share of the rows.

Defined results: null, blank and stand-in values make no claim; coordinates count as one value, real only where both make a place; rows with a null key are left
out; identical rows tie, so none of them dominates; a group of one row has a representative but no domination; a null time is the earliest; empty
tables give no rows; extra columns count as values.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banyan.session import durable, real_place, real_text

#: The writings of the trust levels.
TRUST = {3: ("high", "cao"), 2: ("medium", "med", "trung bình", "trung binh", "vừa"), 1: ("low", "thấp", "thap")}
#: The writings of the sources, without case and separators.
SOURCES = {"top5_recommendation": ("top5recommendation", "top5", "betop5"), "foody_hust_places": ("foodyhustplaces", "foody", "foodyhust"), "google_maps_unique": ("googlemapsunique", "googlemaps", "gmaps", "google")}
MOST_SOURCES = 16
LEVELS = 4
#: The prior sensitivity and specificity of a source by its trust level, worth `WEIGHT` statements.
LEVEL_PRIOR, WEIGHT = (0.6, 0.65, 0.75, 0.85), 20.0
#: The observers of rows, in the order of their bits.
JUDGES = ("trust", "filled", "at")
ALL = (1 << len(JUDGES)) - 1


def trust_level(c: Column) -> Column:
    """3 high, 2 medium, 1 low, 0 none or unreadable."""
    t = F.lower(F.trim(F.regexp_replace(c, r"[\s ]+", " ")))
    out = F.lit(0)
    for level, names in TRUST.items():
        out = F.when(t.isin(*names), F.lit(level)).otherwise(out)
    return F.coalesce(out, F.lit(0))


def source_of(c: Column) -> Column:
    """The source however it is written; unknown writings stand for themselves."""
    t = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    out = t
    for name, writings in SOURCES.items():
        out = F.when(t.isin(*writings), F.lit(name)).otherwise(out)
    return out


def source_number(c: Column) -> Column:
    """1 and up for the known sources, 0 for all others."""
    s = source_of(c)
    return F.coalesce(*(F.when(s == n, F.lit(i)) for i, n in enumerate(SOURCES, 1)), F.lit(0))


def value_columns(df: DataFrame, skip: tuple[str, ...], pairs: tuple[tuple[str, str], ...]) -> dict[str, Column]:
    """name -> the real value as text, null where it is none; a pair of coordinates is one value."""
    inside = {c for p in pairs for c in p}
    out: dict[str, Column] = {}
    for c, kind in df.dtypes:
        if c in skip or c in inside:
            continue
        v = F.col(f"`{c}`")
        if kind == "string":
            out[c] = real_text(v)
        elif kind in ("double", "float"):
            out[c] = F.when(~F.isnan(v), v).cast("string")
        else:
            out[c] = v.cast("string")
    for a, b in pairs:
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        out[f"{a}+{b}"] = F.when(real_place(x, y), F.concat_ws(",", x.cast("string"), y.cast("string")))
    return out


# --- the model ---


@dataclass
class Quality:
    """What is inferred: the posterior of each pattern, and each observer's sensitivity and specificity."""

    p: np.ndarray
    sens: np.ndarray
    spec: np.ndarray
    rounds: int


def infer(yes: np.ndarray, no: np.ndarray, n: np.ndarray, prior: np.ndarray, weight: float = WEIGHT, tolerance: float = 1e-9, most: int = 2000) -> Quality:
    """Expectation-maximisation over patterns: bits of the observers that state a thing, of those that state another, and how often."""
    bits = np.arange(len(prior))
    y, x = ((m[:, None] >> bits & 1).astype(float) for m in (yes, no))
    sens, spec, share = prior.copy(), prior.copy(), 0.5
    p = np.zeros(len(n))
    for r in range(1, most + 1):
        z = np.log(share / (1 - share)) + y @ np.log(sens / (1 - spec)) + x @ np.log((1 - sens) / spec)
        new = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        t, f = new * n, (1 - new) * n
        sens = np.clip((t @ y + weight * prior) / (t @ (y + x) + weight), 0.51, 0.999)
        spec = np.clip((f @ x + weight * prior) / (f @ (y + x) + weight), 0.51, 0.999)
        share = float(np.clip((t.sum() + 1) / (n.sum() + 2), 1e-6, 1 - 1e-6))
        done = len(n) == 0 or np.abs(new - p).max() < tolerance
        p = new
        if done:
            break
    return Quality(p, sens, spec, r)


def posterior(stated: DataFrame, prior: np.ndarray, out: str = "p") -> DataFrame:
    """`stated` (yes, no, ...) with the posterior of each row. The patterns that are collected are at most 3 ** (observers of one group)."""
    if len(prior) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} observers")
    spark = stated.sparkSession
    k = stated.groupBy("yes", "no").agg(F.count("*").alias("n")).toPandas()
    q = infer(k["yes"].to_numpy(np.int64), k["no"].to_numpy(np.int64), k["n"].to_numpy(float), prior)
    small = spark.createDataFrame([(int(a), int(b), float(p)) for a, b, p in zip(k["yes"], k["no"], q.p)], f"yes int, no int, {out} double")
    return stated.join(F.broadcast(small) if len(k) <= 100_000 else small, ["yes", "no"])


# --- rows ---


@dataclass
class Groups:
    """How a table's rows form groups and what they state."""

    df: DataFrame
    key: str
    group: dict[str, Column]
    number: Column  # of the source, under MOST_SOURCES / LEVELS
    trust: Column
    time: str
    values: dict[str, Column]

    @property
    def sources(self) -> np.ndarray:
        return np.tile(np.array(LEVEL_PRIOR), MOST_SOURCES // LEVELS)

    def rows(self) -> DataFrame:
        """The rows of groups: (*group, row_key, trust, at, src, filled, v), v the real values as array<struct<col, val>>."""
        ok = reduce(lambda a, b: a & b, (g.isNotNull() for g in self.group.values()))
        at = F.coalesce(F.col(self.time).cast("timestamp"), F.to_timestamp(F.lit("1900-01-01")))
        filled = sum((v.isNotNull().cast("int") for v in self.values.values()), F.lit(0))
        v = F.array(*(F.struct(F.lit(n).alias("col"), v.alias("val")) for n, v in self.values.items()))
        return self.df.filter(ok).select(
            *(c.alias(n) for n, c in self.group.items()), F.col(self.key).alias("row_key"), trust_level(self.trust).alias("trust"), at.alias("at"), (self.number * LEVELS + trust_level(self.trust)).alias("src"), filled.alias("filled"), v.alias("v")
        )


def judged(g: Groups) -> DataFrame:
    """(*group, row_key, size, yes, no): the judges by whom each row is first in its group, as bits, and the others."""
    keys = list(g.group)
    rows = g.rows().select(*keys, "row_key", *JUDGES)
    top = rows.groupBy(*keys).agg(*(F.max(j).alias(f"top_{j}") for j in JUDGES), F.count("*").alias("size"))
    first = sum(((F.col(j) == F.col(f"top_{j}")).cast("int") * (1 << i) for i, j in enumerate(JUDGES)), F.lit(0))
    return durable(rows.join(top, keys).select(*keys, "row_key", "size", first.alias("yes"), (F.lit(ALL) - first).alias("no")))


def representatives(g: Groups, quality: DataFrame | None = None) -> DataFrame:
    """(*group, row_key, p, size, dominates): the representative of each group; `quality` (row_key, quality) ranks rows of equal posterior."""
    keys = list(g.group)
    j = judged(g)
    # groups of one row tell nothing about the judges
    pairs = posterior(j.filter("size > 1"), np.full(len(JUDGES), 0.8)).unionByName(j.filter("size = 1").withColumn("p", F.lit(1.0)))
    if quality is not None:
        pairs = pairs.join(quality, "row_key", "left").fillna(0.0, ["quality"])
    order = F.struct("p", *(["quality"] if quality is not None else []), "row_key")
    best = pairs.groupBy(*keys).agg(F.max_by(F.struct("row_key", "p", "yes"), order).alias("b"), F.max("size").alias("size"), F.count_if(F.col("yes") == ALL).alias("full"))
    # the exact check of what the model chose
    dominates = (F.col("b.yes") == ALL) & (F.col("full") == 1) & (F.col("size") > 1)
    return best.select(*keys, "b.row_key", "b.p", "size", dominates.alias("dominates"))


# --- values ---


def truths(claimed: DataFrame, keys: list[str], prior: np.ndarray) -> DataFrame:
    """(*keys, col, val, p, trust, at) of claims (*keys, col, val, src, trust, at): the probability that each stated value is true."""
    bit = F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("src")))
    by_val = claimed.groupBy(*keys, "col", "val").agg(bit.alias("yes"), F.max(F.struct("trust", "at")).alias("last"))
    by_col = by_val.groupBy(*keys, "col").agg(F.bit_or("yes").alias("voters"))
    facts = by_val.join(by_col, [*keys, "col"]).withColumn("no", F.col("voters").bitwiseAND(F.bitwise_not("yes")))
    return posterior(durable(facts), prior).select(*keys, "col", "val", "p", "last.trust", "last.at")


def claims(g: Groups) -> DataFrame:
    """(*keys, row_key, col, val, src, trust, at): what each row states."""
    c = g.rows().select(*g.group, "row_key", "src", "trust", "at", F.explode("v").alias("x"))
    return c.select(*g.group, "row_key", "x.col", "x.val", "src", "trust", "at").filter("val is not null")


def values(g: Groups, least: float = 0.5) -> DataFrame:
    """(*keys, col, val, p, best): each value judged true, and the best value of a field even where none is."""
    keys = list(g.group)
    t = durable(truths(claims(g), keys, g.sources))
    best = t.groupBy(*keys, "col").agg(F.max_by("val", F.struct("p", "trust", "at", "val")).alias("__best"))
    return t.join(best, [*keys, "col"]).withColumn("best", F.col("val") == F.col("__best")).filter((F.col("p") >= least) | F.col("best")).select(*keys, "col", "val", "p", "best")


def fused(g: Groups) -> DataFrame:
    """(*keys, row_key, size, dominates, record): the representative row and the record built field by field, a map from column to best value."""
    keys = list(g.group)
    c = claims(g)
    t = durable(truths(c, keys, g.sources))
    quality = c.select(*keys, "row_key", "col", "val").join(t.select(*keys, "col", "val", "p"), [*keys, "col", "val"]).groupBy("row_key").agg(F.sum("p").alias("quality"))
    field = t.groupBy(*keys, "col").agg(F.max_by("val", F.struct("p", "trust", "at", "val")).alias("val"))
    record = field.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("col", "val")))).alias("record"))  # a row a column
    return representatives(g, quality).join(record, keys, "left").select(*keys, "row_key", "size", "dominates", "record")


# --- the tables ---


def store_groups(master: DataFrame) -> Groups:
    v = value_columns(master, ("row_id", "updated_at", "google_match_confidence", "store_id"), (("google_lat", "google_lng"),))
    return Groups(master, "row_id", {"store_id": real_text(F.col("store_id"))}, F.lit(0), F.col("google_match_confidence"), "updated_at", v)


def source_groups(source_map: DataFrame) -> Groups:
    v = value_columns(source_map, ("map_id", "crawled_at", "match_confidence"), ())
    name = F.col("source_name")
    return Groups(source_map, "map_id", {"store_id": real_text(F.col("store_id")), "source": source_of(name)}, source_number(name), F.col("match_confidence"), "crawled_at", v)
