"""Queries on nested values, overrides, unpivots and ordered lists."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from banyan.functions import nested, text
from banyan.operators.conform import first_wins, pick
from banyan.plans.base import query

_S1 = "s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY row_id) AS rn FROM store_master) WHERE rn = 1)"


@query("SELECT o_orderkey, coalesce(l.price, o_totalprice) AS price FROM orders LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS price FROM lineitem WHERE l_discount > 0.05 GROUP BY 1) l ON o_orderkey = l_orderkey")
def nested_path_fallback(t):
    """The greatest price of a discounted line, from a nested place, else the total of the order itself."""
    l = t.lineitem.filter("l_discount > 0.05").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("price"))
    d = t.orders.join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_totalprice", F.struct(F.struct("price").alias("info")).alias("detail"))
    return d.select("o_orderkey", nested.at_path(d, "detail.info.price", "detail.price", "o_totalprice").alias("price"))


@query("SELECT row_id, canonical_name AS name, district FROM store_master")
def drop_nested_fields(t):
    """A nested record without its image fields."""
    d = t.store_master.select("row_id", F.struct(F.col("canonical_name").alias("name"), F.col("google_website").alias("image_url"), F.struct("district", F.col("google_phone").alias("photo")).alias("place")).alias("r"))
    return d.select("row_id", nested.without_fields("r", d.schema["r"].dataType, ("image", "photo", "thumbnail", "picture")).alias("r")).select("row_id", "r.name", "r.place.district")


@query("SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k, 1::BIGINT AS keys FROM events")
def drop_map_keys(t):
    m = nested.map_without(F.map_concat(text.map_or_empty(F.col("props")), F.create_map(F.lit("photo_1"), F.col("event_type"))), ("photo", "image"))
    return t.events.select("event_id", m.alias("m")).select("event_id", F.col("m")["k"].cast("bigint").alias("k"), F.size("m").cast("bigint").alias("keys"))


@query("""SELECT row_id, CASE WHEN google_name IS NOT NULL THEN google_name ELSE canonical_name END AS name, CASE WHEN google_phone IS NOT NULL THEN google_phone END AS phone, (1 + (google_phone IS NOT NULL)::INT)::BIGINT AS keys FROM store_master""")
def merge_map_list(t):
    """The maps of two sources into one, the last value of a key holds."""
    own = F.create_map(F.lit("name"), F.col("canonical_name"))
    found = F.map_filter(F.create_map(F.lit("name"), F.col("google_name"), F.lit("phone"), F.col("google_phone")), lambda k, v: v.isNotNull())
    return t.store_master.select("row_id", nested.merge_maps(F.array(own, found)).alias("m")).select("row_id", F.col("m")["name"].alias("name"), F.try_element_at("m", F.lit("phone")).alias("phone"), F.size("m").cast("bigint").alias("keys"))


@query(f"WITH {_S1} SELECT store_id, name, flag FROM (SELECT store_id, unnest([{{'name': 'phone', 'flag': (google_phone IS NOT NULL)::INT}}, {{'name': 'website', 'flag': (google_website IS NOT NULL)::INT}}], recursive := true) FROM s)")
def bool_map_rows(t):
    s = first_wins(t.store_master, ["store_id"], "row_id")
    m = s.select("store_id", F.create_map(F.lit("phone"), F.col("google_phone").isNotNull(), F.lit("website"), F.col("google_website").isNotNull()).alias("m"))
    return nested.flags(m, "store_id", "m")


@query("SELECT ingest_id, CASE WHEN review_text IS NOT NULL THEN [review_text] WHEN reviewer IS NOT NULL THEN [reviewer] END AS payload FROM review_fact")
def payload_fallback(t):
    """The first list that has entries, of several places it may be in."""
    one = lambda c: F.array_compact(F.array(c))
    return t.review_fact.select("ingest_id", nested.first_list(one("review_text"), one("reviewer")).alias("payload"))


@query("""WITH a AS (SELECT store_id, row_number() OVER (ORDER BY n DESC, store_id) AS k FROM (SELECT store_id, count(*) AS n FROM review_fact GROUP BY 1)), b AS (SELECT store_id, row_number() OVER (ORDER BY r DESC, store_id) AS k FROM (SELECT store_id, max(be_rating_avg) AS r FROM store_master GROUP BY 1)),
u AS (SELECT store_id, k FROM a WHERE k <= 3 UNION ALL SELECT store_id, k + 3 FROM b WHERE k <= 3) SELECT store_id, min(k)::BIGINT AS place FROM u GROUP BY 1""")
def seed_keys(t):
    """The first three of two rankings, each once, in order."""
    three = lambda d, c: d.orderBy(F.desc(c), "store_id").limit(3).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col(c)).alias("o"), "store_id"))), lambda x: x["store_id"]).alias("l"))
    a = three(t.review_fact.groupBy("store_id").agg(F.count("*").alias("n")), "n")
    b = three(t.store_master.groupBy("store_id").agg(F.max("be_rating_avg").alias("r")), "r")
    both = a.select(F.col("l").alias("x")).crossJoin(b.select(F.col("l").alias("y")))  # one row each
    p = F.concat(F.transform("x", lambda v, i: F.struct(v.alias("store_id"), (i + 1).alias("k"))), F.transform("y", lambda v, i: F.struct(v.alias("store_id"), (i + 4).alias("k"))))
    return both.select(F.explode(p).alias("p")).groupBy("p.store_id").agg(F.min("p.k").cast("bigint").alias("place"))


@query("SELECT store_id, k::DOUBLE AS quality, CASE WHEN n > 3 THEN n END::DOUBLE AS position FROM (SELECT store_id, count(*) AS n, count(source_url) AS k FROM store_source_map GROUP BY store_id)")
def labelled_points(t):
    """Points with labels to columns."""
    s = t.store_source_map.groupBy("store_id").agg(F.count("*").cast("double").alias("n"), F.count("source_url").cast("double").alias("k"))
    p = F.array_compact(F.array(F.struct(F.lit("Chất lượng").alias("key"), F.col("k").alias("value")), F.when(F.col("n") > 3, F.struct(F.lit("Vị trí").alias("key"), F.col("n").alias("value")))))
    return s.select("store_id", *nested.labelled(p, {"quality": "Chất lượng", "position": "Vị trí"}))


@query(f"WITH {_S1} SELECT store_id, slot, kind FROM s, (VALUES ('main', 'a'), ('main', 'b'), ('side', 'c'), ('drink', 'd')) v(slot, kind)")
def template_rows(t):
    """One row to four by templates."""
    s = first_wins(t.store_master, ["store_id"], "row_id")
    return nested.templates(s, ["store_id"], [("main", "a"), ("main", "b"), ("side", "c"), ("drink", "d")], ["slot", "kind"])


@query("""WITH m AS (SELECT google_name AS name, min(store_id) AS to_store FROM store_master WHERE google_match_confidence = 'high' AND google_name IS NOT NULL GROUP BY 1)
SELECT map_id, coalesce(to_store, store_id) AS store FROM store_source_map LEFT JOIN m ON source_name_raw = name""")
def map_override(t):
    """A given mapping by exact name before what the row itself says."""
    m = t.store_master.filter("google_match_confidence = 'high' and google_name is not null").groupBy(F.col("google_name").alias("source_name_raw")).agg(F.min("store_id").alias("to_store"))
    return t.store_source_map.join(m, "source_name_raw", "left").select("map_id", F.coalesce("to_store", "store_id").alias("store"))


@query("""SELECT store_id, source_url FROM (SELECT store_id, source_url, row_number() OVER (PARTITION BY store_id ORDER BY crawled_at, map_id) AS k FROM store_source_map WHERE regexp_matches(source_url, '^https?://[^/?#]+/[^/?#]+/?$')) WHERE k = 1""")
def first_acceptable(t):
    """The first address of each store that passes the test of its form."""
    ok = t.store_source_map.filter(F.col("source_url").rlike(r"^https?://[^/?#]+/[^/?#]+/?$"))
    return pick(ok.select("store_id", "source_url", "crawled_at", "map_id"), ["store_id"], F.asc("crawled_at"), F.asc("map_id")).select("store_id", "source_url")


@query("""SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) WHERE k = 1 OR l_quantity >= 45""")
def first_or_frequent(t):
    """The first row of each group, and all with a large count."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", F.row_number().over(w).alias("k")).filter("k = 1 or l_quantity >= 45").select("l_orderkey", "l_linenumber")


@query("""WITH s AS (SELECT store_id, avg(rating_5) AS r, min(length(review_text)) AS n FROM review_fact GROUP BY 1) SELECT store_id, round(CASE WHEN n <= 10 THEN greatest(r, 4.5) WHEN n > 40 THEN least(r, 2.5) ELSE r END, 4) AS signal FROM s""")
def signal_clamp(t):
    s = t.review_fact.groupBy("store_id").agg(F.avg("rating_5").alias("r"), F.min(F.length("review_text")).alias("n"))
    return s.select("store_id", F.round(nested.clamp_signal(F.col("r"), F.col("n") <= 10, 4.5, F.col("n") > 40, 2.5), 4).alias("signal"))


@query("SELECT a, b FROM (SELECT DISTINCT ward AS a, district AS b FROM store_master WHERE ward IS NOT NULL UNION SELECT DISTINCT district, ward FROM store_master WHERE ward IS NOT NULL)")
def symmetric_closure(t):
    from banyan.graph.build import undirected

    return undirected(t.store_master.filter("ward is not null").select(F.col("ward").alias("a"), F.col("district").alias("b")).distinct()).distinct()


@query(f"""WITH {_S1} SELECT store_id, list_sort(list_distinct([canonical_name, trim(regexp_replace(canonical_name, '\\s*-\\s*.*$', '')), concat_ws(' ', canonical_name, district)])) AS variants FROM s""")
def query_variants(t):
    """Distinct ways to ask for a store, in order."""
    s = first_wins(t.store_master, ["store_id"], "row_id")
    v = F.array(F.col("canonical_name"), F.trim(F.regexp_replace("canonical_name", r"\s*-\s*.*$", "")), F.concat_ws(" ", "canonical_name", "district"))
    return s.select("store_id", F.sort_array(F.array_distinct(F.array_compact(v))).alias("variants"))
