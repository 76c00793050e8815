"""Queries that conform several sources: precedence by column, tagged unions, flags, notes, lenient values."""

from __future__ import annotations

from pyspark.sql import functions as F

from banyan.functions import nested, text
from banyan.operators import conform
from banyan.plans.base import query

_S1 = "s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY row_id) AS rn FROM store_master WHERE store_id IS NOT NULL) WHERE rn = 1)"
_M1 = "m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY map_id) AS rn FROM store_source_map WHERE store_id IS NOT NULL) WHERE rn = 1)"
_L1 = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY location_id, canonical_address, street, ward, district, city, lat, lng, area_tag) AS rn FROM normalized_location WHERE store_id IS NOT NULL) WHERE rn = 1)"


def _first(t):
    """The first row of each store in three tables."""
    s = conform.first_wins(t.store_master.filter("store_id is not null"), ["store_id"], "row_id")
    m = conform.first_wins(t.store_source_map.filter("store_id is not null"), ["store_id"], "map_id")
    order = ("location_id", "canonical_address", "street", "ward", "district", "city", "lat", "lng", "area_tag")
    l = conform.pick(t.normalized_location.filter("store_id is not null"), ["store_id"], *(F.asc_nulls_last(c) for c in order))
    return s, m, l


def _real(c: str) -> str:
    return f"CASE WHEN trim({c}) <> '' THEN {c} END"


@query(f"""WITH {_S1}, {_M1}, {_L1}, k AS (SELECT store_id FROM s UNION SELECT store_id FROM m UNION SELECT store_id FROM l)
SELECT k.store_id, coalesce({_real('s.canonical_name')}, {_real('s.google_name')}, {_real('m.source_name_raw')}) AS name, coalesce({_real('l.canonical_address')}, {_real('s.address')}, {_real('m.address_raw')}, {_real('s.google_address')}) AS address,
coalesce({_real('l.city')}, {_real('s.city')}, 'Hà Nội') AS city, coalesce(s.google_rating, s.be_rating_avg) AS rating, coalesce(s.lat, l.lat, s.google_lat) AS lat, coalesce({_real('s.google_website')}, {_real('m.source_url')}) AS website
FROM k LEFT JOIN s USING (store_id) LEFT JOIN m USING (store_id) LEFT JOIN l USING (store_id)""")
def conform_columns(t):
    """One row a store, each column from its own chain of sources, the city with a default."""
    s, m, l = _first(t)
    chains = {
        "name": [("s", "canonical_name"), ("s", "google_name"), ("m", "source_name_raw")],
        "address": [("l", "canonical_address"), ("s", "address"), ("m", "address_raw"), ("s", "google_address")],
        "city": [("l", "city"), ("s", "city")],
        "rating": [("s", "google_rating"), ("s", "be_rating_avg")],
        "lat": [("s", "lat"), ("l", "lat"), ("s", "google_lat")],
        "website": [("s", "google_website"), ("m", "source_url")],
    }
    return conform.by_column(["store_id"], {"s": s, "m": m, "l": l}, chains, {"city": "Hà Nội"})


@query(f"""WITH {_M1} SELECT l.store_id, l.location_id, l.district, m.source_name, m.note, m.store_key_map FROM (SELECT DISTINCT store_id, location_id, district FROM normalized_location) l LEFT JOIN (SELECT store_id, source_name, note, source_store_key AS store_key_map FROM m) m USING (store_id)""")
def join_with_suffix(t):
    """The first source row of each store beside its location; columns of both names are told apart by a suffix."""
    l = t.normalized_location.select("store_id", "location_id", "district").distinct().withColumn("store_key", F.lit(None).cast("string"))
    m = t.store_source_map.filter("store_id is not null").select("store_id", "source_name", "note", F.col("source_store_key").alias("store_key"), "map_id")
    return conform.join_suffixed(l, m, ["store_id"], "map_id", "_map").drop("store_key")


@query("""SELECT ingest_id, store_id, reviewer, rating_5, review_text FROM review_fact WHERE rating_5 IS NOT NULL OR review_text IS NOT NULL""")
def drop_empty_reviews(t):
    """The essential columns of reviews that hold a rating or a text."""
    return t.review_fact.filter("rating_5 is not null or review_text is not null").select("ingest_id", "store_id", "reviewer", "rating_5", "review_text")


@query("SELECT row_id, store_id FROM store_master WHERE coalesce(nullif(trim(lower(status)), ''), 'active') = 'active'")
def status_filter(t):
    """A missing status counts as active."""
    status = F.coalesce(F.nullif(F.trim(F.lower("status")), F.lit("")), F.lit("active"))
    return t.store_master.filter(status == "active").select("row_id", "store_id")


_LISTING = ("Trang chủ", "Xem thêm quán gần đây", "Danh sách")


@query("SELECT doc_id FROM documents WHERE store_id IS NULL OR " + " OR ".join(f"coalesce(contains(text, '{x}'), false)" for x in _LISTING))
def listing_pages(t):
    """Pages without a store of their own, or with a sign of a list."""
    mark = text.any_hit(F.coalesce("text", F.lit("")), _LISTING)
    return t.documents.filter(F.col("store_id").isNull() | mark).select("doc_id")


_SPLIT = "list_filter(list_transform(string_split_regex({}, '[;|,/]'), lambda x: trim(x)), lambda x: x <> '')"


@query(f"""WITH u AS (SELECT store_id, 'category' AS type, unnest({_SPLIT.format('primary_category')}) AS value, 'be' AS source, 0 AS p FROM store_master
UNION ALL SELECT store_id, 'area', unnest([ward, district]), 'be', 1 FROM store_master UNION ALL SELECT store_id, 'area', unnest([area_tag, ward, district]), 'location', 2 FROM normalized_location
UNION ALL SELECT store_id, 'record', lower(source_name), 'map', 3 FROM store_source_map)
SELECT store_id, type, (min((p, trim(value), source)))[2] AS value, (min((p, trim(value), source)))[3] AS source FROM u WHERE store_id IS NOT NULL AND trim(value) <> '' GROUP BY store_id, type, lower(trim(value))""")
def category_union(t):
    """Categories, areas and records of stores from several sources, split, once each; the first source holds."""
    s, l = t.store_master, t.normalized_location
    parts = [
        (s, "category", "be", text.split_list(F.col("primary_category"))),
        (s, "area", "be", F.array("ward", "district")),
        (l, "area", "location", F.array("area_tag", "ward", "district")),
        (t.store_source_map, "record", "map", F.array(F.lower("source_name"))),
    ]
    return conform.tagged_union(parts, "store_id")


@query("""WITH c AS (SELECT session_id, 'intent' AS type, unnest(list_filter(list_transform(string_split_regex(intent, '[|;]'), lambda x: trim(x)), lambda x: x <> '')) AS value, 0 AS p FROM user_session_context
UNION ALL SELECT session_id, 'weather', weather_context, 1 FROM user_session_context UNION ALL SELECT session_id, 'time', time_context, 2 FROM user_session_context)
SELECT session_id, type, (min((p, trim(value))))[2] AS value, CASE type WHEN 'intent' THEN 'request' ELSE 'scenario' END AS source FROM c WHERE session_id IS NOT NULL AND trim(value) <> '' GROUP BY session_id, type, lower(trim(value))""")
def context_tags(t):
    """The tags of a session by type, each type with its source."""
    u = t.user_session_context
    return conform.tagged_union([(u, "intent", "request", text.split_multi(F.col("intent"))), (u, "weather", "scenario", F.array("weather_context")), (u, "time", "scenario", F.array("time_context"))], "session_id")


@query(f"""WITH {_S1}, o AS (SELECT store_id, unnest([{{'option': 'phone', 'available': (google_phone IS NOT NULL)::INT}}, {{'option': 'website', 'available': (google_website IS NOT NULL)::INT}}], recursive := true), 0 AS p FROM s
UNION ALL SELECT store_id, lower(trim(source_name)), 1, 1 FROM store_source_map WHERE store_id IS NOT NULL AND trim(source_name) <> '')
SELECT store_id, option, (min((p, available)))[2] AS available FROM o GROUP BY store_id, option""")
def service_union(t):
    """Flags of a map of options, then options of a list as true; the map holds where both have one."""
    s = conform.first_wins(t.store_master.filter("store_id is not null"), ["store_id"], "row_id")
    flags = nested.flags(s.select("store_id", F.create_map(F.lit("phone"), F.col("google_phone").isNotNull(), F.lit("website"), F.col("google_website").isNotNull()).alias("m")), "store_id", "m")
    listed = t.store_source_map.filter("store_id is not null and trim(source_name) <> ''").select("store_id", F.lower(F.trim("source_name")).alias("name"), F.lit(1).alias("flag")).distinct()
    u = flags.withColumn("p", F.lit(0)).unionByName(listed.withColumn("p", F.lit(1)))
    return u.groupBy("store_id", F.col("name").alias("option")).agg(F.min(F.struct("p", "flag")).alias("x")).select("store_id", "option", F.col("x.flag").alias("available"))


#: Services of sessions and the flag that each stands for.
FLAGS = {"dine_in": "seating", "takeaway": "counter_service", "delivery": "delivers"}


@query("SELECT DISTINCT session_id, flag FROM user_session_context JOIN (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in FLAGS.items()) + ") f(slug, flag) ON desired_service = slug WHERE session_id IS NOT NULL")
def slug_flags(t):
    """A slug to its flag, by a map in the plan; slugs without a flag give no row."""
    m = F.create_map(*(F.lit(x) for kv in FLAGS.items() for x in kv))
    return t.user_session_context.filter("session_id is not null").select("session_id", F.try_element_at(m, F.col("desired_service")).alias("flag")).filter("flag is not null").distinct()


@query(f"""WITH {_S1} SELECT store_id, source, key, note FROM (SELECT store_id, unnest([{{'source': 'be', 'key': store_id, 'note': 'own row'}}, {{'source': 'google', 'key': google_place_id, 'note': 'matched by ' || coalesce(google_match_method, 'nothing')}}], recursive := true) FROM s) WHERE key IS NOT NULL""")
def source_map_rows(t):
    """One row for each source that a store has, with a note."""
    s = conform.first_wins(t.store_master.filter("store_id is not null"), ["store_id"], "row_id")
    rows = F.array(
        F.struct(F.lit("be").alias("source"), F.col("store_id").alias("key"), F.lit("own row").alias("note")),
        F.struct(F.lit("google").alias("source"), F.col("google_place_id").alias("key"), F.concat(F.lit("matched by "), F.coalesce("google_match_method", F.lit("nothing"))).alias("note")),
    )
    return s.select("store_id", F.explode(rows).alias("x")).select("store_id", "x.*").filter("key is not null")


@query("""SELECT row_id, concat_ws('|', CASE WHEN trim(canonical_name) <> '' THEN 'be' END, CASE WHEN trim(google_name) <> '' THEN 'google' END, CASE WHEN trim(google_query_name) <> '' THEN 'query' END) AS sources FROM store_master""")
def evidence_names(t):
    """The names of the sources that tell a store's name."""
    has = lambda c, n: F.when(F.trim(c) != "", F.lit(n))
    return t.store_master.select("row_id", F.concat_ws("|", has("canonical_name", "be"), has("google_name", "google"), has("google_query_name", "query")).alias("sources"))


@query("""WITH p AS (SELECT user_id, 'intent' AS type, unnest(list_filter(list_transform(string_split_regex(intent, '[|;]'), lambda x: trim(x)), lambda x: x <> '')) AS value, 0.85::DOUBLE AS weight FROM user_session_context
UNION ALL SELECT user_id, 'service', desired_service, 0.65 FROM user_session_context UNION ALL SELECT user_id, 'weather', weather_context, 0.65 FROM user_session_context)
SELECT user_id, type, value, max(weight) AS weight FROM p WHERE user_id IS NOT NULL AND trim(value) <> '' GROUP BY ALL""")
def preference_lists(t):
    """Preferences of users from lists and single columns, once each."""
    u = t.user_session_context.filter("user_id is not null").select("user_id", "intent", "desired_service", "weather_context").distinct()
    one = lambda k, w, c: F.transform(c, lambda v: F.struct(F.lit(k).alias("type"), v.alias("value"), F.lit(w).alias("weight")))
    p = F.concat(one("intent", 0.85, text.split_multi(F.col("intent"))), one("service", 0.65, F.array("desired_service")), one("weather", 0.65, F.array("weather_context")))
    return u.select("user_id", F.explode(p).alias("x")).select("user_id", "x.*").filter("trim(value) <> ''").groupBy("user_id", "type", "value").agg(F.max("weight").alias("weight"))


@query("""WITH w AS (SELECT store_id, aspect_name, mention_count FROM (SELECT store_id, source_name AS aspect_name, count(*)::BIGINT AS mention_count FROM review_fact WHERE store_id IS NOT NULL GROUP BY ALL))
SELECT store_id, string_agg(aspect_name || ':' || mention_count, ' ' ORDER BY mention_count DESC, aspect_name) AS line FROM w WHERE aspect_name IS NOT NULL GROUP BY store_id""")
def ordered_mentions(t):
    """Counts of a store as one line, the most frequent first, ties by name."""
    n = t.review_fact.filter("store_id is not null and source_name is not null").groupBy("store_id", "source_name").agg(F.count("*").alias("n"))
    l = n.groupBy("store_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "source_name", "n"))).alias("l"))
    return l.select("store_id", F.array_join(F.transform("l", lambda x: F.concat(x["source_name"], F.lit(":"), x["n"].cast("string"))), " ").alias("line"))


@query(r"""SELECT map_id, TRY_CAST(trim(source_store_key) AS DOUBLE) AS plain, coalesce(TRY_CAST(trim(source_store_key) AS DOUBLE), TRY_CAST(regexp_replace(replace(replace(source_store_key, '.', ''), ',', '.'), '[^0-9.-]', '', 'g') AS DOUBLE)) AS lenient FROM store_source_map""")
def lenient_numbers(t):
    """Numbers as they are, or with points for thousands and a comma for the fraction."""
    return t.store_source_map.select("map_id", text.as_float(F.col("source_store_key")).alias("plain"), text.to_float(F.col("source_store_key")).alias("lenient"))


@query("""SELECT event_id, coalesce(try_cast(json_extract_string(try_cast(props AS JSON), '$.k') AS VARCHAR), props) AS value FROM events""")
def jsonish_values(t):
    """A value of a JSON object, of a literal with single quotes, or the text as it is."""
    return t.events.select("event_id", text.jsonish(F.col("props"), "$.k").alias("value"))


@query("""SELECT row_id, concat_ws('; ', ward, district, city) AS joined, '{"city":' || CASE WHEN city IS NULL THEN 'null' ELSE to_json(city)::VARCHAR END || ',"ward":' || CASE WHEN ward IS NULL THEN 'null' ELSE to_json(ward)::VARCHAR END || '}' AS packed FROM store_master""")
def join_fields(t):
    """A list as one text, and fields as a JSON object."""
    return t.store_master.select("row_id", text.join_field(F.array("ward", "district", "city")).alias("joined"), text.json_props("city", "ward").alias("packed"))


_PART = r"trim(regexp_extract(address, '(?i)(?:^|[,\-])\s*(?:{})\s*([^,\-]+)', 1))"


@query(f"""SELECT row_id, nullif({_PART.format('phường |p[.] ?')}, '') AS ward, nullif({_PART.format('quận |q[.] ?')}, '') AS district, nullif({_PART.format('thành phố |tp[.]? ')}, '') AS city FROM store_master""")
def location_keywords(t):
    """Ward, district and city of an address by the words that stand before them."""
    return t.store_master.select("row_id", *(text.after_word(F.col("address"), w).alias(n) for n, w in (("ward", "phường |p[.] ?"), ("district", "quận |q[.] ?"), ("city", "thành phố |tp[.]? "))))
