"""Queries on duplicates, joins of several sources, aggregates, set operations and aspects."""

from __future__ import annotations

from pyspark.sql import functions as F

from banyan.functions import text
from banyan.operators import aspects, conform
from banyan.operators.match import best_match, match_with_fallback
from banyan.plans.base import query
from banyan.plans.scalar_queries import norm_sql
from banyan.sources.files import duplicate_keys, upsert


@query("""SELECT store_id, source_name, note, is_suspect, geo_distance_m FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY is_suspect, coalesce(name_similarity, 0) DESC, coalesce(geo_distance_m, 999999), source_name, coalesce(note, ''), coalesce(address_similarity, 0), coalesce(match_confidence_recomputed, '')) AS rn FROM source_match_quality) WHERE rn = 1""")
def dedup_argmin(t):
    """One row a store: least suspect, then best name, then least distance."""
    q = t.source_match_quality.withColumn("__o", F.struct("source_name", F.coalesce("note", F.lit("")), F.coalesce("address_similarity", F.lit(0.0)), F.coalesce("match_confidence_recomputed", F.lit(""))))
    return conform.argmin(q, ["store_id"], F.col("is_suspect"), F.col("name_similarity"), F.col("geo_distance_m"), "__o").select("store_id", "source_name", "note", "is_suspect", "geo_distance_m")


@query("SELECT store_id, row_id, canonical_name FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY row_id) AS rn FROM store_master) WHERE rn = 1")
def dedup_first_wins(t):
    return conform.first_wins(t.store_master, ["store_id"], "row_id").select("store_id", "row_id", "canonical_name")


@query("""SELECT r.ingest_id, m.canonical_name, m.district FROM review_fact r LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY row_id DESC) AS rn FROM store_master) WHERE rn = 1) m ON r.store_id = m.store_id""")
def left_join_last_wins(t):
    return conform.left_last_wins(t.review_fact.select("ingest_id", "store_id"), t.store_master.select("store_id", "canonical_name", "district", "row_id"), ["store_id"], "row_id").select("ingest_id", "canonical_name", "district")


@query("""WITH h AS (SELECT * FROM review_fact WHERE batch_no = 0), n AS (SELECT DISTINCT store_id, rated_at, rating_5, review_text FROM review_fact WHERE batch_no > 0)
SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.store_id IS NOT DISTINCT FROM n.store_id AND h.rated_at IS NOT DISTINCT FROM n.rated_at AND h.rating_5 IS NOT DISTINCT FROM n.rating_5 AND h.review_text IS NOT DISTINCT FROM n.review_text)""")
def incremental_append(t):
    """The rows of later batches whose signature the history lacks."""
    sig = ["store_id", "rated_at", "rating_5", "review_text"]
    r = t.review_fact.select("batch_no", *sig)
    return conform.append_unseen(r.filter("batch_no = 0"), r.filter("batch_no > 0").drop("batch_no"), sig)


@query("SELECT DISTINCT city, district, ward FROM store_master")
def distinct_multi_key(t):
    return t.store_master.select("city", "district", "ward").distinct()


@query("SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(list_filter(list_transform(string_split_regex(primary_category, '[;|,/]'), lambda x: trim(x)), lambda x: x <> '')) AS word FROM store_master) GROUP BY word")
def vocab_distinct(t):
    return t.store_master.select(F.explode(text.split_list(F.col("primary_category"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT store_id, min(canonical_name) AS name, 0 AS p FROM store_master GROUP BY 1 UNION ALL SELECT store_id, min(google_name), 1 FROM store_master WHERE google_name IS NOT NULL GROUP BY 1
UNION ALL SELECT store_id, min(source_name_raw), 2 FROM store_source_map WHERE source_name_raw IS NOT NULL GROUP BY 1)
SELECT store_id, name FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY p) AS rn FROM s) WHERE rn = 1""")
def source_priority(t):
    """Each store's name from the first source that has one."""
    one = lambda d, c: d.filter(F.col(c).isNotNull()).groupBy("store_id").agg(F.min(c).alias("name"))
    return conform.by_priority([one(t.store_master, "canonical_name"), one(t.store_master, "google_name"), one(t.store_source_map, "source_name_raw")], ["store_id"])


@query("SELECT ingest_id, row_number() OVER (PARTITION BY store_id ORDER BY ingest_id)::BIGINT AS ordinal FROM review_fact")
def ordinal_in_group(t):
    return conform.ordinal(t.review_fact.select("store_id", "ingest_id"), ["store_id"], "ingest_id", "ordinal").select("ingest_id", F.col("ordinal").cast("bigint").alias("ordinal"))


@query("""SELECT store_id, source_name, string_agg(DISTINCT match_confidence, '|' ORDER BY match_confidence) AS confidences, count(*)::BIGINT AS n FROM store_source_map GROUP BY store_id, source_name""")
def evidence_sources(t):
    return t.store_source_map.groupBy("store_id", "source_name").agg(F.nullif(F.array_join(F.sort_array(F.collect_set("match_confidence")), "|"), F.when(F.count("match_confidence") == 0, F.lit(""))).alias("confidences"), F.count("*").alias("n"))


@query("""SELECT store_id, tag, value FROM (SELECT store_id, unnest([{'tag': 'category', 'value': primary_category}, {'tag': 'ward', 'value': ward}, {'tag': 'district', 'value': district}, {'tag': 'open', 'value': be_open_time}], recursive := true) FROM store_master) WHERE value IS NOT NULL AND trim(value) <> '' GROUP BY ALL""")
def tag_union(t):
    """Several columns as (tag, value) rows, once each."""
    tags = F.array(*(F.struct(F.lit(n).alias("tag"), F.col(c).alias("value")) for n, c in (("category", "primary_category"), ("ward", "ward"), ("district", "district"), ("open", "be_open_time"))))
    return t.store_master.select("store_id", F.explode(tags).alias("x")).select("store_id", "x.tag", "x.value").filter("value is not null and trim(value) <> ''").distinct()


@query("""SELECT store_id, be_open_time, be_close_time, n FROM (SELECT store_id, be_open_time, be_close_time, n, row_number() OVER (PARTITION BY store_id ORDER BY n DESC, be_open_time, be_close_time) AS rn FROM (SELECT store_id, be_open_time, be_close_time, count(*)::BIGINT AS n FROM store_master WHERE regexp_matches(be_open_time, '^\\d{2}:\\d{2}$') AND regexp_matches(be_close_time, '^\\d{2}:\\d{2}$') GROUP BY ALL)) WHERE rn = 1""")
def mode_open_range(t):
    """The most frequent opening range; ties go to the earlier one."""
    ok = F.col("be_open_time").rlike(r"^\d{2}:\d{2}$") & F.col("be_close_time").rlike(r"^\d{2}:\d{2}$")
    n = t.store_master.filter(ok).groupBy("store_id", "be_open_time", "be_close_time").agg(F.count("*").alias("n"))
    return conform.pick(n, ["store_id"], F.desc("n"), F.asc("be_open_time"), F.asc("be_close_time"))


@query("SELECT store_id, count(*)::BIGINT AS reviews, count(DISTINCT reviewer)::BIGINT AS reviewers, count(review_text)::BIGINT AS texts FROM review_fact GROUP BY store_id")
def count_distinct(t):
    return t.review_fact.groupBy("store_id").agg(F.count("*").alias("reviews"), F.countDistinct("reviewer").alias("reviewers"), F.count("review_text").alias("texts"))


@query("SELECT key FROM (SELECT store_id AS key FROM store_master UNION SELECT store_id FROM store_source_map UNION SELECT store_id FROM review_fact)")
def union_distinct(t):
    k = lambda d: d.select(F.col("store_id").alias("key"))
    return k(t.store_master).union(k(t.store_source_map)).union(k(t.review_fact)).distinct()


@query("SELECT store_id FROM store_master INTERSECT SELECT store_id FROM review_fact")
def set_intersection(t):
    return t.store_master.select("store_id").intersect(t.review_fact.select("store_id"))


@query("SELECT store_id FROM store_master EXCEPT SELECT store_id FROM review_fact")
def set_difference(t):
    return t.store_master.select("store_id").subtract(t.review_fact.select("store_id"))


@query("SELECT store_id, count(*)::BIGINT AS n FROM store_master GROUP BY store_id HAVING count(*) > 1")
def key_violations(t):
    """The check of a uniqueness constraint."""
    return duplicate_keys(t.store_master, ["store_id"])


@query("""SELECT row_id, CASE WHEN NOT coalesce(lat BETWEEN 8 AND 24, false) THEN 'latitude' WHEN NOT coalesce(google_lat BETWEEN 8 AND 24, false) THEN 'map latitude' END AS error FROM store_master
WHERE NOT coalesce(lat BETWEEN 8 AND 24, false) OR NOT coalesce(google_lat BETWEEN 8 AND 24, false)""")
def build_errors(t):
    _, bad = conform.split_valid(t.store_master, {"latitude": F.col("lat").between(8, 24), "map latitude": F.col("google_lat").between(8, 24)})
    return bad.select("row_id", "error")


@query("""SELECT user_id, preference, weight, count(*)::BIGINT AS n FROM (SELECT user_id, unnest([{'preference': desired_service, 'weight': 0.85::DOUBLE}, {'preference': weather_context, 'weight': 0.65::DOUBLE}], recursive := true) FROM (SELECT DISTINCT session_id, user_id, desired_service, weather_context FROM user_session_context)) WHERE preference IS NOT NULL GROUP BY ALL""")
def preference_unpivot(t):
    s = t.user_session_context.select("session_id", "user_id", "desired_service", "weather_context").distinct()
    p = F.array(F.struct(F.col("desired_service").alias("preference"), F.lit(0.85).alias("weight")), F.struct(F.col("weather_context").alias("preference"), F.lit(0.65).alias("weight")))
    return s.select("user_id", F.explode(p).alias("p")).select("user_id", "p.preference", "p.weight").filter("preference is not null").groupBy("user_id", "preference", "weight").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, sum(l_extendedprice)::DOUBLE AS total, count(l_orderkey)::BIGINT AS items FROM (SELECT o_orderkey, l_orderkey, coalesce(l_extendedprice, 0) AS l_extendedprice FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_discount > 0.05) GROUP BY o_orderkey""".replace("sum(l_extendedprice)::DOUBLE", "round(sum(l_extendedprice), 2)"))
def left_join_aggregate(t):
    """One to many, with orders that match nothing kept."""
    l = t.lineitem.filter("l_discount > 0.05").select("l_orderkey", "l_extendedprice")
    return t.orders.select("o_orderkey").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(F.round(F.sum(F.coalesce("l_extendedprice", F.lit(0.0))), 2).alias("total"), F.count("l_orderkey").alias("items"))


@query("""WITH n AS (SELECT * FROM (SELECT store_id, canonical_name, row_id, row_number() OVER (PARTITION BY store_id ORDER BY row_id DESC) AS rn FROM store_master) WHERE rn = 1)
SELECT store_id, canonical_name AS name FROM n""")
def keyed_upsert(t):
    """Rows of changes replace stored rows with the same key; the last one holds."""
    old = t.store_master.select("store_id", F.lit("old").alias("name")).distinct()
    return upsert(old, t.store_master.select("store_id", F.col("canonical_name").alias("name"), "row_id"), ["store_id"], "row_id")


@query(f"""WITH m AS (SELECT store_id, min(row_id) AS row_id FROM store_master GROUP BY store_id), s AS (SELECT store_master.* FROM store_master JOIN m USING (row_id)),
a AS (SELECT store_id AS lid, {norm_sql('canonical_name')} AS ln, lat AS llat, lng AS llng FROM s WHERE lat IS NOT NULL AND lng IS NOT NULL),
b AS (SELECT row_id AS rid, {norm_sql('google_name')} AS rn, google_lat AS rlat, google_lng AS rlng FROM s WHERE google_lat IS NOT NULL AND google_lng IS NOT NULL),
p AS (SELECT lid, rid, ln, rn, pow(sin(radians(rlat - llat) / 2), 2) + cos(radians(llat)) * cos(radians(rlat)) * pow(sin(radians(rlng - llng) / 2), 2) AS h FROM a JOIN b ON abs(llat - rlat) < 0.011 AND abs(llng - rlng) < 0.013),
q AS (SELECT lid, rid, round(2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - least(h, 1.0))), 1) AS m, levenshtein(replace(ln, 'đ', 'd'), replace(rn, 'đ', 'd'))::BIGINT AS d FROM p WHERE rn IS NOT NULL)
SELECT lid AS store_id, rid AS row_id, m FROM (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY d, m, rid) AS k FROM q WHERE m <= 1000) WHERE k = 1""")
def nearest_name_in_radius(t):
    """For each store the map name within 1000 m with the least edits: grid cells in place of all pairs."""
    from banyan.functions.geo import haversine_m
    from banyan.operators.match import cells

    s = conform.first_wins(t.store_master, ["store_id"], "row_id")
    a = s.filter("lat is not null and lng is not null").select("store_id", text.norm_text(F.col("canonical_name")).alias("ln"), "lat", "lng").withColumn("c", F.explode(cells(F.col("lat"), F.col("lng"), 0.011, True)))
    b = s.filter("google_lat is not null and google_lng is not null and google_name is not null").select("row_id", text.norm_text(F.col("google_name")).alias("rn"), F.col("google_lat").alias("rlat"), F.col("google_lng").alias("rlng"))
    b = b.withColumn("c", F.explode(cells(F.col("rlat"), F.col("rlng"), 0.011)))
    p = a.join(b, "c").withColumn("m", F.round(haversine_m(F.col("lat"), F.col("lng"), F.col("rlat"), F.col("rlng")), 1)).filter("m <= 1000").withColumn("d", F.levenshtein(F.translate("ln", "đ", "d"), F.translate("rn", "đ", "d")))
    return conform.pick(p, ["store_id"], F.asc("d"), F.asc("m"), F.asc("row_id")).select("store_id", "row_id", "m")


@query(name="fuzzy_match_best")
def fuzzy_match_best(t):
    """The weighted matcher of delivery sides and map places; a test compares it with a plain version."""
    return best_match(*_sides(t))


def _sides(t):
    s = conform.first_wins(t.store_master, ["store_id"], "row_id")
    left = s.select(F.col("store_id").alias("id"), F.col("canonical_name").alias("name"), "address", F.col("google_query_name").alias("query_name"), F.col("google_query_address").alias("query_address"), "lat", "lng")
    right = s.select(F.col("row_id").alias("id"), F.col("google_name").alias("name"), F.col("google_address").alias("address"), F.col("google_lat").alias("lat"), F.col("google_lng").alias("lng"))
    return left, right


@query(name="match_fallback")
def match_fallback(t):
    """Trusted blocks first, then the weighted matcher for all other stores and places."""
    s = conform.first_wins(t.store_master, ["store_id"], "row_id")
    direct = s.filter("lower(trim(google_match_confidence)) = 'high' and google_name is not null").select(F.col("store_id").alias("left_id"), F.col("row_id").alias("right_id"))
    return match_with_fallback(*_sides(t), direct)


@query(f"""SELECT row_id, CASE WHEN m <= 250 AND j >= 0.25 THEN 'high' WHEN m IS NULL THEN 'low' ELSE 'medium' END AS confidence, coalesce(m > 800, false)::INT AS suspect FROM (
SELECT row_id, 2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - least(h, 1.0))) AS m, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END AS j FROM (
SELECT row_id, pow(sin(radians(google_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(google_lat)) * pow(sin(radians(google_lng - lng) / 2), 2) AS h,
list_filter(list_distinct(string_split({norm_sql('canonical_name')}, ' ')), lambda w: length(w) >= 2) AS a, list_filter(list_distinct(string_split({norm_sql('google_name')}, ' ')), lambda w: length(w) >= 2) AS b FROM store_master))""")
def match_quality(t):
    from banyan.functions.geo import haversine_m

    a, b = (text.token_set(text.norm_text(F.col(c))) for c in ("canonical_name", "google_name"))
    s = t.store_master.select("row_id", haversine_m(*(F.col(c) for c in ("lat", "lng", "google_lat", "google_lng"))).alias("m"), text.jaccard(a, b).alias("j"))
    return s.select("row_id", F.when((F.col("m") <= 250) & (F.col("j") >= 0.25), "high").when(F.col("m").isNull(), "low").otherwise("medium").alias("confidence"), F.coalesce(F.col("m") > 800, F.lit(False)).cast("int").alias("suspect"))


# --- aspects ---


def _cases(rules: dict[str, tuple[str, ...]]) -> str:
    return " UNION ALL ".join(f"SELECT store_id, source_name, sentiment, '{a}' AS aspect_name FROM r WHERE {' OR '.join(f'contains(x, {chr(39)}{w}{chr(39)})' for w in words)}" for a, words in rules.items())


_REVIEWS = f"r AS (SELECT store_id, source_name, sentiment, {norm_sql('review_text')} AS x FROM review_fact WHERE trim(review_text) <> '' AND NOT (source_name = 'foody' AND is_promo = 1))"
_PIVOT = f"""WITH {_REVIEWS}, m AS ({_cases(aspects.REVIEW_ASPECTS)}),
a AS (SELECT store_id, aspect_name, count(*)::BIGINT AS mention_count, (count(*) FILTER (sentiment = 'positive'))::BIGINT AS positive_mentions, (count(*) FILTER (sentiment = 'negative'))::BIGINT AS negative_mentions,
(count(*) FILTER (sentiment = 'neutral'))::BIGINT AS neutral_mentions, string_agg(DISTINCT source_name, '|' ORDER BY source_name) AS evidence_sources FROM m GROUP BY store_id, aspect_name)
SELECT *, CASE WHEN positive_mentions - negative_mentions >= 2 THEN 'positive' WHEN positive_mentions - negative_mentions <= -2 THEN 'negative' WHEN negative_mentions > 0 AND positive_mentions > 0 THEN 'mixed'
WHEN neutral_mentions > 0 AND positive_mentions = 0 AND negative_mentions = 0 THEN 'neutral' WHEN positive_mentions > negative_mentions THEN 'mixed_positive' WHEN positive_mentions < negative_mentions THEN 'mixed_negative' ELSE 'mixed' END AS aspect_sentiment FROM a"""


def _mentions(t):
    r = t.review_fact.filter("trim(review_text) <> '' and not (source_name = 'foody' and is_promo = 1)")
    r = r.select("store_id", "source_name", "sentiment", text.norm_text(F.col("review_text")).alias("x"))  # a stage of its own, so it is made once a row
    return r.select("store_id", "source_name", "sentiment", F.explode(aspects.review_aspects(F.col("x"))).alias("aspect_name"))


@query(_PIVOT)
def aspect_sentiment_pivot(t):
    return aspects.aspect_aggregate(_mentions(t))


@query(f"WITH {_REVIEWS}, m AS ({_cases(aspects.REVIEW_ASPECTS)}) SELECT aspect_name, source_name, count(*)::BIGINT AS mentions, count(DISTINCT store_id)::BIGINT AS stores FROM m GROUP BY ALL")
def aspect_hits(t):
    return _mentions(t).groupBy("aspect_name", "source_name").agg(F.count("*").alias("mentions"), F.countDistinct("store_id").alias("stores"))


def _count_sql(words: tuple[str, ...]) -> str:
    return " + ".join(f"(length(x) - length(replace(x, '{w}', ''))) // {len(w)}" for w in words)


_STORE = " UNION ALL ".join(f"SELECT store_id, '{a}' AS aspect_name, ({_count_sql(w)}) AS p, ({_count_sql(aspects.STORE_NEGATIVE[a])}) AS n FROM r" for a, w in aspects.STORE_POSITIVE.items())


@query(f"""WITH r AS (SELECT store_id, {norm_sql('review_text')} AS x FROM review_fact WHERE review_text IS NOT NULL), c AS ({_STORE}),
s AS (SELECT store_id, avg(rating_5) AS g FROM review_fact GROUP BY store_id),
b AS (SELECT c.store_id, aspect_name, (sum(p) + CASE WHEN any_value(g) >= 4 THEN 1 ELSE 0 END)::BIGINT AS positive_mentions, (sum(n) + CASE WHEN any_value(g) > 0 AND any_value(g) < 3 THEN 1 ELSE 0 END)::BIGINT AS negative_mentions FROM c JOIN s ON c.store_id = s.store_id GROUP BY c.store_id, aspect_name)
SELECT store_id, aspect_name, positive_mentions, negative_mentions, CASE WHEN positive_mentions > negative_mentions THEN 'positive' WHEN negative_mentions > positive_mentions THEN 'negative' ELSE 'neutral' END AS aspect_sentiment,
(positive_mentions = negative_mentions)::INT AS neutral_mentions, greatest(1, positive_mentions + negative_mentions + (positive_mentions = negative_mentions)::INT)::BIGINT AS mention_count FROM b""")
def aspect_store_counts(t):
    """Occurrences of words over all reviews of a store, and its mean rating as a signal."""
    r = t.review_fact
    x = r.filter("review_text is not null").select("store_id", text.norm_text(F.col("review_text")).alias("x"))
    h = x.select("store_id", F.explode(aspects.store_hits(F.col("x"))).alias("h")).groupBy("store_id", F.col("h.aspect_name").alias("aspect_name")).agg(F.sum("h.pos").alias("pos"), F.sum("h.neg").alias("neg"))
    return aspects.store_scores(h.join(r.groupBy("store_id").agg(F.avg("rating_5").alias("g")), "store_id"), F.col("g"))


def _present(words: tuple[str, ...]) -> str:
    return " + ".join(f"contains(x, '{w}')::INT" for w in words)


_POLAR = " UNION ALL ".join(f"SELECT ingest_id, store_id, '{a}' AS aspect, ({_present(g)}) AS p, ({_present(b)}) AS n FROM x" for a, (g, b) in aspects.POLARITY.items())
_SCORES = f"x AS (SELECT ingest_id, store_id, trim(regexp_replace(lower(review_text), '\\s+', ' ', 'g')) AS x FROM review_fact WHERE review_text IS NOT NULL), s AS (SELECT ingest_id, store_id, aspect, round((p - n) / (p + n), 3) AS score FROM ({_POLAR}) WHERE p + n > 0)"


@query(f"WITH {_SCORES} SELECT store_id, aspect, round(avg(score), 3) AS mean, count(*)::BIGINT AS sample_count FROM s GROUP BY store_id, aspect")
def attribute_mean(t):
    s = t.review_fact.filter("review_text is not null").select("store_id", text.normalize_text(F.col("review_text")).alias("x")).select("store_id", F.explode(aspects.polarity(F.col("x"))).alias("aspect", "score"))
    return s.groupBy("store_id", "aspect").agg(F.round(F.avg("score"), 3).alias("mean"), F.count("*").alias("sample_count"))


@query(f"WITH {_SCORES} SELECT ingest_id, round(avg(score), 6) AS mean, count(*)::BIGINT AS aspects FROM s GROUP BY ingest_id")
def aspect_map_mean(t):
    x = t.review_fact.filter("review_text is not null").select("ingest_id", text.normalize_text(F.col("review_text")).alias("x"))
    s = x.select("ingest_id", F.map_values(aspects.polarity(F.col("x"))).alias("v"))
    s = s.select("ingest_id", F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("v").cast("bigint").alias("aspects"))
    # having an aspect is asked of the explicit sum: a filter on the map would be pushed below it and make it twice
    return s.groupBy("ingest_id").agg(F.max("total").alias("t"), F.max("aspects").alias("aspects")).filter("aspects > 0").select("ingest_id", F.round(F.col("t") / F.col("aspects"), 6).alias("mean"), "aspects")


_GOOD, _BAD = (" OR ".join(f"contains(x, '{w}')" for w in ws) for ws in (aspects.GOOD_WORDS, aspects.BAD_WORDS))


@query(f"""SELECT ingest_id, CASE WHEN rating_5 >= 4 THEN 'positive' WHEN rating_5 <= 2 THEN 'negative' WHEN {_GOOD} THEN 'positive' WHEN {_BAD} THEN 'negative' ELSE 'neutral' END AS s FROM (SELECT ingest_id, rating_5, coalesce({norm_sql('review_text')}, '') AS x FROM review_fact)""")
def review_sentiment(t):
    r = t.review_fact.select("ingest_id", "rating_5", text.norm_text(F.col("review_text")).alias("x"))
    return r.select("ingest_id", aspects.review_sentiment(F.col("rating_5"), F.col("x")).alias("s"))


@query("SELECT store_id, string_agg(review_text, ' ' ORDER BY ingest_id) AS text FROM review_fact GROUP BY store_id")
def text_blob(t):
    """The texts of all reviews of each store in the order of arrival, joined in parts of 1,024 ids first."""
    r = t.review_fact.select("store_id", F.floor(F.col("ingest_id") / 1024).alias("part"), "ingest_id", "review_text")
    joined = lambda l, c: F.when(F.size(l) > 0, F.array_join(F.transform(F.sort_array(l), lambda x: x[c]), " "))
    kept = lambda k, c: F.collect_list(F.when(F.col(c).isNotNull(), F.struct(k, c)))
    p = r.groupBy("store_id", "part").agg(kept("ingest_id", "review_text").alias("l")).select("store_id", "part", joined("l", "review_text").alias("text"))
    return p.groupBy("store_id").agg(kept("part", "text").alias("l")).select("store_id", joined("l", "text").alias("text"))


@query("SELECT o_orderpriority, l_returnflag, l_shipmode_group, n FROM (SELECT o_orderpriority, l_returnflag, l_linestatus AS l_shipmode_group, count(*)::BIGINT AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY GROUPING SETS ((o_orderpriority, l_returnflag, l_linestatus), (o_orderpriority), ()))")
def ext_grouping_sets(t):
    """Extension: grouping sets over a join."""
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderpriority", "l_returnflag", F.col("l_linestatus").alias("l_shipmode_group"))
    cols = [F.col(c) for c in ("o_orderpriority", "l_returnflag", "l_shipmode_group")]
    return j.groupingSets([cols, [cols[0]], []], *cols).agg(F.count("*").alias("n")).select("o_orderpriority", "l_returnflag", "l_shipmode_group", "n")
