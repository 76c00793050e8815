"""Queries on text, place, date and list functions, over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from banyan.functions import geo, html, text
from banyan.plans.base import query

NORM = r"trim(regexp_replace(regexp_replace(lower(strip_accents({c})), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def norm_sql(c: str) -> str:
    return NORM.format(c=c)


@query(f"SELECT row_id, regexp_replace({norm_sql('canonical_name')}, '\\s+', '_', 'g') AS slug, {norm_sql('address')} AS norm FROM store_master")
def text_slug(t):
    return t.store_master.select("row_id", text.slugify(F.col("canonical_name")).alias("slug"), text.norm_text(F.col("address")).alias("norm"))


@query(
    r"""SELECT row_id, trim(regexp_replace(replace(strip_accents(trim(regexp_replace(lower(canonical_name), '\s+', ' ', 'g'))), 'đ', 'd'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM store_master"""
)
def text_slug_vn(t):
    return t.store_master.select("row_id", text.slug_vn(F.col("canonical_name")).alias("slug"))


@query(r"""SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(text, '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&'), '[\s]+', ' ', 'g')) AS clean FROM documents""")
def text_clean(t):
    return t.documents.select("doc_id", text.text_clean(F.col("text")).alias("clean"))


@query(r"""SELECT row_id, trim(regexp_replace(lower(strip_accents(canonical_name)), '[^a-z0-9]+', ' ', 'g')) AS match_name, list_sort(list_filter(list_distinct(string_split(trim(regexp_replace(lower(strip_accents(canonical_name)), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda w: length(w) >= 2 AND w NOT IN ('quan', 'nha', 'hang'))) AS tokens FROM store_master""")
def text_match_tokens(t):
    m = text.match_text(F.col("canonical_name"))
    return t.store_master.select("row_id", m.alias("match_name"), F.sort_array(text.token_set(m, 2, ("quan", "nha", "hang"))).alias("tokens"))


@query(f"""WITH t AS (SELECT row_id, list_filter(list_distinct(string_split({norm_sql('canonical_name')}, ' ')), lambda w: length(w) >= 2) AS a,
list_filter(list_distinct(string_split({norm_sql('google_name')}, ' ')), lambda w: length(w) >= 2) AS b FROM store_master)
SELECT row_id, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 6) AS jaccard,
round(CASE WHEN len(b) > 0 THEN len(list_intersect(a, b)) / len(b) ELSE 0 END, 6) AS covered FROM t""")
def token_jaccard(t):
    a, b = (text.token_set(text.norm_text(F.col(c))) for c in ("canonical_name", "google_name"))
    return t.store_master.select("row_id", F.round(text.jaccard(a, b), 6).alias("jaccard"), F.round(text.overlap(a, b), 6).alias("covered"))


@query(name="seq_ratio")
def seq_ratio(t):
    """Ratio of matched blocks; no SQL has it, a test compares it with a plain version."""
    return t.store_master.select("row_id", F.round(text.sequence_ratio(text.norm_text(F.col("canonical_name")), text.norm_text(F.col("google_name"))), 4).alias("ratio"))


@query(f"SELECT row_id, levenshtein(replace(coalesce({norm_sql('canonical_name')}, ''), 'đ', 'd'), replace(coalesce({norm_sql('google_name')}, ''), 'đ', 'd'))::BIGINT AS distance FROM store_master")
def edit_distance(t):
    low = lambda c: F.translate(F.coalesce(text.norm_text(F.col(c)), F.lit("")), "đ", "d")
    return t.store_master.select("row_id", F.levenshtein(low("canonical_name"), low("google_name")).cast("bigint").alias("distance"))


@query(r"""SELECT session_id, list_filter(list_transform(string_split_regex(intent, '[|;]'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM (SELECT DISTINCT session_id, intent FROM user_session_context) WHERE intent IS NOT NULL""")
def split_multi(t):
    return t.user_session_context.select("session_id", "intent").distinct().filter("intent is not null").select("session_id", text.split_multi(F.col("intent")).alias("parts"))


@query(r"""SELECT row_id, list_filter(list_transform(string_split_regex(primary_category, '[;|,/]'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM store_master WHERE primary_category IS NOT NULL""")
def split_semi(t):
    return t.store_master.filter("primary_category is not null").select("row_id", text.split_list(F.col("primary_category")).alias("parts"))


@query("""SELECT row_id, CASE WHEN lower(district) = lower(ward) THEN [ward] ELSE [ward, district] END AS areas FROM store_master WHERE ward IS NOT NULL AND district IS NOT NULL""")
def merge_list_cols(t):
    s = t.store_master.filter("ward is not null and district is not null")
    return s.select("row_id", text.merge_lists(F.array("ward"), F.array("district")).alias("areas"))


@query("""SELECT s_suppkey, '{"acctbal":' || CASE WHEN s_nationkey = 0 THEN 'null' ELSE s_nationkey::VARCHAR END || ',"name":"' || s_name || '"}' AS props FROM supplier""")
def json_props(t):
    return t.supplier.select("s_suppkey", text.json_props(F.nullif(F.col("s_nationkey"), F.lit(0)).alias("acctbal"), F.col("s_name").alias("name")).alias("props"))


@query("SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k FROM events")
def json_blob(t):
    return t.events.select("event_id", text.map_or_empty(F.col("props"))["k"].cast("bigint").alias("k"))


@query("SELECT ingest_id, substr(md5(concat_ws('|', store_id, rated_at, review_text)), 1, 16) AS hash, concat('0x', substr(md5(review_id), 1, 8))::BIGINT AS point FROM review_fact")
def md5_ids(t):
    return t.review_fact.select("ingest_id", text.short_hash(F.col("store_id"), F.col("rated_at"), F.col("review_text")).alias("hash"), text.point_id(F.col("review_id")).alias("point"))


@query("""WITH t AS (SELECT map_id, trim(regexp_replace(regexp_replace(upper(coalesce(source_name, '')), '[^0-9A-Z_]', '_', 'g'), '_+', '_', 'g'), '_') AS x FROM store_source_map)
SELECT map_id, CASE WHEN x = '' THEN 'RELATION' WHEN regexp_matches(x, '^[0-9]') THEN 'R_' || x ELSE x END AS relation FROM t""")
def relation_type_clean(t):
    return t.store_source_map.select("map_id", text.relation_type(F.col("source_name")).alias("relation"))


@query("""SELECT row_id, coalesce(nullif(trim(google_website), ''), nullif(trim(google_phone), ''), nullif(trim(google_name), ''), canonical_name) AS contact FROM store_master""")
def first_non_empty(t):
    return t.store_master.select("row_id", text.first_non_empty(*(F.col(c) for c in ("google_website", "google_phone", "google_name", "canonical_name"))).alias("contact"))


@query("""SELECT map_id, TRY_CAST(TRY_CAST(replace(source_store_key, ',', '') AS DOUBLE) AS BIGINT) AS key_int, TRY_CAST(trim(source_store_key) AS DOUBLE) AS key_float FROM store_source_map""")
def number_casts(t):
    return t.store_source_map.select("map_id", text.as_int(F.col("source_store_key")).alias("key_int"), text.as_float(F.col("source_store_key")).alias("key_float"))


@query(r"""WITH t AS (SELECT row_id, regexp_replace(google_phone, '[^0-9]', '', 'g') AS d FROM store_master)
SELECT row_id, nullif(CASE WHEN starts_with(d, '84') AND length(d) >= 10 THEN '0' || substr(d, 3) ELSE d END, '') AS phone FROM t""")
def phone_digits(t):
    return t.store_master.select("row_id", text.phone(F.col("google_phone")).alias("phone"))


@query("SELECT row_id, nullif(regexp_extract(google_open_state, '(\\d{1,2}:\\d{2})', 1), '') AS at FROM store_master")
def clock_time(t):
    return t.store_master.select("row_id", text.clock(F.col("google_open_state")).alias("at"))


_PARSE = "try_strptime(trim(rated_at), '{}')"
_FORMATS = ("%H:%M %d/%m/%Y", "%d/%m/%Y %H:%M", "%m/%d/%Y %H:%M", "%d/%m/%Y", "%m/%d/%Y", "%d/%m/%y", "%m/%d/%y")


_YEAR = r"(\d{1,2}/\d{1,2}/)(\d{2})( |$)"


@query(
    f"WITH t AS (SELECT rating_row, regexp_replace(trim(rated_at), '{_YEAR}', '\\120\\2\\3') AS rated_at FROM be_ratings) SELECT rating_row, strftime(coalesce("
    + ", ".join(_PARSE.format(f) for f in _FORMATS[:5])
    + "), '%Y-%m-%d %H:%M') AS at FROM t"
)
def date_multi_parse(t):
    """All values: years of two digits are those of this century, what cannot be read is null."""
    at = text.mixed_date(F.regexp_replace(F.trim("rated_at"), _YEAR, "$120$2$3"))
    return t.be_ratings.select("rating_row", F.date_format(at, "yyyy-MM-dd HH:mm").alias("at"))


@query(r"""WITH t AS (SELECT map_id, list_filter(list_transform(string_split(address_raw, ','), lambda x: trim(x)), lambda x: x <> '') AS p FROM store_source_map)
SELECT map_id, p[1] AS street, CASE WHEN len(p) >= 2 THEN trim(regexp_replace(p[-2], '^Quận ', '')) END AS district, p[-1] AS city FROM t""")
def location_parts(t):
    return t.store_source_map.select("map_id", text.location_parts(F.col("address_raw")).alias("l")).select("map_id", "l.street", "l.district", "l.city")


@query(f"""WITH t AS (SELECT row_id, list_filter(string_split({norm_sql('address')}, ' ')[1:6], lambda w: w NOT IN ('so', 'kiot', 'ngo', 'ng', 'hem', 'pho', 'p', 'duong') AND regexp_matches(w, '[0-9]')) AS h FROM store_master)
SELECT row_id, h[1] AS house FROM t""")
def house_numbers(t):
    return t.store_master.select("row_id", text.house_number(F.col("address")).alias("house"))


@query(f"""SELECT ingest_id, coalesce(regexp_matches({norm_sql('review_text')}, '\\b(uu dai|voucher|giam|tang|khuyen mai|combo|mua 2 tang 1|shorten asia|link de nhan)\\b'), false)::INT AS promo FROM review_fact""")
def promo_flag(t):
    return t.review_fact.select("ingest_id", text.promo_flag(F.col("review_text")).alias("promo"))


HAV = "2 * {r} * atan2(sqrt(h), sqrt(1 - least(h, 1.0)))"
H = "pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({q} - {p}) / 2), 2)"
_MG = f"(SELECT row_id, {H.format(a='lat', b='google_lat', p='lng', q='google_lng')} AS h FROM store_master)"


@query(f"SELECT row_id, round({HAV.format(r='6371000.0')}, 1) AS m, round({HAV.format(r='6371.0')}, 4) AS km FROM {_MG}")
def geo_haversine(t):
    c = [F.col(x) for x in ("lat", "lng", "google_lat", "google_lng")]
    return t.store_master.select("row_id", F.round(geo.haversine_m(*c), 1).alias("m"), F.round(geo.haversine_km(*c), 4).alias("km"))


@query("""SELECT store_id, source_name, note, geo_distance_m, CASE WHEN geo_distance_m IS NULL THEN 0.0 WHEN geo_distance_m <= 40 THEN 1.0 WHEN geo_distance_m <= 80 THEN 0.95 WHEN geo_distance_m <= 150 THEN 0.88
WHEN geo_distance_m <= 300 THEN 0.75 WHEN geo_distance_m <= 500 THEN 0.55 WHEN geo_distance_m <= 800 THEN 0.35 WHEN geo_distance_m <= 1200 THEN 0.18 ELSE 0.0 END::DOUBLE AS score FROM source_match_quality""")
def geo_score(t):
    return t.source_match_quality.select("store_id", "source_name", "note", "geo_distance_m", geo.geo_score(F.col("geo_distance_m")).alias("score"))


@query(f"""SELECT location_id, count(*)::BIGINT AS n FROM (SELECT *, {H.format(a='21.06', b='lat', p='105.46', q='lng')} AS h FROM normalized_location)
WHERE CASE WHEN lat IS NOT NULL AND lng IS NOT NULL THEN {HAV.format(r='6371000.0')} <= 2200 ELSE coalesce(lower(canonical_address) LIKE '%kha nhiên%', false) END GROUP BY location_id""")
def radius_filter(t):
    """Within 2200 m of a centre; without coordinates by a word of the address."""
    near = F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), geo.haversine_m(F.lit(21.06), F.lit(105.46), F.col("lat"), F.col("lng")) <= 2200)
    return t.normalized_location.filter(near.otherwise(F.coalesce(F.lower("canonical_address").contains("kha nhiên"), F.lit(False)))).groupBy("location_id").agg(F.count("*").alias("n"))


@query(f"""SELECT location_id, m FROM (SELECT DISTINCT location_id, round({HAV.format(r='6371000.0')}, 1) AS m FROM (SELECT *, {H.format(a='21.06', b='lat', p='105.46', q='lng')} AS h FROM normalized_location WHERE lat BETWEEN 8 AND 24)) ORDER BY m, location_id LIMIT 20""")
def nearest_n(t):
    n = t.normalized_location.filter("lat between 8 and 24").select("location_id", F.round(geo.haversine_m(F.lit(21.06), F.lit(105.46), F.col("lat"), F.col("lng")), 1).alias("m")).distinct()
    return n.orderBy(F.asc_nulls_last("m"), "location_id").limit(20)


@query(r"""SELECT map_id, nullif(regexp_extract(source_url, '^https?://([^/?#]+)', 1), '') AS host,
coalesce(regexp_matches(source_url, '^https?://[^/?#]+/[^/?#]+/?$'), false) AS one_segment FROM store_source_map""")
def url_parts(t):
    u = F.col("source_url")
    return t.store_source_map.select("map_id", F.nullif(F.regexp_extract(u, r"^https?://([^/?#]+)", 1), F.lit("")).alias("host"), F.coalesce(u.rlike(r"^https?://[^/?#]+/[^/?#]+/?$"), F.lit(False)).alias("one_segment"))


def _page(t):
    """Pages made of the documents, with title, heading, links, a script and the escaped text."""
    body = F.col("text")
    for x, y in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        body = F.replace(body, F.lit(x), F.lit(y))
    d = t.documents.filter("text is not null")
    return d.select("doc_id", F.concat(F.lit("<html><title>"), F.col("source"), F.lit(" "), F.col("doc_id"), F.lit("</title><p>"), body, F.lit('</p><a href="/s/'), F.coalesce("store_id", F.lit("0")), F.lit('">x</a><a href="/s/a?q=1">y</a><script>var data = {"id": '), F.col("doc_id"), F.lit(', "t": "a}b", "u": undefined, "l": [1,2,],};</script><h1>'), F.coalesce("lang", F.lit("")), F.lit("</h1></html>")).alias("html"))


@query("SELECT doc_id, source || ' ' || doc_id AS title, nullif(lang, '') AS heading FROM documents WHERE text IS NOT NULL")
def html_title(t):
    return _page(t).select("doc_id", html.title(F.col("html")).alias("title"), html.heading(F.col("html")).alias("heading"))


@query("SELECT doc_id, '/s/' || coalesce(store_id, '0') AS link, true AS place FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, '/s/a?q=1', false FROM documents WHERE text IS NOT NULL")
def html_links(t):
    link = F.explode(html.links(F.col("html"))).alias("link")
    return _page(t).select("doc_id", link).select("doc_id", "link", html.place_url(F.concat(F.lit("https://x.example"), F.col("link"))).alias("place"))


@query("SELECT doc_id, doc_id AS id, 2::BIGINT AS size FROM documents WHERE text IS NOT NULL")
def js_object(t):
    """An object in a script: braces within strings, undefined values and trailing commas."""
    o = F.from_json(html.js_object(F.col("html"), "data"), "id bigint, t string, u string, l array<int>")
    return _page(t).select("doc_id", o.alias("o")).select("doc_id", "o.id", F.size("o.l").cast("bigint").alias("size"))


@query(r"""SELECT rating_row, CASE WHEN rating IS NULL THEN 'unknown' WHEN rating >= 4 THEN 'positive' WHEN rating <= 2 THEN 'negative' ELSE 'neutral' END AS sentiment, round(rating / 2, 2) AS half FROM be_ratings""")
def sentiment_case(t):
    from banyan.operators.aspects import rating_sentiment

    return t.be_ratings.select("rating_row", rating_sentiment(F.col("rating")).alias("sentiment"), F.round(F.col("rating") / 2, 2).alias("half"))
