"""The pN_ queries of the training-data operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banyan.llm import addresses, cuts, entities, history, mixing, survivors, tokens
from banyan.session import STAND_INS, durable, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """(rec_a, rec_b): address records of different stores that denote the same house."""
    return addresses.same_house(addresses.address_records(table(spark, d, "store_master"), table(spark, d, "store_source_map"), table(spark, d, "normalized_location")))


def _groups(spark: SparkSession, d: str) -> dict[str, survivors.Groups]:
    return {"store_master": survivors.store_groups(table(spark, d, "store_master")), "store_source_map": survivors.source_groups(table(spark, d, "store_source_map"))}


def _both(spark: SparkSession, d: str, of, *columns: str) -> DataFrame:
    """The rows of `of` for both tables, with `tab`; store_master has no source."""
    parts = [of(g).withColumn("tab", F.lit(tab)) for tab, g in _groups(spark, d).items()]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts).select("tab", *columns)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """(tab, row_key) of each representative that dominates its group."""
    return _both(spark, d, survivors.representatives, "row_key", "dominates").filter("dominates").select("tab", "row_key")


def p2_survivors(spark: SparkSession, d: str) -> DataFrame:
    """One row a group: the representative row and the record built field by field from the values judged most probable."""
    return _both(spark, d, survivors.fused, "store_id", "source", "row_key", "size", "dominates", "record")


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """Every value judged true, so a field may have several, and the best one of each field."""
    return _both(spark, d, survivors.values, "store_id", "source", "col", "val", "p", "best")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """(kept_id, dup_id) of each review row that tells the same review as an earlier row of its store."""
    return history.repeated_rows(table(spark, d, "review_fact"), "ingest_id", "batch_no", "store_id", "reviewer", "review_text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """(store_id, google_place_id) of the stores and map places that are the same shop."""
    return entities.match_shops(table(spark, d, "store_master")).select("store_id", F.col("place_id").alias("google_place_id"))


def p6_matches(spark: SparkSession, d: str) -> DataFrame:
    """The matches with the confidence of each."""
    return entities.match_shops(table(spark, d, "store_master"))


def p6_calibration(spark: SparkSession, d: str) -> DataFrame:
    """How far the confidences hold on labelled pairs that neither fit nor calibration saw."""
    return entities.calibration(table(spark, d, "store_master"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, ids) of each document by the byte-level tokenizer of 50k ids."""
    return tokens.encode(table(spark, d, "documents"), "text", tokens.tokenizer_path(), ("doc_id",))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """How many documents come back as they were from their ids."""
    e = tokens.encode(table(spark, d, "documents"), "text", tokens.tokenizer_path(), ("doc_id", "text"))
    same = tokens.decode(F.col("ids"), tokens.tokenizer_path()) == F.coalesce("text", F.lit(""))
    return e.agg(F.count("*").alias("documents"), F.count_if(same).alias("same"))


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokens.count_tokens(table(spark, d, "documents"), "text", tokens.tokenizer_path(), ("doc_id", "source"))
    return mixing.mix(durable(sizes), table(spark, d, "mix_target"))


def p8_mixed(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, tokens, copies) of each document of the mix."""
    return _mixed(spark, d)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mix reaches, a row for each target."""
    return mixing.shares(_mixed(spark, d), table(spark, d, "mix_target"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """doc_id of each document whose text was cut."""
    return cuts.detect_cuts(table(spark, d, "documents"), "doc_id", "source", "text").filter("cut").select(F.col("key").alias("doc_id"))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts."""
    return cuts.cut_rates(cuts.detect_cuts(table(spark, d, "documents"), "doc_id", "source", "text"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_survivors": p2_survivors, "p2_values": p2_values, "p4_found": p4_found, "p6_found": p6_found, "p6_matches": p6_matches, "p6_calibration": p6_calibration, "p7_ids": p7_ids, "p7_round_trip": p7_round_trip, "p8_mixed": p8_mixed, "p8_shares": p8_shares, "p9_found": p9_found, "p9_rates": p9_rates}
_NOTHING = ", ".join("'" + x + "'" for x in STAND_INS)


def _filled(columns: str, numbers: str = "") -> str:
    real = [f"(lower(trim({c})) NOT IN ({_NOTHING}))" for c in columns.split()] + [f"({c} IS NOT NULL)" for c in numbers.split()]
    return " + ".join(f"coalesce({x}, false)::INT" for x in real)


def _trust(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) IN ('high', 'cao') THEN 3 WHEN lower(trim({c})) IN ('medium', 'med', 'trung bình') THEN 2 WHEN lower(trim({c})) IN ('low', 'thấp') THEN 1 ELSE 0 END"


_MASTER = _filled(
    "store_id canonical_name address ward district city primary_category status be_open_time be_close_time google_name google_query_name google_query_address google_address google_phone google_website google_place_id google_data_id google_open_state google_open_time google_close_time google_match_method",
    "lat lng median_price_vnd be_rating_avg be_rating_count google_rating google_review_count google_match_score",
)
_MAP = _filled("store_id source_name source_store_key source_url source_name_raw address_raw note")
_SOURCE = "CASE WHEN x IN ('top5recommendation', 'top5', 'betop5') THEN 'top5' WHEN x IN ('foodyhustplaces', 'foody', 'foodyhust') THEN 'foody' WHEN x IN ('googlemapsunique', 'googlemaps', 'gmaps') THEN 'google' ELSE x END"
P2_SQL = f"""WITH r AS (SELECT 'store_master' AS tab, row_id AS row_key, store_id AS grp, {_trust('google_match_confidence')} AS t, {_MASTER} + coalesce(google_lat BETWEEN 8 AND 24 AND google_lng BETWEEN 100 AND 112, false)::INT AS f, updated_at AS a FROM store_master
UNION ALL SELECT 'store_source_map', map_id, store_id || '|' || {_SOURCE}, {_trust('match_confidence')}, {_MAP}, crawled_at FROM (SELECT *, regexp_replace(lower(source_name), '[^a-z0-9]', '', 'g') AS x FROM store_source_map))
SELECT tab, row_key FROM r WHERE EXISTS (SELECT 1 FROM r o WHERE o.tab = r.tab AND o.grp = r.grp AND o.row_key <> r.row_key)
AND NOT EXISTS (SELECT 1 FROM r o WHERE o.tab = r.tab AND o.grp = r.grp AND o.row_key <> r.row_key AND (o.t > r.t OR o.f > r.f OR o.a > r.a OR (o.t = r.t AND o.f = r.f AND o.a = r.a)))"""
SQL: dict[str, str] = {"p2_found": P2_SQL, "p7_round_trip": "SELECT count(*)::BIGINT AS documents, count(*)::BIGINT AS same FROM documents"}
