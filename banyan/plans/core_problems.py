"""Queries p3 and p5: nearby locations, and instants of mixed times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banyan.operators.instants import by_rules, interpretations, resolve
from banyan.operators.near import points_within
from banyan.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (session_id, location_id) with the location within the session's radius."""
    found = points_within(
        table(spark, d, "user_session_context"), table(spark, d, "normalized_location"),
        "session_id", "location_id", "current_lat", "current_lng", "radius_m", bounds=(8.0, 24.0, 100.0, 112.0),
    )
    return found.select("session_id", "location_id")


def _times(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None)
    review = table(spark, d, "review_fact").select(F.lit("review_fact").alias("tab"), F.col("ingest_id").cast("string").alias("row_key"), F.concat_ws("|", F.lit("review"), "source_name").alias("source"), F.col("ingest_id").alias("ord"), F.col("rated_at").alias("v"), "tz_name", "crawled_at")
    rating = table(spark, d, "be_ratings").select(F.lit("be_ratings").alias("tab"), F.col("rating_row").cast("string").alias("row_key"), F.lit("ratings").alias("source"), F.col("rating_row").alias("ord"), F.col("rated_at").alias("v"), none.cast("string").alias("tz_name"), "crawled_at")
    session = table(spark, d, "user_session_context").select("session_id", F.col("query_time").alias("v"), "tz_name").dropDuplicates(["session_id"])
    number = F.coalesce(F.regexp_extract("session_id", r"(\d{1,18})$", 1).try_cast("bigint"), F.lit(0))
    session = session.select(F.lit("user_session_context").alias("tab"), F.col("session_id").alias("row_key"), F.lit("sessions").alias("source"), number.alias("ord"), "v", "tz_name", none.cast("timestamp").alias("crawled_at"))
    return review.unionByName(rating).unionByName(session).filter(F.col("v").isNotNull())


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """(tab, row_key, instant_us) of each readable time of three tables."""
    return by_rules(_times(spark, d), "v", F.col("tz_name"), F.col("crawled_at")).select("tab", "row_key", "instant_us")


def p5_by_order(spark: SparkSession, d: str) -> DataFrame:
    """The same where the rules have no say: each time as the order of its source's records makes it likely."""
    return resolve(interpretations(_times(spark, d), "v", F.col("tz_name"), F.col("crawled_at"), rule_cost=0.0), "source", "ord", keep=("tab", "row_key"))


QUERIES = {"p3_found": p3_found, "p5_found": p5_found, "p5_by_order": p5_by_order}

P3_SQL = """
WITH s AS (SELECT DISTINCT session_id, current_lat AS a, current_lng AS o, radius_m AS r FROM user_session_context
           WHERE current_lat BETWEEN 8 AND 24 AND current_lng BETWEEN 100 AND 112 AND radius_m >= 0),
     l AS (SELECT DISTINCT location_id, lat AS b, lng AS p FROM normalized_location WHERE lat BETWEEN 8 AND 24 AND lng BETWEEN 100 AND 112)
SELECT DISTINCT session_id, location_id FROM s JOIN l ON b BETWEEN a - r / 111000.0 AND a + r / 111000.0
WHERE 2 * 6371000 * asin(least(1.0, sqrt(pow(sin(radians(b - a) / 2), 2) + cos(radians(a)) * cos(radians(b)) * pow(sin(radians(p - o) / 2), 2)))) <= r
"""

SQL = {"p3_found": P3_SQL}
