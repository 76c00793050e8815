"""Windows over the events: an extension; the same expressions run on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from banyan.plans.base import query
from banyan.streaming.incremental import sessions, windowed


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_tumbling_window(t):
    w = windowed(t.events, "ts", "1 hour", ["event_type"], F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS first FROM events),
y AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*)::BIGINT AS n FROM y GROUP BY user_id, s""")
def ext_session_window(t):
    return sessions(t.events, "ts", "30 minutes", "user_id", F.count("*").alias("n")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
