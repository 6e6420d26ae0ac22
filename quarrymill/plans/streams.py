"""Registered streaming queries (X01, X02 and windows); each equals its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.streaming import events as st


def stream_hourly(spark: SparkSession, directory: str) -> DataFrame:
    found = st.run_updates(st.tumbling_counts(st.event_stream(spark, directory), "1 hour"), ["start", "event_type"], "hourly")
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_sliding(spark: SparkSession, directory: str) -> DataFrame:
    found = st.run_updates(st.sliding_counts(st.event_stream(spark, directory), "6 hours", "2 hours"), ["start"], "sliding")
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_status(spark: SparkSession, directory: str) -> DataFrame:
    return st.run_updates(st.live_status(st.event_stream(spark, directory)), ["event_type"], "status")


def stream_sessions(spark: SparkSession, directory: str) -> DataFrame:
    found = st.run_available(st.session_counts(st.event_stream(spark, directory), "1 hour"), "sessions")
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_closed_sessions(spark: SparkSession, directory: str) -> DataFrame:
    """Sessions that the watermark has closed, each told once; open ones stay in the state."""
    found = st.run_closed(st.session_counts(st.event_stream(spark, directory), "1 hour"), "closed-sessions")
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_flushes(spark: SparkSession, directory: str) -> DataFrame:
    """Buffers of each user, flushed at three events or after two idle hours."""
    found = st.run_closed(st.flushed_buffers(st.event_stream(spark, directory), "user_id", FULL, IDLE_HOURS * 3600), "flushes")
    return found.withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


FULL, IDLE_HOURS = 3, 2
#: The last watermark: a day before the latest event, in whole milliseconds.
CLOSED = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY FROM events)"
SESSIONS = """g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL {hours} HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)"""

QUERIES = {
    "stream_closed_sessions": (
        stream_closed_sessions,
        f"WITH {SESSIONS.format(hours=1)} SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 1 HOUR <= {CLOSED}",
    ),
    "stream_flushes": (
        stream_flushes,
        f"""WITH {SESSIONS.format(hours=IDLE_HOURS)}, p AS (SELECT *, (row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) - 1) // {FULL} AS flush, min(ts) OVER (PARTITION BY user_id, k) AS session_start,
          max(ts) OVER (PARTITION BY user_id, k) AS ends, max(k) OVER (PARTITION BY user_id) = k AS newest FROM s)
        SELECT user_id AS key, session_start, flush::INTEGER AS flush, count(*)::INTEGER AS n, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id,
          CASE WHEN count(*) = {FULL} THEN 'full' ELSE 'idle' END AS by FROM p GROUP BY user_id, session_start, flush HAVING count(*) = {FULL} OR NOT bool_or(newest) OR max(ends) + INTERVAL {IDLE_HOURS} HOUR < {CLOSED}""",
    ),
    "stream_hourly": (
        stream_hourly,
        "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM events GROUP BY 1, 2",
    ),
    "stream_sliding": (
        stream_sliding,
        "SELECT time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01')::TIMESTAMP - k * INTERVAL 2 HOUR AS start, count(*) AS n FROM events, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1",
    ),
    "stream_status": (stream_status, "SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1"),
    "stream_sessions": (
        stream_sessions,
        """WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k""",
    ),
}
