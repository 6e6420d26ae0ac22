"""Registered queries on provider health and limits.

Windows over the few providers run on range partitions, so that no provider's rows meet in one
task. Admissions, picks, waits and
queue levels are replayed from event rows; the two-field bucket with refunds and the bounded
cache are left out, since they are parts of a server and no data processing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators import health as hl
from quarrymill.operators import ordered as od
from quarrymill.session import table

RATE, BURST, TTL = 0.0002, 3.0, 3600
WEIGHTS = ((0, 10), (1, 20), (2, 5), (3, 50), (4, 15))


def provider_events(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "events").select((F.col("user_id") % 5).alias("provider"), "user_id", "event_id", "ts", "event_type", F.round(F.col("value") * 100, 4).alias("ms"))


EV = "(SELECT user_id % 5 AS provider, user_id, event_id, ts, event_type, round(value * 100, 4) AS ms FROM events)"


def moving_latency_50(spark: SparkSession, directory: str) -> DataFrame:
    ok = provider_events(spark, directory).where("event_type <> 'error'")
    return od.moving_average(ok, ["provider"], "ms", ["ts", "event_id"], 50).select("event_id", F.round("avg_recent", 4).alias("avg50"))


def last_failures(spark: SparkSession, directory: str) -> DataFrame:
    found = od.since_last(provider_events(spark, directory), ["provider"], F.col("event_type") == "error", ["ts", "event_id"], "last_failure")
    return found.select("event_id", "last_failure")


def health_scores(spark: SparkSession, directory: str) -> DataFrame:
    rows = provider_events(spark, directory)
    failed = F.col("event_type") == "error"
    asof = rows.agg(F.max("ts").alias("asof"))
    by = rows.groupBy("provider").agg(
        F.count("*").alias("total"), F.avg((~failed).cast("double")).alias("rate"), F.avg(F.when(~failed, F.col("ms"))).alias("ms"), F.count_if(F.col("event_type") == "click").alias("limited"), F.max(F.when(failed, F.col("ts"))).alias("last")
    )
    idle = F.unix_seconds(F.col("asof").cast("timestamp")) - F.unix_seconds(F.col("last").cast("timestamp"))
    scored = by.join(F.broadcast(asof)).select("provider", hl.health_score(F.col("rate"), F.col("ms"), F.col("limited"), F.col("total"), idle).alias("score"))
    return scored.select("provider", "score", hl.health_label(F.col("score")).alias("label"), F.round(hl.combined_score(F.col("score"), F.lit(50), F.col("provider")), 4).alias("combined"))


def weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WEIGHTS, "provider long, weight long")


def weighted_allocation(spark: SparkSession, directory: str) -> DataFrame:
    """Events of each day shared out among providers by weight: the shares follow the busiest provider's count."""
    counts = provider_events(spark, directory).groupBy("provider").agg(F.count("*").alias("weight"))
    return hl.allocation(counts, 97)


def weighted_pick(spark: SparkSession, directory: str) -> DataFrame:
    draws = table(spark, directory, "events").select(F.col("event_id").alias("id"), (F.pmod(F.col("event_id") * 7919, F.lit(1000)) / 1000).alias("u"))
    return hl.cumulative_pick(weights(spark), draws).groupBy("provider").agg(F.count("*").alias("n"))


def cache_hits(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "events").select("event_id", "ts", "user_id")
    return hl.cache_hits(rows, "user_id", ["ts", "event_id"], TTL).select("event_id", "hit")


def bucket_admissions(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return hl.bucket_admissions(rows.select("user_id", "event_id", (F.col("us") / 1e6).alias("seconds")), "user_id", RATE, BURST)


def backoff_schedule(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "events").select("event_id", hl.backoff(F.col("event_id") % 8, 5.0, 300.0).alias("wait"))


def aged_queue(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "events").select("event_id", (F.col("user_id") % 4).alias("priority"), (F.col("event_id") % 200).alias("waited"))
    return rows.select("event_id", hl.aged_priority(F.col("priority"), F.col("waited")).alias("priority"))


def queue_levels(spark: SparkSession, directory: str) -> DataFrame:
    """Requests waiting at each of six levels, zero where none is."""
    levels = spark.range(6).select(F.col("id").alias("priority"))
    counts = aged_queue(spark, directory).groupBy("priority").agg(F.count("*").alias("n"))
    return levels.join(counts, "priority", "left").select("priority", F.coalesce("n", F.lit(0)).alias("n"))


def providers_for_size(spark: SparkSession, directory: str) -> DataFrame:
    """Documents with the providers whose safe input holds them: context - output - overhead."""
    limits = spark.createDataFrame([("small", 3500, 400), ("medium", 4500, 800), ("large", 32000, 4000)], "provider string, context long, output long")
    docs = table(spark, directory, "documents").select("doc_id", F.floor(F.char_length(F.coalesce("text", F.lit(""))) / 3).alias("tokens"))
    safe = limits.withColumn("safe", F.col("context") - F.col("output") - 2500)
    return docs.join(F.broadcast(safe), F.col("tokens") <= F.col("safe")).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("providers"))


SCORE = """CAST(floor(round(40 * rate + 0.3 * CASE WHEN ms <= 3000 THEN 100 WHEN ms >= 25000 THEN 0 ELSE 100 * (1 - (ms - 3000) / 22000) END + 0.2 * 100 * (1 - least(5 * limited / total, 1))
  + 0.1 * CASE WHEN idle IS NULL THEN 100 WHEN idle < 10 THEN 30 WHEN idle < 60 THEN 60 WHEN idle < 300 THEN 80 ELSE 100 END, 9)) AS INTEGER)"""

QUERIES = {
    "moving_latency_50": (
        moving_latency_50,
        f"SELECT event_id, round(avg(ms) OVER (PARTITION BY provider ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 4) AS avg50 FROM {EV} WHERE event_type <> 'error'",
    ),
    "last_failures": (
        last_failures,
        f"SELECT event_id, max(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY provider ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_failure FROM {EV}",
    ),
    "health_scores": (
        health_scores,
        f"""WITH b AS (SELECT provider, count(*) AS total, avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END) AS rate, avg(ms) FILTER (event_type <> 'error') AS ms, count(*) FILTER (event_type = 'click') AS limited,
          epoch((SELECT max(ts) FROM events)::TIMESTAMP)::BIGINT - epoch(max(ts) FILTER (event_type = 'error'))::BIGINT AS idle FROM {EV} GROUP BY 1), s AS (SELECT provider, {SCORE} AS score FROM b)
        SELECT provider, score, CASE WHEN score > 60 THEN 'healthy' WHEN score > 30 THEN 'degraded' ELSE 'unhealthy' END AS label, round(0.5 * score + 0.3 * 50 + 0.2 * greatest(0, 100 - 10 * provider), 4) AS combined FROM s""",
    ),
    "weighted_allocation": (
        weighted_allocation,
        f"""WITH w AS (SELECT provider, count(*) AS weight FROM {EV} GROUP BY 1), n AS (SELECT *, greatest(1, floor(97 * weight / sum(weight) OVER ()))::BIGINT AS n, row_number() OVER (ORDER BY weight DESC, provider DESC) = 1 AS best FROM w)
        SELECT provider, CAST(n + CASE WHEN best THEN greatest(97 - sum(n) OVER (), 0) ELSE 0 END AS BIGINT) AS n FROM n""",
    ),
    "weighted_pick": (
        weighted_pick,
        f"""WITH w(provider, weight) AS (VALUES {", ".join(map(str, WEIGHTS))}), s AS (SELECT provider, (sum(weight) OVER (ORDER BY provider) - weight) / 100 AS low, sum(weight) OVER (ORDER BY provider) / 100 AS high FROM w)
        SELECT provider::BIGINT AS provider, count(*) AS n FROM events JOIN s ON (event_id * 7919) % 1000 / 1000 >= low AND (event_id * 7919) % 1000 / 1000 < high GROUP BY 1""",
    ),
    "cache_hits": (
        cache_hits,
        f"SELECT event_id, coalesce(epoch(ts)::BIGINT - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT < {TTL}, false) AS hit FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM events)",
    ),
    "bucket_admissions": (
        bucket_admissions,
        f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events),
        w AS (SELECT user_id, event_id, k, t, true AS admitted, {BURST - 1}::DOUBLE AS left_over FROM e WHERE k = 1
          UNION ALL SELECT e.user_id, e.event_id, e.k, e.t, least({BURST}::DOUBLE, w.left_over + (e.t - w.t) * {RATE}::DOUBLE) >= 1,
            least({BURST}::DOUBLE, w.left_over + (e.t - w.t) * {RATE}::DOUBLE) - CASE WHEN least({BURST}::DOUBLE, w.left_over + (e.t - w.t) * {RATE}::DOUBLE) >= 1 THEN 1 ELSE 0 END FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
        SELECT user_id, event_id, admitted FROM w""",
    ),
    "backoff_schedule": (backoff_schedule, "SELECT event_id, least(5.0::DOUBLE * 2 ** (event_id % 8), 300.0::DOUBLE) AS wait FROM events"),
    "aged_queue": (aged_queue, "SELECT event_id, greatest(0, user_id % 4 - (event_id % 200) // 30) AS priority FROM events"),
    "queue_levels": (
        queue_levels,
        "SELECT l AS priority, (SELECT count(*) FROM events WHERE greatest(0, user_id % 4 - (event_id % 200) // 30) = l) AS n FROM (SELECT unnest([0, 1, 2, 3, 4, 5])::BIGINT AS l)",
    ),
    "providers_for_size": (
        providers_for_size,
        """SELECT doc_id, string_agg(p, ',' ORDER BY p) AS providers FROM documents, (VALUES ('small', 600), ('medium', 1200), ('large', 25500)) t(p, safe) WHERE length(coalesce(text, '')) // 3 <= safe GROUP BY doc_id""",
    ),
}
