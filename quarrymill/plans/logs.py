"""Registered log analytics (G01-G04, S09, S10, JN6, A27, K10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators import logs as lg
from quarrymill.operators import ordered as od
from quarrymill.operators.telemetry import rank_percentiles
from quarrymill.session import table

KINDS = {
    "purchase": "concat('[Batch b', user_id % 3, '] scrape_all_subpages concluído: ', event_id % 9, ' páginas (', event_id % 4, ' sucesso) em ', event_id % 5000, '.5ms')",
    "error": "concat('Falha ao obter main page de https://h', user_id % 20, '.com - ', CASE event_id % 3 WHEN 0 THEN 'TIMEOUT' WHEN 1 THEN 'SSL_ERROR x' ELSE 'odd' END)",
    "click": "concat('Circuit OPEN para h', user_id % 20, '.com (5 falhas)')",
    "signup": "concat('[Batch b', event_id % 7, '] Iniciando: ', event_id)",
    "view": "concat('Chunking concluído: 3 chunks, total: ', event_id % 90, ',', 100 + event_id % 900, ' tokens')",
}
MESSAGE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in KINDS.items()) + " END"


def rendered(spark: SparkSession, directory: str) -> DataFrame:
    """Events as log messages."""
    return table(spark, directory, "events").select("event_id", "user_id", F.expr("date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS')").alias("timestamp"), F.expr(MESSAGE).alias("message"))


LOGS = f"(SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, ts, {MESSAGE} AS message FROM events)"


def log_extract(spark: SparkSession, directory: str) -> DataFrame:
    return lg.extracted(rendered(spark, directory)).select("event_id", "pages", "pages_ok", "ms", "main_reason", "circuit", "tokens")


def log_report(spark: SparkSession, directory: str) -> DataFrame:
    rows = lg.extracted(rendered(spark, directory))
    return rows.agg(
        F.count("*").alias("lines"), F.count("pages").alias("companies"), F.sum("pages").alias("pages"), F.sum("pages_ok").alias("pages_ok"), F.round(F.avg("ms"), 4).alias("avg_ms"),
        F.count_if(F.col("ms") < 1000).alias("under_1s"), F.count_if(F.col("ms") >= 4000).alias("from_4s"), F.count("main_reason").alias("main_failures"), F.count("circuit").alias("circuits"),
        F.countDistinct("circuit").alias("circuit_hosts"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("most_tokens"),
    )


def log_percentiles(spark: SparkSession, directory: str) -> DataFrame:
    return rank_percentiles(lg.extracted(rendered(spark, directory)).select("ms"), [], "ms", [50, 90, 95], digits=None)


def main_failures(spark: SparkSession, directory: str) -> DataFrame:
    return lg.extracted(rendered(spark, directory)).where("main_reason IS NOT NULL").groupBy("main_reason").agg(F.count("*").alias("n"))


def latest_batch(spark: SparkSession, directory: str) -> DataFrame:
    return lg.latest_batch(rendered(spark, directory))


def top_circuits(spark: SparkSession, directory: str) -> DataFrame:
    rows = lg.extracted(rendered(spark, directory)).where("circuit IS NOT NULL").groupBy("circuit").agg(F.count("*").alias("n"))
    return rows.orderBy(F.col("n").desc(), "circuit").limit(10)


def as_of_view(spark: SparkSession, directory: str) -> DataFrame:
    """Each purchase with the value of its user's latest view until then."""
    events = table(spark, directory, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("id"), "ts")
    seen = events.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return od.as_of(bought, seen, "user_id", "ts", "value")


SLOWEST = 30


def slowest_with_viewer(spark: SparkSession, directory: str) -> DataFrame:
    """The 30 largest purchases, each with the user of the latest view until then whom no larger purchase has taken."""
    events = table(spark, directory, "events")
    asks = events.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.col("ts").alias("time"), (-F.col("value")).alias("order"))
    views = events.where("event_type = 'view'").select(F.col("ts").alias("time"), F.col("user_id").alias("value"))
    return lg.latest_unused(asks, views, SLOWEST).select("id", F.col("value").alias("user_id"))


def _purchases_and_views(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, directory, "events").select((F.col("user_id") % 5).alias("provider"), F.col("event_id").alias("id"), F.col("ts").alias("time"), "event_type")
    return events.where("event_type = 'purchase'"), events.where("event_type = 'view'")


def latest_unused_views(spark: SparkSession, directory: str) -> DataFrame:
    """Every purchase, in order of time, with the latest view of anyone that no earlier purchase took."""
    return od.take_latest_unused(*_purchases_and_views(spark, directory), []).select("id", F.col("offer_id").alias("view_id"))


def latest_unused_provider_views(spark: SparkSession, directory: str) -> DataFrame:
    """The same within each of five providers."""
    return od.take_latest_unused(*_purchases_and_views(spark, directory), ["provider"]).select("provider", "id", F.col("offer_id").alias("view_id"), F.col("offer_time").alias("view_ts"))


def _unused_sql(keys: str, columns: str) -> str:
    return f"""WITH e AS (SELECT user_id % 5 AS provider, event_id, ts, event_type = 'view' AS offer FROM events WHERE event_type IN ('view', 'purchase')),
        s AS (SELECT *, sum(CASE WHEN offer THEN 1 ELSE -1 END) OVER ({keys} ORDER BY ts, NOT offer, event_id) - CASE WHEN offer THEN 1 ELSE 0 END AS depth FROM e),
        m AS (SELECT *, lag(CASE WHEN offer THEN event_id END) OVER w AS view_id, lag(CASE WHEN offer THEN ts END) OVER w AS view_ts FROM s
          WINDOW w AS (PARTITION BY {keys.replace("PARTITION BY", "").strip() or "1"}, depth ORDER BY ts, NOT offer, event_id))
        SELECT {columns} FROM m WHERE NOT offer"""


QUERIES = {
    "latest_unused_views": (latest_unused_views, _unused_sql("", "event_id AS id, view_id")),
    "latest_unused_provider_views": (latest_unused_provider_views, _unused_sql("PARTITION BY provider", "provider, event_id AS id, view_id, view_ts")),
    "log_extract": (
        log_extract,
        f"""SELECT event_id, try_cast(regexp_extract(message, '([0-9]+) páginas \\(([0-9]+) sucesso\\) em ([0-9.]+)ms', 1) AS INTEGER) AS pages, try_cast(regexp_extract(message, '([0-9]+) páginas \\(([0-9]+) sucesso\\) em ([0-9.]+)ms', 2) AS INTEGER) AS pages_ok,
        try_cast(regexp_extract(message, 'sucesso\\) em ([0-9.]+)ms', 1) AS DOUBLE) AS ms, CASE WHEN prefix(message, 'Falha') THEN CASE WHEN contains(message, 'TIMEOUT') THEN 'timeout' WHEN contains(message, 'SSL_ERROR') THEN 'ssl_error' ELSE 'other_main_page_fail' END END AS main_reason,
        nullif(regexp_extract(message, 'Circuit OPEN para (.+?) \\(', 1), '') AS circuit, try_cast(replace(regexp_extract(message, 'total: ([0-9,]+) tokens', 1), ',', '') AS BIGINT) AS tokens FROM {LOGS}""",
    ),
    "log_report": (
        log_report,
        """WITH e AS (SELECT *, event_id % 5000 + 0.5 AS ms, (event_id % 90) * 10 ** length((100 + event_id % 900)::VARCHAR) + 100 + event_id % 900 AS tokens FROM events)
        SELECT count(*) AS lines, count(*) FILTER (event_type = 'purchase') AS companies, sum(event_id % 9) FILTER (event_type = 'purchase')::BIGINT AS pages, sum(event_id % 4) FILTER (event_type = 'purchase')::BIGINT AS pages_ok,
        round(avg(ms) FILTER (event_type = 'purchase'), 4) AS avg_ms, count(*) FILTER (event_type = 'purchase' AND ms < 1000) AS under_1s, count(*) FILTER (event_type = 'purchase' AND ms >= 4000) AS from_4s,
        count(*) FILTER (event_type = 'error') AS main_failures, count(*) FILTER (event_type = 'click') AS circuits, count(DISTINCT CASE WHEN event_type = 'click' THEN user_id % 20 END) AS circuit_hosts,
        sum(tokens) FILTER (event_type = 'view')::BIGINT AS tokens, max(tokens) FILTER (event_type = 'view')::BIGINT AS most_tokens FROM e""",
    ),
    "log_percentiles": (
        log_percentiles,
        """WITH r AS (SELECT event_id % 5000 + 0.5 AS ms, row_number() OVER (ORDER BY event_id % 5000) - 1 AS k, count(*) OVER () AS n FROM events WHERE event_type = 'purchase')
        SELECT max(CASE WHEN k = least(floor(n * 50 / 100), n - 1) THEN ms END)::DOUBLE AS p50, max(CASE WHEN k = least(floor(n * 90 / 100), n - 1) THEN ms END)::DOUBLE AS p90, max(CASE WHEN k = least(floor(n * 95 / 100), n - 1) THEN ms END)::DOUBLE AS p95 FROM r""",
    ),
    "main_failures": (main_failures, "SELECT CASE event_id % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'ssl_error' ELSE 'other_main_page_fail' END AS main_reason, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1"),
    "latest_batch": (latest_batch, "SELECT 'b' || event_id % 7 AS batch FROM events WHERE event_type = 'signup' ORDER BY ts DESC LIMIT 1"),
    "top_circuits": (top_circuits, "SELECT 'h' || user_id % 20 || '.com' AS circuit, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1 ORDER BY n DESC, circuit LIMIT 10"),
    "slowest_with_viewer": (
        slowest_with_viewer,
        f"""WITH RECURSIVE c AS (SELECT event_id AS id, ts, row_number() OVER (ORDER BY value DESC, event_id) AS k FROM events WHERE event_type = 'purchase' QUALIFY k <= {SLOWEST}),
        v AS (SELECT k, user_id AS u, max(e.ts) AS t FROM c JOIN events e ON e.event_type = 'view' AND e.ts <= c.ts GROUP BY 1, 2),
        r AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS used UNION ALL
          SELECT r.k + 1, list_append(r.used, arg_max(u, (t, u)) FILTER (NOT list_contains(r.used, u))) FROM r LEFT JOIN v ON v.k = r.k + 1 WHERE r.k < {SLOWEST} GROUP BY r.k, r.used)
        SELECT id, used[-1] AS user_id FROM c JOIN r USING (k)""",
    ),
    "as_of_view": (
        as_of_view,
        """SELECT p.user_id, p.event_id AS id, p.ts, v.value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
        ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    ),
}
