"""Registered telemetry queries (F09-F11, P11, P12, JN7, JN8, A04-A18, A25-A27, W06, O08)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import outcomes
from quarrymill.operators import telemetry as tel
from quarrymill.plans.links import LINKS_SQL
from quarrymill.session import table
from quarrymill.staging import staged

# Stand-in: event types as failure reasons; a purchase is a success.
REASONS = {"click": "probe_dns_error", "error": "proxy_fail:proxy_timeout", "view": "scrape_blocked_cloudflare", "signup": "scrape_thin_content"}
BINS = [0, 1, 2, 5, 10, 20]
STATUS = "CASE event_type WHEN 'error' THEN 503 WHEN 'click' THEN 404 WHEN 'view' THEN 403 ELSE 200 END"


def attempts(spark: SparkSession, directory: str) -> DataFrame:
    reason = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])[F.col("event_type")]
    return table(spark, directory, "events").select("event_id", "ts", "user_id", "event_type", reason.alias("reason"), F.round(F.col("value") * 100, 4).alias("ms"))


CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REASONS.items())
ATT = f"(SELECT event_id, ts, user_id, event_type, CASE event_type {CASES} END AS reason, round(value * 100, 4) AS ms FROM events)"


def error_category_counts(spark: SparkSession, directory: str) -> DataFrame:
    found = attempts(spark, directory).select(outcomes.error_category(F.col("reason")).alias("category"))
    return found.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "category")


def fail_reason_buckets(spark: SparkSession, directory: str) -> DataFrame:
    found = attempts(spark, directory).select(outcomes.reason_bucket(F.col("reason")).alias("bucket"))
    return found.groupBy("bucket").agg(F.count("*").alias("n"))


def transient_share(spark: SparkSession, directory: str) -> DataFrame:
    flagged = attempts(spark, directory).where(F.col("reason").isNotNull()).withColumn("transient", outcomes.is_transient(F.col("reason")))
    return flagged.groupBy("event_type", "transient").agg(F.count("*").alias("n"))


def failure_diagnosis(spark: SparkSession, directory: str) -> DataFrame:
    return tel.failure_diagnosis(attempts(spark, directory))


def stage_funnel(spark: SparkSession, directory: str) -> DataFrame:
    return tel.stage_funnel(attempts(spark, directory))


def funnel_reasons(spark: SparkSession, directory: str) -> DataFrame:
    return tel.funnel_reasons(attempts(spark, directory))


def funnel_times(spark: SparkSession, directory: str) -> DataFrame:
    return tel.funnel_times(attempts(spark, directory), "ms", [50, 75, 90, 95, 99])


def run_advice(spark: SparkSession, directory: str) -> DataFrame:
    """What each day's run should change, by thresholds on its rates."""
    runs = attempts(spark, directory).groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n"), F.count_if(F.col("reason").isNull()).alias("ok"), F.count_if(F.col("event_type") == "error").alias("proxy"), F.count_if(F.col("ms") > 20000).alias("slow")
    )
    share = lambda c: F.col(c) / F.col("n")
    advice = F.array_compact(F.array(F.when(share("ok") < 0.2, "success"), F.when(share("proxy") > 0.2, "proxy"), F.when(share("slow") > 0.3, "timeout"), F.when(F.col("n") < 300, "load")))
    return runs.select("day", F.array_join(advice, ",").alias("advice"))


def latency_percentiles(spark: SparkSession, directory: str) -> DataFrame:
    return tel.rank_percentiles(attempts(spark, directory), ["event_type"], "ms", [50, 75, 90, 95, 99])


def overall_percentiles(spark: SparkSession, directory: str) -> DataFrame:
    return tel.rank_percentiles(attempts(spark, directory), [], "ms", [50, 90, 99], "half", None)


def median_percentiles(spark: SparkSession, directory: str) -> DataFrame:
    return tel.rank_percentiles(attempts(spark, directory), ["event_type"], "ms", [50, 95], "median", 3)


def percentile_states(spark: SparkSession, directory: str) -> DataFrame:
    """States of sixteen instances, stored and merged: counts, means, and whether each percentile's true rank is within twice the stated error."""
    rows = attempts(spark, directory).select("event_type", "user_id", "ms").where("ms IS NOT NULL")
    stored = staged(tel.value_states(rows.withColumn("instance", F.col("user_id") % 16), ["event_type", "instance"], "ms"), "latency-states")
    merged = staged(tel.state_percentiles(tel.merged_states(stored, ["event_type"]), ["event_type"], [50, 95, 99]), "percentiles")
    ranked, error = rows.join(merged, "event_type"), 2 * tel.RANK_ERROR  # twice what 99 of 100 keep to
    within = lambda p: (F.count_if(F.col("ms") < F.col(f"p{p}")) / F.count("*") <= p / 100 + error) & (F.count_if(F.col("ms") <= F.col(f"p{p}")) / F.count("*") >= p / 100 - error)
    return ranked.groupBy("event_type").agg(F.first("n").alias("n"), F.round(F.first("mean"), 4).alias("mean"), *[within(p).alias(f"p{p}_within") for p in (50, 95, 99)])


def latency_stats(spark: SparkSession, directory: str) -> DataFrame:
    rows = attempts(spark, directory).groupBy("event_type")
    return rows.agg(
        F.round(F.avg("ms"), 4).alias("avg_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.round(F.coalesce(F.stddev_samp("ms"), F.lit(0.0)), 4).alias("stdev_ms")
    )


def latency_histogram(spark: SparkSession, directory: str) -> DataFrame:
    return tel.histogram(attempts(spark, directory).select((F.col("ms") / 1000).alias("sec")), "sec", BINS, "s")


def conditional_counts(spark: SparkSession, directory: str) -> DataFrame:
    ms = F.col("ms")
    return attempts(spark, directory).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("reason").isNull()).alias("success"),
        F.count_if(ms < 5000).alias("under_5s"),
        F.count_if(ms < 20000).alias("under_20s"),
        F.count_if(ms >= 40000).alias("from_40s"),
        tel.share(F.count_if(F.col("reason").isNull()), F.count("*")).alias("success_rate"),
    )


def throughput(spark: SparkSession, directory: str) -> DataFrame:
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 60e6
    base = attempts(spark, directory).agg(F.count("*").alias("processed"), span.alias("minutes"), F.count_if(F.col("reason").isNull()).alias("ok"))
    rate = F.when(F.col("minutes") > 0, F.col("processed") / F.col("minutes")).otherwise(0.0)
    return base.select("processed", F.round(rate, 4).alias("per_minute"), F.round(F.when(rate > 0, 1000 / rate).otherwise(0.0), 4).alias("eta_minutes"), tel.share(F.col("ok"), F.col("processed")).alias("success_rate"))


def peak_concurrency(spark: SparkSession, directory: str) -> DataFrame:
    spans = attempts(spark, directory).select("ts", (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(1), F.lit(0), F.lit(0))).alias("until"))
    return tel.peak_concurrency(spans, "ts", "until")


def fail_speed_bands(spark: SparkSession, directory: str) -> DataFrame:
    ms = F.col("ms")
    return attempts(spark, directory).where(F.col("reason").isNotNull()).agg(
        F.count_if(ms < 3000).alias("fast"), F.count_if((ms >= 3000) & (ms < 10000)).alias("medium"), F.count_if((ms >= 10000) & (ms < 25000)).alias("slow"), F.count_if(ms >= 25000).alias("timeout")
    )


def bandwidth(spark: SparkSession, directory: str) -> DataFrame:
    rows = attempts(spark, directory).withColumn("bytes", F.col("event_id") % 5000)
    ok = F.greatest(F.count_if(F.col("reason").isNull()), F.lit(1))
    return rows.agg(F.sum("bytes").alias("bytes"), F.round(F.sum("bytes") / 1048576, 4).alias("mb"), F.round(F.sum("bytes") / ok / 1024, 4).alias("kb_per_ok"))


def status_distribution(spark: SparkSession, directory: str) -> DataFrame:
    return attempts(spark, directory).select(F.expr(STATUS).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def last_errors(spark: SparkSession, directory: str) -> DataFrame:
    failed = attempts(spark, directory).where(F.col("reason").isNotNull()).select("event_id", "ts", "reason")
    return tel.last_errors(failed, [F.col("ts").desc(), F.col("event_id").desc()], 10)


def slowest(spark: SparkSession, directory: str) -> DataFrame:
    return tel.last_errors(attempts(spark, directory).select("event_id", "ms"), [F.col("ms").desc(), F.col("event_id")], 30)


def best_group(spark: SparkSession, directory: str) -> DataFrame:
    """The event type with the most rows, and that of the least mean latency; ties by name."""
    groups = attempts(spark, directory).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("ms"), 4).alias("ms"))
    return groups.agg(F.max_by("event_type", F.struct("n", "event_type")).alias("most"), F.min_by("event_type", F.struct("ms", "event_type")).alias("quickest"))


def provider_counters(spark: SparkSession, directory: str) -> DataFrame:
    rows = attempts(spark, directory).withColumn("provider", F.col("user_id") % 5)
    ok = F.col("event_type") != "error"
    return rows.groupBy("provider").agg(
        F.count("*").alias("total"), F.count_if(ok).alias("ok"), tel.share(F.count_if(ok), F.count("*")).alias("success_rate"), F.round(F.avg(F.when(ok, F.col("ms"))), 4).alias("avg_ms")
    )


def top_domains(spark: SparkSession, directory: str) -> DataFrame:
    from quarrymill.functions import urls

    hosts = table(spark, directory, "pages").select(urls.netloc(F.col("url")).alias("host"))
    return hosts.groupBy("host").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "host").limit(10)


def run_comparison(spark: SparkSession, directory: str) -> DataFrame:
    """Solo against combined run: success by event type in the first and second half of users."""
    rows = attempts(spark, directory).withColumn("half", F.col("user_id") % 2)
    by = lambda half, name: rows.where(F.col("half") == half).groupBy("event_type").agg(F.round(F.avg("ms"), 4).alias(name))
    both = by(0, "solo").join(by(1, "combined"), "event_type")
    delta = F.round(F.col("combined") - F.col("solo"), 4)
    verdict = F.when(F.abs(delta) <= 100, "same").when(delta > 0, "slower").otherwise("faster")
    return both.withColumn("delta", delta).withColumn("verdict", verdict)


def subpage_metrics(spark: SparkSession, directory: str) -> DataFrame:
    """Totals, averages per page, filter rate and the share of pages without links."""
    from quarrymill.operators import links

    pages = table(spark, directory, "pages")
    found = links.extract_links(pages)
    kept = links.html_links(found).groupBy("page_id").agg(F.count("*").alias("kept"))
    raw = found.groupBy("page_id").agg(F.count("*").alias("raw"))
    per = pages.select("page_id").join(raw, "page_id", "left").join(kept, "page_id", "left").fillna(0)
    return per.agg(
        F.sum("raw").alias("links"),
        F.sum("kept").alias("kept"),
        F.round(F.avg("raw"), 4).alias("links_per_page"),
        tel.share(F.sum("raw") - F.sum("kept"), F.sum("raw")).alias("filter_rate"),
        tel.share(F.count_if(F.col("raw") == 0), F.count("*")).alias("pages_without_links"),
    )


def _percentile_sql(keys: str, picks: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""WITH r AS (SELECT *, row_number() OVER ({part} ORDER BY ms) - 1 AS k, count(*) OVER ({part}) AS n FROM {ATT} WHERE ms IS NOT NULL)
    SELECT {keys + "," if keys else ""} {picks} FROM r {f"GROUP BY {keys}" if keys else ""}"""


def _pick(p: int, digits: int | None = 1, index: str | None = None) -> str:
    value = f"max(CASE WHEN k = least({index or f'floor(n * {p} / 100)'}, n - 1) THEN ms END)"
    return (f"round({value}, {digits})" if digits is not None else value) + f" AS p{p}"


MEDIAN = "round((max(CASE WHEN k = floor((n - 1) / 2) THEN ms END) + max(CASE WHEN k = floor(n / 2) THEN ms END)) / 2, 3) AS p50"
PROBE, THIN = "prefix(b, 'probe:')", "prefix(b, 'scrape:thin')"

QUERIES = {
    "error_category_counts": (error_category_counts, f"SELECT {outcomes.error_category_sql('reason')} AS category, count(*) AS n FROM {ATT} GROUP BY 1"),
    "fail_reason_buckets": (fail_reason_buckets, f"SELECT {outcomes.reason_bucket_sql('reason')} AS bucket, count(*) AS n FROM {ATT} GROUP BY 1"),
    "transient_share": (
        transient_share,
        f"SELECT event_type, {outcomes.sql_contains_any('lower(reason)', outcomes.TRANSIENT_WORDS)} AS transient, count(*) AS n FROM {ATT} WHERE reason IS NOT NULL GROUP BY 1, 2",
    ),
    "failure_diagnosis": (
        failure_diagnosis,
        f"""WITH a AS (SELECT reason, {outcomes.reason_bucket_sql("reason")} AS bucket FROM {ATT}),
        f AS (SELECT bucket, {outcomes.bucket_kind_sql("bucket")} AS kind, count(*) AS n FROM a WHERE reason IS NOT NULL GROUP BY 1),
        l AS (SELECT kind, bucket, sum(n) AS n FROM f GROUP BY ROLLUP (kind, bucket) HAVING kind IS NOT NULL)
        SELECT kind, bucket, CAST(n AS BIGINT) AS n, round(100 * n / (SELECT count(reason) FROM a), 1) AS pct_of_failures, round(100 * n / (SELECT count(*) FROM a), 1) AS pct_of_total FROM l""",
    ),
    "stage_funnel": (
        stage_funnel,
        f"""WITH a AS (SELECT reason, {outcomes.reason_bucket_sql("reason")} AS b FROM {ATT}),
        c AS (SELECT count(*) AS n, count(*) FILTER (reason IS NOT NULL AND {PROBE}) AS p, count(*) FILTER (reason IS NOT NULL AND NOT {PROBE} AND NOT {THIN}) AS m,
          count(*) FILTER (reason IS NOT NULL AND {THIN}) AS s FROM a),
        t AS (SELECT 'probe' AS stage, n AS entered, p AS fail FROM c UNION ALL SELECT 'main', n - p, m FROM c UNION ALL SELECT 'subpages', n - p - m, s FROM c)
        SELECT stage, entered, entered - fail AS ok, fail, round(100 * (entered - fail) / entered, 1) AS rate FROM t""",
    ),
    "funnel_reasons": (
        funnel_reasons,
        f"""WITH a AS (SELECT {outcomes.reason_bucket_sql("reason")} AS bucket FROM {ATT} WHERE reason IS NOT NULL),
        c AS (SELECT CASE WHEN prefix(bucket, 'probe:') THEN 'probe' WHEN prefix(bucket, 'scrape:thin') THEN 'subpages' ELSE 'main' END AS stage, bucket, count(*) AS n FROM a GROUP BY 1, 2)
        SELECT *, row_number() OVER (PARTITION BY stage ORDER BY n DESC, bucket)::INTEGER AS rank FROM c""",
    ),
    "funnel_times": (
        funnel_times,
        f"""WITH a AS (SELECT ms, CASE WHEN reason IS NULL THEN 'subpages' WHEN {PROBE} THEN 'probe' WHEN {THIN} THEN 'subpages' ELSE 'main' END AS last FROM (SELECT *, {outcomes.reason_bucket_sql("reason")} AS b FROM {ATT})),
        s AS (SELECT 'probe' AS stage, ms FROM a UNION ALL SELECT 'main', ms FROM a WHERE last <> 'probe' UNION ALL SELECT 'subpages', ms FROM a WHERE last = 'subpages'),
        k AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY ms) - 1 AS k, count(*) OVER (PARTITION BY stage) AS c FROM s)
        SELECT stage, {", ".join(f"round(max(CASE WHEN k = least(floor(c * {p} / 100), c - 1) THEN ms END), 1) AS p{p}" for p in (50, 75, 90, 95, 99))} FROM k GROUP BY 1""",
    ),
    "run_advice": (
        run_advice,
        f"""WITH r AS (SELECT ts::DATE AS day, count(*) AS n, count(*) FILTER (reason IS NULL) AS ok, count(*) FILTER (event_type = 'error') AS proxy, count(*) FILTER (ms > 20000) AS slow FROM {ATT} GROUP BY 1)
        SELECT day, concat_ws(',', CASE WHEN ok / n < 0.2 THEN 'success' END, CASE WHEN proxy / n > 0.2 THEN 'proxy' END, CASE WHEN slow / n > 0.3 THEN 'timeout' END, CASE WHEN n < 300 THEN 'load' END) AS advice FROM r""",
    ),
    "latency_percentiles": (latency_percentiles, _percentile_sql("event_type", ", ".join(_pick(p) for p in (50, 75, 90, 95, 99)))),
    "overall_percentiles": (overall_percentiles, _percentile_sql("", f"{_pick(50, None, 'floor(n / 2)')}, {_pick(90, None)}, {_pick(99, None)}")),
    "median_percentiles": (median_percentiles, _percentile_sql("event_type", f"{MEDIAN}, {_pick(95, 3)}")),
    "percentile_states": (
        percentile_states,
        f"SELECT event_type, count(*) AS n, round(avg(ms), 4) AS mean, true AS p50_within, true AS p95_within, true AS p99_within FROM {ATT} WHERE ms IS NOT NULL GROUP BY 1",
    ),
    "latency_stats": (
        latency_stats,
        f"SELECT event_type, round(avg(ms), 4) AS avg_ms, min(ms) AS min_ms, max(ms) AS max_ms, round(coalesce(stddev_samp(ms), 0), 4) AS stdev_ms FROM {ATT} GROUP BY 1",
    ),
    "latency_histogram": (
        latency_histogram,
        "SELECT CASE WHEN hi IS NULL THEN '>' || lo || 's' ELSE lo || '-' || hi || 's' END AS bin, (SELECT count(*) FROM events WHERE round(value * 100, 4) / 1000 >= lo AND (hi IS NULL OR round(value * 100, 4) / 1000 < hi)) AS n FROM (VALUES "
        + ", ".join(f"({a}, {b})" for a, b in zip(BINS, [*BINS[1:], "NULL"]))
        + ") t(lo, hi)",
    ),
    "conditional_counts": (
        conditional_counts,
        f"""SELECT count(*) AS total, count(*) FILTER (reason IS NULL) AS success, count(*) FILTER (ms < 5000) AS under_5s, count(*) FILTER (ms < 20000) AS under_20s,
        count(*) FILTER (ms >= 40000) AS from_40s, round(100 * count(*) FILTER (reason IS NULL) / count(*), 1) AS success_rate FROM {ATT}""",
    ),
    "throughput": (
        throughput,
        f"""WITH b AS (SELECT count(*) AS processed, (epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6 AS minutes, count(*) FILTER (reason IS NULL) AS ok FROM {ATT})
        SELECT processed, round(processed / minutes, 4) AS per_minute, round(1000 / (processed / minutes), 4) AS eta_minutes, round(100 * ok / processed, 1) AS success_rate FROM b""",
    ),
    "peak_concurrency": (
        peak_concurrency,
        "SELECT CAST(max(n) AS BIGINT) AS peak FROM (SELECT sum(d) OVER (ORDER BY moment) AS n FROM (SELECT moment, sum(d) AS d FROM (SELECT ts AS moment, 1 AS d FROM events UNION ALL SELECT ts + INTERVAL 1 HOUR, -1 FROM events) GROUP BY moment))",
    ),
    "fail_speed_bands": (
        fail_speed_bands,
        f"SELECT count(*) FILTER (ms < 3000) AS fast, count(*) FILTER (ms >= 3000 AND ms < 10000) AS medium, count(*) FILTER (ms >= 10000 AND ms < 25000) AS slow, count(*) FILTER (ms >= 25000) AS timeout FROM {ATT} WHERE reason IS NOT NULL",
    ),
    "bandwidth": (
        bandwidth,
        f"SELECT CAST(sum(event_id % 5000) AS BIGINT) AS bytes, round(sum(event_id % 5000) / 1048576, 4) AS mb, round(sum(event_id % 5000) / greatest(count(*) FILTER (reason IS NULL), 1) / 1024, 4) AS kb_per_ok FROM {ATT}",
    ),
    "status_distribution": (status_distribution, f"SELECT {STATUS} AS status, count(*) AS n FROM events GROUP BY 1"),
    "last_errors": (last_errors, f"SELECT event_id, ts, reason FROM {ATT} WHERE reason IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 10"),
    "slowest": (slowest, f"SELECT event_id, ms FROM {ATT} ORDER BY ms DESC, event_id LIMIT 30"),
    "best_group": (
        best_group,
        f"""WITH g AS (SELECT event_type, count(*) AS n, round(avg(ms), 4) AS ms FROM {ATT} GROUP BY 1)
        SELECT (SELECT event_type FROM g ORDER BY n DESC, event_type DESC LIMIT 1) AS most, (SELECT event_type FROM g ORDER BY ms, event_type LIMIT 1) AS quickest""",
    ),
    "provider_counters": (
        provider_counters,
        f"""SELECT user_id % 5 AS provider, count(*) AS total, count(*) FILTER (event_type <> 'error') AS ok, round(100 * count(*) FILTER (event_type <> 'error') / count(*), 1) AS success_rate,
        round(avg(ms) FILTER (event_type <> 'error'), 4) AS avg_ms FROM {ATT} GROUP BY 1""",
    ),
    "top_domains": (top_domains, r"SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1) AS host, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, host LIMIT 10"),
    "run_comparison": (
        run_comparison,
        f"""WITH h AS (SELECT event_type, round(avg(ms) FILTER (user_id % 2 = 0), 4) AS solo, round(avg(ms) FILTER (user_id % 2 = 1), 4) AS combined FROM {ATT} GROUP BY 1)
        SELECT event_type, solo, combined, round(combined - solo, 4) AS delta, CASE WHEN abs(round(combined - solo, 4)) <= 100 THEN 'same' WHEN combined > solo THEN 'slower' ELSE 'faster' END AS verdict FROM h""",
    ),
    "subpage_metrics": (
        subpage_metrics,
        f"""WITH {LINKS_SQL}, r AS (SELECT page_id, count(*) AS n FROM extracted WHERE kind IS NOT NULL GROUP BY 1), k AS (SELECT page_id, count(*) AS n FROM html GROUP BY 1),
        p AS (SELECT page_id, coalesce(r.n, 0) AS raw, coalesce(k.n, 0) AS kept FROM pages LEFT JOIN r USING (page_id) LEFT JOIN k USING (page_id))
        SELECT sum(raw)::BIGINT AS links, sum(kept)::BIGINT AS kept, round(avg(raw), 4) AS links_per_page, round(100 * (sum(raw) - sum(kept)) / sum(raw), 1) AS filter_rate, round(100 * count(*) FILTER (raw = 0) / count(*), 1) AS pages_without_links FROM p""",
    ),
}
