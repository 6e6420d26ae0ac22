"""Registered queries on message labels and small rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import ladders as ld
from quarrymill.functions.rules import quote
from quarrymill.operators.telemetry import rank_percentiles
from quarrymill.plans.facts import QUERIES as FACT_QUERIES
from quarrymill.plans.telemetry import attempts
from quarrymill.session import table

# Messages that events stand for, one of each kind that the ladders tell apart.
MESSAGES = (
    "getaddrinfo failed", "Connection refused", "Read timed out", "Connection reset by peer", "SSL handshake", "Too many redirects",
    "HTTP 403 WAF", "captcha wall", "rate limit hit", "soft 404", "empty body", "bad payload encoding", "proxy down", "Cloudflare", "strange", "",
)


def _messages(spark: SparkSession, directory: str) -> DataFrame:
    pick = F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("event_id") % len(MESSAGES) + 1).cast("int"))
    return table(spark, directory, "events").select("event_id", "user_id", pick.alias("message"))


FIELD = "message"
MERGED_CONTACTS_SQL = FACT_QUERIES["merged_contacts"][1]
MSG = f"(SELECT event_id, user_id, [{', '.join(map(quote, MESSAGES))}][event_id % {len(MESSAGES)} + 1] AS message FROM events)"


def message_labels(spark: SparkSession, directory: str) -> DataFrame:
    return _messages(spark, directory).select("event_id", *[ld.label(F.col("message"), name).alias(name) for name in ld.LADDERS])


def retryable_errors(spark: SparkSession, directory: str) -> DataFrame:
    kinds = _messages(spark, directory).select(ld.label(F.col("message"), "probe").alias("kind"))
    return kinds.groupBy("kind").agg(F.count("*").alias("n")).withColumn("retryable", ld.is_retryable(F.col("kind")))


def told_errors(spark: SparkSession, directory: str) -> DataFrame:
    """The error that is told of each user's many: the first in order of kinds, then of events."""
    rows = _messages(spark, directory).withColumn("kind", ld.label(F.col("message"), "probe"))
    best = rows.groupBy("user_id").agg(F.min_by(F.struct("kind", "event_id"), F.struct(ld.error_rank(F.col("kind")), F.col("event_id"))).alias("b"))
    return best.select("user_id", "b.kind", "b.event_id")


def page_charsets(spark: SparkSession, directory: str) -> DataFrame:
    header = F.when(F.col("page_id") % 3 == 0, "text/html; Charset=ISO-8859-1 ; x").when(F.col("page_id") % 3 == 1, "text/html")
    return table(spark, directory, "pages").select("page_id", ld.charset(header, F.col("html")).alias("charset"))


def model_urls(spark: SparkSession, directory: str) -> DataFrame:
    suffix = F.element_at(F.array(F.lit(""), F.lit("/"), F.lit("/v1")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    url = F.when(F.col("s_suppkey") % 7 != 0, F.concat(F.lit("http://m"), F.col("s_suppkey").cast("string"), suffix))
    return table(spark, directory, "supplier").select("s_suppkey", ld.versioned_base_url(url).alias("url"))


def normal_prompts(spark: SparkSession, directory: str) -> DataFrame:
    prompt = F.concat(F.lit("  \n\t"), "text", F.lit(" \n\n "), "role", F.lit("\n"))
    return table(spark, directory, "conversations").select("conv_id", "turn", F.md5(ld.normal_prompt(prompt)).alias("prompt_md5"))


def available_providers(spark: SparkSession, directory: str) -> DataFrame:
    """Providers below 2000 requests, and the smallest of all limits, 0 without any."""
    loads = table(spark, directory, "events").groupBy((F.col("user_id") % 5).alias("provider")).agg(F.count("*").alias("used"))
    free = F.array_join(F.array_sort(F.collect_list(F.when(F.col("used") < 2000, F.col("provider").cast("string")))), ",")
    return loads.agg(free.alias("free"), F.coalesce(F.min("used"), F.lit(0)).alias("least"))


def phase_summary(spark: SparkSession, directory: str) -> DataFrame:
    """Rows, mean and p50 (the element at n // 2) of each event type's first and second half of users."""
    rows = attempts(spark, directory).withColumn("phase", F.col("user_id") % 2)
    p50 = rank_percentiles(rows, ["event_type", "phase"], "ms", [50], "half")
    means = rows.groupBy("event_type", "phase").agg(F.count("*").alias("n"), F.round(F.avg("ms"), 4).alias("avg_ms"))
    return means.join(p50, ["event_type", "phase"])


def merge_metrics(spark: SparkSession, directory: str) -> DataFrame:
    """Facts before and after merging, what merging took away, and the share of documents without any."""
    from quarrymill.operators import facts as ft
    from quarrymill.plans.facts import contact_facts

    raw = contact_facts(spark, directory)
    merged = ft.merged_lists(ft.routed(raw)).agg(F.count("*").alias("merged"))
    used = raw.agg(F.count("*").alias("items"), F.countDistinct("chunk").alias("bundles"))
    every = table(spark, directory, "documents").agg(F.countDistinct("doc_id").alias("docs"))
    one = used.join(merged).join(every)  # three rows of one row each
    return one.select("items", "merged", F.greatest(F.lit(0), F.col("items") - F.col("merged")).alias("removed"), F.round(1 - F.col("bundles") / F.col("docs"), 4).alias("empty_rate"))


QUERIES = {
    "message_labels": (message_labels, f"SELECT event_id, {', '.join(f'{ld.label_sql(FIELD, name)} AS {name}' for name in ld.LADDERS)} FROM {MSG}"),
    "retryable_errors": (
        retryable_errors,
        f"SELECT kind, n, kind IN ('connection_timeout', 'connection_refused', 'unknown', 'blocked') AS retryable FROM (SELECT {ld.label_sql('message', 'probe')} AS kind, count(*) AS n FROM {MSG} GROUP BY 1)",
    ),
    "told_errors": (
        told_errors,
        f"""WITH k AS (SELECT *, {ld.label_sql("message", "probe")} AS kind FROM {MSG}),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY list_position([{", ".join(map(quote, ld.ERROR_PRIORITY))}], kind), event_id) AS n FROM k) SELECT user_id, kind, event_id FROM r WHERE n = 1""",
    ),
    "page_charsets": (
        page_charsets,
        """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'iso-8859-1' ELSE coalesce(nullif(regexp_extract(substr(html, 1, 2048), '(?i)<meta[^>]+charset=["'']?([A-Za-z0-9_\\-]+)', 1), ''), 'utf-8') END AS charset FROM pages""",
    ),
    "model_urls": (model_urls, "SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'http://m' || s_suppkey || '/v1' END AS url FROM supplier"),
    "normal_prompts": (
        normal_prompts,
        "SELECT conv_id, turn, md5(array_to_string(list_filter(list_transform(string_split(text || chr(10) || role, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS prompt_md5 FROM conversations",
    ),
    "available_providers": (
        available_providers,
        "SELECT coalesce(string_agg(CASE WHEN used < 2000 THEN provider::VARCHAR END, ',' ORDER BY provider), '') AS free, min(used) AS least FROM (SELECT user_id % 5 AS provider, count(*) AS used FROM events GROUP BY 1)",
    ),
    "phase_summary": (
        phase_summary,
        """WITH r AS (SELECT event_type, user_id % 2 AS phase, round(value * 100, 4) AS ms FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY event_type, phase ORDER BY ms) - 1 AS k, count(*) OVER (PARTITION BY event_type, phase) AS c FROM r)
        SELECT event_type, phase, count(*) AS n, round(avg(ms), 4) AS avg_ms, round(max(CASE WHEN k = c // 2 THEN ms END), 1) AS p50 FROM k GROUP BY 1, 2""",
    ),
    "merge_metrics": (
        merge_metrics,
        f"""WITH m AS ({MERGED_CONTACTS_SQL}), w AS (SELECT doc_id, unnest(string_split_regex(text, '[ \\n]+')) AS v FROM documents),
        f AS (SELECT count(*) AS items, count(DISTINCT doc_id) AS bundles FROM w WHERE contains(v, '@') OR regexp_matches(v, '[0-9]{{4}}'))
        SELECT items, (SELECT count(*) FROM m) AS merged, greatest(0, items - (SELECT count(*) FROM m)) AS removed, round(1 - bundles / (SELECT count(DISTINCT doc_id) FROM documents), 4) AS empty_rate FROM f""",
    ),
}
