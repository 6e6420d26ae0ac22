"""Analytics over log messages: typed extraction in one pass, as-of matches, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOG_SCHEMA = "timestamp string, level string, message string, module string, function string, line int"
# What messages tell, and how.
DONE = r"([0-9]+) páginas \(([0-9]+) sucesso\) em ([0-9.]+)ms"
BATCH = r"Scrape de ([0-9]+) subpages concluído em ([0-9.]+)ms"
UNREACHABLE = r"URL inacessível: (.+?) - (.+)"
MAIN_FAILED = r"Falha ao obter main page de (.+?) - (.+)"
CIRCUIT = r"Circuit OPEN para (.+?) \("
SLOW_DOMAIN = r"Domínio marcado como lento: (.+)"
CURL_HOST = r"falhou para https?://([^\s,/]+)"
TOKENS = r"total: ([0-9,]+) tokens"
BATCH_ID = r"\[Batch (\w+)\] Iniciando:"
MAIN_REASONS = ("NO_RESPONSE", "CLOUDFLARE", "BLOCKED", "TIMEOUT", "EMPTY_CONTENT", "SSL_ERROR", "NOT_FOUND")


def read_logs(spark, path: str) -> DataFrame:
    """JSON lines; lines that are no JSON are skipped."""
    return spark.read.schema(LOG_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def write_logs(rows: DataFrame, path: str) -> None:
    """One JSON object per line, null fields left out."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)


def extracted(logs: DataFrame) -> DataFrame:
    """``logs`` with typed columns, null where a message does not tell."""

    def part(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract("message", pattern, group), F.lit(""))

    reason = part(MAIN_FAILED, 2)
    kind = F.when(reason.isNull(), F.lit(None))
    for name in MAIN_REASONS:
        kind = kind.when(F.contains(reason, F.lit(name)), name.lower())
    return logs.select(
        "*",
        part(DONE, 1).cast("int").alias("pages"),
        part(DONE, 2).cast("int").alias("pages_ok"),
        part(DONE, 3).cast("double").alias("ms"),
        part(BATCH, 1).cast("int").alias("batch_size"),
        part(BATCH, 2).cast("double").alias("batch_ms"),
        part(UNREACHABLE, 1).alias("unreachable"),
        kind.otherwise(F.when(reason.isNotNull(), "other_main_page_fail")).alias("main_reason"),
        part(CIRCUIT, 1).alias("circuit"),
        part(SLOW_DOMAIN, 1).alias("slow_domain"),
        part(CURL_HOST, 1).alias("curl_host"),
        F.replace(part(TOKENS, 1), F.lit(","), F.lit("")).cast("long").alias("tokens"),
    )


def latest_batch(logs: DataFrame) -> DataFrame:
    """batch: the id in the last start message, null without one."""
    started = F.nullif(F.regexp_extract("message", BATCH_ID, 1), F.lit(""))
    return logs.agg(F.max_by(F.when(started.isNotNull(), started), F.when(started.isNotNull(), F.col("timestamp"))).alias("batch"))


def latest_unused(asks: DataFrame, offers: DataFrame, most: int) -> DataFrame:
    """id, value of the first ``most`` asks (id, time, order): each takes the latest offer (time, value) at or
    before it whose value no earlier ask has taken, ties to the larger value; null where none is left.

    This is a report on the top of a list, served in an order of its own; `ordered.take_latest_unused`
    serves all asks in order of time. An ask can need no more than its ``most`` latest
    values, so what meets in one row is bounded by the square of ``most``.
    """
    first = asks.orderBy("order", "id").limit(most).select("id", "order", F.col("time").alias("until"))
    met = F.broadcast(first).join(offers, F.col("time") <= F.col("until"))  # at most ``most`` rows are broadcast
    latest = met.groupBy("id", "order", "value").agg(F.max("time").alias("time"))
    order = Window.partitionBy("id").orderBy(F.desc("time"), F.desc("value"))
    some = latest.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    lists = some.groupBy("id", "order").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]).alias("values"))
    one = lists.agg(F.array_sort(F.collect_list(F.struct("order", "id", "values"))).alias("asks"))
    kind = dict(offers.dtypes)["value"]
    start = F.struct(F.array().cast(f"array<{kind}>").alias("used"), F.array().cast(f"array<struct<id: {dict(asks.dtypes)['id']}, value: {kind}>>").alias("out"))

    def take(acc: Column, ask: Column) -> Column:
        value = F.get(F.array_except(ask["values"], acc["used"]), 0)  # keeps the order of the first
        return F.struct(
            F.when(value.isNull(), acc["used"]).otherwise(F.array_append(acc["used"], value)).alias("used"),
            F.array_append(acc["out"], F.struct(ask["id"].alias("id"), value.alias("value"))).alias("out"),
        )

    taken = one.select(F.inline(F.aggregate("asks", start, take, lambda acc: acc["out"])))
    return first.select("id").join(taken, "id", "left")
