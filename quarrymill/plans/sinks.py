"""Registered queries on sources and sinks: each writes to the shared folder and gives what is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions.text import EFFECTIVE_MAX_TOKENS
from quarrymill.operators import logs as lg
from quarrymill.session import table
from quarrymill.sources import files, versions
from quarrymill.staging import shared_folder
from quarrymill.streaming import events as st


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _chunks(spark: SparkSession, directory: str) -> DataFrame:
    """Documents as chunk rows of their source; empty ones as error rows."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, directory, "documents").select(
        F.col("source").alias("key"), F.col("doc_id").alias("discovery_id"), F.concat(F.lit("https://"), "source").alias("website_url"), F.lit(1).alias("chunk_index"), F.lit(1).alias("total_chunks"),
        text.alias("chunk_content"), F.floor(F.char_length(text) / 3).alias("token_count"), F.lit(None).cast("string").alias("page_source"), F.when(F.trim(text) == "", "empty").alias("error"),
    )


def chunk_sink(spark: SparkSession, directory: str) -> DataFrame:
    """Chunk and error rows appended in two jobs, with the ids that they get."""
    path, rows = _folder(spark, "chunk-sink"), _chunks(spark, directory)
    for part in ("error IS NULL", "error IS NOT NULL"):
        files.append_chunks(rows.where(part), path)
    return files.with_row_ids(files.read_chunks(spark, path), ["key", "discovery_id", "chunk_index"]).select("row_id", "key", "discovery_id", "token_count", "error")


def chunk_dump(spark: SparkSession, directory: str) -> DataFrame:
    """The debug copy of all chunks, counted by key."""
    path = _folder(spark, "chunk-dump")
    files.dump_chunks(_chunks(spark, directory), path)
    back = files.read_report(spark, path, "key string, discovery_id long, token_count long, exceeds_limit boolean", whole=False)
    return back.groupBy("key").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.count_if("exceeds_limit").alias("over"))


def log_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Events as log lines, written and read again; lines that are no JSON are skipped."""
    path = _folder(spark, "log-lines")
    events = table(spark, directory, "events")
    lines = events.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"), F.col("props").alias("message"),
        F.col("event_type").alias("module"), F.when(F.col("event_id") % 2 == 0, "run").alias("function"), F.col("event_id").cast("int").alias("line"),
    )
    lg.write_logs(lines, path)
    events.select(F.concat(F.lit("no json "), "props").alias("value")).write.mode("append").text(path)
    return lg.read_logs(spark, path).select("timestamp", "level", "message", "module", "function", "line")


def report_rows(spark: SparkSession, directory: str) -> DataFrame:
    """A benchmark report by event type, written as JSON and read again."""
    path = _folder(spark, "report")
    report = table(spark, directory, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    files.write_report(report, path)
    return files.read_report(spark, path, "event_type string, n long, mean double", whole=False)


def streamed_rows(spark: SparkSession, directory: str) -> DataFrame:
    """Events appended by a stream in micro-batches, each once even if the stream is started again."""
    path = _folder(spark, "streamed-rows")
    for _ in range(2):
        st.append_batches(st.event_stream(spark, directory).select("event_id", "user_id", "event_type"), f"{path}/rows", f"{path}/progress")
    return spark.read.schema("event_id long, user_id long, event_type string").parquet(f"{path}/rows")


def decoded_pages(spark: SparkSession, directory: str) -> DataFrame:
    """Pages as bytes of three kinds, decoded by the charset that their header or markup tells."""
    kind = F.col("page_id") % 3
    html = F.concat(F.when(kind == 1, '<meta charset="nosuch">').otherwise(""), "html")
    body = F.when(kind == 0, F.encode(F.regexp_replace(html, "[^\\u0000-\\u00ff]", "?"), "iso-8859-1")).otherwise(F.encode(html, "utf-8"))
    rows = table(spark, directory, "pages").select("page_id", body.alias("body"), F.when(kind == 0, "text/html; charset=ISO-8859-1").alias("content_type"))
    return files.decoded(rows, "body", "content_type", "html").select("page_id", F.md5("html").alias("html_md5"))


def versioned_upsert(spark: SparkSession, directory: str) -> DataFrame:
    """Orders kept in buckets: two thirds at first, then every fiftieth again or anew, by version."""
    orders = table(spark, directory, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    kept = versions.VersionedTable(spark, _folder(spark, "orders"), "o_orderkey", orders.schema, buckets=16)
    kept.upsert(orders.where("o_orderkey % 3 < 2"))
    kept.upsert(orders.where("o_orderkey % 50 = 0").withColumn("o_totalprice", -F.col("o_totalprice")))
    return kept.read(0).withColumn("version", F.lit(0)).unionByName(kept.read().withColumn("version", F.lit(1)))


def versioned_refresh(spark: SparkSession, directory: str) -> DataFrame:
    """Part names as children of brands; brands whose new names are all blank keep the old ones."""
    parts = table(spark, directory, "part").select("p_brand", "p_name", "p_partkey")
    children = parts.where("p_partkey % 2 = 0").select("p_brand", "p_name").distinct()
    kept = versions.VersionedTable(spark, _folder(spark, "children"), "p_brand", children.schema, buckets=8)
    kept.refresh(children, "p_name")
    name = F.when(F.col("p_brand").endswith("1"), " ").otherwise(F.concat(F.lit(" new "), "p_type"))
    kept.refresh(table(spark, directory, "part").where("p_partkey % 5 = 0").select("p_brand", name.alias("p_name")).distinct(), "p_name")
    return kept.read()


def lasting_ids(spark: SparkSession, directory: str) -> DataFrame:
    """Events appended in two jobs, with ids that stay: how many, from which to which."""
    path, rows = _folder(spark, "lasting-ids"), table(spark, directory, "events").select("event_id", "event_type")
    for part in ("event_type = 'error'", "event_type <> 'error'"):
        versions.append_with_ids(rows.where(part).repartition(5), path)
    kept = versions.read_with_ids(spark, path, rows.schema)
    return kept.groupBy((F.col("event_type") == "error").alias("first")).agg(
        F.count("*").alias("n"), F.countDistinct("row_id").alias("ids"), F.min("row_id").alias("least"), F.max("row_id").alias("most"), F.sum("event_id").alias("events")
    )


DOCS = "(SELECT source AS key, doc_id, coalesce(text, '') AS t FROM documents)"

QUERIES = {
    "versioned_upsert": (
        versioned_upsert,
        """SELECT o_orderkey, o_orderstatus, o_totalprice, 0 AS version FROM orders WHERE o_orderkey % 3 < 2
        UNION ALL SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 50 = 0 THEN -o_totalprice ELSE o_totalprice END, 1 FROM orders WHERE o_orderkey % 3 < 2 OR o_orderkey % 50 = 0""",
    ),
    "versioned_refresh": (
        versioned_refresh,
        """WITH fresh AS (SELECT DISTINCT p_brand, 'new ' || p_type AS p_name FROM part WHERE p_partkey % 5 = 0 AND NOT suffix(p_brand, '1'))
        SELECT DISTINCT p_brand, p_name FROM part WHERE p_partkey % 2 = 0 AND p_brand NOT IN (SELECT p_brand FROM fresh) UNION ALL SELECT * FROM fresh""",
    ),
    "lasting_ids": (
        lasting_ids,
        """WITH n AS (SELECT event_type = 'error' AS first, count(*) AS n, sum(event_id)::BIGINT AS events FROM events GROUP BY 1)
        SELECT first, n, n AS ids, CASE WHEN first THEN 0 ELSE (SELECT n FROM n WHERE first) END::BIGINT AS least, (CASE WHEN first THEN n ELSE (SELECT sum(n) FROM n) END - 1)::BIGINT AS most, events FROM n""",
    ),
    "chunk_sink": (
        chunk_sink,
        f"SELECT row_number() OVER (ORDER BY key, doc_id) - 1 AS row_id, key, doc_id AS discovery_id, (length(t) // 3)::INTEGER AS token_count, CASE WHEN trim(t) = '' THEN 'empty' END AS error FROM {DOCS}",
    ),
    "chunk_dump": (
        chunk_dump,
        f"SELECT key, count(*) AS chunks, sum(length(t) // 3)::BIGINT AS tokens, count(*) FILTER (length(t) // 3 > {EFFECTIVE_MAX_TOKENS}) AS over FROM {DOCS} GROUP BY 1",
    ),
    "log_lines": (
        log_lines,
        """SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, props AS message, event_type AS module, CASE WHEN event_id % 2 = 0 THEN 'run' END AS function,
        event_id::INTEGER AS line FROM events""",
    ),
    "report_rows": (report_rows, "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1"),
    "streamed_rows": (streamed_rows, "SELECT event_id, user_id, event_type FROM events"),
    "decoded_pages": (
        decoded_pages,
        """SELECT page_id, md5(CASE page_id % 3 WHEN 0 THEN regexp_replace(html, '[^\\x{0000}-\\x{00ff}]', '?', 'g') WHEN 1 THEN '<meta charset="nosuch">' || html ELSE html END) AS html_md5 FROM pages""",
    ),
}
