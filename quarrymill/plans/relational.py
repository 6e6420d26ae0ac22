"""Registered relational queries (S01-S04, S08, P01-P04, JN1-JN3, A01-A03, W01, W10, D01-D04, O01-O03)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators import relational as rel
from quarrymill.session import table
from quarrymill.staging import in_buckets

STATUSES = ["BUILDING", "MACHINERY", "AUTOMOBILE"]
AFTER, LIMIT, PARTS = 100, 500, 5


def discovery(spark: SparkSession, directory: str) -> DataFrame:
    """customer as discovery rows."""
    return table(spark, directory, "customer").select(
        F.col("c_custkey").alias("id"),
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("key"),
        F.col("c_mktsegment").alias("status"),
        F.col("c_name").alias("url"),
    )


def scraped(spark: SparkSession, directory: str) -> DataFrame:
    """Pending urgent orders as scraped rows."""
    urgent = table(spark, directory, "orders").where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")
    return urgent.select(F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("key"))


D = "(SELECT c_custkey AS id, lpad(c_custkey::VARCHAR, 8, '0') AS key, c_mktsegment AS status, c_name AS url FROM customer)"
S = "(SELECT lpad(o_custkey::VARCHAR, 8, '0') AS key FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')"
IN = "status IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') AND url IS NOT NULL AND url <> ''"


def pending_work(spark: SparkSession, directory: str) -> DataFrame:
    found = rel.pending_work(discovery(spark, directory), scraped(spark, directory), "key", STATUSES, AFTER, LIMIT)
    return found.select("id", "key", "status")


def all_pending_work(spark: SparkSession, directory: str) -> DataFrame:
    return rel.pending_work(discovery(spark, directory), scraped(spark, directory), "key", STATUSES, None, None).select("id", "key")


def pending_in_buckets(spark: SparkSession, directory: str) -> DataFrame:
    """As all_pending_work, from work and done keys that are stored in equal buckets: asked again and again, it shuffles neither."""
    work, done = in_buckets(discovery(spark, directory), "work", "key", 16), in_buckets(scraped(spark, directory), "done", "key", 16)
    return rel.open_work(work, done, "key", STATUSES).select("id", "key")


def pending_count(spark: SparkSession, directory: str) -> DataFrame:
    return rel.pending_count(discovery(spark, directory), scraped(spark, directory), "key")


def _orders(spark: SparkSession, directory: str, where: str = "true") -> DataFrame:
    return table(spark, directory, "orders").where(where).select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")


def latest_per_key(spark: SparkSession, directory: str) -> DataFrame:
    order = [F.col("o_orderdate").desc_nulls_first(), F.col("o_orderkey").desc()]
    return rel.latest_per_key(_orders(spark, directory), "o_custkey", order).drop("o_orderdate")


def latest_value(spark: SparkSession, directory: str) -> DataFrame:
    return rel.latest_value(_orders(spark, directory), "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


def upsert_merge(spark: SparkSession, directory: str) -> DataFrame:
    base = rel.latest_value(_orders(spark, directory, "o_orderstatus = 'F'"), "o_custkey", ["o_orderdate", "o_orderkey"])
    updates = rel.latest_value(_orders(spark, directory, "o_orderstatus = 'O'"), "o_custkey", ["o_orderdate", "o_orderkey"])
    return rel.upsert(base, updates, "o_custkey").drop("o_orderdate")


def refresh_children(spark: SparkSession, directory: str) -> DataFrame:
    lines = table(spark, directory, "lineitem").join(table(spark, directory, "part"), F.col("l_partkey") == F.col("p_partkey"))
    old = lines.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("company_id"), F.col("p_brand").alias("name"))
    new = lines.where("l_linenumber = 3 AND l_quantity > 25")
    new = new.select(F.col("l_orderkey").alias("company_id"), F.concat(F.lit("  "), "p_type", F.lit(" ")).alias("name"))
    return rel.refresh_children(old, new, "company_id", "name")


def partition_round_robin(spark: SparkSession, directory: str) -> DataFrame:
    return rel.round_robin(discovery(spark, directory).select("id"), ["id"], PARTS)


def prefix_lookup(spark: SparkSession, directory: str) -> DataFrame:
    return rel.prefix_lookup(discovery(spark, directory), "key", "0000001").select("id", "key")


def point_lookup(spark: SparkSession, directory: str) -> DataFrame:
    return discovery(spark, directory).where(F.col("key") == "00000042")


def ordered_chunks(spark: SparkSession, directory: str) -> DataFrame:
    lines = table(spark, directory, "lineitem").where("l_orderkey = 7")
    return lines.select(F.col("l_linenumber").alias("chunk_index"), "l_partkey", "l_quantity").orderBy("chunk_index")


def url_sample(spark: SparkSession, directory: str) -> DataFrame:
    return rel.url_sample(discovery(spark, directory), STATUSES, 200)


def result_rows(spark: SparkSession, directory: str) -> DataFrame:
    orders = table(spark, directory, "orders").select("o_orderkey", "o_orderpriority")
    words = F.when(F.col("o_orderpriority") != "1-URGENT", F.split("o_orderpriority", "-"))
    shaped = orders.select(F.col("o_orderkey").alias("key"), words.alias("chunks"), F.concat(F.lit("failed:"), "o_orderpriority").alias("error"))
    return rel.result_rows(shaped)


def discovery_id_lookup(spark: SparkSession, directory: str) -> DataFrame:
    """Left join of results with discovery rows; results of unknown keys keep a null id."""
    done = scraped(spark, directory).groupBy("key").agg(F.count("*").alias("n"))
    found = discovery(spark, directory).where("status = 'BUILDING'").select("key", F.col("id").alias("discovery_id"))
    return done.join(found, "key", "left")


def request_latest_search(spark: SparkSession, directory: str) -> DataFrame:
    """Each request with its key's latest search row, if any."""
    latest = latest_value(spark, directory)
    asked = table(spark, directory, "customer").select("c_custkey", "c_name")
    return asked.join(latest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


LATEST = """SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM (SELECT *, row_number() OVER (
  PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE {0}) WHERE n = 1"""

QUERIES = {
    "pending_work": (
        pending_work,
        f"SELECT id, key, status FROM {D} d WHERE {IN} AND id > {AFTER} AND NOT EXISTS (SELECT 1 FROM {S} s WHERE s.key = d.key) ORDER BY id LIMIT {LIMIT}",
    ),
    "all_pending_work": (all_pending_work, f"SELECT id, key FROM {D} d WHERE {IN} AND key NOT IN (SELECT key FROM {S})"),
    "pending_in_buckets": (pending_in_buckets, f"SELECT id, key FROM {D} d WHERE {IN} AND key NOT IN (SELECT key FROM {S})"),
    "pending_count": (
        pending_count,
        f"""SELECT total, scraped, greatest(0, total - scraped) AS pending, pending_by_key FROM (SELECT count(*) AS total FROM {D}),
        (SELECT count(DISTINCT key) AS scraped FROM {S}), (SELECT count(*) AS pending_by_key FROM {D} WHERE key NOT IN (SELECT key FROM {S}))""",
    ),
    "latest_per_key": (latest_per_key, LATEST.format("true")),
    "latest_value": (latest_value, LATEST.format("true")),
    "upsert_merge": (
        upsert_merge,
        f"""WITH b AS ({LATEST.format("o_orderstatus = 'F'")}), u AS ({LATEST.format("o_orderstatus = 'O'")})
        SELECT * FROM u UNION ALL SELECT * FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM u)""",
    ),
    "refresh_children": (
        refresh_children,
        """WITH l AS (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey),
        n AS (SELECT l_orderkey AS company_id, trim(p_type) AS name FROM l WHERE l_linenumber = 3 AND l_quantity > 25 AND trim(p_type) <> '')
        SELECT * FROM n UNION ALL SELECT l_orderkey, p_brand FROM l WHERE l_linenumber <= 2 AND l_orderkey NOT IN (SELECT company_id FROM n)""",
    ),
    "partition_round_robin": (
        partition_round_robin,
        f"SELECT c_custkey AS id, CAST((row_number() OVER (ORDER BY c_custkey) - 1) % {PARTS} AS INTEGER) AS part FROM customer",
    ),
    "prefix_lookup": (prefix_lookup, f"SELECT id, key FROM {D} WHERE key = '0000001' OR prefix(key, '0000001')"),
    "point_lookup": (point_lookup, f"SELECT * FROM {D} WHERE key = '00000042'"),
    "ordered_chunks": (ordered_chunks, "SELECT l_linenumber AS chunk_index, l_partkey, l_quantity FROM lineitem WHERE l_orderkey = 7"),
    "url_sample": (url_sample, f"SELECT DISTINCT 'https://' || url AS url FROM (SELECT url FROM {D} WHERE {IN} ORDER BY id LIMIT 200)"),
    "result_rows": (
        result_rows,
        """SELECT o_orderkey AS key, CAST(i AS INTEGER) AS chunk_index, CAST(2 AS INTEGER) AS total_chunks, string_split(o_orderpriority, '-')[i] AS chunk, NULL AS error
        FROM orders, (SELECT unnest([1, 2]) AS i) WHERE o_orderpriority <> '1-URGENT' AND len(string_split(o_orderpriority, '-')) = 2
        UNION ALL SELECT o_orderkey, 1, 1, o_orderpriority, NULL FROM orders WHERE NOT contains(o_orderpriority, '-')
        UNION ALL SELECT o_orderkey, i, 3, string_split(o_orderpriority, '-')[i], NULL FROM orders, (SELECT unnest([1, 2, 3]) AS i) WHERE len(string_split(o_orderpriority, '-')) = 3
        UNION ALL SELECT o_orderkey, 0, 0, NULL, 'failed:' || o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'""",
    ),
    "discovery_id_lookup": (
        discovery_id_lookup,
        f"SELECT s.key, s.n, d.id AS discovery_id FROM (SELECT key, count(*) AS n FROM {S} GROUP BY key) s LEFT JOIN (SELECT * FROM {D} WHERE status = 'BUILDING') d USING (key)",
    ),
    "request_latest_search": (
        request_latest_search,
        f"SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN ({LATEST.format('true')}) ON c_custkey = o_custkey",
    ),
}
