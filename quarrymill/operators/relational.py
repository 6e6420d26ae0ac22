"""Work queues, history and upserts as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.staging import with_position


def open_work(work: DataFrame, done: DataFrame, key: str, statuses: list[str]) -> DataFrame:
    """Rows of ``work`` (key, status, url) with a wanted status and a url that ``done`` lacks, in no order."""
    wanted = work.where(F.col("status").isin(statuses) & F.col("url").isNotNull() & (F.col("url") != ""))
    return wanted.join(done.select(key), key, "left_anti")


def pending_work(work: DataFrame, done: DataFrame, key: str, statuses: list[str], after: int | None, limit: int | None) -> DataFrame:
    """Rows of ``work`` (id, key, status, url) with a wanted status and a url that ``done`` lacks.

    Keyset page: ids above ``after`` in order, ``limit`` of them; without either, from the first or to the last.
    """
    left = work if after is None else work.where(F.col("id") > after)
    open_rows = open_work(left, done, key, statuses).orderBy("id")
    return open_rows if limit is None else open_rows.limit(limit)


def pending_count(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """total, scraped, pending (never negative) and pending_by_key, which counts keys not done."""
    total = work.agg(F.count("*").alias("total"))
    scraped = done.agg(F.countDistinct(key).alias("scraped"))
    left = work.join(done.select(key), key, "left_anti").agg(F.count("*").alias("pending_by_key"))
    one = total.join(scraped).join(left)  # three rows of one row each
    return one.withColumn("pending", F.greatest(F.lit(0), F.col("total") - F.col("scraped")))


def latest_per_key(rows: DataFrame, key: str, order: list[Column], salts: int = 64) -> DataFrame:
    """The first row of each key in ``order``.

    A key's rows are dealt by a salt first, so that of a hot key no task sorts more than its
    share; the winners, at most ``salts`` of a key, meet in the end.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    for keys in ([key, "_salt"], [key]):
        newest = Window.partitionBy(*keys).orderBy(*order)
        salted = salted.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
    return salted.drop("_salt")


def latest_value(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """As ``latest_per_key`` for the largest ``by``, with map-side combining, so hot keys cost no more."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_row"))
    return best.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def upsert(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """``base`` with rows of ``updates`` in place of those of the same key, and new keys added."""
    return base.join(updates.select(key), key, "left_anti").unionByName(updates)


def refresh_children(old: DataFrame, new: DataFrame, parent: str, value: str) -> DataFrame:
    """Child rows after a refresh: a parent with new, non-blank children loses its old ones.

    Values are stripped and blank ones dropped; a parent whose new list is empty keeps its old
    children.
    """
    fresh = new.withColumn(value, F.trim(value)).where(F.col(value) != "")
    return old.join(fresh.select(parent).distinct(), parent, "left_anti").unionByName(fresh)


def round_robin(rows: DataFrame, order: list[str], parts: int) -> DataFrame:
    """``rows`` with ``part``: place in the order modulo the number of parts."""
    return with_position(rows, [], order, "_at").withColumn("part", (F.col("_at") % parts).cast("int")).drop("_at")


def prefix_lookup(rows: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose column is ``key`` or starts with it; the key is never a pattern."""
    return rows.where((F.col(column) == key) | F.startswith(column, F.lit(key)))


def url_sample(rows: DataFrame, statuses: list[str], limit: int) -> DataFrame:
    """Distinct urls of the first rows by id with a wanted status, with a scheme where it lacks."""
    some = rows.where(F.col("status").isin(statuses) & F.col("url").isNotNull() & (F.col("url") != "")).orderBy("id").limit(limit)
    return some.select(F.when(F.col("url").rlike("^https?://"), F.col("url")).otherwise(F.concat(F.lit("https://"), "url")).alias("url")).distinct()


def result_rows(results: DataFrame) -> DataFrame:
    """One row per chunk of each result (key, chunks array<string>, error), or one row without chunk.

    A failed result gives chunk_index 0, total_chunks 0, a null chunk and its error.
    """
    shaped = results.select("key", "error", F.size("chunks").alias("n"), F.posexplode_outer("chunks").alias("at", "chunk"))
    return shaped.select(
        "key",
        F.coalesce(F.col("at") + 1, F.lit(0)).alias("chunk_index"),
        F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)).alias("total_chunks"),
        "chunk",
        F.when(F.col("at").isNull(), F.col("error")).alias("error"),
    )
