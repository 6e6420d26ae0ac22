"""Tables written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="quarrymill-")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in a local session without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts lineage so that lost executors cost no recomputation, and gives the optimizer real
    sizes: a join with a staged table broadcasts it only if the files are small enough.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_tasks(spark: SparkSession) -> int:
    """Several tasks for each core."""
    return max(64, 4 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to several tasks for each core.

    A small file is one task's, whatever its rows cost further on. Rows should still be narrow
    here. The number is given, since adaptive execution would put small partitions together again.
    """
    return df.repartition(spread_tasks(df.sparkSession))


def tasks_for(rows: DataFrame, each: int = 500_000) -> int:
    """Partitions for ``rows`` of a stored table (counted from its footers), about ``each`` in one.

    Adaptive execution sizes tasks by shuffled bytes. Where narrow rows become wide ones in the
    same task, such as keys joined with texts and sorted, that makes tasks of very many rows. A
    given number of partitions is left as it is, and a join on their key needs no other shuffle.
    """
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))


def in_buckets(df: DataFrame, name: str, key: str, buckets: int, then: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """``df`` written once as a table in ``buckets`` parts by the key's hash, in the shared folder.

    Tables with equal buckets of a key join on it without a shuffle on either side, and groups that
    hold the key need none. ``then`` is done to the rows of a bucket before they are written; it may
    not move rows, such as windows over the key.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_folder(spark)}/{table}"
    # Rows of a bucket meet before they are written, so that each bucket is one file.
    then(df.repartition(buckets, key)).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def with_position(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "position") -> DataFrame:
    """``df`` with each row's place (from 0) within its keys in the given order.

    A window over the keys would put each group, or the whole table, into one task. Here rows
    are range-partitioned by keys and order, so that a group may span partitions; each row's
    place is its place in its partition plus the group's rows in earlier partitions.
    """
    ranged = staged(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part", *keys).agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", *keys, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_base"))
    bases = bases.withColumnsRenamed({key: f"_{key}" for key in ["_part", *keys]})
    same = [ranged[key].eqNullSafe(bases[f"_{key}"]) for key in ["_part", *keys]]
    within = Window.partitionBy("_part", *keys).orderBy(*order)
    placed = ranged.withColumn("_place", F.row_number().over(within) - 1).join(bases, same)
    return placed.withColumn(name, (F.col("_base") + F.col("_place")).cast("long")).select(*df.columns, name)
