"""Sequential work on ordered rows of few or hot keys, spread over range partitions.

A window over a key puts all its rows into one task. Here rows are range-partitioned by keys
and order, so that a key may span any number of partitions; each partition works on its own
rows, and what it must know of those before it is one row for each key and partition (counts,
sums, last values), or a halo of a fixed number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.staging import staged


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join on columns of the same names where null equals null."""
    other = right.withColumnsRenamed({name: f"_right_{name}" for name in on})
    same = reduce(lambda a, b: a & b, [left[name].eqNullSafe(other[f"_right_{name}"]) for name in on])
    return left.join(other, same, how).drop(*[f"_right_{name}" for name in on])


@dataclass(frozen=True)
class Ordered:
    """Rows in ``_part`` (rising with keys and order) with ``_at``, their place within part and key from 0."""

    rows: DataFrame
    keys: list[str]
    order: list[str]

    def local(self, *more: str):
        """The window of a row's key within its partition."""
        return Window.partitionBy("_part", *self.keys, *more).orderBy("_at")

    def pieces(self, **values: Column) -> DataFrame:
        """One row for each key and partition: ``_part``, keys, and aggregates."""
        return self.rows.groupBy("_part", *self.keys).agg(*[value.alias(name) for name, value in values.items()])

    def earlier(self):
        """The window of a key's pieces before its own: as many rows as partitions hold the key."""
        window = Window.partitionBy(*self.keys) if self.keys else Window.partitionBy(F.lit(0))
        return window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)

    def running(self, name: str, value: Column, how: str = "sum") -> DataFrame:
        """Rows with the ``sum``, ``max`` or ``last`` known value of their key so far, their own included; nulls are passed over."""
        so_far = self.local().rowsBetween(Window.unboundedPreceding, 0)
        known = F.when(value.isNotNull(), F.col("_at"))
        of_piece, of_row, before, both = {
            "sum": (F.sum(value), F.sum(value).over(so_far), F.sum("_v").over(self.earlier()), lambda a, b: F.when(a.isNull(), b).otherwise(a + F.coalesce(b, F.lit(0)))),
            "max": (F.max(value), F.max(value).over(so_far), F.max("_v").over(self.earlier()), F.greatest),
            "last": (F.max_by(value, known), F.last(value, ignorenulls=True).over(so_far), F.last("_v", ignorenulls=True).over(self.earlier()), F.coalesce),
        }[how]
        carried = self.pieces(_v=of_piece).withColumn("_carried", before).drop("_v").where("_carried IS NOT NULL")
        rows = self.rows.withColumn("_own", of_row)
        return join_null_safe(rows, carried, ["_part", *self.keys]).withColumn(name, both(F.col("_own"), F.col("_carried"))).drop("_own", "_carried")

    def placed(self) -> DataFrame:
        """Rows with ``_place``, their place in their key from 0, and ``_base``, that of their partition's first."""
        bases = self.pieces(_rows=F.count("*")).withColumn("_base", F.coalesce(F.sum("_rows").over(self.earlier()), F.lit(0))).drop("_rows")
        return join_null_safe(self.rows, bases, ["_part", *self.keys], "inner").withColumn("_place", F.col("_base") + F.col("_at"))

    def recent(self, name: str, aggregate: Column, rows: int) -> DataFrame:
        """Rows with an aggregate over the last ``rows`` of their key, their own included.

        Each partition is lent the ``rows - 1`` rows before its first of a key, which may lie in
        several partitions: they are found by their places.
        """
        placed = staged(self.placed(), "placed")
        pieces = placed.groupBy("_part", *self.keys).agg(F.first("_base").alias("_base"), F.count("*").alias("_rows"))
        wanted = pieces.where(F.col("_base") > 0).select(
            F.col("_part").alias("_to"), *self.keys, F.explode(F.sequence(F.greatest(F.col("_base") - (rows - 1), F.lit(0)), F.col("_base") - 1)).alias("_place")
        )
        ends = join_null_safe(placed, pieces.drop("_base"), ["_part", *self.keys], "inner").where(F.col("_at") > F.col("_rows") - rows).drop("_rows")
        lent = join_null_safe(ends, wanted, [*self.keys, "_place"], "inner").withColumn("_part", F.col("_to")).drop("_to")
        window = Window.partitionBy("_part", *self.keys).orderBy("_place").rowsBetween(1 - rows, 0)
        both = placed.withColumn("_lent", F.lit(False)).unionByName(lent.withColumn("_lent", F.lit(True)))
        return both.withColumn(name, aggregate.over(window)).where(~F.col("_lent")).drop("_lent", "_base")


def in_order(df: DataFrame, keys: list[str], order: list[str]) -> Ordered:
    """``df`` range-partitioned by keys and order; ``order`` should tell rows apart, so that no value is a hot one."""
    ranged = staged(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    within = Window.partitionBy("_part", *keys).orderBy(*order)
    return Ordered(ranged.withColumn("_at", (F.row_number().over(within) - 1).cast("long")), keys, order)


def moving_average(events: DataFrame, keys: list[str], value: str, order: list[str], rows: int) -> DataFrame:
    """``events`` with avg_recent: the mean over the last ``rows`` of a key. A key may hold any share of the rows."""
    return in_order(events, keys, order).recent("avg_recent", F.avg(value), rows).select(*events.columns, "avg_recent")


def since_last(events: DataFrame, keys: list[str], happened: Column, order: list[str], name: str) -> DataFrame:
    """``events`` with the time (first of ``order``) of the key's latest row so far for which ``happened``; null before one."""
    found = in_order(events, keys, order).running(name, F.when(happened, F.col(order[0])), "max")
    return found.select(*events.columns, name)


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """``left`` (key, id, time) with the value of the key's latest ``right`` row at or before it.

    One union in order of time, right rows first at equal times; the latest value runs through it.
    """
    kind = dict(right.dtypes)[value]
    asks = left.select(key, "id", time, F.lit(None).cast(kind).alias(value), F.lit(1).alias("_side"))
    offers = right.select(key, F.lit(None).cast(dict(left.dtypes)["id"]).alias("id"), time, value, F.lit(0).alias("_side"))
    both = in_order(asks.unionByName(offers).withColumnRenamed(value, "_value"), [key], [time, "_side", "id"])
    return both.running(value, F.col("_value"), "last").where("_side = 1").select(key, "id", time, value)


def take_latest_unused(asks: DataFrame, offers: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """Each ask (keys, id, time), in order of time, with the latest offer at or before it that no earlier ask took.

    Returns keys, id, time, offer_id, offer_time; nulls where no offer is left. At equal times
    offers come before asks, and larger ids of offers and smaller ones of asks are served first.

    This is matching of brackets: an offer opens one, an ask closes the latest. With the count
    of open brackets as the level, an ask closes the offer before it on its level, where offers
    and asks take turns. Within a partition that is the row before; what a partition can't
    match, at most one ask and one offer on each level, is matched among the partitions that
    have that level. Asks that find nothing open new levels below.
    """
    none = F.lit(None).cast("long")
    both = asks.select(*keys, time, F.col("id").cast("long").alias("id"), F.lit(1).alias("_side")).unionByName(
        offers.select(*keys, time, F.col("id").cast("long").alias("id"), F.lit(0).alias("_side"))
    )
    opened = in_order(both, keys, [time, "_side", "id"]).running("_open", F.when(F.col("_side") == 0, 1).otherwise(-1))
    level = F.when(F.col("_side") == 0, F.col("_open") - 1).otherwise(F.col("_open"))
    on_level = Window.partitionBy("_part", *keys, "_level").orderBy("_at")
    offer = F.struct(F.col("id").alias("offer_id"), F.col(time).alias("offer_time"))
    local = opened.withColumn("_level", level).withColumn("_first", F.lag("_side").over(on_level).isNull()).withColumn("_last", F.lead("_side").over(on_level).isNull())
    local = staged(local.withColumn("_before", F.lag(offer).over(on_level)), "levels")
    ask = F.col("_side") == 1
    matched = local.where(ask & ~F.col("_first")).select(*keys, "id", time, "_before.offer_id", "_before.offer_time")
    left_open = local.where((ask & F.col("_first")) | (~ask & F.col("_last")))
    across = Window.partitionBy(*keys, "_level").orderBy("_part", "_at")
    found = left_open.withColumn("_met", F.lag(F.when(~ask, offer)).over(across)).where(ask)
    return matched.unionByName(found.select(*keys, "id", time, F.coalesce(F.col("_met.offer_id"), none).alias("offer_id"), F.col("_met.offer_time").alias("offer_time")))
