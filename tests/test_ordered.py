"""Ordered work over range partitions against plain folds, with keys that span many partitions."""

import random

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import ordered


@pytest.fixture(autouse=True)
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def by_fold(asks, offers):
    """Asks in order of time, each with the last offer still open: one stack for each key."""
    rows = sorted([(k is not None, k or 0, t, 1, i) for k, i, t in asks] + [(k is not None, k or 0, t, 0, i) for k, i, t in offers])
    out, stacks = [], {}
    for known, k, t, side, i in rows:
        stack = stacks.setdefault((known, k), [])
        if side == 0:
            stack.append((i, t))
        else:
            out.append((k if known else None, i, t, *(stack.pop() if stack else (None, None))))
    return out


@pytest.mark.parametrize("seed, times, share", [(1, 50, 0.5), (2, 10_000, 0.5), (3, 300, 0.8), (4, 300, 0.2), (5, 1, 0.5)])
def test_latest_unused_equals_the_fold(spark, seed, times, share):
    rng = random.Random(seed)
    keys = [None, 1, 2, *[7] * 9]
    asks, offers = [], []
    for n in range(1500):
        (offers if rng.random() < share else asks).append((rng.choice(keys), n, rng.randrange(times)))
    schema = "key long, id long, time long"
    got = ordered.take_latest_unused(spark.createDataFrame(asks, schema), spark.createDataFrame(offers, schema), ["key"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(by_fold(asks, offers), key=str)


def test_offers_then_asks_and_empty_sides(spark):
    schema = "id long, time long"
    rows = lambda low, high: spark.createDataFrame([(n, n) for n in range(low, high)], schema)
    got = {r.id: r.offer_id for r in ordered.take_latest_unused(rows(1000, 2500), rows(0, 1000), []).collect()}
    assert got == {n: (1999 - n if n < 2000 else None) for n in range(1000, 2500)}
    assert ordered.take_latest_unused(rows(0, 0), rows(0, 5), []).count() == 0
    assert [r.offer_id for r in ordered.take_latest_unused(rows(0, 3), rows(0, 0), []).collect()] == [None] * 3


def test_a_million_rows_in_no_single_task(spark):
    rows = spark.range(1_000_000).select("id", F.col("id").alias("time"), (F.xxhash64("id") % 2 == 0).alias("asks"))
    got = ordered.take_latest_unused(rows.where("asks").select("id", "time"), rows.where("NOT asks").select("id", "time"), [])
    one = got.agg(F.count("*"), F.count("offer_id"), F.countDistinct("offer_id"), F.count_if(F.col("offer_time") > F.col("time"))).first()
    asks = [r.asks for r in rows.orderBy("id").collect()]
    open_offers = matched = 0
    for ask in asks:
        matched += ask and open_offers > 0
        open_offers = max(0, open_offers - 1) if ask else open_offers + 1
    assert tuple(one) == (sum(asks), matched, matched, 0)


@pytest.mark.parametrize("rows", [1, 2, 7, 50])
def test_moving_average_over_few_keys(spark, rows):
    rng = random.Random(rows)
    data = [(rng.choice([None, 1, 1, 1, 1, 2]), n, float(rng.randrange(100))) for n in range(700)]
    got = {r.id: r.avg_recent for r in ordered.moving_average(spark.createDataFrame(data, "key long, id long, value double"), ["key"], "value", ["id"], rows).collect()}
    for n, (key, _, _) in enumerate(data):
        recent = [v for k, i, v in data if k == key and i <= n][-rows:]
        assert got[n] == pytest.approx(sum(recent) / len(recent))


def test_running_values(spark):
    rng = random.Random(9)
    data = [(rng.choice([1, 1, 1, 2, None]), n, rng.choice([None, None, rng.randrange(50)])) for n in range(600)]
    table = spark.createDataFrame(data, "key long, id long, v long")
    for how, fold in {"sum": sum, "max": max, "last": lambda vs: vs[-1]}.items():
        got = {r.id: r.x for r in ordered.in_order(table, ["key"], ["id"]).running("x", F.col("v"), how).collect()}
        for n, (key, _, _) in enumerate(data):
            seen = [v for k, i, v in data if k == key and i <= n and v is not None]
            assert got[n] == (fold(seen) if seen else None), how


def test_as_of_with_ties_and_nulls(spark):
    left = spark.createDataFrame([(1, n, n // 3) for n in range(300)] + [(2, 999, 5)], "k long, id long, t long")
    right = spark.createDataFrame([(1, n, n * 10) for n in range(10, 90, 7)], "k long, t long, v long")
    got = {r.id: r.v for r in ordered.as_of(left, right, "k", "t", "v").collect()}
    assert got == {n: max((t * 10 for t in range(10, 90, 7) if t <= n // 3), default=None) for n in range(300)} | {999: None}
