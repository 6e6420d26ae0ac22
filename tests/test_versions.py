"""Versioned tables and lasting ids."""

import random

import pytest
from pyspark.sql import functions as F

from quarrymill.sources.versions import ConflictError, Files, VersionedTable, append_with_ids, read_with_ids


@pytest.fixture
def kept(spark, tmp_path):
    rows = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    table = VersionedTable(spark, str(tmp_path / "t"), "k", rows.schema, buckets=64)
    assert table.read().count() == 0
    table.upsert(rows)
    return table


def rows_of(table, version=None):
    return {r.k: r.v for r in table.read(version).collect()}


def test_an_update_writes_only_the_buckets_that_it_touches(spark, kept):
    assert rows_of(kept) == {n: 2 * n for n in range(20_000)}
    assert len(kept.folders()) == 64
    updates = spark.createDataFrame([(n, -n) for n in (*range(0, 20_000, 1000), 30_000)], "k long, v long")  # a thousandth
    assert kept.upsert(updates) == 1
    assert rows_of(kept) == {n: 2 * n for n in range(20_000)} | {n: -n for n in (*range(0, 20_000, 1000), 30_000)}
    changed = [b for b in kept.folders(1) if kept.folders(0)[b] != kept.folders(1)[b]]
    assert 1 <= len(changed) <= 21
    assert rows_of(kept, 0) == {n: 2 * n for n in range(20_000)}


def test_of_two_writers_one_fails_and_leaves_nothing(spark, kept):
    one, other = (spark.createDataFrame([(1, v)], "k long, v long") for v in (100, 200))
    before = kept.read()
    assert kept.upsert(one, base=0) == 1
    with pytest.raises(ConflictError):
        kept.upsert(other, base=0)
    assert rows_of(kept)[1] == 100 and {r.k: r.v for r in before.where("k = 1").collect()} == {1: 2}
    assert len(Files(spark, f"{kept.path}/data").names()) == 2, "the loser's files are gone"
    assert not [n for n in Files(spark, f"{kept.path}/versions").names() if n.startswith("draft")]
    assert kept.upsert(other) == 2 and rows_of(kept)[1] == 200


def test_children_and_emptied_buckets(spark, tmp_path):
    schema = spark.createDataFrame([], "parent string, child string").schema
    table = VersionedTable(spark, str(tmp_path / "c"), "parent", schema, buckets=4)
    table.refresh(spark.createDataFrame([("a", "x"), ("a", "y "), ("b", "z"), ("c", " "), (None, "w")], schema), "child")
    table.refresh(spark.createDataFrame([("a", "  "), ("b", "n"), ("b", "m")], schema), "child")
    assert sorted((tuple(r) for r in table.read().collect()), key=str) == sorted([("a", "x"), ("a", "y"), ("b", "m"), ("b", "n"), (None, "w")], key=str)
    assert table.upsert(spark.createDataFrame([], schema)) == 2 and table.read().count() == 5


def test_ids_stay_and_none_is_given_twice(spark, tmp_path):
    path, rng = str(tmp_path / "ids"), random.Random(1)
    rows = lambda low, high: spark.range(low, high).select("id", F.lit("r").alias("row_part")).repartition(rng.randrange(1, 6))
    assert append_with_ids(rows(0, 100), path) == (0, 99)
    schema = rows(0, 1).schema
    first = {r.id: r.row_id for r in read_with_ids(spark, path, schema).collect()}
    with pytest.raises(Exception):  # fails while it is written, after its range was taken or before
        append_with_ids(rows(0, 10).withColumn("id", F.raise_error(F.lit("broken")).cast("long")), path)
    assert append_with_ids(rows(0, 0), path)[1] >= 99
    append_with_ids(rows(100, 250), path)
    again = {r.id: r.row_id for r in read_with_ids(spark, path, schema).collect()}
    assert {k: again[k] for k in first} == first and sorted(first.values()) == list(range(100))
    assert len(set(again.values())) == 250 and min(again[k] for k in range(100, 250)) >= 100
