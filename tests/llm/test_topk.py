import math
import random

import numpy as np
import pytest

from quarrymill.llm.topk import Lists, top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, asked, k):
    usable = lambda v: v and all(x is not None and math.isfinite(x) for x in v)
    ints = lambda v: [math.floor(256 * float(np.float32(x))) for x in v]
    out = set()
    vectors = {(i, tuple(ints(v))) for i, v, _ in rows if i is not None and usable(v)}
    for q, v in {(i, tuple(ints(v))) for i, v, _ in asked if i is not None and usable(v)}:
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q and len(w) == len(v))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])}
    return out


def check(spark, rows, asked, k=5):
    queries = spark.createDataFrame([(i, v) for i, v, _ in asked], "query_id long, embedding array<float>")
    got = [tuple(r) for r in top_k(spark.createDataFrame(rows, SCHEMA), queries, k).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, asked, k)


@pytest.mark.parametrize("values", [lambda r: r.gauss(0, 0.2), lambda r: r.choice([0.0, 0.25, -0.25])])
def test_against_brute_force(spark, values):
    rng = random.Random(4)
    rows = [(i, [values(rng) for _ in range(8)], 0) for i in range(700)]
    check(spark, rows, rows[::50])


@pytest.mark.parametrize("shard", [1, 8])
def test_many_blocks_and_equal_vectors(spark, monkeypatch, shard):
    monkeypatch.setattr("quarrymill.llm.topk.VECTOR_ROWS", 40)
    monkeypatch.setattr("quarrymill.llm.topk.QUERY_ROWS", 3)
    monkeypatch.setattr("quarrymill.llm.topk.SHARD_BLOCKS", shard)
    rng = random.Random(5)
    rows = [(i, [0.5, 0.25] if i % 3 == 0 else [rng.gauss(0, 1), rng.gauss(0, 1)], 0) for i in range(300)]
    check(spark, rows, rows[::20])


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, None, 0), (3, [None, 1.0], 0), (4, [float("nan"), 1.0], 0), (5, [float("inf"), 0.0], 0)]
    rows += [(6, [0.0, 0.0], 0), (7, [1.0], 0), (8, [], 0), (None, [1.0, 1.0], 0), (9, [-0.001, 3.0], 0), (10, [1.0], 0)]
    check(spark, rows, rows)
    check(spark, rows[:1], rows[:1])
    check(spark, [], [])


def test_stops_early_with_right_result(monkeypatch):
    rng = np.random.default_rng(0)
    vectors = rng.integers(-5, 6, (5000, 3))
    vectors[17] = 900
    lists = Lists.of(np.arange(5000), vectors)
    ids, scores = lists.top(-1, np.array([1, 2, 3]), 1)
    assert ids.tolist() == [17] and scores.tolist() == [5400]
    scored, plain = [], Lists.scores
    monkeypatch.setattr(Lists, "scores", lambda self, rows, query: scored.append(len(rows)) or plain(self, rows, query))
    lists.top(-1, np.array([1, 2, 3]), 1)
    assert sum(scored) < 500
    later = Lists.of(np.arange(5000, 9000), rng.integers(-5, 6, (4000, 3)))
    scored.clear()
    assert later.top(-1, np.array([1, 2, 3]), 1, (ids, scores)) == (ids, scores) and not scored  # the bound came from the block before


def test_large_components_are_exact_or_an_error(spark):
    schema = "vec_id long, embedding array<double>"
    big = 2.0**54  # times 256 it passes no long integer, but sums of products do unless they cancel
    rows = [(1, [big, 1.0]), (2, [2.0**-8, 3.0]), (3, [-(2.0**-8), -5.0]), (4, [0.0, 2.0**40])]
    table = spark.createDataFrame(rows, schema)
    asked = table.where("vec_id = 1").withColumnRenamed("vec_id", "query_id")
    got = [(r["rank"], r.vec_id, r.score) for r in top_k(table, asked, 5).orderBy("rank").collect()]
    ints = {n: [int(256 * x // 1) for x in v] for n, v in rows}
    score = lambda n: sum(a * b for a, b in zip(ints[1], ints[n]))
    want = sorted([(-score(n), n) for n in (2, 3, 4)])
    assert got == [(rank + 1, n, -s) for rank, (s, n) in enumerate(want)]
    for vectors in ([[1e17, 1.0], [1e17, 2.0]], [[2.0**54, 1.0], [2.0**54, 2.0]]):
        wrong = spark.createDataFrame(list(enumerate(vectors)), schema)
        with pytest.raises(Exception, match="long integer"):
            top_k(wrong, wrong.withColumnRenamed("vec_id", "query_id"), 1).collect()
