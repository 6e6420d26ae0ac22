"""Provider health, selection and limits as expressions and windows over event rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Latency bounds in ms, weights, recency bands (seconds, score), labels.
IDEAL_MS, MAX_MS = 3000.0, 25000.0
WEIGHTS = {"success": 0.40, "latency": 0.30, "rate_limit": 0.20, "recency": 0.10}
RECENCY = ((10, 30), (60, 60), (300, 80))
DEGRADED, UNHEALTHY = 60, 30


def health_score(success_rate: Column, avg_ms: Column, limited: Column, total: Column, idle_seconds: Column) -> Column:
    """0 to 100 from success, latency, rate limits and time since the last failure (null: none)."""
    latency = F.when(avg_ms <= IDEAL_MS, 100.0).when(avg_ms >= MAX_MS, 0.0).otherwise(100 * (1 - (avg_ms - IDEAL_MS) / (MAX_MS - IDEAL_MS)))
    limits = F.when(total == 0, 100.0).otherwise(100 * (1 - F.least(5 * limited / total, F.lit(1.0))))
    recency = F.when(idle_seconds.isNull(), 100)
    for seconds, score in RECENCY:
        recency = recency.when(idle_seconds < seconds, score)
    recency = recency.otherwise(100)
    score = WEIGHTS["success"] * 100 * success_rate + WEIGHTS["latency"] * latency + WEIGHTS["rate_limit"] * limits + WEIGHTS["recency"] * recency
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.round(score, 9)).cast("int")))


def health_label(score: Column) -> Column:
    return F.when(score > DEGRADED, "healthy").when(score > UNHEALTHY, "degraded").otherwise("unhealthy")


def combined_score(health: Column, priority: Column, wait_seconds: Column) -> Column:
    return 0.5 * health + 0.3 * priority + 0.2 * F.greatest(F.lit(0.0), 100 - 10 * wait_seconds)


def allocation(weights: DataFrame, total: int) -> DataFrame:
    """provider, share of ``total`` by weight, at least 1; what is left goes to the heaviest, ties by name."""
    sums = weights.agg(F.sum("weight").alias("all"))
    base = weights.join(F.broadcast(sums)).withColumn("n", F.greatest(F.lit(1), F.floor(total * F.col("weight") / F.col("all"))).cast("long"))
    rest = base.agg((F.lit(total) - F.sum("n")).alias("rest"), F.max_by("provider", F.struct("weight", "provider")).alias("best"))
    filled = base.join(F.broadcast(rest))
    return filled.select("provider", (F.col("n") + F.when(F.col("provider") == F.col("best"), F.greatest(F.col("rest"), F.lit(0))).otherwise(0)).alias("n"))


def cumulative_pick(weights: DataFrame, draws: DataFrame) -> DataFrame:
    """Each draw (id, u in [0, 1)) with the provider whose cumulative weight interval holds it."""
    run = Window.orderBy("provider").rowsBetween(Window.unboundedPreceding, 0)
    ends = weights.withColumn("high", F.sum("weight").over(run)).withColumn("low", F.col("high") - F.col("weight"))
    all_weight = weights.agg(F.sum("weight").alias("all"))  # providers are few; the draws are what grows
    spans = ends.join(F.broadcast(all_weight)).select("provider", (F.col("low") / F.col("all")).alias("low"), (F.col("high") / F.col("all")).alias("high"))
    return draws.join(F.broadcast(spans), (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).select("id", "provider")


def cache_hits(lookups: DataFrame, key: str, order: list[str], ttl_seconds: int) -> DataFrame:
    """``lookups`` with hit: the key was looked up within the time to live; a miss refreshes it.

    A lookup within the time to live of the one before is taken as a hit, as where each lookup
    renews the entry.
    """
    before = Window.partitionBy(key).orderBy(*order)
    gap = F.unix_seconds(F.col(order[0]).cast("timestamp")) - F.unix_seconds(F.lag(order[0]).over(before).cast("timestamp"))
    return lookups.withColumn("hit", F.coalesce(gap < ttl_seconds, F.lit(False)))


def replay_bucket(rate: float, burst: float):
    """A state function for applyInPandasWithState or one sorted group: which requests a token bucket lets through."""

    def run(times: list[float], tokens: float = burst, last: float | None = None) -> tuple[list[bool], float, float | None]:
        out = []
        for now in times:
            if last is not None:
                tokens = min(burst, tokens + (now - last) * rate)
            last = now
            out.append(tokens >= 1)
            tokens -= tokens >= 1
        return out, tokens, last

    return run


def bucket_admissions(requests: DataFrame, key: str, rate: float, burst: float) -> DataFrame:
    """requests (key, event_id, seconds) with admitted, by a token bucket of each key.

    The fold is sequential within a key. Rows come sorted by key and time and are folded as a
    stream over Arrow batches, so no key is held whole in memory.
    """
    ordered = requests.select(key, "event_id", "seconds").repartition(key).sortWithinPartitions(key, "seconds", "event_id")
    fold = replay_bucket(rate, burst)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, tokens, last = object(), burst, None
        for batch in batches:
            admitted: list[bool] = []
            for value, group in batch.groupby(key, sort=False):
                if value != current:
                    current, tokens, last = value, burst, None
                done, tokens, last = fold(group["seconds"].tolist(), tokens, last)
                admitted += done
            yield batch[[key, "event_id"]].assign(admitted=admitted)

    return ordered.mapInPandas(run, f"{key} long, event_id long, admitted boolean")


def backoff(attempt: Column, base: float, cap: float) -> Column:
    return F.least(base * F.pow(F.lit(2.0), attempt), F.lit(cap))


def aged_priority(priority: Column, waited_seconds: Column) -> Column:
    """A request gains one level of priority for every 30 seconds of waiting, down to 0."""
    return F.greatest(F.lit(0), priority - F.floor(waited_seconds / 30))
