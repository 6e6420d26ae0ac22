"""Operational telemetry: diagnosis, funnels, exact rank percentiles, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions import outcomes
from quarrymill.staging import with_position


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole, rounded; 0 without a whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(100 * part / whole, digits))


def failure_diagnosis(attempts: DataFrame) -> DataFrame:
    """Failures by kind and bucket (bucket null: all of a kind): n, pct_of_failures, pct_of_total.

    ``attempts`` has ``reason``, null for a success. Both levels come from one rollup; the two
    totals are a single row.
    """
    totals = attempts.agg(F.count("*").alias("processed"), F.count("reason").alias("failures"))
    failed = attempts.where(F.col("reason").isNotNull()).select(outcomes.reason_bucket(F.col("reason")).alias("bucket"))
    counted = failed.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("kind", outcomes.bucket_kind(F.col("bucket")))
    levels = counted.rollup("kind", "bucket").agg(F.sum("n").alias("n")).where(F.col("kind").isNotNull())
    return levels.join(F.broadcast(totals)).select(
        "kind", "bucket", "n", share(F.col("n"), F.col("failures")).alias("pct_of_failures"), share(F.col("n"), F.col("processed")).alias("pct_of_total")
    )


def rank_percentiles(values: DataFrame, keys: list[str], value: str, percents: list[int], rule: str = "floor", digits: int | None = 1) -> DataFrame:
    """Exact percentiles by rank, one column p<percent> each; groups may be larger than a task.

    ``floor``: the element at min(floor(n * p / 100), n - 1) of the sorted values. ``half``: p50
    is the element at n // 2. ``median``: p50 is the median, the mean of both middle elements.
    Nulls take no part.
    """
    full = values.where(F.col(value).isNotNull())
    placed = with_position(full.select(*keys, value), keys, [value])
    sizes = full.groupBy(*keys).agg(F.count("*").alias("_n")).withColumnsRenamed({k: f"_{k}" for k in keys})
    sized = placed.join(sizes, [placed[k].eqNullSafe(sizes[f"_{k}"]) for k in keys]) if keys else placed.join(F.broadcast(sizes))

    def at(index: Column) -> Column:
        return F.max(F.when(F.col("position") == F.least(index, F.col("_n") - 1), F.col(value)))

    columns = []
    for p in percents:
        picked = at(F.floor(F.col("_n") * p / 100))
        if p == 50 and rule == "half":
            picked = at(F.floor(F.col("_n") / 2))
        if p == 50 and rule == "median":
            picked = (at(F.floor((F.col("_n") - 1) / 2)) + at(F.floor(F.col("_n") / 2))) / 2
        columns.append((picked if digits is None else F.round(picked, digits)).alias(f"p{p}"))
    return sized.groupBy(*keys).agg(*columns)


#: Size of a quantile summary, and the error of a rank that it keeps to with 99 % confidence (2.446 / k ** 0.9433).
SUMMARY_SIZE, RANK_ERROR = 1024, 0.0036


def value_states(values: DataFrame, keys: list[str], value: str, size: int = SUMMARY_SIZE) -> DataFrame:
    """Partial state of each key's values: n, total, least, most, and a quantile summary (binary, a few KB whatever n is).

    States can be stored, and merged with those of other runs, instances or days without the values. Nulls take no part.
    """
    known = values.where(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))
    return known.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("_v").alias("total"), F.min("_v").alias("least"), F.max("_v").alias("most"), F.kll_sketch_agg_double("_v", size).alias("summary")
    )


def merged_states(states: DataFrame, keys: list[str], size: int = SUMMARY_SIZE) -> DataFrame:
    """One state for each of the keys from any number of partial ones, in any order and any number of steps."""
    return states.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("summary", size).alias("summary")
    )


def state_percentiles(states: DataFrame, keys: list[str], percents: list[float]) -> DataFrame:
    """keys, n, mean, and p<percent> each: a value whose rank is within RANK_ERROR of the percent; `rank_percentiles` gives exact ones."""
    picked = [F.kll_sketch_get_quantile_double("summary", F.lit(p / 100.0)).alias(f"p{p:g}") for p in percents]
    return states.select(*keys, "n", (F.col("total") / F.col("n")).alias("mean"), *picked)


def histogram(values: DataFrame, value: str, edges: list[int], unit: str) -> DataFrame:
    """bin, n for bins [edge, next edge) and an open last one; bins without rows have 0."""
    labels = [f"{a}-{b}{unit}" for a, b in zip(edges, edges[1:])] + [f">{edges[-1]}{unit}"]
    placed = F.when(F.col(value) >= edges[-1], labels[-1])
    for (low, high), label in zip(zip(edges, edges[1:]), labels):
        placed = placed.when((F.col(value) >= low) & (F.col(value) < high), label)
    counted = values.select(placed.alias("bin")).where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count("*").alias("n"))
    every = values.sparkSession.createDataFrame([(label,) for label in labels], "bin string")
    return every.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def stage_funnel(attempts: DataFrame) -> DataFrame:
    """stage, entered, ok, fail, rate of probe, main page and subpages.

    An attempt that fails in the probe goes no further; one whose main page fails has no
    subpages. ``attempts`` has ``reason``.
    """
    bucket = outcomes.reason_bucket(F.col("reason"))
    probe_failed = F.coalesce(F.startswith(bucket, F.lit("probe:")), F.lit(False)) & F.col("reason").isNotNull()
    main_failed = F.col("reason").isNotNull() & ~probe_failed & ~F.startswith(bucket, F.lit("scrape:thin"))
    sub_failed = F.col("reason").isNotNull() & F.startswith(bucket, F.lit("scrape:thin"))
    counts = attempts.agg(
        F.count("*").alias("probe_in"), F.count_if(probe_failed).alias("probe_bad"), F.count_if(main_failed).alias("main_bad"), F.count_if(sub_failed).alias("sub_bad")
    )
    main_in = F.col("probe_in") - F.col("probe_bad")
    sub_in = main_in - F.col("main_bad")
    stages = F.array(
        *[
            F.struct(F.lit(name).alias("stage"), entered.alias("entered"), (entered - bad).alias("ok"), bad.alias("fail"), share(entered - bad, entered).alias("rate"))
            for name, entered, bad in (("probe", F.col("probe_in"), F.col("probe_bad")), ("main", main_in, F.col("main_bad")), ("subpages", sub_in, F.col("sub_bad")))
        ]
    )
    return counts.select(F.inline(stages))


def funnel_stage(reason: Column) -> Column:
    """The stage in which an attempt with this reason ended; null for one that failed in none."""
    bucket = outcomes.reason_bucket(reason)
    stage = F.when(F.startswith(bucket, F.lit("probe:")), "probe").when(F.startswith(bucket, F.lit("scrape:thin")), "subpages").otherwise("main")
    return F.when(reason.isNotNull(), stage)


def funnel_reasons(attempts: DataFrame) -> DataFrame:
    """stage, bucket, n, rank: what attempts failed by in each stage, the most frequent first, ties by name."""
    failed = attempts.where(F.col("reason").isNotNull())
    counts = failed.groupBy(funnel_stage(F.col("reason")).alias("stage"), outcomes.reason_bucket(F.col("reason")).alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("stage").orderBy(F.desc("n"), "bucket")))


def funnel_times(attempts: DataFrame, value: str, percents: list[int]) -> DataFrame:
    """stage and percentiles of the times of all attempts that entered it."""
    last = F.coalesce(funnel_stage(F.col("reason")), F.lit("subpages"))
    entered = F.when(last == "probe", F.array(F.lit("probe"))).when(last == "main", F.array(F.lit("probe"), F.lit("main"))).otherwise(F.array(*map(F.lit, ("probe", "main", "subpages"))))
    return rank_percentiles(attempts.select(F.explode(entered).alias("stage"), value), ["stage"], value, percents)


def peak_concurrency(spans: DataFrame, start: str, end: str) -> DataFrame:
    """peak: the most spans open at once; a span ending where another starts does not meet it.

    Steps are summed by time first; the running sum is over distinct times, in ranges, each
    range starting from the sums of the ranges before it.
    """
    steps = spans.select(F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("s"))
    by_time = steps.select("s.at", "s.d").groupBy("at").agg(F.sum("d").alias("d"))
    by_day = by_time.withColumn("day", F.to_date("at"))
    days = by_day.groupBy("day").agg(F.sum("d").alias("total"))
    base = days.select(F.col("day").alias("_day"), (F.sum("total").over(Window.orderBy("day")) - F.col("total")).alias("base"))
    within = Window.partitionBy("day").orderBy("at")
    opened = by_day.withColumn("n", F.sum("d").over(within)).join(base, F.col("day") == F.col("_day"))
    return opened.agg(F.max(F.col("base") + F.col("n")).alias("peak"))


def last_errors(errors: DataFrame, order: list[Column], n: int) -> DataFrame:
    return errors.orderBy(*order).limit(n)
