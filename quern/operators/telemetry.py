"""Events, runs and evaluation: semi and anti joins, last events, latencies, rollups, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.ordered import fragment, group_percentiles, rank_rows, salted_join, trailing_rows

# Severities of checks, the worst last.
SEVERITY = ("PASS", "REVIEW", "FAIL", "ERROR")


def severity_rank(status: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, s in enumerate(SEVERITY):
        out = F.when(status == s, i).otherwise(out)
    return out


def status_of_rank(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), rank + 1)


def roll_up(checks: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """The worst status per key."""
    return checks.groupBy(*keys).agg(status_of_rank(F.max(severity_rank(F.col(status)))).alias("status"))


def best_alternative(checks: DataFrame, keys: list[str], alternative: str, status: str = "status") -> DataFrame:
    """The alternative whose worst status is mildest; on ties the first."""
    per = checks.groupBy(*keys, alternative).agg(F.max(severity_rank(F.col(status))).alias("r"))
    best = per.groupBy(*keys).agg(F.min(F.struct("r", alternative)).alias("b"))
    return best.select(*keys, F.col(f"b.{alternative}").alias(alternative), status_of_rank(F.col("b.r")).alias("status"))


def first_and_last(events: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """First and last event per key, as ``first_<c>`` and ``last_<c>``."""
    at, row = F.struct(*order), F.struct(*columns)
    got = events.groupBy(*keys).agg(F.min_by(row, at).alias("a"), F.max_by(row, at).alias("z"))
    return got.select(*keys, *[F.col(f"a.{c}").alias(f"first_{c}") for c in columns], *[F.col(f"z.{c}").alias(f"last_{c}") for c in columns])


def trailing_context(events: DataFrame, keys: list[str], order: list[str], value: str, size: int = 60) -> DataFrame:
    """Each event with the values of the ``size`` events up to and with it."""
    ranked = rank_rows(fragment(events.select(*keys, *order, value), keys, order), keys, order, "__rank")
    return trailing_rows(ranked, keys, "__rank", F.col(value), size, "context").drop("__rank", "__fragment")


def after_warm_up(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Events without the first of each key."""
    ranked = rank_rows(fragment(events, keys, order), keys, order, "__rank")
    return ranked.filter("__rank > 0").select(*events.columns)


def latency(events: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``n, mean, median, p95`` per key, percentiles by linear interpolation."""
    return group_percentiles(events, keys, value, {"median": 0.5, "p95": 0.95})


def stage_latency(events: DataFrame, key: str, value: str, stages: list[str]) -> DataFrame:
    """Latencies of a fixed list of stages; one without events has n = 0 and nulls."""
    spark = events.sparkSession
    wanted = spark.createDataFrame([(s,) for s in stages], f"{key} string")
    got = latency(events.filter(F.col(key).isin(stages)), [key], value)
    return wanted.join(got, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def broken_context(turns: DataFrame, keys: list[str], order: str, failed: Column) -> DataFrame:
    """Mark the turns that come after a failed one of their key."""
    first = turns.groupBy(*keys).agg(F.min(F.when(failed, F.col(order))).alias("__at"))
    return salted_join(turns, first, keys).withColumn("after_failure", F.coalesce(F.col(order) > F.col("__at"), F.lit(False))).drop("__at")


def paired_difference(rows: DataFrame, keys: list[str], variant: str, value: str, on: str, off: str) -> DataFrame:
    """Value of both variants of each key side by side; a key with only one of them is an error when read."""
    both = rows.groupBy(*keys).agg(F.max(F.when(F.col(variant) == on, F.col(value))).alias("on_value"), F.max(F.when(F.col(variant) == off, F.col(value))).alias("off_value"))
    lacks = F.col("on_value").isNull() | F.col("off_value").isNull()
    return both.withColumn("difference", F.when(lacks, F.raise_error(F.lit("a pair is incomplete")).cast("double")).otherwise(F.col("on_value") - F.col("off_value")))


def against_baseline(current: DataFrame, baseline: DataFrame, key: str, limit: float = 1.10) -> DataFrame:
    """Means compared with a baseline: ratio, change in percent, and whether it is slower by more than ``limit``."""
    both = current.select(key, "mean").join(baseline.select(key, F.col("mean").alias("base")), key, "left")
    ratio = F.col("mean") / F.col("base")
    return both.select(key, "mean", "base", ratio.alias("ratio"), ((ratio - 1) * 100).alias("change_percent"), F.coalesce(ratio > limit, F.lit(False)).alias("review"))


def over_rate(events: DataFrame, key: str, ts: str, limit: int, window: str = "1 minute") -> DataFrame:
    """Keys with more than ``limit`` events in a window of time."""
    counts = events.groupBy(F.col(key), F.window(F.col(ts).cast("timestamp"), window).alias("w")).count()
    return counts.filter(F.col("count") > limit).select(key, F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("count").alias("n"))


def join_chunks(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Stream chunks put together in order, and whether an end mark was among them."""
    got = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(got, lambda x: x[text]), "").alias("content"))


def set_checks(rows: DataFrame, required: str, found: str, forbidden: str) -> DataFrame:
    """Whether all required are found, exactly those are, and none forbidden is."""
    missing = F.array_except(required, found)
    return rows.select(
        "*",
        (F.size(missing) == 0).alias("has_required"),
        ((F.size(missing) == 0) & (F.size(F.array_except(found, required)) == 0)).alias("exact"),
        (F.size(F.array_intersect(forbidden, found)) == 0).alias("none_forbidden"),
    )


def newest(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The newest ``n`` rows per key, numbered from the newest."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)
