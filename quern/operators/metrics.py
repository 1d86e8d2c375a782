"""Metric points rolled up by the minute, merged, re-bucketed and summed up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed by the interface: the longest range, in seconds, that each granularity serves; longer ones get the last.
GRANULARITIES = ((600, "1 minute"), (7200, "5 minutes"), (28800, "15 minutes"), (None, "1 hour"))


def flush(points: DataFrame, dims: list[str], time: str = "ts", value: str = "value") -> DataFrame:
    """minute, dims, sum, count, min, max of each minute: partials that merge() can add up."""
    return points.groupBy(F.window(time, "1 minute").alias("w"), *dims).agg(F.sum(value).alias("sum"), F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max")).select(F.col("w.start").alias("minute"), *dims, "sum", "count", "min", "max")


def merge(a: DataFrame, b: DataFrame, dims: list[str]) -> DataFrame:
    return a.unionByName(b).groupBy("minute", *dims).agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"))


def rebucket(minutes: DataFrame, dims: list[str], granularity: str) -> DataFrame:
    w = F.window("minute", granularity).alias("w")
    return minutes.groupBy(w, *dims).agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max")).select(F.col("w.start").alias("bucket"), *dims, "sum", "count", "min", "max")


def granularity_of(seconds: float) -> str:
    """Automatic granularity of a range: finer for shorter ranges."""
    return next(g for most, g in GRANULARITIES if most is None or seconds <= most)


def range_query(minutes: DataFrame, dims: list[str], start, end, granularity: str | None = None) -> DataFrame:
    """Buckets of the minutes from start to before end; the length of the range chooses the granularity where none is given."""
    inside = minutes.filter((F.col("minute") >= F.lit(start)) & (F.col("minute") < F.lit(end)))
    return rebucket(inside, dims, granularity or granularity_of((end - start).total_seconds()))


def snapshot(points: DataFrame, dims: list[str], now, window: str | None, time: str = "ts", value: str = "value") -> DataFrame:
    """sum, count, min, max of the last window (None: all)."""
    if window:
        points = points.filter(F.col(time) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {window}"))
    return points.groupBy(*dims).agg(F.sum(value).alias("sum"), F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"))


def percentiles(points: DataFrame, dims: list[str], ps: tuple[int, ...] = (50, 90, 95, 99), value: str = "value") -> DataFrame:
    """Nearest rank round(p/100 * (n-1)) over the sorted values, exact.

    Equal values are counted first, so a group is a sorted list of distinct values with running counts: no group's points are gathered.
    """
    from pyspark.sql import Window

    counts = points.filter(F.col(value).isNotNull()).groupBy(*dims, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*dims)
    run = counts.select("*", F.sum("n").over(w.orderBy(value)).alias("upto"), F.sum("n").over(w).alias("all"))
    # The value whose run covers the rank is the least with more than rank values up to it.
    picks = [F.min(F.when(F.col("upto") > F.floor(F.lit(p / 100.0) * (F.col("all") - 1) + 0.5), F.col(value))).alias(f"p{p}") for p in ps]
    return run.groupBy(*dims).agg(*picks)


def segment_means(points: DataFrame, operation: str, phases: list[str]) -> DataFrame:
    return points.groupBy(operation).agg(*[F.avg(p).alias(p) for p in phases])


def prune(minutes: DataFrame, now, retention: str = "24 HOURS") -> DataFrame:
    return minutes.filter(F.col("minute") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {retention}"))
