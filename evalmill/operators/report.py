"""Summaries, ranks and comparisons over many runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_unit, joined, quantiles, ranked


def summary(df: DataFrame, keys: list[str], metrics: list[str], sample: bool = False) -> DataFrame:
    """Per group and metric: n, mean, deviation (population or sample), 95 % half-width (0 for one value); nulls and NaN skipped, null keys kept."""
    columns = []
    for m in metrics:
        v = F.when(~F.isnan(F.col(m).cast("double")), F.col(m))
        n, dev = F.count(v), F.coalesce(F.stddev_samp(v) if sample else F.stddev_pop(v), F.lit(0.0))
        columns += [n.alias(f"n_{m}"), F.avg(v).alias(f"mean_{m}"), dev.alias(f"std_{m}"), F.when(n > 1, 1.96 * dev / F.sqrt(n)).otherwise(0.0).alias(f"ci95_{m}")]
    return df.groupBy(*keys).agg(*columns)


def macro_average(df: DataFrame, outer: list[str], inner: list[str], metric: str) -> DataFrame:
    """Mean and sample deviation over the means of the inner groups."""
    means = df.groupBy(*outer, *inner).agg(F.avg(metric).alias("__m"))
    return means.groupBy(*outer).agg(F.count("*").alias("n_groups"), F.avg("__m").alias("mean"), F.stddev_samp("__m").alias("std"))


def distinct_list(column: str) -> Column:
    """Sorted distinct values as comma-joined text."""
    return F.array_join(F.array_sort(F.collect_set(F.col(column).cast("string"))), ",")


def content_digest(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Per group a digest of the distinct values that depends on no order: SHA-1 of their number and the sum of 60 bits of each value's MD5.

    Both parts add up before the shuffle, so that no group is gathered.
    """
    part = F.conv(F.substring(F.md5(F.col(column).cast("string")), 1, 15), 16, 10).cast("decimal(38,0)")
    distinct = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.lit(1).alias("__one"))
    return distinct.groupBy(*keys).agg(F.count("*").alias("n_values"), F.sha1(F.concat_ws(":", F.count("*").cast("string"), F.sum(part).cast("string"))).alias("digest"))


def mode_of(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The most frequent value of each group, the smallest on ties."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("__n"))
    return counts.groupBy(*keys).agg(F.min_by(column, F.struct(-F.col("__n"), F.col(column))).alias(column), F.max("__n").alias("n"))


def average_rank(df: DataFrame, condition: list[str], metric: str, descending: bool = True) -> DataFrame:
    """Adds the rank inside the condition, ties sharing the average of their places."""
    w = Window.partitionBy(*condition)
    place = F.rank().over(w.orderBy(F.desc(metric) if descending else F.asc(metric)))
    ties = F.count("*").over(Window.partitionBy(*condition, metric))
    return df.withColumn("rank", place + (ties - 1) / 2)


def equal_bins(df: DataFrame, keys: list[str], score: str, ties: list[str], bins: int) -> DataFrame:
    """Adds a bin 1..q of equal counts by rising score: ``max(1, ceil((r-1)*q/(n-1)))`` with q the smaller of bins and n; nulls come last."""
    placed = ranked(in_unit(df, keys, score, rising=True), keys, "__unit", *ties, name="__r", order=F.asc_nulls_last(score))
    sized = joined(placed, df.groupBy(*keys).agg(F.count("*").alias("__n")), keys)
    q, n = F.least(F.lit(bins), F.col("__n")), F.col("__n")
    b = F.when(n == 1, 1).otherwise(F.greatest(F.lit(1), F.ceil((F.col("__r") - 1) * q / (n - 1))))
    return sized.withColumn("bin", b.cast("int")).drop("__r", "__n", "__unit")


def quartiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds the quartile of the value in its group; equal edges count once."""
    edges = quantiles(df, keys, value, {"__1": 0.25, "__2": 0.5, "__3": 0.75}).select(*keys, F.array_distinct(F.array("__1", "__2", "__3")).alias("__e"))
    return df.join(edges, keys).withColumn("quartile", 1 + F.size(F.filter("__e", lambda e: F.col(value) > e))).drop("__e")


def best_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the order."""
    return top_per(df, keys, 1, *order)


def top_per(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each group in the order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def compare(df: DataFrame, model: str, first: str, second: str, keys: list[str], metrics: list[str]) -> DataFrame:
    """Model ``first`` beside ``second`` on equal keys, with the differences."""
    a = df.where(F.col(model) == first).select(*keys, *[F.col(m).alias(f"{m}_a") for m in metrics])
    b = df.where(F.col(model) == second).select(*keys, *[F.col(m).alias(f"{m}_b") for m in metrics])
    return a.join(b, keys).select(*keys, *[f"{m}_{s}" for m in metrics for s in "ab"], *[(F.col(f"{m}_a") - F.col(f"{m}_b")).alias(f"{m}_delta") for m in metrics])


def gaps(df: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the expected grid that the table lacks."""
    return grid.join(df.select(*keys).distinct(), keys, "left_anti")


def selection_instability(df: DataFrame, run: list[str], model: str, metric: str, chosen: str) -> DataFrame:
    """Per run: best model, chosen model, whether they agree, and the gap of the metric (rounded to 12 places)."""
    best = F.max_by(model, F.struct(F.col(metric), F.col(model)))
    picked = F.max(F.when(F.col(model) == F.col(chosen), F.col(metric)))
    t = df.groupBy(*run).agg(best.alias("best"), F.max(metric).alias("__top"), F.max(chosen).alias("chosen"), picked.alias("__own"))
    return t.select(*run, "best", "chosen", (F.col("best") == F.col("chosen")).alias("match"), F.round(F.col("__top") - F.col("__own"), 12).alias("gap"))


def instability_summary(instability: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of ``selection_instability``: runs, share of agreement, mean and largest gap."""
    return instability.groupBy(*keys).agg(F.count("*").alias("runs"), F.avg(F.col("match").cast("int")).alias("match_rate"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap"))
