"""Small helpers that the operators share."""

from __future__ import annotations

import re
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BINS = 1024


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where that is unset and the master is local (tests) a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the folder that the cluster shares."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def few(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``cut``, and sent to every task where it has at most ``most`` rows, so that what it meets is not shuffled."""
    kept = cut(df)
    return F.broadcast(kept) if kept.limit(most + 1).count() <= most else kept


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` itself; raises if a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


def matches(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality on all keys."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def hash_order(seed: int, *columns: str) -> Column:
    """A reproducible pseudo-random order that does not depend on partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def hash_unit(seed: int, *columns: str) -> Column:
    """The hash order as a number in (0, 1] that falls as the order rises."""
    return 1 - F.conv(F.substring(hash_order(seed, *columns), 1, 8), 16, 10).cast("double") / float(1 << 32)


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the further columns of ``right``; null keys are equal, no keys mean one row on the right."""
    named = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(named[f"__r_{k}"]) for k in keys], F.lit(True))
    return left.join(named if keys else F.broadcast(named), on, how).drop(*[f"__r_{k}" for k in keys])


def in_unit(df: DataFrame, keys: list[str], value: str, name: str = "__unit", rising: bool = False) -> DataFrame:
    """Adds the place of the value between its group's bounds, in [0, 1]; with ``rising`` the smallest value gets 1."""
    bounds = df.groupBy(*keys).agg(F.min(value).cast("double").alias("__lo"), F.max(value).cast("double").alias("__hi"))
    v, lo, hi = F.col(value).cast("double"), F.col("__lo"), F.col("__hi")
    place = F.when(hi > lo, ((hi - v) if rising else (v - lo)) / (hi - lo)).otherwise(F.lit(0.0))
    return joined(df, bounds, keys).withColumn(name, place).drop("__lo", "__hi")


def above(df: DataFrame, keys: list[str], score: str, sums: dict[str, Column], order: Column | None = None) -> DataFrame:
    """Adds to each row the sums over all rows of its group with a higher score in [0, 1], or an equal one.

    Two levels, so that a large group is not ordered in one task: totals of
    ``BINS`` score ranges first, then an order inside each range: by falling
    score, or by ``order`` where the score only places a row.
    """
    binned = df.withColumn("__bin", F.least(F.floor(F.col(score) * BINS), F.lit(BINS)))
    totals = binned.groupBy(*keys, "__bin").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    higher = Window.partitionBy(*keys).orderBy(F.desc("__bin")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "__bin", *[F.coalesce(F.sum(f"__{n}").over(higher), F.lit(0)).alias(f"__{n}") for n in sums])
    inside = Window.partitionBy(*keys, "__bin").orderBy(F.desc(score) if order is None else order)
    counted = binned.withColumns({f"__in_{n}": F.sum(c).over(inside) for n, c in sums.items()})
    found = counted.alias("l").join(totals.alias("r"), reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "__bin"]]))
    return found.select(*[F.col(f"l.{c}").alias(c) for c in df.columns], *[(F.col(f"l.__in_{n}") + F.col(f"r.__{n}")).alias(n) for n in sums])


def ranked(df: DataFrame, keys: list[str], score: str, *ties: str, name: str = "rank", order: Column | None = None) -> DataFrame:
    """Adds the position by falling score in [0, 1] (or by ``order``) inside the group, ties by the given columns; two levels as in ``above``."""
    binned = df.withColumn("__bin", F.least(F.floor(F.col(score) * BINS), F.lit(BINS)))
    totals = binned.groupBy(*keys, "__bin").agg(F.count("*").alias("__n"))
    higher = Window.partitionBy(*keys).orderBy(F.desc("__bin")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__n", F.coalesce(F.sum("__n").over(higher), F.lit(0)))
    inside = Window.partitionBy(*keys, "__bin").orderBy(F.desc(score) if order is None else order, *ties)
    counted = binned.withColumn("__in", F.row_number().over(inside))
    found = counted.alias("l").join(totals.alias("r"), reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "__bin"]]))
    return found.select(*[F.col(f"l.{c}").alias(c) for c in df.columns], (F.col("l.__in") + F.col("r.__n")).alias(name))


def crowded(df: DataFrame, keys: list[str], most: int, buckets: int = 1 << 16) -> DataFrame | None:
    """The keys of more than ``most`` rows; None if there are none.

    Rows are counted by a hash of their key first, so that a row per bucket and
    task is shuffled; only keys of buckets above ``most`` are counted each.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    full = [r[0] for r in df.groupBy(bucket.alias("__bucket")).agg(F.count("*").alias("__n")).where(F.col("__n") > most).collect()]
    if not full:
        return None
    held = cut(df.where(bucket.isin(full)).groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > most).drop("__n"))
    return None if held.isEmpty() else held


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, __v and __c: the distinct non-null values of each group as doubles and their rows, counted once and kept in the shared folder."""
    return cut(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c")))


def quantiles_of(counts: DataFrame, keys: list[str], shares: dict[str, float], large: int = 100_000) -> DataFrame:
    """keys, __n (rows) and the exact quantiles of ``value_counts``, interpolated between neighbours.

    Values of groups with more than ``large`` of them are placed in two levels as
    in ``above``, so that no such group is ordered in one task; the others are
    ordered whole, with one shuffle. All shares come from the same places.
    """
    held = crowded(counts, keys, large) if keys else None
    small, many = (counts if held is None else joined(counts, held, keys, "left_anti")), (joined(counts, held, keys, "left_semi") if held is not None else None)
    if not keys:
        small, many = None, counts
    sized = None
    if small is not None:
        own = Window.partitionBy(*keys)
        sized = small.withColumns({"__upto": F.sum("__c").over(own.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)), "__n": F.sum("__c").over(own)})
    if many is not None:
        placed = above(in_unit(many, keys, "__v", rising=True), keys, "__unit", {"__upto": F.col("__c")}, F.asc("__v"))
        placed = joined(placed, many.groupBy(*keys).agg(F.sum("__c").alias("__n")), keys).drop("__unit")
        sized = placed if sized is None else sized.unionByName(placed)
    ends = []
    for name, share in shares.items():
        at = (F.col("__n") - 1) * F.lit(float(share))
        ends += [F.min(F.when(F.col("__upto") > low, F.col("__v"))).alias(f"__{end}_{name}") for end, low in (("lo", F.floor(at)), ("hi", F.ceil(at)))]
        ends.append(F.first(at - F.floor(at)).alias(f"__at_{name}"))
    found = sized.groupBy(*keys).agg(F.first("__n").alias("__n"), *ends)
    return found.select(*keys, "__n", *[(F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__at_{n}")).alias(n) for n in shares])


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and the exact quantiles of the non-null values; groups without values are absent. ``df`` is evaluated once."""
    return quantiles_of(value_counts(df, keys, value), keys, shares).drop("__n")
