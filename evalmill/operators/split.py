"""Leakage-controlled splits, as one column, and their audit."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType

from .common import cut, hash_order, hash_unit, joined, ranked

PARTS = ("train", "val", "test")


def part_of(position: Column, n: Column, train: float, val: float) -> Column:
    """The part of a 1-based position: floor sizes, at least one row each from three rows on."""
    n_train = F.greatest(F.lit(1), F.floor(n * train))
    n_val = F.greatest(F.lit(1), F.floor(n * val))
    n_train = F.when(n >= 3, F.least(n_train, n - 2)).otherwise(n_train)
    n_val = F.when(n >= 3, F.least(n_val, n - n_train - 1)).otherwise(n_val)
    return F.when(position <= n_train, "train").when(position <= n_train + n_val, "val").otherwise("test")


@dataclass(frozen=True)
class Ends:
    """Where train and val end in a hash order of ``n`` rows: the last row's hash of each, the rows before that hash and those that have it; a part that takes all the rest has None."""

    n: int
    last: tuple[str | None, str | None]
    before: tuple[int, int]
    held: tuple[int, int]
    at: tuple[int, int]

    @property
    def torn(self) -> list[str]:
        """Hashes whose rows fall in two parts."""
        return [h for h, b, k, at in zip(self.last, self.before, self.held, self.at, strict=True) if h is not None and b + k > at]


def sizes(n: int, train: float, val: float) -> tuple[int, int]:
    """The sizes that ``part_of`` gives to train and val."""
    n_train, n_val = max(1, math.floor(n * train)), max(1, math.floor(n * val))
    n_train = min(n_train, n - 2) if n >= 3 else n_train
    return n_train, min(n_val, n - n_train - 1) if n >= 3 else n_val


def ends(df: DataFrame, hashes: dict[int, Column], train: float, val: float) -> dict[int, Ends]:
    """The ends of train and val in the order of each hash, from two passes that send counts alone.

    The first pass counts rows by the first three digits, the second the hashes
    of the slots in which a part ends: 1/4096 of the rows each.
    """
    named = F.explode(F.array(*[F.struct(F.lit(s).alias("seed"), h.alias("hash")) for s, h in hashes.items()]))
    spread = df.select(named.alias("__x")).select("__x.seed", "__x.hash").withColumn("slot", F.substring("hash", 1, 3))
    counted: dict[int, list] = {s: [] for s in hashes}
    for r in spread.groupBy("seed", "slot").agg(F.count("*").alias("n")).orderBy("seed", "slot").collect():
        counted[r["seed"]].append((r["slot"], r["n"]))
    wanted, n = {}, {s: sum(k for _, k in rows) for s, rows in counted.items()}
    for s, rows in counted.items():
        a, b = sizes(n[s], train, val)
        for which, at in enumerate((a, a + b)):
            before = 0
            for slot, k in rows:
                if before < at <= before + k:
                    wanted[s, which] = (slot, before, at)
                before += k
    found = {}
    if wanted:
        table = [(s, slot, which, at - before) for (s, which), (slot, before, at) in wanted.items()]
        asked = F.broadcast(df.sparkSession.createDataFrame(table, "seed long, slot string, which int, place long"))
        alike = spread.join(asked, ["seed", "slot"]).groupBy("seed", "which", "place", "hash").agg(F.count("*").alias("k"))
        upto = F.sum("k").over(Window.partitionBy("seed", "which").orderBy("hash").rowsBetween(Window.unboundedPreceding, 0))
        for r in alike.withColumn("upto", upto).where("upto >= place and upto - k < place").collect():
            found[r["seed"], r["which"]] = (r["hash"], wanted[r["seed"], r["which"]][1] + r["upto"] - r["k"], r["k"])
    out = {}
    for s in hashes:
        last, before, held = zip(*[found.get((s, which), (None, 0, 0)) for which in (0, 1)], strict=True)
        a, b = sizes(n[s], train, val)
        out[s] = Ends(n[s], last, before, held, (a, a + b))
    return out


def dealt_to(h: Column, e: Ends, nth: Column, train: float, val: float) -> Column:
    """The part of a row by its hash; rows of a hash that falls in two parts go by ``nth``, their place from 1 on."""
    out = F
    for last, before in zip(e.last, e.before, strict=True):
        if last in e.torn:
            out = out.when(h == last, part_of(F.lit(before) + nth, F.lit(e.n), train, val))
    for last, name in zip(e.last, PARTS, strict=False):
        out = out.when(F.lit(True) if last is None else h <= last, name)
    return out.otherwise("test")


def _by_hash(df: DataFrame, h: Column, e: Ends, place: Column, train: float, val: float) -> DataFrame:
    """``df`` with a column split; only rows of a hash that falls in two parts are shuffled, to take their ``place`` there."""
    rows = df.withColumn("__h", h)
    if not e.torn:
        return rows.withColumn("split", dealt_to(F.col("__h"), e, F.lit(1), train, val)).drop("__h")
    torn = F.col("__h").isin(e.torn)
    placed = rows.where(torn).withColumn("__nth", place).unionByName(rows.where(~torn).withColumn("__nth", F.lit(1)))
    return placed.withColumn("split", dealt_to(F.col("__h"), e, F.col("__nth"), train, val)).drop("__h", "__nth")


def split_random(df: DataFrame, order: list[str], seed: int = 0, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """``df`` with a column split of exact floor sizes in hash order; it is evaluated three times, and its rows stay where they are."""
    h = hash_order(seed, *order)
    place = F.row_number().over(Window.partitionBy("__h").orderBy(*order))
    return _by_hash(df, h, ends(df, {seed: h}, train, val)[seed], place, train, val)


def too_few(df: DataFrame, column: str) -> bool:
    """Whether the column has fewer than three distinct values: one more pass over that column."""
    return df.select(column).distinct().limit(3).count() < 3


def split_by_group(df: DataFrame, group: str, seed: int = 0, train: float = 0.7, val: float = 0.15, rows: list[str] | None = None) -> DataFrame:
    """All rows of a group in one part; rows without a group are dropped.

    With ``rows``, columns that tell rows apart, a table of fewer than three
    groups is split by rows instead.
    """
    known = df.where(F.col(group).isNotNull())
    if rows and too_few(known, group):
        return split_random(known, rows, seed, train, val)
    # Zeros of both signs are one group.
    named = known.withColumn("__g", F.when(F.col(group) == 0, F.lit(0.0)).otherwise(F.col(group)).cast(known.schema[group].dataType)) if isinstance(known.schema[group].dataType, FractionalType) else known.withColumn("__g", F.col(group))
    h = hash_order(seed, "__g")
    found = ends(cut(named.select("__g").distinct()), {seed: h}, train, val)[seed]
    place = F.dense_rank().over(Window.partitionBy("__h").orderBy("__g"))
    return _by_hash(named, h, found, place, train, val).drop("__g")


def split_by_pair(df: DataFrame, first: str, second: str, seed: int = 0, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Cold in two columns: rows stay only where both columns fall in the same part."""
    a = split_by_group(df, first, seed, train, val).withColumnRenamed("split", "__first")
    b = split_by_group(a, second, seed + 1, train, val)
    return b.where("split = __first").drop("__first")


def split_by_time(df: DataFrame, year: str, train: float = 0.7, val: float = 0.15, rows: list[str] | None = None) -> DataFrame:
    """Whole years in order; rows without a year are dropped. The table of distinct years is ordered whole.

    With ``rows``, columns that tell rows apart, a table of fewer than three years
    is cut by rows instead: years in order, rows of a year in hash order.
    """
    known = df.where(F.col(year).isNotNull())
    if rows and too_few(known, year):
        sizes = known.groupBy(year).agg(F.count("*").alias("__n"))
        before = Window.orderBy(year).rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.select(year, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
        placed = ranked(known.withColumn("__unit", hash_unit(0, *rows)), [year], "__unit", *rows, name="__at", order=F.asc(hash_order(0, *rows)))
        part = part_of(F.col("__at") + F.col("__before"), F.col("__all"), train, val)
        return joined(placed, sizes, [year]).withColumn("split", part).select(*df.columns, "split")
    years = known.select(year).distinct()
    placed = years.withColumn("__at", F.row_number().over(Window.orderBy(year))).withColumn("__all", F.count("*").over(Window.partitionBy()))
    return df.join(placed.withColumn("split", part_of(F.col("__at"), F.col("__all"), train, val)).select(year, "split"), year)


def split_frame(df: DataFrame, mode: str, columns: list[str], **options) -> DataFrame:
    """The split named by ``mode``: random, group, pair or time."""
    if mode == "random":
        return split_random(df, columns, **options)
    if mode in ("group", "time"):
        return {"group": split_by_group, "time": split_by_time}[mode](df, columns[0], **options)
    if mode == "pair":
        return split_by_pair(df, columns[0], columns[1], **options)
    raise ValueError(f"no such split: {mode}")


#: Names of the official splits and the columns that must be cold in each.
OFFICIAL = {"random": (), "cold_drug": ("left",), "cold_target": ("right",), "cold_pair": ("left", "right"), "cold_drug_target": ("left", "right"), "pair_cold": ("left", "right")}


def split_official(df: DataFrame, name: str, left: str, right: str, rows: list[str], **options) -> DataFrame:
    """The official split of that name (case and outer blanks do not count): random by ``rows``, or cold in one or both entities."""
    name = name.lower().strip()
    if name not in OFFICIAL:
        raise ValueError(f"no such split: {name}")
    cold = [{"left": left, "right": right}[side] for side in OFFICIAL[name]]
    return split_frame(df, ("random", "group", "pair")[len(cold)], cold or rows, **options)


def overlap(df: DataFrame, entities: dict[str, list[str]]) -> DataFrame:
    """Per entity and pair of parts: distinct keys of each, common ones, Jaccard similarity (0 if both are empty).

    One pass per entity: each key's set of parts, counted.
    """
    out = None
    pairs = [("train", "val"), ("train", "test"), ("val", "test")]
    for name, cols in entities.items():
        held = df.select(*cols, "split").dropna(subset=cols).groupBy(*cols).agg(F.collect_set("split").alias("s"))
        counts = []
        for a, b in pairs:
            in_a, in_b = F.array_contains("s", a), F.array_contains("s", b)
            counts += [F.count_if(in_a).alias(f"a_{a}_{b}"), F.count_if(in_b).alias(f"b_{a}_{b}"), F.count_if(in_a & in_b).alias(f"c_{a}_{b}")]
        rows = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"a_{a}_{b}").alias("n_first"), F.col(f"b_{a}_{b}").alias("n_second"), F.col(f"c_{a}_{b}").alias("n_common")) for a, b in pairs])
        part = held.agg(*counts).select(F.lit(name).alias("entity"), F.explode(rows).alias("r")).select("entity", "r.*")
        out = part if out is None else out.unionByName(part)
    union = F.col("n_first") + F.col("n_second") - F.col("n_common")
    return out.withColumn("jaccard", F.when(union > 0, F.col("n_common") / union).otherwise(F.lit(0.0)))


def violations(overlaps: DataFrame, cold: list[str]) -> DataFrame:
    """Overlap rows of entities that should be cold but have common keys."""
    return overlaps.where(F.col("entity").isin(cold) & (F.col("n_common") > 0))
