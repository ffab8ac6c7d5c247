"""Evaluation of predictions, for many groups at once.

Predictions are long: key columns, a label 0/1 (``y``), a probability in [0, 1]
(``p``), and an id for ties. Rows with a null label or probability take no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import above, cut, few, in_unit, joined, ranked

#: Edges of ten equal bins as floating-point multiples of 0.1.
EDGES = tuple(i * 0.1 for i in range(1, 10))


def usable(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double")))


def _times(weight: str | None) -> Column:
    """How often a row counts: a positive whole number where a column is named."""
    return F.lit(1) if weight is None else F.col(weight)


def ranking(df: DataFrame, keys: list[str], y: str = "y", p: str = "p", weight: str | None = None) -> DataFrame:
    """Per group: n, n_pos, AUROC (ties averaged; null if one class) and average precision (ties grouped; null without positives)."""
    pos = F.sum(_times(weight) * F.col(y))
    scores = usable(df, y, p).groupBy(*keys, p).agg(pos.alias("pos"), (F.sum(_times(weight)) - pos).alias("neg"))
    summed = above(scores, keys, p, {"tp": F.col("pos"), "fp": F.col("neg")})
    pairs = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    steps = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    n_pos, n_neg = F.sum("pos"), F.sum("neg")
    return summed.groupBy(*keys).agg((n_pos + n_neg).alias("n"), n_pos.alias("n_pos"), F.when((n_pos > 0) & (n_neg > 0), pairs / (n_pos * n_neg)).alias("auroc"), F.when(n_pos > 0, steps / n_pos).alias("ap"))


def bin_of(p: Column) -> Column:
    """The bin 0..9 of a probability by comparison with the exact edges; the last bin is closed."""
    return sum([(p >= e).cast("int") for e in EDGES], F.lit(0))


def calibration(df: DataFrame, keys: list[str], y: str = "y", p: str = "p", weight: str | None = None) -> DataFrame:
    """Per group and bin: count, mean probability, positive rate, their gap."""
    w = _times(weight)
    t = usable(df, y, p).groupBy(*keys, bin_of(F.col(p)).alias("bin")).agg(F.sum(w).alias("n"), (F.sum(w * F.col(p)) / F.sum(w)).alias("mean_p"), (F.sum(w * F.col(y)) / F.sum(w)).alias("rate"))
    return t.withColumn("gap", F.abs(F.col("mean_p") - F.col("rate")))


def ece(df: DataFrame, keys: list[str], y: str = "y", p: str = "p", weight: str | None = None) -> DataFrame:
    """Expected calibration error per group."""
    return calibration(df, keys, y, p, weight).groupBy(*keys).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def _confident(df: DataFrame, y: str, p: str) -> DataFrame:
    wrong = ((F.col(p) >= 0.5).cast("int") != F.col(y)).cast("int")
    return usable(df, y, p).withColumn("__conf", F.greatest(F.col(p), 1 - F.col(p))).withColumn("__wrong", wrong)


def risk_at(df: DataFrame, keys: list[str], id_col: str, coverage: float = 0.8, rounding: str = "floor", y: str = "y", p: str = "p") -> DataFrame:
    """Error rate of the most confident share of each group: ``max(1, floor)`` or ceiling of coverage times n; ties by id.

    Counts by confidence tell where the share ends; only rows of that one
    confidence are ordered by id.
    """
    rows = _confident(df, y, p)
    counts = cut(rows.groupBy(*keys, "__conf").agg(F.count("*").alias("__k"), F.sum("__wrong").alias("__bad")))
    size = counts.groupBy(*keys).agg(F.sum("__k").alias("__n"))
    share = F.lit(coverage) * F.col("__n")
    keep = F.greatest(F.lit(1), F.floor(share) if rounding == "floor" else F.ceil(share))
    placed = joined(above(counts, keys, "__conf", {"__upto": F.col("__k")}), size.withColumn("__keep", keep).drop("__n"), keys)
    end = (F.col("__upto") >= F.col("__keep")) & (F.col("__upto") - F.col("__k") < F.col("__keep"))
    whole = F.col("__upto") < F.col("__keep")
    told = few(placed.groupBy(*keys).agg(F.max("__keep").alias("__keep"), F.sum(F.when(whole, F.col("__bad")).otherwise(0)).alias("__sure"), F.max(F.when(end, F.col("__conf"))).alias("__at"), (F.max("__keep") - F.sum(F.when(whole, F.col("__k")).otherwise(0))).alias("__take")))
    last = joined(rows, told, keys).where(F.col("__conf") == F.col("__at"))
    order = Window.partitionBy(*keys).orderBy(id_col)
    first = last.select(*keys, id_col, "__wrong", "__take").withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= F.col("__take"))
    tied = first.groupBy(*keys).agg(F.sum("__wrong").alias("__tied"))
    return joined(told, tied, keys).select(*keys, ((F.col("__sure") + F.col("__tied")) / F.col("__keep")).alias("risk"))


def weighted_risk_at(df: DataFrame, keys: list[str], id_col: str, weight: str, coverage: float = 0.8, y: str = "y", p: str = "p") -> DataFrame:
    """``risk_at`` (floor) over rows that count ``weight`` times each; the last row kept may count in part."""
    rows = _confident(df, y, p).withColumn("__order", F.struct((-F.col("__conf")).alias("c"), F.col(id_col).alias("id")))
    placed = above(rows, keys, "__conf", {"__upto": F.col(weight)}, F.asc("__order"))
    keep = F.greatest(F.lit(1), F.floor(F.lit(coverage) * F.col("__n")))
    taken = F.greatest(F.lit(0), F.least(F.col(weight), F.col("__keep") - (F.col("__upto") - F.col(weight))))
    sized = rows.groupBy(*keys).agg(F.sum(weight).alias("__n")).withColumn("__keep", keep)
    return joined(placed, sized, keys).groupBy(*keys).agg((F.sum(taken * F.col("__wrong")) / F.max("__keep")).alias("risk"))


def risk_coverage(df: DataFrame, keys: list[str], id_col: str, y: str = "y", p: str = "p") -> DataFrame:
    """Per row in order of confidence: coverage and the error rate so far."""
    placed = ranked(_confident(df, y, p), keys, "__conf", id_col)
    # Errors so far: whole blocks of positions first, then inside the block.
    block = placed.withColumn("__block", F.floor((F.col("rank") - 1) / 4096))
    sums = block.groupBy(*keys, "__block").agg(F.sum("__wrong").alias("__sum"), F.count("*").alias("__count"))
    w = Window.partitionBy(*keys)
    sums = sums.select(*keys, "__block", F.coalesce(F.sum("__sum").over(w.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__count").over(w).alias("__n"))
    inside = Window.partitionBy(*keys, "__block").orderBy("rank")
    run = block.withColumn("__in", F.sum("__wrong").over(inside)).join(sums, [*keys, "__block"])
    return run.select(*keys, id_col, "rank", (F.col("rank") / F.col("__n")).alias("coverage"), ((F.col("__in") + F.col("__before")) / F.col("rank")).alias("risk"))


def classification(df: DataFrame, keys: list[str], y: str = "y", p: str = "p", weight: str | None = None) -> DataFrame:
    """Per group: Brier score, accuracy, balanced accuracy (null if one class), MCC (0 if undefined), prevalence."""
    hat = F.col(p) >= 0.5
    pos = F.col(y) == 1
    w, gap = _times(weight), F.col(p) - F.col(y)
    cells = {"tp": hat & pos, "fp": hat & ~pos, "fn": ~hat & pos, "tn": ~hat & ~pos}
    t = usable(df, y, p).groupBy(*keys).agg((F.sum(w * gap * gap) / F.sum(w)).alias("brier"), (F.sum(w * F.col(y)) / F.sum(w)).alias("prevalence"), *[F.sum(F.when(c, w).otherwise(0)).cast("double").alias(n) for n, c in cells.items()])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    both = ((tp + fn) > 0) & ((tn + fp) > 0)
    norm = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return t.select(*keys, "brier", "prevalence", ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"), F.when(both, (tp / (tp + fn) + tn / (tn + fp)) / 2).alias("balanced_accuracy"), F.when(norm > 0, (tp * tn - fp * fn) / norm).otherwise(0.0).alias("mcc"))


def regression(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """Per group: RMSE, MAE, Pearson correlation (null if a side is constant)."""
    d = F.col(y) - F.col(p)
    seen = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    return seen.groupBy(*keys).agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.corr(y, p).alias("pearson"))


def average_ranks(df: DataFrame, keys: list[str], value: str, weight: str, name: str = "rank") -> DataFrame:
    """keys, value and the rank of each distinct value by falling order, ties sharing the average of their places."""
    counts = df.groupBy(*keys, value).agg(F.sum(weight).alias("__c"))
    found = above(in_unit(counts, keys, value), keys, "__unit", {"__upto": F.col("__c")}, F.desc(value))
    return found.select(*keys, value, (F.col("__upto") - (F.col("__c") - 1) / 2).alias(name))


def spearman(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """Rank correlation per group, ties averaged (null if a side is constant).

    Rows are counted by (y, p) first; the mean rank is (n + 1) / 2 on both sides.
    """
    seen = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*keys, F.col(y).cast("double").alias("__y"), F.col(p).cast("double").alias("__p")).agg(F.count("*").alias("__w"))
    placed = joined(joined(seen, average_ranks(seen, keys, "__y", "__w", "__ry"), [*keys, "__y"]), average_ranks(seen, keys, "__p", "__w", "__rp"), [*keys, "__p"])
    w, a, b = F.col("__w"), F.col("__ry"), F.col("__rp")
    sums = placed.groupBy(*keys).agg(F.sum(w).alias("n"), F.sum(w * a * b).alias("ab"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"))
    centre = F.col("n") * (F.col("n") + 1.0) * (F.col("n") + 1.0) / 4
    var = (F.col("aa") - centre) * (F.col("bb") - centre)
    return sums.select(*keys, "n", F.when(var > 0, (F.col("ab") - centre) / F.sqrt(var)).alias("spearman"))


def evaluate(df: DataFrame, keys: list[str], id_col: str, y: str = "y", p: str = "p") -> DataFrame:
    """Ranking, calibration, risk at 80 % and classification metrics per group in one table.

    All but the risk, which needs an order of rows, come from one count of rows by label and probability.
    """
    counts = usable(df, y, p).groupBy(*keys, y, p).agg(F.count("*").alias("__w"))
    out = ranking(counts, keys, y, p, "__w")
    for part in (ece(counts, keys, y, p, "__w"), risk_at(df, keys, id_col, y=y, p=p), classification(counts, keys, y, p, "__w")):
        out = joined(out, part, keys)
    return out.withColumn("ap_lift", F.col("ap") - F.col("prevalence"))


def _relabelled(df: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    marked = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return marked.withColumn("y", (F.col(value) >= F.col("threshold")).cast("int"))


def threshold_sweep(df: DataFrame, keys: list[str], value: str, p: str, thresholds: list[float]) -> DataFrame:
    """Ranking metrics after relabelling by each threshold of the value."""
    return ranking(_relabelled(df, value, thresholds), [*keys, "threshold"], "y", p)


def threshold_metrics(df: DataFrame, keys: list[str], id_col: str, value: str, p: str, thresholds: list[float]) -> DataFrame:
    """All metrics of ``evaluate`` after relabelling by each threshold of the value."""
    return evaluate(_relabelled(df, value, thresholds), [*keys, "threshold"], id_col, "y", p)


def poisson_weight(seed: int, replicate: Column, id_col: str) -> Column:
    """A Poisson(1) count from a hash of seed, replicate and id: the number of cumulative probabilities that a uniform draw reaches."""
    u = F.pmod(F.xxhash64(F.lit(seed), replicate, F.col(id_col)), F.lit(1 << 40)) / float(1 << 40)
    total, term, count = 0.0, 0.36787944117144233, F.lit(0)
    for k in range(1, 10):
        total += term
        term /= k
        count = count + (u >= total).cast("int")
    return count


def _poisson_weights(ids, starts):
    """``poisson_weight`` of long ids (rows) and replicates (columns). ``starts``: Spark's hashes of seed and replicate, into which each id is mixed as ``xxhash64`` does."""
    import numpy as np

    one, two, three, four, five = (np.uint64(k) for k in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x, by: int):
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    mixed = (starts.astype(np.int64).view(np.uint64) + five + np.uint64(8))[None, :] ^ (turned(ids.astype(np.int64).view(np.uint64) * two, 31) * one)[:, None]
    mixed = turned(mixed, 27) * one + four
    for by, times in ((33, two), (29, three)):
        mixed = (mixed ^ (mixed >> np.uint64(by))) * times
    drawn = (mixed ^ (mixed >> np.uint64(32))) & np.uint64((1 << 40) - 1)
    total, term, count = 0.0, 0.36787944117144233, np.zeros(drawn.shape)
    for k in range(1, 10):
        total += term
        term /= k
        count += drawn >= np.uint64(math.ceil(total * (1 << 40)))
    return count


BOOTSTRAPPED = ("ap", "auroc", "ece", "risk", "brier")
#: Rows that a task of the bootstrap weighs together (of one range of values up to twice as many), and replicates at a time.
WEIGHED, ABREAST = 2048, 128


class _Replicates:
    """The sums of all replicates over a few rows at a time, as arrays with a place per replicate; place 0 is the observed table, where each row counts once."""

    def __init__(self, starts: list[int]):
        self.starts, self.n = starts, len(starts) + 1

    def weights(self, ids, places):
        import numpy as np

        w, drawn = np.ones((len(ids), len(places))), places > 0
        w[:, drawn] = _poisson_weights(ids, np.array(self.starts, dtype=np.int64)[places[drawn] - 1])
        return w

    def slices(self, places=None):
        import numpy as np

        places = np.arange(self.n) if places is None else places
        return [places[i : i + ABREAST] for i in range(0, len(places), ABREAST)]

    def summed(self, ids, columns):
        """Weighted sums of each column: an array of columns by places."""
        import numpy as np

        return np.concatenate([columns.T @ self.weights(ids, at) for at in self.slices()], axis=1)

    def by_bin(self, keys: list[str]):
        """Of one range (or a part of it): per bin weights, positives, sums of values and of squared errors."""
        import numpy as np

        def told(pdf):
            y, v, bins = (pdf[c].to_numpy() for c in ("__y", "__v", "__tenth"))
            found = np.unique(bins)
            inside = (bins[:, None] == found[None, :]).astype(float)
            wanted = {"w": np.ones(len(y)), "pos": y, "sum_v": v, "sum_e": (v - y) ** 2}
            out = pdf.loc[[pdf.index[0]] * len(found), keys].reset_index(drop=True).assign(__tenth=found)
            sums = self.summed(pdf["__key"].to_numpy(), np.concatenate([inside * x[:, None] for x in wanted.values()], axis=1))
            return out.assign(**{n: list(part) for n, part in zip(wanted, np.split(sums, len(wanted)))})

        return told

    def in_order(self, keys: list[str]):
        """Of one range: its part of AUROC's pairs and of AP's steps, given the positives and negatives above it."""
        import numpy as np

        def told(pdf, before):
            if pdf.empty:
                return pdf[keys].assign(pairs=[], steps=[])
            pdf = pdf.sort_values("__v", ascending=False, kind="stable")
            ids, y, v = (pdf[c].to_numpy() for c in ("__key", "__y", "__v"))
            fresh = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            upto = np.zeros((2, self.n))
            upto[:, before["__b"].to_numpy() + 1] = before[["tp", "fp"]].to_numpy().T
            pairs, steps = np.zeros(self.n), np.zeros(self.n)
            for at in self.slices():
                w = self.weights(ids, at)
                pos = np.add.reduceat(w * y[:, None], fresh, axis=0)
                neg = np.add.reduceat(w, fresh, axis=0) - pos
                tp, fp = np.cumsum(pos, 0) + upto[0, at], np.cumsum(neg, 0) + upto[1, at]
                pairs[at] = np.sum(neg * (tp - pos / 2), 0)
                steps[at] = np.sum(pos * tp / np.maximum(tp + fp, 1), 0)
            return pdf.iloc[:1][keys].assign(pairs=[pairs], steps=[steps])

        return told

    def errors(self, keys: list[str]):
        """Of one block in order of confidence: weights and weights of wrong rows."""
        import numpy as np

        def told(pdf):
            w, bad = self.summed(pdf["__key"].to_numpy(), np.stack([np.ones(len(pdf)), pdf["__wrong"].to_numpy()], axis=1))
            return pdf.iloc[:1][keys].assign(w=[w], bad=[bad])

        return told

    def at_end(self, keys: list[str]):
        """Of the block where the share of some replicates ends: the wrong weight among the first ``take`` of each."""
        import numpy as np
        import pandas as pd

        def told(pdf, ends):
            if pdf.empty or ends.empty:
                return pdf.iloc[:0][keys].assign(__b=[], last=[])
            pdf = pdf.sort_values("__rank")
            ids, wrong = (pdf[c].to_numpy() for c in ("__key", "__wrong"))
            places, take, out = ends["__b"].to_numpy() + 1, ends["take"].to_numpy(), []
            for at in self.slices(np.arange(len(places))):
                w = self.weights(ids, places[at])
                out.append(wrong @ np.clip(take[at] - (np.cumsum(w, 0) - w), 0, w))
            return pd.concat([pdf.iloc[:1][keys]] * len(places), ignore_index=True).assign(__b=places - 1, last=np.concatenate(out))

        return told


def _spread(df: DataFrame, names: list[str]) -> DataFrame:
    """Arrays with a place per replicate as a row per replicate; -1 is the observed table."""
    other = [c for c in df.columns if c not in names]
    rows = df.select(*other, F.posexplode(F.arrays_zip(*names)).alias("__at", "__z"))
    return rows.select(*other, (F.col("__at") - 1).alias("__b"), *[F.col("__z")[n].alias(n) for n in names])


def bootstrap_difference(df: DataFrame, keys: list[str], id_col: str, y: str, p: str, q: str, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """Per group and metric (AUPRC, AUROC, ECE, risk at 80 %, Brier): n, both observed values, their difference (q less p), its 95 % percentile interval, shares of replicates at or below and at or above 0, replicates used.

    A replicate counts each row by a Poisson weight, the same for both sides;
    those with one class are left out. Ids that are not longs draw by their hash.

    Rows are ordered once for all replicates: by value into ranges (a value as
    heavy as a range has its own, in parts), by confidence and id into blocks. A
    task draws the weights of one range or block for all replicates, so that only
    sums per range and replicate are shuffled. AP and the end of the risk's share
    need what lies above a range: running sums over ranges, then a second draw.
    """
    rows = usable(usable(df, y, p), y, q)
    number = F.col(id_col) if dict(df.dtypes)[id_col] == "bigint" else F.xxhash64(id_col)
    rows = rows.select(*keys, F.col(id_col).alias("__id"), F.coalesce(number, F.lit(0)).alias("__key"), F.col(y).cast("double").alias("__y"), F.col(p).cast("double").alias("__p"), F.col(q).cast("double").alias("__q"))
    sides = F.explode(F.array(F.struct(F.lit("p").alias("side"), F.col("__p").alias("v")), F.struct(F.lit("q").alias("side"), F.col("__q").alias("v"))))
    long = rows.withColumn("__s", sides).select(*keys, "__id", "__key", "__y", F.col("__s.side").alias("__side"), F.col("__s.v").alias("__v"))
    long = cut(_confident(long, "__y", "__v").withColumn("__tenth", bin_of(F.col("__v"))))
    by = [*keys, "__side"]
    # Ranges of as many rows, however many ranges that makes.
    ranges = _in_ranges(long.withColumn("__w", F.lit(1)), by, "__v", "__range", math.inf, WEIGHED)
    placed = ranked(joined(long, ranges, [*by, "__v"]), by, "__conf", "__id", name="__rank")
    alone = F.col("__range") % 2 == 1
    part = F.when(alone, F.pmod("__rank", F.ceil(F.col("__c") / WEIGHED))).otherwise(F.lit(0))
    placed = cut(placed.withColumns({"__part": part, "__block": F.floor((F.col("__rank") - 1) / WEIGHED)}).drop("__id", "__conf", "__c"))

    hashes = [F.xxhash64(F.lit(seed), F.lit(b)) for b in range(replicates)]
    drawn = _Replicates(list(df.sparkSession.range(1).select(F.array(*hashes)).first()[0]) if hashes else [])
    typed = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields}

    def schema(names: list[str], *more: str) -> str:
        return ", ".join([typed[n] for n in names] + list(more))

    # Rows are few bytes for the work on them: a fixed number of tasks, which AQE leaves as it is.
    dealt = lambda d, *columns: d.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
    arrays = lambda *names: [f"{n} array<double>" for n in names]
    told = ["w", "pos", "sum_v", "sum_e"]
    within = [*by, "__range"]
    sums = dealt(placed, *within, "__part").groupBy(*within, "__part").applyInPandas(drawn.by_bin(within), schema([*within, "__tenth"], *arrays(*told)))
    sums = cut(_spread(sums, told).groupBy(*within, "__b", "__tenth").agg(*[F.sum(n).alias(n) for n in told]))
    by_b = [*by, "__b"]
    gap = F.abs(F.col("sum_v") - F.col("pos"))
    bins = sums.where("w > 0").groupBy(*by_b, "__tenth").agg(*[F.sum(n).alias(n) for n in told])
    made = bins.groupBy(*by_b).agg(F.sum("w").cast("long").alias("n"), F.sum("pos").alias("n_pos"), (F.sum(gap) / F.sum("w")).alias("ece"), (F.sum("sum_e") / F.sum("w")).alias("brier"))

    # What lies above each range: positives and negatives.
    higher = Window.partitionBy(*by_b).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    of_range = sums.groupBy(*within, "__b").agg(F.sum("pos").alias("pos"), F.sum(F.col("w") - F.col("pos")).alias("neg"))
    of_range = cut(of_range.withColumns({"tp": F.coalesce(F.sum("pos").over(higher), F.lit(0.0)), "fp": F.coalesce(F.sum("neg").over(higher), F.lit(0.0))}))
    mixed = dealt(placed.where(~alone), *within).groupBy(*within).cogroup(dealt(of_range.where(~alone), *within).groupBy(*within)).applyInPandas(drawn.in_order(by), schema(by, *arrays("pairs", "steps")))
    tp, fp = F.col("tp") + F.col("pos"), F.col("fp") + F.col("neg")
    heavy = of_range.where(alone & (F.col("pos") + F.col("neg") > 0)).select(*by_b, (F.col("neg") * (tp - F.col("pos") / 2)).alias("pairs"), (F.col("pos") * tp / (tp + fp)).alias("steps"))
    ranks = _spread(mixed, ["pairs", "steps"]).unionByName(heavy).groupBy(*by_b).agg(F.sum("pairs").alias("pairs"), F.sum("steps").alias("steps"))

    # The block of confidences in which the share of each replicate ends.
    within = [*by, "__block"]
    blocks = dealt(placed, *within).groupBy(*within).applyInPandas(drawn.errors(within), schema(within, *arrays("w", "bad")))
    every = Window.partitionBy(*by_b)
    upto = {"upto": F.sum("w").over(every.orderBy("__block").rowsBetween(Window.unboundedPreceding, 0)), "keep": F.greatest(F.lit(1), F.floor(F.lit(0.8) * F.sum("w").over(every))).cast("double")}
    blocks = cut(_spread(blocks, ["w", "bad"]).withColumns(upto))
    ends = blocks.where((F.col("upto") >= F.col("keep")) & (F.col("upto") - F.col("w") < F.col("keep"))).select(*within, "__b", (F.col("keep") - F.col("upto") + F.col("w")).alias("take"))
    last = joined(placed, ends.select(*within).distinct(), within, "left_semi").groupBy(*within).cogroup(ends.groupBy(*within)).applyInPandas(drawn.at_end(by), schema(by, "__b int", "last double"))
    sure = blocks.groupBy(*by_b).agg(F.max("keep").alias("keep"), F.sum(F.when(F.col("upto") < F.col("keep"), F.col("bad")).otherwise(0.0)).alias("sure"))
    risk = joined(sure, last, by_b).select(*by_b, ((F.col("sure") + F.col("last")) / F.col("keep")).alias("risk"))

    n_neg = F.col("n") - F.col("n_pos")
    made = joined(joined(made, ranks, by_b), risk, by_b)
    made = made.withColumns({"auroc": F.when((F.col("n_pos") > 0) & (n_neg > 0), F.col("pairs") / (F.col("n_pos") * n_neg)), "ap": F.when(F.col("n_pos") > 0, F.col("steps") / F.col("n_pos"))})
    both = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in BOOTSTRAPPED]))
    # A replicate without two classes has no AUROC; the observed values stay.
    tall = made.where("__b = -1 or auroc is not null").withColumn("__m", both).select(*by_b, "n", F.col("__m.metric").alias("metric"), F.col("__m.value").alias("value"))
    sided = [F.max(F.when(F.col("__side") == side, F.col("value"))).alias(f"value_{side}") for side in "pq"]
    pairs = tall.groupBy(*keys, "metric", "__b").agg(F.max("n").alias("n"), *sided).withColumn("d", F.col("value_q") - F.col("value_p"))
    seen, d = F.col("__b") == -1, F.when(F.col("__b") >= 0, F.col("d"))
    found = pairs.groupBy(*keys, "metric").agg(
        *[F.max(F.when(seen, F.col(c))).alias(n) for c, n in (("n", "n"), ("value_p", "value_p"), ("value_q", "value_q"), ("d", "difference"))],
        F.percentile(d, F.array(F.lit(0.025), F.lit(0.975))).alias("i"), F.avg((d <= 0).cast("int")).alias("share_not_above_0"), F.avg((d >= 0).cast("int")).alias("share_not_below_0"), F.count(d).alias("replicates"),
    )
    return found.select(*keys, "metric", "n", "value_p", "value_q", "difference", F.col("i")[0].alias("low"), F.col("i")[1].alias("high"), "share_not_above_0", "share_not_below_0", "replicates")


def _both_less(y, p, w) -> float:
    """Weight of pairs with a smaller y and a smaller p on one side; equal p count one half. Sorts once per bit of the rank of y."""
    import numpy as np

    by_p = np.argsort(p, kind="stable")
    place, w = np.unique(y, return_inverse=True)[1][by_p], w[by_p].astype(float)
    p, total = np.unique(p[by_p], return_inverse=True)[1], 0.0
    for bit in range(int(place.max()).bit_length() if len(place) else 0):
        # Places that first differ in this bit: the lower half of a group against its upper half.
        group = np.argsort(place >> (bit + 1), kind="stable")
        g, v, upper = (place >> (bit + 1))[group], p[group], (place[group] >> bit & 1).astype(bool)
        upto = np.concatenate([[0.0], np.cumsum(np.where(upper, 0.0, w[group]))])
        fresh = np.concatenate([[True], g[1:] != g[:-1]])
        run = fresh | np.concatenate([[True], v[1:] != v[:-1]])
        starts = np.flatnonzero(run)
        at = np.cumsum(run) - 1
        base = upto[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        less, with_ties = upto[starts][at] - base, upto[np.append(starts[1:], len(v))][at] - base
        total += float(np.sum((w[group] * (less + with_ties) / 2)[upper]))
    return total


def _in_ranges(df: DataFrame, keys: list[str], value: str, name: str, ranges: float, least: int) -> DataFrame:
    """keys, value, its weight and its range by falling order: ranges of about equal weight; a value as heavy as a range has one (odd) for itself."""
    counts = df.groupBy(*keys, value).agg(F.sum("__w").alias("__c"))
    found = above(in_unit(counts, keys, value), keys, "__unit", {"__upto": F.col("__c")}, F.desc(value))
    sizes = counts.groupBy(*keys).agg(F.greatest(F.lit(least), F.ceil(F.sum("__c") / ranges)).alias("__size"))
    heavy = (F.col("__c") >= F.col("__size")).cast("long")
    return joined(found, sizes, keys).select(*keys, value, "__c", (2 * F.floor((F.col("__upto") - F.col("__c")) / F.col("__size")) + heavy).alias(name))


def concordance(df: DataFrame, keys: list[str], y: str = "y", p: str = "p", ranges: int = 512, least: int = 4096) -> DataFrame:
    """Concordance index per group over all pairs with y_i > y_j; a tied prediction counts one half; null without such pairs.

    Rows with a null or NaN on a side take no part. Work is n log n: rows are
    counted by (y, p) and both sides cut into ranges by rank. Pairs in one range
    of y, and those in one range of p but not of y, are counted inside the range
    by sorting; all others follow from the weights of the cells of the two
    ranges. A task sees a range (1/``ranges`` of a group, or ``least`` rows) or a
    group's cells, at most (2 * ``ranges``) squared.
    """
    import numpy as np
    import pandas as pd

    fy, fp = F.col(y).cast("double"), F.col(p).cast("double")
    seen = df.where(fy.isNotNull() & fp.isNotNull() & ~F.isnan(fy) & ~F.isnan(fp)).groupBy(*keys, fy.alias("__y"), fp.alias("__p")).agg(F.count("*").alias("__w"))
    seen = cut(seen)  # both sides' ranges, cells and pairs come from this count
    sides = {side: cut(_in_ranges(seen, keys, f"__{side}", f"__r{side}", ranges, least)) for side in "yp"}
    placed = seen
    for side, table in sides.items():
        placed = joined(placed, table.drop("__c"), [*keys, f"__{side}"])
    placed = cut(placed)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in seen.schema.fields if f.name in keys] + ["good double"])

    def told(pdf: pd.DataFrame, good: float) -> pd.DataFrame:
        return pdf.iloc[:1][keys].assign(good=float(good))

    def in_y(pdf: pd.DataFrame) -> pd.DataFrame:
        return told(pdf, _both_less(pdf["__y"].to_numpy(), pdf["__p"].to_numpy(), pdf["__w"].to_numpy()))

    def in_p(pdf: pd.DataFrame) -> pd.DataFrame:
        return told(pdf, _both_less(-pdf["__ry"].to_numpy(), pdf["__p"].to_numpy(), pdf["__w"].to_numpy()))

    def of_cells(pdf: pd.DataFrame) -> pd.DataFrame:
        (rows, i), (columns, j) = (np.unique(pdf[c], return_inverse=True) for c in ("__ry", "__rp"))
        grid = np.zeros((len(rows), len(columns)))
        np.add.at(grid, (i, j), pdf["__w"].to_numpy())
        higher = np.cumsum(grid, 0) - grid
        tied = np.where(columns % 2 == 1, grid * higher, 0.0) / 2
        return told(pdf, np.sum(grid * (np.cumsum(higher, 1) - higher)) + np.sum(tied))

    cells = placed.groupBy(*keys, "__ry", "__rp").agg(F.sum("__w").alias("__w"))
    good = placed.where("__ry % 2 = 0").groupBy(*keys, "__ry").applyInPandas(in_y, schema)
    good = good.unionByName(placed.where("__rp % 2 = 0").groupBy(*keys, "__rp").applyInPandas(in_p, schema))
    good = good.unionByName(cells.groupBy(*keys).applyInPandas(of_cells, schema)).groupBy(*keys).agg(F.sum("good").alias("__good"))
    n, c = F.sum("__c").cast("double"), F.col("__c").cast("double")
    pairs = sides["y"].groupBy(*keys).agg(((n * n - F.sum(c * c)) / 2).alias("__pairs"))
    return joined(pairs, good, keys).select(*keys, F.when(F.col("__pairs") > 0, F.col("__good") / F.col("__pairs")).alias("ci"))


def approximate_concordance(df: DataFrame, id_col: str, y: str, p: str, pairs: int = 200_000, seed: int = 0) -> DataFrame:
    """Concordance over pairs of rows drawn by hash: every row meets, in each of some rounds, the next row of a seeded hash order in its bucket."""
    seen = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(id_col, F.col(y).alias("__y"), F.col(p).alias("__p"))
    n = max(seen.count(), 1)
    rounds = max(1, -(-pairs // n))
    drawn = seen.withColumn("__round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("__h", F.xxhash64(F.lit(seed), "__round", id_col))
    w = Window.partitionBy("__round", F.pmod("__h", F.lit(max(1, n // 1000)))).orderBy("__h", id_col)
    met = drawn.withColumns({"__y2": F.lead("__y").over(w), "__p2": F.lead("__p").over(w)}).where("__y2 is not null and __y <> __y2")
    agree = (F.col("__y") - F.col("__y2")) * (F.col("__p") - F.col("__p2"))
    return met.agg(F.count("*").alias("n_pairs"), F.avg(F.when(agree > 0, 1.0).when(agree == 0, 0.5).otherwise(0.0)).alias("ci"))
