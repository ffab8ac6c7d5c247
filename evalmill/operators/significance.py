"""Paired significance over seeds, and case mining."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def t_tail(t: float, freedom: int) -> float:
    """Two-sided p-value of Student's t by integrating its density (Simpson's rule on a bounded variable)."""
    if not math.isfinite(t):
        return 0.0
    # P(|T| > t) = I_x(v/2, 1/2) with x = v / (v + t^2); in the angle a the density is cos(a)^(v-1).
    limit, n = math.atan(abs(t) / math.sqrt(freedom)), 2000
    a = np.linspace(0, limit, n + 1)
    f = np.cos(a) ** (freedom - 1)
    inner = limit / n / 3 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum())
    whole = math.sqrt(math.pi) * math.exp(math.lgamma(freedom / 2) - math.lgamma((freedom + 1) / 2)) / 2
    return max(0.0, min(1.0, 1 - inner / whole))


def signed_rank(d: np.ndarray) -> tuple[float, float]:
    """Wilcoxon's statistic (smaller rank sum) and two-sided p-value: exact by counting up to 25 untied values, else normal."""
    d = d[d != 0]
    n = len(d)
    if not n:
        return 0.0, 1.0
    size = np.abs(d)
    _, inverse, counts = np.unique(size, return_inverse=True, return_counts=True)
    last = np.cumsum(counts)
    ranks = (last - (counts - 1) / 2)[inverse]
    plus = float(ranks[d > 0].sum())
    low = min(plus, n * (n + 1) / 2 - plus)
    if n <= 25 and (counts == 1).all():
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return low, float(min(1.0, 2 * ways[: int(low) + 1].sum() / 2**n))
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - float((counts**3 - counts).sum()) / 48)
    return low, math.erfc(abs(low - n * (n + 1) / 4) / spread / math.sqrt(2)) if spread else 1.0


def paired_tests(df: DataFrame, keys: list[str], seed: str, model: str, metric: str, primary: str, baseline: str) -> DataFrame:
    """Per group: seeds in both, mean difference, paired t and signed-rank p-values (null under two seeds)."""
    own = df.where(F.col(model).isin(primary, baseline)).groupBy(*keys, seed).pivot(model, [primary, baseline]).agg(F.avg(metric))
    both = own.dropna(subset=[primary, baseline]).groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(primary) - F.col(baseline))).alias("d"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d in (np.asarray(x, float) for x in pdf.pop("d")):
                n, mean = len(d), float(d.mean())
                dev = float(d.std(ddof=1)) if n > 1 else math.nan
                t = mean / (dev / math.sqrt(n)) if n > 1 and dev > 0 else math.copysign(math.inf, mean) if n > 1 and mean else 0.0
                rows.append((n, mean, t_tail(t, n - 1) if n > 1 else None, signed_rank(d)[1] if n > 1 else None))
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(rows, columns=["n", "mean_delta", "p_t", "p_wilcoxon"])], axis=1)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema.fields if f.name in keys)
    return both.mapInPandas(run, f"{kinds}, n long, mean_delta double, p_t double, p_wilcoxon double")


def cases(df: DataFrame, keys: list[str], id_col: str, model: str, y: str, p: str, n: int, wide: float = 1.0) -> DataFrame:
    """Rows worth a look, by kind: the n largest errors and the n most confident wrong decisions of each model, the n widest disagreements between models.

    Models disagree where they decide differently or their predictions are ``wide`` or more apart.
    """
    error = df.withColumn("size", F.abs(F.col(p) - F.col(y)))
    wrong = error.where((F.col(p) >= 0.5).cast("int") != F.col(y)).withColumn("size", F.abs(F.col(p) - 0.5))
    spread = df.groupBy(*keys, id_col).agg((F.max(p) - F.min(p)).alias("size"), F.count_distinct(F.col(p) >= 0.5).alias("__classes")).where((F.col("__classes") > 1) | (F.col("size") >= wide)).drop("__classes")

    def top(d: DataFrame, by: list[str], kind: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(F.desc("size"), id_col)
        name = F.col(model) if model in d.columns else F.lit(None).cast("string")
        return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(*keys, id_col, name.alias(model), F.lit(kind).alias("kind"), "rank", "size")

    return top(error, [*keys, model], "error").unionByName(top(wrong, [*keys, model], "decision")).unionByName(top(spread, keys, "disagreement"))
