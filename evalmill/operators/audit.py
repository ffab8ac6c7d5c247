"""Composed reports: conflict, reliability, diagnostics, components, thresholds, verdicts.

Run tables are long: key columns of a run, a model name, metric columns. They
have a row per run and model; predictions have a row per sample and model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics, report
from .common import joined, quantiles


def conflict_report(df: DataFrame, keys: list[str], id_col: str, y: str, current: str, retrieved: str, fused: list[str], bins: int = 4) -> tuple[DataFrame, DataFrame]:
    """How models do where two of them disagree: metrics per run, conflict bin and model, and the binned samples.

    ``df`` has a probability column per model. Rows that lack the label or either
    of the two probabilities are left out; bins have equal counts inside a run.
    The gain is the current model's Brier score less the model's own on the rows that both have.
    """
    seen = df.where(F.col(y).isNotNull() & F.col(current).isNotNull() & F.col(retrieved).isNotNull()).withColumn("conflict", F.abs(F.col(current) - F.col(retrieved)))
    binned = report.equal_bins(seen, keys, "conflict", [id_col], bins).withColumnRenamed("bin", "conflict_bin")
    models = list(dict.fromkeys([current, retrieved, *fused]))
    base = binned.withColumns({"__current": F.col(current).cast("double"), **{m: F.col(m).cast("double") for m in models}})
    long = base.unpivot([*keys, id_col, y, "conflict", "conflict_bin", "__current"], models, "model", "p").where("p is not null")
    by = [*keys, "conflict_bin", "model"]
    err = (F.col("__current") - F.col(y)) * (F.col("__current") - F.col(y))
    sums = long.groupBy(*by).agg(F.avg("conflict").alias("mean_conflict"), F.avg("__current").alias("mean_current"), F.avg("p").alias("mean_p"), F.avg(err).alias("current_brier"))
    sums = joined(sums, quantiles(long, by, "conflict", {"median_conflict": 0.5}), by, "left")
    out = joined(sums, metrics.evaluate(long, by, id_col, y), by).withColumn("brier_gain", F.col("current_brier") - F.col("brier"))
    family = F.when(F.col("model") == current, "current").when(F.col("model") == retrieved, "retrieved").otherwise("fused")
    return out.withColumn("family", family), binned.select(*keys, id_col, y, F.col(current).alias("current_p"), F.col(retrieved).alias("retrieved_p"), "conflict", "conflict_bin")


def pooled(per_run: DataFrame, keys: list[str], run: str, columns: list[str]) -> DataFrame:
    """Runs, rows, and mean, population deviation and half-width of each metric over the runs of a group."""
    counted = per_run.groupBy(*keys).agg(F.count_distinct(run).alias("runs"), F.sum("n").alias("total_n"))
    return joined(counted, report.summary(per_run, keys, columns), keys)


def reliability(df: DataFrame, keys: list[str], id_col: str, y: str = "y", p: str = "p") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metrics, calibration table and risk-coverage curve of every group of predictions."""
    return metrics.evaluate(df, keys, id_col, y, p), metrics.calibration(df, keys, y, p), metrics.risk_coverage(df, keys, id_col, y, p)


def failure_diagnostics(runs: DataFrame, keys: list[str], model: str, fixed: str, simple: list[str], density: DataFrame | None = None, metric: str = "ap", tie: str = "auroc", chosen_by: str = "val_ap") -> DataFrame:
    """Per run with the fixed model: its metric beside the best simple model, the best of all and the one that validation would choose.

    Nulls rank last, ties go to the smaller name; ``density`` has one row of sizes per run.
    """
    def last(c: str) -> Column:
        return F.coalesce(F.col(c).cast("double"), F.lit(float("-inf")))

    def best(where: Column, *order: str) -> Column:
        return F.min(F.when(where, F.struct(*[(-last(c)).alias(c) for c in order], F.col(model).alias("name"), F.col(metric).alias("value"))))

    every = F.lit(True)
    found = runs.groupBy(*keys).agg(
        F.max(F.when(F.col(model) == fixed, F.struct(F.col(metric).alias("value"), F.col(tie).alias("tie")))).alias("f"),
        best(F.col(model).isin(simple), metric, tie).alias("s"), best(every, metric, tie).alias("b"), best(every, chosen_by, metric).alias("v"),
    ).where("f is not null")
    own = F.col("f.value")
    out = found.select(
        *keys, F.lit(fixed).alias("fixed_model"), own.alias(f"fixed_{metric}"), F.col("f.tie").alias(f"fixed_{tie}"),
        F.col("s.name").alias("best_simple_model"), F.col("s.value").alias(f"best_simple_{metric}"), (own - F.col("s.value")).alias("fixed_minus_best_simple"),
        F.col("b.name").alias("best_model"), F.col("b.value").alias(f"best_{metric}"), (own - F.col("b.value")).alias("fixed_minus_best"),
        F.col("v.name").alias("val_best_model"), F.col("v.value").alias(f"val_best_{metric}"),
    )
    return out if density is None else joined(out, density, keys, "left")


def component_summary(runs: DataFrame, split: str, seed: str, model: str, order: str, columns: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of repeated runs (split, seed, model) the last in order; then mean, sample deviation and interval per split and model, and over the split means."""
    last = runs.groupBy(split, seed, model).agg(F.max_by(F.struct(*columns), order).alias("m")).select(split, seed, model, "m.*")
    per = report.summary(last, [split, model], columns, sample=True)
    half = {f"{end}_{c}": F.col(f"mean_{c}") + sign * F.col(f"ci95_{c}") for c in columns for end, sign in (("low", -1), ("high", 1))}
    over = report.summary(last.groupBy(split, model).agg(*[F.avg(c).alias(c) for c in columns]), [model], columns, sample=True)
    return last, per.withColumns(half), over


def component_deltas(runs: DataFrame, keys: list[str], model: str, metric: str, steps: dict[str, tuple[str, str]]) -> DataFrame:
    """Per group and named step: the metric of the first model less that of the second; null where one is missing."""
    names = sorted({m for pair in steps.values() for m in pair})
    value = {m: F.max(F.when(F.col(model) == m, F.col(metric))) for m in names}
    wide = runs.groupBy(*keys).agg(*[value[a].alias(f"__a_{s}") for s, (a, _) in steps.items()], *[value[b].alias(f"__b_{s}") for s, (_, b) in steps.items()])
    rows = F.array(*[F.struct(F.lit(s).alias("step"), (F.col(f"__a_{s}") - F.col(f"__b_{s}")).alias("delta")) for s in steps])
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def threshold_grid(df: DataFrame, keys: list[str], part: str, id_col: str, value: str, p: str, thresholds: list[float], test: str = "test") -> tuple[DataFrame, DataFrame]:
    """Every threshold relabels every run: metrics of the test part, and the runs left out because a part has one class.

    keys name a run (split mode, seed); ``part`` is train, val or test. Rows
    without a value take no part.
    """
    spread = df.where(F.col(value).isNotNull()).withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).withColumn("y", (F.col(value) >= F.col("threshold")).cast("int"))
    by = [*keys, "threshold"]
    parts = spread.groupBy(*by, part).agg((1 + (F.max("y") > F.min("y")).cast("int")).alias("classes"), F.count("*").alias("n"), F.avg("y").alias("prevalence"))
    failed = parts.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("classes") < 2, F.col(part)))), ",").alias("one_class_in")).where("one_class_in <> ''")
    valid = joined(spread.where(F.col(part) == test), failed.select(*by, F.lit(True).alias("__bad")), by, "left").where("__bad is null").drop("__bad")
    return metrics.evaluate(valid, by, id_col, "y", p), failed


def ranks_across(runs: DataFrame, condition: list[str], model: str, metric: str) -> DataFrame:
    """Per model: conditions, mean rank (ties averaged) and the number of conditions where it comes first."""
    placed = report.average_rank(runs.where(F.col(metric).isNotNull()), condition, metric).withColumn("__first", F.rank().over(Window.partitionBy(*condition).orderBy(F.desc(metric))) == 1)
    return placed.groupBy(model).agg(F.count("*").alias("n_conditions"), F.avg("rank").alias("mean_rank"), F.count_if("__first").alias("n_first"))


def verdict(coverage: DataFrame, overlaps: DataFrame, cold: dict[str, str], registry: DataFrame) -> DataFrame:
    """One row that passes or fails a benchmark: incomplete fetch groups, common keys of cold splits, runs and missing predictions.

    ``overlaps`` is ``split.overlap`` with a column mode; ``cold`` names the
    entity that a mode keeps apart from train. ``registry`` has a boolean
    ``predictions_present`` per run.
    """
    pairs = F.create_map(*[F.lit(x) for item in cold.items() for x in item]) if cold else F.create_map().cast("map<string,string>")
    broken = overlaps.where((F.try_element_at(pairs, F.col("mode")) == F.col("entity")) & (F.col("first") == "train") & (F.col("n_common") > 0))
    fetched = coverage.agg(F.count("*").alias("fetch_groups"), F.count_if(~F.coalesce("complete", F.lit(False))).alias("incomplete_groups"), F.min("ratio").alias("least_coverage"))
    runs = registry.agg(F.count("*").alias("runs"), F.coalesce(F.bool_and("predictions_present"), F.lit(True)).alias("all_predictions"))
    one = joined(joined(fetched, broken.agg(F.count("*").alias("violations")), []), runs, [])
    return one.withColumn("status", F.when((F.col("violations") > 0) | (F.col("incomplete_groups") > 0), "fail").otherwise("pass"))


def external_report(runs: DataFrame, condition: list[str], part: str, model: list[str], seed: str, columns: list[str], order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs of other frameworks: a summary per condition, part and model, the best model of each condition and part, and what each model covers."""
    by = [*condition, part, *model]
    seeds = F.array_join(F.transform(F.array_sort(F.collect_set(F.col(seed).cast("int"))), lambda s: s.cast("string")), ",").alias("seeds")
    summary = joined(runs.groupBy(*by).agg(F.count("*").alias("runs"), seeds), report.summary(runs, by, columns), by)
    best = report.best_per(summary, [*condition, part], *[F.desc_nulls_last(f"mean_{c}") for c in order], *[F.asc(m) for m in model])
    covered = runs.groupBy(*condition, *model).agg(F.count("*").alias("runs"), seeds, report.distinct_list(part).alias("parts"))
    return summary, best, covered


def leaderboard(runs: DataFrame, order: list[str], model: str) -> DataFrame:
    """The models of one run by falling metrics, nulls last, with their place; a row per model."""
    return runs.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(*[F.desc_nulls_last(c) for c in order], F.asc(model))))


def main_table(runs: DataFrame, labels: dict[str, str], keys: list[str], model: str, seed: str, columns: list[str]) -> DataFrame:
    """Runs of the models that have a display label: runs, mean and sample deviation per group."""
    names = F.create_map(*[F.lit(x) for item in labels.items() for x in item])
    shown = runs.where(F.col(model).isin(list(labels))).withColumn("model_label", names[F.col(model)])
    stats = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return shown.groupBy(*keys, model, "model_label").agg(F.count_distinct(seed).alias("n_runs"), *stats)
