"""Linear models and the fusion of probability columns, through Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_order, hash_unit, ranked
from .metrics import ranking

GRID = tuple(i / 20 for i in range(21))


def hashed_vectors(df: DataFrame, items: dict[str, str], buckets: int) -> DataFrame:
    """Adds a sparse vector of length 1 for each named array column: counts of its items by hash bucket; the zero vector for none and for null.

    ``items`` maps a new column to the array it comes from. The vectors stay
    sparse up to the fit.
    """
    for name, column in items.items():
        ready = df.withColumn("__items", F.coalesce(F.array_compact(F.col(column).cast("array<string>")), F.array().cast("array<string>")))
        counted = HashingTF(numFeatures=buckets, inputCol="__items", outputCol="__counts").transform(ready)
        df = Normalizer(p=2.0, inputCol="__counts", outputCol=name).transform(counted).drop("__items", "__counts")
    return df


def gate_features(df: DataFrame, p: str, q: str, stats: list[str], masks: list[str]) -> DataFrame:
    """Adds a vector ``features``: both probabilities, signed and absolute gap, neighbour statistics, masks, missing count."""
    missing = F.lit(len(masks)) - sum([F.col(m) for m in masks], F.lit(0))
    wide = df.withColumns({"__gap": F.col(q) - F.col(p), "__abs": F.abs(F.col(q) - F.col(p)), "__missing": missing.cast("double")})
    return VectorAssembler(inputCols=[p, q, "__gap", "__abs", *stats, *masks, "__missing"], outputCol="features").transform(wide).drop("__gap", "__abs", "__missing")


def reliability_features(df: DataFrame, p: str, q: str, gate: str, stats: list[str], masks: list[str], name: str = "reliability") -> DataFrame:
    """Adds a vector: both probabilities, the gated one, the gate's weight of ``p``, disagreement, confidence, neighbour statistics, masks, missing count."""
    gated = F.col(gate) * F.col(p) + (1 - F.col(gate)) * F.col(q)
    missing = F.lit(len(masks)) - sum([F.col(m) for m in masks], F.lit(0))
    wide = df.withColumns({"__gated": gated, "__abs": F.abs(F.col(p) - F.col(q)), "__sure": F.abs(gated - 0.5) * 2, "__missing": missing.cast("double")})
    return VectorAssembler(inputCols=[p, q, "__gated", gate, "__abs", "__sure", *stats, *masks, "__missing"], outputCol=name).transform(wide).drop("__gated", "__abs", "__sure", "__missing")


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight``: n / (2 * rows of the label)."""
    n = df.groupBy(label).agg(F.count("*").alias("__n"))
    total = n.agg(F.sum("__n").alias("__all"))
    return df.join(F.broadcast(n), label).join(F.broadcast(total)).withColumn("weight", F.col("__all") / (2.0 * F.col("__n"))).drop("__n", "__all")


def fit_classifier(df: DataFrame, label: str = "label", c: float = 1.0, least: int = 6, least_per_class: int = 2, features: str = "features"):
    """A class-balanced logistic regression on a vector; None where rows or classes are too few."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    if sum(counts.values()) < least or len(counts) < 2 or min(counts.values()) < least_per_class:
        return None
    model = LogisticRegression(featuresCol=features, labelCol=label, weightCol="weight", regParam=1 / (c * sum(counts.values())), standardization=False, maxIter=40)
    rows = balanced_weights(df, label).select(features, label, "weight").persist()
    fitted = model.fit(rows)
    rows.unpersist()
    return fitted


def predict(model, df: DataFrame, name: str, fallback: Column) -> DataFrame:
    """Adds the probability of 1, or the fallback where there is no model."""
    if model is None:
        return df.withColumn(name, fallback)
    return model.transform(df).withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def fold_of(df: DataFrame, label: str, order: list[str], folds: int, seed: int = 0) -> DataFrame:
    """Adds ``fold``, stratified: the place in a hash order inside each label, modulo the number of folds."""
    placed = ranked(df.withColumn("__unit", hash_unit(seed, *order)), [label], "__unit", *order, name="__place", order=F.asc(hash_order(seed, *order)))
    return placed.withColumn("fold", F.pmod(F.col("__place") - 1, F.lit(folds)).cast("int")).drop("__unit", "__place")


def dealt(df: DataFrame, label: str, order: list[str], folds: int = 3, seed: int = 0) -> tuple[DataFrame, int]:
    """``df`` with a column fold, and the number of folds: no more than rows of the smaller class, 0 where that is under two."""
    counts = [r[1] for r in df.groupBy(label).count().collect()]
    folds = min(folds, *counts) if len(counts) == 2 else 0
    if folds < 2:
        return df.withColumn("fold", F.lit(0)), 0
    return fold_of(df, label, order, folds, seed), folds


def fit_folds(df: DataFrame, label: str, folds: int, c: float = 1.0) -> list[tuple]:
    """Per fold a class-balanced classifier of the other folds and a sigmoid of its margin, fitted on the fold."""
    fitted = []
    for f in range(folds):
        model = fit_classifier(df.where(F.col("fold") != f), label, c)
        if model is not None:
            held = model.transform(df.where(F.col("fold") == f)).select(label, F.array(vector_to_array("rawPrediction")[1]).alias("m"))
            fitted.append((model, LogisticRegression(featuresCol="m", labelCol=label, maxIter=40).fit(held.select(label, array_to_vector("m").alias("m")))))
    return fitted


def fit_calibrated(df: DataFrame, label: str, order: list[str], folds: int = 3, c: float = 1.0, seed: int = 0) -> list[tuple]:
    """``fit_folds`` over a table that is dealt for it; empty where that can't be."""
    rows, folds = dealt(df, label, order, folds, seed)
    rows = rows.persist()
    fitted = fit_folds(rows, label, folds, c)
    rows.unpersist()
    return fitted


def predict_calibrated(models: list[tuple], df: DataFrame, name: str) -> DataFrame:
    """Adds the mean of the calibrated probabilities; 0.5 where there is no model."""
    out, parts = df, []
    for i, (model, sigmoid) in enumerate(models):
        slope, bias = float(sigmoid.coefficients[0]), float(sigmoid.intercept)
        margin = vector_to_array("rawPrediction")[1]
        out = model.transform(out).withColumn(f"__p{i}", 1 / (1 + F.exp(-(slope * margin + bias)))).drop("rawPrediction", "probability", "prediction")
        parts.append(F.col(f"__p{i}"))
    mean = sum(parts[1:], parts[0]) / len(parts) if parts else F.lit(0.5)
    return out.withColumn(name, mean).drop(*[f"__p{i}" for i in range(len(models))])


def cross_fitted(df: DataFrame, label: str, order: list[str], folds: int = 3, seed: int = 0, name: str = "p", c: float = 1.0, features: str = "features", by: str | None = None, to_mean: bool = False) -> DataFrame:
    """Each row's probability from the model of the other folds, dealt by the label or by ``by``; where a fold can't be fitted 0.5, or the mean label of the other folds."""
    dealt, out = fold_of(df, by or label, order, folds, seed), None
    for f in range(folds):
        others = dealt.where(F.col("fold") != f)
        model = fit_classifier(others, label, c, features=features)
        mean = others.agg(F.avg(label)).first()[0] if to_mean and model is None else None
        part = predict(model, dealt.where(F.col("fold") == f), name, F.lit(0.5 if mean is None else float(mean)))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def blend_scores(df: DataFrame, keys: list[str], y: str, p: str, q: str, grid: tuple[float, ...] = GRID) -> DataFrame:
    """Average precision of (1-a)p + aq for every weight a of the grid."""
    spread = df.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in grid]))).withColumn("blend", F.round((1 - F.col("alpha")) * F.col(p) + F.col("alpha") * F.col(q), 12))
    return ranking(spread, [*keys, "alpha"], y, "blend")


def blend_weight(df: DataFrame, keys: list[str], y: str, p: str, q: str, grid: tuple[float, ...] = GRID) -> DataFrame:
    """Per group the weight of highest average precision, on ties the one nearest to 0.5, then the smaller."""
    scored = blend_scores(df, keys, y, p, q, grid).withColumn("r", F.round("ap", 9))
    order = F.struct("r", -F.abs(F.col("alpha") - 0.5), -F.col("alpha"))
    return scored.groupBy(*keys).agg(F.max_by("alpha", order).alias("alpha"), F.max("r").alias("ap"))


def best_candidate(df: DataFrame, keys: list[str], model: str, order: str, y: str = "y", p: str = "p") -> DataFrame:
    """Per group the model of highest average precision, the first in order on ties."""
    scored = ranking(df, [*keys, model, order], y, p).withColumn("r", F.round("ap", 9))
    return scored.groupBy(*keys).agg(F.max_by(model, F.struct("r", -F.col(order))).alias(model), F.max("r").alias("ap"))


def monotonic_bridge(train: DataFrame, df: DataFrame, x: str, y: str, name: str = "bridged") -> DataFrame:
    """An isotonic map from score to measurement, held flat outside the range; the mean measurement where fewer than two scores differ."""
    seen = train.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if seen.select(x).distinct().limit(2).count() < 2:
        mean = seen.agg(F.avg(y)).first()[0]
        return df.withColumn(name, F.lit(mean).cast("double"))
    model = IsotonicRegression(featuresCol=x, labelCol=y, predictionCol=name).fit(seen.select(x, y))
    return model.transform(df)


def ridge(train: DataFrame, label: str, alpha: float):
    """Ridge regression with the penalty ``alpha`` of the closed form (Spark divides its own by the label's deviation)."""
    n, dev = train.agg(F.count("*"), F.stddev_pop(label)).first()
    return LinearRegression(labelCol=label, regParam=alpha * (dev or 1.0) / max(n, 1), elasticNetParam=0.0, standardization=False, solver="normal").fit(train)


def neighbour_regression(near: DataFrame, values: DataFrame, id_col: str, value: str) -> DataFrame:
    """Per query the similarity-weighted mean of its neighbours' values; their plain mean where all similarities are 0."""
    joined = near.join(values.select(F.col(id_col).alias("ref_id"), F.col(value).alias("v")), "ref_id")
    w = F.sum("sim")
    return joined.groupBy("query_id").agg(F.when(w > 0, F.sum(F.col("sim") * F.col("v")) / w).otherwise(F.avg("v")).alias("predicted"))


def arbitration_target(y: str, current: str, retrieved: str) -> Column:
    """1 where the current probability has a lower or equal squared error."""
    def err(p: str) -> Column:
        return (F.col(p) - F.col(y)) * (F.col(p) - F.col(y))

    return (err(current) <= err(retrieved)).cast("double")


def arbitrated(val: DataFrame, df: DataFrame, order: list[str], anchor: str = "anchor", y: str = "y", current: str = "current", retrieved: str = "retrieved", folds: int = 3, seed: int = 0, *, stats: list[str], masks: list[str]) -> tuple[DataFrame, float]:
    """Conflict-aware arbitration, fitted on ``val`` and applied to ``df``.

    Both tables have a vector ``features`` (``gate_features``), the columns of
    ``stats`` and ``masks`` and a column ``anchor``. A gate learns which
    probability to trust. A probe learns how reliable the gate's choice is, from
    ``reliability_features`` of that choice. Both are cross-fitted on ``val``, in
    folds stratified by ``y`` and no more than the rows of its smaller class, so
    that the anchor's strength (21 values, smallest Brier score, then the
    smallest) is chosen on rows not trained on; under two folds the gate is 0.5
    and the trust the share of right choices.
    Returns ``df`` with full, no_gate, no_probe and no_anchor, and the strength.
    """
    def mixed(gate: Column, trust: Column, strength: Column | float, use_gate: bool = True) -> Column:
        g = gate if use_gate else F.lit(0.5)
        fused = g * F.col(current) + (1 - g) * F.col(retrieved)
        s = strength * (1 - trust)
        return (1 - s) * fused + s * F.col(anchor)

    def judged(rows: DataFrame) -> DataFrame:
        return reliability_features(rows, current, retrieved, "__gate", stats, masks, "__reliability")

    def mean_of(rows: DataFrame, column: str) -> float:
        mean = rows.agg(F.avg(column)).first()[0]
        return 0.5 if mean is None else float(mean)

    # The fits read these small tables many times; persisted rows can be computed anew if an executor is lost.
    target = val.withColumn("__gate_y", arbitration_target(y, current, retrieved)).persist()
    counts = [r[1] for r in target.groupBy(y).count().collect()]
    folds = min(folds, *counts) if len(counts) == 2 else 0
    gated = cross_fitted(target, "__gate_y", order, folds, seed, "__gate", 0.5, by=y, to_mean=True).drop("fold") if folds > 1 else target.withColumn("__gate", F.lit(0.5))
    right = ((F.col("__gate") * F.col(current) + (1 - F.col("__gate")) * F.col(retrieved) >= 0.5).cast("double") == F.col(y)).cast("double")
    gated = judged(gated).withColumn("__right", right).persist()
    usual = F.lit(mean_of(gated, "__right"))
    probed = cross_fitted(gated, "__right", order, folds, seed + 1, "__trust", 0.5, "__reliability", y, True) if folds > 1 else gated.withColumn("__trust", usual)
    tried = probed.persist().withColumn("strength", F.explode(F.array(*[F.lit(g) for g in GRID]))).withColumn("__p", mixed(F.col("__gate"), F.col("__trust"), F.col("strength")))
    scored = tried.groupBy("strength").agg(F.round(F.avg((F.col("__p") - F.col(y)) * (F.col("__p") - F.col(y))), 12).alias("brier"))
    best = scored.agg(F.min_by("strength", F.struct("brier", "strength"))).first()[0]
    strength = 0.0 if best is None else float(best)
    gate, probe = fit_classifier(target, "__gate_y", 0.5), fit_classifier(gated, "__right", 0.5, features="__reliability")
    out = predict(probe, judged(predict(gate, df, "__gate", F.lit(mean_of(target, "__gate_y")))), "__trust", usual)
    g, t = F.col("__gate"), F.col("__trust")
    made = {"full": mixed(g, t, strength), "no_gate": mixed(g, t, strength, False), "no_probe": mixed(g, F.lit(0.5), strength), "no_anchor": mixed(g, t, 0.0)}
    return out.withColumns(made).drop("__gate", "__trust", "__reliability"), strength
