import math

import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from evalmill.functions import text as T
from evalmill.operators import fuse, retrieve, split, suite
from evalmill.operators.common import cut

EVERY = suite.Roles("joint", ("m1", "m2"), (("a", "va"), ("b", "vb")), "s", "bits", "e1", "e2", "et", "other")


def rows_of(spark):
    def wave(i, j):
        return F.sin(F.col("id") * (0.7 + 0.31 * i) + j)

    df = spark.range(90).withColumn("y", ((wave(0, 0) + 0.6 * wave(1, 1)) > 0).cast("int"))
    df = df.withColumns({"va": F.array(*[wave(0, j) for j in range(3)]), "vb": F.array(*[wave(1, j) for j in range(3)]), "m1": F.lit(1), "m2": (F.col("id") % 5 > 0).cast("int")})
    df = df.withColumns({"vb": F.when(F.col("m2") == 1, F.col("vb")).otherwise(F.array().cast("array<double>")), "s": F.array(F.floor(3 * wave(0, 0)).cast("string"), F.floor(3 * wave(1, 1)).cast("string"))})
    return split.split_random(df, ["id"], seed=4, train=0.5, val=0.25)


def told(df, *names):
    return {(r.id, r.split): tuple(round(r[n], 9) for n in names) for r in df.collect()}


def test_every_variant_has_its_place():
    table = suite.standard_variants(EVERY)
    variants = [n for n, v in table.items() if not isinstance(v, suite.Evidence)]
    assert len(variants) >= 35
    order = [n for level in suite.levels(table) for n in level]
    assert sorted(order) == sorted(table) and order[-1] == "fullsuite_val_select"
    for name in table:
        assert all(order.index(n) < order.index(name) for n in suite.needs(table[name], table))
    few = suite.standard_variants(suite.Roles("joint", ("m1",), (("a", "va"),)))
    assert "hybrid_blend_avg" not in few and "full" in few and suite.levels(few)
    assert set(suite.short_suite(("gated_retrieval",), few)) == {"views", "mask", "multiview_retrieval", "gated_retrieval"}


def test_circles_and_unknown_names_raise():
    with pytest.raises(ValueError, match="circle"):
        suite.levels({"a": suite.Blend("b", "b"), "b": suite.Blend("a", "a")})
    with pytest.raises(ValueError, match="nothing"):
        suite.levels({"a": suite.Blend("nothing", "nothing")})


def test_gate_and_arbitration_equal_a_hand_made_run(spark):
    df, masks = cut(rows_of(spark)), ("m1", "m2")
    # Out of order on purpose: the graph sorts itself.
    table = {
        "full": suite.Arbitrated("plain", "evidence", ("views",), masks),
        "flat": suite.Arbitrated("plain", "evidence", ("views",), masks, "no_gate"),
        "gate": suite.Gate("plain", "evidence", ("sets",), masks),
        "evidence": suite.Features(("views", "sets")),
        "plain": suite.Features(("va", "m1", "m2")),
        "views": suite.Views((("b", "vb"),), 5),
        "sets": suite.SetNeighbours("s", 5),
    }
    got = suite.run_suite(df, "id", "y", table, folds=2).groupBy("id", "split", "y").pivot("model", ["plain", "evidence", "gate", "full", "flat"]).agg(F.first("p"))

    train = df.where("split = 'train'")
    by_hand = df.withColumn("label", F.col("y").cast("double"))
    for name, found in (("views_b", retrieve.cosine_top_k(df.where(F.size("vb") > 0), train.where(F.size("vb") > 0), "id", "vb", 5)), ("sets", retrieve.set_top_k(df, train, "id", "s", 5, fill=True))):
        stats = retrieve.label_summary(df, found, train, "id", "y").withColumnRenamed("query_id", "id")
        by_hand = cut(by_hand.join(stats.withColumnsRenamed({s: f"{name}_{s}" for s in suite.STATISTICS}), "id"))
    views, sets = [f"views_b_{s}" for s in suite.STATISTICS], [f"sets_{s}" for s in suite.STATISTICS]
    rest = by_hand.where("split <> 'train'")
    for name, columns in (("plain", ("va", "m1", "m2")), ("evidence", (*views, *sets))):
        models = fuse.fit_calibrated(suite.as_vector(by_hand.where("split = 'train'"), columns).select("id", "label", "features"), "label", ["id"], 2)
        rest = cut(fuse.predict_calibrated(models, suite.as_vector(rest, columns), name).drop("features"))
    ready = fuse.gate_features(rest, "plain", "evidence", sets, list(masks))
    gate = fuse.fit_classifier(ready.where("split = 'val'").select("label", "features"), "label", 0.5)
    rest = cut(fuse.predict(gate, ready, "gate", F.lit(None)).drop("features"))
    prior = train.agg(F.avg("y")).first()[0]
    ready = fuse.gate_features(rest.withColumns({"anchor": F.lit(prior), "yy": F.col("label")}), "plain", "evidence", views, list(masks))
    made, _ = fuse.arbitrated(ready.where("split = 'val'"), ready, ["id"], "anchor", "yy", "plain", "evidence", stats=views, masks=list(masks))
    names = ("plain", "evidence", "gate", "full", "flat")
    assert told(got, *names) == told(cut(made.withColumn("flat", F.col("no_gate")).select("id", "split", *names)), *names)


def test_a_row_in_two_parts_and_small_validation(spark):
    df = rows_of(spark)
    blank = df.where("split = 'test'").withColumns({"split": F.lit("missing"), "vb": F.array().cast("array<double>"), "m2": F.lit(0)})
    few = df.where("split <> 'val'").unionByName(df.where("split = 'val'").limit(3)).unionByName(blank)
    table = {"views": suite.Views((("b", "vb"),), 5), "one": suite.Features(("va", "m2")), "two": suite.Features(("views",)), "gate": suite.Gate("one", "two", ("views",), ("m1", "m2")), "given": suite.Given("m2")}
    got = suite.run_suite(few, "id", "y", table, folds=2).collect()
    parts = {}
    for r in got:
        parts.setdefault((r.split, r.model), {})[r.id] = r.p
    assert len(parts["test", "gate"]) == len(parts["missing", "gate"]) and len(parts["val", "one"]) == 3
    # Under six rows the gate is the tuned blend of its two sides.
    for r in parts["test", "gate"]:
        low, high = sorted((parts["test", "one"][r], parts["test", "two"][r]))
        assert low - 1e-9 <= parts["test", "gate"][r] <= high + 1e-9
    assert any(not math.isclose(parts["test", "two"][r], parts["missing", "two"][r]) for r in parts["test", "two"])
    assert set(parts["missing", "given"].values()) == {0.0}


def test_bridge_of_constant_scores_is_the_mean(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0), (None, 9.0)], "x double, y double")
    assert {r.bridged for r in fuse.monotonic_bridge(df, df.where("x is not null"), "x", "y").collect()} == {3.0}
    assert {r.bridged for r in fuse.monotonic_bridge(df.limit(0), df, "x", "y").collect()} == {None}


def test_sparse_vectors_reach_a_fit(spark):
    """Characters and words hashed (F1, F2), joined with masks (F3), in a suite."""
    texts = [(i, f"{'bright' if i % 2 else 'dull'} thing number {i % 7}", i % 2, int(i % 3 > 0)) for i in range(80)] + [(80, None, 0, 0), (81, "", 1, 0)]
    df = spark.createDataFrame(texts, "id long, text string, y int, mask int")
    df = df.withColumn("split", F.when(F.col("id") % 4 < 2, "train").when(F.col("id") % 4 == 2, "val").otherwise("test"))
    ready = df.withColumns({"chars": T.char_ngrams(F.col("text"), 2, 3), "words": T.word_ngrams(F.col("text"), 1, 2)})
    ready = cut(fuse.hashed_vectors(ready, {"c": "chars", "w": "words"}, 1 << 12).drop("chars", "words"))
    joint = suite.as_vector(ready, ("c", "w", "mask"))
    rows = {r.id: r for r in joint.collect()}
    assert rows[0].features.size == 2 * (1 << 12) + 1 and isinstance(rows[0].features, SparseVector)
    assert abs(rows[0].c.norm(2) - 1) < 1e-12 and rows[80].c.numNonzeros() == rows[81].w.numNonzeros() == 0
    # Equal up to the buckets' numbers: counts of distinct grams over their length.
    for i in (0, 5):
        words = texts[i][1].split()
        grams = words + [" ".join(x) for x in zip(words, words[1:])]
        assert sorted(rows[i].w.values) == pytest.approx([1 / math.sqrt(len(grams))] * len(grams))
    got = suite.run_suite(ready, "id", "y", {"m": suite.Features(("c", "w", "mask"))}, folds=2).where("split = 'test' and id < 80").collect()
    assert all((r.p > 0.5) == (r.y == 1) for r in got) and len(got) == 20


def test_regression_of_clean_and_blanked_rows(spark):
    df = spark.range(60).withColumns({"v": 2.0 * F.col("id") + 1, "x": F.col("id").cast("double")}).withColumn("split", F.when(F.col("id") % 3 == 0, "train").when(F.col("id") % 3 == 1, "val").otherwise("test"))
    blank = df.where("split = 'test'").withColumns({"split": F.lit("missing"), "x": F.lit(0.0)})
    near = df.select(F.col("id").alias("query_id"), "split", (F.col("v") + 20 * F.sin(F.col("id") * 1.7)).alias("predicted"))
    near = near.unionByName(near.where("split = 'test'").withColumns({"split": F.lit("missing"), "predicted": F.lit(7.0)}))
    got = suite.direct_regression(df.unionByName(blank), "id", "v", ("x",), near, alphas=(1e-6,)).collect()
    assert len(got) == 3 * 60 and {r.p for r in got if r.split == "missing" and r.model == "neighbours"} == {7.0}
    assert len({round(r.p, 6) for r in got if r.split == "missing" and r.model == "ridge"}) == 1


def test_budget_of_references(spark):
    df = spark.range(50).withColumnRenamed("id", "vec_id")
    drawn = [sorted(r.vec_id for r in retrieve.within_budget(df.repartition(n), "vec_id", 12, 3).collect()) for n in (1, 5)]
    assert drawn[0] == drawn[1] and len(drawn[0]) == 12 and retrieve.within_budget(df, "vec_id", None).count() == 50
