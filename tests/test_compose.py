import pytest
from pyspark.sql import functions as F

from evalmill.functions import text as T
from evalmill.operators import audit, curate, fuse, metrics, report, split, suite
from evalmill.sources import scans


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_rank_correlation_with_ties_and_constants(spark):
    df = spark.createDataFrame([("a", 1.0, 10.0), ("a", 2.0, 10.0), ("a", 3.0, 30.0), ("a", 3.0, 20.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), (None, 1.0, 1.0), (None, 2.0, 0.0)], "k string, y double, p double")
    got = {r["k"]: r["spearman"] for r in metrics.spearman(df, ["k"], "y", "p").collect()}
    # Ranks 1, 2, 3.5, 3.5 against 1.5, 1.5, 4, 3: covariance 4, both variances 4.5.
    assert got["a"] == pytest.approx(4 / 4.5) and got["b"] is None and got[None] == pytest.approx(-1.0)


def test_folds_are_stratified(spark):
    df = spark.range(23).withColumn("label", (F.col("id") < 7).cast("int"))
    counts = fuse.fold_of(df, "label", ["id"], 3).groupBy("label", "fold").count().collect()
    assert sorted(r["count"] for r in counts if r["label"] == 1) == [2, 2, 3] and sorted(r["count"] for r in counts if r["label"] == 0) == [5, 5, 6]


def test_calibrated_classifier_separates_and_falls_back(spark):
    df = spark.range(60).withColumns({"label": (F.col("id") % 2).cast("double"), "x": (F.col("id") % 2) + 0.2 * F.sin(F.col("id"))})
    ready = suite.as_vector(df, ("x",))
    models = fuse.fit_calibrated(ready, "label", ["id"])
    means = {r["label"]: r["m"] for r in fuse.predict_calibrated(models, ready, "p").groupBy("label").agg(F.avg("p").alias("m")).collect()}
    assert len(models) == 3 and means[1.0] > 0.8 > 0.2 > means[0.0]
    assert fuse.fit_calibrated(ready.where("label = 1"), "label", ["id"]) == []
    assert {r["p"] for r in fuse.predict_calibrated([], ready, "p").collect()} == {0.5}


def test_suite_names_select_and_blend(spark):
    df = spark.range(80).withColumns({"y": (F.col("id") % 2).cast("int"), "good": F.col("id") % 2 + 0.1 * F.cos(F.col("id")), "noise": F.sin(F.col("id") * 3)})
    df = df.withColumn("split", F.when(F.col("id") < 40, "train").when(F.col("id") < 60, "val").otherwise("test"))
    table = {"good": suite.Features(("good",)), "noise": suite.Features(("noise",)), "other": suite.Features(("noise", "good")), "mean": suite.Blend("good", "noise", 0.5), "best": suite.Select(("noise", "good"))}
    small = suite.short_suite(("best",), table)
    assert list(small) == ["good", "noise", "best"]
    got = suite.run_suite(df, "id", "y", small, folds=2)
    assert got.count() == 3 * 40
    ap = {r["model"]: r["ap"] for r in metrics.ranking(got.where("split = 'test'"), ["model"]).collect()}
    assert ap["best"] == ap["good"] == 1.0


def test_direct_regression_fuses(spark):
    df = spark.range(60).withColumns({"v": 2.0 * F.col("id") + 1, "x": F.col("id").cast("double")}).withColumn("split", F.when(F.col("id") % 3 == 0, "train").when(F.col("id") % 3 == 1, "val").otherwise("test"))
    near = df.select(F.col("id").alias("query_id"), (F.col("v") + 20 * F.sin(F.col("id") * 1.7)).alias("predicted")).where("query_id <> 2")
    got = suite.direct_regression(df, "id", "v", ("x",), near, alphas=(1e-6, 100.0))
    found = {(r["split"], r["model"]): r["rmse"] for r in metrics.regression(got, ["split", "model"], "v", "p").collect()}
    assert found["test", "ridge"] < 1e-3 and found["val", "neighbours"] > 5 and found["test", "fused"] < 0.1


def test_grid_runs_a_cell_once(spark, tmp_path):
    done = []

    def run(cell):
        done.append(cell["seed"])
        return spark.range(cell["seed"])

    cells = [{"seed": 2, "mode": "a"}, {"seed": 3, "mode": "a"}]
    assert suite.run_grid(spark, cells[:1], str(tmp_path), run).count() == 2
    assert suite.run_grid(spark, cells, str(tmp_path), run).groupBy("seed").count().count() == 2
    assert done == [2, 3]


def test_conflict_report_bins_and_gain(spark):
    rows = [(f"s{i}", i % 2, 0.5, 0.5 + 0.05 * i * (1 if i % 2 else -1), 0.9 if i % 2 else 0.1) for i in range(8)] + [("null", None, 0.1, 0.2, 0.3)]
    df = spark.createDataFrame(rows, "sample_id string, y int, current double, retrieved double, fused double").withColumn("run", F.lit("r"))
    per, samples = audit.conflict_report(df, ["run"], "sample_id", "y", "current", "retrieved", ["fused"], 2)
    assert samples.count() == 8
    high = per.where("conflict_bin = 2 and model = 'fused'").first()
    assert high["n"] == 4 and high["brier_gain"] == pytest.approx(0.25 - 0.01) and high["family"] == "fused"
    assert per.where("model = 'current'").agg(F.max(F.abs("brier_gain"))).first()[0] == 0
    assert audit.pooled(per, ["model"], "run", ["brier_gain"]).where("total_n = 8 and runs = 1").count() == 3


def test_cohort_keeps_ends_of_each_group(spark):
    rows = [(a * 10 + i, f"a{a}", 2010 + a * 2, "Ki", 4.0 + i) for a in range(6) for i in range(6)] + [(99, None, 2010, "Ki", 1.0), (98, "a1", None, "Ki", 1.0)]
    df = spark.createDataFrame(rows, "id long, g string, y int, t string, v double")
    cohort, manifest = curate.balanced_cohort(df, "g", "y", "t", "v", "id", 3, 3)
    got = cohort.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    assert rows_of(got, "n", "lo", "hi") == [(3, 4.0, 9.0)] * 3
    assert manifest.count() == 6 and manifest.where("selected and retained_rows = 3").count() == 3
    assert curate.balanced_cohort(df, "g", "y", "t", "v", "id", 0, 0)[0].count() == 36
    assert curate.balanced_cohort(df.limit(0), "g", "y", "t", "v", "id", 3, 3)[0].count() == 0


def test_diagnostics_and_components(spark):
    df = spark.createDataFrame([("r", 1, "main", 0.7, 0.8, 0.5, 1), ("r", 1, "simple", 0.9, 0.7, None, 1), ("r", 1, "other", None, 0.9, 0.6, 1), ("r", 1, "main", 0.6, 0.8, 0.5, 0)], "split string, seed int, model string, ap double, auroc double, val_ap double, o int")
    one = audit.failure_diagnostics(df.where("o = 1"), ["split", "seed"], "model", "main", ["simple", "absent"]).first()
    assert (one["best_simple_model"], one["best_model"], one["val_best_model"], one["val_best_ap"]) == ("simple", "simple", "other", None)
    assert one["fixed_minus_best_simple"] == pytest.approx(-0.2)
    last, per, over = audit.component_summary(df, "split", "seed", "model", "o", ["ap"])
    assert last.where("model = 'main'").first()["ap"] == 0.7 and per.where("model = 'main'").first()["std_ap"] == 0.0 and over.count() == 3
    deltas = audit.component_deltas(last, ["split"], "model", "ap", {"d": ("main", "simple"), "none": ("main", "absent")})
    assert [(s, None if d is None else round(d, 6)) for s, d in rows_of(deltas, "step", F.coalesce("delta", F.lit(None)))] == [("d", -0.2), ("none", None)]


def test_threshold_grid_names_one_class_parts(spark):
    df = spark.createDataFrame([(i, p, float(v), 0.5) for i, (p, v) in enumerate([("train", 5), ("train", 7), ("val", 6), ("val", 8), ("test", 5), ("test", 9)])], "id int, part string, v double, p double").withColumn("mode", F.lit("random"))
    found, failed = audit.threshold_grid(df, ["mode"], "part", "id", "v", "p", [7.0, 10.0])
    assert rows_of(found, "threshold", "n", "n_pos") == [(7.0, 2, 1)]
    assert rows_of(failed, "threshold", "one_class_in") == [(10.0, "test,train,val")]


def test_verdict_fails_and_passes(spark):
    log = spark.createDataFrame([("Ki", 500, 5000, None), ("IC50", 500, 500, None)], "k string, page_count int, total_count int, error string")
    none = spark.createDataFrame([], "mode string, entity string, first string, n_common long")
    bad = spark.createDataFrame([("cold", "g", "train", 2), ("random", "g", "train", 5)], none.schema)
    runs = spark.createDataFrame([(True,)], "predictions_present boolean")
    whole = curate.fetch_coverage(log, ["k"])
    one = audit.verdict(whole, none, {"cold": "g"}, runs).first()
    assert (one["status"], one["incomplete_groups"], one["least_coverage"]) == ("fail", 1, 0.1)
    assert audit.verdict(whole.where("k = 'IC50'"), bad, {"cold": "g"}, runs).first()["violations"] == 1
    assert audit.verdict(whole.where("k = 'IC50'"), none, {}, runs.limit(0)).first()["status"] == "pass"


def test_external_report_and_ranks(spark):
    df = spark.createDataFrame([("d", "test", "x", 42, 0.7), ("d", "test", "x", 42, 0.74), ("d", "test", "y", 7, 0.5), ("d", "val", "y", 7, 0.5)], "dataset string, part string, model string, seed int, ap double")
    summary, best, covered = audit.external_report(df, ["dataset"], "part", ["model"], "seed", ["ap"], ["ap"])
    assert summary.where("model = 'x'").first()["seeds"] == "42" and summary.where("model = 'x'").first()["mean_ap"] == pytest.approx(0.72)
    assert rows_of(best, "part", "model") == [("test", "x"), ("val", "y")]
    assert rows_of(covered, "model", "parts") == [("x", "test"), ("y", "test,val")]
    assert rows_of(audit.leaderboard(df.where("seed = 7"), ["ap"], "part"), "part", "place") == [("test", 1), ("val", 2)]


def test_content_digest_ignores_order_and_repeats(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "a"), (2, "a"), (3, "a"), (3, None)], "k int, v string")
    got = {r["k"]: (r["n_values"], r["digest"]) for r in report.content_digest(df, ["k"], "v").collect()}
    assert got[1] == got[2] != got[3] and got[3][0] == 1


def test_described_records_and_slugs(spark):
    record = '{"proteinDescription": {"recommendedName": {"fullName": {"value": "Kinase"}}}, "comments": [{"commentType": "SUBUNIT", "texts": [{"value": "no"}]}, {"commentType": "FUNCTION", "texts": []}, {"commentType": "FUNCTION", "texts": [{"value": "one"}, {"value": "two"}, {"value": "three"}]}]}'
    df = spark.createDataFrame([(record, 100.0), ("{}", 0.5), ("broken", 1000000.0), (None, 12.25)], "js string, v double")
    got = df.select(T.described(F.col("js"), F.lit("id")), T.threshold_slug(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [("Kinase one two", "t100nm"), ("id", "t0p5nm"), ("id", "t1000000nm"), ("id", "t12p25nm")]


def test_prediction_scan_joins_the_header(spark, tmp_path):
    for run, files in {"a_s1": ["predictions", "validation_predictions"], "b_s2": ["predictions"]}.items():
        (tmp_path / run).mkdir()
        for f in files:
            (tmp_path / run / f"{f}.csv").write_text("sample_id,label\ns1,1\n")
    header = spark.createDataFrame([("a_s1", "d")], "run_dir string, dataset string")
    files = {"test": f"{tmp_path}/*/predictions.csv", "val": f"{tmp_path}/*/validation_predictions.csv"}
    got = scans.read_predictions(spark, files, "sample_id string, label int", header)
    assert [(m, r, d) for m, r, d in sorted((x["metric_split"], x["run_dir"], x["dataset"]) for x in got.collect())] == [("test", "a_s1", "d"), ("test", "b_s2", None), ("val", "a_s1", "d")]
    with pytest.raises(ValueError):
        scans.read_benchmark(spark, f"{tmp_path}/a_s1/predictions.csv", "id string, label int")


def test_few_groups_or_years_split_by_rows(spark):
    df = spark.createDataFrame([(i, f"g{i % 2}", 2000 + i % 2) for i in range(6)] + [(9, None, None)], "id int, g string, y int")
    for found in (split.split_by_group(df, "g", rows=["id"]), split.split_by_time(df, "y", rows=["id"])):
        assert {r["split"]: r["count"] for r in found.groupBy("split").count().collect()} == {"train": 4, "val": 1, "test": 1}
    ends = {r["split"]: (r["a"], r["b"]) for r in split.split_by_time(df, "y", rows=["id"]).groupBy("split").agg(F.min("y").alias("a"), F.max("y").alias("b")).collect()}
    assert ends["train"][1] <= ends["val"][0] and ends["val"][1] <= ends["test"][0]
    wide = df.withColumn("g", F.col("id"))
    assert sorted(map(tuple, split.split_by_group(wide, "g", rows=["id"]).select("id", "split").collect())) == sorted(map(tuple, split.split_by_group(wide, "g").select("id", "split").collect()))
