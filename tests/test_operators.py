import json

import pytest
from pyspark.sql import functions as F

from evalmill.functions import text as T
from evalmill.operators import curate, fuse, metrics, report, retrieve, split
from evalmill.operators.common import require_columns
from evalmill.sources import scans


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_gap_labels(spark):
    df = spark.createDataFrame([(100.0,), (10000.0,), (3000.0,)], "v double")
    assert sorted(values(curate.label_with_gap(df, "v", 1000.0), "v", "label")) == [(100.0, 1), (10000.0, 0)]
    assert sorted(values(curate.label_with_gap(df, "v", 5000.0, 1000.0, True), "v", "label")) == [(100.0, 0), (10000.0, 1)]


def test_log_scale(spark):
    df = spark.createDataFrame([(1000.0,), (10000.0,), (100.0,)], "v double")
    assert [r[0] for r in df.select(curate.nm_to_p(F.col("v"))).collect()] == pytest.approx([6, 5, 7])
    with pytest.raises(Exception):
        spark.createDataFrame([(0.0,)], "v double").select(curate.nm_to_p(F.col("v"))).collect()


def test_required_columns(spark):
    with pytest.raises(ValueError):
        require_columns(spark.range(1), "id", "other")


def test_replicates_take_first_described(spark):
    df = spark.createDataFrame([(1, 2.0, 2010, 1, None), (1, 4.0, 2011, 2, "b"), (1, 9.0, 2012, 3, "c")], "k int, v double, y int, o int, d string")
    for large in (2, 100):
        assert values(curate.collapse_replicates(df, ["k"], "v", "y", "o", ["d"], large), "v", "y", "d", "n_replicates") == [(4.0, 2011, "b", 3)]


@pytest.mark.parametrize("n,sizes", [(10, {"train": 7, "val": 1, "test": 2}), (3, {"train": 1, "val": 1, "test": 1}), (1, {"train": 1})])
def test_random_split_sizes(spark, n, sizes):
    found = split.split_random(spark.range(n), ["id"]).groupBy("split").count().collect()
    assert {r[0]: r[1] for r in found} == sizes


def test_group_and_time_splits(spark):
    df = spark.createDataFrame([(i, f"a{i % 5}", 2000 + i % 6) for i in range(60)], "id int, g string, y int")
    parts = split.split_by_group(df, "g").groupBy("g").agg(F.count_distinct("split").alias("n"))
    assert {r["n"] for r in parts.collect()} == {1}
    assert split.violations(split.overlap(split.split_by_group(df, "g"), {"g": ["g"]}), ["g"]).count() == 0
    ends = {r["split"]: (r["a"], r["b"]) for r in split.split_by_time(df, "y").groupBy("split").agg(F.min("y").alias("a"), F.max("y").alias("b")).collect()}
    assert ends["train"][1] < ends["val"][0] <= ends["val"][1] < ends["test"][0]
    with pytest.raises(ValueError):
        split.split_frame(df, "none", ["id"])


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.9), (3, 1, 0.4), (4, 0, 0.1)], "id int, y int, p double").withColumn("m", F.lit("a"))
    r = metrics.ranking(df, ["m"]).first()
    assert (r["n"], r["n_pos"]) == (4, 2)
    assert r["auroc"] == pytest.approx(0.625)
    assert r["ap"] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    assert metrics.ranking(df.where("y = 1"), ["m"]).first()["auroc"] is None
    assert metrics.risk_at(df, ["m"], "id").first()["risk"] == pytest.approx(1 / 3)
    assert [r[0] for r in spark.createDataFrame([(0.3,), (0.30000000000000004,), (1.0,)], "p double").select(metrics.bin_of(F.col("p"))).collect()] == [2, 3, 9]


def test_bootstrap_of_five_metrics(spark):
    rows = [(i, (i * 7) % 3 % 2, ((i * 5) % 11) / 10, ((i * 3) % 7) / 6) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, y int, p double, q double").withColumn("k", F.lit("a"))
    got = {r.metric: r for r in metrics.bootstrap_difference(df, ["k"], "id", "y", "p", "q", replicates=20).collect()}
    drawn = df.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("w", metrics.poisson_weight(0, F.col("b"), "id"))
    # Each row as often as its weight, so that the metrics need none.
    again = drawn.withColumn("id", F.explode(F.expr("transform(sequence(1, w + 1), i -> id * 100L + i)"))).where("id % 100 <= w").persist()

    def told(d, keys, p):
        return {r["b"] if "b" in keys else -1: r for r in metrics.evaluate(d.select(*keys, "id", "y", F.col(p).alias("p")), keys, "id").collect()}

    seen = [told(df, ["k"], c)[-1] for c in "pq"]
    a, b = told(again, ["b"], "p"), told(again, ["b"], "q")
    assert set(got) == {"ap", "auroc", "ece", "risk", "brier"} and len(a) == 20
    for m, r in got.items():
        d = sorted(b[i][m] - a[i][m] for i in a)
        assert (r.n, r.replicates) == (40, 20) and r.difference == pytest.approx(seen[1][m] - seen[0][m])
        assert r.low == pytest.approx(d[0] + 0.475 * (d[1] - d[0])) and r.high == pytest.approx(d[18] + 0.525 * (d[19] - d[18]))
        assert r.share_not_above_0 == pytest.approx(sum(x <= 1e-12 for x in d) / 20, abs=0.051) and r.share_not_below_0 == pytest.approx(sum(x >= -1e-12 for x in d) / 20, abs=0.051)


def test_equal_count_bins(spark):
    found = report.equal_bins(spark.range(10).withColumn("k", F.lit(1)), ["k"], "id", [], 4).groupBy("bin").count().orderBy("bin").collect()
    assert [r[1] for r in found] == [3, 2, 2, 3]


def test_neighbours_exclude_self(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.95, 0.05], 1), (3, [0.0, 1.0], 0), (4, [0.0, 0.0], 1)], "id long, v array<double>, y int")
    near = retrieve.cosine_top_k(df, df, "id", "v", 1)
    best = {r["query_id"]: (r["ref_id"], round(r["sim"], 6)) for r in near.collect()}
    assert best[1][0] == 2 and best[4] == (1, 0.0)
    found = {r["query_id"]: r for r in retrieve.label_summary(df, near, df, "id", "y").collect()}
    assert found[1]["mean_label"] == 1.0 and found[1]["n_ones"] == 1.0


def test_shortcut_audit_looks_beyond_a_hot_label(spark):
    near = [(i, [1.0, i / 1000], "hot", 1) for i in range(60)]
    rows = [*near, (100, [0.0, 1.0], "far", 0), (101, [0.1, 1.0], None, 1), (102, [0.0, 1.0], "far", 0)]
    df = spark.createDataFrame(rows, "id long, v array<double>, a string, y int")
    scores = retrieve.shortcut_scores(df.where("id in (0, 100)"), df, "id", "v", "y", {"a": "a", "pair": ("a", "y")}, 2, 0.5, 1, 7)
    got = {(r.condition, r.query_id): (r.n, round(r.score, 6)) for r in scores.collect()}
    assert got["original", 0] == (2, 1.0) and got["original", 100] == (2, 0.5)
    assert got["no_same_a", 0] == got["no_same_pair", 0] == got["no_high_similarity", 0] == got["no_shortcut", 0] == (2, 0.5)
    assert got["no_same_a", 100] == (2, 1.0) and got["label_free", 0][0] == 2 and got["label_free", 0][1] > 0.99
    alone = retrieve.shortcut_scores(df.where("id = 0"), df.where("id < 60"), "id", "v", "y", {"a": "a"}, 2, 0.5)
    assert {r.condition: (r.n, r.score) for r in alone.collect()}["no_shortcut"] == (0, 1.0)
    told = {r.condition: r for r in retrieve.shortcut_metrics(scores).collect()}
    assert len(told) == 6 and told["no_same_a"].n_queries == 2 and told["no_same_a"].auroc == 0.0


def test_blend_prefers_the_stronger_signal(spark):
    rows = [(i, i % 2, 0.2 + 0.6 * (i % 2), 0.5) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, y int, p double, q double").withColumn("k", F.lit(1))
    assert fuse.blend_weight(df, ["k"], "y", "p", "q").first()["ap"] == 1.0


def test_ridge_equals_closed_form(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(0)
    x, noise = rng.normal(size=(40, 2)), rng.normal(size=40)
    y = x @ [1.0, -2.0] + 3 + 0.1 * noise
    df = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "label"])
    xc, yc = x - x.mean(0), y - y.mean()
    exact = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(2), xc.T @ yc)
    assert fuse.ridge(df, "label", 2.0).coefficients.toArray() == pytest.approx(exact, rel=1e-6)


def test_arbitration_probe_sees_the_gated_choice(spark):
    df = spark.createDataFrame([(1, 0.9, 0.2, 0.25, 3.0, 0.0)], "id long, p double, q double, g double, s double, m double")
    got = fuse.reliability_features(df, "p", "q", "g", ["s"], ["m"]).first()["reliability"]
    assert list(got) == pytest.approx([0.9, 0.2, 0.375, 0.25, 0.7, 0.25, 3.0, 0.0, 1.0])
    # Both sides agree; right where they are sure, which is no line in either probability.
    rows = [(i, float((v >= 0.5) == (abs(v - 0.5) > 0.25)), v, v + 0.001 * (i % 3 - 1), 0.5, 1.0) for i in range(120) for v in [((i * 37) % 100 + 0.5) / 100]]
    ready = fuse.gate_features(spark.createDataFrame(rows, "id long, y double, current double, retrieved double, anchor double, mask double"), "current", "retrieved", [], ["mask"])
    fused, strength = fuse.arbitrated(ready, ready, ["id"], folds=2, stats=[], masks=["mask"])
    by = {r.id: r for r in fused.collect()}
    moved = {i: abs(r.full - r.no_anchor) / abs(r.no_anchor - 0.5) for i, r in by.items() if abs(r.no_anchor - 0.5) > 0.01}
    sure = [m for i, m in moved.items() if abs(by[i].current - 0.5) > 0.4]
    unsure = [m for i, m in moved.items() if abs(by[i].current - 0.5) < 0.1]
    assert strength > 0 and max(sure) < min(unsure)


def test_text_functions(spark):
    df = spark.createDataFrame([("ab c",), ("",), (None,)], "t string")
    got = df.select(T.presence(F.col("t")), T.char_ngrams(F.col("t"), 2, 3), T.shortened(F.col("t"), 80)).collect()
    assert [tuple(r) for r in got] == [(1, ["ab", "b ", " c", "ab ", "b c"], "ab c"), (0, [], ""), (0, [], None)]
    path = spark.createDataFrame([("out/run_s42_x/metrics.json",), ("none",)], "p string").select(T.seed_of(F.col("p"))).collect()
    assert [r[0] for r in path] == [42, None]


def test_scans(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "a.json").write_text(json.dumps({"activities": [{"v": 1}, {"v": 2}], "page_meta": {"total_count": 5}}))
    from pyspark.sql import types as T_

    got = scans.read_pages(spark, str(tmp_path / "pages"), T_.StructType([T_.StructField("v", T_.IntegerType())]))
    assert sorted(values(got, "v", "total_count")) == [(1, 5), (2, 5)]
    (tmp_path / "cache.json").write_text(json.dumps({"a": "plain", "b": {"text": "deep", "sequence": "S"}}))
    assert sorted(values(scans.read_keyed_json(spark, str(tmp_path / "cache.json")), "key", "value")) == [("a", "plain"), ("b", "deep")]
    run = tmp_path / "runs" / "x_s7_y"
    run.mkdir(parents=True)
    (run / "metrics.json").write_text(json.dumps({"dataset": "d", "split_mode": "random", "models": {"m": {"selected_model": "m", "test_clean": {"auroc": 0.5}}, "n": {}}}))
    assert values(scans.read_metrics(spark, [str(tmp_path / "runs" / "*" / "metrics.json")], ["auroc"]), "seed", "model", "auroc") == [(7, "m", 0.5)]
    files = scans.list_files(spark, str(tmp_path / "runs"), digest=True)
    assert scans.complete_runs(files, ["metrics.json"]).count() == 1
    assert scans.complete_runs(files, ["metrics.json", "other.csv"]).count() == 0
    for part in ("train", "val", "test"):
        (tmp_path / f"random_{part}.csv").write_text("id\n1\n")
    (tmp_path / "cold_train.csv").write_text("id\n1\n")
    assert sorted(values(scans.read_splits(spark, str(tmp_path), "id int"), "mode", "split")) == [("random", "test"), ("random", "train"), ("random", "val")]


def test_entry_imports_and_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_tails_and_signed_ranks():
    import numpy as np

    from evalmill.operators.significance import signed_rank, t_tail

    # Values of printed tables.
    assert t_tail(2.776, 4) == pytest.approx(0.05, abs=2e-4) and t_tail(12.706, 1) == pytest.approx(0.05, abs=2e-4) and t_tail(0.0, 5) == 1.0
    assert signed_rank(np.array([1.0, 2, 3, 4, 5])) == (0.0, 0.0625)
    assert signed_rank(np.zeros(3)) == (0.0, 1.0)


def test_concordance_over_blocks(spark):
    df = spark.createDataFrame([(i, (i * 7) % 23, float((i * 5) % 11)) for i in range(50)], "id long, y int, p double").withColumn("k", F.lit(1))
    rows = [(r.y, r.p) for r in df.collect()]
    pairs = [(a, b) for a in rows for b in rows if a[0] > b[0]]
    want = sum(1.0 if a[1] > b[1] else 0.5 if a[1] == b[1] else 0.0 for a, b in pairs) / len(pairs)
    assert metrics.concordance(df, ["k"], ranges=6, least=4).first()["ci"] == pytest.approx(want)


def test_encoder_runs_once_per_text(spark):
    def encode(batches):
        for b in batches:
            yield b.assign(vec=[[float(len(t)), 1.0] for t in b["text"]])

    df = spark.createDataFrame([("aa",), ("aa",), ("",), (None,), ("b",)], "t string")
    cache = spark.createDataFrame([("b", [9.0, 9.0])], "text string, vec array<double>")
    got = retrieve.encoded_once(df, "t", encode, 2, cache)
    assert sorted((r.t or "", r.vec) for r in got.collect()) == [("", [0.0, 0.0]), ("", [0.0, 0.0]), ("aa", [2.0, 1.0]), ("aa", [2.0, 1.0]), ("b", [9.0, 9.0])]


def test_projections(spark):
    from evalmill.operators import project

    df = spark.createDataFrame([(1, "AB12C", "true", '{"a": "x"}', "5"), (2, "ab", "no", '{"a": " "}', "-1")], "id long, acc string, flag string, js string, v string")
    assert values(df.select(project.looks_like_accession(F.col("acc")).alias("a"), project.is_complete(F.col("js"), ["a"]).alias("b")), "a", "b") == [(True, True), (False, False)]
    assert values(project.replay_missing(df, {"acc": "flag"}), "acc") == [("",), ("ab",)]
    assert values(project.regression_rows(df, "v", "id"), "id", "binary_label") == [(1, 1)]
    assert values(project.shortlist(df, "acc", ["ab", "zz"]), "id", "position") == [(2, 1)]
    with pytest.raises(Exception):
        project.with_predictions(df, df.where("id = 1").select("id", F.lit(0.5).alias("p")), "id").collect()
    assert project.with_predictions(df, df.select("id", F.lit(0.5).alias("p")), "id").count() == 2
    wide = spark.createDataFrame([(1, 0.1, 0.2)], "id int, m_prob_clean double, m_prob double")
    assert sorted(values(project.long_form(wide, ["id"]), "model", "prob")) == [("m", 0.1), ("m", 0.2)]


def test_scaling_and_pairs(spark):
    df = spark.createDataFrame([(1, 0.0, "train"), (1, 10.0, "train"), (2, 15.0, "test")], "k int, v double, s string")
    assert sorted(r[0] for r in curate.scaled(df, ["v"], F.col("s") == "train").select("v").collect()) == [-1.0, 1.0, 2.0]
    assert sorted(values(curate.pair_values(df, "k", "s", "v", "v"), "k", "v")) == [(1, 10.0), (2, 15.0)]


def test_concordance_equals_all_pairs(spark):
    import random

    draw = random.Random(5)
    for kinds_y, kinds_p in ((2, 400), (400, 2), (40, 40), (400, 400), (1, 9)):
        rows = [(draw.choice(["a", "b", None]), float(draw.randrange(kinds_y)), draw.randrange(kinds_p) / 7) for _ in range(300)] + [("a", None, 1.0), ("a", 1.0, None), ("c", 1.0, 0.5)]
        rows += [("a", 0.0, 0.5)] * 60  # one value heavier than a range
        found = dict(values(metrics.concordance(spark.createDataFrame(rows, "k string, y double, p double"), ["k"], ranges=9, least=3), "k", "ci"))
        assert set(found) == {"a", "b", None, "c"}
        for k, ci in found.items():
            seen = [(y, p) for g, y, p in rows if g == k and y is not None and p is not None]
            met = [1.0 if a[1] > b[1] else 0.5 if a[1] == b[1] else 0.0 for a in seen for b in seen if a[0] > b[0]]
            assert ci == (pytest.approx(sum(met) / len(met)) if met else None)


def test_quantiles_equal_sorted_rows(spark):
    import numpy as np

    from evalmill.operators.common import quantiles

    draw = np.random.default_rng(3)
    rows = [(str(k), float(v)) for k, n in (("a", 1), ("b", 2), ("c", 999), ("d", 40)) for v in draw.integers(0, 50, n)] + [("d", None), ("e", None), (None, 2.0)]
    found = {r[0]: r[1:] for r in values(quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"lo": 0.3, "mid": 0.5, "top": 1.0}), "k", "lo", "mid", "top")}
    assert set(found) == {"a", "b", "c", "d", None}
    for k, got in found.items():
        assert got == pytest.approx(tuple(np.quantile([v for g, v in rows if g == k and v is not None], [0.3, 0.5, 1.0])))


def test_set_search_equals_all_pairs(spark):
    import random

    draw = random.Random(7)
    rows = [(i, [draw.randrange(30) for _ in range(draw.randrange(9))]) for i in range(80)] + [(80, None), (81, []), (82, [None, 3])]
    df = spark.createDataFrame(rows, "id long, s array<int>")
    got = sorted(values(retrieve.set_top_k(df, df, "id", "s", 4, query_block=20, reference_block=30), "query_id", "rank", "ref_id", "sim"))
    sets = {i: {m for m in s or [] if m is not None} for i, s in rows}
    want = []
    for a, one in sets.items():
        near = sorted((-len(one & two) / len(one | two), b) for b, two in sets.items() if a != b and one & two)[:4]
        want += [(a, r + 1, b, pytest.approx(-d)) for r, (d, b) in enumerate(near)]
    assert got == want
