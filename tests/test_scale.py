"""What keeps work in proportion to the input: plans, sizes and the same results by plainer means."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evalmill.operators import common, curate, metrics, project, retrieve, search, split
from evalmill.plans import benchmark


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def by_rank(df, order, seed):
    """Split sizes and parts of an order by one sort."""
    n = df.count()
    at = F.row_number().over(Window.orderBy(common.hash_order(seed, *order), *order))
    return df.withColumn("split", split.part_of(at, F.lit(n), 0.7, 0.15))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 5000])
def test_random_split_leaves_rows_in_place(spark, n):
    df = spark.range(n)
    got = split.split_random(df, ["id"], seed=3)
    assert "Exchange" not in plan(got)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, by_rank(df, ["id"], 3).collect()))


def test_torn_hashes_keep_exact_sizes(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    for seed in range(4):
        got = Counter(r["split"] for r in split.split_random(df, ["k"], seed=seed).collect())
        assert got == {"train": 70, "val": 15, "test": 15}


def test_group_split_joins_nothing(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 40).alias("g"))
    got = split.split_by_group(df, "g", seed=2)
    assert "Join" not in plan(got) and "Exchange" not in plan(got)
    want = by_rank(df.where("g is not null").select("g").distinct(), ["g"], 2).join(df, "g")
    assert sorted(map(tuple, got.select("id", "g", "split").collect())) == sorted(map(tuple, want.select("id", "g", "split").collect()))


def test_coded_grid_equals_all_splits(spark):
    c = benchmark.Columns()
    rows = spark.range(400).select((F.col("id") % 90).alias("row_id"), F.lit(1).alias("left_id"), (F.col("id") % 23).alias("right_id"), (F.col("id") % 31).alias("context_id"), F.lit(1.0).alias("value"), (1990 + F.col("id") % 9).cast("int").alias("year"), "id")
    dealt = benchmark.exploded(benchmark.grid_splits(rows, c, [1, 5]))
    assert "Exchange" not in plan(benchmark.coded(rows.withColumn("row_id", F.col("id")), c, [1]))
    for seed in (1, 5):
        count = lambda t: Counter((r["mode"], r["split"]) for r in t.collect())
        assert count(dealt.where(F.col("seed") == seed)) == count(benchmark.all_splits(rows, c, seed))
        cold = "mode <> 'random'"
        key = ["mode", "id", "split"]
        assert Counter(map(tuple, dealt.where(cold).where(F.col("seed") == seed).select(*key).collect())) == Counter(map(tuple, benchmark.all_splits(rows, c, seed).where(cold).select(*key).collect()))


def test_risk_orders_one_confidence(spark):
    rows = [(i, i % 2, [0.2, 0.8, 0.8, 0.6, 0.5][i % 5], "a" if i % 3 else None) for i in range(173)]
    df = spark.createDataFrame(rows, "id long, y int, p double, g string")
    for rounding in ("floor", "ceil"):
        got = {r["g"]: r["risk"] for r in metrics.risk_at(df, ["g"], "id", 0.55, rounding).collect()}
        for g in ("a", None):
            own = sorted((-max(p, 1 - p), i, int((p >= 0.5) != y)) for i, y, p, x in rows if x == g)
            n = len(own) * 0.55
            keep = max(1, int(n) if rounding == "floor" else -int(-n // 1))
            assert got[g] == pytest.approx(sum(w for *_, w in own[:keep]) / keep)


def test_sets_of_few_members_meet_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    data = [(i, [str(m) for m in np.flatnonzero(rng.random(12) < 0.5)]) for i in range(260)] + [(400, ["other"]), (401, None), (402, [])]
    df = spark.createDataFrame(data, "id long, s array<string>")
    asked = df.where("id % 2 = 0")
    joined = retrieve.set_top_k(asked, df, "id", "s", 5, fill=True).collect()
    used = []
    dense = retrieve._dense_sets
    monkeypatch.setattr(retrieve, "_dense_sets", lambda *a: used.append(1) or dense(*a, block=50))
    assert sorted(retrieve.set_top_k(asked, df, "id", "s", 5, fill=True, least=0).collect()) == sorted(joined)
    assert used


def test_frames_to_blocks_are_bounded(spark, monkeypatch):
    """However many blocks a row goes to, a task holds few of its copies."""
    seen = []
    monkeypatch.setattr(search, "SENT", 10)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(3).normal(size=(400, 4)))], "id long, v array<double>")

    class Caught:
        """Runs what a table is asked to do on the driver, and keeps the sizes of its frames."""

        def __init__(self, df):
            self.df, self.schema = df, df.schema

        def mapInPandas(self, f, kind):
            if "deal" in kind:
                seen.extend(len(p) for p in f(iter([self.df.toPandas()])))
            return self.df.mapInPandas(f, kind)

    shells = search.shells_of(df, 20)
    meet = lambda q, r: q[["id"]].assign(n=len(r))
    everywhere = lambda pdf: np.ones((len(pdf), len(shells.parts)), bool)
    met = search._met(Caught(df), Caught(df), shells, everywhere, meet, "id long, n long", 8, False)
    assert max(seen) <= 10 and sum(seen) > 10 * 400
    # Every query meets every reference once.
    assert {r["s"] for r in met.groupBy("id").agg(F.sum("n").alias("s")).collect()} == {400}


def test_a_short_policy_table_leaves_rows_in_place(spark):
    df = spark.range(1000).select((F.col("id") % 2).cast("string").alias("k"), F.col("id").cast("double").alias("v"))
    policy = spark.createDataFrame([("0", 100.0, 500.0, False), ("1", 900.0, 300.0, True)], "k string, active double, inactive double, greater_is_better boolean")
    got = project.label_policy(df, policy, "k", "v")
    assert "SortMergeJoin" not in plan(got) and "hashpartitioning" not in plan(got)
    assert Counter(r["label"] for r in got.collect()) == {1: 51 + 50, 0: 250 + 150}


def test_bootstrap_shuffles_no_replicates_of_rows(spark, monkeypatch):
    """Sums of ranges and blocks go to other tasks, not rows times replicates; ties, hot values, null keys and texts as ids included."""
    rng = np.random.default_rng(5)
    rows = [(int(i), "a" if i % 3 else None, int(rng.random() < 0.4), 0.5 if i % 2 else float(rng.integers(0, 40)) / 39, float(rng.random())) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, k string, y int, p double, q double")
    monkeypatch.setattr(metrics, "WEIGHED", 50)
    spread, sent = metrics._spread, []
    monkeypatch.setattr(metrics, "_spread", lambda d, names: sent.append(d.count()) or spread(d, names))
    got = {(r.k, r.metric): r for r in metrics.bootstrap_difference(df, ["k"], "id", "y", "p", "q", replicates=30).collect()}
    assert len(sent) == 3 and max(sent) < 150
    drawn = df.withColumn("b", F.explode(F.sequence(F.lit(-1), F.lit(29)))).withColumn("w", F.when(F.col("b") < 0, 1).otherwise(metrics.poisson_weight(0, F.col("b"), "id"))).where("w > 0").persist()
    want = {}
    for side in "pq":
        by = ["k", "b"]
        for m, part in {"auroc": metrics.ranking(drawn, by, "y", side, "w"), "ap": metrics.ranking(drawn, by, "y", side, "w"), "ece": metrics.ece(drawn, by, "y", side, "w"), "brier": metrics.classification(drawn, by, "y", side, "w"), "risk": metrics.weighted_risk_at(drawn, by, "id", "w", y="y", p=side)}.items():
            want |= {(r.k, m, side, r.b): r[m] for r in part.collect()}
    for (k, m), r in got.items():
        assert (r.value_p, r.value_q) == pytest.approx((want[k, m, "p", -1], want[k, m, "q", -1]))
        d = [want[k, m, "q", b] - want[k, m, "p", b] for b in range(30)]
        assert (r.low, r.high) == pytest.approx(tuple(np.percentile(d, [2.5, 97.5]))) and r.replicates == 30
    assert len(got) == 10
    named = metrics.bootstrap_difference(df.withColumn("id", F.concat(F.lit("t"), "id")), ["k"], "id", "y", "p", "q", replicates=3).collect()
    assert {r.replicates for r in named} == {3}


def _told(df):
    return sorted(map(str, df.collect()))


def test_crowded_keys_are_counted_in_full_buckets_only(spark):
    df = spark.range(900).select(F.when(F.col("id") < 300, 0).when(F.col("id") < 500, None).otherwise(F.col("id")).alias("k"))
    assert common.crowded(df, ["k"], 300) is None
    assert {r["k"] for r in common.crowded(df, ["k"], 199, buckets=2).collect()} == {0, None}


def test_replicates_and_quantiles_order_small_groups_after_one_shuffle(spark):
    """No aggregate holds the values of a key and small groups have no ranges of ranks; both ways give the same rows."""
    rows = [(i % 7 or None, float(i * 37 % 101) if i % 5 else None, 1990 + i * 13 % 17 if i % 11 else None, i, "d" if i % 3 else None) for i in range(400)] + [(100 + i % 90, float(i % 8), 2000, i, "e") for i in range(130)]
    df = spark.createDataFrame(rows, "k int, v double, y int, o int, d string").repartition(4)
    one = curate.collapse_replicates(df, ["k"], "v", "y", "o", ["d"])
    text = one._jdf.queryExecution().optimizedPlan().toString()
    assert "median" not in text and "percentile" not in text
    want = df.groupBy("k").agg(F.median("v").alias("v"), F.bround(F.median("y")).cast("int").alias("y"), F.count("*").alias("n_replicates"), F.min_by("d", F.when(F.col("d").isNotNull(), F.struct("y", "o"))).alias("d"))
    assert _told(one) == _told(want) == _told(curate.collapse_replicates(df, ["k"], "v", "y", "o", ["d"], large=20))
    counts = common.value_counts(df, ["k"], "v")
    shares = {"lo": 0.3, "hi": 0.7}
    got = common.quantiles_of(counts, ["k"], shares)
    assert "__bin" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert _told(got) == _told(common.quantiles_of(counts, ["k"], shares, large=5))


def test_lone_replicates_are_not_ordered(spark):
    """A key of one row passes by the orders of values and years, and its part and theirs read one shuffle; (1, null) and (null, 1) have one hash."""
    rows = [(i, i % 3, float(i), 1990 + i % 9, i, None if i % 4 else "d") for i in range(300)] + [(7, 1, 5.0, None, 900, "e"), (7, 1, None, 1980, None, "f")]
    rows += [(1, None, 3.0, 2001, 901, "g"), (None, 1, 4.0, 2002, 902, "h"), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "k int, m int, v double, y int, o int, d string").repartition(4)
    one = curate.collapse_replicates(df, ["k", "m"], "v", "y", "o", ["d"])
    want = df.groupBy("k", "m").agg(F.median("v").alias("v"), F.bround(F.median("y")).cast("int").alias("y"), F.count("*").alias("n_replicates"), F.min_by("d", F.when(F.col("d").isNotNull(), F.struct("y", "o"))).alias("d"))
    assert _told(one) == _told(want)
    assert "ReusedExchange" in one._jdf.queryExecution().executedPlan().toString()
    lone = one._jdf.queryExecution().optimizedPlan().children().apply(1).toString()
    assert "row_number" not in lone and "Aggregate" not in lone


def test_replicates_of_collated_keys_meet(spark):
    rows = [("a", 1.0, 2000, 1, "x"), ("A", 3.0, 2002, 2, "y"), ("b", 5.0, 2004, 3, "z")]
    df = spark.createDataFrame(rows, "k string, v double, y int, o int, d string").withColumn("k", F.collate("k", "UTF8_LCASE"))
    assert sorted((r["v"], r["y"], r["n_replicates"], r["d"]) for r in curate.collapse_replicates(df, ["k"], "v", "y", "o", ["d"]).collect()) == [(2.0, 2001, 2, "x"), (5.0, 2004, 1, "z")]


def test_profile_tells_entities_apart_by_narrow_rows(spark):
    rows = [("a" if i % 4 else None, float(i), 2000 + i % 3, i % 5 or None, f"x{i % 7}") for i in range(60)] + [("none", 1.0, 1999, None, None)]
    df = spark.createDataFrame(rows, "k string, v double, y int, e long, f string")
    got = curate.profile(df, ["k"], "v", (F.col("v") < 9).cast("int"), "y", ["e", "f"])
    wide = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "__e" in x and "Aggregate" in x]
    assert wide and not any("avg" in x for x in wide) and "Expand" not in plan(got)
    want = df.groupBy("k").agg(F.count_distinct("e"), F.count_distinct("f"), F.median("v"))
    assert _told(got.select("k", F.col("n_e").alias("a"), F.col("n_f").alias("b"), F.col("median_value").alias("c"))) == _told(want.toDF("k", "a", "b", "c"))
