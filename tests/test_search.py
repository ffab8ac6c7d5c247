import numpy as np
import pytest
from pyspark.sql import functions as F

from evalmill.operators import retrieve, search


def clustered(n, d=16, centres=24, spread=0.05, seed=7):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    return [(i, [float(x) for x in c[i % centres] + spread * rng.normal(size=d)]) for i in range(n)]


def brute(data, wanted, k):
    ids = np.array([i for i, _ in data])
    u = search.unit(np.array([v for _, v in data]))
    out = {}
    for i in wanted:
        s = u @ u[ids == i][0]
        order = np.lexsort((ids, -np.round(s, 12)))
        out[i] = [(int(ids[j]), s[j]) for j in order if ids[j] != i][:k]
    return out


def rows_of(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.ref_id, r.sim))
    return got


@pytest.mark.parametrize("kind", ["clustered", "uniform", "ties"])
def test_shells_find_what_brute_force_finds(spark, kind):
    if kind == "clustered":
        data = clustered(1500) + [(5000 + i, [0.0] * 16) for i in range(5)]
    elif kind == "uniform":
        data = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(3).normal(size=(600, 16)))]
    else:
        data = [(i, [1.0] * 16 if i % 3 else [float(i % 5 == 0), 1.0] + [0.0] * 14) for i in range(900)]
    df = spark.createDataFrame(data, "id long, v array<double>")
    wanted = [i for i, _ in data if i % 50 == 0]
    found = retrieve.cosine_top_k(df.where("id % 50 = 0"), df, "id", "v", 6, query_block=8, reference_block=64)
    got, want = rows_of(found), brute(data, wanted, 6)
    assert set(got) == set(want)
    for i in want:
        assert np.allclose([s for _, s in got[i]], [s for _, s in want[i]])
        if kind != "ties":
            assert [j for j, _ in got[i]] == [j for j, _ in want[i]] or not any(data[i][1])
    if kind == "ties":
        # Rounding of equal vectors' products is equal too: ties go to the smaller id.
        assert all(ids == sorted(ids) for i in got for s in {round(s, 9) for _, s in got[i]} for ids in [[j for j, t in got[i] if round(t, 9) == s]])


def test_shells_leave_blocks_out(spark):
    df = spark.createDataFrame(clustered(3000), "id long, v array<double>")
    queries = df.where("id % 20 = 0")
    near = retrieve.cosine_top_k(queries, df, "id", "v", 5, query_block=32, reference_block=128)
    met, all_ = search.surviving(queries, df, near, 5, 128)
    assert met < 0.25 * all_


def test_shells_are_bounded_and_hold_every_row(spark):
    data = [(i, [1.0, 0.001 * (i % 2)]) for i in range(1000)] + [(2000, [0.0, 0.0])]
    shells = search.shells_of(spark.createDataFrame(data, "id long, v array<double>"), 50)
    assert len(shells.parts) <= len(shells.pivots) * search.STEPS + 1 and shells.blocks >= 20
    u = search.unit(np.array([v for _, v in data]))
    at = shells.place(u)
    assert (shells.bounds(u)[:, at] >= u @ u.T - 1e-9).all() and at[-1] == len(shells.parts) - 1


def test_conditions_through_shells(spark):
    data = [(i, v, i % 4, int(i % 3 == 0)) for i, v in clustered(600, centres=6)]
    df = spark.createDataFrame(data, "id long, v array<double>, a int, y int")
    args = ("id", "v", "y", {"a": "a"}, 4, 0.9)
    small = retrieve.shortcut_scores(df.where("id % 40 = 0"), df, *args)
    shells = retrieve.shortcut_scores(df.where("id % 40 = 0"), df, *args, query_block=4, reference_block=40)
    def told(t):
        return sorted((r.condition, r.query_id, r.n, round(r.score, 9), r.mean_sim and round(r.mean_sim, 9)) for r in t.collect())
    assert told(small) == told(shells)


def test_no_rows_at_all(spark):
    df = spark.createDataFrame([], "id long, v array<double>")
    assert retrieve.cosine_top_k(df, df, "id", "v", 5).count() == 0
    assert search.in_shells(df, df, lambda q, r: None, "query_id long, ref_id long, sim double", 3, 8, 8).count() == 0


def sets_of(n, members, size, seed):
    rng = np.random.default_rng(seed)
    return [(i, sorted({str(int(x)) for x in rng.zipf(1.3, rng.integers(0, size)) if x < members})) for i in range(n)]


@pytest.mark.parametrize("members,size,k", [(1000, 12, 5), (10, 6, 3), (10**6, 4, 7)])
def test_set_search_equals_brute_force(spark, members, size, k):
    data = sets_of(240, members, size, size)
    data += [(300, None), (301, data[5][1]), (302, data[5][1])]
    df = spark.createDataFrame(data, "id long, s array<string>")
    got = rows_of(retrieve.set_top_k(df.where("id % 3 = 0"), df, "id", "s", k, look=4, fill=True))
    whole = {i: set(s) for i, s in data if s is not None}
    for i in (i for i in whole if i % 3 == 0):
        best = sorted((-(len(whole[i] & s) / max(1, len(whole[i] | s))), j) for j, s in whole.items() if j != i)[:k]
        assert got[i] == [(j, -s) for s, j in best]
    assert 300 not in got
    none = df.limit(0)
    assert retrieve.set_top_k(none, df, "id", "s", k, fill=True).count() == retrieve.set_top_k(none, none, "id", "s", k, fill=True).count() == 0
    assert retrieve.set_top_k(df.where("id = 9").withColumn("s", F.lit(None).cast("array<string>")), df, "id", "s", k, fill=True).count() == 0
