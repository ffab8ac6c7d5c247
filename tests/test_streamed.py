"""Search where bounds leave out little: blocks stream, no row is sent to many of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalmill.operators import nearest, retrieve, search


def uniform(n, d=8, seed=11):
    """Vectors without structure; some rows equal others, some are zero or multiples of others."""
    v = np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32).astype(float)
    v[n // 2 : n // 2 + 60] = v[3]
    v[n // 3 : n // 3 + 20] = 0
    v[-5:] = 4 * v[:5]
    return v


def sims(v):
    """Similarities summed in the order of the elements, as SQL does."""
    dot, square = np.zeros((len(v), len(v))), np.zeros(len(v))
    for x in v.T:
        dot += x[:, None] * x[None, :]
        square += x * x
    length = np.sqrt(square[:, None] * square[None, :])
    return np.clip(np.divide(dot, length, out=np.zeros_like(dot), where=length > 0), -1, 1)


def lists(s, k, banned):
    ids = np.arange(len(s))
    return {i: [(int(j), float(s[i, j])) for j in np.lexsort((ids, -s[i])) if j != i and not banned[i, j]][:k] for i in range(len(s))}


def test_every_row_finds_its_neighbours_and_is_sent_once(spark, monkeypatch):
    v = uniform(900)
    df = spark.createDataFrame([*((i, x.tolist()) for i, x in enumerate(v)), (None, v[3].tolist()), (2000, None)], "id long, v array<float>").repartition(5)
    monkeypatch.setattr(search, "_met", None)  # blocks that rows are sent to, as often as there are blocks
    monkeypatch.setattr(nearest, "TILE", 50)
    monkeypatch.setattr(nearest, "HELD", 1000)
    found = {}
    for r in retrieve.cosine_top_k(df, df, "id", "v", 6, query_block=8, reference_block=64).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.ref_id, r.sim))
    assert found == lists(sims(v), 6, np.zeros((900, 900), bool))


@pytest.mark.parametrize("few", [-1, 10**9])
def test_rankings_leave_out_what_they_say(spark, monkeypatch, few):
    """Streamed and through blocks: hot and null attributes, a condition that leaves nothing, equal vectors."""
    monkeypatch.setattr(search, "FEW", few)
    v = uniform(400)
    a = [None if i % 50 == 0 else "hot" if i % 3 else f"x{i % 7}" for i in range(400)]
    y = [None if i == 7 else i % 2 for i in range(400)]
    df = spark.createDataFrame([(i, x.tolist(), a[i], "one", y[i]) for i, x in enumerate(v)], "id long, v array<double>, a string, b string, y int")
    got = retrieve.shortcut_scores(df, df, "id", "v", "y", {"a": "a", "b": "b", "pair": ("a", "b")}, 4, 0.6, query_block=8, reference_block=40)
    told = {(r.condition, r.query_id): r for r in got.collect()}
    s = sims(v)
    same = np.array([[p is not None and p == q for q in a] for p in a])
    bans = {"original": s > 2, "no_same_a": same, "no_same_b": s < 2, "no_same_pair": same, "no_high_similarity": s >= 0.6, "no_shortcut": s < 2}
    for name, ban in bans.items():
        for i, near in lists(s, 4, ban).items():
            r = told[name, i]
            assert r.n == len(near)
            assert near == [] or abs(r.mean_sim - np.mean([x for _, x in near])) < 1e-12
            labels = [y[j] for j, _ in near if y[j] is not None]
            assert near == [] or abs(r.score - np.mean(labels)) < 1e-12


def test_equal_vectors_are_equally_similar_wherever_they_stand():
    import pandas as pd

    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 37))
    v[1:] = v[1]
    q, r = (nearest.Rows(pd.DataFrame({"id": np.arange(n), "v": list(v[:n])})) for n in (1, 300))
    assert len({*nearest.similarity(q, r, np.zeros(299, int), np.arange(1, 300))}) == 1


def test_ids_of_many_equal_rows_fill_lists(spark):
    """Equal vectors of one id, excluded for that id, do not hide those of others."""
    rows = [(1, [1.0, 0.0])] * 30 + [(i, [1.0, 0.0]) for i in range(2, 12)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = retrieve.cosine_top_k(df.where("id in (1, 5)").dropDuplicates(["id"]), df, "id", "v", 4)
    assert {i: sorted(r.ref_id for r in got.collect() if r.query_id == i) for i in (1, 5)} == {1: [2, 3, 4, 5], 5: [1, 1, 1, 1]}
    assert got.where(F.col("sim") != 1.0).count() == 0
