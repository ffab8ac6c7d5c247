import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import SF

from evalmill.llm import queries, whitening

FIELDS = "vec_id long, embedding array<double>, component int, n string, x int"


def table(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, v, 1, "n", 2) for i, v in enumerate(vectors)], FIELDS)


def exact(vectors, scale=256):
    """n, sums and covariance of the distinct whole vectors, in fractions."""
    x = sorted({tuple(math.floor(Fraction(scale) * Fraction(c)) for c in v) for v in vectors})
    n, sums = len(x), [sum(c) for c in zip(*x)]
    d = range(len(sums))
    return n, sums, [[Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x), n**3) for j in d] for i in d]


def residual(cov, value, component):
    """Largest entry of V c - e c, over the largest of V."""
    v = [Fraction(float(c)) for c in component]
    out = [sum(a * b for a, b in zip(row, v, strict=True)) - Fraction(float(value)) * c for row, c in zip(cov, v, strict=True)]
    return float(max(map(abs, out)) / max(abs(a) for row in cov for a in row))


def test_rows_equal_brute_force(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = {r.vec_id: [float(c) for c in r.embedding] for r in df.collect()}
    n, sums, cov = exact(vectors.values())
    model = whitening.fit(df)
    assert (model.n, list(model.sums)) == (n, sums)
    told = np.linalg.eigvalsh(np.array([[float(a) for a in row] for row in cov]))[::-1]
    assert np.allclose(model.values, told[:4], rtol=1e-12)
    for value, component in zip(model.values, model.components, strict=True):
        assert residual(cov, value, component) < 1e-14 and abs(math.fsum(c * c for c in component) - 1) < 1e-15
    got = {(r.vec_id, r.component): r for r in queries.op12_whitening(spark, SF).collect()}
    assert len(got) == 4 * len(vectors)
    trace = float(sum(cov[i][i] for i in range(len(cov))))
    for i, v in vectors.items():
        x = [math.floor(256 * c) for c in v]
        for j in range(4):
            r = got[i, j + 1]
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
            projected = math.fsum(float(a - Fraction(s, n)) * c for a, s, c in zip(x, sums, model.components[j], strict=True)) / math.sqrt(model.values[j])
            assert abs(r.whitened - projected) < 1e-12 and abs(r.explained - told[j] / trace) < 1e-12 and r.identity_error < 1e-10


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.lists(st.sampled_from([0.0, 1e-9, 0.5, 0.5 + 1e-9, 0.5 + 1e-13, 1.0, 1.0 + 3e-8, 7.0]), min_size=12, max_size=12), st.integers(0, 10**6))
def test_eigenvectors_of_clustered_values(d, values, seed):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0].astype(np.longdouble)
    a = q @ np.diag(np.array(values[:d], np.longdouble)) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.refined(a)
    top = max(np.abs(a).max(), np.longdouble(1e-300))
    assert np.abs(a @ x - x * found).max() <= 1e-15 * top * d
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-16 * 4 * d
    assert list(found) == sorted(found, reverse=True)


def test_far_mean_and_narrow_spread(spark):
    rng = np.random.default_rng(5)
    vectors = [[float(2**40 + a), float(-(2**41) + b), float(c)] for a, b, c in rng.integers(0, 5, (200, 3))]
    df = table(spark, vectors + vectors[:50])
    n, _, cov = exact(vectors)
    model = whitening.fit(df)
    assert model.n == n
    assert all(residual(cov, e, c) < 1e-13 for e, c in zip(model.values, model.components, strict=True))
    assert model.identity_error < 1e-9 and whitening.whiten(df, model).count() == 250 * 3


def test_entries_beyond_longs(spark):
    big = [[1e300, 0.0], [-1e300, 1.0], [2.0**50, 2.0], [0.25, -3.0]]
    model = whitening.fit(table(spark, big))
    cut = [[min(max(math.floor(Fraction(256) * Fraction(c)), -(2**63)), 2**63 - 1) for c in v] for v in big]
    assert list(model.sums) == [sum(c) for c in zip(*cut)]
    rows = whitening.whiten(table(spark, big), model).collect()
    assert {r.deviation for r in rows} == {2**63 - 1} and all(math.isfinite(r.whitened) for r in rows)


def test_odd_rows(spark):
    good = [[0.5, 0.25, 1.0], [0.5, 0.25, -1.0], [0.1, 0.0, 1.0]]
    bad = [None, [], [None, 1.0, 2.0], [float("nan")] * 3, [float("inf"), 0.0, 0.0], [1.0, 2.0]]
    df = table(spark, good + bad + good)
    ids = spark.createDataFrame([(None, good[0], 1, "n", 2), (2**60 + 1, good[1], 1, "n", 2)], FIELDS)
    model = whitening.fit(df.union(ids))
    rows = whitening.whiten(df.union(ids), model).collect()
    assert model.n == 3 and len(model.values) == 2  # three points span two directions
    assert {r.vec_id for r in rows} == {0, 1, 2, 9, 10, 11, None, 2**60 + 1} and len(rows) == 16
    same = {(r.component, r.whitened) for r in rows if r.vec_id in (0, 9, None)}
    assert len(same) == 2


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]] * 5, [None]])
def test_nothing_to_fit(spark, vectors):
    df = table(spark, vectors)
    assert whitening.whiten(df, whitening.fit(df)).count() == 0


def test_sums_do_not_depend_on_parts(spark):
    rng = np.random.default_rng(8)
    df = table(spark, rng.normal(size=(300, 5)).tolist()).cache()
    assert whitening.fit(df.repartition(1)).components == whitening.fit(df.repartition(7)).components
