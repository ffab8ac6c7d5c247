import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalmill.llm import runs


def brute(words, least=12):
    """Every maximal stretch of every lag; of one stretch the smallest lag."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def kept(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@st.composite
def repetitive(draw):
    words = draw(st.lists(st.sampled_from(draw(st.sampled_from(["a", "ab", "abc", "abcdefgh"]))), max_size=90))
    for _ in range(draw(st.integers(0, 3)) if words else 0):
        a = draw(st.integers(0, len(words) - 1))
        p = draw(st.integers(1, max(1, (len(words) - a) // 2)))
        for i in range(a, draw(st.integers(a, len(words)))):
            words[i] = words[a + (i - a) % p]
    return words


@settings(max_examples=400, deadline=None)
@given(st.lists(repetitive(), max_size=4), st.sampled_from([2, 3, 6, 12, 13, 40]))
def test_runs_equal_brute_force(texts, least):
    got = list(runs.search([" ".join(t) for t in texts], least))
    for words, (found, collapsed) in zip(texts, got, strict=True):
        assert found == brute(words, least) and collapsed == kept(words, found)


def test_every_gram_repeats_at_a_shorter_lag():
    a, b = [[f"{x}{i}" for i in range(9)] for x in "ab"]
    block = a + a + a + b + a + b + b + b
    words = ["x", *block, *block, *block[:20], "y"]
    assert list(runs.search([" ".join(words)]))[0][0] == brute(words)


def test_classes_cover_every_lag():
    for least in (1, 2, 5, 12, 50):
        at = 1
        for level, low, high in runs.classes(least):
            assert low == at <= high
            for q in range(low, min(high, low + 300) + 1):
                overlap = max(least - q, q)
                assert 2 * (1 << level) - 1 <= overlap < 2 * (2 << level) - 1
            at = high + 1
            if at > 1000:
                break


def test_time_follows_length():
    for unit in ("a ", "a b ", " ".join(map(str, range(5000))) + " "):
        n = 200_000 // len(unit.split())
        began = time.perf_counter()
        (found, collapsed), = runs.search([unit * n])
        assert found == [(0, n * len(unit.split()), len(unit.split()))] and collapsed == unit.strip()
        assert time.perf_counter() - began < 20


def test_spaces_and_borders():
    twelve = "z " * 12
    texts = [twelve, twelve, "z z " * 6, "z\x1cz " * 12, None, "", " \n", "z\x0bz\x0cz\tz\r\nz z " * 2]
    got = list(runs.search(texts))
    assert [r for r, _ in got] == [[(0, 12, 1)], [(0, 12, 1)], [], [(0, 12, 1)], [], [], [], [(0, 12, 1)]]
    assert got[2][1] == " ".join(["z z"] * 6) and got[3][1] == "z\x1cz"


def test_rows(spark):
    random.seed(3)
    texts = [None, "", "a b " * 9, "a b " * 9, "x " * 50_000, " ".join(random.choice("ab") for _ in range(300)), "none of these words is said twice in here at all"]
    df = spark.createDataFrame([(i if i else None, t, 5, "r") for i, t in enumerate(texts)], "doc_id long, text string, length int, runs string")
    got = {r.doc_id: r for r in runs.find(df).withColumn("top", runs.longest(F.col("runs"))).collect()}
    for i, t in enumerate(texts):
        words = (t or "").split()
        r = got[i or None]
        told = [(x.start, x.length, x.period) for x in r.runs]
        assert told == ([(0, 50_000, 1)] if i == 4 else brute(words)) and r.collapsed == kept(words, told) and r.length == 5
        best = min(told, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.top and (r.top.start, r.top.length, r.top.period)) == best
    assert runs.find(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_documents_do_not_meet(size):
    texts = [f"{'q ' * i}r" for i in range(size)]
    assert [len(r) for r, _ in runs.search(texts)] == [int(i >= 12) for i in range(size)]
