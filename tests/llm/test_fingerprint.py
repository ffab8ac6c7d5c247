import hashlib
import re

from oracle import SF
from pyspark.sql import functions as F

from evalmill.llm import fingerprint, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = fingerprint.Sketch(width=3, size=8)


def hashes(text, settings):
    w = WORD.findall(text or "")
    grams = [w[i : i + settings.width] for i in range(max(1, len(w) - settings.width + 1))] if w else []
    return {hashlib.md5(" ".join(g).encode()).hexdigest()[:16] for g in grams}


def sketched(text, settings):
    return sorted(hashes(text, settings))[: settings.size]


def alike(a, b, size):
    if not a and not b:
        return 1.0
    u = sorted({*a, *b})[:size]
    return len({*u} & {*a} & {*b}) / len(u)


def edit(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def words(n, step=7):
    return " ".join(str(i * step % 1009) for i in range(n))


TEXTS = {5000: "", 4000: None, 900: words(400), 899: words(400), 70: "x", 64: "é😀 ü b" * 9, 63: "one two", 1: words(50, 3), 0: " \n ", -1: "end of all " * 2000, -70: words(12)}


def test_rows_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in TEXTS.items()], "doc_id long, text string, bucket string, n_chars long, edited string")
    got = {r.doc_id: r for r in fingerprint.compared(df, SMALL).collect()}
    order = sorted(TEXTS, reverse=True)
    for i, after in zip(order, [*order[1:], order[0]], strict=True):
        text, following = TEXTS[i] or "", TEXTS[after] or ""
        row = got[i]
        assert (row.n_chars, row.edited) == (len(text), edit(text, following))
        assert (row.sketch, row.edited_sketch, row.next_sketch) == tuple(sketched(t, SMALL) for t in (text, row.edited, following))


def test_estimates_equal_brute_force(spark):
    rows = [(a, b, sketched(a, SMALL), sketched(b, SMALL)) for a in TEXTS.values() for b in TEXTS.values()]
    df = spark.createDataFrame(rows, "a string, b string, x array<string>, y array<string>")
    told = df.select("a", "b", "x", "y", fingerprint.resemblance(F.col("x"), F.col("y"), SMALL).alias("r"), fingerprint.containment(F.col("x"), F.col("y"), SMALL).alias("c"), fingerprint.merged(F.col("x"), F.col("y"), SMALL).alias("m"), fingerprint.parsed(fingerprint.printed(F.col("x"))).alias("p"))
    for r in told.collect():
        both = hashes(r.a, SMALL) | hashes(r.b, SMALL)
        assert r.m == sorted(both)[: SMALL.size] and r.p == r.x
        assert r.r == alike(r.x, r.y, SMALL.size)
        seen = {*r.m} & {*r.x}
        assert r.c == (1.0 if not r.x else 0.0 if not r.y else len(seen & {*r.y}) / len(seen) if seen else None)


def test_sketches_of_parts_merge(spark):
    texts = [words(n, s) for n, s in ((300, 7), (300, 11), (4, 3), (200, 7))] + [None, ""]
    df = spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "part int, text string").withColumn("s", fingerprint.sketch(F.col("text"), SMALL))
    got = {r.part: r for r in fingerprint.merge_rows(df, ["part"], "s", SMALL).withColumn("n", fingerprint.distinct_shingles(F.col("s"), SMALL)).collect()}
    for part in (0, 1):
        assert got[part].s == sorted(set().union(*(hashes(t, SMALL) for t in texts[part::2])))[: SMALL.size]


def test_count_of_distinct_shingles(spark):
    wide = fingerprint.Sketch(1, 256)
    df = spark.createDataFrame([(n, " ".join(map(str, range(n)))) for n in (0, 1, 255, 5000)], "n int, text string")
    got = {r.n: r.told for r in df.select("n", fingerprint.distinct_shingles(fingerprint.sketch(F.col("text"), wide), wide).alias("told")).collect()}
    assert (got[0], got[1], got[255]) == (0, 1, 255) and abs(got[5000] - 5000) < 5000 / 4


def test_odd_rows(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, None), (None, "no id"), (None, None), (7, "w " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprint.compared(df, SMALL).collect()
    assert len(got) == 6
    alone = [r for r in got if r.doc_id is None]
    assert sorted(r.edited for r in alone) == ["", "no id"] and all(r.next_sketch is None for r in alone)
    assert len({tuple(r.sketch) for r in got if r.doc_id == 1 and r.n_chars == 5}) == 1
    assert fingerprint.compared(df.limit(0), SMALL).count() == 0


def test_order_over_many_parts(spark):
    ids = [7 * i * i - 5000 for i in range(300)]
    df = spark.createDataFrame([(i,) for i in ids], "k long")
    falling = sorted(ids, reverse=True)
    assert {(r.k, r.next) for r in fingerprint.next_of(df, "k").collect()} == set(zip(falling, [*falling[1:], falling[0]], strict=True))


def test_edited_texts_stay_near(spark):
    rows = queries.op11_fingerprint(spark, SF).where("n_chars > 2000").collect()
    assert sum(r.near_edited > r.near_next for r in rows) >= 0.98 * len(rows)
