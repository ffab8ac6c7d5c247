import math
import re
from collections import Counter

import pytest
from oracle import SF
from pyspark.sql import functions as F

from evalmill.functions import text as T
from evalmill.operators import common, fuse
from evalmill.plans import registry


def grams(text, high):
    words = re.findall("[a-z0-9]+", (text or "").lower())
    return [" ".join(words[i : i + n]) for n in range(1, high + 1) for i in range(len(words) - n + 1)]


def test_word_ngrams_and_hashed_vectors_brute_force(spark):
    texts = ["a b a b", "", None, "one", "x y z x y z x y z", "  Many, many  words -- many "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    g = T.word_ngrams(F.col("text"), 1, 2)
    buckets = F.transform(g, lambda x: F.pmod(F.xxhash64(x), F.lit(7)).cast("int"))
    for r in df.select("text", g.alias("g"), buckets.alias("b"), T.hashed_counts(g, 7).alias("c"), T.hashed_vector(g, 7).alias("v"), T.hashed_set(g, 7).alias("s")).collect():
        assert r.g == grams(r.text, 2)
        want = Counter(r.b)
        assert {c.bucket: c.n for c in r.c} == want and set(r.s) == set(want)
        norm = math.sqrt(sum(n * n for n in want.values()))
        assert r.v == pytest.approx({b: n / norm for b, n in want.items()})


def test_char_vector_of_a_document(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").limit(5)
    for r in rows.select(T.hashed_vector(T.char_ngrams(F.substring("text", 1, 300), 2, 3), 64).alias("v")).collect():
        assert sum(w * w for w in r.v.values()) == pytest.approx(1.0)


def test_monotonic_bridge_is_monotone_and_flat_outside(spark):
    train = spark.createDataFrame([(0.1, 1.0), (0.2, 3.0), (0.3, 2.0), (0.4, 5.0)], "x double, y double")
    out = fuse.monotonic_bridge(train, spark.createDataFrame([(0.0,), (0.1,), (0.2,), (0.25,), (0.3,), (0.4,), (9.0,)], "x double"), "x", "y").orderBy("x").collect()
    assert [r.bridged for r in out] == [1.0, 1.0, 2.5, 2.5, 2.5, 5.0, 5.0]


def test_checkpoint_folder_is_kept(spark):
    assert common.shared_folder(spark) == common.shared_folder(spark)


def test_entity_ties_go_to_the_first_row_of_the_table(spark, tmp_path):
    rows = [(k, o, 1, f"2000-01-{d:02}") for k in range(20) for o, d in ((7, 9), (7, 3), (8, 1), (7, 5))]
    spark.createDataFrame(rows, "l_partkey long, l_orderkey long, l_linenumber int, l_shipdate string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = registry.queries()["entity_table"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == [(k, "2000-01-09") for k in range(20)]
