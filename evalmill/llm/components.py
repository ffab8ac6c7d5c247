"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id of the links (a, b); the component is its smallest id.

    Each round links every id to the smallest of its neighbourhood, first from
    below, then from above; rounds are written to the shared folder and stop
    when nothing changes. Ids without links have no row; null links are void.
    """
    star = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    star, before = cut(star), None
    for _ in range(max_rounds):
        state = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = star.union(star.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        star = cut(small)
    else:
        raise RuntimeError("components have not settled")
    return star.select(F.col("u").alias("id"), F.col("v").alias("component")).union(star.select(F.col("v"), F.col("v"))).distinct()
