"""Exact top-k inner-product search with multi-resolution segment statistics.

A vector is cut into segments. For a segment of length L the inner product of
two vectors is at most ``L * mean * mean + L * deviation * deviation``; the sum
over segments bounds the whole from above, that is, it bounds the distance from
below. Bounds run from coarse to fine segments; what survives is computed
exactly, in integers. Queries and candidates meet in blocks of bounded size.

Defined results: vectors that are null, or hold a null or non-finite component,
take no part; vectors only meet others of their own length (the empty vector
scores 0); ties go to the smaller id; repeated rows are candidates each of
their own, while a repeated query counts once per id (its largest vector);
scores are exact for every finite vector, and one beyond a long becomes the
nearest long; null ids take no part; an empty table gives no rows; other columns
never matter.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SEGMENTS = (4, 8, 16)


def quantized(vec_col: str, scale: int) -> Column:
    """floor(scale * x) of each component as double, or null if the vector takes no part."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    most = F.lit(sys.float_info.max)

    def whole(x: Column) -> Column:
        scaled = F.greatest(-most, F.least(most, F.lit(float(scale)) * x.cast("double")))
        # From 2**52 on every double is a whole number.
        return F.when(F.abs(scaled) < float(1 << 52), F.floor(scaled).cast("double")).otherwise(scaled)

    return F.when(v.isNotNull() & ~bad, F.transform(v, whole))


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of a vector with the rows of a matrix, all of whole doubles, as int64; beyond that range its nearest end."""
    terms = np.abs(c) @ np.abs(q)  # bounds every partial sum
    if not len(c) or terms.max() < 2.0**53:
        return (c @ q).astype(np.int64)
    out = np.empty(len(c), np.int64)
    small = terms < 2.0**53
    out[small] = (c[small] @ q).astype(np.int64)
    whole = [int(x) for x in q]
    for i in np.flatnonzero(~small):
        score = sum(int(x) * y for x, y in zip(c[i], whole, strict=True))
        out[i] = min(max(score, -(1 << 63)), (1 << 63) - 1)
    return out


def segment_features(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows of sqrt(L)*mean and sqrt(L)*deviation per segment, whose dot products bound inner products."""
    pieces = np.array_split(x, min(parts, x.shape[1]), axis=1)
    out = []
    for p in pieces:
        root, mean = np.sqrt(p.shape[1]), p.mean(axis=1)
        out += [root * mean, root * np.sqrt(np.maximum((p * p).mean(axis=1) - mean * mean, 0))]
    return np.stack(out, axis=1)


def search_block(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, candidate id, score) of the k best candidates of every query."""
    found: list[tuple[int, int, int]] = []
    if not len(cid) or not len(qid):
        return found
    levels = [] if q.shape[1] == 0 else [(segment_features(q, s), segment_features(c, s)) for s in SEGMENTS if s <= q.shape[1]] or [(segment_features(q, 1), segment_features(c, 1))]
    # Rounding errors of bounds and scores stay far below this share of the vectors' lengths.
    slack = 1e-9 * np.sqrt((q * q).sum(axis=1)) * np.sqrt((c * c).sum(axis=1).max()) + 1e-3
    for i in range(len(qid)):
        live = np.flatnonzero(cid != qid[i])
        if levels and len(live) > 2 * k and np.isfinite(slack[i]):
            bound = levels[0][1][live] @ levels[0][0][i]
            best = np.argpartition(bound, -2 * k)[-2 * k :]
            # The k-th best of some scores is a floor.
            floor = np.partition(c[live[best]] @ q[i], -k)[-k]
            for n, (fq, fc) in enumerate(levels):
                if n:
                    bound = fc[live] @ fq[i]
                live = live[bound >= floor - slack[i]]
        scores = exact_scores(q[i], c[live])
        order = np.lexsort((cid[live], -scores.astype(object) if len(scores) and scores.min() == -(1 << 63) else -scores))[:k]
        found += [(int(qid[i]), int(cid[live[j]]), int(scores[j])) for j in order]
    return found


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    scale: int = 1024,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    query_block: int = 512,
    candidate_block: int = 8192,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k best other rows for every query.

    Each query block meets each candidate block in one task; the block counts
    follow the row counts, so that a task's size stays the same.
    """
    given = vectors.select(F.col(id_col).alias("id"), quantized(vec_col, scale).alias("v"), is_query.alias("q")).where("v is not null and id is not null")
    n, nq = given.agg(F.count("*"), F.count_if("q")).first()
    blocks, query_blocks = -(-n // candidate_block) or 1, -(-nq // query_block) or 1
    dims = F.size("v").alias("d")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    # Equal rows spread over the blocks too: the place in the table, fixed in the shared folder, is part of the hash.
    placed = cut(given.select("id", "v", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("cb")))
    held = placed.select(dims, every(query_blocks).alias("qb"), "cb", "id", "v")
    queries = given.where("q").groupBy("id").agg(F.max("v").alias("v"))
    asked = queries.select(dims, F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("qb"), every(blocks).alias("cb"), "id", "v")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[int, int, int]] = []
        if len(left) and len(right):
            c = np.stack(right["v"].to_numpy()).astype(np.float64)
            for i in range(0, len(left), query_block):
                part = left.iloc[i : i + query_block]
                rows += search_block(part["id"].to_numpy(), np.stack(part["v"].to_numpy()).astype(np.float64), right["id"].to_numpy(), c, k)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    keys = ("d", "qb", "cb")
    near = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
