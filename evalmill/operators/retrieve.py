"""Nearest labelled rows: exact top-k by cosine or set similarity, and what they say."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, joined
from .curate import sample_rows
from .metrics import evaluate
from .nearest import Ranking, Search
from .search import columns, in_shells


def _best(s: np.ndarray, rid: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest similarities above -inf, ties to the smaller id."""
    best = np.flatnonzero(s >= np.partition(s, -k)[-k]) if len(s) > k else np.arange(len(s))
    best = best[s[best] > -np.inf]
    return best[np.lexsort((rid[best], -s[best]))][:k]


#: Similarities that a task holds at a time.
HELD = 1 << 20


def _searched(queries: DataFrame, reference: DataFrame, id_col: str, vec_col: str, further: dict[str, Column], find: Search, schema: str, query_block: int, reference_block: int) -> DataFrame:
    """Queries meet references as (id, v, further columns): where these fill more than two blocks, through shells of angles that leave blocks out (``search``). Rows without an id take no part."""
    q, r = (columns(d.where(F.col(id_col).isNotNull()), id_col, vec_col, further) for d in (queries, reference))
    asked, held = q.count(), r.count()

    def meet(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        return find.meet(q, r)

    if held > 2 * reference_block:
        per, kinds = (find.per,) if find.per else (), len(find.rankings)
        return in_shells(q, r, meet, schema, find.k, max(query_block, min(asked // 16, 8 * query_block)), reference_block, per, kinds, find)
    deals, parts = max(1, -(-asked // query_block)), 2

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = q.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(deals)).cast("int")).withColumn("rb", every(parts))
    right = r.withColumn("qb", every(deals)).withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    return left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(meet, schema)


def cosine_top_k(queries: DataFrame, reference: DataFrame, id_col: str, vec_col: str, k: int = 8, query_block: int = 1024, reference_block: int = 8192) -> DataFrame:
    """query_id, rank, ref_id, sim of the k most similar other rows; a zero vector has similarity 0; ties to the smaller id."""
    return top_k(_searched(queries, reference, id_col, vec_col, {}, Search(k), "query_id long, ref_id long, sim double", query_block, reference_block), k)


def within_budget(reference: DataFrame, id_col: str, budget: int | None, seed: int = 0) -> DataFrame:
    """At most ``budget`` reference rows (None: all), drawn by a seeded hash of their ids."""
    return reference if budget is None else sample_rows(reference, budget, [id_col], seed)


def top_k(near: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "ref_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "ref_id", "sim")


def _by_rarity(sets: DataFrame, held: DataFrame) -> DataFrame:
    """(id, n, m, df, pos) for each member m of each set: df rows of the reference hold it; pos counts from the rarest, from 1 on."""
    each = sets.select("id", F.size("v").alias("n"), F.explode("v").alias("m")).join(held, "m", "left")
    row = F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "m")))
    return each.groupBy("id", "n").agg(row.alias("row")).select("id", "n", F.posexplode("row").alias("at", "x")).select("id", "n", "x.m", "x.df", (F.col("at") + 1).alias("pos"))


def _set_similarity(pairs: DataFrame, q: DataFrame, r: DataFrame) -> DataFrame:
    """query_id, ref_id, sim of distinct pairs, from the whole sets."""
    left, right = q.select(F.col("id").alias("query_id"), F.col("v").alias("x")), r.select(F.col("id").alias("ref_id"), F.col("v").alias("y"))
    both = pairs.join(left, "query_id").join(right, "ref_id").withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.select("query_id", "ref_id", (F.col("common") / (F.size("x") + F.size("y") - F.col("common"))).alias("sim"))


def _common(q: pd.DataFrame, r: pd.DataFrame, members: int, width: int = 1024) -> np.ndarray:
    """Members in common of every query (rows) and reference (columns), whose ``v`` hold numbers below ``members``; so many numbers at a time."""
    def spread(sets: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets.to_numpy())

    (qi, qm), (ri, rm) = spread(q["v"]), spread(r["v"])
    common = np.zeros((len(q), len(r)), np.float32)
    for low in range(0, members, width):
        a, b = (np.zeros((len(d), min(width, members - low)), np.float32) for d in (q, r))
        for held, at, m in ((a, qi, qm), (b, ri, rm)):
            here = (m >= low) & (m < low + width)
            held[at[here], m[here] - low] = 1
        common += a @ b.T
    return common


def _dense_sets(asked: DataFrame, index: DataFrame, held: DataFrame, k: int, block: int = 8192) -> DataFrame:
    """query_id, rank, ref_id, sim of sets over few members, which most rows share: blocks of queries meet blocks of references as rows of 0 and 1."""
    code = cut(held.select("m", (F.row_number().over(Window.orderBy("m")) - 1).alias("code")))
    members = code.count()
    q = cut(asked.join(F.broadcast(code), "m").groupBy("id", "n").agg(F.collect_list("code").alias("v")))
    r = cut(index.withColumnsRenamed({"ref_id": "id", "rn": "n"}).join(F.broadcast(code), "m").groupBy("id", "n").agg(F.collect_list("code").alias("v")))
    deals, parts = (max(1, -(-d.count() // block)) for d in (q, r))

    def meet(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        qid, place, sim, ids = [], [], [], r["id"].to_numpy()
        step = max(1, HELD // max(1, len(r)))
        for start in range(0, len(q) if len(r) else 0, step):
            some = q.iloc[start : start + step]
            both = _common(some, r, members).astype(float)
            s = np.where(both > 0, both / (some["n"].to_numpy()[:, None] + r["n"].to_numpy() - both), -np.inf)
            for one, j in zip(some["id"].to_numpy(), s, strict=True):
                j[ids == one] = -np.inf
                best = _best(j, ids, k)
                qid.append(np.full(len(best), one)), place.append(best), sim.append(j[best])
        at = np.concatenate(place) if place else []
        return pd.DataFrame({"query_id": np.concatenate(qid) if qid else [], "ref_id": ids[at] if place else [], "sim": np.concatenate(sim) if sim else []})

    def own(n: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    left = q.withColumn("qb", own(deals)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = r.withColumn("rb", own(parts)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    return top_k(left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(meet, "query_id long, ref_id long, sim double"), k)


def set_top_k(queries: DataFrame, reference: DataFrame, id_col: str, set_col: str, k: int = 8, query_block: int | None = None, reference_block: int | None = None, look: int = 64, fill: bool = False, least: int = 1_000_000) -> DataFrame:
    """The k most similar other rows by Tanimoto similarity of two sets, over rows that share a member.

    With ``fill``, where fewer than k share one, the smallest other ids follow
    with similarity 0. Blocks are no longer needed; their sizes are taken and ignored.

    An index from members to rows. Its rarest members (in at most ``look`` rows)
    give each query some partners and so a floor, the k-th best of their
    similarities. Two sets that reach it overlap by a number that follows from
    their sizes, so that they share one of their rarest members each (the
    prefix), and their sizes are near; only such pairs are compared. Null members
    do not count; rows with a null set take no part; ties go to the smaller id.

    Where the index would join more rows (and more than ``least``) than whole
    blocks of 0 and 1 cost, as few members are in most rows, blocks meet instead.
    """
    q, r = (columns(d.withColumn(set_col, F.array_distinct(F.array_compact(F.col(set_col).cast("array<string>")))), id_col, set_col, {}, "array<string>") for d in (queries, reference))
    held = r.select(F.explode("v").alias("m")).groupBy("m").agg(F.count("*").alias("df"))
    asked, index = cut(_by_rarity(q, held)), _by_rarity(r, held).select(F.col("id").alias("ref_id"), F.col("n").alias("rn"), "m", F.col("pos").alias("rpos"))
    index = cut(index)
    other = F.col("id") != F.col("ref_id")
    rare = asked.where(F.col("df").between(1, look)).join(index, "m").where(other).select(F.col("id").alias("query_id"), "ref_id").distinct()
    first = top_k(_set_similarity(rare, q, r), k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("sim").alias("floor"))
    floor, n, rn = F.coalesce("floor", F.lit(0.0)), F.col("n"), F.col("rn")
    # The least overlap at the floor: with the smallest partner before the join, with this one after it.
    prefix = F.col("pos") <= n - F.greatest(F.ceil(floor * n - 1e-9), F.lit(1)) + 1
    overlap = F.greatest(F.ceil(floor / (1 + floor) * (n + rn) - 1e-9), F.lit(1))
    within = (F.col("pos") <= n - overlap + 1) & (F.col("rpos") <= rn - overlap + 1) & (rn >= floor * n - 1e-9) & (rn * floor <= n + 1e-9)
    reached = asked.where("df > 0").join(first, "id", "left").where(prefix)
    met = reached.agg(F.sum("df")).first()[0] or 0
    # A product of blocks costs a pair about as much as 1/50 of a joined row, and as one row for 5000 members.
    if met > least and met > q.count() * r.count() * (1 / 50 + held.count() / 5000):
        near = _dense_sets(asked.where("df > 0"), index, held, k)
    else:
        pairs = reached.join(index, "m").where(other & within).select(F.col("id").alias("query_id"), "ref_id").distinct()
        near = top_k(_set_similarity(pairs, q, r), k)
    if not fill:
        return near
    near = cut(near)
    counts = near.groupBy("query_id").agg(F.count("*").alias("n"))
    short = q.select(F.col("id").alias("query_id")).join(counts, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < k)
    # A query passes over itself and its own neighbours at most: 2k rows are enough for all.
    lowest = r.select(F.col("id").alias("ref_id")).orderBy("ref_id").limit(2 * k)
    rest = short.join(F.broadcast(lowest), F.col("query_id") != F.col("ref_id")).join(near.select("query_id", "ref_id"), ["query_id", "ref_id"], "left_anti")
    rest = rest.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("ref_id")) + F.col("n")).where(F.col("rank") <= k)
    return near.unionByName(rest.select("query_id", F.col("rank").cast("int").alias("rank"), "ref_id", F.lit(0.0).alias("sim")))


def label_summary(queries: DataFrame, near: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """Per query: weighted and plain mean label, deviation, mean and largest similarity, count of ones; zeros where there is no neighbour."""
    found = near.join(labels.select(F.col(id_col).alias("ref_id"), F.col(label_col).cast("double").alias("y")), "ref_id")
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("sim"))) + 1e-6
    stats = {"mean_label": F.avg("y"), "std_label": F.stddev_pop("y"), "mean_sim": F.avg("sim"), "max_sim": F.max("sim"), "n_ones": F.sum("y"), "weighted_label": F.sum(F.col("y") * w) / F.sum(w)}
    found = found.groupBy("query_id").agg(*[c.alias(n) for n, c in stats.items()])
    return queries.select(F.col(id_col).alias("query_id")).join(found, "query_id", "left").select("query_id", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in stats])


def shortcut_scores(queries: DataFrame, reference: DataFrame, id_col: str, vec_col: str, label_col: str, same: dict[str, str | tuple[str, ...]], k: int, high: float = 0.85, query_block: int = 1024, reference_block: int = 8192) -> DataFrame:
    """Per condition and query: y, n, score, agreement, mean_sim of the k nearest legal rows of the whole reference.

    Conditions: original, without those that share each named attribute (all of
    them where several are named; null is never shared), without those of high
    similarity, and without all of them. The score is the mean label of the
    neighbours, the reference's prevalence where there is none. ``label_free`` is
    the mean similarity of the original neighbours, 0 without any.
    """
    groups = {n: (a,) if isinstance(a, str) else tuple(a) for n, a in same.items()}
    columns = {a: f"a{i}" for i, a in enumerate(dict.fromkeys(a for g in groups.values() for a in g))}
    held = {n: tuple(columns[a] for a in g) for n, g in groups.items()}
    rankings = (Ranking("original"), *(Ranking(f"no_same_{n}", (g,)) for n, g in held.items()), Ranking("no_high_similarity", (), high), Ranking("no_shortcut", tuple(held.values()), high))
    conditions = [x.name for x in rankings]
    find = Search(k, rankings, (("y", "y_r"),), "condition")

    y = F.col(label_col).cast("double")
    further = {"y": y, **{c: F.col(a).cast("string") for a, c in columns.items()}}
    found = _searched(queries, reference, id_col, vec_col, further, find, "condition string, query_id long, ref_id long, sim double, y_r double", query_block, reference_block)
    order = Window.partitionBy("condition", "query_id").orderBy(F.desc("sim"), "ref_id")
    near = found.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k).drop("__r")
    asked = queries.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("query_id"), y.alias("y"), F.explode(F.array(*map(F.lit, conditions))).alias("condition"))
    stats = [F.count("ref_id").alias("n"), F.avg("y_r").alias("score"), F.avg((F.col("y_r") == F.col("y")).cast("int")).alias("agreement"), F.avg("sim").alias("mean_sim")]
    per = asked.join(near, ["condition", "query_id"], "left").groupBy("condition", "query_id", "y").agg(*stats)
    rate = reference.where(F.col(vec_col).isNotNull()).agg(F.avg(y).alias("__rate"))
    both = F.when(F.col("condition") == "original", F.array(F.lit("original"), F.lit("label_free"))).otherwise(F.array("condition"))
    told = per.crossJoin(F.broadcast(rate)).withColumn("condition", F.explode(both))
    score = F.when(F.col("condition") == "label_free", F.coalesce("mean_sim", F.lit(0.0))).otherwise(F.coalesce("score", "__rate"))
    return told.select("condition", "query_id", "y", "n", score.alias("score"), "agreement", "mean_sim")


def shortcut_audit(scores: DataFrame) -> DataFrame:
    """How neighbours answer when shortcuts are removed, from ``shortcut_scores``.

    Per condition: queries (those without neighbours too), mean neighbours, mean
    score, its neighbours' agreement with the query's own label, mean similarity.
    """
    return scores.groupBy("condition").agg(F.count("*").alias("n_queries"), F.avg("n").alias("mean_neighbours"), F.avg("score").alias("mean_label"), F.avg("agreement").alias("agreement"), F.avg("mean_sim").alias("mean_sim"))


def shortcut_metrics(scores: DataFrame) -> DataFrame:
    """The audit and the metrics of the scores as predictions per condition."""
    rows = scores.persist()  # read by each metric
    return joined(shortcut_audit(rows), evaluate(rows, ["condition"], "query_id", "y", "score"), ["condition"])


def multi_view(queries: DataFrame, reference: DataFrame, id_col: str, label_col: str, views: dict[str, str], k: int = 8) -> DataFrame:
    """Neighbour label summaries per view in one wide table, a column ``{view}_{statistic}`` each.

    A view takes part where its vector is present (not null nor empty) on both
    sides and the reference has at least two such rows; zeros otherwise.
    """
    out = queries.select(F.col(id_col).alias("query_id"))
    for view, column in views.items():
        here = [d.where(F.size(F.coalesce(column, F.array().cast("array<double>"))) > 0) for d in (queries, reference)]
        rows = here[1] if here[1].limit(2).count() == 2 else here[1].limit(0)
        found = label_summary(queries, cosine_top_k(here[0], rows, id_col, column, k), reference, id_col, label_col)
        out = out.join(found.select("query_id", *[F.col(c).alias(f"{view}_{c}") for c in found.columns[1:]]), "query_id")
    return out


def exposure(near: DataFrame, rows: DataFrame, id_col: str, same: dict[str, str], high: float = 0.85) -> DataFrame:
    """Per query the share of neighbours that have each named attribute in common, and of those with high similarity."""
    attributes = list(dict.fromkeys(same.values()))
    q = rows.select(F.col(id_col).alias("query_id"), *[F.col(a).alias(f"q_{a}") for a in attributes])
    r = rows.select(F.col(id_col).alias("ref_id"), *[F.col(a).alias(f"r_{a}") for a in attributes])
    shares = [F.avg(F.coalesce(F.col(f"q_{a}") == F.col(f"r_{a}"), F.lit(False)).cast("int")).alias(f"share_{n}") for n, a in same.items()]
    return near.join(q, "query_id").join(r, "ref_id").groupBy("query_id").agg(*shares, F.avg((F.col("sim") >= high).cast("int")).alias("share_high"))


def reliance(fused: Column, current: Column, retrieved: Column) -> Column:
    """How far a fused probability has moved from the current towards the retrieved one, in [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.abs(fused - current) / (F.abs(retrieved - current) + 1e-8)))


def encoded_once(df: DataFrame, text_col: str, encode, width: int, cache: DataFrame | None = None, name: str = "vec") -> DataFrame:
    """Adds a vector per text: each distinct text is encoded once, cached ones (text, vec) are reused, empty and null texts get zeros.

    ``encode`` maps an iterator of pandas frames with a column text to frames
    with text and vec.
    """
    wanted = df.where(F.length(F.coalesce(F.col(text_col), F.lit(""))) > 0).select(F.col(text_col).alias("text")).distinct()
    new = wanted if cache is None else wanted.join(cache.select("text"), "text", "left_anti")
    table = new.mapInPandas(encode, "text string, vec array<double>")
    table = table if cache is None else table.unionByName(cache.select("text", "vec"))
    zero = F.array_repeat(F.lit(0.0), width)
    return df.join(table.select(F.col("text").alias(text_col), F.col("vec").alias("__vec")), text_col, "left").withColumn(name, F.coalesce("__vec", zero)).drop("__vec")
