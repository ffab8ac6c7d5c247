"""Mixing sources to target weights with a low-discrepancy schedule.

Targets: the sources share the total of all sizes by weight; a target stops at
``max_passes`` times its source's size and the excess is shared again.

Schedule: the documents of a source, in a shuffled order, form one stream of
words that is cut into blocks of equal length. Slot ``i`` of the mix falls on
the golden-ratio point ``frac((i + 1) * phi)``; the source whose interval of
cumulative shares holds that point fills the slot with its next block, so its
slots are ranked and rank ``r`` takes block ``r mod blocks``. Slots are drawn
until every source has reached its target; the last block is cut at the target.

Cumulative sums and ranks run in two levels (chunk totals, then inside a
chunk), so that a source with a third of all rows spreads over many tasks.

Defined results: a null text has size 0; documents of size 0 are never taken;
a null source is a source, last in order; repeated rows count one by one and
ties in order cannot show, as copies of an id are numbered; an empty table
gives no rows. The one-row-per-source table is the only data ordered in a
single task.
"""

from __future__ import annotations

import math
from decimal import Decimal, getcontext

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

getcontext().prec = 60
_PHI = (Decimal(5).sqrt() - 1) / 2
_CHUNK = 1 << 20


def word_count(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def golden_point(i: Column) -> Column:
    """frac((i + 1) * phi), in two parts so that doubles keep it exact to about 1e-10 for any long index below 2**40."""
    n = i + 1
    low, high = n % _CHUNK, F.floor(n / _CHUNK)
    step = float(_CHUNK * _PHI % 1)
    return F.pmod(low * float(_PHI) + F.pmod(high * step, F.lit(1.0)), F.lit(1.0))


def numbered(docs: DataFrame, id_col: str, size: Column, source_col: str, piece: int = 10_000) -> DataFrame:
    """id, source, size, the number ``same`` among rows equal in these, and ``copy`` among the rows of the id.

    Equal rows are counted before they are ordered, so that an id that many rows
    repeat, or null, is ordered by its distinct sources and sizes alone.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"))
    counted = narrow.groupBy("id", "source", "size").agg(F.count("*").alias("m"))
    earlier = Window.partitionBy("id").orderBy("source", "size").rowsBetween(Window.unboundedPreceding, -1)
    told = counted.withColumn("earlier", F.coalesce(F.sum("m").over(earlier), F.lit(0)))
    one = F.lit(1).cast("long")
    pieces = told.withColumn("done", F.explode(F.sequence(one - 1, F.col("m") - 1, F.lit(piece).cast("long"))))
    each = pieces.withColumn("same", F.explode(F.sequence(F.col("done") + 1, F.least("m", F.col("done") + piece))))
    return each.select("id", "source", "size", "same", (F.col("earlier") + F.col("same")).alias("copy"))


def source_targets(sources: DataFrame, weights: tuple[float, ...], max_passes: int) -> DataFrame:
    """Adds weight and target to (source, source_size): weights repeat over the sources in order, nulls last."""
    ordered = Window.orderBy(F.asc_nulls_last("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    named = sources.withColumn("weight", F.get(cycle, (F.row_number().over(ordered) - 1) % len(weights)))
    cap = max_passes * F.col("source_size")
    # From the source that reaches its cap first: what the others would get a unit of weight, were all before it capped.
    by_ratio = Window.orderBy(cap / F.col("weight"), F.asc_nulls_last("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    rated = named.withColumn("level", rest / F.sum("weight").over(onward)).withColumn("open", cap / F.col("weight") >= F.col("level"))
    level = F.max(F.when(F.col("open"), F.col("level"))).over(Window.partitionBy())
    first_open = F.min(F.when(F.col("open"), F.struct(cap / F.col("weight"), F.col("level").alias("level")))).over(Window.partitionBy())
    final = F.coalesce(first_open["level"], level, F.lit(0.0))
    return rated.withColumn("target", F.least(cap.cast("double"), F.col("weight") * final)).drop("level", "open")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_passes: int = 3,
    block_words: int = 128,
    chunk_rows: int = 500,
    seed: int = 7,
) -> DataFrame:
    """Per document: id, copy, same, source, size, source_size, target, taken (words the mix takes, repeats counted).

    ``copy`` numbers the rows of an id, ``same`` those of an id that have one
    source and size. Chunks grow with the square root of the rows, so that
    neither their number nor their size makes one task large.
    """
    spark = docs.sparkSession
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), F.col("copy").cast("string")))
    rows = cut(numbered(docs, id_col, word_count(text_col), source_col).withColumn("key", key).withColumn("s", F.struct("source")))
    n = rows.count()
    chunks = max(1, n // max(chunk_rows, math.isqrt(n)))
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("chunk", F.floor(place * chunks / (1 << 32)).cast("long"))

    # One row per source and chunk: where the chunk begins in the source's stream.
    sums = rows.groupBy("s", "chunk").agg(F.sum("size").alias("chunk_size"))
    sources = source_targets(sums.groupBy("s").agg(F.sum("chunk_size").alias("source_size")).withColumn("source", F.col("s.source")), weights, max_passes)
    limit = F.floor("target")
    blocks = F.ceil(F.col("source_size") / block_words)
    passes = F.floor(limit / F.greatest(F.col("source_size"), F.lit(1)))
    need = passes * blocks + F.ceil((limit - passes * F.col("source_size")) / block_words)
    sources = cut(sources.select("s", "source", "source_size", "target", limit.alias("limit"), blocks.alias("blocks"), need.alias("need")))
    starts = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunk_table = sums.withColumn("chunk_at", F.coalesce(F.sum("chunk_size").over(starts), F.lit(0))).drop("chunk_size").join(sources.select("s", "source_size", "target"), "s")
    inside = Window.partitionBy("s", "chunk").orderBy("key", "id", "copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(chunk_table, ["s", "chunk"])
    at = F.col("at") + F.col("chunk_at")
    placed = placed.select("id", "copy", "same", "s", "size", "source_size", "target", at.alias("at"))

    # Documents cut at the block borders; one of size 0 has a single empty piece.
    last = F.floor((F.col("at") + F.greatest(F.col("size"), F.lit(1)) - 1) / block_words)
    pieces = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block_words), last)))
    slots = schedule(spark, sources, block_words)
    both = pieces.join(slots, ["s", "block"], "left")
    begin = F.greatest("at", F.col("block") * block_words)
    end = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_words, F.col("until"))
    words = F.coalesce(F.greatest(end - begin, F.lit(0)), F.lit(0))
    words = F.when(F.col("until").isNull(), 0).otherwise(words)
    return both.groupBy("id", "copy", "same", "s", "size", "source_size", "target").agg(F.sum(words).cast("long").alias("taken")).select(F.col("id").alias(id_col), "copy", "same", F.col("s.source").alias("source"), "size", "source_size", "target", "taken")


def schedule(spark, sources: DataFrame, block_words: int, bins: int = 1024, chunk: int = 4096) -> DataFrame:
    """Filled slots: s, block, slot, and ``until``, the word of the source's stream that the slot stops at."""
    total = sources.agg(F.coalesce(F.sum("need"), F.lit(0)), F.count("*")).first()
    chunk = max(chunk, math.isqrt(total[0]))
    below = Window.orderBy(F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    share = F.lit(float(max(total[0], 1)))
    lo = F.coalesce(F.sum("need").over(below), F.lit(0))
    ranges = sources.where("need > 0").withColumn("lo", lo / share).withColumn("hi", (lo + F.col("need")) / share)
    last_bin = F.greatest(F.ceil(F.col("hi") * bins) - 1, F.floor(F.col("lo") * bins))

    def drawn(begin: int, end: int, wanted: DataFrame) -> DataFrame:
        """The slots begin to end - 1 that fall on the wanted ranges."""
        dealt = wanted.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") * bins), last_bin)))
        points = spark.range(begin, end).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("p")).withColumn("bin", F.floor(F.col("p") * bins))
        hit = (F.col("p") >= F.col("lo")) & (F.col("p") < F.col("hi"))
        return points.join(dealt, "bin").where(hit).select("slot", "s", "source_size", "limit", "blocks", "need", F.floor(F.col("slot") / chunk).alias("part"))

    # The points of a small range may lag behind its share: more are drawn, for such sources only, until each has its slots.
    begin, surplus, wanted, slots, counts = 0, math.ceil(0.02 * total[0]) + 16 * total[1], ranges, None, None
    end = total[0] + surplus
    while True:
        found = drawn(begin, end, wanted)
        n = cut(found.groupBy("s", "part").agg(F.count("*").alias("n")))
        slots, counts = (found, n) if slots is None else (slots.unionByName(found), counts.unionByName(n))
        have = counts.groupBy("s").agg(F.sum("n").alias("have"))
        wanted = cut(ranges.join(have, "s", "left").where("need > coalesce(have, 0)").drop("have"))
        if wanted.isEmpty():
            break
        begin, end, surplus = end, end + 2 * surplus, 2 * surplus
    before = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.groupBy("s", "part").agg(F.sum("n").alias("n"))
    firsts = counts.select("s", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("s", "part").orderBy("slot")
    ranked = slots.withColumn("r", F.row_number().over(inside) - 1).join(firsts, ["s", "part"]).withColumn("rank", F.col("r") + F.col("first")).where(F.col("rank") < F.col("need"))
    passed = F.floor(F.col("rank") / F.col("blocks"))
    return ranked.select("s", (F.col("rank") % F.col("blocks")).alias("block"), "slot", F.least("source_size", F.col("limit") - passed * F.col("source_size")).alias("until"))
