"""Document fingerprints: bottom-k sketches of shingle hashes, in Spark SQL expressions alone.

A text's sketch is the ``size`` smallest hashes of its distinct word shingles,
sorted. Hashes are the first 16 hexadecimal digits of MD5, so that any engine can
repeat them. Sketches merge: the sketch of a union is the smallest hashes of the
sketches' union, in whatever parts the shingles came. Two sketches tell
resemblance, containment and the number of distinct shingles.

Defined results: null and empty texts, and texts without words, have an empty
sketch; a text shorter than a shingle is one shingle; two empty sketches
resemble each other fully, an empty one and another not at all; repeated rows
get equal sketches; other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Hexadecimal digits of a hash.
DIGITS = 16


@dataclass(frozen=True)
class Sketch:
    """width: words a shingle. size: hashes that a sketch keeps."""

    width: int = 5
    size: int = 128


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingles(text: Column, width: int) -> Column:
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    last = lambda w: F.greatest(F.size(w) - (width - 1), F.lit(1))
    return bound(words, lambda w: F.transform(F.slice(w, F.lit(1), last(w)), lambda _, i: F.array_join(F.slice(w, i + 1, F.lit(width)), " ")))


def smallest(hashes: Column, size: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)


def sketch(text: Column, settings: Sketch = Sketch()) -> Column:
    return smallest(F.transform(shingles(text, settings.width), lambda s: F.substring(F.md5(s), 1, DIGITS)), settings.size)


def merged(a: Column, b: Column, settings: Sketch = Sketch()) -> Column:
    """The sketch of the union of what two sketches stand for."""
    return smallest(F.concat(a, b), settings.size)


def merge_rows(sketches: DataFrame, keys: list[str], column: str, settings: Sketch = Sketch()) -> DataFrame:
    """keys and the merged sketch of each group's rows.

    Each task sends at most ``size`` hashes of a group on, however large the group is.
    """
    hashes = sketches.select(*keys, F.explode(column).alias("__h")).distinct()
    order = Window.partitionBy(*keys).orderBy("__h")
    kept = hashes.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= settings.size)
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list("__h")).alias(column))


def _shares(a: Column, b: Column, settings: Sketch, of) -> Column:
    """Of the union's sketch the hashes that both hold, over those that ``of`` counts."""
    return bound(merged(a, b, settings), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / of(u))


def resemblance(a: Column, b: Column, settings: Sketch = Sketch()) -> Column:
    """The estimated shared part of all shingles of both."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(_shares(a, b, settings, F.size))


def containment(a: Column, b: Column, settings: Sketch = Sketch()) -> Column:
    """The estimated part of a's shingles that b holds; 1 for an empty a, null where the union's sketch holds none of a's."""
    inside = _shares(a, b, settings, lambda u: F.nullif(F.size(F.array_intersect(u, a)), F.lit(0)))
    return F.when(F.size(a) == 0, 1.0).when(F.size(b) == 0, 0.0).otherwise(inside)


def distinct_shingles(a: Column, settings: Sketch = Sketch()) -> Column:
    """The number of distinct shingles: exact below ``size``, else estimated from the largest hash kept."""
    unit = (F.conv(F.substring(F.element_at(a, -1), 1, 13), 16, 10).cast("double") + 1) / float(16**13)
    return F.when(F.size(a) < settings.size, F.size(a).cast("double")).otherwise((settings.size - 1) / unit)


def printed(a: Column) -> Column:
    """A sketch as a string: its hashes one after the other."""
    return F.array_join(a, "")


def parsed(text: Column) -> Column:
    """A sketch back from its string."""
    return F.regexp_extract_all(text, F.lit(f".{{{DIGITS}}}"), F.lit(0))


def next_of(keys: DataFrame, key: str) -> DataFrame:
    """(key, next) for distinct keys: the next smaller one; after the smallest comes the largest.

    Ranges of keys first, in as many parts as a shuffle has, then the order in
    each; only one row a part is ordered whole. The parts are kept in the shared
    folder, so that a lost task finds the same ones.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(keys.select(key).repartitionByRange(parts, F.desc(key)).withColumn("__part", F.spark_partition_id()))
    inside = dealt.withColumn("next", F.lead(key).over(Window.partitionBy("__part").orderBy(F.desc(key))))
    firsts = dealt.groupBy("__part").agg(F.max(key).alias("__first"))
    falling = Window.orderBy(F.desc("__first"))
    after = F.coalesce(F.lead("__first").over(falling), F.max("__first").over(falling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    borders = firsts.select("__part", after.alias("__after"))
    return inside.join(borders, "__part").select(key, F.coalesce("next", "__after").alias("next"))


def with_next(docs: DataFrame, carry: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", bits: int = 6) -> DataFrame:
    """id, text, the columns ``carry`` computed from ``text``, and next_text and next_{column} of the next document, by falling id.

    After the smallest id comes the largest. Texts are shuffled once, to buckets
    of ``2 ** bits`` neighbouring ids; only each bucket's first row goes to the
    bucket before. Rows of a repeated id follow each other by their texts'
    digests; rows without an id have no next document (nulls).
    """
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = given.withColumn("bucket", F.shiftright("id", bits)).where("id is not null and bucket is not null")  # named, so that both uses share one shuffle
    order = Window.partitionBy("bucket").orderBy(F.desc("id"), F.md5(F.coalesce("text", F.lit(""))), F.col("text").isNull())
    dealt = known.repartition("bucket")
    heads = dealt.withColumn("n", F.row_number().over(order)).where("n = 1")
    before = next_of(known.select("bucket").distinct(), "bucket").withColumnsRenamed({"bucket": "bucket_before", "next": "bucket"})
    heads = heads.join(before, "bucket").select(F.col("bucket_before").alias("bucket"), F.lit(True).alias("is_last"), F.col("text").alias("head_text"), *[c.alias(f"head_{n}") for n, c in carry.items()])
    names = ["text", *carry]
    led = dealt.select("id", "bucket", "text", *[c.alias(n) for n, c in carry.items()])
    led = led.select("*", F.lead(F.lit(True)).over(order).isNull().alias("is_last"), *[F.lead(n).over(order).alias(f"lead_{n}") for n in names])
    # Only a bucket's last row meets the next bucket's first one.
    told = led.join(heads, ["bucket", "is_last"], "left").select("id", *names, *[F.when(F.col("is_last"), F.col(f"head_{n}")).otherwise(F.col(f"lead_{n}")).alias(f"next_{n}") for n in names])
    alone = given.where("id is null").select("id", "text", *[c.alias(n) for n, c in carry.items()])
    return told.unionByName(alone, allowMissingColumns=True)


def compared(docs: DataFrame, settings: Sketch = Sketch(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited (its second half exchanged for the beginning of the next document), sketch, edited_sketch, next_sketch.

    Of an odd number of characters the middle one stays; a next text that is too
    short is taken whole; rows without an id have no next document and stay as
    they are; an empty table gives no rows.
    """
    rows = with_next(docs, {"sketch": sketch(F.col("text"), settings)}, id_col, text_col)
    text, length = F.coalesce("text", F.lit("")), F.length(F.coalesce("text", F.lit("")))
    half = F.floor(length / 2).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), length - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    given = rows.select(F.col("id").alias(id_col), length.cast("long").alias("n_chars"), F.when(F.col("id").isNull(), text).otherwise(edited).alias("edited"), "sketch", "next_sketch")
    return given.withColumn("edited_sketch", sketch(F.col("edited"), settings))
