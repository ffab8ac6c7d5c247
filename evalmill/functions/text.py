"""Column functions over text, sets and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def char_ngrams(text: Column, low: int, high: int) -> Column:
    """All character n-grams of a text for low <= n <= high, in order of n; empty for null and short texts."""
    def of(n: int) -> Column:
        last = F.length(text) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.coalesce(F.concat(*[of(n) for n in range(low, high + 1)]), F.array().cast("array<string>"))


def hashed_set(items: Column, buckets: int) -> Column:
    """Distinct bucket numbers of the items."""
    return F.array_distinct(F.transform(items, lambda g: F.pmod(F.xxhash64(g), F.lit(buckets)).cast("int")))


def presence(column: Column) -> Column:
    """1 unless null or empty."""
    return (F.length(F.coalesce(column, F.lit(""))) > 0).cast("int")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; the plain product where a norm is 0."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(dot(a, b))


def tanimoto(a: Column, b: Column) -> Column:
    """Shared part of two sets, 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def encoded(text: Column, alphabet: str, length: int) -> Column:
    """Codes 1.. of the characters (0: unknown), cut or zero-filled to ``length``."""
    characters = F.filter(F.split(F.substring(F.coalesce(text, F.lit("")), 1, length), ""), lambda c: c != "")
    codes = F.transform(characters, lambda c: F.instr(F.lit(alphabet), c))
    filled = F.concat(codes, F.array_repeat(F.lit(0), length))
    return F.slice(filled, 1, length)


def shortened(text: Column, width: int) -> Column:
    """White space runs as one space; longer texts end in three dots at the width."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 3), F.lit("..."))).otherwise(flat)


def composed(first: Column, second: Column, fallback: Column) -> Column:
    """Both trimmed texts around a separator; the fallback if both are empty."""
    a, b = (F.trim(F.coalesce(c, F.lit(""))) for c in (first, second))
    return F.when((a == "") & (b == ""), fallback).otherwise(F.concat(a, F.lit(" [SEP] "), b))


def seed_of(path: Column) -> Column:
    """The seed that a run's directory name carries, else null."""
    return F.nullif(F.regexp_extract(path, r"_s(\d+)(?:_|/|$)", 1), F.lit("")).cast("int")


def run_name(path: Column) -> Column:
    """Split and seed of a run directory named ``{split}_s{seed}``: struct<split, seed>, null where it is not."""
    name = F.regexp_extract(path, r"([^/]+)/?$", 1)
    split = F.regexp_extract(name, r"^(.+)_s(\d+)$", 1)
    seed = F.nullif(F.regexp_extract(name, r"^(.+)_s(\d+)$", 2), F.lit("")).cast("int")
    return F.when(seed.isNotNull(), F.struct(split.alias("split"), seed.alias("seed")))


def stable_id(prefix: str, text: Column) -> Column:
    """A reproducible id from a text."""
    return F.concat(F.lit(prefix), F.pmod(F.xxhash64(text), F.lit(10_000_000_000)).cast("string"))


def words(text: Column) -> Column:
    """Runs of letters a-z and digits of the lower-cased text; empty for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def word_ngrams(text: Column, low: int, high: int) -> Column:
    """All word n-grams of a text for low <= n <= high, in order of n."""
    one = words(text)
    grams, last = [], one
    for n in range(1, high + 1):
        if n > 1:
            # Each gram grows by the word n - 1 places on, side by side, so that no gram is cut from the whole list.
            last = F.filter(F.zip_with(last, F.slice(one, n, F.greatest(F.size(one), F.lit(1))), lambda g, w: F.concat(g, F.lit(" "), w)), lambda g: g.isNotNull())
        if n >= low:
            grams.append(last)
    return F.concat(*grams)


def hashed_counts(items: Column, buckets: int) -> Column:
    """(bucket, n) of the items by hash bucket, in order of the bucket: sorted once, then the ends of equal runs."""
    hashed = F.array_sort(F.transform(items, lambda g: F.pmod(F.xxhash64(g), F.lit(buckets)).cast("int")))
    before = F.concat(F.array(F.lit(-1)), hashed)
    pairs = F.zip_with(before, F.concat(hashed, F.array(F.lit(buckets))), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    ends = F.filter(F.transform(pairs, lambda z, i: F.struct(z["p"].alias("bucket"), z["q"].alias("next"), i.alias("at"))), lambda z: z["bucket"] != z["next"])
    later = F.slice(ends, 2, F.greatest(F.size(ends), F.lit(1)))
    counts = F.zip_with(ends, later, lambda e, f: F.struct(f["bucket"].alias("bucket"), (f["at"] - e["at"]).alias("n")))
    return F.filter(counts, lambda c: c["bucket"].isNotNull())


def hashed_vector(items: Column, buckets: int) -> Column:
    """Counts of the items by hash bucket as a map bucket -> weight of length 1 (empty for no items)."""
    counts = hashed_counts(items, buckets)
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, c: s + c["n"].cast("double") * c["n"]))
    # The norm is bound once, so that it isn't summed anew for every bucket.
    return F.get(F.transform(F.array(norm), lambda z: F.map_from_entries(F.transform(counts, lambda c: F.struct(c["bucket"].alias("bucket"), (c["n"] / z).alias("w"))))), F.lit(0))


def threshold_slug(value: Column) -> Column:
    """A threshold in nM as a name: ``t100nm``, ``t0p5nm``."""
    plain = F.regexp_replace(F.format_string("%.6f", value.cast("double")), r"\.?0+$", "")
    return F.concat(F.lit("t"), F.replace(plain, F.lit("."), F.lit("p")), F.lit("nm"))


def described(payload: Column, fallback: Column) -> Column:
    """The recommended name and the first functional comment (its first two texts) of a JSON record; the fallback if both are empty."""
    record = F.from_json(payload, "proteinDescription struct<recommendedName: struct<fullName: struct<value: string>>>, comments array<struct<commentType: string, texts: array<struct<value: string>>>>")
    name = record["proteinDescription"]["recommendedName"]["fullName"]["value"]
    texts = F.transform(F.filter(record["comments"], lambda c: c["commentType"] == "FUNCTION"), lambda c: F.filter(F.transform(F.slice(c["texts"], 1, 2), lambda t: t["value"]), lambda v: F.length(v) > 0))
    first = F.get(F.filter(texts, lambda t: F.size(t) > 0), F.lit(0))
    found = F.trim(F.concat_ws(" ", F.array(F.nullif(name, F.lit(""))), first))
    return F.when(F.length(found) > 0, found).otherwise(fallback)
