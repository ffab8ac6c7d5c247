"""Near-duplicates by b-bit MinHash.

Every document gets minima over its word shingles. Bands of whole minima make
candidates; the low bits of all minima, packed into longs, estimate similarity
by bit counts, corrected for chance collisions; links are confirmed on the full
shingle sets (of 64-bit shingle hashes; a word's hash has a random multiplier for
each of its places, so that words built alike do not meet).

Copies first collapse into classes by a digest of the set. In every band bucket
all classes are then compared with its smallest one, which ties large groups
together without all pairs. Only buckets that still span several components are
compared further, in blocks of bounded size, and there only across components;
members whose own hashes rule out any link there are left out before.

Defined results: null and empty texts, and texts without words, are components
of their own with 0 shingles; a text shorter than a shingle is one shingle;
ids are whole numbers below 2**62; rows with a null id take no part in links and
are kept; repeated rows get equal results; an id's different texts are linked
each by itself; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components

BITS = 4
LONGS = 8
MINIMA = LONGS * 64 // BITS
_U = np.uint64


@dataclass(frozen=True)
class NearDup:
    """width: words a shingle. percent: least similarity of a link. slack: standard errors that the estimate may fall short. block: hashes that a block of a bucket holds."""

    width: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 5
    slack: float = 5.0
    block: int = 65_536


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x9E3779B97F4A7C15)
    x = x ^ (x >> _U(29))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Shingler:
    """Hashes of word shingles, many texts at a time."""

    def __init__(self, width: int) -> None:
        rng = np.random.default_rng(20260101)
        values = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        values[65:91] = values[97:123]  # A-Z as a-z
        self.width, self.values = width, values
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.weights = rng.integers(1, 1 << 63, width, dtype=np.uint64) | _U(1)
        self.grow(1 << 10)

    def grow(self, n: int) -> None:
        """Random multipliers for the first ``n`` places of a word; a longer list begins with the shorter one."""
        self.places = np.random.PCG64(20260303).random_raw(n) | _U(1)

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the words of a byte array: each place of a word has a multiplier of its own."""
        word = ~self.space[data]
        edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        lengths = end - start
        if len(lengths) and lengths.max() > len(self.places):
            self.grow(2 * int(lengths.max()))
        ends = np.cumsum(lengths)
        place = np.arange(lengths.sum()) - np.repeat(ends - lengths, lengths)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values[data[word]] * self.places[place])])
        return start, _mix(total[ends] - total[ends - lengths] + lengths.astype(np.uint64))

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        start, hashes = self.words(data)
        ends = np.searchsorted(start, np.cumsum([len(r) + 1 for r in raw]))
        n = max(0, len(hashes) - self.width + 1)
        all_ = np.zeros(n, np.uint64)
        for i, w in enumerate(self.weights):
            all_ += hashes[i : i + n] * w
        all_ = _mix(all_)
        at = 0
        for end in ends:
            count = end - at
            if count >= self.width:
                yield np.unique(all_[at : end - self.width + 1])
            elif count:
                short = hashes[at:end] * self.weights[:count]
                yield _mix(np.array([short.sum() + _U(count)], np.uint64))
            else:
                yield np.empty(0, np.uint64)
            at = end


def batches_of(texts: list[str | None], limit: int = 1 << 20) -> Iterator[slice]:
    """Slices of neighbouring texts with about ``limit`` characters each."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield slice(first, i + 1)
            first, size = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


class Signer:
    def __init__(self, settings: NearDup) -> None:
        rng = np.random.default_rng(20260202)
        self.a = rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
        self.s = settings
        self.mult = rng.integers(1, 1 << 63, (settings.bands, settings.rows), dtype=np.uint64) | _U(1)
        self.shift = (np.arange(64 // BITS, dtype=np.uint64) * _U(BITS))[None]

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        h = (hashes >> _U(32)).astype(np.uint32)
        low = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(h), 512):
            np.minimum(low, (h[i : i + 512, None] * self.a + self.b).min(axis=0), out=low)
        return low

    def __call__(self, hashes: np.ndarray) -> tuple[list[int], list[int]]:
        """Packed low bits and band keys, as signed longs."""
        low = self.minima(hashes)
        kept = ((low ^ (low >> np.uint32(15))) & np.uint32((1 << BITS) - 1)).astype(np.uint64)
        packed = (kept.reshape(LONGS, -1) << self.shift).sum(axis=1, dtype=np.uint64)
        used = low[: self.s.bands * self.s.rows].astype(np.uint64).reshape(self.s.bands, self.s.rows)
        keys = _mix((used * self.mult).sum(axis=1, dtype=np.uint64) + np.arange(self.s.bands, dtype=np.uint64))
        return packed.view(np.int64).tolist(), keys.view(np.int64).tolist()


def digest(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of shingle hashes."""
    a, b = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64)
    return int(a), int(b)


def signatures(docs: DataFrame, settings: NearDup, id_col: str, text_col: str, carry: dict[str, Column]) -> DataFrame:
    """Per row: id, n_shingles, digest of the set (d1, d2), packed bits, band keys, and the columns ``carry``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, signer = Shingler(settings.width), Signer(settings)
        for pdf in batches:
            texts = pdf["text"].tolist()
            rows = []
            for part in batches_of(texts):
                for found in shingler.sets(texts[part]):
                    bits, keys = signer(found) if len(found) else (None, None)
                    rows.append((len(found), *digest(found), bits, keys))
            told = pd.DataFrame(rows, columns=["n_shingles", "d1", "d2", "bits", "bands"], index=pdf.index)
            yield pd.concat([pdf.drop(columns="text"), told], axis=1)

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[c.alias(n) for n, c in carry.items()])
    further = "".join(f", `{n}` {given.schema[n].dataType.simpleString()}" for n in carry)
    return given.mapInPandas(run, f"id long{further}, n_shingles long, d1 long, d2 long, bits array<long>, bands array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity by bit counts: the share of equal bit groups, less those equal by chance."""
    mask = sum(1 << i for i in range(0, 64, BITS))
    differing = None
    for i in range(LONGS):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        folded = x
        for k in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, k))
        n = F.bit_count(folded.bitwiseAND(F.lit(mask)))
        differing = n if differing is None else differing + n
    chance = 2.0**-BITS
    return (1 - differing / MINIMA - chance) / (1 - chance)


def least_estimate(settings: NearDup) -> float:
    """The threshold less ``slack`` standard errors of the estimate there."""
    chance, j = 2.0**-BITS, settings.percent / 100
    p = chance + (1 - chance) * j
    return j - settings.slack * math.sqrt(p * (1 - p) / MINIMA) / (1 - chance)


def shingle_sets(docs: DataFrame, ids: DataFrame, nodes: DataFrame, settings: NearDup, id_col: str, text_col: str) -> DataFrame:
    """id and the sorted shingle hashes of the classes whose id is in ``ids``; nodes (id, rep, d1, d2) says whose text, and of which set."""
    wanted = ids.join(nodes.select("id", "rep", "d1", "d2"), "id")
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).where("text is not null").join(wanted, "rep").select("id", "text", "d1", "d2")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(settings.width)
        for pdf in batches:
            texts_ = pdf["text"].tolist()
            found = [s for part in batches_of(texts_) for s in shingler.sets(texts_[part])]
            own = [digest(s) == d for s, d in zip(found, zip(pdf["d1"], pdf["d2"], strict=True), strict=True)]
            yield pd.DataFrame({"id": pdf["id"][own], "hashes": [s.view(np.int64) for s, o in zip(found, own, strict=True) if o]})

    return texts.mapInPandas(hashed, "id long, hashes array<long>")


def similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sets of distinct hashes reach the threshold."""
    both = np.sort(np.concatenate([p, q]))
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(p) + len(q) - common)


def confirm(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, settings: NearDup, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = cut(shingle_sets(docs, ids, nodes, settings, id_col, text_col))

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [similar(x, y, settings.percent) for x, y in zip(pdf["x"], pdf["y"], strict=True)]
            yield pdf.loc[keep, ["a", "b"]]

    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInPandas(linked, "a long, b long").distinct()


def linkable_members(members: DataFrame, sets: DataFrame, settings: NearDup) -> DataFrame:
    """members (band, id, component) with their set sizes n, less those that can't have a link in their bucket.

    Of the n hashes of a document, those that no other member of any such bucket
    holds are in no intersection; with the bucket's smallest set size this bounds
    the similarity to any partner from above, so that no link is lost.
    """
    held = sets.select("id", F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("c"), F.min("id").alias("id"))
    alone = held.where("c = 1").groupBy("id").agg(F.count("*").alias("u"))
    sized = sets.select("id", F.size("hashes").alias("n")).join(alone, "id", "left").select("id", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("shared"))
    rows = members.join(sized, "id")
    least = rows.groupBy("band").agg(F.min("n").alias("n_min"))
    partner = F.greatest("n_min", "shared")
    possible = 100 * F.col("shared") >= settings.percent * (F.col("n") + partner - F.col("shared"))
    return rows.join(least, "band").where(possible).select("band", "id", "component", "n")


def across(members: DataFrame, sets: DataFrame, signed: DataFrame, settings: NearDup) -> DataFrame:
    """Links (a, b) between components inside buckets, enough to join what belongs together.

    members: band, id, component, n. Members of a bucket's largest component are
    not compared with each other. Blocks of about ``block`` hashes bound what one
    task compares; a pair is looked at in the first band that it shares, by its
    bits first, then on the full sets. Only links leave a task, no pairs.
    """
    per = members.groupBy("band", "component").agg(F.sum("n").alias("n"))
    size = per.groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("main_component"), F.max("n").alias("n_main"), F.sum("n").alias("n_all"), F.count("*").alias("parts")).where("parts > 1")
    main = F.col("component") == F.col("main_component")
    main_blocks, rest_blocks = F.ceil(F.col("n_main") / settings.block), F.ceil((F.col("n_all") - F.col("n_main")) / settings.block)
    own = F.pmod(F.xxhash64("id"), F.when(main, main_blocks).otherwise(rest_blocks))
    held = members.join(size, "band").select("band", "id", "component", main.alias("main"), own.alias("own"), main_blocks.alias("main_blocks"), rest_blocks.alias("rest_blocks"))
    # Block pairs: (rest i, main j) and (rest i, rest j) with i <= j; the second is named below zero.
    i_own, rest, mains = F.col("own"), F.sequence(F.lit(0).cast("long"), F.col("rest_blocks") - 1), F.sequence(F.lit(0).cast("long"), F.col("main_blocks") - 1)
    to_rest = F.transform(rest, lambda i: F.struct(i.alias("i"), i_own.alias("j")))
    to_main = F.transform(mains, lambda j: F.struct(i_own.alias("i"), j.alias("j")))
    among = F.transform(rest, lambda i: F.struct(F.least(i, i_own).alias("i"), (-1 - F.greatest(i, i_own)).alias("j")))
    dealt = held.withColumn("at", F.explode(F.when(F.col("main"), to_rest).otherwise(F.concat(to_main, among)))).select("band", "at", "id", "component", "main", "own")
    full = dealt.join(sets, "id").join(signed.select("id", "bits", "bands"), "id")
    groups = full.groupBy("band", "at").agg(F.collect_list(F.struct("id", "component", "main", "own", "bits", "bands", "hashes")).alias("rows")).where("size(rows) > 1")
    least = least_estimate(settings)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mask = _U(sum(1 << i for i in range(0, 64, BITS)))
        for pdf in batches:
            out = []
            for band, at, rows in zip(pdf["band"], pdf["at"], pdf["rows"], strict=True):
                bits = np.array([r["bits"] for r in rows], np.int64).view(np.uint64)
                bands = np.array([r["bands"] for r in rows], np.int64)
                side = np.array([r["main"] if at["j"] >= 0 else r["own"] for r in rows], np.int64)
                alike = at["j"] < 0 and at["i"] == -1 - at["j"]  # a block with itself: all its pairs
                root = {r["component"]: r["component"] for r in rows}

                def find(c: int, root: dict = root) -> int:
                    while root[c] != c:
                        root[c] = c = root[root[c]]
                    return c

                for i in range(len(rows) - 1):
                    x = bits[i + 1 :] ^ bits[i]
                    folded = x.copy()
                    for k in range(1, BITS):
                        folded |= x >> _U(k)
                    j = 1 - np.bitwise_count(folded & mask).sum(axis=1) / MINIMA
                    j = (j - 2.0**-BITS) / (1 - 2.0**-BITS)
                    same = bands[i + 1 :] == bands[i]
                    first = bands[i][same.argmax(axis=1)] == band
                    near = (j >= least) & first & (alike | (side[i + 1 :] != side[i]))
                    for m in i + 1 + np.flatnonzero(near):
                        p, q = find(rows[i]["component"]), find(rows[m]["component"])
                        if p != q and similar(np.asarray(rows[i]["hashes"]), np.asarray(rows[m]["hashes"]), settings.percent):
                            root[p] = q
                            out.append((int(rows[i]["id"]), int(rows[m]["id"])))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return groups.mapInPandas(compare, "a long, b long")


def star_pairs(reps: DataFrame, least: float) -> DataFrame:
    """Distinct (a, b): a leads, as its smallest id, a band bucket that holds b too, and their bits put them at ``least`` or more. reps: id, bits, bands."""
    filed = reps.select("id", F.explode("bands").alias("band"))
    buckets = filed.groupBy("band").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    starred = filed.join(buckets, "band").where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    bits = reps.select("id", "bits")
    with_bits = starred.join(bits.select(F.col("id").alias("a"), F.col("bits").alias("x")), "a").join(bits.select(F.col("id").alias("b"), F.col("bits").alias("y")), "b")
    return with_bits.where(estimate(F.col("x"), F.col("y")) >= least).select("a", "b").distinct()


def copy_classes(docs: DataFrame, settings: NearDup, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class): the smallest id that leads one of the row's buckets and is a near copy by its bits; itself if there is none.

    An estimate in one step, for weights: no full sets, no chains of links. ids tell rows apart.
    """
    signed = cut(signatures(docs, settings, id_col, text_col, {}).select("id", "bits", "bands"))
    near = star_pairs(signed.where("bits is not null"), settings.percent / 100).groupBy("b").agg(F.min("a").alias("class"))
    found = signed.select("id").join(near.withColumnRenamed("b", "id"), "id", "left")
    return found.select(F.col("id").alias(id_col), F.coalesce("class", "id").alias("class"))


#: Numbers of classes from here on are no ids.
FRESH = 1 << 62


def set_classes(linkable: DataFrame) -> DataFrame:
    """Per distinct set (d1, d2): rep, the smallest id that has it; row, that id's first row; node, a number of its own.

    The node is the rep. Where an id has several sets, only the one with the
    smallest digest keeps it; the others get numbers from ``FRESH`` on.
    """
    # Grouped by one column more than joined by, so that the join deals both sides anew and can split a hot digest.
    classes = linkable.groupBy("d1", "d2", "n_shingles").agg(F.min(F.struct("id", "row")).alias("least")).select("d1", "d2", F.col("least.id").alias("rep"), F.col("least.row").alias("row"))
    first = classes.groupBy("rep").agg(F.min(F.struct("d1", "d2")).alias("first"))
    fresh = F.lit(FRESH) + F.pmod(F.xxhash64("d1", "d2"), F.lit(FRESH))
    return classes.join(first, "rep").select("d1", "d2", "rep", "row", F.when(F.col("first") == F.struct("d1", "d2"), F.col("rep")).otherwise(fresh).alias("node"))


def near_duplicates(docs: DataFrame, settings: NearDup, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest linked id), kept (the row's id is that), the columns ``carry`` of the row, group.

    Rows of one id with different texts are documents of their own: ``group`` is
    one number for each component, where these may share their smallest id.
    """
    carry = carry or {}
    signed = cut(signatures(docs, settings, id_col, text_col, carry).withColumn("row", F.monotonically_increasing_id()))
    linkable = signed.where("n_shingles > 0 and id is not null")
    rep_of = linkable.withColumnRenamed("row", "own").join(set_classes(linkable), ["d1", "d2"])
    is_rep = F.col("own") == F.col("row")
    rows = cut(rep_of.select("id", *carry, "n_shingles", "node", "rep", "d1", "d2", F.when(is_rep, F.col("bits")).alias("bits"), F.when(is_rep, F.col("bands")).alias("bands")))
    nodes = rows.where("bits is not null").select(F.col("node").alias("id"), "rep", "d1", "d2", "bits", "bands")
    reps = nodes.select("id", "bits", "bands")
    filed = reps.select("id", F.explode("bands").alias("band"))
    tested = cut(star_pairs(reps, least_estimate(settings)))
    links = cut(confirm(tested, docs, nodes, settings, id_col, text_col))
    parts = connected_components(links)

    parted = filed.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = parted.groupBy("band").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p < q").select("band")
    members = cut(parted.join(split, "band"))
    sets = cut(shingle_sets(docs, members.select("id").distinct(), nodes, settings, id_col, text_col))
    links = links.union(across(linkable_members(members, sets, settings), sets, reps, settings))
    parts = connected_components(links)

    found = rows.select("id", *carry, "n_shingles", "node", "rep").join(parts.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("group", F.coalesce("component", "node"))
    # Only where an id has several sets may a component's smallest number not be its smallest id.
    odd = found.where(F.col("node") >= FRESH).groupBy("group").agg(F.min("rep").alias("odd"))
    found = found.join(odd, "group", "left").withColumn("component_id", F.least(F.when(F.col("group") < FRESH, F.col("group")), "odd"))
    rest = signed.where("n_shingles = 0 or id is null").select("id", *carry, "n_shingles", F.col("id").alias("component_id"), F.lit(None).cast("long").alias("group"))
    all_ = found.select("id", *carry, "n_shingles", "component_id", "group").unionByName(rest)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    return all_.select(F.col("id").alias(id_col), "n_shingles", "component_id", kept, *carry, "group")
