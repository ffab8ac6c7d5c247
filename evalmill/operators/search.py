"""Exact nearest rows by cosine, with blocks of rows that can't matter left out before the shuffle.

A bounded sample of reference rows serves as pivots. Each reference row belongs to
its nearest pivot, and there to a shell of angles from it; a shell that holds more
rows than a block is dealt to several blocks. The table of shells is bounded by the
numbers of pivots and angle steps, whatever the number of rows. By the triangle
inequality of angles, a query's angle to a pivot bounds its similarity to every row
of a shell from above. A first look into the most promising shell gives each query
a floor, the k-th best similarity there; then a query goes only to blocks of shells
whose bound reaches its floor, and a reference block only where a query comes.

Where the bounds leave out little, as a bounded sample tells, rows that go to every
block would grow with the square of the table. Then no row is sent twice: queries and
references are kept once as packed blocks in the shared folder, and each task holds
one block of queries while reference blocks stream by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import cut
from .nearest import Rows, Search, compare, unit

STEPS = 64
#: Rows of a frame that a task sends to blocks at a time.
SENT = 4096
#: Angles this close may have swapped places by rounding.
SLACK = 1e-6
#: Reference rows and queries of the samples; bytes of a packed block of queries; rows sent to blocks, as a multiple of all, from which blocks stream.
SAMPLE, ASKED, LOADED, FEW = 2048, 256, 8 << 20, 4


def angles(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ pivots.T, -1.0, 1.0))


@dataclass(frozen=True)
class Shells:
    """Pivots; of each shell its pivot, angle range and blocks (first, number); for (pivot, step) the shell. Zero vectors have the last shell."""

    pivots: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    parts: np.ndarray
    shell: np.ndarray

    @property
    def blocks(self) -> int:
        return int(self.parts.sum())

    def place(self, u: np.ndarray) -> np.ndarray:
        """The shell of each row."""
        return self.shell[place(u, self.pivots)]

    def bounds(self, u: np.ndarray) -> np.ndarray:
        """For each row and shell the largest similarity that a row there can have."""
        told = angles(u, self.pivots)[:, self.pivot]
        apart = np.maximum(np.maximum(told - self.high - SLACK, self.low - told - SLACK), 0.0)
        out = np.cos(apart)
        out[:, -1] = 0.0
        out[~u.any(axis=1)] = 1.0  # a zero vector is as near to every row
        return out

    def bound(self, u: np.ndarray, shell: int) -> np.ndarray:
        """The same for one shell."""
        p = self.pivot[shell]
        one = Shells(self.pivots[p : p + 1], np.zeros(2, np.int64), *(np.array([x[shell], 0.0]) for x in (self.low, self.high)), self.first, self.parts, self.shell)
        return one.bounds(u)[:, 1 if shell == len(self.parts) - 1 else 0]


def place(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(nearest pivot, angle step) as one number; zero vectors have one of their own."""
    told = angles(u, pivots)
    nearest = told.argmin(axis=1)
    step = np.minimum((told[np.arange(len(u)), nearest] * (STEPS / np.pi)).astype(np.int64), STEPS - 1)
    return np.where(u.any(axis=1), nearest * STEPS + step, len(pivots) * STEPS)


def shells_of(reference: DataFrame, block: int, max_pivots: int = 256) -> Shells:
    """Shells of a table (id, v) with about ``block`` rows a block; the pivots are the rows with the smallest seeded hash.

    Empty angle steps go to the shell before, or to the first one of their pivot.
    """
    rows = reference.count()
    wanted = int(min(max_pivots, max(1, 2 * rows // block)))
    sample = reference.select("v").where(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(wanted).collect()
    pivots = unit(np.array([r["v"] for r in sample], float)) if sample else np.zeros((1, 1))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                at, n = np.unique(place(unit(np.stack(pdf["v"].to_numpy())), pivots), return_counts=True)
                yield pd.DataFrame({"at": at, "n": n})

    counts = np.zeros(len(pivots) * STEPS + 1, np.int64)
    for r in (reference.select("v").mapInPandas(placed, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect() if sample else ()):
        counts[r["at"]] = r["n"]
    shell = np.zeros(len(counts), np.int64)
    pivot, low, high, held = [], [], [], []
    for p in range(len(pivots)):
        open_ = False
        for step in range(STEPS):
            n = int(counts[p * STEPS + step])
            if not open_ or (n and held[-1] + n > block):
                pivot.append(p), low.append(step), high.append(step + 1), held.append(0)
                open_ = True
            if n:
                held[-1] += n
                high[-1] = step + 1
            shell[p * STEPS + step] = len(held) - 1
    shell[-1] = len(held)
    pivot.append(0), low.append(0), high.append(STEPS), held.append(int(counts[-1]))
    parts = np.maximum(1, -(-np.array(held) // block))
    return Shells(pivots, np.array(pivot), np.array(low) * (np.pi / STEPS), np.array(high) * (np.pi / STEPS), np.cumsum(parts) - parts, parts, shell)


def _met(queries: DataFrame, reference: DataFrame, shells: Shells, chosen, meet, schema: str, query_block: int, look: bool) -> DataFrame:
    """Queries meet the blocks of the shells that ``chosen`` (a matrix of truth values from queries) names; of each only the first block where ``look``."""

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                n = sum(chosen(pdf.iloc[i : i + 1024]).sum(axis=0) for i in range(0, len(pdf), 1024))
                yield pd.DataFrame({"shell": np.flatnonzero(n), "n": n[n > 0]})

    counts = np.zeros(len(shells.parts), np.int64)
    for r in queries.mapInPandas(asked, "shell long, n long").groupBy("shell").agg(F.sum("n").alias("n")).collect():
        counts[r["shell"]] = r["n"]
    deals = -(-counts // query_block)  # groups of queries that meet each block of a shell
    parts = np.minimum(shells.parts, 1) if look else shells.parts

    def keyed(pdf: pd.DataFrame, at: np.ndarray, n: np.ndarray, first: np.ndarray, deal: np.ndarray | None) -> Iterator[pd.DataFrame]:
        """Row ``at[i]`` once for each of ``n[i]`` blocks (or deals, where ``deal`` is None) in frames of about ``SENT`` rows, whatever the number of blocks."""
        upto = np.cumsum(n)
        for start in range(0, int(upto[-1]) if len(n) else 0, SENT):
            end = min(start + SENT, int(upto[-1]))
            i, j = np.searchsorted(upto, [start, end - 1], side="right")
            each = np.arange(start, end)
            of = np.repeat(np.arange(i, j + 1), np.diff(np.clip(np.concatenate([[start], upto[i : j + 1]]), start, end)))
            count = each - (upto[of] - n[of])
            keys = {"block": first[of] + count, "deal": deal[of]} if deal is not None else {"block": first[of], "deal": count}
            yield pdf.iloc[at[of]].assign(**keys)

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                for start in range(0, len(pdf), 1024):  # a row of truth values for each query
                    some = pdf.iloc[start : start + 1024]
                    at, shell = np.nonzero(chosen(some))
                    deal = pd.util.hash_array(some["id"].to_numpy()[at]).astype(np.int64) % np.maximum(1, deals[shell])
                    yield from keyed(some, at, parts[shell], shells.first[shell], deal)

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                shell = shells.place(unit(np.stack(pdf["v"].to_numpy())))
                part = pd.util.hash_array(pdf["id"].to_numpy(), hash_key="0fedcba987654321").astype(np.int64) % shells.parts[shell]
                n = np.where(part < parts[shell], deals[shell], 0)
                yield from keyed(pdf, np.arange(len(pdf)), n, shells.first[shell] + part, None)

    def fields(df: DataFrame) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", block long, deal long"

    left, right = queries.mapInPandas(sent, fields(queries)), reference.mapInPandas(held, fields(reference))
    return left.groupBy("block", "deal").cogroup(right.groupBy("block", "deal")).applyInPandas(meet, schema)


def sampled(df: DataFrame, rows: int, held: int = 1 << 18) -> pd.DataFrame:
    """The rows of the smallest seeded hash, fewer where they are long."""
    width = df.select(F.max(F.size("v"))).first()[0] or 0
    at = df.orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(int(min(rows, max(64, held // max(1, width)))))
    return pd.DataFrame([r.asDict() for r in at.collect()], columns=df.columns)


def _sent(queries: DataFrame, sample: pd.DataFrame, shells: Shells, find: Search, asked: int, query_block: int, reference_block: int) -> float:
    """Rows that would go to blocks, as some queries tell, with floors from the sample."""
    some = sampled(queries, ASKED)
    if not len(some) or not len(sample):
        return 0.0
    rows = Rows(some)
    best = find.empty(len(rows))
    compare(rows, Rows(sample), best, find.rankings)
    counts = np.ceil((shells.bounds(rows.u) >= best.floor.min(axis=0)[:, None] - 1e-9).mean(axis=0) * asked)
    return float((counts * shells.parts + np.ceil(counts / query_block) * shells.parts * reference_block).sum())


def _packed(pdf: pd.DataFrame) -> bytes:
    batch, out = pa.RecordBatch.from_pandas(pdf, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as to:
        to.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpacked(held: bytes) -> Rows:
    return Rows(pa.ipc.open_stream(held).read_pandas())


def _streamed(queries: DataFrame, reference: DataFrame, shells: Shells, sample: pd.DataFrame, find: Search, schema: str, asked: int) -> DataFrame:
    """Every block of queries beside every block of references, which stream through its task; each is kept once, and only lists are sent on."""

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                shell = shells.place(unit(np.stack(pdf["v"].to_numpy())))
                part = pd.util.hash_array(pdf["id"].to_numpy(), hash_key="0fedcba987654321").astype(np.int64) % shells.parts[shell]
                yield pdf.assign(shell=shell, block=shells.first[shell] + part)

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shell": pdf["shell"].iloc[:1], "r": [_packed(pdf.drop(columns=["shell", "block"]))]})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [pdf for pdf in batches if len(pdf)]
        if held:
            yield pd.DataFrame({"q": [_packed(pd.concat(held))]})

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reference.schema.fields) + ", shell long, block long"
    right = cut(reference.mapInPandas(placed, kind).groupBy("block").applyInPandas(block, "shell long, r binary"))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    width = max(1, len(sample["v"].iloc[0])) * (4 if queries.schema["v"].dataType == ArrayType(FloatType()) else 8)
    blocks = -(-asked // max(1, min(LOADED // width, max(1024, asked // (2 * cores)))))
    left = cut(queries.repartition(blocks).mapInPandas(whole, "q binary"))

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = best = None
        for pdf in batches:
            for shell, held, asking in zip(pdf["shell"], pdf["r"], pdf["q"], strict=True):
                if asking is not None:
                    q = _unpacked(asking)
                    best, first = find.empty(len(q)), find.empty(len(q))
                    compare(q, Rows(sample), first, find.rankings)
                    best.floor[:] = first.floor
                active = np.flatnonzero(shells.bound(q.u, shell) >= best.floor.min(axis=0) - 1e-9)
                if len(active):
                    compare(q, _unpacked(held), best, find.rankings, active)
        if q is not None:
            yield from find.frames(best, q)

    # A task's block of queries comes with its first block of references alone.
    together = right.coalesce(max(1, 2 * cores // blocks)).crossJoin(left.hint("shuffle_replicate_nl"))
    once = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    return together.select("shell", "r", F.when(once, F.col("q")).alias("q")).mapInPandas(searched, schema)


def in_shells(queries: DataFrame, reference: DataFrame, meet, schema: str, k: int, query_block: int, reference_block: int, per: tuple[str, ...] = (), kinds: int = 1, find: Search | None = None) -> DataFrame:
    """What ``meet`` finds for queries (id, v, ...) among references (id, v, ...), enough for the k best of each query.

    ``meet`` gives query_id, sim and the columns ``per``, in which a query has
    ``kinds`` rankings; its floor is the least of theirs. With ``find``, of which
    ``meet`` is a part, rows that would go to many blocks stream instead.
    """
    shells = shells_of(reference, reference_block)
    if find is not None:
        asked, rows, sample = queries.count(), reference.count(), sampled(reference, SAMPLE)
        if _sent(queries, sample, shells, find, asked, query_block, reference_block) > FEW * (asked + rows):
            return _streamed(queries, reference, shells, sample, find, schema, asked)

    def first(pdf: pd.DataFrame) -> np.ndarray:
        return np.arange(len(shells.parts)) == shells.place(unit(np.stack(pdf["v"].to_numpy())))[:, None]

    looked = _met(queries, reference, shells, first, meet, schema, query_block, True)
    order = Window.partitionBy(*per, "query_id").orderBy(F.desc("sim"))
    last = looked.withColumn("__n", F.row_number().over(order)).where(F.col("__n") == k)
    floors = last.groupBy("query_id").agg(F.min("sim").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= kinds).select("query_id", "floor")
    known = cut(queries.join(floors, queries["id"] == floors["query_id"], "left").drop("query_id"))

    def near(pdf: pd.DataFrame) -> np.ndarray:
        floor = pdf["floor"].fillna(-np.inf).to_numpy()
        return shells.bounds(unit(np.stack(pdf["v"].to_numpy()))) >= floor[:, None] - 1e-9

    return _met(known, reference, shells, near, meet, schema, query_block, False)


def surviving(queries: DataFrame, reference: DataFrame, near: DataFrame, k: int, reference_block: int) -> tuple[int, int]:
    """(pairs of query and block that a search compares, all such pairs), given the k best (query_id, rank, sim) of each query."""
    shells = shells_of(reference, reference_block)
    floors = near.where(F.col("rank") == k).select("query_id", F.col("sim").alias("floor"))
    known = queries.join(floors, queries["id"] == floors["query_id"], "left")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                ok = shells.bounds(unit(np.stack(pdf["v"].to_numpy()))) >= pdf["floor"].fillna(-np.inf).to_numpy()[:, None] - 1e-9
                yield pd.DataFrame({"met": [int((ok * shells.parts).sum())], "n": [len(pdf)]})

    met, n = known.mapInPandas(counted, "met long, n long").agg(F.sum("met"), F.sum("n")).first()
    return met or 0, (n or 0) * shells.blocks


def columns(df: DataFrame, id_col: str, vec_col: str, further: dict[str, Column], kind: str = "array<double>") -> DataFrame:
    """(id, v, further columns) of the rows that have a vector; one of floats travels as it is."""
    kind = "array<float>" if kind == "array<double>" and df.schema[vec_col].dataType == ArrayType(FloatType()) else kind
    return df.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast(kind).alias("v"), *[c.alias(n) for n, c in further.items()])
