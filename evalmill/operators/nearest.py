"""The k most similar reference rows of each query, kept while reference rows come by.

Products of floats tell which pairs can reach a query's floor, the k-th best so far;
only those are computed in doubles, summed in the order of the elements as SQL does,
so that equal vectors have equal similarities wherever they stand. Where many pairs
reach it, products of doubles and the k-th best of the tile raise the floor first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd

#: Rows of references and of pairs that are compared at a time.
TILE, HELD = 2048, 1 << 20
#: Pairs whose vectors are held as doubles at a time.
PAIRS = 1 << 15


def unit(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, float)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


@dataclass(frozen=True)
class Ranking:
    """Which references a query's list leaves out: those that share all columns of one of ``groups``, and those as similar as ``high``."""

    name: str = ""
    groups: tuple[tuple[str, ...], ...] = ()
    high: float = np.inf


class Rows:
    """Ids and vectors of a frame (id, v, further columns)."""

    def __init__(self, pdf: pd.DataFrame) -> None:
        self.pdf, self.id = pdf, pdf["id"].to_numpy()
        v = np.stack(pdf["v"].to_numpy()).astype(float)
        self.v = v if v.shape[1] else np.zeros((len(v), 1))
        self.square = np.concatenate([np.cumsum(x * x, axis=1)[:, -1] for x in np.split(self.v, range(PAIRS, len(self.v), PAIRS))])
        self.u = unit(self.v)
        self.small = self.u.astype(np.float32)

    def __len__(self) -> int:
        return len(self.id)


@dataclass
class Best:
    """The k best of each ranking and query: similarity, reference and its further columns; and the floors, at least the k-th best."""

    rankings: int
    queries: int
    k: int
    columns: tuple[str, ...] = ()
    sim: np.ndarray = field(init=False)
    ref: np.ndarray = field(init=False)
    floor: np.ndarray = field(init=False)
    further: dict[str, np.ndarray] = field(init=False)

    def __post_init__(self) -> None:
        shape = (self.rankings, self.queries, self.k)
        self.sim, self.ref = np.full(shape, -np.inf), np.zeros(shape, np.int64)
        self.floor = np.full(shape[:2], -np.inf)
        self.further = {c: np.full(shape, np.nan) for c in self.columns}

    def add(self, ranking: int, query: np.ndarray, sim: np.ndarray, ref: np.ndarray, further: dict[str, np.ndarray]) -> None:
        rows, at = np.unique(query, return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(rows)), self.k), at])
        found = {"sim": np.concatenate([self.sim[ranking, rows].ravel(), sim]), "ref": np.concatenate([self.ref[ranking, rows].ravel(), ref])}
        found |= {c: np.concatenate([self.further[c][ranking, rows].ravel(), further[c]]) for c in self.columns}
        order = np.lexsort((found["ref"], -found["sim"], row))
        starts = np.searchsorted(row[order], np.arange(len(rows)))
        kept = order[(starts[:, None] + np.arange(self.k)).ravel()]  # each row has its k old places at least
        for name, to in (("sim", self.sim), ("ref", self.ref), *self.further.items()):
            to[ranking, rows] = found[name][kept].reshape(len(rows), self.k)
        self.floor[ranking, rows] = np.maximum(self.floor[ranking, rows], self.sim[ranking, rows, -1])

    def listed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places (ranking, query, position) that hold a reference."""
        return np.nonzero(self.sim > -np.inf)


def similarity(a: Rows, b: Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosine of rows ``i`` and ``j``; 0 for a zero vector."""
    dot = np.concatenate([np.cumsum(a.v[i[s : s + PAIRS]] * b.v[j[s : s + PAIRS]], axis=1)[:, -1] for s in range(0, max(1, len(i)), PAIRS)])
    x, y = a.square[i], b.square[j]
    with np.errstate(over="ignore", under="ignore"):
        length = np.sqrt(x * y)
    length = np.where((length > 0) & np.isfinite(length), length, np.sqrt(x) * np.sqrt(y))
    return np.clip(np.divide(dot, length, out=np.zeros_like(dot), where=length > 0), -1.0, 1.0)


def _needed(r: Rows, k: int, columns: list[str]) -> np.ndarray:
    """Places of the rows that can be listed: of equal vectors and columns those of the smallest ids, whatever id a query excludes."""
    if len(np.unique(r.square)) == len(r):
        return np.arange(len(r))
    whole = pd.factorize(np.ascontiguousarray(r.v + 0.0).view(f"V{r.v.shape[1] * 8}").ravel().astype(object))[0]
    keys = pd.DataFrame({"v": whole, **{c: r.pdf[c].to_numpy() for c in columns}, "id": r.id}).sort_values("id", kind="stable")
    by = ["v", *columns]
    keys = keys[keys.groupby([*by, "id"], dropna=False).cumcount() < k]  # an id's rows fill a list at most
    return np.sort(keys[keys.groupby(by, dropna=False).cumcount() < 2 * k].index.to_numpy())


def compare(q: Rows, r: Rows, best: Best, rankings: tuple[Ranking, ...], active: np.ndarray | None = None) -> None:
    """Takes the references ``r`` into the lists of the queries ``q`` (those at ``active``, where given)."""
    k, columns = best.k, sorted({c for x in rankings for g in x.groups for c in g})
    codes = {c: np.split(pd.factorize(pd.concat([q.pdf[c], r.pdf[c]]))[0], [len(q)]) for c in columns}
    further = {c: r.pdf[c].to_numpy(float, na_value=np.nan) for c in best.columns}
    needed, rows = _needed(r, k, columns), np.arange(len(q)) if active is None else active
    width = q.v.shape[1]
    loose, tight = (width + 8) * 2.0**-22, (width + 8) * 2.0**-50  # more than the rounding of products of floats and of doubles

    def legal(x: Ranking, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = q.id[i] != r.id[j]
        for g in x.groups:
            shared = True
            for c in g:
                shared = shared & (codes[c][0][i] == codes[c][1][j]) & (codes[c][0][i] >= 0)
            ok = ok & ~shared
        return ok

    def crowded(some: np.ndarray, tile: np.ndarray) -> np.ndarray:
        s, reached, still = q.u[some] @ r.u[tile].T, False, q.square[some] == 0
        for n, x in enumerate(rankings):
            ok = legal(x, some[:, None], tile[None, :]) & (s < x.high + tight)
            floor = best.floor[n, some]
            if len(tile) >= k:
                sure = np.where(ok & (s < x.high - tight), s, -np.inf)
                floor = np.maximum(floor, np.partition(sure, -k, axis=1)[:, -k] - tight)
            ok = ok & (s >= floor[:, None] - tight)
            # A zero vector is as near to every row: once its list is full, only smaller ids change it.
            ok[still] &= (r.id[tile] < best.ref[n, some[still], -1][:, None]) | (best.sim[n, some[still], -1][:, None] < 0)
            reached = reached | ok
            best.floor[n, some] = np.maximum(best.floor[n, some], floor - tight)
        return np.flatnonzero(reached)

    for start in range(0, len(needed), TILE):
        tile = needed[start : start + TILE]
        small, step = np.ascontiguousarray(r.small[tile].T), max(1, HELD // len(tile))
        for low in range(0, len(rows), step):
            some = rows[low : low + step]
            least = best.floor[:, some].min(axis=0)
            flat = None
            if (least > -np.inf).all():
                flat = np.flatnonzero(q.small[some] @ small >= (least - loose).astype(np.float32)[:, None])
            if flat is None or len(flat) > len(some) * len(tile) // 64:
                flat = crowded(some, tile)
            if len(flat):
                i, j = some[flat // len(tile)], tile[flat % len(tile)]
                sim = similarity(q, r, i, j)
                for n, x in enumerate(rankings):
                    ok = np.flatnonzero((sim >= best.floor[n, i]) & (sim < x.high))
                    ok = ok[legal(x, i[ok], j[ok])]
                    if len(ok):
                        best.add(n, i[ok], sim[ok], r.id[j[ok]], {c: f[j[ok]] for c, f in further.items()})


@dataclass(frozen=True)
class Search:
    """The ``k`` best of each ranking; ``names`` are those of further reference columns in what is found, ``per`` that of the ranking."""

    k: int
    rankings: tuple[Ranking, ...] = (Ranking(),)
    names: tuple[tuple[str, str], ...] = ()
    per: str | None = None

    def empty(self, queries: int) -> Best:
        return Best(len(self.rankings), queries, self.k, tuple(c for c, _ in self.names))

    def frames(self, best: Best, q: Rows, rows: int = 1 << 16) -> Iterator[pd.DataFrame]:
        """The lists as (``per``, query_id, ref_id, sim, further columns), so many rows at a time."""
        n, i, p = best.listed()
        for s in range(0, max(1, len(n)), rows):
            a = n[s : s + rows], i[s : s + rows], p[s : s + rows]
            named = {self.per: np.array([x.name for x in self.rankings], object)[a[0]]} if self.per else {}
            yield pd.DataFrame(named | {"query_id": q.id[a[1]], "ref_id": best.ref[a], "sim": best.sim[a], **{to: best.further[c][a] for c, to in self.names}})

    def meet(self, q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        """What a frame of queries finds in a frame of references; a column ``floor`` of the queries holds for all rankings."""
        if not len(q) or not len(r):
            return pd.DataFrame([], columns=[*([self.per] if self.per else []), "query_id", "ref_id", "sim", *[to for _, to in self.names]])
        rows = Rows(q)
        best = self.empty(len(rows))
        if "floor" in q:
            best.floor[:] = q["floor"].fillna(-np.inf).to_numpy() - 1e-9
        compare(rows, Rows(r), best, self.rankings)
        return pd.concat(self.frames(best, rows))
