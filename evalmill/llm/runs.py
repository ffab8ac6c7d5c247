"""Periodic runs of words, found by seeds on diagonals.

A run is a stretch of consecutive words with smallest period q, at least ``least``
and at least ``2 * q`` long, that no neighbouring word extends. On the diagonal of
lag q it is a stretch of matches, at least ``max(least - q, q)`` long: the overlap
that a run of this period guarantees. Lags fall into classes; the k-grams of a
class are as long as lets every guaranteed overlap hold one that starts at a
multiple of k. Such k-grams are looked up in an index of all k-grams that repeat
in the document, which gives pairs of occurrences, at most twice as many as words
for each class. Per lag, a pair that begins where the last one ended only moves
the furthest covered place on; what is left is extended at both ends, by less than
k words, through the names of shorter k-grams. k-grams are named exactly, by pairs
of the names of their halves; no hash stands for a text.

Many documents are searched at a time, as one list of words whose names differ
between documents. Time grows as n log n with the number of words, whatever they
repeat; nothing is shuffled.

Defined results: null and empty texts, and texts without words, have no runs and
collapse to the empty text; rows are searched one by one, repeated or without an
id alike; an empty table stays empty; input columns of the results' names are
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD
from .minhash import batches_of

_WORDS = re.compile(WORD)
LEAST = 12

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]  # first words, ends, periods


def named(keys: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Names from 0 on of the keys that occur more than once, at their places; -1 elsewhere."""
    out = np.full(size, -1, np.int64)
    _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
    repeated = counts > 1
    out[at] = np.where(repeated, np.cumsum(repeated) - 1, -1)[which]
    return out


def longer(names: np.ndarray, k: int) -> np.ndarray:
    """Names of the 2k-grams from those of the k-grams."""
    first, second = names[: max(0, len(names) - k)], names[k:]
    at = np.flatnonzero((first >= 0) & (second >= 0))
    return named(first[at] * (names.max(initial=0) + 1) + second[at], at, len(names))


def seeds(names: np.ndarray, k: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places at multiples of k, and lags within [low, high], of equal k-grams."""
    anchors = np.arange(0, len(names), k)
    anchors = anchors[names[anchors] >= 0]
    held = np.flatnonzero(names >= 0)
    stride = len(names) + high + 1
    index = np.sort(names[held] * stride + held)  # by name, then place
    keys = names[anchors] * stride + anchors
    begin, end = np.searchsorted(index, keys + low), np.searchsorted(index, keys + high, "right")
    counts = end - begin
    place = np.repeat(anchors, counts)
    nth = np.arange(len(place)) - np.repeat(np.cumsum(counts) - counts, counts)
    return place, index[np.repeat(begin, counts) + nth] % stride - place


def extended(levels: list[np.ndarray], place: np.ndarray, lag: np.ndarray, back: bool) -> np.ndarray:
    """Places moved on while the words there equal those a lag further on, by less than the seeds' k words."""
    place = place.copy()
    for j in range(len(levels) - 1, -1, -1):
        names, width = levels[j], 1 << j
        at = place - width if back else place
        inside = (at >= 0) & (at + lag + width <= len(names))
        a, b = np.where(inside, at, 0), np.where(inside, at + lag, 0)
        same = inside & (names[a] >= 0) & (names[a] == names[b])
        place[same] += -width if back else width
    return place


def classes(least: int) -> Iterator[tuple[int, int, int]]:
    """(level, lowest, highest lag): k = 2**level is the longest with 2k - 1 words in every guaranteed overlap."""
    low = 1
    while True:
        level = ((max(least - low, low) + 1) // 2).bit_length() - 1
        high = low
        while ((max(least - high - 1, high + 1) + 1) // 2).bit_length() - 1 == level:
            high = (4 << level) - 2 if high >= least else high + 1
        yield level, low, high
        low = high + 1


def runs_of(words: np.ndarray, least: int = LEAST) -> Runs:
    """All runs of a list of word numbers (below 0: equal to no other), by first word, then period."""
    known = np.flatnonzero(words >= 0)
    levels = [named(words[known], known, len(words))]
    found: list[Runs] = []
    for level, low, high in classes(least):
        while len(levels) <= level:
            levels.append(longer(levels[-1], 1 << (len(levels) - 1)))
        if low > len(words) // 2 or not (levels[level] >= 0).any():
            if low > least:
                break
            continue
        k = 1 << level
        place, lag = seeds(levels[level], k, low, high)
        # The furthest covered place of each lag moves on from seed to seed; a gap starts a new extension.
        order = np.lexsort((place, lag))
        place, lag = place[order], lag[order]
        fresh = np.ones(len(place), bool)
        fresh[1:] = (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + k)
        last = np.append(fresh[1:], True)[: len(place)]
        start = extended(levels[:level], place[fresh], lag[fresh], True)
        end = extended(levels[:level], place[last] + k, lag[fresh], False)
        lag = lag[fresh]
        long = end - start >= np.maximum(least - lag, lag)
        found.append((start[long], (end + lag)[long], lag[long]))
    start, end, lag = (np.concatenate(c) if found else np.empty(0, np.int64) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
    # A stretch with a smaller period, which then divides the lag, is found under both: the least is its period.
    order = np.lexsort((lag, end, start))
    start, end, lag = start[order], end[order], lag[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    order = np.lexsort((lag[first], start[first]))
    return start[first][order], end[first][order], lag[first][order]


def search(texts: list[str | None], least: int = LEAST) -> Iterator[tuple[list[tuple[int, int, int]], str]]:
    """Per text its runs (first word, length, period) and the text without the words that a run repeats."""
    listed = [_WORDS.findall(t or "") for t in texts]
    sizes = np.array([len(w) + 1 for w in listed], np.int64)  # a word of no document stands between two
    starts = np.cumsum(sizes) - sizes
    flat = pd.factorize(np.array([w for words in listed for w in words], object))[0].astype(np.int64)
    total, kinds = int(sizes.sum()), int(flat.max(initial=0)) + 1
    numbers = np.full(total, -1, np.int64)
    inside = np.ones(total, bool)
    inside[starts + sizes - 1] = False
    numbers[inside] = flat + np.repeat(np.arange(len(listed)), sizes - 1) * kinds
    first, end, period = runs_of(numbers, least)
    cover = np.zeros(total + 1, np.int64)
    np.add.at(cover, first + period, 1)
    np.add.at(cover, end, -1)
    dropped = np.cumsum(cover) > 0
    cuts = np.searchsorted(first, np.append(starts, total))
    for i, words in enumerate(listed):
        own = slice(cuts[i], cuts[i + 1])
        if cuts[i] == cuts[i + 1]:
            yield [], " ".join(words)
            continue
        at = int(starts[i])
        rows = list(zip((first[own] - at).tolist(), (end[own] - first[own]).tolist(), period[own].tolist(), strict=True))
        gone = dropped[at : at + len(words)].tolist()
        yield rows, " ".join([w for w, g in zip(words, gone, strict=True) if not g])


def find(docs: DataFrame, least: int = LEAST, text_col: str = "text") -> DataFrame:
    """Adds runs (array of start, length, period, by start, then period) and collapsed, the text without repeated words."""
    given = docs.drop("runs", "collapsed")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf[text_col].tolist()
            for part in batches_of(texts):
                found = list(search(texts[part], least))
                told = [[{"start": s, "length": n, "period": q} for s, n, q in rows] for rows, _ in found]
                yield pdf.iloc[part].assign(runs=told, collapsed=[c for _, c in found])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields)
    return given.mapInPandas(run, f"{fields}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def longest(runs: Column) -> Column:
    """The longest run; of equally long ones the first, then the one with the smallest period; null if there is none."""
    return F.get(F.array_sort(F.transform(runs, lambda r: F.struct((-r["length"]).alias("falling"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), F.lit(0))
