"""Toxicity: a fuzzy lexicon with scores for the context of each hit.

The lexicon is learned from labelled documents: words, and word beginnings that
many different words share, whose presence goes with the label. It becomes a
trie; Levenshtein automata of its terms, run together over the trie, find
misspelled forms too. The joint automaton is made deterministic while it runs,
one state per set of (trie node, edits), so that a word costs one table lookup
per character until it dies. Edits may fall on any letter, the first included;
digits and signs inside a word stand for the letters they look like. Words that
labelled clean documents hold are exceptions and never count as misspellings.
A window around each hit tells quotation from abuse. A small logistic regression
turns the hits of a document into a score; it is fitted on hits of a lexicon
that was learned without the fold of the document.

Defined results: null and empty texts, and any text without a hit, get the
model's score for no hits; without labelled rows of both classes every score is
0; repeated rows are judged one by one; conflicting labels of a document count
as toxic; of equally near terms the longer wins, then the smaller; other columns
never reach the score, and input columns named score or predicted may be there.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, spread
from .minhash import NearDup, copy_classes

#: A word may hold digits, and signs between letters or a sign that stands for its first letter.
_WORD = re.compile(r"[@$]?[^\W_]+(?:[@$!*|]{1,2}[^\W_]+)*")
_LETTERS = re.compile(r"[^\W\d_]+")
_QUOTES = "\"'«»‘’‚“”„‹›"
PREFIX_LENGTHS = (4, 5, 6, 7, 8)
#: The letters that a digit or sign looks like.
ALIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "il"}

Hit = tuple[str, float, int]  # term, weight, edits


@dataclass(frozen=True)
class Lexicon:
    """Terms with their log-odds; a term that ends in ``*`` matches by its beginning. Exceptions are not misspellings."""

    terms: tuple[tuple[str, float], ...]
    exceptions: frozenset[str] = frozenset()


#: Letters from which on a word's answer is not kept.
LONG = 64


class Automaton:
    """The terms' Levenshtein automata over one trie, determinised as needed."""

    def __init__(self, lexicon: Lexicon, max_states: int = 30_000, max_words: int = 200_000) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.allowed: list[int] = [0]  # edits that any term below a node may use
        self.word: dict[int, tuple[str, float]] = {}
        self.start: dict[int, tuple[str, float]] = {}
        self.max_states, self.max_words, self.exceptions = max_states, max_words, lexicon.exceptions
        for term, weight in lexicon.terms:
            edits, node = self.edits(term), 0
            for ch in term.rstrip("*"):
                self.allowed[node] = max(self.allowed[node], edits)
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.allowed.append(0)
                node = self.children[node][ch]
            self.allowed[node] = max(self.allowed[node], edits)
            (self.start if term.endswith("*") else self.word)[node] = (term, weight)
        self.reset()

    @staticmethod
    def edits(term: str) -> int:
        """Edits that a term bears: longer ones more, beginnings fewer."""
        n = len(term.rstrip("*"))
        return int(n >= 6) if term.endswith("*") else int(n >= 4) + (n >= 8)

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.sets: list[tuple[bytes, Hit | None]] = []  # nodes with their edits, packed: a set may hold hundreds
        self.next: list[dict[str, int]] = []
        self.found: list[Hit | None] = []
        self.seen: dict[str, Hit | None] = {}
        self.root = self.state({0: 0}, None)

    @staticmethod
    def nearer(a: Hit | None, b: Hit | None) -> Hit | None:
        if a is None or b is None:
            return a or b
        return min(a, b, key=lambda h: (h[2], -len(h[0]), h[0]))

    def state(self, members: dict[int, int], begun: Hit | None) -> int:
        """The number of a set of trie nodes with the fewest edits each, and the best beginning so far; -1 for nothing."""
        open_ = list(members.items())
        while open_:  # a letter of the term left out
            node, used = open_.pop()
            if members[node] == used:
                for child in self.children[node].values():
                    if used < self.allowed[child] and used + 1 < members.get(child, 9):
                        members[child] = used + 1
                        open_.append((child, used + 1))
        hit = None
        for node, used in members.items():
            if (t := self.start.get(node)) and used <= self.edits(t[0]):
                begun = self.nearer(begun, (*t, used))
            if (t := self.word.get(node)) and used <= self.edits(t[0]):
                hit = self.nearer(hit, (*t, used))
        if not members and begun is None:
            return -1
        key = (array("I", sorted(node << 2 | used for node, used in members.items())).tobytes(), begun)
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            # A whole term is nearer than a beginning with as many edits.
            self.found.append(begun if hit is None or (begun is not None and begun[2] < hit[2]) else hit)
        return self.ids[key]

    def step(self, state: int, ch: str) -> int:
        members: dict[int, int] = {}
        before, begun = self.sets[state]
        like = ALIKE.get(ch, "")
        for packed in array("I", before):
            node, used = packed >> 2, packed & 3
            for letter, child in self.children[node].items():
                cost = used + (letter != ch and letter not in like)
                if cost <= self.allowed[child] and cost < members.get(child, 9):
                    members[child] = cost
            if used < self.allowed[node] and used + 1 < members.get(node, 9):  # a letter too many
                members[node] = used + 1
        return self.state(members, begun)

    def match(self, word: str) -> Hit | None:
        """The lexicon term that ``word`` stands for, its weight and the edits between, or None."""
        state = self.root
        if state < 0:
            return None
        for ch in word:
            step = self.next[state].get(ch)
            if step is None:
                step = self.next[state][ch] = self.step(state, ch)
            if step < 0:
                return None
            state = step
        hit = self.found[state]
        return None if hit and hit[2] and word in self.exceptions else hit

    def hit(self, word: str) -> Hit | None:
        """Of a word with its digits and signs; failing that, of its runs of letters."""
        if word.isalpha():
            return self.match(word)
        if not (parts := _LETTERS.findall(word)):
            return None
        found = self.match(word)
        for part in parts if found is None else ():
            found = self.nearer(found, self.match(part))
        return found

    def hits(self, words: set[str]) -> dict[str, Hit]:
        out = {}
        for w in words:
            if len(self.sets) > self.max_states or len(self.seen) > self.max_words:
                self.reset()
            if len(w) > LONG:  # read anew each time, so that long words fill no memory
                hit = self.hit(w)
            elif w in self.seen:
                hit = self.seen[w]
            else:
                hit = self.seen[w] = self.hit(w)
            if hit is not None:
                out[w] = hit
        return out


@lru_cache(2)
def automaton_of(lexicon: Lexicon) -> Automaton:
    """One for all tasks of a Python worker, with the states and words that it has seen."""
    return Automaton(lexicon)


def quoted(text: str, start: int, end: int, window: int) -> bool:
    """Whether marks of quotation stand on both sides within the window and the line, an odd number before."""
    left = text[max(0, start - window) : start].rpartition("\n")[2]
    right = text[end : end + window].partition("\n")[0]
    return sum(left.count(q) for q in _QUOTES) % 2 == 1 and any(q in right for q in _QUOTES)


def features(text: str | None, automaton: Automaton, window: int = 80) -> list[float]:
    """Log counts of exact, misspelled and quoted hits; weights of the best hit that is not quoted and of the best that is."""
    out = [0.0] * 5
    lowered = (text or "").lower()
    hits = automaton.hits(set(_WORD.findall(lowered)))
    if not hits:
        return out
    counts = [0, 0, 0]
    for m in _WORD.finditer(lowered):
        if hit := hits.get(m[0]):
            if quoted(lowered, *m.span(), window):
                counts[2] += 1
                out[4] = max(out[4], hit[1])
            else:
                counts[1 if hit[2] else 0] += 1
                out[3] = max(out[3], hit[1] / (1 + hit[2]))
    out[:3] = [math.log1p(n) for n in counts]
    return out


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    weights: tuple[float, ...]  # the last is the constant

    def score(self, row: list[float]) -> float:
        z = self.weights[-1] + sum(w * x for w, x in zip(self.weights, row, strict=False))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40, weight: np.ndarray | None = None) -> np.ndarray:
    """Ridge logistic regression of weighted rows by Newton steps, the constant last and free."""
    weight = np.ones(len(x)) if weight is None else weight
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad, hess = x.T @ (weight * (p - y)) + penalty @ w, (x * (weight * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(hess + 1e-9 * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: A row that is no copy weighs this much; whole numbers add up alike in any order.
UNIT = 1 << 20


def weighed(sample: DataFrame, id_col: str, settings: NearDup = NearDup(width=3, percent=80)) -> DataFrame:
    """Adds weight and fold: near copies (``settings``) share the weight of one row and a fold; every row stays, with its own label.

    ids tell the rows apart.
    """
    near = cut(copy_classes(sample, settings, id_col).select(F.col(id_col).alias("__id"), F.col("class").alias("__class")))
    sizes = near.groupBy("__class").agg(F.count("*").alias("__copies"))
    weight, fold = F.round(F.lit(UNIT) / F.col("__copies")).cast("long"), F.pmod(F.xxhash64("__class"), F.lit(2)).cast("int")
    told = near.join(sizes, "__class").select("__id", F.greatest(weight, F.lit(1)).alias("weight"), fold.alias("fold"))
    return sample.join(told, sample[id_col] == told["__id"]).drop("__id")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_rows: int = 20_000,
    max_terms: int | None = 2000,
    min_evidence: float = 20.0,
    tasks: int = 32,
) -> ToxicityModel:
    """Learn lexicon and weights from labelled rows where ``usable`` holds on the id.

    The sample is bounded: the ``sample_rows`` labelled ids with the smallest
    seeded hash, all of their rows; near copies together weigh as much as one. A term needs a
    log-likelihood ratio of ``min_evidence``; the ``max_terms`` strongest are kept (None: all of
    them). Exceptions are words of the sample.
    """
    known = labels.where(usable & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("toxic"))
    order = spread(id_col, 23)
    chosen = known.withColumn("h", order).orderBy("h", id_col).limit(sample_rows)
    # The sample is small beside the table, so that it is dealt to more tasks than its rows lay in.
    sample = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col).select("text", "toxic").repartition(tasks)
    sample = cut(sample.withColumn("row", F.monotonically_increasing_id()))
    texts = cut(weighed(sample, "row").select("text", "toxic", "weight", "fold"))

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[int]] = {}

        def told() -> pd.DataFrame:
            return pd.DataFrame([(t, *c) for t, c in held.items()], columns=["term", "pos0", "n0", "pos1", "n1"])

        for pdf in batches:
            for text, toxic, weight, fold in zip(pdf["text"].tolist(), pdf["toxic"].tolist(), pdf["weight"].tolist(), pdf["fold"].tolist(), strict=True):
                words = {w for w in _LETTERS.findall((text or "").lower()) if len(w) > 1}
                starts = {w[:n] + "*" for w in words for n in PREFIX_LENGTHS if len(w) >= n}
                for t in (*words, *starts, ""):
                    counts = held.setdefault(t, [0, 0, 0, 0])
                    counts[2 * fold] += weight * toxic
                    counts[2 * fold + 1] += weight
                if len(held) > 100_000:
                    yield told()
                    held.clear()
        if held:
            yield told()

    sums = [F.sum(c).alias(c) for c in ("pos0", "n0", "pos1", "n1")]
    counted = cut(texts.mapInPandas(terms, "term string, pos0 long, n0 long, pos1 long, n1 long").groupBy("term").agg(*sums))
    total = counted.where("term = ''").first()
    if total is None or not 0 < total["pos0"] + total["pos1"] < total["n0"] + total["n1"]:
        return ToxicityModel(Lexicon(()), (-30.0,))

    def learned(pos: str, n: str) -> Lexicon:
        """From the rows that two expressions over ``counted`` count."""
        counts = counted.where("term <> ''").select("term", (F.expr(pos) / UNIT).alias("pos"), (F.expr(n) / UNIT).alias("n")).where("n > 0")
        all_pos, all_n = (sum(total[c.strip()] for c in e.split("+")) / UNIT for e in (pos, n))
        if not 0 < all_pos < all_n:
            return Lexicon(())
        share = all_pos / all_n

        def part(k: Column, p: Column | float) -> Column:
            return F.when(k > 0, k * F.log(p)).otherwise(0.0)

        hit, miss = F.col("pos"), F.col("n") - F.col("pos")
        rate = hit / F.col("n")
        evidence = 2 * (part(hit, rate) + part(miss, 1 - rate) - part(hit, F.lit(share)) - part(miss, F.lit(1 - share)))
        odds = F.log((hit + 0.5) / (all_pos + 1)) - F.log((miss + 0.5) / (all_n - all_pos + 1))
        best = counts.withColumn("g", evidence).withColumn("w", odds).where((F.col("g") >= min_evidence) & (rate >= 0.5 + share / 2)).orderBy(F.desc("g"), "term")
        best = best if max_terms is None else best.limit(max_terms)
        lexicon = Lexicon(tuple(sorted((r["term"], float(r["w"])) for r in best.select("term", "w").collect())))

        def misread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton = automaton_of(lexicon)
            for pdf in batches:
                yield pdf[[bool(h and h[2]) for h in map(automaton.match, pdf["term"])]]

        clean = counts.where(~F.col("term").endswith("*") & (rate < 0.5)).select("term")
        return Lexicon(lexicon.terms, frozenset(r["term"] for r in clean.mapInPandas(misread, "term string").collect()))

    without = {0: learned("pos1", "n1"), 1: learned("pos0", "n0")}

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automata = {fold: automaton_of(lexicon) for fold, lexicon in without.items()}
        for pdf in batches:
            yield pd.DataFrame({"toxic": pdf["toxic"], "weight": pdf["weight"], "x": [features(t, automata[f]) for t, f in zip(pdf["text"], pdf["fold"], strict=True)]})

    seen = texts.mapInPandas(measure, "toxic int, weight long, x array<double>").groupBy("x").agg(F.sum(F.col("toxic") * F.col("weight")).alias("pos"), F.sum("weight").alias("n")).orderBy("x").collect()
    x = np.array([r["x"] for r in seen for _ in range(2)], dtype=float)
    y = np.array([v for _ in seen for v in (1.0, 0.0)])
    weight = np.array([v / UNIT for r in seen for v in (r["pos"], r["n"] - r["pos"])])
    w = logistic(x, y, weight=weight)
    return ToxicityModel(learned("pos0 + pos1", "n0 + n1"), tuple(float(v) for v in w))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the id, the columns ``keep``, score, predicted."""
    given = docs.select(id_col, *keep, F.col(text_col).alias("__text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = automaton_of(model.lexicon)
        for pdf in batches:
            values = [model.score(features(t, automaton)) for t in pdf.pop("__text")]
            yield pdf.assign(score=values, predicted=[int(v >= 0.5) for v in values])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields if f.name != "__text")
    return given.mapInPandas(run, f"{fields}, score double, predicted int")
