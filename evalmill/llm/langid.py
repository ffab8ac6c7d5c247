"""Language identification by compression.

One raw-content zstandard dictionary per language is cut from a bounded sample
of labelled documents. A text is compressed against each dictionary, block by
block; the language whose dictionary yields the fewest bytes wins. A narrow
margin between the two smallest sizes is a rejection.

Defined results: a null text, or one without any letter, is ``und`` with score
0 and counts as rejected; ties go to the language with more labelled rows, then
to the smaller name; repeated rows are judged one by one; without labelled rows
every text is ``und``; columns besides id and text never reach the prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread

UNDETERMINED = "und"
_NO_LETTERS = re.compile(r"[\W\d_]+")
_LETTER_LIKE = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class LanguageModel:
    """Dictionaries by language, most frequent language first."""

    dictionaries: tuple[tuple[str, bytes], ...]
    block_bytes: int = 16_384
    min_margin: float = 0.002


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER_LIKE.finditer(text))


def letters_only(text: str) -> str:
    """Lower case, with every run of other characters turned into one space."""
    return f" {_NO_LETTERS.sub(' ', text.lower()).strip()} "


def fit(
    docs: DataFrame,
    usable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_docs: int = 64,
    piece_chars: int = 1024,
    dictionary_bytes: int = 32_768,
    max_langs: int | None = 256,
    **settings: float,
) -> LanguageModel:
    """Learn dictionaries from the rows of ``docs`` where ``usable`` holds.

    The sample is bounded: of each of the ``max_langs`` most frequent languages (None: of all)
    at most ``sample_docs`` documents, the one with the smallest seeded hash in
    each of as many hash classes (of a repeated id the least text), and of each at
    most ``piece_chars`` characters.
    """
    known = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    keyed = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), spread(id_col, 11).alias("h"))
    slot = F.pmod(F.col("h"), F.lit(sample_docs))
    firsts = keyed.groupBy("lang", slot.alias("slot")).agg(F.min("h").alias("h"), F.count("*").alias("n"))
    chosen = firsts.groupBy("lang").agg(F.sum("n").alias("n"), F.collect_list("h").alias("hs"))
    ordered = chosen.orderBy(F.desc("n"), "lang")
    rows = (ordered if max_langs is None else ordered.limit(max_langs)).collect()
    if not rows:
        return LanguageModel((), **settings)
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(r["lang"], h) for r in rows for h in r["hs"]], "lang string, h long")
    texts = keyed.join(F.broadcast(wanted), ["lang", "h"]).select("lang", "h", F.substring("text", 1, piece_chars).alias("piece")).groupBy("lang", "h").agg(F.min("piece").alias("piece"))
    pieces: dict[str, list[tuple[int, str]]] = {}
    for r in texts.collect():
        pieces.setdefault(r["lang"], []).append((r["h"], letters_only(r["piece"])))
    made = []
    for r in rows:
        content = "".join(p for _, p in sorted(pieces.get(r["lang"], []))).encode()[:dictionary_bytes]
        # zstandard takes no content under eight bytes
        if content:
            made.append((r["lang"], content * -(-8 // len(content))))
    return LanguageModel(tuple(made), **settings)


class Judge:
    """Compressors of one model, made once per Python worker task."""

    def __init__(self, model: LanguageModel) -> None:
        self.langs = [lang for lang, _ in model.dictionaries]
        self.block, self.margin = model.block_bytes, model.min_margin
        self.compress = []
        # A greedy match search over small tables: the fastest of the settings tried that keeps accuracy.
        search = zstandard.ZstdCompressionParameters(write_content_size=0, write_checksum=0, write_dict_id=0, window_log=18, hash_log=15, chain_log=15, search_log=3, min_match=4, strategy=zstandard.STRATEGY_GREEDY)
        for _, content in model.dictionaries:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=search)
            self.compress.append(zstandard.ZstdCompressor(dict_data=d, compression_params=search).compress)

    def __call__(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, margin, rejected."""
        if text is None or not self.langs or not has_letter(text):
            return UNDETERMINED, 0.0, 0.0, True
        data = letters_only(text).encode("utf-8", "replace")
        blocks = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        sizes = [sum(len(c(b)) for b in blocks) for c in self.compress]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
        margin = (second - sizes[best]) / second
        return self.langs[best], second / (second + sizes[best]), margin, margin < self.margin


def judged(model: LanguageModel, text: Column) -> Column:
    """struct<lang_pred, score, margin, rejected> of a text column."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge = Judge(model)
        for texts in batches:
            yield pd.DataFrame([judge(t) for t in texts], columns=["lang_pred", "score", "margin", "rejected"])

    return F.pandas_udf(run, "lang_pred string, score double, margin double, rejected boolean")(text)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the id, the columns ``keep``, lang_pred, score, margin, rejected."""
    found = docs.select(id_col, *keep, judged(model, F.col(text_col)).alias("judged"))
    return found.select(id_col, *keep, *[found["judged"][n].alias(n) for n in ("lang_pred", "score", "margin", "rejected")])


def accepted(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected."""
    return docs.where(~judged(model, F.col(text_col))["rejected"])
