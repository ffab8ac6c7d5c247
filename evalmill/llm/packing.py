"""Cost-balanced packing of tokenised documents into sequences.

The cost of a sequence is linear plus quadratic in its pieces' lengths (the
matrix products and the attention inside each document). Pieces are taken by
falling length; each goes to the sequence of lowest cost with token capacity
left. A document longer than a sequence is cut into whole sequences first; a
piece that no longer fits anywhere fills the emptiest sequence and its rest is
dealt next.

Tasks pack what they read in windows of a fixed number of documents, so that
nothing is shuffled and memory is bounded. What a window leaves over, less than
a sequence, moves to the next; at a task's end it becomes sequences of power of
two lengths, which need no padding.

Defined results: a null text is an empty document, whose only id is the end id;
repeated rows are packed one by one; ids may be of any type, null too; equal
lengths go in the order read; the end id follows every document; texts of any
length are encoded in parts; an empty table gives no rows; other columns do not
matter. Sequence ids are unique and depend on how the input is split into tasks.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


@dataclass(frozen=True)
class Packing:
    """window: documents dealt at once. linear, quadratic: cost of a token and of a pair of tokens of a piece. flush_bytes: ids given out at once."""

    tokens: int = 2048
    end_id: int = 1
    window: int = 1500
    linear: float = 1.0
    quadratic: float = 1 / 1024
    flush_bytes: int = 1 << 22


def byte_of() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Ids of texts, as little-endian unsigned 32-bit bytes.

    With ``added_tokens`` a text is cut at the literals of the file's added
    tokens, which have ids of their own. Long texts are encoded in parts: a
    single space between two visible characters always begins a token of a
    byte-level BPE vocabulary, and so does the last space of a run before one.
    """

    part = 1 << 18
    border = re.compile(r"\S(?= \S)")
    #: Runs that the pattern's look-ahead would go through character by character.
    spaces = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2000,}")

    def __init__(self, path: str, pattern: str, added_tokens: bool = False) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        added = file.get("added_tokens", [])
        to_byte = byte_of()
        own = {t["content"] for t in added}
        ranks = {bytes(to_byte[c] for c in token): rank for token, rank in file["model"]["vocab"].items() if token and token not in own}
        self.coder = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        if not added_tokens:
            added = []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take in or look at their neighbours are not supported")
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        self.literals = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")

    def encode(self, text: str) -> bytes:
        if not any(t in text for t in self.added):
            return self.ordinary(text)
        return b"".join(self.added[part] if part in self.added else self.ordinary(part) for part in self.literals.split(text) if part)

    def ordinary(self, text: str) -> bytes:
        if len(text) < 1000:
            return self.plain(text)
        out, at = [], 0
        # A run of 2000 covers one of these slices.
        long_run = any(text[i : i + 1000].isspace() for i in range(0, len(text), 1000))
        for m in self.spaces.finditer(text) if long_run else ():
            out += map(self.plain, self.parts(text[at : m.start()]))
            # All of the run but its last space, which goes with what follows, is one token of the pattern.
            at = m.end() - (m.end() < len(text))
            out.append(np.array(self.coder._core_bpe.encode_single_piece(text[m.start() : at].encode()), "<u4").tobytes())
        return b"".join([*out, *map(self.plain, self.parts(text[at:]))])

    def plain(self, text: str) -> bytes:
        return np.array(self.coder.encode_ordinary(text), "<u4").tobytes()

    def parts(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > self.part and (m := self.border.search(text, at + self.part)):
            yield text[at : m.end()]
            at = m.end()
        yield text[at:]


@lru_cache(1)
def coder_of(path: str, pattern: str, added_tokens: bool) -> Tokens:
    """One for all tasks of a Python worker."""
    return Tokens(path, pattern, added_tokens)


@dataclass
class Sequence:
    pieces: list = field(default_factory=list)


def pack(pieces: list[tuple[int, tuple]], settings: Packing, count: int) -> tuple[list[Sequence], list[tuple[int, tuple, int]]]:
    """Fill ``count`` sequences from (length, key) pieces; also the rest as (length, key, start in the piece).

    Sequence.pieces holds (key, start in the piece, length).
    """
    queue = [(-n, i, 0, key) for i, (n, key) in enumerate(pieces)]
    heapq.heapify(queue)
    made = [Sequence() for _ in range(count)]
    # A full sequence keeps room 0 and takes no piece, as pieces are never empty.
    room, cost = np.full(count, settings.tokens), np.zeros(count)
    left = count * settings.tokens
    while queue and left:
        n, i, start, key = heapq.heappop(queue)
        put = -n
        best = int(np.where(room >= put, cost, np.inf).argmin())
        if room[best] < put:
            best = int(room.argmax())
            put = int(room[best])
            heapq.heappush(queue, (put + n, i, start + put, key))
        made[best].pieces.append((key, start, put))
        room[best] -= put
        left -= put
        cost[best] += settings.linear * put + settings.quadratic * put * put
    return made, [(-n, key, start) for n, _, start, key in queue]


@dataclass
class Packer:
    """Packs the documents of one task; ``rows`` are what is ready, ``ready`` the bytes of their ids."""

    settings: Packing
    number: int
    rows: list[tuple] = field(default_factory=list)
    ready: int = 0
    held: list[tuple[int, tuple]] = field(default_factory=list)  # (length, (doc, start, doc_tokens, ids))

    def put(self, doc: object, start: int, ids: bytes, total: int, offset: int, size: int) -> None:
        self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.number, offset, size, ids))
        self.ready += len(ids) + 200

    def add(self, doc: object, ids: bytes) -> Iterator[None]:
        """Take one document in; yields wherever ``rows`` may be emptied."""
        full, total = self.settings.tokens, len(ids) // 4
        rest = total - total % full
        for start in range(0, rest, full):
            self.put(doc, start, ids[4 * start : 4 * (start + full)], total, 0, full)
            self.number += 1
            yield
        if total % full:
            self.held.append((total % full, (doc, rest, total, ids[4 * rest :])))
        if len(self.held) >= self.settings.window:
            self.deal()
            yield

    def deal(self) -> None:
        full = self.settings.tokens
        done, rest = pack(self.held, self.settings, sum(n for n, _ in self.held) // full)
        for s in done:
            at = 0
            for (doc, start, total, ids), a, n in s.pieces:
                self.put(doc, start + a, ids[4 * a : 4 * (a + n)], total, at, full)
                at += n
            self.number += 1
        self.held = [(n, (doc, start + a, total, ids[4 * a :])) for n, (doc, start, total, ids), a in sorted(rest, key=lambda r: -r[0])]

    def close(self) -> None:
        """Deal what is held; the last tokens become sequences of power of two lengths."""
        self.deal()
        left, at = sum(n for n, _ in self.held), 0
        size = 1 << (left.bit_length() - 1) if left else 0
        queue = deque(self.held)
        while queue:
            n, (doc, start, total, ids) = queue.popleft()
            take = min(n, size - at)
            self.put(doc, start, ids[: 4 * take], total, at, size)
            at += take
            if take < n:
                queue.appendleft((n - take, (doc, start + take, total, ids[4 * take :])))
            if at == size:
                self.number, left, at = self.number + 1, left - size, 0
                size = 1 << (left.bit_length() - 1) if left else 0


_LONGS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens")


def packed(docs: DataFrame, path: str, pattern: str, settings: Packing = Packing(), id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, added_tokens: bool = False) -> DataFrame:
    """Per piece: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens.

    ``with_ids`` adds ``ids``, the piece's ids as little-endian unsigned 32-bit
    bytes. With ``added_tokens`` the literal of an added token of the file, such
    as ``<|endoftext|>``, gets its id, as ``tokenizers`` does by default;
    otherwise it is text like any other (``encode_special_tokens``).
    """
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = given.schema["id"].dataType
    schema = ", ".join([f"`{id_col}` {id_type.simpleString()}", *(f"{n} long" for n in _LONGS), *(["ids binary"] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        tokens = coder_of(path, pattern, added_tokens)
        end = np.array([settings.end_id], "<u4").tobytes()
        packer = Packer(settings, (context.partitionId() if context else 0) << 36)

        def flush() -> pa.RecordBatch:
            doc, *longs, ids = zip(*packer.rows, strict=True)
            columns = [pa.array(doc, to_arrow_type(id_type)), *(pa.array(v, pa.int64()) for v in longs), *([pa.array(ids, pa.binary())] if with_ids else [])]
            packer.rows, packer.ready = [], 0
            return pa.RecordBatch.from_arrays(columns, names=[id_col, *_LONGS, *(["ids"] if with_ids else [])])

        for batch in batches:
            docs_, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                for _ in packer.add(docs_[i].as_py(), (tokens.encode(text) if text else b"") + end):
                    if packer.ready >= settings.flush_bytes:
                        yield flush()
        packer.close()
        if packer.rows:
            yield flush()

    return given.mapInArrow(run, schema)
