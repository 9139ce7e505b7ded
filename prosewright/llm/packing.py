"""Packing: sum-of-squares online packing into windows of ``capacity`` tokens.

A document of n tokens first fills floor(n / capacity) windows of its own; the rest, if any, is placed online: a level
array counts the open windows at each fill, and the piece goes to the fill level (or a new window) that leaves the
sum of squared counts smallest, ties to the fullest window.  Every input partition packs by itself and holds only its
open windows.  Those go on to packers of about TOKENS_A_PACKER tokens, where they are pieces in turn: they are placed by
the same rule, again and again while that closes windows.  Only what is open then is cut: the emptiest windows fill
up the fullest, and the last one of a packer goes into windows whose lengths are powers of two, so no padding is left.
``by_cut`` marks the pieces that this last step moved or split.

Null text is the empty text: it has only the end id.  Repeated rows are packed each.  An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosewright.llm.common import Scratch
from prosewright.llm.tokens import load_tokenizer, safe_pieces

CAPACITY = 1024
PARTITION_BITS = 40
MERGED = 1 << 62  # sequence ids of windows that packers of open windows close
TOKENS_A_PACKER = 1 << 22  # 16 MB of ids
PART_CHARS = 1 << 20
MEMO_CHARS = 1 << 25

FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SCHEMA = ", ".join(f"{f} long" for f in FIELDS) + ", by_cut boolean"

_SURE = r"[\w!-/:-@\[-`{-~]"  # surely not white space
_LETTER, _MARK = r"A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"
#: pieces that a byte-level BPE with the usual pattern keeps apart: letters, digits or marks with a space before them, short
#: forms, an apostrophe, a line feed, if what follows surely ends them; else all up to a space or line feed behind a sure character
_UNITS = re.compile(
    rf" ?[{_LETTER}]++(?=[ \n0-9'{_MARK}]|\Z)| ?[0-9]++(?=[ \n{_LETTER}'{_MARK}]|\Z)| ?[{_MARK}]++(?=[ \n{_LETTER}0-9]|\Z)"
    rf"|\n(?=[{_LETTER}0-9'{_MARK}])|'(?:[stmd]|re|ve|ll)|'(?=[{_LETTER}0-9])|.+?(?<={_SURE})(?=[ \n])|.+",
    re.S,
)
_SINGLE = re.compile(rf" ?(?:[{_LETTER}]+|[0-9]+|[{_MARK}]+)")
#: bytes as the characters that byte-level vocabularies are spelled in: printable ones as they are, the others from 256 on
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SPELLED = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class Known(dict):
    """Ids of pieces as little-endian bytes, asked of the library when first looked up: its model for single pieces, its encoder for others."""

    def __init__(self, tok):
        super().__init__()
        self.tok, self.model, self.held = tok, tok.model, 0

    def __missing__(self, piece: str) -> bytes:
        if self.held > MEMO_CHARS:
            self.clear()
            self.held = 0
        if _SINGLE.fullmatch(piece):
            ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_SPELLED))]
        else:
            ids = self.tok.encode(piece, add_special_tokens=False).ids
        self.held += len(piece) + 64
        self[piece] = packed = struct.pack(f"<{len(ids)}I", *ids)
        return packed


class Encoder:
    """Ids of whole texts as the tokenizer's library gives them.

    A byte-level BPE's ids of a text are those of its pieces in a row, so the library is asked once for each distinct piece
    that is remembered.  Texts that hold a special token's string, and tokenizers of other kinds, are encoded part by part.
    """

    def __init__(self, name: str):
        self.tok, self.model_file = load_tokenizer(name), name.endswith(".model")
        if not self.model_file:
            made = json.loads(self.tok.to_str())
            kind = made["pre_tokenizer"] or {}
            self.by_piece = made["normalizer"] is None and kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind["add_prefix_space"]
            self.special = [t["content"] for t in made["added_tokens"]]
            self.known = Known(self.tok)

    def ids(self, text: str) -> np.ndarray:
        if self.model_file:
            return np.array(self.tok.encode(text), "<u4")
        parts = []
        by_piece = self.by_piece and not any(s in text for s in self.special)
        for part in safe_pieces(text, PART_CHARS if by_piece else 16_384):
            if by_piece:
                parts.append(np.frombuffer(b"".join(map(self.known.__getitem__, _UNITS.findall(part))), "<u4"))
            else:
                parts.append(np.array(self.tok.encode(part, add_special_tokens=False).ids, "<u4"))
        return np.concatenate(parts) if parts else np.empty(0, "<u4")


_ENCODERS: dict[str, Encoder] = {}  # one for each worker, as its tasks see the same words


def encoded(name: str, texts: list[str | None], end_id: int | None) -> Iterator[np.ndarray]:
    """The ids of each text, then ``end_id``."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    encoder = _ENCODERS[name]
    tail = np.array([] if end_id is None else [end_id], "<u4")
    for text in texts:
        yield np.concatenate((encoder.ids(text), tail)) if text else tail


class SumOfSquares:
    """Open windows of one packer, each a list of pieces (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.level = np.zeros(capacity + 1, "i8")  # open windows at each fill; 0 and capacity stay empty
        self.open: list[list[list]] = [[] for _ in range(capacity)]

    def best_level(self, size: int) -> int:
        """The fill to extend by ``size``; 0 is a new window."""
        count, last = self.level, self.capacity - size
        change = 2 * count[size:] + 1  # of the level that is reached
        change[last] = 0  # a full window leaves the array
        change[1:] -= 2 * count[1 : last + 1] - 1  # of the level that is left
        usable = count[: last + 1] > 0
        usable[0] = True
        change = np.where(usable, change, np.iinfo("i8").max)
        return last - int(np.argmin(change[::-1]))

    def place(self, pieces: list, size: int) -> list | None:
        """Puts pieces of ``size`` tokens, which stay together, into a window; returns it if that fills it."""
        at = self.best_level(size)
        if at:
            window = self.open[at].pop()
            self.level[at] -= 1
        else:
            window = []
        window += pieces
        if at + size == self.capacity:
            return window
        self.level[at + size] += 1
        self.open[at + size].append(window)
        return None

    def left(self) -> list[tuple[int, list]]:
        """(fill, window) of the open windows, fullest first."""
        return [(fill, window) for fill in range(self.capacity - 1, 0, -1) for window in self.open[fill]]


def merged(windows: list[tuple[int, list]], capacity: int) -> tuple[list[list], list[tuple[int, list]]]:
    """Places open windows as pieces, fullest first, as often as that closes some: full windows, and those still open."""
    full: list[list] = []
    while True:
        packer = SumOfSquares(capacity)
        made = [w for fill, pieces in sorted(windows, key=lambda w: -w[0]) if (w := packer.place(list(pieces), fill)) is not None]
        full += made
        left = packer.left()
        if len(left) == len(windows):
            return full, left
        windows = left


def cut_to_fit(windows: list[tuple[int, list]], capacity: int) -> Iterator[list]:
    """Fills the fullest of the open windows with cuts of the emptiest; the last one goes into powers of two.

    Pieces come out as (doc_id, start, ids, doc_tokens, by_cut).
    """
    windows = sorted(windows, key=lambda w: -w[0])
    whole = [[(*p, False) for p in pieces] for _, pieces in windows]
    fills = [fill for fill, _ in windows]
    at, end = 0, len(whole)
    donor: list[tuple] = []

    def taken(room: int) -> list[tuple]:
        nonlocal donor, end
        out = []
        while room and (donor or end > at + 1):
            if not donor:
                end -= 1
                donor = whole[end]
            doc, start, ids, total, _ = donor.pop(0)
            out.append((doc, start, ids[:room], total, True))
            if len(ids) > room:
                donor.insert(0, (doc, start + room, ids[room:], total, True))
            room -= len(out[-1][2])
        return out

    while at < end:
        more = taken(capacity - fills[at])
        size = fills[at] + sum(len(p[2]) for p in more)
        if size == capacity:
            yield whole[at] + more
        else:  # the last one
            donor, end = whole[at] + more, at + 1
            while size:
                room = 1 << (size.bit_length() - 1)
                yield taken(room)
                size -= room
        at += 1
        if at == end and donor:  # what the last donor has left
            size = sum(len(p[2]) for p in donor)
            while size:
                room = 1 << (size.bit_length() - 1)
                yield taken(room)
                size -= room


class _Rows:
    """Output rows of windows, as Arrow batches; ``ids`` is kept only for pieces of open windows."""

    def __init__(self, base: int):
        self.base, self.made, self.rows = base, 0, []

    def add(self, window: list[tuple], still_open: bool = False) -> None:
        at = 0
        for doc, start, ids, total, by_cut in window:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.base + self.made, at, by_cut, ids.tobytes() if still_open else None))
            at += len(ids)
        self.made += 1

    def batch(self):
        import pyarrow as pa

        columns = list(zip(*self.rows, strict=True))
        self.rows = []
        kinds = [pa.int64()] * 7 + [pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*FIELDS, "by_cut", "ids"])


def place_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int | None = 0) -> DataFrame:
    """Pieces of each document in the windows of its partition; those of windows still open carry their ids."""

    def placed(batches):
        from pyspark import TaskContext

        out, packer = _Rows(TaskContext.get().partitionId() << PARTITION_BITS), SumOfSquares(capacity)
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encoded(tokenizer, batch.column(1).to_pylist(), end_id), strict=True):
                total, full = len(ids), len(ids) - len(ids) % capacity
                for start in range(0, full, capacity):
                    out.add([(doc, start, ids[start : start + capacity], total, False)])
                if full < total and (window := packer.place([(doc, full, ids[full:], total)], total - full)):
                    out.add([(*p, False) for p in window])
            if out.rows:
                yield out.batch()
        for i, (_, window) in enumerate(packer.left(), 1):
            out.add([(*p, False) for p in window], still_open=True)
            if i % 256 == 0:
                yield out.batch()
        if out.rows:
            yield out.batch()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(placed, SCHEMA + ", ids binary")


def close_windows(left: DataFrame, packers: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of open windows in full ones: windows are dealt to the packers by hash, and each packer is one task."""

    def closed(batches):
        held: dict[int, dict[int, list]] = {}
        for batch in batches:
            packer, doc, start, total, sequence, ids = (batch.column(i).to_pylist() for i in range(6))
            for p, s, *piece, raw in zip(packer, sequence, doc, start, total, ids, strict=True):
                held.setdefault(p, {}).setdefault(s, []).append((piece[0], piece[1], np.frombuffer(raw, "<u4"), piece[2]))
        for p in sorted(held):
            out = _Rows(MERGED | p << PARTITION_BITS)
            full, still = merged([(sum(len(x[2]) for x in w), w) for _, w in sorted(held[p].items())], capacity)
            for i, window in enumerate(chain(([(*x, False) for x in w] for w in full), cut_to_fit(still, capacity)), 1):
                out.add(window)
                if i % 4096 == 0:
                    yield out.batch()
            if out.rows:
                yield out.batch()

    dealt = left.withColumn("packer", F.pmod(F.xxhash64("sequence_id"), F.lit(packers)).cast("int"))
    rows = dealt.repartitionById(packers, F.col("packer")).sortWithinPartitions("packer", "sequence_id", "offset")
    return rows.select("packer", "doc_id", "start", "doc_tokens", "sequence_id", "ids").mapInArrow(closed, SCHEMA + ", ids binary")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int | None = 0, tokens_a_packer: int = TOKENS_A_PACKER) -> DataFrame:
    """A row for each piece of each document, with its window (``sequence_id``) and place there; texts are read once and not shuffled."""
    placed = Scratch(docs.sparkSession, "packing").write(place_documents(docs, tokenizer, capacity, end_id), "placed")
    left = placed.where("ids IS NOT NULL")
    tokens = left.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    packers = max(1, -(-tokens // tokens_a_packer))
    return placed.where("ids IS NULL").union(close_windows(left, packers, capacity)).drop("ids")
