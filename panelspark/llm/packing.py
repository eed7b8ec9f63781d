"""Packing token sequences online with a fixed number of open windows per partition.

Every partition keeps a few open windows. A piece goes into the fullest one that it fits (best fit). Where it fits none,
the fullest window is emitted; if more than SLACK of it are free, the piece's beginning fills it first. What is open at a
partition's end is left over: left-over pieces of neighbouring partitions are packed again the same way, in rounds, until
one set is left, which is closed.
"""

from __future__ import annotations

import os
import string
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.bpe import Lists
from panelspark.llm.common import shared_table

#: Tokens in a window, open windows of a partition, free tokens that a window may be emitted with.
WINDOW, OPEN, SLACK = 2048, 32, 8
#: Partitions whose left-over windows are packed together in a round.
TOGETHER = 16
#: Distinct words, and characters in them, that a worker process remembers before it starts over.
REMEMBERED, REMEMBERED_CHARS = 600_000, 12_000_000
#: Bytes of text that are cut into words together; words that the library is given at a time.
BATCH, JOINED = 4_000_000, 500
#: Pieces in a batch of results.
ROWS = 20_000


class Tokens:
    """The ids of texts by the tokenizers library, each distinct word encoded once.

    Its rules drop white space and never look across it, so the words between spaces and line feeds have ids of their own;
    and a letter never joins the punctuation behind it, so neither do words and what closes them.
    """

    def __init__(self, path: str):
        # Tasks share the cores already; the library's own threads cost more than they save on single words.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.forget()

    def forget(self) -> None:
        self.words, self.stems, self.size = Lists(), Lists(), 0

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of many words in a row, and how many each has."""
        out, sizes = [], []
        for i in range(0, len(words), JOINED):
            part = words[i : i + JOINED]
            found = self.library.encode(" ".join(part), add_special_tokens=False)
            ends = np.cumsum([len(w) + 1 for w in part])
            place = np.searchsorted(ends, np.array([a for a, _ in found.offsets], dtype=np.int64), side="right")
            out.append(np.array(found.ids, dtype=np.int32))
            sizes.append(np.bincount(place, minlength=len(part)))
        return np.concatenate(out), np.concatenate(sizes)

    def _learn(self, words: list[str]) -> None:
        """Adds words: of each the stem, and the punctuation behind it."""
        parts, counts = [], []
        for w in words:
            own = [w]
            if "<|" not in w:  # else it may hold a special token
                stem = w.rstrip(string.punctuation)
                # A letter may fold to a letter and a mark, which would join the punctuation; such words stay whole.
                if len(stem) < len(w) and stem and stem[-1].lower().isalpha():
                    own = [stem, w[len(stem) :]]
                # The rules fold case.
                if own[0].isascii():
                    own[0] = own[0].lower()
            parts += own
            counts.append(len(own))
        index = self.stems.find(parts)
        missing = list(dict.fromkeys(map(parts.__getitem__, np.flatnonzero(index < 0).tolist())))
        if missing:
            self.stems.add(missing, *self._encode(missing))
            index = self.stems.find(parts)
        ids, upto = self.stems.take(index)
        self.words.add(words, ids, np.diff(np.append(0, upto)[np.cumsum(counts)], prepend=0))
        self.size += sum(map(len, words))

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text's closed by ``end``, and how many each has; a null text is empty."""
        if len(self.words.number) > REMEMBERED or self.size > REMEMBERED_CHARS:
            self.forget()
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        # Words are told apart before they come to Python: each of a batch's once.
        flat = pc.dictionary_encode(lists.flatten())
        names = flat.dictionary.to_pylist()
        index = self.words.find(names)
        new = np.flatnonzero(index < 0).tolist()
        if new:
            missing = list(map(names.__getitem__, new))
            self._learn(missing)
            index[new] = self.words.find(missing)
        ids, upto = self.words.take(index[flat.indices.to_numpy()])
        ends = np.append(0, upto)[np.cumsum(lists.value_lengths().to_numpy())]
        return np.insert(ids, ends, end), np.diff(ends, prepend=0) + 1


def _batches(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of about BATCH bytes at a time; a longer text comes alone."""
    upto = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)))
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(upto, upto[row] + BATCH, side="right")) - 1)
        yield row, texts.slice(row, last - row)
        row = last


@lru_cache(maxsize=1)
def tokens(path: str) -> Tokens:
    """The process's words: they serve the next task too and change no result."""
    return Tokens(path)


class Piece(NamedTuple):
    """A run of a document's ids."""

    id: object
    start: int
    ids: np.ndarray
    total: int


class Packer:
    """Open windows, the fullest first to be emitted."""

    def __init__(self, window: int, most: int, slack: int):
        self.window, self.most, self.slack = window, most, slack
        #: (free tokens, number) of the open windows, ascending, and their pieces.
        self.free: list[tuple[int, int]] = []
        self.held: dict[int, list[Piece]] = {}
        self.next = 0
        self.full: list[tuple[int, list[Piece]]] = []

    def _emit(self, number: int, pieces: list[Piece]) -> None:
        self.full.append((number, pieces))

    def _put(self, at: int, piece: Piece) -> None:
        free, number = self.free.pop(at)
        self.held[number].append(piece)
        if free == len(piece.ids):
            self._emit(number, self.held.pop(number))
        else:
            insort(self.free, (free - len(piece.ids), number))

    def add(self, piece: Piece) -> None:
        """Whole windows of a long run first, then the rest by best fit."""
        while len(piece.ids) >= self.window:
            self._emit(self.next, [piece._replace(ids=piece.ids[: self.window])])
            self.next += 1
            piece = piece._replace(start=piece.start + self.window, ids=piece.ids[self.window :])
        while len(piece.ids):
            at = bisect_left(self.free, (len(piece.ids), -1))
            if at < len(self.free):
                return self._put(at, piece)
            if len(self.free) >= self.most:
                gap, number = self.free[0]
                if gap > self.slack:
                    self._put(0, piece._replace(ids=piece.ids[:gap]))
                    piece = piece._replace(start=piece.start + gap, ids=piece.ids[gap:])
                    continue
                del self.free[0]
                self._emit(number, self.held.pop(number))
            self.free.append((self.window, self.next))
            self.held[self.next] = []
            self.next += 1

    def emitted(self) -> list[tuple[int, list[Piece]]]:
        out, self.full = self.full, []
        return out

    def close(self) -> None:
        """Emits what is open: its pieces are laid end to end and cut into windows, the last run into windows whose sizes
        are powers of two, which need no padding."""
        left = [p for _, number in reversed(self.free) for p in self.held[number]]
        self.free, self.held = [], {}
        rest, room, held = sum(len(p.ids) for p in left), 0, []
        for piece in left:
            while len(piece.ids):
                if not room:
                    room = self.window if rest >= self.window else 1 << rest.bit_length() - 1
                n = min(room, len(piece.ids))
                held.append(piece._replace(ids=piece.ids[:n]))
                piece = piece._replace(start=piece.start + n, ids=piece.ids[n:])
                room, rest = room - n, rest - n
                if not room:
                    self._emit(self.next, held)
                    self.next, held = self.next + 1, []


_ROW = "start long, length long, ids_crc32 long, doc_tokens long, part int, round int, window long, offset long, ids binary"


def _schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("id", kind), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
                      ("part", pa.int32()), ("round", pa.int32()), ("window", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def _table(windows: list[tuple[int, list[Piece]]], part: int, round_: int, left: bool, kind: pa.DataType) -> list[pa.RecordBatch]:
    """A row for each piece of the windows; left-over ones carry their ids."""
    rows = []
    for number, pieces in windows:
        offset = 0
        for p in pieces:
            data = p.ids.astype("<u4").tobytes()
            rows.append((p.id, p.start, len(p.ids), zlib.crc32(data), p.total, part, round_, number, offset, data if left else None))
            offset += len(p.ids)
    if not rows:
        return []
    return [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _schema(kind))], schema=_schema(kind))]


def _left(packer: Packer) -> list[tuple[int, list[Piece]]]:
    return [(number, packer.held[number]) for _, number in packer.free]


def pack(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", end: int = 1, window: int = WINDOW, most: int = OPEN, slack: int = SLACK) -> DataFrame:
    """One row per piece: id, ``start`` (the document's ids before it), ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset`` (place in the sequence).

    A document is its text's ids and one ``end`` id, so null and empty texts are one token; every id lies in one piece,
    and repeated rows are documents of their own. Sequences hold ``window`` tokens at most and are emitted with ``slack``
    free at most; the last few have a power of two. A text of any length is encoded as a whole. An empty table gives no
    rows. A task works on about four megabytes of texts at a time, a longer text alone, and holds ``most`` windows.
    """
    kind = docs.select(F.col(id).alias("id")).schema["id"].dataType
    layout = f"id {kind.simpleString()}, {_ROW}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer, part = tokens(path), Packer(window, most, slack), TaskContext.get().partitionId()
        arrow = None
        for batch in batches:
            arrow = batch.column(0).type
            for row, texts in _batches(batch.column(1)):
                ids, sizes = own.encode(texts, end)
                at = 0
                for name, n in zip(batch.column(0).slice(row, len(texts)).to_pylist(), sizes.tolist()):
                    packer.add(Piece(name, 0, ids[at : at + n].copy(), n))
                    at += n
                yield from _table(packer.emitted(), part, 0, False, arrow)
        if arrow is not None:
            yield from _table(_left(packer), part, 0, True, arrow)

    def again(round_: int, last: bool):
        def merge(rows: pa.Table) -> pa.Table:
            packer = Packer(window, most, slack)
            ordered = rows.sort_by([("part", "ascending"), ("window", "ascending"), ("offset", "ascending")])
            part = ordered["part"][0].as_py() // TOGETHER
            for r in ordered.select(["id", "start", "ids", "doc_tokens"]).to_pylist():
                packer.add(Piece(r["id"], r["start"], np.frombuffer(r["ids"], dtype="<u4"), r["doc_tokens"]))
            arrow = rows.schema.field("id").type
            if last:
                packer.close()
            batches = _table(packer.emitted(), part, round_, False, arrow) + _table(_left(packer), part, round_, True, arrow)
            return pa.Table.from_batches(batches, schema=_schema(arrow))

        return merge

    found = shared_table(docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, layout))
    done, round_ = found.where("ids is null"), 0
    left = found.where("ids is not null")
    parts = left.agg(F.max("part")).first()[0]
    while parts is not None:
        round_, last, parts = round_ + 1, parts < TOGETHER, parts // TOGETHER
        group = left.withColumn("group", F.floor(F.col("part") / TOGETHER)).groupBy("group")
        merged = shared_table(group.applyInArrow(again(round_, last), layout))
        done, left = done.unionByName(merged.where("ids is null")), merged.where("ids is not null")
        if last:
            break
    # A window's number, its partition and its round make its name.
    name = F.col("window") + F.shiftleft(F.col("part").cast("long"), 32) + F.shiftleft(F.col("round").cast("long"), 56)
    return done.select(F.col("id").alias(id), "start", "length", "ids_crc32", "doc_tokens", name.alias("sequence_id"), "offset")
