"""Fill-in-the-middle transformation over content-defined chunks whose summaries are remembered.

A rolling hash cuts texts where their last bytes say so, hence equal passages of different texts give equal chunks. What a
chunk adds to its text (line ends, code points, whether it holds a marker, its first and last bytes) is worked out once and
kept under the chunk's own bytes, so a chunk that comes again is told by its content and not by a hash. Adding up the
chunks' counts finds the chunk that a cut falls into; the cut inside it follows from its line ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.bpe import slices
from panelspark.llm.common import text_of

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
#: Bytes that the rolling hash sees, bits of it that must be zero at a cut, and a chunk's fewest and most bytes.
SEEN, BITS, LEAST, MOST = 32, 9, 64, 4096
#: Chunks, and bytes in them, that a worker process remembers before it starts over.
REMEMBERED, REMEMBERED_BYTES = 60_000, 24_000_000
_APART = b"\xff" * SEEN


@lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    """A number for each byte; 0xFF, which no UTF-8 text holds, is zero and keeps neighbouring texts apart."""
    numbers = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)
    numbers[255] = 0
    return numbers


def rolling(data: np.ndarray) -> np.ndarray:
    """For each byte the hash of the last SEEN bytes: the sum of their numbers, each shifted by its distance. The window
    doubles from one byte on."""
    sums, width = _gear()[data], 1
    while width < SEEN:
        longer = sums.copy()
        longer[width:] += sums[:-width] << np.uint32(width)
        sums, width = longer, 2 * width
    return sums


def cuts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Where the chunks of each text [start, end) of ``data`` end. Texts lie SEEN bytes of 0xFF apart."""
    marks = np.flatnonzero(rolling(data) >> np.uint32(32 - BITS) == 0) + 1
    first, last = np.searchsorted(marks, starts), np.searchsorted(marks, ends)
    out = []
    for start, end, a, b in zip(starts.tolist(), ends.tolist(), first.tolist(), last.tolist()):
        own, at = [], start
        for mark in [*marks[a:b].tolist(), end]:
            while mark - at > MOST:
                at += MOST
                own.append(at)
            if mark - at >= LEAST or mark == end and mark > at:
                own.append(mark)
                at = mark
        out.append(own)
    return out


class Summary(NamedTuple):
    """What a chunk adds to a text."""

    size: int
    chars: int
    #: Bytes and code points up to and with each line end.
    ends: np.ndarray
    end_chars: np.ndarray
    marked: bool
    head: bytes
    tail: bytes


def summary(chunk: bytes) -> Summary:
    data = np.frombuffer(chunk, dtype=np.uint8)
    chars = np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)
    ends = np.flatnonzero(data == 10).astype(np.int32) + 1
    return Summary(len(chunk), int(chars[-1]), ends, chars[ends - 1], any(m in chunk for m in MARKERS), chunk[:2], chunk[-2:])


class Summaries:
    """Chunk bytes to their summary."""

    def __init__(self):
        self.known: dict[bytes, Summary] = {}
        self.size = 0

    def of(self, chunk: bytes) -> Summary:
        found = self.known.get(chunk)
        if found is None:
            if len(self.known) >= REMEMBERED or self.size > REMEMBERED_BYTES:
                self.known, self.size = {}, 0
            found = self.known[chunk] = summary(chunk)
            self.size += len(chunk)
        return found


@lru_cache(maxsize=1)
def summaries() -> Summaries:
    """The process's summaries: they serve the next task too and change no result."""
    return Summaries()


class Places(NamedTuple):
    """A text's lines and marker, and where given cuts (lines before them) fall."""

    lines: int
    marked: bool

    @staticmethod
    def totals(parts: list[Summary]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Line ends, bytes and code points up to and with each chunk."""
        counts = np.array([(len(p.ends), p.size, p.chars) for p in parts], dtype=np.int64).reshape(-1, 3).cumsum(axis=0)
        return counts[:, 0], counts[:, 1], counts[:, 2]


def marked(parts: list[Summary]) -> bool:
    """Whether a marker lies in a chunk or over a boundary; only a last chunk is shorter than a marker."""
    return any(p.marked for p in parts) or any(m in a.tail + b.head for a, b in zip(parts, parts[1:]) for m in MARKERS)


def located(parts: list[Summary], upto: tuple[np.ndarray, np.ndarray, np.ndarray], line: int, lines: int) -> tuple[int, int]:
    """Bytes and code points before a cut after so many of the text's lines."""
    if line == 0:
        return 0, 0
    if line == lines:
        return int(upto[1][-1]), int(upto[2][-1])
    i = int(np.searchsorted(upto[0], line))
    before = [int(u[i - 1]) if i else 0 for u in upto]
    k = line - before[0] - 1
    return before[1] + int(parts[i].ends[k]), before[2] + int(parts[i].end_chars[k])


class Cut(NamedTuple):
    lines: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: bytes


def transformed(text: bytes, parts: list[Summary], h: tuple[int, int, int, int], rate: int, spm: int) -> Cut:
    """A text's new order, from its chunks' summaries and four drawn numbers."""
    if not text:
        return Cut(0, "plain", None, None, text)
    upto = Places.totals(parts)
    lines = int(upto[0][-1]) + (parts[-1].tail[-1] != 10)
    if h[2] % 100 >= rate or marked(parts):
        return Cut(lines, "plain", None, None, text)
    first, second = sorted((h[0] % (lines + 1), h[1] % (lines + 1)))
    (a, a_chars), (b, b_chars) = located(parts, upto, first, lines), located(parts, upto, second, lines)
    if h[3] % 100 < spm:
        form, output = "spm", (SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b])
    else:
        form, output = "psm", (PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b])
    return Cut(lines, form, a_chars, b_chars - a_chars, b"".join(output))


def drawn(id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the seed and a row's id; a null id counts as no digits."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


COLUMNS = ["n", "form", "prefix_chars", "middle_chars", "output"]


def fill_in_middle(docs: DataFrame, id: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """``docs`` with ``n`` (lines), ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars`` (code points, null if
    plain) and ``output``; columns of these names are replaced.

    A line ends with its line feed or with the text. ``rate`` of 100 texts are transformed, ``spm`` of 100 of these with
    the suffix first. Null and empty texts give an empty output in plain form, as do texts that hold a marker unchanged;
    equal rows get equal results; an empty table gives no rows. A text of any length is cut as a whole: a batch holds
    about a megabyte of texts, a longer text goes alone.
    """
    kept = [c for c in docs.columns if c not in COLUMNS]
    given = docs.select(*kept, F.array(*drawn(F.col(id), seed)).alias("_h"), text_of(text).alias("_text"))
    added = T.StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string")
    out = T.StructType([*docs.select(*kept).schema.fields, *added.fields])
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = summaries()
        for batch in batches:
            for row, texts in slices(batch.column(len(kept) + 1)):
                h = batch.column(len(kept)).slice(row, len(texts)).to_pylist()
                raw = [t.encode("utf-8", "surrogatepass") for t in texts]
                data = _APART.join(raw)
                sizes = np.array([len(t) for t in raw], dtype=np.int64)
                starts = np.cumsum(sizes + SEEN) - sizes - SEEN
                ends = cuts(np.frombuffer(data, dtype=np.uint8), starts, starts + sizes)
                found = []
                for t, start, own, drawn_ in zip(raw, starts.tolist(), ends, h):
                    parts = [known.of(data[a:b]) for a, b in zip([start, *own[:-1]], own)]
                    found.append(transformed(t, parts, drawn_, rate, spm))
                columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(types)]
                outputs = pa.array([f.output for f in found], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(row, len(texts)) for i in range(len(kept))), *columns, outputs], out.names)

    return given.mapInArrow(run, out)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output and its form stand for."""
    p, s, m = (marker.decode() for marker in MARKERS)
    o = F.col(output)
    # No part holds a marker, and none begins inside another, so each is found where it was put.
    part = lambda begin, end: F.substring_index(F.substring_index(o, begin, -1), end, 1)
    psm = F.concat(part(p, s), F.substring_index(o, m, -1), part(s, m))
    spm = F.concat(part(p, m), F.substring_index(o, m, -1), part(s, p))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(o)
