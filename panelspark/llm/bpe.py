"""Byte-level BPE with batched merge rounds.

Texts are cut at single spaces into chunks that the tokenizer's own pattern never crosses; each task encodes a distinct
chunk once. New words of a batch go through merge rounds together: all their symbols lie in one flat array, each round
looks up all neighbouring pairs by binary search in the sorted pair keys, takes the lowest-ranked pair of every word and
merges its occurrences from the left.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The tokenizer's pre-tokenisation pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words or chunks, and characters in chunks, that a worker process remembers, over tasks, before it starts over.
REMEMBERED, REMEMBERED_CHARS = 150_000, 3_000_000
#: Characters of text that are encoded together, and ids that are decoded together; a longer text goes alone.
BATCH, DECODED = 1_000_000, 500_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 characters stand
    for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE tokenizer file: merges as sorted pair keys, the bytes of every id, added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        ids = parts["model"]["vocab"]
        symbols = byte_symbols()
        self.of_byte = np.array([ids[s] for s in symbols], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in parts["model"]["merges"]]
        left = np.array([ids[a] for a, _ in merges], dtype=np.int64)
        right = np.array([ids[b] for _, b in merges], dtype=np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        self.added = {t["content"]: t["id"] for t in parts["added_tokens"]}
        byte_of = {s: b for b, s in enumerate(symbols)}
        top = max([*ids.values(), *self.added.values()])
        self.pieces = [b""] * (top + 1)
        for token, i in ids.items():
            self.pieces[i] = bytes(byte_of[c] for c in token)
        for token, i in self.added.items():
            self.pieces[i] = token.encode()
        self.lengths = np.array([len(p) for p in self.pieces], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.pieces), dtype=np.uint8)
        self.cut_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (none empty) in a row and how many each has, by merge rounds over all of them at once."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_word = [], []
        none = len(self.ranks)
        while len(symbols):
            same = word[1:] == word[:-1]
            pairs = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
            rank = np.where(same & (self.keys[at] == pairs), self.ranks[at], none)
            rank = np.append(rank, none)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            lowest = np.minimum.reduceat(rank, first)
            spread = np.repeat(lowest, np.diff(np.append(first, len(word))))
            # Words without a pair left are complete and leave.
            active = spread < none
            if not active.all():
                done_symbols.append(symbols[~active])
                done_word.append(word[~active])
                symbols, word, rank, spread = symbols[active], word[active], rank[active], spread[active]
                if not len(symbols):
                    break
            hit = rank == spread
            # Of overlapping hits (equal symbols in a row) every second one counts from the left.
            here = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), here, 0))
            place = here - run
            hit &= place % 2 == 0
            symbols = symbols.copy()
            symbols[hit] = self.made[rank[hit]]
            stays = np.append(True, ~hit[:-1])
            symbols, word = symbols[stays], word[stays]
        if done_symbols:
            symbols, word = np.concatenate(done_symbols), np.concatenate(done_word)
            order = np.argsort(word, kind="stable")
            symbols, word = symbols[order], word[order]
        return symbols, np.bincount(word, minlength=len(words))

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and where each text of ``sizes`` ids ends in them."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - n), n)
        upto = np.cumsum(sizes)
        return self.bytes[at], np.append(0, ends)[upto]

    def texts(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The text of every list of ids, DECODED ids at a time."""
        upto, out, row = np.append(0, np.cumsum(sizes)), [], 0
        while row < len(sizes):
            last = max(row + 1, int(np.searchsorted(upto, upto[row] + DECODED, side="right")) - 1)
            data, ends = self.decode(ids[upto[row] : upto[last]], sizes[row:last])
            whole = data.tobytes()
            out += [whole[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends[:-1]], ends)]
            row = last
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The process's encoder: what it remembers serves the next task too and changes no result."""
    return Encoder(vocabulary(path))


class Lists:
    """Lists of ids by name, end to end in one array."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def add(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.number.update(zip(names, range(len(self.ends) - 1, len(self.ends) - 1 + len(names))))
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def find(self, names: list[str]) -> np.ndarray:
        """The numbers of names; -1 for those not known."""
        return np.fromiter(map(self.number.get, names, repeat(-1)), dtype=np.int64, count=len(names))

    def take(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all numbers in a row, and where each one's end."""
        n = self.ends[index + 1] - self.ends[index]
        upto = np.cumsum(n)
        at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(self.ends[index] - (upto - n), n)
        return self.ids[at], upto


class Encoder:
    """What a task remembers of words and chunks."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.pattern = vocab, regex.compile(PATTERN)
        self.forget()

    def forget(self) -> None:
        self.words, self.chunks, self.size = Lists(), Lists(), 0

    def _learn(self, keys: list[str]) -> None:
        """Adds chunks and their words. A key with a leading space is the rest of it, any other stands behind a space."""
        chunks = [k[1:] if k[0] == " " else " " + k for k in keys]
        self.size += sum(map(len, chunks))
        cut = [[c] if c in self.vocab.added else self.pattern.findall(c) for c in chunks]
        new = list(dict.fromkeys(w for ws in cut for w in ws if w not in self.words.number))
        plain = [w for w in new if w not in self.vocab.added]
        if plain:
            merged = self.vocab.merge([w.encode("utf-8", "surrogatepass") for w in plain])
            self.words.add(plain, *merged)
        for token in [w for w in new if w in self.vocab.added]:
            self.words.add([token], np.array([self.vocab.added[token]]), np.array([1]))
        ids, upto = self.words.take(self.words.find([w for ws in cut for w in ws]))
        sizes = np.diff(np.append(0, upto)[np.cumsum([len(ws) for ws in cut])], prepend=0)
        self.chunks.add(keys, ids, sizes)

    def _cut(self, text: str) -> list[str]:
        """Keys of chunks that the pattern never crosses: a single space between others always starts a match."""
        added = self.vocab.cut_added
        if added is not None and any(map(text.__contains__, self.vocab.added)):
            return [" " + part for part in added.split(text) if part]
        keys = text.split(" ")
        if keys[0]:
            keys[0] = " " + keys[0]
        else:
            del keys[0]
        return keys

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        if len(self.chunks.number) > REMEMBERED or len(self.words.number) > REMEMBERED or self.size > REMEMBERED_CHARS:
            self.forget()
        lists = list(map(self._cut, texts))
        flat = list(chain.from_iterable(lists))
        index = self.chunks.find(flat)
        missing = list(dict.fromkeys(map(flat.__getitem__, np.flatnonzero(index < 0).tolist())))
        # Where more white space follows a space, the text stays whole; such chunks are never remembered.
        odd = {c for c in missing if not c or c[0] != " " and c[0].isspace()}
        if odd:
            lists = [cut if odd.isdisjoint(cut) else [" " + t] if t else [] for cut, t in zip(lists, texts)]
            flat = list(chain.from_iterable(lists))
            index = self.chunks.find(flat)
            missing = list(dict.fromkeys(map(flat.__getitem__, np.flatnonzero(index < 0).tolist())))
        if missing:
            self._learn(missing)
            new = np.flatnonzero(index < 0)
            index[new] = self.chunks.find(list(map(flat.__getitem__, new.tolist())))
        ids, upto = self.chunks.take(index)
        sizes = np.cumsum([len(cut) for cut in lists])
        return ids, np.diff(np.append(0, upto)[sizes] if len(sizes) else np.zeros(0, dtype=np.int64), prepend=0)


def slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about BATCH bytes at a time; null is empty."""
    upto = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)))
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(upto, upto[row] + BATCH, side="right")) - 1)
        yield row, [t or "" for t in texts.slice(row, last - row).to_pylist()]
        row = last


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids`` (array of int), the whole text's tokens; a column of that name is replaced.

    Added tokens in a text become their ids, as in the tokenizers library; nothing else is added, cut off or padded.
    Null and empty texts give an empty array.
    """

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(path)
        for batch in batches:
            done = [own.encode(p) for _, p in slices(batch)]
            values = np.concatenate([np.zeros(0, dtype=np.int32), *[v for v, _ in done]])
            ends = np.concatenate([[0], *[n for _, n in done]]).cumsum()
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))

    return docs.withColumn(ids, run(F.col(text)))


def decode(tokens: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``tokens`` with ``decoded``, the text of ``ids``; bytes that are no UTF-8 become U+FFFD. Null gives an empty text."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(path)
        for batch in batches:
            batch = batch.cast(pa.list_(pa.int32()))
            sizes = np.nan_to_num(batch.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            texts = vocab.texts(batch.flatten().to_numpy(zero_copy_only=False), sizes)
            yield pa.array(texts, pa.string())

    return tokens.withColumn(decoded, run(F.col(ids)))


def round_trip(docs: DataFrame, path: str, *keep: str, text: str = "text") -> DataFrame:
    """(keep, ids, decoded): every text encoded, and its ids decoded again, in one pass of small batches."""
    kept = docs.select(*keep).schema
    out = T.StructType([*kept.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, own = vocabulary(path), encoder(path)
        for batch in batches:
            for row, texts in slices(batch.column(len(keep))):
                ids, sizes = own.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(ids, pa.int32()))
                columns = [batch.column(i).slice(row, len(texts)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(vocab.texts(ids, sizes), pa.string())], [*keep, "ids", "decoded"])
            pa.default_memory_pool().release_unused()

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, out)
