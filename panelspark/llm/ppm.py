"""Scoring texts with prediction by partial matching over bytes, next to a word unigram.

Contexts are the last ORDER bytes. Documents are dealt to chunks by hash; each chunk counts its distinct byte strings of
length ORDER + 1 and its words over training documents. Summed over chunks, the strings are the leaves of a trie whose
inner counts follow from them. The trie is worked on in subtrees below the last two context bytes (at most 2^24 leaves
each by construction); a symbol that a context hasn't seen escapes to the next shorter one, where the symbols of the
longer one are excluded. Every distinct string gets its log probability once, and goes back to the chunks that hold it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.llm.common import blocks, row_key, shared_table, text_of

ORDER = 4
#: Stands before a text and ends it; no UTF-8 text has this byte.
EDGE = 0xFF
#: Symbols that a text can go on with: all bytes, of which EDGE is the end.
ALPHABET = 256
#: Bytes of text in a chunk, on average, and those worked on at a time.
CHUNK_BYTES, PART_BYTES = 16_000_000, 2_000_000


def _mask(order: int) -> int:
    return (1 << 8 * (order + 1)) - 1


def strings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every symbol with its context as an integer (the newest byte lowest), and how many each text has."""
    edge = bytes([EDGE])
    pad = edge * ORDER
    flat = np.frombuffer(b"".join([pad + t + edge for t in texts]), dtype=np.uint8).astype(np.int64)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    keys = flat[ORDER:].copy()
    for i in range(1, ORDER + 1):
        keys |= flat[ORDER - i : len(flat) - i] << 8 * i
    # Strings that end inside the next text's padding are none.
    at = np.arange(sizes.sum()) + np.repeat(np.arange(len(texts)) * ORDER, sizes)
    return keys[at], sizes


class Counts:
    """Sorted keys with counts; zero for others."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, place = np.unique(keys, return_inverse=True)
        self.counts = np.bincount(place, weights=counts, minlength=len(self.keys))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0.0)


def log_probabilities(keys: np.ndarray, n: np.ndarray, short: np.ndarray, least: int = 2) -> np.ndarray:
    """Natural log probability of each string.

    ``keys`` and ``n``: all strings below some contexts of ``least`` bytes, n their training count (0: not seen).
    ``short``: training counts of all (last byte, symbol) pairs, 256 x 256, the trie's upper part.
    """
    grams = {ORDER: Counts(keys[n > 0], n[n > 0])}
    for k in range(ORDER - 1, least - 1, -1):
        grams[k] = Counts(grams[k + 1].keys & _mask(k), grams[k + 1].counts)
    pairs = np.flatnonzero(short)
    grams[1] = Counts(pairs, short.ravel()[pairs])
    grams[0] = Counts(grams[1].keys & _mask(0), grams[1].counts)
    totals = {k: Counts(g.keys >> 8, g.counts) for k, g in grams.items()}
    kinds = {k: Counts(g.keys >> 8, np.ones(len(g.keys))) for k, g in grams.items()}
    # What of order k a context of order k + 1 excludes: the counts there of all symbols seen here.
    excluded = {k: Counts(grams[k + 1].keys >> 8, grams[k](grams[k + 1].keys & _mask(k))) for k in range(ORDER)}
    out = np.zeros(len(keys))
    open_ = np.arange(len(keys))
    for k in range(ORDER, -1, -1):
        key = keys[open_]
        context = (key & _mask(k)) >> 8
        longer = (key & _mask(k + 1)) >> 8
        left = totals[k](context) - (excluded[k](longer) if k < ORDER else 0)
        kind = kinds[k](context) - (kinds[k + 1](longer) if k < ORDER else 0)
        count = grams[k](key & _mask(k))
        hit = count > 0
        out[open_[hit]] += np.log(count[hit] / (left[hit] + kind[hit]))
        # Contexts not seen, or with nothing left to escape from, are passed for free.
        escape = ~hit & (kind > 0)
        out[open_[escape]] += np.log(kind[escape] / (left[escape] + kind[escape]))
        open_ = open_[~hit]
    out[open_] -= math.log(max(1.0, ALPHABET - len(grams[0].keys)))
    return out


def _parts(rows: pa.Table) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes, A-Z lower-cased), PART_BYTES at a time; a longer text comes alone."""
    texts = rows["text"].cast(pa.large_binary())
    start, part, size = 0, [], 0
    for i, t in enumerate(texts):
        part.append(t.as_py().lower())
        size += len(part[-1])
        if size >= PART_BYTES:
            yield start, part
            start, part, size = i + 1, [], 0
    if part:
        yield start, part


def _learn(rows: pa.Table) -> pa.Table:
    """The chunk's distinct strings and words with their training counts; zero where only other documents have them."""
    train = rows["train"].to_numpy()
    keys, counts, words = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), Counter()
    for start, texts in _parts(rows):
        learnt = train[start : start + len(texts)]
        found, sizes = strings(texts)
        flags = np.repeat(learnt, sizes)
        # Sorting the strings alone is much faster than sorting places.
        for these, weight in ((found[flags], 1), (found[~flags], 0)):
            u, n = np.unique(these, return_counts=True)
            keys, counts = np.concatenate([keys, u]), np.concatenate([counts, n * weight])
        keys, place = np.unique(keys, return_inverse=True)
        counts = np.bincount(place, weights=counts, minlength=len(keys)).astype(np.int64)
        words.update(b"\n".join([t for t, ok in zip(texts, learnt) if ok]).split())
        for w in {*b"\n".join([t for t, ok in zip(texts, learnt) if not ok]).split()}:
            words[w] += 0
    names = sorted(words)
    chunk = rows["chunk"][0].as_py()
    return pa.table({
        "chunk": pa.array(np.full(len(keys) + len(names), chunk), pa.int32()),
        "key": pa.concat_arrays([pa.array(keys, pa.int64()), pa.nulls(len(names), pa.int64())]),
        "word": pa.concat_arrays([pa.nulls(len(keys), pa.binary()), pa.array(names, pa.binary())]),
        "n": pa.array(np.concatenate([counts, np.array([words[w] for w in names], dtype=np.int64)]), pa.int64()),
    })


def _subtree(short: np.ndarray):
    def run(rows: pa.Table) -> pa.Table:
        keys = rows["key"].to_numpy()
        return pa.table({"key": pa.array(keys), "value": pa.array(log_probabilities(keys, rows["n"].to_numpy(), short))})

    return run


class Places:
    """Finds keys in a sorted list through a table of hashes; those that collide are searched for."""

    BITS = 21

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.table = np.zeros(1 << self.BITS, dtype=np.int32)
        self.table[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.table[self._slot(keys)]
        other = np.flatnonzero(self.keys[at] != keys)
        at[other] = np.searchsorted(self.keys, keys[other])
        if not np.array_equal(self.keys[np.minimum(at[other], len(self.keys) - 1)], keys[other]):
            raise ValueError("a string of the chunk has no probability")
        return at


def _score(ends: int):
    """ends: how many training documents end, which is the count of the end token."""

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        is_key = known["key"].is_valid()
        grams = known.filter(is_key).sort_by("key")
        places, values = Places(grams["key"].to_numpy()), grams["value"].to_numpy()
        counts = known.filter(known["word"].is_valid())
        table = dict(zip(counts["word"].to_pylist(), counts["value"].to_numpy().tolist()))
        out = {"log10": [], "n_tokens": [], "n_known": [], "words10": []}
        for _, texts in _parts(rows):
            keys, sizes = strings(texts)
            first = np.cumsum(sizes) - sizes
            out["log10"].append(np.add.reduceat(values[places(keys)], first) / math.log(10))
            lists = [t.split() for t in texts]
            n = np.array([len(x) for x in lists], dtype=np.int64)
            seen = np.array([table[w] for x in lists for w in x], dtype=np.float64)
            # A zero behind the last word lets texts without words sum up to nothing.
            upto = np.concatenate([[0.0], np.cumsum(np.log10(seen + 0.5))])
            known_upto = np.concatenate([[0], np.cumsum(seen > 0)])
            last = np.cumsum(n)
            out["words10"].append(upto[last] - upto[last - n] + math.log10(ends + 0.5))
            out["n_known"].append(known_upto[last] - known_upto[last - n] + (ends > 0))
            out["n_tokens"].append(n + 1)
        return rows.select(["id", "train"]).append_column("n_tokens", pa.array(np.concatenate(out["n_tokens"]))).append_column(
            "n_known", pa.array(np.concatenate(out["n_known"]).astype(np.int64))).append_column(
            "words10", pa.array(np.concatenate(out["words10"]))).append_column("log10", pa.array(np.concatenate(out["log10"])))

    return run


def score(docs: DataFrame, id: str = "doc_id", text: str = "text", folds: int = 5, held: int = 1) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``
    (log10 of the smoothed unigram), ``score`` (log10 probability of the text's bytes, A-Z lower-cased, and its end).

    Documents whose crc32(id as text) mod ``folds`` is ``held`` are scored only; a null id is learnt from. A null text is
    empty: one token, the end. Repeated rows count and are scored each; an empty table gives no rows. Without training
    documents all symbols are equally likely.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).alias("id"), text_of(text).alias("text"), row_key(id, text).alias("row")).withColumn(
        "train", F.coalesce(F.crc32(F.encode(F.col("id").cast("string"), "UTF-8")) % folds != held, F.lit(True)))
    size, ends = docs.select(F.octet_length(text_of(text)).alias("size"), F.coalesce(F.crc32(F.encode(F.col(id).cast("string"), "UTF-8")) % folds != held, F.lit(True)).alias("train")).agg(
        F.sum("size"), F.count(F.when(F.col("train"), 1))).first()
    chunks = max(blocks(spark), -(-(size or 0) // CHUNK_BYTES))
    dealt = rows.withColumn("chunk", F.pmod("row.h1", F.lit(chunks)).cast("int")).drop("row")
    facts = shared_table(dealt.groupBy("chunk").applyInArrow(_learn, "chunk int, key long, word binary, n long"))
    grams = facts.where("key is not null").select("chunk", "key", "n")
    words = facts.where("word is not null").select("chunk", "word", "n")
    sums = grams.groupBy("key").agg(F.sum("n").alias("n"))
    short = np.zeros((256, 256))
    for r in grams.where("n > 0").groupBy(F.col("key").bitwiseAND(F.lit(_mask(1))).alias("pair")).agg(F.sum("n").alias("n")).collect():  # 2^16 rows at most
        short[r["pair"] >> 8, r["pair"] & 255] = r["n"]
    logs = sums.withColumn("below", F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF)).cast("int")).groupBy("below").applyInArrow(_subtree(short), "key long, value double")
    counted = shared_table(words.withColumn("total", F.sum("n").over(W.partitionBy("word"))).withColumn(
        "first", F.row_number().over(W.partitionBy("word").orderBy("chunk")) == 1).select("chunk", "word", "total", "first"))
    distinct, tokens = counted.where("first and total > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("total"), F.lit(0))).first()
    train_tokens, kinds = tokens + ends, distinct + (ends > 0)
    known = grams.join(logs, "key").select("chunk", "key", F.lit(None).cast("binary").alias("word"), "value").unionByName(
        counted.select("chunk", F.lit(None).cast("long").alias("key"), "word", F.col("total").cast("double").alias("value")))
    scored = dealt.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(
        _score(ends), f"id {dict(rows.dtypes)['id']}, train boolean, n_tokens long, n_known long, words10 double, log10 double")
    spread = math.log10(train_tokens + 0.5 * (kinds + 1))
    return scored.select(F.col("id").alias(id), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"),
                         (F.col("words10") - F.col("n_tokens") * F.lit(spread)).alias("base_score"), F.col("log10").alias("score"))
