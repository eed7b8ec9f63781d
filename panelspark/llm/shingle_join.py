"""Texts whose sets of word shingles have a Jaccard similarity of NUM / DEN or more.

Fingerprints propose candidates, and so do bands of min-hashes: BANDS short rows a text, so that two texts at the limit miss each other about once
in 2,800 cases. Every candidate is verified on the whole sets. Before that a sketch of both sets, the parity of how many
shingles fall into each of SKETCH places, rules out pairs that differ in too much; it never rules out a near pair.

A crowd that shares a band is first compared with one member each, that which meets most texts; after that only members
that the links found so far leave in different components are compared.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import free, shared_table, sifted
from panelspark.operators.components import connected_components

#: Sets are near at this similarity.
NUM, DEN = 4, 5
#: Bands, and min-hashes in each.
BANDS, ROWS = 20, 5
#: Places of the sketch; shingles hashed at a time.
SKETCH, CHUNK = 256, 4096
#: Candidates of one text are verified in so many parts.
SALTS = 64


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of a text's shingles with their repeats: lower-cased in A-Z, of so many words; a text of fewer is one
    shingle, and one without words has none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    cut = zip(starts[:n].tolist(), ends[-n:].tolist())
    hash_ = xxhash.xxh64_intdigest
    return np.fromiter((hash_(joined[a:b], seed) for a, b in cut), dtype="<u8", count=n)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words).view(np.int64))


def _sets(text: str, words: int) -> Column:
    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, words) for t in texts])

    return run(text)


def _factors() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands that turn one hash into BANDS * ROWS others."""
    drawn = np.random.default_rng(11).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
    return drawn[0] * np.uint64(2) + np.uint64(1), drawn[1]


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band of a set's min-hashes (a set of no shingles has none)."""
    if not len(shingles):
        return np.zeros(0, dtype=np.int64)
    times, plus = _factors()
    values, least = shingles.view(np.uint64), np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(values), CHUNK):
        mixed = values[None, i : i + CHUNK] * times[:, None] + plus[:, None]
        # The low bits of a product follow from the low bits of its factors; the high ones from all.
        np.minimum(least, (mixed ^ mixed >> np.uint64(32)).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))], dtype=np.uint64).view(np.int64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """SKETCH bits: whether an odd number of the shingles falls into each place."""
    places = (shingles.view(np.uint64) >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=SKETCH) & 1).astype(np.uint8)).view(np.int64)


def _prints(text: str, words: int) -> Column:
    """(sig, n, sketch, bands) of a text's set; sig names it by 128 bits."""

    @F.pandas_udf("sig binary, n int, sketch array<long>, bands array<long>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [(xxhash.xxh3_128_digest(s.tobytes()), len(s), sketch(s), band_keys(s)) for s in (shingle_set(t, words) for t in texts)]
        return pd.DataFrame(rows, columns=["sig", "n", "sketch", "bands"]).astype({"n": np.int32})

    return run(text)


def _may_be_near(a: str, b: str) -> Column:
    """Whether sizes and sketches leave room for enough common shingles: as sets differ in at least as many shingles as
    their sketches do in places."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(SKETCH // 64)])
    return (F.least(na, nb) * DEN >= F.greatest(na, nb) * NUM) & (apart * (NUM + DEN) <= (na + nb) * (DEN - NUM))


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b")).where("a <> b").distinct()


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The pairs whose whole sets are near. Only texts that stand in pairs move."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    wanted = shared_table(nodes.join(asked, "sig", "left_semi").select("sig", F.col("first.row").alias("row")))
    texts = sifted(docs, wanted.select("row"), "row").join(wanted, "row").dropDuplicates(["row"])
    sets = shared_table(texts.select("sig", _sets("text", words).alias("set")))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    left = salted.select("a", "salt").distinct().join(sets.select(F.col("sig").alias("a"), F.col("set").alias("sa")), "a")
    both = salted.join(sets.select(F.col("sig").alias("b"), F.col("set").alias("sb")), "b").join(left, ["a", "salt"])
    common = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("n"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    found = shared_table(common.where(F.col("both") * (NUM + DEN) >= F.col("n") * NUM).select("a", "b"))
    free(wanted, sets)
    return found


def near_components(docs: DataFrame, words: int, fingerprint: Callable[[str, int], Column], candidates: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """From ``docs`` (id, row, text), id a struct that holds row: (id, ``component_id``), the smallest id reachable over
    near pairs. Texts of the same set, also those without words, are one node. An empty table gives no rows.

    ``candidates`` makes pairs (a, b) out of (sig, fp), the nodes and their ``fingerprint``; the bands add those that
    fingerprints lie too far apart for. All are verified on the whole sets.
    """
    prints = shared_table(docs.withColumn("p", _prints("text", words)).withColumn("fp", fingerprint("text", words)).select("id", "p.*", "fp"))
    nodes = shared_table(prints.groupBy("sig").agg(F.min("id").alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"), F.min("fp").alias("fp")))
    postings = nodes.select("sig", F.explode("bands").alias("key"))
    crowds = postings.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    met = shared_table(postings.join(crowds, "key"))
    meets = met.groupBy("sig").agg(F.sum("c").alias("meets")).join(nodes.select("sig", "n", "sketch"), "sig")
    met = met.join(meets, "sig").select("key", F.struct("sig", "n", "sketch").alias("x"), "meets")
    centres = met.groupBy("key").agg(F.max_by("x", F.struct("meets", F.col("x.sig"))).alias("y"))
    close = candidates(nodes.select("sig", "fp"))
    pairs = shared_table(_pairs(met.join(centres, "key").where(_may_be_near("x", "y"))).unionByName(close).distinct())
    links = _verified(pairs, nodes, docs, words)
    found = shared_table(connected_components(links).withColumnRenamed("id", "sig"))
    labelled = met.join(found, F.col("x.sig") == F.col("sig"), "left").select("key", "x", F.coalesce("component", "x.sig").alias("component"), "meets")
    mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max_by("component", F.struct("meets", "x.sig")).alias("main")).where("low <> high")
    split = shared_table(labelled.join(mixed.select("key", "main"), "key").select("key", "x", "component", "main"))
    other = split.select("key", F.col("x").alias("y"), F.col("component").alias("own"))
    # Those outside the bucket's main component meet all others; of two outside it, the pair is built once.
    apart = split.where("component <> main").join(other, "key").where("component <> own and (own = main or x.sig < y.sig)")
    rest = shared_table(_pairs(apart.where(_may_be_near("x", "y"))).join(pairs, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        more = _verified(rest, nodes, docs, words)
        if not more.isEmpty():
            found = shared_table(connected_components(links.unionByName(more)).withColumnRenamed("id", "sig"))
    roots = shared_table(nodes.select("sig", "first").join(found, "sig", "left").withColumn("component", F.coalesce("component", "sig")))
    firsts = roots.groupBy("component").agg(F.min("first").alias("component_id"))
    free(nodes, pairs, split, rest)
    return prints.select("id", "sig").join(roots.join(firsts, "component").select("sig", "component_id"), "sig").select("id", "component_id")
