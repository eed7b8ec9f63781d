"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits. Each bit position gets a non-zero vector of three bits; table v (of seven) keeps the positions
whose vector has an odd inner product with v. Two positions span two dimensions at most, so some v is orthogonal to the
vectors of any two differing bits: every pair within two bits agrees on all that some table keeps.

Inside a bucket pairs are not compared one by one. A row stands at its own fingerprint and at those one bit away among
the positions that the table leaves out. Rows that meet at a place are within two bits of each other, and rows within
two bits meet; each place links its rows (65 fingerprints at most) to the smallest.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import flagged, row_key, shared_table, text_of
from panelspark.llm.shingle_join import near_components, shingle_hashes
from panelspark.operators.components import connected_components

BITS, RADIUS = 64, 2
#: Shingles whose bits are added up at a time.
CHUNK = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int = RADIUS) -> list[int]:
    """One mask for each non-zero v in radius + 1 dimensions. Positions take the non-zero vectors in turn, with a stride
    that spreads the few that 64 positions can have over all of them.
    """
    n = 2 ** (radius + 1) - 1
    stride = next(s for s in range(int(n * 0.618) | 1, 2 * n + 2) if math.gcd(s, n) == 1)
    vectors = [i * stride % n + 1 for i in range(BITS)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, n + 1)]


def simhash(text: str | None, words: int, seed: int = 42) -> int:
    """The fingerprint of a text (unsigned). Bit i is set if it is in more than half of the shingles' hashes."""
    hashes = shingle_hashes(text, words, seed)
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, CHUNK):
        bits = np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | Column, words: int = 3, seed: int = 42) -> Column:
    """SimHash of a text column as a long: lower-cased in A-Z, shingles of so many words with their repeats, XXH64.
    A text of fewer words is one shingle; one without words, or null, has fingerprint zero."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, words, seed) for t in texts], dtype=np.uint64).view(np.int64))

    return run(text)


def _keyed(prints: DataFrame, masks: list[int]) -> DataFrame:
    """(fp, v, key) for each table v."""
    tables = F.inline(F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for v, m in enumerate(masks)]))
    return prints.select("fp").select("fp", tables)


def links(prints: DataFrame) -> DataFrame:
    """(a, b) for distinct ``fp``: links that join exactly those within two bits, directly or over others."""
    masks = covering_masks()
    keyed = _keyed(prints, masks)
    crowded = keyed.groupBy("v", "key").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("v", "key")
    members = keyed.join(crowded, ["v", "key"], "left_semi").select("fp", "v")
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in masks])
    places = members.select("fp", F.explode(F.get(flips, F.col("v"))).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("place"))
    met = places.groupBy("place").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    return met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b").distinct()


def near_groups(prints: DataFrame) -> DataFrame:
    """``prints`` (id, fp) with ``component_id``, the smallest id reachable over links of RADIUS bits or fewer.

    Equal fingerprints are one node, so a group of copies costs one row. Null ids are never the smallest; where all of
    a component are null, so is its id. An empty table gives no rows.
    """
    nodes = shared_table(prints.groupBy("fp").agg(F.min("id").alias("first")))
    linked = connected_components(shared_table(links(nodes)))
    roots = nodes.join(linked.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    roots = shared_table(roots)
    firsts = roots.groupBy("component").agg(F.min("first").alias("component_id"))
    return prints.join(roots.join(firsts, "component").select("fp", "component_id"), "fp")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (16 hex digits), ``component_id``. Repeated rows repeat here."""
    prints = shared_table(docs.select(F.col(id).alias("id"), fingerprint(text, words).alias("fp")))
    return near_groups(prints).select(F.col("id").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def candidates(prints: DataFrame) -> DataFrame:
    """(a, b), a the smaller, from ``prints`` (sig, fp): each sig with the first of its fingerprint, and the first ones of
    fingerprints that ``links`` joins. Linear in the rows."""
    firsts = shared_table(prints.groupBy("fp").agg(F.min("sig").alias("first")))
    same = prints.join(firsts, "fp").select(F.col("first").alias("a"), F.col("sig").alias("b"))
    first = lambda c: firsts.select(F.col("fp").alias(c), F.col("first").alias(f"_{c}"))
    close = links(firsts).join(first("a"), "a").join(first("b"), "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    return same.unionByName(close).where("a <> b").distinct()


def drop_near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5) -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their component, with all their columns.

    Texts are near when their shingle sets have a Jaccard similarity of 0.8 or more. Candidates are texts whose
    fingerprints covering masks bring within RADIUS bits, and those of ``shingle_join`` for near texts whose fingerprints
    differ in more; the whole sets decide. A null id counts as the largest; rows that repeat an id and a text stay or go together.
    Texts without words are near copies of each other; an empty table gives no rows.
    """
    row = row_key(id, text)
    ordered = F.struct(F.col(id).isNull().alias("last"), F.col(id).alias("id"), row.alias("row"))
    rows = docs.select(ordered.alias("id"), row.alias("row"), text_of(text).alias("text"))
    gone = shared_table(near_components(rows, words, fingerprint, candidates).where("id <> component_id").select(F.col("id.row").alias("row")).distinct())
    told = flagged(docs.select(F.struct("*").alias("doc"), row.alias("row")), gone, "row")
    # A left join: an anti join would be moved in front of the filter.
    left = told.where("_may").join(gone.withColumn("_gone", F.lit(True)), "row", "left").where("_gone is null")
    return told.where("not _may").select("doc.*").unionByName(left.select("doc.*"))
