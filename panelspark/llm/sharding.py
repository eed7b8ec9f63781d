"""Sharding by a keyed permutation of global row numbers.

Rows get gapless numbers in an order that depends on their values only. A Feistel network over two mixed-radix halves
permutes 0..a*b-1 with a*b just over the row count; numbers that land beyond the count walk on along their cycle. Shard
and slot follow from the permuted number by division, so both can be computed for any row without looking at others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.llm.common import shared_table

ROUNDS = 8
#: Steps of a cycle walk. A step stays outside with a chance of about 1/sqrt(rows); a walk that were longer raises.
STEPS = 64
#: Hash ranges that rows are numbered in; windows see one range at a time.
BUCKETS = 4096
#: Repeated rows are expanded in pieces of so many.
PIECE = 10_000


def halves(n: int) -> tuple[int, int]:
    """Radices a and b with a*b >= n and a*b - n < a."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def _div(x: Column, by: int) -> Column:
    return F.call_function("div", x, F.lit(by)).cast("long")


def feistel(number: Column, n: int, seed: int, rounds: int = ROUNDS) -> Column:
    """One pass of the network over 0..a*b-1."""
    a, b = halves(n)
    pair = F.struct(_div(number, b).alias("l"), F.pmod(number, F.lit(b)).cast("long").alias("r"))

    def turn(p: Column, i: Column) -> Column:
        mixed = F.xxhash64(F.lit(seed), i, F.when(i % 2 == 0, p["r"]).otherwise(p["l"]))
        return F.when(i % 2 == 0, F.struct(F.pmod(p["l"] + F.pmod(mixed, F.lit(a)), F.lit(a)).cast("long").alias("l"), p["r"].alias("r"))).otherwise(
            F.struct(p["l"].alias("l"), F.pmod(p["r"] + F.pmod(mixed, F.lit(b)), F.lit(b)).cast("long").alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), pair, turn, lambda p: p["l"] * F.lit(b) + p["r"])


def permuted(number: Column, n: int, seed: int) -> Column:
    """The place of row ``number`` of ``n`` after the shuffle named by ``seed``: a bijection of 0..n-1."""
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), feistel(number, n, seed), lambda x, i: F.when(x < n, x).otherwise(feistel(x, n, seed)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))


def row_numbers(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``df`` with ``row_number``, gapless from 0, the same for the same set of rows however they are partitioned.

    Order: hash range of the whole row, then its columns. Equal rows are counted before they are numbered, so that
    a row which repeats many times does not fill one window, and take consecutive numbers.
    """
    columns = df.columns
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies")).withColumn(
        "_bucket", F.pmod(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in columns]), F.lit(buckets)).cast("int"))
    counted = shared_table(counted)
    offsets = counted.groupBy("_bucket").agg(F.sum("_copies").alias("_rows")).withColumn(
        "_offset", F.coalesce(F.sum("_rows").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = W.partitionBy("_bucket").orderBy(*columns).rowsBetween(W.unboundedPreceding, -1)
    numbered = counted.withColumn("_before", F.coalesce(F.sum("_copies").over(inside), F.lit(0))).join(offsets.select("_bucket", "_offset"), "_bucket")
    first = F.col("_offset") + F.col("_before")
    pieces = numbered.select(*columns, first.alias("_first"), "_copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(PIECE).cast("long"))).alias("_from"))
    last = F.least(F.col("_copies"), F.col("_from") + PIECE) - 1
    return pieces.select(*columns, "_first", F.explode(F.sequence(F.col("_from"), last)).alias("_nth")).select(*columns, (F.col("_first") + F.col("_nth")).alias("row_number"))


def shard(df: DataFrame, shards: int = 24, seed: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``df`` with ``row_number``, ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in each shard).

    Shard sizes differ by one row at most. Rows are compared by all their columns; nulls are values like others,
    repeated rows each get a slot, an empty table gives no rows. Columns named like the new ones are replaced.
    """
    df = df.drop("row_number", "shard", "slot")
    numbered = row_numbers(df, buckets)
    n = df.count()
    place = permuted(F.col("row_number"), n, seed)
    placed = numbered.withColumn("_place", place)
    return placed.select(*df.columns, "row_number", F.pmod("_place", F.lit(shards)).cast("int").alias("shard"),
                         _div(F.col("_place"), shards).alias("slot"))
