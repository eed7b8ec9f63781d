"""Ranks, running sums and exact quantiles that never sort a whole group in one task.

A plain window over a group sends the group to one task. Here the group is first reduced to one row per
distinct key, cut into value ranges, and every range gets its offset from a small per-range total. Only the
totals table (ranges per group, bounded) is scanned in order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.session import cut_lineage

# The fewest value ranges per group: a square number, searched in two steps of its root.
RANGES = 256
HASH_BITS = 14


def default_ranges(df: DataFrame) -> int:
    """Four ranges for each shuffle partition, rounded up to a square, so that ranges grow with the cluster."""
    wanted = max(RANGES, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return math.ceil(math.sqrt(wanted)) ** 2


def _same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "inner") if keys else left.crossJoin(F.broadcast(right))


def range_limits(df: DataFrame, key: str, part: Sequence[str], ranges: int) -> DataFrame:
    """(part, _coarse, _limits): ascending cut points of ``key``, and every root-th of them for the first search step.

    Checkpointed, so every use sees the same ones.
    """
    root = math.isqrt(ranges)
    steps = [i / ranges for i in range(1, ranges)]
    limits = df.groupBy(*part).agg(F.percentile_approx(key, steps, ranges * 20).alias("_limits"))
    return cut_lineage(limits.withColumn("_coarse", F.filter("_limits", lambda _, i: i % root == root - 1)))


def with_ranges(df: DataFrame, key: str, part: Sequence[str], ranges: int) -> DataFrame:
    """Add ``_range``, the number of limits below the key: first among the coarse ones, then inside that block."""
    root = math.isqrt(ranges)
    below = lambda a: F.size(F.filter(a, lambda b: b < F.col(key)))
    joined = _same_keys(df, range_limits(df, key, part, ranges), part)
    first = joined.select(*df.columns, below(F.col("_coarse")).alias("_c"), "_limits")
    block = F.slice("_limits", F.col("_c") * root + 1, F.lit(root - 1))
    return first.select(*df.columns, (F.col("_c") * root + below(block)).alias("_range"))


def cumulative(distinct: DataFrame, key: str, sums: dict[str, str], part: Sequence[str] = (),
               ranges: int | None = None) -> DataFrame:
    """Add inclusive running sums ``{out: column}`` in ascending ``key`` order inside each ``part``.

    ``distinct`` holds one row per (part, key). The range limits come from an approximate percentile and are
    checkpointed, so both uses below see the same limits even after a lost executor.
    """
    part = list(part)
    ranged = with_ranges(distinct, key, part, ranges or default_ranges(distinct))
    totals = ranged.groupBy(*part, "_range").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    before = W.partitionBy(*(part or [F.lit(0)])).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *part, "_range", *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums]
    )
    inside = W.partitionBy(*part, "_range").orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    return ranged.join(offsets, [*part, "_range"]).select(
        *distinct.columns,
        *[(F.sum(c).over(inside) + F.col(f"_o_{o}")).alias(o) for o, c in sums.items()],
    )


def value_positions(df: DataFrame, value: str, part: Sequence[str] = (), times: str | None = None) -> DataFrame:
    """One row per distinct value: ``n`` copies occupying sorted positions ``[lo, hi)`` of ``total``. A row stands for
    ``times`` copies if that is given.

    Counts are written once: limits, range totals, positions and the total all read them.
    """
    part = list(part)
    n = F.sum(times) if times else F.count(F.lit(1))
    counts = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(*part, value).agg(n.alias("n")))
    placed = cumulative(counts, value, {"hi": "n"}, part).withColumn("lo", F.col("hi") - F.col("n"))
    totals = counts.groupBy(*part).agg(F.sum("n").alias("total"))
    return _same_keys(placed, totals, part)


def pick_at(value: str, position: Column) -> Column:
    """Aggregate over ``value_positions`` rows: the value at a zero-based sorted position."""
    return F.max(F.when((F.col("lo") <= position) & (position < F.col("hi")), F.col(value)))


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], part: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated quantiles ``{out: p}`` per part, plus the non-null count ``n``."""
    placed = value_positions(df, value, part)
    picks = []
    for out, p in probs.items():
        at = F.lit(p) * (F.col("total") - 1)
        picks += [pick_at(value, F.floor(at)).alias(f"_a_{out}"), pick_at(value, F.ceil(at)).alias(f"_b_{out}")]
    got = placed.groupBy(*part).agg(F.max("total").alias("n"), *picks)
    out_cols = []
    for out, p in probs.items():
        at = F.lit(p) * (F.col("n") - 1)
        low = F.col(f"_a_{out}")
        out_cols.append((low + (F.col(f"_b_{out}") - low) * (at - F.floor(at))).alias(out))
    return got.select(*part, "n", *out_cols)


def average_ranks(df: DataFrame, value: str, rank: str, part: Sequence[str] = (), times: str | None = None) -> DataFrame:
    """One row per distinct value with its tie-averaged one-based rank."""
    return value_positions(df, value, part, times).select(
        *part, value, (F.col("lo") + (F.col("n") + 1) / F.lit(2.0)).alias(rank)
    )


def hash_positions(df: DataFrame, key: str, seed: int, out: str = "pos", part: Sequence[str] = ()) -> DataFrame:
    """Zero-based position in a fixed pseudo-random order of ``key``, and the group ``total``.

    The order is by a seeded hash, so the top hash bits are balanced ranges by construction.
    """
    part = list(part)
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key))).withColumn(
        "_range", F.shiftright("_h", 64 - HASH_BITS)
    )
    totals = hashed.groupBy(*part, "_range").agg(F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy(*(part or [F.lit(0)]))
    before = whole.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *part, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"),
        F.sum("_n").over(whole).alias("total"),
    )
    inside = W.partitionBy(*part, "_range").orderBy("_h", key)
    return hashed.join(offsets, [*part, "_range"]).select(
        *df.columns, (F.row_number().over(inside) - 1 + F.col("_o")).alias(out), "total"
    )


def sequential_ids(df: DataFrame, key: str, out: str, start: int = 0) -> DataFrame:
    """Dense ids in ascending order of a unique key (no single-task sort)."""
    ones = df.select(key).withColumn("_one", F.lit(1).cast("long"))
    ids = cumulative(ones, key, {out: "_one"}).select(key, (F.col(out) - 1 + start).alias(out))
    return df.join(ids, key)
