"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent in [0, 1], normalised. The exponent is the largest one
whose weights reach the target entropy, raised as far as the repetition limit asks. Weights become token quotas, quotas
become passes over a source's documents, each pass in a permutation of its own, cut into blocks that all hold the
sources in the target proportions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.llm.common import WORD, row_key, shared_table, text_of


@dataclass(frozen=True)
class Mix:
    #: Entropy to reach, as a part of the way from that of the sources' own shares to that of equal shares.
    entropy: float = 0.25
    #: No document is taken more often, but for the rounding up of a last part of a pass.
    repeats: float = 2.0
    #: Tokens to deal out; None: the least that takes every document of every source at least once.
    budget: int | None = None
    #: Tokens in a block.
    block: int = 1_000_000
    seed: int = 1
    #: Hash ranges a source's documents are ordered in; windows see one range at a time.
    ranges: int = 1024


#: Exponents tried in one round over the sources, and rounds: each round cuts the interval by SECTIONS.
SECTIONS, SEARCHES = 32, 6
#: Stands for a null source.
NO_SOURCE = "\x00null"


def exponent(shares: DataFrame, mix: Mix) -> float:
    """The exponent for ``shares`` (source, tokens, share). Both conditions fall or rise steadily with it, so each round
    keeps the one section in which they turn; the sources stay distributed, one row of sums comes back.
    """
    natural, n = shares.agg(F.sum(-F.col("share") * F.log("share")), F.count(F.lit(1))).first()
    if not n or n == 1:
        return 1.0
    target = natural + mix.entropy * (math.log(n) - natural)

    def search(holds) -> float:
        """The end of the interval in which ``holds`` (false below, true above) turns; 1 if it never does."""
        lo, hi = 0.0, 1.0
        for _ in range(SEARCHES):
            tried = [lo + (hi - lo) * i / SECTIONS for i in range(SECTIONS + 1)]
            first = next((i for i, x in enumerate(holds(tried)) if x), SECTIONS)
            if first == 0:
                return tried[0]
            lo, hi = tried[first - 1], tried[first]
        return hi

    def sums(tried: list[float], **of):
        """A row of sums for each exponent, in order."""
        w = F.pow("share", F.col("e"))
        return shares.select("share", F.explode(F.array(*map(F.lit, tried))).alias("e")).groupBy("e").agg(*[f(w).alias(k) for k, f in of.items()]).orderBy("e").collect()

    def low_entropy(tried: list[float]) -> list[bool]:
        return [math.log(r.z) - r.s / r.z <= target + 1e-12 for r in sums(tried, z=F.sum, s=lambda w: F.sum(w * F.log(w)))]

    def few_repeats(tried: list[float]) -> list[bool]:
        # Passes of a source go with w / share; the budget is given, or makes the smallest of them 1.
        got = sums(tried, z=F.sum, top=lambda w: F.max(w / F.col("share")), low=lambda w: F.min(w / F.col("share")))
        total = shares.agg(F.sum("tokens")).first()[0] if mix.budget else 0
        return [(r.top / r.z * mix.budget / total if mix.budget else r.top / r.low) <= mix.repeats + 1e-9 for r in got]

    return max(search(low_entropy), search(few_repeats))


def quotas(shares: DataFrame, mix: Mix) -> DataFrame:
    """(source, tokens, weight, quota): ``shares`` with weights that add up to 1 and the tokens to take."""
    alpha = round(exponent(shares, mix), 9)
    raw = shares.withColumn("raw", F.pow("share", F.lit(alpha)))
    z, low, tokens = raw.agg(F.sum("raw"), F.min(F.col("raw") / F.col("share")), F.sum("tokens")).first()
    if z is None:
        return raw.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota"))
    weight = F.col("raw") / z
    # Without a budget the smallest number of passes is one: quota = tokens * (raw / share) / low.
    quota = weight * mix.budget if mix.budget else F.greatest(F.col("raw") / F.col("share") / low, F.lit(1.0)) * F.col("tokens")
    return raw.select("source", "tokens", weight.alias("weight"), F.round(quota).cast("long").alias("quota"))


def counted(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """(doc, row, source, tokens): every row as a struct, its key, its source and its words; a null text has none."""
    return docs.select(F.struct("*").alias("doc"), row_key(*docs.columns).alias("row"),
                       F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE)).alias("source"),
                       F.regexp_count(text_of(text), F.lit(WORD)).cast("long").alias("tokens"))


def mixture(rows: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of ``counted`` that are taken, once for each time: with ``turn`` (0 for the first pass over the source),
    ``block``, ``place`` (order inside the block) and ``weight``.

    A row is taken in a pass if the source's quota isn't used up where the row starts. Rows without tokens use none of
    it and go along with the first pass. A null source is a source; equal rows are taken one by one; an empty table
    gives no rows.
    """
    counts = shared_table(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    total = counts.agg(F.sum("tokens")).first()[0] or 0
    shares = counts.where("tokens > 0").withColumn("share", F.col("tokens") / F.lit(max(total, 1)))
    wanted = shared_table(quotas(shares, mix))
    blocks = max(1, -(-(wanted.agg(F.sum("quota")).first()[0] or 0) // mix.block))
    passes = F.when((F.col("tokens") == 0) | (F.col("total") == 0), F.lit(1).cast("long")).otherwise(F.ceil(F.col("quota") / F.col("total")))
    taken = (
        rows.join(wanted.withColumnRenamed("tokens", "total"), "source", "left")
        .withColumn("total", F.coalesce("total", F.lit(0))).withColumn("quota", F.coalesce("quota", F.lit(0)))
        .withColumn("passes", passes).where("passes > 0").withColumn("turn", F.explode(F.expr("sequence(0L, passes - 1L, 1L)")))
        .withColumn("order", F.xxhash64(F.lit(mix.seed), "turn", "row"))
        .withColumn("range", F.shiftrightunsigned("order", 64 - int(math.log2(mix.ranges))))
    )
    inside = W.partitionBy("source", "turn", "range").orderBy("order", "row").rowsBetween(W.unboundedPreceding, -1)
    # The same rows without their documents: where each range of a pass starts.
    ranges = taken.groupBy("source", "turn", "range").agg(F.sum("tokens").alias("n"))
    earlier = W.partitionBy("source", "turn").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranges.select("source", "turn", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    start = F.col("turn") * F.col("total") + F.col("offset") + F.coalesce(F.col("before"), F.lit(0))
    block = F.when(F.col("quota") > 0, F.call_function("div", F.col("start") * F.lit(blocks), F.col("quota"))).otherwise(F.lit(0))
    return (
        taken.withColumn("before", F.sum("tokens").over(inside)).join(offsets, ["source", "turn", "range"])
        .withColumn("start", start).where((F.col("start") < F.col("quota")) | ((F.col("tokens") == 0) & (F.col("turn") == 0)))
        .select("doc", "row", F.when(F.col("source") != NO_SOURCE, F.col("source")).alias("source"), "tokens", "turn",
                F.least(block, F.lit(blocks - 1)).cast("long").alias("block"),
                F.xxhash64(F.lit(mix.seed), F.lit("place"), "turn", "row").alias("place"), "weight")
    )


def mixed_documents(docs: DataFrame, mix: Mix = Mix(), source: str = "source", text: str = "text") -> DataFrame:
    """The documents of the mixture with their own columns, block after block, each block permuted."""
    return (mixture(counted(docs, source, text), mix).select("doc", "block", "place", "row")
            .repartitionByRange("block", "place").sortWithinPartitions("block", "place", "row").select("doc.*"))
