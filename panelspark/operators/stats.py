"""Exact statistics over large tables: distribution summaries, KS, AUC, average precision, rank correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.scale import average_ranks, cumulative, exact_quantiles, pick_at, value_positions
from panelspark.session import cut_lineage


def unpivot(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), name: str = "feature",
            value: str = "value") -> DataFrame:
    return df.unpivot(list(keep), list(columns), name, value)


def score_stats(df: DataFrame, score: str) -> DataFrame:
    """Mean, p90 (linear) and maximum of the non-null scores."""
    q = exact_quantiles(df, score, {"p90": 0.9})
    return df.agg(F.avg(score).alias("mean"), F.max(score).alias("max")).crossJoin(F.broadcast(q.drop("n")))


def summarize(df: DataFrame, features: Sequence[str], part: Sequence[str] = ()) -> DataFrame:
    """N, median, quartiles, mean, population deviation per feature and part."""
    keys = [*part, "feature"]
    long = unpivot(df, features, part)
    long = long.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    moments = long.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    q = exact_quantiles(long, "value", {"median": 0.5, "p25": 0.25, "p75": 0.75}, keys)
    return moments.join(q, keys, "left").select(
        *keys, F.coalesce("n", F.lit(0)).alias("n"), "median", "p25", "p75", "mean", "std")


def ks_test(df: DataFrame, value: str, group: str, a: str, b: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance and asymptotic p-value (100 terms, clipped)."""
    both = df.where(F.col(value).isNotNull() & ~F.isnan(value) & F.col(group).isin(a, b))
    counts = cut_lineage(both.groupBy(value).agg(
        F.count_if(F.col(group) == a).alias("na"), F.count_if(F.col(group) == b).alias("nb")))
    run = cumulative(counts, value, {"ca": "na", "cb": "nb"})
    sizes = counts.agg(F.sum("na").alias("n_a"), F.sum("nb").alias("n_b"))
    d = run.crossJoin(F.broadcast(sizes)).agg(
        F.max(F.abs(F.try_divide("ca", "n_a") - F.try_divide("cb", "n_b"))).alias("d"),
        F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    n = F.nullif(F.col("n_a") * F.col("n_b"), F.lit(0)) / (F.col("n_a") + F.col("n_b"))
    lam = (F.sqrt(n) + 0.12 + 0.11 / F.sqrt(n)) * F.col("d")
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda s, j: s + F.when(j % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.exp(-2.0 * F.col("_lam") * F.col("_lam") * j * j))
    return d.withColumn("_lam", lam).withColumn(
        "p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * series))).drop("_lam")


def histograms(df: DataFrame, value: str, group: str, log: bool = False, edges: int = 50) -> DataFrame:
    """A10: counts per group over bins shared by all groups (log-spaced for areas); last bin closed on the right."""
    bins = edges - 1
    x = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    if log:
        x = x.where(F.col(value) > 0).withColumn("_v", F.ln(value))
    else:
        x = x.withColumn("_v", F.col(value).cast("double"))
    span = x.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    if log:
        span = span.withColumn("_lo", F.greatest("_lo", F.ln(F.lit(1e-3))))
    at = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    binned = x.crossJoin(F.broadcast(span)).where(F.col("_v") >= F.col("_lo")).withColumn(
        "bin", F.when(F.col("_hi") > F.col("_lo"), F.least(at, F.lit(bins - 1))).otherwise(0))
    return binned.groupBy(group, "bin").agg(F.count(F.lit(1)).alias("n"))


def _score_counts(df: DataFrame, score: str, y: str, part: Sequence[str]) -> DataFrame:
    return cut_lineage(df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(*part, score).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")))


def roc_auc(df: DataFrame, score: str, y: str, part: Sequence[str] = ()) -> DataFrame:
    """Exact ROC-AUC with ties counted half; null for a single class."""
    part = list(part)
    run = cumulative(_score_counts(df, score, y, part), score, {"c_neg": "neg"}, part)
    wins = F.sum(F.col("pos") * (F.col("c_neg") - F.col("neg") / F.lit(2.0)))
    agg = run.groupBy(*part).agg(wins.alias("_w"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    both = F.col("n_pos").cast("double") * F.col("n_neg")
    return agg.select(*part, "n_pos", "n_neg", F.when(both > 0, F.col("_w") / both).alias("auc"))


def average_precision(df: DataFrame, score: str, y: str, part: Sequence[str] = ()) -> DataFrame:
    """Sum over distinct scores of recall gain x precision."""
    part = list(part)
    counts = _score_counts(df, score, y, part).withColumn("_down", -F.col(score))
    run = cumulative(counts, "_down", {"tp": "pos", "fp": "neg"}, part)
    agg = run.groupBy(*part).agg(
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_s"), F.sum("pos").alias("n_pos"))
    return agg.select(*part, F.when(F.col("n_pos") > 0, F.col("_s") / F.col("n_pos")).alias("average_precision"))


def spearman(df: DataFrame, x: str, y: str, part: Sequence[str] = (), min_rows: int = 3) -> DataFrame:
    """Rank correlation with averaged ties (p-value not computed); null below ``min_rows``.

    Works on counts per distinct (x, y), so repeated pairs cost one row; they are written once, and both ranks read them.
    """
    part = list(part)
    pairs = cut_lineage(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*part, x, y).agg(F.count(F.lit(1)).alias("w")))
    ranked = pairs.join(average_ranks(pairs, x, "_rx", part, "w"), [*part, x]).join(
        average_ranks(pairs, y, "_ry", part, "w"), [*part, y])
    w, rx, ry = F.col("w").cast("double"), F.col("_rx"), F.col("_ry")
    sums = ranked.groupBy(*part).agg(
        F.sum(w).alias("_n"), F.sum(w * rx).alias("_x"), F.sum(w * ry).alias("_y"),
        F.sum(w * rx * ry).alias("_xy"), F.sum(w * rx * rx).alias("_xx"), F.sum(w * ry * ry).alias("_yy"))
    cov = F.col("_xy") / F.col("_n") - F.col("_x") / F.col("_n") * F.col("_y") / F.col("_n")
    var = lambda s, q: F.col(q) / F.col("_n") - (F.col(s) / F.col("_n")) * (F.col(s) / F.col("_n"))
    rho = cov / F.sqrt(var("_x", "_xx") * var("_y", "_yy"))
    ok = (F.col("_n") >= min_rows) & (var("_x", "_xx") > 0) & (var("_y", "_yy") > 0)
    return sums.select(*part, F.col("_n").cast("bigint").alias("n"), F.when(ok, rho).alias("spearman"))


def medians(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One (feature, median) row per feature; an all-null feature has median 0."""
    long = unpivot(df.select(*[F.col(c).cast("double").alias(c) for c in features]), features)
    q = exact_quantiles(long, "value", {"median": 0.5}, ["feature"]).drop("n")
    names = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return names.join(q, "feature", "left").select("feature", F.coalesce("median", F.lit(0.0)).alias("median"))


def median_map(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """The medians as a driver-side dict: one number per column, whatever the number of rows."""
    return {r["feature"]: r["median"] for r in medians(df, features).collect()}


def coverage(df: DataFrame, features: Sequence[str], by: str | None = None) -> DataFrame:
    """Share of non-null values per feature, overall and (rollup) per ``by``."""
    aggs = [(F.count(c) / F.count(F.lit(1))).alias(c) for c in features]
    wide = (df.rollup(by) if by else df.groupBy()).agg(*aggs)
    return wide.unpivot([by] if by else [], list(features), "feature", "coverage").withColumn(
        "sparse", F.col("coverage") < 0.5)


def index_pick(df: DataFrame, value: str, fraction: float, out: str, part: Sequence[str] = ()) -> DataFrame:
    """The sorted value at position int(fraction * n)."""
    at: Column = F.least(F.floor(F.lit(fraction) * F.col("total")), F.col("total") - 1)
    return value_positions(df, value, part).groupBy(*part).agg(pick_at(value, at).alias(out))
