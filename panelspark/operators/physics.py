"""Soiling recurrences. Every group is one look-back window or one station's daily series (calendar-bounded)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.config import SCORING, EquivalentDay, Kimber
from panelspark.functions.numeric import round_binary


def fill_from_median(df: DataFrame, keys: Sequence[str], column: str, out: str, default: float) -> DataFrame:
    """Missing readings take the series median; an empty series takes the default."""
    median = F.median(column).over(W.partitionBy(*keys))
    return df.withColumn(out, F.coalesce(F.col(column), median, F.lit(default)))


#: Days of a series that are folded together.
STRETCH = 64


def _kimber_days(df: DataFrame, keys: Sequence[str], params: Kimber, rest: Sequence[str] = ()) -> DataFrame:
    """Per series its days in order (``_days``, with the columns ``rest``) and the ratio of each (``_ratios``)."""
    rain = F.coalesce(F.col("precipitation_sum"), F.lit(0.0)) >= params.rain_clean_mm
    df = fill_from_median(df, keys, "pm2_5", "_pm", params.empty_series_pm25)
    loss = F.when(~rain, F.lit(params.deposition_per_pm25) * F.col("_pm"))
    # In stretches, as in ``equivalent_days``.
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dt", loss.alias("_loss"), *rest))).alias("_days")).withColumn(
        "_ratios", F.expr(f"""
        flatten(aggregate(sequence(0, cast((size(_days) - 1) div {STRETCH} as int)), CAST(array() AS ARRAY<ARRAY<DOUBLE>>),
            (done, k) -> concat(done, array(aggregate(slice(_days, k * {STRETCH} + 1, {STRETCH}),
                array(coalesce(try_element_at(try_element_at(done, -1), -1), 1D)),
                (path, x) -> concat(path, array(if(x._loss IS NULL, 1D, greatest(0D, path[size(path) - 1] - x._loss)))),
                path -> slice(path, 2, {STRETCH}))))))
    """))


def kimber_ratio(df: DataFrame, keys: Sequence[str], params: Kimber = Kimber(), out: str = "soiling_ratio") -> DataFrame:
    """Clean at rain, otherwise lose deposition x PM2.5 per day, never below zero.

    Folded day by day, not in the closed form of running sums: that rounds otherwise, and a label whose mean lies
    exactly on its threshold then falls on the other side.
    """
    rest = [c for c in df.columns if c not in {*keys, "dt", out}]
    days = _kimber_days(df, keys, params, rest).select(*keys, F.inline(F.arrays_zip("_days", "_ratios")))
    return days.select(*[F.col(c) if c in keys else F.col("_days")[c].alias(c) for c in df.columns if c != out], F.col("_ratios").alias(out))


def _daily_factor(df: DataFrame, keys: Sequence[str], p: EquivalentDay) -> DataFrame:
    if "pm10" in df.columns:
        df = fill_from_median(df, keys, "pm10", "_pm", 0.0)
    else:
        df = df.withColumn("_pm", F.lit(0.0))
    rain = F.coalesce(F.col("precipitation_sum"), F.lit(0.0))
    factor = (
        F.when(rain >= p.heavy_rain_mm, F.lit(0.0))
        .when(rain >= p.rain_min_mm,
              F.lit(1.0) - (rain - p.rain_min_mm) / F.lit(p.heavy_rain_mm - p.rain_min_mm))
        .when(F.col("_pm") > p.pm10_dust_threshold,
              F.lit(1.0) + F.lit(p.pm10_dust_scale) * (F.col("_pm") - p.pm10_dust_threshold))
        .otherwise(F.lit(1.0))
    )
    return df.withColumn("_f", factor).drop("_pm")


def soiling_loss(eqd, p: EquivalentDay):
    return F.lit(p.sl_sat) * (F.lit(1.0) - F.exp(-eqd / F.lit(p.k)))


def equivalent_days(df: DataFrame, keys: Sequence[str], params: EquivalentDay = EquivalentDay()) -> DataFrame:
    """Full trajectory (keys, dt, eqd, soiling_loss).

    A heavy-rain day sets the state to zero whatever came before, so the series splits there into independent
    segments; each segment is folded on its own. The segment grouping reuses the window's partitioning.
    """
    day = W.partitionBy(*keys).orderBy("dt").rowsBetween(W.unboundedPreceding, 0)
    marked = _daily_factor(df, keys, params).withColumn("_seg", F.count_if(F.col("_f") == 0).over(day))
    # Stretches of STRETCH days: a day is copied inside its stretch only, a stretch among the stretches only by reference,
    # so that a dry segment of decades costs as much a day as one of a month.
    folded = marked.groupBy(*keys, "_seg").agg(
        F.array_sort(F.collect_list(F.struct("dt", F.col("_f").alias("f")))).alias("_days")
    ).select(*keys, F.expr(f"""
        flatten(aggregate(sequence(0, cast((size(_days) - 1) div {STRETCH} as int)), CAST(array() AS ARRAY<ARRAY<STRUCT<dt: DATE, eqd: DOUBLE>>>),
            (done, k) -> concat(done, array(aggregate(slice(_days, k * {STRETCH} + 1, {STRETCH}),
                named_struct('eq', coalesce(try_element_at(try_element_at(done, -1), -1).eqd, 0D), 'path', CAST(array() AS ARRAY<STRUCT<dt: DATE, eqd: DOUBLE>>)),
                (s, x) -> named_struct(
                    'eq', x.f * (s.eq + 1D),
                    'path', concat(s.path, array(named_struct('dt', x.dt, 'eqd', x.f * (s.eq + 1D))))),
                s -> s.path)))))
    """).alias("_path"))
    return folded.select(*keys, F.inline("_path")).withColumn("soiling_loss", soiling_loss(F.col("eqd"), params))


def terminal_equivalent_days(df: DataFrame, keys: Sequence[str], params: EquivalentDay = EquivalentDay()) -> DataFrame:
    """Last state of each trajectory only: one fold, nothing is materialised per day."""
    rain = F.coalesce(F.col("precipitation_sum"), F.lit(0.0))
    return _daily_factor(df, keys, params).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("dt", F.col("_f").alias("f")))).alias("_days"),
        F.max(F.when(rain >= params.heavy_rain_mm, F.col("dt"))).alias("last_rain_date"),
        F.max("dt").alias("last_dt"),
    ).select(
        *keys, F.expr("aggregate(_days, 0D, (s, x) -> x.f * (s + 1D))").alias("eqd"), "last_rain_date", "last_dt"
    ).withColumn("soiling_loss", soiling_loss(F.col("eqd"), params))


def kimber_labels(rows: DataFrame, keys: Sequence[str], threshold: float = 0.97, params: Kimber = Kimber()) -> DataFrame:
    """Label from the mean of the trajectory, added up in the order of days; ``rows`` are label rows joined with their days."""
    mean = F.expr("aggregate(_ratios, 0D, (s, v) -> s + v) / size(_ratios)")
    return _kimber_days(rows, keys, params).select(*keys, mean.alias("iwsr")).withColumn(
        "label", (F.col("iwsr") < threshold).cast("int")
    )


def equivalent_day_labels(rows: DataFrame, keys: Sequence[str], threshold: float, params: EquivalentDay) -> DataFrame:
    """Label from the terminal loss."""
    ends = terminal_equivalent_days(rows, keys, params)
    return ends.select(*keys, (F.lit(1.0) - F.col("soiling_loss")).alias("iwsr")).withColumn(
        "label", (F.col("iwsr") < threshold).cast("int")
    )


def score_series(rows: DataFrame, keys: Sequence[str], params: EquivalentDay = SCORING) -> DataFrame:
    """Risk score in [0, 1], loss in percent, equivalent days, last heavy rain."""
    ends = terminal_equivalent_days(rows, keys, params)
    if params.sl_sat > 0:
        risk = F.least(F.lit(1.0), F.col("soiling_loss") / F.lit(params.sl_sat))
    else:
        risk = F.lit(0.0)
    return ends.select(
        *keys, risk.alias("risk_score"), round_binary(F.col("soiling_loss") * 100, 3).alias("soiling_loss_pct"),
        round_binary(F.col("eqd"), 1).alias("eqd"), "last_rain_date",
    )
