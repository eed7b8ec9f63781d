"""Cleaning decisions for many areas of interest at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.config import Recommend
from panelspark.functions.numeric import round_binary
from panelspark.operators.daily import longest_dry_run
from panelspark.operators.scale import pick_at, value_positions


def risk_bucket(risk: Column) -> Column:
    """Confidence name of a risk."""
    return F.when(risk < 0.50, "low").when(risk < 0.75, "medium").otherwise("high")


def recovery_range(risk: Column) -> Column:
    """Expected recovery in percent, [low, high]."""
    pair = lambda a, b: F.array(F.lit(a), F.lit(b))
    return F.when(risk < 0.50, pair(2.0, 5.0)).when(risk < 0.75, pair(5.0, 12.0)).otherwise(pair(10.0, 20.0))


def area_risk(scores: DataFrame, area: str = "aoi_id", score: str = "risk_score") -> DataFrame:
    """The score at sorted position min(n-1, int(0.9 n)) of each area, 0 when it has none.

    Scores are counted per distinct value before anything is ordered, so one area may hold most of the arrays.
    """
    clean = scores.withColumn(score, F.when(~F.isnan(score), F.col(score)))
    at = F.least(F.col("total") - 1, F.floor(F.lit(0.9) * F.col("total")))
    picked = value_positions(clean, score, [area]).groupBy(area).agg(pick_at(score, at).alias("aoi_risk"))
    sizes = scores.groupBy(area).agg(F.count(F.lit(1)).alias("n_arrays"))
    return sizes.join(picked, area, "left").select(area, "n_arrays", F.coalesce("aoi_risk", F.lit(0.0)).alias("aoi_risk"))


def recommend_areas(scores: DataFrame, forecast: DataFrame, areas: DataFrame, today: Column,
                    cfg: Recommend = Recommend()) -> DataFrame:
    """One decision per area, with risk 0 where it has no arrays. ``areas`` has (aoi_id, last_cleaned); ``forecast`` one row per (aoi_id, day_no)."""
    rain = forecast.where(F.col("day_no") < cfg.forecast_days)
    dry = longest_dry_run(rain, ["aoi_id"], "day_no", "rain_mm", F.lit(cfg.rain_mm_threshold / max(cfg.forecast_days, 1)))
    total = rain.groupBy("aoi_id").agg(F.sum("rain_mm").alias("total_rain_mm"))
    base = (
        areas.join(area_risk(scores), "aoi_id", "left").join(total, "aoi_id", "left").join(dry, "aoi_id", "left")
        .withColumn("today", today)
        .withColumn("days_since_clean", F.datediff("today", "last_cleaned"))
        .withColumn("total_rain_mm", F.coalesce("total_rain_mm", F.lit(0.0)))
        .withColumn("aoi_risk", F.coalesce("aoi_risk", F.lit(0.0))).withColumn("n_arrays", F.coalesce("n_arrays", F.lit(0)))
    )
    rule = (
        F.when(F.col("aoi_risk") < cfg.risk_threshold, "below_risk_threshold")
        .when(F.col("days_since_clean") < cfg.min_days_since_clean, "below_age_threshold")
        .when(F.col("total_rain_mm") >= cfg.rain_mm_threshold, "deferred_due_to_rain")
        .otherwise("weather_window_open")
    )
    is_open = F.col("rule_fired") == "weather_window_open"
    first = F.date_add("today", 1)
    dry_end = F.date_add("today", F.col("dry_end_day").cast("int"))
    return base.withColumn("rule_fired", rule).select(
        "aoi_id", "rule_fired",
        F.when(is_open, first).alias("window_start"),
        F.when(is_open, F.when(dry_end > first, dry_end).otherwise(F.date_add("today", cfg.forecast_days))).alias("window_end"),
        risk_bucket(F.col("aoi_risk")).alias("confidence"),
        recovery_range(F.col("aoi_risk")).alias("expected_recovery_pct"),
        "aoi_risk", "n_arrays", "days_since_clean", "total_rain_mm", "last_cleaned", "today",
    )


def recommend_arrays(scores: DataFrame, decisions: DataFrame, cfg: Recommend = Recommend()) -> DataFrame:
    """Each array gated by its area's window and its own score. The area table is joined by size (AQE)."""
    score = F.coalesce(F.col("risk_score"), F.lit(0.0))
    act = F.col("window_start").isNotNull() & (F.col("rule_fired") == "weather_window_open") & (
        F.col("_score") >= cfg.risk_threshold)
    joined = scores.join(decisions.select("aoi_id", "rule_fired", "window_start", "window_end"), "aoi_id", "left")
    joined = joined.withColumn("_score", score)
    window = F.format_string("%s → %s", F.col("window_start").cast("string"), F.col("window_end").cast("string"))
    return joined.select(
        "aoi_id", "array_id", round_binary(F.col("_score"), 3).alias("risk_score"),
        F.when(act, window).alias("cleaning_window"),
        F.when(act, F.when(F.col("_score") >= 0.75, "high").otherwise("medium"))
        .when(F.col("_score") < 0.5, "low").otherwise("medium").alias("priority"),
        F.when(act, "clean").otherwise("monitor").alias("action"),
        F.when(act, recovery_range(F.col("_score"))).alias("expected_recovery_pct"),
    )


def ordered(recommendations: DataFrame) -> DataFrame:
    """Arrays to clean first, then by falling score."""
    return recommendations.orderBy(F.col("action") != "clean", F.desc("risk_score"), "array_id")


def actionable(recommendations: DataFrame, *keys: str) -> DataFrame:
    """How many arrays are to be cleaned, of how many."""
    return recommendations.groupBy(*keys).agg(
        F.count_if(F.col("action") == "clean").alias("n_clean"), F.count(F.lit(1)).alias("n_total"))


def with_recommendations(arrays: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Arrays with their recommendation, an em dash where there is none."""
    rec = recommendations.select("array_id", "priority", "action", "cleaning_window")
    out = arrays.join(rec, "array_id", "left")
    for c in ("priority", "action", "cleaning_window"):
        out = out.withColumn(c, F.coalesce(c, F.lit("—")))
    return out
