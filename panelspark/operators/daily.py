"""Daily and hourly series: roll-ups, calendar spines, look-back windows, streaks.

A daily series holds one row per (station, day), so a station group is bounded by the calendar and the
per-station windows below stay small whatever the number of stations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing floats are NULL inside the engine; NaN from files is turned at the scan."""
    return df.select(*[
        F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes
    ])


def daily_means(hourly: DataFrame, values: Sequence[str], station: str = "station_id", ts: str = "ts") -> DataFrame:
    """Mean per calendar day, with null rows for days inside a station's range that have no data."""
    days = hourly.withColumn("dt", F.to_date(ts)).groupBy(station, "dt").agg(
        *[F.avg(v).alias(v) for v in values]
    )
    return calendar_complete(days, values, station)


def calendar_complete(days: DataFrame, values: Sequence[str], station: str = "station_id") -> DataFrame:
    """Fill the gaps between consecutive days of a series with null rows.

    Each row emits the missing days up to its successor: one pass, no join back to a spine.
    """
    nxt = F.lead("dt").over(W.partitionBy(station).orderBy("dt"))
    return (
        days.withColumn("_last", F.coalesce(F.date_sub(nxt, 1), F.col("dt")))
        .withColumn("_day", F.explode(F.sequence("dt", "_last", F.expr("INTERVAL 1 DAY"))))
        .select(station, F.col("_day").alias("dt"),
                *[F.when(F.col("_day") == F.col("dt"), F.col(v)).alias(v) for v in values])
    )


def calendar_spine(keys: DataFrame, daily: DataFrame, start: str = "start", end: str = "end",
                   on: str = "station_id") -> DataFrame:
    """One row per day in [start, end] per key row; missing days carry nulls."""
    spine = keys.withColumn("dt", F.explode(F.sequence(start, end, F.expr("INTERVAL 1 DAY"))))
    return spine.join(daily, [on, "dt"], "left")


def with_air_quality(weather: DataFrame, air: DataFrame | None, keys: Sequence[str] = ("station_id", "dt")) -> DataFrame:
    """Weather keeps all its days; without an air-quality table the weather passes unchanged."""
    return weather if air is None else weather.join(air, list(keys), "left")


def species_means(readings: DataFrame, keys: Sequence[str], variable: str = "variable",
                  value: str = "value") -> DataFrame:
    """Species means to PM2.5 / PM10 in micrograms; a species that is absent counts as zero."""
    # Species that make up each particulate class.
    fine = ["DUSMASS25", "BCSMASS", "OCSMASS", "SO4SMASS", "SSSMASS25"]
    coarse = ["DUSMASS", "SSSMASS", "BCSMASS", "OCSMASS", "SO4SMASS"]
    names = sorted({*fine, *coarse})
    means = readings.groupBy(*keys).agg(*[
        F.avg(F.when(F.col(variable) == n, F.nanvl(value, F.lit(None)))).alias(n) for n in names
    ])

    def total(species: list[str]) -> Column:
        acc = F.lit(0.0)
        for s in species:
            acc = acc + F.coalesce(F.col(s), F.lit(0.0))
        return acc * F.lit(1e9)

    return means.select(*keys, total(fine).alias("pm2_5"), total(coarse).alias("pm10"))


def lookback_start(as_of: Column, days: int, inclusive: bool = True) -> Column:
    """First day of the look-back; the label generators use the exclusive form (one day more)."""
    return F.date_sub(as_of, days - 1 if inclusive else days)


def year_end(year: Column) -> Column:
    return F.make_date(year, F.lit(12), F.lit(31))


def rolling(daily: DataFrame, specs: Sequence[tuple[str, int, str, str]], station: str = "station_id") -> DataFrame:
    """Rolling aggregates over the last N calendar days for every row; specs are (column, days, agg, out)."""
    known = {"sum": F.sum, "mean": F.avg, "max": F.max}
    out = []
    for column, days, agg, name in specs:
        if agg not in known:
            raise ValueError(f"unknown aggregate {agg!r}")
        w = W.partitionBy(station).orderBy(F.expr("CAST(unix_date(dt) AS BIGINT)")).rangeBetween(-(days - 1), 0)
        out.append(known[agg](column).over(w).alias(name))
    return daily.select("*", *out)


def days_in_lookback(labels: DataFrame, daily: DataFrame, days: int, inclusive: bool = True,
                     station: str = "station_id") -> DataFrame:
    """Each label row with its own daily rows in [start, as_of].

    Joined on (station, calendar year): a label meets only the one or two years its window touches, not the
    station's whole history.
    """
    start = lookback_start(F.col("as_of"), days, inclusive)
    keyed = labels.withColumn("_start", start).withColumn(
        "_year", F.explode(F.sequence(F.year("_start"), F.year("as_of")))
    )
    return (
        keyed.join(daily.withColumn("_year", F.year("dt")), [station, "_year"])
        .where(F.col("dt").between(F.col("_start"), F.col("as_of")))
        .drop("_start", "_year")
    )


def in_window(days: int, as_of: str = "as_of", dt: str = "dt") -> Column:
    return (F.col(dt) > F.date_sub(F.col(as_of), days)) & (F.col(dt) <= F.col(as_of))


def window_stats(rows: DataFrame, keys: Sequence[str], specs: Sequence[tuple[str, int, str, str]]) -> DataFrame:
    """W01 for one ``as_of`` per group: all windows of all columns in a single aggregation."""
    known = {"sum": F.sum, "mean": F.avg, "max": F.max}
    aggs = []
    for column, days, agg, name in specs:
        if agg not in known:
            raise ValueError(f"unknown aggregate {agg!r}")
        aggs.append(known[agg](F.when(in_window(days), F.col(column))).alias(name))
    return rows.groupBy(*keys).agg(*aggs)


def streaks(rows: DataFrame, keys: Sequence[str], dry_mm: float = 1.0, rain_mm: float = 5.0) -> DataFrame:
    """Trailing dry observations, and observations since the last significant rain.

    Both count non-missing observations, not calendar days. With no such rain the count is the series length.
    """
    w = W.partitionBy(*keys)
    rain = F.col("precipitation_sum")
    seen = rows.where(rain.isNotNull() & (F.col("dt") <= F.col("as_of")))
    marked = seen.select(
        *keys, "dt",
        F.max(F.when(rain >= dry_mm, F.col("dt"))).over(w).alias("_wet"),
        F.max(F.when(rain >= rain_mm, F.col("dt"))).over(w).alias("_heavy"),
    )
    after = lambda c: F.count_if(F.col(c).isNull() | (F.col("dt") > F.col(c)))
    return marked.groupBy(*keys).agg(
        after("_wet").alias("dry_day_streak"), after("_heavy").alias("days_since_rain_5mm")
    )


def longest_dry_run(forecast: DataFrame, keys: Sequence[str], day: str, rain: str, threshold: Column) -> DataFrame:
    """Last day number of the longest dry run, first run on ties, null when no day is dry."""
    w = W.partitionBy(*keys).orderBy(day)
    dry = forecast.where(F.col(rain) < threshold).withColumn("_run", F.col(day) - F.row_number().over(w))
    runs = dry.groupBy(*keys, "_run").agg(F.max(day).alias("_end"), F.count(F.lit(1)).alias("_len"))
    best = runs.groupBy(*keys).agg(F.max_by("_end", F.struct(F.col("_len"), -F.col("_end"))).alias("dry_end_day"))
    return forecast.select(*keys).distinct().join(best, list(keys), "left")
