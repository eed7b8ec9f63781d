"""Queries: daily series, look-back windows, recurrences."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.config import SCORING, EquivalentDay, Features
from panelspark.operators import daily as D
from panelspark.operators import features as X
from panelspark.operators import physics as P
from panelspark.plans.fixtures import FIXTURES
from panelspark.plans.registry import query
from panelspark.session import dealt

LABELS_SQL = "SELECT station_id, year, MAKE_DATE(year, 12, 31) AS as_of FROM f_panel"
# A fixed day inside the data range for single-date look-backs.
AS_OF = "2000-06-30"


def labels(t):
    return t.f_panel.select("station_id", "year", D.year_end(F.col("year")).alias("as_of"))


def label_days(t, days=365, inclusive=True):
    return D.days_in_lookback(labels(t), t.f_daily, days, inclusive)


def station_days(t, days, inclusive=True):
    at = t.f_station.select("station_id", F.to_date(F.lit(AS_OF)).alias("as_of"))
    return D.days_in_lookback(at, t.f_daily, days, inclusive)


@query("a01_hourly_to_daily", """
    WITH d AS (SELECT station_id, CAST(ts AS DATE) AS dt, AVG(pm2_5) AS pm2_5, AVG(pm10) AS pm10
               FROM f_hourly GROUP BY 1, 2),
         r AS (SELECT station_id, MIN(dt) AS a, MAX(dt) AS b FROM d GROUP BY 1),
         s AS (SELECT station_id, CAST(UNNEST(GENERATE_SERIES(a, b, INTERVAL 1 DAY)) AS DATE) AS dt FROM r)
    SELECT s.station_id, s.dt, d.pm2_5, d.pm10 FROM s LEFT JOIN d USING (station_id, dt)""", "pm2_5, pm10")
def a01(t):
    return D.daily_means(t.f_hourly.withColumn("ts", F.col("ts").cast("timestamp")), ["pm2_5", "pm10"])


SPECIES_SQL = """SELECT l_suppkey AS station_id, CAST(l_shipdate AS DATE) AS dt,
    CASE l_linenumber WHEN 1 THEN 'DUSMASS25' WHEN 2 THEN 'BCSMASS' WHEN 3 THEN 'OCSMASS' WHEN 4 THEN 'SO4SMASS'
         WHEN 5 THEN 'SSSMASS25' WHEN 6 THEN 'DUSMASS' ELSE 'SSSMASS' END AS variable,
    l_quantity / 1e9 AS value FROM lineitem"""


@query("a02_species_means", f"""
    WITH s AS ({SPECIES_SQL}), m AS (SELECT station_id, dt, variable, AVG(value) AS v FROM s GROUP BY 1, 2, 3)
    SELECT station_id, dt,
      SUM(CASE WHEN variable IN ('DUSMASS25','BCSMASS','OCSMASS','SO4SMASS','SSSMASS25') THEN v ELSE 0 END) * 1e9 AS pm2_5,
      SUM(CASE WHEN variable IN ('DUSMASS','SSSMASS','BCSMASS','OCSMASS','SO4SMASS') THEN v ELSE 0 END) * 1e9 AS pm10
    FROM m GROUP BY 1, 2""", "pm2_5, pm10")
def a02(t):
    return D.species_means(t.sql(SPECIES_SQL), ["station_id", "dt"])


@query("a36_calendar_spine", """
    WITH r AS (SELECT station_id, MIN(dt) AS a, MAX(dt) AS b FROM f_daily GROUP BY 1),
         s AS (SELECT station_id, CAST(UNNEST(GENERATE_SERIES(a, b, INTERVAL 1 DAY)) AS DATE) AS dt FROM r)
    SELECT s.station_id, s.dt, d.precipitation_sum, d.pm2_5 FROM s LEFT JOIN f_daily d USING (station_id, dt)""",
       "precipitation_sum, pm2_5")
def a36(t):
    daily = t.f_daily.select("station_id", "dt", "precipitation_sum", "pm2_5")
    keys = daily.groupBy("station_id").agg(F.min("dt").alias("start"), F.max("dt").alias("end"))
    return D.calendar_spine(keys, daily).drop("start", "end")


@query("j01_weather_with_air_quality", """
    WITH aq AS (SELECT station_id, dt, pm2_5 AS aq_pm2_5 FROM f_daily WHERE EXTRACT(YEAR FROM dt) >= 1996)
    SELECT w.station_id, w.dt, w.precipitation_sum, aq.aq_pm2_5
    FROM f_daily w LEFT JOIN aq USING (station_id, dt)""",
       "precipitation_sum, aq_pm2_5")
def j01(t):
    # Dealt before the days are made, so that a task makes and joins few of them.
    lines = dealt(t.lineitem, t.lineitem.count(), "l_suppkey", F.col("l_shipdate").cast("date"))
    daily = t.sql(FIXTURES["f_daily"], lineitem=lines)
    weather = daily.select("station_id", "dt", "precipitation_sum")
    air = daily.where(F.year("dt") >= 1996).select("station_id", "dt", F.col("pm2_5").alias("aq_pm2_5"))
    return D.with_air_quality(weather, air)


@query("j22_days_in_lookback", f"""
    SELECT l.station_id, l.year, COUNT(*) AS n_days, MIN(d.dt) AS first_dt, MAX(d.dt) AS last_dt
    FROM ({LABELS_SQL}) l JOIN f_daily d ON d.station_id = l.station_id AND d.dt BETWEEN l.as_of - 399 AND l.as_of
    GROUP BY 1, 2""")
def j22(t):
    return label_days(t, 400).groupBy("station_id", "year").agg(
        F.count(F.lit(1)).alias("n_days"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))


@query("p04_binary_label", "SELECT station_id, year, CAST(iwsr < 0.95 AS INT) AS label FROM f_panel")
def p04(t):
    return t.f_panel.select("station_id", "year", (F.col("iwsr") < 0.95).cast("int").alias("label"))


@query("p05_lookback_bounds", f"""
    SELECT station_id, year, as_of, as_of - 364 AS start_inclusive, as_of - 365 AS start_exclusive FROM ({LABELS_SQL}) l""")
def p05(t):
    return labels(t).select("*", D.lookback_start(F.col("as_of"), 365).alias("start_inclusive"),
                            D.lookback_start(F.col("as_of"), 365, inclusive=False).alias("start_exclusive"))


@query("w01_rolling_calendar_windows", """
    SELECT station_id, dt,
      SUM(precipitation_sum) OVER (PARTITION BY station_id ORDER BY dt RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS rain_7d,
      AVG(pm2_5) OVER (PARTITION BY station_id ORDER BY dt RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW) AS pm2_5_30d,
      MAX(wind_speed_10m_max) OVER (PARTITION BY station_id ORDER BY dt RANGE BETWEEN INTERVAL 89 DAY PRECEDING AND CURRENT ROW) AS wind_90d
    FROM f_daily""", "rain_7d, pm2_5_30d, wind_90d")
def w01(t):
    return D.rolling(t.f_daily, [("precipitation_sum", 7, "sum", "rain_7d"), ("pm2_5", 30, "mean", "pm2_5_30d"),
                                 ("wind_speed_10m_max", 90, "max", "wind_90d")]).select(
        "station_id", "dt", "rain_7d", "pm2_5_30d", "wind_90d")


def _window_cols(specs):
    return ",\n".join(
        f"{agg}(CASE WHEN d.dt > l.as_of - {w} THEN d.{c} END) AS {out}" for c, w, agg, out in specs)


W02_SPECS = [("precipitation_sum", w, "SUM", f"precip_{w}d_mm") for w in (7, 30, 90)] + [
    (c, w, "AVG", f"{c}_{w}d_mean") for c in ("wind_speed_10m_max", "pm2_5", "pm10") for w in (7, 30, 90)]
W02_NAMES = ", ".join(s[3] for s in W02_SPECS)


@query("w02_feature_windows", f"""
    SELECT l.station_id, l.as_of, {_window_cols(W02_SPECS)}
    FROM ({LABELS_SQL}) l JOIN f_daily d ON d.station_id = l.station_id AND d.dt BETWEEN l.as_of - 364 AND l.as_of
    GROUP BY 1, 2""", W02_NAMES)
def w02(t):
    rows = label_days(t)
    return D.window_stats(rows, ["station_id", "as_of"], X.window_specs(rows.columns, Features()))


STREAK_SQL = """SELECT l.station_id, l.as_of, d.dt, d.precipitation_sum AS p,
    ROW_NUMBER() OVER (PARTITION BY l.station_id, l.as_of ORDER BY d.dt DESC) - 1 AS back
  FROM (SELECT station_id, DATE '2000-06-30' AS as_of FROM f_station) l
  JOIN f_daily d ON d.station_id = l.station_id AND d.dt BETWEEN l.as_of - 364 AND l.as_of
  WHERE d.precipitation_sum IS NOT NULL"""


def _streak(name, op, mm):
    return (f"WITH s AS ({STREAK_SQL}) SELECT station_id, as_of, "
            f"CAST(COALESCE(MIN(CASE WHEN p >= {mm} THEN back END), COUNT(*)) AS BIGINT) AS {name} FROM s GROUP BY 1, 2")


@query("w03_dry_day_streak", _streak("dry_day_streak", ">=", 1))
def w03(t):
    return D.streaks(station_days(t, 365), ["station_id", "as_of"]).drop("days_since_rain_5mm")


@query("w04_days_since_significant_rain", _streak("days_since_rain_5mm", ">=", 5))
def w04(t):
    return D.streaks(station_days(t, 365), ["station_id", "as_of"]).drop("dry_day_streak")


def kimber_sql(source: str, keys: str) -> str:
    """Day-by-day recursion over (keys, dt, p, pm); the oracle follows the definition, not the closed form."""
    on = " AND ".join(f"s.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    cols = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    return f"""WITH RECURSIVE s AS MATERIALIZED (
        SELECT {keys}, dt, COALESCE(p, 0) AS p,
          COALESCE(pm, MEDIAN(pm) OVER (PARTITION BY {keys}), 10e0) AS pm,
          ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY dt) AS rn FROM ({source}) x),
      r AS (SELECT {keys}, dt, rn, CASE WHEN p >= 1 THEN 1e0 ELSE GREATEST(0e0, 1e0 - 6e-4 * pm) END AS v FROM s WHERE rn = 1
        UNION ALL SELECT {cols}, s.dt, s.rn, CASE WHEN s.p >= 1 THEN 1e0 ELSE GREATEST(0e0, r.v - 6e-4 * s.pm) END
        FROM r JOIN s ON {on} AND s.rn = r.rn + 1)"""


def eqd_sql(source: str, keys: str) -> str:
    on = " AND ".join(f"s.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    cols = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    return f"""WITH RECURSIVE m AS (
        SELECT {keys}, dt, COALESCE(p, 0) AS p, COALESCE(pm, MEDIAN(pm) OVER (PARTITION BY {keys}), 0e0) AS pm,
          ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY dt) AS rn FROM ({source}) x),
      s AS MATERIALIZED (SELECT {keys}, dt, p, rn, CASE WHEN p >= 10 THEN 0e0 WHEN p >= 1 THEN 1e0 - (p - 1) / 9e0
          WHEN pm > 50 THEN 1e0 + 2e-2 * (pm - 50) ELSE 1e0 END AS f FROM m),
      r AS (SELECT {keys}, dt, rn, f * 1e0 AS eqd FROM s WHERE rn = 1
        UNION ALL SELECT {cols}, s.dt, s.rn, s.f * (r.eqd + 1e0) FROM r JOIN s ON {on} AND s.rn = r.rn + 1)"""


WHOLE = "SELECT station_id, dt, precipitation_sum AS p, {pm} AS pm FROM f_daily"
LOOK = """SELECT l.station_id, l.as_of, d.dt, d.precipitation_sum AS p, d.{pm} AS pm FROM ({labels}) l
  JOIN f_daily d ON d.station_id = l.station_id AND d.dt BETWEEN l.as_of - {back} AND l.as_of"""
AT_SQL = "SELECT station_id, DATE '2000-06-30' AS as_of FROM f_station"


def look(pm, back, labels_sql=LABELS_SQL):
    return LOOK.format(pm=pm, back=back, labels=labels_sql)


@query("w05_kimber_trajectory",
       kimber_sql(WHOLE.format(pm="pm2_5"), "station_id") + " SELECT station_id, dt, v AS soiling_ratio FROM r",
       "soiling_ratio")
def w05(t):
    daily = t.f_daily.select("station_id", "dt", "precipitation_sum", "pm2_5")
    return P.kimber_ratio(daily, ["station_id"]).select("station_id", "dt", "soiling_ratio")


@query("w06_equivalent_day_trajectory",
       eqd_sql(WHOLE.format(pm="pm10"), "station_id")
       + " SELECT station_id, dt, eqd, 25e-2 * (1e0 - EXP(-eqd / 30e0)) AS soiling_loss FROM r", "eqd, soiling_loss")
def w06(t):
    return P.equivalent_days(t.f_daily, ["station_id"])


@query("w07_kimber_labels",
       kimber_sql(look("pm2_5", 180, AT_SQL), "station_id, as_of")
       + " SELECT station_id, as_of, AVG(v) AS iwsr, CAST(AVG(v) < 0.97 AS INT) AS label FROM r GROUP BY 1, 2", "iwsr", digits=9)
def w07(t):
    return P.kimber_labels(station_days(t, 180, inclusive=False), ["station_id", "as_of"])


@query("w08_equivalent_day_panel_labels",
       eqd_sql(look("pm10", 364), "station_id, as_of")
       + """, e AS (SELECT station_id, as_of, 1e0 - 1e-1 * (1e0 - EXP(-ARG_MAX(eqd, dt) / 30e0)) AS iwsr FROM r GROUP BY 1, 2)
       SELECT station_id, as_of, iwsr, CAST(iwsr < 0.944 AS INT) AS label FROM e""", "iwsr")
def w08(t):
    return P.equivalent_day_labels(label_days(t), ["station_id", "as_of"], 0.944, SCORING)


@query("w08_equivalent_day_point_labels",
       eqd_sql(look("pm10", 365, AT_SQL), "station_id, as_of")
       + """, e AS (SELECT station_id, as_of, 1e0 - 25e-2 * (1e0 - EXP(-ARG_MAX(eqd, dt) / 30e0)) AS iwsr FROM r GROUP BY 1, 2)
       SELECT station_id, as_of, iwsr, CAST(iwsr < 0.90 AS INT) AS label FROM e""", "iwsr")
def w08_point(t):
    rows = station_days(t, 365, inclusive=False)
    return P.equivalent_day_labels(rows, ["station_id", "as_of"], 0.90, EquivalentDay())


@query("w09_kimber_features",
       kimber_sql(look("pm2_5", 364), "station_id, as_of") + """
       SELECT station_id, as_of, AVG(v) AS kimber_iwsr_proxy,
         AVG(CASE WHEN dt > as_of - 7 THEN v END) AS kimber_iwsr_7d_mean,
         AVG(CASE WHEN dt > as_of - 30 THEN v END) AS kimber_iwsr_30d_mean,
         AVG(CASE WHEN dt > as_of - 90 THEN v END) AS kimber_iwsr_90d_mean FROM r GROUP BY 1, 2""",
       "kimber_iwsr_proxy, kimber_iwsr_7d_mean, kimber_iwsr_30d_mean, kimber_iwsr_90d_mean", digits=9)
def w09_kimber(t):
    rows = label_days(t)
    cols = ["kimber_iwsr_proxy", *[f"kimber_iwsr_{w}d_mean" for w in (7, 30, 90)]]
    return X.feature_rows(rows, ["station_id", "as_of"], Features(use_equivalent_day=False)).select(
        "station_id", "as_of", *cols)


@query("w09_equivalent_day_features",
       eqd_sql(look("pm10", 364), "station_id, as_of") + """
       , l AS (SELECT *, 1e-1 * (1e0 - EXP(-eqd / 30e0)) AS sl FROM r)
       SELECT station_id, as_of, ARG_MAX(sl, dt) AS eqd_loss_proxy,
         AVG(CASE WHEN dt > as_of - 7 THEN sl END) AS eqd_loss_7d_mean,
         AVG(CASE WHEN dt > as_of - 30 THEN sl END) AS eqd_loss_30d_mean FROM l GROUP BY 1, 2""",
       "eqd_loss_proxy, eqd_loss_7d_mean, eqd_loss_30d_mean")
def w09_eqd(t):
    return X.feature_rows(label_days(t), ["station_id", "as_of"], Features(use_kimber=False)).select(
        "station_id", "as_of", "eqd_loss_proxy", "eqd_loss_7d_mean", "eqd_loss_30d_mean")


@query("w10_score_series",
       eqd_sql(look("pm10", 365, AT_SQL), "station_id, as_of")
       + """, e AS (SELECT station_id, as_of, ARG_MAX(eqd, dt) AS q FROM r GROUP BY 1, 2),
       h AS (SELECT station_id, MAX(CASE WHEN p >= 10 THEN dt END) AS last_rain_date FROM s GROUP BY 1)
       SELECT e.station_id, LEAST(1e0, 1e-1 * (1e0 - EXP(-q / 30e0)) / 1e-1) AS risk_score,
         ROUND(10e0 * (1e0 - EXP(-q / 30e0)), 3) AS soiling_loss_pct, ROUND(q, 1) AS eqd, h.last_rain_date
       FROM e JOIN h USING (station_id)""", "risk_score, soiling_loss_pct, eqd")
def w10(t):
    rows = station_days(t, 365, inclusive=False)
    return P.score_series(rows, ["station_id", "as_of"]).drop("as_of")


@query("w12_series_median_fill", """
    SELECT station_id, dt, COALESCE(wind_speed_10m_max, MEDIAN(wind_speed_10m_max) OVER (PARTITION BY station_id), 0) AS wind
    FROM f_daily""", "wind")
def w12(t):
    return P.fill_from_median(t.f_daily, ["station_id"], "wind_speed_10m_max", "wind", 0.0).select(
        "station_id", "dt", "wind")
